"""Annotated sequence files in GenBank's flat format, as tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clusterlake.functions.biology import in_frame, reverse_complement, translate
from clusterlake.operators.filters import file_name_filter
from clusterlake.plans.scratch import small_batches, written

#: Kinds of candidate clusters whose protoclusters are merged.
MERGED_KINDS = ("chemical_hybrid", "interleaved")
LEVELS = {"region": "region_number", "cand_cluster": "candidate_cluster_number", "protocluster": "protocluster_number", "proto_core": "protocluster_number"}
RECORD = "struct<record_type:string,number:int,parent_type:string,parent_number:int,children:array<int>,nt_start:int,nt_stop:int,product:string,category:string,kind:string,contig_edge:boolean>"
CDS = "struct<orf:int,nt_start:int,nt_stop:int,strand:int,gene_kind:string,aa_seq:string>"
SCHEMA = f"path string, hash string, nt_len int, organism string, taxonomy string, description string, version string, records array<{RECORD}>, cds array<{CDS}>, error string"


class BadFile(ValueError):
    """A file that lacks what its layout needs."""


#: A span of one part, as nearly all are.
SPAN = re.compile(r"(complement\()?(\d+)\.\.(\d+)(?(1)\))")
LETTERS, PARTS = re.compile(r"[A-Za-z0-9_.]+:"), re.compile(r"<?(\d+)(?:\.\.>?(\d+))?")


def parse_location(text: str) -> tuple[int, int, int, list[tuple[int, int]], bool, bool]:
    """(start, stop, strand, parts, fuzzy start, fuzzy end): 0-based and half open."""
    if m := SPAN.fullmatch(text):
        a, b = int(m[2]) - 1, int(m[3])
        return a, b, -1 if m[1] else 1, [(a, b)], False, False
    strand = -1 if text.startswith("complement(") else 1
    spans = [(int(a), int(b or a)) for a, b in PARTS.findall(LETTERS.sub("", text))]
    if not spans:
        raise BadFile(f"no position in {text!r}")
    parts = [(a - 1, b) for a, b in spans]
    return min(a for a, _ in parts), max(b for _, b in parts), strand, parts, "<" in text, ">" in text


def parse_flat_file(text: str) -> dict:
    """Header fields, features (type, location, qualifiers) and the sequence of the first record."""
    out: dict = {"organism": "Unknown", "taxonomy": "Unknown", "description": "", "comment": "", "features": [], "sequence": "", "length": 0}
    part, lines = "", text.split("\n//")[0].splitlines()
    taxonomy: list[str] = []
    sequence: list[str] = []
    feature: list[str] = []

    def flush() -> None:
        if not feature:
            return
        kind, location = feature[0].split(None, 1)
        if (plain := _plain(feature)) is not None:
            out["features"].append((kind, location.replace(" ", ""), plain))
            feature.clear()
            return
        k = 1
        while k < len(feature) and not feature[k].startswith("/"):
            location += feature[k]
            k += 1
        qualifiers: dict[str, list[str]] = {}
        raw: list[str] = []
        for x in feature[k:]:
            if x.startswith("/") and (not raw or raw[-1].count('"') != 1 and not _open(raw)):
                raw.append(x)
            elif raw:
                raw[-1] += ("" if raw[-1].startswith("/translation") else " ") + x
        for x in raw:
            name, _, value = x[1:].partition("=")
            qualifiers.setdefault(name, []).append(value.strip().strip('"').replace('""', '"'))
        out["features"].append((kind, location.replace(" ", ""), qualifiers))
        feature.clear()

    for line in lines:
        if part == "FEATURES" and line.startswith("     "):
            if line[5:6].strip():
                flush()
            feature.append(line.strip())
            continue
        if line[:1].strip():
            flush()
            part = line.split()[0]
        if part == "LOCUS" and line.startswith("LOCUS"):
            m = re.search(r"\s(\d+)\s+(?:bp|aa)\b", line)
            out["length"] = int(m[1]) if m else 0
        elif part == "DEFINITION":
            out["description"] = (out["description"] + " " + line[12:].strip()).strip()
        elif part == "SOURCE" and line.strip().startswith("ORGANISM"):
            out["organism"] = line[12:].strip() or "Unknown"
            taxonomy.append("")
        elif part == "SOURCE" and taxonomy:
            taxonomy.append(line.strip())
        elif part == "COMMENT":
            out["comment"] += line[12:] + "\n"
        elif part == "ORIGIN" and line.startswith(" "):
            sequence.append("".join(line.split()[1:]))
    flush()
    ranks = [x.strip() for x in " ".join(taxonomy).rstrip(". ").split(";") if x.strip()]
    out["taxonomy"] = ";".join(ranks) or "Unknown"
    out["sequence"] = "".join(sequence).upper()
    out["length"] = len(out["sequence"]) or out["length"]
    return out


def _plain(feature: list[str]) -> dict[str, list[str]] | None:
    """Qualifiers of a feature each line of which is one, with a value in one pair of quotes or none; None of any other."""
    out: dict[str, list[str]] = {}
    for x in feature[1:]:
        if x[:1] != "/":
            return None
        name, _, value = x[1:].partition("=")
        quotes = x.count('"')
        if quotes == 2 and value[:1] == '"' == value[-1:]:
            value = value[1:-1]
        elif quotes:
            return None
        else:
            value = value.strip()
        if name in out:
            out[name].append(value)
        else:
            out[name] = [value]
    return out


def _open(raw: list[str]) -> bool:
    """Whether the last qualifier's quotes are still open."""
    return raw[-1].count('"') % 2 == 1


def version_of(comment: str) -> str:
    """The version of the annotating program; 4 without one, and 5 for 1.x of its gut variant."""
    m = re.search(r"##\w*antiSMASH-Data-START##.*?Version\s*::\s*(\S+)", comment, re.S | re.I)
    if not m:
        return "5" if "gutSMASH" in comment else "4"
    return "5" if m[1].startswith("1.") or "gutSMASH" in comment else m[1]


def _one(q: dict, name: str, default: str | None = None) -> str | None:
    return q[name][0] if name in q else default


def records_of(flat: dict, force: bool = False) -> list[dict]:
    """Records of all levels, each with the number of its parent."""
    version = version_of(flat["comment"])
    features = flat["features"]
    base = {"parent_type": None, "parent_number": None, "children": [], "category": None, "kind": None}

    def record(level: str, number: int, location: str, q: dict, **more) -> dict:
        start, stop, *_ = parse_location(location)
        return base | {"record_type": level, "number": number, "nt_start": start, "nt_stop": stop, "product": ".".join(sorted(q.get("product", ["other"]))), "contig_edge": _one(q, "contig_edge") == "True"} | more

    major = re.match(r"\d+", version)
    if major and int(major[0]) < 5:
        clusters = [f for f in features if f[0] == "cluster"]
        if not clusters:
            if not force:
                raise BadFile("no cluster feature")
            return [base | {"record_type": "region", "number": 1, "nt_start": 0, "nt_stop": flat["length"], "product": "other", "contig_edge": None}]
        if len(clusters) > 1:
            raise BadFile("more than one cluster feature")
        _, location, q = clusters[0]
        m = re.search(r"Cluster number: (\d+)", " ".join(q.get("note", [])))
        if not m:
            raise BadFile("a cluster without number")
        return [record("region", int(m[1]), location, q | {"product": (_one(q, "product") or "other").split("-")})]
    found: dict[str, dict[int, dict]] = {k: {} for k in LEVELS}
    for kind, location, q in features:
        if kind not in LEVELS:
            continue
        number = _one(q, LEVELS[kind])
        if number is None:
            raise BadFile(f"a {kind} without number")
        if kind == "region" and found["region"]:
            raise BadFile("more than one region feature")
        children = q.get({"region": "candidate_cluster_numbers", "cand_cluster": "protoclusters"}.get(kind, ""), [])
        more = {"children": [int(c) for c in children], "kind": _one(q, "kind")}
        if kind == "protocluster":
            more["category"] = _one(q, "category", "Categoryless")
        found[kind][int(number)] = record(kind, int(number), location, q, **more)
    if not found["region"]:
        if not force:
            raise BadFile("no region feature")
        return [base | {"record_type": "region", "number": 1, "nt_start": 0, "nt_stop": flat["length"], "product": "other", "contig_edge": None}]
    region = next(iter(found["region"].values()))
    for upper, lower in (("region", "cand_cluster"), ("cand_cluster", "protocluster")):
        for r in found[upper].values():
            for c in r["children"]:
                if c not in found[lower]:
                    raise BadFile(f"{upper} {r['number']} names {lower} {c}, which isn't there")
                found[lower][c] |= {"parent_type": upper, "parent_number": r["number"]}
    for number, p in found["protocluster"].items():
        if number not in found["proto_core"]:
            raise BadFile(f"protocluster {number} has no core")
        found["proto_core"][number] |= {"parent_type": "protocluster", "parent_number": number, "category": p["category"]}
    merge_hybrids(found)
    labels = lambda rows: ".".join(sorted({c for r in rows if r["category"] for c in r["category"].split(".")})) or None
    for r in found["cand_cluster"].values():
        r["category"] = labels([found["protocluster"][c] for c in r["children"]])
    region["category"] = labels(list(found["protocluster"].values()))
    return [r for k in LEVELS for r in found[k].values()]


def merge_hybrids(found: dict[str, dict[int, dict]]) -> None:
    """Makes the protoclusters of each chemical hybrid or interleaved candidate cluster one, and their cores: of the least number, from the first start to the last stop, with the labels of all. Every candidate cluster that names one of them names it instead."""
    renamed: dict[int, int] = {}
    for c in found["cand_cluster"].values():
        parts = sorted(set(c["children"]))
        if c["kind"] not in MERGED_KINDS or len(parts) < 2:
            continue
        for level in ("protocluster", "proto_core"):
            rows = [found[level][n] for n in parts if n in found[level]]
            if rows:
                labels = lambda k: ".".join(sorted({x for r in rows if r[k] for x in r[k].split(".")})) or None  # noqa: E731, B023
                edge = any(r["contig_edge"] for r in rows)
                found[level][parts[0]] = rows[0] | {"number": parts[0], "parent_number": c["number"] if level == "protocluster" else parts[0], "nt_start": min(r["nt_start"] for r in rows), "nt_stop": max(r["nt_stop"] for r in rows), "product": labels("product"), "category": labels("category"), "contig_edge": edge}
        renamed |= dict.fromkeys(parts, parts[0])
    for level in ("protocluster", "proto_core"):
        for n, new in renamed.items():
            if n != new:
                found[level].pop(n, None)
    for c in found["cand_cluster"].values():
        c["children"] = sorted({renamed.get(n, n) for n in c["children"]})


def same_translation(given: str, made: str) -> bool:
    """Whether a translation is the one made from the sequence, but for the first residue, which may stand for another start codon."""
    return given == made or given[1:] == made[1:]


def genes_of(flat: dict) -> list[dict]:
    """Coding sequences with their place among all of the file; those without a translation get one, and are left out if there is none."""
    out = []
    for orf, (_, location, q) in enumerate((f for f in flat["features"] if f[0] == "CDS"), 1):
        start, stop, strand, parts, fuzzy_start, fuzzy_end = parse_location(location)
        aa = _one(q, "translation")
        if aa is None and flat["sequence"]:
            nt = "".join(flat["sequence"][a:b] for a, b in sorted(parts))
            nt = reverse_complement(nt) if strand < 0 else nt
            aa = translate(in_frame(nt, fuzzy_start if strand > 0 else fuzzy_end, fuzzy_end if strand > 0 else fuzzy_start), int(_one(q, "transl_table", "1")))
        kind = _one(q, "gene_kind") or next((m[1] for x in q.get("sec_met", []) if (m := re.match(r"Kind: (\w+)", x))), None)
        if aa:
            out.append({"orf": orf, "nt_start": start, "nt_stop": stop, "strand": strand, "gene_kind": kind, "aa_seq": aa.replace(" ", "")})
    return out


def parse_file(path: str, content: bytes, force: bool = False) -> dict:
    """A row of SCHEMA; what is wrong with a file is in error."""
    row: dict = {"path": path, "hash": hashlib.sha256(content).hexdigest(), "records": [], "cds": [], "error": None}
    try:
        flat = parse_flat_file(content.decode("utf-8", "replace"))
        row |= {"nt_len": flat["length"], "organism": flat["organism"], "taxonomy": flat["taxonomy"], "description": flat["description"], "version": version_of(flat["comment"])}
        row["cds"] = genes_of(flat)  # these are read even where the records are not as they should be
        row["records"] = records_of(flat, force)
    except (BadFile, ValueError, IndexError) as e:
        row |= {k: row.get(k) for k in ("nt_len", "organism", "taxonomy", "description", "version")} | {"error": f"{type(e).__name__}: {e}"}
    return row


def found_files(spark: SparkSession, path: str, include: tuple[str, ...] = ("cluster", "region"), exclude: tuple[str, ...] = ("final",), recursive: bool = True) -> DataFrame:
    """(path, content) of the .gbk files of a folder; names are tested before contents are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gbk").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(file_name_filter(F.element_at(F.split("path", "/"), -1), include, exclude)).select("path", "content")


def read_files(spark: SparkSession, path: str, include: tuple[str, ...] = ("cluster", "region"), exclude: tuple[str, ...] = ("final",), recursive: bool = True, force: bool = False) -> DataFrame:
    """Parsed .gbk files of a folder, one row each, of equal contents the least path; files are parsed where they are read."""
    return parsed(found_files(spark, path, include, exclude, recursive), force)


#: Fixed value: what names of files of the reference set hold.
REFERENCE_SET = ("BGC",)


def read_reference_set(spark: SparkSession, path: str, exclude: tuple[str, ...] = ("final",), force: bool = False) -> DataFrame:
    """read_files() of a downloaded reference set."""
    return read_files(spark, path, REFERENCE_SET, exclude, force=force)


#: Paths that are broadcast at most.
FEW_PATHS = 1_000_000


def listed(files: DataFrame) -> DataFrame:
    """(path, hash) of files (path, content), which are hashed where they are read: of equal contents the least path."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash")).groupBy("hash").agg(F.min("path").alias("path")).select("path", "hash")


def parsed(files: DataFrame, force: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Rows (path, content) parsed where they are; of equal contents the least path. Hashes are compared before anything is parsed: a copy never is, and with only (path, hash), a part of listed(), no other file."""
    keep = written(listed(files) if only is None else only, "paths")
    keep = F.broadcast(keep) if keep.count() <= FEW_PATHS else keep
    files = files.select("path", F.col("content").cast("binary").alias("content")).join(keep.select("path"), "path")
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 20):
                rows = [parse_file(r["path"], r["content"] or b"", force) for r in b.slice(i, 20).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    small_batches(files.sparkSession, 100)
    return files.mapInArrow(run, SCHEMA)


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """containers, records and genes of the files without an error, which the caller has to look at; ids are hashes of the contents, so that they are the same in every run."""
    ok = files.where("error IS NULL").withColumn("container_id", F.xxhash64("hash"))
    key = lambda kind, number: F.xxhash64("hash", kind, number)
    containers = ok.select("container_id", "path", "hash", "nt_len", "organism", "taxonomy", "description", "version")
    r = ok.select("container_id", "hash", F.explode("records").alias("r")).select("container_id", "hash", "r.*")
    parent = F.when(F.col("parent_number").isNotNull(), key(F.col("parent_type"), F.col("parent_number")))
    parent = F.coalesce(parent, F.when(F.col("record_type") == "cand_cluster", key(F.lit("region"), F.lit(None).cast("int"))))
    records = r.select(key(F.col("record_type"), F.col("number")).alias("record_id"), "container_id", parent.alias("parent_id"), "record_type", "number", "nt_start", "nt_stop", "product", "category", "kind", "contig_edge")
    genes = ok.select("container_id", F.explode("cds").alias("g")).select(F.xxhash64("container_id", "g.orf").alias("gene_id"), "container_id", "g.*")
    return {"containers": containers, "records": records, "genes": genes}
