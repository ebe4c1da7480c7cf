"""Profile search on tables: proteins against a profile database."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clusterlake.functions.domains import FILTER, Database
from clusterlake.functions.profiles import parse_profile
from clusterlake.operators.alignment import without_overlaps
from clusterlake.operators.evaluate import numbered
from clusterlake.plans.scratch import released, small_batches, written

HIT = "gene_id long, accession string, start int, stop int, score double, alignment string, pvalue double"
#: Profiles that the driver and a task hold at once, some 75 kB each; a database is scanned in as many passes as it has such parts.
PROFILES_AT_ONCE = 2_000


def search(genes: DataFrame, profiles: DataFrame, overlap: float = 0.1, filter_p: float = FILTER) -> DataFrame:
    """Hits of (gene_id, aa_seq) that reach a profile's trusted cutoff (0 without one), overlaps resolved, each with its aligned string of the profile's length. A gene has as many hits of a profile as it has domains.

    Profiles that a gene has no good stretch without gaps of are left out ahead: filter_p is the greatest p-value of one, 1 for the full program.

    Profiles (accession, trusted_domain, body) are a reference of its own size, which doesn't grow with the genes: they go to the workers
    in parts of PROFILES_AT_ONCE, one after the other, and each part's hits are written before the next one is read.
    """
    spark = genes.sparkSession
    small_batches(spark)
    arrow = to_arrow_schema(StructType.fromDDL(HIT))
    every = written(numbered(profiles.select("accession", "trusted_domain", "body"), [F.col("accession"), F.col("body")], "nth"), "profiles")
    found = None
    for at in range(0, max(1, every.count()), PROFILES_AT_ONCE):
        rows = [(r["accession"], r["trusted_domain"], r["body"]) for r in every.where((F.col("nth") > at) & (F.col("nth") <= at + PROFILES_AT_ONCE)).collect()]
        part = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            models = Database([parse_profile(body, accession, trusted) for accession, trusted, body in part.value], [body for _, _, body in part.value])
            for b in batches:
                out = []
                for gene, aa in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for p, d in models.domains(aa or "", filter_p):
                        if d.score >= (p.trusted or 0.0):
                            out.append({"gene_id": gene, "accession": p.accession, "start": d.start, "stop": d.stop, "score": d.score, "alignment": d.aligned, "pvalue": d.pvalue})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        hits = written(genes.select("gene_id", "aa_seq").mapInArrow(run, HIT), "hits")
        part.unpersist()
        found = hits if found is None else found.unionByName(hits)
    released(every)
    return without_overlaps(found, overlap)
