"""Source divergence audit: which sources of a language differ, and by which terms, found by bounds instead of by scoring every term."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterlake.llm.common import released, small, small_batches, table, written

#: A term is kept in a language from this many of its documents on; terms that are reported of a group.
LEAST_DOCS, TOP = 3, 200
#: Distinct terms that a task counts before it passes its counts on, and pair values that it adds up at a time.
HELD, PAIRS = 800_000, 1_000_000
#: Buckets of a group that are evaluated in the first round; each later round takes four times as many.
FIRST = 16
#: Bytes of terms stay, A-Z become lower case, all others separate terms.
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: str) -> list[bytes]:
    r"""Matches of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`, only A-Z lower-cased: in UTF-8, no byte of a longer character is below 0x80."""
    return text.encode("utf-8", "replace").translate(_TERMS).split()


def probability(count: str, total: str, size: str) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + size)), exact: the product may pass 64 bits. Names of columns."""
    return F.expr(f"1L + (CAST({count} + 1 AS DECIMAL(19,0)) * 1000000000BD) div CAST({total} + {size} AS DECIMAL(20,0))")


def excess(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); probabilities are 10^9 + 1 at most, so that the square fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def postings(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, n, sources array<struct<source, n>>) of documents (text, lang, source): each term of a language with its documents and occurrences, and its occurrences by source.

    A term that is null lists every source of the language, with or without terms. Tasks count before anything moves, so that a hot
    source or term is one row of a task; a row's array is bounded by the number of sources.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = defaultdict(Counter)
        again: dict = defaultdict(Counter)  # occurrences beyond the first of a document: few terms have any

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                keys, more = list(own), again[lang, source]
                for at in range(0, max(len(keys), 1), 20_000):
                    some = keys[at : at + 20_000]
                    rows = [(None, 0, 0)] * (at == 0) + [(k.decode(), own[k], own[k] - more.get(k, 0)) for k in some]
                    t, a, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t), pa.string()), pa.array([source] * len(t), pa.string()), pa.array(t, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["lang", "source", "term", "n", "docs"])
            n.clear()
            again.clear()

        for b in batches:
            for text, lang, source in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = terms(text or "")
                n[lang, source].update(found)
                if len(set(found)) < len(found):
                    more = again[lang, source]
                    for t, k in Counter(found).items():
                        if k > 1:
                            more[t] += k - 1
            if sum(map(len, n.values())) > HELD:
                yield from out()
        yield from out()

    rows = docs.select("text", F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"))
    counts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))


def groups(post: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, id, total, size, lang_total, none): each source of a language, numbered, with the occurrences of kept terms in it, their number and occurrences in the language, and the probability of a kept term that it lacks."""
    kept = post.where(F.col("term").isNotNull() & (F.col("docs") >= least))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("lang_total"))
    of_group = kept.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = post.where("term IS NULL").select("lang", F.inline("sources")).select("lang", "source")
    g = every.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "size", "lang_total"])
    number = F.row_number().over(W.partitionBy("lang").orderBy("source"))  # of as many rows as a language has sources
    return g.select("lang", "source", number.alias("id"), "total", "size", "lang_total", F.when(F.col("size") > 0, probability("0", "total", "size")).alias("none"))


def top_terms(post: DataFrame, group: DataFrame, least: int = LEAST_DOCS, top: int = TOP, first: int = FIRST) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source has more of than its language, the greatest values of f first.

    f grows with the group's probability p and falls with the language's q. A bucket holds the terms of a group of about one count, split
    by octaves of q; f at its greatest p and least q bounds them. Buckets are evaluated best bound first, a few at once, until no
    bound of those left reaches the kth value found: one that equals it could still win a tie. Groups that are done take no part in later rounds.
    """
    kept = post.where(F.col("term").isNotNull() & (F.col("docs") >= least)).select("lang", "term", F.col("n").alias("lang_n"), F.inline("sources"))
    own = kept.where("n > 0").join(small(group.where("size > 0")), ["lang", "source"]).select("lang", "source", "term", "n", probability("n", "total", "size").alias("p"), probability("lang_n", "lang_total", "size").alias("q")).where("p > q")
    own = written(own.withColumn("bucket", F.floor(F.log2("n") * 8) * 64 + F.floor(F.log2("q"))).drop("n"), "terms")
    bound = own.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q")).select("lang", "source", "bucket", excess("p", "q").alias("bound"))
    best_first = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket"))  # buckets: some hundreds a group
    bound = written(bound.withColumn("at", best_first), "bounds")
    last = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found, open_, low, high = None, None, 0, first
    while True:
        now = bound.where((F.col("at") > low) & (F.col("at") <= high))
        now = now if open_ is None else now.join(small(open_), ["lang", "source"], "left_semi")
        value = own.join(small(written(now.select("lang", "source", "bucket"), "buckets")), ["lang", "source", "bucket"]).select("lang", "source", F.col("term").alias("item"), excess("p", "q").alias("value"))
        both = value if found is None else found.drop("rank").unionByName(value)
        found = written(both.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top), "found")
        kth = found.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
        left = bound.where(F.col("at") == high + 1).join(kth, ["lang", "source"], "left").where("kth IS NULL OR bound >= kth")
        open_ = written(left.select("lang", "source"), "open")
        if open_.isEmpty():
            return found
        low, high = high, high * 4


def pair_values(post: DataFrame, group: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, item, value): f summed over all kept terms, for each source and each other one of its language.

    Most terms are in few sources. With f0 for a term that both lack, the sum is f0 for each kept term, and a correction for each term
    of either source, which depends on its count alone and so is made once for each count that occurs, and one for each term that both
    have, which the term's postings give. Tasks add the latter up before they pass them on.
    """
    side = lambda s: group.select("lang", *(F.col(c).alias(c + s) for c in ("source", "id", "none")), "size") if s == "1" else group.select("lang", *(F.col(c).alias(c + s) for c in ("source", "id", "none")))
    pair = written(side("1").join(side("2"), "lang").where("id1 <> id2"), "pairs")  # as many rows as the result
    kept = post.where(F.col("term").isNotNull() & (F.col("docs") >= least))
    each = kept.select("lang", F.posexplode("sources")).select("lang", "col.source", "col.n").where("n > 0")
    each = each.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")).join(small(group), ["lang", "source"])
    each = written(each.select("lang", "id", probability("n", "total", "size").alias("p"), "m"), "counts")
    base = excess("none1", "none2")
    one = pair.join(each.withColumnRenamed("id", "id1"), ["lang", "id1"]).select("lang", "id1", "id2", (F.col("m") * (excess("p", "none2") - base)).alias("v"))
    two = pair.join(each.withColumnRenamed("id", "id2"), ["lang", "id2"]).select("lang", "id1", "id2", (F.col("m") * (excess("none1", "p") - base)).alias("v"))
    both = shared_terms(kept, group)
    start = pair.select("lang", "id1", "id2", F.coalesce(F.col("size") * base, F.lit(0)).alias("v"))
    total = start.unionByName(one).unionByName(two).unionByName(both).groupBy("lang", "id1", "id2").agg(F.sum("v").alias("value"))
    return pair.join(total, ["lang", "id1", "id2"]).select("lang", F.col("source1").alias("source"), F.col("source2").alias("item"), "value")


def shared_terms(kept: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, id1, id2, v): corrections for the terms that two sources have, from the postings; parts of a sum."""
    some = kept.where(F.size("sources") > 1).withColumn("word", F.monotonically_increasing_id())
    with_p = some.select("lang", "word", F.inline("sources")).join(small(group), ["lang", "source"]).select("lang", "word", F.struct("id", probability("n", "total", "size").alias("p"), "none").alias("x"))
    lists = with_p.groupBy("lang", "word").agg(F.collect_list("x").alias("x")).select("lang", "x.id", "x.p", "x.none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in set(b.column(0).to_pylist()):
                own = b.filter(pa.compute.equal(b.column(0), lang))
                sizes = pa.compute.list_value_length(own.column(1)).to_numpy()
                flat = [own.column(i).flatten().to_numpy() for i in (1, 2, 3)]
                yield from sums(lang, sizes, *flat)

    def sums(lang: str, sizes: np.ndarray, ids: np.ndarray, p: np.ndarray, none: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Each element meets all of its list: chunks of elements with a bounded number of partners; a list longer than that is met in parts.
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        partners = np.repeat(sizes, sizes).astype(np.int64)
        at = 0
        while at < len(ids):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(partners[at:]), PAIRS, "right")) + at)
            i = np.repeat(np.arange(at, stop), partners[at:stop])
            j = np.arange(len(i)) - np.repeat(np.cumsum(partners[at:stop]) - partners[at:stop], partners[at:stop]) + begin[i]
            i, j = i[i != j], j[i != j]
            f = lambda a, c: (a - c) ** 2 // c
            v = f(p[i], p[j]) - f(p[i], none[j]) - f(none[i], p[j]) + f(none[i], none[j])
            keys, where = np.unique(ids[i].astype(np.int64) << 32 | ids[j], return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, where, v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(total)], names=["lang", "id1", "id2", "v"])
            at = stop

    return lists.mapInArrow(run, "lang string, id1 int, id2 int, v long")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of a language by how far a source's terms differ from theirs (part pair), and the terms that it has more of than its language (part term).

    Documents are rows: repeated ones count again. Null text, lang and source count as empty; a source without terms has a rank among
    others all the same. Ties are in byte order of the item. An empty table gives an empty result; other columns are not read.
    """
    post = written(postings(docs), "postings")
    g = written(groups(post, least), "groups")
    by_value = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs_ = pair_values(post, g, least).withColumn("rank", by_value)
    each = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return each(pairs_, "pair").unionByName(each(top_terms(post, g, least, top), "term"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text, lang and source are read as empty. Repeated rows and rows without an id are documents like others; very long texts are counted whole; ties go by the item's bytes; an empty table gives an empty result; other columns are not read."""
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
total AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(total.n, 0) + l.v))::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (k.lang_n + 1) // (l.n + l.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source, t.source AS item, sum((s.p - t.p) * (s.p - t.p) // t.p) AS value FROM p s JOIN p t ON s.lang = t.lang AND s.term = t.term GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
