"""Similarities of records as joins and expressions: Jaccard, adjacency, domain copies, and the weighted distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterlake.operators import blocks


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(n / F.size(F.array_union(a, b)))


def neighbour_pairs(domains: Column) -> Column:
    """Distinct neighbouring pairs of an array of strings, each pair in alphabetical order."""
    n = F.size(domains)
    pair = lambda i: F.array_sort(F.slice(domains, i, 2))
    return F.when(n < 2, F.array().cast("array<array<string>>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), pair)))


def adjacency(a: Column, b: Column) -> Column:
    """1 for two single equal domains, 0 if either has fewer than two, else the Jaccard index of neighbouring pairs."""
    single = (F.size(a) == 1) & (F.size(b) == 1) & (F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1)))
    return F.when(single, F.lit(1.0)).when((F.size(a) < 2) | (F.size(b) < 2), F.lit(0.0)).otherwise(jaccard(neighbour_pairs(a), neighbour_pairs(b)))


def sequence_score(da: Column, na: Column, dn: Column, nn: Column, boost: float) -> Column:
    """Domain sequence similarity from the distance d and the count n of anchor (a) and other (n) domains."""
    pa, pn = na * boost / (na + nn), nn / (na + nn)
    both = 1 - (pn / (pa + pn) * dn / nn + pa / (pa + pn) * da / na)
    return F.when(na == 0, 1 - dn / nn).when(nn == 0, 1 - da / na).otherwise(both)


def record_tokens(records: DataFrame, genes: DataFrame, anchors: tuple[str, ...]) -> DataFrame:
    """(bin, record_id, container_id, token, domain, gene, anchor, other, gram): what a record has, its domains and neighbouring pairs of them, once each, with what each counts for.

    Genes are ordered once; each gives its domain and the pair with the next one, which are counted where they are.
    """
    ordered = genes.select("record_id", "domain", F.lead("domain").over(W.partitionBy("record_id").orderBy("orf")).alias("next"))
    gram = F.when(F.col("next").isNotNull(), F.concat_ws("\t", F.least("domain", "next"), F.greatest("domain", "next")))
    each = ordered.select("record_id", F.explode(F.array(F.struct(F.lit(1).alias("domain"), F.col("domain").alias("token")), F.struct(F.lit(0).alias("domain"), gram.alias("token")))).alias("t")).select("record_id", "t.*").where("token IS NOT NULL")
    n = each.groupBy("record_id", "token", "domain").agg(F.count(F.lit(1)).alias("n"))
    gene = F.when(F.col("domain") == 1, F.col("n")).otherwise(0)
    anchor = F.col("token").isin(*anchors)
    counts = [gene.alias("gene"), F.when(anchor, gene).otherwise(0).alias("anchor"), F.when(anchor, 0).otherwise(gene).alias("other"), (1 - F.col("domain")).alias("gram")]
    return records.select("bin", "record_id", "container_id").join(n.select("record_id", "token", "domain", *counts), "record_id")


def scored_pairs(records: DataFrame, genes: DataFrame, anchors: tuple[str, ...], weights: tuple[float, float, float, float], below: float | None = None) -> DataFrame:
    """(bin, a, b, jaccard, adjacency, dss, distance), rounded to six places, of all pairs with a common domain, or those whose distance is less than below; any other pair has distance 1.

    Whole records are compared (no region is chosen), and copies of a domain count as alike, so that everything is a count of tokens.
    """
    return blocks.scores(records, genes, anchors, weights, below)


SQL_EDGES = """copies AS (SELECT record_id, domain, count(*) AS n, domain IN ({anchors}) AS anchor FROM gene GROUP BY ALL),
per AS (SELECT record_id, count(*) AS domains, sum(n) AS genes, coalesce(sum(n) FILTER (anchor), 0) AS anchors, coalesce(sum(n) FILTER (NOT anchor), 0) AS others FROM copies GROUP BY 1),
gram AS (SELECT DISTINCT record_id, least(domain, nxt) AS x, greatest(domain, nxt) AS y FROM (SELECT record_id, domain, lead(domain) OVER (PARTITION BY record_id ORDER BY orf) AS nxt FROM gene) WHERE nxt IS NOT NULL),
ngram AS (SELECT record_id, count(*) AS grams FROM gram GROUP BY 1),
pair AS (
  SELECT ra.bin, ra.record_id AS a, rb.record_id AS b, count(*) AS inter, sum(CASE WHEN x.anchor THEN least(x.n, y.n) ELSE 0 END) AS ma, sum(CASE WHEN x.anchor THEN 0 ELSE least(x.n, y.n) END) AS mn
  FROM rec ra JOIN rec rb ON ra.bin = rb.bin AND ra.record_id < rb.record_id AND ra.container_id <> rb.container_id
  JOIN copies x ON x.record_id = ra.record_id JOIN copies y ON y.record_id = rb.record_id AND x.domain = y.domain GROUP BY ALL),
near AS (SELECT p.a, p.b, count(*) AS common FROM pair p JOIN gram x ON x.record_id = p.a JOIN gram y ON y.record_id = p.b AND x.x = y.x AND x.y = y.y GROUP BY ALL),
part_ AS (
  SELECT p.bin, p.a, p.b, inter, coalesce(common, 0) AS common, pa.domains AS d1, pb.domains AS d2, pa.genes AS g1, pb.genes AS g2, coalesce(ga.grams, 0) + coalesce(gb.grams, 0) AS gg,
    pa.anchors + pb.anchors - 2 * ma AS da, pa.anchors + pb.anchors - ma AS na, pa.others + pb.others - 2 * mn AS dn, pa.others + pb.others - mn AS nn
  FROM pair p JOIN per pa ON pa.record_id = p.a JOIN per pb ON pb.record_id = p.b LEFT JOIN ngram ga ON ga.record_id = p.a LEFT JOIN ngram gb ON gb.record_id = p.b LEFT JOIN near n ON n.a = p.a AND n.b = p.b),
score AS (
  SELECT bin, a, b, round(inter / (d1 + d2 - inter), 6) AS jaccard,
    round(CASE WHEN g1 = 1 AND g2 = 1 THEN 1.0::DOUBLE WHEN g1 < 2 OR g2 < 2 THEN 0.0::DOUBLE ELSE common / (gg - common) END, 6) AS adjacency,
    round(CASE WHEN na = 0 THEN 1 - dn / nn WHEN nn = 0 THEN 1 - da / na ELSE 1 - (
      (nn / (na + nn)) / ((na * {boost} / (na + nn)) + (nn / (na + nn))) * dn / nn + (na * {boost} / (na + nn)) / ((na * {boost} / (na + nn)) + (nn / (na + nn))) * da / na) END, 6) AS dss FROM part_),
edge AS (SELECT *, round(1 - (jaccard * {wj}::DOUBLE + adjacency * {wa}::DOUBLE + dss * {wd}::DOUBLE), 6) AS distance FROM score)"""


def sql_edges(anchors: tuple[str, ...], weights: tuple[float, float, float, float]) -> str:
    wj, wa, wd, boost = weights
    return SQL_EDGES.format(anchors=", ".join(f"'{a}'" for a in anchors), boost=f"{boost}::DOUBLE", wj=wj, wa=wa, wd=wd)
