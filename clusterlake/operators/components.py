"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlake.plans.scratch import released, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, id, component): each node with an edge and the least id that it can reach, within the graph that keys name.

    Large-star and small-star steps in turn, each linking every neighbour of a node to the least of them, until nothing changes:
    a number of rounds that grows with the logarithm of the size, not with the diameter. The least neighbour is an aggregate with
    map-side combining, and joined back, so that a hub's neighbours need not meet in one task. Edges with a null end, loops and
    repeated edges are allowed and change nothing; an empty table gives an empty one.
    """
    k = list(keys)
    e = edges.select(*k, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = written(e, "edges")

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def large(df: DataFrame) -> DataFrame:
        both = df.unionByName(df.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*k, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, [*k, "u"]).where("v > u").select(*k, F.col("v").alias("u"), F.col("m").alias("v"))

    def small(df: DataFrame) -> DataFrame:
        least = df.groupBy(*k, "u").agg(F.min("v").alias("m"))
        linked = df.join(least, [*k, "u"]).where("v <> m").select(*k, F.col("v").alias("u"), F.col("m").alias("v"))
        return linked.unionByName(least.select(*k, "u", F.col("m").alias("v"))).distinct()

    before = state(e)
    while before[0]:
        last, e = e, written(small(large(e).where("u <> v").distinct()), "edges")
        released(last)
        now = state(e)
        if now == before:
            break
        before = now
    roots = e.select(*k, F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(*k, F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _labelled(edges: DataFrame, labels: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(*keys, a, b, ca, cb): edges with the components of their ends; an end that has none is its own."""
    side = lambda s: labels.select(*keys, F.col("id").alias(s), F.col("component").alias(f"c{s}"))
    e = edges.select(*keys, F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = e.join(side("a"), [*keys, "a"], "left").join(side("b"), [*keys, "b"], "left")
    return e.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))


def grown(labels: DataFrame, new: DataFrame, a: str = "a", b: str = "b", keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, id, component) of a graph whose components were labels, after the edges new have come: the labels are what stands for all old edges.

    Each component counts as one node, that of its least id; only new edges between different components are followed. What
    moves grows with the new edges and the components that they join; the labels are read once, to be written anew.
    """
    k = list(keys)
    e = written(_labelled(new, labels, k, a, b), "new")
    merged = connected_components(e.where("ca <> cb").select(*k, "ca", "cb"), "ca", "cb", keys)
    into = written(merged.select(*k, F.col("id").alias("component"), F.col("component").alias("_to")), "merged")
    ends = e.select(*k, F.col("a").alias("id"), F.col("ca").alias("component")).unionByName(e.select(*k, F.col("b").alias("id"), F.col("cb").alias("component"))).distinct()
    every = labels.select(*k, "id", "component").unionByName(ends.join(labels.select(*k, "id"), [*k, "id"], "left_anti"))
    return every.join(into, [*k, "component"], "left").select(*k, "id", F.coalesce("_to", "component").alias("component"))


def shrunk(labels: DataFrame, left: DataFrame, gone: DataFrame, a: str = "a", b: str = "b", keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, id, component) of a graph whose components were labels, after the edges gone have been removed and the edges left have stayed: only components that lost an edge are put together anew."""
    k = list(keys)
    lost = _labelled(gone, labels, k, a, b)
    touched = written(lost.select(*k, F.col("ca").alias("component")).unionByName(lost.select(*k, F.col("cb").alias("component"))).distinct(), "touched")
    inside = labels.join(touched, [*k, "component"], "left_semi").select(*k, F.col("id").alias(a))
    again = connected_components(left.select(*k, a, b).join(inside, [*k, a], "left_semi"), a, b, keys)
    return labels.select(*k, "id", "component").join(touched, [*k, "component"], "left_anti").select(*k, "id", "component").unionByName(again.select(*k, "id", "component"))
