"""Dereplication: sketches of shingles, their Jaccard index, components, and a representative each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterlake.operators.components import connected_components
from clusterlake.plans.scratch import written


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for each row; within a lambda, an expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def word_shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n words of a text in lower case; none for shorter texts."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(runs(w))))


def kmers(sequence: Column, k: int = 10) -> Column:
    """Distinct substrings of k letters; none for shorter sequences."""
    parts = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (k - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))
    return let(sequence, lambda s: F.when(F.length(s) < k, F.array().cast("array<string>")).otherwise(F.array_distinct(parts(s))))


def sketch(items: DataFrame, tokens: Column, digits: int = 1) -> DataFrame:
    """(item, token): hashes of tokens, scaled down to those that begin with so many zero digits, the same for every item."""
    kept = F.filter(F.transform(tokens, F.md5), lambda x: x.startswith("0" * digits))  # where they are made, so that few rows are
    return items.select("item", F.explode(F.array_distinct(kept)).alias("token")).distinct()


def keyed(sketches: DataFrame) -> DataFrame:
    """(item, key, tokens): the whole sketch of each item, and what equal ones share."""
    each = sketches.groupBy("item").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return each.select("item", F.md5(F.array_join("tokens", "")).alias("key"), "tokens")


def equal_sketches(whole: DataFrame) -> DataFrame:
    """(key, item, members, tokens) of keyed() sketches: equal ones as one class, named by the least item."""
    return whole.groupBy("key").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("members"), F.min("tokens").alias("tokens"))


def sketch_classes(sketches: DataFrame) -> DataFrame:
    """(key, item, members, tokens): items with equal sketches as one class, named by the least of them."""
    return equal_sketches(keyed(sketches))


def class_of(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """(item, class) of each item that has a sketch."""
    key = F.md5(F.array_join(F.array_sort(F.collect_list("token")), ""))
    return sketches.groupBy("item").agg(key.alias("key")).join(classes.select("key", F.col("item").alias("class")), "key").select("item", "class")


def class_edges(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of classes with at least that Jaccard index, copies left out.

    Two sets that reach it share a token among the rarest few of each (all but as many as must be shared, and one), so that only
    those are joined; sizes must allow it too. Survivors are verified on the whole sets.
    """
    n = F.size("tokens")
    token = classes.select(F.col("item").alias("x"), n.alias("n"), F.explode("tokens").alias("token"))
    often = token.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(W.partitionBy("x").orderBy("df", "token"))
    prefix = token.join(often, "token").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    side = lambda s: prefix.select("token", F.col("x").alias(s), F.col("n").alias(f"n_{s}"))
    near = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & (F.col("n_a") >= F.col("n_b") * least - 1e-9) & (F.col("n_b") >= F.col("n_a") * least - 1e-9))
    pairs = near.select("a", "b").distinct()
    whole = lambda s: classes.select(F.col("item").alias(s), F.col("tokens").alias(f"t_{s}"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b")
    i = F.size(F.array_intersect("t_a", "t_b"))
    j = i / (F.size("t_a") + F.size("t_b") - i)
    return both.select("a", "b", j.alias("j")).where(F.col("j") >= least).select("a", "b", F.round("j", 6).alias("jaccard"))


def dereplicate(items: DataFrame, sketches: DataFrame, least: float = 0.8) -> DataFrame:
    """(item, component, representative) of items with sketches (item, token): the member most similar to all others of its component, the least of equals.

    Items with equal sketches are one class from the start: each counts in the sums, but their pairs are never made. Tokens are gathered
    once for each item, and membership goes by the sketch's key. An item that is
    like no other represents itself, as does one without tokens.
    """
    s = written(keyed(sketches), "sketches")
    c = written(equal_sketches(s), "classes")
    e = written(class_edges(c, least), "edges")
    links = e.select(F.col("a").alias("item"), F.col("b").alias("other"), "jaccard").unionByName(e.select(F.col("b").alias("item"), F.col("a").alias("other"), "jaccard"))
    beyond = links.join(c.select(F.col("item").alias("other"), "members"), "other").groupBy("item").agg(F.sum(F.col("jaccard") * F.col("members")).alias("beyond"))
    total = F.round(F.coalesce("beyond", F.lit(0.0)) + F.col("members") - 1, 4)
    component = connected_components(e).withColumnRenamed("id", "item")
    every = c.select("item", "members").join(beyond, "item", "left").join(component, "item", "left").select("item", F.coalesce("component", "item").alias("component"), total.alias("total"))
    best = every.groupBy("component").agg(F.max(F.struct("total")).alias("t")).select("component", "t.total").join(every, ["component", "total"]).groupBy("component").agg(F.min("item").alias("representative"))
    named = every.select(F.col("item").alias("class"), "component").join(best, "component").join(c.select("key", F.col("item").alias("class")), "class")
    found = s.select("item", "key").join(named, "key").select("item", "component", "representative")
    return items.select("item").join(found, "item", "left").select("item", F.coalesce("component", "item").alias("component"), F.coalesce("representative", "item").alias("representative"))
