"""Pairs by blocks against the token join, and what they move."""

import random

import pytest
from pyspark.sql import functions as F

from clusterlake.operators import alignment, blocks, families, pairs, similarity

WEIGHTS = (0.2, 0.05, 0.75, 2.0)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    records = [(i, r.randrange(12), "xy"[i % 2]) for i in range(60)]
    genes = [(i, k, f"d{r.randrange(6)}") for i in range(60) for k in range(1, r.randrange(1, 6) + 1)]
    return spark.createDataFrame(records, "record_id long, container_id long, bin string"), spark.createDataFrame(genes, "record_id long, orf int, domain string").cache()


def joined(records, genes):
    return pairs.candidate_pairs(similarity.record_tokens(records, genes, ("d1",)).where("domain = 1")).select("bin", "a", "b")


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_blocks_give_what_the_token_join_gives(tables, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    records, genes = tables
    want = sorted(joined(records, genes).collect())
    assert sorted(blocks.common_domains(records, genes).collect()) == want
    front = {1, 2, 7, 30}
    f = records.where(F.col("record_id").isin(*front)).select("record_id")
    assert sorted(blocks.common_domains(records, genes, f).collect()) == [x for x in want if {x.a, x.b} & front]
    known = records.sparkSession.createDataFrame([(x.bin, x.b, x.a) for x in want[::3]], "bin string, a long, b long")
    assert sorted(blocks.common_domains(records, genes, known=known).collect()) == [x for k, x in enumerate(want) if k % 3]
    assert sorted(blocks.common_domains(records, genes, known=known, present=True).collect()) == want[::3]
    d = genes.select("record_id", "domain", (F.col("orf") - 1).alias("position"))
    regions = sorted(alignment.greedy_regions(joined(records, genes), d).collect())
    assert sorted(blocks.greedy_regions(records, genes).drop("bin").collect()) == regions
    every = blocks.scores(records, genes, ("d1",), WEIGHTS).collect()
    assert sorted((x.bin, x.a, x.b) for x in every) == [tuple(x) for x in want]
    near = blocks.scores(records, genes, ("d1",), WEIGHTS, 0.6).collect()
    assert near and sorted(near) == sorted(x for x in every if x.distance < 0.6)
    lists = {x.record_id: [g.domain for g in x.g] for x in genes.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("orf", "domain"))).alias("g")).collect()}
    for x in every:
        p, q = set(lists[x.a]), set(lists[x.b])
        assert x.jaccard == round(len(p & q) / len(p | q), 6)


def test_pairs_are_not_shuffled(tables):
    """What is scored leaves the tasks that count it; the join's aggregate moved every pair."""
    records, genes = tables
    plan = similarity.scored_pairs(records, genes, ("d1",), WEIGHTS)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.splitlines()[0]


def test_rounding_is_half_up_by_decimal_form():
    import numpy as np

    assert blocks.rounded(np.array([0.1234565, 0.1234575, 0.0000005, 1 / 3, 0.0, 1.0])).tolist() == [0.123457, 0.123458, 0.000001, 0.333333, 0.0, 1.0]


@pytest.mark.parametrize("block", [9, 4096])
@pytest.mark.parametrize("copies", [1, 3])
def test_components_by_blocks_are_those_of_the_edges(tables, monkeypatch, block, copies):
    """Copies of a record share its container or have one of their own, so that a class lies in one container or in several."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    records, genes = tables
    n = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    records = records.withColumn("n", n).select((F.col("record_id") + 100 * F.col("n")).alias("record_id"), (F.col("container_id") + F.when(F.col("record_id") % 3 == 0, 0).otherwise(20 * F.col("n"))).alias("container_id"), "bin")
    genes = genes.withColumn("n", n).select((F.col("record_id") + 100 * F.col("n")).alias("record_id"), "orf", "domain")
    cutoffs = (0.2, 0.6)
    e = blocks.scores(records, genes, ("d1",), WEIGHTS, 0.6).select("bin", "a", "b", "distance").cache()
    want = families.components_by_cutoff(e, cutoffs).cache()
    for counted in (False, True):
        got = blocks.components(records, genes, ("d1",), WEIGHTS, cutoffs, counted).cache()
        assert sorted(got.drop("edges").collect()) == sorted(want.collect())
    assert sorted(families.counted_density(got).collect()) == sorted(families.density(e, want, cutoffs).select("cutoff", "bin", "component", "nodes", "edges", "density").collect())
    odd = blocks.components(records, genes, ("d1",), WEIGHTS, (0.6,), rest=(3, (0, 1))).drop("edges")
    assert sorted(odd.collect()) == sorted(families.components_by_cutoff(e.where("(a + b) % 3 < 2"), (0.6,)).collect())


def test_components_write_a_row_a_record_not_an_edge(spark):
    """Fifty like records have 1225 edges; the rows that leave the cells are their records."""
    records = spark.createDataFrame([(i, i, "x") for i in range(50)], "record_id long, container_id long, bin string")
    genes = spark.createDataFrame([(i, 1, "d") for i in range(50)], "record_id long, orf int, domain string")
    got = blocks.components(records, genes, ("d1",), WEIGHTS, (0.5,), counted=True).collect()
    assert len(got) == 50 and {x.component for x in got} == {0} and sum(x.edges for x in got) == 1225


@pytest.mark.parametrize("block", [9, 32, 4096])
def test_what_blocks_reach_is_what_edges_reach(tables, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    records, genes = tables
    records = records.withColumn("bin", F.when(F.col("record_id") < 12, "z").otherwise(F.col("bin")))
    start = records.where("record_id IN (1, 14, 15)")
    want = families.spread(blocks.scores(records, genes, ("d1",), WEIGHTS, 0.75), start, 0.75)
    got = sorted(blocks.reached(records, genes, ("d1",), WEIGHTS, start, 0.75).collect())
    assert got == sorted(want.collect()) and max(x.round for x in got) > 1


def test_what_a_record_carries_comes_with_its_edges(tables):
    records, genes = tables
    r = records.withColumn("of", F.array(F.struct((F.col("record_id") * 2).alias("x"))))
    got = blocks.scores(r, genes, ("d1",), WEIGHTS, 0.6, ("distance",), carry="of").collect()
    assert got and all(x.carried[0].x == 2 * x.a for x in got)
    assert len(got) == blocks.scores(records, genes, ("d1",), WEIGHTS, 0.6).count()


def test_records_of_equal_features_are_compared_once(tables, spark):
    """Forty copies of two records make 1521 pairs between them in other containers, and two comparisons or so; a call for each pair took all the time."""
    records, genes = tables
    hit = F.array(F.struct(F.col("domain").alias("accession"), F.lit("A").alias("alignment")))
    g = genes.withColumn("hsps", hit).withColumn("strand", F.lit(1)).withColumn("is_core", F.col("orf") == 2)
    feats = alignment.features(records.select("record_id", F.lit("region").alias("kind"), F.lit("p").alias("product"), F.lit(False).alias("contig_edge")), g).cache()
    want = alignment.regions(joined(records, genes), feats, "local").collect()
    assert sorted(alignment.common_regions(records, genes, feats, "local").collect()) == sorted(want)
    scored = alignment.score_pairs(joined(records, genes), feats, WEIGHTS).collect()
    assert sorted(alignment.score_common(records, genes, feats, WEIGHTS).collect()) == sorted(scored)

    import numpy as np
    import pyarrow as pa

    calls = []
    made = blocks.Outcomes(pa.array(["x", "y"] * 20), str, lambda x, y, _: calls.append(1) or (len(x + y),), [pa.int32()])
    every = np.arange(40)
    columns, stay = made.of(np.repeat(every, 40), np.tile(every, 40))
    assert len(calls) == 4 and len(stay) == 1600 and columns[0].to_pylist() == [2] * 1600


def test_network_edges_are_not_shuffled(spark, sf):
    """The rows of the network leave the tasks that find them with the names of both ends; joins moved each edge twice."""
    from clusterlake.plans.catalog import QUERIES

    for name in ("network_edges", "full_network"):
        plan = QUERIES[name][0](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan.split("MapInArrow")[0]


def test_matches_are_filled_in_without_joining_edges_again(tables, spark):
    """Rows as the joins gave them: those that have a match, null ones, those of records without features and those without a common domain stay as they are."""
    records, genes = tables
    hit = F.array(F.struct(F.col("domain").alias("accession"), F.lit("A").alias("alignment")))
    g = genes.withColumn("hsps", hit).withColumn("strand", F.lit(1)).withColumn("is_core", F.col("orf") == 2)
    feats = alignment.features(records.where("record_id <> 7").select("record_id", F.lit("region").alias("kind"), F.lit("p").alias("product"), F.lit(False).alias("contig_edge")), g).cache()
    some = pairs.all_pairs(records)
    stop = F.when(F.col("a") == 3, None).when((F.col("a") + F.col("b")) % 3 == 0, 2).otherwise(0)
    e = some.select("bin", "a", "b", F.lit(0).alias("lcs_a_start"), stop.alias("lcs_a_stop"), F.lit(0).alias("lcs_b_start"), stop.alias("lcs_b_stop"), F.lit(False).alias("reverse"), F.concat("bin", F.col("b")).alias("more")).cache()
    want = alignment.with_matches(e, alignment.lacking_matches(e, feats))
    got = alignment.backfill_matches(e, feats)
    rows = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    assert rows(got) == rows(want.select(*e.columns)) and got.columns == e.columns
    top = got._jdf.queryExecution().optimizedPlan()
    assert "Union" in top.nodeName() and sum("MapInArrow" in top.children().apply(i).toString() for i in range(2)) == 1


def exchanges(df):
    return [x.strip(" :+-") for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_a_records_domains_move_once_and_narrow(spark, sf):
    """Lists of domains in order: one shuffle of line items, of four columns; the window's moved seven, and its lists moved again."""
    from clusterlake.plans.model import genes, placed_domains

    lists = lambda g: g.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("orf", "domain"))).alias("g")).select("record_id", "g.domain")
    of = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(of)
    try:
        spark.conf.set(of, str(10 << 20))
        assert len(exchanges(lists(placed_domains(spark, sf)))) == len(exchanges(lists(genes(spark, sf)))) == 1
        plan = lists(placed_domains(spark, sf))._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "l_extendedprice" not in plan
    finally:
        spark.conf.set(of, before)
    assert sorted(lists(placed_domains(spark, sf)).collect()) == sorted(lists(genes(spark, sf)).collect())


@pytest.mark.parametrize("block", [4, 4096])
def test_pairs_without_an_edge_are_found_without_edges_written(tables, monkeypatch, block):
    """What is left when the edges are looked up; the only tables written are the members and the sizes of bins."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    records, genes = tables
    e = blocks.scores(records, genes, ("d1",), WEIGHTS, 0.6).select("bin", "a", "b")
    want = sorted(blocks.common_domains(records, genes, known=e).collect())
    made, plain = [], blocks.written
    monkeypatch.setattr(blocks, "written", lambda df, what: made.append(what) or plain(df, what))
    assert sorted(blocks.without_edge(records, genes, ("d1",), WEIGHTS, 0.6).collect()) == want and want
    assert made == ["members", "sizes"] and e.count()


def test_missing_pairs_stores_no_edge(spark, sf, monkeypatch):
    from clusterlake.plans import queries

    monkeypatch.setattr(queries, "written", lambda df, what: pytest.fail(f"{what} written"))
    assert queries.missing_pairs(spark, sf).columns == ["bin", "a", "b"]


def test_dereplication_gathers_a_sketch_once(spark, monkeypatch):
    """Members find their class by the key that was written with their tokens; the tokens were gathered again for it."""
    from clusterlake.operators import sketches

    made, plain = {}, sketches.written
    monkeypatch.setattr(sketches, "written", lambda df, what: made.setdefault(what, plain(df, what)))
    items = spark.createDataFrame([(i,) for i in range(6)], "item long")
    rows = [(i, f"{k:02d}") for i in range(5) for k in range(10) if (i, k) not in ((2, 9), (3, 0), (3, 1))] + [(0, "00")]
    got = sketches.dereplicate(items, spark.createDataFrame(rows, "item long, token string"), 0.8)
    assert sorted(tuple(x) for x in got.collect()) == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 5, 5)]
    assert made["sketches"].columns == ["item", "key", "tokens"] and made["sketches"].count() == 5
