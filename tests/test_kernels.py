"""Kernels on lists, and their agreement with the table forms."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterlake.functions import biology
from clusterlake.functions import kernels as K
from clusterlake.operators import bins, filters, search, similarity, state
from clusterlake.operators.components import connected_components
from clusterlake.operators.families import affinity_propagation
from clusterlake.plans.config import Settings


def rec(domains, cores=(), kind="region", product=""):
    return K.Record(list(domains), list(range(len(domains))), set(cores), len(domains), kind, product, ["AB"] * len(domains), list(range(len(domains))), list(range(len(domains))))


def test_scores():
    assert K.jaccard("abcd", "bcde") == 0.6 and K.jaccard("", "a") == 0
    assert K.adjacency("abcd", "cdab") == 0.5 and K.adjacency("a", "ab") == 0 and K.adjacency("a", "a") == 1
    assert K.aligned_distance("TEST-PF1--", "TEST--P-F1") == 1 - 4 / 9
    with pytest.raises(ValueError, match="length"):
        K.aligned_distance("A", "AB")


def test_longest_match():
    assert K.longest_match(rec("xABCDEy"), rec("zABCDEw")) == K.Region(1, 6, 1, 6, 1, 6, 1, 6, False)
    assert K.longest_match(rec("xABCDEy"), rec("wEDCBAz")) == K.Region(1, 6, 1, 6, 1, 6, 1, 6, True)
    core = K.longest_match(rec("ABCxyDE", {6}), rec("ABCzwDE"))
    assert (core.a0, core.a1) == (5, 7)
    central = K.longest_match(rec("AuvwxBqrstC"), rec("AabcdBefghC"))
    assert (central.a0, central.a1, central.b0, central.b1) == (5, 6, 5, 6)
    inner = rec("ABCxyDE", {0}, "protocluster"), rec("ABCzwDE", kind="protocluster")
    inner[0].protocore.add(5)
    assert K.longest_match(*inner).a0 == 5
    with pytest.raises(ValueError, match="no domain"):
        K.longest_match(rec("ab"), rec("cd"))


def test_extensions():
    a, b = rec("ABCDEFGHIJKLMN"), rec("ABCDEFGHIJKLMN")
    start = K.Region(4, 7, 4, 7, 4, 7, 4, 7)
    r = K.extend_legacy(a, b, start, Settings())
    assert (r.a0, r.a1, r.b0, r.b1) == (0, 14, 0, 14)
    gap = K.extend_legacy(rec("ABCDEFGHIJ" * 2), rec("ABCDEFGxHIJ" + "ABCDEFGHIJ"), K.Region(0, 7, 0, 7, 0, 7, 0, 7), Settings())
    assert gap.a1 == 20 and gap.b1 == 21
    none = K.extend_legacy(rec("ABCpqrs"), rec("ABCtuvw"), K.Region(0, 3, 0, 3, 0, 3, 0, 3), Settings())
    assert (none.a1, none.b1) == (3, 3)
    g = K.extend_greedy(rec("xAByyCx"), rec("AzzBC"), start)
    assert (g.a0, g.a1, g.b0, g.b1) == (1, 6, 0, 5)
    s = K.extend_simple(rec("AxABCxA"), rec("zzABCzz"), K.Region(2, 5, 2, 5, 2, 5, 2, 5), Settings())
    assert (s.a0, s.a1, s.b0, s.b1) == (0, 7, 2, 5)
    h = K.extend_glocal(rec("a" * 10), rec("b" * 20), K.Region(3, 6, 5, 8, 3, 6, 5, 8))
    assert (h.a0, h.a1, h.b0, h.b1) == (0, 10, 5, 8)


def test_acceptance():
    c = Settings()
    r = K.Region(0, 5, 0, 5, 0, 5, 0, 5)
    long = rec("a" * 100)
    assert not K.accepted_extension(long, long, r, c)
    assert K.accepted_extension(rec("a" * 20, {1}), long, r, c)
    assert not K.accepted_extension(rec("a" * 20), long, r, c)
    terpene = rec("a" * 100, {1}, product="terpene")
    assert K.accepted_extension(terpene, terpene, r, c)
    assert not K.accepted_extension(rec("a", kind="protocluster"), rec("a", kind="proto_core"), r, c)
    assert K.accepted_extension(rec("a" * 9, {1}, "protocluster"), rec("a" * 9, {}, "protocluster"), r, c)


def test_assignment():
    r = random.Random(1)
    for _ in range(200):
        n, m = r.randint(1, 5), r.randint(1, 5)
        c = np.array([[r.random() for _ in range(m)] for _ in range(n)])
        t = c if n <= m else c.T
        best = min(sum(t[i, p[i]] for i in range(len(t))) for p in itertools.permutations(range(t.shape[1]), len(t)))
        assert abs(sum(c[i, j] for i, j in K.assignment(c)) - best) < 1e-9


def test_sequence_similarity():
    assert K.sequence_similarity([("A", "xy")], [("A", "xy")], ()) == 1
    assert K.sequence_similarity([("A", "xy"), ("B", "xx")], [("A", "xz")], ()) == 1 - (0.5 + 1) / 2
    assert K.sequence_similarity([("A", "xy"), ("A", "zz")], [("A", "zz")], ("A",)) == 0.5
    mixed = K.sequence_similarity([("A", "xy"), ("B", "xx")], [("A", "xy")], ("A",), 2.0)
    assert abs(mixed - (1 - (0 * 2 + 1 * 1) / 3)) < 1e-12


def test_overlap_filters():
    hit = lambda s, e, score: {"start": s, "stop": e, "score": score}
    assert K.without_overlaps([hit(0, 100, 10), hit(50, 150, 9)]) == [hit(0, 100, 10)]
    assert K.without_overlaps([hit(0, 100, 9), hit(50, 150, 10)]) == [hit(50, 150, 10)]
    assert K.without_overlaps([hit(0, 100, 9), hit(95, 195, 10)]) == [hit(0, 100, 9), hit(95, 195, 10)]
    assert len(K.without_overlaps([hit(0, 100, 9.01), hit(50, 150, 9.0)])) == 2
    assert K.without_overlaps([hit(50, 150, 9), hit(0, 100, 9)]) == [hit(0, 100, 9)]
    gene = lambda s, e, n, strand=1: {"start": s, "stop": e, "strand": strand, "length": n}
    assert K.without_overlapping_genes([gene(0, 300, 100), gene(150, 330, 60)]) == [gene(0, 300, 100)]
    assert K.without_overlapping_genes([gene(0, 300, 60), gene(150, 330, 100)]) == [gene(150, 330, 100)]
    assert len(K.without_overlapping_genes([gene(0, 300, 100), gene(150, 330, 60, -1)])) == 2
    assert len(K.without_overlapping_genes([gene(0, 300, 100), gene(290, 590, 100)])) == 2


def test_trees():
    assert K.neighbour_joining([3, 64], np.zeros((2, 2))) == "(3:0.0,64:0.0):0.01;"
    t = K.neighbour_joining(["a", "b", "c", "d"], np.array([[0, 0.1, 0.5, 0.6], [0.1, 0, 0.5, 0.6], [0.5, 0.5, 0, 0.2], [0.6, 0.6, 0.2, 0]]))
    assert t in ("((a:0.05,b:0.05):0.25,(c:0.05,d:0.15):0.15):0.01;", "((c:0.05,d:0.15):0.15,(a:0.05,b:0.05):0.25):0.01;")


def test_affinity_propagation():
    s = np.zeros((8, 8))
    for i, j in itertools.combinations(range(8), 2):
        s[i, j] = s[j, i] = 0.99 if i // 4 == j // 4 else 0.0
    s[0, 4] = s[4, 0] = s[3, 7] = s[7, 3] = 0.7
    label = affinity_propagation(s)
    assert len(set(label[:4])) == len(set(label[4:])) == 1 and label[0] != label[4]
    assert affinity_propagation(np.array([[0.0]])).tolist() == [0]
    assert affinity_propagation(np.full((3, 3), -5.0) + 5.5 * (1 - np.eye(3))).tolist() == [0, 0, 0]


def test_translation():
    assert biology.translate("ATGGCCTAAGGG") == "MA"
    assert biology.translate("ATGTGANNN", 4) == "MWX"
    assert biology.reverse_complement("ATGC") == "GCAT"
    assert biology.in_frame("ATGCC", False, True) == "ATG" and biology.in_frame("CCATG", True, False) == "ATG"


def test_expressions_agree_with_kernels(spark):
    r = random.Random(2)
    rows = [("".join(r.choice("abcd") for _ in range(r.randint(0, 6))), "".join(r.choice("abcd") for _ in range(r.randint(0, 6)))) for _ in range(150)]
    df = spark.createDataFrame([(list(x), list(y)) for x, y in rows], "x array<string>, y array<string>")
    got = df.select("x", "y", similarity.jaccard(F.col("x"), F.col("y")).alias("j"), similarity.adjacency(F.col("x"), F.col("y")).alias("a")).collect()
    for g in got:
        assert abs(g["j"] - K.jaccard(g["x"], g["y"])) < 1e-12
        assert abs(g["a"] - K.adjacency(g["x"], g["y"])) < 1e-12


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(5, 5), (None, 3)]
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")).count() == 0


def test_legacy_classes(spark):
    cases = {"T1PKS": "PKSI", "T1PKS.T3PKS": "PKSother", "NRPS.NRPS-like": "NRPS", "NRPS.T1PKS": "PKS-NRP_Hybrids", "LAP.thiopeptide": "RiPP", "terpene": "terpene", "terpene.NRPS": "other", "": "other", "saccharide.amglyccycl": "saccharide", "ectoine": "other"}
    df = spark.createDataFrame([(k,) for k in cases], "product string")
    assert {r["product"]: r["bin"] for r in bins.legacy_bins(df).collect()} == cases
    weights = {"PKS": "PKSother", "NRPS.PKS": "PKS-NRP_Hybrids", "RiPP": "RiPP", "RiPP.terpene": "other", "Categoryless": "other"}
    df = spark.createDataFrame([(k,) for k in weights], "c string")
    assert {r["c"]: r["w"] for r in df.select("c", bins.category_weights(F.col("c")).alias("w")).collect()} == weights


def test_filters(spark):
    df = spark.createDataFrame([("a.region1.gbk",), ("cluster_final.gbk",), ("other.gbk",)], "name string")
    keep = lambda *a: [r[0] for r in df.where(filters.file_name_filter(F.col("name"), *a)).collect()]
    assert keep() == ["a.region1.gbk"] and len(keep(("*",))) == 3
    x = spark.createDataFrame([("PF00001.12", 7, 123456), ("PF00002", 3, 5)], "a string, s int, n int")
    assert [tuple(r) for r in x.select(filters.without_version(F.col("a")), filters.family_name(F.col("n"))).collect()] == [("PF00001", "FAM_123456"), ("PF00002", "FAM_00005")]
    assert filters.with_all_domains(df, df, ()) is df


def test_search():
    assert search.parse("a b[domain] AND (c OR d[family])") == ("AND", ("term", "a b", "domain"), ("OR", ("term", "c", None), ("term", "d", "family")))
    for bad in ("(a", "a)", "AND a", "a OR", ""):
        with pytest.raises(search.SearchError):
            search.parse(bad)


def test_state(spark):
    assert state.next_task(1, 2, 5, 5, 3, 3, 9, 9) == "SAVE_FILES" and state.next_task(2, 2, 5, 4, 3, 3, 9, 9) == "SCAN"
    assert state.next_task(2, 2, 5, 5, 3, 2, 9, 9) == "ALIGN" and state.next_task(2, 2, 5, 5, 3, 3, 9, 8) == "COMPARE" and state.next_task(0, 0, 0, 0, 0, 0, 0, 0) == "DONE"
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "hash int")
    for stored, given, want in (((), (1,), "NO_DATA"), ((1,), (2,), "NEW"), ((1, 2), (1, 2), "SAME"), ((1, 2), (1,), "PARTIAL"), ((1, 2), (2, 3), "MIXED")):
        assert state.input_state(df(*stored), df(*given)).first()["state"] == want
    runs = spark.createDataFrame([(1, "x"), (2, Settings().digest())], "started int, digest string")
    assert state.same_settings(runs, Settings().digest()) and not state.same_settings(runs, "x")
    assert Settings.from_yaml("EXTEND_MATCH: 7\nunknown: 1\nanchor_domains: [PF1]").extend_match == 7


@pytest.mark.parametrize("mode, strategy", [("local", "legacy"), ("glocal", "legacy"), ("auto", "simple_match"), ("glocal", "greedy")])
def test_regions_of_pairs_that_are_alike_are_found_once(monkeypatch, mode, strategy):
    """Pairs that differ in names of domains, and in core genes that nothing is asked about, go down one tree; what it gives is what the pair alone gives."""
    import random

    r = random.Random(5)
    c = Settings(no_min_classes=("t",))

    def made(names):
        genes, n = [], r.randrange(1, 6)
        for orf in range(n):
            hsps = [{"accession": r.choice(names), "alignment": r.choice(("AC", "A-", "CC"))} for _ in range(r.choice((0, 1, 1, 1, 2)))]
            genes.append({"orf": orf // 2, "strand": r.choice((1, -1)), "is_core": r.random() < 0.4, "in_protocore": r.random() < 0.4, "hsps": hsps})
        return K.Record.of(genes, r.choice(("region", "protocluster", "proto_core")), r.choice("tu"), r.random() < 0.5)

    pairs = [(made(names), made(names)) for names in ("abcdef", "ghijkl", "abgh") * 400]
    pairs = [(a, b) for a, b in pairs if set(a.domains) & set(b.domains)]
    regions = K.Regions(mode, strategy, c)
    for a, b in pairs:
        want, match, _ = K.comparable_region(a, b, mode, strategy, c)
        assert regions.of(a, b) == (want, match)
        assert K.pair_score(a, b, (0.2, 0.05, 0.75, 2.0), mode, strategy, c, regions) == K.pair_score(a, b, (0.2, 0.05, 0.75, 2.0), mode, strategy, c)
    calls = []
    monkeypatch.setattr(K, "comparable_region", lambda *a: calls.append(1))
    for a, b in pairs:
        regions.of(a, b)
    assert not calls


def test_single_copies_are_matched_without_an_assignment(monkeypatch):
    """The least distance is the assignment where one side has one copy."""
    x, y = [("a", "AC"), ("b", "AA")], [("a", "AA"), ("a", "AC"), ("b", "CA"), ("c", "")]
    want = 1 - (0 + 1 + 0.5 + 1) / 4
    monkeypatch.setattr(K, "assignment", None)
    assert K.sequence_similarity(x, y, ()) == K.sequence_similarity(y, x, ()) == want
