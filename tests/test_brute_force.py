"""Queries that SQL can't express, row by row on the smallest tables, and their kernels against plain programs."""

import itertools
import math
import random
from dataclasses import replace

import duckdb
import numpy as np
import pytest

from clusterlake.functions import kernels as K
from clusterlake.operators.families import affinity_propagation
from clusterlake.plans.catalog import QUERIES
from clusterlake.plans.config import Settings
from clusterlake.plans.model import ANCHORS, SQL_GENES, SQL_RECORDS, WEIGHTS

SETTINGS = replace(Settings(), anchor_domains=ANCHORS)


@pytest.fixture(scope="module")
def raw(sf):
    """Records as (genes, product, contig edge) by id, and all pairs of a bin that share a domain."""
    c = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    recs = {r: (bin_, con, product, kind == "P") for r, con, bin_, product, _, kind, _ in c.sql(f"WITH {SQL_RECORDS} SELECT * FROM rec").fetchall()}
    genes: dict = {}
    for r, orf, domain, score, _, strand, core in c.sql(f"WITH {SQL_GENES} SELECT * FROM gene ORDER BY record_id, orf").fetchall():
        genes.setdefault(r, []).append({"orf": orf, "strand": strand, "is_core": core, "in_protocore": False, "hsps": [{"accession": domain, "alignment": f"{int(score):08b}"}]})
    of = {r: K.Record.of(genes[r], "region", product, edge) for r, (_, _, product, edge) in recs.items() if r in genes}
    groups: dict = {}
    for r in of:
        groups.setdefault(recs[r][0], []).append(r)
    pairs = [(a, b) for rs in groups.values() for a, b in itertools.combinations(sorted(rs), 2) if recs[a][1] != recs[b][1] and set(of[a].domains) & set(of[b].domains)]
    return of, pairs


def test_pair_scores(spark, sf, raw):
    of, pairs = raw
    rows = {(r["a"], r["b"]): r for r in QUERIES["pair_scores_glocal"][0](spark, sf).collect()}
    assert set(rows) == set(pairs) and len(rows) > 100
    for a, b in pairs:
        want = K.pair_score(of[a], of[b], WEIGHTS["mix"], "glocal", "legacy", SETTINGS)
        got = rows[a, b].asDict()
        assert all(got[k] == v if not isinstance(v, float) else abs(got[k] - v) < 1e-12 for k, v in want.items())
        x = slice(want["a_start"], want["a_stop"])  # one domain a gene here
        y = slice(want["b_start"], want["b_stop"])
        p, q = of[a].domains[x], (of[b].domains[::-1] if want["reverse"] else of[b].domains)[y]
        s, t = set(p), set(q)
        assert abs(want["jaccard"] - len(s & t) / len(s | t)) < 1e-12
        d = 1 - 0.2 * want["jaccard"] - 0.05 * want["adjacency"] - 0.75 * want["dss"]
        assert abs(want["distance"] - d) < 1e-12


@pytest.mark.parametrize("name, strategy", [("extend_legacy", "legacy"), ("extend_simple", "simple_match")])
def test_regions(spark, sf, raw, name, strategy):
    of, pairs = raw
    rows = {(r["a"], r["b"]): r for r in QUERIES[name][0](spark, sf).collect()}
    assert set(rows) == set(pairs)
    for a, b in pairs:
        region, match, _ = K.comparable_region(of[a], of[b], "local", strategy)
        got = rows[a, b]
        assert tuple(got[f"lcs_{k}"] for k in ("a0", "a1", "b0", "b1")) == (match.a0, match.a1, match.b0, match.b1)
        assert tuple(got[k] for k in ("a0", "a1", "b0", "b1")) == (region.a0, region.a1, region.b0, region.b1) and got["reverse"] == region.reverse


def plain_blocks(a, b):
    """Common substrings: the longest one (the first in a, then in b), and those to the left and to the right of it; neighbours that touch in both are one."""

    def within(a0, a1, b0, b1):
        best = (0, 0, 0)
        for i, j in itertools.product(range(a0, a1), range(b0, b1)):
            n = 0
            while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
        n, i, j = best
        return [] if not n else within(a0, i, b0, j) + [(i, j, n)] + within(i + n, a1, j + n, b1)

    out = []
    for i, j, n in within(0, len(a), 0, len(b)):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def some_records(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        yield tuple(K.Record.of([{"orf": k + 1, "strand": 1, "is_core": r.random() < 0.2, "in_protocore": False, "hsps": [{"accession": r.choice("abcdef"), "alignment": "x"}]} for k in range(r.randint(1, 9))]) for _ in range(2))


def test_longest_match():
    for a, b in some_records(1, 400):
        if not set(a.domains) & set(b.domains):
            continue
        m = K.longest_match(a, b)
        other = b.domains[::-1] if m.reverse else b.domains
        assert a.domains[m.a0 : m.a1] == other[m.b0 : m.b1] and m.a1 > m.a0
        every = [(n, i, j, rev) for rev, x in ((False, b.domains), (True, b.domains[::-1])) for i, j, n in plain_blocks(a.domains, x)]
        assert (m.a1 - m.a0, m.a0, m.b0, m.reverse) in every
        core = [x for x in every if any(x[1] <= c < x[1] + x[0] for c in a.cores) or any(x[2] <= c < x[2] + x[0] for c in b.cores)]
        found = core or every
        most = [k for k, x in enumerate(found) if x[0] == max(y[0] for y in found)]
        # Of several longest ones, the most central of what follows the first of them.
        assert (m.a1 - m.a0, m.a0, m.b0, m.reverse) in ([found[most[0]]] if len(most) == 1 else found[most[0] :])


def test_simple_extension():
    c = Settings()
    for a, b in some_records(2, 400):
        common = set(a.domains) & set(b.domains)
        if not common:
            continue
        m = K.longest_match(a, b)
        other = b.backwards() if m.reverse else b
        e = K.extend_simple(a, other, m, c)
        for x, lo, hi, new_lo, new_hi in ((a, m.a0, m.a1, e.a0, e.a1), (other, m.b0, m.b1, e.b0, e.b1)):
            value = [c.extend_match if d in common else c.extend_gap for d in x.domains]
            right = [sum(value[hi:k]) for k in range(hi, len(value) + 1)]
            left = [sum(value[k:lo]) for k in range(lo, -1, -1)]
            assert new_hi == hi + right.index(max(right)) and new_lo == lo - left.index(max(left))


def test_glocal_takes_the_shorter_arms():
    for a, b in some_records(3, 400):
        if set(a.domains) & set(b.domains):
            m = K.longest_match(a, b)
            e = K.extend_glocal(a, b, m)
            left, right = (m.a0, m.b0), (len(a.domains) - m.a1, len(b.domains) - m.b1)
            assert (m.a0 - e.a0, m.b0 - e.b0) == ((left[0], 0) if left[0] <= left[1] else (0, left[1]))
            assert (e.a1 - m.a1, e.b1 - m.b1) == ((right[0], 0) if right[0] <= right[1] else (0, right[1]))


def test_sequence_similarity_by_all_assignments():
    r = random.Random(4)
    for _ in range(200):
        x, y = ([(r.choice("ab"), "".join(r.choice("AC-") for _ in range(6))) for _ in range(r.randint(1, 4))] for _ in range(2))
        d, n = {True: 0.0, False: 0.0}, {True: 0, False: 0}
        for k in {k for k, _ in x + y}:
            p, q = ([t for m, t in z if m == k] for z in (x, y))
            few, many = sorted((p, q), key=len)
            least = min(sum(K.aligned_distance(s, t) for s, t in zip(few, some)) for some in itertools.permutations(many, len(few)))
            d[k == "a"] += least + len(many) - len(few)
            n[k == "a"] += len(many)
        shares = [(n[s] * w, d[s] / n[s]) for s, w in ((True, 2.0), (False, 1.0)) if n[s]]
        want = 1 - sum(w * v for w, v in shares) / sum(w for w, _ in shares)
        assert abs(K.sequence_similarity(x, y, ("a",), 2.0) - want) < 1e-9


def test_distances_of_aligned_strings():
    r = random.Random(5)
    texts = ["".join(r.choice("ACD-") for _ in range(12)) for _ in range(20)] + ["-" * 12]
    assert np.allclose(K.aligned_distances(texts), [[K.aligned_distance(x, y) for y in texts] for x in texts])


def plain_affinity(s, damping, rounds):
    """Messages one by one."""
    n = len(s)
    r, a = ([[0.0] * n for _ in range(n)] for _ in range(2))
    for _ in range(rounds):
        for i in range(n):
            row = [s[i][k] - max(a[i][j] + s[i][j] for j in range(n) if j != k) for k in range(n)]
            r[i] = [damping * x + (1 - damping) * y for x, y in zip(r[i], row)]
        new = [[sum(max(0, r[j][k]) for j in range(n) if j != k) if i == k else min(0, r[k][k] + sum(max(0, r[j][k]) for j in range(n) if j not in (i, k))) for k in range(n)] for i in range(n)]
        a = [[damping * x + (1 - damping) * y for x, y in zip(p, q)] for p, q in zip(a, new)]
    exemplars = [k for k in range(n) if a[k][k] + r[k][k] > 0]
    return [i if i in exemplars else max(exemplars, key=lambda k: s[i][k]) for i in range(n)], exemplars


def test_affinity_propagation():
    g = np.random.default_rng(6)
    tried = 0
    for _ in range(40):
        n = int(g.integers(3, 9))
        s = g.random((n, n))
        s = (s + s.T) / 2
        np.fill_diagonal(s, 0.0)
        own, exemplars = plain_affinity(s.tolist(), 0.5, 300)
        got = affinity_propagation(s, 0.5, 300, 299)
        if not exemplars:
            continue
        groups = lambda x: {frozenset(i for i in range(n) if x[i] == k) for k in set(x)}
        assert len(set(got.tolist())) == len(exemplars)
        tried += groups(own) == groups(got.tolist())
    assert tried >= 30  # members may move once exemplars are chosen anew within their groups


def test_families(spark, sf):
    """Every record of a component is in one family, whose centre is a member of it and of the component."""
    rows = QUERIES["families_affinity"][0](spark, sf).collect()
    members = {(r["cutoff"], r["bin"], r["component"], r["record_id"]): r["family"] for r in rows}
    components = {(r["cutoff"], r["bin"], r["component"], r["record_id"]) for r in QUERIES["components_by_cutoff"][0](spark, sf).collect()}
    assert set(members) == components and len(rows) == len(members)
    edges = {}
    for r in QUERIES["weighted_distance"][0](spark, sf).collect():
        edges[r["a"], r["b"]] = edges[r["b"], r["a"]] = 1 - r["distance"]
    groups: dict = {}
    for (cutoff, bin_, component, record), family in members.items():
        assert members[cutoff, bin_, component, family] == family
        groups.setdefault((cutoff, bin_, component), []).append(record)
    for (cutoff, bin_, component), ids in groups.items():
        ids = sorted(ids)
        s = np.zeros((len(ids), len(ids)))
        for i, j in itertools.permutations(range(len(ids)), 2):
            x = edges.get((ids[i], ids[j]), 0.0)
            s[i, j] = x if x > 1 - cutoff else 0.0
        dense = round(np.count_nonzero(s) / (len(ids) * (len(ids) - 1)), 2) >= 0.85
        np.fill_diagonal(s, -5.0 if dense else 0.0)
        want = affinity_propagation(s)
        want = np.zeros(len(ids), int) if (want < 0).any() else want
        assert [members[cutoff, bin_, component, x] for x in ids] == [ids[k] for k in want]


def parse(newick):
    """(children with lengths, leaf names) of a tree as nested lists."""
    at = 0

    def node():
        nonlocal at
        if newick[at] == "(":
            at += 1
            kids = [node()]
            while newick[at] == ",":
                at += 1
                kids.append(node())
            at += 1
            name = kids
        else:
            start = at
            while newick[at] not in ":,)":
                at += 1
            name = newick[start:at]
        length = 0.0
        if at < len(newick) and newick[at] == ":":
            start = at = at + 1
            while newick[at] not in ",);":
                at += 1
            length = float(newick[start:at])
        return name, length

    return node()


def leaf_paths(tree):
    name, length = tree
    if isinstance(name, str):
        return {name: length}, {}
    depth, between = {}, {}
    for kid in name:
        d, b = leaf_paths(kid)
        between |= b
        for x, y in itertools.product(depth, d):
            between[frozenset((x, y))] = depth[x] + d[y]
        depth |= d
    return {k: v + length for k, v in depth.items()}, between


def test_trees_keep_additive_distances():
    r = random.Random(7)
    for _ in range(60):
        n = r.randint(3, 9)
        nodes = [(str(k), {str(k): 0.0}) for k in range(n)]
        between = {}
        while len(nodes) > 1:
            i, j = sorted(r.sample(range(len(nodes)), 2))
            (_, x), (_, y) = nodes.pop(j), nodes.pop(i)
            lx, ly = r.uniform(0.1, 2), r.uniform(0.1, 2)
            for p, q in itertools.product(x, y):
                between[frozenset((p, q))] = x[p] + lx + y[q] + ly
            nodes.append(("", {k: v + lx for k, v in x.items()} | {k: v + ly for k, v in y.items()}))
        d = np.array([[between.get(frozenset((str(i), str(j))), 0.0) for j in range(n)] for i in range(n)])
        name, _ = parse(K.neighbour_joining(list(range(n)), d))
        depth, got = leaf_paths((name, 0.0))
        assert set(got) == set(between) and all(math.isclose(got[k], v, rel_tol=1e-4, abs_tol=1e-4) for k, v in between.items())
        far = sorted(depth.values())[-2:]
        assert math.isclose(far[1], max(between.values()) / 2, rel_tol=1e-4)  # rooted in the middle of the longest path


def test_family_trees(spark, sf, raw):
    of, _ = raw
    rows = {r["family"]: r for r in QUERIES["family_trees"][0](spark, sf).collect()}
    c = duckdb.connect()
    for t in ("orders", "customer"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    families = dict(c.sql(f"WITH {SQL_RECORDS} SELECT min(record_id), list_sort(list(record_id)) FROM rec GROUP BY bin").fetchall())
    assert set(rows) == set(families)
    for family, ids in families.items():
        lines = rows[family]["fasta"].split("\n")
        text = {x[1:]: t for x, t in zip(lines[::2], lines[1::2])}
        assert list(text) == [str(i) for i in ids] and len({len(t) for t in text.values()}) == 1
        names = leaf_paths(parse(rows[family]["newick"]))[0]
        assert set(names) == {str(i) for i in ids}
        if len(ids) > 2:
            d = np.array([[K.aligned_distance(text[str(x)], text[str(y)]) for y in ids] for x in ids])
            assert rows[family]["newick"] == K.neighbour_joining(ids, d)


def plain_longest(genes):
    """Genes compared with all kept ones, on a list that changes meanwhile."""
    kept = []
    for new in genes:
        hit = False
        for k, old in enumerate(kept):  # goes on over the changed list
            shared = min(old["stop"], new["stop"]) - max(old["start"], new["start"])
            if old["strand"] != new["strand"] or shared <= 0 or shared / 3 <= 0.1 * min(old["length"], new["length"]):
                continue
            hit = True
            if new["length"] >= old["length"]:
                del kept[k]
                kept.append(new)
        if not hit:
            kept.append(new)
    return kept


def test_overlapping_genes_of_dereplication(spark, sf):
    r = random.Random(8)
    for _ in range(200):
        genes = [{"orf": k, "start": (a := 20 * k + r.randrange(60)), "stop": a + 3 * (n := r.randint(5, 40)), "strand": r.choice((1, -1)), "length": n} for k in range(r.randint(0, 12))]
        assert K.longest_of_overlapping_genes(genes) == plain_longest(genes)
    rows = sorted(tuple(x) for x in QUERIES["overlap_filter_genes_again"][0](spark, sf).collect())
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    by: dict = {}
    for record, orf, width, strand in c.sql(f"WITH {SQL_GENES} SELECT record_id, orf, width, strand FROM gene ORDER BY 1, 2").fetchall():
        by.setdefault(record, []).append({"container_id": record, "orf": orf, "start": orf * 15, "stop": orf * 15 + width, "strand": strand, "length": width})
    assert rows == sorted(tuple(g.values()) for genes in by.values() for g in plain_longest(genes))


def test_trees_of_many_equal_members_keep_distances():
    """6,000 members of nine alignments: more than a matrix of members was made of. Joined by class or by row, the tree is the same one."""
    r = random.Random(5)
    at = [r.uniform(0.5, 3) for _ in range(9)]  # a star: any two ends are as far as their branches are long
    d = np.array([[0.0 if i == j else at[i] + at[j] for j in range(9)] for i in range(9)])
    of = [r.randrange(9) for _ in range(40)]
    few = K.neighbour_joining(list(range(40)), d[np.ix_(of, of)])
    order = {c: k for k, c in enumerate(dict.fromkeys(of))}
    first = list(order)
    assert few == K.neighbour_joining(list(range(40)), d[np.ix_(first, first)], [order[c] for c in of])
    _, got = leaf_paths(parse(few)[:2])
    assert all(math.isclose(got[frozenset((str(x), str(y)))], d[of[x], of[y]], rel_tol=1e-4, abs_tol=1e-4) for x, y in itertools.combinations(range(40), 2))
    many = K.neighbour_joining(list(range(6000)), d, [k % 9 for k in range(6000)])
    assert many.count(",") == 5999 and many.endswith(";")
