"""Components that are kept up to date, and interval joins, against plain programs."""

import random
from collections import Counter

import pytest

from clusterlake.operators import intervals
from clusterlake.operators.components import connected_components, grown, shrunk
from clusterlake.plans.scratch import written


def plain(edges):
    label = {}
    for k, a, b in edges:
        if a is not None and b is not None and a != b:
            label.setdefault((k, a), a)
            label.setdefault((k, b), b)
    changed = True
    while changed:
        changed = False
        for k, a, b in edges:
            if (k, a) in label and (k, b) in label and label[k, a] != label[k, b]:
                label[k, a] = label[k, b] = min(label[k, a], label[k, b])
                changed = True
    return {(k, i, c) for (k, i), c in label.items()}


def test_random_inserts_and_deletes(spark):
    r = random.Random(6)
    df = lambda rows: spark.createDataFrame(list(rows), "key string, a long, b long")
    held = {(r.choice("xy"), *sorted(r.sample(range(60), 2))) for _ in range(30)}
    labels = written(connected_components(df(held), keys=("key",)), "labels")
    for step in range(4):
        if step % 2 == 0:
            new = {(r.choice("xyz"), *sorted(r.sample(range(60 + 10 * step), 2))) for _ in range(12)}
            held |= new
            labels = grown(labels, df([*new, ("x", 1, 1), ("x", None, 2)]), keys=("key",))
        else:
            gone = set(r.sample(sorted(held), 12))
            held -= gone
            labels = shrunk(labels, df(held), df(gone), keys=("key",))
        labels = written(labels, "labels")
        assert sorted(tuple(x) for x in labels.select("key", "id", "component").collect()) == sorted(plain(held))
    empty = df([])
    assert grown(connected_components(empty, keys=("key",)), empty, keys=("key",)).isEmpty()


@pytest.mark.parametrize("lengths", [(1, 30), (1, 4000), (50, 70)])
def test_intervals(spark, lengths):
    r = random.Random(1)
    some = lambda n: [(r.choice("pq"), i, (s := r.randint(-500, 20_000)), s + r.randint(*lengths)) for i in range(n)]
    x, y = some(400), [*some(300), ("p", 900, 5, 5), ("p", 901, None, 7), (None, 902, 1, 9), ("q", 903, -10_000, 40_000)]
    df = lambda rows: spark.createDataFrame(rows, "key string, id long, start long, stop long")
    got = Counter((g["id"], g["id_r"]) for g in intervals.overlapping(df(x), df(y), ["key"]).collect())
    real = [t for t in y if t[0] is not None and t[2] is not None and t[2] < t[3]]
    assert got == Counter((a[1], b[1]) for a in x for b in real if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    got = Counter((g["id"], g["id_r"]) for g in intervals.contained(df(x), df(y), ["key"]).collect())
    assert got == Counter((a[1], b[1]) for a in x for b in real if a[0] == b[0] and a[2] >= b[2] and a[3] <= b[3])


def test_rows_met_are_few(spark):
    """100,000 intervals of one key in a row: what the join puts out before its last filter is a multiple of the matches, not of the pairs."""
    n = 100_000
    x = spark.range(n).selectExpr("'k' AS key", "id", "id * 1000 AS start", "id * 1000 + 900 + id % 300 AS stop")
    met = intervals.overlapping(x, x, ["key"], least=-(10**9))  # all that meet in the first bin that both have
    matches = intervals.overlapping(x, x, ["key"]).count()
    assert matches >= n and met.count() < 12 * matches
