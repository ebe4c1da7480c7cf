import math
import random

import numpy as np

from clusterlake.functions import profiles as P
from clusterlake.operators.profiles import search
from clusterlake.sources.tables import read_profiles


def profile_text(consensus, accession="PF00001.1", trusted=10.0):
    """A profile that favours one letter at each node."""
    lines = [f"HMMER3/f [x]\nNAME  X\nACC   {accession}\nLENG  {len(consensus)}\nTC    {trusted} {trusted};\nHMM     " + " ".join(P.LETTERS), "  m->m m->i m->d i->m i->i d->m d->d"]
    move = " ".join(f"{-math.log(x):.5f}" for x in (0.98, 0.01, 0.01, 0.6, 0.4, 0.6, 0.4))
    flat = " ".join(f"{-math.log(x):.5f}" for x in P.BACKGROUND)
    lines += [flat, move]
    for k, c in enumerate(consensus, 1):
        match = " ".join(f"{-math.log(0.81 if x == c else 0.01):.5f}" for x in P.LETTERS)
        lines += [f"  {k} {match} {k} - - -", flat, move]
    return "\n".join(lines) + "\n//\n"


def brute(p, s):
    """The same recursion, cell by cell."""
    m = len(p.match)
    enter = np.arange(m, 0, -1) / np.arange(m, 0, -1).sum()
    best = -1e9
    M, I, D = {}, {}, {}
    for i in range(1, len(s) + 1):
        for k in range(m):
            g = lambda t, a, b: t.get((a, b), -1e9)
            start = math.log(enter[k])
            M[i, k] = p.match[k, P.LETTERS.index(s[i - 1])] + max(start, *([g(M, i - 1, k - 1) + p.move[k - 1, 0], g(I, i - 1, k - 1) + p.move[k - 1, 3], g(D, i - 1, k - 1) + p.move[k - 1, 5]] if k else [start]))
            I[i, k] = max(g(M, i - 1, k) + p.move[k, 1], g(I, i - 1, k) + p.move[k, 4])
            D[i, k] = max(g(M, i, k - 1) + p.move[k - 1, 2], g(D, i, k - 1) + p.move[k - 1, 6]) if k else -1e9
            best = max(best, M[i, k])
    return best


def test_viterbi_is_the_recursion():
    r = random.Random(1)
    p = P.parse_profile(profile_text("MKVLAWGTREDQ"), "x")
    for _ in range(20):
        s = "".join(r.choice(P.LETTERS) for _ in range(r.randint(1, 8))) + "MKVLAWGTREDQ"[r.randint(0, 5) : r.randint(6, 12)] + r.choice(["", "AC", "MKV"])
        score, start, stop, text = P.viterbi(p, s)
        n = len(s)
        length = np.log(n / (n + 3.0)) * n + np.log(3.0 / (n + 3.0)) - (n * np.log(n / (n + 1.0)) + np.log(1.0 / (n + 1.0)))
        assert abs(score * math.log(2) - length - brute(p, s)) < 1e-3  # the text has five decimals
        assert len(text) == 12 and text.replace("-", "") and 0 <= start < stop <= n


def test_alignment_with_gaps():
    p = P.parse_profile(profile_text("MKVLAWGTREDQHHSS"), "x")
    assert P.viterbi(p, "CCMKVLAWGTREDQHHSSCC")[1:] == (2, 18, "MKVLAWGTREDQHHSS")
    assert P.viterbi(p, "MKVLAWTREDQHHSS")[3] == "MKVLAW-TREDQHHSS"
    assert P.viterbi(p, "MKVLAWGCCTREDQHHSS")[3] == "MKVLAWGTREDQHHSS"
    assert P.viterbi(p, "") == (0.0, 0, 0, "-" * 16)


def test_search(spark, tmp_path):
    (tmp_path / "p.hmm").write_text(profile_text("MKVLAWGTREDQHHSS") + profile_text("CCCCWWWWHHHH", "PF00002.7"))
    genes = spark.createDataFrame([(1, "AAMKVLAWGTREDQHHSSAA"), (2, "GGGGCCCCWWWWHHHHGG"), (3, "GAGAGAGA"), (4, None)], "gene_id long, aa_seq string")
    hits = {(r["gene_id"], r["accession"], r["start"], r["stop"]) for r in search(genes, read_profiles(spark, str(tmp_path / "p.hmm"))).collect()}
    assert hits == {(1, "PF00001", 2, 18), (2, "PF00002", 4, 16)}


def test_accessions_of_six_digits_lose_their_version(spark, tmp_path):
    from clusterlake.sources.tables import read_domain_list, read_profiles

    one = "HMMER3/f [x]\nNAME  x\nACC   {}\nLENG  7\nHMM\n//\n"
    (tmp_path / "p.hmm").write_text("".join(one.format(a) for a in ("PF00001.3", "PF100000.3", "PF1234567.12", "PF100001")))
    assert sorted(r["accession"] for r in read_profiles(spark, str(tmp_path / "p.hmm")).collect()) == ["PF00001", "PF100000", "PF100001", "PF1234567"]
    (tmp_path / "l.txt").write_text("PF100000.3\nPF00002\n")
    assert sorted(r["domain"] for r in read_domain_list(spark, str(tmp_path / "l.txt")).collect()) == ["PF00002", "PF100000"]
