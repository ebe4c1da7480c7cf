"""Profile search and alignment: Viterbi over a profile's match, insert and delete states, vectorised over sequences of a batch.

This is a plain local, one-hit Viterbi in log-odds against the profile's background, without the filters, null-model corrections and
calibrated statistics of dedicated search programs: scores are near theirs for clear hits, but not the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
#: Background frequencies of amino acids, in the order of LETTERS.
BACKGROUND = np.array([0.0787945, 0.0151600, 0.0535222, 0.0668298, 0.0397062, 0.0695071, 0.0229198, 0.0590092, 0.0594422, 0.0963728, 0.0237718, 0.0414386, 0.0482904, 0.0395639, 0.0540978, 0.0683364, 0.0540687, 0.0673417, 0.0114135, 0.0304133])
NEVER = -1e9


@dataclass
class Profile:
    accession: str
    match: np.ndarray  # [length, letters] log-odds
    move: np.ndarray  # [length, 7]: log probabilities MM MI MD IM II DM DD from each node
    trusted: float | None


def parse_profile(body: str, accession: str, trusted: float | None = None) -> Profile:
    """From the text of one profile: node lines of negative logarithms, three for each node."""
    lines = body[body.index("\nHMM ") :].splitlines()[1:]
    at = next(i for i, x in enumerate(lines) if x.split()[:1] == ["1"])
    value = lambda x: NEVER if x == "*" else -float(x)
    match, move = [], []
    for i in range(at, len(lines) - 2, 3):
        parts = lines[i].split()
        if not parts or not parts[0].isdigit():
            break
        match.append([value(x) for x in parts[1:21]])
        move.append([value(x) for x in lines[i + 2].split()[:7]])
    return Profile(accession, np.array(match) - np.log(BACKGROUND), np.array(move), trusted)


def viterbi(p: Profile, sequence: str) -> tuple[float, int, int, str]:
    """(score in bits, start, stop, aligned string) of the best local hit: 0-based and half open. The string has the profile's length: a letter or a gap for each node."""
    x = np.array([LETTERS.find(c) for c in sequence.upper()])
    n, m = len(x), len(p.match)
    if not n or not m:
        return 0.0, 0, 0, "-" * m
    odds = np.where(x[:, None] >= 0, p.match[:, np.maximum(x, 0)].T, 0.0)
    enter = np.log(2.0 / (m * (m + 1))) + np.log(np.arange(m, 0, -1))  # a local start at any node, earlier ones more likely
    enter -= np.log(np.exp(enter).sum())
    mm, mi, md, im, ii, dm, dd = p.move.T
    vm, vi, vd = (np.full((n + 1, m), NEVER) for _ in range(3))
    came = np.zeros((n + 1, m), np.int8)  # of match: 0 start, 1 match, 2 insert, 3 delete
    del_open = np.zeros((n + 1, m), bool)  # of delete: from match
    ins_open = np.zeros((n + 1, m), bool)  # of insert: from match
    run = np.concatenate(([0.0], np.cumsum(np.maximum(dd[:-1], NEVER / m))))
    for i in range(1, n + 1):
        before = np.full((4, m), NEVER)
        before[0] = enter
        before[1, 1:] = vm[i - 1, :-1] + mm[:-1]
        before[2, 1:] = vi[i - 1, :-1] + im[:-1]
        before[3, 1:] = vd[i - 1, :-1] + dm[:-1]
        came[i] = before.argmax(0)
        vm[i] = before.max(0) + odds[i - 1]
        opened, longer = vm[i - 1] + mi, vi[i - 1] + ii
        ins_open[i] = opened >= longer
        vi[i] = np.maximum(opened, longer)
        # Deletes run along the profile within a row: the best opening so far plus the way from there.
        first = np.full(m, NEVER)
        first[1:] = vm[i, :-1] + md[:-1] - run[1:]
        best = np.maximum.accumulate(first)
        del_open[i] = first >= best
        vd[i] = np.maximum(best + run, NEVER)
    i, k = divmod(int(vm.argmax()), m)
    length = np.log(n / (n + 3.0)) * n + np.log(3.0 / (n + 3.0)) - (n * np.log(n / (n + 1.0)) + np.log(1.0 / (n + 1.0)))
    score, stop = (vm[i, k] + length) / np.log(2), i
    text, state = ["-"] * m, "M"
    while True:
        if state == "M":
            text[k] = sequence[i - 1]
            back = came[i, k]
            i -= 1
            if back == 0:
                return float(score), i, stop, "".join(text)
            k -= 1
            state = "MID"[back - 1]
        elif state == "I":
            state = "M" if ins_open[i, k] else "I"
            i -= 1
        else:
            state = "M" if del_open[i, k] else "D"
            k -= 1
