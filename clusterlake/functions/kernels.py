"""Alignment of two records' domains: plain Python on lists, with no Spark.

Positions count domains from 0; a stop is exclusive. Where the better match is with the second record read backwards, its positions
and gene numbers count from its end.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from difflib import SequenceMatcher
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np

from clusterlake.plans.config import Settings

REGION_TYPES = ("region", "cand_cluster")


@dataclass
class Record:
    """Domains in reading order, each with the number of its gene among the genes that have domains."""

    domains: list[str]
    gene: list[int]
    cores: set[int] = field(default_factory=set)
    n_genes: int = 0
    kind: str = "region"
    product: str = ""
    alignments: list[str] = field(default_factory=list)
    orfs: list[int] = field(default_factory=list)
    all_orfs: list[int] = field(default_factory=list)
    contig_edge: bool = False
    protocore: set[int] = field(default_factory=set)

    @classmethod
    def of(cls, genes: Sequence[dict], kind: str = "region", product: str = "", contig_edge: bool = False) -> Record:
        """Genes with orf, strand, is_core and hsps (accession, alignment); the domains of a gene on the minus strand come in reverse."""
        r = cls([], [], kind=kind, product=product or "", contig_edge=bool(contig_edge), all_orfs=[g["orf"] for g in genes])
        for g in genes:
            hsps = list(g["hsps"] or [])
            if not hsps:
                continue
            for h in hsps if g["strand"] == 1 else hsps[::-1]:
                r.domains.append(h["accession"])
                r.alignments.append(h["alignment"] or "")
                r.gene.append(r.n_genes)
            if g["is_core"]:
                r.cores.add(r.n_genes)
            if g["in_protocore"]:
                r.protocore.add(r.n_genes)
            r.orfs.append(g["orf"])
            r.n_genes += 1
        return r

    def backwards(self) -> Record:
        last = self.n_genes - 1
        return replace(self, domains=self.domains[::-1], gene=[last - g for g in self.gene[::-1]], cores={last - g for g in self.cores}, protocore={last - g for g in self.protocore}, alignments=self.alignments[::-1], orfs=self.orfs[::-1], all_orfs=self.all_orfs[::-1])


    @cached_property
    def turned(self) -> Record:
        """backwards(), made once."""
        return self.backwards()

    @cached_property
    def place(self) -> dict[str, int]:
        """Where each domain is first."""
        return {d: k for k, d in reversed(list(enumerate(self.domains)))}

    @cached_property
    def core_bits(self) -> tuple[int, int]:
        """Core genes and genes of protocores, a bit each."""
        return sum(1 << g for g in self.cores), sum(1 << g for g in self.protocore)


@dataclass(frozen=True)
class Region:
    """What is compared: domain positions and gene numbers of both records, and whether the second is read backwards."""

    a0: int
    a1: int
    b0: int
    b1: int
    ga0: int
    ga1: int
    gb0: int
    gb1: int
    reverse: bool = False

    @classmethod
    def whole(cls, a: Record, b: Record) -> Region:
        return cls(0, len(a.domains), 0, len(b.domains), 0, a.n_genes, 0, b.n_genes)


def _bits(start: int, stop: int) -> int:
    return (1 << stop) - (1 << start) if stop > start else 0


def longest_match(a: Record, b: Record, asked: list | None = None) -> Region:
    """The common substring to start from, of all matching blocks forwards and backwards: the one longest with a core gene, else the most central with one; else the same without.

    Between records below the level of candidate clusters, genes of the protocores count instead of core genes.
    """
    below = a.kind not in REGION_TYPES and b.kind not in REGION_TYPES
    kinds: dict[bool, list[tuple[int, float, int, int, bool]]] = {True: [], False: []}
    few, positions = (a, 0) if a.n_genes <= b.n_genes else (b, 1)
    for reverse, other in ((False, b.domains), (True, b.domains[::-1])):
        for block in SequenceMatcher(None, a.domains, other, autojunk=False).get_matching_blocks():
            i, j, n = block
            if not n:
                continue
            core = any(r.gene[k] <= c <= r.gene[k + n - 1] for r, k in ((a, i), (b, j)) for c in (r.protocore if below else r.cores))
            if asked is not None:
                asked.append((int(below), _bits(a.gene[i], a.gene[i + n - 1] + 1), _bits(b.gene[j], b.gene[j + n - 1] + 1), core))
            k = (i, j)[positions]
            middle = few.n_genes / 2
            off = round(min(abs(middle - few.gene[k]), abs(middle - few.gene[k + n - 1])))
            kinds[core].append((n, off, i, j, reverse))
    for found in (kinds[True], kinds[False]):
        if not found:
            continue
        most = max(x[0] for x in found)
        at = [k for k, x in enumerate(found) if x[0] == most]
        # A longer block discards what came before it, but shorter ones after it are looked at for their place.
        best = found[at[0]] if len(at) == 1 else min(found[at[0] :], key=lambda x: x[1])
        n, _, i, j, reverse = best
        other = b.backwards() if reverse else b
        end = lambda r, stop: r.n_genes if stop == len(r.domains) else r.gene[stop - 1] + 1
        if reverse:  # genes are told from the forward positions
            f0, f1 = len(b.domains) - (j + n), len(b.domains) - j
            gb0, gb1 = b.n_genes - end(b, f1), b.n_genes - b.gene[f0]
        else:
            gb0, gb1 = other.gene[j], end(other, j + n)
        return Region(i, i + n, j, j + n, a.gene[i], end(a, i + n), gb0, gb1, reverse)
    raise ValueError("the records have no domain in common")


def _arm(query: Record, start: int, target: Record, target_start: int, free: dict[str, list[int]], step: int, c: Settings, most: int) -> tuple[int, int]:
    """Domains of query and target to add on one side of a match, whose edge is start and target_start (exclusive in the direction step)."""
    score = best = query_add = target_add = 0
    last = target_start - 1 if step > 0 else target_start
    reach = range(start, len(query.domains)) if step > 0 else range(start - 1, -1, -1)
    for n, q in enumerate(reach, 1):
        places = free.get(query.domains[q])
        if not places:
            score += c.extend_mismatch
            continue
        # On the right the match's own last place may be taken again; on the left its first may not.
        usable = [p for p in places if p >= target_start - 1] if step > 0 else [p for p in reversed(places) if p < target_start]
        if not usable or abs(usable[0] - last) > most:
            score += c.extend_mismatch
            continue
        p = usable[0]
        ahead = (p - last) * step
        score += c.extend_match
        if ahead > 1:
            score += c.extend_gap * (ahead - 1)
        if ahead < 1:
            score -= c.extend_gap
        if ahead > 0:
            last = p
        places.remove(p)
        if score >= best:
            best, query_add = score, n
            target_add = max(target_add, p + 1 - target_start if step > 0 else target_start - p)
    return query_add, target_add


def extend_legacy(a: Record, b: Record, r: Region, c: Settings) -> Region:
    """Extends both ways by matches, mismatches and gaps, from the record with fewer domains to the other. b is as r reads it."""
    swap = len(a.domains) > len(b.domains)
    q, t = (b, a) if swap else (a, b)
    (q0, q1), (t0, t1) = ((r.b0, r.b1), (r.a0, r.a1)) if swap else ((r.a0, r.a1), (r.b0, r.b1))
    (gq0, gq1), (gt0, gt1) = ((r.gb0, r.gb1), (r.ga0, r.ga1)) if swap else ((r.ga0, r.ga1), (r.gb0, r.gb1))
    most = int(len(t.domains) * c.extend_max_gap)
    free: dict[str, list[int]] = {}
    for p, d in enumerate(t.domains):
        free.setdefault(d, []).append(p)
    if t1 != len(t.domains) and q1 != len(q.domains):
        dq, dt = _arm(q, q1, t, t1, free, 1, c, most)
        if dq:
            q1, gq1 = q1 + dq, q.gene[q1 + dq - 1] + 1
        if dt > 0:
            t1, gt1 = t1 + dt, t.gene[t1 + dt - 1] + 1
    if t0 != 0 and q0 != 0:
        dq, dt = _arm(q, q0, t, t0, free, -1, c, most)
        if dq:
            q0, gq0 = q0 - dq, q.gene[q0 - dq]
        if dt > 0:
            t0, gt0 = t0 - dt, t.gene[t0 - dt]
    if swap:
        return Region(t0, t1, q0, q1, gt0, gt1, gq0, gq1, r.reverse)
    return Region(q0, q1, t0, t1, gq0, gq1, gt0, gt1, r.reverse)


def extend_greedy(a: Record, b: Record, r: Region) -> Region:
    """From the first to the last domain in common, on each record."""
    common = set(a.domains) & set(b.domains)
    (a0, a1), (b0, b1) = ((min(p), max(p) + 1) for p in ([k for k, d in enumerate(x.domains) if d in common] for x in (a, b)))
    return Region(a0, a1, b0, b1, a.gene[a0], a.gene[a1 - 1] + 1, b.gene[b0], b.gene[b1 - 1] + 1, r.reverse)


def extend_simple(a: Record, b: Record, r: Region, c: Settings) -> Region:
    """Each arm up to where the sum of matches and gaps, by whether the other record has the domain at all, is greatest."""
    common = set(a.domains) & set(b.domains)

    def arm(x: Record, places: range) -> int | None:
        score = best = 0
        out = None
        for p in places:
            score += c.extend_match if x.domains[p] in common else c.extend_gap
            if score > best:
                best, out = score, p
        return out

    new = {}
    for x, s, lo, hi in ((a, "a", r.a0, r.a1), (b, "b", r.b0, r.b1)):
        if (p := arm(x, range(hi, len(x.domains)))) is not None:
            new |= {f"{s}1": p + 1, f"g{s}1": x.gene[p] + 1}
        if (p := arm(x, range(lo - 1, -1, -1))) is not None:
            new |= {f"{s}0": p, f"g{s}0": x.gene[p]}
    return replace(r, **new)


def extend_glocal(a: Record, b: Record, r: Region) -> Region:
    """Takes the shorter arm fully, on each side; the first record's if they are equal."""
    r = replace(r, a0=0, ga0=0) if r.a0 <= r.b0 else replace(r, b0=0, gb0=0)
    n, m = len(a.domains), len(b.domains)
    return replace(r, a1=n, ga1=a.n_genes) if n - r.a1 <= m - r.b1 else replace(r, b1=m, gb1=b.n_genes)


def long_enough(a: Record, b: Record, r: Region, share: float) -> bool:
    return (r.a1 - r.a0) >= share * len(a.domains) or (r.b1 - r.b0) >= share * len(b.domains)


def has_core(a: Record, b: Record, r: Region, asked: list | None = None) -> bool:
    core = any(r.ga0 <= g < r.ga1 for g in a.cores) or any(r.gb0 <= g < r.gb1 for g in b.cores)
    if asked is not None:
        n = b.n_genes
        asked.append((0, _bits(r.ga0, r.ga1), _bits(n - r.gb1, n - r.gb0) if r.reverse else _bits(r.gb0, r.gb1), core))
    return core


def accepted_match(a: Record, b: Record, r: Region, c: Settings, asked: list | None = None) -> bool:
    share = c.lcs_min if a.kind in REGION_TYPES or b.kind in REGION_TYPES else c.lcs_min_protocluster
    return long_enough(a, b, r, share) or has_core(a, b, r, asked)


def accepted_extension(a: Record, b: Record, r: Region, c: Settings, asked: list | None = None) -> bool:
    free = a.product == b.product and a.product in c.no_min_classes
    core = has_core(a, b, r, asked)
    if a.kind in REGION_TYPES or b.kind in REGION_TYPES:
        return long_enough(a, b, r, c.extend_min) or core and (free or long_enough(a, b, r, c.extend_min_core))
    if a.kind == b.kind == "protocluster":
        return core and (free or long_enough(a, b, r, c.extend_min_protocluster))
    return a.kind == b.kind == "proto_core" and core


def comparable_region(a: Record, b: Record, mode: str = "glocal", strategy: str = "legacy", c: Settings | None = None, asked: list | None = None) -> tuple[Region, Region, Record]:
    """(region, match to start from, b as the region reads it). Global mode, and auto mode without a contig edge, compare the whole records, as do regions too short.

    What is asked of core genes is noted in asked: whether of protocores, the genes of a and of b as bits, and whether one of them is core.
    """
    c = c or Settings()
    whole = Region.whole(a, b)
    if mode == "global" or mode == "auto" and not (a.contig_edge or b.contig_edge):
        return whole, whole, b
    match = longest_match(a, b, asked)
    other = b.turned if match.reverse else b
    if not accepted_match(a, other, match, c, asked):
        return whole, match, b
    r = {"legacy": lambda: extend_legacy(a, other, match, c), "greedy": lambda: extend_greedy(a, other, match), "simple_match": lambda: extend_simple(a, other, match, c)}[strategy]()
    if mode != "local":
        r = extend_glocal(a, other, r)
    if not accepted_extension(a, other, r, c, asked):
        return whole, match, b
    return r, match, other


class Regions:
    """comparable_region() of many pairs, found once for all that are alike.

    Of domains it asks which of the two records' are equal, of genes which domains are of one, and whether there is a core gene among some. Pairs
    that agree in the first two ask the same until a first answer differs, so that they share a tree of questions, whose leaves are (region, match).
    A pair goes down the tree; where no other has been, its region is found and what was asked becomes a branch.
    """

    #: Trees held at a time.
    MOST = 200_000

    def __init__(self, mode: str = "glocal", strategy: str = "legacy", c: Settings | None = None):
        self.mode, self.strategy, self.c = mode, strategy, c or Settings()
        self.shapes: dict[tuple, int] = {}
        self.trees: dict[tuple, list] = {}

    def _shape(self, r: Record) -> int:
        """A number of all that is asked of a record but its domains and core genes."""
        if (own := r.__dict__.get("shape")) is None or own[0] is not self.shapes:
            rest = r.kind, r.product if r.product in self.c.no_min_classes else None, r.contig_edge if self.mode == "auto" else None, tuple(r.gene), r.n_genes
            own = r.shape = self.shapes, self.shapes.setdefault(rest, len(self.shapes))
        return own[1]

    def of(self, a: Record, b: Record) -> tuple[Region, Region]:
        # Where each domain is first in the other record: two of one record are equal where these are, if the other has them at all.
        key = self._shape(a), self._shape(b), *map(a.place.get, b.domains), *map(b.place.get, a.domains)
        tree = self.trees.get(key)
        if tree is None:
            if len(self.trees) >= self.MOST:
                self.trees.clear()
            tree = self.trees[key] = [None, None]
        (a0, a1), (b0, b1) = a.core_bits, b.core_bits
        at, way, n = tree, 0, 0
        while (node := at[way]) is not None:
            if isinstance(node, tuple):
                return node
            below, x, y = node[2]
            at, way, n = node, (a1 & x or b1 & y) != 0 if below else (a0 & x or b0 & y) != 0, n + 1
        asked: list[tuple] = []
        region, match, _ = comparable_region(a, b, self.mode, self.strategy, self.c, asked)
        for below, x, y, core in asked[n:]:
            at[way] = node = [None, None, (below, x, y)]
            at, way = node, core
        at[way] = region, match
        return region, match


def jaccard(x: Sequence[str], y: Sequence[str]) -> float:
    s, t = set(x), set(y)
    return len(s & t) / len(s | t) if s and t else 0.0


def adjacency(x: Sequence[str], y: Sequence[str]) -> float:
    if len(x) == len(y) == 1 and x[0] == y[0]:
        return 1.0
    if len(x) < 2 or len(y) < 2:
        return 0.0
    s, t = ({tuple(sorted(p)) for p in pairwise(z)} for z in (x, y))
    return len(s & t) / len(s | t)


@lru_cache(1 << 16)
def aligned_distance(x: str, y: str) -> float:
    """Share of columns that differ, of those that aren't gaps in both. Equal strings have none; lengths must be equal."""
    if len(x) != len(y):
        raise ValueError("aligned strings differ in length")
    both = sum(p == q == "-" for p, q in zip(x, y, strict=True))
    same = sum(p == q != "-" for p, q in zip(x, y, strict=True))
    return 1 - same / (len(x) - both) if len(x) > both else 0.0


def aligned_distances(texts: Sequence[str]) -> np.ndarray:
    """aligned_distance() of each text with each, a row of bytes at a time."""
    n = len(texts)
    x = np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8).reshape(n, -1)
    gap = x == ord("-")
    out = np.zeros((n, n))
    for i in range(n):
        columns = x.shape[1] - (gap[i] & gap).sum(1)
        same = ((x[i] == x) & ~gap[i]).sum(1)
        out[i] = np.where(columns > 0, 1 - same / np.maximum(columns, 1), 0.0)
    return out


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, as many as the lesser side has: shortest augmenting paths with potentials."""
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assignment(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sorted((owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])


def sequence_similarity(x: Sequence[tuple[str, str]], y: Sequence[tuple[str, str]], anchors: Sequence[str], boost: float = 1.0) -> float:
    """Domain sequence similarity of (accession, aligned string) lists: copies of a domain are matched at least cost; copies without a partner count 1."""
    copies: dict[str, tuple[list[str], list[str]]] = {}
    for side, rows in enumerate((x, y)):
        for accession, text in rows:
            copies.setdefault(accession, ([], []))[side].append(text)
    d, n = {True: 0.0, False: 0.0}, {True: 0, False: 0}
    for accession, (p, q) in copies.items():
        k, m = len(p), len(q)
        anchor = accession in anchors
        n[anchor] += max(k, m)
        if not (p and q):
            d[anchor] += k + m
        elif k == 1 or m == 1:
            d[anchor] += min(aligned_distance(s, t) for s in p for t in q) + abs(k - m)
        else:
            cost = np.array([[aligned_distance(s, t) for t in q] for s in p])
            d[anchor] += sum(cost[i, j] for i, j in assignment(cost)) + abs(k - m)
    if not n[True]:
        return 1 - d[False] / n[False] if n[False] else 0.0
    if not n[False]:
        return 1 - d[True] / n[True]
    w = n[True] * boost, n[False]
    return 1 - (w[1] * d[False] / n[False] + w[0] * d[True] / n[True]) / (w[0] + w[1])


def inflate(orfs: list[int], all_orfs: list[int], start: int, stop: int) -> tuple[int, int]:
    """Numbers among the genes with domains, as numbers among all genes."""
    return all_orfs.index(orfs[start]), all_orfs.index(orfs[stop - 1]) + 1


def pair_score(a: Record, b: Record, weights: tuple[float, float, float, float], mode: str = "glocal", strategy: str = "legacy", c: Settings | None = None, regions: Regions | None = None) -> dict:
    """distance, jaccard, adjacency, dss and the region in gene numbers, of all genes. Records without a common domain have distance 1 and no region is chosen.

    With regions, which are of the same mode, strategy and settings, they are looked up there.
    """
    c = c or Settings()
    if a.place.keys().isdisjoint(b.place):
        return {"distance": 1.0, "jaccard": 0.0, "adjacency": 0.0, "dss": 0.0, "a_start": 0, "a_stop": a.n_genes, "b_start": 0, "b_stop": b.n_genes, "lcs_a_start": 0, "lcs_a_stop": 0, "lcs_b_start": 0, "lcs_b_stop": 0, "reverse": False}
    r, match = (regions or Regions(mode, strategy, c)).of(a, b)
    other, start = (b.turned if x.reverse else b for x in (r, match))
    x, y = slice(r.a0, r.a1), slice(r.b0, r.b1)
    j, ai = jaccard(a.domains[x], other.domains[y]), adjacency(a.domains[x], other.domains[y])
    dss = sequence_similarity(list(zip(a.domains[x], a.alignments[x], strict=True)), list(zip(other.domains[y], other.alignments[y], strict=True)), c.anchor_domains, weights[3])
    a0, a1 = inflate(a.orfs, a.all_orfs, r.ga0, r.ga1)
    b0, b1 = inflate(other.orfs, other.all_orfs, r.gb0, r.gb1)
    la0, la1 = inflate(a.orfs, a.all_orfs, match.ga0, match.ga1)
    lb0, lb1 = inflate(start.orfs, start.all_orfs, match.gb0, match.gb1)
    return {
        "distance": 1 - (j * weights[0] + ai * weights[1] + dss * weights[2]), "jaccard": j, "adjacency": ai, "dss": dss,
        "a_start": a0, "a_stop": a1, "b_start": b0, "b_stop": b1, "lcs_a_start": la0, "lcs_a_stop": la1, "lcs_b_start": lb0, "lcs_b_stop": lb1, "reverse": r.reverse,
    }


def without_overlaps(hits: Sequence[dict], share: float = 0.1) -> list[dict]:
    """Hits of one gene (start, stop, score), in order of arrival: of two that overlap by the share of either, the better scored to one decimal stays; of equals a later arrival replaces one that starts after it, else both stay."""
    kept: list[dict] = []
    for new in hits:
        losers = []
        for k, old in enumerate(kept):
            common = min(old["stop"], new["stop"]) - max(old["start"], new["start"])
            if common <= 0 or common / (old["stop"] - old["start"]) < share and common / (new["stop"] - new["start"]) < share:
                continue
            was, now = round(old["score"], 1), round(new["score"], 1)
            if was > now:
                break
            if now > was or new["start"] < old["start"]:
                losers.append(k)
        else:
            kept = [old for k, old in enumerate(kept) if k not in losers] + [new]
    return kept


def without_overlapping_genes(genes: Sequence[dict], share: float = 0.1) -> list[dict]:
    """Genes (start, stop, strand, length) in order: one that overlaps an earlier one of its strand by more than the share of the shorter protein is dropped if shorter, else takes the place of the first such."""
    kept: list[dict] = []
    for new in genes:
        for k, old in enumerate(kept):
            common = min(old["stop"], new["stop"]) - max(old["start"], new["start"])
            if old["strand"] == new["strand"] and common > 0 and common / 3 > share * min(old["length"], new["length"]):
                if new["length"] >= old["length"]:
                    kept = kept[:k] + kept[k + 1 :] + [new]
                break
        else:
            kept.append(new)
    return kept


def longest_of_overlapping_genes(genes: Sequence[dict], share: float = 0.1) -> list[dict]:
    """Genes as above, but compared with all that are kept: each overlap with a gene that isn't longer takes its place at the end of the list, of which the comparison passes over the gene that moves up. One that took several places is listed as often."""
    kept: list[dict] = []
    for new in genes:
        overlaps, k = False, 0
        while k < len(kept):
            old = kept[k]
            common = min(old["stop"], new["stop"]) - max(old["start"], new["start"])
            if old["strand"] == new["strand"] and common > 0 and common / 3 > share * min(old["length"], new["length"]):
                overlaps = True
                if new["length"] >= old["length"]:
                    kept = kept[:k] + kept[k + 1 :] + [new]
            k += 1
        if not overlaps:
            kept.append(new)
    return kept


def neighbour_joining(names: Sequence[str], distance: np.ndarray, of: Sequence[int] | None = None) -> str:
    """A Newick tree, rooted in the middle of its longest path; fewer than three members are joined at one point.

    With of, the class of each member, distance is that of classes. Members of a class lie at no distance and as far as each other from
    all others, and so does what two of them are joined to: a class counts as often as it has nodes left, and a step costs the square of
    the classes, not of the members. Without, members of equal rows are found to be a class.
    """
    if len(names) < 3:
        return f"({','.join(f'{n}:0.0' for n in names)}):0.01;"
    d = np.array(distance, float)
    if of is None:
        _, first, of = np.unique(d, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)
        of, d = np.argsort(order)[of.reshape(-1)], d[np.ix_(first[order], first[order])]
    links: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
    nodes: list[deque[int]] = [deque() for _ in range(len(d))]
    for x, c in enumerate(of):
        nodes[c].append(x)

    def link(x: int, y: int, length: float) -> None:
        links.setdefault(x, {})[y] = links.setdefault(y, {})[x] = max(0.0, length)

    for n in range(len(names), 2, -1):
        often = np.array([len(x) for x in nodes])
        total = (d * often).sum(1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.where(often > 1, -2 * total, np.inf))
        i, j = sorted(divmod(int(q.argmin()), len(nodes)))
        new = len(links)
        half = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        link(nodes[i].popleft(), new, half)
        link(nodes[j].popleft(), new, d[i, j] - half)
        if i == j:
            nodes[i].append(new)
            continue
        row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k, x in enumerate(nodes) if x]
        d = np.block([[d[np.ix_(keep, keep)], row[keep][:, None]], [row[keep][None, :], np.zeros((1, 1))]])
        nodes = [nodes[k] for k in keep] + [deque([new])]
    (x, i), (y, j) = [(x, c) for c, own in enumerate(nodes) for x in own]
    link(x, y, d[i, j])

    def far(start: int) -> tuple[int, float, dict[int, int]]:
        seen, stack, came = {start: 0.0}, [start], {start: -1}
        while stack:
            x = stack.pop()
            for y, w in links[x].items():
                if y not in seen:
                    seen[y], came[y] = seen[x] + w, x
                    stack.append(y)
        end = max(range(len(names)), key=lambda k: seen[k])
        return end, seen[end], came

    first, _, _ = far(0)
    last, length, came = far(first)
    at, left = last, length / 2
    while came[at] >= 0 and links[at][came[at]] < left:
        left -= links[at][came[at]]
        at = came[at]
    up = came[at]

    def write(x: int, parent: int, w: float) -> str:
        out, open_ = [], [(x, parent, w)]
        while open_:
            at = open_.pop()
            if isinstance(at, str):
                out.append(at)
                continue
            x, parent, w = at
            below = [(y, x, z) for y, z in links[x].items() if y != parent]
            out.append("(" if below else f"{names[x]}:{w:.6g}")
            open_.extend([f"):{w:.6g}"] if below else [])
            for y in below[:0:-1]:
                open_.extend([y, ","])
            open_.extend(below[:1])
        return "".join(out)

    if up < 0:
        own = [f"{names[at]}:0"] if at < len(names) else []  # the path has no length: its end is a member itself
        return f"({','.join(own + [write(y, at, z) for y, z in links[at].items()])}):0.01;"
    return f"({write(at, up, left)},{write(up, at, links[at][up] - left)}):0.01;"
