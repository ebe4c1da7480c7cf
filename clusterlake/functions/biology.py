"""Translation of coding sequences."""

from __future__ import annotations

from itertools import product

#: The standard genetic code in the order TCAG, and what other tables change, by number.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CHANGES = {
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    10: {"TGA": "C"},
    12: {"CTG": "S"},
    25: {"TGA": "G"},
}
_COMPLEMENT = str.maketrans("ACGTUNRYKMSWBDHVacgtunrykmswbdhv", "TGCAANYRMKSWVHDBtgcaanyrmkswvhdb")


def codons(table: int = 1) -> dict[str, str]:
    out = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), STANDARD, strict=True)}
    return out | CHANGES.get(table, {})


def reverse_complement(nt: str) -> str:
    return nt.translate(_COMPLEMENT)[::-1]


def translate(nt: str, table: int = 1) -> str:
    """Up to the first stop codon; a codon with an ambiguous letter is X, and letters left over are dropped."""
    code, out = codons(table), []
    nt = nt.upper().replace("U", "T")
    for i in range(0, len(nt) - 2, 3):
        aa = code.get(nt[i : i + 3], "X")
        if aa == "*":
            break
        out.append(aa)
    return "".join(out)


def in_frame(nt: str, fuzzy_start: bool, fuzzy_end: bool) -> str:
    """A sequence whose length isn't a multiple of three is trimmed at its fuzzy end, at the start if only that is."""
    extra = len(nt) % 3
    if not extra:
        return nt
    return nt[extra:] if fuzzy_start and not fuzzy_end else nt[:-extra]
