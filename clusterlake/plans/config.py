"""Settings that affect results, with their defaults, and their hash."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields, replace

#: Anchor domain accessions.
ANCHOR_DOMAINS = ("PF02801", "PF02624", "PF00109", "PF00501", "PF02797", "PF01397", "PF03936", "PF00432", "PF00195", "PF00494", "PF00668", "PF05147")

#: Product names of the legacy classes.
LEGACY_CLASSES = {
    "PKSI": ("t1pks", "T1PKS"),
    "PKSother": ("transatpks", "t2pks", "t3pks", "otherks", "hglks", "transAT-PKS", "transAT-PKS-like", "T2PKS", "T3PKS", "PKS-like", "hglE-KS"),
    "NRPS": ("nrps", "NRPS", "NRPS-like", "thioamide-NRP", "NAPAA"),
    "RiPP": (
        "lantipeptide", "thiopeptide", "bacteriocin", "linaridin", "cyanobactin", "glycocin", "LAP", "lassopeptide", "sactipeptide", "bottromycin",
        "head_to_tail", "microcin", "microviridin", "proteusin", "lanthipeptide", "lipolanthine", "RaS-RiPP", "fungal-RiPP", "TfuA-related",
        "guanidinotides", "RiPP-like", "lanthipeptide-class-i", "lanthipeptide-class-ii", "lanthipeptide-class-iii", "lanthipeptide-class-iv",
        "lanthipeptide-class-v", "ranthipeptide", "redox-cofactor", "thioamitides", "epipeptide", "cyclic-lactone-autoinducer", "spliceotide", "RRE-containing",
    ),
    "saccharide": ("amglyccycl", "oligosaccharide", "cf_saccharide", "saccharide"),
}


@dataclass(frozen=True)
class Settings:
    anchor_domains: tuple[str, ...] = ANCHOR_DOMAINS
    no_min_classes: tuple[str, ...] = ("terpene",)
    min_length: int = 0
    max_length: int = 500_000
    cds_overlap: float = 0.1
    domain_overlap: float = 0.1
    lcs_min: float = 0.1
    lcs_min_protocluster: float = 0.0
    extend_min: float = 0.3
    extend_min_core: float = 0.2
    extend_min_protocluster: float = 0.2
    extend_match: int = 5
    extend_mismatch: int = -3
    extend_gap: int = -2
    extend_max_gap: float = 0.1
    dense: float = 0.85
    preference: float = 0.0
    dense_preference: float = -5.0
    damping: float = 0.9
    max_iterations: int = 1000
    stable_iterations: int = 200
    top_frequencies: int = 3
    kmer: int = 10
    scaled: int = 100

    def scoring(self) -> dict:
        """The values that the score of two records with given features depends on."""
        own = ("anchor_domains", "no_min_classes", "lcs_min", "lcs_min_protocluster", "extend_min", "extend_min_core", "extend_min_protocluster", "extend_match", "extend_mismatch", "extend_gap", "extend_max_gap")
        return {k: getattr(self, k) for k in own}

    def digest(self) -> str:
        """Changes when a value does; a run only goes on with results of the same digest."""
        return hashlib.sha256(repr([(f.name, getattr(self, f.name)) for f in fields(self)]).encode()).hexdigest()

    @classmethod
    def from_yaml(cls, text: str) -> Settings:
        """Keys are the fields' names in any case; unknown keys are ignored, missing ones keep their default."""
        import yaml

        given = {str(k).lower(): v for k, v in (yaml.safe_load(text) or {}).items()}
        names = {f.name for f in fields(cls)}
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names})
