"""Parameters of sketching and of comparison (fixed values of the method)."""

from __future__ import annotations

from dataclasses import dataclass, replace

MARKER_K, MARKER_K_AA = 21, 10
MIN_CONTIG = 500
CHUNK = 20_000
MAX_LINEAR = 5000
ANCHOR_SCORE = 20.0
MIN_COVER = 500
RESCUE_MARKERS = 20
INDEX_QUERIES = 50
OVERLAP_SHARE = 0.5
DEBIAS_BASES, DEBIAS_ANI = 150_000, 0.9
ORF_FORWARD, ORF_REVERSE = 30, 45
LONG_GENOME, CONTIG_CAP = 100_000, 300_000


@dataclass(frozen=True)
class SketchParams:
    """How sequences are sampled. Two sketches compare only if these are equal."""

    c: int = 125
    k: int = 15
    marker_c: int = 1000
    use_aa: bool = False
    mask_span: int = 21

    def __post_init__(self) -> None:
        if self.k > (MARKER_K_AA if self.use_aa else 16):
            raise ValueError("k is too large: at most 16 for nucleotides, 10 for amino acids")
        if self.c > self.marker_c:
            raise ValueError("c must not exceed marker_c")

    @staticmethod
    def amino_acid() -> SketchParams:
        return SketchParams(c=15, k=6, marker_c=1000, use_aa=True)


#: Presets in the order in which they apply; the last one wins.
PRESETS = {"fast": {"c": 200}, "slow": {"c": 30}, "medium": {"c": 70}, "small_genomes": {"c": 30, "marker_c": 200}}


def with_presets(params: SketchParams, *names: str) -> SketchParams:
    """Parameters after presets; ``fast`` with ``slow`` is an error."""
    if {"fast", "slow"} <= set(names):
        raise ValueError("fast and slow exclude each other")
    for name, change in PRESETS.items():
        if name in names:
            params = replace(params, **change)
    unknown = set(names) - set(PRESETS)
    if unknown:
        raise ValueError(f"unknown presets: {sorted(unknown)}")
    return params


@dataclass(frozen=True)
class MapParams:
    """How pairs are compared. Percent arguments are fractions of 100; 0 means the default."""

    min_af: float = 0.0
    both_min_af: float = 0.0
    screen: float = 0.0
    robust: bool = False
    median: bool = False
    rescue: bool = True
    min_ani: float = 0.1

    def af_cutoff(self, aa: bool) -> float:
        return self.min_af / 100 or (0.05 if aa else 0.15)

    def screen_identity(self, aa: bool) -> float:
        return self.screen / 100 or (0.60 if aa else 0.80)


@dataclass(frozen=True)
class ChainParams:
    """Constants of anchors and chains that follow from the sketch."""

    c: int
    k: int
    aa: bool

    @property
    def bp_band(self) -> int:
        return 500 if self.aa else 2500

    @property
    def band(self) -> int:
        return self.bp_band // self.c

    @property
    def max_gap(self) -> int:
        return 50 if self.aa else 300

    @property
    def min_anchors(self) -> int:
        return 5 if self.aa else 3

    @property
    def min_score(self) -> float:
        return self.min_anchors * ANCHOR_SCORE * 0.75


def chain_params(p: SketchParams) -> ChainParams:
    return ChainParams(p.c, p.k, p.use_aa)
