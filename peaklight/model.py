"""Settings that change results, as frozen values with a signature, and the shared schemas."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

#: One spectrum per row; the two arrays run in parallel, axis ascending.
SPECTRUM = "spectrum_id string, axis array<double>, intensity array<double>"
#: Ranges of grid points, both ends included. NULL: start_idx to end_idx; empty: no support.
RUNS = "array<struct<start:int,end:int>>"


def canonical_json(value) -> str:
    """Sorted keys, no blanks, no NaN or infinity (null instead), -0.0 as 0.0."""

    def clean(x):
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        if isinstance(x, float):
            return (x + 0.0) if math.isfinite(x) else None
        return x

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def signature(value, size: int = 40) -> str:
    return hashlib.sha1(canonical_json(value).encode()).hexdigest()[:size]


class Settings:
    def payload(self) -> dict:
        return {"kind": type(self).__name__, **asdict(self)}

    def signature(self) -> str:
        return signature(self.payload())


@dataclass(frozen=True)
class Grid(Settings):
    """minimum, minimum + step, ... up to maximum."""

    minimum: float = 60.0
    maximum: float = 4000.0
    step: float = 1.0

    def __post_init__(self):
        if not (self.step > 0 and self.maximum > self.minimum and all(map(math.isfinite, (self.minimum, self.maximum, self.step)))):
            raise ValueError("a grid needs finite ends in order and a positive step")

    def __len__(self) -> int:
        return int(math.floor((self.maximum - self.minimum) / self.step + 1e-9)) + 1


#: Upper end of the range that is searched first.
FIRST_HIGH = 2000


def first_range(grid: Grid, high: float = FIRST_HIGH) -> tuple[float, float]:
    """The range of a grid that is searched first: from its start to ``high``, or to its end where that leaves nothing."""
    top = min(grid.maximum, high)
    return grid.minimum, top if top > grid.minimum else grid.maximum


@dataclass(frozen=True)
class WhiteReference(Settings):
    """Subtraction of a white reference that is known by the hash of its content."""

    enabled: bool = False
    scale: float = 1.0
    content_sha1: str = ""

    def payload(self) -> dict:
        return {"kind": "WhiteReference", "version": 1, "enabled": self.enabled, "scale": round(float(self.scale), 6), "content_sha1": self.content_sha1}

    def token(self) -> str:
        return signature(self.payload(), 12)

    def label(self) -> str:
        return f"on (scale={self.scale:.3f})" if self.enabled else "off"


@dataclass(frozen=True)
class Upload(Settings):
    """A file by name, hash and size, without its bytes."""

    filename: str
    sha1: str
    size_bytes: int | None = None

    def __post_init__(self):
        if not self.filename.strip():
            raise ValueError("an upload has a file name")
        digest = self.sha1.strip().lower()
        if len(digest) != 40 or any(c not in "0123456789abcdef" for c in digest):
            raise ValueError("the hash of an upload has 40 hexadecimal digits")
        if self.size_bytes is not None and self.size_bytes < 0:
            raise ValueError("the size of an upload isn't negative")
        object.__setattr__(self, "sha1", digest)

    @classmethod
    def of(cls, filename: str, content: bytes) -> Upload:
        return cls(filename, hashlib.sha1(content).hexdigest(), len(content))


@dataclass(frozen=True)
class Matching(Settings):
    gradient_weight: float = 0.20
    similarity_weight: float = 0.88
    f1_weight: float = 0.75
    peak_tolerance: int = 5
    max_shift: int = 5
    min_coverage: float = 0.70
    shortlist_raw: int = 3600
    shortlist_corrected: int = 1800
    shortlist_floor: int = 300
    per_top_raw: int = 12
    per_top_corrected: int = 8
    phase_cap: int = 5
    peak_slots: int = 12
    slot_pcs: float = 0.52
    slot_similarity: float = 0.50
    tie: float = 1e-12
    max_peaks: int = 80
    min_run: int = 5
    min_signal: float = 1e-9
    prominence: float = 1e-6
    prominence_share: float = 0.03
    peak_distance: int = 3
    min_support: int = 20
    min_pcs: float = 0.0
    offset_query: bool = True

    def shortlist(self, variant: str, top_n: int) -> int:
        per, least = (self.per_top_raw, self.shortlist_raw) if variant == "DB-RAW" else (self.per_top_corrected, self.shortlist_corrected)
        return max(self.shortlist_floor, per * top_n, least)


#: For a signed residual: its offset stays, and peaks must agree a little.
def residual_matching() -> Matching:
    return Matching(offset_query=False, min_pcs=0.15)


@dataclass(frozen=True)
class Evidence(Settings):
    min_score: float = 0.80
    min_margin: float = 0.05
    min_coverage: float = 0.80
    min_common: int = 50
    min_specimens: int = 2
    reject_boundary: bool = True
    reject_clipping: bool = True


@dataclass(frozen=True)
class Residual(Settings):
    min_common: int = 20
    min_improvement: float = 0.02
    edge_guard: int = 3


#: Other spellings of the baseline methods.
BASELINE_ALIASES = {"arpls": "arpls", "als": "als", "iasls": "als", "asls": "als", "none": "none", "off": "none", "": "none"}


@dataclass(frozen=True)
class Baseline(Settings):
    method: str = "arpls"
    lam: float = 1e5
    iterations: int = 50
    tolerance: float = 1e-3
    p: float = 0.01
    als_iterations: int = 20
    lam1: float = 1e2
    autoscale: bool = True
    strength: float = 1.0

    def payload(self) -> dict:
        """Only what the method uses counts for the signature."""
        used = {"arpls": ("lam", "iterations", "tolerance"), "als": ("lam", "p", "als_iterations", "lam1"), "none": ()}[self.method]
        shared = () if self.method == "none" else ("autoscale", "strength")
        return {"kind": "Baseline", "method": self.method} | {k: getattr(self, k) for k in (*used, *shared)}

    @classmethod
    def named(cls, method: str, **settings) -> Baseline:
        key = (method or "").strip().lower()
        if key not in BASELINE_ALIASES:
            raise ValueError(f"unknown baseline method {method!r}")
        return cls(method=BASELINE_ALIASES[key], **settings)


def library_baseline() -> Baseline:
    return Baseline(lam=1e4)


@dataclass(frozen=True)
class Smoothing(Settings):
    method: str = "savgol"
    window: int = 5
    order: int = 3

    def payload(self) -> dict:
        return {"kind": "Smoothing", "method": self.method} | ({"window": self.window, "order": self.order} if self.method == "savgol" else {})


@dataclass(frozen=True)
class Denoise(Settings):
    sigma_cap: float = 1.0
    span: float = 1300.0
    overlap: float = 325.0
    guide: float = 10.0
    trend: float = 20.0
    range_share: float = 0.02
    points: int = 500


@dataclass(frozen=True)
class Reduction(Settings):
    minimum: float = 50.0
    maximum: float = 2000.0
    step: float = 1.0
    least_k: int = 3
    most_k: int = 9
    components: int = 30
    keep_all: int = 4
    representatives: int = 9
    medoid_seeds: int = 6
    seed: int = 42


@dataclass(frozen=True)
class Trim(Settings):
    """Edge trimming of spectra scaled to 0..1000."""

    low: float = 0.0
    high: float = 1000.0
    head_extra: float = 2.0
    smooth_window: float = 3.0
    slope_window: float = 4.0
    noise_range: float = 40.0
    noise_points: int = 80
    ramp_span: float = 6.0
    quiet_sigma: float = 1.0
    peak_share: float = 0.5
    rising_share: float = 0.60
    fall_share: float = 0.03
    fall_sigma: float = 2.0
    fall_counts: float = 20.0
    fall_window: float = 4.0
    fall_rising_share: float = 0.55
    zero: float = 0.0
    tail_points: int = 20
    tail_jump: float = 30.0
    edge_jump: float = 50.0
    edge_range: float = 250.0
    return_share: float = 0.20
    return_counts: float = 40.0
    return_range: float = 300.0


@dataclass(frozen=True)
class Query:
    """A prepared query on the grid of the library."""

    vector: list[float]
    mask: list[bool]
    variant: str = "RAW"
    exclude: frozenset[str] = field(default_factory=frozenset)
