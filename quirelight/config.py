"""Tunable values of the reconstruction, in one frozen place."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values, where results depend on them, are named after what they bound."""

    header_lines: int = 3
    header_min: int = 3
    similarity: float = 0.85
    peak_fraction: float = 0.25
    fallback_threshold: int = 40
    prose_min_lines: int = 5
    prose_band: float = 0.3
    prose_fraction: float = 0.5
    front_fraction: float = 0.1
    toc_min_lines: int = 4
    toc_fraction: float = 0.6
    mu: float = 2.0
    lam: float = 2.0
    rho: float = 0.5
    min_attested: int = 2


DEFAULT = Config()
