"""Parameters of a run, with the checks made before anything is read."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass
class Config:
    """gt, ref, map_path and the exclusion lists are paths; the rest are model and window parameters."""

    gt: str
    out: str
    ref: str | None = None
    map_path: str | None = None
    chrom: str | None = None
    exclude_samples: str | None = None
    exclude_markers: str | None = None
    burnin: int = 6
    iterations: int = 12
    mcmc_burnin: int = 2
    dynamic_mcmc: bool = False
    mcmc_steps: int = 3
    phase_states: int = 400
    rare: float = 0.002
    imp_states: int = 1600
    cluster: float = 0.005
    step: float = 0.1
    ap: bool = False
    gp: bool = False
    ne: float = 1e5
    err: float | None = None
    em: bool = True
    window: float = 40.0
    overlap: float = 2.0
    window_markers: int = 4_000_000
    seed: int = -99999

    def validate(self) -> None:
        """Raises ValueError or FileNotFoundError; paths with a scheme are left to Spark."""
        for path in (self.gt, self.ref, self.map_path, self.exclude_samples, self.exclude_markers):
            if path and "://" not in path and not os.path.exists(path):
                raise FileNotFoundError(path)
        if self.out.endswith("/") or ("://" not in self.out and os.path.isdir(self.out)):
            raise ValueError("out names a folder; a prefix is needed")
        if self.window < 1.1 * self.overlap:
            raise ValueError("window must be at least 1.1 times overlap")
        for name in ("ne", "window", "cluster", "step"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.err is not None and not 0 <= self.err < 0.5:
            raise ValueError("err must lie in [0, 0.5)")
        if min(self.iterations, self.phase_states, self.imp_states, self.window_markers) < 1:
            raise ValueError("iterations, states and window_markers must be at least 1")
