"""Settings: what the command line gives comes before a configuration file, and that before the defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    template: str = "{pdb_id}/{pdb_id}_final.cif"
    distance_cutoff: float = 4.0
    edia_cutoff: float | None = None
    bfactor_cutoff: float | None = None
    bfactor_mode: str = "zscore"
    bfactor_population: str = "water"
    cluster_radius: float = 1.0
    consensus_cutoff: float = 0.3
    match_radius: float = 1.0
    min_cluster_size: int = 5
    min_samples: int | None = None

    @classmethod
    def load(cls, path: str | None = None, **given) -> Config:
        """From a JSON file and the values that aren't None; an unknown name raises ValueError."""
        values = json.loads(Path(path).read_text()) if path else {}
        values |= {k: v for k, v in given.items() if v is not None}
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(cls(), **values)

    def as_dict(self) -> dict:
        return asdict(self)
