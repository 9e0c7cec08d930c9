"""Constants of the movement model."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Defaults: metres, seconds, metres per second."""

    sigma: float = 4.07  # GPS noise in map matching
    radius_sigmas: float = 30.0  # search radius in sigmas
    beta: float = 1.0
    time_scale: float = 10.0
    max_candidates: int = 10
    max_speed: float = 40.0
    min_speed: float = 5.0
    max_piece: int = 1000
    path_bound: float = 2000.0
    gps_sigma: float = 5.0  # GPS noise in the travel-time model
    epsilon: float = 2.220446049250313e-16


    @classmethod
    def of(cls, values: dict[str, str]) -> Config:
        """Settings as text.read_config() gives them; unknown keys are an error."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if odd := set(values) - set(kinds):
            raise ValueError(f"no such settings: {sorted(odd)}")
        return cls(**{k: kinds[k](float(v)) if kinds[k] is int else kinds[k](v) for k, v in values.items()})


DEFAULT = Config()
EPOCH_SHIFT = 86_400
