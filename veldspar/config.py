"""Engine settings and the constants of the feature vector."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from typing import ClassVar

# The normalisation limits and merchant category risks that decisions are defined by.
LIMITS = {
    "max_amount": 10000.0, "max_installments": 12.0, "amount_vs_avg_ratio": 10.0, "max_minutes": 1440.0,
    "max_km": 1000.0, "max_tx_count_24h": 20.0, "max_merchant_avg_amount": 10000.0,
}
MCC_RISK = {
    "5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80,
    "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50,
}
DEFAULT_RISK = 0.5
DIMS = 14


@dataclass(frozen=True)
class EngineConfig:
    """k neighbours vote; a score below threshold is approved."""

    k: int = 5
    threshold: float = 0.6
    nprobe: int = 8
    space: str = "i16"
    index_path: str = ""

    ENV: ClassVar[dict] = {"k": "VELDSPAR_K", "threshold": "VELDSPAR_THRESHOLD", "nprobe": "VELDSPAR_NPROBE", "space": "VELDSPAR_SPACE", "index_path": "VELDSPAR_INDEX"}

    def __post_init__(self):
        if self.k < 1 or self.nprobe < 1 or self.space not in ("i8", "i16", "f32", "f64"):
            raise ValueError(f"bad settings: {self}")

    @classmethod
    def from_mapping(cls, values: dict, names: dict | None = None) -> EngineConfig:
        names, out = names or {f.name: f.name for f in fields(cls)}, cls()
        for f in fields(cls):
            if (v := values.get(names.get(f.name, ""))) is not None:
                out = replace(out, **{f.name: type(getattr(out, f.name))(v)})
        return out

    @classmethod
    def from_env(cls, env=os.environ) -> EngineConfig:
        return cls.from_mapping(env, cls.ENV)

    @classmethod
    def from_spark(cls, spark, prefix: str = "veldspar.") -> EngineConfig:
        return cls.from_mapping({f.name: spark.conf.get(prefix + f.name, None) for f in fields(cls)})


def read_numbers(text: str) -> dict[str, float]:
    """A flat JSON object of numbers; of a repeated key the last counts; anything else raises."""
    got = json.loads(text)
    if not isinstance(got, dict) or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in got.values()):
        raise ValueError("expected an object of numbers")
    return {k: float(v) for k, v in got.items()}
