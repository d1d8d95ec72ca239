"""Run configuration and manifest: small driver-side records with a canonical hash."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.hashing import content_hashes
from lodestrata.sources.panels import canonical_json


@dataclass(frozen=True)
class Experiment:
    """Parameters of a run; ``check`` fails on values without meaning."""

    # The defaults of a run.
    window: int = 504
    minimum_folds: int = 4
    per_year: int = 252
    max_weight: float = 0.10
    mean_half_life: float = 63.0
    vol_half_life: float = 21.0
    cor_half_life: float = 63.0
    shrink: float = 0.5
    bootstrap_draws: int = 500
    bootstrap_block: int = 21
    coverage: float = 0.95
    seed: int = 361
    ceilings: tuple[float, ...] = (0.06, 0.08, 0.10, 0.12, 0.14)
    costs_bps: tuple[float, ...] = (0.0, 1.0, 5.0, 10.0, 25.0)
    thresholds: tuple[float, ...] = (0.80, 0.90, 0.95, 0.975)
    notes: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.window < 2 or self.minimum_folds < 1 or self.per_year < 1:
            raise ValueError("window, folds and periods must be positive")
        if not 0 < self.max_weight <= 1 or not 0 < self.coverage < 1 or not 0 <= self.shrink <= 1:
            raise ValueError("weights, coverage and shrinkage are shares")
        if min(self.mean_half_life, self.vol_half_life, self.cor_half_life) <= 0:
            raise ValueError("half-lives must be positive")
        if not 1 <= self.bootstrap_block <= self.window or any(c < 0 for c in self.costs_bps) or not self.ceilings:
            raise ValueError("block, costs or ceilings are out of range")

    @classmethod
    def load(cls, text: str) -> Experiment:
        known = json.loads(text)
        unknown = set(known) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})

    def sha256(self) -> str:
        return hashlib.sha256(canonical_json(asdict(self)).encode()).hexdigest()


def manifest(spark: SparkSession, experiment: Experiment, inputs: list[str], counts: dict[str, int]) -> str:
    """JSON of the configuration's hash, the inputs' content hashes and row counts."""
    hashes = {r.path: r.sha256 for p in inputs for r in content_hashes(spark, p).collect()}  # a row a file of the inputs named
    return canonical_json({"config_sha256": experiment.sha256(), "inputs": hashes, "counts": counts, "spark": spark.version})


def validated(manifest_json: str, experiment: Experiment) -> dict:
    """Refuse artifacts of another configuration."""
    known = json.loads(manifest_json)
    if known.get("config_sha256") != experiment.sha256():
        raise ValueError("artifacts belong to another configuration")
    return known


def complete_strategies(weights: DataFrame, schedule: DataFrame, failures: DataFrame) -> DataFrame:
    """Strategies with weights on every decision date and no recorded failure."""
    need = schedule.agg(F.count("*").alias("need"))
    have = weights.groupBy("strategy").agg(F.count_distinct("as_of").alias("have"))
    return have.join(F.broadcast(need), F.col("have") == F.col("need")).join(failures, "strategy", "left_anti").select("strategy")  # need is one row
