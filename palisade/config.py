"""Settings that detections obey: cut-offs, enabled types, locale."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans.catalog import DEFAULT_THRESHOLD, THRESHOLDS

LOWEST, HIGHEST = 0.3, 0.95


@dataclass
class Config:
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    disabled: set[str] = field(default_factory=set)
    locale: str | None = None
    history: list[tuple[str, float, float, str]] = field(default_factory=list)

    def threshold(self, entity_type: str) -> float:
        return self.thresholds.get(entity_type, DEFAULT_THRESHOLD)

    def set_threshold(self, entity_type: str, value: float, reason: str = "") -> None:
        """Set a cut-off, held between 0.3 and 0.95, and remember why."""
        new = max(LOWEST, min(HIGHEST, value))
        self.history.append((entity_type, self.threshold(entity_type), new, reason))
        self.thresholds[entity_type] = new

    def reset(self) -> None:
        self.thresholds, self.disabled, self.history = dict(THRESHOLDS), set(), []

    def keep(self) -> Column:
        """The condition on (entity_type, score) for a detection to stay."""
        cut = F.coalesce(F.create_map(*[F.lit(x) for kv in self.thresholds.items() for x in kv])[F.col("entity_type")], F.lit(DEFAULT_THRESHOLD))
        return (F.col("score") >= cut) & ~F.col("entity_type").isin(*(self.disabled or {""}))

    def apply(self, detections: DataFrame) -> DataFrame:
        return detections.where(self.keep())

    def to_json(self) -> str:
        return json.dumps({"thresholds": self.thresholds, "disabled": sorted(self.disabled), "locale": self.locale})

    @classmethod
    def from_json(cls, text: str) -> Config:
        raw = json.loads(text)
        return cls(dict(THRESHOLDS) | raw.get("thresholds", {}), set(raw.get("disabled", ())), raw.get("locale"))
