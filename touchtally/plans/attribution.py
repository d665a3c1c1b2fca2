"""The attribution comparison as one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from touchtally.config import AttributionConfig
from touchtally.operators import rules, value
from touchtally.operators.journeys import build_touches
from touchtally.sources.checkpoints import materialise


@dataclass(frozen=True)
class AttributionRun:
    """Reports over one pass of the touch log.

    ``facts`` is written once to the checkpoint folder; it has a few hundred
    rows per segment, and every report below reads only it and the spend log. With segment
    columns every report is per segment, and a segment without a result says why in ``reason``
    while the others are not affected.
    """

    facts: DataFrame
    cfg: AttributionConfig
    segment_cols: tuple[str, ...] = ()

    @classmethod
    def start(
        cls,
        touches: DataFrame,
        conversions: DataFrame,
        cfg: AttributionConfig,
        segment_cols: Sequence[str] = (),
    ) -> AttributionRun:
        kept = build_touches(touches, conversions, cfg, segment_cols)
        return cls(materialise(rules.attribution_facts(kept, cfg)), cfg, tuple(segment_cols))

    def shares(self, models: Sequence[str] = value.ALL_MODELS) -> DataFrame:
        return value.attribution_shares(self.facts, self.cfg, models, self.segment_cols)

    def attribution_matrix(self, models: Sequence[str] = value.ALL_MODELS) -> DataFrame:
        """Channels by models; every model's column adds up to 1 in a segment, or is NULL."""
        return rules.pivot_models(self.shares(models), "share", models, self.segment_cols)

    def credited_value(self, models: Sequence[str] = value.ALL_MODELS) -> DataFrame:
        return value.credited_value(self.facts, self.cfg, models, self.segment_cols)

    def roi(self, spend: DataFrame, models: Sequence[str] = value.ALL_MODELS) -> DataFrame:
        return value.roi_table(self.credited_value(models), spend, self.cfg.channels, segment_cols=self.segment_cols)

    def reallocation(self, spend: DataFrame, model: str = "shapley", max_shift: float = 0.30) -> DataFrame:
        return value.reallocation_plan(self.roi(spend, [model]), max_shift, self.segment_cols)

    def misallocation(self, spend: DataFrame, incumbent: str = "last_touch", challenger: str = "shapley") -> DataFrame:
        return value.misallocation(self.roi(spend, [incumbent, challenger]), incumbent, challenger, self.segment_cols)

    def recovery(self, truth: DataFrame, baseline: str = "last_touch") -> DataFrame:
        return value.recovery_scores(self.shares(), truth, baseline, self.segment_cols)
