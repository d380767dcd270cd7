"""What a run did: rows and seconds of every step that was computed, observed while it was."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "step string, began timestamp, seconds double, rows_in long, rows_out long, columns int"


@dataclass
class RunLog:
    """Steps in the order in which they ended."""

    steps: list[tuple] = field(default_factory=list)

    def checkpoint(self, df: DataFrame, step: str, *inputs: str) -> DataFrame:
        """df, checkpointed; its rows are counted on the way. inputs: steps whose rows it reads."""
        seen = Observation(f"{step}-{len(self.steps)}")
        began, at = datetime.now(timezone.utc), time.monotonic()
        out = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint()
        rows = {s[0]: s[4] for s in self.steps}
        given = [rows[x] for x in inputs if x in rows]
        self.steps.append((step, began, time.monotonic() - at, sum(given) if given else None, seen.get["rows"], len(df.columns)))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row per step (LOG)."""
        return spark.createDataFrame(self.steps, LOG)
