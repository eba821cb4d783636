"""Presets as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fidelity level -> simplification of walls and of openings, grid of walls, doors and windows (mm), angle
# tolerance (degrees), snapping to the grid on, right angles on, what becomes of gaps, largest gap closed (mm, null: not set by the level).
PRESETS = (
    ("LOSSLESS", 0.1, 0.1, 0.0, 0.0, 0.0, 0.0, False, False, "propose_only", None),
    ("HIGH", 2.0, 1.0, 2.0, 2.0, 2.0, 5.0, True, True, "propose_only", None),
    ("MEDIUM", 5.0, 2.0, 5.0, 5.0, 5.0, 10.0, True, True, "repair_and_mark", 50.0),
    ("LOW", 10.0, 5.0, 10.0, 10.0, 10.0, 15.0, True, True, "repair_and_mark", 20.0),
)
COLUMNS = "level string, simplify_walls double, simplify_openings double, grid_walls double, grid_doors double, grid_windows double, angle_tolerance double, snap_to_grid boolean, right_angle boolean, gap_mode string, max_gap_close double"


def with_fidelity(plans: DataFrame, level: str = "level") -> DataFrame:
    """+ the overrides of each row's level; an unknown or null level leaves them null, so that defaults stay."""
    presets = preset_table(plans.sparkSession).withColumnRenamed("level", level)
    return plans.join(F.broadcast(presets), level, "left")


def preset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), COLUMNS)
