"""Parameter grids, their cost and their grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.operators.ranks import ranked

#: Cost of the task (steps, delays, states) that others are scaled to, in seconds. Fixed values.
UNIT_COST, UNIT = 3000.0, (40_000, 6, 48)


def with_options(rows: DataFrame, values: dict[str, list[int]]) -> DataFrame:
    """rows under every combination of the parameters' values."""
    for name, options in values.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    return rows


def grid(spark: SparkSession, values: dict[str, list[int]]) -> DataFrame:
    """All combinations of the parameters' values."""
    return with_options(spark.range(1).drop("id"), values)


def cost(steps: Column, delays: Column, states: Column) -> Column:
    """Seconds, in proportion to steps, delays and the square of the states."""
    unit = UNIT[0] * UNIT[1] * UNIT[2] ** 2
    return F.lit(UNIT_COST) * (steps * delays * states * states) / unit


def grouped(tasks: DataFrame, groups: int, order: list[str]) -> DataFrame:
    """tasks with grp: dealt out in turn, dearest first."""
    rows = ranked(tasks, [F.desc("cost"), *map(F.col, order)], "grp")
    return rows.withColumn("grp", (F.col("grp") - 1) % groups)


#: Parameters of a training task and their usual values: states, delays, delay in ms, scaling, weight of the variance, whether states are held fixed in the gradient.
USUAL = {"states": [48], "delays": [6], "delay_ms": [25.0], "scaling": ["block_rms"], "variance_weight": [0.005], "fixed_states": [False]}
#: Families of tasks: which sources (recorded or synthetic, all or reference ones only), and what differs from the usual values. Fixed values.
FAMILIES = (
    ("recorded", False, {}),
    ("recorded", False, {"scaling": ["channel_zscore"]}),
    ("synthetic", False, {"delays": [1], "delay_ms": [0.0]}),
    ("synthetic", True, {"delays": [1], "delay_ms": [0.0], "states": [8, 12, 16, 24, 32, 48]}),
    ("recorded", True, {"scaling": ["block_rms", "channel_zscore"]}),
    ("recorded", True, {"delay_ms": [10.0, 25.0, 50.0]}),
    ("recorded", True, {"variance_weight": [0.005, 0.01]}),
    ("recorded", True, {"states": [20, 24, 28, 32, 36, 40, 48, 56, 64], "delays": [1], "delay_ms": [0.0]}),
    ("recorded", True, {"states": [24, 28, 32, 36, 40, 44, 48, 52, 56, 64, 80]}),
    ("recorded", True, {"fixed_states": [False, True]}),
)
#: The scan of states: sources of a control group at many values, all others at two. Fixed values.
SCAN = (("control", False, {"states": [12, 16, 24, 32, 48, 64, 100]}), ("other", False, {"states": [24, 48]}))
#: Gradient steps of a usual task; epochs over a synthetic source, and its batch.
STEPS, EPOCHS, BATCH = 40_000, 300, 2048


def planned(sources: DataFrame, families: tuple = FAMILIES) -> DataFrame:
    """Tasks of all families, each once: source, the parameters, gradient steps and cost. sources: (source, kind, reference, samples)."""
    out = None
    for kind, reference, own in families:
        rows = sources.where((F.col("kind") == kind) & (F.col("reference") | F.lit(not reference)))
        for name, values in (USUAL | own).items():
            rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
        out = rows if out is None else out.unionByName(rows)
    usual = F.lit(STEPS) * (F.col("states") / USUAL["states"][0]) * F.sqrt(F.col("delays") / F.lit(float(USUAL["delays"][0])))
    synthetic = EPOCHS * F.greatest(F.lit(1), F.ceil(F.col("samples") / BATCH))
    tasks = out.drop("reference").distinct().withColumn("steps", F.when(F.col("kind") == "synthetic", synthetic).otherwise(F.floor(usual)).cast("long"))
    return tasks.withColumn("cost", F.floor(cost(F.col("steps"), F.col("delays"), F.col("states"))))
