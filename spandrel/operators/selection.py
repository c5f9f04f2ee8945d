"""Registry checks, routing, scoring and selection over registry DataFrames (a handful of rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(value: Column) -> Column:
    return value.over(Window.partitionBy())


def problems(registry: DataFrame) -> DataFrame:
    """Adds `problem`: why a row cannot be registered, null if it can. NaN numbers are problems too."""
    bad_speed = ~(F.col("throughput") > 0) | F.isnan("throughput")
    bad_ratio = ~((F.col("compression_ratio") > 0) & (F.col("compression_ratio") <= 1)) | F.isnan("compression_ratio")
    text = lambda kind, number: F.concat(F.lit("Plugin "), F.col("name"), F.lit(f" has invalid {kind}: "), F.col(number).cast("string"))
    problem = (
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", "Plugin name cannot be empty")
        .when(F.coalesce(F.col("version"), F.lit("")) == "", "Plugin version cannot be empty")
        .when(bad_speed | F.col("throughput").isNull(), text("throughput", "throughput"))
        .when(bad_ratio | F.col("compression_ratio").isNull(), text("compression ratio", "compression_ratio"))
    )
    return registry.withColumn("problem", problem)


def validated(registry: DataFrame) -> DataFrame:
    """The registry, or a failed job with the first problem."""
    wrong = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("boolean")).otherwise(F.lit(True))
    return problems(registry).filter(wrong).drop("problem")


def first_registered(registry: DataFrame) -> DataFrame:
    """One codec an identifier: the first registered."""
    order = F.row_number().over(Window.partitionBy("magic").orderBy("reg_order"))
    return registry.withColumn("_order", order).filter("_order = 1").drop("_order")


def counted(registry: DataFrame) -> DataFrame:
    """Codecs by identifier."""
    return registry.groupBy("magic").agg(F.count(F.lit(1)).alias("codecs"))


def named(registry: DataFrame, name: str, any_case: bool = False) -> DataFrame:
    """The first codec of a name."""
    same = F.lower("name") == name.lower() if any_case else F.col("name") == name
    return registry.filter(same).orderBy("reg_order").limit(1)


def scored(registry: DataFrame, weights: tuple[float, float]) -> DataFrame:
    """Adds `score`: weighted log throughput (more is better) and ratio (less is better), each scaled over the registry;
    a measure that does not vary counts 1, and so does a lone codec."""
    speed = F.log("throughput")
    low, high = _over(F.min(speed)), _over(F.max(speed))
    small, large = _over(F.min("compression_ratio")), _over(F.max("compression_ratio"))
    fast = F.when(high - low < 1e-9, 1.0).otherwise((speed - low) / (high - low))
    tight = F.when(large - small < 1e-9, 1.0).otherwise((large - F.col("compression_ratio")) / (large - small))
    score = F.when(_over(F.count(F.lit(1))) == 1, 1.0).otherwise(F.lit(weights[0]) * fast + F.lit(weights[1]) * tight)
    return registry.withColumn("score", score)


def selected(registry: DataFrame, weights: tuple[float, float]) -> DataFrame:
    """The best score; of equals the first by name."""
    return scored(registry, weights).orderBy(F.desc("score"), "name").limit(1)


def routed(frames: DataFrame, registry: DataFrame, key: str = "magic") -> DataFrame:
    """Frames with their codec's name, null if unknown."""
    return frames.join(F.broadcast(registry.select(F.col("magic").alias(key), F.col("name").alias("plugin_name"))), key, "left")


def unknown(frames: DataFrame, registry: DataFrame, key: str = "magic") -> DataFrame:
    """Frames that no codec claims."""
    return frames.join(F.broadcast(registry.select(F.col("magic").alias(key))), key, "left_anti")


def names(registry: DataFrame) -> DataFrame:
    """All codec names in one text, sorted."""
    return registry.agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("available"))
