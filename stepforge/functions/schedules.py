"""Learning-rate, noise and position schedules as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def linear_warmup(step: Column, warm: int, end: int, start: float, most: float, least: float) -> Column:
    """``start`` to ``most`` over ``warm`` steps, then straight down to ``least`` at ``end``, where it stays."""
    rise = F.lit(start) + F.lit(most - start) * step / F.lit(float(warm))
    fall = F.lit(least) + F.lit(most - least) * (F.lit(end) - step) / F.lit(float(end - warm))
    return F.when(step <= 0, F.lit(start)).when(step <= warm, rise).when(step < end, fall).otherwise(F.lit(least))


def cosine(step: Column, end: int, least: float) -> Column:
    """Half a cosine from 1 to 0, but not below ``least``."""
    return F.greatest(F.lit(least), (F.cos(F.lit(math.pi) * step / F.lit(float(end))) + 1) * F.lit(0.5))


def shifted_sigma(sigma: Column, shift: float) -> Column:
    return F.lit(shift) * sigma / (F.lit(1.0) + F.lit(shift - 1) * sigma)


def sigma_schedule(
    spark: SparkSession,
    steps: int,
    extra_step: bool = True,
    shift: float | None = 1.0,
    exponential_mu: float | None = None,
    terminal: float | None = None,
    reverse: bool = False,
    train_steps: int = 1000,
) -> DataFrame:
    """(step, sigma, timestep, weight) of a flow schedule from 1 down to 0, one row per step.

    ``extra_step`` leaves 0 out. Sigmas are shifted, or by ``exponential_mu`` mapped to e^mu / (e^mu + 1 / sigma - 1); with ``terminal``
    stretched so that the last one has this value; ``reverse`` gives 1 - sigma. Weights are bell-shaped in the time step,
    from 0, with the sum ``steps``. A schedule is small, so a window over it is one task.
    """
    whole = Window.partitionBy()
    s = F.lit(1.0) - F.col("id") / F.lit(float(steps if extra_step else steps - 1))
    if exponential_mu is not None:
        e = math.exp(exponential_mu)
        sigma = F.when(s == 0, F.lit(0.0)).otherwise(F.lit(e) / (F.lit(e) + (F.lit(1.0) / s - 1)))
    else:
        sigma = shifted_sigma(s, shift)
    df = spark.range(steps).select(F.col("id").alias("step"), sigma.alias("sigma"))
    if terminal is not None:
        last = F.max_by(1 - F.col("sigma"), "step").over(whole)
        df = df.withColumn("sigma", 1 - (1 - F.col("sigma")) / (last / F.lit(1 - terminal)))
    if reverse:
        df = df.withColumn("sigma", 1 - F.col("sigma"))
    df = df.withColumn("timestep", F.col("sigma") * train_steps)
    y = F.exp(F.pow((F.col("timestep") - F.lit(steps / 2)) / F.lit(float(steps)), F.lit(2.0)) * F.lit(-2.0))
    df = df.withColumn("_y", y).withColumn("_y", F.col("_y") - F.min("_y").over(whole))
    return df.select("step", "sigma", "timestep", (F.col("_y") * (F.lit(float(steps)) / F.sum("_y").over(whole))).alias("weight"))


def nearest_in(values: Sequence[float], x: Column) -> Column:
    """The place of the value next to ``x`` in a list of any spacing; of two the first. The list is a schedule, so it is short."""
    return F.array_position(
        F.transform(F.array(*[F.lit(float(v)) for v in values]), lambda v: F.abs(v - x)),
        F.array_min(F.transform(F.array(*[F.lit(float(v)) for v in values]), lambda v: F.abs(v - x))),
    ) - 1


def noise_mix(x: Column, noise: Column, sigma: Column) -> Column:
    return (F.lit(1.0) - sigma) * x + sigma * noise


def euler_step(x: Column, velocity: Column, sigma: Column, after: Column) -> Column:
    return x + velocity * (after - sigma)


def sincos(position: Column, width: int) -> Column:
    """Sines then cosines of a position at falling frequencies; ``width`` is even."""
    half = width // 2
    frequency = lambda i: position / F.pow(F.lit(10000.0), i / F.lit(float(half)))
    at = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(at, lambda i: F.sin(frequency(i))), F.transform(at, lambda i: F.cos(frequency(i))))


def uniform_grid(spark: SparkSession, buckets: int) -> DataFrame:
    """(bucket, value): quantiles from 1 / buckets to 1 - 1 / buckets in even steps."""
    low, high = 1 / buckets, 1 - 1 / buckets
    return spark.range(buckets).select(F.col("id").alias("bucket"), (F.lit(low) + F.col("id") * F.lit(high - low) / F.lit(buckets - 1)).alias("value"))


def logit_normal_grid(spark: SparkSession, buckets: int, scale: float = 1.0) -> DataFrame:
    """(bucket, value): the sigmoid of normal quantiles, times ``scale``, on the uniform grid."""

    def values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normal = NormalDist()
        for p in parts:
            z = p["value"].map(normal.inv_cdf) * scale
            yield pd.DataFrame({"bucket": p["bucket"], "value": 1 / (1 + (-z).map(math.exp))})

    return uniform_grid(spark, buckets).mapInPandas(values, "bucket bigint, value double")


def slice_grid(grid: DataFrame, least: float, most: float) -> DataFrame:
    """(place, value): the values from ``least`` to below ``most``, numbered from 0. A grid is small, so one window numbers it."""
    part = grid.where((F.col("value") >= least) & (F.col("value") < most))
    return part.select((F.row_number().over(Window.orderBy("bucket")) - 1).cast("bigint").alias("place"), "value")


def sample_grid(draws: DataFrame, grid: DataFrame, quantile: str) -> DataFrame:
    """``draws`` with ``value``: the element of a sliced grid at the draw's quantile (from 0 to below 1). The grid is broadcast;
    it has as many rows as it has buckets."""
    n = grid.count()
    place = F.least(F.floor(F.col(quantile) * n), F.lit(n - 1)).cast("bigint")
    return draws.withColumn("place", place).join(F.broadcast(grid), "place").drop("place")
