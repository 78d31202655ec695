"""Operators on the time axis. Stamps are hour numbers (`hour_idx`) in the calendar of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_counts(times: DataFrame, hour: str = "hour_idx") -> DataFrame:
    """segment, step_h, n: the differences of neighbouring stamps, to six places."""
    w = Window.partitionBy("segment").orderBy(hour)
    stamps = times.select("segment", hour).distinct()
    steps = stamps.select("segment", F.round((F.col(hour) - F.lag(hour).over(w)).cast("double"), 6).alias("step_h")).where("step_h is not null")
    return steps.groupBy("segment", "step_h").agg(F.count("*").alias("n"))


def dominant_step(times: DataFrame, hour: str = "hour_idx") -> DataFrame:
    """segment, step_h, regular: the most frequent step, the smallest on ties, and whether it is the only one."""
    counts = step_counts(times, hour)
    return counts.groupBy("segment").agg(F.max_by("step_h", F.struct("n", -F.col("step_h"))).alias("step_h"), (F.count("*") == 1).alias("regular"))


def check_divisor(step_h: float, dt: float) -> int:
    """Steps in dt; an error unless the step is a divisor of dt."""
    ratio = dt / step_h if step_h and step_h > 0 else 0
    if ratio < 1 or abs(ratio - round(ratio)) > 1e-8:
        raise ValueError(f"the step of {step_h} h is no divisor of {dt} h")
    return round(ratio)


def on_step(hour: Column, dt: float) -> Column:
    off = F.pmod(hour.cast("double"), F.lit(float(dt)))
    return (off < 1e-8) | (off > dt - 1e-8)


def subsample(field: DataFrame, dt: float, step_h: float, hour: str = "hour_idx") -> DataFrame:
    check_divisor(step_h, dt)
    return field.where(on_step(F.col(hour), dt))


def accumulate(field: DataFrame, dt: float, step_h: float, kind: str = "amount", value: str = "v", hour: str = "hour_idx", cells: tuple[str, ...] = ("segment", "iy", "ix")) -> DataFrame:
    """Total and peak of each full window [start, start + dt), named by its start. kind "rate": per second, made an amount first."""
    ratio = check_divisor(step_h, dt)
    v = F.col(value) * (step_h * 3600) if kind == "rate" else F.col(value)
    rows = field.withColumn("__v", v).withColumn("start", (F.floor(F.col(hour) / dt) * dt).cast("long"))
    out = rows.groupBy(*cells, "start").agg(F.sum("__v").alias("total"), F.max("__v").alias("peak"), F.count("*").alias("n"))
    return out.where(F.col("n") == ratio).drop("n")


def align(times: DataFrame, field: DataFrame, value: str = "v", fill: float = 0.0, on: tuple[str, ...] = ("segment", "hour_idx", "iy", "ix")) -> DataFrame:
    """field on the target rows; absent values become fill."""
    return times.select(*on).join(field.select(*on, value), list(on), "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def interpolate(field: DataFrame, dt: int, value: str = "v", hour: str = "hour_idx", cells: tuple[str, ...] = ("segment", "iy", "ix")) -> DataFrame:
    """Values at every dt between the known stamps of each cell, linear between neighbours."""
    w = Window.partitionBy(*cells).orderBy(hour)
    nxt = field.select(*cells, hour, value, F.lead(hour).over(w).alias("__h"), F.lead(value).over(w).alias("__v"))
    first = (F.ceil(F.col(hour) / dt) * dt).cast("long")
    last = F.when(F.col("__h").isNull(), F.col(hour)).otherwise(F.col("__h") - 1).cast("long")
    steps = nxt.where(first <= last).withColumn("__at", F.explode(F.sequence(first, last, F.lit(dt).cast("long"))))
    share = (F.col("__at") - F.col(hour)) / (F.col("__h") - F.col(hour))
    v = F.when(F.col("__at") == F.col(hour), F.col(value)).otherwise(F.col(value) + (F.col("__v") - F.col(value)) * share)
    return steps.select(*cells, F.col("__at").alias(hour), v.alias(value))


def file_gaps(index: DataFrame) -> DataFrame:
    """stream, path, note: "gap" or "overlap" against the stream's file before, by t0; no row where they meet. index: stream, path, t0, t1, step_h."""
    w = Window.partitionBy("stream").orderBy("t0", "path")
    due = F.lag(F.col("t1") + F.col("step_h")).over(w)
    return index.select("stream", "path", F.when(F.col("t0") > due, "gap").when(F.col("t0") < due, "overlap").alias("note")).where("note is not null")


def axis_differences(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("segment", "hour_idx")) -> DataFrame:
    """Stamps of only one of two streams; none: the same axis."""
    x, y = a.select(*on).distinct().withColumn("__a", F.lit(True)), b.select(*on).distinct().withColumn("__b", F.lit(True))
    both = x.join(y, list(on), "full_outer").where("__a is null or __b is null")
    return both.select(*on, F.when(F.col("__a").isNull(), "second").otherwise("first").alias("only_in"))


def describe(times: DataFrame, hour: str = "hour_idx", calendar: str = "standard") -> DataFrame:
    """segment, n, first, last, step_h, regular, calendar."""
    ends = times.groupBy("segment").agg(F.count_distinct(hour).alias("n"), F.min(hour).alias("first"), F.max(hour).alias("last"))
    return ends.join(dominant_step(times, hour), "segment", "left").withColumn("calendar", F.lit(calendar))


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def consecutive(rows: DataFrame, keys: tuple[str, ...], t: str = "t", out: str = "run") -> DataFrame:
    """rows with the number of their run of consecutive steps, per key; rows: one for each key and step."""
    return rows.withColumn(out, F.col(t) - F.row_number().over(Window.partitionBy(*keys).orderBy(t)))
