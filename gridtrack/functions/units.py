"""Unit strings: one spelling each, and how to convert to canonical units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings after the plain rewriting below, and the one that stands for them.
ALIASES = {
    "meters": "m", "metres": "m", "meter": "m", "metre": "m", "gpm": "m", "m2s-2": "m2s-2", "m^2s^-2": "m2s-2", "m**2s**-2": "m2s-2",
    "pascal": "pa", "pascals": "pa", "hectopascal": "hpa", "hectopascals": "hpa", "millibar": "hpa", "millibars": "hpa", "mb": "hpa", "mbar": "hpa",
    "kelvin": "k", "degc": "c", "celsius": "c", "degreec": "c", "degreecelsius": "c", "degreescelsius": "c",
    "kgkg-1": "1", "kg/kg": "1", "gkg-1": "g/kg", "ms-1": "m/s", "m/s": "m/s", "kmh-1": "km/h", "kt": "knot", "knots": "knot", "kts": "knot",
    "kgm-2s-1": "mm/s", "kg/m2/s": "mm/s", "mms-1": "mm/s", "mm/day": "mm/d", "mmday-1": "mm/d", "mmd-1": "mm/d", "mmh-1": "mm/h", "mm/hr": "mm/h", "mm/hour": "mm/h", "kgm-2": "mm", "kg/m2": "mm", "kgm-1s-1": "kg/m/s",
}
#: variable class, unit, factor, offset, kind (of precipitation).
CONVERSIONS = (
    ("z", "m2s-2", 1.0, 0.0, None), ("z", "m", 9.81, 0.0, None), ("z", "dam", 98.1, 0.0, None), ("z", "km", 9810.0, 0.0, None),
    ("msl", "pa", 1.0, 0.0, None), ("msl", "hpa", 100.0, 0.0, None), ("msl", "kpa", 1000.0, 0.0, None),
    ("t", "k", 1.0, 0.0, None), ("t", "c", 1.0, 273.15, None),
    ("q", "1", 1.0, 0.0, None), ("q", "g/kg", 0.001, 0.0, None),
    ("wind", "m/s", 1.0, 0.0, None), ("wind", "km/h", 1 / 3.6, 0.0, None), ("wind", "knot", 0.514444, 0.0, None),
    ("tp", "mm", 1.0, 0.0, "amount"), ("tp", "m", 1000.0, 0.0, "amount"), ("tp", "cm", 10.0, 0.0, "amount"),
    ("tp", "mm/s", 1.0, 0.0, "rate"), ("tp", "mm/h", 1 / 3600, 0.0, "rate"), ("tp", "mm/d", 1 / 86400, 0.0, "rate"), ("tp", "m/s", 1000.0, 0.0, "rate"),
    ("ivt", "kg/m/s", 1.0, 0.0, None),
)


def normalised(unit: Column) -> Column:
    """Lower case without blanks, dots and marks of powers, then the one spelling."""
    u = F.regexp_replace(F.lower(F.trim(unit)), r"[\s·]|\*\*|\^", "")
    u = F.regexp_replace(u, r"\*", "")
    table = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(F.element_at(table, u), u)


def conversion_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONVERSIONS), "var_class string, unit string, factor double, offset double, kind string")


def lookup(rows: DataFrame, var_class: str = "var_class", unit: str = "unit") -> DataFrame:
    """rows with factor, offset and kind; all null for a unit that its class does not know."""
    table = conversion_table(rows.sparkSession).toDF("__class", "__unit", "factor", "offset", "kind")
    return rows.join(F.broadcast(table), (F.col(var_class) == F.col("__class")) & (normalised(F.col(unit)) == F.col("__unit")), "left").drop("__class", "__unit")


def convert(rows: DataFrame, value: str, out: str) -> DataFrame:
    return rows.withColumn(out, F.col(value) * F.col("factor") + F.col("offset"))
