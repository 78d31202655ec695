"""Exact deduplication by content sort.

Splitters sampled from the normalised texts range-partition them, an external sort
inside each partition puts equal texts side by side, and neighbours are compared in
full; the text itself, not a digest, is the key. Splitters are the first bytes of texts, with
a hash that parts those that begin alike, so that the driver never holds whole texts;
inside a partition the same two come first in the order, and then the text. Texts that alone would fill more
than one partition are told apart first by counting 64-bit hashes; there are fewer of
them than partitions, and they are counted in full with map-side combination, so no
task ever holds one group.

Null counts as the empty text. Of equal texts the row with the largest (or smallest)
doc_id stays; repeated rows of that doc_id all count as that row. A null doc_id stays
only where all ids of its group are null. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, shuffle_partitions

#: Code points of a text that its splitter has.
HEAD = 16


def exact_dedup(docs: DataFrame, keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; keep: "smallest" or "largest"."""
    spark = docs.sparkSession
    parts = partitions or shuffle_partitions(spark)
    best = {"smallest": F.min, "largest": F.max}[keep]
    norm = docs.select("doc_id", lower_ascii(F.col("text")).alias("norm")).withColumn("head", F.substring("norm", 1, HEAD)).withColumn("hash", F.xxhash64("norm"))
    n = docs.count()
    # Fewer than `parts` hashes can have more than n / parts rows: the list is bounded.
    hot = [r.h for r in norm.groupBy(F.col("hash").alias("h")).count().where(F.col("count") * parts > n).where("count > 1").collect()]
    cold = norm.where(~F.col("hash").isin(hot)) if hot else norm
    same = Window.partitionBy("head", "hash", "norm")
    out = cold.repartitionByRange(parts, "head", "hash").select("doc_id", best("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"), F.sha2("norm", 256).alias("text_sha256"))
    if hot:
        rows = norm.where(F.col("hash").isin(hot))
        groups = rows.groupBy("norm").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        # Fewer than `parts` rows without their texts: what is broadcast has a bound.
        groups = groups.select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
        rows = rows.select("doc_id", F.sha2("norm", 256).alias("text_sha256")).join(F.broadcast(groups), "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
        out = out.unionByName(rows)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
