"""Parts that follow one another in time: each node has a parent at most; an object is a tree, named by its root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .label import label, numbered
from .objects import OBJ, overlaps



def roots(nodes: DataFrame, keys: tuple[str, ...] = ("segment",), max_rounds: int = 40) -> DataFrame:
    """nodes (keys, node, parent or null) with the root that each reaches; pointers double each round."""
    now = staged(nodes.select(*keys, "node", F.coalesce("parent", "node").alias("up")), "forest")
    for _ in range(max_rounds):
        higher = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("far"))
        step = staged(now.join(higher, [*keys, "up"], "left").select(*keys, "node", F.coalesce("far", "up").alias("next"), (F.coalesce("far", "up") != F.col("up")).alias("moved")), "forest")
        now = step.select(*keys, "node", F.col("next").alias("up"))
        if step.where("moved").isEmpty():
            return now.withColumnRenamed("up", "root")
    raise RuntimeError(f"roots not reached in {max_rounds} rounds")


def parts(objects: DataFrame, ny: int, nx: int) -> DataFrame:
    """The objects' cells with `part`: their connected part (8 neighbours) in their step."""
    renamed = objects.withColumnRenamed("obj_id", "parent_obj")
    out = label(renamed, ny, nx, through_time=False, keys=("parent_obj",))
    return out.select("segment", F.col("parent_obj").alias("obj_id"), "t", "iy", "ix", F.col("obj_id").alias("part"))


def part_counts(with_parts: DataFrame) -> DataFrame:
    """segment, obj_id, mean_parts: parts in a step, over the steps of the bounding box."""
    per = with_parts.groupBy(*OBJ, "t").agg(F.count_distinct("part").alias("n"))
    return per.groupBy(*OBJ).agg((F.sum("n") / (F.max("t") - F.min("t") + 1)).alias("mean_parts"))


def part_parents(with_parts: DataFrame) -> DataFrame:
    """segment, obj_id, t, part, parent: a part that several meet goes on the largest of them; else one goes on the single part before it if it is the largest that does; others begin anew.

    Sizes are cells; the lowest part on ties.
    """
    size = with_parts.groupBy(*OBJ, "t", "part").agg(F.count("*").alias("cells"))
    before = with_parts.select("segment", "obj_id", (F.col("t") + 1).alias("t"), "iy", "ix", F.col("part").alias("q"))
    links = with_parts.join(before, ["segment", "obj_id", "t", "iy", "ix"]).select(*OBJ, "t", "part", "q").distinct()
    links = links.join(size, [*OBJ, "t", "part"]).join(size.select(*OBJ, (F.col("t") + 1).alias("t"), F.col("part").alias("q"), F.col("cells").alias("q_cells")), [*OBJ, "t", "q"])
    preds = links.withColumn("n_pred", F.count("*").over(Window.partitionBy(*OBJ, "t", "part")))
    first = F.row_number().over(Window.partitionBy(*OBJ, "t", "q").orderBy(F.desc("cells"), "part")) == 1
    preds = preds.withColumn("leads", first)
    best = F.row_number().over(Window.partitionBy(*OBJ, "t", "part").orderBy(F.desc("q_cells"), "q"))
    chosen = preds.withColumn("rank", best).where("rank = 1 and (n_pred > 1 or leads)").select(*OBJ, "t", "part", F.col("q").alias("parent"))
    return size.join(chosen, [*OBJ, "t", "part"], "left").select(*OBJ, "t", "part", "cells", "parent")


def break_up(objects: DataFrame, ny: int, nx: int, min_steps: int, limit: float = 1.5) -> DataFrame:
    """Objects with more than `limit` parts a step on average are taken apart along their parts' trees; then the lifetime filter, and new ids."""
    cells = staged(parts(objects, ny, nx), "parts")
    many = part_counts(cells).where(F.col("mean_parts") > limit).select(*OBJ)
    multi = staged(cells.join(many, list(OBJ), "left_semi"), "multi")
    tree = roots(part_parents(multi).select("segment", F.col("part").alias("node"), "parent"))
    apart = multi.join(tree.withColumnRenamed("node", "part"), ["segment", "part"]).select("segment", F.col("obj_id").alias("from_id"), F.col("root"), "t", "iy", "ix")
    whole = cells.join(many, list(OBJ), "left_anti").select("segment", F.col("obj_id").alias("from_id"), F.lit(None).cast("long").alias("root"), "t", "iy", "ix")
    both = staged(whole.union(apart), "taken-apart")
    # Ids are given once, to those that stay: the order is that of all ids.
    long = both.groupBy("segment", "from_id", "root").agg((F.max("t") - F.min("t") + 1).alias("n")).where(F.col("n") >= min_steps)
    ids = numbered(long.select("segment", "from_id", "root"), "from_id", "root").select("segment", "from_id", F.col("root").alias("__root"), F.col("obj_id_new").alias("obj_id"))
    return both.join(ids, ["segment", "from_id"]).where(F.col("root").eqNullSafe(F.col("__root"))).select("segment", "obj_id", "t", "iy", "ix")


def link_basins(basins: DataFrame, sizes: DataFrame, claim: str = "largest") -> DataFrame:
    """Parents of basins (segment, t, iy, ix, obj_id = basin): each basin before chooses the one that it shares most cells with; of several that choose the same, the one of the largest size before goes on ("largest"), or the smallest ("last"). sizes: segment, t, obj_id, size."""
    shared = overlaps(basins)
    top = Window.partitionBy("segment", "t", "before_id").orderBy(F.desc("n"), "obj_id")
    choice = shared.withColumn("r", F.row_number().over(top)).where("r = 1")
    own = sizes.select("segment", (F.col("t") + 1).alias("t"), F.col("obj_id").alias("before_id"), "size")
    order = [F.desc("size"), F.col("before_id")] if claim == "largest" else [F.col("size"), F.desc("before_id")]
    claims = Window.partitionBy("segment", "t", "obj_id").orderBy(*order)
    won = choice.join(own, ["segment", "t", "before_id"]).withColumn("r", F.row_number().over(claims)).where("r = 1")
    nodes = basins.select("segment", "t", "obj_id").distinct()
    return nodes.join(won.select("segment", "t", "obj_id", F.col("before_id").alias("parent")), ["segment", "t", "obj_id"], "left").select("segment", "t", F.col("obj_id").alias("node"), "parent")


def track(basins: DataFrame, parents: DataFrame) -> DataFrame:
    """The basins' cells named by the root of their tree."""
    tree = roots(parents)
    return basins.withColumnRenamed("obj_id", "node").join(tree, ["segment", "node"]).select("segment", F.col("root").alias("obj_id"), "t", "iy", "ix")


