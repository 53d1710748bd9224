"""Folders from the order of layers: parents, depths, spans and children, by running aggregates.

Walking down from the top, a FOLDER opens a level and a HIDDEN divider closes it; a divider without a folder closes
nothing. Groups of any size are scanned in blocks, see :mod:`strata.operators.scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.operators.scan import BLOCK, running

def _step() -> Column:
    return F.when(F.col("layer_type") == "FOLDER", 1).when(F.col("layer_type") == "HIDDEN", -1).otherwise(0)


def levels(layers: DataFrame) -> DataFrame:
    """(path, idx, layer_type, step, sum, before, after): the running sum of steps from the top, and the levels around
    the row, which never fall below 0. The sum and its lowest value are carried over the blocks together."""
    d = layers.select("path", "idx", "layer_type", _step().alias("step"), F.floor(-F.col("idx") / BLOCK).alias("_b"))
    w = Window.partitionBy("path", "_b").orderBy(F.desc("idx"))
    to_here, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_s", F.sum("step").over(to_here)).withColumn("_low", F.min("_s").over(above))
    wb = Window.partitionBy("path").orderBy("_b")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    blocks = local.groupBy("path", "_b").agg(F.sum("step").alias("_t"), F.min("_s").alias("_m"))
    blocks = blocks.withColumn("_c", F.sum("_t").over(before)).withColumn("_n", F.row_number().over(wb))
    blocks = blocks.withColumn("_cl", F.min(F.coalesce("_c", F.lit(0)) + F.col("_m")).over(before))
    carry = blocks.where("_n > 1").select(F.col("path").alias("_kp"), F.col("_b").alias("_kb"), "_c", "_cl")
    j = local.join(carry, (F.col("path") == F.col("_kp")) & (F.col("_b") == F.col("_kb")), "left")
    c = F.coalesce("_c", F.lit(0))
    low = F.least(F.lit(0), F.col("_cl"), c + F.col("_low"))
    total = c + F.col("_s")
    return j.select("path", "idx", "layer_type", "step", total.alias("sum"), (total - F.col("step") - low).alias("before"), (total - F.least(low, total)).alias("after"))


def parents(layers: DataFrame) -> DataFrame:
    """(path, idx, layer_type, parent, depth): the open folder, -1 at the top level; a divider belongs to its folder."""
    ask = F.struct(F.col("before").alias("level"), F.lit(None).cast("int").alias("open"))
    opens = F.when(F.col("step") == 1, F.array(ask, F.struct(F.col("after").alias("level"), F.col("idx").alias("open")))).otherwise(F.array(ask))
    e = levels(layers).select("path", "idx", "layer_type", F.explode(opens).alias("e")).select("path", "idx", "layer_type", "e.level", "e.open")
    found = running(e, ["path", "level"], -F.col("idx"), parent=("last", F.col("open"))).where("open is null")
    return found.select("path", "idx", "layer_type", F.when(F.col("level") == 0, -1).otherwise(F.col("parent")).alias("parent"), F.col("level").cast("int").alias("depth"))


def spans(layers: DataFrame) -> DataFrame:
    """(path, idx, layer_type, start, count): a folder's rows reach down to its divider; all else is one row.

    A folder's divider is the first one below that brings the sum back to what it was above the folder.
    """
    level = F.when(F.col("step") == 1, F.col("sum") - 1).when(F.col("step") == -1, F.col("sum"))
    # rows that neither open nor close stand alone, each in a level that no folder has
    d = levels(layers).select("path", "idx", "layer_type", F.coalesce(level, F.lit(1 << 40)).alias("level"), F.when(F.col("step") == -1, F.col("idx")).alias("close"))
    below = running(d, ["path", "level"], F.col("idx"), div=("last", F.col("close")))
    start = F.when(F.col("layer_type") == "FOLDER", F.coalesce("div", "idx")).otherwise(F.col("idx"))
    return below.select("path", "idx", "layer_type", start.alias("start")).withColumn("count", F.col("idx") - F.col("start") + 1)


def children(tree: DataFrame) -> DataFrame:
    """(path, parent, n, first, last, children): direct children of each folder and of the top level (-1), no dividers.

    The list is per folder; folders of unbounded width are better read as the rows of :func:`parents`.
    """
    d = tree.where("layer_type <> 'HIDDEN'")
    return d.groupBy("path", "parent").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.array_sort(F.collect_list("idx")).alias("children"))
