"""Running aggregates over groups of any size.

A window over a whole group runs in one task. Here each group is cut into blocks of consecutive order numbers: a window
runs within the blocks, the totals of the blocks (few rows) are scanned once, and what comes before a block is joined to
its rows. Groups within one block have nothing to join, so that adaptive execution drops the join where no group is
larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Order numbers per block.
BLOCK = 1 << 16

_MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}


def _total(kind: str, value: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value)


def _over(kind: str, value: Column, w) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(w)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value).over(w)


def running(df: DataFrame, by: list[str], order: Column, inclusive: bool = True, block: int = BLOCK, **outs: tuple[str, Column]) -> DataFrame:
    """Add running aggregates: ``name=(kind, value)`` with kind sum, min, max or last (non-null).

    ``order`` is an integer that is unique within ``by``. An empty frame gives null, 0 for sums.
    """
    d = df.withColumn("_o", order.cast("bigint")).withColumn("_b", F.floor(F.col("_o") / block))
    w = Window.partitionBy(*by, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = d.groupBy(*by, "_b").agg(*[_total(k, v, F.col("_o")).alias(f"_t_{n}") for n, (k, v) in outs.items()])
    wb = Window.partitionBy(*by).orderBy("_b")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_kb"), F.row_number().over(wb).alias("_n"), *[_over(k, F.col(f"_t_{n}"), before).alias(f"_c_{n}") for n, (k, _) in outs.items()]
    ).where("_n > 1")
    local = d.select("*", *[_over(k, v, w).alias(f"_l_{n}") for n, (k, v) in outs.items()])
    joined = local.join(carry, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col("_b") == F.col("_kb")], "left")
    made = [_MERGE[k](F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in outs.items()]
    return joined.select(*[c for c in df.columns if c not in outs], *made)


def rerank(df: DataFrame, by: list[str], order: Column, name: str = "idx") -> DataFrame:
    """``name`` becomes the position, from 0, in the order of the integer ``order``."""
    return running(df.withColumn("_r", order), by, F.col("_r"), _pos=("sum", F.lit(1))).withColumn(name, (F.col("_pos") - 1).cast("int")).drop("_r", "_pos")
