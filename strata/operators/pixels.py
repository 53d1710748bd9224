"""Pixel arithmetic on columns: colour conversion, masks, opacity, compositing, runs and predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: D65 white, XYZ to linear sRGB.
WHITE = (0.95047, 1.0, 1.08883)
XYZ_TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
#: Rows of one pixel that are folded at once; the folds are folded again.
FOLD = 256


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """8-bit inverted ink as stored: each colour is (ink * black) >> 8."""
    return [F.shiftright((v * k).cast("int"), 8) for v in (c, m, y)]


def cmyk_float_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [F.floor((1 - v) * (1 - k) * 255 + 0.5).cast("int") for v in (c, m, y)]


def lab_to_rgb(l: Column, a: Column, b: Column) -> list[Column]:
    """8-bit Lab as stored (L in 0..255, a and b offset by 128) to 8-bit sRGB."""
    fy = (l / 255.0 * 100.0 + 16.0) / 116.0
    fx, fz = (a - 128.0) / 500.0 + fy, fy - (b - 128.0) / 200.0
    lin = [F.when(t * t * t > 0.008856, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787) * w for t, w in zip((fx, fy, fz), WHITE)]
    out = []
    for row in XYZ_TO_RGB:
        v = row[0] * lin[0] + row[1] * lin[1] + row[2] * lin[2]
        g = F.when(v > 0.0031308, 1.055 * F.pow(F.greatest(v, F.lit(0.0031308)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v)
        out.append(F.floor(F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int"))
    return out


def high_byte(v: Column) -> Column:
    """A 16-bit sample as 8 bits."""
    return F.shiftright(v.cast("int"), 8)


def float_sample(v: Column) -> Column:
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")


def gray(v: Column) -> list[Column]:
    """Grayscale, and duotone shown as its gray."""
    return [v, v, v]


def bitmap(byte: Column, x: Column) -> Column:
    """One bit of a packed row, highest first: a set bit is black."""
    bit = F.floor(byte / F.pow(F.lit(2.0), 7 - x % 8)).cast("int") % 2
    return F.when(bit == 1, 0).otherwise(255)


def mask_alpha(a: Column, m: Column, inside: Column, default_color: Column) -> Column:
    """Alpha under a mask: inside a * m div 255; outside 0 under a black default, else unchanged."""
    return F.when(inside, F.floor(a * m / 255)).when(default_color == 0, F.lit(0)).otherwise(a).cast("int")


def fold_opacity(a: Column, opacity: Column) -> Column:
    return F.floor(a * opacity / 255).cast("int")


def inside(x: Column, y: Column, top: Column, left: Column, bottom: Column, right: Column) -> Column:
    return (x >= left) & (x < right) & (y >= top) & (y < bottom)


def _over(acc: Column, s: Column) -> Column:
    """Source ``s`` over ``acc``, both premultiplied (r, g, b, a) in 0..1: associative, so folds can be folded."""
    keep = 1.0 - s["a"]
    return F.struct(*[(s[c] + acc[c] * keep).alias(c) for c in ("r", "g", "b", "a")])


def _fold(values: Column) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "g", "b", "a")])
    return F.aggregate(values, zero, lambda acc, s: _over(acc, s["p"]))


def source_over(layers: DataFrame, by: list[str], order: str = "idx") -> DataFrame:
    """Composite of straight-alpha 8-bit r, g, b, a rows from the lowest ``order`` up: (by, r, g, b, a) as 8 bits.

    Rows of a pixel are folded in runs of ``FOLD`` positions, then the folds, so no pixel needs one task for all rows.
    """
    alpha = F.col("a") / 255.0
    p = F.struct(*[(F.col(c) / 255.0 * alpha).alias(c) for c in ("r", "g", "b")], alpha.alias("a"))
    d = layers.select(*by, F.floor(F.col(order) / FOLD).alias("_b"), F.struct(F.col(order).alias("k"), p.alias("p")).alias("_s"))
    runs = d.groupBy(*by, "_b").agg(_fold(F.array_sort(F.collect_list("_s"))).alias("_p"))
    whole = runs.groupBy(*by).agg(_fold(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("k"), F.col("_p").alias("p"))))).alias("_p"))
    eight = lambda v: F.floor(v * 255.0 + 0.5 + 1e-9).cast("int")
    return whole.select(*by, *[F.when(F.col("_p.a") > 0, eight(F.least(F.col(f"_p.{c}") / F.col("_p.a"), F.lit(1.0)))).otherwise(0).alias(c) for c in ("r", "g", "b")], eight(F.col("_p.a")).alias("a"))


def byte_runs(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, start, length, value): maximal runs of equal bytes of each row of a plane, by gaps and islands.

    A row is as wide as its layer, which the format bounds; so a window over one row is bounded too.
    """
    island = F.col(pos) - F.row_number().over(Window.partitionBy(key, value).orderBy(pos))
    return rows.withColumn("_i", island).groupBy(key, value, "_i").agg(F.min(pos).alias("start"), F.count("*").alias("length")).select(key, "start", "length", F.col(value).alias("value"))


def packbits_size(runs: DataFrame, key: str) -> DataFrame:
    """Encoded bytes of each row: runs of two and more take 2 bytes per 128, single bytes are gathered in literals of
    at most 128 with a header each."""
    d = runs.withColumn("_lit", F.col("length") == 1)
    group = F.count_if(~F.col("_lit")).over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    parts = d.withColumn("_g", group).groupBy(key, "_g").agg(
        F.count_if("_lit").alias("n"), F.sum(F.when(~F.col("_lit"), F.floor(F.col("length") / 128) * 2 + F.when(F.col("length") % 128 > 0, 2).otherwise(0)).otherwise(0)).alias("rep")
    )
    return parts.groupBy(key).agg(F.sum(F.col("n") + F.ceil(F.col("n") / 128) + F.col("rep")).cast("bigint").alias("size"))


def undo_prediction(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """8-bit horizontal prediction undone: the running sum modulo 256 over a row."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("sample", F.pmod(F.sum(value).over(w), F.lit(256)).cast("int"))


def bleed_pass(px: DataFrame, by: list[str]) -> DataFrame:
    """One pass of alpha bleed: transparent pixels without colour take the mean of their coloured 4-neighbours."""
    solid = px.where("a > 0")
    near = solid.select(*by, F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("_near"), "r", "g", "b")
    mean = near.groupBy(*by, "_near.x", "_near.y").agg(*[F.floor(F.avg(c)).cast("int").alias(f"_m_{c}") for c in ("r", "g", "b")])
    d = px.join(mean, [*by, "x", "y"], "left")
    hit = (F.col("a") == 0) & F.col("_m_r").isNotNull()
    return d.select(*by, "x", "y", *[F.when(hit, F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) for c in ("r", "g", "b")], "a", hit.alias("filled"))
