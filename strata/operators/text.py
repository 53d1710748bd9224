"""Text layers: lengths in UTF-16 units, paragraphs, runs, fonts, sizes, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.scan import running

PARAGRAPH_END = "\r"


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def ended(text: Column) -> Column:
    """The text with its final paragraph mark."""
    return F.when(text.endswith(PARAGRAPH_END), text).otherwise(F.concat(text, F.lit(PARAGRAPH_END)))


def without_nul(text: Column) -> Column:
    return F.regexp_replace(text, "\\x00$", "")


def paragraphs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, para, body, length): one row per paragraph, the mark counted in the length."""
    body = ended(F.col("text"))
    each = texts.where("text is not null").select(*keys, F.posexplode(F.split(F.substring(body, F.lit(1), F.length(body) - 1), PARAGRAPH_END)).alias("para", "body"))
    return each.withColumn("length", utf16_length(F.col("body")) + 1)


def fit_lengths(runs: DataFrame, texts: DataFrame, keys: list[str], pos: str = "run") -> DataFrame:
    """Run lengths that cover their text exactly: what is beyond the end is cut, the last run takes what is left.

    Runs that begin beyond the end come out with length 0.
    """
    whole = texts.where("text is not null").select(*keys, utf16_length(ended(F.col("text"))).alias("total"))
    d = running(runs.join(whole, keys), keys, F.col(pos), end=("sum", F.col("length")))
    last = runs.groupBy(*keys).agg(F.max(pos).alias("_last"))
    d = d.join(last, keys).withColumn("start", F.least(F.col("end") - F.col("length"), F.col("total")))
    end = F.when(F.col(pos) == F.col("_last"), F.col("total")).otherwise(F.least("end", "total"))
    return d.select(*keys, pos, (end - F.col("start")).cast("int").alias("length"), F.col("start").cast("int").alias("start"), F.col("total").cast("int").alias("total"))


def resolve_fonts(runs: DataFrame, fonts: DataFrame, default: str) -> DataFrame:
    """Runs with the name of their font number; a number out of range keeps the default."""
    return runs.join(fonts, "font_no", "left").withColumn("font_name", F.coalesce("font_name", F.lit(default)))


def append_fonts(fonts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, font_no, font): the font list of each document with the wanted ones that it lacks, in order of name."""
    new = wanted.where("font is not null").select("path", "font").distinct().join(fonts.select("path", "font"), ["path", "font"], "left_anti")
    top = fonts.groupBy("path").agg(F.max("font_no").alias("top"))
    from pyspark.sql.window import Window

    # the fonts of one document, a bounded list
    rank = F.row_number().over(Window.partitionBy("path").orderBy("font"))
    more = new.withColumn("n", rank).join(top, "path", "left").select("path", (F.coalesce("top", F.lit(-1)) + F.col("n")).cast("int").alias("font_no"), "font")
    return fonts.select("path", "font_no", "font").unionByName(more)


def size_in_pixels(size: Column, dpi: Column, inherited: Column) -> Column:
    return F.when(inherited, size * dpi / 72.0).otherwise(size)


def clamp_bounds(l: Column, t: Column, r: Column, b: Column, outer: tuple[Column, Column, Column, Column]) -> list[Column]:
    """A box within an outer box; a box outside comes out empty at the nearest edge."""
    ol, ot, orr, ob = outer
    cl, ct = F.least(F.greatest(l, ol), orr), F.least(F.greatest(t, ot), ob)
    return [cl, ct, F.greatest(F.least(r, orr), cl), F.greatest(F.least(b, ob), ct)]


def replace_text(runs: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Runs after the text was replaced: the first run's style over the whole new text."""
    style = [c for c in runs.columns if c not in (*keys, "run", "length")]
    one = runs.groupBy(*keys).agg(F.min(F.struct("run", *style)).alias("_m")).select(*keys, F.lit(0).alias("run"), *[F.col(f"_m.{c}").alias(c) for c in style])
    return one.join(texts.select(*keys, utf16_length(ended(F.coalesce("text", F.lit("")))).alias("length")), keys)
