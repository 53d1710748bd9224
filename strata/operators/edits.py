"""Edits of documents: each gives a new DataFrame of layers; order is kept by re-ranking, trees are derived afterwards.

Positions of an edit come as columns or as a table with one row per document, so that one call edits many documents.
Order keys are integers: a row keeps ``STRIDE * idx``, what is inserted goes between.

An edit of layers alone moves rows of one table. :func:`in_documents` carries any of them over to all tables that belong
to layers (channels, info blocks, text, states), so that the documents can be written: a moved layer takes its pixels
along, a copy brings its own, a new layer is written from its fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.operators.layers import next_id
from strata.operators.scan import rerank, running

STRIDE = 4


def _ranked(df: DataFrame, key: Column) -> DataFrame:
    return rerank(df, ["path"], key)


def delete(layers: DataFrame, which: Column) -> DataFrame:
    """Layers without those ``which`` holds for, counted anew."""
    return _ranked(layers.where(~F.coalesce(which, F.lit(False))), F.col("idx"))


def move(layers: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (path, from, to): one layer of each document to position ``to``, counted after its removal."""
    return move_range(layers, at.select("path", "from", F.lit(1).alias("count"), F.when(F.col("to") > F.col("from"), F.col("to") + 1).otherwise(F.col("to")).alias("to")))


def move_range(layers: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (path, from, count, to): a block in front of position ``to``, counted before the move; a block that would
    move into itself stays, and so does one that is not wholly there."""
    size = layers.groupBy("path").agg((F.max("idx") + 1).alias("_n"))
    d = layers.join(at.join(size, "path"), "path", "left")
    a, n, to = F.col("from"), F.col("count"), F.col("to")
    ok = a.isNotNull() & (a >= 0) & (n > 0) & (a + n <= F.col("_n")) & (to >= 0) & (to <= F.col("_n")) & ((to < a) | (to > a + n))
    i = F.col("idx")
    inside = (i >= a) & (i < a + n)
    new = (
        F.when(~F.coalesce(ok, F.lit(False)), i)
        .when(inside & (to < a), i - a + to)
        .when(inside, i - a + to - n)
        .when((to < a) & (i >= to) & (i < a), i + n)
        .when((to > a) & (i >= a + n) & (i < to), i - n)
        .otherwise(i)
    )
    return d.withColumn("idx", new.cast("int")).select(*layers.columns)


def swap_sibling(layers: DataFrame, tree: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (path, idx): change places with the sibling above, whole blocks at a time; no sibling above, no change.

    ``tree`` has (path, idx, parent, start, count).
    """
    t = tree.where("layer_type <> 'HIDDEN'").select("path", "idx", "parent", "start", "count")
    nxt = running(t, ["path", "parent"], -F.col("idx"), inclusive=False, up=("last", F.col("idx")))
    me = nxt.join(at.select("path", "idx"), ["path", "idx"], "left_semi").where("up is not null")
    other = t.select("path", F.col("idx").alias("up"))
    plan = me.join(other, ["path", "up"]).select("path", F.col("start").alias("from"), "count", (F.col("up") + 1).alias("to"))
    return move_range(layers, plan)


def duplicate(layers: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (path, idx): a copy right above each named layer, one per document, with a fresh id."""
    copies = layers.join(at.select("path", "idx"), ["path", "idx"], "left_semi").drop("layer_id").join(next_id(layers).withColumnRenamed("next_id", "layer_id"), "path")
    both = layers.withColumn("_k", F.lit(0)).unionByName(copies.withColumn("_k", F.lit(1)))
    return _ranked(both, F.col("idx") * STRIDE + F.col("_k")).drop("_k").select(*layers.columns)


def copy_across(layers: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (src, idx, path, dest): a layer of document ``src`` into ``path`` at ``dest``; outside means on top."""
    src = layers.withColumnRenamed("path", "src").join(at, ["src", "idx"]).drop("layer_id").join(next_id(layers).withColumnRenamed("next_id", "layer_id"), "path")
    top = layers.groupBy("path").agg((F.max("idx") + 1).alias("_n"))
    dest = F.when((F.col("dest") < 0) | (F.col("dest") > F.col("_n")), F.col("_n")).otherwise(F.col("dest"))
    new = src.join(top, "path").withColumn("_k", dest * STRIDE - 1)
    both = layers.withColumn("_k", F.col("idx") * STRIDE).unionByName(new.select(*layers.columns, "_k"))
    return _ranked(both, F.col("_k")).drop("_k").select(*layers.columns)


def add_layers(layers: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` has the columns of a layer, its idx being the position to stand at, one per document and position."""
    both = layers.withColumn("_k", F.col("idx") * STRIDE).unionByName(new.withColumn("_k", F.col("idx") * STRIDE - 1), allowMissingColumns=True)
    return _ranked(both, F.col("_k")).drop("_k").select(*layers.columns)


def add_folder(layers: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (path, first, count, name): a folder around ``count`` rows from ``first``; 0 rows give an empty folder."""
    ids = at.join(next_id(layers), "path")
    rows = [
        ids.select("path", F.lit("HIDDEN").alias("layer_type"), F.lit("</Layer group>").alias("name_unicode"), F.col("next_id").alias("layer_id"), (F.col("first") * STRIDE - 2).alias("_k")),
        ids.select("path", F.lit("FOLDER").alias("layer_type"), F.col("name").alias("name_unicode"), (F.col("next_id") + 1).alias("layer_id"), ((F.col("first") + F.col("count")) * STRIDE - 1).alias("_k")),
    ]
    both = layers.withColumn("_k", F.col("idx") * STRIDE)
    for r in rows:
        both = both.unionByName(r.withColumn("layer_name", F.col("name_unicode")), allowMissingColumns=True)
    return _ranked(both, F.col("_k")).drop("_k").select(*layers.columns)


#: Tables whose rows belong to a layer.
BY_LAYER = ("channels", "info_blocks", "descriptors", "descriptor_leaves", "text_layers", "text_runs", "text_paragraphs", "text_fonts", "layer_comp_states")


def in_documents(tables: dict[str, DataFrame], edit: Callable[..., DataFrame], *args, **kwargs) -> dict[str, DataFrame]:
    """The tables of documents after ``edit(layers, *args)``, which may be any edit of layers in this module."""
    before = tables["layers"]
    marked = before.withColumn("_src", F.col("path")).withColumn("_old", F.col("idx")).withColumn("_id", F.col("layer_id"))
    after = edit(marked, *args, **kwargs)
    at = after.where("_old is not null").select(F.col("_src").alias("_from"), F.col("_old").alias("_was"), F.col("path").alias("_to"), F.col("idx").alias("_now"))
    out = dict(tables)
    for t in BY_LAYER:
        if t in tables:
            df = tables[t]
            moved = df.join(at, (F.col("path") == F.col("_from")) & (F.col("idx") == F.col("_was")))
            out[t] = moved.select(*[{"path": F.col("_to"), "idx": F.col("_now")}.get(c, F.col(c)).alias(c) for c in df.columns])
    fresh = F.col("_old").isNull()
    if "dirty" in before.columns:
        after = after.withColumn("dirty", F.coalesce("dirty", F.lit(False)) | fresh | ~F.col("layer_id").eqNullSafe(F.col("_id")))
        for c, v in {"sig": "8BIM", "blend_key": "norm", "opacity": 255, "clipping": 0, "flag": 0, "filler": 0, "fill_opacity": 255, "sheet_color": 0, **{f"rect_{k}": 0 for k in ("top", "left", "bottom", "right")}}.items():
            default = F.when(F.col("layer_type") == "FOLDER", "pass").otherwise("norm") if c == "blend_key" else F.lit(v)
            after = after.withColumn(c, F.when(fresh, F.coalesce(F.col(c), default)).otherwise(F.col(c)).cast(before.schema[c].dataType))
        after = after.withColumn("name_raw", F.when(fresh, _pascal(F.col("name_unicode"))).otherwise(F.col("name_raw")))
    if "channels" in tables:
        # a row without pixels still has its four channels, each of no rows
        none = after.where(fresh & F.col("layer_type").isin("FOLDER", "HIDDEN")).select("path", "idx", F.posexplode(F.array(*[F.lit(k) for k in (-1, 0, 1, 2)])).alias("ch_pos", "ch_id"))
        none = none.select("path", "idx", "ch_pos", "ch_id", F.lit(2).alias("length"), F.lit(1).alias("compression"), F.lit(b"").alias("data"))
        out["channels"] = out["channels"].unionByName(none.select(*out["channels"].columns))
    out["layers"] = after.select(*before.columns)
    if "documents" in tables:
        n = after.groupBy("path").agg(F.count("*").cast("int").alias("_n"))
        d = tables["documents"].join(n, "path", "left")
        out["documents"] = d.withColumn("n_layers", F.coalesce("_n", F.lit(0))).withColumn("no_layers", F.col("no_layers") & F.col("_n").isNull()).select(*tables["documents"].columns)
    return out


def _pascal(name: Column) -> Column:
    return F.substring(F.encode(name, "UTF-8"), 1, 255)


def add_images(tables: dict[str, DataFrame], new: DataFrame) -> dict[str, DataFrame]:
    """``new`` (path, idx, name, top, left, width, height, bgra): new image layers in front of positions, one per document
    and position, each with a fresh id."""
    from strata.sources import psd

    # the new layers of one document, a list that the caller gives
    number = F.row_number().over(Window.partitionBy("path").orderBy("idx"))
    named = new.join(next_id(tables["layers"]), "path", "left").withColumn("layer_id", (F.coalesce("next_id", F.lit(1)) + number - 1).cast("int"))
    rows = named.select(
        "path", "idx", F.col("name").alias("name_unicode"), "layer_id", F.lit("NORMAL").alias("layer_type"), F.lit(8).alias("flag"),
        F.col("top").alias("rect_top"), F.col("left").alias("rect_left"), (F.col("top") + F.col("height")).alias("rect_bottom"), (F.col("left") + F.col("width")).alias("rect_right"),
    )
    out = in_documents(tables, add_layers, rows)
    made = named.select("path", "layer_id", "width", "height", "bgra").join(out["layers"].select("path", "layer_id", "idx"), ["path", "layer_id"])
    chans = psd.channel_rows(made, tables["channels"].schema)
    return out | {"channels": out["channels"].unionByName(chans.select(*out["channels"].columns))}


def set_columns(layers: DataFrame, where: Column, **values: Column) -> DataFrame:
    """New values of columns for the rows that ``where`` holds for; opacities are clamped to 0..255. Such layers are written
    anew, and the short name follows the name."""
    hit = F.coalesce(where, F.lit(False))
    made = {c: F.least(F.greatest(v, F.lit(0)), F.lit(255)) if c in ("opacity", "fill_opacity") else v for c, v in values.items()}
    if "dirty" in layers.columns:
        made["dirty"] = F.lit(True)
        if "name_unicode" in made and "name_raw" not in made:
            made["name_raw"] = _pascal(made["name_unicode"])
    return layers.withColumn("_hit", hit).select(*[F.when(F.col("_hit"), made[c]).otherwise(F.col(c)).cast(t).alias(c) if c in made else F.col(c) for c, t in layers.dtypes])


def set_mask(layers: DataFrame, disabled: Column | None = None, default_color: Column | None = None, density: Column | None = None, feather: Column | None = None, where: Column | None = None, strict: bool = False) -> DataFrame:
    """New mask values where there is a mask (and ``where`` holds); null values leave what is there. Layers without a mask
    stay without; with ``strict`` such a layer fails the job if ``where`` names it. Colours and densities are clamped to
    0..255."""
    byte = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int")
    m, hit = F.col("mask"), F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    if disabled is not None:
        m = m.withField("flags", F.when(disabled, F.col("mask.flags").bitwiseOR(F.lit(2))).when(~disabled, F.col("mask.flags").bitwiseAND(F.lit(~2))).otherwise(F.col("mask.flags")))
    for field, v in (("default_color", byte(default_color) if default_color is not None else None), ("user_density", byte(density) if density is not None else None), ("user_feather", feather.cast("double") if feather is not None else None)):
        if v is not None:
            m = m.withField(field, F.coalesce(v, F.col(f"mask.{field}")))
    there = F.col("mask").isNotNull()
    new = F.when(hit & there, m).otherwise(F.col("mask"))
    if strict:
        new = F.when(hit & ~there, F.raise_error(F.lit("layer without a mask"))).otherwise(new)
    out = layers.withColumn("_m", new)
    if "dirty" in layers.columns:
        out = out.withColumn("dirty", F.coalesce("dirty", F.lit(False)) | (hit & there))
    return out.select(*[F.col("_m").alias("mask") if c == "mask" else F.col(c) for c in layers.columns])


def move_text(text: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Shift text layers: transform, rectangle and mask rectangle, rounded half away from zero."""
    x, y = F.round(dx).cast("int"), F.round(dy).cast("int")
    d = text.withColumn("tx", F.col("tx") + dx).withColumn("ty", F.col("ty") + dy)
    for c, by in (("rect_top", y), ("rect_bottom", y), ("rect_left", x), ("rect_right", x)):
        d = d.withColumn(c, F.col(c) + by)
    if "mask" in text.columns:
        m = F.col("mask")
        for c, by in (("rect_top", y), ("rect_bottom", y), ("rect_left", x), ("rect_right", x)):
            m = m.withField(c, F.col(f"mask.{c}") + by)
        d = d.withColumn("mask", F.when(F.col("mask").isNotNull(), m))
    return d


def shift_layers(layers: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (path, idx, dx, dy): rectangles, masks and the rectangles around these, shifted by the rounded amounts."""
    d = layers.join(at.select("path", "idx", F.round("dx").cast("int").alias("_x"), F.round("dy").cast("int").alias("_y")), ["path", "idx"], "left")
    hit = F.col("_x").isNotNull()
    by = {"top": F.col("_y"), "bottom": F.col("_y"), "left": F.col("_x"), "right": F.col("_x")}
    m = F.col("mask")
    for c, v in by.items():
        d = d.withColumn(f"rect_{c}", F.when(hit, F.col(f"rect_{c}") + v).otherwise(F.col(f"rect_{c}")))
        m = m.withField(f"rect_{c}", F.col(f"mask.rect_{c}") + v).withField(f"real_{c}", F.col(f"mask.real_{c}") + v)
    d = d.withColumn("dirty", F.coalesce("dirty", F.lit(False)) | hit).withColumn("mask", F.when(hit & F.col("mask").isNotNull(), m).otherwise(F.col("mask")))
    return d.select(*layers.columns)


def replace_blocks(blocks: DataFrame, new: DataFrame, keys: list[str], value: str = "data") -> DataFrame:
    """Blocks with the values of ``new``; a null value removes a block, a key that was not there is added."""
    a, b = blocks.alias("a"), new.select(*keys, F.col(value).alias("_v"), F.lit(True).alias("_hit")).alias("b")
    j = a.join(b, keys, "full_outer")
    return j.where("_hit is null or _v is not null").withColumn(value, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(value))).select(*blocks.columns)
