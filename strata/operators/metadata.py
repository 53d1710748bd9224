"""Document metadata and edits of info blocks, set-based: resources, blocks, text, effects, comps.

Edits come as tables keyed by (path, idx); a block is rewritten by a kernel only where an edit hits it, everything else
passes through as it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import descriptor, engine_data
from strata.operators.edits import shift_layers
from strata.session import frames
from strata.sources import document

#: Resource ids.
ICC, EXIF, XMP, GUIDES, SLICES, COMPS = 1039, 1058, 1060, 1032, 1050, 1065


def resource(resources: DataFrame, number: int) -> DataFrame:
    """(path, data): the first resource of an id in each document."""
    return resources.where(F.col("id") == number).groupBy("path").agg(F.min_by("data", "pos").alias("data"))


def resource_ids(resources: DataFrame) -> DataFrame:
    return resources.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def xmp(resources: DataFrame) -> DataFrame:
    return resource(resources, XMP).select("path", F.decode("data", "UTF-8").alias("xmp"))


def info_block(blocks: DataFrame, key: str) -> DataFrame:
    """(path, idx, data): the first block of a key of each layer."""
    return blocks.where(F.col("key") == key).groupBy("path", "idx").agg(F.min_by("data", "pos").alias("data"))


def info_keys(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("path", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("keys"))


def document_block(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.where(F.col("key") == key).groupBy("path").agg(F.min_by("data", "pos").alias("data"))


def set_document_block(blocks: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Trailing blocks with ``new`` (path, data) in place of those of ``key``; null data removes, a new one goes last."""
    hit = new.select("path", F.col("data").alias("_new"), F.lit(True).alias("_hit"))
    old = blocks.join(hit, "path", "left")
    mine = (F.col("key") == key) & F.col("_hit")
    kept = old.where(~F.coalesce(mine, F.lit(False)) | F.col("_new").isNotNull())
    kept = kept.withColumn("data", F.when(mine, F.col("_new")).otherwise(F.col("data"))).withColumn("size", F.length("data")).withColumn("padding", F.when(mine, F.lit(None).cast("binary")).otherwise(F.col("padding"))).select(*blocks.columns)
    there = blocks.where(F.col("key") == key).select("path")
    last = blocks.groupBy("path").agg((F.max("pos") + 1).alias("pos"))
    add = new.where("data is not null").join(there, "path", "left_anti").join(last, "path", "left")
    add = add.select("path", F.coalesce("pos", F.lit(0)).alias("pos"), F.lit("8BIM").alias("sig"), F.lit(key).alias("key"), F.length("data").alias("size"), "data", F.lit(None).cast("binary").alias("padding"))
    return kept.unionByName(add.select(*blocks.columns))


def rewrite_blocks(blocks: DataFrame, edits: DataFrame, key: str, change: Callable[[bytes, dict], bytes]) -> DataFrame:
    """Info blocks with those of ``key`` that ``edits`` (path, idx, ...) names passed through ``change``."""
    args = [c for c in edits.columns if c not in ("path", "idx")]
    hit = blocks.where(F.col("key") == key).join(edits.select("path", "idx", F.struct(*args).alias("_e")), ["path", "idx"])

    def run(batches):
        for b in batches:
            data = [change(bytes(d), e.asDict(True) if hasattr(e, "asDict") else dict(e)) for d, e in zip(b["data"], b["_e"])]
            yield b.drop(columns="_e").assign(data=data, size=[len(d) for d in data])

    order = [c for c in blocks.columns]
    new = hit.select(*order, "_e").transform(frames, run, blocks.schema)
    rest = blocks.join(edits.select("path", "idx").withColumn("key", F.lit(key)), ["path", "idx", "key"], "left_anti").select(*order)
    return rest.unionByName(new)


def set_text(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (path, idx, text): new text in the style of the first run."""
    return rewrite_blocks(blocks, edits, "TySh", lambda d, e: document.edit_text_block(d, lambda x: engine_data.set_text(x, e["text"])))


def set_rich_text(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (path, idx, text, runs, paragraphs): runs and paragraphs are arrays of structs with a length each."""

    def change(d: bytes, e: dict) -> bytes:
        rows = lambda x: [r.asDict(True) if hasattr(r, "asDict") else dict(r) for r in x] if x is not None else None
        return document.edit_text_block(d, lambda x: engine_data.set_rich_text(x, e["text"], rows(e["runs"]), rows(e.get("paragraphs"))))

    return rewrite_blocks(blocks, edits, "TySh", change)


def _style(e: dict) -> dict:
    """An edit's fields as those of a run; r, g, b and a are one colour."""
    color = [e.get(c) for c in "rgba"]
    return {k: v for k, v in e.items() if k not in ("run", *"rgba")} | ({"color": tuple(c for c in color if c is not None)} if None not in color[:3] else {})


def set_run_style(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (path, idx, run, and any of font, size, tracking, kerning, auto_kerning, bold, italic, underline and the
    colour r, g, b, a); null leaves a value, a font that the layer lacks is appended to its fonts."""
    return rewrite_blocks(blocks, edits, "TySh", lambda d, e: document.edit_text_block(d, lambda x: engine_data.set_run_style(x, int(e["run"]), **_style(e))))


def set_justification(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (path, idx, justification, and paragraph, where -1 and null mean all)."""
    which = lambda e: -1 if e.get("paragraph") is None else int(e["paragraph"])
    return rewrite_blocks(blocks, edits, "TySh", lambda d, e: document.edit_text_block(d, lambda x: engine_data.set_justification(x, int(e["justification"]), which(e))))


def add_fonts(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (path, idx, font): text layers with the font in their list."""
    return rewrite_blocks(blocks, edits, "TySh", lambda d, e: document.edit_text_block(d, lambda x: engine_data.add_font(x, e["font"])[0]))


def set_text_transform(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (path, idx, and any of xx, xy, yx, yy, tx, ty); null leaves a value."""
    return rewrite_blocks(blocks, edits, "TySh", document.set_text_transform)


def set_text_bounds(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (path, idx, left, top, right, bottom): new frames, the boxes of the letters clamped into them."""
    return rewrite_blocks(blocks, edits, "TySh", lambda d, e: document.set_text_bounds(d, e["left"], e["top"], e["right"], e["bottom"]))


def move_text(tables: dict[str, DataFrame], edits: DataFrame) -> dict[str, DataFrame]:
    """``edits`` (path, idx, dx, dy): text layers shifted in the file: transform, rectangle, mask and what is around it."""
    hit = edits.join(tables["info_blocks"].where("key = 'TySh'").select("path", "idx").distinct(), ["path", "idx"], "left_semi")
    blocks = rewrite_blocks(tables["info_blocks"], hit, "TySh", lambda d, e: document.move_text_block(d, e["dx"], e["dy"]))
    return tables | {"info_blocks": blocks, "layers": shift_layers(tables["layers"], hit)}


#: What becomes of the document-level text data when a text layer is edited.
KEEP, REMOVE, SYNC = "keep", "remove", "sync"


def drop_text_data(blocks: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Document blocks without text data, in all documents or in those of ``paths`` (path)."""
    if paths is None:
        return blocks.where("key is null or key <> 'Txt2'")
    return blocks.join(paths.select("path").distinct().withColumn("key", F.lit("Txt2")), ["path", "key"], "left_anti").select(*blocks.columns)


def follow_text(blocks: DataFrame, texts: DataFrame, edits: DataFrame, policy: str = SYNC) -> DataFrame:
    """Document blocks after edits of text layers. ``texts`` has (path, idx, text_index); ``edits`` (path, idx, text, and
    optionally the lengths of its paragraphs and styles as arrays ``paragraphs`` and ``styles``), where a null text stands
    for an edit of style or place.

    KEEP leaves the text data as it is, REMOVE drops it from the edited documents. SYNC writes new texts into it, and drops
    it where it can't follow: style or place changed, no index, or an index that is out of range.
    """
    if policy == KEEP:
        return blocks
    if policy == REMOVE:
        return drop_text_data(blocks, edits)
    lists = [F.col(c) if c in edits.columns else F.array().cast("array<int>").alias(c) for c in ("paragraphs", "styles")]
    named = edits.select("path", "idx", "text", *lists).join(texts.select("path", "idx", "text_index"), ["path", "idx"], "left")
    per = named.groupBy("path").agg(F.max((F.col("text_index").isNull() | F.col("text").isNull()).cast("int")).alias("_lost"), F.array_sort(F.collect_list(F.struct("text_index", "text", "paragraphs", "styles"))).alias("_e"))
    hit = blocks.where("key = 'Txt2'").join(per, "path")

    def run(batches):
        for b in batches:
            keep, data = [], []
            for raw, lost, es in zip(b["data"], b["_lost"], b["_e"]):
                new = bytes(raw)
                try:
                    for e in es if not lost else ():
                        new = engine_data.set_body_text(new, int(e["text_index"]), e["text"], list(e["paragraphs"] if e["paragraphs"] is not None else ()), list(e["styles"] if e["styles"] is not None else ()))
                    keep.append(not lost)
                except IndexError:
                    keep.append(False)
                data.append(new)
            out = b.drop(columns=["_lost", "_e"]).assign(data=data, size=[len(x) for x in data])
            yield out[keep]

    new = hit.select(*blocks.columns, "_lost", "_e").transform(frames, run, blocks.schema)
    return drop_text_data(blocks, per).unionByName(new)


def set_descriptor(blocks: DataFrame, edits: DataFrame, key: str = "lfx2") -> DataFrame:
    """``edits`` (path, idx, json): values merged into the descriptor of a block; keys that it lacks are passed over."""

    def change(d: bytes, e: dict) -> bytes:
        skip = descriptor.PREFIX[key]
        return d[:skip] + descriptor.serialize(descriptor.merge(descriptor.parse(d, skip), json.loads(e["json"])))

    return rewrite_blocks(blocks, edits, key, change)


def effects(descriptors: DataFrame) -> DataFrame:
    return descriptors.where("block = 'lfx2'").select("path", "idx", F.parse_json("json").alias("effects"))


def fills(descriptors: DataFrame) -> DataFrame:
    """(path, idx, kind, fill): solid before gradient before pattern."""
    rank = F.when(F.col("block") == "SoCo", 0).when(F.col("block") == "GdFl", 1).when(F.col("block") == "PtFl", 2)
    best = descriptors.where("block in ('SoCo', 'GdFl', 'PtFl')").groupBy("path", "idx").agg(F.min(F.struct(rank.alias("r"), "block", "json")).alias("m"))
    return best.select("path", "idx", F.col("m.block").alias("kind"), F.parse_json("m.json").alias("fill"))


def mark_dirty(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """Layers that an edit names are written from their fields and blocks."""
    hit = edits.select("path", "idx").distinct().withColumn("_d", F.lit(True))
    return layers.join(hit, ["path", "idx"], "left").withColumn("dirty", F.coalesce("_d", "dirty", F.lit(False))).select(*layers.columns)


def utf8_to_utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16BE")


def utf16_to_utf8(data: Column) -> Column:
    return F.decode(data, "UTF-16BE")


def big_endian(data: Column, at: Column | int, n: int, signed: bool = False) -> Column:
    """A big-endian number of up to 7 bytes at a position (from 0) of a binary column."""
    v = F.conv(F.hex(F.substring(data, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(n))), 16, 10).cast("bigint")
    return F.when(v >= 1 << (8 * n - 1), v - (1 << 8 * n)).otherwise(v) if signed else v


def padding(size: Column, align: int) -> Column:
    return F.pmod(-size, F.lit(align))


def fixed_to_dpi(raw: Column) -> Column:
    return F.when(raw > 0, raw / 65536.0).otherwise(72.0)
