"""Layer attributes: one row per layer, flags, blend modes, ids, names, rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the document format: blend key and mode.
BLEND = {
    "norm": "NORMAL", "diss": "DISSOLVE", "dark": "DARKEN", "mul ": "MULTIPLY", "idiv": "COLOR_BURN", "lbrn": "LINEAR_BURN", "dkCl": "DARKER_COLOR",
    "lite": "LIGHTEN", "scrn": "SCREEN", "div ": "COLOR_DODGE", "lddg": "LINEAR_DODGE", "lgCl": "LIGHTER_COLOR", "ltCl": "LIGHTER_COLOR", "over": "OVERLAY",
    "sLit": "SOFT_LIGHT", "hLit": "HARD_LIGHT", "vLit": "VIVID_LIGHT", "lLit": "LINEAR_LIGHT", "pLit": "PIN_LIGHT", "hMix": "HARD_MIX", "diff": "DIFFERENCE",
    "smud": "EXCLUSION", "fsub": "SUBTRACT", "fdiv": "DIVIDE", "hue ": "HUE", "sat ": "SATURATION", "colr": "COLOR", "lum ": "LUMINOSITY", "pass": "PASS_THROUGH",
}
#: Layer types by number; colour modes; channel ids; label names; descriptor units.
TYPES = ["NORMAL", "HIDDEN", "FOLDER", "ADJUST", "FILL", "TEXT"]
COLOR_MODES = {0: "bitmap", 1: "grayscale", 2: "indexed", 3: "rgb", 4: "cmyk", 7: "multichannel", 8: "duotone", 9: "lab"}
CHANNELS = {-3: "real_user_mask", -2: "user_mask", -1: "transparency", 0: "first", 1: "second", 2: "third", 3: "fourth"}
LABELS = ["none", "red", "orange", "yellow", "green", "blue", "violet", "gray", "seafoam", "indigo", "magenta", "fuschia"]
UNIT_NAMES = {"#Pnt": "points", "#Mlm": "millimeters", "#Ang": "angle", "#Rsl": "density", "#Rlt": "distance", "#Nne": "none", "#Prc": "percent", "#Pxl": "pixels"}
#: Layer flag bits and mask flag bits.
FLAGS = {"transparency_protected": 0, "hidden": 1, "obsolete": 2, "later_ver5": 3, "pixel_data_irrelevant": 4}
MASK_FLAGS = {"relative": 0, "disabled": 1, "inverted": 2, "from_render": 3, "has_parameters": 4}
#: Info blocks that decide the type of a layer.
ADJUST_KEYS = ["grdm", "levl", "curv", "hue ", "hue2", "blnc", "nvrt", "post", "thrs", "selc", "brit", "mixr", "clrL", "phfl", "blwh", "vibA", "expA"]
FILL_KEYS = ["SoCo", "GdFl", "PtFl"]
PIXEL_TYPES = ["NORMAL", "TEXT", "ADJUST", "FILL"]

_FIRST = ["ingested_at", "opacity", "fill_opacity", "flag", "clipping", "blend_key", "layer_id", "sheet_color", "rect_top", "rect_left"]


def once(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first delivery of each key, nulls first; partial aggregation takes copies before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_m")).select(*keys, "_m.*").select(*df.columns)


def layers_once(df: DataFrame) -> DataFrame:
    return once(df.where("path is not null and idx is not null"), ["path", "idx"], _FIRST)


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return m[key] if default is None else F.coalesce(m[key], default)


def bit(flags: Column, n: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << n)) != 0


def visible(flag: Column) -> Column:
    return ~bit(flag, FLAGS["hidden"])


def blend_mode(key: Column) -> Column:
    return lookup(BLEND, key, F.lit("INVALID"))


def fourcc_to_int(key: Column) -> Column:
    """A four-character key as the big-endian number of its bytes."""
    return F.conv(F.hex(F.encode(key, "ISO-8859-1")), 16, 10).cast("bigint")


def int_to_fourcc(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "ISO-8859-1")


def width(prefix: str = "rect") -> Column:
    return F.col(f"{prefix}_right") - F.col(f"{prefix}_left")


def height(prefix: str = "rect") -> Column:
    return F.col(f"{prefix}_bottom") - F.col(f"{prefix}_top")


def display_name() -> Column:
    return F.coalesce(F.nullif("name_unicode", F.lit("")), F.nullif("layer_name", F.lit("")), F.lit(""))


def safe_name(name: Column, most: int = 40) -> Column:
    """Runs of anything but letters, digits, ``_ - . +`` as one underscore, none at the ends, at most ``most``."""
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}_\-.+]+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(clean, "^_+|_+$", ""), 1, most), F.lit("")), F.lit("layer"))


def label(number: Column) -> Column:
    return F.coalesce(F.when((number >= 0) & (number < len(LABELS)), F.element_at(F.array(*map(F.lit, LABELS)), (number + 1).cast("int"))), F.lit("unknown"))


def first_by_id(df: DataFrame) -> DataFrame:
    """(path, layer_id, idx): the lowest layer of each id."""
    return df.where("layer_id is not null").groupBy("path", "layer_id").agg(F.min("idx").alias("idx"))


def next_id(df: DataFrame) -> DataFrame:
    """(path, next_id): the id that a new layer of each document gets."""
    return df.groupBy("path").agg((F.greatest(F.coalesce(F.max("layer_id"), F.lit(0)), F.lit(0)) + 1).alias("next_id"))


def type_from_blocks(blocks: DataFrame, keys: list[str], pos: str, block: str, data: str | None = None) -> DataFrame:
    """Layer type by the last info block that names one; NORMAL without any. Section dividers say their kind in the first
    four bytes of ``data``: 1 and 2 are folders, 3 is hidden, all else says nothing; without data they are folders."""
    section = F.lit("FOLDER") if data is None else F.when(F.hex(F.substring(data, 1, 4)).isin("00000001", "00000002"), "FOLDER").when(F.hex(F.substring(data, 1, 4)) == "00000003", "HIDDEN")
    kind = F.when(F.col(block).isin(ADJUST_KEYS), "ADJUST").when(F.col(block).isin(FILL_KEYS), "FILL").when(F.col(block) == "TySh", "TEXT").when(F.col(block).isin("lsct", "lsdk"), section)
    return blocks.groupBy(*keys).agg(F.coalesce(F.max_by(kind, F.when(kind.isNotNull(), F.col(pos))), F.lit("NORMAL")).alias("layer_type"))


def clip_to(top: Column, left: Column, bottom: Column, right: Column, h: Column, w: Column) -> list[Column]:
    """The part of a rectangle on a canvas; empty rectangles come out with width or height 0."""
    t, l = F.greatest(top, F.lit(0)), F.greatest(left, F.lit(0))
    return [t, l, F.greatest(F.least(bottom, h), t), F.greatest(F.least(right, w), l)]
