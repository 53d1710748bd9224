"""Queries through the binary format: documents built from the tables, written, read, edited and compared."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import codec, descriptor, engine_data
from strata.functions.binio import Writer
from strata.operators import comps, edits, layers, metadata
from strata.session import plain, stored, table
from strata.sources import document, psd

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_SIDE = 8
#: Documents that are built at a time.
_BATCH = 64
#: Layer comps, slices and such of every built document.
_COMPS = ((1, "day"), (2, "night"), (3, "unused"))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------------------------------------- documents from tables


def _object(items: list[tuple[str, tuple]], name: str = "", kind: str = "null") -> dict:
    return {"name": name, "class": (kind, len(kind) != 4), "whole": True, "items": [((k.ljust(4), len(k) > 4), v) for k, v in items]}


def _tree(leaves: list[tuple[str, tuple]]) -> dict:
    """An object whose leaves stand at the given paths."""
    root: dict = {}
    for path, node in leaves:
        at = root
        *way, last = path.split(".")
        for k in way:
            at = at.setdefault(k, {})
        at[last] = node
    make = lambda d: _object([(k, ("Objc", make(v)) if isinstance(v, dict) else v) for k, v in d.items()])
    return make(root)


def _engine(text: str, runs: list[dict], fonts: list[str], justification: int) -> bytes:
    """Engine data with one style per run and one paragraph sheet per paragraph."""
    font_list = " ".join(f"<< /Name {engine_data.string_bytes(f).decode('latin-1')} >>" for f in fonts)
    styles = []
    for r in runs:
        sheet = [f"/FontSize {engine_data.number_bytes(float(r['size_px'])).decode()}", f"/Tracking {r['tracking']}", f"/Kerning {r['kerning']}"]
        sheet += [f"/{k} {'true' if r[c] else 'false'}" for k, c in (("AutoKerning", "auto_kerning"), ("FauxBold", "bold"), ("FauxItalic", "italic"), ("Underline", "underline"))]
        sheet += [f"/Font {fonts.index(r['font'])}"] if r["font"] is not None else []
        sheet += ["/FillColor << /Type 1 /Values [ " + " ".join(engine_data.number_bytes(float(r[c])).decode() for c in "argb") + " ] >>"]
        styles.append("<< /StyleSheet << /StyleSheetData << " + " ".join(sheet) + " >> >> >>")
    lines = text.split("\r")[:-1]
    paras = " ".join(f"<< /ParagraphSheet << /Properties << /Justification {justification} >> >> >>" for _ in lines)
    lengths = " ".join(str(engine_data.units(x) + 1) for x in lines)
    body = (
        f"\n\n<< /EngineDict << /Editor << /Text {engine_data.string_bytes(text).decode('latin-1')} >> /ParagraphRun << /RunArray [ {paras} ] /RunLengthArray [ {lengths} ] >> "
        f"/StyleRun << /RunArray [ {' '.join(styles)} ] /RunLengthArray [ {' '.join(str(r['length']) for r in runs)} ] >> >> /ResourceDict << /FontSet [ {font_list} ] >> >>"
    )
    return body.encode("latin-1")


def _text_block(t: dict) -> bytes:
    text = (t["text"] or "").removesuffix("\r") + "\r"
    runs = sorted(t["runs"] or [], key=lambda r: r["run"])
    fonts = sorted({r["font"] for r in runs if r["font"] is not None}) or ["Plain"]
    sides = lambda l, top, r, b: ("Objc", _object([(k, ("UntF", ("#Pnt", float(v)))) for k, v in (("Left", l), ("Top", top), ("Rght", r), ("Btom", b))]))
    items = [("Txt", ("TEXT", text + "\0")), ("Ornt", ("enum", (("Ornt", False), ("Vrtc" if t["orientation"] == "vertical" else "Hrzn", False)))), ("bounds", sides(0, 0, 200, 100)), ("boundingBox", sides(-5, 3, 190, 120))]
    items += [("TextIndex", ("long", t["text_index"]))] if t["text_index"] is not None else []
    items += [("EngineData", ("tdta", _engine(text, runs, fonts, t["justification"] or 0)))]
    return struct.pack(">h6dhi", 1, *[float(t[c] or 0) for c in document.TRANSFORM], 50, 16) + descriptor.serialize(_object(items, kind="TxLr")) + b"tail"


@lru_cache(maxsize=8)
def _comp_resource(last: int) -> bytes:
    each = [("Objc", _object([("Nm", ("TEXT", name + "\0")), ("compID", ("long", k)), ("capturedInfo", ("long", k)), ("comment", ("TEXT", f"as {name}\0"))], kind="Comp")) for k, name in _COMPS]
    return struct.pack(">I", 16) + descriptor.serialize(_object([("list", ("VlLs", each)), ("lastAppliedComp", ("long", last))]))


@lru_cache(maxsize=4096)
def _state_block(k: int) -> bytes:
    """States of layer ``k`` in comps 1 and 2; that of comp 1 is written twice, the last one holds."""
    state = lambda comp, on, x: ("Objc", _object([*([("enab", ("bool", on))] if on is not None else []), ("Ofst", ("Objc", _object([("Hrzn", ("long", x)), ("Vrtc", ("long", -x))]))), ("compList", ("VlLs", [("long", comp)]))]))
    o = _object([("layerSettings", ("VlLs", [state(1, True, 5), state(2, None, k), state(1, False, 9)]))])
    body = struct.pack(">I", 16) + descriptor.serialize(o)
    return struct.pack(">I", 1) + b"8BIMcmls" + b"\0" * 4 + struct.pack(">I", len(body)) + body


def _slice_resource(name: str) -> bytes:
    w = Writer().put("I", 6).put("4i", 0, 0, 48, 64).unicode(name).put("I", 2)
    for n in range(2):
        w.put("3i", n, 0, n)
        if n == 1:
            w.put("i", 77)
        w.unicode(f"{name} {n}").put("i", 1).put("4i", n, 0, 10 * n, 20)
        for t in ("u", "t", "m", "a"):
            w.unicode(t)
        w.put("B", 0).unicode("cell").put("2i", 0, 0).put("4B", 255, 1, 2, 3)
    return w.bytes()


def _resources_of(path: str, width: int | None, n: int) -> list[dict]:
    fixed = (72 + (width or 0) % 200) << 16
    data = [
        (1005, struct.pack(">iHHiHH", fixed if width is not None else -1, 1, 1, fixed, 1, 1)),
        (1032, struct.pack(">IiiI", 1, 576, 576, 2) + struct.pack(">iBiB", 32 * n, 1, -48, 0)),
        (1039, b"icc" + bytes((n % 256,))),
        (1050, _slice_resource(path)),
        (1060, f"<x:xmpmeta about=\"{path}\"/>".encode()),
        (1065, _comp_resource(n % 3)),
        (1036, struct.pack(">III", 1, 4, 3) + b"\0" * 16 + b"jpeg"),
        (1060, b"<second/>"),
    ]
    return [{"pos": k, "id": i, "name": b"", "data": x} for k, (i, x) in enumerate(data)]


@lru_cache(maxsize=4096)
def _recoded(kind: int, data: bytes) -> bytes:
    return codec.encode_plane(kind, codec.decode_plane(codec.RLE, data, _SIDE, _SIDE, 8), _SIDE, _SIDE, 8)


def _layer(k: int, x: dict) -> tuple[dict, list[dict], list[dict]]:
    """One layer with its channels and info blocks: small pictures in a colour of their own, packed in all four ways."""
    name, number = x["name"], int(x["layer_id"])
    kind = {"FOLDER": 1, "HIDDEN": 3}.get(x["layer_type"])
    own = {"opacity": int(x["opacity"]), "flag": int(x["flag"]), "clipping": int(x["clipping"]), "blend_key": x["blend_key"], "ranges_raw": struct.pack(">4i", k, 65535, 255, -k)}
    if kind:
        l, c, b = document.divider(k, name, number, kind)
        own.pop("blend_key")
    else:
        l, c, b = document.image_layer(k, name, number, bytes((k % 256, number % 256, 7, 255)) * (_SIDE * _SIDE), _SIDE, _SIDE, k % 40, k % 50)
        for ch in c:
            ch |= {"compression": k % 4, "data": _recoded(k % 4, ch["data"])}
        if x["mask"]:
            m = x["mask"]
            own["mask"] = {c: int(m[c] or 0) for c in ("default_color", "flags")} | {"rect_top": k, "rect_left": 1, "rect_bottom": k + 2, "rect_right": 4, "user_density": 128, "user_feather": 2.5}
            c.append(document.mask_channel(k, len(c), bytes((255, 128, 0, 9, 8, 7)), 3, 2))
    more = [("lclr", struct.pack(">H6x", x["sheet_color"] or 0))]
    more += [("iOpa", struct.pack(">B3x", x["fill_opacity"]))] if x["fill_opacity"] is not None else []
    more += [("shmd", _state_block(k))] if k % 5 == 0 else []
    more += [("TySh", _text_block(x["text"]))] if x["text"] and not kind else []
    if x["leaves"]:
        node = lambda v: ("TEXT", (v["v_string"] or "") + "\0") if v["os_type"] == "TEXT" else ("UntF", (v["unit"] or "#Nne", v["val"] or 0.0)) if v["os_type"] == "UntF" else ("doub", v["val"] or 0.0)
        more.append(("lfx2", struct.pack(">II", 0, 16) + descriptor.serialize(_tree([(v["jpath"], node(v)) for v in sorted(x["leaves"], key=lambda v: v["jpath"])]))))
    b += [{"idx": k, "pos": len(b) + n, "sig": "8BIM", "key": key, "data": data} for n, (key, data) in enumerate(more)]
    return l | own, c, b


def _documents(batches):
    import pyarrow as pa

    form = pa.schema([("path", pa.string()), ("content", pa.binary())])
    for batch in (b.slice(k, _BATCH) for b in batches for k in range(0, b.num_rows, _BATCH)):
        out = []
        for r in plain(batch.to_struct_array()):
            ls, cs, bs, bodies = [], [], [], []
            for k, x in enumerate(sorted(r["parts"], key=lambda x: x["idx"])):
                l, c, b = _layer(k, x)
                ls.append(l)
                cs += c
                bs += b
                if x["text"] and x["layer_type"] not in ("FOLDER", "HIDDEN"):
                    bodies.append((x["text"]["text"] or "").removesuffix("\r") + "\r")
            txt2 = b" /0 [" + b"".join(b" << /0 " + engine_data.string_bytes(t) + b" /5 << /0 [ << /1 %d >> ] >> /6 << /0 [ << /1 %d >> ] >> >>" % (engine_data.units(t), engine_data.units(t)) for t in bodies) + b" ]"
            trailing = [{"pos": 0, "sig": "8BIM", "key": "Txt2", "size": len(txt2), "data": txt2, "padding": None}] if bodies else []
            trailing.append({"pos": 1, "sig": "8B64", "key": "lnk2", "size": 3, "data": b"abc", "padding": b"\0"})
            doc = document.blank(64, 48) | {"n_layers": len(ls), "merged_alpha": bool(r["merged_alpha"]), "global_mask": struct.pack(">6hBx", 1, 2, 3, -4, 5, 100, 128)}
            out.append({"path": r["path"], "content": document.write(doc, ls, cs, _resources_of(r["path"], r["width"], len(ls)), trailing, bs)})
        if out:
            yield pa.RecordBatch.from_pylist(out, form)


_RUN = "run int, length int, font string, size_px double, r double, g double, b double, a double, tracking int, kerning int, auto_kerning boolean, bold boolean, italic boolean, underline boolean"


def built(spark: SparkSession, d: str) -> DataFrame:
    """(path, content) of a document for each path of the layers table, with its text, effects and header beside."""
    key = ["path", "idx"]
    l = layers.layers_once(table(spark, d, "layers"))
    t = layers.once(table(spark, d, "text_layers").where("path is not null and idx is not null"), key, ["ingested_at", "text"])
    run = [f.split(" ")[0] for f in _RUN.split(", ")]
    runs = table(spark, d, "text_runs").where("path is not null and idx is not null and run is not null").groupBy(*key, "run").agg(F.min(F.struct(*run[1:])).alias("m")).groupBy(*key).agg(F.collect_list(F.struct("run", "m.*")).alias("runs"))
    text = t.join(runs, key).select(*key, F.struct("text", "orientation", "justification", "text_index", *document.TRANSFORM, "runs").alias("text"))
    leaf = table(spark, d, "descriptor_leaves").where("block = 'lfx2' and jpath is not null and os_type in ('UntF', 'doub', 'TEXT')").groupBy(*key, "jpath").agg(F.min(F.struct("leaf_id", "os_type", "val", "unit", "v_string")).alias("m"))
    leaves = leaf.groupBy(*key).agg(F.collect_list(F.struct("jpath", "m.os_type", "m.val", "m.unit", "m.v_string")).alias("leaves"))
    x = F.struct(
        "idx", "layer_type", F.coalesce("layer_id", F.lit(0)).alias("layer_id"), layers.display_name().alias("name"), F.coalesce("opacity", F.lit(255)).alias("opacity"), F.coalesce("flag", F.lit(0)).alias("flag"),
        F.coalesce("clipping", F.lit(0)).alias("clipping"), F.coalesce("blend_key", F.lit("norm")).alias("blend_key"), "fill_opacity", "sheet_color", "mask", "text", "leaves",
    )
    each = l.join(text, key, "left").join(leaves, key, "left").groupBy("path").agg(F.collect_list(x).alias("parts"))
    h = table(spark, d, "psd_headers").where("path is not null").groupBy("path").agg(F.min("width").alias("width"), F.bool_or("merged_alpha").alias("merged_alpha"))
    return each.join(h, "path", "left").mapInArrow(_documents, "path string, content binary")


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: psd.tables(built(spark, d), name, pixels=False)


_ORDER = ", ".join(f"{c} NULLS FIRST" for c in layers._FIRST)
#: The layers of the built documents: k is the position in the file.
_K = f"""L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, idx ORDER BY {_ORDER}) AS n FROM layers WHERE path IS NOT NULL AND idx IS NOT NULL) WHERE n = 1),
R AS (SELECT path, idx, run, min(struct_pack(length, font, size_px, r, g, b, a, tracking, kerning, auto_kerning, bold, italic, underline)) AS m FROM text_runs WHERE path IS NOT NULL AND idx IS NOT NULL AND run IS NOT NULL GROUP BY path, idx, run),
T AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY path, idx ORDER BY ingested_at NULLS FIRST, text NULLS FIRST) AS n FROM text_layers WHERE path IS NOT NULL AND idx IS NOT NULL) t
      WHERE n = 1 AND EXISTS (SELECT 1 FROM R WHERE R.path = t.path AND R.idx = t.idx)),
W AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY idx) - 1 AS INTEGER) AS k, CAST(count(*) OVER (PARTITION BY path) AS INTEGER) AS size,
             layer_type IN ('FOLDER', 'HIDDEN') AS bare, coalesce(nullif(name_unicode, ''), nullif(layer_name, ''), '') AS name, coalesce(layer_id, 0) AS id FROM L),
X AS (SELECT W.*, NOT bare AND T.idx IS NOT NULL AS has_text, rtrim(coalesce(T.text, ''), '') AS raw_text, T.text AS t_text, T.orientation, T.justification, T.text_index, T.xx, T.xy, T.yx, T.yy, T.tx, T.ty
      FROM W LEFT JOIN T USING (path, idx)),
K AS (SELECT *, CASE WHEN has_text THEN regexp_replace(coalesce(t_text, ''), chr(13) || '$', '') || chr(13) END AS body,
             CASE WHEN bare THEN layer_type WHEN has_text THEN 'TEXT' ELSE 'NORMAL' END AS kind, CASE WHEN bare THEN NULL ELSE k % 256 END AS blue FROM X)"""


# ------------------------------------------------------------------------------------------------------ reading of sections


@query(f"""WITH {_K} SELECT path, k AS idx, kind AS layer_type, id AS layer_id, name AS name_unicode, coalesce(opacity, 255) AS opacity, coalesce(flag, 0) AS flag,
    CASE WHEN bare THEN 0 ELSE CAST(k % 40 AS INTEGER) END AS rect_top, CASE WHEN bare THEN 0 ELSE CAST(k % 50 AS INTEGER) END AS rect_left, coalesce(clipping, 0) AS clipping,
    coalesce(fill_opacity, 255) AS fill_opacity, coalesce(sheet_color, 0) AS sheet_color FROM K""")
def psd_layers(spark: SparkSession, d: str) -> DataFrame:
    """The layers of the built documents, read back from their bytes."""
    return _table("layers")(spark, d).select("path", "idx", "layer_type", "layer_id", "name_unicode", "opacity", "flag", "rect_top", "rect_left", "clipping", "fill_opacity", "sheet_color")


@query("""WITH P AS (SELECT path, count(DISTINCT idx) AS n FROM layers WHERE path IS NOT NULL AND idx IS NOT NULL GROUP BY path), H AS (SELECT path, min(width) AS width, bool_or(merged_alpha) AS merged_alpha FROM psd_headers WHERE path IS NOT NULL GROUP BY path)
    SELECT path, 1 AS version, 3 AS channels, 48 AS height, 64 AS width, 8 AS depth, 3 AS mode, CASE WHEN H.width IS NULL THEN 72.0 ELSE 72.0 + H.width % 200 END AS hres, 72.0 + coalesce(H.width, 0) % 200 AS vres, coalesce(H.merged_alpha, false) AS merged_alpha, CAST(n AS INTEGER) AS n_layers,
           CAST(n % 3 AS INTEGER) AS last_applied_comp, 1 AS overlay_color_space, -4 AS color3, 100 AS opacity, 128 AS kind FROM P LEFT JOIN H USING (path)""")
def psd_documents(spark: SparkSession, d: str) -> DataFrame:
    h = _table("documents")(spark, d)
    return h.select("path", "version", "channels", "height", "width", "depth", "mode", "hres", "vres", "merged_alpha", "n_layers", "last_applied_comp", *[f"global_layer_mask.{c}" for c in ("overlay_color_space", "color3", "opacity", "kind")])


@query(f"""WITH {_K} SELECT path, k AS idx, k AS rect_top, 1 AS rect_left, k + 2 AS rect_bottom, 4 AS rect_right, coalesce(mask.default_color, 0) AS default_color, (coalesce(mask.flags, 0) | 16) AS flags, 128 AS user_density, 2.5::DOUBLE AS user_feather
    FROM K WHERE mask IS NOT NULL AND NOT bare""")
def psd_masks(spark: SparkSession, d: str) -> DataFrame:
    return _table("layers")(spark, d).where("mask is not null").select("path", "idx", *[f"mask.{c}" for c in ("rect_top", "rect_left", "rect_bottom", "rect_right", "default_color", "flags", "user_density", "user_feather")])


@query(f"WITH {_K} SELECT path, k AS idx, 0 AS n, k AS source, 65535 AS dest FROM K UNION ALL SELECT path, k, 1, 255, -k FROM K")
def psd_blend_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _table("layers")(spark, d).select("path", "idx", F.posexplode("blend_ranges").alias("n", "r")).select("path", "idx", "n", "r.source", "r.dest")


@query(f"""WITH {_K}, C AS (SELECT *, unnest(CASE WHEN mask IS NOT NULL AND NOT bare THEN [-1, 0, 1, 2, -2] ELSE [-1, 0, 1, 2] END) AS ch_id FROM K)
    SELECT path, k AS idx, ch_id, CASE WHEN bare OR ch_id = -2 THEN 1 ELSE CAST(k % 4 AS INTEGER) END AS compression, CASE WHEN bare THEN 2 WHEN ch_id = -2 THEN 14 WHEN k % 4 = 0 THEN 66 WHEN k % 4 = 1 THEN 34 END AS length FROM C""")
def psd_channels(spark: SparkSession, d: str) -> DataFrame:
    """What the records say of the channels; lengths of zip streams are up to the library."""
    return _table("channels")(spark, d).select("path", "idx", "ch_id", "compression", F.when(F.col("compression") < 2, F.col("length")).alias("length"))


@query(f"""WITH {_K} SELECT path, k AS idx, list_concat(['luni', 'lyid'], CASE WHEN bare THEN ['lsct'] ELSE [] END, ['lclr'], CASE WHEN fill_opacity IS NOT NULL THEN ['iOpa'] ELSE [] END, CASE WHEN k % 5 = 0 THEN ['shmd'] ELSE [] END, CASE WHEN has_text THEN ['TySh'] ELSE [] END,
        CASE WHEN EXISTS (SELECT 1 FROM descriptor_leaves l WHERE l.path = K.path AND l.idx = K.idx AND l.block = 'lfx2' AND l.jpath IS NOT NULL AND l.os_type IN ('UntF', 'doub', 'TEXT')) THEN ['lfx2'] ELSE [] END) AS keys FROM K""")
def psd_block_keys(spark: SparkSession, d: str) -> DataFrame:
    return metadata.info_keys(_table("info_blocks")(spark, d))


@query(f"WITH {_K} SELECT path, k AS idx, CASE kind WHEN 'FOLDER' THEN '00000001' WHEN 'HIDDEN' THEN '00000003' END AS divider FROM K WHERE bare")
def psd_dividers(spark: SparkSession, d: str) -> DataFrame:
    """The first block of a key."""
    return metadata.info_block(_table("info_blocks")(spark, d), "lsct").select("path", "idx", F.hex(F.substring("data", 1, 4)).alias("divider"))


@query(f"WITH {_K} SELECT path, k AS idx, kind AS layer_type FROM K")
def psd_types_from_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layers.type_from_blocks(_table("info_blocks")(spark, d), ["path", "idx"], "pos", "key", "data")


@query(f"""WITH {_K}, D AS (SELECT path, idx, jpath, arg_min(struct_pack(os_type, val, unit, v_string), leaf_id) AS m FROM descriptor_leaves WHERE block = 'lfx2' AND jpath IS NOT NULL AND os_type IN ('UntF', 'doub', 'TEXT') GROUP BY path, idx, jpath)
    SELECT K.path, K.k AS idx, D.jpath, D.m.os_type AS type, CASE WHEN D.m.os_type <> 'TEXT' THEN coalesce(D.m.val, 0) END AS v_double, CASE D.m.os_type WHEN 'UntF' THEN coalesce(D.m.unit, '#Nne') END AS unit,
           CASE D.m.os_type WHEN 'TEXT' THEN coalesce(D.m.v_string, '') END AS v_string FROM D JOIN K USING (path, idx)""")
def psd_descriptor_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _table("descriptor_leaves")(spark, d).where("block = 'lfx2'").select("path", "idx", "jpath", "type", F.when(F.isnan("v_double"), 0.0).otherwise(F.col("v_double")).alias("v_double"), "unit", "v_string")


@query(f"""WITH {_K} SELECT path, k AS idx, body AS text, CASE WHEN orientation = 'vertical' THEN 'Vrtc' ELSE 'Hrzn' END AS orientation, coalesce(justification, 0) AS justification, coalesce(xx, 0) AS xx, coalesce(xy, 0) AS xy, coalesce(yx, 0) AS yx, coalesce(yy, 0) AS yy, coalesce(tx, 0) AS tx, coalesce(ty, 0) AS ty,
    200.0::DOUBLE AS bound_right, text_index FROM K WHERE has_text""")
def psd_text_layers(spark: SparkSession, d: str) -> DataFrame:
    return _table("text_layers")(spark, d).select("path", "idx", "text", "orientation", "justification", *document.TRANSFORM, "bound_right", "text_index")


@query(f"""WITH {_K} SELECT K.path, K.k AS idx, CAST(row_number() OVER (PARTITION BY K.path, K.k ORDER BY R.run) - 1 AS INTEGER) AS run, m.length, m.font, round(m.size_px, 6) AS size_px, round(m.r, 6) AS r, round(m.g, 6) AS g, round(m.b, 6) AS b, round(m.a, 6) AS a, m.tracking, m.kerning, m.auto_kerning, m.bold, m.italic, m.underline FROM K JOIN R USING (path, idx) WHERE has_text""")
def psd_text_runs(spark: SparkSession, d: str) -> DataFrame:
    r = _table("text_runs")(spark, d)
    return r.select("path", "idx", "run", "length", "font", *[F.round(c, 6).alias(c) for c in ("size_px", "r", "g", "b", "a")], "tracking", "kerning", "auto_kerning", "bold", "italic", "underline")


@query(f"""WITH {_K}, P AS (SELECT *, unnest(range(len(string_split(body, chr(13))) - 1)) AS para FROM K WHERE has_text), S AS (SELECT *, string_split(body, chr(13))[para + 1] AS s FROM P)
    SELECT path, k AS idx, CAST(para AS INTEGER) AS para, CAST(length(s) + length(regexp_replace(s, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) + 1 AS INTEGER) AS length, coalesce(justification, 0) AS justification FROM S""")
def psd_text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _table("text_paragraphs")(spark, d)


@query(f"""WITH {_K}, F AS (SELECT K.path, K.k, coalesce(nullif(list_sort(list_distinct(list(m.font) FILTER (m.font IS NOT NULL))), []), ['Plain']) AS fonts FROM K JOIN R USING (path, idx) WHERE has_text GROUP BY K.path, K.k), G AS (SELECT path, k, unnest(coalesce(fonts, ['Plain'])) AS name, generate_subscripts(coalesce(fonts, ['Plain']), 1) AS n FROM F)
    SELECT path, k AS idx, CAST(n - 1 AS INTEGER) AS font_no, name FROM G""")
def psd_text_fonts(spark: SparkSession, d: str) -> DataFrame:
    return _table("text_fonts")(spark, d)


@query(f"""WITH {_K} SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS INTEGER) AS text_index, body AS text FROM K WHERE has_text""")
def psd_txt2_texts(spark: SparkSession, d: str) -> DataFrame:
    return _table("txt2_texts")(spark, d)


_PATHS = "P AS (SELECT path, CAST(count(DISTINCT idx) AS INTEGER) AS n FROM layers WHERE path IS NOT NULL AND idx IS NOT NULL GROUP BY path)"


@query(f"WITH {_PATHS} SELECT path, [1005, 1032, 1039, 1050, 1060, 1065, 1036, 1060] AS ids, '<x:xmpmeta about=\"' || path || '\"/>' AS xmp, '696363' || lpad(printf('%X', n % 256), 2, '0') AS icc FROM P")
def psd_resources(spark: SparkSession, d: str) -> DataFrame:
    r = _table("resources")(spark, d)
    icc = metadata.resource(r, metadata.ICC).select("path", F.hex("data").alias("icc"))
    return metadata.resource_ids(r).join(metadata.xmp(r), "path").join(icc, "path")


@query(f"WITH {_PATHS} SELECT path, 0 AS n, CAST(n AS DOUBLE) AS location, 'horizontal' AS direction FROM P UNION ALL SELECT path, 1, -1.5, 'vertical' FROM P")
def psd_guides(spark: SparkSession, d: str) -> DataFrame:
    return _table("guides")(spark, d)


@query(f"WITH {_PATHS} SELECT path, 576 AS horizontal, 576 AS vertical FROM P")
def psd_grid(spark: SparkSession, d: str) -> DataFrame:
    return _table("grid")(spark, d)


@query(f"""WITH {_PATHS}, S AS (SELECT path, unnest([0, 1]) AS s FROM P) SELECT path, s AS n, s AS id, s AS origin, CASE s WHEN 1 THEN 77 END AS associated_layer_id, path || ' ' || s AS name, 'm' AS message, s AS left, 10 * s AS right, 255 AS a, 3 AS b FROM S""")
def psd_slices(spark: SparkSession, d: str) -> DataFrame:
    return _table("slices")(spark, d).select("path", "n", "id", "origin", "associated_layer_id", "name", "message", "left", "right", "a", "b")


@query(f"""WITH {_PATHS}, C AS (SELECT path, unnest([1, 2, 3]) AS id FROM P) SELECT path, id, ['day', 'night', 'unused'][id] AS name, 'as ' || ['day', 'night', 'unused'][id] AS comment, id % 2 = 1 AS record_visibility, id >= 2 AS record_position, false AS record_appearance FROM C""")
def psd_comps(spark: SparkSession, d: str) -> DataFrame:
    return _table("comps")(spark, d)


@query(f"""WITH {_K} SELECT path, k AS idx, 1 AS comp_id, false AS enabled, 9 AS offset_x, -9 AS offset_y FROM K WHERE k % 5 = 0 UNION ALL SELECT path, k, 2, (coalesce(flag, 0) & 2) = 0, k, -k FROM K WHERE k % 5 = 0""")
def psd_comp_states(spark: SparkSession, d: str) -> DataFrame:
    """A comp's state that is written twice counts as it was written last."""
    m = comps.comp_map(_table("layer_comp_states")(spark, d))
    return m.select("path", "idx", F.explode("comps").alias("comp_id", "s")).select("path", "idx", "comp_id", "s.*")


@query(f"WITH {_PATHS} SELECT path, 1 AS format, 4 AS width, 3 AS height, '6A706567' AS data FROM P")
def psd_thumbnails(spark: SparkSession, d: str) -> DataFrame:
    return _table("thumbnails")(spark, d).withColumn("data", F.hex("data"))


@query(f"WITH {_K}, P AS (SELECT path, bool_or(has_text) AS any_text FROM K GROUP BY path) SELECT path, 'lnk2' AS key, '8B64' AS sig, 3 AS size FROM P UNION ALL SELECT path, 'Txt2', '8BIM', NULL FROM P WHERE any_text")
def psd_document_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _table("document_blocks")(spark, d).select("path", "key", "sig", F.when(F.col("key") == "lnk2", F.col("size")).alias("size"))


# ---------------------------------------------------------------------------------------------------------------- pixels


@query(f"""WITH {_K} SELECT path, k AS idx, 8 AS width, 8 AS height, CAST(k % 256 AS INTEGER) AS blue, CAST(id % 256 AS INTEGER) AS green, 7 AS red, 255 AS alpha FROM K WHERE NOT bare AND id >= 0""")
def psd_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The last pixel of each layer without its mask."""
    t = psd.all_tables(built(spark, d), ("documents", "layers", "channels"))
    return _pixel(psd.layer_images(t["documents"], t["layers"], t["channels"], "image")).where("idx is not null")


def _pixel(images: DataFrame) -> DataFrame:
    byte = lambda k: F.conv(F.hex(F.substring("bgra", -4 + k, 1)), 16, 10).cast("int")
    return images.select("path", "idx", "width", "height", *[byte(k).alias(c) for k, c in enumerate(("blue", "green", "red", "alpha"))])


@query(f"""WITH {_K}, F AS (SELECT path, id, min(k) AS k FROM K GROUP BY path, id) SELECT F.path, F.k AS idx, F.id AS layer_id, CAST(F.k % 256 AS INTEGER) AS blue FROM F JOIN K ON K.path = F.path AND K.k = F.k WHERE NOT bare AND F.id % 7 = 0""")
def psd_image_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The picture of the lowest layer of every seventh id."""
    t = psd.all_tables(built(spark, d), ("documents", "layers", "channels"))
    ids = t["layers"].where("layer_id % 7 = 0").select("path", "layer_id")
    images = _pixel(psd.layer_images_by_id(t["documents"], t["layers"], t["channels"], ids, "image"))
    return images.join(t["layers"].select("path", "idx", "layer_id"), ["path", "idx"]).select("path", "idx", "layer_id", "blue")


@query(f"""WITH {_K} SELECT path, k AS idx, 3 AS width, 2 AS height, 7 AS blue, 7 AS red, 255 AS alpha FROM K WHERE mask IS NOT NULL AND NOT bare""")
def psd_mask_images(spark: SparkSession, d: str) -> DataFrame:
    t = psd.all_tables(built(spark, d), ("documents", "layers", "channels"))
    return _pixel(psd.layer_images(t["documents"], t["layers"], t["channels"], "mask")).select("path", "idx", "width", "height", "blue", "red", "alpha")


@query(f"WITH {_PATHS} SELECT path, 64 AS width, 48 AS height, 255 AS blue, 255 AS green, 255 AS red FROM P")
def psd_merged(spark: SparkSession, d: str) -> DataFrame:
    return _pixel(psd.merged_images(psd.tables(built(spark, d), "documents"))).select("path", "width", "height", "blue", "green", "red")


@query(f"WITH {_PATHS} SELECT path, 64 AS width, 48 AS height, 10 AS blue, 20 AS green, 30 AS red FROM P")
def psd_set_merged(spark: SparkSession, d: str) -> DataFrame:
    """The composite replaced by a picture, saved and read again."""
    t = psd.all_tables(built(spark, d))
    new = t["documents"].select("path", F.unhex(F.repeat(F.lit("0A141EFF"), 64 * 48)).alias("bgra"))
    saved = psd.assemble(**t | {"documents": psd.set_merged(t["documents"], new)})
    return _pixel(psd.merged_images(psd.tables(saved, "documents"))).select("path", "width", "height", "blue", "green", "red")


@query(f"""WITH {_K}, V AS (SELECT path, arg_max(struct_pack(k, id, opacity, mask), k) AS m FROM K WHERE NOT bare AND (coalesce(flag, 0) & 2) = 0 AND k % 40 BETWEEN 13 AND 20 AND k % 50 BETWEEN 13 AND 20 GROUP BY path)
    SELECT path, 64 AS width, 48 AS height, CAST(m.k % 256 AS INTEGER) AS blue, CAST(m.id % 256 AS INTEGER) AS green, 7 AS red, 255 AS alpha FROM V WHERE coalesce(m.opacity, 255) = 255 AND m.mask IS NULL""")
def psd_composite(spark: SparkSession, d: str) -> DataFrame:
    """The pixel at (20, 20) of each built document composed of its visible layers, where the uppermost one there is opaque."""
    t = psd.all_tables(built(spark, d), ("documents", "layers", "channels"))
    made = psd.composite(t["documents"], t["layers"], psd.layer_images(t["documents"], t["layers"], t["channels"]))
    there = t["layers"].where("layer_type in ('NORMAL', 'TEXT') and flag & 2 = 0 and 20 >= rect_top and 20 < rect_bottom and 20 >= rect_left and 20 < rect_right")
    top = there.groupBy("path").agg(F.max_by(F.struct("opacity", "mask"), "idx").alias("m")).where("m.opacity = 255 and m.mask is null")
    at = made.join(top.select("path"), "path").withColumn("bgra", F.substring("bgra", (20 * 64 + 20) * 4 + 1, 4))
    return _pixel(at).drop("idx")


# ----------------------------------------------------------------------------------------------------------------- saving


@query(f"WITH {_PATHS} SELECT path, true AS same FROM P")
def psd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """(path, same): every document taken apart into tables, put together again and compared byte by byte."""
    files = stored(built(spark, d))
    again = psd.assemble(**psd.all_tables(files)).select("path", F.col("content").alias("again"))
    return files.join(again, "path", "left").select("path", (F.col("content") == F.col("again")).alias("same"))


@query(f"WITH {_K} SELECT path, k AS idx, true AS same_text, true AS same_leaves FROM K WHERE has_text")
def psd_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Engine data written out in the indented form and read again says the same; so do descriptors that were taken apart."""
    blocks = stored(_table("info_blocks")(spark, d).where("key = 'TySh'"))
    edits_ = blocks.select("path", "idx", F.lit(0).alias("form"))
    again = metadata.rewrite_blocks(blocks, edits_, "TySh", lambda b, e: document.edit_text_block(b, engine_data.emit)).select("path", "idx", F.col("data").alias("again"))

    def run(batches):
        import pandas as pd

        for b in batches:
            texts = [[engine_data.read_text(engine_data.parse(_engine_of(bytes(x)))) for x in (old, new)] for old, new in zip(b["data"], b["again"])]
            kept = [document.change_text_block(bytes(x), lambda head, items: head) == bytes(x) for x in b["data"]]
            yield pd.DataFrame({"path": b["path"], "idx": b["idx"], "same_text": [x == y for x, y in texts], "same_leaves": kept})

    return blocks.join(again, ["path", "idx"]).select("path", "idx", "data", "again").mapInPandas(run, "path string, idx int, same_text boolean, same_leaves boolean")


def _engine_of(block: bytes) -> bytes:
    held: list[bytes] = []
    document.edit_text_block(block, lambda x: held.append(x) or x)
    return held[0]


# ------------------------------------------------------------------------------------------------- edits, saved and read again


def _edited(spark: SparkSession, d: str, edit: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of the built documents after an edit that was written into their bytes and read from these."""
    saved = psd.assemble(**edit(psd.all_tables(built(spark, d))))
    return psd.all_tables(saved, ("documents", "layers", "channels"))


def _shown(t: dict[str, DataFrame], *more: str) -> DataFrame:
    """Each layer with the blue of its picture, which says where the layer was before."""
    blue = _pixel(psd.layer_images(t["documents"], t["layers"], t["channels"], "image")).select("path", "idx", "blue")
    return t["layers"].join(blue, ["path", "idx"], "left").select("path", "idx", "layer_type", "layer_id", "name_unicode", "blue", *more)


def _sizes(t: dict[str, DataFrame]) -> DataFrame:
    return t["documents"].where("n_layers > 0").select("path", "n_layers")


_SHOW = "kind AS layer_type, id AS layer_id, name AS name_unicode, CAST(blue AS INTEGER) AS blue"
_RANK = "CAST(row_number() OVER (PARTITION BY path ORDER BY o) - 1 AS INTEGER) AS idx"


@query(f"WITH {_K}, E AS (SELECT *, k AS o FROM K WHERE k % 3 <> 1) SELECT path, {_RANK}, {_SHOW} FROM E")
def psd_delete(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_edited(spark, d, lambda t: edits.in_documents(t, edits.delete, F.col("idx") % 3 == 1)))


@query(f"WITH {_K}, E AS (SELECT *, CASE WHEN k = 0 THEN least(2, size - 1) + 0.5 ELSE k END AS o FROM K) SELECT path, {_RANK}, {_SHOW} FROM E")
def psd_move(spark: SparkSession, d: str) -> DataFrame:
    at = lambda t: _sizes(t).select("path", F.lit(0).alias("from"), F.least(F.lit(2), F.col("n_layers") - 1).alias("to"))
    return _shown(_edited(spark, d, lambda t: edits.in_documents(t, edits.move, at(t))))


@query(f"WITH {_K}, E AS (SELECT *, CASE WHEN size >= 3 AND k IN (1, 2) THEN k - 10 ELSE k END AS o FROM K) SELECT path, {_RANK}, {_SHOW} FROM E")
def psd_move_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows 1 and 2 to the bottom; documents that lack them stay."""
    at = lambda t: _sizes(t).select("path", F.lit(1).alias("from"), F.lit(2).alias("count"), F.lit(0).alias("to"))
    return _shown(_edited(spark, d, lambda t: edits.in_documents(t, edits.move_range, at(t))))


_FRESH = "CAST(greatest(max(id) OVER (PARTITION BY path), 0) + 1 AS INTEGER)"


@query(f"WITH {_K}, N AS (SELECT *, {_FRESH} AS fresh FROM K), E AS (SELECT *, k AS o FROM N UNION ALL SELECT * REPLACE (fresh AS id), 0.5 FROM N WHERE k = 0) SELECT path, {_RANK}, {_SHOW} FROM E")
def psd_duplicate(spark: SparkSession, d: str) -> DataFrame:
    at = lambda t: t["layers"].where("idx = 0").select("path", "idx")
    return _shown(_edited(spark, d, lambda t: edits.in_documents(t, edits.duplicate, at(t))))


@query(f"""WITH {_K}, N AS (SELECT *, {_FRESH} AS fresh FROM K), Q AS (SELECT path, any_value(fresh) AS fresh, any_value(size) AS size FROM N GROUP BY path),
    Y AS (SELECT min(path) AS src, max(path) AS path FROM Q GROUP BY regexp_extract(path, '^(.*)/', 1) HAVING min(path) <> max(path)),
    S AS (SELECT t.path, least(1, t.size) - 0.5 AS o, K.kind, t.fresh AS id, K.name, K.blue FROM Y JOIN K ON K.path = Y.src AND K.k = 0 JOIN Q t ON t.path = Y.path),
    E AS (SELECT path, k AS o, kind, id, name, blue FROM K UNION ALL SELECT path, o, kind, id, name, blue FROM S) SELECT path, {_RANK}, {_SHOW} FROM E""")
def psd_copy_across(spark: SparkSession, d: str) -> DataFrame:
    """The lowest layer of the first document of each folder into its last one, in front of row 1."""

    def at(t: dict[str, DataFrame]) -> DataFrame:
        pairs = _sizes(t).groupBy(F.regexp_extract("path", "^(.*)/", 1)).agg(F.min("path").alias("src"), F.max("path").alias("path")).where("src <> path")
        return pairs.select("src", F.lit(0).alias("idx"), "path", F.lit(1).alias("dest"))

    return _shown(_edited(spark, d, lambda t: edits.in_documents(t, edits.copy_across, at(t))))


@query(f"""WITH {_K}, N AS (SELECT path, {_FRESH} AS fresh, size FROM K QUALIFY k = 0),
    E AS (SELECT path, k AS o, kind, id, name, blue FROM K UNION ALL SELECT path, -0.5, 'HIDDEN', fresh, '</Layer group>', NULL FROM N UNION ALL SELECT path, least(2, size) - 0.5, 'FOLDER', fresh + 1, 'née ' || path, NULL FROM N) SELECT path, {_RANK}, {_SHOW} FROM E""")
def psd_add_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder around the two lowest rows."""
    at = lambda t: _sizes(t).select("path", F.lit(0).alias("first"), F.least(F.lit(2), F.col("n_layers")).alias("count"), F.concat(F.lit("née "), "path").alias("name"))
    return _shown(_edited(spark, d, lambda t: edits.in_documents(t, edits.add_folder, at(t))))


@query(f"""WITH {_K}, N AS (SELECT path, {_FRESH} AS fresh FROM K QUALIFY k = 0), E AS (SELECT path, k AS o, kind, id, name, blue FROM K UNION ALL SELECT path, 0.5, 'NORMAL', fresh, 'new', 250 FROM N) SELECT path, {_RANK}, {_SHOW} FROM E""")
def psd_add_image(spark: SparkSession, d: str) -> DataFrame:
    new = lambda t: _sizes(t).select("path", F.lit(1).alias("idx"), F.lit("new").alias("name"), F.lit(3).alias("top"), F.lit(4).alias("left"), F.lit(2).alias("width"), F.lit(1).alias("height"), F.unhex(F.lit("FA0000FFFA0000FF")).alias("bgra"))
    return _shown(_edited(spark, d, lambda t: edits.add_images(t, new(t))))


@query(f"""WITH {_K}, E AS (SELECT *, k AS o FROM K) SELECT path, k AS idx, kind AS layer_type, id AS layer_id, CASE WHEN k % 2 = 0 THEN name || ' é🍑' ELSE name END AS name_unicode, CAST(blue AS INTEGER) AS blue,
    CASE WHEN k % 4 = 1 THEN 99 ELSE coalesce(fill_opacity, 255) END AS fill_opacity, CASE WHEN k % 3 = 0 THEN 255 ELSE coalesce(opacity, 255) END AS opacity, CASE WHEN k % 6 = 5 THEN 4 ELSE coalesce(sheet_color, 0) END AS sheet_color, true AS short_follows FROM E""")
def psd_rename(spark: SparkSession, d: str) -> DataFrame:
    """Names, opacities and labels of some layers, in the blocks and the record of the file; 300 is clamped to 255."""
    name = F.concat("name_unicode", F.lit(" é🍑"))

    def edit(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        l = edits.set_columns(t["layers"], F.col("idx") % 2 == 0, name_unicode=name)
        l = edits.set_columns(l, F.col("idx") % 4 == 1, fill_opacity=F.lit(99))
        l = edits.set_columns(l, F.col("idx") % 3 == 0, opacity=F.lit(300))
        return t | {"layers": edits.set_columns(l, F.col("idx") % 6 == 5, sheet_color=F.lit(4))}

    short = F.col("name_raw") == F.substring(F.encode("name_unicode", "UTF-8"), 1, 255)
    t = _edited(spark, d, edit)
    return _shown(t | {"layers": t["layers"].withColumn("short_follows", short)}, "fill_opacity", "opacity", "sheet_color", "short_follows")


@query(f"""WITH {_K} SELECT path, k AS idx, CASE WHEN k % 2 = 0 THEN 100 ELSE 128 END AS user_density, CASE WHEN k % 2 = 0 THEN 5.5::DOUBLE ELSE 2.5::DOUBLE END AS user_feather, CASE WHEN k % 2 = 0 THEN 255 ELSE coalesce(mask.default_color, 0) END AS default_color,
    CASE WHEN k % 2 = 0 THEN (coalesce(mask.flags, 0) | 18) ELSE (coalesce(mask.flags, 0) | 16) END AS flags, k AS rect_top FROM K WHERE mask IS NOT NULL AND NOT bare""")
def psd_mask_edit(spark: SparkSession, d: str) -> DataFrame:
    edit = lambda t: t | {"layers": edits.set_mask(t["layers"], F.lit(True), F.lit(999), F.lit(100), F.lit(5.5), where=F.col("idx") % 2 == 0)}
    l = _edited(spark, d, edit)["layers"].where("mask is not null")
    return l.select("path", "idx", *[f"mask.{c}" for c in ("user_density", "user_feather", "default_color", "flags", "rect_top")])


@query(f"""WITH {_K}, D AS (SELECT path, idx, jpath, arg_min(os_type, leaf_id) AS os_type FROM descriptor_leaves WHERE block = 'lfx2' AND jpath IS NOT NULL AND os_type IN ('UntF', 'doub', 'TEXT') GROUP BY path, idx, jpath)
    SELECT K.path, K.k AS idx, D.jpath, D.os_type AS type, CASE WHEN D.os_type = 'UntF' THEN 12.5::DOUBLE END AS v_double FROM D JOIN K USING (path, idx) WHERE D.jpath = 'DrSh.Dstn'""")
def psd_effects_edit(spark: SparkSession, d: str) -> DataFrame:
    """A value merged into the effects of the layers that have it; keys that they lack change nothing."""

    def change(idx: int, o: dict) -> dict | None:
        there = any(x["jpath"] == "DrSh.Dstn" and x["type"] == "UntF" for x in descriptor.leaves(o))
        return descriptor.merge(o, {"DrSh": {"Dstn": 12.5, "none": 3}, "more": 1}) if there else None

    saved = psd.rewritten(built(spark, d), lambda path, content: document.edit_descriptors(content, "lfx2", change))
    return psd.tables(saved, "descriptor_leaves", pixels=False).where("block = 'lfx2' and jpath = 'DrSh.Dstn'").select("path", "idx", "jpath", "type", F.when(F.col("type") == "UntF", F.col("v_double")).alias("v_double"))


def _text_edited(spark: SparkSession, d: str, edit: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    files = stored(built(spark, d))
    t, texts = psd.all_tables(files), psd.tables(files, "text_layers", pixels=False)
    new = edit(t, texts)
    saved = psd.assemble(**new | {"layers": metadata.mark_dirty(new["layers"], texts.select("path", "idx"))})
    return psd.all_tables(saved, ("layers", "text_layers", "text_runs", "text_paragraphs", "text_fonts", "txt2_texts", "document_blocks"), pixels=False)


@query(f"""WITH {_K}, Q AS (SELECT path, bool_or(text_index IS NULL) AS lost, max(text_index) AS top, count(*) AS n FROM K WHERE has_text GROUP BY path), N AS (SELECT path, k, text_index, 'new 🍑' || k || chr(13) AS text FROM K WHERE has_text)
    SELECT path, k AS idx, text, 1 AS runs, 1 AS paragraphs, CAST(length(text) + 1 AS INTEGER) AS length, CASE WHEN lost OR top >= n THEN NULL ELSE arg_max(text, text) OVER (PARTITION BY path, text_index) END AS in_txt2 FROM N JOIN Q USING (path)""")
def psd_text_edit(spark: SparkSession, d: str) -> DataFrame:
    """New text in every text layer; the document-level text follows, or is dropped where it can't."""
    text = lambda idx: f"new 🍑{idx}"
    saved = psd.rewritten(built(spark, d), lambda path, content: document.edit_texts(content, lambda idx, x: engine_data.set_text(x, text(idx)), text))
    t = psd.all_tables(saved, ("text_layers", "text_runs", "text_paragraphs", "txt2_texts"), pixels=False)
    n = lambda name: t[name].groupBy("path", "idx").agg(F.count("*").cast("int").alias(name[5:]), F.sum("length").cast("int").alias("length"))
    rows = t["text_layers"].join(n("text_runs"), ["path", "idx"]).join(n("text_paragraphs").drop("length"), ["path", "idx"])
    return rows.join(t["txt2_texts"].withColumnRenamed("text", "in_txt2"), ["path", "text_index"], "left").select("path", "idx", "text", "runs", "paragraphs", "length", "in_txt2")


@query(f"""WITH {_K}, F AS (SELECT K.path, K.k, min(R.run) AS first FROM K JOIN R USING (path, idx) WHERE has_text GROUP BY K.path, K.k) SELECT K.path, K.k AS idx, CAST(row_number() OVER (PARTITION BY K.path, K.k ORDER BY R.run) - 1 AS INTEGER) AS run, CASE WHEN R.run = first THEN 'Fresh (1)' ELSE m.font END AS font,
    CASE WHEN R.run = first THEN 0.25 ELSE round(m.r, 6) END AS r, CASE WHEN R.run = first THEN -7 ELSE m.tracking END AS tracking, CASE WHEN R.run = first THEN true ELSE m.bold END AS bold, round(m.size_px, 6) AS size_px, m.length FROM K JOIN R USING (path, idx) JOIN F ON F.path = K.path AND F.k = K.k WHERE has_text""")
def psd_run_style(spark: SparkSession, d: str) -> DataFrame:
    """Font by name, colour, tracking and weight of the first run of every text layer."""

    style = lambda idx, x: engine_data.set_run_style(x, 0, font="Fresh (1)", tracking=-7, bold=True, color=(0.25, 0.5, 0.75, 1.0))
    saved = psd.rewritten(built(spark, d), lambda path, content: document.edit_texts(content, style))
    return psd.tables(saved, "text_runs", pixels=False).select("path", "idx", "run", "font", F.round("r", 6).alias("r"), "tracking", "bold", F.round("size_px", 6).alias("size_px"), "length")


@query(f"""WITH {_K}, P AS (SELECT *, unnest(range(len(string_split(body, chr(13))) - 1)) AS para FROM K WHERE has_text) SELECT path, k AS idx, CAST(para AS INTEGER) AS para, CASE WHEN k % 2 = 0 OR para = 0 THEN 2 ELSE coalesce(justification, 0) END AS justification FROM P""")
def psd_justify(spark: SparkSession, d: str) -> DataFrame:
    """All paragraphs of every second text layer, the first one of the others."""
    which = F.when(F.col("idx") % 2 == 0, -1).otherwise(0)
    edit = lambda t, texts: t | {"info_blocks": metadata.set_justification(t["info_blocks"], texts.select("path", "idx", F.lit(2).alias("justification"), which.alias("paragraph")))}
    return _text_edited(spark, d, edit)["text_paragraphs"].select("path", "idx", "para", "justification")


@query(f"""WITH {_K} SELECT path, k AS idx, coalesce(tx, 0) + 2.5 AS tx, coalesce(ty, 0) - 7.25 AS ty, coalesce(xx, 0) AS xx, CAST(k % 40 AS INTEGER) - 7 AS rect_top, CAST(k % 50 AS INTEGER) + 3 AS rect_left, CASE WHEN mask IS NOT NULL THEN k - 7 END AS mask_top, 150.0::DOUBLE AS bound_right FROM K WHERE has_text""")
def psd_text_move(spark: SparkSession, d: str) -> DataFrame:
    """Text layers shifted with their rectangles and masks, and given a narrower frame."""

    def edit(t: dict[str, DataFrame], texts: DataFrame) -> dict[str, DataFrame]:
        t = metadata.move_text(t, texts.select("path", "idx", F.lit(2.5).alias("dx"), F.lit(-7.25).alias("dy")))
        e = texts.select("path", "idx", *[F.lit(v).alias(c) for c, v in (("left", 0.0), ("top", 5.0), ("right", 150.0), ("bottom", 80.0))])
        return t | {"info_blocks": metadata.set_text_bounds(t["info_blocks"], e)}

    t = _text_edited(spark, d, edit)
    l = t["layers"].select("path", "idx", "rect_top", "rect_left", F.col("mask.rect_top").alias("mask_top"))
    return t["text_layers"].join(l, ["path", "idx"]).select("path", "idx", "tx", "ty", "xx", "rect_top", "rect_left", "mask_top", "bound_right")


@query(f"""WITH {_K}, P AS (SELECT path, bool_or(has_text) AS any_text FROM K GROUP BY path), S AS (SELECT path, unnest(['keep', 'remove', 'sync']) AS policy FROM P WHERE any_text) SELECT path, policy, policy = 'keep' AS kept FROM S""")
def psd_text_policy(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the document-level text after an edit of style, by policy."""
    files = stored(built(spark, d))
    texts, blocks = psd.tables(files, "text_layers", pixels=False), psd.tables(files, "document_blocks", pixels=False)
    e = texts.select("path", "idx", F.lit(None).cast("string").alias("text"))
    out = None
    for p in (metadata.KEEP, metadata.REMOVE, metadata.SYNC):
        left = metadata.follow_text(blocks, texts, e, p).where("key = 'Txt2'").select("path", F.lit(True).alias("kept"))
        one = texts.select("path").distinct().join(left, "path", "left").select("path", F.lit(p).alias("policy"), F.coalesce("kept", F.lit(False)).alias("kept"))
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
