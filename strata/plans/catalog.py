"""Queries of the document operators over the layered-document tables, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import comps, edits, layers, metadata, pixels, text, tree
from strata.operators.scan import running
from strata.session import bounded, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_ORDER = ", ".join(f"{c} NULLS FIRST" for c in layers._FIRST)
_L = f"L AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY path, idx ORDER BY {_ORDER}) AS n FROM layers WHERE path IS NOT NULL AND idx IS NOT NULL) WHERE n = 1)"
_T = "T AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY path, idx ORDER BY ingested_at NULLS FIRST, text NULLS FIRST) AS n FROM text_layers WHERE path IS NOT NULL AND idx IS NOT NULL) WHERE n = 1)"
#: The folder of each layer by a stack: rows from the top down, a list of open folders carried along.
_TREE = f"""{_L},
K AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx DESC) AS k FROM L),
S AS (SELECT path, idx, k, CAST(-1 AS INTEGER) AS parent, 0 AS depth, CASE WHEN layer_type = 'FOLDER' THEN [idx] ELSE CAST([] AS INTEGER[]) END AS st FROM K WHERE k = 1
      UNION ALL
      SELECT K.path, K.idx, K.k, coalesce(S.st[-1], -1), CAST(len(S.st) AS INTEGER), CASE K.layer_type WHEN 'FOLDER' THEN list_append(S.st, K.idx) WHEN 'HIDDEN' THEN S.st[:-2] ELSE S.st END
      FROM S JOIN K ON K.path = S.path AND K.k = S.k + 1)"""
_SPAN = """C AS (SELECT *, sum(CASE layer_type WHEN 'FOLDER' THEN 1 WHEN 'HIDDEN' THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY idx DESC) AS cs FROM L),
P AS (SELECT f.path, f.idx, max(h.idx) AS start FROM C f JOIN C h ON h.path = f.path AND h.idx < f.idx AND h.layer_type = 'HIDDEN' AND h.cs = f.cs - 1 WHERE f.layer_type = 'FOLDER' GROUP BY f.path, f.idx),
G AS (SELECT L.*, coalesce(P.start, L.idx) AS start, L.idx - coalesce(P.start, L.idx) + 1 AS "count" FROM L LEFT JOIN P USING (path, idx))"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return layers.layers_once(table(spark, d, "layers"))


def _text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "text_layers").where("path is not null and idx is not null")
    return layers.once(t, ["path", "idx"], ["ingested_at", "text"])


def _case(values: dict, key: str, default: str | None = None) -> str:
    lit = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + (f" ELSE {lit(default)}" if default is not None else "") + " END"


# -------------------------------------------------------------------------------------------------- attributes, filters


@query(f"""WITH {_L}, H AS (SELECT path, min(width) AS width, min(height) AS height, min(n_layers) AS declared FROM psd_headers WHERE path IS NOT NULL GROUP BY path)
    SELECT H.path, width, height, declared, CAST(count(L.idx) AS BIGINT) AS n_layers, max(rect_right) AS right_most, max(rect_bottom) AS bottom_most FROM H LEFT JOIN L USING (path) GROUP BY H.path, width, height, declared""")
def scan_header_stats(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "psd_headers").where("path is not null").groupBy("path").agg(F.min("width").alias("width"), F.min("height").alias("height"), F.min("n_layers").alias("declared"))
    n = _layers(spark, d).groupBy("path").agg(F.count("*").alias("n_layers"), F.max("rect_right").alias("right_most"), F.max("rect_bottom").alias("bottom_most"))
    return h.join(n, "path", "left").select("path", "width", "height", "declared", F.coalesce("n_layers", F.lit(0)).alias("n_layers"), "right_most", "bottom_most")


@query(f"WITH {_L} SELECT path, idx, " + ", ".join(f"(flag & {1 << n}) {'=' if k == 'hidden' else '<>'} 0 AS {'visible' if k == 'hidden' else k}" for k, n in layers.FLAGS.items()) + " FROM L")
def layer_flags(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("flag")
    return _layers(spark, d).select("path", "idx", *[(layers.visible(f) if k == "hidden" else layers.bit(f, n)).alias("visible" if k == "hidden" else k) for k, n in layers.FLAGS.items()])


@query(f"WITH {_L} SELECT path, idx, " + ", ".join(f"(mask.flags & {1 << n}) <> 0 AS {k}" for k, n in layers.MASK_FLAGS.items()) + " FROM L WHERE mask IS NOT NULL")
def mask_flags(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).where("mask is not null").select("path", "idx", *[layers.bit(F.col("mask.flags"), n).alias(k) for k, n in layers.MASK_FLAGS.items()])


@query(f"WITH {_L} SELECT path, idx, blend_key, {_case(layers.BLEND, 'blend_key', 'INVALID')} AS blend_mode FROM L")
def blend_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).select("path", "idx", "blend_key", layers.blend_mode(F.col("blend_key")).alias("blend_mode"))


@query("""WITH K AS (SELECT DISTINCT blend_key FROM layers WHERE length(blend_key) = 4)
    SELECT blend_key, CAST(ascii(blend_key[1]) * 16777216 + ascii(blend_key[2]) * 65536 + ascii(blend_key[3]) * 256 + ascii(blend_key[4]) AS BIGINT) AS number, blend_key AS again FROM K""")
def fourcc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "layers").where("length(blend_key) = 4").select("blend_key").distinct().withColumn("number", layers.fourcc_to_int(F.col("blend_key")))
    return k.withColumn("again", layers.int_to_fourcc(F.col("number")))


@query(f"WITH {_L} SELECT path, layer_id, min(idx) AS idx FROM L WHERE layer_id IS NOT NULL GROUP BY path, layer_id")
def layer_by_id_first(spark: SparkSession, d: str) -> DataFrame:
    return layers.first_by_id(_layers(spark, d))


@query(f"WITH {_L} SELECT path, greatest(coalesce(max(layer_id), 0), 0) + 1 AS next_id FROM L GROUP BY path")
def next_layer_id(spark: SparkSession, d: str) -> DataFrame:
    return layers.next_id(_layers(spark, d))


@query(f"WITH {_L} SELECT path, idx, layer_type, rect_right - rect_left AS width, rect_bottom - rect_top AS height FROM L WHERE layer_type IN ('NORMAL', 'TEXT', 'ADJUST', 'FILL') AND rect_right > rect_left AND rect_bottom > rect_top")
def nonempty_pixel_layers(spark: SparkSession, d: str) -> DataFrame:
    w, h = layers.width(), layers.height()
    return _layers(spark, d).where(F.col("layer_type").isin(layers.PIXEL_TYPES) & (w > 0) & (h > 0)).select("path", "idx", "layer_type", w.alias("width"), h.alias("height"))


@query(f"""WITH {_L}, N AS (SELECT path, idx, coalesce(nullif(name_unicode, ''), nullif(layer_name, ''), '') AS name FROM L WHERE layer_type <> 'HIDDEN')
    SELECT path, idx, name, coalesce(nullif(substring(regexp_replace(regexp_replace(name, '[^\\p{{L}}\\p{{N}}_\\-.+]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), ''), 'layer') AS safe FROM N""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    n = _layers(spark, d).where("layer_type <> 'HIDDEN'").select("path", "idx", layers.display_name().alias("name"))
    return n.withColumn("safe", layers.safe_name(F.col("name")))


@query(f"WITH {_L} SELECT path, idx, sheet_color, {_case(dict(enumerate(layers.LABELS)), 'sheet_color', 'unknown')} AS label FROM L")
def sheet_colors(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).select("path", "idx", "sheet_color", layers.label(F.col("sheet_color")).alias("label"))


@query(f"SELECT path, min(mode) AS mode, {_case(layers.COLOR_MODES, 'min(mode)', 'unknown')} AS mode_name, min(depth) AS depth FROM psd_headers WHERE path IS NOT NULL GROUP BY path")
def color_modes(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "psd_headers").where("path is not null").groupBy("path").agg(F.min("mode").alias("mode"), F.min("depth").alias("depth"))
    return h.withColumn("mode_name", layers.lookup(layers.COLOR_MODES, F.col("mode"), F.lit("unknown")))


@query("""WITH C AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 7 AS INTEGER) - 3 AS ch_id FROM lineitem)
    SELECT l_orderkey, l_linenumber, ch_id, ch_id IN (-2, -3) AS is_mask FROM C""")
def mask_channels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 7).cast("int").alias("ch_id"))
    return c.withColumn("ch_id", F.col("ch_id") - 3).withColumn("is_mask", F.col("ch_id").isin(-2, -3))


@query("""SELECT path, min(version) AS version, min(channels) AS channels, min(height) AS height, min(width) AS width, min(depth) AS depth, min(mode) AS mode, bool_or(merged_alpha) AS merged_alpha, min(last_applied_comp) AS last_applied_comp FROM psd_headers WHERE path IS NOT NULL GROUP BY path""")
def header_attributes(spark: SparkSession, d: str) -> DataFrame:
    cols = ("version", "channels", "height", "width", "depth", "mode")
    return table(spark, d, "psd_headers").where("path is not null").groupBy("path").agg(*[F.min(c).alias(c) for c in cols], F.bool_or("merged_alpha").alias("merged_alpha"), F.min("last_applied_comp").alias("last_applied_comp"))


@query(f"WITH {_L} SELECT path, idx, layer_type, layer_type = 'FOLDER' AS is_group, layer_id, opacity, fill_opacity, clipping, rect_right - rect_left AS width, rect_bottom - rect_top AS height, mask IS NOT NULL AS has_mask FROM L")
def layer_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).select("path", "idx", "layer_type", (F.col("layer_type") == "FOLDER").alias("is_group"), "layer_id", "opacity", "fill_opacity", "clipping", layers.width().alias("width"), layers.height().alias("height"), F.col("mask").isNotNull().alias("has_mask"))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS number, CAST(l_partkey % 65536 - CASE WHEN l_partkey % 65536 >= 32768 THEN 65536 ELSE 0 END AS BIGINT) AS low_signed, CAST((4 - l_partkey % 4) % 4 AS BIGINT) AS padding, CASE WHEN l_partkey > 0 THEN l_partkey / 65536.0e0 ELSE 72.0e0 END AS fixed FROM lineitem")
def byte_numbers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.unhex(F.lpad(F.hex("l_partkey"), 8, "0"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", metadata.big_endian(raw, 0, 4).alias("number"), metadata.big_endian(raw, 2, 2, signed=True).alias("low_signed"),
        metadata.padding(F.col("l_partkey"), 4).cast("bigint").alias("padding"), metadata.fixed_to_dpi(F.col("l_partkey")).alias("fixed"),
    )


# ---------------------------------------------------------------------------------------------------------------- trees


@query(f"WITH RECURSIVE {_TREE} SELECT path, idx, parent FROM S")
def tree_parent(spark: SparkSession, d: str) -> DataFrame:
    return tree.parents(_layers(spark, d).select("path", "idx", "layer_type")).select("path", "idx", "parent")


@query(f"WITH RECURSIVE {_TREE} SELECT path, idx, depth FROM S")
def tree_depth(spark: SparkSession, d: str) -> DataFrame:
    return tree.parents(_layers(spark, d).select("path", "idx", "layer_type")).select("path", "idx", "depth")


@query(f"WITH RECURSIVE {_TREE} SELECT S.path, parent, count(*) AS n, min(S.idx) AS first, max(S.idx) AS last, list(S.idx ORDER BY S.idx) AS children FROM S JOIN L USING (path, idx) WHERE layer_type <> 'HIDDEN' GROUP BY S.path, parent")
def tree_children(spark: SparkSession, d: str) -> DataFrame:
    return tree.children(tree.parents(_layers(spark, d).select("path", "idx", "layer_type")))


@query(f"WITH {_L}, {_SPAN} SELECT path, idx, start, CAST(\"count\" AS INTEGER) AS count FROM G")
def group_span(spark: SparkSession, d: str) -> DataFrame:
    return tree.spans(_layers(spark, d).select("path", "idx", "layer_type")).select("path", "idx", "start", "count")


@query(f"WITH {_L} SELECT path, bool_or(layer_type = 'FOLDER') AS has_folder, count(*) FILTER (WHERE layer_type = 'FOLDER') AS n_folders, count(*) FILTER (WHERE layer_type = 'HIDDEN') AS n_dividers FROM L GROUP BY path")
def folder_presence(spark: SparkSession, d: str) -> DataFrame:
    folder, divider = F.col("layer_type") == "FOLDER", F.col("layer_type") == "HIDDEN"
    return _layers(spark, d).groupBy("path").agg(F.bool_or(folder).alias("has_folder"), F.count_if(folder).alias("n_folders"), F.count_if(divider).alias("n_dividers"))


@query("""WITH B AS (SELECT path, idx, leaf_id, CASE WHEN block IN ('SoCo', 'GdFl', 'PtFl') THEN 'FILL' WHEN block = 'TySh' THEN 'TEXT' END AS kind FROM (SELECT DISTINCT leaf_id, path, idx, block FROM descriptor_leaves))
    SELECT path, idx, coalesce(arg_max(kind, leaf_id) FILTER (kind IS NOT NULL), 'NORMAL') AS layer_type FROM B GROUP BY path, idx""")
def type_last_block_wins(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "descriptor_leaves").select("leaf_id", "path", "idx", "block").distinct()
    return layers.type_from_blocks(b, ["path", "idx"], "leaf_id", "block")


# ---------------------------------------------------------------------------------------------------------------- edits

_RANK = "CAST(row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS INTEGER) AS idx"
_EDITED = ["path", "idx", "layer_id", "layer_type", "name_unicode"]


@query(f"WITH {_L}, E AS (SELECT *, idx AS k FROM L WHERE NOT coalesce(opacity = 0 OR layer_id % 5 = 0, false)) SELECT path, {_RANK}, layer_id, layer_type, name_unicode FROM E")
def edit_delete(spark: SparkSession, d: str) -> DataFrame:
    return edits.delete(_layers(spark, d), (F.col("opacity") == 0) | (F.col("layer_id") % 5 == 0)).select(*_EDITED)


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """Layers counted from 0 without the gaps that lost rows leave."""
    return edits.delete(_layers(spark, d), F.lit(False))


_D = "D AS (SELECT path, layer_id, layer_type, name_unicode, opacity, flag, CAST(row_number() OVER (PARTITION BY path ORDER BY idx) - 1 AS INTEGER) AS idx FROM L), Z AS (SELECT path, max(idx) + 1 AS n FROM D GROUP BY path)"


@query(f"WITH {_L}, {_D}, E AS (SELECT D.*, n // 3 AS a, n - 1 AS b FROM D JOIN Z USING (path)) SELECT path, CAST(CASE WHEN idx = a THEN b WHEN idx > a AND idx <= b THEN idx - 1 ELSE idx END AS INTEGER) AS idx, layer_id, layer_type, name_unicode FROM E")
def edit_move(spark: SparkSession, d: str) -> DataFrame:
    l = _dense(spark, d)
    at = l.groupBy("path").agg((F.max("idx") + 1).alias("n")).select("path", F.expr("cast(n div 3 as int)").alias("from"), (F.col("n") - 1).alias("to"))
    return edits.move(l, at).select(*_EDITED)


@query(f"""WITH {_L}, {_D}, E AS (SELECT D.*, n // 4 AS a, n // 4 AS c, n FROM D JOIN Z USING (path))
    SELECT path, CAST(CASE WHEN c = 0 THEN idx WHEN idx >= a AND idx < a + c THEN idx - a + n - c WHEN idx >= a + c THEN idx - c ELSE idx END AS INTEGER) AS idx, layer_id, layer_type, name_unicode FROM E""")
def edit_move_range(spark: SparkSession, d: str) -> DataFrame:
    l = _dense(spark, d)
    at = l.groupBy("path").agg((F.max("idx") + 1).alias("to")).select("path", F.expr("cast(to div 4 as int)").alias("from"), F.expr("cast(to div 4 as int)").alias("count"), "to")
    return edits.move_range(l, at).select(*_EDITED)


@query(f"""WITH RECURSIVE {_TREE}, {_SPAN}, G2 AS (SELECT G.*, S.parent FROM G JOIN S USING (path, idx) WHERE layer_type <> 'HIDDEN'),
    U AS (SELECT *, min(idx) OVER (PARTITION BY path, parent ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS up FROM G2),
    A AS (SELECT path, min(idx) AS idx FROM L WHERE layer_type = 'FOLDER' GROUP BY path),
    M AS (SELECT U.path, U.start AS a, U."count" AS c, U.up + 1 AS t FROM U JOIN A USING (path, idx) WHERE U.up IS NOT NULL)
    SELECT L.path, CAST(CASE WHEN a IS NULL OR t <= a + c OR t > (SELECT max(x.idx) + 1 FROM L x WHERE x.path = L.path) THEN L.idx WHEN L.idx >= a AND L.idx < a + c THEN L.idx - a + t - c WHEN L.idx >= a + c AND L.idx < t THEN L.idx - c ELSE L.idx END AS INTEGER) AS idx,
           layer_id, layer_type, name_unicode FROM L LEFT JOIN M USING (path)""")
def edit_sibling_swap(spark: SparkSession, d: str) -> DataFrame:
    l = _layers(spark, d)
    narrow = l.select("path", "idx", "layer_type")
    t = tree.parents(narrow).join(tree.spans(narrow).select("path", "idx", "start", "count"), ["path", "idx"])
    at = narrow.where("layer_type = 'FOLDER'").groupBy("path").agg(F.min("idx").alias("idx"))
    return edits.swap_sibling(l, t, at).select(*_EDITED)


@query(f"""WITH {_L}, A AS (SELECT path, min(idx) AS idx FROM L WHERE layer_type = 'TEXT' GROUP BY path), N AS (SELECT path, greatest(coalesce(max(layer_id), 0), 0) + 1 AS next_id FROM L GROUP BY path),
    E AS (SELECT path, idx * 4 AS k, layer_id, layer_type, name_unicode FROM L UNION ALL SELECT L.path, L.idx * 4 + 1, next_id, layer_type, name_unicode FROM L JOIN A USING (path, idx) JOIN N USING (path))
    SELECT path, {_RANK}, layer_id, layer_type, name_unicode FROM E""")
def edit_duplicate(spark: SparkSession, d: str) -> DataFrame:
    l = _layers(spark, d)
    return edits.duplicate(l, l.where("layer_type = 'TEXT'").groupBy("path").agg(F.min("idx").alias("idx"))).select(*_EDITED)


@query(f"""WITH {_L}, {_D}, Q AS (SELECT path, lead(path) OVER (ORDER BY path) AS src FROM (SELECT DISTINCT path FROM D)), N AS (SELECT path, greatest(coalesce(max(layer_id), 0), 0) + 1 AS next_id FROM D GROUP BY path),
    E AS (SELECT path, idx * 4 AS k, layer_id, layer_type, name_unicode FROM D UNION ALL SELECT Q.path, 2 * 4 - 1 + CASE WHEN n < 2 THEN (n - 2) * 4 ELSE 0 END, next_id, D.layer_type, D.name_unicode FROM Q JOIN D ON D.path = Q.src AND D.idx = 0 JOIN N ON N.path = Q.path JOIN Z ON Z.path = Q.path)
    SELECT path, {_RANK}, layer_id, layer_type, name_unicode FROM E""")
def edit_copy_across(spark: SparkSession, d: str) -> DataFrame:
    l = _dense(spark, d)
    paths = l.select("path").distinct()
    # the next document by path: sorted in ranges, so that no task sees all of them
    pairs = _next_of(paths, "path", "src").select("src", F.lit(0).alias("idx"), "path", F.lit(2).alias("dest"))
    return edits.copy_across(l, pairs).select(*_EDITED)


def _next_of(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): each value with the next one in order, by ranges of the sorted values."""
    from pyspark.sql.window import Window

    ranged = df.repartitionByRange(F.col(column)).withColumn("_p", F.spark_partition_id())
    heads = ranged.groupBy("_p").agg(F.min(column).alias("_head")).withColumn("_next", F.lead("_head").over(Window.orderBy("_p")))  # one row per range
    w = Window.partitionBy("_p").orderBy(column)
    return ranged.withColumn(name, F.lead(column).over(w)).join(heads, "_p").select(column, F.coalesce(name, "_next").alias(name)).where(F.col(name).isNotNull())


@query(f"""WITH RECURSIVE {_L}, {_D}, N AS (SELECT path, greatest(coalesce(max(layer_id), 0), 0) + 1 AS next_id FROM D GROUP BY path),
    E AS (SELECT path, idx * 4 AS k, layer_id, layer_type, name_unicode FROM D UNION ALL SELECT path, 1 * 4 - 2, next_id, 'HIDDEN', '</Layer group>' FROM N UNION ALL SELECT path, 3 * 4 - 1, next_id + 1, 'FOLDER', 'folder' FROM N),
    R AS (SELECT path, {_RANK}, layer_id, layer_type, name_unicode FROM E),
    K AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx DESC) AS k FROM R),
    S AS (SELECT path, idx, k, CAST(-1 AS INTEGER) AS parent, CASE WHEN layer_type = 'FOLDER' THEN [idx] ELSE CAST([] AS INTEGER[]) END AS st FROM K WHERE k = 1
          UNION ALL SELECT K.path, K.idx, K.k, coalesce(S.st[-1], -1), CASE K.layer_type WHEN 'FOLDER' THEN list_append(S.st, K.idx) WHEN 'HIDDEN' THEN S.st[:-2] ELSE S.st END FROM S JOIN K ON K.path = S.path AND K.k = S.k + 1)
    SELECT path, idx, layer_id, layer_type, name_unicode, parent FROM R JOIN S USING (path, idx)""")
def edit_add_folder(spark: SparkSession, d: str) -> DataFrame:
    l = _dense(spark, d)
    at = l.select("path").distinct().select("path", F.lit(1).alias("first"), F.lit(2).alias("count"), F.lit("folder").alias("name"))
    new = edits.add_folder(l, at).select(*_EDITED)
    return new.join(tree.parents(new).select("path", "idx", "parent"), ["path", "idx"]).select(*_EDITED, "parent")


@query(f"""WITH {_L}, {_D}, E AS (SELECT path, idx * 4 AS k, layer_id, layer_type, name_unicode FROM D UNION ALL SELECT path, 4 - 1, CAST(NULL AS INTEGER), 'NORMAL', 'new' FROM Z)
    SELECT path, {_RANK}, layer_id, layer_type, name_unicode FROM E""")
def edit_add_layer(spark: SparkSession, d: str) -> DataFrame:
    l = _dense(spark, d)
    new = l.select("path").distinct().select("path", F.lit(1).alias("idx"), F.lit("NORMAL").alias("layer_type"), F.lit("new").alias("name_unicode"))
    return edits.add_layers(l, new).select(*_EDITED)


@query(f"""WITH {_L} SELECT path, idx, least(greatest(CASE WHEN layer_type = 'TEXT' THEN opacity * 2 ELSE opacity END, CASE WHEN layer_type = 'TEXT' THEN 0 ELSE opacity END), CASE WHEN layer_type = 'TEXT' THEN 255 ELSE opacity END) AS opacity,
    CASE WHEN layer_type = 'TEXT' THEN least(greatest(fill_opacity - 100, 0), 255) ELSE fill_opacity END AS fill_opacity, CASE WHEN layer_type = 'TEXT' THEN 'mul ' ELSE blend_key END AS blend_key, CASE WHEN layer_type = 'TEXT' THEN flag | 2 ELSE flag END AS flag FROM L""")
def edit_params(spark: SparkSession, d: str) -> DataFrame:
    e = edits.set_columns(_layers(spark, d), F.col("layer_type") == "TEXT", opacity=F.col("opacity") * 2, fill_opacity=F.col("fill_opacity") - 100, blend_key=F.lit("mul "), flag=F.col("flag").bitwiseOR(F.lit(2)))
    return e.select("path", "idx", "opacity", "fill_opacity", "blend_key", "flag")


@query(f"WITH {_L} SELECT path, idx, name_unicode || ' copy' AS name_unicode, name_unicode || ' copy' AS layer_name FROM L WHERE layer_type = 'FOLDER'")
def edit_rename(spark: SparkSession, d: str) -> DataFrame:
    l, new = _layers(spark, d), F.concat("name_unicode", F.lit(" copy"))
    return edits.set_columns(l, F.col("layer_type") == "FOLDER", layer_name=new, name_unicode=new).where("layer_type = 'FOLDER'").select("path", "idx", "name_unicode", "layer_name")


@query(f"WITH {_L} SELECT path, idx, CASE WHEN idx % 2 = 0 THEN mask.flags | 2 ELSE mask.flags & ~2 END AS flags, 128 AS default_color, mask.rect_top AS rect_top FROM L WHERE mask IS NOT NULL")
def mask_edit(spark: SparkSession, d: str) -> DataFrame:
    m = edits.set_mask(_layers(spark, d), disabled=F.col("idx") % 2 == 0, default_color=F.lit(128)).where("mask is not null")
    return m.select("path", "idx", "mask.flags", "mask.default_color", "mask.rect_top")


@query("""WITH B AS (SELECT DISTINCT leaf_id, block, coalesce(v_string, '') AS v FROM descriptor_leaves WHERE leaf_id % 3 <> 2), N AS (SELECT DISTINCT leaf_id, block, CASE WHEN leaf_id % 2 = 0 THEN 'new' END AS v FROM descriptor_leaves WHERE leaf_id % 3 <> 0)
    SELECT leaf_id, block, CASE WHEN N.leaf_id IS NOT NULL THEN N.v ELSE B.v END AS v FROM B FULL JOIN N USING (leaf_id, block) WHERE N.leaf_id IS NULL OR N.v IS NOT NULL""")
def block_replace(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "descriptor_leaves")
    old = t.where("leaf_id % 3 <> 2").select("leaf_id", "block", F.coalesce("v_string", F.lit("")).alias("v")).distinct()
    new = t.where("leaf_id % 3 <> 0").select("leaf_id", "block", F.when(F.col("leaf_id") % 2 == 0, "new").alias("v")).distinct()
    return edits.replace_blocks(old, new, ["leaf_id", "block"], "v")


# --------------------------------------------------------------------------------------------------------------- pixels

_PX = "X AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 256 AS INTEGER) AS c, CAST(l_suppkey * 37 % 256 AS INTEGER) AS m, CAST(l_quantity AS INTEGER) * 5 AS y, CAST((l_partkey * 31 + l_linenumber) % 256 AS INTEGER) AS k, CAST(l_suppkey * 53 % 256 AS INTEGER) AS a FROM lineitem)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).cast("int").alias("c"), (F.col("l_suppkey") * 37 % 256).cast("int").alias("m"), (F.col("l_quantity").cast("int") * 5).alias("y"),
        ((F.col("l_partkey") * 31 + F.col("l_linenumber")) % 256).cast("int").alias("k"), (F.col("l_suppkey") * 53 % 256).cast("int").alias("a"),
    )


@query(f"WITH {_PX} SELECT l_orderkey, l_linenumber, (c * k) >> 8 AS r, (m * k) >> 8 AS g, (y * k) >> 8 AS b FROM X")
def cmyk_to_rgb(spark: SparkSession, d: str) -> DataFrame:
    r, g, b = pixels.cmyk_to_rgb(*map(F.col, "cmyk"))
    return _pixels(spark, d).select("l_orderkey", "l_linenumber", r.alias("r"), g.alias("g"), b.alias("b"))


def _lab_sql() -> str:
    inv = lambda t, w: f"(CASE WHEN {t} * {t} * {t} > 0.008856e0 THEN {t} * {t} * {t} ELSE ({t} - 16.0e0 / 116.0e0) / 7.787e0 END) * {w}e0"
    rows = [" + ".join(f"{m}e0 * {x}" for m, x in zip(row, ("X_", "Y_", "Z_"))) for row in pixels.XYZ_TO_RGB]
    out = lambda v: f"CAST(floor(least(greatest(CASE WHEN {v} > 0.0031308e0 THEN 1.055e0 * pow(greatest({v}, 0.0031308e0), 1 / 2.4e0) - 0.055e0 ELSE 12.92e0 * {v} END, 0.0e0), 1.0e0) * 255.0e0 + 0.5e0) AS INTEGER)"
    return f"""WITH {_PX}, F AS (SELECT *, (c / 255.0e0 * 100.0e0 + 16.0e0) / 116.0e0 AS fy FROM X), F2 AS (SELECT *, (m - 128.0e0) / 500.0e0 + fy AS fx, fy - (y - 128.0e0) / 200.0e0 AS fz FROM F),
        G AS (SELECT *, {inv('fx', pixels.WHITE[0])} AS X_, {inv('fy', pixels.WHITE[1])} AS Y_, {inv('fz', pixels.WHITE[2])} AS Z_ FROM F2), H AS (SELECT *, {rows[0]} AS lr, {rows[1]} AS lg, {rows[2]} AS lb FROM G)
        SELECT l_orderkey, l_linenumber, {out('lr')} AS r, {out('lg')} AS g, {out('lb')} AS b FROM H"""


@query(_lab_sql())
def lab_to_rgb(spark: SparkSession, d: str) -> DataFrame:
    r, g, b = pixels.lab_to_rgb(*map(F.col, "cmy"))
    return _pixels(spark, d).select("l_orderkey", "l_linenumber", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"WITH {_PX} SELECT l_orderkey, l_linenumber, c AS r, c AS g, c AS b, (c * 257) >> 8 AS from16, CAST(floor(least(greatest(c / 200.0e0, 0), 1) * 255 + 0.5) AS INTEGER) AS from32 FROM X")
def gray_duotone(spark: SparkSession, d: str) -> DataFrame:
    r, g, b = pixels.gray(F.col("c"))
    return _pixels(spark, d).select("l_orderkey", "l_linenumber", r.alias("r"), g.alias("g"), b.alias("b"), pixels.high_byte(F.col("c") * 257).alias("from16"), pixels.float_sample(F.col("c") / 200.0).alias("from32"))


@query(f"WITH {_PX} SELECT l_orderkey, l_linenumber, x, CASE WHEN (c >> (7 - x)) & 1 = 1 THEN 0 ELSE 255 END AS v FROM X, (SELECT CAST(unnest(range(8)) AS INTEGER) AS x)")
def bitmap_bits(spark: SparkSession, d: str) -> DataFrame:
    e = _pixels(spark, d).select("l_orderkey", "l_linenumber", "c", F.explode(F.array(*map(F.lit, range(8)))).alias("x"))
    return e.select("l_orderkey", "l_linenumber", "x", pixels.bitmap(F.col("c"), F.col("x")).alias("v"))


@query(f"""WITH {_PX}, P AS (SELECT n, arg_min(p_size * 5, p_partkey) AS r, arg_min(CAST(p_partkey * 7 % 256 AS INTEGER), p_partkey) AS g, arg_min(CAST(p_partkey * 13 % 256 AS INTEGER), p_partkey) AS b FROM (SELECT *, CAST(p_partkey % 256 AS INTEGER) AS n FROM part) GROUP BY n)
    SELECT l_orderkey, l_linenumber, c AS color, r, g, b, CASE WHEN c = 17 THEN 0 ELSE 255 END AS a FROM X LEFT JOIN P ON P.n = X.c""")
def indexed_palette(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = F.struct(k, (F.col("p_size") * 5).alias("r"), (k * 7 % 256).cast("int").alias("g"), (k * 13 % 256).cast("int").alias("b"))
    palette = table(spark, d, "part").groupBy((k % 256).cast("int").alias("color")).agg(F.min(rows).alias("p")).select("color", "p.r", "p.g", "p.b")
    # a palette has at most 256 entries
    return _pixels(spark, d).select("l_orderkey", "l_linenumber", F.col("c").alias("color")).join(bounded(palette), "color", "left").withColumn("a", F.when(F.col("color") == 17, 0).otherwise(255))


@query(f"""WITH {_PX} SELECT l_orderkey, l_linenumber, CASE WHEN c % 64 >= 5 AND c % 64 < 45 AND m % 48 >= 3 AND m % 48 < 35 THEN (a * k) // 255 WHEN l_linenumber % 2 = 0 THEN 0 ELSE a END AS a FROM X""")
def mask_to_alpha(spark: SparkSession, d: str) -> DataFrame:
    hit = pixels.inside(F.col("c") % 64, F.col("m") % 48, F.lit(3), F.lit(5), F.lit(35), F.lit(45))
    default = F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(255)
    return _pixels(spark, d).select("l_orderkey", "l_linenumber", pixels.mask_alpha(F.col("a"), F.col("k"), hit, default).alias("a"))


@query(f"WITH {_PX} SELECT l_orderkey, l_linenumber, (a * k) // 255 AS a FROM X")
def opacity_fold(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("l_orderkey", "l_linenumber", pixels.fold_opacity(F.col("a"), F.col("k")).alias("a"))


@query(f"""WITH {_L}, H AS (SELECT path, min(width) AS w, min(height) AS h FROM psd_headers GROUP BY path), R AS (SELECT L.path, idx, greatest(rect_top, 0) AS t, greatest(rect_left, 0) AS l, rect_bottom, rect_right, h, w FROM L JOIN H USING (path))
    SELECT path, idx, t AS top, l AS "left", greatest(least(rect_bottom, h), t) AS bottom, greatest(least(rect_right, w), l) AS "right" FROM R""")
def rect_clip(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "psd_headers").where("path is not null").groupBy("path").agg(F.min("width").alias("w"), F.min("height").alias("h"))
    r = layers.clip_to(*[F.col(f"rect_{c}") for c in ("top", "left", "bottom", "right")], F.col("h"), F.col("w"))
    return _layers(spark, d).join(h, "path").select("path", "idx", *[c.alias(n) for c, n in zip(r, ("top", "left", "bottom", "right"))])


@query(f"""WITH {_L}, R AS (SELECT path, idx, greatest(rect_top, mask.rect_top) AS t, greatest(rect_left, mask.rect_left) AS l, least(rect_bottom, mask.rect_bottom) AS b, least(rect_right, mask.rect_right) AS r FROM L WHERE mask IS NOT NULL)
    SELECT path, idx, t AS top, l AS "left", b AS bottom, r AS "right", CAST(b - t AS BIGINT) * (r - l) AS area FROM R WHERE b > t AND r > l""")
def mask_overlap(spark: SparkSession, d: str) -> DataFrame:
    m = _layers(spark, d).where("mask is not null")
    g = m.select("path", "idx", *[(F.greatest if c in ("top", "left") else F.least)(f"rect_{c}", f"mask.rect_{c}").alias(c) for c in ("top", "left", "bottom", "right")])
    return g.where("bottom > top and right > left").withColumn("area", F.expr("cast(bottom - top as bigint) * (right - left)"))


@query("""WITH RECURSIVE V AS (SELECT l_orderkey, l_linenumber, (l_partkey % 256) / 255.0e0 AS r, (l_suppkey * 37 % 256) / 255.0e0 AS g, ((l_partkey * 31 + l_linenumber) % 256) / 255.0e0 AS b, (l_suppkey * 53 % 256) / 255.0e0 AS a FROM lineitem),
    P AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, r * a, g * a, b * a, a) AS k FROM V),
    O AS (SELECT l_orderkey, k, r * a AS r, g * a AS g, b * a AS b, a FROM P WHERE k = 1 UNION ALL SELECT P.l_orderkey, P.k, P.r * P.a + O.r * (1 - P.a), P.g * P.a + O.g * (1 - P.a), P.b * P.a + O.b * (1 - P.a), P.a + O.a * (1 - P.a) FROM O JOIN P ON P.l_orderkey = O.l_orderkey AND P.k = O.k + 1),
    W AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC) AS n FROM O)
    SELECT l_orderkey, CASE WHEN a > 0 THEN CAST(floor(least(r / a, 1) * 255 + 0.5 + 1e-9) AS INTEGER) ELSE 0 END AS r, CASE WHEN a > 0 THEN CAST(floor(least(g / a, 1) * 255 + 0.5 + 1e-9) AS INTEGER) ELSE 0 END AS g, CASE WHEN a > 0 THEN CAST(floor(least(b / a, 1) * 255 + 0.5 + 1e-9) AS INTEGER) ELSE 0 END AS b, CAST(floor(a * 255 + 0.5 + 1e-9) AS INTEGER) AS a FROM W WHERE n = 1""")
def source_over(spark: SparkSession, d: str) -> DataFrame:
    p = _pixels(spark, d).select("l_orderkey", "l_linenumber", F.col("c").alias("r"), F.col("m").alias("g"), F.col("k").alias("b"), "a")
    return pixels.source_over(p, ["l_orderkey"], "l_linenumber")


_BYTES = "Y AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(floor((unnest(embedding) + 1) * 128) AS INTEGER) AS byte FROM embeddings)"


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    return e.select("vec_id", "pos", F.floor((F.col("e") + 1) * 128).cast("int").alias("byte"))


_RUNS = f"{_BYTES}, V AS (SELECT vec_id, pos, byte // 32 AS v FROM Y), B AS (SELECT *, pos - row_number() OVER (PARTITION BY vec_id, v ORDER BY pos) AS g FROM V), U AS (SELECT vec_id, v AS value, min(pos) AS start, count(*) AS length FROM B GROUP BY vec_id, v, g)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return pixels.byte_runs(_bytes(spark, d).select("vec_id", "pos", F.expr("cast(byte div 32 as int)").alias("v")), "vec_id", "pos", "v")


@query(f"WITH {_RUNS} SELECT vec_id, start, length, value FROM U")
def packbits_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


@query(f"""WITH {_RUNS}, W AS (SELECT *, length = 1 AS lit, sum(CASE WHEN length > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY start) AS g FROM U),
    P AS (SELECT vec_id, g, count(*) + ceil(count(*) / 128.0) AS s FROM W WHERE lit GROUP BY vec_id, g UNION ALL SELECT vec_id, -start, (length // 128) * 2 + CASE WHEN length % 128 > 0 THEN 2 ELSE 0 END FROM W WHERE NOT lit)
    SELECT vec_id, CAST(sum(s) AS BIGINT) AS size FROM P GROUP BY vec_id""")
def packbits_size(spark: SparkSession, d: str) -> DataFrame:
    return pixels.packbits_size(_runs(spark, d), "vec_id")


@query(f"WITH {_BYTES} SELECT vec_id, pos, CAST(sum(byte) OVER (PARTITION BY vec_id ORDER BY pos) % 256 AS INTEGER) AS sample FROM Y")
def predict_decode(spark: SparkSession, d: str) -> DataFrame:
    return pixels.undo_prediction(_bytes(spark, d), "vec_id", "pos", "byte").select("vec_id", "pos", "sample")


@query(f"WITH {_L} SELECT path, idx, greatest(rect_right - rect_left, 0)::BIGINT * greatest(rect_bottom - rect_top, 0) * 4 AS length, CAST(coalesce(sum(greatest(rect_right - rect_left, 0)::BIGINT * greatest(rect_bottom - rect_top, 0) * 4) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM L")
def channel_offsets(spark: SparkSession, d: str) -> DataFrame:
    size = F.greatest(layers.width(), F.lit(0)).cast("bigint") * F.greatest(layers.height(), F.lit(0)) * 4
    l = _layers(spark, d).select("path", "idx", size.alias("length"))
    return running(l, ["path"], F.col("idx"), inclusive=False, offset=("sum", F.col("length")))


@query(f"""WITH {_PX}, P AS (SELECT l_orderkey, l_linenumber % 3 AS x, l_linenumber // 3 AS y, c AS r, m AS g, k AS b, CASE WHEN a < 100 THEN 0 ELSE a END AS a FROM X), S AS (SELECT * FROM P WHERE a > 0),
    N AS (SELECT P.l_orderkey, P.x, P.y, CAST(floor(avg(S.r)) AS INTEGER) AS r, CAST(floor(avg(S.g)) AS INTEGER) AS g, CAST(floor(avg(S.b)) AS INTEGER) AS b FROM P JOIN S ON S.l_orderkey = P.l_orderkey AND abs(S.x - P.x) + abs(S.y - P.y) = 1 GROUP BY P.l_orderkey, P.x, P.y)
    SELECT P.l_orderkey, P.x, P.y, CASE WHEN P.a = 0 AND N.r IS NOT NULL THEN N.r ELSE P.r END AS r, CASE WHEN P.a = 0 AND N.r IS NOT NULL THEN N.g ELSE P.g END AS g, CASE WHEN P.a = 0 AND N.r IS NOT NULL THEN N.b ELSE P.b END AS b, P.a, P.a = 0 AND N.r IS NOT NULL AS filled FROM P LEFT JOIN N USING (l_orderkey, x, y)""")
def alpha_bleed_pass(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    p = _pixels(spark, d).select("l_orderkey", (n % 3).alias("x"), F.expr("cast(l_linenumber div 3 as int)").alias("y"), F.col("c").alias("r"), F.col("m").alias("g"), F.col("k").alias("b"), F.when(F.col("a") < 100, 0).otherwise(F.col("a")).alias("a"))
    return pixels.bleed_pass(p, ["l_orderkey"])


# ----------------------------------------------------------------------------------------------------------------- text

_U16 = "(length({0}) + len(list_filter(string_split({0}, ''), lambda x: unicode(x) > 65535)))"


@query(f"WITH {_T} SELECT path, idx, CAST({_U16.format('text')} AS INTEGER) AS units FROM T WHERE text IS NOT NULL AND text <> ''")
def utf16_length(spark: SparkSession, d: str) -> DataFrame:
    return _text(spark, d).where("text <> ''").select("path", "idx", text.utf16_length(F.col("text")).alias("units"))


@query(f"WITH {_T} SELECT path, idx, CASE WHEN ends_with(text, chr(13)) THEN text ELSE text || chr(13) END AS text, text AS again FROM T WHERE text IS NOT NULL")
def text_encoding(spark: SparkSession, d: str) -> DataFrame:
    again = metadata.utf16_to_utf8(metadata.utf8_to_utf16(F.col("text")))
    return _text(spark, d).where("text is not null").select("path", "idx", text.without_nul(text.ended(F.col("text"))).alias("text"), again.alias("again"))


@query(f"""WITH {_T}, E AS (SELECT path, idx, CASE WHEN ends_with(text, chr(13)) THEN text[:-2] ELSE text END AS t FROM T WHERE text IS NOT NULL),
    P AS (SELECT path, idx, CAST(unnest(range(len(string_split(t, chr(13))))) AS INTEGER) AS para, unnest(string_split(t, chr(13))) AS body FROM E)
    SELECT path, idx, para, body, CAST(CASE WHEN body = '' THEN 0 ELSE {_U16.format('body')} END + 1 AS INTEGER) AS length FROM P""")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return text.paragraphs(_text(spark, d), ["path", "idx"])


@query(f"""WITH {_T}, R AS (SELECT path, idx, run, min(length) AS length FROM text_runs GROUP BY path, idx, run), W AS (SELECT path, idx, CASE WHEN text = '' THEN 0 ELSE {_U16.format('text')} END + CASE WHEN ends_with(text, chr(13)) THEN 0 ELSE 1 END AS total FROM T WHERE text IS NOT NULL),
    E AS (SELECT R.*, total, sum(length) OVER (PARTITION BY path, idx ORDER BY run) AS e, max(run) OVER (PARTITION BY path, idx) AS last FROM R JOIN W USING (path, idx)), F AS (SELECT *, least(e - length, total) AS start FROM E)
    SELECT path, idx, run, CAST(CASE WHEN run = last THEN total ELSE least(e, total) END - start AS INTEGER) AS length, CAST(start AS INTEGER) AS start, CAST(total AS INTEGER) AS total FROM F""")
def run_fit_lengths(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "text_runs").groupBy("path", "idx", "run").agg(F.min("length").alias("length"))
    return text.fit_lengths(runs, _text(spark, d), ["path", "idx"])


@query("""WITH R AS (SELECT path, idx, run, min(length) AS length FROM text_runs GROUP BY path, idx, run)
    SELECT path, idx, CAST(run % 30 AS INTEGER) AS font_no, count(*) AS n, coalesce(min(n_name), 'default') AS font_name FROM R LEFT JOIN nation ON n_nationkey = run % 30 GROUP BY path, idx, run % 30""")
def font_resolve(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "text_runs").select("path", "idx", "run").distinct().withColumn("font_no", F.col("run") % 30)
    fonts = bounded(table(spark, d, "nation").select(F.col("n_nationkey").alias("font_no"), F.col("n_name").alias("font_name")))
    return text.resolve_fonts(runs, fonts, "default").groupBy("path", "idx", "font_no").agg(F.count("*").alias("n"), F.min("font_name").alias("font_name"))


@query("SELECT path, idx, list_sort(list(DISTINCT font)) AS fonts, CAST(count(DISTINCT font) AS INTEGER) AS n FROM text_runs WHERE font IS NOT NULL GROUP BY path, idx")
def fonts_per_layer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_runs").where("font is not null").groupBy("path", "idx").agg(F.array_sort(F.collect_set("font")).alias("fonts")).withColumn("n", F.size("fonts"))


@query("""WITH F AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY font) - 1 AS INTEGER) AS font_no, font FROM (SELECT DISTINCT path, font FROM text_runs WHERE font IS NOT NULL AND idx % 2 = 0)),
    W AS (SELECT DISTINCT path, font FROM text_runs r WHERE font IS NOT NULL AND NOT EXISTS (SELECT 1 FROM F WHERE F.path = r.path AND F.font = r.font)), M AS (SELECT path, max(font_no) AS top FROM F GROUP BY path)
    SELECT path, font_no, font FROM F UNION ALL SELECT W.path, CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY W.path ORDER BY font) AS INTEGER), font FROM W LEFT JOIN M ON M.path = W.path""")
def font_append(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    r = table(spark, d, "text_runs").where("font is not null")
    have = r.where("idx % 2 = 0").select("path", "font").distinct().withColumn("font_no", (F.row_number().over(Window.partitionBy("path").orderBy("font")) - 1).cast("int"))
    return text.append_fonts(have, r)


@query("""WITH R AS (SELECT path, idx, run, min(size_px) AS size FROM text_runs GROUP BY path, idx, run), H AS (SELECT path, min(vres) AS dpi FROM psd_headers GROUP BY path)
    SELECT path, idx, run, round(CASE WHEN run = 0 THEN size * coalesce(dpi, 72) / 72 ELSE size END, 6) AS size_px FROM R LEFT JOIN H USING (path)""")
def text_px_scale(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "text_runs").groupBy("path", "idx", "run").agg(F.min("size_px").alias("size"))
    h = table(spark, d, "psd_headers").where("path is not null").groupBy("path").agg(F.min("vres").alias("dpi"))
    return runs.join(h, "path", "left").select("path", "idx", "run", F.round(text.size_in_pixels(F.col("size"), F.coalesce("dpi", F.lit(72.0)), F.col("run") == 0), 6).alias("size_px"))


@query(f"""WITH {_L}, {_T} SELECT path, idx, round(tx + 12.5, 6) AS tx, round(ty - 7.5, 6) AS ty, rect_left + 13 AS rect_left, rect_top - 8 AS rect_top, mask.rect_left + 13 AS mask_left FROM L JOIN T USING (path, idx)""")
def text_move(spark: SparkSession, d: str) -> DataFrame:
    t = _layers(spark, d).join(_text(spark, d).select("path", "idx", "tx", "ty"), ["path", "idx"])
    m = edits.move_text(t, F.lit(12.5), F.lit(-7.5))
    return m.select("path", "idx", F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"), "rect_left", "rect_top", F.col("mask.rect_left").alias("mask_left"))


@query(f"""WITH {_L}, R AS (SELECT path, idx, least(greatest(rect_left, 50), 400) AS l, least(greatest(rect_top, 40), 300) AS t, rect_right, rect_bottom FROM L)
    SELECT path, idx, l AS "left", t AS top, greatest(least(rect_right, 400), l) AS "right", greatest(least(rect_bottom, 300), t) AS bottom FROM R""")
def bounds_clamp(spark: SparkSession, d: str) -> DataFrame:
    box = text.clamp_bounds(*[F.col(f"rect_{c}") for c in ("left", "top", "right", "bottom")], tuple(map(F.lit, (50, 40, 400, 300))))
    return _layers(spark, d).select("path", "idx", *[c.alias(n) for c, n in zip(box, ("left", "top", "right", "bottom"))])


@query(f"""WITH {_T}, R AS (SELECT path, idx, arg_min(coalesce(font, ''), run) AS font FROM text_runs GROUP BY path, idx)
    SELECT path, idx, 0 AS run, font, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {_U16.format('text')} END + CASE WHEN ends_with(coalesce(text, ''), chr(13)) THEN 0 ELSE 1 END AS INTEGER) AS length FROM R JOIN T USING (path, idx)""")
def text_replace(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "text_runs").select("path", "idx", "run", F.coalesce("font", F.lit("")).alias("font"), "length")
    return text.replace_text(runs, _text(spark, d), ["path", "idx"]).select("path", "idx", "run", "font", "length")


@query("""WITH R AS (SELECT path, idx, run, bool_or(bold) AS bold, min(size_px) AS size_px, min(tracking) AS tracking FROM text_runs GROUP BY path, idx, run)
    SELECT path, idx, run, CASE WHEN run = 0 THEN true ELSE bold END AS bold, CASE WHEN run = 0 THEN size_px * 2 ELSE size_px END AS size_px, CASE WHEN run = 0 THEN -100 ELSE tracking END AS tracking FROM R""")
def run_style_edit(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "text_runs").groupBy("path", "idx", "run").agg(F.bool_or("bold").alias("bold"), F.min("size_px").alias("size_px"), F.min("tracking").alias("tracking"))
    return edits.set_columns(r, F.col("run") == 0, bold=F.lit(True), size_px=F.col("size_px") * 2, tracking=F.lit(-100))


@query(f"WITH {_T} SELECT path, idx, CASE WHEN idx % 3 = 0 THEN 2 ELSE justification END AS justification FROM T")
def justification_edit(spark: SparkSession, d: str) -> DataFrame:
    return edits.set_columns(_text(spark, d).select("path", "idx", "justification"), F.col("idx") % 3 == 0, justification=F.lit(2))


@query(f"""WITH {_T}, B AS (SELECT path, text_index, text FROM T WHERE text_index IS NOT NULL) SELECT T.path, T.idx, T.text_index, count(B.text) AS n_bodies FROM T LEFT JOIN B ON B.path = T.path AND B.text_index = T.text_index GROUP BY T.path, T.idx, T.text_index""")
def text_index_join(spark: SparkSession, d: str) -> DataFrame:
    t = _text(spark, d).select("path", "idx", "text_index", "text")
    bodies = t.where("text_index is not null").groupBy("path", "text_index").agg(F.count("text").alias("n_bodies"))
    return t.drop("text").join(bodies, ["path", "text_index"], "left").select("path", "idx", "text_index", F.coalesce("n_bodies", F.lit(0)).alias("n_bodies"))


# ------------------------------------------------------------------------------------------------ descriptors and comps


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def descriptor_get(spark: SparkSession, d: str) -> DataFrame:
    v = F.parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query(f"SELECT leaf_id, min(unit) AS unit, {_case(layers.UNIT_NAMES, 'min(unit)')} AS unit_name FROM descriptor_leaves WHERE unit IS NOT NULL GROUP BY leaf_id")
def descriptor_units(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "descriptor_leaves").where("unit is not null").groupBy("leaf_id").agg(F.min("unit").alias("unit"))
    return u.withColumn("unit_name", layers.lookup(layers.UNIT_NAMES, F.col("unit")))


@query("""SELECT path, idx, coalesce(min(jpath) FILTER (block = 'SoCo'), min(jpath) FILTER (block = 'GdFl'), min(jpath) FILTER (block = 'PtFl')) AS fill, min(jpath) FILTER (block = 'lfx2') AS effect, list_sort(list(DISTINCT block)) AS keys FROM descriptor_leaves GROUP BY path, idx""")
def fill_priority(spark: SparkSession, d: str) -> DataFrame:
    first = lambda b: F.min(F.when(F.col("block") == b, F.col("jpath")))
    return table(spark, d, "descriptor_leaves").groupBy("path", "idx").agg(F.coalesce(*map(first, layers.FILL_KEYS)).alias("fill"), first("lfx2").alias("effect"), F.array_sort(F.collect_set("block")).alias("keys"))


_COMPS = "C AS (SELECT DISTINCT L.path, r_regionkey AS comp_id FROM L, region), ST AS (SELECT L.path, L.idx, comp_id, (L.idx + comp_id) % 2 = 0 AS enabled FROM L JOIN C USING (path) WHERE (L.idx + comp_id) % 4 = 0)"


def _comps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    l = _layers(spark, d).select("path", "idx", layers.visible(F.col("flag")).alias("visible"))
    ids = [r[0] for r in table(spark, d, "region").select("r_regionkey").distinct().orderBy(F.col("r_regionkey")).toLocalIterator()]
    each = F.explode(F.array(*map(F.lit, ids))).alias("comp_id")
    c = l.select("path").distinct().select("path", each)
    s = l.select("path", "idx", each).where("(idx + comp_id) % 4 = 0").withColumn("enabled", F.expr("(idx + comp_id) % 2 = 0"))
    return l, c, s


@query(f"WITH {_L}, {_COMPS} SELECT L.path, L.idx, C.comp_id, coalesce(enabled, (flag & 2) = 0) AS shown FROM L JOIN C USING (path) LEFT JOIN ST ON ST.path = L.path AND ST.idx = L.idx AND ST.comp_id = C.comp_id")
def comp_visibility(spark: SparkSession, d: str) -> DataFrame:
    return comps.visibility(*_comps(spark, d))


@query(f"""WITH {_L}, {_COMPS}, V AS (SELECT L.path, L.idx, C.comp_id, coalesce(enabled, (flag & 2) = 0) AS shown FROM L JOIN C USING (path) LEFT JOIN ST ON ST.path = L.path AND ST.idx = L.idx AND ST.comp_id = C.comp_id)
    SELECT L.path, L.idx, CASE WHEN EXISTS (SELECT 1 FROM V WHERE V.path = L.path AND V.idx = L.idx AND comp_id = 1 AND shown) THEN 'shown' ELSE 'hidden' END AS side FROM L""")
def comp_show_sets(spark: SparkSession, d: str) -> DataFrame:
    l, c, s = _comps(spark, d)
    show = comps.visibility(l, c.where("comp_id = 1"), s).where("shown")
    return comps.shown(l, show).select("path", "idx", F.lit("shown").alias("side")).unionByName(comps.hidden(l, show).select("path", "idx", F.lit("hidden").alias("side")))


_OPTIONS = f"{_TREE}, O AS (SELECT S.path, parent AS folder, S.idx, CAST(row_number() OVER (PARTITION BY S.path, parent ORDER BY S.idx) - 1 AS INTEGER) AS option, CAST(count(*) OVER (PARTITION BY S.path, parent) AS INTEGER) AS n FROM S JOIN L USING (path, idx) WHERE layer_type IN ('NORMAL', 'TEXT', 'ADJUST', 'FILL') AND parent >= 0), Q AS (SELECT * FROM O WHERE n >= 2)"


@query(f"WITH RECURSIVE {_OPTIONS} SELECT path, folder, option, idx, n FROM Q")
def option_groups(spark: SparkSession, d: str) -> DataFrame:
    return comps.option_groups(tree.parents(_layers(spark, d).select("path", "idx", "layer_type")))


@query(f"""WITH RECURSIVE {_OPTIONS}, GR AS (SELECT path, folder, n, row_number() OVER (PARTITION BY path ORDER BY folder DESC) AS k FROM Q WHERE option = 0),
    WT AS (SELECT path, folder, n, k, CAST(1 AS BIGINT) AS w, least(n, 24)::BIGINT AS total FROM GR WHERE k = 1 UNION ALL SELECT GR.path, GR.folder, GR.n, GR.k, WT.total, least(WT.total * GR.n, 24)::BIGINT FROM WT JOIN GR ON GR.path = WT.path AND GR.k = WT.k + 1),
    TT AS (SELECT path, max(total) AS total FROM WT GROUP BY path), NV AS (SELECT path, unnest(range(total)) AS variation FROM TT)
    SELECT NV.path, CAST(variation AS INTEGER) AS variation, WT.folder, Q.idx FROM NV JOIN WT USING (path) JOIN Q ON Q.path = NV.path AND Q.folder = WT.folder AND Q.option = (variation // WT.w) % WT.n""")
def variations(spark: SparkSession, d: str) -> DataFrame:
    return comps.variations(comps.option_groups(tree.parents(_layers(spark, d).select("path", "idx", "layer_type"))))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
