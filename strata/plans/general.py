"""Queries of the general training-data operators (units, hierarchies) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import hierarchy, units
from strata.session import table


def _units(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "descriptor_leaves"), table(spark, d, "psd_headers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return units.disagreements(_units(spark, d))


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d)


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """The leaves with a unit of their own, in common units."""
    return _units(spark, d).where("stated").select("leaf_id", "kind", F.round(F.col("value") + 1e-7, 4).alias("value"), "common_unit")  # off the ties


def p3_resolutions(spark: SparkSession, d: str) -> DataFrame:
    return units.resolutions(table(spark, d, "psd_headers")).withColumn("dpi", F.round("dpi", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles(table(spark, d, "layers"), order="ingested_at")


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    layers = table(spark, d, "layers")
    return hierarchy.described(hierarchy.hierarchy(layers, order="ingested_at"), layers)


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, d, "layers"), order="ingested_at"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_units, p3_values, p3_resolutions, p5_found, p5_hierarchy, p5_descendants)}


_RESOLUTIONS = r"""
h AS (SELECT path, hres, hres_unit, hres_text, ingested_at, lower(coalesce(hres_text, '')) AS t FROM psd_headers WHERE path IS NOT NULL),
f AS (SELECT *, CASE WHEN regexp_matches(t, '(/|per ?)(cm|centi)') THEN 2.54 WHEN regexp_matches(t, '(/|per ?)m|\bppm\b') THEN 0.0254 ELSE 1.0 END AS w,
             try_cast(replace(regexp_extract(hres_text, '[-+]?\d+(?:[.,]\d+)?'), ',', '.') AS DOUBLE) AS num FROM h),
g AS (SELECT *, CASE WHEN isfinite(hres) THEN hres * CASE hres_unit WHEN 1 THEN 1.0 WHEN 2 THEN 2.54 ELSE w END END AS a, num * w AS b FROM f),
k AS (SELECT path, ingested_at, CASE WHEN a BETWEEN 71.856 AND 1202.4 THEN a WHEN a / 65536 BETWEEN 71.856 AND 1202.4 THEN a / 65536 END AS a,
             CASE WHEN b BETWEEN 71.856 AND 1202.4 THEN b WHEN b / 65536 BETWEEN 71.856 AND 1202.4 THEN b / 65536 END AS b FROM g),
r AS (SELECT path, coalesce(a, b, 72.0) AS dpi, CASE WHEN a IS NOT NULL THEN 'number' WHEN b IS NOT NULL THEN 'text' ELSE 'default' END AS dpi_from,
             row_number() OVER (PARTITION BY path ORDER BY coalesce(a, b) IS NULL, a IS NULL, ingested_at, coalesce(a, b)) AS n FROM k)
"""

#: Leaves once, the number and the unit of each, its kind, and its value in the common unit of that.
_VALUES = r"""
l AS (SELECT leaf_id, path, idx, jpath, val, unit, v_string, row_number() OVER (PARTITION BY leaf_id ORDER BY recorded_at, val) AS n FROM descriptor_leaves WHERE leaf_id IS NOT NULL),
q AS (SELECT leaf_id, path, idx, jpath, coalesce(CASE WHEN isfinite(val) THEN val END, try_cast(replace(regexp_extract(v_string, '[-+]?\d+(?:[.,]\d+)?'), ',', '.') AS DOUBLE)) AS num,
             coalesce(unit, trim(regexp_replace(v_string, '^\s*[-+]?\d+(?:[.,]\d+)?', ''))) AS u FROM l WHERE n = 1),
v AS (SELECT q.*, CASE WHEN u IN ('#Pxl', 'px', 'pixels', '#Pnt', '#Rlt', 'pt', 'points', '#Mlm', 'mm', 'millimetres', 'cm', 'µm', 'in', 'inch', 'inches', '"', 'pc', 'picas') THEN 'length' WHEN u IN ('#Ang', 'deg', '°', 'rad', 'turn') THEN 'angle' WHEN u IN ('#Prc', '%', 'percent', '#Nne') THEN 'share' END AS kind,
             num * CASE WHEN u IN ('#Pxl', 'px', 'pixels', '#Ang', 'deg', '°', '#Prc', '%', 'percent') THEN 1
             WHEN u IN ('#Pnt', '#Rlt', 'pt', 'points') THEN dpi / 72 WHEN u IN ('#Mlm', 'mm', 'millimetres') THEN dpi / 25.4 WHEN u = 'cm' THEN dpi / 2.54 WHEN u = 'µm' THEN dpi / 25400
             WHEN u IN ('in', 'inch', 'inches', '"') THEN dpi WHEN u IN ('pc', 'picas') THEN dpi / 6 WHEN u = 'rad' THEN 180 / pi() WHEN u = 'turn' THEN 360 WHEN u = '#Nne' THEN 100 END AS x
      FROM q LEFT JOIN (SELECT path, dpi FROM r WHERE n = 1) USING (path))
"""

_TREE = """
n AS (SELECT path, idx, arg_min(coalesce(parent_index, -1), (ingested_at, coalesce(parent_index, -1))) AS parent FROM layers WHERE path IS NOT NULL AND idx IS NOT NULL GROUP BY path, idx),
up AS (SELECT path, idx, idx AS anc FROM n
       UNION
       SELECT u.path, u.idx, n.parent FROM up u JOIN n ON n.path = u.path AND n.idx = u.anc JOIN n m ON m.path = n.path AND m.idx = n.parent WHERE n.parent >= 0),
reach AS (SELECT u.path, u.idx, n.parent AS anc FROM up u JOIN n ON n.path = u.path AND n.idx = u.anc JOIN n m ON m.path = n.path AND m.idx = n.parent WHERE n.parent >= 0),
loops AS (SELECT DISTINCT path, idx FROM reach WHERE idx = anc),
bad AS (SELECT u.path, u.idx, min(u.anc) AS cycle_idx FROM up u JOIN loops l ON l.path = u.path AND l.idx = u.anc GROUP BY u.path, u.idx)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_resolutions": f"WITH {_RESOLUTIONS} SELECT path, round(dpi, 6) AS dpi, dpi_from FROM r WHERE n = 1",
        "p3_values": f"""WITH {_RESOLUTIONS}, {_VALUES}
            SELECT leaf_id, kind, round(x + 1e-7, 4) AS value, CASE kind WHEN 'length' THEN 'px' WHEN 'angle' THEN 'deg' ELSE 'percent' END AS common_unit FROM v WHERE kind IS NOT NULL AND num IS NOT NULL""",
        "p3_found": f"""WITH {_RESOLUTIONS}, {_VALUES}
            SELECT a.leaf_id AS leaf_id_a, b.leaf_id AS leaf_id_b FROM v a JOIN v b ON a.path = b.path AND a.idx = b.idx AND a.jpath = b.jpath AND a.leaf_id < b.leaf_id
            WHERE abs(a.x - b.x) > 0.02 * greatest(abs(a.x), abs(b.x))""",
        "p5_hierarchy": f"""WITH RECURSIVE {_TREE}, good AS (SELECT path, idx, anc FROM up WHERE (path, idx) NOT IN (SELECT (path, idx) FROM bad)),
            d AS (SELECT path, idx, CAST(count(*) - 1 AS INTEGER) AS depth FROM good GROUP BY path, idx),
            f AS (SELECT g.path, g.idx, arg_min(g.anc, e.depth) AS root, list(g.anc ORDER BY e.depth) FILTER (g.anc <> g.idx) AS folders FROM good g JOIN d e ON e.path = g.path AND e.idx = g.anc GROUP BY g.path, g.idx),
            b AS (SELECT path, anc AS idx, count(*) AS n_below FROM good WHERE anc <> idx GROUP BY path, anc),
            o AS (SELECT *, row_number() OVER (PARTITION BY path, idx ORDER BY ingested_at NULLS FIRST, layer_id NULLS FIRST) AS r FROM layers WHERE path IS NOT NULL AND idx IS NOT NULL)
            SELECT o.path, o.idx, o.layer_id, o.layer_type, coalesce(o.name_unicode, o.layer_name) AS name, d.depth, f.root, bad.cycle_idx, CASE WHEN bad.cycle_idx IS NULL THEN coalesce(f.folders, []) END AS folders, coalesce(b.n_below, 0) AS n_below
            FROM o LEFT JOIN d ON d.path = o.path AND d.idx = o.idx LEFT JOIN f ON f.path = o.path AND f.idx = o.idx LEFT JOIN b ON b.path = o.path AND b.idx = o.idx LEFT JOIN bad ON bad.path = o.path AND bad.idx = o.idx WHERE r = 1""",
        "p5_found": f"WITH RECURSIVE {_TREE} SELECT path, idx, cycle_idx FROM bad",
        "p5_descendants": f"""WITH RECURSIVE {_TREE}, good AS (SELECT path, idx, anc FROM up WHERE (path, idx) NOT IN (SELECT (path, idx) FROM bad)),
            d AS (SELECT path, idx, count(*) AS k FROM good GROUP BY path, idx)
            SELECT g.path, g.anc AS ancestor, g.idx, CAST(d.k - e.k AS INTEGER) AS distance FROM good g JOIN d ON d.path = g.path AND d.idx = g.idx JOIN d e ON e.path = g.path AND e.idx = g.anc WHERE g.anc <> g.idx""",
    }
