"""Quantities recorded in different units, brought to common units.

Kinds and their common units: lengths in pixels of their file, angles in degrees, shares in percent, resolutions in
dots per inch. A unit stands in the unit column, or in the text column (alone or behind a number, with a point or a
comma before the decimals), or nowhere. Where it stands nowhere it is assigned: for each quantity name, the log of the
values with known units gives the expected distribution, each candidate unit is a component of it shifted by the log of
its conversion factor, EM over log-scale bins fits the weights of the components and the distribution, and the unit of
the highest posterior is taken. A name without any known unit takes the model of all names that end like it. A posterior
below ``CERTAIN`` is flagged as uncertain.

Results for odd input: a null, NaN or infinite number, and a text without a number, give a null value; an unknown unit
word counts as no unit; zero and negative numbers have no log and keep the assignment of weight alone; a leaf id that
comes several times counts once (first recorded, then smallest number); a header that comes several times gives its
first usable resolution, and one of 72 if none is usable; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import bounded, stored

#: Unit -> (kind, factor to the common unit; lengths to inches, pixels apart).
UNITS = {
    "#Pxl": ("length", None), "px": ("length", None), "pixel": ("length", None), "pixels": ("length", None),
    "#Pnt": ("length", 1 / 72), "#Rlt": ("length", 1 / 72), "pt": ("length", 1 / 72), "point": ("length", 1 / 72), "points": ("length", 1 / 72),
    "#Mlm": ("length", 1 / 25.4), "mm": ("length", 1 / 25.4), "millimetre": ("length", 1 / 25.4), "millimetres": ("length", 1 / 25.4), "millimeter": ("length", 1 / 25.4), "millimeters": ("length", 1 / 25.4),
    "cm": ("length", 1 / 2.54), "centimetre": ("length", 1 / 2.54), "centimetres": ("length", 1 / 2.54), "centimeter": ("length", 1 / 2.54), "centimeters": ("length", 1 / 2.54),
    "m": ("length", 1 / 0.0254), "µm": ("length", 1 / 25400), "μm": ("length", 1 / 25400), "um": ("length", 1 / 25400),
    "in": ("length", 1.0), "inch": ("length", 1.0), "inches": ("length", 1.0), '"': ("length", 1.0), "″": ("length", 1.0),
    "pc": ("length", 1 / 6), "pica": ("length", 1 / 6), "picas": ("length", 1 / 6),
    "#Ang": ("angle", 1.0), "deg": ("angle", 1.0), "degree": ("angle", 1.0), "degrees": ("angle", 1.0), "°": ("angle", 1.0), "º": ("angle", 1.0),
    "rad": ("angle", 180 / math.pi), "radian": ("angle", 180 / math.pi), "radians": ("angle", 180 / math.pi), "turn": ("angle", 360.0), "turns": ("angle", 360.0), "gon": ("angle", 0.9), "grad": ("angle", 0.9),
    "#Prc": ("share", 1.0), "%": ("share", 1.0), "percent": ("share", 1.0), "per cent": ("share", 1.0), "#Nne": ("share", 100.0), "ratio": ("share", 100.0), "‰": ("share", 0.1),
}
#: The units that are candidates where none is recorded.
CANDIDATES = {"length": ["#Pxl", "#Pnt", "#Mlm", "cm", "µm", "in", "pc"], "angle": ["#Ang", "rad", "turn"], "share": ["#Prc", "#Nne"]}
NAMES = {"length": "px", "angle": "deg", "share": "percent"}
DEFAULT_DPI, LOWEST_DPI, HIGHEST_DPI, ROUNDING = 72.0, 72.0, 1200.0, 0.002
CERTAIN = 0.95
#: Width of a log-scale bin of the mixtures.
BIN = 0.05
EM_ROUNDS = 25

_NUMBER = r"([-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)"


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def number_in(text: Column) -> Column:
    """The first number of a text; a comma is a decimal point."""
    return _finite(F.regexp_replace(F.nullif(F.regexp_extract(text, _NUMBER, 1), F.lit("")), ",", ".").try_cast("double"))


def unit_in(text: Column) -> Column:
    """What stands behind the number of a text, or the whole text where it has none."""
    return F.nullif(F.trim(F.regexp_replace(text, "^\\s*" + _NUMBER, "")), F.lit(""))


def _lookup(unit: Column, what: int) -> Column:
    m = F.create_map(*[F.lit(x) for u, v in UNITS.items() if v[what] is not None for x in (u, v[what])])
    return F.coalesce(m[unit], m[F.lower(unit)])


def in_inches(raw: Column, factor: Column) -> Column:
    """A resolution with its factor to dots per inch; read as 16.16 fixed point where only that gives a real one."""
    v = _finite(raw) * factor
    ok = lambda x: x.between(LOWEST_DPI * (1 - ROUNDING), HIGHEST_DPI * (1 + ROUNDING))
    return F.when(ok(v), v).when(ok(v / 65536), v / 65536)


def per_inch(text: Column) -> Column:
    """Factor to dots per inch of a resolution's unit in words; without a known word it is per inch."""
    t = F.lower(text)
    return F.when(t.rlike(r"(/|per\s*|\bp)(cm\b|centi)|\bppcm|\bdpcm"), 2.54).when(t.rlike(r"(/|per\s*)mm\b"), 25.4).when(t.rlike(r"(/|per\s*)m(et|\b)|\bppm\b"), 0.0254).otherwise(1.0)


def resolutions(headers: DataFrame) -> DataFrame:
    """(path, dpi, dpi_from): one row per file; dpi_from is number, text or default."""
    text = F.col("hres_text")
    named = F.when(F.col("hres_unit") == 2, 2.54).when(F.col("hres_unit") == 1, 1.0).otherwise(per_inch(F.coalesce(text, F.lit(""))))
    one = headers.where("path is not null").select(
        "path", "ingested_at",
        in_inches(F.col("hres").cast("double"), named).alias("a"),
        in_inches(number_in(text), per_inch(text)).alias("b"),
    )
    best = F.min(F.struct(F.coalesce("a", "b").isNull().alias("no"), F.col("a").isNull().alias("text"), F.col("ingested_at"), F.coalesce("a", "b").alias("v")))
    return one.groupBy("path").agg(best.alias("m")).select(
        "path",
        F.coalesce("m.v", F.lit(DEFAULT_DPI)).alias("dpi"),
        F.when(F.col("m.no"), "default").when(F.col("m.text"), "text").otherwise("number").alias("dpi_from"),
    )


def _once(leaves: DataFrame) -> DataFrame:
    """Each leaf once; partial aggregation takes repeated deliveries of a hot leaf before the shuffle."""
    cols = ["recorded_at", "val", "path", "idx", "jpath", "source", "os_type", "unit", "v_string"]
    return leaves.where("leaf_id is not null").groupBy("leaf_id").agg(F.min(F.struct(*cols)).alias("m")).select("leaf_id", "m.*")


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weights and log-scale distribution of one quantity name; one row per candidate unit. The distribution starts from the
    values with known units, and takes the others in by their posteriors."""
    kind = pdf["kind"].iloc[0]
    known, free = pdf[pdf["known"]], pdf[~pdf["known"]]
    x, n = known["bin"].to_numpy(float) * BIN, known["n"].to_numpy(float)
    y, m = free["bin"].to_numpy(float) * BIN, free["n"].to_numpy(float)
    units = CANDIDATES[kind]
    shift = np.array([0.0 if UNITS[u][1] is None else math.log(UNITS[u][1] * (DEFAULT_DPI if kind == "length" else 1)) for u in units])
    moved = y[:, None] + shift[None, :]
    w = np.full(len(units), 1 / len(units))
    share = np.zeros_like(moved)
    for _ in range(EM_ROUNDS if m.sum() else 1):
        total = n.sum() + share.sum()
        mu = float(((x * n).sum() + (moved * share).sum()) / total)
        sd = max(float(np.sqrt(((((x - mu) ** 2) * n).sum() + (((moved - mu) ** 2) * share).sum()) / total)), BIN)
        post = w * (np.exp(-0.5 * ((moved - mu) / sd) ** 2) + 1e-300)
        post /= post.sum(axis=1, keepdims=True)
        share = post * m[:, None]
        w = (share.sum(axis=0) + 1) / (m.sum() + len(units))
    return pd.DataFrame({"name": pdf["name"].iloc[0], "kind": kind, "cand": units, "weight": w, "mu": mu, "sd": sd})


def _models(q: DataFrame, per: Column) -> DataFrame:
    """(name, k, c): kind and candidates of each quantity name, and of each last part of names, for those that have no value
    with a unit of their own."""
    names = F.array(F.col("jpath"), F.concat(F.lit("*."), F.substring_index("jpath", ".", -1)))
    bins = q.where((per > 0) & F.col("jpath").isNotNull()).groupBy("jpath", "kind", F.floor(F.log(per) / BIN).alias("bin")).agg(F.count("*").alias("n"))
    bins = bins.select(F.explode(names).alias("name"), "kind", "bin", "n").groupBy("name", "kind", "bin").agg(F.sum("n").alias("n"))
    of = bins.where("kind is not null").groupBy("name", "kind").agg(F.sum("n").alias("s")).groupBy("name").agg(F.max_by("kind", F.struct("s", "kind")).alias("k"))
    hist = bins.join(of, "name").where("kind is null or kind = k").select("name", F.col("k").alias("kind"), F.col("kind").isNotNull().alias("known"), "bin", "n")
    model = hist.groupBy("name").applyInPandas(_fit, "name string, kind string, cand string, weight double, mu double, sd double")
    return model.groupBy("name").agg(F.first("kind").alias("k"), F.array_sort(F.collect_list(F.struct("cand", "weight", "mu", "sd"))).alias("c"))


def common_units(leaves: DataFrame, headers: DataFrame) -> DataFrame:
    """(leaf_id, path, idx, jpath, source, kind, num, unit_used, value, common_unit, stated, posterior, uncertain)."""
    one = _once(leaves)
    text = F.col("v_string")
    said = F.coalesce(F.when(_lookup(F.col("unit"), 0).isNotNull(), F.col("unit")), unit_in(text))
    q = one.select(
        "leaf_id", "path", "idx", "jpath", "source",
        F.coalesce(_finite(F.col("val").cast("double")), number_in(text)).alias("num"),
        F.when(_lookup(said, 0).isNotNull(), said).alias("said"),
    ).withColumn("kind", _lookup(F.col("said"), 0)).join(resolutions(headers).select("path", "dpi"), "path", "left")
    q = stored(q)  # read for the models and for the result
    dpi = F.coalesce("dpi", F.lit(DEFAULT_DPI))

    def value(unit: Column) -> Column:
        f = _lookup(unit, 1)
        length = F.when(f.isNull(), F.col("num")).otherwise(F.col("num") * f * dpi)
        return F.when(_lookup(unit, 0) == "length", length).otherwise(F.col("num") * f)

    q = q.withColumn("v", value(F.col("said")))
    # a file's dots per inch are taken out of the unassigned values, which makes the components fixed offsets
    per = F.when(F.col("said").isNull(), F.col("num") * dpi / DEFAULT_DPI).otherwise(F.col("v"))
    models = stored(_models(q, per))
    free = q.where("said is null and num is not null")
    own = free.join(bounded(models.withColumnRenamed("name", "jpath")), "jpath", "left")
    pooled = models.select(F.col("name").alias("_last"), F.col("k").alias("_k"), F.col("c").alias("_c")).where("_last like '*.%'")
    own = own.withColumn("_last", F.concat(F.lit("*."), F.substring_index("jpath", ".", -1))).join(bounded(pooled), "_last", "left")
    own = own.withColumn("k", F.coalesce("k", "_k")).withColumn("c", F.coalesce("c", "_c"))

    shift = lambda c: F.coalesce(F.log(_lookup(c["cand"], 1) * F.when(F.col("k") == "length", dpi).otherwise(1.0)), F.lit(0.0))
    z = lambda c: F.when(F.col("num") > 0, (F.log("num") + shift(c) - c["mu"]) / c["sd"]).otherwise(0.0)
    score = F.transform("c", lambda c: F.struct((c["weight"] * F.exp(-0.5 * z(c) * z(c)) + 1e-300).alias("p"), c["cand"].alias("u")))
    own = own.withColumn("best", F.array_max(score)).withColumn("used", F.col("best.u")).withColumn("posterior", F.col("best.p") / F.aggregate(score, F.lit(0.0), lambda a, s: a + s["p"]))
    key = ["leaf_id", "path", "idx", "jpath", "source", "num", "dpi"]
    rest = q.where("said is not null or num is null").select(*key, "kind", F.col("said").alias("used"), F.when(F.col("said").isNotNull(), 1.0).alias("posterior"), (F.col("said").isNotNull() & F.col("num").isNotNull()).alias("stated"))
    every = rest.unionByName(own.select(*key, F.when(F.col("used").isNotNull(), F.col("k")).alias("kind"), "used", "posterior", F.lit(False).alias("stated")))
    return every.select(
        "leaf_id", "path", "idx", "jpath", "source", "kind", "num", F.col("used").alias("unit_used"), value(F.col("used")).alias("value"),
        F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[F.col("kind")].alias("common_unit"),
        "stated", "posterior", (F.coalesce("posterior", F.lit(0.0)) < CERTAIN).alias("uncertain"),
    )


def disagreements(units: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(leaf_id_a, leaf_id_b): leaves of one quantity with stated units whose values differ by more than ``tolerance``
    of the larger one. The different values of a quantity are compared, not its leaves; these are joined to what differs."""
    key = ["path", "idx", "jpath"]
    v = units.where("stated and value is not null and path is not null and idx is not null and jpath is not null").select(*key, "leaf_id", "value")
    values = v.select(*key, "value").distinct()
    a, b = values.withColumnRenamed("value", "x"), values.withColumnRenamed("value", "y")
    pairs = a.join(b, key).where((F.col("x") < F.col("y")) & (F.col("y") - F.col("x") > tolerance * F.greatest(F.abs("x"), F.abs("y"))))
    left = v.select(*key, F.col("leaf_id").alias("p"), F.col("value").alias("x"))
    right = v.select(*key, F.col("leaf_id").alias("q"), F.col("value").alias("y"))
    each = pairs.join(left, [*key, "x"]).join(right, [*key, "y"])
    return each.select(F.least("p", "q").alias("leaf_id_a"), F.greatest("p", "q").alias("leaf_id_b"))
