"""Layer comps and variations: which layers show, and the combinations of options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.layers import PIXEL_TYPES


def last_states(states: DataFrame, pos: str = "pos") -> DataFrame:
    """One state per (path, idx, comp_id): the one written last, by ``pos``; without that column any of those that are given,
    the largest."""
    keys = ["path", "idx", "comp_id"]
    rest = [c for c in states.columns if c not in keys]
    order = [pos, *[c for c in rest if c != pos]] if pos in rest else rest
    return states.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def comp_map(states: DataFrame) -> DataFrame:
    """(path, idx, comps): the states of each layer as a map by comp, the last one written of each."""
    one = last_states(states)
    return one.groupBy("path", "idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("comp_id", F.struct("enabled", "offset_x", "offset_y"))))).alias("comps"))


def visibility(layers: DataFrame, comps: DataFrame, states: DataFrame) -> DataFrame:
    """(path, idx, comp_id, shown): the state in each comp; without one a layer keeps its own visibility.

    ``layers`` has (path, idx, visible), ``comps`` (path, comp_id), ``states`` (path, idx, comp_id, enabled).
    """
    each = layers.select("path", "idx", "visible").join(comps.select("path", "comp_id").distinct(), "path")
    return each.join(last_states(states), ["path", "idx", "comp_id"], "left").select("path", "idx", "comp_id", F.coalesce("enabled", "visible").alias("shown"))


def shown(layers: DataFrame, show: DataFrame) -> DataFrame:
    return layers.join(show.select("path", "idx"), ["path", "idx"], "left_semi")


def hidden(layers: DataFrame, show: DataFrame) -> DataFrame:
    return layers.join(show.select("path", "idx"), ["path", "idx"], "left_anti")


def option_groups(tree: DataFrame, at_least: int = 2) -> DataFrame:
    """(path, folder, option, idx, n): folders with several direct pixel layers, the options numbered bottom up."""
    opts = tree.where(F.col("layer_type").isin(PIXEL_TYPES) & (F.col("parent") >= 0)).select("path", F.col("parent").alias("folder"), "idx")
    lists = opts.groupBy("path", "folder").agg(F.array_sort(F.collect_list("idx")).alias("o")).where(F.size("o") >= at_least)
    return lists.select("path", "folder", F.size("o").alias("n"), F.posexplode("o").alias("option", "idx"))


def variations(options: DataFrame, limit: int = 24) -> DataFrame:
    """(path, variation, folder, idx): the first ``limit`` combinations of each document, the lowest folder changing
    slowest. A combination is a number in a mixed base, so nothing is multiplied out and thrown away."""
    groups = options.where("option = 0").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("folder", "n"))).alias("g"))
    # the weight of a folder is the product of the sizes of the folders above it, as far as the limit is concerned
    weights = F.transform("g", lambda x, k: F.struct(x["folder"].alias("folder"), x["n"].alias("n"), F.aggregate(F.slice("g", k + 2, F.size("g")), F.lit(1).cast("bigint"), lambda a, y: F.least(a * y["n"], F.lit(limit).cast("bigint"))).alias("w")))
    total = F.aggregate("g", F.lit(1).cast("bigint"), lambda a, y: F.least(a * y["n"], F.lit(limit).cast("bigint")))
    numbered = groups.select("path", weights.alias("w"), F.explode(F.sequence(F.lit(0).cast("bigint"), total - 1)).alias("variation"))
    each = numbered.select("path", "variation", F.explode("w").alias("w")).select("path", "variation", "w.folder", F.expr("cast((variation div w.w) % w.n as int)").alias("option"))
    return each.join(options.select("path", "folder", "option", "idx"), ["path", "folder", "option"]).select("path", F.col("variation").cast("int").alias("variation"), "folder", "idx")
