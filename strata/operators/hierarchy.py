"""Parent-child links to full hierarchies.

Each node names its parent within its tree key. Nodes are cut into blocks of consecutive ids, so that a tree of any
size is split over tasks. In a block, a weighted disjoint-set forest (parent link of weight 1, path compression) gives
every node its local root and its distance to it; a link that closes on its own root is a loop. What leaves a block is
a link from a local root to a node elsewhere. These links are merged in two wider levels (256 blocks, then the whole
tree) by the same forest with the distances as weights. Only nodes that another block points to take part in that, and
in the last level only those that another 256 blocks point to. Paths are made by walking the parents of each node; they
leave the kernels in frames of ``HELD`` ids, however deep a tree is.

Results for odd input: rows without tree key or id are left out; a repeated (key, id) counts once, the first row by
``order`` wins, then the smallest parent; a parent of -1 or null is the top level; a parent that is not there ends the
chain, the last row that is there is the root; a parent equal to the node itself is a loop of one. Nodes whose chain
never ends have null depth, root and path, and ``cycle_idx``, the smallest id on the loop. An empty table gives an
empty result. Other columns of the input are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import frames, stored

#: Ids per block, and blocks per block of the next level.
BLOCK = 1 << 16
FANOUT = 256
#: Ids of paths that a kernel holds before it hands them on.
HELD = 1 << 20

#: ``low`` is the smallest id on the way from a node to its local root.
_SCHEMA = "path string, idx int, root int, dist int, out int, cycle_idx int, low int, chain array<int>"


def forest(ids: list[int], links: list[int | None], weights: list[int]) -> tuple[dict[int, int], list[int], list[int], dict[int, int]]:
    """Weighted disjoint-set forest of directed links.

    Returns the position by id, the root's position and the distance to it for each position, and for each root that is
    on a loop the smallest id on that loop.
    """
    at = {x: k for k, x in enumerate(ids)}
    up = list(range(len(ids)))
    dist = [0] * len(ids)

    def find(k: int) -> int:
        way = []
        while up[k] != k:
            way.append(k)
            k = up[k]
        total = 0
        for x in reversed(way):
            total += dist[x]
            up[x], dist[x] = k, total
        return k

    loops: dict[int, int] = {}
    for k, link in enumerate(links):
        p = at.get(link) if link is not None else None
        if p is None:
            continue
        if find(p) == k:  # k is still a root, and its own chain comes back to it
            least, x = ids[k], p
            while x != k:
                least = min(least, ids[x])
                x = at[links[x]]
            loops[k] = least
        else:
            up[k], dist[k] = p, weights[k]
    roots = [find(k) for k in range(len(ids))]
    return at, roots, dist, loops


def _complete(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no group spans two frames; holds one batch and one group."""
    rest = None
    for b in batches:
        if not len(b):
            continue
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        last = b[keys].iloc[-1]
        same = (b[keys] == last).all(axis=1)
        rest = b[same]
        if not same.all():
            yield b[~same]
    if rest is not None and len(rest):
        yield rest


class _Rows:
    """Rows of the schema, handed on in frames that hold at most about ``HELD`` ids of paths."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.cols: list[list] = [[] for _ in range(8)]
        self.held = 0

    def add(self, *row) -> bool:
        for c, v in zip(self.cols, row):
            c.append(v)
        self.held += len(row[-1] or ())
        return self.held >= HELD

    def frame(self) -> pd.DataFrame:
        names = ["path", "idx", "root", "dist", "out", "cycle_idx", "low", "chain"]
        made = pd.DataFrame({n: pd.Series(c, dtype=object) if n in ("path", "chain") else pd.array(c, dtype="Int32") for n, c in zip(names, self.cols)})
        self.clear()
        return made


def _lowest(ids: list[int], ups: list[int | None], own: list[int]) -> list[int]:
    """The smallest of ``own`` on the way of each node up to the end, ``ups`` being positions; no loops."""
    low: list[int | None] = [None] * len(ids)
    for k in range(len(ids)):
        way, x = [], k
        while x is not None and low[x] is None:
            way.append(x)
            x = ups[x]
        least = None if x is None else low[x]
        for y in reversed(way):
            least = own[y] if least is None else min(least, own[y])
            low[y] = least
    return low


def _ups(at: dict[int, int], roots: list[int], links: list[int | None]) -> list[int | None]:
    """The position of each node's parent in the block; None for local roots."""
    return [None if roots[k] == k else at[links[k]] for k in range(len(links))]


def _block_kernel(with_chain: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Rows()
        for b in _complete(batches, ["path", "block"]):
            paths, blocks = b["path"].tolist(), b["block"].tolist()
            idx, parent = b["idx"].tolist(), b["parent"].tolist()
            start, n = 0, len(paths)
            while start < n:
                end = start
                while end < n and paths[end] == paths[start] and blocks[end] == blocks[start]:
                    end += 1
                ids = idx[start:end]
                links = [None if p < 0 else p for p in parent[start:end]]
                at, roots, dist, loops = forest(ids, links, [1] * len(ids))
                ups = _ups(at, roots, links)
                low = _lowest(ids, ups, ids)
                for k, x in enumerate(ids):
                    r = roots[k]
                    loop = loops.get(r)
                    chain = None
                    if with_chain and loop is None:
                        chain, y = [x], ups[k]
                        while y is not None:
                            chain.append(ids[y])
                            y = ups[y]
                    if out.add(paths[start], x, ids[r], dist[k], links[r] if loop is None else None, loop, low[k], chain):
                        yield out.frame()
                start = end
            yield out.frame()

    return run


def _merge_kernel(with_chain: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows()
        for b in _complete(batches, ["path", "block"]):
            for path, g in b.groupby(["path", "block"], sort=False):
                ids = g["idx"].tolist()
                whole = lambda c, g=g: [None if pd.isna(x) else int(x) for x in g[c]]
                out, loop0, far, rts, own = (whole(c) for c in ("out", "cycle_idx", "dist", "root", "low"))
                chains = g["chain"].tolist()
                at, roots, dist, loops = forest(ids, out, [d + 1 for d in far])
                # a loop over several blocks passes through the whole way of each of its entries
                for r in list(loops):
                    least, x = own[r], at[out[r]]
                    while x != r:
                        least = min(least, own[x])
                        x = at[out[x]]
                    loops[r] = least
                ups = _ups(at, roots, out)
                low = _lowest(ids, ups, own)
                for k, x in enumerate(ids):
                    r = roots[k]
                    loop = loops.get(r, loop0[r])
                    chain = None
                    if with_chain and loop is None:
                        chain, y = list(chains[k]), ups[k]
                        while y is not None:
                            chain += chains[y].tolist()
                            y = ups[y]
                    if rows.add(path[0], x, rts[r], dist[k] + far[r], None if loop is not None else out[r], loop, low[k], chain):
                        yield rows.frame()
            yield rows.frame()

    return run


def _run(df: DataFrame, block: Column, kernel) -> DataFrame:
    return df.withColumn("block", block).repartition("path", "block").sortWithinPartitions("path", "block", "idx").transform(frames, kernel, _SCHEMA)


def hierarchy(df: DataFrame, path: str = "path", idx: str = "idx", parent: str = "parent_index", order: str | None = None, with_chain: bool = True) -> DataFrame:
    """One row per node: (path, idx, parent, root, depth, cycle_idx, chain), chain from the root to the node.

    With ``with_chain=False`` chain is null; loops, roots and depths are the same.
    """
    first = F.struct(*([F.col(order)] if order else []), F.coalesce(F.col(parent), F.lit(-1)).alias("p"))
    nodes = (
        df.where(F.col(path).isNotNull() & F.col(idx).isNotNull())
        .groupBy(F.col(path).alias("path"), F.col(idx).cast("int").alias("idx"))
        .agg(F.min(first)["p"].cast("int").alias("parent"))
    )
    size = F.lit(BLOCK)
    local = _run(nodes, F.floor(F.col("idx") / size), _block_kernel(with_chain))
    # only trees with ids beyond the first block have links between blocks; for all others the rest is empty
    wide = nodes.where((F.col("idx") >= size) | (F.col("parent") >= size)).select("path").distinct()
    crossing = _run(nodes.join(wide, "path", "left_semi"), F.floor(F.col("idx") / size), _block_kernel(with_chain))
    first = _run(_entered(crossing), F.floor(F.col("idx") / F.lit(BLOCK * FANOUT)), _merge_kernel(with_chain))
    last = _run(_entered(first), F.lit(0), _merge_kernel(with_chain))
    joined = _beyond(local, _beyond(first, last, with_chain), with_chain)
    open_ = F.col("cycle_idx").isNull()
    return joined.select(
        "path", "idx",
        F.when(open_, F.col("root")).alias("root"),
        F.when(open_, F.col("dist")).alias("depth"),
        "cycle_idx",
        F.when(open_ & F.lit(with_chain), F.reverse("chain")).alias("chain"),
    )


def _entered(rows: DataFrame) -> DataFrame:
    """The rows that links from other blocks point to."""
    targets = rows.where("out is not null").select("path", F.col("out").alias("idx")).distinct()
    return rows.join(targets, ["path", "idx"], "left_semi")


def _beyond(rows: DataFrame, entries: DataFrame, with_chain: bool) -> DataFrame:
    """Rows with what lies behind the link that leaves their block."""
    e = entries.select("path", F.col("idx").alias("out"), *[F.col(c).alias(f"e_{c}") for c in ("root", "dist", "cycle_idx", "chain")])
    j = rows.join(e, ["path", "out"], "left")
    return j.select(
        "path", "idx",
        F.coalesce("e_root", "root").alias("root"),
        (F.col("dist") + F.coalesce(F.col("e_dist") + 1, F.lit(0))).alias("dist"),
        F.lit(None).cast("int").alias("out"),
        F.coalesce("cycle_idx", "e_cycle_idx").alias("cycle_idx"),
        "low",
        F.when(F.lit(with_chain), F.concat("chain", F.coalesce("e_chain", F.array().cast("array<int>")))).alias("chain"),
    )


def cycles(df: DataFrame, **columns: str) -> DataFrame:
    """(path, idx, cycle_idx) of the nodes whose chain of parents never ends."""
    return hierarchy(df, with_chain=False, **columns).where("cycle_idx is not null").select("path", "idx", "cycle_idx")


def descendants(tree: DataFrame) -> DataFrame:
    """(path, ancestor, idx, distance) for each node and each of its proper ancestors, from :func:`hierarchy`."""
    return (
        tree.where("depth > 0")
        .select("path", "idx", "depth", F.posexplode(F.slice("chain", F.lit(1), F.col("depth"))).alias("at", "ancestor"))
        .select("path", "ancestor", "idx", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
    )


def described(tree: DataFrame, df: DataFrame) -> DataFrame:
    """:func:`hierarchy` of layers with their ids, types and names, and the number of descendants of each node.

    ``folders`` is the chain of folder indices from the root to the node, ``n_below`` counts its descendants.
    """
    own = (
        df.where("path is not null and idx is not null")
        .groupBy("path", "idx")
        .agg(F.min(F.struct("ingested_at", "layer_id", "layer_type", F.coalesce("name_unicode", "layer_name").alias("name"))).alias("m"))
        .select("path", "idx", "m.layer_id", "m.layer_type", "m.name")
    )
    tree = stored(tree)  # read for the rows and for the counts
    below = descendants(tree).groupBy("path", F.col("ancestor").alias("idx")).agg(F.count("*").alias("n_below"))
    folders = F.when(F.col("cycle_idx").isNull(), F.slice("chain", F.lit(1), F.col("depth")))
    return tree.join(own, ["path", "idx"]).join(below, ["path", "idx"], "left").select(
        "path", "idx", "layer_id", "layer_type", "name", "depth", "root", "cycle_idx", folders.alias("folders"), F.coalesce("n_below", F.lit(0)).alias("n_below"),
    )
