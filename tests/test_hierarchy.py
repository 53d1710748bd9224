"""Parents, loops and paths against a plain walk."""

import random

from strata.operators import hierarchy as H

SCHEMA = "path string, idx int, parent_index int, ingested_at int, extra string"


def walk(parents: dict[int, int | None], x: int):
    """(depth, root, cycle_idx, chain from the root) of x."""
    seen, chain = {}, []
    while True:
        seen[x] = len(chain)
        chain.append(x)
        p = parents[x]
        if p is None or p < 0 or p not in parents:
            return len(chain) - 1, x, None, chain[::-1]
        if p in seen:
            return None, None, min(chain[seen[p] :]), None
        x = p


def expected(rows):
    trees: dict = {}
    for path, idx, parent, at, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[3] is not None, r[3] or 0, -1 if r[2] is None else r[2])):
        trees.setdefault(path, {}).setdefault(idx, parent)
    return {(p, x): walk(t, x) for p, t in trees.items() for x in t}


def check(spark, rows):
    got = {(r["path"], r["idx"]): (r["depth"], r["root"], r["cycle_idx"], r["chain"]) for r in H.hierarchy(spark.createDataFrame(rows, SCHEMA), order="ingested_at").collect()}
    want = expected(rows)
    assert got == want
    loops = {(r["path"], r["idx"]): r["cycle_idx"] for r in H.cycles(spark.createDataFrame(rows, SCHEMA), order="ingested_at").collect()}
    assert loops == {k: v[2] for k, v in want.items() if v[2] is not None}


def test_random_graphs(spark):
    rng = random.Random(5)
    rows = []
    for t in range(40):
        n = rng.randint(1, 30)
        rows += [(f"t{t}", k, rng.choice([None, -1, k, rng.randrange(n + 3), rng.randrange(n)]), 1, "x") for k in range(n)]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(None, 1, 0, 1, ""), ("a", None, 0, 1, ""), ("a", 0, 0, 1, ""), ("a", 1, 9, 1, ""), ("b", 0, None, None, ""), ("b", 1, 0, 1, ""), ("b", 1, -1, 2, ""), ("b", 1, 0, 1, "")])
    assert H.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks(spark, monkeypatch):
    """Trees over several blocks and levels, with loops across blocks."""
    monkeypatch.setattr(H, "BLOCK", 8)
    monkeypatch.setattr(H, "FANOUT", 4)
    rng = random.Random(9)
    rows = []
    for t in range(12):
        n = rng.randint(20, 150)
        rows += [(f"t{t}", k, rng.choice([-1, max(0, k - rng.randint(1, 12)), min(n, k + rng.randint(1, 20)), rng.randrange(n)]) if rng.random() < 0.9 else -1, 1, "") for k in range(n)]
    ring = [("ring", k, (k + 1) % 64, 1, "") for k in range(64)] + [("ring", 64 + k, 63 + k, 1, "") for k in range(20)]
    chain = [("chain", k, k - 1, 1, "") for k in range(100)]
    check(spark, rows + ring + chain)


def test_descendants(spark):
    tree = H.hierarchy(spark.createDataFrame([("a", 0, -1, 1, ""), ("a", 1, 0, 1, ""), ("a", 2, 1, 1, "")], SCHEMA))
    got = {(r["ancestor"], r["idx"], r["distance"]) for r in H.descendants(tree).collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (1, 2, 1)}


def test_deep_chains_leave_in_small_frames(monkeypatch):
    """A chain of thousands in one block: no frame holds more than HELD ids and one path."""
    import pandas as pd

    monkeypatch.setattr(H, "HELD", 20_000)
    n = 3000
    b = pd.DataFrame({"path": "a", "block": 0, "idx": range(n), "parent": [k - 1 for k in range(n)]})
    frames = list(H._block_kernel(True)(iter([b])))
    assert sum(map(len, frames)) == n and max(sum(map(len, f["chain"])) for f in frames) < 20_000 + n
    (plain,) = [f for f in H._block_kernel(False)(iter([b])) if len(f)]
    assert plain["chain"].isna().all() and plain["dist"].tolist() == list(range(n)) and set(plain["low"]) == {0}
