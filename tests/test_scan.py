"""Running aggregates and trees against plain Python, with small blocks."""

import random

from pyspark.sql import functions as F

from strata.operators import edits, scan, tree


def test_running_over_blocks(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.choice([None, *range(-5, 6)])) for g in ("a", None, "b") for k in rng.sample(range(-40, 60), 50)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    outs = {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "x": ("max", F.col("v")), "l": ("last", F.col("v"))}
    for inclusive in (True, False):
        got = {(r["g"], r["k"]): (r["s"], r["m"], r["x"], r["l"]) for r in scan.running(df, ["g"], F.col("k"), inclusive, block=7, **outs).collect()}
        for g in ("a", None, "b"):
            seen = []
            for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
                if inclusive and v is not None:
                    seen.append(v)
                assert got[g, k] == (sum(seen), min(seen, default=None), max(seen, default=None), seen[-1] if seen else None)
                if not inclusive and v is not None:
                    seen.append(v)


def plain_tree(types: list[str]):
    """(parent, depth, start, count) by a stack, rows from the top down."""
    n = len(types)
    parent, depth, stack = [0] * n, [0] * n, []
    for k in reversed(range(n)):
        parent[k], depth[k] = (stack[-1] if stack else -1), len(stack)
        if types[k] == "FOLDER":
            stack.append(k)
        elif types[k] == "HIDDEN" and stack:
            stack.pop()
    start = list(range(n))
    for k in range(n):
        if types[k] == "FOLDER":
            level = 1
            for j in range(k - 1, -1, -1):
                level += {"FOLDER": 1, "HIDDEN": -1}.get(types[j], 0)
                if level == 0:
                    start[k] = j
                    break
    return parent, depth, start


def test_trees(spark, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK", 5)
    monkeypatch.setattr(scan.running, "__defaults__", (True, 5))
    rng = random.Random(2)
    docs = {f"d{k}": [rng.choice(["FOLDER", "HIDDEN", "NORMAL"]) for _ in range(rng.randint(1, 40))] for k in range(40)}
    df = spark.createDataFrame([(p, k, t) for p, ts in docs.items() for k, t in enumerate(ts)], "path string, idx int, layer_type string")
    got = {(r["path"], r["idx"]): (r["parent"], r["depth"]) for r in tree.parents(df).collect()}
    span = {(r["path"], r["idx"]): r["start"] for r in tree.spans(df).collect()}
    for p, ts in docs.items():
        parent, depth, start = plain_tree(ts)
        assert [got[p, k] for k in range(len(ts))] == list(zip(parent, depth))
        assert [span[p, k] for k in range(len(ts))] == start


COLUMNS = "path string, idx int, layer_type string, layer_id int, name_unicode string, layer_name string"


def named(df):
    return [r["name_unicode"] for r in df.orderBy("idx").collect()]


def test_edits(spark):
    l = spark.createDataFrame([("a", k, "NORMAL", k, n, n) for k, n in enumerate("abcde")], COLUMNS)
    at = lambda **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"`{k}` {'string' if isinstance(x, str) else 'int'}" for k, x in v.items()))
    assert named(edits.move(l, at(path="a", **{"from": 0}, to=3))) == list("bcdae")
    assert named(edits.move(l, at(path="a", **{"from": 4}, to=1))) == list("aebcd")
    assert named(edits.move_range(l, at(path="a", **{"from": 1}, count=2, to=5))) == list("adebc")
    assert named(edits.move_range(l, at(path="a", **{"from": 1}, count=2, to=2))) == list("abcde")
    assert named(edits.delete(l, F.col("idx") == 1)) == list("acde")
    assert named(edits.duplicate(l, at(path="a", idx=1))) == list("abbcde")
    assert max(r["layer_id"] for r in edits.duplicate(l, at(path="a", idx=1)).collect()) == 5
    folder = edits.add_folder(l.where("idx < 3"), at(path="a", first=1, count=2, name="f"))
    assert named(folder) == ["a", "</Layer group>", "b", "c", "f"]
    assert [r["parent"] for r in tree.parents(folder).orderBy("idx").collect()] == [-1, 4, 4, 4, -1]
    assert named(edits.add_folder(l, at(path="a", first=3, count=0, name="f")))[3:5] == ["</Layer group>", "f"]
