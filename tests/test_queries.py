"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
#: For what needs enough rows of each source.
WIDER = "/root/testdata/sf0.01"
SQL = __spark_entry__.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, WIDER if name == "p7_kept" else DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(SQL[name])
    named = [d[0] for d in answer.description]
    assert sorted(named) == columns
    want = sorted((tuple(plain(r[named.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert got == want


#: What must hold for the rows of a query without SQL: at least so many, and a condition on each.
PROPERTIES = {
    "p1_found": (100, lambda r: r["field"] in ("layer_name", "name_unicode")),
    "p1_report": (6, lambda r: 0 <= r["n_cut"] <= r["n_values"] and abs(r["share"] * r["n_values"] - r["n_cut"]) < 1e-6 and r["n_cut"] == r["half_a_character"] + r["within_word"] + r["within_sentence"] + r["within_text"] + r["other_goes_on"]),
    "p2_found": (5, lambda r: r["field"] in ("layer_name", "name_unicode")),
    "p2_restored": (5, lambda r: r["finished"] and (r["restored"] != r["value"]) == bool(r["steps"])),
    "p3_units": (100, lambda r: (r["value"] is None) == (r["num"] is None or r["unit_used"] is None) and (not r["stated"] or r["posterior"] == 1) and r["uncertain"] == ((r["posterior"] or 0) < 0.95)),
    "p4_found": (5, lambda r: r["field"] in ("name_unicode", "text")),
    "p4_forms": (1000, lambda r: (r["value"] != r["form"]) == bool(r["why"])),
    "p6_found": (1, lambda r: r["doc_id"] is not None and r["item_id"] is not None),
    "p6_leaks": (1, lambda r: (r["run"] >= 12 or r["score"] > 0) and 0 < r["share"] <= 1),
    "p6_items": (360, lambda r: 0 <= r["n_exact"] <= r["n_docs"] and (r["longest_run"] >= 12) == (r["n_exact"] > 0)),
    "p7_mixture": (10, lambda r: r["times"] >= 1 and r["n_tokens"] > 0),
    "p7_shares": (7, lambda r: abs(r["share"] - r["target_share"]) < 0.03 and r["most_times"] <= r["max_repeats"]),
    "p8_levels": (100, lambda r: (r["level"] is None) == (r["basis"] is None) and (r["level"] is None or 0 <= r["level"] <= 18)),
    "p8_profile": (10, lambda r: r["n_docs"] > 0),
}


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - set(SQL)))
def test_properties(spark, name):
    least, holds = PROPERTIES[name]
    rows = __spark_entry__.queries()[name](spark, WIDER).collect()
    assert len(rows) >= least
    assert [r for r in rows if not holds(r)] == []


def test_safe_names_of_every_script(spark, duck):
    """Against the rule in Python, whose letters and digits are those of Unicode."""
    import re

    def safe(name):
        return re.sub(r"[^\w\-.+]+", "_", name).strip("_")[:40] or "layer"

    rows = __spark_entry__.queries()["safe_names"](spark, DATA).collect()
    keys = duck.execute("SELECT DISTINCT path, idx FROM layers WHERE path IS NOT NULL AND idx IS NOT NULL AND layer_type <> 'HIDDEN'").fetchall()
    assert sorted((r["path"], r["idx"]) for r in rows) == sorted(keys)
    assert [r["safe"] for r in rows] == [safe(r["name"]) for r in rows]
    assert sum(not r["name"].isascii() for r in rows) > 100


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
