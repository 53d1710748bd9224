"""Common units, resolutions and disagreements."""

import math

import pytest

from strata.operators import units as U

LEAF = "leaf_id bigint, path string, idx int, source string, block string, jpath string, os_type string, val double, unit string, v_string string, recorded_at int"
HEAD = "path string, hres double, hres_unit int, hres_text string, ingested_at int"


def leaf(i, val, unit, text=None, path="a", jpath="Sz", at=1):
    return (i, path, 0, "s", "lfx2", jpath, "UntF", val, unit, text, at)


def test_resolutions(spark):
    rows = [
        ("inch", 300.0, 1, None, 1), ("cm", 118.11, 2, None, 1), ("fixed", 300.0 * 65536, 1, None, 1), ("metre", 2835.0, None, "px/m", 1), ("text", None, None, "118,11 dots per cm", 1), ("ppi", None, None, "240ppi", 1),
        ("none", None, 1, None, 1), ("bad", -1.0, 1, None, 1), ("bad", 144.0, 1, None, 2), ("nan", math.nan, None, None, 1), (None, 72.0, 1, None, 1),
    ]
    got = {r["path"]: (round(r["dpi"]), r["dpi_from"]) for r in U.resolutions(spark.createDataFrame(rows, HEAD)).collect()}
    assert got == {"inch": (300, "number"), "cm": (300, "number"), "fixed": (300, "number"), "metre": (72, "number"), "text": (300, "text"), "ppi": (240, "text"), "none": (72, "default"), "bad": (144, "number"), "nan": (72, "default")}


def test_values(spark):
    heads = spark.createDataFrame([("a", 144.0, 1, None, 1)], HEAD)
    rows = [
        leaf(1, 10.0, "#Pxl"), leaf(2, 36.0, "#Pnt"), leaf(3, 25.4, "#Mlm"), leaf(4, None, None, "2,54 cm"), leaf(5, 1.0, None, "in"), leaf(6, None, None, "6 picas"), leaf(7, None, None, "n/a"), leaf(8, math.nan, "#Pxl"),
        leaf(9, 0.5, "#Nne", jpath="Op"), leaf(10, math.pi, None, "rad", jpath="An"), leaf(11, None, None, "0.5 turn", jpath="An"), leaf(12, None, None, "90°", jpath="An"), leaf(1, 99.0, "#Pxl", at=2),
    ]
    got = {r["leaf_id"]: r for r in U.common_units(spark.createDataFrame(rows, LEAF), heads).collect()}
    want = {1: 10, 2: 72, 3: 144, 4: 144, 5: 144, 6: 144, 7: None, 8: None, 9: 50, 10: 180, 11: 180, 12: 90}
    assert {k: None if r["value"] is None else round(r["value"], 6) for k, r in got.items()} == want
    assert not got[7]["stated"] and got[4]["stated"]


def test_missing_units_are_assigned(spark):
    """Shares known as percents around 40; one bare 0.4 is a ratio, a bare 40 a percent."""
    rows = [leaf(k, 30.0 + k % 20, "#Prc", jpath="Op") for k in range(60)] + [leaf(100, 0.4, None, jpath="Op"), leaf(101, 40.0, None, jpath="Op"), leaf(102, 4.0, None, jpath="Op")]
    got = {r["leaf_id"]: r for r in U.common_units(spark.createDataFrame(rows, LEAF), spark.createDataFrame([], HEAD)).collect()}
    assert got[100]["unit_used"] == "#Nne" and got[100]["value"] == pytest.approx(40) and not got[100]["uncertain"]
    assert got[101]["unit_used"] == "#Prc" and not got[101]["stated"]
    assert got[102]["posterior"] < 1


def test_disagreements(spark):
    rows = [leaf(1, 100.0, "#Pxl"), leaf(2, 102.0, "#Pxl"), leaf(3, 110.0, "#Pxl"), leaf(4, 110.0, "#Pxl"), leaf(5, 500.0, None), leaf(6, 100.0, "#Pxl", path="b"), leaf(7, 0.0, "#Pxl", path="c"), leaf(8, 0.0, "#Pxl", path="c")]
    u = U.common_units(spark.createDataFrame(rows, LEAF), spark.createDataFrame([], HEAD))
    got = {(r[0], r[1]) for r in U.disagreements(u).collect()}
    assert got == {(1, 3), (1, 4), (2, 3), (2, 4)}


def test_empty(spark):
    u = U.common_units(spark.createDataFrame([], LEAF), spark.createDataFrame([], HEAD))
    assert u.count() == 0 and U.disagreements(u).count() == 0
