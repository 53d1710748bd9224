"""Small cases of layers, pixels, text, comps and edits against hand-made results."""

from pyspark.sql import functions as F

from strata.operators import comps, edits, layers, pixels, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_keys_and_flags(spark):
    r = one(spark, layers.fourcc_to_int(F.lit("lgCl")), layers.int_to_fourcc(F.lit(0x6C67436C)), layers.blend_mode(F.lit("lgCl")), layers.blend_mode(F.lit("ltCl")), layers.blend_mode(F.lit("xxxx")), layers.blend_mode(F.lit("mul ")))
    assert tuple(r) == (0x6C67436C, "lgCl", "LIGHTER_COLOR", "LIGHTER_COLOR", "INVALID", "MULTIPLY")
    r = one(spark, layers.visible(F.lit(2)), layers.visible(F.lit(9)), layers.bit(F.lit(9), 3), layers.label(F.lit(5)), layers.label(F.lit(77)), layers.safe_name(F.lit("  a/b:c é!")), layers.safe_name(F.lit("")))
    assert tuple(r) == (False, True, True, "blue", "unknown", "a_b_c_é", "layer")


def test_once(spark):
    df = spark.createDataFrame([("a", 1, None, 5), ("a", 1, 3, 4), ("b", 1, 2, 9), ("b", 1, 2, 8)], "path string, idx int, at int, v int")
    assert {tuple(r) for r in layers.once(df, ["path", "idx"], ["at", "v"]).collect()} == {("a", 1, None, 5), ("b", 1, 2, 8)}


def test_colors(spark):
    white = one(spark, *pixels.lab_to_rgb(F.lit(255), F.lit(128), F.lit(128)))
    black = one(spark, *pixels.lab_to_rgb(F.lit(0), F.lit(128), F.lit(128)))
    assert tuple(white) == (255, 255, 255) and tuple(black) == (0, 0, 0)
    assert tuple(one(spark, *pixels.cmyk_to_rgb(*[F.lit(255)] * 4))) == (254, 254, 254)
    assert tuple(one(spark, *pixels.cmyk_float_to_rgb(F.lit(0.0), F.lit(1.0), F.lit(0.5), F.lit(0.0)))) == (255, 0, 128)
    r = one(spark, pixels.mask_alpha(F.lit(200), F.lit(128), F.lit(True), F.lit(0)), pixels.mask_alpha(F.lit(200), F.lit(128), F.lit(False), F.lit(0)), pixels.mask_alpha(F.lit(200), F.lit(128), F.lit(False), F.lit(255)), pixels.fold_opacity(F.lit(255), F.lit(128)))
    assert tuple(r) == (200 * 128 // 255, 0, 200, 128)


def test_source_over_folds_in_order(spark, monkeypatch):
    rows = [("a", k, (k * 37) % 256, (k * 91) % 256, k % 256, 40 + k % 100) for k in range(30)]
    df = spark.createDataFrame(rows, "p string, idx int, r int, g int, b int, a int")
    whole = pixels.source_over(df, ["p"]).first()
    monkeypatch.setattr(pixels, "FOLD", 4)
    assert pixels.source_over(df, ["p"]).first() == whole
    acc = [0.0] * 4
    for _, _, r, g, b, a in rows:
        a /= 255
        acc = [v / 255 * a + x * (1 - a) for v, x in zip((r, g, b), acc)] + [a + acc[3] * (1 - a)]
    assert [whole[c] for c in "rgb"] == [int(x / acc[3] * 255 + 0.5) for x in acc[:3]]
    assert pixels.source_over(spark.createDataFrame([("t", 0, 9, 9, 9, 0)], df.schema), ["p"]).first()[1:] == (0, 0, 0, 0)


def test_text(spark):
    t = spark.createDataFrame([("a", 0, "AAAA\rBBBB"), ("b", 0, "x\U0001f351"), ("c", 0, None), ("d", 0, "")], "path string, idx int, text string")
    paras = {(r["path"], r["para"]): (r["body"], r["length"]) for r in text.paragraphs(t, ["path", "idx"]).collect()}
    assert paras == {("a", 0): ("AAAA", 5), ("a", 1): ("BBBB", 5), ("b", 0): ("x\U0001f351", 4), ("d", 0): ("", 1)}
    runs = spark.createDataFrame([("a", 0, 0, 3), ("a", 0, 1, 2), ("b", 0, 0, 9), ("b", 0, 1, 9)], "path string, idx int, run int, length int")
    fitted = {(r["path"], r["run"]): r["length"] for r in text.fit_lengths(runs, t, ["path", "idx"]).collect()}
    assert fitted == {("a", 0): 3, ("a", 1): 7, ("b", 0): 4, ("b", 1): 0}


def test_variations(spark):
    rows = [("a", 9, "NORMAL", 1), ("a", 9, "NORMAL", 2), ("a", 9, "TEXT", 3), ("a", 20, "FILL", 11), ("a", 20, "NORMAL", 12), ("a", -1, "NORMAL", 30), ("a", 40, "NORMAL", 31)]
    tree = spark.createDataFrame(rows, "path string, parent int, layer_type string, idx int")
    options = comps.option_groups(tree)
    got: dict = {}
    for r in comps.variations(options, limit=24).collect():
        got.setdefault(r["variation"], {})[r["folder"]] = r["idx"]
    assert [got[k] for k in range(6)] == [{9: a, 20: b} for a in (1, 2, 3) for b in (11, 12)] and len(got) == 6
    assert {r["variation"] for r in comps.variations(options, limit=4).collect()} == {0, 1, 2, 3}


def test_visibility(spark):
    l = spark.createDataFrame([("a", 0, True), ("a", 1, False)], "path string, idx int, visible boolean")
    c = spark.createDataFrame([("a", 1), ("a", 2)], "path string, comp_id int")
    s = spark.createDataFrame([("a", 0, 2, False)], "path string, idx int, comp_id int, enabled boolean")
    got = {(r["idx"], r["comp_id"]): r["shown"] for r in comps.visibility(l, c, s).collect()}
    assert got == {(0, 1): True, (0, 2): False, (1, 1): False, (1, 2): False}


def test_move_text_rounds_away_from_zero(spark):
    t = spark.createDataFrame([(1.0, 2.0, 0, 0, 10, 10)], "tx double, ty double, rect_top int, rect_left int, rect_bottom int, rect_right int")
    r = edits.move_text(t, F.lit(2.5), F.lit(-2.5)).first()
    assert (r["tx"], r["ty"], r["rect_left"], r["rect_top"]) == (3.5, -0.5, 3, -3)


def test_runs_and_sizes(spark):
    rows = [("a", k, v) for k, v in enumerate([1, 1, 1, 2, 3, 3, 4])] + [("b", k, 7) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    runs = pixels.byte_runs(df, "k", "pos", "v")
    assert {(r["start"], r["length"], r["value"]) for r in runs.where("k = 'a'").collect()} == {(0, 3, 1), (3, 1, 2), (4, 2, 3), (6, 1, 4)}
    assert {r["k"]: r["size"] for r in pixels.packbits_size(runs, "k").collect()} == {"a": 2 + 2 + 2 + 2, "b": 6}


def test_bleed(spark):
    px = spark.createDataFrame([("a", 0, 0, 10, 20, 30, 255), ("a", 1, 0, 0, 0, 0, 0), ("a", 3, 0, 0, 0, 0, 0)], "p string, x int, y int, r int, g int, b int, a int")
    got = {r["x"]: (r["r"], r["a"], r["filled"]) for r in pixels.bleed_pass(px, ["p"]).collect()}
    assert got == {0: (10, 255, False), 1: (10, 0, True), 3: (0, 0, False)}


def test_replace_blocks(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "z")], "id int, key string, data string")
    new = spark.createDataFrame([(2, "a", "new"), (3, "a", None), (4, "a", "add")], "id int, key string, data string")
    assert {tuple(r) for r in edits.replace_blocks(old, new, ["id", "key"]).collect()} == {(1, "a", "x"), (2, "a", "new"), (4, "a", "add")}
