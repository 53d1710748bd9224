"""The binary format: codecs, descriptors, engine data, documents from their rows and back."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import codec, descriptor, engine_data, image
from strata.functions.binio import Ranged, Writer
from strata.operators import edits
from strata.sources import document, psd
from strata.streaming import documents as streaming


@pytest.mark.parametrize("w,h,kind", [(1, 1, 0), (1, 40, 0), (40, 1, 0), (16, 16, 1), (17, 13, 0), (129, 1, 1), (100, 60, 2)])
@pytest.mark.parametrize("compression", [0, 1, 2, 3])
@pytest.mark.parametrize("depth", [8, 16, 32])
def test_planes(w, h, kind, compression, depth):
    rng = random.Random(w * h)
    plane = bytes([7] * (w * h * depth // 8)) if kind == 1 else bytes(rng.randrange(256 if kind == 0 else 3) for _ in range(w * h * depth // 8))
    assert codec.decode_plane(compression, codec.encode_plane(compression, plane, w, h, depth), w, h, depth) == plane


def test_packbits():
    assert codec.unpack_row(bytes([2, 1, 2, 3, 254, 9, 128, 0, 5]), 7) == bytes([1, 2, 3, 9, 9, 9, 5])
    assert codec.pack_row(b"\x05" * 130) == bytes([129, 5, 255, 5])
    assert codec.pack_row(b"") == b""
    assert codec.decode_plane(9, b"", 2, 2, 8) == b"\xff" * 4


def test_colors():
    assert image.to_bgra({0: np.array([[255]], np.uint8), 1: np.array([[128]], np.uint8), 2: np.array([[128]], np.uint8)}, 9)[0, 0].tolist() == [255, 255, 255, 255]
    full = np.array([[255]], np.uint8)
    assert image.to_bgra({k: full for k in range(4)}, 4)[0, 0, :3].tolist() == [254] * 3
    assert image.samples(b"\x80", 2, 1, 1).tolist() == [[0, 255]]
    px = np.zeros((2, 3, 4), np.uint8)
    px[:, 0] = (10, 20, 30, 255)
    assert image.bleed(px, 1)[0, 1].tolist() == [10, 20, 30, 0]
    assert image.png(px).startswith(b"\x89PNG") and image.bmp(px).startswith(b"BM")


def rich() -> bytes:
    """A descriptor with every kind of item."""
    w = Writer().put("I", 0).put("I", 0).raw("null").put("I", 11)
    ident = lambda s: w.put("I", 0 if len(s) == 4 else len(s)).raw(s)
    ident("Opct"), w.raw("UntF").raw("#Prc").put("d", 40.0)
    ident("Nm  "), w.raw("TEXT").unicode("né\U0001f351")
    ident("longkey"), w.raw("long").put("i", -5)
    ident("Md  "), w.raw("enum"), ident("BlnM"), ident("Mltp")
    ident("enab"), w.raw("bool").put("B", 1)
    ident("Angl"), w.raw("doub").put("d", 1.5)
    ident("list"), w.raw("VlLs").put("I", 2).raw("long").put("i", 1).raw("long").put("i", 2)
    ident("clas"), w.raw("type").put("I", 0), ident("Lyr ")
    ident("data"), w.raw("tdta").put("I", 3).raw(b"xyz")
    ident("refs"), w.raw("obj ").put("I", 2).raw("Idnt").put("I", 7).raw("name").put("I", 0), ident("Lyr "), w.unicode("n")
    ident("sub "), w.raw("Objc").put("I", 0), ident("Clr "), w.put("I", 1)
    ident("Rd  "), w.raw("doub").put("d", 255.0)
    return w.bytes()


def test_descriptor():
    raw = rich()
    o = descriptor.parse(raw)
    assert descriptor.serialize(o) == raw and o["whole"]
    p = descriptor.plain_object(o)
    assert p["Opct"] == {"value": 40.0, "unit": "#Prc"} and p["Nm  "] == "né\U0001f351" and p["list"] == [1, 2] and p["refs"] is None and p["sub "] == {"Rd  ": 255.0}
    assert {x["jpath"] for x in descriptor.leaves(o)} >= {"Opct", "list[1]", "sub.Rd"}
    m = descriptor.merge(o, {"Opct": 55, "sub ": {"Rd  ": 1}})
    assert descriptor.plain_object(m)["Opct"] == {"value": 55.0, "unit": "#Prc"} and descriptor.plain_object(descriptor.parse(descriptor.serialize(m))) == descriptor.plain_object(m)
    assert descriptor.merge(o, {"none": 1}) == o  # keys that it lacks are passed over
    broken = descriptor.parse(raw.replace(b"doub", b"????", 1))
    assert not broken["whole"] and descriptor.item(broken, "Opct") is not None


def engine(text: str = "AAAA\rBBBB\r") -> bytes:
    t = engine_data.string_bytes(text)
    style = b"<<\n/StyleSheet\n<<\n/StyleSheetData\n<<\n/Font 1\n/FontSize 12.5\n/FauxBold true\n/FillColor\n<<\n/Type 1\n/Values [ 1.0 .5 .25 0.0 ]\n>>\n>>\n>>\n>>"
    para = b"<<\n/ParagraphSheet\n<<\n/Properties\n<<\n/Justification 0\n>>\n>>\n>>"
    font = lambda n: b"<<\n/Name " + engine_data.string_bytes(n) + b"\n>>"
    return b"\n\n<<\n/EngineDict\n<<\n/Editor\n<<\n/Text " + t + b"\n>>\n/ParagraphRun\n<<\n/RunArray [\n" + para + b"\n" + para + b"\n]\n/RunLengthArray [ 5 5 ]\n>>\n/StyleRun\n<<\n/RunArray [\n" + style + b"\n]\n/RunLengthArray [ 10 ]\n>>\n>>\n/ResourceDict\n<<\n/FontSet [\n" + font("One") + b"\n" + font("Two()") + b"\n]\n>>\n>>"


def read_engine(data: bytes) -> dict:
    return engine_data.read_text(engine_data.parse(data))


def test_engine_data():
    t = read_engine(engine())
    assert t["text"] == "AAAA\rBBBB\r" and t["fonts"] == ["One", "Two()"] and t["runs"][0]["font"] == "Two()" and t["runs"][0]["r"] == 0.5 and t["runs"][0]["bold"] is True
    assert engine_data.splice(engine(), []) == engine()
    new = read_engine(engine_data.set_text(engine(), "x\U0001f351"))
    assert new["text"] == "x\U0001f351\r" and [r["length"] for r in new["runs"]] == [4] and [p["length"] for p in new["paragraphs"]] == [4]
    rich_text = read_engine(engine_data.set_rich_text(engine(), "0123456789", [{"length": 3, "size": 30.0, "color": (1, 0, 0)}, {"length": 2, "italic": True}], [{"length": 11, "justification": 2}]))
    assert [r["length"] for r in rich_text["runs"]] == [3, 8] and rich_text["runs"][0]["size"] == 30.0 and rich_text["runs"][0]["r"] == 1 and rich_text["runs"][1]["italic"] is True and rich_text["paragraphs"][0]["justification"] == 2
    assert read_engine(engine_data.set_run_style(engine(), 0, tracking=-100))["runs"][0]["tracking"] == -100
    assert [p["justification"] for p in read_engine(engine_data.set_justification(engine(), 1))["paragraphs"]] == [1, 1]
    data, number = engine_data.add_font(engine(), "Three")
    assert number == 2 and read_engine(data)["fonts"][2] == "Three" and engine_data.add_font(engine(), "One")[1] == 0
    assert engine_data.number_bytes(0.5) == b".5" and engine_data.number_bytes(12.0) == b"12.0" and engine_data.number_bytes(-0.25) == b"-.25"
    bare = b"/0 << /1 [ << /0 " + engine_data.string_bytes("abc\r") + b" /5 << /0 [ << /1 4 >> ] >> /6 << /0 [ << /2 1 /1 2 >> << /2 2 /1 2 >> ] >> >> << /0 " + engine_data.string_bytes("z\r") + b" /5 << /0 [ ] >> /6 << /0 [ ] >> >> << /0 " + engine_data.string_bytes("no body") + b" /6 << >> >> ] >>"
    assert engine_data.body_texts(bare) == ["abc\r", "z\r"]
    assert engine_data.body_texts(engine_data.set_body_text(bare, 0, "longer")) == ["longer\r", "z\r"]
    assert b"/1 7" in engine_data.set_body_text(bare, 0, "longer")
    styled = engine_data.set_body_text(bare, 0, "longer", [], [1, 0, 2, 9])
    assert b"[ << /2 1 /1 1 >> << /2 2 /1 2 >> << /2 2 /1 4 >> ]" in styled or b"[<< /2 1 /1 1 >> << /2 2 /1 2 >> << /2 2 /1 4 >> ]" in styled
    assert engine_data.emit_compact(b" " + bare) == b" " + bare
    assert engine_data.fit([3, 0, -2, 2], 11) == [3, 8] and engine_data.fit([0], 4) == [4]
    named = read_engine(engine_data.set_run_style(engine(), 0, font="Four", color=(0.5, 0, 1)))
    assert named["fonts"] == ["One", "Two()", "Four"] and named["runs"][0]["font"] == "Four" and named["runs"][0]["b"] == 1
    indented = engine_data.emit(engine())
    assert engine_data.emit(indented) == indented and read_engine(indented) == t and indented.startswith(b"\n\n<<\n\t/EngineDict\n\t<<\n\t\t/Editor\n")


def sample() -> bytes:
    """Two folders, pictures with a mask, text, effects, resources, trailing blocks and odd padding."""
    ls, cs, bs = [], [], []

    def add(l, c, b):
        ls.append(l)
        cs.extend(c)
        bs.extend(b)

    add(*document.image_layer(0, "bg", 1, bytes((10, 20, 30, 255)) * 48, 8, 6))
    add(*document.divider(1, "</Layer group>", 2, 3))
    l, c, b = document.image_layer(2, "é\U0001f351", 3, bytes((1, 2, 3, 200)) * 16, 4, 4, 1, 1)
    l["mask"] = {"rect_top": 2, "rect_left": 2, "rect_bottom": 4, "rect_right": 4, "default_color": 0, "flags": 0, "user_density": 128, "user_feather": 2.5, "real_flags": None}
    c.append(document.mask_channel(2, 4, bytes((255, 0, 128, 255)), 2, 2))
    b += [{"idx": 2, "pos": 2, "sig": "8BIM", "key": "lfx2", "data": struct.pack(">II", 0, 16) + rich()}, {"idx": 2, "pos": 3, "sig": "8BIM", "key": "lclr", "data": b"\0\5" + b"\0" * 6}, {"idx": 2, "pos": 4, "sig": "8BIM", "key": "iOpa", "data": b"\x80\0\0\0"}]
    add(l, c, b)
    add(*document.divider(3, "folder", 4, 1))
    l, c, b = document.image_layer(4, "text", 5, bytes(16), 2, 2)
    o = {"name": "", "class": ("TxLr", False), "whole": True, "items": [(("Txt ", False), ("TEXT", "AAAA\rBBBB\r\0")), (("Ornt", False), ("enum", (("Ornt", False), ("Hrzn", False)))), (("TextIndex", True), ("long", 0)), (("EngineData", True), ("tdta", engine()))]}
    b.append({"idx": 4, "pos": 2, "sig": "8BIM", "key": "TySh", "data": struct.pack(">h6dhi", 1, 1.0, 0.0, 0.0, 1.0, 3.0, 4.0, 50, 16) + descriptor.serialize(o) + b"tail"})
    add(l, c, b)
    res = [{"pos": 0, "id": 1005, "name": b"", "data": struct.pack(">IHHIHH", 144 << 16, 1, 1, 144 << 16, 1, 1)}, {"pos": 1, "id": 1032, "name": b"odd", "data": struct.pack(">IiiIiB", 1, 576, 576, 1, 320, 1)}, {"pos": 2, "id": 1060, "name": b"", "data": b"<x/>"}]
    txt2 = b"/0 << /0 " + engine_data.string_bytes("AAAA\r") + b" /5 << /0 [ ] >> /6 << /0 [ ] >> >>"
    trailing = [{"pos": 0, "sig": "8BIM", "key": "Txt2", "size": len(txt2), "data": txt2, "padding": None}, {"pos": 1, "sig": "8B64", "key": "lnk2", "size": 3, "data": b"abc", "padding": b"\0"}]
    doc = document.blank(16, 12) | {"n_layers": 5, "merged_alpha": True, "global_mask": b"\0" * 14}
    return document.write(doc, ls, cs, res, trailing, bs)


def again(data: bytes, **changes) -> bytes:
    t = document.read("x", data)
    assert t["documents"][0]["error"] is None
    parts = {k: t[k] for k in ("layers", "channels", "resources", "document_blocks", "info_blocks")} | changes
    return document.write(t["documents"][0], **parts)


def test_round_trip():
    data = sample()
    assert again(data) == data
    t = document.read("x", data)
    l = t["layers"]
    assert [x["layer_type"] for x in l] == ["NORMAL", "HIDDEN", "NORMAL", "FOLDER", "TEXT"]
    assert l[2]["name_unicode"] == "é\U0001f351" and l[2]["mask"]["user_density"] == 128 and l[2]["mask"]["user_feather"] == 2.5 and l[2]["sheet_color"] == 5 and l[2]["fill_opacity"] == 128
    assert t["documents"][0]["hres"] == 144 and t["documents"][0]["merged_alpha"] and t["guides"][0] == {"path": "x", "n": 0, "location": 10.0, "direction": "horizontal"}
    assert t["text_layers"][0]["text"] == "AAAA\rBBBB\r" and t["text_layers"][0]["tx"] == 3.0 and t["text_runs"][0]["font"] == "Two()" and t["txt2_texts"][0]["text"] == "AAAA\r"
    assert [p["length"] for p in t["text_paragraphs"]] == [5, 5]


def test_edited_layers_are_rebuilt():
    data = sample()
    t = document.read("x", data)
    for x in t["layers"]:
        x["dirty"] = True
    for b in t["info_blocks"]:
        if b["key"] == "TySh":
            b["data"] = document.edit_text_block(b["data"], lambda e: engine_data.set_text(e, "new"))
    new = document.read("x", document.write(t["documents"][0], t["layers"], t["channels"], t["resources"], t["document_blocks"], t["info_blocks"]))
    assert new["documents"][0]["error"] is None and new["text_layers"][0]["text"] == "new\r" and new["layers"][2]["mask"]["user_feather"] == 2.5
    assert len(new["layers"]) == 5 and new["info_blocks"][-1]["data"].endswith(b"tail")


def test_broken_files():
    for data in (b"", b"8BPS", b"nope" * 20, sample()[:200], b"8BPS\0\2" + b"\0" * 40):
        t = document.read("x", data)
        assert t["documents"][0]["error"]
    with pytest.raises(ValueError):
        document.image_layer(0, "x", 1, b"", 2, 2)
    with pytest.raises(ValueError):
        document.known_blend("none!")
    with pytest.raises(ValueError):
        document.blank(1, 1, 4)


def test_solid_composite():
    d = document.blank(12, 9) | {"composite": codec.solid_composite([10, 20, 30], 12, 9)}
    planes = codec.composite_planes(d["composite"], 3, 12, 9, 8)
    assert [set(p) for p in planes] == [{10}, {20}, {30}]


def test_spark_tables(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.psd").write_bytes(sample())
    (tmp_path / "bad.psd").write_bytes(b"junk")
    psd.register(spark)
    load = lambda t: spark.read.format("psd").option("table", t).load(str(tmp_path))
    assert load("layers").count() == 15
    docs = load("documents")
    assert docs.where("error is not null").count() == 1
    one = str(tmp_path / "f1.psd")
    assert load("layers").where(F.col("path") == one).count() == 5
    files = spark.read.format("binaryFile").load(str(tmp_path))
    t = {n: psd.tables(files, n) for n in ("documents", "layers", "channels", "resources", "document_blocks")}
    built = psd.assemble(**t)
    assert {bytes(r["content"]) for r in built.collect()} == {sample()}
    built.select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "content").write.format("psd").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "f0.psd").read_bytes() == sample()
    images = psd.layer_images(t["documents"], t["layers"], t["channels"])
    px = {r["idx"]: np.frombuffer(bytes(r["bgra"]), np.uint8).reshape(r["height"], r["width"], 4) for r in images.where("path like '%f0.psd'").collect()}
    assert px[0][0, 0].tolist() == [10, 20, 30, 255]
    assert px[2][:, :, 3].tolist() == [[0, 0, 0, 0], [0, 200, 0, 0], [0, 200 * 128 // 255, 200, 0], [0, 0, 0, 0]]
    assert psd.layer_images(t["documents"], t["layers"], t["channels"], "mask").count() == 3
    flat = psd.composite(t["documents"], t["layers"], images).where("path like '%f0.psd'").first()
    shown = np.frombuffer(bytes(flat["bgra"]), np.uint8).reshape(12, 16, 4)
    assert shown[0, 0].tolist() == [10, 20, 30, 255] and shown[11, 15].tolist() == [0, 0, 0, 0]
    assert psd.merged_images(t["documents"]).count() == 3 and psd.export_png(images).count() == images.count() and psd.bleed(images).count() == images.count()
    assert psd.manifest(t["layers"]).count() == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.psd").write_bytes(sample())
    for _ in range(2):
        streaming.ingest(spark, str(tmp_path / "in"), "layers", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_block_edits(spark, tmp_path):
    from strata.operators import metadata

    (tmp_path / "a.psd").write_bytes(sample())
    files = spark.read.format("binaryFile").load(str(tmp_path))
    t = {n: psd.tables(files, n) for n in ("documents", "layers", "channels", "resources", "document_blocks", "info_blocks", "descriptors")}
    path = t["layers"].first()["path"]
    text = spark.createDataFrame([(path, 4, "edited")], "path string, idx int, text string")
    blocks = metadata.set_text(t["info_blocks"], text)
    style = spark.createDataFrame([(path, 4, 0, -100, True)], "path string, idx int, run int, tracking int, italic boolean")
    blocks = metadata.set_run_style(blocks, style)
    effects = spark.createDataFrame([(path, 2, '{"Opct": 75}')], "path string, idx int, json string")
    blocks = metadata.set_descriptor(blocks, effects)
    layers = metadata.mark_dirty(t["layers"], text.select("path", "idx").union(effects.select("path", "idx")))
    new = spark.createDataFrame([(path, b"Txt2 gone")], "path string, data binary")
    trailing = metadata.set_document_block(metadata.set_document_block(t["document_blocks"], new, "FMsk"), new.withColumn("data", F.lit(None).cast("binary")), "Txt2")
    built = psd.assemble(t["documents"], layers, t["channels"], t["resources"], trailing, blocks).first()
    got = document.read("x", bytes(built["content"]))
    assert got["documents"][0]["error"] is None and got["text_layers"][0]["text"] == "edited\r"
    assert got["text_runs"][0]["tracking"] == -100 and got["text_runs"][0]["italic"] is True
    assert '"value": 75.0' in got["descriptors"][0]["json"]
    assert [b["key"] for b in got["document_blocks"]] == ["lnk2", "FMsk"] and got["document_blocks"][1]["data"] == b"Txt2 gone"
    assert metadata.xmp(t["resources"]).first()["xmp"] == "<x/>" and metadata.resource_ids(t["resources"]).first()["ids"] == [1005, 1032, 1060]
    assert metadata.info_keys(t["info_blocks"]).where("idx = 2").first()["keys"] == ["luni", "lyid", "lfx2", "lclr", "iOpa"]
    assert bytes(metadata.info_block(t["info_blocks"], "lyid").where("idx = 2").first()["data"]) == b"\0\0\0\3"
    assert metadata.document_block(t["document_blocks"], "lnk2").count() == 1 and metadata.effects(t["descriptors"]).count() == 1 and metadata.fills(t["descriptors"]).count() == 0
    n = t["resources"].where("id = 1005").select(metadata.big_endian(F.col("data"), 0, 4).alias("n"), metadata.big_endian(F.unhex(F.lit("FFFE")), 0, 2, True).alias("m"), metadata.padding(F.lit(5), 4).alias("p")).first()
    assert (n["n"], n["m"], n["p"]) == (144 << 16, -2, 3)
    assert spark.range(1).select(metadata.utf16_to_utf8(metadata.utf8_to_utf16(F.lit("é\U0001f351"))).alias("t"), metadata.fixed_to_dpi(F.lit(144 << 16)).alias("d")).first()[0:2] == ("é\U0001f351", 144.0)


def test_pixel_edits(spark, tmp_path):
    (tmp_path / "a.psd").write_bytes(sample())
    files = spark.read.format("binaryFile").load(str(tmp_path))
    t = {n: psd.tables(files, n) for n in ("documents", "layers", "channels", "resources", "document_blocks", "info_blocks")}
    path = t["layers"].first()["path"]
    new = spark.createDataFrame([(path, 2, 2, 3, bytearray(bytes((9, 8, 7, 255)) * 6))], "path string, idx int, width int, height int, bgra binary")
    layers, channels = psd.set_layer_pixels(t["layers"], t["channels"], new)
    mask = spark.createDataFrame([(path, 0, 1, 2, 2, 1, bytearray(b"\x10\x20"))], "path string, idx int, top int, left int, width int, height int, plane binary")
    layers, channels = psd.set_mask_pixels(layers, channels, mask)
    docs = psd.set_composite(t["documents"], spark.createDataFrame([(path, 1, 2, 3)], "path string, r int, g int, b int"))
    built = bytes(psd.assemble(docs, layers, channels, t["resources"], t["document_blocks"], t["info_blocks"]).first()["content"])
    got = document.read("x", built)
    assert got["documents"][0]["error"] is None
    l = got["layers"]
    assert (l[2]["rect_right"] - l[2]["rect_left"], l[2]["rect_bottom"] - l[2]["rect_top"]) == (2, 3)
    assert [c["ch_id"] for c in got["channels"] if c["idx"] == 2] == [-1, 0, 1, 2, -2] and [c["ch_id"] for c in got["channels"] if c["idx"] == 0] == [-1, 0, 1, 2, -2]
    assert [l[0]["mask"][k] for k in ("rect_top", "rect_left", "rect_bottom", "rect_right")] == [1, 2, 2, 4]
    px = codec.decode_plane(*[next(c for c in got["channels"] if c["idx"] == 0 and c["ch_id"] == -2)[k] for k in ("compression", "data")], 2, 1, 8)
    assert px == b"\x10\x20" and codec.composite_planes(got["documents"][0]["composite"], 3, 16, 12, 8)[2] == b"\3" * 192


def test_command_line(tmp_path, capsys):
    from strata.__main__ import main

    (tmp_path / "a.psd").write_bytes(sample())
    (tmp_path / "b.psd").write_bytes(b"junk")
    assert main(str(tmp_path / "a.psd")) == 0 and "5 layers" in capsys.readouterr().out
    assert main(str(tmp_path / "b.psd")) == 1


def obj(name: str, *items) -> tuple:
    """An object of (key, node) items."""
    return {"name": "", "class": (name, len(name) != 4), "whole": True, "items": [((k, len(k) != 4), n) for k, n in items]}


def test_metadata_blocks():
    comps = obj("CompList", ("list", ("VlLs", [("Objc", obj("Comp", ("compID", ("long", 7)), ("Nm  ", ("TEXT", "one\0")), ("comment", ("TEXT", "c\0")), ("capturedInfo", ("long", 5))))])), ("lastAppliedComp", ("long", 7)))
    setting = lambda on, x, ids: ("Objc", obj("null", *([("enab", ("bool", on))] if on is not None else []), ("Ofst", ("Objc", obj("Pnt ", ("Hrzn", ("long", x)), ("Vrtc", ("long", 2))))), ("compList", ("VlLs", [("long", i) for i in ids]))))
    state = obj("null", ("LayerID", ("long", 1)), ("layerSettings", ("VlLs", [setting(True, 4, [7]), setting(None, 0, [8])])))
    body = struct.pack(">I", 16) + descriptor.serialize(state)
    shmd = struct.pack(">I", 1) + b"8BIMcmls\0\0\0\0" + struct.pack(">I", len(body)) + body
    uni = lambda s: struct.pack(">I", len(s)) + s.encode("utf-16-be")
    one = struct.pack(">3i", 1, 2, 1) + struct.pack(">i", 9) + uni("s") + struct.pack(">5i", 1, 0, 0, 10, 20) + uni("u") + uni("t") + uni("m") + uni("a") + b"\1" + uni("cell") + struct.pack(">2i", 0, 1) + bytes((255, 1, 2, 3))
    slices = struct.pack(">I4i", 6, 0, 0, 10, 20) + uni("all") + struct.pack(">I", 1) + one
    resources = [
        {"pos": 0, "id": 1065, "name": b"", "data": struct.pack(">I", 16) + descriptor.serialize(comps)}, {"pos": 1, "id": 1050, "name": b"", "data": slices},
        {"pos": 2, "id": 1033, "name": b"", "data": struct.pack(">III", 1, 4, 3) + b"\0" * 16 + b"old"}, {"pos": 3, "id": 1036, "name": b"", "data": struct.pack(">III", 1, 8, 6) + b"\0" * 16 + b"jpeg"},
        {"pos": 4, "id": 1046, "name": b"", "data": struct.pack(">h", 3)}, {"pos": 5, "id": 1047, "name": b"", "data": struct.pack(">h", 1)}, {"pos": 6, "id": 1050, "name": b"", "data": b"\0"},
    ]
    l, c, b = document.image_layer(0, "x", 1, bytes(4), 1, 1)
    b += [{"idx": 0, "pos": 2, "sig": "8BIM", "key": "shmd", "data": shmd}, {"idx": 0, "pos": 3, "sig": "8BIM", "key": "hue2", "data": b"\0\0"}, {"idx": 0, "pos": 4, "sig": "8BIM", "key": "SoCo", "data": b"\0\0\0\x10" + rich()}, {"idx": 0, "pos": 5, "sig": "8B64", "key": "lsct", "data": b"\0\0\0\1"}]
    doc = document.blank(4, 4) | {"mode": 2, "color_data": bytes(range(256)) + bytes([5] * 256) + bytes([6] * 256), "n_layers": 1}
    t = document.read("x", document.write(doc, [l], c, resources, [], b))
    assert t["documents"][0]["error"] is None and t["documents"][0]["last_applied_comp"] == 7
    assert t["comps"] == [{"path": "x", "id": 7, "name": "one", "comment": "c", "record_visibility": True, "record_position": False, "record_appearance": True}]
    assert [(s["comp_id"], s["enabled"], s["offset_x"], s["offset_y"]) for s in t["layer_comp_states"]] == [(7, True, 4, 2), (8, True, 0, 2)]
    assert t["slices"][0]["associated_layer_id"] == 9 and t["slices"][0]["cell_text"] == "cell" and t["slices"][0]["is_cell_text_html"] and (t["slices"][0]["right"], t["slices"][0]["b"]) == (10, 3)
    assert t["thumbnails"] == [{"path": "x", "format": 1, "width": 8, "height": 6, "data": b"jpeg"}]
    assert [(p["n"], p["r"], p["g"], p["a"]) for p in t["palette"]] == [(0, 0, 5, 255), (1, 1, 5, 0), (2, 2, 5, 255)]
    assert t["layers"][0]["layer_type"] == "FILL" and t["layers"][0]["info_keys"][-1] == "lsct"
    assert {d["block"] for d in t["descriptors"]} == {"SoCo"}


# ---------------------------------------------------------------------------------------------------- edits that are saved


def saved(spark, change, data: bytes | None = None) -> dict[str, list[dict]]:
    """The tables of a document after an edit of its tables, written and read again."""
    t = psd.all_tables(spark.createDataFrame([("x", data or sample())], "path string, content binary"))
    out = psd.assemble(**change(t)).first()["content"]
    return document.read("x", bytes(out))


def raw_layers(t: dict[str, list[dict]]) -> dict[int, tuple]:
    """Extra data and channels of each layer by its id."""
    chans: dict[int, list] = {}
    for c in t["channels"]:
        chans.setdefault(c["idx"], []).append((c["ch_id"], c["compression"], c["data"]))
    return {x["layer_id"]: (x["extra"], chans[x["idx"]]) for x in t["layers"]}


def test_untouched_layers_stay_as_they_are(spark):
    before = raw_layers(document.read("x", sample()))
    at = lambda **k: spark.createDataFrame([{"path": "x", **k}])
    gone = saved(spark, lambda t: edits.in_documents(t, edits.delete, F.col("idx") == 0))
    assert [x["layer_id"] for x in gone["layers"]] == [2, 3, 4, 5] and raw_layers(gone) == {k: v for k, v in before.items() if k != 1}
    moved = saved(spark, lambda t: edits.in_documents(t, edits.move, at(**{"from": 0, "to": 2})))
    assert [x["layer_id"] for x in moved["layers"]] == [2, 3, 1, 4, 5] and raw_layers(moved) == before
    twice = saved(spark, lambda t: edits.in_documents(t, edits.duplicate, at(idx=2)))
    assert [x["layer_id"] for x in twice["layers"]] == [1, 2, 3, 6, 4, 5]
    new = raw_layers(twice)
    copy = new.pop(6)
    assert new == before and copy[1] == before[3][1] and twice["layers"][3]["mask"] == twice["layers"][2]["mask"] and twice["layers"][3]["fill_opacity"] == 128
    folder = saved(spark, lambda t: edits.in_documents(t, edits.add_folder, at(first=0, count=1, name="née")))
    assert [x["layer_type"] for x in folder["layers"]] == ["HIDDEN", "NORMAL", "FOLDER", "HIDDEN", "NORMAL", "FOLDER", "TEXT"]
    assert folder["layers"][2]["name_unicode"] == "née" and folder["layers"][2]["blend_mode"] == "PASS_THROUGH" and {k: v for k, v in raw_layers(folder).items() if k in before} == before
    named = saved(spark, lambda t: t | {"layers": edits.set_columns(t["layers"], F.col("idx") == 2, name_unicode=F.lit("new"), fill_opacity=F.lit(99), opacity=F.lit(-3))})
    x = named["layers"][2]
    assert (x["name_unicode"], x["name_raw"], x["fill_opacity"], x["opacity"], x["info_keys"]) == ("new", b"new", 99, 0, document.read("x", sample())["layers"][2]["info_keys"])
    assert {k: v for k, v in raw_layers(named).items() if k != 3} == {k: v for k, v in before.items() if k != 3}
    with pytest.raises(Exception, match="info blocks"):
        saved(spark, lambda t: {k: v for k, v in t.items() if k != "info_blocks"} | {"layers": edits.set_columns(t["layers"], F.col("idx") == 2, opacity=F.lit(1))})
    with pytest.raises(Exception, match="without a mask"):
        saved(spark, lambda t: t | {"layers": edits.set_mask(t["layers"], density=F.lit(1), where=F.col("idx") == 0, strict=True)})


def test_only_the_wanted_ranges_are_read(spark, tmp_path):
    big = document.write(document.blank(600, 500) | {"n_layers": 1}, *[[x] if isinstance(x, dict) else x for x in document.image_layer(0, "noise", 1, np.random.default_rng(1).integers(0, 256, 600 * 500 * 4, dtype=np.uint8).tobytes(), 600, 500)][:2], [], [], [])
    r = Ranged(lambda n, at: big[at : at + n], len(big), 512)
    assert document.read("x", r, {"layers"})["layers"][0]["rect_right"] == 600 and r.fetched < 4096 < len(big)
    assert document.read("x", Ranged(lambda n, at: big[at : at + n], len(big))) == document.read("x", big)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.psd").write_bytes(big)
    psd.register(spark)
    for where in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/sub/*.psd"):
        assert spark.read.format("psd").option("table", "layers").load(where).first()["name_unicode"] is None
    lean = spark.read.format("psd").option("table", "channels").option("pixels", "false").load(str(tmp_path))
    assert {(c["ch_id"], c["compression"], c["data"]) for c in lean.collect()} == {(k, 1, None) for k in range(-1, 3)}


def test_names_of_files_do_not_clash(spark, tmp_path):
    rows = spark.createDataFrame([("a/b_c", b"1"), ("a_b/c", b"2"), ("é", b"3")], "path string, content binary")
    psd.register(spark)
    rows.write.format("psd").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.read_bytes() for p in (tmp_path / "out").iterdir()) == [b"1", b"2", b"3"]
    with pytest.raises(Exception, match="same path"):
        rows.union(rows).write.format("psd").mode("append").save(str(tmp_path / "again"))
    assert list((tmp_path / "again").iterdir()) == []


def test_indexed_and_float_composites(spark):
    table = bytes(range(256)) + bytes(255 - k for k in range(256)) + bytes(256)
    doc = {"version": 1, "channels": 1, "height": 1, "width": 2, "depth": 8, "mode": 2, "color_data": table, "n_layers": 0, "no_layers": True, "composite": b"\0\0" + bytes((3, 200))}
    ink = struct.pack(">8f", *([0.5] * 2 + [0.0] * 2 + [1.0] * 2 + [0.25] * 2))
    cmyk = doc | {"channels": 4, "depth": 32, "mode": 4, "color_data": b"", "composite": b"\0\0" + ink}
    files = spark.createDataFrame([("i", document.write(doc, [], [], [], [])), ("k", document.write(cmyk, [], [], [], []))], "path string, content binary")
    px = {r["path"]: bytes(r["bgra"]) for r in psd.merged_images(psd.tables(files, "documents")).collect()}
    assert px["i"] == bytes((0, 252, 3, 255, 0, 55, 200, 255))
    assert px["k"] == bytes((0, 191, 96, 255)) * 2


def test_section_dividers_override_the_blend_mode():
    l, c, b = document.divider(0, "f", 1, 2)
    t = document.read("x", document.write(document.blank(4, 4) | {"n_layers": 1}, [l | {"blend_key": "norm"}], c, [], [], b))
    assert (t["layers"][0]["blend_key"], t["layers"][0]["blend_mode"], t["layers"][0]["layer_type"]) == ("norm", "PASS_THROUGH", "FOLDER")
