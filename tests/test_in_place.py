"""Edits of documents where they lie: the same bytes as through tables, each document built and read once."""

import pytest

from strata.functions import descriptor, engine_data
from strata.functions.binio import Short
from strata.plans import files
from strata.sources import document, psd

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def contents(spark) -> list[bytes]:
    return [bytes(r["content"]) for r in files.built(spark, DATA).collect()]


def through_tables(data: bytes, key: str, change, blocks=lambda x: x) -> bytes:
    t = document.read("x", data)
    for b in t["info_blocks"]:
        if b["key"] == key and (new := change(b["idx"], b["data"])) is not None:
            b["data"] = new
            t["layers"][b["idx"]]["dirty"] = True
    return document.write(t["documents"][0], t["layers"], t["channels"], t["resources"], blocks(t["document_blocks"]), t["info_blocks"])


def style(x: bytes) -> bytes:
    return engine_data.set_run_style(x, 0, font="Fresh (1)", tracking=-7, color=(0.25, 0.5, 0.75, 1.0))


def built_once(df) -> None:
    """Documents are built and parsed in one stage: nothing is shuffled from the builder on."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3, plan
    assert "Exchange" not in plan[: plan.rindex("MapInArrow")]


def test_texts(contents):
    n = 0
    for data in contents:
        new = document.edit_texts(data, lambda idx, x: style(x))
        assert new == through_tables(data, "TySh", lambda idx, b: document.edit_text_block(b, style))
        n += new != data
    assert n > 3


def test_other_blocks_stay():
    data = document.write(document.blank(4, 4) | {"n_layers": 0}, [], [], [], [{"pos": 0, "sig": "8BIM", "key": "abcd", "data": b"12345", "padding": None, "size": 5}], [])
    assert document.edit_texts(data, lambda idx, x: x) == data
    with pytest.raises(Short):
        document.edit_texts(data[:30], lambda idx, x: x)


def test_broken_documents_are_left_out(spark, contents):
    df = spark.createDataFrame([("a", contents[0]), ("b", contents[0][:40]), ("c", None)], "path string, content binary")
    assert [r["path"] for r in psd.rewritten(df, lambda path, x: document.edit_texts(x, lambda idx, e: engine_data.set_run_style(e, 0, tracking=-7))).collect()] == ["a"]


def test_run_style_builds_once(spark):
    built_once(files.psd_run_style(spark, DATA))


def test_document_text_follows(contents):
    n = 0
    for data in contents:
        new = document.read("x", document.edit_texts(data, lambda idx, x: engine_data.set_text(x, f"new ({idx})"), lambda idx: f"new ({idx})"))
        old = document.read("x", data)
        assert new["documents"][0]["error"] is None and [b["key"] for b in new["document_blocks"] if b["key"] != "Txt2"] == ["lnk2"]
        texts, k = {x["idx"]: x["text_index"] for x in old["text_layers"]}, len(old["txt2_texts"])
        if any(v is None or not 0 <= v < k for v in texts.values()):
            assert not new["txt2_texts"]
            continue
        want = [x["text"] for x in old["txt2_texts"]]
        for text, at in sorted((f"new ({idx})\r", at) for idx, at in texts.items()):
            want[at] = text
        assert [x["text"] for x in new["txt2_texts"]] == want
        n += bool(texts)
    assert n


def test_text_edit_builds_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(psd, "all_tables", lambda saved, names, **more: seen.append(saved) or {t: psd.tables(saved, t, **more) for t in names})
    files.psd_text_edit(spark, DATA)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan[: plan.rindex("MapInArrow")]


def test_effects(contents):
    n = 0

    def change(idx: int, o: dict) -> dict | None:
        return descriptor.merge(o, {"DrSh": {"Dstn": 12.5}}) if descriptor.item(o, "DrSh") else None

    def block(idx: int, b: bytes) -> bytes | None:
        o = change(idx, descriptor.parse(b, 8))
        return b[:8] + descriptor.serialize(o) if o else None

    for data in contents:
        new = document.edit_descriptors(data, "lfx2", change)
        assert new == through_tables(data, "lfx2", block)
        n += new != data
    assert n


def test_effects_edit_builds_once(spark):
    built_once(files.psd_effects_edit(spark, DATA))
