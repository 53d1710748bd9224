"""Truncation, wrong encodings and look-alikes on made-up names."""

import random

import pytest

from strata.llm import confusables, lookalike, mojibake, truncation

LAYER = "path string, idx int, source string, layer_name string, name_unicode string, field string, value string, words string, garbled boolean"
WORDS = "button shadow header footer banner texture menu logo border window slider avatar ribbon corner".split()
ACCENTS = "página camada sombra título botão edição versão coração promoção rodapé".split()
CYRILLIC = "кнопка папка слой текст картинка обложка заголовок меню".split()
KANA = "レイヤー ボタン メニュー グループ アイコン ヘッダー".split()


def names(n=1500, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = rng.choices(rng.choice([WORDS, WORDS, ACCENTS, CYRILLIC, KANA]), k=rng.randint(1, 5))
        out.append(rng.choice(" _-").join(words) + rng.choice(["", "", " 4", " copy"]))
    return out


def layers(spark, values):
    """One path per value, both fields alike unless a pair is given."""
    rows = []
    for k, v in enumerate(values):
        a, b = v if isinstance(v, tuple) else (v, v)
        rows.append((f"p{k}", 0, "src", a, b, "clash", "clash", None, None))
    return spark.createDataFrame(rows, LAYER)


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    values = names(3000, 8)
    words = Counter(w for v in values for w in v.replace("_", " ").replace("-", " ").split() if not w.isascii())
    return mojibake.Plausibility(Counter(g for v in values for g in mojibake.bigrams_of(v)), words)


@pytest.mark.parametrize("text,shown,written", [("título botão", "cp1252", "utf-8"), ("слой меню", "latin-1", "cp1251"), ("レイヤー ボタン", "cp1252", "utf-8"), ("レイヤー", "latin-1", "euc_jp"), ("картинка", "cp1251", "utf-8"), ("coração edição", "mac_roman", "cp1252"), ("メニュー アイコン", "mac_roman", "cp932"), ("versão", "cp437", "utf-8"), ("папка", "gbk", "utf-8")])
def test_restores(model, text, shown, written):
    holes = {c: c for c in "\x81\x8d\x8f\x90\x9d"}
    raw = text.encode(written)
    bad = "".join(holes.get(chr(b)) or bytes([b]).decode(shown) for b in raw) if shown == "cp1252" else raw.decode(shown)
    garbled, restored, steps = mojibake.judge(bad, model)
    assert garbled and restored == text and steps


def test_restores_twice(model):
    bad = "edição versão".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.judge(bad, model)[:2] == (True, "edição versão")


@pytest.mark.parametrize("text", [None, "", "button", "título botão", "слой", "レイヤー ボタン", "menu 4", "x" * 100_000, "título " * 5000])
def test_leaves_correct_text(model, text):
    assert mojibake.judge(text, model)[:2] == (False, text)


def test_escapes(model):
    """Escapes in plain ASCII are searched too; those of plain ASCII are no wrong decoding."""
    for bad in ("t&#237;tulo bot&atilde;o", "t%C3%ADtulo bot%C3%A3o", "t=C3=ADtulo bot=C3=A3o", "\\u0074\\u00edtulo bot\\u00e3o", "t&amp;#237;tulo bot&amp;#227;o"):
        assert mojibake.judge(bad, model)[:2] == (True, "título botão"), bad
    for fine in ("logo &amp; menu", "menu 100%", "a=1", "layer %20 copy"):
        assert not mojibake.judge(fine, model)[0], fine


@pytest.mark.parametrize("shown, written", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "cp1252"), ("cp1252", "cp932"), ("gbk", "utf-8")])
def test_restores_unseen_names(model, shown, written):
    """Names that the model has not seen, of words that it has."""
    pool = KANA if written == "cp932" or shown == "gbk" else ACCENTS if written == "cp1252" else [*ACCENTS, *CYRILLIC]
    rng, right, n = random.Random(11), 0, 0
    for _ in range(120):
        name = " ".join(rng.choices(pool, k=rng.randint(2, 5)))
        try:
            bad = name.encode(written).decode(shown)
        except UnicodeDecodeError:
            continue
        if bad != name:
            n += 1
            right += mojibake.judge(bad, model)[1] == name
    assert n > 5 and right >= 0.95 * n


def test_double_decoding_is_undone(model):
    for name in ("coração edição", "папка слой", "レイヤー ボタン"):
        twice = name.encode().decode("latin-1").encode().decode("latin-1")
        assert mojibake.judge(twice, model)[:2] == (True, name)


def test_lost_characters(model):
    garbled, restored, _ = mojibake.judge("t�tulo bot�o", model)
    assert garbled and restored == "título botão"
    assert mojibake.judge("T��TULO edi��o", model)[1] == "TÍTULO edição"
    assert not mojibake.judge("título coraç�", model)[0]  # half a character at a cut end
    assert mojibake.judge("men\x83u", model)[0]


def test_garbled_rows(spark):
    good = names()
    bad = "promoção edição".encode().decode("cp1252")
    df = layers(spark, [*good, (bad, None), (None, None), ("", bad), (bad, "promoção edição")])
    df = df.unionByName(df.where("path like 'p150%'"))  # delivered twice
    got = {(r["path"], r["field"]): r["restored"] for r in mojibake.garbled(df).collect()}
    assert got == {("p1500", "layer_name"): "promoção edição", ("p1502", "name_unicode"): "promoção edição", ("p1503", "layer_name"): "promoção edição"}
    assert mojibake.garbled(layers(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,form,why",
    [
        ("\uff22utton", "Button", ["width"]), ("a\u3000b", "a b", ["blank", "width"]), ("e\u0301t", "\u00e9t", ["marks"]), ("\u30cf\u3099", "\u30d0", ["marks"]), ("\uff8a\uff9e", "\u30d0", ["width"]),
        ("\u1105\u1166", "\ub808", ["marks"]), ("\u30cf\u309b", "\u30d0", ["marks"]), ("a\u200bb", "ab", ["invisible"]), ("a\u202fb", "a b", ["blank"]), ("b\u0430nner", "banner", ["script"]),
        ("C\u043b\u043e\u0439", "\u0421\u043b\u043e\u0439", ["script"]), ("\u03bdect\u03bfr", "vector", ["script"]), ("\u0435\u0301a", "\u00e9a", ["script"]),
        ("\U0001f469\u200d\U0001f3a8 x\r", "\U0001f469\u200d\U0001f3a8 x\r", []), ("\u2764\ufe0f", "\u2764\ufe0f", []), ("\u043a\u043d\u043e\u043f\u043a\u0430", "\u043a\u043d\u043e\u043f\u043a\u0430", []), ("\u03b1\u7248 \u2122 \xb2", "\u03b1\u7248 \u2122 \xb2", []),
        (None, None, []), ("", "", []), ("plain", "plain", []), ("\u200b", "", ["invisible"]), ("\u0646\u200c\u0627", "\u0646\u200c\u0627", []),
    ],
)
def test_fold(text, form, why):
    assert confusables.fold(text) == (form, why)


@pytest.mark.parametrize("text,form", [("l\u0251yer", "layer"), ("\u13deayer", "Layer"), ("\U0001d400\U0001d401", "AB"), ("\ufb01le", "file"), ("\u2173", "iv"), ("l\u0430yer\u30c6", "layer\u30c6"), ("\u2460\u339c", "\u2460\u339c"), ("\u03a9mega", "\u03a9mega"), ("\u02a4\u026a\u0259", "\u02a4\u026a\u0259"), ("\u05e9\u05dc\u05d5\u05dd", "\u05e9\u05dc\u05d5\u05dd"), ("\uff2c\u0430yer", "Layer")])
def test_fold_with_all_shapes(spark, text, form):
    known = confusables.shapes(spark)
    assert confusables.fold(text, known, True)[0] == form
    assert confusables.fold(form, known, True)[0] == form


def test_every_letter_with_a_look_alike_is_found_within_a_word(spark):
    """Each look-alike of an everyday Latin letter, put into Latin words in its place."""
    known = confusables.shapes(spark)
    alike = [(c, i["LATIN"]) for c, i in known.image.items() if "LATIN" in i and i["LATIN"].isascii() and "LATIN" not in confusables.scripts(c)]
    right = sum(confusables.fold(f"wrd{c}q", known)[0] == f"wrd{b}q" for c, b in alike)
    assert len(alike) > 150 and right >= 0.99 * len(alike)


def test_fold_is_stable():
    rng = random.Random(4)
    chars = "abe\u0301\u200b\u3000\uff21\uff76\uff9e\u0430\u0435\u03bf\ub80c\u1105\u11ab\U0001f469\u200d\ufe0f\r"
    for _ in range(3000):
        t = "".join(rng.choices(chars, k=rng.randint(0, 12)))
        once = confusables.fold(t)[0]
        assert confusables.fold(once)[0] == once


def test_disguised_rows(spark):
    good = names()
    texts = spark.createDataFrame([("t", 0, "a line\r", "x"), ("t", 0, "a line\r", "y"), ("t", 1, None, ""), ("t", 2, "", ""), ("t", 3, "\U0001f469\u200d\U0001f3a8\r", ""), (None, 4, "\u200b", ""), ("t", 5, "x\u200b" * 20_000, "")], "path string, idx int, text string, value string")
    swap = {"c": "с", "o": "о", "p": "р", "y": "у", "e": "е", "x": "х"}
    whole = "".join(swap[c] for c in "copy")
    bad = "promoção edição".encode().decode("cp1252")
    df = layers(spark, [*good, f"logo {whole}", bad, "b\u0430nner", None])
    m = mojibake.plausibility(df, ["layer_name", "name_unicode"])
    got = {(r["path"], r["idx"], r["field"]): r["form"] for r in lookalike.disguised(df, texts, m).collect()}
    assert got.pop(("t", 5, "text")) == "x" * 20_000
    assert got == {("t", 0, "text"): "a line\r", ("p1500", 0, "name_unicode"): "logo copy", ("p1502", 0, "name_unicode"): "banner"}
    forms = lookalike.one_form(lookalike.values_of(df, texts), m)
    assert forms.count() == df.count() + 6 and forms.where("value is null and form is not null").count() == 0


def sentences(n=600):
    rng = random.Random(6)
    noun = "button shadow header layer window folder poster".split()
    return [f"Please {rng.choice(['check', 'move', 'open'])} the {rng.choice(noun)} and the {rng.choice(noun)} before {rng.choice(['Monday', 'Friday', 'noon'])}" for _ in range(n)]


def test_truncated_rows(spark):
    cases = ["button shad", ("logo_head", "logo_header"), "Please check the button and the", "Please open the window and ", "página tít", "папка карти", "メニュー レイ", "título coraç�"]
    whole = ["shadow", "menu 4", "Please move the folder and the poster before noon", "logo copy", "", None, "Я", "кнопка"]
    df = layers(spark, [*names(4000, 1), *sentences(), *cases, *whole])
    m = mojibake.plausibility(df, ["layer_name", "name_unicode"])
    base = 4600
    found = {(int(r["path"][1:]) - base, r["field"]) for r in truncation.truncated(df, m).collect()}
    wanted = {(k, f) for k, c in enumerate(cases) for f, v in zip(truncation.FIELDS, c if isinstance(c, tuple) else (c, c)) if v != "logo_header"}
    assert found == wanted
    report = {(r["source"], r["field"]): r["n_cut"] for r in truncation.report(df, m).collect()}
    assert report == {("src", "layer_name"): 8, ("src", "name_unicode"): 7}
    empty = layers(spark, []).limit(0)
    assert truncation.truncated(empty, m).count() == 0 and truncation.report(empty, m).count() == 0


def test_pieces():
    assert truncation.pieces("Button_x 12") == [("button", False), ("x", False)]
    assert truncation.pieces("表紙を直し") == [("表紙", True), ("を", True), ("直", True), ("し", False)]
