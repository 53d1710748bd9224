"""Mail parts, leakage, mixing and reading levels."""

import base64
import email
import random

import numpy as np
import pytest

from strata.llm import leakage, mail, mixing, reading

DOC = "doc_id bigint, text string, source string, message_id string, part int, words string, n_tokens bigint, level double"
ITEM = "item_id bigint, suite string, text string, n_docs bigint"


def message(body: str, html: bool = False, encoding: str = "8bit", charset: str = "utf-8") -> str:
    raw = body.encode(charset)
    if encoding == "base64":
        body = base64.encodebytes(raw).decode()
    elif encoding == "quoted-printable":
        import quopri

        body = quopri.encodestring(raw).decode("ascii")
    return f"From: a@b.example\nSubject: s\nContent-Type: text/{'html' if html else 'plain'}; charset=\"{charset}\"\nContent-Transfer-Encoding: {encoding}\n\n{body}"


def multipart(*inner: str, closed: bool = True) -> str:
    return "From: a@b.example\nContent-Type: multipart/mixed;\n boundary=\"=_b.1\"\n\npreamble\n" + "".join(f"--=_b.1\n{x}\n" for x in inner) + ("--=_b.1--\nepilogue\n" if closed else "")


@pytest.mark.parametrize("encoding", ["8bit", "base64", "quoted-printable"])
@pytest.mark.parametrize("charset", ["utf-8", "iso-8859-1"])
def test_parts(encoding, charset):
    charset = "utf-8" if encoding == "8bit" else charset
    text = "Olá, está pronta.\n" + "word " * 60
    assert mail.parts(message(text, encoding=encoding, charset=charset))[0][2].split() == text.split()
    both = multipart(message(text, encoding=encoding, charset=charset), message(f"<p>{text}</p>", True, encoding, charset), closed=False)
    assert [mail.words(p[2]) for p in mail.parts(both)] == [mail.words(text)] * 2
    assert [mail.words(p[2]) for p in mail.parts(both.replace("\n", "\r\n"))] == [mail.words(text)] * 2


def test_parts_odd():
    assert mail.parts(None) == [] and mail.parts("") == []
    assert mail.parts("no headers here\nat all")[0][2] == "no headers here\nat all"
    nested = multipart(multipart(message("deep")).replace("=_b.1", "=_b.2"), message("flat"))
    assert [p[2].strip() for p in mail.parts(nested)] == ["deep", "flat"]
    image = "Content-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA"
    attached = "Content-Type: text/plain\nContent-Disposition: attachment; filename=x\n\nnotes"
    assert [(a, t) for _, a, t in mail.parts(multipart(image, attached))] == [(True, "notes")]
    assert mail.words(mail.reader_text("<style>p {}</style>a<b>b</b>c<br>d &amp; e<!-- x --><p>f</p>")) == ["abc", "d", "e", "f"]
    assert mail.words("> a b\n>> c\n| d_e") == ["a", "b", "c", "d", "e"]
    assert mail.parts("Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n%%%%")[0][2] == ""
    own = mail.own_prose(message("I wrote this.\n\nOn Mon, 1 Jan, B wrote:\n> quoted\n-- \nsig"))
    assert mail.words(own) == ["i", "wrote", "this"]


@pytest.mark.parametrize("body, want", [
    ("On Mon, 1 Jan, B wrote:\n> quoted\n> more\n\nI wrote below.\n-- \nsig", "i wrote below"),
    ("Above.\n\nOn Mon, 1 Jan 2014 at 10:00, B\n<b@b.example> wrote:\n> one\nFirst answer.\n> two\n>> deep\nSecond answer.\n", "above first answer second answer"),
    ("On Tuesday I left.\nOn Mon, 1 Jan, B wrote:\n> q\nOn Friday he wrote\nto me.", "on tuesday i left on friday he wrote to me"),
    ("Mine.\n-----Original Message-----\nFrom: B\n\nnot mine\n", "mine"),
    ("Mine.\n\n----- Forwarded message -----\nOn Mon, 1 Jan, B wrote:\nnot mine\n", "mine"),
])
def test_own_prose_around_quotes(body, want):
    assert mail.words(mail.own_prose(message(body))) == want.split()
    assert mail.words(mail.own_prose(message(body.replace("\n", "\r\n"), encoding="base64"))) == want.split()


def test_own_prose_around_quotes_in_markup():
    quote = "<p>On Mon, 1 Jan, B wrote:</p><blockquote>one<blockquote>deep</blockquote>two</blockquote>"
    assert mail.words(mail.own_prose(message(f"<p>Above.</p>{quote}<p>Below.</p>{quote}<p>End.</p><blockquote>open", True))) == ["above", "below", "end"]


def test_parts_like_the_standard_library():
    rng = random.Random(2)
    words = "alpha beta gamma olá déjà Straße".split()
    for _ in range(60):
        inner = [message(" ".join(rng.choices(words, k=30)), rng.random() < 0.3, rng.choice(["base64", "quoted-printable"]), rng.choice(["utf-8", "iso-8859-1"])) for _ in range(rng.randint(1, 3))]
        text = multipart(*inner, closed=rng.random() < 0.7)
        want = [p.get_payload(decode=True).decode(p.get_content_charset()) for p in email.message_from_string(text).walk() if p.get_content_maintype() == "text"]
        assert [mail.words(p[2]) for p in mail.parts(text)] == [mail.words(w) for w in want]


def brute(docs, items):
    out = set()
    grams = {}
    for i, _, t, _ in items:
        w = mail.words(t or "")
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    for d in docs:
        for p in mail.parts(d[1]):
            w = mail.words(p[2])
            for k in range(len(w) - 11):
                out |= {(d[0], i) for i in grams.get(tuple(w[k : k + 12]), ()) if d[0] is not None and i is not None}
    return out


def test_leaks(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    items = [(k, "s", " ".join(rng.choices(words, k=rng.choice([3, 8, 12, 30, 80]))), 1) for k in range(40)] + [(50, "s", None, 1), (None, "s", "x", 1), (0, "s", None, 1)]
    items.append((41, "s", items[5][2], 1))
    docs = []
    for k in range(150):
        w = rng.choices(words, k=rng.randint(0, 200))
        if rng.random() < 0.6:
            own = mail.words(rng.choice(items[:40])[2])
            a = rng.randrange(len(own))
            w[5:5] = own[a : a + rng.choice([6, 11, 12, 13, 40])]
        docs.append((k, message("\n> ".join([" ".join(w)]), rng.random() < 0.3, rng.choice(["8bit", "base64"])), "s", None, 1, "", 1, 1.0))
    docs += [(200, None, "s", None, 1, "", 1, 1.0), (None, "x", "s", None, 1, "", 1, 1.0), (201, "", "s", None, 1, "", 1, 1.0), (3, docs[3][1], "s", None, 1, "", 1, 1.0)]
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = leakage.leaks(d, i)
    exact = {(r["doc_id"], r["item_id"]) for r in got.where("run >= 12").collect()}
    assert exact == brute(docs, items) and len(exact) > 10
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 2000)  # several blocks of items
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i).where("run >= 12").collect()} == exact
    report = {r["item_id"]: r["n_exact"] for r in leakage.items_report(got, i).collect()}
    assert sum(report.values()) == len(exact) and report[50] == 0
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_edited_copies_score(spark):
    item = " ".join(f"w{k}" for k in range(60))
    edited = " ".join("x" if k % 10 == 9 else f"w{k}" for k in range(60))
    got = leakage.leaks(spark.createDataFrame([(1, message(edited), "s", None, 1, "", 1, 1.0)], DOC), spark.createDataFrame([(1, "s", item, 1)], ITEM)).first()
    assert got["run"] == 9 and got["score"] >= 80


def test_edited_copies_are_found_however_often_they_are_repeated(spark):
    item = " ".join(f"w{k}" for k in range(60))
    edited = " ".join("x" if k % 10 == 9 else f"w{k}" for k in range(60))
    docs = [(k, message(edited), "s", None, 1, "", 1, 1.0) for k in range(5)]
    got = leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, "s", item, 1)], ITEM)).collect()
    assert {r["doc_id"] for r in got} == set(range(5))
    # a single seed that is common elsewhere is enough
    one = " ".join("x" if k % 6 == 5 and k != 11 else f"w{k}" for k in range(60))
    docs = [(9, message(one), "s", None, 1, "", 1, 1.0)] + [(k, message("w6 w7 w8 w9 w10 w11"), "s", None, 1, "", 1, 1.0) for k in range(5)]
    got = leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, "s", item, 1)], ITEM)).collect()
    assert [r["doc_id"] for r in got] == [9]


def test_clean_corpus_has_no_leaks(spark):
    docs = [(1, message("nothing of it stands here"), "s", None, 1, "", 1, 1.0)]
    for text in (" ".join(f"w{k}" for k in range(60)), "two words", ""):
        assert leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, "s", text, 1)], ITEM)).count() == 0


@pytest.mark.parametrize("every, kept, least", [(4, 60, 0.9), (5, 60, 0.95), (6, 60, 1.0), (7, 25, 0.95), (8, 25, 1.0), (10, 25, 1.0), (5, 35, 0.95), (12, 25, 1.0)])
def test_recall_of_edited_copies(spark, every, kept, least):
    """Items of 60 words, the first ``kept`` copied into other text, one word in ``every`` changed."""
    rng = random.Random(every)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, "s", " ".join(rng.choices(words, k=60)), 1) for k in range(100)]
    docs = []
    for k, (_, _, text, _) in enumerate(items):
        own = [rng.choice(words) if j % every == every - 1 else w for j, w in enumerate(text.split()[:kept])]
        docs.append((k, message(" ".join(rng.choices(words, k=80) + own + rng.choices(words, k=80))), "s", None, 1, "", 1, 1.0))
    got = leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    assert sum(r["doc_id"] == r["item_id"] for r in got) >= least * len(items) and all(r["doc_id"] == r["item_id"] for r in got)


def test_edited_excerpts_of_long_items_are_found(spark):
    item = [f"w{k}" for k in range(178)]
    edited = [f"w{k}" if k % 10 else "x" for k in range(61, 121)]
    pattern = ["x" if k % 8 in (1, 5, 7) and k > 8 else f"w{k}" for k in range(178)]  # a sentence built alike
    docs = [(k, message(" ".join(w)), "s", None, 1, "", 1, 1.0) for k, w in enumerate((edited, pattern, edited + pattern[121:]))]
    got = leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, "s", " ".join(item), 1)], ITEM)).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 2] and all(r["run"] < 12 for r in got)


def test_align():
    rng = np.random.default_rng(1)
    for _ in range(40):
        item, docs = rng.integers(0, 5, rng.integers(1, 25)), [rng.integers(-1, 5, rng.integers(1, 40)) for _ in range(3)]
        for doc, found in zip(docs, leakage.align(item, docs)):
            h, r, score, run = {}, {}, 0, 0
            for i, w in enumerate(item):
                for j, x in enumerate(doc):
                    h[i, j] = max(0, h.get((i - 1, j - 1), 0) + (2 if w == x else -1), h.get((i - 1, j), 0) - 1, h.get((i, j - 1), 0) - 1)
                    r[i, j] = r.get((i - 1, j - 1), 0) + 1 if w == x else 0
                    score, run = max(score, h[i, j]), max(run, r[i, j])
            assert found == (score, run)


def test_flow():
    patterns = {("a",): 100, ("b",): 50, ("a", "b"): 40}
    total, used = mixing.route(patterns, {"a": (0.5, 1), "b": (0.5, 2)})
    assert total == 190 and sum(v for (_, s), v in used.items() if s == "a") == 95 and sum(v for (_, s), v in used.items() if s == "b") == 95
    total, used = mixing.route({("a",): 10, ("b",): 1000}, {"a": (0.5, 3), "b": (0.5, 1)})
    assert 59 <= total <= 61 and used[("a",), "a"] <= 30
    assert mixing.route({}, {"a": (1.0, 1)})[1] == {}
    assert mixing.min_cost_flow(4, [(0, 1, 5, 0), (0, 1, 5, 3), (1, 2, 7, 0), (2, 3, 9, 0)], 0, 3) == (7, [5, 2, 7, 7])


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(k, "word " * rng.randint(1, 60), rng.choice("aaaabbc"), f"m{k % 400}" if k % 3 else None, 1, "", 1, 1.0) for k in range(600)]
    docs += [(900, None, "a", None, 1, "", 1, 1.0), (901, "x", None, None, 1, "", 1, 1.0), (902, "", "a", None, 1, "", 1, 1.0), docs[0]]
    goal = spark.createDataFrame([("a", 0.4, 1, 9.0), ("b", 0.3, 2, 9.0), ("c", 0.3, 4, 9.0), (None, 0.1, 1, 9.0)], "source string, target_share double, max_repeats int, share double")
    d = spark.createDataFrame(docs, DOC)
    m = mixing.mixture(d, goal)
    rows = m.collect()
    assert rows and [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(mixing.mixture(d, goal).collect())]
    own = {x[0]: x[2] for x in docs}
    most = {"a": 1, "b": 2, "c": 4}
    assert all(own[r["doc_id"]] == r["source"] and 1 <= r["times"] <= most[r["source"]] for r in rows)
    got = {r["source"]: r["share"] for r in mixing.shares(m, goal).collect()}
    assert got["a"] == pytest.approx(0.4, abs=0.02) and got["b"] == pytest.approx(0.3, abs=0.02) and got["c"] == pytest.approx(0.3, abs=0.02)
    more = goal.union(spark.createDataFrame([("nowhere", 0.5, 1, 9.0)], goal.schema))
    assert {r["source"]: round(r["share"], 2) for r in mixing.shares(mixing.mixture(d, more), more).collect()} == {**{k: round(v, 2) for k, v in got.items()}, "nowhere": 0}
    assert mixing.mixture(d.limit(0), goal).count() == 0


def graded(n: int, seed: int):
    """Texts whose words get rarer with the grade."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        g = rng.randint(0, 18)
        out.append((float(g), [f"word{chr(97 + min(18, max(0, round(rng.gauss(g * 0.8, 2)))))}" + chr(97 + rng.randrange(5)) for _ in range(60)]))
    return out


def test_level_on_held_out_texts(spark):
    texts = graded(400, 1)
    labels = spark.createDataFrame([(k, int(g), "r") for k, (g, _) in enumerate(texts)], "doc_id bigint, grade int, rater string")
    model = reading.fit(spark.createDataFrame([(k, message(" ".join(w)), "s", None, 1, "", 1, 1.0) for k, (_, w) in enumerate(texts)], DOC), labels)
    errors = [abs(model.of(w)[0] - g) for g, w in graded(200, 2)]
    assert sum(errors) / len(errors) < 1.5
    assert model.of([])[0] is None and model.of(["unbekannt"] * 50)[0] is None


def test_levels(spark):
    texts = graded(200, 3)
    docs = [(k, message(" ".join(w)), "s", None, 1, "", 1, 1.0) for k, (_, w) in enumerate(texts)] + [(900, None, "s", None, 1, "", 1, 1.0), (901, message("Привет мир " * 9), None, None, 1, "", 1, 1.0), (902, "", "s", None, 1, "", 1, 1.0), (0, message(" ".join(texts[0][1])), "s", None, 1, "", 1, 1.0), (903, message("word " * 50_000), "s", None, 1, "", 1, 1.0)]
    labels = spark.createDataFrame([(k, int(g), "r") for k, (g, _) in enumerate(texts)] + [(0, None, "r"), (5, 18, "q"), (9999, 3, "r"), (None, 3, "r")], "doc_id bigint, grade int, rater string")
    d = spark.createDataFrame(docs, DOC)
    got = {r["doc_id"]: r["level"] for r in reading.levels(d, labels).collect()}
    assert len(got) == 204 and got[900] is None and got[902] is None
    basis = {r["doc_id"]: r["basis"] for r in reading.levels(d, labels).collect()}
    assert basis[901] == "shape" and got[901] is not None and basis[1] == "words" and basis[900] is None
    assert sum(abs(got[k] - g) for k, (g, _) in enumerate(texts)) / 200 < 1.5
    assert reading.profile(reading.levels(d, labels), d).where("level is null").count() > 0
    none = reading.levels(d, labels.limit(0))
    assert none.where("level is not null").count() == 0 and none.count() == 204
    assert reading.levels(d.limit(0), labels).count() == 0
