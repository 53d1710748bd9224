"""Reading level of each document.

From messages with grades, each word gets the grade at which it is acquired: a low quantile of the grades of the texts
that use it, each grade weighted by how rare texts of that grade are, and drawn to the overall middle where the word is
rare. The level of a document is calibrated from quantiles of the grades of its known words by ridge regression against
the raters' grades, clipped to the scale. Only the prose that the sender wrote is read.

The model is fitted on at most ``LABELLED`` graded messages, chosen by a hash of their ids; that bounds the table of
word grades that is sent to the tasks. Their words are counted by grade in the cluster; only the counts of words in
``LEAST_TEXTS`` texts and more, and one row of quantiles per message, come to the driver. Every document is scored with
its whole prose.

Texts with too few known words, mostly in other languages, get a level by transfer: the length of sentences and words and
the share of long words are calibrated on the same labels, Chinese and Japanese characters counting as half a word;
``basis`` says which of the two a level is from.

Results for odd input: null grades and labels of unknown documents are left out; several grades of one message are
averaged; documents with fewer than ``LEAST_WORDS`` words have a null level, and those with less than ``LEAST_KNOWN`` of
them known one by transfer; without any label all levels are null; repeated documents count once.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import mail
from strata.session import frames, stored

LABELLED = 20_000
GRADES = 19
#: Share of the weighted texts of a word from which it counts as acquired.
ACQUIRED = 0.25
LEAST_TEXTS = 3
LEAST_WORDS, LEAST_KNOWN = 5, 0.5
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
RIDGE = 1.0


def prose_words(prose: str) -> list[str]:
    return [w for w in mail.words(prose) if not w.isdigit()]


def word_grades(per: np.ndarray, uses: dict[str, np.ndarray]) -> dict[str, float]:
    """Acquisition grade of each word from the texts per grade and the texts that use it per grade."""
    # texts of each grade as if there were equally many, smoothed over neighbours
    base = np.convolve(per, (0.25, 0.5, 0.25), "same") + 1.0
    out = {}
    scale = np.arange(GRADES)
    for w, u in uses.items():
        if u.sum() < LEAST_TEXTS:
            continue
        share = np.cumsum(u / base)
        share /= share[-1]
        k = int(np.searchsorted(share, ACQUIRED))
        before = float(share[k - 1]) if k else 0.0
        low = k - 0.5 + (ACQUIRED - before) / max(float(share[k]) - before, 1e-9)
        mean = float((u / base * scale).sum() / (u / base).sum())
        out[w] = 0.5 * low + 0.5 * mean
    return out


def features(words: list[str], grades: dict[str, float]) -> list[float] | None:
    known = sorted(g for w in words if (g := grades.get(w)) is not None)
    if len(words) < LEAST_WORDS or len(known) < LEAST_KNOWN * len(words) or not known:
        return None
    n = len(known)
    q = [known[min(n - 1, int(p * n))] for p in QUANTILES]
    half = known[n // 2 :]
    return [1.0, *q, sum(known) / n, sum(half) / len(half)]


_SENTENCE = re.compile(r"[.!?…。！？]+(?=\s|$)|[。！？]|\n\s*\n")
_CJK = re.compile("[\u3005\u3040-\u30ff\u3400-\u9fff\uac00-\ud7ff]")


def shape(prose: str) -> list[float] | None:
    """Lengths of sentences and words, whatever the language."""
    wide = len(_CJK.findall(prose))
    words = [w for w in mail.words(_CJK.sub(" ", prose) if wide else prose) if not w.isdigit()]
    n = len(words) + wide / 2
    if n < LEAST_WORDS:
        return None
    sentences = max(1, sum(1 for part in _SENTENCE.split(prose) if mail.WORD.search(part)))
    letters = sum(map(len, words)) + 2.5 * wide
    return [1.0, math.log(n / sentences), letters / n, sum(len(w) > 7 for w in words) / n]


def calibrate(rows: list[list[float]], grades: list[float]) -> np.ndarray:
    x, y = np.array(rows), np.array(grades)
    eye = np.eye(x.shape[1]) * RIDGE
    eye[0, 0] = 0
    return np.linalg.solve(x.T @ x + eye, x.T @ y)


class Level:
    """Word grades, the weights that calibrate their quantiles, and those of the shape of texts; without weights nothing
    has a level."""

    def __init__(self, words: dict[str, float], weights: np.ndarray | None, shapes: np.ndarray | None = None):
        self.words, self.weights, self.shapes = words, weights, shapes

    def of(self, words: list[str], prose: str = "") -> tuple[float | None, str | None, float]:
        """(level, basis, share of known words)."""
        known = sum(w in self.words for w in words) / max(1, len(words))
        for basis, weights, f in (("words", self.weights, features(words, self.words)), ("shape", self.shapes, shape(prose) if prose else None)):
            if weights is not None and f is not None:
                return min(GRADES - 1.0, max(0.0, float(np.dot(f, weights)))), basis, known
        return None, None, known


def _prose(batches):
    for b in batches:
        own = [mail.own_prose(t) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "grade": b["grade"], "words": [" ".join(prose_words(t)) for t in own], "shape": [shape(t) for t in own]})


def _quantiles(sent):
    """Features of the texts of one half with the word grades of the other."""

    def run(batches):
        halves = sent.value
        for b in batches:
            made = [features(w.split(), halves[1 - h]) for w, h in zip(b["words"], b["half"])]
            yield pd.DataFrame({"grade": [g for g, f in zip(b["grade"], made) if f], "f": [f for f in made if f]})

    return run


def fit(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> Level:
    """Word grades from one half of the labelled texts calibrate on the other, then all texts give the words."""
    graded = labels.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the bounded sample of labelled rows
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    prose = rows.transform(frames, _prose, "doc_id bigint, grade double, words string, shape array<double>").where("words <> ''")
    prose = stored(prose.withColumn("half", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int")).withColumn("k", F.greatest(F.lit(0), F.least(F.lit(GRADES - 1), F.bround("grade").cast("int")))))
    per = np.zeros((2, GRADES))
    for r in prose.groupBy("half", "k").count().toLocalIterator():
        per[r["half"], r["k"]] = r["count"]
    each = prose.select("half", "k", F.explode(F.array_distinct(F.split("words", " "))).alias("w")).groupBy("w", "half", "k").agg(F.count("*").alias("n"))
    cells = each.groupBy("w").agg(F.sum("n").alias("s"), F.collect_list(F.struct("half", "k", "n")).alias("c")).where(F.col("s") >= LEAST_TEXTS)
    uses: dict[str, np.ndarray] = {}
    for r in cells.toLocalIterator():
        u = uses[r["w"]] = np.zeros((2, GRADES))
        for half, k, n in r["c"]:
            u[half, k] = n
    if not uses:
        return Level({}, None)
    sent = documents.sparkSession.sparkContext.broadcast([word_grades(per[h], {w: u[h] for w, u in uses.items()}) for h in (0, 1)])
    made = list(prose.select("grade", "words", "half").transform(frames, _quantiles(sent), "grade double, f array<double>").toLocalIterator())
    seen = list(prose.where("shape is not null").select("grade", "shape").toLocalIterator())
    return Level(word_grades(per.sum(axis=0), {w: u.sum(axis=0) for w, u in uses.items()}), calibrate([list(r["f"]) for r in made], [r["grade"] for r in made]) if made else None, calibrate([list(r["shape"]) for r in seen], [r["grade"] for r in seen]) if seen else None)


def levels(documents: DataFrame, labels: DataFrame, model: Level | None = None) -> DataFrame:
    """(doc_id, level, basis, known_share, n_words) of each document."""
    sent = documents.sparkSession.sparkContext.broadcast(model or fit(documents, labels))

    def run(batches):
        m = sent.value
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"]):
                prose = mail.own_prose(t)
                w = prose_words(prose)
                out.append((i, *m.of(w, prose), len(w)))
            yield pd.DataFrame(out, columns=["doc_id", "level", "basis", "known_share", "n_words"]).astype({"doc_id": "int64", "level": "float64", "basis": object, "known_share": "float64", "n_words": "int32"})

    scored = documents.where("doc_id is not null").select("doc_id", "text").transform(frames, run, "doc_id bigint, level double, basis string, known_share double, n_words int")
    scored = scored.withColumn("level", F.when(~F.isnan("level"), F.col("level")))
    return scored.groupBy("doc_id").agg(F.max(F.struct("level", "basis", "known_share", "n_words")).alias("m")).select("doc_id", "m.*")


def profile(scored: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, level, n_docs): how many documents of each source are at each whole level; null where unknown."""
    d = documents.where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    return d.join(scored, "doc_id").groupBy("source", F.floor("level").cast("int").alias("level")).agg(F.count("*").alias("n_docs"))
