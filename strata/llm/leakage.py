"""Evaluation texts leaking into training text.

The words of every readable part are written once. Words that no test item has are set apart; all n-grams of the items
(``NGRAM`` words) are looked up in the whole corpus as numbers. A hit joins a stretch of text to an item on a diagonal
(place in the text less place in the item). The hits of a narrow band of diagonals are chained: what they cover must
outweigh the words between them by ``CHAIN``, and must be rare: each covered word counts -log2 of its share of all words
of the corpus, ``SEED_BITS`` together, so that copies of a passage don't make its own seeds common. A chain of ``RUN``
words needs no rarity. The region around the diagonal is aligned with the item by Smith-Waterman over words, which finds
edited and paraphrased copies, and the longest exact run is measured. A region is at most four times as long as its
item; the regions of an item are aligned together.

Items are a stated query set of bounded size: they go to the tasks in blocks of ``BLOCK_BYTES`` of text, so any number
of them is handled. Documents are never shuffled or collected.

Results for odd input: null texts and ids are left out; an item of fewer than ``NGRAM`` words gives no seed and no row;
an item of fewer than ``RUN`` words can only be found by its evidence; repeated documents and items count once by id; equal
items are reported each; an empty table, and a corpus in which no seed occurs, give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import mail
from strata.session import frames, stored

RUN = 12
NGRAM = 3
#: Rarity of what the seeds of a band cover, in bits, from which its region is aligned.
SEED_BITS = 40.0
#: Words that a chain of seeds in a band must cover, the words between them taken off; half of a short item is enough.
CHAIN = 8
#: Slots in which the hits of bands are counted before they are sorted.
SLOTS = 1 << 22
#: More than the chains of one group can rise or fall.
APART = 1 << 34
#: Diagonals of a band; bands overlap by half.
BAND = 8
#: Words that are looked up at once.
CHUNK = 1 << 20
#: A copy without an exact run of RUN words holds as much evidence as one: each kept word of the aligned region counts 1,
#: each changed or missing one -2, each additional one -1. Of a short item half of its words are enough.
KEPT, CHANGED = 1, -2
#: Words of the regions that are aligned together with one item.
CELLS = 1 << 16
#: Fewer than 2^21 different words fit into a block, so that the code of an n-gram fits into 63 bits.
BLOCK_BYTES = 8 << 20

_SCHEMA = "doc_id bigint, item_id bigint, part int, score int, run int, share double"


def _parts(batches):
    for b in batches:
        ids, at, words = [], [], []
        for i, t in zip(b["doc_id"], b["text"]):
            for k, (_, _, text) in enumerate(mail.parts(t)):
                w = " ".join(mail.words(text))
                if w:
                    ids.append(i)
                    at.append(k)
                    words.append(w)
        yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "part": pd.Series(at, dtype="int32"), "words": pd.Series(words, dtype=object)})


def part_words(documents: DataFrame) -> DataFrame:
    """(doc_id, part, words): the words of each readable part, separated by blanks."""
    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").transform(frames, _parts, "doc_id bigint, part int, words string")


class Items:
    """Test items as arrays of word numbers, and their n-grams as sorted codes with the places of each."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in items]
        self.numbers: dict[str, int] = {}
        for _, w in items:
            for x in w:
                self.numbers.setdefault(x, len(self.numbers))
        self.arrays = [np.array([self.numbers[x] for x in w], dtype=np.int32) for _, w in items]
        self.sizes = np.array([len(a) for a in self.arrays], dtype=np.int64)
        codes = [self.codes(a) for a in self.arrays]
        every = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, dtype=np.int64)
        order = np.argsort(every, kind="stable")
        self.grams, self.first, self.uses = np.unique(every[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The code of the n-gram at each place; -1 where a word is in no item."""
        n, base = len(words) - NGRAM + 1, np.int64(max(1, len(self.numbers)))
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        out, ok = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(NGRAM):
            w = words[k : k + n]
            out = out * base + w
            ok &= w >= 0
        return np.where(ok, out, -1)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of each n-gram of the items that occurs."""
        at, gram = [], []
        for start in range(0, max(0, len(words) - NGRAM + 1), CHUNK):
            c = self.codes(words[start : start + CHUNK + NGRAM - 1])
            here = np.flatnonzero(c >= 0)
            k = np.searchsorted(self.grams, c[here])
            met = k < len(self.grams)
            met[met] = self.grams[k[met]] == c[here][met]
            at.append(here[met] + start)
            gram.append(k[met])
        if not at:
            return (np.zeros(0, dtype=np.int64),) * 3
        where, g = np.concatenate(at), np.concatenate(gram)
        n = self.uses[g]
        use = np.repeat(self.first[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(where, n), self.owner[use], self.place[use]


def _numbered(texts, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as one array, each text followed by a -1, and where each begins."""
    each = []
    for t in texts:
        w = [numbers.get(x, -1) for x in t.split(" ")]
        w.append(-1)
        each.append(np.array(w, dtype=np.int32))
    starts = np.cumsum([0, *map(len, each)])
    return (np.concatenate(each) if each else np.zeros(0, dtype=np.int32)), starts


def _counter(sent):
    def run(batches):
        numbers = sent.value.numbers
        counts, total = np.zeros(len(numbers), dtype=np.int64), 0
        for b in batches:
            words, starts = _numbered(b["words"], numbers)
            counts += np.bincount(words[words >= 0], minlength=len(numbers))
            total += len(words) - len(b)
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"k": np.append(met, -1).astype("int32"), "n": np.append(counts[met], total).astype("int64")})

    return run


def regions(items: Items, words: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, from, to) of the stretches of the numbered texts that hold enough evidence of an item."""
    at, item, place = items.hits(words)
    if not len(at):
        return []
    text = np.searchsorted(starts, at, side="right") - 1
    diagonal = at - place
    total = np.concatenate([[0.0], np.cumsum(np.where(words >= 0, bits[words], 0.0))])
    need = np.minimum(CHAIN, -(-items.sizes // 2))
    least, found = -(-need // NGRAM), []
    for shift in (0, BAND // 2):
        band = (diagonal + shift) // BAND
        key = (text * len(items.sizes) + item) * (int(band.max() - band.min()) + 1) + band - band.min()
        # most bands hold fewer hits than a chain needs; hashed counts are never too low
        slot = key % SLOTS
        kept = np.flatnonzero(np.bincount(slot, minlength=SLOTS)[slot] >= least[item])
        if not len(kept):
            continue
        order = kept[np.argsort(key[kept], kind="stable")]  # hits come in the order of their places
        t, i, d, p = text[order], item[order], band[order], at[order]
        new = np.r_[True, np.diff(key[order]) != 0]
        # what a hit covers beyond the one before it, less the words between the two
        last = np.where(new, p, np.r_[0, p[:-1] + NGRAM])
        begin, starting = np.maximum(p, last), np.flatnonzero(new)
        gain, group = p + NGRAM - begin, np.cumsum(new) - 1
        rise = np.cumsum(gain - np.maximum(p - last, 0))
        low = np.minimum.accumulate(rise - gain - group * APART) + group * APART
        chain = np.maximum.reduceat(rise - low, starting)
        rare = np.bincount(group, total[p + NGRAM] - total[begin]) >= SEED_BITS
        enough = (chain >= need[i[starting]]) & (rare | (chain >= RUN))
        first = starting[enough]
        size = items.sizes[i[first]]
        found.append(np.stack([t[first], i[first], (d[first] * BAND - shift) // size], axis=1))
    out = []
    if not found:
        return out
    for t, i, k in np.unique(np.concatenate(found), axis=0).tolist():
        n = int(items.sizes[i])
        a, b = max(int(starts[t]), (k - 1) * n), min(int(starts[t + 1]) - 1, (k + 3) * n + BAND)
        out.append((t, i, a, b))
    return out


def _table(docs: list[np.ndarray]) -> np.ndarray:
    """One column per array, filled up with a number that equals nothing."""
    t = np.full((max(map(len, docs)), len(docs)), -1, dtype=np.int32)
    for k, d in enumerate(docs):
        t[: len(d), k] = d
    return t


def _scores(item: np.ndarray, doc: np.ndarray, match: int = 2, other: int = -1) -> np.ndarray:
    """Best local alignment score of each column; ``other`` for a changed or missing word of the item, -1 for one more."""
    wide, n = doc.shape
    kind = np.int16 if match * len(item) + wide + 8 < 1 << 15 else np.int32
    # a cell at word j of the column is kept j higher, so that more words there cost nothing
    steps = np.repeat(np.arange(wide + 1, dtype=kind)[:, None], n, axis=1)
    h, d, t = steps.copy(), steps.copy(), np.empty((wide, n), dtype=kind)
    best = np.zeros((wide + 1, n), dtype=kind)
    for w in item:
        np.multiply(doc == w, kind(match - other), out=t)
        t += h[:-1]
        t += kind(other + 1)
        h += kind(other)
        np.maximum(t, h[1:], out=d[1:])
        d[0] = 0
        np.maximum(d, steps, out=d)
        np.maximum.accumulate(d, axis=0, out=h)
        np.maximum(best, np.subtract(h, steps, out=d), out=best)
    return best.max(axis=0)


def _runs(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest common run of the item with each column."""
    r = np.zeros((doc.shape[0] + 1, doc.shape[1]), dtype=np.int32)
    best = r.copy()
    for w in item:
        r[1:] = (r[:-1] + 1) * (doc == w)
        np.maximum(best, r, out=best)
    return best.max(axis=0)


def align(item: np.ndarray, docs: list[np.ndarray], least: int = 0) -> list[tuple[int, int]]:
    """Best local alignment score and longest common run of an item with each of some arrays of word numbers, those
    below 0 equal nothing; zeros where no region holds the evidence ``least``."""
    same: dict[bytes, list[int]] = {}  # copies of a message give the same array
    for k, d in enumerate(docs):
        same.setdefault(d.tobytes(), []).append(k)
    out = [(0, 0)] * len(docs)
    order = sorted(same.values(), key=lambda v: -len(docs[v[0]]))  # those of like length together
    at = 0
    while at < len(order):
        here = order[at : at + max(1, CELLS // max(1, len(docs[order[at][0]])))]
        at += len(here)
        doc = _table([docs[v[0]] for v in here])
        high = np.flatnonzero(_scores(item, doc, KEPT, CHANGED) >= least)
        if len(high):
            doc = np.ascontiguousarray(doc[:, high])
            for k, s, r in zip(high, _scores(item, doc).tolist(), _runs(item, doc).tolist()):
                for x in here[k]:
                    out[x] = (s, r)
    return out


def _bounded(batches):
    """The rows of batches in frames of about ``CHUNK`` words; a text is never cut."""
    for b in batches:
        part = (b["words"].str.len().cumsum() // (6 * CHUNK)).to_numpy()
        for k in np.unique(part):
            yield b[part == k]


def _matcher(sent):
    def run(batches):
        items, bits = sent.value
        for b in _bounded(batches):
            words, starts = _numbered(b["words"], items.numbers)
            of: dict[int, list[tuple[int, np.ndarray]]] = {}
            for t, i, x, y in regions(items, words, starts, bits):
                of.setdefault(i, []).append((t, words[x:y]))
            ids, part, out = b["doc_id"].to_numpy(), b["part"].to_numpy(), []
            for i, here in of.items():
                size, best = int(items.sizes[i]), {}
                for (t, _), (score, length) in zip(here, align(items.arrays[i], [w for _, w in here], min(RUN, -(-size // 2)))):
                    if score:
                        best[t] = max(best.get(t, (False, 0, 0)), (length >= RUN, score, length))
                out += [(ids[t], items.ids[i], part[t], score, length, score / (2 * size)) for t, (_, score, length) in best.items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "part", "score", "run", "share"]).astype({"doc_id": "int64", "item_id": "int64", "part": "int32", "score": "int32", "run": "int32", "share": "float64"})

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, run, share): documents and the items that leaked into them, best part each."""
    spark = documents.sparkSession
    parts = stored(part_words(documents))
    own = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    found = None
    for n in range(blocks):
        block = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n)
        held = Items(sorted((r["item_id"], mail.words(r["text"])) for r in block.toLocalIterator()))
        if not len(held.grams):
            continue
        counts = parts.select("words").transform(frames, _counter(spark.sparkContext.broadcast(held)), "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
        uses = {r["k"]: r["n"] for r in counts.toLocalIterator()}  # at most one row per word of the block
        total = uses.pop(-1, 0)
        bits = np.zeros(len(held.numbers))
        for k, v in uses.items():
            bits[k] = np.log2(total / v)
        hit = parts.transform(frames, _matcher(spark.sparkContext.broadcast((held, bits))), _SCHEMA)
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = spark.createDataFrame([], _SCHEMA)
    best = F.max(F.struct((F.col("run") >= RUN).alias("exact"), "score", "run", "share"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.score", "m.run", "m.share")


def items_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_docs, n_exact, longest_run): what leaked of the test set, items without leaks included."""
    n = found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.sum((F.col("run") >= RUN).cast("bigint")).alias("n_exact"), F.max("run").alias("longest_run"))
    own = items.where("item_id is not null").groupBy("item_id").agg(F.min("suite").alias("suite"))
    return own.join(n, "item_id", "left").select("item_id", "suite", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_exact", "longest_run")])
