"""Garbled text from wrong character encodings: find it and restore it.

A text is a node of a graph; its edges encode it with one codec and decode the bytes with another, or unescape it.
A best-first search with a set of visited texts and byte strings expands the node of the lowest cost first; the cost is
a character plausibility (bigram model of the whole corpus) plus a price for each step. It ends when the cheapest node
left is plausible throughout, or when none is left that is not a detour: a node may be worse than the best text so far
by ``DETOUR``, or by ``DETOUR_SHARE`` for each of the characters of that. A text is garbled if a cheaper one is reached by the
margin, if it holds control characters that only a wrong decoding leaves, or if a replacement character stands where
the text was not merely cut.

Each different value is judged once, in a table of different values; the decisions are joined to the rows.

Results for odd input: null and empty texts and texts of plain ASCII without escapes are never garbled; a text that is
too implausible but leads nowhere is garbled only by the signs above, and is returned as it is; ties go to the shorter
path, then to the text that sorts first. Very long texts are searched whole. A search that reaches ``MAX_NODES`` nodes
gives the best text so far and says so in ``finished``.
"""

from __future__ import annotations

import codecs
import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Callable
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.confusables import fold, whole_image
from strata.session import bounded, frames, spread, stored

#: Codecs that text is wrongly shown in, and codecs that it was written in.
SHOWN = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8_r", "gbk", "cp932", "euc_jp", "cp949", "big5", "cp1250", "mac_cyrillic")
WRITTEN = ("utf-8", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8_r", "mac_cyrillic", "cp932", "euc_jp", "gbk", "cp949", "big5")
#: Bytes that cp1252 leaves undefined; decoders pass them on as control characters or replace them.
HOLES = {"cp1252": "\x81\x8d\x8f\x90\x9d", "cp1251": "\x98", "cp1250": "\x81\x83\x88\x90\x98"}
STEP_COST = 3.0
MARGIN = 2.0
#: Gain over the cost of a disguise that a wrong encoding needs.
OVER_DISGUISE = 0.5
#: Worth of a restored text whose words beyond ASCII the corpus knows.
KNOWN_WORDS = 4.0
#: Weight of single characters against pairs, as a share of the corpus: a rare character teaches little about the next.
PRIOR = 1e-4
#: Price of a small letter before a capital within a word.
CASE_COST = 5.0
#: Price of a second or later step to anything but UTF-8.
ODD_STEP_COST = 10.0
#: Mean cost around a character beyond ASCII up to which a restored text is believed.
BELIEVABLE = 6.0
#: Gain from which a restored text is believed whatever rare letters it holds.
SURE_GAIN = 25.0
#: Price of a cut character at the end of what a step decodes.
CUT_COST = 18.0
#: Mean cost per character around any character beyond ASCII below which a text is plausible throughout.
PLAUSIBLE = 4.6
ALONE = 3.5
#: Steps to a plausible text; texts with look-alikes allow one.
MAX_STEPS = 6
#: How much worse than the best text so far a node on the way may be, at least and for each character of that.
DETOUR, DETOUR_SHARE = 15.0, 0.25
LOST = "\ufffd"
#: Nodes that one search expands; a search that needs more is reported.
MAX_NODES = 1000

_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_ESCAPE = re.compile(r"&(#\d+|#x[0-9a-fA-F]+|[a-zA-Z]\w+);|(?:%[0-9A-Fa-f]{2}){2,}|\\u[0-9a-fA-F]{4}|=[0-9A-F]{2}=[0-9A-F]{2}")
_ASCII = re.compile(r"[\x09-\x7e]*\Z")
_BEYOND = re.compile("[^\x00-\x7f]")
_LOST_RUN = re.compile("\ufffd+")
_LOST_WORD = re.compile("(?:[^\\W\\d_]|\ufffd)+")
_WORDS = re.compile(r"[^\W\d_]+")
#: Signs that names don't have but wrong decodings do, and small letters before capitals beyond ASCII.
_ODD = re.compile("[\x80-\xbf\xd7\xf7\u2010-\u2bff\uff00-\uffff\u02b0-\u036f]")
_SYMBOLS = re.compile("[\xa1-\xac\xae-\xb3\xb5\xb7\xb9-\xbf\xd7‐-‧‰-›€№™←-⇿☀-➿\U0001f000-\U0001faff️‍]|[α-ω](?=[一-鿿])")
#: Symbols between two letters, or two of the kinds that wrong decodings put side by side.
_INNER = re.compile("[^\\W\\d_][\xa1-\xa9\xab\xac\xae-\xb3\xb7\xb9\xbb-\xbf\xd7‐-‘‚-›€™][^\\W\\d_]|[\xa1-\xbf‐-›€™]{2}")
#: Anything beyond ASCII but the symbols that people type.
_BARE = re.compile("[^\x00-\x7e\xa3\xa9\xab\xae\xb0\xb2\xb3\xb5\xb7\xbb-\xbe\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac\u2116\u2122\u2190-\u21ff\u2600-\u27bf]")
_APOSTROPHE = re.compile("(?<=[a-zA-Z])\u2019(?=(?:s|t|re|ve|ll|d|m)\\b)|(?<=\\b[lcdjmnstLCDJMNST])\u2019(?=[aeiouyhéèêà])")
_MONEY_LETTER = re.compile("\u20ac[^\\W\\d_]")
_JUMP = re.compile("[a-z\xdf-\xff\u0430-\u045f][\xc0-\xde\u0152\u0160\u0178\u017d\u0410-\u042f]|[\xc0-\xde\u0152\u0160\u0178\u017d\u0400-\u042f][a-z\xdf-\xff]+[\xc0-\xde\u0400-\u042f]")
_INCREMENTAL = {c: codecs.getincrementaldecoder(c) for c in ("utf-8", "cp932", "euc_jp", "gbk", "cp949", "big5")}

_TWINS: dict[bytes, bytes] = {}
for _a in (0xFA, 0xFB, 0xFC, 0xED, 0xEE):
    for _b in (*range(0x40, 0x7F), *range(0x80, 0xFD)):
        try:
            _back = bytes((_a, _b)).decode("cp932").encode("cp932")
        except UnicodeDecodeError:
            continue
        if _back != bytes((_a, _b)):
            _TWINS[_back] = bytes((_a, _b))


class Plausibility:
    """Cost of a text in nats under a character bigram model, with digits as one character and letters in lower case."""

    def __init__(self, bigrams: dict[str, float], words: dict[str, float] | None = None):
        total = sum(bigrams.values()) or 1.0
        left: dict[str, float] = {}
        right: dict[str, float] = {}
        fans: dict[str, int] = {}
        for g, n in bigrams.items():
            left[g[0]] = left.get(g[0], 0.0) + n
            right[g[1]] = right.get(g[1], 0.0) + n
            fans[g[0]] = fans.get(g[0], 0) + 1
        self.uni = {c: -math.log(n / total) for c, n in right.items()}
        self.unseen = math.log(total) + 4.0
        k = PRIOR * total
        self.bi = {g: -math.log((n + k * right[g[1]] / total) / (left[g[0]] + k)) for g, n in bigrams.items()}
        self.back = 3.0
        #: Words beyond ASCII by what is left of them when those letters are lost, the commonest first.
        self.masks: dict[str, str] = {}
        for w, _ in sorted((words or {}).items(), key=lambda x: (-x[1], x[0])):
            mask = _BEYOND.sub(LOST, w)
            self.masks.setdefault(mask, w)
            self.masks.setdefault(_LOST_RUN.sub(LOST, mask), w)
        self.words = frozenset(words or ())
        self.next: dict[str, list[str]] = {}
        for g in bigrams:
            self.next.setdefault(g[0], []).append(g[1])

    @staticmethod
    def folded(text: str) -> str:
        return " " + re.sub(r"\d", "0", text.lower()) + " "

    def _each(self, t: str) -> list[float]:
        """The cost of each character of a folded text behind the one before it."""
        v = list(map(self.bi.get, map(add, t, t[1:])))
        if None in v:
            uni, back, unseen = self.uni, self.back, self.unseen
            v = [x if x is not None else uni.get(b, unseen) + back for x, b in zip(v, t[1:])]
        return v

    def cost(self, text: str) -> float:
        return sum(self._each(self.folded(text))) + (0.0 if text.isascii() else CASE_COST * len(_JUMP.findall(text)))

    def worst(self, text: str) -> float:
        """The highest cost near a character beyond ASCII: the mean of three in a row, or of one less ``ALONE``."""
        t = self.folded(text)
        v, high = self._each(t), 0.0
        for k, c in enumerate(t[1:]):
            if c > "\x7f":
                near = v[k - 1 if k else 0 : k + 2]
                high = max(high, sum(near) / len(near), v[k] - ALONE)
        return high


def consistent(text: str) -> bool:
    """Whether each word is in one script, so that the text can teach the model; symbols may stand at the ends of words."""
    if _SYMBOLS.search(text):
        if _INNER.search(text):
            return False
        text = _SYMBOLS.sub("", text)
    return not _ODD.search(text) and all(len({_group(c) for c in w}) == 1 and not _JUMP.search(w) for w in _WORDS.findall(text))


def _group(c: str) -> int:
    """0 Latin, 1 Greek, 2 Cyrillic, 3 Chinese and Japanese, 4 Korean, 5 anything else."""
    o = ord(c)
    return 0 if o < 0x250 else 1 if 0x370 <= o < 0x400 else 2 if 0x400 <= o < 0x530 else 3 if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or o == 0x3005 else 4 if 0xAC00 <= o < 0xD7B0 else 5


def bigrams_of(text: str) -> list[str]:
    t = Plausibility.folded(text)
    return [a + b for a, b in zip(t, t[1:])]


def _twin(raw: bytes) -> bytes:
    """Shift-JIS bytes with the vendor characters in their other place; rows ED and EE repeat those of FA to FC."""
    out, k = bytearray(), 0
    while k < len(raw):
        n = 2 if 0x81 <= raw[k] <= 0x9F or 0xE0 <= raw[k] <= 0xFC else 1
        pair = raw[k : k + n]
        out += _TWINS.get(pair, pair)
        k += n
    return bytes(out)


def _encoded(text: str, codec: str) -> list[bytes]:
    holes = HOLES.get(codec)
    try:
        raw = text.encode(codec)
        return [raw, again] if codec == "cp932" and (again := _twin(raw)) != raw else [raw]
    except UnicodeEncodeError:
        if holes is None:
            return []
    out = []
    for t in [text.replace(LOST, h) for h in holes] if LOST in text else [text] if _C1.search(text) else []:
        try:
            out.append(b"".join(c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode(codec) for c in t))
        except UnicodeEncodeError:
            break
    return out


def _decoded(raw: bytes, codec: str) -> tuple[str | None, int]:
    """Strict but for a cut character at the very end, which is left out and counted."""
    try:
        inc = _INCREMENTAL.get(codec)
        if inc is None:
            return raw.decode(codec), 0
        d = inc("strict")
        return d.decode(raw, False), len(d.getstate()[0])
    except UnicodeDecodeError:
        return None, 0


def neighbours(text: str, seen_bytes: set[bytes]):
    """(step, text, bytes of a cut character) of each text that one step reaches."""
    for shown in SHOWN:
        for raw in _encoded(text, shown):
            if raw in seen_bytes:
                continue
            seen_bytes.add(raw)
            for written in WRITTEN:
                t, cut = _decoded(raw, written)
                if t and t != text:
                    yield f"{shown}>{written}", t, cut
    if _ESCAPE.search(text):
        t = html.unescape(text)
        t = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), t)
        for mark in "%=":
            t = re.sub(rf"(?:{mark}[0-9A-Fa-f]{{2}})+", lambda m: bytes.fromhex(m[0].replace(m[0][0], "")).decode("utf-8", "replace"), t)
        if t != text:
            yield "unescape", t, 0


def _refill(text: str, step: str, model: Plausibility) -> tuple[str, float] | None:
    """Lost characters of a text as the undefined bytes of the codec, each chosen by the cost of what it decodes to."""
    shown, _, written = step.partition(">")
    holes = HOLES.get(shown, "")
    at = [k for k, c in enumerate(text) if c == LOST]
    best: tuple[float, str, str] | None = None
    for h in holes:
        chars = list(text.replace(LOST, h))
        for k in [-1, *at]:
            for x in holes if k >= 0 else h:
                if k >= 0:
                    was, chars[k] = chars[k], x
                for raw in _encoded("".join(chars), shown):
                    t, cut = _decoded(raw, written)
                    if t and (best is None or model.cost(t) + CUT_COST * cut < best[0]):
                        best = (model.cost(t) + CUT_COST * cut, t, "".join(chars))
                if k >= 0:
                    chars[k] = was
            if best is not None and k >= 0 and len(best[2]) == len(chars):
                chars[k] = best[2][k]
    return (best[1], best[0]) if best else None


def search(text: str, model: Plausibility, most_steps: int = MAX_STEPS) -> tuple[str, list[str], float, bool]:
    """The cheapest text found, the steps to it, how much cheaper it is than the text itself, and whether the search was
    finished."""
    first = model.cost(text)
    best = (first, 0, text, [], 0.0)
    heap = [best]
    seen, seen_bytes, expanded = {text}, set(), 0
    finished = True
    while heap:
        cost, depth, t, steps, paid = heapq.heappop(heap)
        if cost > best[0] + max(DETOUR, DETOUR_SHARE * len(best[2])) or (depth and not _ESCAPE.search(t) and model.worst(t) < PLAUSIBLE):
            break  # the cheapest of all that is left is plausible throughout, or all of it is a detour
        if depth >= most_steps:
            continue
        if expanded == MAX_NODES:
            finished = False
            break
        expanded += 1
        for step, n, cut in neighbours(t, seen_bytes):
            if n in seen:
                continue
            seen.add(n)
            price = paid + STEP_COST + CUT_COST * min(cut, 1) + (ODD_STEP_COST if depth and not step.endswith(("utf-8", "unescape")) else 0.0)
            node = (model.cost(n) + price, depth + 1, n, [*steps, step], price)
            if node[:3] < best[:3]:
                best = node
            if not n.isascii() or _ESCAPE.search(n):
                heapq.heappush(heap, node)
    if LOST in text and len(best[3]) == 1 and (again := _refill(text, best[3][0], model)) and again[1] < best[0]:
        best = (again[1] + STEP_COST, 1, again[0], best[3], STEP_COST)
    return best[2], best[3], first - best[0], finished


def restore(text: str, model: Plausibility, most_steps: int = MAX_STEPS) -> tuple[str, list[str], float]:
    return search(text, model, most_steps)[:3]


def _known(m: re.Match, model: Plausibility) -> str:
    """A word with lost letters as the commonest word of the corpus that it can be, in its case."""
    w = m[0]
    if LOST not in w:
        return w
    low = w.lower()
    found = model.masks.get(low) or model.masks.get(_LOST_RUN.sub(LOST, low))
    if found is None:
        return w
    left = [c for c in w if c != LOST]
    if len(left) > 1 and all(c.isupper() for c in left):
        return found.upper()
    return found[0].upper() + found[1:] if w[0].isupper() else found


def fill(text: str, model: Plausibility) -> str:
    """Words with lost letters as words of the corpus; what is left as the likeliest letter between its neighbours."""
    chars = list(_LOST_WORD.sub(lambda m: _known(m, model), text))
    for k, c in enumerate(chars):
        if c != LOST:
            continue
        a = model.folded("".join(chars[:k]))[-2] if k else " "
        b = model.folded("".join(chars[k + 1 : k + 2]))[1] if k + 1 < len(chars) and chars[k + 1] != LOST else None
        opts = [(model.bi[a + x] + (model.bi.get(x + b, model.unseen) if b else 0.0), x) for x in model.next.get(a, ()) if not x.isascii()]
        if opts:
            x = min(opts)[1]
            beside = [y for y in chars[max(0, k - 1) : k] + chars[k + 1 : k + 2] if y.isalpha()]
            chars[k] = x.upper() if beside and all(y.isupper() for y in beside) else x
    return "".join(chars)


def judge(text: str | None, model: Plausibility, at_limit: bool = False) -> tuple[bool, str | None, str]:
    """(garbled, the text as it was or as it is, the steps): the decision on one value.

    ``at_limit`` says that the value is as long as its field allows, so that a lost character at its end was cut.
    """
    return decide(text, model, at_limit)[:3]


def decide(text: str | None, model: Plausibility, at_limit: bool = False) -> tuple[bool, str | None, str, bool]:
    """:func:`judge`, and whether its search was finished."""
    if not suspicious(text):
        return False, text, "", True
    body = text.rstrip(LOST)
    tail = text[len(body) :]
    lost = LOST in body or bool(tail and not at_limit and _lost_letter(body, tail, model))
    sure = lost or bool(_C1.search(text))
    work = text if lost else body
    form, why = fold(work)
    most_steps, escaped = MAX_STEPS, bool(_ESCAPE.search(work))
    if not sure and not escaped and not _JUMP.search(form) and model.worst(form) < PLAUSIBLE:
        if "script" not in why:
            return False, text, "", True
        most_steps = 1  # plausible with look-alikes replaced; only a single wrong decoding explains it as well
    found, steps, gain, finished = search(work, model, most_steps)
    first = model.cost(work)
    images = _WORDS.sub(lambda m: whole_image(m[0]) or m[0], form)
    plain = min(model.cost(form), model.cost(images) + STEP_COST)
    margin = MARGIN
    if form != work or images != work:  # a disguise explains the text as well as a wrong encoding does
        gain -= max(0.0, first - plain - STEP_COST)
        margin = OVER_DISGUISE
        beyond = [w for w in _WORDS.findall(found.lower()) if not w.isascii()]
        if steps and beyond and all(w in model.words for w in beyond):
            gain += KNOWN_WORDS
    elif escaped:
        gain = gain if not found.isascii() else 0.0  # an escape of plain ASCII is no wrong decoding
    elif not _BARE.search(work) and not _MONEY_LETTER.search(work) and (consistent(work) or _APOSTROPHE.sub("", work).isascii()):
        margin = SURE_GAIN  # symbols that stand where they belong
    if len(steps) > 1 and not all(x.endswith(("utf-8", "unescape")) for x in steps):
        margin = max(margin, 1.6 * SURE_GAIN)  # a chain of other codecs can lead anywhere
    if lost:
        filled = fill(work, model)
        if LOST not in filled and model.worst(filled) < BELIEVABLE and (not steps or model.cost(filled) + STEP_COST < first - gain):
            found, steps = filled, ["fill"]
        return True, found, " ".join(steps), finished
    if steps and gain > margin and (gain > SURE_GAIN or model.worst(found) < BELIEVABLE) and (sure or consistent(fold(found.rstrip(LOST))[0] or "")):
        return True, found, " ".join(steps), finished
    return sure, text, "", finished


def _lost_letter(body: str, tail: str, model: Plausibility) -> bool:
    """Whether a lost character at the end stands for the last letter of a word rather than for a cut: nothing else in
    the text is beyond ASCII, and some letter between the one before and a word end is likely."""
    if not body.isascii() or not body[-1:].isalpha() or len(tail) > 1:
        return len(tail) > 1
    a = body[-1].lower()
    return any(model.bi[a + x] + model.bi.get(x + " ", model.unseen) < 9.0 for x in model.next.get(a, ()) if not x.isascii())


def suspicious(text: str | None) -> bool:
    """Texts that need a search at all: those with anything but plain ASCII, or with escapes."""
    return bool(text) and (not _ASCII.match(text) or bool(_ESCAPE.search(text)))


# ---------------------------------------------------------------------------------------------------------------------
# on DataFrames


#: Decisions that a task remembers; long values are not kept beside others.
CACHED, SHORT = 50_000, 300
#: Pairs of characters and words beyond ASCII in the model, the commonest ones; sf0.1 has 3 thousand and 1.5 thousand.
PAIRS, KNOWN = 1 << 20, 1 << 17
#: Up to so many different garbled values are sent to all tasks; more are joined by shuffle.
GARBLED = 100_000


def _count_bigrams(batches):
    import pandas as pd

    total: Counter = Counter()
    for b in batches:
        values = pd.concat([b[c] for c in b.columns]).dropna().value_counts()
        for v, n in values.items():
            f = fold(v)[0]
            if f and consistent(f):
                for g in bigrams_of(f):
                    total[g] += n
                if not f.isascii():
                    for w in _WORDS.findall(f.lower()):
                        if not w.isascii():
                            total["\x01" + w] += n
    yield pd.DataFrame({"g": list(total), "n": pd.Series(list(total.values()), dtype="int64")})


def plausibility(df: DataFrame, fields: list[str]) -> Plausibility:
    """The bigram model and the words beyond ASCII of all values of ``fields``; counted in the partitions and summed. The
    ``PAIRS`` commonest pairs and the ``KNOWN`` commonest words come to the driver; a pair or word beyond them costs what
    one costs that was never seen, at every size of the corpus."""
    counts = stored(df.select(*fields).transform(frames, _count_bigrams, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")))
    word = F.col("g").startswith("\x01") & (F.length("g") > 2)
    top = lambda d, k: {r["g"]: float(r["n"]) for r in d.orderBy(F.desc("n"), "g").limit(k).toLocalIterator()}
    pairs, words = top(counts.where(~word & (F.length("g") == 2) & ~F.col("g").startswith("\x01")), PAIRS), top(counts.where(word), KNOWN)
    return Plausibility(pairs, {g[1:]: n for g, n in words.items()})


#: A limit has at least so many different values, and so many times as many as each of the ``BELOW`` lengths below it on
#: average; of longer ones there are so many times fewer.
LEAST_PILE, PILE, BELOW = 4, 2.0, 8


def field_limits(df: DataFrame, fields: list[str], source: str = "source") -> DataFrame:
    """(source, <field>_bytes, <field>_chars): the length at which the different values of a field of a source pile up at
    the upper end, in bytes and in characters; null where they don't. Lost ends are left out of the lengths."""
    each = df.select(F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.rtrim(F.col(f), F.lit(LOST)).alias("v")) for f in fields])).alias("x")).select("source", "x.*").where("v is not null").distinct()
    kinds = F.array(F.struct(F.lit("bytes").alias("kind"), F.octet_length("v").alias("size")), F.struct(F.lit("chars").alias("kind"), F.char_length("v").alias("size")))
    # a histogram per source and field, with as many rows as there are lengths
    n = each.select("source", "field", F.explode(kinds).alias("x")).groupBy("source", "field", "x.kind", "x.size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source", "field", "kind").orderBy("size")
    below = F.coalesce(F.sum("n").over(w.rangeBetween(-BELOW, -1)), F.lit(0)) / BELOW
    longer = F.coalesce(F.sum("n").over(w.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    piles = n.select("*", below.alias("below"), longer.alias("longer")).where((F.col("n") >= LEAST_PILE) & (F.col("n") >= PILE * F.col("below")) & (PILE * F.col("longer") <= F.col("n")))
    return piles.groupBy("source").agg(*[F.max(F.when((F.col("field") == f) & (F.col("kind") == k), F.col("size"))).alias(f"{f}_{k}") for f in fields for k in ("bytes", "chars")])


def with_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with the limits of their source; sources are few, and if they aren't the join shuffles."""
    limits = bounded(limits.withColumnRenamed("source", "_source"))
    return rows.join(limits, rows["source"].eqNullSafe(limits["_source"]), "left").drop("_source")


def each_field(rows: DataFrame, fields: list[str], *more: Callable[[str], Column]) -> DataFrame:
    """One row per field: field, value and ``more`` columns made of the field's name, beside the other columns."""
    rest = [c for c in rows.columns if c not in fields and not any(c in (f"{f}_bytes", f"{f}_chars") for f in fields)]
    one = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), *[m(f) for m in more])
    return rows.select(*rest, F.explode(F.array(*map(one, fields))).alias("_x")).select(*rest, "_x.*")


def _cut(field: str) -> Column:
    """Whether the field's value ends in a lost character where its bytes reach the limit."""
    v = F.col(field)
    return F.coalesce(v.endswith(LOST) & (F.octet_length(F.rtrim(v, F.lit(LOST))) >= F.col(f"{field}_bytes") - 3), F.lit(False)).alias("cut")


#: What a value must hold to need a decision: anything beyond ASCII, or an escape.
_ASK = r"[^\x09-\x7e]|&#?\w+;|%[0-9A-Fa-f]|\\u|=[0-9A-F]"


def judged(df: DataFrame, fields: list[str], model: Plausibility) -> DataFrame:
    """(path, idx, source, field, value, restored, steps, finished) of each value that is garbled; each different value is
    judged once."""
    rows = with_limits(df.select("path", "idx", "source", *fields), field_limits(df, fields))
    rows = each_field(rows, fields, _cut).where(F.col("value").rlike(_ASK))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pandas as pd

        m = sent.value
        for b in batches:
            made = [decide(v, m, c) for v, c in zip(b["value"], b["cut"])]
            hit = [x[0] for x in made]
            b = b.assign(restored=[x[1] for x in made], steps=[x[2] for x in made], finished=[x[3] for x in made])
            yield b[hit]

    each = spread(rows.select("value", "cut").distinct()).transform(frames, run, "value string, cut boolean, restored string, steps string, finished boolean")
    return rows.join(bounded(stored(each), GARBLED), ["value", "cut"]).select("path", "idx", "source", "field", "value", "restored", "steps", "finished")


def garbled(df: DataFrame, fields: list[str] = ("layer_name", "name_unicode"), model: Plausibility | None = None) -> DataFrame:
    """Each garbled value once by (path, idx, field), with the restored text."""
    fields = list(fields)
    df = df.where("path is not null and idx is not null")
    found = judged(df, fields, model or plausibility(df, fields))
    return found.groupBy("path", "idx", "field").agg(F.min(F.struct("source", "value", "restored", "steps", "finished")).alias("m")).select("path", "idx", "field", "m.*")
