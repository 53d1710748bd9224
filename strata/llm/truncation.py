"""Text cut off by field limits: which values lost their end, and how often that happens in each source.

Values are first restored from wrong encodings and brought to one form, each different value once. Words are the runs of
letters; text without blanks (Chinese, Japanese) is split where its script changes. The corpus vocabulary forms a trie,
kept as a table with one row per prefix (distributed, its size never meets one machine): how often the prefix is a word
before other words, how often it is the last word, and how often words are that continue it. Uses are counted over
different texts, so that copies of a cut name are no evidence for it. A value is cut if

* its last word is no known word but a proper prefix of known words, which also hold behind the word before it, or
* its last word is known but hardly ever ends a sentence, and the value reads as a sentence, or, without blanks, the
  last run hardly ever ends its text, or
* half a character stands at its end, or
* the other field of the same layer continues it within the word.

Length evidence: the share of a word's ends that a cut explains grows where the value is as long as its field allows in
its source; the limits are the lengths at which the different values of a (source, field) pile up at the upper end.

Results for odd input: null and empty values are no cases; repeated rows count once; digits at the end are complete;
an empty table gives an empty result and an empty report.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.confusables import fold
from strata.llm.mojibake import LOST, Plausibility, each_field, field_limits, judge, with_limits
from strata.session import bounded, frames, spread, stored

FIELDS = ["layer_name", "name_unicode"]
#: A last word is unknown if its uses are below this share of the uses of words that continue it; more at a limit.
FRAGMENT_SHARE, FRAGMENT_SHARE_AT_LIMIT = 0.1, 0.3
#: A cut word never stands before others: up to this share of the uses of words that continue it counts as noise.
INNER_SHARE = 0.002
#: Different texts in which a word is the last one behind one word, from which it may be known there, if they are above this
#: share of the uses of the words that continue it there.
CONTEXT_USES, CONTEXT_SHARE = 5, 0.3
#: Up to so many words are sent to all tasks; more are joined by shuffle.
WORDS = 100_000
#: A word ends no sentence if it is last in less than this share of its uses.
END_SHARE = 0.06
#: Uses as a last word that are assumed beside those that were seen.
UNSEEN_ENDS = 1.2
#: Up to so many different cut values are sent to all tasks; more are joined by shuffle.
CASES = 100_000

_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Reads as a sentence: a capital first, then words behind single blanks, at least two of them in small letters.
_SENTENCE = re.compile(r"[^\W\d_a-zß-ÿа-џ][^\s_/]*(?: [^\W_]+(?:['’-][^\W_]+)*){2,}[ .!?]?")
_SMALL = re.compile(r" [a-zß-ÿа-џ]")
_RUN = re.compile("[㐀-鿿々]+|[ぁ-ゟ]+|[゠-ヿ]+|[^々ぁ-ヿ㐀-鿿]+")


def pieces(text: str) -> list[tuple[str, bool]]:
    """The words of a text in lower case, each with whether it goes on without a break into the next."""
    out: list[tuple[str, bool]] = []
    for m in _LETTERS.finditer(text):
        runs = _RUN.findall(m[0].lower())
        out += [(r, k + 1 < len(runs)) for k, r in enumerate(runs)]
    return out


def _prepare(model):
    def run(batches):
        m = model.value
        for b in batches:
            made = [_ready(v, v.rstrip(LOST), c, m) for v, c in zip(b["value"], b["at_limit"])]
            yield b.assign(**{n: [x[k] for x in made] for k, n in enumerate(("text", "half", "sentence", "words"))})

    return run


def _at_limit(field: str) -> Column:
    v = F.col(field)
    body = F.rtrim(v, F.lit(LOST))
    by_bytes = F.octet_length(body) >= F.col(f"{field}_bytes") - F.when(body != v, 3).otherwise(0)
    return (F.coalesce(by_bytes, F.lit(False)) | F.coalesce(F.char_length(body) >= F.col(f"{field}_chars"), F.lit(False))).alias("at_limit")


def _ready(value: str, body: str, at_limit: bool, model: Plausibility) -> tuple[str, bool, bool, list[str]]:
    """The readable text, whether half a character stands at its end, whether it is a sentence, and its words; those that go on end in ``+``."""
    garbled, restored, steps = judge(value, model, at_limit)
    text = (fold(restored)[0] if not garbled or steps else body) or ""
    half = not garbled and body != value
    text = text.rstrip(LOST)
    words = [w + "+" * on for w, on in pieces(text)]
    last = text[-1:]
    if words and not (last.isalpha() or half):  # ends behind its last word
        words.append(" " if last.isspace() else ".")
    if garbled and not steps:
        words = []
    return text, half, bool(_SENTENCE.fullmatch(text)) and len(_SMALL.findall(text)) > 1, words


def prepared(layers: DataFrame, model: Plausibility) -> tuple[DataFrame, DataFrame]:
    """(path, idx, source, field, value, at_limit, other) once per (path, idx, field), where other is the value of the other
    field, and (value, at_limit, text, half, sentence, words) once per different value."""
    rows = layers.where("path is not null and idx is not null").groupBy("path", "idx").agg(F.min(F.struct("source", *FIELDS)).alias("m")).select("path", "idx", "m.*")
    rows = with_limits(rows, field_limits(layers, FIELDS))
    other = lambda f: F.nullif(F.col(FIELDS[1 - FIELDS.index(f)]), F.lit("")).alias("other")
    rows = stored(each_field(rows, FIELDS, _at_limit, other).where("value <> ''"))
    sent = layers.sparkSession.sparkContext.broadcast(model)
    each = spread(rows.select("value", "at_limit").distinct()).transform(frames, _prepare(sent), "value string, at_limit boolean, text string, half boolean, sentence boolean, words array<string>")
    return rows, stored(each)


def trie(ready: DataFrame) -> DataFrame:
    """(sentence, prefix, inner, last, on, more): one row per trie node that is a word; sentences have a trie of their own.

    inner and last: uses of the node as a word before others and as the last word; on: uses as a run that goes on without
    a break; more: uses of words that continue it.
    """
    each = ready.select("sentence", F.posexplode("words").alias("at", "w"), F.size("words").alias("n"))
    uses = each.groupBy("sentence", "w", (F.col("at") + 1 == F.col("n")).alias("end")).agg(F.count("*").alias("n"))
    bare = F.regexp_replace("w", r"\+$", "")
    on = F.col("w").endswith("+")
    words = uses.where("w not in ('.', ' ')").groupBy("sentence", bare.alias("w")).agg(
        F.sum(F.when(~F.col("end"), F.col("n")).otherwise(0)).alias("inner"),
        F.sum(F.when(F.col("end"), F.col("n")).otherwise(0)).alias("last"),
        F.sum(F.when(on, F.col("n")).otherwise(0)).alias("on"),
    )
    own = words.select("sentence", F.col("w").alias("prefix"), "inner", "last", "on", F.lit(0).cast("bigint").alias("more"))
    longer = words.where("length(w) > 1").select("sentence", F.explode(F.expr("transform(sequence(1, length(w) - 1), k -> left(w, k))")).alias("prefix"), (F.col("inner") + F.col("last")).alias("more"))
    longer = longer.groupBy("sentence", "prefix").agg(F.sum("more").alias("more"))
    return own.drop("more").join(longer, ["sentence", "prefix"], "left").select("sentence", "prefix", "inner", "last", "on", F.coalesce("more", F.lit(0)).alias("more"))


def known_in_context(ready: DataFrame, suspects: DataFrame) -> DataFrame:
    """(sentence, before, w): last words among ``suspects`` (sentence, w) that are complete behind the word before them."""
    pairs = ready.where("size(words) > 1").select("sentence", F.explode(F.expr("transform(sequence(2, size(words)), k -> struct(words[k - 2] as before, words[k - 1] as w, k = size(words) as end))")).alias("p")).select("sentence", "p.*")
    uses = pairs.where("w not in ('.', ' ')").groupBy("sentence", "before", "w").agg(F.count("*").alias("n"), F.sum(F.col("end").cast("int")).alias("last"))
    ends = uses.where(F.col("last") >= CONTEXT_USES).join(suspects, ["sentence", "w"], "left_semi")
    longer = uses.where("length(w) > 1").select("sentence", "before", F.explode(F.expr("transform(sequence(1, length(w) - 1), k -> left(w, k))")).alias("w"), "n").join(ends, ["sentence", "before", "w"], "left_semi").groupBy("sentence", "before", "w").agg(F.sum("n").alias("more"))
    return ends.join(longer, ["sentence", "before", "w"], "left").where(F.col("last") >= CONTEXT_SHARE * F.coalesce("more", F.lit(0))).select("sentence", "before", "w")


def decided(each: DataFrame) -> DataFrame:
    """(value, at_limit, text, n_words, why) of different values; why is null for those that are complete by themselves."""
    evidence = each.where("size(words) > 0").dropDuplicates(["text"])
    nodes = trie(evidence)
    # only a word that may be cut, or that ends no sentence, can make a case: these go to the values
    uses, share = F.col("inner") + F.col("last"), F.when(F.col("at_limit"), FRAGMENT_SHARE_AT_LIMIT).otherwise(FRAGMENT_SHARE)
    kinds = nodes.select(
        "sentence", F.col("prefix").alias("w"), "inner", "last", "on", "more",
        (F.col("last") + UNSEEN_ENDS < END_SHARE * uses).alias("no_end"),
        (uses - F.col("on") + UNSEEN_ENDS < END_SHARE * uses).alias("goes_on"),
    ).where((F.col("more") * FRAGMENT_SHARE_AT_LIMIT > uses) | F.col("no_end") | F.col("goes_on"))
    v = each.withColumn("tail", F.expr("get(words, size(words) - 1)")).withColumn("spaced", F.coalesce(F.col("tail") == " ", F.lit(False))).withColumn("dotted", F.coalesce(F.col("tail") == ".", F.lit(False)))
    v = v.withColumn("w", F.regexp_replace(F.when(F.col("spaced") | F.col("dotted"), F.expr("get(words, greatest(size(words) - 2, 0))")).otherwise(F.col("tail")), r"\+$", ""))
    v = v.withColumn("before", F.expr("get(words, size(words) - 2)"))
    kinds = bounded(stored(kinds), WORDS)
    fine = known_in_context(evidence, kinds.select("sentence", "w")).withColumn("in_context", F.lit(True))
    v = v.join(kinds, ["sentence", "w"], "left").join(bounded(stored(fine), WORDS), ["sentence", "before", "w"], "left")
    fragment = ~F.col("dotted") & ~F.col("spaced") & (F.col("inner") <= INNER_SHARE * F.col("more")) & (F.col("last") < share * F.col("more")) & F.col("in_context").isNull()
    ending = ~F.col("dotted") & F.col("no_end") & F.col("sentence")
    run = ~F.col("dotted") & ~F.col("spaced") & F.col("goes_on") & F.col("w").rlike("[々ぁ-ヿ㐀-鿿]")
    why = F.when(F.col("half"), "half a character").when(fragment, "within a word").when(ending, "within a sentence").when(run, "within a text")
    return v.select("value", "at_limit", "text", F.size("words").alias("n_words"), F.when(F.size("words") > 0, why).alias("why"))


def _continued(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of complete values that the other field continues within the word, whose text and why they get."""
    longer = rows.where("octet_length(other) > octet_length(value)")
    texts = ends.groupBy(F.col("value").alias("other")).agg(F.min("text").alias("_t"))
    both = longer.join(ends.where("why is null and n_words > 0"), ["value", "at_limit"]).join(texts, "other")
    go_on = (F.length("_t") > F.length("text")) & F.col("_t").startswith(F.col("text"))
    within = go_on & F.substring("_t", F.length("text") + 1, 1).rlike(r"(?U)[\p{L}]") & F.col("text").rlike(r"(?U)\p{L}$")
    return both.where(within).withColumn("why", F.lit("the other field goes on"))


_CASE = ["path", "idx", "source", "field", "text", "at_limit", "why"]


def truncated(layers: DataFrame, model: Plausibility) -> DataFrame:
    """(path, idx, source, field, text, at_limit, why) of each value that lost its end."""
    return _cases(layers, model)[2]


def _cases(layers: DataFrame, model: Plausibility) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, each = prepared(layers, model)
    ends = stored(decided(each))
    by_itself = rows.join(bounded(ends.where("why is not null"), CASES), ["value", "at_limit"])
    return rows, ends, by_itself.select(*_CASE).unionByName(_continued(rows, ends).select(*_CASE))


def report(layers: DataFrame, model: Plausibility) -> DataFrame:
    """(source, field, n_values, n_cut, share, n_at_limit, and one count per reason): how often each source truncates."""
    rows, ends, cases = _cases(layers, model)
    per = rows.groupBy("source", "field", "value", "at_limit").agg(F.count("*").alias("n"))
    n = per.join(ends.where("n_words > 0").select("value", "at_limit"), ["value", "at_limit"]).groupBy("source", "field").agg(F.sum("n").alias("n_values"))
    reasons = {"half_a_character": "half a character", "within_word": "within a word", "within_sentence": "within a sentence", "within_text": "within a text", "other_goes_on": "the other field goes on"}
    cut = cases.groupBy("source", "field").agg(F.count("*").alias("n_cut"), F.count_if("at_limit").alias("n_at_limit"), *[F.count_if(F.col("why") == w).alias(c) for c, w in reasons.items()])
    both = n.withColumnRenamed("source", "_s").join(cut, F.col("_s").eqNullSafe(cut["source"]) & (n["field"] == cut["field"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(F.col("_s").alias("source"), n["field"].alias("field"), "n_values", zero("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_values")).alias("share"), zero("n_at_limit"), *[zero(c) for c in reasons])
