"""Visually identical text on DataFrames: the one form of each value and what was changed.

The form of a value is :func:`strata.llm.confusables.fold` with all classes of look-alikes; each different value is folded
once. Words wholly in look-alike letters of another script need the corpus: the image is taken where it is, in letters
of either case, ``TIMES`` as frequent as the spelling found; a word of one or two letters, which says little, only in a
value that has Latin words and no other word of that script. Values that are garbled by a wrong encoding are left as
they are and are no cases.

Results for odd input: null and empty values have themselves as form; rows without path or idx are left out of the
cases; a value that is delivered twice counts once per (path, idx, field); an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.confusables import Shapes, fold, scripts, shapes
from strata.llm.mojibake import Plausibility, judge
from strata.session import bounded, frames, spread, stored

TIMES = 20
#: Up to so many words, or changed values, are sent to all tasks; more are joined by shuffle.
WORDS = 100_000
_LATIN = r"(?<![\\p{L}\\p{M}])[a-zA-Z]+(?![\\p{L}\\p{M}])"
_RUN = re.compile(r"[^\W\d_]+")


def _candidates(text: str, known: Shapes) -> list[dict[str, str]]:
    """Words of a folded text that are wholly in look-alikes of another script, with their Latin images."""
    words = _RUN.findall(text)
    found = [(w, image) for w in dict.fromkeys(words) if not w.isascii() and (image := known.whole_image(w))]
    if any(len(w) < 3 for w, _ in found):
        latin = any(w.isascii() for w in words)
        whole = {w for w, _ in found}
        proper = frozenset().union(*(scripts(c) for w in words if w not in whole for c in w))
        found = [(w, image) for w, image in found if len(w) > 2 or (latin and proper.isdisjoint(scripts(w[0])))]
    return [{"word": w, "to": image} for w, image in found]


def _fold_kernel(sent):
    def run(batches):
        model, known = sent.value
        for b in batches:
            out = []
            for v in b["value"]:
                form, why = fold(v, known, True)
                whole = _candidates(form, known)
                out.append((v, form, " ".join(why), whole) if (why or whole) and not judge(v, model)[0] else None)
            yield pd.DataFrame([x for x in out if x], columns=["value", "form", "why", "whole"])

    return run


def whole_words(values: DataFrame, found: DataFrame) -> DataFrame:
    """(word): words of ``found`` (word, image, n) whose image the different ``values`` (value) know far better."""
    latin = values.select(F.explode(F.expr(f"regexp_extract_all(value, '{_LATIN}', 0)")).alias("w")).select(F.lower("w").alias("image"))
    known = latin.join(bounded(found.select("image").distinct(), WORDS), "image", "left_semi").groupBy("image").agg(F.count("*").alias("m"))
    return found.join(known, "image").where(F.col("m") >= TIMES * F.col("n")).select("word")


def changed(values: DataFrame, model: Plausibility, known: Shapes | None = None) -> DataFrame:
    """(value, form, why) of each different value (value) whose form is another."""
    spark = values.sparkSession
    sent = spark.sparkContext.broadcast((model, known or shapes(spark)))
    each = values.where("value <> ''").select("value").distinct()
    folded = stored(spread(each.where(F.col("value").rlike("[^\\x00-\\x7e]"))).transform(frames, _fold_kernel(sent), "value string, form string, why string, whole array<struct<word:string,to:string>>"))
    open_ = folded.where("size(whole) > 0")
    uses = open_.select(F.explode("whole").alias("x")).groupBy(F.col("x.word").alias("word"), F.lower("x.to").alias("image")).agg(F.count("*").alias("n"))
    words = bounded(stored(whole_words(each, uses)), WORDS)
    hit = open_.select("value", "form", "why", F.explode("whole").alias("x")).join(words.withColumnRenamed("word", "_w"), F.col("x.word") == F.col("_w"), "left")
    subs = hit.groupBy("value").agg(F.first("form").alias("form"), F.first("why").alias("why"), F.collect_set(F.when(F.col("_w").isNotNull(), F.col("x"))).alias("subs"))
    done = subs.select(
        "value",
        F.expr("aggregate(subs, form, (t, s) -> regexp_replace(t, concat('(?<![\\\\p{L}\\\\p{M}])', s.word, '(?![\\\\p{L}\\\\p{M}])'), s.to))").alias("form"),
        F.concat_ws(" ", F.nullif("why", F.lit("")), F.when(F.size("subs") > 0, "script")).alias("why"),
    )
    return folded.where("size(whole) = 0 or whole is null").select("value", "form", "why").unionByName(done).where("why <> ''")


def one_form(values: DataFrame, model: Plausibility) -> DataFrame:
    """(path, idx, field, value, form, why) for (path, idx, field, value); why is empty where nothing was changed."""
    new = bounded(stored(changed(values.select("value"), model)), WORDS)
    rows = values.select("path", "idx", "field", "value").join(new, "value", "left")
    return rows.select("path", "idx", "field", "value", F.coalesce("form", "value").alias("form"), F.coalesce("why", F.lit("")).alias("why"))


def values_of(layers: DataFrame, text_layers: DataFrame) -> DataFrame:
    """(path, idx, field, value) of name_unicode and text."""
    a = layers.select("path", "idx", F.lit("name_unicode").alias("field"), F.col("name_unicode").alias("value"))
    b = text_layers.select("path", "idx", F.lit("text").alias("field"), F.col("text").alias("value"))
    return a.unionByName(b).where("path is not null and idx is not null")


def disguised(layers: DataFrame, text_layers: DataFrame, model: Plausibility) -> DataFrame:
    """(path, idx, field, value, form, why) once per disguised value."""
    values = values_of(layers, text_layers)
    found = values.join(bounded(stored(changed(values.select("value"), model)), WORDS), "value")
    return found.groupBy("path", "idx", "field").agg(F.min(F.struct("value", "form", "why")).alias("m")).select("path", "idx", "field", "m.*")
