"""Mixing sources to target weights.

Copies of one message in several sources are one document that may count for any of them. Documents are aggregated by
the set of sources they are in (membership pattern); a min-cost flow routes the tokens of each pattern to the quotas of
the sources, where the k-th repetition of a pattern costs k - 1, so that repetitions come last and are spread; the
total is the largest that all quotas can be met for, at most ``total`` if given, else at most the tokens there are.
Documents are then laid out on a seeded line per pattern, and each source takes its stretch of it; a line is walked
again for each repetition.

The tokens are those of a public byte-level BPE, ``tokenizer`` is the path of its ranks. Positions on the lines come
from sums over hash buckets, so no line is sorted in one task.

Results for odd input: documents of sources without target, with null source, text or id are not used; a null message
id stands for itself; a document delivered twice counts once; an empty text has no tokens and is never selected; the
share of a source without documents is spread over the others in proportion, and is reported as 0 reached; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strata.session import bounded, frames, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level BPE splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Messages per hash bucket of a line, and buckets at least.
PER_BUCKET, BUCKETS = 4096, 1024
#: Up to so many rows of buckets are sent to all tasks; more are joined by shuffle.
STARTS = 100_000
SEED = 7


def _tokens(tokenizer: str):
    def run(batches):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield b.drop(columns="text").assign(n_tokens=[len(enc.encode_ordinary(t)) for t in b["text"]])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, message_id, n_tokens) of each document once."""
    d = documents.where("doc_id is not null and text is not null and source is not null").select("doc_id", "source", "message_id", "text")
    counted = d.transform(frames, _tokens(tokenizer), "doc_id bigint, source string, message_id string, n_tokens bigint")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "message_id", "n_tokens")).alias("m")).select("doc_id", "m.*")


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> tuple[int, list[int]]:
    """Largest flow at least cost, by shortest augmenting paths; arcs are (from, to, capacity, cost)."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)
    total = 0
    while True:
        dist, via, queue, queued = [None] * n, [-1] * n, deque([source]), [False] * n
        dist[source] = 0
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in out[x]:
                if cap[e] > 0 and (dist[to[e]] is None or dist[x] + cost[e] < dist[to[e]]):
                    dist[to[e]], via[to[e]] = dist[x] + cost[e], e
                    if not queued[to[e]]:
                        queue.append(to[e])
                        queued[to[e]] = True
        if dist[sink] is None:
            return total, [cap[2 * k + 1] for k in range(len(arcs))]
        push, x = None, sink
        while x != source:
            push = cap[via[x]] if push is None else min(push, cap[via[x]])
            x = to[via[x] ^ 1]
        x = sink
        while x != source:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
        total += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """The total and the tokens that each pattern gives to each source."""
    sources, pats = sorted(s for s, (share, _) in targets.items() if share > 0), sorted(patterns)
    node = {("s", s): 2 + k for k, s in enumerate(sources)} | {("p", p): 2 + len(sources) + k for k, p in enumerate(pats)}

    def flow(size: int) -> tuple[int, int, dict]:
        arcs, label = [], []
        for p in pats:
            own = [s for s in p if s in targets and targets[s][0] > 0]
            for k in range(max((targets[s][1] for s in own), default=0)):
                arcs.append((0, node["p", p], patterns[p], k))
                label.append(None)
            for s in own:
                arcs.append((node["p", p], node["s", s], patterns[p] * targets[s][1], 0))
                label.append((p, s))
        quota = {s: int(size * targets[s][0]) for s in sources}
        for s in sources:
            arcs.append((node["s", s], 1, quota[s], 0))
            label.append(None)
        got, used = min_cost_flow(2 + len(node), arcs, 0, 1)
        return got, sum(quota.values()), {x: v for x, v in zip(label, used) if x and v}

    low, high = 0, sum(patterns.values()) if total is None else total
    got, asked, used = flow(high)
    if got == asked:
        return high, used
    while high - low > max(1, high // 1_000_000):
        mid = (low + high) // 2
        got, asked, tried = flow(mid)
        low, high = (mid, high) if got == asked else (low, mid)
    return low, flow(low)[2]


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, times): the selected documents, for which source and how often."""
    spark = documents.sparkSession
    goal = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share is not null and max_repeats is not null").toLocalIterator()}
    tokens = stored(token_counts(documents, tokenizer))
    known = tokens.where(F.col("source").isin(list(goal)) & (F.col("n_tokens") > 0)).withColumn("message", F.coalesce("message_id", F.concat(F.lit("#"), "doc_id")))
    # a message once per source; its size is that of the largest copy, so that no quota is passed unseen
    copies = known.groupBy("message", "source").agg(F.min(F.struct("doc_id", "n_tokens")).alias("m")).select("message", "source", "m.*")
    groups = copies.groupBy("message").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.max("n_tokens").alias("n_tokens"))
    groups = stored(groups.withColumn("key", F.xxhash64(F.lit(seed), "message")))
    n_buckets = max(BUCKETS, -(-groups.count() // PER_BUCKET))
    groups = groups.withColumn("bucket", F.pmod(F.shiftright("key", 20), F.lit(n_buckets)))
    buckets = stored(groups.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("s")))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.withColumn("before", before)
    sizes = {tuple(r["pattern"]): int(r["s"]) for r in buckets.groupBy("pattern").agg(F.sum("s").alias("s")).toLocalIterator()}
    there = {s for p in sizes for s in p}
    whole = sum(share for s, (share, _) in goal.items() if s in there) or 1.0
    goal = {s: (share / whole, most) for s, (share, most) in goal.items() if s in there}
    _, given = route(sizes, goal, total)
    # each source's stretch of a pattern's line; the line repeats after the pattern's size
    stretches, ends = [], {}
    for (p, s), v in sorted(given.items()):
        at = ends.get(p, 0)
        stretches.append((list(p), s, at, at + v, sizes[p]))
        ends[p] = at + v
    schema = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("source", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("size", T.LongType())])
    lines = F.broadcast(spark.createDataFrame(stretches, schema))  # at most patterns x sources rows
    within = F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("key", "message").rowsBetween(Window.unboundedPreceding, -1))
    placed = groups.withColumn("within", F.coalesce(within, F.lit(0))).join(bounded(starts.select("pattern", "bucket", "before"), STARTS), ["pattern", "bucket"])
    # the middle of a document decides to which stretch it belongs, at each walk along the line
    mid = F.col("before") + F.col("within") + F.expr("n_tokens div 2")
    first = F.greatest(F.lit(0), F.ceil((F.col("a") - mid) / F.col("size")))
    last = F.ceil((F.col("b") - mid) / F.col("size")) - 1
    taken = placed.withColumn("mid", mid).join(lines, "pattern").withColumn("times", (last - first + 1).cast("int")).where("times > 0").select("message", "source", "times")
    return taken.join(copies, ["message", "source"]).select("doc_id", "source", "n_tokens", "times")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, share, most_times): the shares reached."""
    chosen = stored(chosen)
    got = chosen.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("times")).alias("n_tokens"), F.max("times").alias("most_times"))
    goal = targets.where("source is not null").groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    full = goal.join(got, "source", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    whole = chosen.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("times")), F.lit(0))).first()[0]
    return full.select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "n_tokens",
        (F.col("n_tokens") / F.lit(float(whole) if whole else None)).alias("share"), F.coalesce("most_times", F.lit(0)).alias("most_times"),
    )


#: By how much a share may miss its target: documents are not cut, and a copy may be shorter than the largest one.
TOLERANCE = 0.005


def kept(reached: DataFrame) -> DataFrame:
    """(source, within_share, within_repeats): whether the shares reached and the repetitions are those asked for."""
    return reached.select("source", (F.abs(F.col("share") - F.col("target_share")) <= TOLERANCE).alias("within_share"), (F.col("most_times") <= F.col("max_repeats")).alias("within_repeats"))
