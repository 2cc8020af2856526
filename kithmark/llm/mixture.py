"""Combining sources to target shares of tokens with a low-discrepancy schedule.

The mixture is a row of slots of equal size. Slot i belongs to the source into whose piece of the
cumulative target shares the golden-ratio point frac((i + 1/2) * phi) falls, so that every stretch of the
schedule has nearly the target shares. The pages of a source are shuffled by a hash, once for each
repetition, laid end to end and cut into blocks of equally many tokens; the k-th block of a source is
joined with the k-th slot of that source. Ranks and running totals are built in two levels (bucket totals, then
within the bucket), so that no source, however large, is sorted in one task.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kithmark.runtime import cut

GOLDEN = (math.sqrt(5) - 1) / 2
#: The table of targets is a parameter and goes to the driver; more sources than this are refused.
MAX_SOURCES = 10_000
#: Parts of the unit interval in which a point is looked for.
CELLS = 4096
_ENCODERS: dict[str, object] = {}


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def with_token_counts(df: DataFrame, keep: list[str], text: str, vocabulary: str) -> DataFrame:
    """``keep`` and ``n_tokens`` of the whole text; null and empty texts have none."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", n_tokens long"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocabulary)
        for b in batches:
            yield b[keep].assign(n_tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in b["_text"]])

    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(count, schema)


@dataclass
class Mixture:
    """``schedule``: one row per chosen page and repetition; ``blocks``: one row per slot and page in its block; ``shares``: one row per source."""

    schedule: DataFrame
    blocks: DataFrame
    shares: DataFrame


def _running_start(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """Adds ``start``: the sum of ``value`` over all earlier rows of the group, bucket by bucket."""
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, bucket, F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(offsets, [*group, bucket]).withColumn("start", F.col("_offset") + F.col("_local")).drop("_offset", "_local")


def mix(
    docs: DataFrame, targets: DataFrame, *, record: str = "doc_id", source: str = "source", text: str = "text",
    vocabulary: str | None = None, total_tokens: int | str | None = None, block_tokens: int = 1024, seed: int = 7,
) -> Mixture:
    """Chooses pages so that each source has its share of the tokens.

    ``total_tokens``: size of the mixture. None: the largest size at which every source that has pages can
    reach its share within its repetitions. "corpus": the tokens of all pages; sources too small for
    that give all they may and the shares that are really reached are reported.

    ``blocks``: slot, source, record, repetition (from 1), first_token, n_tokens (of the page in that slot). ``schedule``: slot (the
    first that the page is in), source, record, repetition, n_tokens. ``shares``: source, target_share,
    max_repeats, available_tokens, chosen_tokens, actual_share, most_repeats, target_met (within two blocks of
    the target). Pages without a source, of a source that isn't in ``targets``, and pages without tokens aren't
    chosen; a source without pages is reported with nothing. Ties in the shuffle go by record. Of repeated records one
    is taken. Empty tables give an empty schedule. Further columns are ignored.
    """
    spark = docs.sparkSession
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] if r["max_repeats"] is not None else 1)) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").limit(MAX_SOURCES + 1).collect()}
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    pages = docs.select(F.col(record).alias("rid"), F.col(source).alias("source"), F.col(text).alias("text"))
    names = spark.createDataFrame([(x,) for x in wanted], "source string")  # at most MAX_SOURCES rows
    pages = pages.where("rid is not null").join(F.broadcast(names), "source", "left_semi")
    sized = cut(with_token_counts(pages, ["rid", "source"], "text", vocabulary or tokenizer_path()).where("n_tokens > 0").dropDuplicates(["rid"]))
    have = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    able = {s: have[s][0] * reps for s, (share, reps) in wanted.items() if s in have and share > 0 and reps > 0}
    corpus = sum(t for t, _ in have.values())
    if total_tokens is None:
        total = min((able[s] / wanted[s][0] for s in able), default=0)
    else:
        total = corpus if total_tokens == "corpus" else int(total_tokens)
    weight = sum(share for share, _ in wanted.values() if share > 0) or 1.0
    n_slots = max(1, round(total / block_tokens)) if able else 0

    # slots: the golden-ratio point of a slot picks its source, its rank among the slots of the source is k
    cells, upto = [], 0.0
    for s, (share, _) in sorted(wanted.items()):
        if share > 0:
            low, upto = upto, upto + share / weight
            cells += [(c, low, upto, s) for c in range(int(low * CELLS), min(CELLS - 1, int(upto * CELLS)) + 1)]
    if cells:  # rounding mustn't leave a gap at the end
        cells[-1] = (*cells[-1][:2], 2.0, cells[-1][3])
    pieces = F.broadcast(spark.createDataFrame(cells, "cell int, low double, high double, source string"))  # at most MAX_SOURCES + CELLS rows
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"pmod((id + 0.5D) * {GOLDEN!r}D, 1.0D)").alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    slots = slots.join(pieces, "cell").where("low <= point and point < high").select("slot", "source", F.expr("slot div 65536").alias("bucket"), F.lit(1).alias("one"))
    slots = _running_start(slots, ["source"], "bucket", ["slot"], "one").select("slot", "source", F.col("start").alias("k"))
    given = {r["source"]: r["count"] for r in slots.groupBy("source").count().collect()}

    # pages: as many shuffled repetitions as the slots of the source ask for and its limit allows
    rows = [(s, min(wanted[s][1], math.ceil(given[s] * block_tokens / have[s][0])), given[s], have[s][0]) for s in able if given.get(s)]
    plan = F.broadcast(spark.createDataFrame(rows, "source string, reps int, slots long, tokens long"))  # at most MAX_SOURCES rows
    n_docs = sum(n for _, n in have.values())
    bits = min(24, max(6, math.ceil(math.log2(max(1, n_docs / 50_000)))))
    laid = sized.join(plan, "source").withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("reps"))))
    laid = laid.withColumn("h", F.xxhash64("rid", "repetition", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits)).withColumn("o", F.col("h").bitwiseXOR(F.lit(-(2**63))))
    laid = _running_start(laid, ["source", "repetition"], "bucket", ["o", "rid"], "n_tokens")
    start = F.col("start") + (F.col("repetition") - 1) * F.col("tokens")
    laid = laid.withColumn("start", start)
    last = F.least(F.floor((F.col("start") + F.col("n_tokens") - 1) / block_tokens), F.col("slots") - 1)
    laid = laid.withColumns({"first": F.floor(F.col("start") / block_tokens), "last": last}).where("first <= last").withColumn("k", F.explode(F.sequence("first", "last")))
    begin = F.greatest("start", F.col("k") * block_tokens)
    cut_up = laid.select("source", "k", F.col("rid").alias(record), "repetition", (begin - F.col("start")).alias("first_token"), (F.least(F.col("start") + F.col("n_tokens"), (F.col("k") + 1) * block_tokens) - begin).alias("n_tokens"))
    chosen = cut(cut_up.join(slots, ["source", "k"]).select("slot", "source", record, "repetition", "first_token", "n_tokens"))

    got = {r["source"]: (r["t"], r["m"]) for r in chosen.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("repetition").alias("m")).collect()}
    all_chosen = sum(t for t, _ in got.values())
    report = []
    for s, (share, reps) in sorted(wanted.items()):
        t, most = got.get(s, (0, 0))
        tokens = have.get(s, (0, 0))[0]
        met = abs(t - share / weight * total) <= 2 * block_tokens if total else share == 0
        report.append((s, share, reps, tokens, t, round(t / all_chosen, 6) if all_chosen else 0.0, most, bool(met)))
    shares = spark.createDataFrame(report, "source string, target_share double, max_repeats int, available_tokens long, chosen_tokens long, actual_share double, most_repeats int, target_met boolean")
    schedule = chosen.groupBy("source", record, "repetition").agg(F.min("slot").alias("slot"), F.sum("n_tokens").alias("n_tokens"))
    return Mixture(schedule.select("slot", "source", record, "repetition", "n_tokens"), chosen, shares)
