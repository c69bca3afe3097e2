"""Mixing sources to target weights by temperature.

A source's share of all tokens, raised to an exponent and normalised, is its weight. The exponent is the largest one from 0 to
1 whose weights reach the target entropy, and not so small that a source would be repeated more than `repeats` times.
Entropy and repetition both fall as the exponent grows, so each is found by bisection (five halvings a pass: one
aggregation over the sources tries 31 exponents). Only these sums reach the driver.

A source gets budget x weight tokens: whole epochs, then part of one. In each epoch the documents stand in blocks of about
`block` rows, the blocks in an order of their own for the epoch, the documents of a block likewise. Token positions come
from a prefix sum over blocks plus one within the block, so a source with a third of all rows is spread over many tasks.
A document is taken if it ends within what its source gets.

A token is a run of characters other than white space.

Cases: a null source is a source of its own. A null or empty text has no tokens; a source without tokens gets one epoch and
weight 0. Equal rows (doc_id, text and source) are taken together. Very long texts count whole; one that exceeds what
is left of its source's part epoch is left out of that epoch. Other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import join_hot, nest, unnest
from lodestar.session import cut

WORDS = r"\S+"


def row_key() -> Column:
    return F.xxhash64("doc_id", "text", "source")


def _bisect(shares: DataFrame, value: Column, enough, passes: int = 8) -> float:
    """The largest exponent in [0, 1] at which enough(value) holds, if it holds at 0 and stops holding once; else 0 or 1."""
    low, high = 0.0, 1.0
    for _ in range(passes):
        grid = [low + (high - low) * i / 32 for i in range(33)]
        at = shares.crossJoin(F.broadcast(shares.sparkSession.range(33).select(F.col("id"), F.element_at(F.array(*map(F.lit, grid)), (F.col("id") + 1).cast("int")).alias("a"))))
        found = {r[0]: r[1] for r in at.groupBy("id").agg(value.alias("v")).collect()}
        if enough(found[32]):
            return high
        held = [i for i in range(32) if enough(found[i])]
        if not held:
            return low
        low, high = grid[max(held)], grid[max(held) + 1]
    return low


def mixture(items: DataFrame, entropy: float, repeats: float, budget: int | None) -> DataFrame:
    """(src, rows, tokens, weight, quota) for each source of `items` (src, n_tokens)."""
    sums = cut(items.groupBy("src").agg(F.count("*").alias("rows"), F.sum("n_tokens").cast("double").alias("tokens")), "mix-sources")
    total, sources = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0.0)), F.count_if(F.col("tokens") > 0)).first()
    budget = total if budget is None else float(budget)
    shares = sums.where("tokens > 0").select("src", (F.col("tokens") / F.lit(max(total, 1.0))).alias("s"))
    alpha = 1.0
    if sources > 1:
        spread = F.expr("ln(sum(pow(s, a))) - first(a) * sum(pow(s, a) * ln(s)) / sum(pow(s, a))")
        alpha = _bisect(shares, spread, lambda h: h >= entropy * math.log(sources))
        if budget <= repeats * total:
            most = F.expr("max(pow(s, a - 1)) / sum(pow(s, a))")
            over = _bisect(shares, most, lambda m: m * budget / total > repeats)
            alpha = max(alpha, over)
    weights = shares.select("src", F.pow("s", F.lit(alpha)).alias("p"))
    norm = weights.agg(F.sum("p")).first()[0] or 1.0
    weights = weights.select("src", (F.col("p") / F.lit(norm)).alias("weight"))
    joined = sums.join(weights, "src", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return cut(joined.withColumn("quota", F.when(F.col("tokens") > 0, F.floor(F.col("weight") * F.lit(budget) + 1e-6)).otherwise(0.0).cast("double")), "mix-weights")


def select_rows(docs: DataFrame, entropy: float = 0.95, repeats: float = 2.0, budget: int | None = None, block: int = 4096, seed: int = 29) -> DataFrame:
    """(key, doc_id, source, copies, n_tokens, epoch, block, token_start, weight) of what is taken, in every epoch.

    `copies` rows of `docs` share a key; n_tokens counts them all. budget None: as many tokens as there are.
    """
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), src.alias("src"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long").alias("n"))
    items = rows.groupBy("key", "doc_id", "source", "src").agg(F.count("*").alias("copies"), F.sum("n").alias("n_tokens"))
    items = cut(items, "mix-items")
    plan = mixture(items, entropy, repeats, budget)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("int")
    plan = plan.withColumns({"whole": whole, "blocks": F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(block))).cast("long")})
    plan = plan.select("src", "tokens", "weight", "quota", "whole", "blocks")
    dealt = join_hot(items, plan, ["src"]).withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")))
    epochs = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    inside = Window.partitionBy("src", "epoch", "block").orderBy(F.xxhash64("key", "epoch", F.lit(seed + 1)), "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = epochs.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    sums = dealt.groupBy("src", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("whole").alias("whole"))
    sums = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole")))).drop("whole")
    across = Window.partitionBy("src", "epoch").orderBy(F.xxhash64("src", "epoch", "block", F.lit(seed + 2)), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "epoch", "block", F.coalesce(F.sum("block_tokens").over(across), F.lit(0)).alias("block_start"))
    found = placed.join(starts, ["src", "epoch", "block"]).withColumn("token_start", F.col("before") + F.col("block_start"))
    left = F.col("quota") - F.col("whole") * F.col("tokens")
    taken = (F.col("epoch") < F.col("whole")) | ((F.col("tokens") > 0) & (F.col("token_start") + F.col("n_tokens") <= left))
    return found.where(taken).select("key", "doc_id", "source", "copies", "n_tokens", "epoch", "block", "token_start", "weight")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the mixture takes, as often as it takes them."""
    own = ("doc_id", "text", "source")
    times = cut(select_rows(docs.select(*own), **options).groupBy("key").agg(F.count("*").cast("int").alias("times")), "mix-taken")
    again = nest(docs, *own).withColumn("key", row_key()).join(times, "key").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return unnest(again, docs, *own)
