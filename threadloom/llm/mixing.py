"""Mixing sources to target weights by Sainte-Lague apportionment.

A document's tokens are its runs of non-blank characters.  The documents of a source are spread over
shards of about `SHARD_BLOCKS` blocks (as many as its tokens need, so that a shard's order is a task's
work at any size) and, in a seeded order, cut into blocks of `BLOCK` tokens.  A document belongs to the
block in which it begins, and one that runs over further blocks makes its block count as so many.  Blocks
are then handed out like seats: the next goes to the source with the highest quotient weight / (2 *
seats + 1) that still has blocks (of equal quotients the least source, nulls last), until `FRACTION` of
all blocks are allocated.  Each source's quota goes to its shards the same way, weighted by their blocks,
and a shard takes blocks in a seeded order until its quota is reached; the last may exceed it if it
counts as several.

Weights default to round(tokens ** ALPHA), which lifts small sources over large ones.  Only one row a
source and shard comes to the driver: one for about 34 million tokens.

Defined results: rows with one doc_id and source are one document and stay or go together; a null
source is a source of its own; a null text has no tokens and belongs to the block it falls in; a
source without weight gets none; an empty table gives an empty result; extra columns are carried.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import cut, pick, small_or_hashed

BLOCK, SHARD_BLOCKS, ALPHA, FRACTION, SEED = 4096, 8192, 0.7, 0.8, "mix-1"


def apportion(seats: int, weights: dict, caps: dict) -> dict:
    """Seats by highest quotients, never above a party's cap; keys in rising order break ties.

    A divisor search gives every party the seats whose quotients lie above a bound, and a heap hands
    out the rest one by one, so that the work doesn't grow with the number of seats.
    """
    party = [k for k in caps if weights.get(k, 0) > 0 and caps[k] > 0]
    seats = min(seats, sum(caps[k] for k in party))

    def above(bound: float) -> dict:
        # seats whose quotient w / (2k + 1) exceeds the bound
        return {k: min(caps[k], max(0, int((weights[k] / bound + 1) / 2 - 1e-9))) for k in party}

    lo, hi = 0.0, max([weights[k] for k in party], default=1.0) * 2.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid <= 0 or sum(above(mid).values()) > seats:
            lo = mid
        else:
            hi = mid
    got = above(hi)
    # the last seats before the bound are handed out again, so that rounding of the bound can't matter
    got = {k: max(0, v - 2) for k, v in got.items()}
    rank = {k: i for i, k in enumerate(sorted(party, key=lambda k: (k is None, k)))}
    heap = [(-weights[k] / (2 * got[k] + 1), rank[k], k) for k in party if got[k] < caps[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got.values())):
        _, _, k = heapq.heappop(heap)
        got[k] += 1
        if got[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), rank[k], k))
    return {k: got.get(k, 0) for k in caps}


def quotas(blocks: list[tuple], weights: dict | None = None, alpha: float = ALPHA, fraction: float = FRACTION) -> dict:
    """{(source, shard): blocks to take} from rows (source, shard, blocks, tokens)."""
    have: dict = {}
    tokens: dict = {}
    shards: dict = {}
    for source, shard, n, t in blocks:
        have[source] = have.get(source, 0) + n
        tokens[source] = tokens.get(source, 0) + t
        shards.setdefault(source, {})[shard] = n
    if weights is None:
        weights = {s: round(t**alpha) for s, t in tokens.items()}
    by_source = apportion(int(fraction * sum(have.values())), weights, have)
    return {(s, k): n for s, total in by_source.items() for k, n in apportion(total, shards[s], shards[s]).items()}


def blocked(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, shard, block, tokens): one row a document."""
    count = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(r"[^ \t\n\r\f]+")))
    units = pick(docs, "doc_id", "source", "text").select("doc_id", "source", count.cast("long").alias("tokens"))
    units = cut(units.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens")))
    sizes = cut(units.groupBy("source").agg((F.floor(F.sum("tokens") / (block * shard_blocks)) + 1).alias("shards")).withColumnRenamed("source", "of"))
    sizes = small_or_hashed(sizes, 64)
    units = units.join(sizes, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    units = units.withColumn("key", key).withColumn("shard", F.conv(F.substring("key", 1, 15), 16, 10).cast("long") % F.col("shards"))
    before = Window.partitionBy("source", "shard").orderBy("key", F.asc_nulls_last("doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    return units.select("doc_id", "source", "shard", F.floor(at / block).cast("long").alias("block"), "tokens")


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, fraction: float = FRACTION, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, shard, block, tokens) of the documents that stay."""
    units = cut(blocked(docs, block, shard_blocks, seed))
    # a block counts as many as there are up to the next in which a document begins
    shard = Window.partitionBy("source", "shard")
    whole = F.ceil(F.sum("tokens").over(shard) / block)
    have = units.groupBy("source", "shard", "block").agg(F.sum("tokens").alias("tokens"))
    have = cut(have.withColumn("seats", F.greatest(F.lit(1), F.coalesce(F.lead("block").over(shard.orderBy("block")), whole) - F.col("block")).cast("long")))
    size = have.groupBy("source", "shard").agg(F.sum("seats").alias("n"), F.sum("tokens").alias("t")).collect()
    quota = quotas([tuple(r) for r in size], weights, alpha, fraction)
    spark = docs.sparkSession
    source = units.schema["source"].dataType.simpleString()
    allowed = spark.createDataFrame([(s, k, n) for (s, k), n in quota.items() if n], f"source {source}, shard long, quota long")
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("source").cast("string"), F.lit("")), "shard", "block"))
    order = Window.partitionBy("source", "shard").orderBy("draw", "block")
    before = F.coalesce(F.sum("seats").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = have.withColumn("draw", draw).withColumn("before", before)

    def same(a: DataFrame, b: DataFrame, *names: str) -> list:
        return [a[n].eqNullSafe(b[n]) for n in names]

    taken = ranked.join(allowed, same(ranked, allowed, "source", "shard")).filter("before < quota").select(ranked["source"], ranked["shard"], "block")
    return units.join(taken, same(units, taken, "source", "shard", "block"), "left_semi")


def take(docs: DataFrame, **settings) -> DataFrame:
    """`docs` without the documents that the mixture leaves out."""
    stay = mix(docs, **settings).select(F.col("doc_id").alias("stay_id"), F.col("source").alias("stay_source"))
    names = [f"_{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names)
    key, source = (names[docs.columns.index(n)] for n in ("doc_id", "source"))
    stay = stay.hint("shuffle_hash")  # ids only: the side to build; texts are streamed, not sorted
    return out.join(stay, out[key].eqNullSafe(stay["stay_id"]) & out[source].eqNullSafe(stay["stay_source"]), "left_semi").toDF(*docs.columns)
