"""Sharding by histogram sort: exact byte counts below probe keys, refined until the splitters are good enough.

The sort key is one long: the upper 40 bits of the text's hash, then 24 bits of the
document's.  Equal texts are next to each other, and a text that is a large part of
the corpus is still spread over 2^24 keys.  Every round counts the exact bytes
between probes across all partitions (a few hundred sums, combined before the
shuffle); the intervals that hold a splitter shrink by the number of probes.  Then
rows move once, by (shard, slice).

Law `bytes`: shards are contiguous key ranges of nearly equal bytes.  Null texts
have no bytes and count 1; repeated rows are kept, each in a slot of its own;
an empty table gives an empty result.  Native DataFrame code only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinreel.llm.common import parts_for, settle

LOW, HIGH = -(1 << 63), 1 << 63
#: Bytes that one exchange slice of a shard holds.
SLICE_BYTES = 8 << 20


def sort_key(text: Column, doc_id: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(~0xFFFFFF)).bitwiseOR(F.xxhash64(F.lit(7), doc_id).bitwiseAND(F.lit(0xFFFFFF)))


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _interval(key: Column, probes: list[int]) -> Column:
    """Number of probes at or below the key, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(probes[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(probes))


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.002, probes_each: int = 32) -> list[int]:
    """Keys that cut the rows of keys(_key, _size) into `shards` ranges, each within `tolerance` of a shard's bytes
    of its place, or as near as rows with equal keys allow."""
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    goals = [total * k // shards for k in range(1, shards)]
    # for each splitter: an interval [lo, hi) with exact bytes below lo and below hi
    state = [(LOW, 0, HIGH, total)] * len(goals)
    while True:
        probes = set()
        for goal, (lo, below_lo, hi, below_hi) in zip(goals, state):
            if min(goal - below_lo, below_hi - goal) > tolerance * total / shards and hi - lo > 1:
                step = max(1, (hi - lo) // probes_each)
                probes.update(range(lo + step, hi, step))
        if not probes:
            break
        at = sorted(probes)
        counted = dict(keys.groupBy(_interval(F.col("_key"), at).alias("i")).agg(F.sum("_size")).collect())
        below, known = 0, {}
        for i, p in enumerate(at):
            below += counted.get(i, 0)
            known[p] = below
        new = []
        for goal, (lo, below_lo, hi, below_hi) in zip(goals, state):
            for p in at:
                if lo < p < hi:
                    if known[p] <= goal and p > lo:
                        lo, below_lo = p, known[p]
                    elif known[p] > goal:
                        hi, below_hi = p, known[p]
                        break
            new.append((lo, below_lo, hi, below_hi))
        state = new
    best = [lo if goal - below_lo <= below_hi - goal else hi for goal, (lo, below_lo, hi, below_hi) in zip(goals, state)]
    return [min(b, HIGH - 1) for b in best]


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """doc_id, text, size, law, shard, slot: every row in a shard, slots gapless from 0 in each shard."""
    base = docs.select("doc_id", "text", byte_size(F.col("text")).alias("_size"), sort_key(F.col("text"), F.col("doc_id")).alias("_key"))
    keys = settle(base.select("_key", "_size"), "keys")
    cuts = splitters(keys, shards, tolerance)
    total = keys.agg(F.sum("_size")).first()[0] or 0
    slices = parts_for(total // max(1, shards), SLICE_BYTES, 32)
    place = lambda df: df.withColumn("_shard", _interval(F.col("_key"), cuts)).withColumn("_slice", F.pmod(F.xxhash64(F.lit(3), "_key"), F.lit(slices)).cast("int"))
    counts = place(keys).groupBy("_shard", "_slice").count()
    first = counts.select(
        F.col("_shard").alias("_shard2"), F.col("_slice").alias("_slice2"),
        (F.sum("count").over(Window.partitionBy("_shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_first"),
    )
    # shards x slices rows: a few thousand, as the slice size bounds them
    numbered = place(base).withColumn("_row", F.row_number().over(Window.partitionBy("_shard", "_slice").orderBy("_key", "doc_id")))
    out = numbered.join(F.broadcast(first) if shards * slices <= 100_000 else first, (F.col("_shard") == F.col("_shard2")) & (F.col("_slice") == F.col("_slice2")))
    return out.select("doc_id", "text", F.col("_size").alias("size"), F.lit("bytes").alias("law"), F.col("_shard").cast("int").alias("shard"), (F.col("_first") + F.col("_row") - 1).cast("long").alias("slot"))
