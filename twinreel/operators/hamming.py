"""Hamming similarity self-join of samples: direct, or over blocks of the hash.

The block route is exhaustive: by the pigeonhole principle a pair within the tolerance
has a block within that block's radius.  One side is dealt to its own block values,
the other to every value within the radius, so the join is an equi-join.  A pair
counts only in the first block in which it qualifies, so no `distinct` follows.
Equal hashes are joined once and expanded afterwards.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinreel.constants import PAIR_WORK, best_blocks, block_plan, block_work, masks, work_per_hash
from twinreel.functions.hashing import block, hamming
from twinreel.plans.storage import settle

#: Distinct hashes that are broadcast at most, whatever route is asked for (8 bytes each).
BROADCAST_HASHES = 1_000_000
#: Candidates that a task of the block route meets, about.
TASK_CANDIDATES = 20_000_000


def distinct_pairs_direct(hashes: DataFrame, tolerance: int, rows: int = 0) -> DataFrame:
    """(x, y, dist) with x <= y over distinct hashes (about `rows` of them), by comparing every pair; for sets known to be small."""
    x, y = hashes.select(F.col("hash").alias("x")).repartition(_tasks(hashes, rows * rows * PAIR_WORK / TASK_CANDIDATES)), hashes.select(F.col("hash").alias("y"))
    return x.join(F.broadcast(y), (F.col("x") <= F.col("y")) & (hamming(F.col("x"), F.col("y")) <= tolerance)).withColumn("dist", hamming(F.col("x"), F.col("y")))


def _key(k: int, value: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), value.alias("v"))


def _probes(k: int, shift: int, bits: int, radius: int) -> Column:
    """Keys of every value of block k within the radius of y's."""
    at = F.array(*[F.lit(m).cast("long") for m in masks(bits, radius)])
    return F.transform(at, lambda m: _key(k, block(F.col("y"), shift, bits).bitwiseXOR(m)))


def _tasks(hashes: DataFrame, least: float = 0) -> int:
    """Partitions for work that its few bytes do not show, so that they are not merged into one."""
    return max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(least))


def distinct_pairs_indexed(hashes: DataFrame, tolerance: int, blocks: int, rows: int = 0) -> DataFrame:
    """(x, y, dist) with x <= y over distinct hashes (about `rows` of them), over blocks."""
    tasks = _tasks(hashes, rows * block_work(tolerance, blocks, rows)[1] / TASK_CANDIDATES)
    plan = [(k, *p) for k, p in enumerate(block_plan(tolerance, blocks)) if p[2] >= 0]
    home = F.array(*[_key(k, block(F.col("x"), shift, bits)) for k, shift, bits, _ in plan])
    probes = F.concat(*[_probes(*p) for p in plan])
    left = hashes.select(F.col("hash").alias("x")).select("x", F.explode(home).alias("key")).select("x", "key.k", "key.v").repartition(tasks, "k", "v")
    right = hashes.select(F.col("hash").alias("y")).select("y", F.explode(probes).alias("key")).select("y", "key.k", "key.v").repartition(tasks, "k", "v")
    dist = hamming(F.col("x"), F.col("y"))

    def earlier(k: int) -> Column:
        within = [hamming(block(F.col("x"), s, b), block(F.col("y"), s, b)) <= r for j, s, b, r in plan if j < k]
        return reduce(lambda p, q: p | q, within, F.lit(False))

    first = reduce(lambda acc, p: F.when(F.col("k") == p[0], ~earlier(p[0])).otherwise(acc), plan, F.lit(False))
    return left.join(right, ["k", "v"]).where((F.col("x") <= F.col("y")) & (dist <= tolerance) & first).select("x", "y", dist.alias("dist"))


def index_is_cheaper(rows: int, tolerance: int) -> bool:
    """Does dealing keys cost less, by estimate, than comparing all of `rows` hashes?"""
    return work_per_hash(tolerance, best_blocks(tolerance, rows), rows) < PAIR_WORK * rows


def distinct_pairs(hashes: DataFrame, tolerance: int, route: str = "auto") -> DataFrame:
    """(x, y, dist) with x <= y, by the cheaper route; `hashes` has the distinct hashes."""
    rows = hashes.count()
    if rows <= BROADCAST_HASHES and (route == "direct" or route == "auto" and not index_is_cheaper(rows, tolerance)):
        return distinct_pairs_direct(hashes, tolerance, rows)
    return distinct_pairs_indexed(hashes, tolerance, best_blocks(tolerance, rows), rows)


def even_tolerance(hashes: DataFrame, tolerance: int) -> int:
    """If every hash has equally many bits set, distances are even and an odd tolerance equals the even one below."""
    low, high = hashes.agg(F.min(F.bit_count("hash")), F.max(F.bit_count("hash"))).first()
    return tolerance - tolerance % 2 if low is not None and low == high else tolerance


def frame_matches(samples: DataFrame, tolerance: int, route: str = "auto") -> DataFrame:
    """(a, b, i, j, offset, dist): every pair of samples of two media, a < b, within the tolerance."""
    # read several times: the count, the bit counts and both sides of the join
    hashes = settle(samples.select("hash").distinct().repartition(_tasks(samples)), "hashes")
    pairs = settle(distinct_pairs(hashes, even_tolerance(hashes, tolerance), route), "pairs")
    both = pairs.unionByName(pairs.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "dist"))
    a = samples.select(F.col("media_id").alias("a"), F.col("idx").alias("i"), F.col("t_start").alias("ta"), F.col("hash").alias("x"))
    b = samples.select(F.col("media_id").alias("b"), F.col("idx").alias("j"), F.col("t_start").alias("tb"), F.col("hash").alias("y"))
    return a.join(both, "x").join(b, "y").where("a < b").select("a", "b", "i", "j", (F.col("tb") - F.col("ta")).alias("offset"), "dist")
