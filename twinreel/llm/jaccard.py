"""The exact check after the SimHash search: which candidates have a Jaccard coefficient of shingle sets of at least a threshold.

Candidates that hang together are a family.  A family of at most BLOCK classes is compared all with all, over
lists of the classes that hold each shingle.  In a larger family every class is first compared with one leader; the classes
that link to it are connected already, so only the others are compared with the whole family, in pairs of blocks.
Links go out as spanning forests.

Defined results: null and wordless texts are one class; fewer words than a shingle make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinreel.llm.common import bounded_batches, drop_settled, settle
from twinreel.llm.simhash import Links, roots, shingle_hashes

#: Most classes of a block; small families are dealt into bins of about as many.
BLOCK = 1000
#: A table of classes is broadcast up to this many rows, else joined by shuffling.
BROADCAST_ROWS = 500_000
#: Copies of a large family's leader, so that its members do not meet in one task.
SALTS = 64


def linked(ids: np.ndarray, sets: list[np.ndarray], listed: np.ndarray, probes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the pairs of a probe and a listed row with a coefficient of `least` or more."""
    n = np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(len(sets)), n)
    name = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(owner) else np.empty(0, np.int64)
    kept = listed[owner]
    holders, names = owner[kept], name[kept]
    order = np.argsort(names, kind="stable")
    holders, at = holders[order], np.searchsorted(names[order], np.arange(len(owner) + 2))
    starts, links = np.concatenate(([0], np.cumsum(n))), Links()
    for i in np.flatnonzero(probes).tolist():
        mine = name[starts[i] : starts[i + 1]]
        both = np.zeros(len(sets), np.int64)
        for j in range(0, len(mine), 1 << 12):
            both += np.bincount(np.concatenate([holders[at[k] : at[k + 1]] for k in mine[j : j + (1 << 12)]]), minlength=len(sets))
        near = np.flatnonzero((both > 0) & (both >= least * (n + n[i] - both) - 1e-9))
        near = near[ids[near] != ids[i]]
        links.add(np.full(len(near), ids[i]), ids[near])
    return links.result()


def _sets(table: pa.Table, column: str = "shingles") -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in table.column(column)]


EDGES = "child long, parent long"


def _edges(found: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    return pa.table({"child": pa.array(found[0], pa.int64()), "parent": pa.array(found[1], pa.int64())})


def shingle_sets(keyed: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes) for the wanted(id, _want) classes, each from the text of the row with that _key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(t.as_py() or b"", words)).tobytes() for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], ["id", "shingles"])

    bounded_batches(keyed.sparkSession)
    small = wanted.count() <= BROADCAST_ROWS
    texts = keyed.join(F.broadcast(wanted) if small else wanted, F.col("_key") == F.col("_want")).select("id", "text")
    return texts.mapInArrow(run, "id long, shingles binary").groupBy("id").agg(F.first("shingles").alias("shingles"))


def components(keyed: DataFrame, printed: DataFrame, edges: DataFrame, words: int, least: float) -> DataFrame:
    """(id, root) for the classes that are not the smallest of their component.

    keyed(_key, text): the rows; printed(_key, id): their classes; edges(child, parent): candidate links of classes.
    """
    found = roots(edges)
    family = found.select("id", F.col("root").alias("family")).unionByName(found.select(F.col("root").alias("id"), F.col("root").alias("family")).distinct())
    family = settle(family.join(family.groupBy("family").agg(F.count("*").alias("c")), "family"), "families")
    rows = family.count()
    wanted = printed.join(F.broadcast(family.select("id")) if rows <= BROADCAST_ROWS else family.select("id"), "id", "left_semi").groupBy("id").agg(F.min("_key").alias("_want"))
    sets = settle(family.join(shingle_sets(keyed, settle(wanted, "wanted"), words), "id"), "sets")

    def all_pairs(table: pa.Table) -> pa.Table:
        every = np.ones(table.num_rows, bool)
        return _edges(linked(table.column("id").to_numpy(), _sets(table), every, every, least))

    small = sets.where(F.col("c") <= BLOCK).withColumn("bin", F.pmod(F.xxhash64("family"), F.lit(max(1, -(-rows // BLOCK)))))
    out = small.select("bin", "id", "shingles").groupBy("bin").applyInArrow(all_pairs, EDGES)
    large = sets.where(F.col("c") > BLOCK)
    # the leader of a large family is its smallest class: there are at most rows / BLOCK of them
    lead = large.where(F.col("id") == F.col("family")).select(F.col("family").alias("_f"), F.col("shingles").alias("lead"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))

    def with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column("shingles"), b.column("lead")):
                one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                near.append(both > 0 and both >= least * (len(one) + len(two) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("family"), b.column("c"), b.column("shingles"), pa.array(near, pa.bool_())], ["id", "family", "c", "shingles", "near"])

    bounded_batches(keyed.sparkSession)
    led = salted.join(lead, (F.col("family") == F.col("_f")) & (F.col("salt") == F.col("_s"))).select("id", "family", "c", "shingles", "lead").mapInArrow(with_leader, "id long, family long, c long, shingles binary, near boolean")
    led = settle(led, "led")
    stars = led.where("near AND id <> family").select(F.col("id").alias("child"), F.col("family").alias("parent"))
    rest = led.where(~F.col("near"))
    left = rest.groupBy("family").agg(F.count("*").alias("r")).select(F.col("family").alias("_f"), F.ceil(F.col("r") / BLOCK).cast("int").alias("probes"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    dealt = led.join(left, F.col("family") == F.col("_f")).select("id", "family", "shingles", "near", "probes", blocks.alias("blocks"))
    listed = dealt.select("id", "family", "shingles", F.lit(True).alias("listed"), block(F.col("blocks")).alias("a"), F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("p"))
    probing = dealt.where(~F.col("near")).select("id", "family", "shingles", F.lit(False).alias("listed"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), block(F.col("probes")).alias("p"))

    def across(table: pa.Table) -> pa.Table:
        side = table.column("listed").to_numpy()
        return _edges(linked(table.column("id").to_numpy(), _sets(table), side, ~side, least))

    out = out.unionByName(stars).unionByName(listed.unionByName(probing).groupBy("family", "a", "p").applyInArrow(across, EDGES))
    done = roots(out)
    drop_settled(sets)
    return done
