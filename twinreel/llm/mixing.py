"""Mixing sources to target weights with a time-varying curriculum.

Each source has a total demand in words (its target) and a schedule: a piecewise
linear weight over training progress 0..1.  The integral of the schedule gives the
source's cumulative demand; inverting it at the offset where a document starts in
its source's (seeded, repeated) order gives the document's training position, and
documents are range-sorted by position.

Defined results: null texts have size 0, are kept and take 0 words; a null source
is a source of its own, last in order; repeated rows each take their own share;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twinreel.llm.common import packed, parts_for, settle

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source that one task numbers; a hot source is cut into as many hash ranges as it needs.
ROWS_PER_RANGE = 2000
#: Tables of sources up to this many rows are broadcast; larger ones are joined by shuffling narrow rows.
BROADCAST_ROWS = 20_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, max_repeats: float) -> list[float]:
    """Targets in proportion to weight, none above max_repeats x size; the excess goes to the others by weight."""
    targets, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(total)
    while open_:
        share = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / share > max_repeats * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / share
            break
        for i in over:
            targets[i] = max_repeats * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def schedule_table(knots: Sequence[tuple[float, float]]) -> tuple[list[float], list[float], list[float]]:
    """(times, weights, cumulative share of the integral at each time) of a piecewise linear schedule over 0..1."""
    times, weights = [float(t) for t, _ in knots], [float(w) for _, w in knots]
    if times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:])) or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("a schedule runs from time 0 to 1 with rising times and weights that are not negative")
    cum = [0.0]
    for i in range(len(times) - 1):
        cum.append(cum[-1] + (times[i + 1] - times[i]) * (weights[i] + weights[i + 1]) / 2)
    return times, weights, [c / cum[-1] for c in cum]


def _invert(u: Column) -> Column:
    """Time at which the cumulative share reaches u: find the segment, then solve its quadratic."""
    seg = F.least(F.size(F.filter("_cum", lambda c: c <= u)), F.size("_cum") - 1)
    t0, t1 = F.element_at("_times", seg), F.element_at("_times", seg + 1)
    w0, w1 = F.element_at("_ws", seg), F.element_at("_ws", seg + 1)
    area = (u - F.element_at("_cum", seg)) * F.col("_mass")
    slope = (w1 - w0) / (t1 - t0)
    # area = w0*d + slope*d^2/2, in the form that stays exact as slope -> 0
    root = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * area, F.lit(0.0)))
    return F.least(t0 + F.when(root > 0, 2 * area / root).otherwise(0.0), t1)


def row_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeats: float = 2.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = (((0, 1), (1, 1)),),
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, positions (one for each use), row_key.

    `weights` and `schedules` go round the sources in code-point order, null last.  All targets
    together are `share` x all words.  A source's words are laid out in seeded hash order, over and
    over; the mix takes the first `target` of them, so the last document used may be taken in part.
    The list of sources with its weights is the caller's own driver-side table; documents never are.
    """
    spark = docs.sparkSession
    narrow = settle(
        docs.select(
            "doc_id", "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            row_key(seed).alias("_h"),
        ),
        "mix",
    )
    stats = sorted(narrow.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["s"] for r in stats]
    targets = water_fill(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], share * sum(sizes), max_repeats)
    rows = []
    for i, r in enumerate(stats):
        times, ws, cum = schedule_table(schedules[i % len(schedules)])
        mass = sum((times[j + 1] - times[j]) * (ws[j] + ws[j + 1]) / 2 for j in range(len(times) - 1))
        rows.append((r["source"], i, sizes[i], float(targets[i]), int(targets[i] + 0.5), parts_for(r["n"], ROWS_PER_RANGE), times, ws, cum, mass))
    params = spark.createDataFrame(rows, "_source string, _s int, source_size long, target double, _demand long, _ranges long, _times array<double>, _ws array<double>, _cum array<double>, _mass double")
    placed = narrow.join(F.broadcast(params) if len(rows) <= BROADCAST_ROWS else params, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_range", F.shiftright(F.shiftrightunsigned("_h", 33) * F.col("_ranges"), 31))
    before = placed.groupBy("_s", "_range").agg(F.sum("size").alias("_sum")).select(
        F.col("_s").alias("_s2"), F.col("_range").alias("_range2"), (F.sum("_sum").over(Window.partitionBy("_s").orderBy("_range")) - F.col("_sum")).alias("_before")
    )
    inside = F.sum("size").over(Window.partitionBy("_s", "_range").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at = placed.withColumn("_inside", inside).join(before, (F.col("_s") == F.col("_s2")) & (F.col("_range") == F.col("_range2"))).withColumn("_start", F.col("_before") + F.col("_inside"))
    uses = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("_demand") - F.col("_start") - F.lit(k) * F.col("source_size"))) for k in range(-int(-max_repeats // 1))]
    starts = [F.when(u > 0, _invert((F.col("_start") + F.lit(k) * F.col("source_size")) / F.col("_demand"))) for k, u in enumerate(uses)]
    taken = uses[0]
    for u in uses[1:]:
        taken = taken + u
    return at.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.filter(F.array(*starts), lambda x: x.isNotNull()).alias("positions"), F.col("_h").alias("row_key"))


def by_position(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by the position of their first use; those not used come last."""
    return mixed.withColumn("position", F.try_element_at("positions", F.lit(1))).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, mixed: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed corpus: each document once for each use, its columns unchanged, range-sorted by position.

    A document taken in part is kept whole.  `seed` is that of the mix.  Rows equal in doc_id and text share the uses of
    the one that is used most.  The narrow table of uses grows with the documents, so it is never broadcast: the
    plan is the same at every size.
    """
    uses = mixed.groupBy("row_key").agg(F.max("positions").alias("positions")).where(F.size("positions") > 0)
    placed = packed(docs, key=row_key(seed), doc_id=F.col("doc_id")).join(uses.hint("merge"), F.col("key") == F.col("row_key")).select("row", "doc_id", F.explode("positions").alias("position"))
    return placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("row.*")


def schema() -> T.StructType:
    return T.StructType.fromDDL("doc_id long, source string, size long, source_size long, target double, taken long, positions array<double>, row_key long")
