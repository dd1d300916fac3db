"""URL filter: host/path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models (Witten-Bell interpolation from order 0 to
ORDER) are fitted on accepted and on rejected URLs.  A URL's score is the difference
of the two log-likelihoods divided by its length; the cut-off is calibrated on held
out examples.  Every different URL that a rule decides is an example, and the rule's
word is final for it.  Tasks count the grams of their URLs; what is sent to all tasks
is the counts of different grams, by 64-bit hashes.

Defined results: a null url, or one without "://", has an empty host and path and is
scored as it stands (null: as an empty string).  If either class has no example,
every URL without a rule is allowed.  Repeated rows are repeated; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinreel.llm.common import ascii_lower, bounded_batches, drop_settled, settle

ORDER = 5
#: Of the examples, one in so many (by hash) is held out to calibrate the cut-off.
HELD_OUT = 5
#: The cut-off is a multiple of this.
STEP = 2.0**-13
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict; of the rules that fit, the longest wins, then the first given."""
    rest = F.substring("url", F.locate("://", F.col("url")) + 3, F.length("url"))
    whole = F.when(F.contains("url", F.lit("://")), rest).otherwise("")
    host = F.regexp_extract(whole, r"^[^/?#]*", 0)
    after = F.substring(whole, F.length(host) + 1, F.length(whole))
    base = pages.select("page_id", "url", F.coalesce(ascii_lower(host), F.lit("")).alias("host"), F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit("")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        name, slash, tail = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return base.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


class Markov:
    """Variable-order character model with Witten-Bell smoothing."""

    def __init__(self, texts: Sequence[str], alphabet: int, order: int = ORDER):
        self.order, self.alphabet = order, alphabet
        counts: dict[str, Counter] = defaultdict(Counter)
        for t in texts:
            t = "\x02" * order + t + "\x03"
            for i in range(order, len(t)):
                for k in range(order + 1):
                    counts[t[i - k : i]][t[i]] += 1
        self.counts = {c: dict(n) for c, n in counts.items()}
        self.totals = {c: (sum(n.values()), len(n)) for c, n in self.counts.items()}

    def probability(self, context: str, char: str) -> float:
        p = 1.0 / self.alphabet
        for k in range(self.order + 1):
            c = context[self.order - k :]
            if c not in self.totals:
                break
            total, kinds = self.totals[c]
            p = (self.counts[c].get(char, 0) + kinds * p) / (total + kinds)
        return p


class Ratio:
    """Length-normalised log-likelihood difference of two models."""

    def __init__(self, accepted: Sequence[str], rejected: Sequence[str]):
        alphabet = len(set("".join(accepted)) | set("".join(rejected))) + 2
        self.good, self.bad = Markov(accepted, alphabet), Markov(rejected, alphabet)
        self.memo: dict[str, float] = {}

    def score(self, text: str) -> float:
        n, total, memo = ORDER, 0.0, self.memo
        text = "\x02" * n + text + "\x03"
        for i in range(n, len(text)):
            gram = text[i - n : i + 1]
            v = memo.get(gram)
            if v is None:
                if len(memo) > 500_000:
                    memo.clear()
                v = memo[gram] = math.log(self.good.probability(gram[:-1], gram[-1])) - math.log(self.bad.probability(gram[:-1], gram[-1]))
            total += v
        return total / (len(text) - n)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15 + codes.shape[1], np.uint64)
    for c in codes.T:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def windows(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the ORDER + 1 characters that end at each place of each text and at its end, places of each text)."""
    n = ORDER + 1
    flat = np.frombuffer("".join("\x02" * ORDER + t + "\x03" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    if not len(texts):
        return np.zeros((0, n), np.uint32), places
    inside = np.arange(int(places.sum())) + np.repeat(np.arange(len(texts)) * ORDER, places)
    return np.lib.stride_tricks.sliding_window_view(flat, n)[inside], places


class CountedRatio:
    """What Ratio gives, from the counts of the grams of ORDER + 1 characters in accepted and rejected URLs, by hash.

    Shorter grams are ends of those, so their counts follow.  Two grams of like hash would count as one: at 10,000,000 grams, by
    calculation, 3 in a million such models have any.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.start = 1.0 / (len(np.unique(codes[:, -1])) + 1)
        self.levels = []
        for k in range(ORDER + 1):
            grams, at, which = np.unique(_hashes(codes[:, ORDER - k :]), return_index=True, return_inverse=True)
            n = np.zeros((len(grams), 2))
            np.add.at(n, which, counts)
            contexts, of = np.unique(_hashes(codes[at, ORDER - k : ORDER]), return_inverse=True)
            total, kinds = np.zeros((len(contexts), 2)), np.zeros((len(contexts), 2))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            self.levels.append((grams, n.astype(np.float32) if n.max() < 1 << 24 else n, contexts, total, kinds.astype(np.float32)))

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """Log of the ratio of the two probabilities of each gram's last character after the others."""
        p = np.full((len(codes), 2), self.start)
        for k, (grams, n, contexts, total, kinds) in enumerate(self.levels):
            key = _hashes(codes[:, ORDER - k : ORDER])
            at = np.minimum(np.searchsorted(contexts, key), len(contexts) - 1)
            met = contexts[at] == key
            t, v = np.where(met[:, None], total[at], 0.0), np.where(met[:, None], kinds[at], 0.0)
            key = _hashes(codes[:, ORDER - k :])
            at = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
            c = np.where((grams[at] == key)[:, None], n[at], 0.0)
            p = np.where(t > 0, (c + v * p) / np.maximum(t + v, 1.0), p)
        return np.log(p[:, 0]) - np.log(p[:, 1])

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        codes, places = windows(texts)
        if not len(codes):
            return np.zeros(0)
        _, first, which = np.unique(_hashes(codes), return_index=True, return_inverse=True)
        return np.add.reduceat(self.grams(codes[first])[which], np.cumsum(places) - places) / places


def calibrate(good: Sequence[float], bad: Sequence[float]) -> float:
    """The cut-off (allow at or above it) with the best balanced accuracy; of equals, the nearest to zero."""
    marks = np.unique(np.concatenate([np.asarray(good, float), np.asarray(bad, float)]))
    cuts = np.append(0.0, (marks[1:] + marks[:-1]) / 2)
    above = len(good) - np.searchsorted(np.sort(good), cuts, "left")
    return _best(cuts, above / max(len(good), 1), np.searchsorted(np.sort(bad), cuts, "left") / max(len(bad), 1))


def _best(cuts: np.ndarray, good_kept: np.ndarray, bad_dropped: np.ndarray) -> float:
    return float(cuts[np.lexsort((np.abs(cuts), -np.round(good_kept + bad_dropped, 9)))[0]])


def cut_off(steps: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """`calibrate` from how many scores lie in each step (ascending): the cut-off is where a step begins."""
    at = np.append(steps, steps[-1:] + 1)
    before = [np.append(0, np.cumsum(n)) for n in (good, bad)]
    zero = [float(n[steps < 0].sum()) for n in (good, bad)]
    kept = [np.append(x, y) for x, y in zip(before, zero)]
    return _best(np.append(at * STEP, 0.0), 1 - kept[0] / max(good.sum(), 1), kept[1] / max(bad.sum(), 1))


def plain(url: Column) -> Column:
    """What the models read: the URL without its scheme, A-Z lower-cased."""
    return ascii_lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^/?#]*?://", ""))


def examples(decided: DataFrame) -> DataFrame:
    """(u, good, held): every different URL that a rule decides, and whether it is held out."""
    u = decided.where(F.col("rule_verdict").isNotNull()).select(plain(F.col("url")).alias("u"), (F.col("rule_verdict") == "allow").alias("good")).distinct()
    return u.select("u", "good", (F.pmod(F.xxhash64("u"), F.lit(HELD_OUT)) == 0).alias("held"))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    width = 4 * (ORDER + 1)

    def out() -> Iterator[pa.RecordBatch]:
        grams = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), *(pa.array([n[g] for g in grams], pa.int64()) for n in seen)], ["gram", "good", "bad"])
        seen[0].clear(), seen[1].clear()

    for b in batches:
        good, texts = np.array(b.column("good").to_pylist(), bool), b.column("u").to_pylist()
        for n, mine in zip(seen, (good, ~good)):
            codes, _ = windows([texts[i] for i in np.flatnonzero(mine).tolist()])
            cells, counts = np.unique(np.ascontiguousarray(codes).view(f"V{width}").ravel(), return_counts=True)
            for g, c in zip(cells.tolist(), counts.tolist()):
                n[g] += c
        if len(seen[0]) + len(seen[1]) > 1_000_000:
            yield from out()
    yield from out()


def fit(decided: DataFrame) -> tuple[CountedRatio | None, float]:
    """Models and cut-off from decided(url, rule_verdict): every different URL is counted or scored."""
    spark = decided.sparkSession
    found = settle(examples(decided), "urls")
    n = {(r["good"], r["held"]): r["n"] for r in found.groupBy("good", "held").agg(F.count("*").alias("n")).collect()}
    if not all(any(good == g for good, _ in n) for g in (True, False)):
        drop_settled(found)
        return None, 0.0
    # a class whose few URLs all fell to one side is both learnt and scored
    few = F.col("good").isin([g for g in (True, False) if len([1 for good, _ in n if good == g]) < 2])
    bounded_batches(spark, 10_000)
    counted = found.where(~F.col("held") | few).select("u", "good").mapInArrow(_count_grams, "gram binary, good long, bad long")
    table = counted.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()  # a row for each different gram
    codes = np.frombuffer(b"".join(table.column("gram").to_pylist()), np.uint32).reshape(-1, ORDER + 1)
    ratio = CountedRatio(codes, np.stack([table.column(c).to_numpy() for c in ("good", "bad")], 1).astype(float))
    model = spark.sparkContext.broadcast(ratio)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.floor(model.value.scores(b.column("u").to_pylist()) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("good"), pa.array(at)], ["good", "step"])

    held = found.where(F.col("held") | few).select("u", "good").mapInArrow(steps, "good boolean, step long")
    rows = held.groupBy("step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("step").toArrow()
    model.unpersist()
    drop_settled(found)
    return ratio, cut_off(*(rows.column(c).to_numpy() for c in ("step", "good", "bad")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score for every page."""
    spark = pages.sparkSession
    ruled = with_rules(pages, rules)
    ratio, cut = fit(ruled)
    model = spark.sparkContext.broadcast(ratio)
    named = ruled.withColumn("_plain", plain(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts = b.column("_plain").to_pylist()
            scores = m.scores(texts).tolist() if m else [None] * len(texts)
            verdicts = [v or ("allow" if s is None or s >= cut else "block") for v, s in zip(b.column("rule_verdict").to_pylist(), scores)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["page_id", "url", "host", "path", "rule", "verdict", "score"])

    bounded_batches(spark, 10_000)
    kinds = dict(pages.select("page_id").dtypes)
    return named.mapInArrow(run, f"page_id {kinds['page_id']}, url string, host string, path string, rule string, verdict string, score double")
