"""SimHash near-duplicates by vantage-point trees.

A fingerprint has a bit set where more than half of the document's shingle hashes
have it.  Equal fingerprints are one row.  A shallow vantage-point tree, grown on a
bounded sample, deals the fingerprints into shards by their Hamming distance to
vantage points; a fingerprint is at home in one shard and also visits the shards
that its ball of `radius` reaches over a boundary (by the triangle inequality; of a
pair on both sides only the inner one visits).  In each shard a deeper tree is
pruned in the same way, leaves are compared exactly, and the links found go out as a
spanning forest: every link's ends stay connected, but a large group of near copies
never becomes all its pairs.  Components are joined up by distributed parent
pointers.

Defined results: null and wordless texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; repeated rows have equal
results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinreel.llm.common import bounded_batches, drop_settled, settle

SEED = 42
#: The tree's top is grown on this many distinct fingerprints; all are dealt by it.
SAMPLE = 20_000
SHARD, MAX_SHARD, SHARDS = 2_000, 1_000_000, 32
LEAF = 256
SALTS = 16
#: Extra words for longer fingerprints: each shingle hash is mixed with these fixed values (first digits of pi in hex).
MIX = [0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0]

#: Fingerprints of shingle sets: TABLES codes of CODE_BITS bits, searched within CODE_RADIUS; candidates differ in at most CHECK_BITS of CHECK_WORDS words.
TABLES, CODE_BITS, CODE_RADIUS, CHECK_WORDS, CHECK_BITS = 32, 20, 1, 4, 73
SET_WORDS = TABLES * CODE_BITS // 64
SET_KEYS = np.random.default_rng(31).integers(1, 1 << 63, SET_WORDS, dtype=np.uint64).tolist()


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(ws) <= words:
        return np.array([h(b" ".join(ws), SEED)], np.uint64)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts[: len(ws) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64, len(ws) - words + 1)


def _majority(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        block = hashes[i : i + (1 << 15)].astype(">u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _mixed(h: np.ndarray, key: int) -> np.ndarray:
    x = h ^ np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 4, extra: int = 0) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), n (shingles), x0.. (`extra` more words of a longer fingerprint)."""
    bounded_batches(docs.sparkSession)
    names = ["fp", *(f"x{i}" for i in range(extra))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, n = np.zeros((b.num_rows, 1 + extra), np.uint64), np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column("text").cast(pa.binary())):
                hashes = shingle_hashes(t.as_py() or b"", words)
                if n_ := len(hashes):
                    n[i] = n_
                    rows[i] = [_majority(hashes), *(_majority(_mixed(hashes, k)) for k in MIX[:extra])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(rows[:, j].copy().view(np.int64)) for j in range(1 + extra)), pa.array(n)], ["doc_id", *names, "n"])

    kinds = dict(docs.select("doc_id").dtypes)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, {', '.join(f'{x} long' for x in names)}, n long")


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node that is not its component's smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


class Links:
    """Links found so far, kept as a forest whenever they grow large."""

    def __init__(self, most: int = 1 << 20):
        self.a, self.b, self.n, self.most = [], [], 0, most

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)
            if self.n > self.most:
                self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.n = [a], [b], len(a)
        self.most = max(self.most, 2 * self.n)
        return a, b


def join_shard(ids: np.ndarray, fps: np.ndarray, home: np.ndarray, radius: int, sure, hot=None) -> tuple[np.ndarray, np.ndarray]:
    """Forest of all links within `radius` between a home row and any other row.

    sure(i, j): keeps which candidate pairs.  hot(home, visitors, links): compares a large leaf in place of comparing all.
    """
    links, stack = Links(), [(np.flatnonzero(home), np.flatnonzero(~home))]
    rng = np.random.default_rng(7)
    while stack:
        h, v = stack.pop()
        split = None
        if len(h) > LEAF:
            for _ in range(4):
                vantage = fps[h[rng.integers(len(h))]]
                dh = np.bitwise_count(fps[h] ^ vantage).astype(np.int16)
                m = int(np.median(dh))
                inner = dh <= m
                if 0.1 < inner.mean() < 0.9:
                    split = inner
                    break
                alike = dh == 0
                if LEAF < alike.sum() < len(h):  # a value that very many rows have: a branch of its own, which its neighbours visit
                    dv = np.bitwise_count(fps[v] ^ vantage)
                    stack.append((h[alike], np.concatenate([v[dv <= radius], h[~alike & (dh <= radius)]])))
                    stack.append((h[~alike], v))
                    h = None
                    break
        if h is None:
            continue
        if split is None:
            both = np.concatenate([h, v])
            if hot is not None and len(h) > 4 * LEAF:
                hot(h, v, links)
                continue
            step = max(1, (1 << 21) // max(len(h), 1))
            for i in range(0, len(both), step):
                rows = both[i : i + step]
                p, q = np.nonzero(near(fps[rows][:, None], fps[h][None, :], radius))
                p, q = rows[p], h[q]
                keep = p != q
                p, q = p[keep], q[keep]
                if sure is not None and len(p):
                    keep = sure(p, q)
                    p, q = p[keep], q[keep]
                links.add(ids[p], ids[q])
            continue
        dv = np.bitwise_count(fps[v] ^ vantage).astype(np.int16)
        stack.append((h[split], v[dv <= m + radius]))
        stack.append((h[~split], np.concatenate([v[dv > m - radius], h[split & (dh > m - radius)]])))
    return links.result()


def grow(sample: np.ndarray, size: np.ndarray, rows: int, radius: int, width: float) -> list:
    """Tree top: nested [kind, value, bound, left, right], or a leaf number.  width: how far apart in size (log) partners are, 0 if any."""
    want = max(SHARD, min(MAX_SHARD, rows // SHARDS))
    rng, leaves = np.random.default_rng(11), 0

    def build(at: np.ndarray, depth: int):
        nonlocal leaves
        if len(at) / max(1, len(sample)) * rows > want and len(at) >= 16 and depth < 24:
            tries = []
            for _ in range(4):
                vantage = sample[at[rng.integers(len(at))]]
                d = np.bitwise_count(sample[at] ^ vantage)
                m = int(np.median(d))
                left = d <= m
                if 0.25 <= left.mean() <= 0.75:
                    tries.append(((left & (d > m - radius)).mean(), ["d", int(vantage), m], left))
            if width:
                t = float(np.median(size[at]))
                left = size[at] <= t
                if 0.25 <= left.mean() <= 0.75:
                    tries.append(((left & (size[at] > t - width)).mean(), ["n", 0, t], left))
            if tries:
                _, node, left = min(tries, key=lambda x: x[0])
                return [*node, build(at[left], depth + 1), build(at[~left], depth + 1)]
        leaves += 1
        return leaves - 1

    return build(np.arange(len(sample)), 0)


def deal(tree, fps: np.ndarray, size: np.ndarray, radius: int, width: float) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, rows, home) for the rows that are at home in, or visit, each shard."""
    stack = [(tree, np.arange(len(fps)), np.empty(0, np.int64))]
    while stack:
        node, h, v = stack.pop()
        if isinstance(node, int):
            yield node, h, True
            yield node, v, False
            continue
        kind, vantage, m, left, right = node
        if kind == "d":
            d = lambda at: np.bitwise_count(fps[at] ^ np.uint64(vantage)).astype(np.int64)
            reach = radius
        else:
            d = lambda at: size[at]
            reach = width
        dh, dv = d(h), d(v)
        stack.append((left, h[dh <= m], v[dv <= m + reach]))
        stack.append((right, h[dh > m], np.concatenate([v[dv > m - reach], h[(dh <= m) & (dh > m - reach)]])))


def links(classes: DataFrame, radius: int, extra: int = 0, most: int = 0, ratio: float = 0.0) -> DataFrame:
    """(child, parent): a forest of the links among classes(id, fp, n, x0..).

    Two classes link if their 64 bits differ in at most `radius` places and, where `extra` is given,
    all their bits in at most `most`, and where `ratio` is given, the smaller has at least `ratio` of
    the larger's shingles.
    """
    spark = classes.sparkSession
    rows = classes.count()
    width = -math.log(ratio) if ratio else 0.0
    picked = classes.select("fp", "n").orderBy(F.xxhash64("fp"), "fp", "n").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in picked], np.int64).view(np.uint64)
    tree = grow(sample, np.log(np.maximum([r["n"] for r in picked], 1)) if picked else np.empty(0), rows, radius, width)
    names = ["id", "fp", "n", *(f"x{i}" for i in range(extra))]
    kinds = ", ".join(f"{x} long" for x in names)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.log(np.maximum(b.column("n").to_numpy(zero_copy_only=False), 1))
            out = [(s, at, home) for s, at, home in deal(tree, fps, size, radius, width) if len(at)]
            if out:
                taken = b.take(pa.array(np.concatenate([at for _, at, _ in out])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(at), s) for s, at, _ in out]), pa.int64()), pa.array(np.concatenate([np.full(len(at), h) for _, at, h in out])), *taken.columns], ["shard", "home", *names])

    def join(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ["home", *names]}
        fps = col["fp"].view(np.uint64)
        more = [col[f"x{i}"].view(np.uint64) for i in range(extra)]
        size = np.log(np.maximum(col["n"], 1))

        def sure(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = np.abs(size[i] - size[j]) <= width + 1e-9 if width else np.ones(len(i), bool)
            if extra:
                ok &= np.bitwise_count(fps[i] ^ fps[j]).astype(np.int64) + sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in more) <= most
            return ok

        a, b = join_shard(col["id"], fps, col["home"], radius, sure if width or extra else None)
        return pa.table({"child": pa.array(a, pa.int64()), "parent": pa.array(b, pa.int64())})

    bounded_batches(spark, 10_000)
    dealt = classes.select(*names).mapInArrow(assign, f"shard long, home boolean, {kinds}")
    return dealt.groupBy("shard").applyInArrow(join, "child long, parent long")


def set_prints(docs: DataFrame, words: int, keep: list[str]) -> DataFrame:
    """The columns `keep`, id (a hash of the set of shingle hashes), n (shingles) and bits (SET_WORDS x 64) for every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, bits = [], [], []
            for t in b.column("text").cast(pa.binary()):
                hashes = np.unique(shingle_hashes(t.as_py() or b"", words))
                ids.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63))
                n.append(len(hashes))
                bits.append(b"".join(_majority(_mixed(hashes, k)).to_bytes(8, "big") for k in SET_KEYS))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], [*keep, "id", "n", "bits"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, f"{', '.join(f'`{k}` {kinds[k]}' for k in keep)}, id long, n long, bits binary")


def table_codes(bits: list[bytes]) -> np.ndarray:
    """(rows, TABLES) codes: consecutive runs of CODE_BITS of the fingerprints."""
    each = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), SET_WORDS * 8), axis=1)
    powers = (1 << np.arange(CODE_BITS, dtype=np.uint64))[::-1]
    return (each.reshape(len(bits), TABLES, CODE_BITS) * powers).sum(axis=2, dtype=np.uint64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of check words differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def hot_leaf(ids: np.ndarray, check: np.ndarray, home: np.ndarray, most: int):
    """Compares a large leaf by the check words alone.

    Rows within `most` bits of a leader are linked to it, and so need no comparison among themselves; a
    row beyond is compared with those of them that the triangle inequality allows.
    """

    def compare(x: np.ndarray, y: np.ndarray, links: Links) -> None:
        step = max(1, (1 << 19) // max(len(y), 1))
        for i in range(0, len(x), step):
            rows = x[i : i + step]
            p, q = np.nonzero(apart(check[rows][:, None], check[y][None, :]) <= most)
            p, q = rows[p], y[q]
            keep = (p != q) & (home[p] | home[q])
            links.add(ids[p[keep]], ids[q[keep]])

    def run(h: np.ndarray, v: np.ndarray, links: Links) -> None:
        far = np.concatenate([h, v])
        while (leaders := far[home[far]]).size > LEAF:
            leader = leaders[0]
            d = apart(check[far], check[leader])
            near_ = d <= most
            y, dy = far[near_], d[near_]
            links.add(ids[y], np.full(len(y), ids[leader]))
            far, d = far[~near_], d[~near_]
            x = far[d <= most + dy.max()]
            if len(x):
                compare(x, y[dy >= d.min() - most], links)
        if len(leaders):
            compare(far, leaders, links)

    return run


def set_links(classes: DataFrame) -> DataFrame:
    """(child, parent): a forest of candidate links among classes(id, bits).

    TABLES times, a code of CODE_BITS of the fingerprint is searched by vantage-point trees within CODE_RADIUS, and what is
    found links if the first CHECK_WORDS words differ in at most CHECK_BITS bits.  Two sets with a Jaccard coefficient of 0.8 differ
    in about 15 % of the bits, so a table finds them with a probability of 0.17 and all tables with 0.997.
    """
    spark = classes.sparkSession
    rows = classes.count()
    sample = [bytes(r["bits"]) for r in classes.select("bits", "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    codes = table_codes(sample) if sample else np.empty((0, TABLES), np.uint64)
    trees = [grow(codes[:, t], np.zeros(len(sample)), rows, CODE_RADIUS, 0.0) for t in range(TABLES)]
    fields = ["shard", "home", "code", "id", "check"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = b.column("bits").to_pylist()
            ids, checks = b.column("id"), pa.array([x[: 8 * CHECK_WORDS] for x in bits], pa.binary())
            found, none = table_codes(bits), np.zeros(len(bits))
            for t in range(TABLES):
                for leaf, at, home in deal(trees[t], found[:, t], none, CODE_RADIUS, 0.0):
                    if len(at):
                        k = pa.array(at)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t << 24 | leaf), pa.int64()), pa.array(np.full(len(at), home)), pa.array(found[at, t].astype(np.int64)), ids.take(k), checks.take(k)], fields)

    def join(table: pa.Table) -> pa.Table:
        ids, code, home = (table.column(c).to_numpy() for c in ("id", "code", "home"))
        check = np.frombuffer(b"".join(table.column("check").to_pylist()), np.uint64).reshape(-1, CHECK_WORDS)
        a, b = join_shard(ids, code.astype(np.uint64), home, CODE_RADIUS, lambda i, j: apart(check[i], check[j]) <= CHECK_BITS, hot_leaf(ids, check, home, CHECK_BITS))
        return pa.table({"child": pa.array(a, pa.int64()), "parent": pa.array(b, pa.int64())})

    bounded_batches(spark, 10_000)
    dealt = classes.select("id", "bits").mapInArrow(assign, "shard long, home boolean, code long, id long, check binary")
    return dealt.groupBy("shard").applyInArrow(join, "child long, parent long")


def roots(edges: DataFrame) -> DataFrame:
    """(id, root) for every id that is not the smallest of its component, from (child, parent) edges with parent < child.

    Each round: a child with several parents keeps the smallest and links the others to it; then
    every pointer jumps over its parent.  A parent with very many children is dealt over salts.
    """
    at = settle(edges.distinct(), "edges")
    while True:
        low = at.groupBy("child").agg(F.min("parent").alias("p"), F.count("*").alias("k"))
        single = low.select("child", F.col("p").alias("parent"))
        others = at.join(low.where("k > 1"), "child").where("parent > p").select(F.col("parent").alias("child"), F.col("p").alias("parent"))
        parents = single.unionByName(others).distinct().groupBy("child").agg(F.min("parent").alias("up")).select(F.col("child").alias("q"), "up")
        via = at.select(F.col("parent").alias("q")).distinct().join(parents, "q").select(F.col("q").alias("q"), "up", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        salted = single.withColumn("q", F.col("parent")).withColumn("s", F.pmod(F.xxhash64("child"), F.lit(SALTS)).cast("int"))
        jumped = salted.join(via, ["q", "s"], "left").select("child", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved"))
        new = settle(jumped.unionByName(others.withColumn("moved", F.lit(True))).groupBy("child", "parent").agg(F.max("moved").alias("moved")), "edges")
        done = new.where("moved").limit(1).count() == 0
        drop_settled(at)
        if done:
            return new.select(F.col("child").alias("id"), F.col("parent").alias("root"))
        at = new.select("child", "parent")


def components(docs: DataFrame, words: int = 4, radius: int = 4, extra: int = 0, most: int = 0, ratio: float = 0.0) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, itself included) for every document.

    Classes are documents with equal fingerprints (with `ratio`, and equal numbers of shingles), named by their smallest doc_id.
    """
    more = [f"x{i}" for i in range(extra)]
    key = ["fp", *more, *(["n"] if ratio else [])]
    prints = settle(fingerprints(docs, words, extra), "prints")
    grouped = prints.groupBy(*key).agg(F.min("doc_id").cast("long").alias("id"), F.count("*").alias("copies"), *([] if ratio else [F.max("n").alias("n")]))
    classes = settle(grouped, "classes")
    found = roots(links(classes, radius, extra, most, ratio))
    named = classes.join(found, "id", "left")
    # what needs a name other than its own doc_id: classes with copies and linked classes
    table = named.where((F.col("copies") > 1) | F.col("root").isNotNull()).select(*(F.col(k).alias(f"_{k}") for k in key), F.coalesce("root", "id").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt2"))
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("_salt") == F.col("_salt2")]
    salted = prints.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(table, on, "left").select("doc_id", "fp", F.coalesce("component_id", F.col("doc_id").cast("long")).alias("component_id"))
