"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

Tokens are ASCII-lower-cased words and one end for each text.  The most frequent tokens (`own_words`
of them, so the model grows with the vocabulary that was counted) have vectors of their own; all others
share a vector by a hash where they are context, and a class member by their last three bytes where
they are predicted.

A predicted vector is the sum of the element-wise weighted vectors of the CONTEXT tokens before a
position.  Its products with output vectors and biases are logits of two softmaxes: over classes (the
FIRST tokens are classes, the other tokens are dealt by their last three bytes), and over the
members of the class (its own words, and one member for the rest).  Within the rest of a class
a token has its smoothed relative frequency.  So the distribution over the whole vocabulary, with one
unseen token for each class, sums to one, and no product is taken with more vectors than there are
classes and members of one class.

Counts cover every training text, exactly, and are never held in one place: texts are dealt into
chunks of CHUNK bytes, each chunk's distinct tokens are summed by token and joined back.
Training is data-parallel: each task makes NCE steps over every position of every training
text it holds, and a parameter row's changes are averaged over the tasks that touched it, weighted by how
often, in blocks of rows.

Defined results: null and empty texts are one end token; repeated rows score alike;
an empty training set scores every token as unseen; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinreel.llm.common import bounded_batches, settle

#: DIM and the bias make a row of 32 numbers.
CONTEXT, DIM, FIRST = 4, 31, 64
#: Words with vectors of their own: PER_ROOT x the square root of the number of training tokens' kinds, MOST at most (the size of the model).
PER_ROOT, MOST = 64, 1 << 16
CHUNK, LEAST_CHUNKS = 12 << 20, 48
#: A step takes SEGMENTS runs of SEGMENT positions each, picked at random from a buffer of BUFFER runs.
SEGMENT, SEGMENTS, BUFFER = 32, 24, 2048
#: Noise classes for a step, and noise members for a position.
NOISE, NOISE_MEMBERS, RATE = 64, 2, 0.1
#: Parameter rows of a block, and partitions that average blocks.
BLOCK, AVERAGES = 2048, 32
#: Tokens whose places a task remembers, about.
REMEMBERED = 1 << 20
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def split(texts: pa.Array) -> pa.Array:
    """The words of each text; null texts and texts of white space have none."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())))
    words = pc.ascii_split_whitespace(trimmed)
    return pc.if_else(pc.equal(pc.binary_length(trimmed), 0), pa.scalar([], words.type), words)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def own_words(kinds: int) -> int:
    return min(MOST, int(PER_ROOT * kinds**0.5))


def endings(own: int) -> int:
    """Number of classes by ending: a power of two near the square root of the own words."""
    return 1 << max(4, round(np.log2(1.4 * max(own, 1) ** 0.5)))


class _Places(dict):
    """A token's row as context, and its class << 32: worked out once for each token, however often it occurs."""

    def __init__(self, v: Vocabulary):
        self.v = v
        super().__init__(zip(v.number, (np.arange(v.own) | v.own_class.astype(np.int64) << 32).tolist()))

    def __missing__(self, token: bytes) -> int:
        self[token] = place = self.v.own + zlib.crc32(token) % self.v.hashed | self.v.class_of(token) << 32
        return place


class Vocabulary:
    """Where a token's vectors are.  `own`: (token, count) by falling count; `ends`: class -> (tokens, kinds) of its rest."""

    def __init__(self, own: list[tuple[bytes, int]], ends: dict[int, tuple[int, int]]):
        self.own = len(own)
        self.first, self.ends = min(FIRST, self.own), endings(self.own)
        self.hashed = max(1024, self.own)
        self.pad = self.own + self.hashed
        self.number = {t: i for i, (t, _) in enumerate(own)}
        self.count = np.array([c for _, c in own], np.float64)
        self.classes = self.first + self.ends
        self.own_class = np.array([i if i < self.first else self.class_of(t) for i, (t, _) in enumerate(own)], np.int32)
        # members in order of class, each class's rest last
        inner = self.own - self.first
        at_class = np.concatenate([self.own_class[self.first :], np.arange(self.first, self.classes)]).astype(np.int64)
        order = np.lexsort((np.arange(len(at_class)) >= inner, at_class))
        at = np.empty(len(order), np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        self.own_member = np.concatenate([np.full(self.first, -1, np.int32), at[:inner]])
        self.rest_member = at[inner:]
        self.starts = np.searchsorted(at_class[order], np.arange(self.first, self.classes + 1))
        self.rest = np.array([ends.get(i, (0, 0)) for i in range(self.ends)], np.float64).reshape(-1, 2)
        freq = np.empty(len(order))
        freq[at[:inner]] = self.count[self.first :]
        freq[self.rest_member] = self.rest[:, 0] + 0.1
        self.members = len(freq)
        per_class = np.add.reduceat(freq, self.starts[:-1])
        self.q_member = freq / np.repeat(per_class, np.diff(self.starts))
        self.q_class = np.concatenate([self.count[: self.first], per_class])
        self.q_class /= self.q_class.sum()
        self.rows = self.pad + 1 + self.classes + self.members + CONTEXT
        self.places: _Places | None = None

    def class_of(self, token: bytes) -> int:
        return self.first + zlib.crc32(token[-3:]) % self.ends

    def look(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row as context, class, member or -1) of each token."""
        if self.places is None or len(self.places) > self.own + REMEMBERED:
            self.places = _Places(self)
        place = np.fromiter(map(self.places.__getitem__, names), np.int64, len(names))
        row, cls, member = (place & 0xFFFFFFFF).astype(np.int32), (place >> 32).astype(np.int32), np.empty(len(names), np.int32)
        known, other = np.flatnonzero(row < self.own), np.flatnonzero(row >= self.own)
        member[known] = self.own_member.take(row.take(known))
        member[other] = self.rest_member.take(cls.take(other) - self.first)
        return row, cls, member


class Model:
    """All parameters as rows of one matrix: context vectors, class vectors, member vectors, context weights.  The last column is the bias."""

    def __init__(self, v: Vocabulary, weights: np.ndarray | None = None):
        self.v = v
        if weights is None:  # small random vectors; the biases are log frequencies, so the model starts as the unigram
            rng = np.random.default_rng(5)
            weights = rng.normal(0, 0.1, (v.rows, DIM + 1)).astype(np.float32)
            weights[: v.pad + 1, DIM] = 0
            weights[v.pad] = 0
            weights[-CONTEXT:] = 1
            weights[-CONTEXT:, DIM] = 0
        self.w = weights
        a, b, c = v.pad + 1, v.pad + 1 + v.classes, v.pad + 1 + v.classes + v.members
        self.at = (a, b, c)
        # the last column of context vectors and weights is zero
        self.inp, self.cls, self.mem, self.mix = weights[:a], weights[a:b], weights[b:c], weights[c:]

    @classmethod
    def start(cls, v: Vocabulary) -> Model:
        m = cls(v)
        m.cls[:, DIM], m.mem[:, DIM] = np.log(v.q_class), np.log(v.q_member)
        return m

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        """Predicted vectors with a last column of ones, for the positions that follow the first CONTEXT of a run of vectors."""
        n = len(rows) - CONTEXT
        out, part = rows[CONTEXT - 1 : CONTEXT - 1 + n] * self.mix[0], np.empty((n, DIM + 1), np.float32)
        for j in range(1, CONTEXT):
            out += np.multiply(rows[CONTEXT - 1 - j : CONTEXT - 1 - j + n], self.mix[j], out=part)
        out[:, DIM] = 1
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def aliases(q: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stay, other): a uniform place of a class that is kept with probability `stay`, else changed to the other, is drawn by q."""
    stay, other = q * np.repeat(np.diff(starts), np.diff(starts)), np.arange(len(q), dtype=np.int32)
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        p = stay[s:e].tolist()
        small, large = [i for i, x in enumerate(p) if x < 1], [i for i, x in enumerate(p) if x >= 1]
        while small and large:
            i, j = small.pop(), large[-1]
            other[s + i] = s + j
            p[j] -= 1 - p[i]
            if p[j] < 1:
                small.append(large.pop())
        for i in [*small, *large]:
            p[i] = 1.0
        stay[s:e] = p
    return stay, other


class Trainer:
    """NCE: noise classes drawn by frequency and shared by a step, noise members drawn within the target's class.  Adagrad steps on touched rows, with one rate for a row."""

    def __init__(self, model: Model, seed: int):
        v = model.v
        self.m, self.rng = model, np.random.default_rng(seed)
        self.square = np.full(len(model.w), 1e-8, np.float32)
        self.touched = np.zeros(len(model.w), np.float32)
        self.log_class, self.log_member = np.log(v.q_class * NOISE).astype(np.float32), np.log(v.q_member * NOISE_MEMBERS).astype(np.float32)
        self.drawn = self.rng.choice(v.classes, 1 << 18, p=v.q_class).astype(np.int32)
        self.stay, self.alias = aliases(v.q_member, v.starts)
        self.sizes = np.diff(v.starts)
        self.last = np.zeros(len(model.w), np.int32)
        self.cells = model.w.view(f"V{4 * (DIM + 1)}").ravel()
        self.grads = np.empty((0, DIM + 1), np.float32)

    def _update(self, rows: np.ndarray, grads: np.ndarray) -> None:
        # each row's last gradient gets the row's other ones added
        every = np.arange(len(rows), dtype=np.int32)
        self.last[rows] = every
        at = self.last.take(rows)
        ends = at == every
        keep, more = np.flatnonzero(ends), np.flatnonzero(~ends)
        place = np.empty(len(rows), np.int64)
        place[keep] = np.arange(len(keep))
        g, key, half = grads.take(keep, axis=0), rows.take(keep), (DIM + 1) // 2
        # two numbers at once, as one complex number
        to = (place.take(at.take(more))[:, None] * half + np.arange(half)).ravel()
        np.add.at(g.reshape(-1).view(np.complex64), to, grads.take(more, axis=0).reshape(-1).view(np.complex64))
        s = self.square.take(key) + np.einsum("ij,ij->i", g, g) / g.shape[1]
        self.square[key] = s
        g *= (RATE / np.sqrt(s))[:, None]
        self.cells[key] = np.subtract(self.m.w.take(key, axis=0), g, out=g).view(self.cells.dtype).ravel()
        self.touched[key] += 1

    def step(self, x: np.ndarray, y: np.ndarray, member: np.ndarray) -> None:
        """x: runs of CONTEXT + SEGMENT context rows; y, member: runs of SEGMENT classes (-1 past the end of a text) and members (-1: none)."""
        m, v = self.m, self.m.v
        a, b, c = m.at
        x, n = x.ravel(), x.size
        rows = m.w.take(x, axis=0)
        real = np.flatnonzero(y.ravel() >= 0)
        y, member = y.ravel().take(real), member.ravel().take(real)
        at = real + real // SEGMENT * CONTEXT  # runs lie behind each other: what is predicted across their bounds is not used
        h = m.hidden(rows).take(at, axis=0)
        z = self.drawn.take(self.rng.integers(0, len(self.drawn), NOISE))
        two = np.flatnonzero(member >= 0)
        ends = np.cumsum([n, CONTEXT, len(y), NOISE, len(two) * (1 + NOISE_MEMBERS)])
        if len(self.grads) < ends[-1]:
            self.grads = np.empty((ends[-1], DIM + 1), np.float32)
        g_rows, g_mix, g_y, g_z, g_member = np.split(self.grads[: ends[-1]], ends[:-1])
        wy, wz = m.cls.take(y, axis=0), m.cls.take(z, axis=0)
        good = _sigmoid(np.einsum("ij,ij->i", h, wy) - self.log_class.take(y)) - 1
        bad = h @ wz.T
        bad -= self.log_class.take(z)
        gh = _sigmoid(bad) @ wz
        gh += np.multiply(good[:, None], wy, out=wy)
        np.multiply(good[:, None], h, out=g_y)
        np.matmul(bad.T, h, out=g_z)
        keys = [x, np.arange(c, c + CONTEXT), a + y, a + z]
        if len(two):
            h2, e = h.take(two, axis=0), y.take(two) - v.first
            u = self.rng.random((len(two), NOISE_MEMBERS)) * self.sizes.take(e)[:, None]
            slot = u.astype(np.int32)
            u -= slot
            slot += v.starts.take(e)[:, None]
            ids = np.empty((len(two), 1 + NOISE_MEMBERS), np.int32)
            ids[:, 0], ids[:, 1:] = member.take(two), np.where(u < self.stay.take(slot), slot, self.alias.take(slot))
            w = m.mem.take(ids, axis=0)
            d = _sigmoid(np.einsum("ijk,ik->ij", w, h2) - self.log_member.take(ids))
            d[:, 0] -= 1
            gh[two] += np.einsum("ij,ijk->ik", d, w)
            keys.append(b + ids.ravel())
            np.multiply(d[:, :, None], h2[:, None, :], out=g_member.reshape(*ids.shape, DIM + 1))
        g = np.zeros((n - CONTEXT, DIM + 1), np.float32)
        g[at] = gh
        g_rows[:] = 0
        part, ones = np.empty_like(g), np.ones(len(g), np.float32)
        for j in range(CONTEXT):
            run = slice(CONTEXT - 1 - j, n - 1 - j)
            g_rows[run] += np.multiply(g, m.mix[j], out=part)
            np.matmul(ones, np.multiply(g, rows[run], out=part), out=g_mix[j])
        self._update(np.concatenate(keys), self.grads[: ends[-1]])
        m.w[v.pad] = 0


def runs(v: Vocabulary, lengths: list[int], row: np.ndarray, cls: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, one behind the other, cut into runs of SEGMENT positions with the CONTEXT rows before them."""
    n = np.array(lengths)
    k = -(-n // SEGMENT)
    after = np.cumsum(k)
    # each text fills its runs from their start
    at = np.arange(len(row)) + np.repeat((after - k) * SEGMENT - (np.cumsum(n) - n), n)
    x, y, z = (np.full(after[-1] * SEGMENT, none, np.int32) for none in (v.pad, -1, -1))
    x[at], y[at], z[at] = row, cls, member
    x = x.reshape(-1, SEGMENT)
    lead = np.full((len(x), CONTEXT), v.pad, np.int32)
    lead[1:] = x[:-1, -CONTEXT:]
    lead[after - k] = v.pad
    return np.concatenate([lead, x], 1), y.reshape(-1, SEGMENT), z.reshape(-1, SEGMENT)


def train_on(texts: Iterator[bytes | None], model: Model, seed: int) -> tuple[Trainer, int]:
    """A trainer after steps over every position of all the texts, and the number of positions."""
    trainer, v = Trainer(model, seed), model.v
    buffer: list[bytes] = []
    lengths: list[int] = []
    used = 0

    def flush() -> None:
        x, y, z = runs(v, lengths, *v.look(buffer))
        mixed = trainer.rng.permutation(len(x))
        for i in range(0, len(x), SEGMENTS):
            at = mixed[i : i + SEGMENTS]
            trainer.step(x.take(at, axis=0), y.take(at, axis=0), z.take(at, axis=0))
        buffer.clear()
        lengths.clear()

    for text in texts:
        names = tokens(text)
        buffer += names
        lengths.append(len(names))
        used += len(names)
        if len(buffer) >= BUFFER * SEGMENT:
            flush()
    if buffer:
        flush()
    return trainer, used


def _log_softmax(h: np.ndarray, w: np.ndarray, own: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Log probability of row own[i] of w for h[i]; works in `space` (as large as a block's logits, so it stays in a cache)."""
    out, step = np.empty(len(h), np.float32), max(1, len(space) // len(w))
    ones, at = np.ones(len(w), np.float32), np.arange(min(step, len(h))) * len(w)
    for i in range(0, len(h), step):
        x, y = h[i : i + step], own[i : i + step]
        z = np.matmul(x, w.T, out=space[: len(x) * len(w)].reshape(len(x), len(w)))
        mine = z.ravel().take(at[: len(x)] + y)
        with np.errstate(over="ignore"):
            total = np.exp(z, out=z) @ ones
        if not np.isfinite(total).all() or (total == 0).any():  # logits far from the usual
            z = x @ w.T
            z -= z.max(1, keepdims=True)
            mine, total = z[np.arange(len(x)), y], np.exp(z).sum(1)
        out[i : i + step] = mine - np.log(total)
    return out


def log10_scores(m: Model, row: np.ndarray, cls: np.ndarray, member: np.ndarray, block: int = 512, wide: int = 1 << 16) -> np.ndarray:
    """log10 probability of class and member at each position; texts follow each other, each after CONTEXT padding rows (class -1)."""
    v, out = m.v, np.zeros(len(row), np.float64)
    space = np.empty(block * v.classes, np.float32)
    if v.ends:
        space = np.empty(max(len(space), int(np.diff(v.starts).max())), np.float32)
    for i in range(CONTEXT, len(row), wide):
        n = min(wide, len(row) - i)
        h = m.hidden(m.inp.take(row[i - CONTEXT : i + n], axis=0))
        at = np.flatnonzero(cls[i : i + n] >= 0)
        out[i + at] = _log_softmax(h.take(at, axis=0), m.cls, cls[i + at], space)
        two = at[member[i + at] >= 0]
        e = cls[i + two] - v.first
        order = np.argsort(e, kind="stable")
        two, ends = two[order], np.searchsorted(e[order], np.arange(v.ends + 1))
        h, own, logs = h.take(two, axis=0), member[i + two], np.empty(len(two), np.float32)
        for c in np.flatnonzero(np.diff(ends)).tolist():
            lo, hi, k = v.starts[c], v.starts[c + 1], slice(ends[c], ends[c + 1])
            logs[k] = _log_softmax(h[k], m.mem[lo:hi], own[k] - lo, space)
        out[i + two] += logs
    return out / np.log(10)


def _chunked(docs: DataFrame, chunks: int) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id")).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))


def _split_all(texts: pa.ChunkedArray) -> pa.ChunkedArray:
    return pa.chunked_array([split(x) for x in texts.chunks], pa.list_(pa.string()))


def chunk_tokens(docs: DataFrame) -> DataFrame:
    """(chunk, token, c): the distinct tokens of each chunk with their counts in its training texts."""

    def count(table: pa.Table) -> pa.Table:
        out = table.column("held_out")
        seen = pc.list_flatten(_split_all(table.column("text").filter(pc.invert(out)))).value_counts()
        names, c = seen.field("values"), seen.field("counts")
        other = pc.list_flatten(_split_all(table.column("text").filter(out))).unique()
        other = other.filter(pc.invert(pc.is_in(other, value_set=names)))
        # an END closes each text
        n = len(out) - pc.sum(out).as_py()
        names = pa.concat_arrays([names.view(pa.binary()), other.view(pa.binary()), pa.array([END], pa.binary())])
        c = pa.concat_arrays([c, pa.array([0] * len(other) + [n], pa.int64())])
        return pa.table({"chunk": pa.repeat(table.column("chunk")[0].cast(pa.int32()), len(names)), "token": names, "c": c})

    return docs.groupBy("chunk").applyInArrow(count, "chunk int, token binary, c long")


CHANGES = "block int, rows binary, touched binary, change binary"


def train(docs: DataFrame, own: list[tuple[bytes, int]], ends: dict[int, tuple[int, int]]) -> np.ndarray:
    """The weights after all tasks' changes are averaged."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((own, ends))

    def batch(blocks: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for k, rows, touched, change in blocks:
            cells = (rows.astype("<u2").tobytes(), touched.astype("<f4").tobytes(), change.astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], ["block", "rows", "touched", "change"])

    def unpack(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for r in b.to_pylist():
            yield r["block"], np.frombuffer(r["rows"], "<u2"), np.frombuffer(r["touched"], "<f4"), np.frombuffer(r["change"], "<f2").reshape(-1, DIM + 1).astype(np.float32)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = Model.start(Vocabulary(*shared.value))
        before = model.w.copy()
        trainer, _ = train_on((t.as_py() for b in batches for t in b.column("text")), model, TaskContext.get().partitionId())
        rows = np.flatnonzero(trainer.touched)
        for k in np.unique(rows // BLOCK).tolist():
            mine = rows[rows // BLOCK == k]
            yield from batch(iter([(k, mine - k * BLOCK, trainer.touched[mine], model.w[mine] - before[mine])]))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, rows, touched, change in unpack(b):
                t = total.setdefault(k, np.zeros((BLOCK, DIM + 2), np.float32))
                t[rows, : DIM + 1] += touched[:, None] * change
                t[rows, DIM + 1] += touched
        for k, t in total.items():
            rows = np.flatnonzero(t[:, -1])
            yield from batch(iter([(k, rows, t[rows, -1], t[rows, :-1] / t[rows, -1:])]))

    bounded_batches(spark)
    changes = docs.where(~F.col("held_out")).select("text").mapInArrow(local, CHANGES)
    averaged = changes.repartition(AVERAGES, "block").mapInArrow(mean, CHANGES)
    model = Model.start(Vocabulary(own, ends))
    for r in averaged.toLocalIterator():  # the model itself, whose size MOST bounds
        rows = np.frombuffer(r["rows"], "<u2").astype(np.int64) + r["block"] * BLOCK
        model.w[rows] += np.frombuffer(r["change"], "<f2").reshape(-1, DIM + 1)
    shared.unpersist()
    return model.w


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    dealt = _chunked(docs, max(LEAST_CHUNKS, -(-size // CHUNK)))
    bounded_batches(spark)
    asked = settle(chunk_tokens(dealt), "asked")
    counted = settle(asked.groupBy("token").agg(F.sum("c").alias("c")), "counts")
    total, kinds = counted.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    own = [(bytes(r["token"]), r["c"]) for r in counted.where("c > 0").orderBy(F.desc("c"), "token").limit(own_words(kinds)).collect()]
    # own words are those up to the last one in that order
    least = own[-1] if own else (b"", 1 << 62)
    is_own = (F.col("c") > least[1]) | ((F.col("c") == least[1]) & (F.col("token") <= F.lit(bytearray(least[0]))))
    ending = (F.crc32(F.expr("substring(token, greatest(length(token) - 2, 1), 3)")) % endings(len(own))).cast("int")
    ends = {r["e"]: (r["n"], r["v"]) for r in counted.where((F.col("c") > 0) & ~is_own).groupBy(ending.alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    weights = train(dealt, own, ends)
    shared = spark.sparkContext.broadcast((own, ends, weights.astype("<f4").tobytes()))

    loaded: list[tuple[Model, np.ndarray]] = []

    def load() -> tuple[Model, np.ndarray]:
        if not loaded:  # once for each task
            words, rests, flat = shared.value
            v = Vocabulary(words, rests)
            base = np.log10((v.count + 0.1) / (total + 0.1 * (kinds + 1)))
            loaded.append((Model(v, np.frombuffer(flat, "<f4").reshape(v.rows, DIM + 1)), base))
        return loaded[0]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        model, own_base = load()
        v, out = model.v, []
        count = dict(zip(right.column("token").to_pylist(), right.column("c").to_pylist()))
        names: list[bytes] = []
        lengths: list[int] = []
        rows: list[tuple] = []

        def flush() -> None:
            row, cls, member = v.look(names)
            other = np.flatnonzero(row >= v.own)
            c = np.fromiter((count.get(names[i], 0) for i in other.tolist()), np.float64, len(other))
            base, known = np.append(own_base, 0).take(np.minimum(row, v.own)), np.ones(len(names), np.int64)
            base[other], known[other] = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1))), c > 0
            e = cls[other] - v.first
            inside = np.log10((c + 0.1) / (v.rest[e, 0] + 0.1 * (v.rest[e, 1] + 1)))
            # texts lie behind each other, each after CONTEXT padding rows
            at = np.arange(len(names)) + np.repeat(np.arange(1, len(rows) + 1) * CONTEXT, lengths)
            wide = [np.full(len(names) + len(rows) * CONTEXT, x, np.int32) for x in (v.pad, -1, -1)]
            for x, y in zip(wide, (row, cls, member)):
                x[at] = y
            logs = log10_scores(model, *wide)[at]
            logs[other] += inside
            starts = np.cumsum([0, *lengths[:-1]])
            sums = [np.add.reduceat(x, starts).tolist() for x in (known, base, logs)]
            out.extend((*r, i, n, total, b, s) for r, i, n, b, s in zip(rows, lengths, *sums))
            for x in (names, lengths, rows):
                x.clear()

        for doc, text, is_out in zip(left.column("doc_id").to_pylist(), left.column("text"), left.column("held_out").to_pylist()):
            words = tokens(text.as_py())
            names += words
            lengths.append(len(words))
            rows.append((doc, is_out))
            if len(names) > 1 << 17:
                flush()
        if rows:
            flush()
        types = [left.column("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * 7, types)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # own words are known to every task: only the others go back to the chunks that ask for them
    known = spark.createDataFrame(pa.table({"token": pa.array([t for t, _ in own], pa.binary())}))
    back = asked.join(F.broadcast(known), "token", "left_anti").select("chunk", "token").join(counted.where("c > 0"), "token")
    kinds_ = dict(docs.select("doc_id").dtypes)
    bounded_batches(spark)
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, f"doc_id {kinds_['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
