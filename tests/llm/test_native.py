"""Mixing, sharding, decontamination, SpotSigs: brute force on small fixtures, and odd inputs."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from twinreel.llm import decontaminate, mixing, sharding, spotsigs
from twinreel.llm.queries import oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"


def _docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and", "und", "de", "É", "é"]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 5, 30, 80, 400]))) for _ in range(60)]
    return [*out, None, "", "   ", "x" * 200_000, "word " * 30_000, *[out[3]] * 25, "the", "the of and", "***", "日本語 テキスト"]


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 450, 2) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.water_fill([10, 1000], [1, 1], 1515, 2) == [20, 1495]
    assert mixing.water_fill([0, 0], [1, 2], 0, 2) == [0, 0]
    assert mixing.water_fill([], [], 0, 2) == []


def test_schedule_inverts_its_integral():
    times, ws, cum = mixing.schedule_table([(0, 3), (0.25, 1), (1, 1)])
    assert cum[-1] == 1
    assert cum[1] == pytest.approx(0.5 / 1.25)
    with pytest.raises(ValueError, match="schedule"):
        mixing.schedule_table([(0, 1), (0.5, 1)])


def test_mix(spark, texts):
    docs = _docs(spark, texts, ["a", "b", None, "C"])
    knots = [(0, 3), (0.25, 1), (1, 1)]
    rows = mixing.mix(docs, schedules=(knots,)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    by = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    order = ["C", "a", "b", None]
    want = mixing.water_fill([sum(r["size"] for r in by[s]) for s in order], [5, 2, 1, 5], 1.5 * sum(size.values()), 2)
    for s, t in zip(order, want):
        assert by[s][0]["target"] == pytest.approx(t)
        assert abs(sum(r["taken"] for r in by[s]) - t) <= 1
        # positions follow the schedule: the share of the source's uses before time 0.25 is its integral's
        early = sum(p < 0.25 for r in by[s] for p in r["positions"])
        assert all(0 <= p <= 1 for r in by[s] for p in r["positions"])
        assert early > 0
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs, schedules=(knots,)).collect()), key=str)
    ordered = [r["position"] for r in mixing.by_position(mixing.mix(docs)).collect()]
    known = [p for p in ordered if p is not None]
    assert known == sorted(known)
    assert ordered[len(known) :] == [None] * (len(ordered) - len(known))
    used = mixing.training_order(docs, mixing.mix(docs))
    assert used.columns == docs.columns
    assert used.count() == sum(len(r["positions"]) for r in mixing.mix(docs).collect())


def _reached(knots, share):
    """The time at which the schedule's integral reaches its share, by bisection on an integral of its own."""

    def area(t):
        return sum((min(t, b) - a) * (w + w + (v - w) * (min(t, b) - a) / (b - a)) / 2 for (a, w), (b, v) in zip(knots, knots[1:]) if t > a)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if area(mid) < share * area(1.0) else (low, mid)
    return low


def test_positions_invert_the_cumulative_demand(spark):
    rng = random.Random(9)
    texts = ["w " * rng.randrange(0, 40) for _ in range(120)]
    docs = _docs(spark, texts, ["a", "b", "c"])
    curves = ([(0, 3), (0.25, 1), (1, 1)], [(0, 1), (1, 4)], [(0, 2), (0.5, 0), (1, 1)])
    rows = mixing.mix(docs, weights=(5, 2, 1), schedules=curves).collect()
    for source, knots, weight in zip("abc", curves, (5, 2, 1)):
        mine = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["row_key"], r["doc_id"]))
        whole, demand, at = sum(r["size"] for r in mine), int(mine[0]["target"] + 0.5), 0
        for r in mine:
            starts = [at + k * whole for k in range(2) if r["size"] and at + k * whole < demand]
            assert len(r["positions"]) == len(starts)
            for got, x in zip(r["positions"], starts):
                assert got == pytest.approx(_reached(knots, x / demand), abs=1e-6)
            assert r["taken"] == sum(min(r["size"], demand - x) for x in starts)
            at += r["size"]


def test_operators_keep_columns_of_any_name(spark):
    names = ["_th", "_id", "_salt", "_position", "_positions", "_key", "row", "key", "position", "row_key", "a.b", "_bad"]
    rows = [(i, f"one two three four five six seven eight nine ten eleven {i if i else ''}", "en", "s", 1, *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven 3")], "item_id long, text string")
    kept = decontaminate.remove_documents(docs, bench, 12).collect()
    assert sorted(map(tuple, kept)) == [r for r in rows if r[0] != 3]
    used = mixing.training_order(docs, mixing.mix(docs))
    assert used.columns == docs.columns
    assert set(map(tuple, used.collect())) <= set(rows)
    import corpus_pipeline as p

    assert sorted(map(tuple, p.drop_near_duplicates(spark, docs, "").collect())) == rows[:1]  # the first is 0.875 like each of the others


def test_mix_of_nothing(spark):
    assert mixing.mix(_docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(_docs(spark, [None, ""])).collect()] == [0, 0]


def test_shards(spark, texts):
    many = [f"{t} {i}" if t and len(t) < 5000 else t for i in range(20) for t in texts if t != "x" * 200_000]
    docs = _docs(spark, many)
    rows = sharding.shard(docs, 8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(many)))
    assert all(r["size"] == len((many[r["doc_id"]] or "").encode()) + 1 for r in rows)
    total = sum(r["size"] for r in rows)
    for s in range(8):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= 0.004 * total / 8 + 2 * max(r["size"] for r in rows)
    assert sharding.shard(_docs(spark, []), 8).count() == 0
    assert {(r["shard"], r["slot"]) for r in sharding.shard(_docs(spark, ["a"] * 3), 8).collect()} <= {(s, k) for s in range(8) for k in range(3)}


def test_splitters_cut_exact_bytes(spark):
    rng = random.Random(4)
    keys = [(rng.randrange(-(2**63), 2**63), rng.randrange(1, 50)) for _ in range(3000)] + [(7, 9)] * 500
    df = spark.createDataFrame(keys, "_key long, _size long")
    cuts = sharding.splitters(df, 5, 0.001)
    total = sum(s for _, s in keys)
    for k, c in enumerate(cuts):
        below = sum(s for x, s in keys if x < c)
        assert abs(below - total * (k + 1) // 5) <= 50 or 7 in (c, c - 1) or abs(below - total * (k + 1) / 5) <= 4500


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))


def _hits(docs, items, n):
    out = {}
    for i, t in enumerate(docs):
        ws, hit, who = _words(t), set(), set()
        for item, text in items:
            iw = _words(text)
            k = min(n, len(iw))
            grams = {tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)} if k else set()
            for j in range(len(ws) - k + 1) if k else ():
                if tuple(ws[j : j + k]) in grams:
                    hit.update(range(j, j + k))
                    who.add(str(item))
        out[i] = (len(ws), len(hit), sorted(who), hit)
    return out


@pytest.mark.parametrize("limit", [100_000, 0])
def test_decontamination(spark, texts, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SET_LIMIT", limit)
    items = [(1, "Alpha beta gamma delta EPSILON zeta eta theta iota kappa lambda mu"), (20, "short É item"), (3, None), (4, "***"), (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (6, "w1 w2")]
    passage = "alpha, beta gamma-delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [t for t in texts if t is None or len(t) < 9000] + [f"pre {passage} post {passage}", passage.upper(), "a short É item here", "a short é item here", "alpha beta gamma delta epsilon zeta eta theta iota", "w1 w2 w1 w2"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _hits(docs, items, 10)
    got = decontaminate.hits(_docs(spark, docs), bench, 10)
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, who, at = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, who)
        assert {p for s in r["spans"] for p in range(s["start"], s["end"] + 1)} == {p + 1 for p in at}
    clean = {i for i, w in want.items() if not w[1]}
    kept = decontaminate.remove_documents(_docs(spark, docs), bench, 10)
    assert kept.columns == DOCS.replace(",", "").split(" ")[::2]
    assert {r["doc_id"] for r in kept.collect()} == clean
    cut = dict(decontaminate.cut_spans(got).collect())
    assert all(cut[i] == docs[i] for i in clean)
    for i, (_, _, _, at) in want.items():
        assert _words(cut[i]) == [w for k, w in enumerate(_words(docs[i])) if k not in at]
    none = decontaminate.hits(_docs(spark, ["a b", None]), bench.where("item_id = 4"), 10).collect()
    assert [(r["n_words"], r["n_hit"]) for r in sorted(none, key=lambda r: r["doc_id"])] == [(2, 0), (0, 0)]
    assert decontaminate.hits(_docs(spark, []), bench, 10).count() == 0


def _sigs(t):
    """Each anchor with the next content words; content words that no anchor covers are starts."""
    common, out = set(spotsigs.COMMON), set()
    ws = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    content = [i for i, w in enumerate(ws) if w not in common]
    covered = set()
    for i, w in enumerate(ws):
        chain = [k for k in content if k > i][: spotsigs.CHAIN]
        if w in common and chain:
            out.add((w, " ".join(ws[k] for k in chain)))
            covered |= set(chain)
    for n, k in enumerate(content):
        if k not in covered or n == 0:
            out.add(("", " ".join(ws[c] for c in content[n : n + spotsigs.CHAIN])))
    return out


def test_spotsigs(spark, texts):
    docs = [t for t in texts if t is None or len(t) < 9000]
    df = _docs(spark, docs)
    sizes = dict(df.select("doc_id", F.size(spotsigs.signatures(F.col("text")))).collect())
    assert sizes == {i: len(_sigs(t)) for i, t in enumerate(docs)}
    rows = {r["doc_id"]: r for r in spotsigs.compare_with_next(df).collect()}
    assert len(rows) == len(docs)
    for i, t in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)] or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_text"] == edit
        for other, name in ((edit, "near_edited"), (nxt, "near_next")):
            a, b = _sigs(t), _sigs(other)
            assert rows[i][name] == pytest.approx(len(a & b) / len(a | b) if a or b else 1.0)


def test_spotsigs_ranges_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS_PER_RANGE", 7)
    rng = random.Random(2)
    ids = sorted(rng.sample(range(-500, 10**9), 90))
    base = [" ".join(f"the w{rng.randrange(60)} x{rng.randrange(60)}" for _ in range(30)) for _ in range(90)]
    base[10], base[11] = base[9], base[9] + " the new words"
    df = spark.createDataFrame(list(zip(ids, base)), "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(df).where("_ghost = 0").collect()}
    assert got == {i: base[(k + 1) % 90] for k, i in enumerate(ids)}
    pairs, members = spotsigs.near_pairs(df, 0.8)
    named = dict(members.collect())
    assert named[ids[10]] == ids[9]
    want = set()
    for x in range(90):
        for y in range(x + 1, 90):
            a, b = _sigs(base[x]), _sigs(base[y])
            if a != b and len(a & b) / len(a | b) >= 0.8:
                want.add((named[ids[x]], named[ids[y]]))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(min(p), max(p)) for p in want}
    one = spark.createDataFrame([(5, "the word here")], "doc_id long, text string")
    r = spotsigs.compare_with_next(one).first()
    assert (r["near_next"], r["edited_text"]) == (1.0, "the wor" + "the wo")
    assert spotsigs.compare_with_next(one.limit(0)).count() == 0


def test_splitters_are_exact_beside_a_long_document(spark):
    rng = random.Random(9)
    rows = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)})
    sizes = [500_000 if i == 100 else rng.randrange(1, 1000) for i in range(3000)]
    cuts = sharding.splitters(spark.createDataFrame(list(zip(rows, sizes)), "_key long, _size long"), 4)
    total = sum(sizes)
    for k, cut in enumerate(cuts, 1):
        goal = total * k // 4
        nearest = min(abs(sum(sizes[:i]) - goal) for i in range(3001))
        assert abs(sum(n for x, n in zip(rows, sizes) if x < cut) - goal) <= max(nearest, 0.002 * total / 4)


def test_spotsigs_of_the_query_see_whole_texts(spark, tmp_path):
    rng = random.Random(8)
    plain = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    head, tail = plain(40), plain(40)
    texts = [f"{head} {plain(40)}", f"{head} {plain(40)}", f"the {plain(2)} {tail}", f"the of and to in with {plain(5)}", "the", None, "", "the one of", "日本語 テキスト", plain(300)]
    vocab = ["the", "of", "and", "und", "de", *(f"w{i}" for i in range(12))]
    texts += [" ".join(rng.choices(vocab, k=rng.randrange(1, 90))) for _ in range(40)]
    df = _docs(spark, texts)
    got = dict(df.select("doc_id", spotsigs.signatures(F.col("text"))).collect())
    assert {i: len(s) for i, s in got.items()} == {i: len(_sigs(t)) for i, t in enumerate(texts)}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries()["op9_spotsigs"](spark, str(tmp_path)).collect()}
    assert rows[0]["fingerprint"] != rows[1]["fingerprint"]
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        for other, name in ((t[: len(t) - half] + nxt[:half], "near_edited"), (nxt, "near_next")):
            a, b = _sigs(t), _sigs(other)
            assert rows[i][name] == pytest.approx(len(a & b) / len(a | b) if a or b else 1.0)
    assert rows[9]["near_edited"] < 0.6


def test_queries_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        got = queries()[name](spark, d)
        want = con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        key = lambda rows: sorted([tuple(r) for r in rows], key=str)
        assert key(got.select(*cols).collect()) == key(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())


def test_shard_query_digest(spark):
    d = "/root/testdata/sf0.001"
    text = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    for r in queries()["op4_histogram_shards"](spark, d).collect():
        assert r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode())
    r = queries()["op9_spotsigs"](spark, d).orderBy("doc_id").first()
    t, n = text[0], text[1]
    assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
