"""The near-duplicate stage against the Jaccard coefficient of all pairs of shingle sets."""

import random

import pytest

from twinreel.llm import jaccard, simhash


def _shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def _groups(texts, least=0.8):
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a | b and len(a & b) >= least * len(a | b) - 1e-9):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def _texts():
    """Pairs just over and just under 0.8, long and short; a group linked by neighbours only."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfglmnprst", k=7))
    out = []
    for n in (8, 9, 10, 14, 24, 124, 404):
        for cut in range(1, 2 + n // 4):
            base = [word() for _ in range(n)]
            if abs((n - 4 - cut) / (n - 4) - 0.8) < 0.15 and cut < n - 4:
                out += [" ".join(base), " ".join(base[:-cut])]  # J = (n - 4 - cut) / (n - 4)
            near = (n - 4 - cut) / (n - 4 + cut)
            if abs(near - 0.8) < 0.15:
                out += [" ".join(base), " ".join(base[:-cut] + [word() for _ in range(cut)])]
    chain = [word() for _ in range(200)]
    out += [" ".join(chain[i : i + 100]) for i in range(0, 100, 5)]
    return [*out, None, "", " \n", "one", "One", "one two"]


@pytest.mark.parametrize("block", [1000, 4])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, block):
    import corpus_pipeline as p

    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = _texts()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r["doc_id"] for r in p.drop_near_duplicates(spark, df, "").select("doc_id").collect())
    assert got == sorted(set(_groups(texts)))
    assert p.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_rows_with_null_or_repeated_ids_go_only_as_copies(spark):
    import corpus_pipeline as p

    rng = random.Random(6)
    a, b, c, d, e, f = (" ".join("".join(rng.choices("bcdfglmnprst", k=6)) for _ in range(40)) for _ in range(6))
    rows = [(None, a), (None, b), (None, c + " more"), (1, c), (2, d), (2, e), (2, c), (3, e), (4, f), (4, f), (5, f), (None, f), (None, None), (6, ""), (7, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = p.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    want = [(None, a), (None, b), (1, c), (2, d), (2, e), (4, f), (6, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_search_finds_nearly_all_pairs_at_the_threshold(spark):
    """Recall of the SimHash search itself, on pairs with coefficients of 0.8 to 0.83, long and short."""
    import numpy as np

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("bcdfglmnprst", k=7))
    rows, pairs = [], 0
    while pairs < 300:
        n = rng.choice([9, 14, 30, 100, 400])
        a = [word() for _ in range(n)]
        b = [*a[: n - max(1, round((n - 4) / 9))]]
        b += [word() for _ in range(n - len(b))]
        x, y = _shingles(" ".join(a)), _shingles(" ".join(b))
        if not 0.8 <= len(x & y) / len(x | y) <= 0.83:
            b = a[: n - max(1, (n - 4) // 5)]
            y = _shingles(" ".join(b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.83:
            rows += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = simhash.set_prints(df, 5, ["doc_id"])
    of = {r["id"]: r["doc_id"] // 2 for r in prints.collect()}
    found = {of[r["child"]] for r in simhash.set_links(prints.select("id", "bits")).collect() if of[r["child"]] == of[r["parent"]]}
    assert len(found) >= 0.97 * pairs
    assert np.unique([d for d, _ in rows]).size == 2 * pairs


def test_a_large_group_is_compared_by_leaders():
    import numpy as np

    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, (3, simhash.CHECK_WORDS), dtype=np.uint64)
    check = np.concatenate([np.repeat(c[None], 400, 0) for c in centre])
    flips = rng.random((*check.shape, 64)) < rng.uniform(0.02, 0.25, len(check))[:, None, None]
    check ^= (flips * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(-1).astype(np.uint64)
    ids, home = np.arange(len(check)), rng.random(len(check)) < 0.8
    links = simhash.Links()
    simhash.hot_leaf(ids, check, home, 73)(np.flatnonzero(home), np.flatnonzero(~home), links)
    i, j = np.nonzero((simhash.apart(check[:, None], check[None, :]) <= 73) & (home[:, None] | home[None, :]))
    keep = i < j
    want = dict(zip(*(x.tolist() for x in simhash.forest(i[keep], j[keep]))))
    assert dict(zip(*(x.tolist() for x in links.result()))) == want
