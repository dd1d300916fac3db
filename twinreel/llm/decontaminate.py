"""Benchmark decontamination: a hash set of normalised benchmark n-grams, scanned over every training window.

Words are runs of digits, lower-cased letters and non-ASCII characters.  A window is
`n` consecutive words of an item; an item with fewer words is one window.  Every
document window is hashed and looked up; looked-up windows are compared word for
word with the benchmark before they count.

The set is part of the plan while it holds at most SET_LIMIT hashes (its size is
checked); a larger benchmark is joined on the hash instead.  Defined results: a null
or empty text has no words and no hits; items without words are ignored; repeated
rows each get the result of their text; an empty benchmark leaves every document
clean.  Native DataFrame code only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinreel.llm.common import ascii_lower, let, packed, settle

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SET_LIMIT = 100_000
#: A text's copies are dealt over this many keys where rows meet their text's result.
SALTS = 32
#: Hashes of contaminated texts (8 bytes each) that are broadcast at most.
BROADCAST_TEXTS = 1_000_000
SPANS = "array<struct<start:int,end:int>>"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def _hashes(ws: Column, n: int) -> Column:
    """Hash of each window of n words, in order; none if there are fewer words."""
    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) >= n, let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n)))))


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """item_id, len, hash, window (the words, space-joined): the distinct windows of each item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_ws")).where(F.size("_ws") > 0)
    full = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_ws") - (n - 1), F.lit(1))), lambda i: F.slice("_ws", i, n))
    one = items.select("item_id", F.explode(full).alias("_w"))
    return one.select("item_id", F.size("_w").alias("len"), F.xxhash64(F.transform("_w", lambda w: F.xxhash64(w))).alias("hash"), F.array_join("_w", " ").alias("window")).distinct()


def _window(ws: Column, at: Column) -> Column:
    return F.array_join(F.slice(ws, at["at"], at["len"]), " ")


def _salt(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int").alias("_salt")


def _salted(texts: DataFrame) -> DataFrame:
    return texts.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _text_hash() -> Column:
    return F.xxhash64("text", F.reverse("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_th", _text_hash())


def contaminated_texts(keyed: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame | None:
    """(_th2, _items, _spans): one row for each distinct text with a verified hit; None if the benchmark has no window."""
    grams = settle(windows(benchmark, n), "grams")
    lens = sorted(r[0] for r in grams.select("len").distinct().collect())
    if not lens:
        return None
    count = grams.select("hash").distinct().count()
    small = count <= SET_LIMIT
    known = [r[0] for r in grams.select("hash").distinct().collect()] if small else []

    def found(ws: Column) -> Column:
        """Windows of the text, in order: hash, place and length; of a small set only those with a known hash, with their words."""
        each = []
        for size in lens:
            at = F.transform(_hashes(ws, size), lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at"), F.lit(size).alias("len")))
            if small:
                at = F.transform(F.filter(at, lambda x: x["h"].isin(known)), lambda x: F.struct(x["h"].alias("h"), x["at"].alias("at"), x["len"].alias("len"), _window(ws, x).alias("w")))
            each.append(F.coalesce(at, F.array().cast(f"array<struct<h:bigint,at:int,len:int{',w:string' if small else ''}>>")))
        return F.concat(*each)

    # equal texts (a large group of copies) are scanned alike and kept once
    scanned = keyed.select("_th", let(words(F.col("text")), found).alias("_found")).where(F.size("_found") > 0)
    if small:
        one = scanned.groupBy("_th").agg(F.first("_found").alias("_found")).select("_th", F.explode("_found").alias("_f"))
        verified = one.join(F.broadcast(grams), (F.col("_f.h") == F.col("hash")) & (F.col("_f.w") == F.col("window"))).select("_th", "item_id", F.col("_f.at").alias("at"), F.col("_f.len").alias("len"))
    else:
        # only hashes meet; the words of the windows that meet are compared afterwards, text by text
        met = scanned.select("_th", F.explode("_found").alias("_f")).join(grams, F.col("_f.h") == F.col("hash"))
        met = settle(met.select("_th", F.struct("item_id", F.col("_f.at").alias("at"), F.col("_f.len").alias("len"), "window").alias("_m")).groupBy("_th").agg(F.collect_set("_m").alias("_met")), "met")
        texts = keyed.join(met.select("_th"), "_th", "left_semi").groupBy("_th").agg(F.first("text").alias("text"))
        sure = F.col("_met"), words(F.col("text"))
        checked = let(sure[1], lambda ws: F.filter(sure[0], lambda m: _window(ws, m) == m["window"]))
        verified = met.join(texts, "_th").select("_th", F.explode(checked).alias("_m")).select("_th", "_m.item_id", "_m.at", "_m.len")
    per_text = verified.groupBy("_th").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"),
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("len") - 1).alias("end")))).alias("_raw"),
    )
    # merge sorted spans: a span that starts inside the last one, or right after it, extends it
    merged = F.aggregate(
        "_raw",
        F.array().cast(SPANS),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"] - 1),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return per_text.select(F.col("_th").alias("_th2"), "_items", merged.alias("_spans"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: doc_id, text, n_words, n_hit, items (sorted item_ids as strings), spans
    (array of start, end: hit words, counted from 1, merged)."""
    base = _keyed(docs.select("doc_id", "text"))
    n_words = F.size(words(F.col("text"))).cast("long").alias("n_words")
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast(SPANS)
    per_text = contaminated_texts(base, benchmark, n)
    if per_text is None:
        return base.select("doc_id", "text", n_words, F.lit(0).cast("long").alias("n_hit"), no_items.alias("items"), no_spans.alias("spans"))
    plain = base.select("doc_id", "text", "_th", _salt(F.col("doc_id")), n_words)
    out = plain.join(_salted(per_text), (F.col("_th") == F.col("_th2")) & (F.col("_salt") == F.col("_salt2")), "left")
    n_hit = F.aggregate(F.coalesce("_spans", no_spans), F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"] + 1))
    return out.select("doc_id", "text", "n_words", n_hit.alias("n_hit"), F.coalesce("_items", no_items).alias("items"), F.coalesce("_spans", no_spans).alias("spans"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without any hit, their columns unchanged; equal texts share their fate.

    The hashes of contaminated texts are broadcast while there are at most BROADCAST_TEXTS of them; more are
    joined over salted keys.
    """
    found = contaminated_texts(_keyed(docs.select("doc_id", "text")), benchmark, n)
    if found is None:
        return docs
    bad = settle(found.select(F.col("_th2").alias("_bad")), "contaminated")
    keyed, same = packed(docs, _th=_text_hash(), _salt=_salt(F.col("doc_id"))), F.col("_th") == F.col("_bad")
    if bad.count() <= BROADCAST_TEXTS:
        return keyed.join(F.broadcast(bad), same, "left_anti").select("row.*")
    return keyed.join(_salted(bad), same & (F.col("_salt") == F.col("_salt2")), "left_anti").select("row.*")


def cut_spans(hit: DataFrame) -> DataFrame:
    """doc_id, text with every hit word and what stands between hit words of one span removed.

    Texts without hits are unchanged; cut texts are the remaining pieces, each as it was written.
    """
    # pieces: each word, in either case, with the break after it; text before the first word stays
    gap = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
    lead = F.regexp_extract("text", f"^[{gap}]*", 0)
    pieces = F.regexp_extract_all("text", F.lit(f"[^{gap}]+[{gap}]*"), 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists("spans", lambda s: (i + 1 >= s["start"]) & (i + 1 <= s["end"])))
    return hit.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(lead, F.array_join(kept, ""))).alias("text"))
