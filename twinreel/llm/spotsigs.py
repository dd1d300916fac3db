"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

A text is lower-cased and cut into runs of letters and digits.  Every common word is an anchor, and so is the
start of the text and every content word that no anchor's chain covers, so signatures see the whole text; a
signature is the anchor and the next two content words, further anchors skipped.
Signatures are kept as sorted distinct 64-bit hashes.  Likeness is the Jaccard
coefficient of two sets; `near_pairs` partitions the sets by length and compares
only pairs whose lengths and rarest signatures allow the threshold.

Defined results: null texts and texts without content words have no signatures; two such texts have
likeness 1 if both are empty of signatures, else 0.  Repeated doc_ids are ordered by
text; rows without a doc_id come first.  Other columns are ignored.  Native DataFrame code only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinreel.llm.common import let

# Common words of English, French, German and Spanish.
COMMON = """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their
there they this to was we were which who will with you
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour que qui sa se
ses son sont sur un une vous
aber als am auch auf aus bei das dem den der des die du ein eine einem einen einer er es für hat ich im ist mit nach nicht
noch sich sie sind so über um und von war wie wir zu zum zur
al como con del el ella ellos era esta este fue la las lo los más mi muy no nos o para pero por que se si sin su sus un una y ya""".split()
CHAIN = 2
#: Content words that one anchor covers; further ones are starts of their own.
GAP = CHAIN
#: Rows that one lead window holds, about.
ROWS_PER_RANGE = 2000
#: The table of ranges is broadcast up to this many rows, else joined by shuffling.
BROADCAST_ROWS = 500_000


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes over the whole length of a text (array of long).

    Every anchor takes the next CHAIN content words however many anchors stand between.  The first content word and
    every one that no anchor's chain covers start a chain with the empty anchor.  So each content word is in a signature.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    common = sorted(set(COMMON))
    # an item for each content word, with the anchors just before it
    marked = F.array_join(F.transform(F.split(plain, " "), lambda w: F.when(w.isin(common), F.concat(w, F.lit("\t"))).otherwise(F.concat(w, F.lit("\n")))), "")
    items = F.filter(F.split(marked, "\n"), lambda x: (x != "") & ~x.endswith("\t"))

    def chains(its: Column) -> Column:
        words = F.transform(its, lambda x: F.substring_index(x, "\t", -1))
        anchors = F.transform(its, lambda x: F.slice(F.split(x, "\t"), 1, F.size(F.split(x, "\t")) - 1))
        return let(words, lambda w: let(anchors, lambda a: F.flatten(F.transform(w, lambda x, i: let(
            F.array_join(F.slice(w, i + 1, CHAIN), " "),
            lambda c: F.transform(F.when(F.exists(F.slice(a, F.greatest(i + 2 - GAP, F.lit(1)), F.least(i + 1, F.lit(GAP))), lambda y: F.size(y) > 0) & (i > 0), F.element_at(a, i + 1)).otherwise(F.array_append(F.element_at(a, i + 1), F.lit(""))), lambda y: F.xxhash64(y, c)),
        )))))

    return F.array_sort(F.array_distinct(let(items, chains)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprint(sigs: Column) -> Column:
    """A string for a signature set: its size and a digest, equal for equal sets only."""
    return F.concat(F.size(sigs).cast("string"), F.lit("-"), F.md5(F.array_join(F.transform(sigs, lambda s: F.hex(s)), " ")))


def _ranges(docs: DataFrame) -> tuple[list[float], int]:
    """Cut points of doc_id and how many equal slices to cut each piece into."""
    n = docs.count()
    pieces = min(64, max(1, n // ROWS_PER_RANGE))
    cuts = docs.select(F.percentile_approx("doc_id", [(i + 1) / pieces for i in range(pieces - 1)], 1000).alias("c")).first()[0] if pieces > 1 else []
    return sorted(set(cuts or [])), max(1, -(-n // (pieces * ROWS_PER_RANGE)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by doc_id, the first's after the last.

    Rows are dealt into ranges of doc_id; the first row of each range is also given to the range
    before it, so no window spans more than one range.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts, each = _ranges(base)
    ends = base.agg(F.min("doc_id"), F.max("doc_id")).first()
    if ends[0] is None:
        return base.withColumn("next_text", F.col("text"))
    edges = [ends[0], *cuts, ends[1] + 1]
    piece = F.lit(0)
    for i, c in enumerate(cuts):
        piece = F.when(F.col("doc_id") >= c, F.lit(i + 1)).otherwise(piece) if i == 0 else F.greatest(piece, F.when(F.col("doc_id") >= c, F.lit(i + 1)).otherwise(0))
    starts, widths = F.array(*[F.lit(e) for e in edges[:-1]]), F.array(*[F.lit(max(1, -(-(b - a) // each))) for a, b in zip(edges, edges[1:])])
    ranged = base.withColumn("_piece", piece).withColumn(
        "_range", F.col("_piece").cast("long") * each + F.least(F.floor((F.col("doc_id") - F.element_at(starts, F.col("_piece") + 1)) / F.element_at(widths, F.col("_piece") + 1)), F.lit(each - 1))
    ).drop("_piece")
    firsts = sorted(ranged.groupBy("_range").agg(F.min("doc_id").alias("d")).collect())
    # a row for each range, with its first doc_id and the range before it: at most rows / ROWS_PER_RANGE or so
    before = [(r["d"], firsts[i - 1]["_range"], i == 0) for i, r in enumerate(firsts)]
    spark = docs.sparkSession
    table = spark.createDataFrame(before, "_first long, _to long, _wraps boolean")
    ghosts = ranged.join(F.broadcast(table) if len(before) <= BROADCAST_ROWS else table, F.col("doc_id") == F.col("_first")).groupBy("_first", "_to", "_wraps").agg(F.min("text").alias("text"))
    all_rows = ranged.select("doc_id", "text", "_range", F.lit(0).alias("_ghost")).unionByName(ghosts.select(F.col("_first").alias("doc_id"), "text", F.col("_to").alias("_range"), F.lit(1).alias("_ghost")))
    order = Window.partitionBy("_range").orderBy("_ghost", "doc_id", "text")
    return all_rows.select("doc_id", "text", "_ghost", "_range", F.lead("text").over(order).alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """The text with its last floor(n/2) characters replaced by the first as many of another text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_text, sigs, edited_sigs, near_edited, near_next for every document."""
    led = with_next(docs)
    order = Window.partitionBy("_range").orderBy("_ghost", "doc_id", "text")
    if "_range" not in led.columns:
        led = led.withColumn("_range", F.lit(0)).withColumn("_ghost", F.lit(0))
    one = led.withColumn("sigs", signatures(F.col("text"))).withColumn("next_sigs", F.lead("sigs").over(order)).where(F.col("_ghost") == 0)
    two = one.withColumn("edited_text", edited(F.col("text"), F.coalesce("next_text", "text"))).withColumn("edited_sigs", signatures(F.col("edited_text")))
    return two.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited_text", "sigs", "edited_sigs", likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.coalesce("next_sigs", "sigs")).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs a < b of signature-set classes with Jaccard >= threshold, and doc_id -> class.

    Documents with equal sets are one class, named by its smallest doc_id.  Classes are dealt into
    length partitions (powers of 1/threshold): a partner's length is in the same partition or a
    neighbouring one.  Within a partition a class is probed by the prefix of its rarest signatures
    that any partner must share, so signatures that are in a large part of the corpus are not keys.
    """
    docs = docs.select("doc_id", signatures(F.col("text")).alias("sigs"))
    members = docs.select("doc_id", F.min("doc_id").over(Window.partitionBy(F.xxhash64("sigs"), F.md5(F.array_join(F.transform("sigs", lambda s: F.hex(s)), " ")))).alias("class"))
    sets = docs.join(members.where(F.col("doc_id") == F.col("class")).select(F.col("class").alias("_c")).distinct(), F.col("doc_id") == F.col("_c")).where(F.size("sigs") > 0).select("doc_id", "sigs").dropDuplicates(["doc_id"])
    tokens = sets.select("doc_id", F.explode("sigs").alias("t"), F.size("sigs").alias("n"))
    freq = tokens.groupBy("t").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    ranked = tokens.join(freq, "t", "left").withColumn("f", F.coalesce("f", F.lit(1)))
    ordered = ranked.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("s"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1
    keyed = ordered.select("doc_id", "n", F.floor(F.log("n") / F.log(F.lit(1 / threshold)) + 1e-9).alias("part"), F.explode(F.slice("s", F.lit(1), prefix)).alias("k")).where(F.col("k.f") > 1).select("doc_id", "n", "part", F.col("k.t").alias("t"))
    left = keyed.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), "t", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = keyed.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), "t", "part")
    able = (F.col("x") != F.col("y")) & (F.col("nx") >= F.col("ny") * threshold) & (F.col("ny") >= F.col("nx") * threshold)
    pairs = left.join(right, ["t", "part"]).where(able).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sa, sb = sets.select(F.col("doc_id").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("sigs").alias("sb"))
    out = pairs.join(sa, "a").join(sb, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)
    return out, members
