"""Files that keep arriving: a file stream fingerprinted into the cache, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinreel.operators.cache import Cache
from twinreel.sources.decoders import fingerprint


def entries(files: DataFrame, kf_interval: float = 0.0, min_kf_samples: float = 0.0) -> DataFrame:
    """Cache entries of files(path, modificationTime, length, content): how many samples each has and its frames, or why it has none."""
    frames = fingerprint(files)
    others = [c for c in frames.columns if c != "path"]
    per = frames.groupBy("path").agg(
        F.count_if(F.coalesce("valid", F.lit(False))).alias("samples"), F.coalesce(F.max("duration"), F.lit(0.0)).alias("duration"), F.max("problem").alias("problem"),
        F.collect_list(F.struct(*others)).alias("frames"),
    )
    stamp = files.select(
        "path", F.unix_seconds("modificationTime").alias("mtime"), (F.unix_micros("modificationTime") % 1_000_000 * 1000).alias("mtime_nsec"), F.col("length").alias("size"),
        F.lit(float(kf_interval)).alias("kf_interval"), F.lit(float(min_kf_samples)).alias("min_kf_samples"),
    )
    return stamp.join(per, "path").withColumn("kind", F.when(F.col("problem").isNull(), "media").otherwise("refused"))


def frames_of(cached: DataFrame) -> DataFrame:
    """The frames of cache entries, as they were decoded."""
    return cached.select("path", F.explode("frames").alias("frame")).select("path", "frame.*")


def watch(spark: SparkSession, folder: str, cache: Cache, checkpoint: str, glob: str = "*", once: bool = False) -> StreamingQuery:
    """Fingerprint the files that appear in a folder; an entry replaces the one of the same path, so a repeated batch does no harm."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)

    def batch(rows: DataFrame, _: int) -> None:
        cache.upsert(entries(rows))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
