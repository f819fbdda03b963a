"""Writers: sharded, resumable and append sinks. Spark's committer publishes a folder as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.runtime import cut


def write_jsonl(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_shards(df: DataFrame, path: str, rows_per_file: int, *, together: Sequence[str] = ()) -> None:
    """Parquet files of at most ``rows_per_file`` rows; rows equal in ``together`` go to one task."""
    d = df.repartition(*together) if together else df
    d.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_missing(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append only rows whose keys the target does not hold yet, so that a repeated call adds nothing; returns what was new."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    new = df.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti") if fs.exists(p(path)) else df
    new = cut(new)
    new.write.mode("append").parquet(path)
    return new


def as_map_document(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Nested JSON text: outer key to inner key to value. One row per outer key; inner keys of one outer key share a row."""
    outer, inner = keys
    return df.groupBy(outer).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(inner).cast("string"), F.col(value)))))).alias("document"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda x: jvm.org.apache.hadoop.fs.Path(x)


def publish(spark: SparkSession, path: str, write: Callable[[str], None], *, replace: bool = False) -> None:
    """A folder that appears as a whole or not at all: ``write`` fills a neighbour, which then takes its name.

    An error leaves what was there. An existing folder is an error unless it may be replaced.
    """
    fs, p = _fs(spark, path)
    if fs.exists(p(path)) and not replace:
        raise FileExistsError(path)
    tmp, old = f"{path}.tmp-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        write(tmp)
        had = fs.exists(p(path))
        if had:
            fs.rename(p(path), p(old))
        if not fs.rename(p(tmp), p(path)):
            if had:
                fs.rename(p(old), p(path))
            raise OSError(f"{tmp} could not become {path}")
        fs.delete(p(old), True)
    finally:
        fs.delete(p(tmp), True)


def write_aligned(frames: dict[str, DataFrame], path: str, keys: Sequence[str]) -> DataFrame:
    """Several streams of the same records, a folder each, published together with a manifest; returns the manifest.

    All streams must hold the same keys, each once; otherwise nothing is written.
    """
    spark = next(iter(frames.values())).sparkSession
    kept = {n: cut(df) for n, df in frames.items()}
    counts = [df.select(*keys, F.lit(n).alias("stream")) for n, df in kept.items()]
    together = counts[0]
    for c in counts[1:]:
        together = together.unionByName(c)
    bad = together.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("stream").alias("s")).filter((F.col("n") != len(frames)) | (F.col("s") != len(frames)))
    if not bad.isEmpty():
        raise ValueError(f"the streams are not aligned, first at {bad.first()}")
    manifest = spark.createDataFrame([(n, df.count(), "complete") for n, df in kept.items()], "stream string, num_rows long, status string")

    def write(tmp: str) -> None:
        for n, df in kept.items():
            df.write.parquet(f"{tmp}/{n}")
        manifest.coalesce(1).write.json(f"{tmp}/manifest")

    publish(spark, path, write)
    return manifest


def shard_digests(spark: SparkSession, path: str, shard: str, columns: Sequence[str]) -> DataFrame:
    """Per shard: rows and an additive checksum of their values, which no order of rows changes."""
    h = F.xxhash64(*columns)
    return spark.read.parquet(path).groupBy(shard).agg(F.count(F.lit(1)).alias("num_rows"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"))


def resume_shards(df: DataFrame, path: str, shard: str) -> DataFrame:
    """Write the shards that are not there yet, a folder each, and check those that are; returns the names of the new ones.

    A shard that is there with other rows or values than ``df`` has is an error.
    A shard's folder is written as a whole by the committer, so a broken run leaves only whole ones.
    """
    spark = df.sparkSession
    cols = [c for c in df.columns if c != shard]
    fs, p = _fs(spark, path)
    want = df.groupBy(shard).agg(F.count(F.lit(1)).alias("num_rows"), F.sum(F.xxhash64(*cols).bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(F.xxhash64(*cols), 32)).alias("high"))
    new = want.select(shard)
    if fs.exists(p(path)):
        have = shard_digests(spark, path, shard, cols)
        both = want.alias("w").join(have.alias("h"), shard)
        off = both.filter((F.col("w.num_rows") != F.col("h.num_rows")) | (F.col("w.low") != F.col("h.low")) | (F.col("w.high") != F.col("h.high"))).select(shard).limit(1).collect()
        if off:
            raise ValueError(f"shard {off[0][0]} is there with other rows")
        new = want.join(have.select(shard), shard, "left_anti").select(shard)
    new = cut(new)
    df.join(new, shard, "left_semi").repartition(shard).write.mode("append").partitionBy(shard).parquet(path)
    return new


class StepTransaction:
    """Rows of a step are staged, then kept or dropped as a whole; the table holds only committed steps."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.staged = spark, path, None

    def begin(self) -> None:
        if self.staged is not None:
            raise RuntimeError("a step is open")
        self.staged = f"{self.path}.step-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> None:
        if self.staged is None:
            raise RuntimeError("no step is open")
        df.write.mode("append").parquet(self.staged)

    def commit(self) -> None:
        fs, p = _fs(self.spark, self.path)
        if self.staged is None:
            raise RuntimeError("no step is open")
        if fs.exists(p(self.staged)):
            self.spark.read.parquet(self.staged).write.mode("append").parquet(self.path)
        self.abort()

    def abort(self) -> None:
        fs, p = _fs(self.spark, self.path)
        if self.staged is not None:
            fs.delete(p(self.staged), True)
        self.staged = None
