"""Readers for the stored forms of experiment data. Schemas are given, never inferred."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.sources import schemas


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, *, strict: bool = True) -> DataFrame:
    """Line-delimited JSON; blank lines are skipped. Strict: a broken line fails; else it comes out in ``_corrupt_record``."""
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if strict:
        return spark.read.schema(s).option("mode", "FAILFAST").json(path)
    s = T.StructType([*s.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def blank_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files with blank lines, for formats that forbid them: file, blank_lines."""
    t = spark.read.text(path).filter(F.trim("value") == "")
    return t.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("blank_lines"))


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines, without parsing them."""
    return spark.read.text(path).filter(F.trim("value") != "").count()


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv_same_header(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV files that must share one header; all columns as strings, in file order of the first."""
    heads = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    first = heads.groupBy("f").agg(F.min_by("value", "i").alias("header")).select("header").distinct().limit(2).collect()
    if len(first) > 1:
        raise ValueError("the files have different headers")
    return spark.read.option("header", True).option("enforceSchema", False).csv(list(paths))


def read_waypoint_summary(spark: SparkSession, path: str) -> DataFrame:
    """The episodes of waypoint summaries, a row each; a document without the required keys fails."""
    d = read_document(spark, path, schemas.WAYPOINT_SUMMARY)
    ok = F.col("source_trajectory_records_path").isNotNull() & F.col("episodes").isNotNull()
    e = F.when(ok, F.col("episodes")).otherwise(F.raise_error(F.lit("not a waypoint summary")))
    return d.select("source_trajectory_records_path", F.explode(e).alias("e")).select("source_trajectory_records_path", "e.*")


def inventory(spark: SparkSession, folder: str, *, glob: str = "*") -> DataFrame:
    """path and size of all files below a folder, caches left out; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return f.select("path", F.col("length").alias("size")).filter(~F.col("path").rlike(r"/\.cache/"))


def find_shards(spark: SparkSession, folder: str, layer: int, suffix: str = "npz") -> DataFrame:
    return inventory(spark, folder, glob=f"layer_{layer:02d}_shard_*.{suffix}").distinct()


def read_npz(spark: SparkSession, folder: str, array: str, *, glob: str = "*.npz") -> DataFrame:
    """Rows of a 2-D array in NPZ bundles: path, row_idx, values. Each file is decoded by one task, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)[array]
                a = a.reshape(len(a), -1).astype("float64")
                for at in range(0, len(a), 4096):
                    part = a[at : at + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1] or 1, dtype="int32")[: len(part) + 1]), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), lists], names=["path", "row_idx", "values"])

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return f.select("path", "content").mapInArrow(run, "path string, row_idx long, values array<double>")


def npz_shapes(spark: SparkSession, folder: str, *, glob: str = "*.npz") -> DataFrame:
    """path, array, shape of every array in NPZ bundles, from the headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            version = np.lib.format.read_magic(f)
                            shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]
                        out.append({"path": path, "array": re.sub(r"\.npy$", "", name), "shape": list(shape)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("array", pa.string()), ("shape", pa.list_(pa.int64()))]))

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return f.select("path", "content").mapInArrow(run, "path string, array string, shape array<long>")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a sparse-activation manifest, a row each; other formats than the known one fail."""
    d = read_document(spark, path, schemas.MANIFEST)
    ok = F.when(F.col("format") == schemas.SPARSE_FORMAT, F.col("shards")).otherwise(F.raise_error(F.concat(F.lit("unknown format "), F.coalesce("format", F.lit("null")))))
    return d.select(F.explode(ok).alias("s")).select("s.*")


def first_video(files: DataFrame) -> DataFrame:
    """episode_num and the first path, in order, of the files named for it by either of two patterns."""
    n = F.coalesce(F.nullif(F.regexp_extract("path", r"episode=(\d+)--", 1), F.lit("")), F.nullif(F.regexp_extract("path", r"episode_(\d+)[^/]*\.mp4$", 1), F.lit("")))
    return files.withColumn("episode_num", n.cast("int")).filter(F.col("episode_num").isNotNull()).groupBy("episode_num").agg(F.min("path").alias("path"))


def read_jsonl_numbered(spark: SparkSession, path: str, schema: str, *, blank_is_error: bool = False) -> DataFrame:
    """Line-delimited JSON with ``file`` and ``line`` (from 1), and ``error``: ``blank_line``, ``broken``, or null.

    A file is one row until it is cut into lines, so that lines can be numbered;
    files of this form are records of single runs. Blank lines are left out, or errors.
    """
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n", -1)).alias("i", "text"), F.size(F.split("value", "\r?\n", -1)).alias("n"))
    t = t.filter(~((F.col("i") == F.col("n") - 1) & (F.col("text") == "")))  # after the last line's end
    blank = F.trim("text") == ""
    good = F.from_json("text", schema, {"mode": "PERMISSIVE"})
    error = F.when(blank, "blank_line").when(F.try_parse_json("text").isNull() | good.isNull(), "broken")
    rows = t.select("file", (F.col("i") + 1).alias("line"), blank.alias("blank"), error.alias("error"), good.alias("r"))
    return (rows if blank_is_error else rows.filter(~F.col("blank"))).select("file", "line", "error", "r.*")


def read_sparse_run(spark: SparkSession, folder: str, schema: str = schemas.TOPK) -> DataFrame:
    """All rows of a run's sparse shards, in either layout: the manifest lies in the folder itself or in ``sae_activations/<part>``.

    Shards are parquet files named by the manifest, relative to the manifest or
    to the run; a shard that is missing fails, as does an unknown format.
    """
    found = inventory(spark, folder, glob="manifest.json").select("path").filter(F.col("path").rlike(r"(^|/)([^/]+/)?manifest\.json$"))
    paths = sorted((r.path for r in found.limit(10_000).collect()), key=lambda p: (p.count("/"), p))  # one manifest a run
    if not paths:
        raise FileNotFoundError(f"no manifest below {folder}")
    base = paths[0].rsplit("/", 1)[0]
    names = [r.path for r in read_manifest(spark, paths[0]).select("path").collect()]  # the list of a run's files
    have = {r.path for r in inventory(spark, folder, glob="*.parquet").select("path").collect()}
    root = paths[0][: paths[0].index(folder.rstrip("/")) + len(folder.rstrip("/"))]
    files = [next((c for c in (f"{base}/{n}", f"{root}/{n}") if c in have), None) or f"{base}/{n}" for n in names]
    missing = [f for f in files if f not in have]
    if missing:
        raise FileNotFoundError(f"{len(missing)} shards are missing, the first is {missing[0]}")
    return spark.read.schema(schema).parquet(*files)


def npz_headers(spark: SparkSession, folder: str, *, glob: str = "*.npz") -> DataFrame:
    """Like :func:`npz_shapes`, without reading array data: a task opens each file on the shared file system and reads its directory and headers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile
        from urllib.parse import unquote, urlparse

        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                with zipfile.ZipFile(unquote(urlparse(path).path)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            version = np.lib.format.read_magic(f)
                            shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]
                        out.append({"path": path, "array": re.sub(r"\.npy$", "", name), "shape": list(shape)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("array", pa.string()), ("shape", pa.list_(pa.int64()))]))

    return inventory(spark, folder, glob=glob).select("path").mapInArrow(run, "path string, array string, shape array<long>")
