"""Writers of episode tables and of their metadata."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.operators.catalog import patch
from stepforge.sources.files import jsonl


def write_episodes(df: DataFrame, path: str, partition: Sequence[str] = ("split", "task_slug"), overwrite: bool = False, rows: int = 1_000_000) -> None:
    """Parquet by partition. Rows of a partition are spread by hash over files of about ``rows`` rows, so that a task that
    a third of all rows belong to isn't one writer's work. With ``overwrite`` only the partitions in ``df`` are replaced."""
    spark = df.sparkSession
    writer = df.write.partitionBy(*partition).option("maxRecordsPerFile", rows)
    if not overwrite:
        writer.mode("append").parquet(path)
        return
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "dynamic")
        writer.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(key, before)


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that worked, without the error column, and rows that failed."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def update_registry(spark: SparkSession, path: str, name: str, feature: Mapping[str, object]) -> None:
    """Add or replace one entry of ``features`` in a JSON file, by a temporary file that takes its place."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()) if fs.exists(p) else "{}"
    info = json.loads(text)
    info.setdefault("features", {})[name] = dict(feature)
    temporary = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(json.dumps(info, indent=2).encode()))
    finally:
        stream.close()
    # One step: a reader sees the old file or the new one.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(fs.makeQualified(temporary), fs.makeQualified(p), options)


def upsert_jsonl(spark: SparkSession, path: str, schema: str, new: DataFrame, key: Sequence[str], values: Sequence[str]) -> bool:
    """Rewrite a folder of JSON lines with the values that ``new`` has for its keys; False, and nothing written, if none of them is there.

    The new lines are written beside the old ones and take their place by renaming, so a writer that dies leaves the
    old list or, between the two renames, its copy under ``.old``, from which the next call starts.
    """
    jvm = spark._jvm
    path_of = jvm.org.apache.hadoop.fs.Path
    target, kept, staged = path_of(path), path_of(path + ".old"), path_of(path + ".new")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(kept):
        fs.rename(kept, target)
    old = jsonl(spark, path, schema)
    if old.join(new.select(*key), list(key), "left_semi").isEmpty():
        return False
    patch(old, new, key, values).write.mode("overwrite").option("ignoreNullFields", "false").json(staged.toString())
    fs.delete(kept, True)
    if not (fs.rename(target, kept) and fs.rename(staged, target)):
        raise RuntimeError(f"{path} could not be replaced")
    fs.delete(kept, True)
    return True


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path``, made and written there first if it isn't complete yet (or with ``refresh``).

    A write that was broken off leaves no success marker and is made again.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if refresh or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
