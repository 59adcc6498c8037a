"""Consolidation of many small files into few well-sized ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.operators.prefix import id_block, running_total

#: Wanted bytes of an output file, and the bytes that opening one input costs.
TARGET_BYTES = 128 << 20
OPEN_COST = 4 << 10


def latest_listing(files: DataFrame, temporary: str) -> DataFrame:
    """One row per finished file: the listing with the latest modified_ts, then the smallest file_id.

    Files whose path matches the pattern ``temporary`` are unfinished and left out, as are rows
    without a path.
    """
    names = [c for c in files.columns if c != "file_path"]
    best = F.max_by(F.struct(*names), F.struct(F.col("modified_ts"), -F.col("file_id")))
    return (
        files.where(F.col("file_path").isNotNull() & ~F.col("file_path").rlike(temporary))
        .groupBy("file_path")
        .agg(best.alias("_best"))
        .select("file_path", "_best.*")
    )


def padded_bytes(n_bytes: Column, open_cost: int) -> Column:
    return F.coalesce(n_bytes, F.lit(0)).cast("bigint") + F.lit(open_cost).cast("bigint")


def pack_splits(
    files: DataFrame, group: list[str], target_bytes: int = TARGET_BYTES, open_cost: int = OPEN_COST
) -> DataFrame:
    """Assign each file of ``files`` (unique file_id, n_bytes) to one output file of its group; adds ``bin_no``.

    This is the packing of the engine's combined splits, made for groups of any size: in id
    order a file's padded size (bytes and ``open_cost``, which bounds the inputs of one output)
    is added up per group, and a bin is closed each time the total passes the room. Files of
    an eighth of the target or more would stay as they are: each gets a bin of its own, numbered
    -1 - file_id. The rest shares bins whose room is an eighth below the target, so that a bin's
    padded size never passes ``target_bytes``.

    Null n_bytes counts as 0. Null group values form a group. No files give no rows.
    """
    room = target_bytes - target_bytes // 8
    sized = files.withColumn("_padded", padded_bytes(F.col("n_bytes"), open_cost))
    large = F.col("_padded") > target_bytes // 8
    small = running_total(
        sized.where(~large), group, id_block("file_id"), [F.col("file_id")], "_padded", "_start"
    ).withColumn("bin_no", F.floor(F.col("_start") / room).cast("bigint"))
    alone = sized.where(large).withColumn("bin_no", (-1 - F.col("file_id")).cast("bigint"))
    return small.drop("_start", "_padded").unionByName(alone.drop("_padded"))


def compact_parquet(
    spark: SparkSession, source: str, target: str, target_bytes: int = TARGET_BYTES, open_cost: int = OPEN_COST
) -> dict[str, int]:
    """Rewrite the Parquet files under ``source`` as few files under ``target``; return counts.

    The reader packs small files into combined splits of ``target_bytes`` at ``open_cost`` per
    file; every split is one output file, without a shuffle. Output is written to a staging
    folder beside ``target``, compared with the input (row count and an order-free checksum of
    all columns), and only then renamed, so that a lost executor or a failed check never leaves
    a partial result. The target must not exist. Settings of the session are restored.
    """
    keys = {
        "spark.sql.files.maxPartitionBytes": str(target_bytes),
        "spark.sql.files.openCostInBytes": str(open_cost),
        "spark.sql.files.minPartitionNum": "1",
        "spark.sql.leafNodeDefaultParallelism": "1",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(target)):
        raise FileExistsError(target)
    staged = f"{target.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        data = spark.read.parquet(source)
        data.write.parquet(staged)
        result = spark.read.parquet(staged)
        copied, n_out = _checked(result)
        before_copy, n_in = _checked(data)
        if before_copy != copied:
            raise RuntimeError(f"the copy of {source} differs from it")
        if not fs.rename(path(staged), path(target)):
            raise RuntimeError(f"{target} could not be published")
        return {"files_in": n_in, "files_out": n_out, "rows": copied[0]}
    finally:
        if fs.exists(path(staged)):
            fs.delete(path(staged), True)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _checked(df: DataFrame) -> tuple[tuple[int, int, int], int]:
    """The fingerprint of the rows and the number of files with rows; paths are counted by tasks and never come to the driver."""
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.input_file_name().alias("_file"))
    digests = named.select("_file", F.xxhash64("_row").alias("a"), F.hash("_row").cast("bigint").alias("b"))
    # One row per file after the map side, then one in all.
    by_file = digests.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b"))
    row = by_file.agg(F.sum("n"), F.sum("a"), F.sum("b"), F.count(F.lit(1))).first()
    return (int(row[0] or 0), int(row[1] or 0), int(row[2] or 0)), int(row[3])


def fingerprint(df: DataFrame) -> tuple[int, int, int]:
    """Rows and two order-free sums of row hashes; equal for equal bags of rows."""
    return _checked(df)[0]
