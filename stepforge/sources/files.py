"""Readers of file trees and of columnar episode repositories."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def find_builder(spark: SparkSession, root: str, marker: str = "dataset_info.json") -> str:
    """``root`` if it holds the marker file, else its last child by name that does; an error if there is none."""
    fs, p = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(path(p, marker)):
        return root
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and fs.exists(path(s.getPath(), marker)))
    if not names:
        raise FileNotFoundError(f"no {marker} under {root}")
    return f"{root.rstrip('/')}/{names[-1]}"


def list_files(spark: SparkSession, root: str, pattern: str = "*", pruned: str = r"/(\.[^/]*|[^/]*_bak)/") -> DataFrame:
    """(path, n_bytes, modified) of the files under ``root`` by name pattern, without pruned folders. Contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return df.select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(pruned))


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, broken ones are rows of nulls."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def lerobot(spark: SparkSession, root: str, episode_schema: StructType | str, episodes: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Frames and episodes of a columnar repository (data/**.parquet, meta/episodes.jsonl).

    With ``episodes`` only so many are kept, those first in a seeded order of their index; that limit is the
    feature. Frames of other episodes are left out by a semi join.
    """
    meta = jsonl(spark, f"{root}/meta/episodes.jsonl", episode_schema)
    frames = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
    if episodes is None:
        return frames, meta
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("episode_index").cast("string")))
    chosen = meta.orderBy(order, "episode_index").limit(episodes)
    return frames.join(chosen.select("episode_index"), "episode_index", "left_semi"), chosen


def lerobots(spark: SparkSession, roots: Mapping[str, str], episode_schema: StructType | str, episodes: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Frames and episodes of several repositories with the column ``repo``; a limit counts for each of them."""
    frames = meta = None
    for name, root in roots.items():
        f, m = (df.withColumn("repo", F.lit(name)) for df in lerobot(spark, root, episode_schema, episodes, seed))
        frames = f if frames is None else frames.unionByName(f, allowMissingColumns=True)
        meta = m if meta is None else meta.unionByName(m)
    if frames is None:
        raise ValueError("no repositories")
    return frames, meta


def pick_camera(columns: Sequence[str]) -> list[str]:
    """Camera columns to read: the joined view, else the three views, else the main one, else the first by name."""
    views = sorted(c for c in columns if "image" in c or "cam" in c)
    joined = [c for c in views if c.endswith("cam_concatenated")]
    three = [c for w in ("cam_high", "cam_left_wrist", "cam_right_wrist") for c in views if c.endswith(w)]
    main = [c for w in ("main", "image", ".image") for c in views if c.endswith(w)]
    return joined[:1] or (three if len(three) == 3 else []) or main[:1] or views[:1]


#: Turns a file's bytes into (values, width); the readers of tensor and archive formats are given by the caller.
Decoder = Callable[[bytes], "tuple[list[list[float]], int]"]


def decoded(spark: SparkSession, root: str, pattern: str, decode: Decoder) -> DataFrame:
    """(path, t, values, error): one row per step of each decoded file; a broken file gives one row with its error,
    an empty one none.

    Files are read by tasks, in Arrow batches; formats whose libraries aren't installed need only ``decode``.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, content in zip(p["path"], p["content"], strict=True):
                try:
                    values, _ = decode(bytes(content))
                    out += [(path, t, [float(x) for x in v], None) for t, v in enumerate(values)]
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=["path", "t", "values", "error"])
            frame["t"] = frame["t"].astype("Int32")
            yield frame

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.select("path", "content").mapInPandas(rows, "path string, t int, values array<float>, error string")
