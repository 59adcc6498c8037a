"""Readers and writers by round trips: tables are written in the shared folder, read back and compared with where they came from."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge import config
from stepforge.plans.common import EPISODES, STEPS, episodes, steps
from stepforge.registry import query
from stepforge.session import work_folder
from stepforge.sinks import episodes as K
from stepforge.sources import files as S
from stepforge.sources import records as R
from stepforge.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    """A folder that Python's file functions reach as well."""
    return work_folder(spark, name).removeprefix("file:").replace("//", "/")


@query("rlds_builder_resolve", "SELECT '1.10.0' AS first, '1.2.0' AS last")
def rlds_builder_resolve(spark: SparkSession, root: str) -> DataFrame:
    """The builder folder itself if it is one, else the last version by name."""
    base = _folder(spark, "builder")
    for version in ("1.10.0", "1.2.0", "1.9"):
        os.makedirs(f"{base}/{version}")
    for version in ("1.10.0", "1.2.0"):
        with open(f"{base}/{version}/dataset_info.json", "w") as file:
            file.write("{}")
    own, last = S.find_builder(spark, f"{base}/1.10.0"), S.find_builder(spark, base)
    return spark.createDataFrame([(own.rsplit("/", 1)[1], last.rsplit("/", 1)[1])], "first string, last string")


#: Most steps of a record.
RECORD_STEPS = 4096


def _encoded(row: dict) -> R.Features:
    read = [q for q in row["q"] if q["qpos"] is not None]
    return {
        "episode": [row["ep_key"]], "dataset": [row["dataset"] or ""], "step": [q["t"] for q in read],
        "width": [len(q["qpos"]) for q in read], "qpos": [float(x) for q in read for x in q["qpos"]],
    }


def _decoded(features: R.Features) -> dict:
    rows, at = [], 0
    for width in features["width"]:
        rows.append(features["qpos"][at : at + width])
        at += width
    return {"ep_key": features["episode"][0], "dataset": features["dataset"][0].decode() or None, "t": features["step"], "qpos": rows}


@query(
    "rlds_scan",
    f"WITH {STEPS} SELECT ep_key, dataset, t, list_transform(qpos, lambda x: x::DOUBLE + 0.0) AS qpos FROM st WHERE qpos IS NOT NULL",
)
def rlds_scan(spark: SparkSession, root: str) -> DataFrame:
    """The steps of episodes that were written as record files of a builder; every reading comes back."""
    # A record holds at most RECORD_STEPS steps, so a long recording is several records.
    part = F.floor(F.col("t") / RECORD_STEPS)
    whole = steps(spark, root, "dataset", "qpos").groupBy("ep_key", "dataset", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("t", "qpos"))).alias("q"))
    base = _folder(spark, "rlds")
    R.write_builder(whole, f"{base}/1.0.0", "arm", "train", _encoded, 4)
    found = R.rlds(spark, base, "train", _decoded, "ep_key bigint, dataset string, t array<int>, qpos array<array<double>>")
    long = R.exploded_steps(found, ["t", "qpos"])
    return long.select("ep_key", "dataset", "t", F.transform("qpos", lambda x: x + F.lit(0.0)).alias("qpos"))


@query(
    "lerobot_scan",
    f"""WITH {EPISODES}, {STEPS}, f AS (SELECT ep_key, count(*) AS n_frames, count(qpos) AS n_states FROM st GROUP BY ep_key)
    SELECT CASE WHEN has_video THEN 'a' ELSE 'b' END AS repo, ep_key AS episode_index, n_steps AS length, n_frames, n_states FROM ep JOIN f USING (ep_key) WHERE has_video IS NOT NULL""",
)
def lerobot_scan(spark: SparkSession, root: str) -> DataFrame:
    """Frames and episode list of two columnar repositories, read as one."""
    eps = episodes(spark, root, "n_steps", "has_video")
    frames = steps(spark, root, "qpos").select(F.col("ep_key").alias("episode_index"), F.col("t").alias("frame_index"), F.col("qpos").alias("action"))
    roots = {}
    for name, mine in (("a", eps.where("has_video")), ("b", eps.where("NOT has_video"))):
        base = roots[name] = work_folder(spark, "repo")
        listed = mine.select(F.col("ep_key").alias("episode_index"), F.col("n_steps").alias("length"))
        listed.write.json(f"{base}/meta/episodes.jsonl")
        frames.join(listed.select("episode_index"), "episode_index", "left_semi").write.parquet(f"{base}/data/chunk-000")
    found, meta = S.lerobots(spark, roots, "episode_index bigint, length int")
    counts = found.groupBy("repo", "episode_index").agg(F.count(F.lit(1)).alias("n_frames"), F.count("action").alias("n_states"))
    return meta.join(counts, ["repo", "episode_index"]).select("repo", "episode_index", "length", "n_frames", "n_states")


@query("jsonl_scan", f"WITH {EPISODES} SELECT ep_key, instruction, n_steps FROM ep")
def jsonl_scan(spark: SparkSession, root: str) -> DataFrame:
    """JSON lines between blank ones."""
    path = work_folder(spark, "lines")
    line = F.to_json(F.struct("ep_key", "instruction", "n_steps"))
    episodes(spark, root, "instruction", "n_steps").select(F.explode(F.array(line, F.lit(""), F.lit("  "))).alias("value")).write.text(path)
    return S.jsonl(spark, path, "ep_key bigint, instruction string, n_steps int")


@query(
    "yaml_config",
    "SELECT dataset, coalesce(fps, 10) AS fps, 64 AS t5_max_length, coalesce(unknown_task_name, 'unknown_task') AS unknown_task_name FROM convert_config",
)
def yaml_config(spark: SparkSession, root: str) -> DataFrame:
    """Settings of each dataset: the command line over a file over defaults."""
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class Settings:
        fps: int = 10
        t5_max_length: int = 512
        unknown_task_name: str = "unknown_task"

    rows = []
    for r in table(spark, root, "convert_config", "dataset", "fps", "t5_max_length", "unknown_task_name").collect():
        path = _folder(spark, "settings") + ".json"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as file:
            json.dump({k: v for k, v in r.asDict().items() if k != "dataset"}, file)
        s = config.build(Settings(), path, {"t5_max_length": 64})
        rows.append((r.dataset, s.fps, s.t5_max_length, s.unknown_task_name))
    return spark.createDataFrame(rows, "dataset string, fps int, t5_max_length int, unknown_task_name string")


@query(
    "partitioned_episode_sink",
    f"WITH {EPISODES} SELECT split, task_slug, ep_key, n_steps FROM ep",
)
def partitioned_episode_sink(spark: SparkSession, root: str) -> DataFrame:
    """Episodes written by split and task, one split written again, and read back: each once."""
    path = work_folder(spark, "episodes")
    df = episodes(spark, root, "split", "task_slug", "n_steps")
    K.write_episodes(df, path)
    K.write_episodes(df.where("split = 'train'"), path, overwrite=True)
    return spark.read.schema("ep_key bigint, n_steps int, split string, task_slug string").parquet(path).select("split", "task_slug", "ep_key", "n_steps")


@query(
    "failure_log",
    f"""WITH {EPISODES}, e AS (SELECT ep_key, CASE WHEN n_steps IS NULL THEN 'no length' WHEN trim(coalesce(instruction, '')) = '' THEN 'no instruction' END AS error FROM ep)
    SELECT ep_key, error, (SELECT count(*) FROM e WHERE error IS NULL) AS n_written FROM e WHERE error IS NOT NULL""",
)
def failure_log(spark: SparkSession, root: str) -> DataFrame:
    """Episodes that failed with their reason, and how many were written."""
    df = episodes(spark, root, "instruction", "n_steps")
    error = F.when(F.col("n_steps").isNull(), "no length").when(F.trim(F.coalesce("instruction", F.lit(""))) == "", "no instruction")
    good, bad = K.split_failures(df.select("ep_key", error.alias("error")))
    return bad.select("ep_key", "error", F.lit(good.count()).alias("n_written"))


@query("episode_cache", f"WITH {EPISODES} SELECT ep_key, dataset, n_steps FROM ep")
def episode_cache(spark: SparkSession, root: str) -> DataFrame:
    """A scan result that is kept: the second reader doesn't make it again."""
    path = work_folder(spark, "cache")
    K.stored(spark, path, lambda: episodes(spark, root, "dataset", "n_steps"))

    def again() -> DataFrame:
        raise AssertionError("the stored table was there")

    return K.stored(spark, path, again)


@query("feature_registry_update", "SELECT names AS name, 'float32' AS dtype, target_action_dim AS width FROM multi_dataset")
def feature_registry_update(spark: SparkSession, root: str) -> DataFrame:
    """An entry per source in a registry file; entries that are written again are replaced."""
    path = work_folder(spark, "info") + ".json"
    sources = table(spark, root, "multi_dataset", "names", "target_action_dim").collect()
    for width in (1, None):
        for r in sources:
            K.update_registry(spark, path, r.names, {"dtype": "float32", "shape": [width or r.target_action_dim]})
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "features map<string, struct<dtype: string, shape: array<int>>>")["features"])
    return text.select(entries.alias("name", "f")).select("name", "f.dtype", F.col("f.shape")[0].alias("width"))


@query(
    "jsonl_upsert_atomic",
    f"WITH {EPISODES} SELECT ep_key, n_steps, CASE WHEN dataset = 'bridge' THEN 'vectors/' || ep_key || '.pt' END AS vector FROM ep",
)
def jsonl_upsert_atomic(spark: SparkSession, root: str) -> DataFrame:
    """A list of JSON lines, some of which get a new value; the list is replaced as a whole, and new keys aren't added."""
    path = work_folder(spark, "list")
    df = episodes(spark, root, "dataset", "n_steps")
    df.select("ep_key", "n_steps", F.lit(None).cast("string").alias("vector")).write.option("ignoreNullFields", "false").json(path)
    new = df.where("dataset = 'bridge'").select("ep_key", F.format_string("vectors/%d.pt", "ep_key").alias("vector"))
    extra = spark.createDataFrame([(-1, "vectors/none.pt")], "ep_key bigint, vector string")
    schema = "ep_key bigint, n_steps int, vector string"
    K.upsert_jsonl(spark, path, schema, new.unionByName(extra), ["ep_key"], ["vector"])
    K.upsert_jsonl(spark, path, schema, extra, ["ep_key"], ["vector"])
    return S.jsonl(spark, path, schema)


_CAMERAS = {
    "joined": ["observation.images.cam_high", "observation.images.cam_concatenated", "action"],
    "three": ["observation.images.cam_right_wrist", "observation.images.cam_high", "observation.images.cam_left_wrist", "image"],
    "main": ["observation.images.side", "observation.images.main"],
    "first": ["observation.images.top", "observation.images.side"],
    "none": ["action", "state"],
}


@query(
    "schema_feature_pick",
    """SELECT * FROM (VALUES ('joined', 'observation.images.cam_concatenated'), ('three', 'observation.images.cam_high,observation.images.cam_left_wrist,observation.images.cam_right_wrist'),
    ('main', 'observation.images.main'), ('first', 'observation.images.side'), ('none', '')) v(name, picked)""",
)
def schema_feature_pick(spark: SparkSession, root: str) -> DataFrame:
    """The camera columns to read of tables with different columns."""
    return spark.createDataFrame([(n, ",".join(S.pick_camera(c))) for n, c in _CAMERAS.items()], "name string, picked string")
