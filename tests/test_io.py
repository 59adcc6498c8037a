"""Sources, sinks, hooks and streaming on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from stepforge.config import build, merged
from stepforge.operators.models import caption, embed, stub_captioner, stub_embedder
from stepforge.operators.spikes import SpikeRules
from stepforge.sinks.episodes import split_failures, stored, update_registry, write_episodes
from stepforge.sources.files import decoded, find_builder, jsonl, lerobot, list_files, pick_camera
from stepforge.sources.instructions import instruction_rows
from stepforge.streaming.ingest import ingest_new


def test_builder_and_listing(spark, tmp_path):
    for v in ("0.1.0", "1.0.0", "2.0.0"):
        (tmp_path / v).mkdir()
        if v != "2.0.0":
            (tmp_path / v / "dataset_info.json").write_text("{}")
    assert find_builder(spark, str(tmp_path)).endswith("1.0.0")
    assert find_builder(spark, str(tmp_path / "0.1.0")).endswith("0.1.0")
    (tmp_path / "x_bak").mkdir()
    (tmp_path / "x_bak" / "dataset_info.json").write_text("{}")
    assert list_files(spark, str(tmp_path), "*.json").count() == 2


def test_jsonl_and_lerobot(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "episodes.jsonl").write_text("\n".join([json.dumps({"episode_index": i, "tasks": [f"t{i}"]}) for i in range(6)] + ["", "  ", "{broken"]))
    spark.range(60).select((F.col("id") % 6).alias("episode_index"), F.col("id").alias("frame")).write.parquet(str(tmp_path / "data" / "chunk-000"))
    schema = "episode_index bigint, tasks array<string>"
    assert jsonl(spark, str(tmp_path / "meta/episodes.jsonl"), schema).count() == 7
    frames, meta = lerobot(spark, str(tmp_path), schema)
    assert frames.count() == 60
    frames, meta = lerobot(spark, str(tmp_path), schema, episodes=2)
    assert meta.count() == 2 and frames.count() in (10, 20)


def test_cameras():
    assert pick_camera(["state", "a.cam_high", "a.cam_left_wrist", "a.cam_right_wrist"]) == ["a.cam_high", "a.cam_left_wrist", "a.cam_right_wrist"]
    assert pick_camera(["x.cam_concatenated", "a.cam_high"]) == ["x.cam_concatenated"]
    assert pick_camera(["z.image", "b.camera"]) == ["z.image"] and pick_camera(["state"]) == []


def test_decoded_files_and_failures(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes([1, 2, 3, 4]))
    (tmp_path / "b.bin").write_bytes(b"\x01")

    def decode(content):
        return [[content[i], content[i + 1]] for i in range(0, len(content), 2)], 2

    good, bad = split_failures(decoded(spark, str(tmp_path), "*.bin", decode))
    assert [r["values"] for r in good.orderBy("t").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    assert bad.count() == 1 and "IndexError" in bad.first().error


def test_instruction_shapes(spark):
    rows = [
        (1, '[{"caption": "a"}, {"caption": ["b", 3, "c"]}, "d", 7]'),
        (2, '{"captions": ["e", "e"], "language_instruction_2": "f", "other": "x"}'),
        (3, '{"seen": "g", "caption": null}'),
        (4, "not json"),
        (5, None),
        (6, '"plain"'),
    ]
    df = spark.createDataFrame(rows, "id int, j string")
    got = sorted((r.id, r.text) for r in instruction_rows(df, "id", "j").collect())
    assert got == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "e"), (2, "e"), (2, "f"), (3, "g")]


def test_partitioned_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "split string, task_slug string, v int")
    write_episodes(df, path)
    write_episodes(df.where("split = 'a'").withColumn("v", F.lit(9)), path, overwrite=True)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 9]


def test_registry(spark, tmp_path):
    path = f"file://{tmp_path}/info.json"
    update_registry(spark, path, "a", {"dtype": "float"})
    update_registry(spark, path, "a", {"dtype": "double"})
    update_registry(spark, path, "b", {"shape": [2]})
    assert json.loads((tmp_path / "info.json").read_text()) == {"features": {"a": {"dtype": "double"}, "b": {"shape": [2]}}}


def test_hooks_do_not_depend_on_the_batch_size(spark):
    df = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(9)], "k bigint, s string")
    results = [sorted((r.k, tuple(r.embedding)) for r in embed(df, "k", "s", lambda: stub_embedder, batch=b).collect()) for b in (1, 3, 64)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 9
    windows = spark.createDataFrame([(1, "v.mp4", [0, 2]), (2, "w.mp4", [1])], "k bigint, p string, f array<int>")
    assert [r.line for r in caption(windows, "k", "p", "f", lambda: stub_captioner).orderBy("k").collect()] == ["v.mp4 frames 0 2", "w.mp4 frames 1"]


def test_ingestion_is_idempotent(spark, tmp_path):
    schema = "k bigint, at timestamp"
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-02 00:00:00")], "k bigint, at string")
    batch = rows.select("k", F.to_timestamp("at").alias("at"))
    batch.write.parquet(source)
    for _ in range(2):
        ingest_new(spark.readStream.schema(schema).parquet(source), target, state, "k", "at").awaitTermination()
        batch.write.mode("append").parquet(source)
    ingest_new(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "other"), "k", "at").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2]


def test_stored_tables_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    path = f"file://{tmp_path}/t"
    assert stored(spark, path, make).count() == stored(spark, path, make).count() == 1
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert stored(spark, path, make).count() == 2 and stored(spark, path, make, refresh=True).count() == 3


def test_settings_in_layers(tmp_path):
    (tmp_path / "c.json").write_text('{"jump": 2.5, "burst": 1}')
    got = build(SpikeRules(), str(tmp_path / "c.json"), {"burst": 3, "gap": None})
    assert (got.jump, got.burst, got.gap) == (2.5, 3, SpikeRules().gap)
    with pytest.raises(ValueError, match="unknown"):
        build(SpikeRules(), None, {"nothing": 1})
    assert merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 5}, "d": None}) == {"a": {"b": 5, "c": 2}, "d": 1}
