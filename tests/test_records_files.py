"""Record files, builders, payloads, and lists that are replaced as a whole."""

import math
import random
import struct

import numpy as np
import pytest

from stepforge.functions import schedules as H
from stepforge.operators.catalog import aligned, misaligned
from stepforge.sinks.episodes import upsert_jsonl
from stepforge.sources import records as R
from stepforge.sources.files import decoded, jsonl


def test_checksum_of_known_bytes():
    # The check value of the Castagnoli polynomial, masked.
    crc = 0xE3069283
    assert R.masked_crc(b"123456789") == ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_frames_come_back_and_broken_ones_raise():
    records = [b"", b"a", bytes(range(256)) * 5]
    content = b"".join(map(R.frame, records))
    assert list(R.unframe(content, verify=True)) == records and list(R.unframe(b"")) == []
    for bad in (content[:-1], content[:5], b"x" + content[1:]):
        with pytest.raises(ValueError):
            list(R.unframe(bad))
    changed = bytearray(R.frame(b"abc"))
    changed[12] ^= 1
    assert list(R.unframe(bytes(changed))) != [b"abc"]
    with pytest.raises(ValueError, match="broken"):
        list(R.unframe(bytes(changed), verify=True))


def test_messages_come_back():
    rng = random.Random(1)
    features = {"text": ["é", "b"], "raw": [b"\x00\xff"], "n": [0, -1, 2**40, -(2**63)], "x": [rng.random() for _ in range(300)], "none": []}
    got = R.decode_features(R.encode_features(features))
    assert got["text"] == ["é".encode(), b"b"] and got["raw"] == features["raw"] and got["n"] == features["n"] and got["none"] == []
    assert np.allclose(got["x"], features["x"], rtol=1e-6)
    # Values that aren't packed.
    single = R._part(1, R._part(1, R._part(1, b"k") + R._part(2, R._part(3, R._varint(8) + R._varint(7) + R._varint(8) + R._varint(9)))))
    floats = R._part(1, R._part(1, R._part(1, b"f") + R._part(2, R._part(2, R._varint(13) + struct.pack("<f", 1.5)))))
    assert R.decode_features(single) == {"k": [7, 9]} and R.decode_features(floats) == {"f": [1.5]}


def test_builders_must_be_complete(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(11)], "k bigint, s string")
    folder = str(tmp_path / "d" / "1.0.0")
    lengths = R.write_builder(df, folder, "d", "train", lambda r: {"k": [r["k"]], "s": [r["s"]]}, 3)
    assert sum(lengths) == 11 and len(lengths) == 3
    (tmp_path / "d" / "1.0.0" / "d-train.tfrecord-00001-of-00003.gstmp").write_bytes(b"unfinished")
    read = lambda: R.rlds(spark, str(tmp_path / "d"), "train", lambda f: {"k": f["k"][0], "s": f["s"][0].decode()}, "k bigint, s string")
    assert sorted(map(tuple, read().collect())) == [(i, f"t{i}") for i in range(11)]
    with pytest.raises(FileNotFoundError, match="no record files"):
        R.shard_paths(spark, folder, "test")
    (tmp_path / "d" / "1.0.0" / "d-train.tfrecord-00001-of-00003").unlink()
    with pytest.raises(ValueError, match="2 of 3"):
        read()


def test_payloads():
    assert R.payload_rows([[1, 2], [3, 4]]) == [[1, 2], [3, 4]] and R.payload_rows(np.arange(3)) == [[0], [1], [2]]
    assert R.payload_rows({"meta": [9], "action": [[5, 6]]}) == [[5, 6]] and R.payload_rows({"any": {"qpos": [[1]]}}) == [[1]]
    assert R.payload_rows(np.zeros((2, 3, 2))) == [[0] * 6] * 2
    for bad in ({}, {"a": [1], "b": [2]}, 5.0):
        with pytest.raises(ValueError):
            R.payload_rows(bad)


def test_array_files_are_read_by_tasks(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    np.savez(tmp_path / "b.npz", meta=np.zeros(2), qpos=np.array([[7.0]]))
    (tmp_path / "c.npy").write_bytes(b"broken")
    rows = decoded(spark, str(tmp_path), "*.np[yz]", R.numpy_file).collect()
    got = {(r.path.rsplit("/", 1)[1], r.t): r["values"] for r in rows if r.error is None}
    assert got == {("a.npy", 0): [1, 2], ("a.npy", 1): [3, 4], ("b.npz", 0): [7]}
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.error] == ["c.npy"]


def test_lists_are_replaced_as_a_whole(spark, tmp_path):
    path, schema = str(tmp_path / "list"), "k int, v string"
    spark.createDataFrame([(1, None), (2, "b")], schema).write.option("ignoreNullFields", "false").json(path)
    new = spark.createDataFrame([(1, "x"), (9, "y")], schema)
    assert upsert_jsonl(spark, path, schema, new, ["k"], ["v"])
    assert not upsert_jsonl(spark, path, schema, new.where("k = 9"), ["k"], ["v"])
    assert sorted(map(tuple, jsonl(spark, path, schema).collect())) == [(1, "x"), (2, "b")]
    # A writer that died between its two renames left the copy.
    (tmp_path / "list").rename(tmp_path / "list.old")
    assert upsert_jsonl(spark, path, schema, spark.createDataFrame([(2, "c")], schema), ["k"], ["v"])
    assert sorted(map(tuple, jsonl(spark, path, schema).collect())) == [(1, "x"), (2, "c")] and not (tmp_path / "list.old").exists()


def test_grids_and_schedules(spark):
    grid = [r.value for r in H.logit_normal_grid(spark, 1000).orderBy("bucket").collect()]
    assert len(grid) == 1000 and grid == sorted(grid)
    # The normal quantile of 0.001 is -3.090232306.
    assert grid[0] == pytest.approx(1 / (1 + math.exp(3.090232306167813))) and grid[0] + grid[-1] == pytest.approx(1)
    part = [r.value for r in H.slice_grid(H.uniform_grid(spark, 100), 0.2, 0.5).orderBy("place").collect()]
    assert part[0] >= 0.2 > part[0] - 0.01 and part[-1] < 0.5
    draws = spark.createDataFrame([(0.0,), (0.999,), (0.5,)], "q double")
    got = sorted(r.value for r in H.sample_grid(draws, H.slice_grid(H.uniform_grid(spark, 100), 0.2, 0.5), "q").collect())
    assert got == [part[0], part[len(part) // 2], part[-1]]
    ends = {r.step: r.sigma for r in H.sigma_schedule(spark, 10, shift=3.0, terminal=0.1).collect()}
    assert ends[9] == pytest.approx(0.1) and ends[0] == pytest.approx(1)
    assert [r.sigma for r in H.sigma_schedule(spark, 3, extra_step=False, shift=1.0, reverse=True).orderBy("step").collect()] == [0, 0.5, 1]
    assert sum(r.weight for r in H.sigma_schedule(spark, 10).collect()) == pytest.approx(10)
    warm = spark.createDataFrame([(s,) for s in (-1, 0, 5, 10, 15, 20, 30)], "s int")
    assert [r[0] for r in warm.select(H.linear_warmup(warm.s, 10, 20, 0.2, 1.0, 0.1)).collect()] == pytest.approx([0.2, 0.2, 0.6, 1.0, 0.55, 0.1, 0.1])
    near = spark.createDataFrame([(8.0,), (3.4,), (6.5,)], "x double")
    assert [r[0] for r in near.select(H.nearest_in([9.0, 4.0, 3.0], near.x)).collect()] == [0, 2, 0]


def test_alignment(spark):
    a = spark.createDataFrame([(1, 0), (1, 2), (1, 5), (2, 0), (3, 1)], "k int, t int")
    b = spark.createDataFrame([(1, 1), (1, 2), (2, 7), (4, 0)], "k int, t int")
    assert sorted(tuple(r) for r in aligned(a, b, ["k"], "t").collect()) == [(1, 1, 0, 1), (1, 2, 2, 2), (2, 1, 0, 7)]
    assert sorted(tuple(r) for r in misaligned(a, b, ["k"]).collect()) == [(1, 3, 2), (3, 1, 0), (4, 0, 1)]
