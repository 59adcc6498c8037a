"""Record files of episode archives: framing, feature messages, builders with shard lengths, and array payloads."""

from __future__ import annotations

import io
import json
import os
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.sources.files import _fs, find_builder

Features = dict[str, list]


# ---------------------------------------------------------------- framing


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC = _crc_table()


def masked_crc(data: bytes) -> int:
    """The Castagnoli checksum, rotated and shifted as record files store it."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = _CRC[(crc ^ b) & 255] ^ (crc >> 8)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(record: bytes) -> bytes:
    length = struct.pack("<Q", len(record))
    return length + struct.pack("<I", masked_crc(length)) + record + struct.pack("<I", masked_crc(record))


def unframe(content: bytes, verify: bool = False) -> Iterator[bytes]:
    """The records of a file; a broken length or a cut file raises ValueError. ``verify`` also checks each record's own sum."""
    at = 0
    while at < len(content):
        head = content[at : at + 12]
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError(f"no record at byte {at}")
        n = struct.unpack("<Q", head[:8])[0]
        record = content[at + 12 : at + 12 + n]
        tail = content[at + 12 + n : at + 16 + n]
        if len(record) < n or len(tail) < 4:
            raise ValueError(f"the record at byte {at} is cut off")
        if verify and masked_crc(record) != struct.unpack("<I", tail)[0]:
            raise ValueError(f"the record at byte {at} is broken")
        yield record
        at += 16 + n


# ---------------------------------------------------------------- messages


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _number(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a message; lengths give bytes."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        elif kind == 2:
            n, at = _number(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, kind, value


def _part(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def encode_features(features: Mapping[str, Sequence]) -> bytes:
    """A message of named lists: bytes or text, whole numbers, or floats (4 bytes), by the first element; empty ones are floats."""
    entries = b""
    for name, values in features.items():
        first = next(iter(values), 0.0)
        if isinstance(first, (bytes, str)):
            body = _part(1, b"".join(_part(1, v.encode() if isinstance(v, str) else v) for v in values))
        elif isinstance(first, (int, np.integer)):
            body = _part(3, _part(1, b"".join(_varint(int(v)) for v in values)))
        else:
            body = _part(2, _part(1, np.asarray(values, "<f4").tobytes()))
        entries += _part(1, _part(1, name.encode()) + _part(2, body))
    return _part(1, entries)


def decode_features(message: bytes) -> Features:
    """Named lists of a message: bytes, ints or floats; packed and single values both count."""
    out: Features = {}
    for _, _, features in _fields(message):
        for _, _, entry in _fields(features):
            name, values = "", []
            for field, _, body in _fields(entry):
                if field == 1:
                    name = bytes(body).decode()
                    continue
                for kind, _, items in _fields(body):
                    for _, wire, v in _fields(items):
                        if kind == 1:
                            values.append(bytes(v))
                        elif kind == 2:
                            values += np.frombuffer(v, "<f4").astype(float).tolist()
                        elif wire == 0:
                            values.append(v - (1 << 64) if v >> 63 else v)
                        else:
                            at = 0
                            while at < len(v):
                                n, at = _number(v, at)
                                values.append(n - (1 << 64) if n >> 63 else n)
            out[name] = values
    return out


# ---------------------------------------------------------------- builders


def write_builder(df: DataFrame, folder: str, name: str, split: str, encode: Callable[[dict], Features], shards: int) -> list[int]:
    """Write the rows of ``df`` as ``shards`` record files with their description; returns the records of each.

    Tasks write their own shard, so ``folder`` must be a path that all machines have mounted. A shard that is written again replaces
    the first attempt at once.
    """
    columns = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, n = TaskContext.get().partitionId(), 0
        path = f"{folder}/{name}-{split}.tfrecord-{shard:05d}-of-{shards:05d}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{path}.gstmp", "wb") as file:
            for batch in batches:
                for row in batch.to_pylist():
                    file.write(frame(encode_features(encode({c: row[c] for c in columns}))))
                    n += 1
        os.replace(f"{path}.gstmp", path)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64())], ["shard", "n"])

    counts = {r.shard: r.n for r in df.repartition(shards).mapInArrow(write, "shard int, n bigint").collect()}
    lengths = [counts.get(i, 0) for i in range(shards)]
    with open(f"{folder}/dataset_info.json", "w") as file:
        json.dump({"name": name, "splits": [{"name": split, "shardLengths": [str(n) for n in lengths]}]}, file)
    return lengths


def shard_paths(spark: SparkSession, builder: str, split: str) -> list[str]:
    """The record files of a split in order of their numbers, without unfinished ones; an error if there are none or not all."""
    fs, p = _fs(spark, builder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if f"-{split}.tfrecord-" in name and not name.endswith(".gstmp"):
            found.append((int(name.rsplit(".tfrecord-", 1)[1].split("-of-")[0]), status.getPath().toString()))
    if not found:
        raise FileNotFoundError(f"no record files of {split} in {builder}")
    info = json.loads("\n".join(r.value for r in spark.read.text(path(p, "dataset_info.json").toString(), wholetext=True).collect()))
    lengths = next((s["shardLengths"] for s in info.get("splits", []) if s["name"] == split), None)
    if lengths is not None and [n for n, _ in sorted(found)] != list(range(len(lengths))):
        raise ValueError(f"{builder} has {len(found)} of {len(lengths)} record files of {split}")
    return [p for _, p in sorted(found)]


def record_rows(spark: SparkSession, paths: Sequence[str], decode: Callable[[Features], dict], schema: str) -> DataFrame:
    """One row per record of the files, by ``decode``; files are read and decoded by tasks."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = [decode(decode_features(r)) for r in unframe(content.as_buffer().to_pybytes())]
                if found:
                    yield pa.RecordBatch.from_pylist([{n: f.get(n) for n in names} for f in found], schema=kinds)

    kinds = _arrow(spark, schema)
    raw = spark.read.format("binaryFile").load(list(paths)).select("content")
    return raw.mapInArrow(rows, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def rlds(spark: SparkSession, root: str, split: str, decode: Callable[[Features], dict], schema: str) -> DataFrame:
    """The episodes of a split of the builder under ``root`` (or its last version)."""
    return record_rows(spark, shard_paths(spark, find_builder(spark, root), split), decode, schema)


# ---------------------------------------------------------------- array payloads

# Names under which payloads keep their array, in the order in which they are tried.
PAYLOAD_KEYS = ("latent_action", "qpos", "epos", "action", "actions", "state", "data", "tensor")


def payload_rows(payload: object, keys: Sequence[str] = PAYLOAD_KEYS) -> list[list[float]]:
    """Rows of an array, of nested lists, or of a mapping that has one under a known name (else its only entry).

    One dimension is one row of each value; more than two are flattened after the first. Raises ValueError if there is no array.
    """
    if isinstance(payload, Mapping):
        name = next((k for k in keys if k in payload), None)
        if name is None and len(payload) == 1:
            name = next(iter(payload))
        if name is None:
            raise ValueError(f"no array under any of {', '.join(keys)}")
        return payload_rows(payload[name], keys)
    array = np.asarray(payload, float)
    if array.ndim == 0:
        raise ValueError("a single number is no array")
    return array.reshape(len(array), -1).tolist()


def numpy_file(content: bytes) -> tuple[list[list[float]], int]:
    """A decoder of array files (.npy and .npz) for ``files.decoded``."""
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    rows = payload_rows(loaded if isinstance(loaded, np.ndarray) else {k: loaded[k] for k in loaded.files})
    return rows, len(rows[0]) if rows else 0


def exploded_steps(episodes: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """One row per step of episodes whose ``arrays`` hold one element a step; the other columns are repeated."""
    rest = [c for c in episodes.columns if c not in arrays]
    return episodes.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("step", "_s")).select(*rest, "step", *[F.col("_s")[a].alias(a) for a in arrays])
