"""Copies of nested records that differ only in form, by Merkle hashing from the leaves up."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.operators.skewjoin import lookup_by_key
from stepforge.session import durable

_LOOSE_POINT = re.compile(r"(?<!\d)\.|\.(?!\d)")
#: ASCII: capitals to small letters, and all but letters, digits and points away.
_ASCII = {i: chr(i).lower() if chr(i).isalnum() or chr(i) == "." else None for i in range(128)}
_NOT_COMPARED = re.compile(r"(?<!\d)\.|\.(?!\d)|[^\w.]+|_+")


def plain_leaf(text: str) -> str:
    """Letters and digits without case, and points between two digits; all else is dropped."""
    if not text.isascii():
        return _NOT_COMPARED.sub("", unicodedata.normalize("NFC", text).casefold())
    if "." in text:
        text = _LOOSE_POINT.sub("", text)
    return text.translate(_ASCII)


class _Pairs(list):
    """The fields of an object, repeated names included."""


def _constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=_constant)


@lru_cache(maxsize=10_000)
def _field(name: str) -> tuple[str, bytes]:
    """A field's name as JSON, and its digest."""
    quoted = json.dumps(name)
    return quoted, hashlib.blake2b(quoted.encode(), digest_size=16).digest()


def parse(text: str) -> object:
    """The record; numbers keep their text. Raises ValueError if ``text`` isn't valid JSON."""
    try:
        return _DECODER.decode(text)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def digest(node: object) -> tuple[bytes, str]:
    """Merkle digest of a parsed record and the canonical form that it stands for.

    A leaf hashes its normal form; a list the digests of its elements in order; an object the
    sorted pairs of field name and child digest.
    """
    if isinstance(node, _Pairs):
        parts = []
        for name, child in node:
            d, form = digest(child)
            parts.append((*_field(name), d, form))
        parts.sort()
        h = hashlib.blake2b(b"o" + b"".join([n + d for _, n, d, _ in parts]), digest_size=16)
        return h.digest(), "{" + ",".join([f"{q}:{form}" for q, _, _, form in parts]) + "}"
    if isinstance(node, list):
        children = [digest(c) for c in node]
        h = hashlib.blake2b(b"l" + b"".join([d for d, _ in children]), digest_size=16)
        return h.digest(), "[" + ",".join([form for _, form in children]) + "]"
    # Numbers are read as text, so 5 and "5" are equal values; true, false and null are not text.
    form = f'"{plain_leaf(node)}"' if isinstance(node, str) else {True: "true", False: "false", None: "null"}[node]
    return hashlib.blake2b(b"v" + form.encode("utf-8", "surrogatepass"), digest_size=16).digest(), form


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, roots, forms = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or text is None:
                continue
            try:
                d, form = digest(parse(text))
            except (ValueError, RecursionError):
                continue
            ids.append(i)
            roots.append(d)
            forms.append(form.encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(roots, pa.binary()), pa.array(forms, pa.binary())], ["_id", "_root", "_form"]
        )


def record_digests(records: DataFrame, id_column: str, text: str) -> DataFrame:
    """(_id, _root, _form) of each record that is valid JSON; null and invalid ones have no row."""
    return records.select(F.col(id_column).cast("bigint"), F.col(text).cast("string")).mapInArrow(
        _digests, "_id bigint, _root binary, _form binary"
    )


def _groups(hashed: DataFrame) -> DataFrame:
    """One row per root digest; _least and _most are equal if all its records have one structure."""
    return hashed.groupBy("_root").agg(
        F.min("_id").alias("keep_id"),
        F.count(F.lit(1)).alias("n_copies"),
        F.min("_form").alias("_least"),
        F.max("_form").alias("_most"),
    )


def copy_classes(records: DataFrame, id_column: str, text: str) -> DataFrame:
    """(keep_id, n_copies): one row per distinct content, keep_id the smallest id of its copies.

    Grouped by root digest with partial aggregation, so a content with a third of all records is
    one state per task. The structural comparison is in the same pass: the least and the greatest
    canonical form of a group must be equal. Groups in which they aren't (a collision of 128-bit
    digests) are grouped by the form itself.

    Null ids, null texts and invalid JSON don't count; records nested deeper than the parser's
    limit are invalid. An empty text is invalid JSON. No rows give no rows.
    """
    hashed = record_digests(records, id_column, text)
    # Kept, so that records are parsed once; a second time only if digests collide.
    groups = durable(_groups(hashed).withColumn("_sure", F.col("_least") == F.col("_most")).drop("_least", "_most"))
    sure = groups.where("_sure").select("keep_id", "n_copies")
    apart = groups.where("NOT _sure").select("_root")
    if apart.isEmpty():
        return sure
    exact = hashed.join(apart, "_root", "left_semi").groupBy("_root", "_form")
    return sure.unionByName(
        exact.agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).select("keep_id", "n_copies")
    )


def copies(records: DataFrame, id_column: str, text: str) -> DataFrame:
    """(keep_id, copy_id): one row per record that is a copy of one with a smaller id.

    See copy_classes for what counts. Ids are expected to be unique; of a repeated smallest
    id all rows are the kept record.
    """
    hashed = record_digests(records, id_column, text)
    groups = durable(_groups(hashed).where("n_copies > 1").withColumn("_sure", F.col("_least") == F.col("_most")).drop("_least", "_most"))
    total = records.count()
    member = lookup_by_key(
        hashed.select("_id", "_root"), groups.where("_sure").select("_root", "keep_id", "n_copies"), "_root", "n_copies", "_id", total
    )
    found = member.where(F.col("keep_id") < F.col("_id")).select("keep_id", F.col("_id").alias("copy_id"))
    if groups.where("NOT _sure").isEmpty():
        return found
    apart = hashed.join(groups.where("NOT _sure").select("_root"), "_root", "left_semi")
    exact = apart.groupBy("_root", "_form").agg(F.min("_id").alias("keep_id"))
    rest = apart.join(exact, ["_root", "_form"]).where(F.col("keep_id") < F.col("_id"))
    return found.unionByName(rest.select("keep_id", F.col("_id").alias("copy_id")))
