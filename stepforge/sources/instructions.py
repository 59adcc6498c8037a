"""Instruction records: nested JSON in several shapes to one text a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that hold texts or lists of texts.
FIELDS = ("caption", "captions", "seen", "language_instruction", "language_instruction_2", "language_instruction_3")


def _texts(value: Column) -> Column:
    """The strings of a variant that is a string or a list; an empty list for all else."""
    kind = F.schema_of_variant(value)
    none = F.array().cast("array<string>")
    element = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")),
    )
    return F.when(kind == "STRING", F.array(F.try_variant_get(value, "$", "string"))).when(
        kind.startswith("ARRAY"), F.filter(element, lambda s: s.isNotNull())
    ).otherwise(none)


def record_texts(json: Column) -> Column:
    """All instruction texts of a record; an empty list for null and invalid JSON."""
    record = F.try_parse_json(json)
    empty = F.array().cast("array<string>")

    def of_object(v: Column) -> Column:
        return F.concat(*[F.coalesce(_texts(F.try_variant_get(v, f"$.{f}", "variant")), empty) for f in FIELDS])

    elements = F.try_variant_get(record, "$", "array<variant>")
    of_list = F.flatten(
        F.transform(
            elements,
            lambda e: F.when(F.schema_of_variant(e) == "STRING", F.array(F.try_variant_get(e, "$", "string")))
            .when(F.schema_of_variant(e).startswith("OBJECT"), of_object(e))
            .otherwise(empty),
        )
    )
    kind = F.schema_of_variant(record)
    return F.coalesce(F.when(kind.startswith("OBJECT"), of_object(record)).when(kind.startswith("ARRAY"), of_list), empty)


def instruction_rows(records: DataFrame, id_column: str, json: str) -> DataFrame:
    """(id, text): one row per instruction text; records without one have no row. Repeated texts are kept."""
    return records.select(id_column, F.explode(record_texts(F.col(json))).alias("text"))
