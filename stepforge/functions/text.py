"""Text functions as column expressions."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words and colours that a group key leaves out.
STOP_WORDS = (
    "the a an to of on in at from into onto near left right front back top bottom middle center corner edge between with and so that "
    "is it be are by for up down over under across toward towards around this there as parallel parrellel close closer"
).split()
COLORS = "red green blue yellow orange purple pink black white gray grey brown gold silver".split()

# Default patterns of an invalid instruction.
INVALID = ("nan", "none", "null")


def task_slug(text: Column, length: int = 80, fallback: str = "unknown_task") -> Column:
    """A name for a folder: lower case, white space and slashes as one underscore, only a-z, 0-9 and _.

    Null, blank and wholly foreign text give the fallback. The cut to ``length`` comes last, so a
    cut slug may end in an underscore.
    """
    value = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    value = F.regexp_replace(value, r"[\s/\\]+", "_")
    value = F.regexp_replace(value, r"[^a-z0-9_]+", "")
    value = F.regexp_replace(F.regexp_replace(value, r"_+", "_"), r"^_|_$", "")
    return F.when(value == "", F.lit(fallback)).otherwise(F.substring(value, 1, length))


def group_key(text: Column, most: int = 6) -> Column:
    """The first words of an instruction that carry meaning; all words if none does; '' for null and blank."""
    value = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]+", " ")
    tokens = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    kept = F.filter(tokens, lambda w: ~w.isin(*STOP_WORDS, *COLORS))
    return F.array_join(F.slice(F.when(F.size(kept) > 0, kept).otherwise(tokens), 1, most), " ")


def grouped_slug(text: Column, mode: Column, fallback: str = "unknown_task") -> Column:
    """The slug of an instruction, or of its group key where ``mode`` is normalized_instruction."""
    return F.when(mode == "normalized_instruction", task_slug(group_key(text), 80, fallback)).otherwise(task_slug(text, 80, fallback))


def is_invalid(text: Column, patterns: Column) -> Column:
    """Whether a text is null, blank, or contains one of the patterns (any case); null patterns match nothing."""
    value = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    hit = F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: (p != "") & F.contains(value, p))
    return (value == "") | F.coalesce(hit, F.lit(False))


def first_non_empty(texts: Column) -> Column:
    """The first element that isn't blank, trimmed; '' if there is none."""
    kept = F.filter(texts, lambda x: F.trim(x) != "")
    return F.coalesce(F.trim(F.get(kept, F.lit(0))), F.lit(""))


def meta_lines(text: Column) -> Column:
    """Lines that aren't blank; a wholly blank text gives its trimmed form as the one line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.trim(text)))


def line_at(text: Column, t: Column) -> Column:
    """Line ``t`` of the lines that aren't blank, the last line beyond the end; null if there is none."""
    lines = F.filter(F.split(F.trim(text), "\n"), lambda x: F.trim(x) != "")
    return F.trim(F.get(lines, F.least(t, F.size(lines) - 1).cast("int")))


def sanitize_line(text: Column, default: str) -> Column:
    """One line with single spaces; ``default`` for null and blank text."""
    value = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(value == "", F.lit(default)).otherwise(value)


def whitespace_clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonicalize(text: Column) -> Column:
    """Underscores as spaces, no ASCII punctuation, lower case, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(text, "_", " "), r"""[!-/:-@\[-`{-~]""", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


@F.pandas_udf(StringType())
def basic_clean(texts: pd.Series) -> pd.Series:
    """HTML entities resolved twice, trimmed; no built-in does it."""
    return texts.map(lambda x: None if x is None else html.unescape(html.unescape(x)).strip())


def with_suffix(text: Column, setup: str, control: str) -> Column:
    """The text with setup and control tags; a space between only if the text has none at its end."""
    suffix = f"<setup_start>{setup}<setup_end><control_start>{control}<control_end>."
    gap = F.when((text == "") | text.rlike(r"[ \n\t]$"), F.lit("")).otherwise(F.lit(" "))
    return F.concat(text, gap, F.lit(suffix))


def natural_key(name: Column) -> Column:
    """A string that sorts as digits by value: each digit run is padded to 20 places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def nearest(value: Column, step: float) -> Column:
    """The multiple of ``step`` next to the value; halves go to the even multiple."""
    return F.bround(value / F.lit(float(step)), 0) * F.lit(float(step)) + F.lit(0.0)  # no negative zero


def round_down(value: Column, step: int) -> Column:
    return F.floor(value / F.lit(step)) * F.lit(step)


def format_numeric(value: Column, style: str) -> Column:
    """A number as ``no_number`` ('' ), ``nearest_10``, or with so many decimals (``0f``, ``2f``); halves to even."""
    if style == "no_number":
        return F.lit("")
    if style == "nearest_10":
        return F.format_string("%.0f", nearest(value, 10))
    places = int(style.removesuffix("f"))
    return F.format_string(f"%.{places}f", F.bround(value, places))


def eval_score(log: Column) -> Column:
    """Score in percent of an evaluation log; null where the log has neither a rate nor an error.

    The last line with ``Success rate:`` counts (colour codes removed): the percentage after =>, else
    its last percentage; else the last ``success_rate:`` times 100; else 0 if the log names an error.
    """
    plain = F.regexp_replace(log, r"\x1b\[[0-9;]*m", "")
    lines = F.split(plain, "\n")
    rate = F.element_at(F.filter(lines, lambda x: F.lower(x).contains("success rate:")), -1)
    arrow = F.regexp_extract(rate, r"=>\s*(\d+\.?\d*)%", 1)
    shares = F.regexp_extract_all(rate, F.lit(r"(\d+\.?\d*)%"), F.lit(1))
    last = F.coalesce(F.get(shares, F.size(shares) - 1), F.lit(""))
    part = F.regexp_extract(F.element_at(F.filter(lines, lambda x: x.contains("success_rate:")), -1), r"(\d+\.?\d*)", 1)
    has_rate = F.lower(plain).contains("success rate:")
    return (
        F.when(has_rate & (arrow != ""), arrow.try_cast("double"))
        .when(has_rate, last.try_cast("double"))
        .when(plain.contains("success_rate:"), F.bround(part.try_cast("double") * 100, 1))
        .when(plain.rlike("failed with exit code|Error:|Traceback"), F.lit(0.0))
    )


def device_list(text: Column) -> Column:
    """Devices by number, cuda:number or cpu, in order; null if empty or one of them is none of these."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    ok = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"^(\d+|cuda:\d+|cpu)$"))
    named = F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("cuda:"), p)).otherwise(p))
    return F.when(ok, F.array_join(named, ","))


def checkpoint_step(path: Column) -> Column:
    """The step number in a checkpoint's path; null if there is none."""
    return F.regexp_extract(path, r"step_(\d+)", 1).try_cast("bigint")


def coalesce_text(columns: Sequence[Column]) -> Column:
    """The first column that isn't blank, trimmed; '' if all are."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))
