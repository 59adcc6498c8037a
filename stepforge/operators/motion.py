"""Look-ahead windows over steps and their summaries as text."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.kinematics import wrap_angle
from stepforge.operators.ranking import ranked

#: Clauses of a summary: position in the arm, word above 0, word below 0, unit; z comes before y.
CLAUSES = (
    (0, "move forward", "move back", "cm"),
    (2, "move up", "move down", "cm"),
    (1, "move left", "move right", "cm"),
    (3, "tilt left", "tilt right", "degrees"),
    (4, "tilt back", "tilt forward", "degrees"),
    (5, "rotate counterclockwise", "rotate clockwise", "degrees"),
)


def lookahead(partition: Sequence[str], order: str, width: int, first: int = 0) -> Window:
    """The rows from ``first`` to ``width`` - 1 after the current one, fewer at the end."""
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(first, width - 1)


def _amount(total: Column, unit: str) -> Column:
    """Whole centimetres or tens of degrees, halves to even; sums are cut to 6 decimals first, so ties don't depend on the order of addition."""
    if unit == "cm":
        return F.bround(F.round(F.abs(total) * 100, 6), 0)
    return F.bround(F.round(F.abs(total) * 180 / F.lit(math.pi), 6) / 10, 0) * 10


def arm_summary(totals: Sequence[Column], gripper: Column | None, skip_zero: bool = True) -> Column:
    """The clauses of one arm's motion. totals: x, y, z, roll, pitch, yaw summed over the window.

    With ``skip_zero`` a distance that rounds to 0 is left out; else only one that is 0 before
    rounding, so "move forward 0 cm" is possible. Angles that round to 0 are always left out. The gripper
    clause is always there if there is a gripper.
    """
    parts = []
    for at, above, below, unit in CLAUSES:
        amount = _amount(totals[at], unit)
        said = F.format_string("%.0f " + unit, amount)
        shown = (amount != 0) if skip_zero or unit == "degrees" else F.lit(True)
        parts.append(
            F.when(shown & (totals[at] > 0), F.concat(F.lit(above + " "), said)).when(
                shown & (totals[at] < 0), F.concat(F.lit(below + " "), said)
            )
        )
    if gripper is not None:
        parts.append(F.when(gripper >= 0.5, F.lit("open gripper")).otherwise(F.lit("close gripper")))
    return F.concat_ws(", ", *parts)


#: Rows of a recording beyond which its windows are worth more than one task.
PART = 1 << 16


def in_parts(df: DataFrame, keys: Sequence[str], order: str, width: int, part: int) -> DataFrame:
    """Rows with ``_part`` and ``_own``: recordings cut into parts of ``part`` rows.

    A part also has the row before it and the ``width`` - 1 rows after it (``_own`` is false there), so that windows
    within a part see what they would see in the whole recording. Positions are counted in blocks of ``order``, an integer,
    so a recording with a third of all rows is no single task's work.
    """
    placed = ranked(df, keys, F.col(order), [F.col(order)], "_pos", width=part)
    at, own = (F.col("_pos") - 1) % part, F.floor((F.col("_pos") - 1) / part)
    parts = F.array(
        own, F.when((at < width - 1) & (own > 0), own - 1).otherwise(own), F.when(at == part - 1, own + 1).otherwise(own)
    )
    return placed.withColumn("_home", own).withColumn("_part", F.explode(F.array_distinct(parts))).withColumn("_own", F.col("_part") == F.col("_home")).drop("_pos", "_home")


def language_actions(
    df: DataFrame, signal: str, keys: Sequence[str], order: str, arms: int, mode: str, width: int = 16, skip_zero: bool = True, part: int | None = None
) -> DataFrame:
    """(keys, order, summary): text of the window that starts at each step.

    mode: ``delta`` (the signal holds changes) or ``absolute`` (poses). ``arms``: arms of seven values. Rows with
    a null signal must be left out before; a reading that isn't a finite number is missing, its row stays in the windows. One shuffle by ``keys``: all windows share it. The frame is bounded, so
    a long recording costs memory for ``width`` rows only. With ``part`` recordings are cut into parts of so many rows, which
    gives the same texts by more tasks, for one more shuffle.
    """
    if part is not None:
        whole = in_parts(df.select(*keys, order, signal), keys, order, width, part)
        inner = _actions(whole, signal, [*keys, "_part"], order, arms, mode, width, skip_zero, ["_own"])
        return inner.where("_own").select(*keys, order, "summary")
    return _actions(df, signal, keys, order, arms, mode, width, skip_zero, [])


def _actions(
    df: DataFrame, signal: str, keys: Sequence[str], order: str, arms: int, mode: str, width: int, skip_zero: bool, extra: Sequence[str]
) -> DataFrame:
    names = [f"_x{i}" for i in range(7 * arms)]
    reading = lambda i: F.get(signal, F.lit(i)).cast("double")
    known = lambda x: F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
    flat = df.select(*keys, order, *extra, *[known(reading(i)).alias(n) for i, n in enumerate(names)])
    texts = []
    if mode == "absolute":
        # The differences need a window of their own below the sums.
        before = Window.partitionBy(*keys).orderBy(order)
        steps = {}
        for i, n in enumerate(names):
            if i % 7 < 6:
                d = F.col(n) - F.lag(n).over(before)
                steps[f"_d{i}"] = wrap_angle(d) if i % 7 >= 3 else d
        flat = flat.withColumns(steps)
        ahead = lookahead(keys, order, width, 1)
        totals = {i: F.coalesce(F.sum(f"_d{i}").over(ahead), F.lit(0.0)) for i in range(7 * arms) if i % 7 < 6}
    else:
        ahead = lookahead(keys, order, width)
        totals = {i: F.sum(names[i]).over(ahead) for i in range(7 * arms) if i % 7 < 6}
    last = lookahead(keys, order, width)
    summed = flat.select(
        *keys,
        order,
        *extra,
        *[t.alias(f"_s{i}") for i, t in totals.items()],
        *[F.last(names[7 * a + 6]).over(last).alias(f"_g{a}") for a in range(arms)],
    )
    for a in range(arms):
        texts.append(arm_summary([F.col(f"_s{7 * a + i}") for i in range(6)], F.col(f"_g{a}"), skip_zero))
    if arms == 1:
        summary = texts[0]
    else:
        summary = F.concat(F.lit("Left arm: "), texts[0], F.lit(". Right arm: "), texts[1])
    return summed.select(*keys, order, *extra, summary.alias("summary"))
