"""Step signals: derived poses, look-ahead summaries, sampling of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.functions import kinematics as K
from stepforge.operators.motion import CLAUSES, PART, in_parts, language_actions, lookahead
from stepforge.operators.skewjoin import lookup_by_key
from stepforge.plans.common import STEPS, finite, finite_or_null, readings, readings_sql, steps, stored_steps
from stepforge.registry import query
from stepforge.tables import table

DELTA = ("bridge", "droid", "fractal")
ABSOLUTE = ("robotwin2", "aloha_agilex_1", "aloha_agilex_2", "ac_one")
WINDOW = 16
def _names(datasets: tuple[str, ...]) -> str:
    return ", ".join(f"'{d}'" for d in datasets)


def wrapped_sql(d: str) -> str:
    """A difference of angles in [-pi, pi): the positive remainder, by the same operations as the engine's."""
    r = f"fmod({d} + pi(), 2 * pi())"
    return f"(CASE WHEN {r} < 0 THEN fmod({r} + 2 * pi(), 2 * pi()) ELSE {r} END - pi())"


def _summary_sql(arms: int, mode: str, datasets: tuple[str, ...], skip_zero: bool) -> str:
    """The summaries in SQL, independent of the engine's code: list of clauses by CASE."""
    columns = ", ".join(f"CASE WHEN isfinite(epos[{i + 1}]) THEN epos[{i + 1}]::DOUBLE END AS x{i}" for i in range(7 * arms))
    base = f"b AS (SELECT ep_key, t, {columns} FROM st WHERE dataset IN ({_names(datasets)}) AND epos IS NOT NULL)"
    frames = f"""WINDOW a AS (PARTITION BY ep_key ORDER BY t ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING),
        f AS (PARTITION BY ep_key ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {WINDOW - 1} FOLLOWING)"""
    if mode == "absolute":
        steps_of = []
        for i in range(7 * arms):
            if i % 7 < 6:
                d = f"(x{i} - lag(x{i}) OVER (PARTITION BY ep_key ORDER BY t))"
                if i % 7 >= 3:
                    d = wrapped_sql(d)
                steps_of.append(f"{d} AS d{i}")
        base += f", dd AS (SELECT *, {', '.join(steps_of)} FROM b)"
        sums = ", ".join(f"coalesce(sum(d{i}) OVER f, 0.0) AS s{i}" for i in range(7 * arms) if i % 7 < 6)
        source = "dd"
    else:
        sums = ", ".join(f"sum(x{i}) OVER a AS s{i}" for i in range(7 * arms) if i % 7 < 6)
        source = "b"
    grips = ", ".join(f"last_value(x{7 * a + 6}) OVER a AS g{a}" for a in range(arms))
    texts = []
    for a in range(arms):
        parts = []
        for at, above, below, unit in CLAUSES:
            s = f"s{7 * a + at}"
            amount = f"round_even(round(abs({s}) * 100, 6), 0)" if unit == "cm" else f"round_even(round(abs({s}) * 180 / pi(), 6) / 10, 0) * 10"
            shown = f"{amount} <> 0" if skip_zero or unit == "degrees" else "true"
            parts.append(
                f"CASE WHEN {shown} AND {s} > 0 THEN '{above} ' || printf('%.0f', {amount}) || ' {unit}' "
                f"WHEN {shown} AND {s} < 0 THEN '{below} ' || printf('%.0f', {amount}) || ' {unit}' END"
            )
        parts.append(f"CASE WHEN g{a} >= 0.5 THEN 'open gripper' ELSE 'close gripper' END")
        texts.append(f"concat_ws(', ', {', '.join(parts)})")
    summary = texts[0] if arms == 1 else f"'Left arm: ' || {texts[0]} || '. Right arm: ' || {texts[1]}"
    return f"WITH {STEPS}, {base}, w AS (SELECT ep_key, t, {sums}, {grips} FROM {source} {frames}) SELECT ep_key, t, {summary} AS summary FROM w"


def _summaries(spark: SparkSession, root: str, datasets: tuple[str, ...], arms: int, mode: str, skip_zero: bool = True) -> DataFrame:
    """Summaries of the steps that have a pose. A recording with more than PART steps is cut before its rows are shuffled."""
    long = longest(spark, root) > PART
    df = steps(spark, root, "dataset", "epos", together=not long, datasets=datasets).where(F.col("epos").isNotNull())
    return language_actions(df, "epos", ["ep_key"], "t", arms, mode, WINDOW, skip_zero, PART if long else None)


def longest(spark: SparkSession, root: str) -> int:
    """The largest step number, one column of the scan; it says whether recordings are cut into parts."""
    return table(spark, root, "steps", "t").agg(F.max("t")).first()[0] or 0


def _in_windows(spark: SparkSession, root: str, *columns: str, datasets: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Steps for windows of up to WINDOW rows, and the columns to partition by; rows outside their own part have ``_own`` false."""
    if longest(spark, root) > PART:
        cut = in_parts(steps(spark, root, *columns, datasets=datasets), ["ep_key"], "t", WINDOW, PART)
        return cut, ["ep_key", "_part"]
    return steps(spark, root, *columns, together=True, datasets=datasets).withColumn("_own", F.lit(True)), ["ep_key"]


@query("delta_language_action", _summary_sql(1, "delta", DELTA, False))
def delta_language_action(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of signals that hold changes, one arm."""
    return _summaries(spark, root, DELTA, 1, "delta", skip_zero=False)


@query("delta_language_action_rounded", _summary_sql(1, "delta", DELTA, True))
def delta_language_action_rounded(spark: SparkSession, root: str) -> DataFrame:
    """As delta_language_action, without distances that round to 0."""
    return _summaries(spark, root, DELTA, 1, "delta")


@query("absolute_language_action", _summary_sql(1, "absolute", ABSOLUTE, True))
def absolute_language_action(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of the left arm's poses."""
    return _summaries(spark, root, ABSOLUTE, 1, "absolute")


@query("bimanual_language_action", _summary_sql(2, "absolute", ABSOLUTE, True))
def bimanual_language_action(spark: SparkSession, root: str) -> DataFrame:
    return _summaries(spark, root, ABSOLUTE, 2, "absolute")


@query(
    "lookahead_window",
    f"""WITH {STEPS} SELECT ep_key, t, min(t) OVER w AS first_t, max(t) OVER w AS last_t, count(*) OVER w AS n FROM st
    WINDOW w AS (PARTITION BY ep_key ORDER BY t ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)""",
)
def lookahead_window(spark: SparkSession, root: str) -> DataFrame:
    df, by = _in_windows(spark, root)
    w = lookahead(by, "t", WINDOW)
    df = df.select("ep_key", "t", "_own", F.min("t").over(w).alias("first_t"), F.max("t").over(w).alias("last_t"), F.count(F.lit(1)).over(w).alias("n"))
    return df.where("_own").drop("_own")


_STEP = "(PARTITION BY ep_key, dim ORDER BY t)"


@query(
    "epos_from_qpos",
    f"""WITH {STEPS}, x AS ({readings_sql('qpos', 'st', 'ep_key, t')}), y AS (SELECT ep_key, t, dim, CASE WHEN isfinite(v) THEN v END AS v FROM x)
    SELECT ep_key, t, dim, CASE WHEN row_number() OVER {_STEP} = 1 THEN 0.0 ELSE v - lag(v) OVER {_STEP} + 0.0 END AS v FROM y""",
)
def epos_from_qpos(spark: SparkSession, root: str) -> DataFrame:
    """Changes of the joints from step to step, 0 at the start; null where a reading or the one before it isn't finite."""
    return _changes(spark, root, "qpos").select("ep_key", "t", "dim", F.when(F.col("_first"), F.lit(0.0)).otherwise(F.col("_d") + F.lit(0.0)).alias("v"))


def _changes(spark: SparkSession, root: str, signal: str, datasets: tuple[str, ...] = ()) -> DataFrame:
    """Readings with ``_d``, the change from the step before; long recordings by parts."""
    df, by = _in_windows(spark, root, *(["dataset"] if datasets else []), signal, datasets=datasets)
    df = readings(signal, df, *by, "t", "_own").withColumn("v", finite_or_null(F.col("v")))
    w = Window.partitionBy(*by, "dim").orderBy("t")
    df = df.withColumn("_d", F.col("v") - F.lag("v").over(w)).withColumn("_first", F.lag("t").over(w).isNull())
    return df.where("_own")


_D = f"(v - lag(v) OVER {_STEP})"


@query(
    "epos_from_cartesian",
    f"""WITH {STEPS}, x AS ({readings_sql('epos', 'st', 'ep_key, t, dataset')}), y AS (SELECT ep_key, t, dim, CASE WHEN isfinite(v) THEN v END AS v FROM x WHERE dataset IN ({_names(ABSOLUTE)}))
    SELECT ep_key, t, dim, round(CASE WHEN dim % 7 = 6 THEN v WHEN row_number() OVER {_STEP} = 1 THEN 0.0 WHEN dim % 7 < 3 THEN {_D}
    ELSE {wrapped_sql(_D)} END, 9) + 0.0 AS v FROM y""",
)
def epos_from_cartesian(spark: SparkSession, root: str) -> DataFrame:
    """Changes of both arms' poses: angles wrapped, the gripper as it is, 0 at the start; null where a reading isn't finite."""
    df = _changes(spark, root, "epos", ABSOLUTE)
    change = F.when(F.col("dim") % 7 < 3, F.col("_d")).otherwise(K.wrap_angle(F.col("_d")))
    value = F.when(F.col("dim") % 7 == 6, F.col("v")).when(F.col("_first"), F.lit(0.0)).otherwise(change)
    return df.select("ep_key", "t", "dim", (F.round(value, 9) + 0.0).alias("v"))


@query(
    "wrap_angle",
    f"""WITH {STEPS}, x AS (SELECT ep_key, t, epos[6]::DOUBLE * 3 AS a FROM st WHERE epos IS NOT NULL)
    SELECT ep_key, t, round({wrapped_sql('a')}, 9) + 0.0 AS a FROM x WHERE isfinite(a)""",
)
def wrap_angle(spark: SparkSession, root: str) -> DataFrame:
    a = F.get("epos", F.lit(5)).cast("double") * 3
    df = steps(spark, root, "epos").where("epos IS NOT NULL").select("ep_key", "t", a.alias("a")).where(finite("a"))
    return df.select("ep_key", "t", (F.round(K.wrap_angle(F.col("a")), 9) + 0.0).alias("a"))


_Q = "w / n AS w, x / n AS x, y / n AS y, z / n AS z"


@query(
    "quat_to_rpy",
    f"""WITH {STEPS}, q AS (SELECT ep_key, t, qpos[1]::DOUBLE w, qpos[2]::DOUBLE x, qpos[3]::DOUBLE y, qpos[4]::DOUBLE z FROM st WHERE qpos IS NOT NULL),
    n AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM q WHERE isfinite(w) AND isfinite(x) AND isfinite(y) AND isfinite(z)),
    u AS (SELECT ep_key, t, {_Q} FROM n WHERE n > 1e-12)
    SELECT ep_key, t, round(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), 9) + 0.0 AS roll,
    round(asin(greatest(-1.0, least(1.0, 2 * (w * y - z * x)))), 9) + 0.0 AS pitch,
    round(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 9) + 0.0 AS yaw FROM u""",
)
def quat_to_rpy(spark: SparkSession, root: str) -> DataFrame:
    """The first four joints read as a quaternion w, x, y, z."""
    df = steps(spark, root, "qpos").where("qpos IS NOT NULL")
    df = df.select("ep_key", "t", *[F.get("qpos", F.lit(i)).cast("double").alias(n) for i, n in enumerate("wxyz")])
    df = df.where(finite("w") & finite("x") & finite("y") & finite("z"))
    roll, pitch, yaw = K.quaternion_rpy(*[F.col(n) for n in "wxyz"])
    return df.where(F.sqrt(F.expr("w * w + x * x + y * y + z * z")) > 1e-12).select(
        "ep_key", "t", *[(F.round(c, 9) + 0.0).alias(n) for n, c in (("roll", roll), ("pitch", pitch), ("yaw", yaw))]
    )


_LEN = f"{STEPS}, e AS (SELECT ep_key, max(t) + 1 AS n FROM st GROUP BY ep_key)"


def _lengths(spark: SparkSession, root: str) -> DataFrame:
    return stored_steps(spark, root).groupBy("ep_key").agg((F.max("t") + 1).alias("n"))


@query(
    "sample_first_mid_last",
    f"""WITH {STEPS}, w AS (SELECT ep_key, t, t AS a, t + count(*) OVER (PARTITION BY ep_key ORDER BY t ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS b FROM st),
    i AS (SELECT ep_key, t, unnest([a, a + (b - a - 1) // 2, b - 1]) AS frame FROM w)
    SELECT DISTINCT ep_key, t, frame FROM i""",
)
def sample_first_mid_last(spark: SparkSession, root: str) -> DataFrame:
    """First, middle and last frame of each window, without repeats."""
    return window_frames(spark, root).select("ep_key", "t", F.explode("frames").alias("frame"))


def window_frames(spark: SparkSession, root: str) -> DataFrame:
    """(ep_key, t, frames): first, middle and last frame of the window that begins at each step."""
    df, by = _in_windows(spark, root)
    n = F.count(F.lit(1)).over(lookahead(by, "t", WINDOW))
    df = df.select("ep_key", "t", "_own", n.alias("n")).where("_own")
    frames = F.array_distinct(F.array(F.col("t").cast("bigint"), F.col("t") + F.floor((F.col("n") - 1) / 2), F.col("t") + F.col("n") - 1))
    return df.select("ep_key", "t", frames.alias("frames"))


@query(
    "unique_frame_indices",
    f"""WITH {STEPS}, w AS (SELECT ep_key, t // 8 AS batch, unnest([t, t + 4, t + 8]) AS frame FROM st)
    SELECT ep_key, batch, count(DISTINCT frame) AS n_frames, min(frame) AS first_frame, max(frame) AS last_frame FROM w GROUP BY ALL""",
)
def unique_frame_indices(spark: SparkSession, root: str) -> DataFrame:
    """Distinct frames that a micro-batch of eight windows needs."""
    df = steps(spark, root, "task_slug").select("ep_key", F.floor(F.col("t") / 8).alias("batch"), F.explode(F.array(F.col("t"), F.col("t") + 4, F.col("t") + 8)).alias("frame"))
    return df.groupBy("ep_key", "batch").agg(F.count_distinct("frame").alias("n_frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


#: Video frames of a chunk, actions per frame, and steps between actions.
FRAMES, RATIO, RATE = 2, 3, 2


@query(
    "chunk_sampling_indices",
    f"""WITH {_LEN}, c AS (SELECT ep_key, n, unnest(range(0, greatest(n - {FRAMES * RATIO * RATE} - 1, 0) + 1)) AS cond FROM e)
    SELECT ep_key, cond, i AS slot, least(cond + (i + 1) * {RATE}, n - 1) AS action_t, (i + 1) % {RATIO} = 0 AS has_frame
    FROM c, range(0, {FRAMES * RATIO}) r(i)""",
)
def chunk_sampling_indices(spark: SparkSession, root: str) -> DataFrame:
    """All chunks: condition step, action steps (the last step beyond the end), and which of them have a frame."""
    df = _chunks(_lengths(spark, root))
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(FRAMES * RATIO - 1))).alias("slot"))
    at = F.least(F.col("cond") + (F.col("slot") + 1) * RATE, F.col("n") - 1)
    return df.select("ep_key", "cond", "slot", at.alias("action_t"), ((F.col("slot") + 1) % RATIO == 0).alias("has_frame"))


def _chunks(lengths: DataFrame) -> DataFrame:
    """(ep_key, n, cond): the condition step of every chunk."""
    return lengths.select("ep_key", "n", F.explode(F.sequence(F.lit(0), _last_chunk())).alias("cond"))


def _last_chunk() -> F.Column:
    """The condition step of the last chunk of a recording of ``n`` steps."""
    return F.greatest(F.col("n") - FRAMES * RATIO * RATE - 1, F.lit(0))


@query(
    "latent_sampling_indices",
    f"""WITH {_LEN}, c AS (SELECT ep_key, n, unnest(range(0, greatest(n - 1 - 4 * {RATE}, 0) + 1)) AS cond FROM e WHERE n >= 2)
    SELECT ep_key, cond, i AS slot, least(cond + (i + 1) * {RATE}, n - 1) AS video_t, least(cond + i * {RATE}, n - 2) AS action_t FROM c, range(0, 4) r(i)""",
)
def latent_sampling_indices(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of four frames where actions lie between frames."""
    top = F.greatest(F.col("n") - 1 - 4 * RATE, F.lit(0))
    df = _lengths(spark, root).where("n >= 2").select("ep_key", "n", F.explode(F.sequence(F.lit(0), top)).alias("cond"))
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot"))
    return df.select(
        "ep_key", "cond", "slot",
        F.least(F.col("cond") + (F.col("slot") + 1) * RATE, F.col("n") - 1).alias("video_t"),
        F.least(F.col("cond") + F.col("slot") * RATE, F.col("n") - 2).alias("action_t"),
    )


_CHUNKS = f"{_LEN}, c AS (SELECT ep_key, n, unnest(range(0, greatest(n - {FRAMES * RATIO * RATE} - 1, 0) + 1)) AS cond FROM e)"
_LIST = "list_transform(st.{0}, lambda x: x::DOUBLE + 0.0)"


def _plain(signal: str) -> F.Column:
    """The array as doubles; -0.0 is 0.0."""
    return F.transform(F.col(signal).cast("array<double>"), lambda x: x + F.lit(0.0))


@query(
    "action_gather",
    f"""WITH {_CHUNKS}, i AS (SELECT ep_key, cond, i AS slot, least(cond + (i + 1) * {RATE}, n - 1)::INT AS t FROM c, range(0, {FRAMES * RATIO}) r(i))
    SELECT i.ep_key, cond, slot, i.t, {_LIST.format('qpos')} AS v FROM i JOIN st ON st.ep_key = i.ep_key AND st.t = i.t WHERE st.qpos IS NOT NULL""",
)
def action_gather(spark: SparkSession, root: str) -> DataFrame:
    """The whole rows at the action steps of every chunk; steps beyond the end are the last one.

    A step finds the chunks that take it by its recording's length. A list of all chunks is many times larger than the lengths
    it is made from, which the planner doesn't see: it takes the list for small and broadcasts it.
    """
    stored = stored_steps(spark, root)
    lengths = stored.groupBy("ep_key").agg((F.max("t") + 1).alias("n"), F.count(F.lit(1)).alias("_rows"))
    rows = lookup_by_key(steps(spark, root, "qpos").where("qpos IS NOT NULL"), lengths, "ep_key", "_rows", "t", stored.count())
    rows = rows.select("ep_key", "t", "n", _plain("qpos").alias("v"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(FRAMES * RATIO - 1))).alias("slot"))
    cond = F.col("t") - (F.col("slot") + 1) * RATE
    # Only the one chunk of a recording that is shorter than a chunk reaches beyond the end.
    rows = rows.withColumn("cond", F.when(F.col("t") == F.col("n") - 1, F.greatest(cond, F.lit(0))).otherwise(cond))
    return rows.where((F.col("cond") >= 0) & (F.col("cond") <= _last_chunk())).select("ep_key", "cond", "slot", "t", "v")


@query(
    "action_gather_strict",
    f"""WITH {_CHUNKS}, i AS (SELECT ep_key, n, cond, i AS slot, cond + (i + 1) * {RATE} AS t FROM c, range(0, {FRAMES * RATIO}) r(i)),
    o AS (SELECT ep_key, cond, max(t) >= any_value(n) AS out_of_range FROM i GROUP BY ALL)
    SELECT ep_key, count(*) FILTER (NOT out_of_range) AS n_chunks, count(*) FILTER (out_of_range) AS n_out_of_range, min(cond) FILTER (out_of_range) AS first_out_of_range FROM o GROUP BY ep_key""",
)
def action_gather_strict(spark: SparkSession, root: str) -> DataFrame:
    """The strict form: chunks with an action step beyond the end are errors, reported by episode and not clamped."""
    chunks = _chunks(_lengths(spark, root))
    beyond = F.col("cond") + FRAMES * RATIO * RATE >= F.col("n")
    return chunks.groupBy("ep_key").agg(
        F.count_if(~beyond).alias("n_chunks"), F.count_if(beyond).alias("n_out_of_range"), F.min(F.when(beyond, F.col("cond"))).alias("first_out_of_range")
    )


@query(
    "initial_state_gather",
    f"""WITH {_CHUNKS}, i AS (SELECT ep_key, least(cond, n - 1)::INT AS t FROM c)
    SELECT i.ep_key, i.t, {_LIST.format('qpos')} AS state FROM i JOIN st ON st.ep_key = i.ep_key AND st.t = i.t""",
)
def initial_state_gather(spark: SparkSession, root: str) -> DataFrame:
    """The whole state at the condition step of every chunk, at most the last step."""
    at = _chunks(_lengths(spark, root)).select("ep_key", F.least("cond", F.col("n") - 1).cast("int").alias("t"))
    return at.join(steps(spark, root, "qpos"), ["ep_key", "t"]).select("ep_key", "t", _plain("qpos").alias("state"))


_SIZE = "(320 + (ep_key % 17) * 32)::DOUBLE AS w, (240 + (ep_key % 13) * 20)::DOUBLE AS h"


@query(
    "letterbox_geometry",
    f"""WITH {_LEN}, i AS (SELECT ep_key, {_SIZE} FROM e), s AS (SELECT *, least(384.0::DOUBLE / w, 320.0::DOUBLE / h) AS k FROM i),
    g AS (SELECT ep_key, floor(w * k)::BIGINT AS new_width, floor(h * k)::BIGINT AS new_height FROM s)
    SELECT ep_key, new_width, new_height, (384 - new_width) // 2 AS "left", (320 - new_height) // 2 AS top FROM g""",
)
def letterbox_geometry(spark: SparkSession, root: str) -> DataFrame:
    return _images(spark, root).select("ep_key", *[c.alias(n) for n, c in K.letterbox(F.col("w"), F.col("h"), 384, 320).items()])


def _images(spark: SparkSession, root: str) -> DataFrame:
    """A picture size for each episode."""
    df = _lengths(spark, root)
    return df.select("ep_key", "n", (320 + (F.col("ep_key") % 17) * 32).cast("double").alias("w"), (240 + (F.col("ep_key") % 13) * 20).cast("double").alias("h"))


@query("tshape_geometry", f"WITH {_LEN}, i AS (SELECT ep_key, {_SIZE} FROM e) SELECT ep_key, (h + floor(h / 2))::BIGINT AS height FROM i")
def tshape_geometry(spark: SparkSession, root: str) -> DataFrame:
    return _images(spark, root).select("ep_key", K.t_shape_height(F.col("h")).cast("bigint").alias("height"))


_LOW, _HIGH = 4 * 28 * 28, 300 * 28 * 28


@query(
    "smart_resize",
    f"""WITH {_LEN}, i AS (SELECT ep_key, {_SIZE} FROM e), r AS (SELECT *, greatest(28.0, round_even(h / 28, 0) * 28) AS h0, greatest(28.0, round_even(w / 28, 0) * 28) AS w0, sqrt(h * w / {_HIGH}) AS d FROM i)
    SELECT ep_key, CASE WHEN h0 * w0 > {_HIGH} THEN greatest(28, floor(h / d / 28) * 28) ELSE h0 END::BIGINT AS height,
    CASE WHEN h0 * w0 > {_HIGH} THEN greatest(28, floor(w / d / 28) * 28) ELSE w0 END::BIGINT AS width FROM r""",
)
def smart_resize(spark: SparkSession, root: str) -> DataFrame:
    height, width = K.smart_resize(F.col("h"), F.col("w"), 28, _LOW, _HIGH)
    return _images(spark, root).select("ep_key", height.alias("height"), width.alias("width"))


@query(
    "smart_nframes",
    f"""WITH {_LEN} SELECT ep_key, (floor(least(least(greatest(n / 15.0::DOUBLE * 2, 4.0), least(768.0, floor(n / 2) * 2)), n) / 2) * 2)::BIGINT AS n_frames FROM e""",
)
def smart_nframes(spark: SparkSession, root: str) -> DataFrame:
    return _lengths(spark, root).select("ep_key", K.smart_frames(F.col("n"), F.lit(15.0)).alias("n_frames"))


@query(
    "linspace_indices",
    f"WITH {_LEN} SELECT ep_key, i AS slot, round_even(i * (n - 1) / 7.0::DOUBLE, 0)::BIGINT AS frame FROM e, range(0, 8) r(i)",
)
def linspace_indices(spark: SparkSession, root: str) -> DataFrame:
    return _lengths(spark, root).select("ep_key", F.posexplode(K.linspace_indices(F.col("n"), 8)).alias("slot", "frame"))
