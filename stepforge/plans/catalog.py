"""Scans of file inventories, catalogs of complete episodes, pending work, upserts, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.operators import catalog as C
from stepforge.operators.prefix import id_block, running_total
from stepforge.operators.ranking import ranked
from stepforge.functions.schedules import nearest_in
from stepforge.operators.skewjoin import lookup_by_key
from stepforge.plans.common import EPISODES, FILES, STEPS, episodes, files, sql_list, steps, stored_steps
from stepforge.registry import query
from stepforge.tables import table

KEY = ["dataset", "split", "task_slug", "episode_id"]
_KEY = ", ".join(KEY)
REQUIRED = ["qpos", "epos", "umt5_wan", "videos"]


@query(
    "tfrecord_shard_scan",
    """SELECT dataset, split, kind, count(*) FILTER (file_path NOT LIKE '%.gstmp') AS n_shards, count(*) FILTER (file_path LIKE '%.gstmp') AS n_unfinished,
    min(try_cast(regexp_extract(file_path, '(\\d+)\\.[a-z0-9]+$', 1) AS BIGINT)) FILTER (file_path NOT LIKE '%.gstmp') AS first_shard,
    max(try_cast(regexp_extract(file_path, '(\\d+)\\.[a-z0-9]+$', 1) AS BIGINT)) FILTER (file_path NOT LIKE '%.gstmp') AS last_shard
    FROM episode_files WHERE regexp_matches(file_path, '(\\d+)\\.[a-z0-9]+(\\.gstmp)?$') GROUP BY ALL""",
)
def tfrecord_shard_scan(spark: SparkSession, root: str) -> DataFrame:
    """Numbered files of each split and kind, without unfinished ones, and their first and last number."""
    df = table(spark, root, "episode_files", "dataset", "split", "kind", "file_path")
    done = ~F.col("file_path").endswith(".gstmp")
    number = F.when(done, F.regexp_extract("file_path", r"(\d+)\.[a-z0-9]+$", 1).try_cast("bigint"))
    return df.where(F.col("file_path").rlike(r"(\d+)\.[a-z0-9]+(\.gstmp)?$")).groupBy("dataset", "split", "kind").agg(
        F.count_if(done).alias("n_shards"), F.count_if(~done).alias("n_unfinished"), F.min(number).alias("first_shard"), F.max(number).alias("last_shard")
    )


@query(
    "recursive_file_scan",
    """SELECT file_id, file_path FROM episode_files WHERE regexp_matches(file_path, '/[0-9]+\\.pt$')
    AND NOT regexp_matches(file_path, '(^|/)(videos|instructions|umt5_wan|[^/]*_bak|\\.[^/]*)/')""",
)
def recursive_file_scan(spark: SparkSession, root: str) -> DataFrame:
    """Files with numeric names outside folders that are pruned."""
    df = table(spark, root, "episode_files", "file_id", "file_path")
    return df.where(F.col("file_path").rlike(r"/[0-9]+\.pt$") & ~F.col("file_path").rlike(r"(^|/)(videos|instructions|umt5_wan|[^/]*_bak|\.[^/]*)/"))


@query(
    "layout_scan",
    """SELECT file_id, string_split(file_path, '/')[-5] AS dataset, string_split(file_path, '/')[-3] AS task,
    CASE WHEN contains(lower(string_split(file_path, '/')[-4]), 'clean') THEN 'clean' WHEN contains(lower(string_split(file_path, '/')[-4]), 'randomized') THEN 'randomized' END AS subset
    FROM episode_files WHERE contains(lower(string_split(file_path, '/')[-4]), 'clean') OR contains(lower(string_split(file_path, '/')[-4]), 'randomized')""",
)
def layout_scan(spark: SparkSession, root: str) -> DataFrame:
    """Subset of each file by its folder's name; files of neither subset are skipped."""
    df = table(spark, root, "episode_files", "file_id", "file_path")
    parts = C.path_parts(F.col("file_path"))
    folder = F.lower(parts["split"])
    subset = C.subset_of(folder, {})
    return df.select("file_id", parts["dataset"].alias("dataset"), parts["task"].alias("task"), subset.alias("subset")).where("subset IS NOT NULL")


#: Subset of each folder that is named in the settings; others go by their name.
SUBSETS = {"train": "clean", "test": "randomized"}


@query(
    "layout_scan_mapped",
    """WITH f AS (SELECT file_id, string_split(file_path, '/')[-3] AS task, string_split(file_path, '/')[-4] AS folder FROM episode_files)
    SELECT file_id, task, CASE WHEN folder = 'train' THEN 'clean' WHEN folder = 'test' THEN 'randomized' WHEN contains(lower(folder), 'clean') THEN 'clean' WHEN contains(lower(folder), 'randomized') THEN 'randomized' END AS subset
    FROM f WHERE subset IS NOT NULL""",
)
def layout_scan_mapped(spark: SparkSession, root: str) -> DataFrame:
    """Subset of each file by the configured map of folders, else by the folder's name; files of neither are skipped."""
    df = table(spark, root, "episode_files", "file_id", "file_path")
    parts = C.path_parts(F.col("file_path"))
    return df.select("file_id", parts["task"].alias("task"), C.subset_of(parts["split"], SUBSETS).alias("subset")).where("subset IS NOT NULL")


@query(
    "shard_completeness",
    """WITH n AS (SELECT dataset, split, kind, try_cast(regexp_extract(file_path, '(\\d+)\\.[a-z0-9]+$', 1) AS BIGINT) AS n FROM episode_files WHERE file_path NOT LIKE '%.gstmp'),
    d AS (SELECT dataset, split, kind, count(DISTINCT n) AS n_found, max(n) + 1 AS n_expected FROM n WHERE n IS NOT NULL GROUP BY ALL)
    SELECT *, n_expected - n_found AS n_missing FROM d WHERE n_found < n_expected""",
)
def shard_completeness(spark: SparkSession, root: str) -> DataFrame:
    """Numbered file sets of which numbers are missing; the count that is expected is that of the highest number."""
    df = table(spark, root, "episode_files", "dataset", "split", "kind", "file_path").where(~F.col("file_path").endswith(".gstmp"))
    number = F.regexp_extract("file_path", r"(\d+)\.[a-z0-9]+$", 1).try_cast("bigint")
    numbers = df.select("dataset", "split", "kind", number.alias("n")).where("n IS NOT NULL").distinct()
    found = numbers.groupBy("dataset", "split", "kind").agg(F.count(F.lit(1)).alias("n_found"), (F.max("n") + 1).alias("n_expected"))
    return found.where("n_found < n_expected").withColumn("n_missing", F.col("n_expected") - F.col("n_found"))


@query(
    "leaf_dir_discovery",
    f"""WITH {FILES} SELECT dataset, split, task_slug FROM fl GROUP BY ALL HAVING count(DISTINCT kind) FILTER (kind IN ('qpos', 'videos', 'umt5_wan')) = 3""",
)
def leaf_dir_discovery(spark: SparkSession, root: str) -> DataFrame:
    """Task folders that hold all required children."""
    df = table(spark, root, "episode_files", "dataset", "split", "task_slug", "kind", "file_path").where(~F.col("file_path").endswith(".gstmp"))
    return C.complete_keys(df, ["dataset", "split", "task_slug"], "kind", ["qpos", "videos", "umt5_wan"])


def _complete(required: list[str]) -> str:
    return f"""WITH {FILES} SELECT {_KEY} FROM fl GROUP BY ALL HAVING count(DISTINCT kind) FILTER (list_contains({sql_list(required)}, kind)) = {len(required)}"""


@query("catalog_inner_join", _complete(REQUIRED))
def catalog_inner_join(spark: SparkSession, root: str) -> DataFrame:
    """Episodes that have all kinds of files."""
    df = table(spark, root, "episode_files", *KEY, "kind", "file_path").where(~F.col("file_path").endswith(".gstmp"))
    return C.complete_keys(df, KEY, "kind", REQUIRED)


@query(
    "stem_set_intersection",
    f"""WITH {FILES} SELECT dataset, episode_id FROM fl WHERE kind = 'videos' INTERSECT SELECT dataset, episode_id FROM fl WHERE kind = 'umt5_wan' INTERSECT SELECT dataset, episode_id FROM fl WHERE kind = 'qpos'""",
)
def stem_set_intersection(spark: SparkSession, root: str) -> DataFrame:
    df = files(spark, root).select("dataset", "episode_id", "kind")
    one = lambda k: df.where(F.col("kind") == k).select("dataset", "episode_id")
    return one("videos").intersect(one("umt5_wan")).intersect(one("qpos"))


@query(
    "catalog_optional_kind",
    f"""WITH {FILES} SELECT {_KEY}, bool_or(coalesce(kind = 'instructions', false)) AS has_text FROM fl GROUP BY {_KEY}
    HAVING count(DISTINCT kind) FILTER (kind IN ('qpos', 'videos', 'umt5_wan')) = 3""",
)
def catalog_optional_kind(spark: SparkSession, root: str) -> DataFrame:
    """Episodes with the required kinds, and whether the optional text exists."""
    df = files(spark, root)
    required = ["qpos", "videos", "umt5_wan"]
    have = df.groupBy(*KEY).agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in [*required, "instructions"]])
    return have.where("qpos AND videos AND umt5_wan").select(*KEY, F.col("instructions").alias("has_text"))


@query(
    "instruction_resolution",
    f"""WITH {EPISODES}, own AS (SELECT ep_key, min(trim(instructions)) AS txt FROM instruction_records WHERE instructions IS NOT NULL AND ep_key IS NOT NULL GROUP BY ep_key),
    task AS (SELECT task_slug, min(instruction) AS txt FROM ep WHERE trim(coalesce(instruction, '')) <> '' AND task_slug IS NOT NULL GROUP BY task_slug)
    SELECT ep.ep_key, coalesce(own.txt, task.txt) AS text, CASE WHEN own.txt IS NOT NULL THEN 'episode' ELSE 'task' END AS origin
    FROM ep LEFT JOIN own ON own.ep_key = ep.ep_key LEFT JOIN task ON task.task_slug = ep.task_slug WHERE coalesce(own.txt, task.txt) IS NOT NULL""",
)
def instruction_resolution(spark: SparkSession, root: str) -> DataFrame:
    """An episode's own text, else one of its task; episodes with neither are dropped.

    Both sides are one row per key before they are joined; a task with a third of the episodes is spread.
    """
    df = episodes(spark, root, "task_slug", "instruction")
    records = table(spark, root, "instruction_records", "ep_key", "instructions").where("instructions IS NOT NULL AND ep_key IS NOT NULL")
    own = records.groupBy("ep_key").agg(F.min(F.trim("instructions")).alias("own"))
    has_text = F.trim("instruction") != ""
    task = df.where(F.col("task_slug").isNotNull()).groupBy("task_slug").agg(F.min(F.when(has_text, F.col("instruction"))).alias("shared"), F.count(F.lit(1)).alias("n"))
    rows = df.select("ep_key", "task_slug").join(own, "ep_key", "left")
    joined = lookup_by_key(rows, task, "task_slug", "n", "ep_key", table(spark, root, "episodes", "ep_key").count())
    return joined.select(
        "ep_key", F.coalesce("own", "shared").alias("text"), F.when(F.col("own").isNotNull(), "episode").otherwise("task").alias("origin")
    ).where("text IS NOT NULL")


@query(
    "raw_target_pairing",
    f"""WITH {FILES}, a AS (SELECT dataset, split, task_slug, regexp_extract(file_path, '(\\d+)\\.[a-z0-9]+$', 1)::BIGINT AS n, file_path FROM fl WHERE kind = 'qpos'),
    b AS (SELECT dataset, split, task_slug, regexp_extract(file_path, '(\\d+)\\.[a-z0-9]+$', 1)::BIGINT AS n, file_path FROM fl WHERE kind = 'videos')
    SELECT a.file_path AS target, b.file_path AS raw FROM a LEFT JOIN b USING (dataset, split, task_slug, n)""",
)
def raw_target_pairing(spark: SparkSession, root: str) -> DataFrame:
    """Targets with the raw file of the same number; null where it is missing."""
    number = F.regexp_extract("file_path", r"(\d+)\.[a-z0-9]+$", 1).try_cast("bigint").alias("n")
    df = files(spark, root)
    on = ["dataset", "split", "task_slug", "n"]
    a = df.where("kind = 'qpos'").select(*on[:3], number, F.col("file_path").alias("target"))
    b = df.where("kind = 'videos'").select(*on[:3], number, F.col("file_path").alias("raw"))
    return a.join(b, on, "left").select("target", "raw")


@query(
    "qpos_epos_length_align",
    f"""WITH {STEPS} SELECT ep_key, count(*) FILTER (qpos IS NOT NULL) AS n_qpos, count(*) FILTER (epos IS NOT NULL) AS n_epos,
    least(count(*) FILTER (qpos IS NOT NULL), count(*) FILTER (epos IS NOT NULL)) AS n_kept,
    count(*) FILTER (qpos IS NOT NULL) <> count(*) FILTER (epos IS NOT NULL) AS mismatched FROM st GROUP BY ep_key""",
)
def qpos_epos_length_align(spark: SparkSession, root: str) -> DataFrame:
    """Lengths of both signals, the common length, and whether they differ."""
    has = [F.max(F.col(c).isNotNull()).alias(c) for c in ("qpos", "epos")]
    df = stored_steps(spark, root, "qpos", "epos").groupBy("ep_key", "t").agg(*has).groupBy("ep_key").agg(F.count_if("qpos").alias("n_qpos"), F.count_if("epos").alias("n_epos"))
    return df.withColumn("n_kept", F.least("n_qpos", "n_epos")).withColumn("mismatched", F.col("n_qpos") != F.col("n_epos"))


@query(
    "qpos_epos_trim",
    f"""WITH {STEPS}, q AS (SELECT ep_key, row_number() OVER (PARTITION BY ep_key ORDER BY t) AS row, t AS qpos_t FROM st WHERE qpos IS NOT NULL),
    e AS (SELECT ep_key, row_number() OVER (PARTITION BY ep_key ORDER BY t) AS row, t AS epos_t FROM st WHERE epos IS NOT NULL)
    SELECT ep_key, row, qpos_t, epos_t FROM q JOIN e USING (ep_key, row)""",
)
def qpos_epos_trim(spark: SparkSession, root: str) -> DataFrame:
    """Both signals paired row by row and trimmed to the shorter one."""
    return C.aligned(*_signal_steps(spark, root), ["ep_key"], "t")


@query(
    "qpos_epos_strict",
    f"""WITH {STEPS} SELECT ep_key, count(*) FILTER (qpos IS NOT NULL) AS n_left, count(*) FILTER (epos IS NOT NULL) AS n_right FROM st GROUP BY ep_key HAVING n_left <> n_right""",
)
def qpos_epos_strict(spark: SparkSession, root: str) -> DataFrame:
    """The strict form: episodes whose signals differ in length are errors."""
    return C.misaligned(*_signal_steps(spark, root), ["ep_key"])


def _signal_steps(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    df = stored_steps(spark, root, "qpos", "epos")
    return tuple(df.where(F.col(c).isNotNull()).select("ep_key", "t").distinct() for c in ("qpos", "epos"))


@query(
    "cumulative_offsets",
    f"""WITH {EPISODES}, t AS (SELECT dataset, task_slug, count(*) AS n_episodes, coalesce(sum(n_steps), 0)::BIGINT AS n_frames FROM ep WHERE task_slug IS NOT NULL GROUP BY ALL)
    SELECT dataset, task_slug, n_episodes, n_frames, (sum(n_episodes) OVER w - n_episodes)::BIGINT AS episode_offset, (sum(n_frames) OVER w - n_frames)::BIGINT AS frame_offset FROM t WINDOW w AS (PARTITION BY dataset ORDER BY task_slug)""",
)
def cumulative_offsets(spark: SparkSession, root: str) -> DataFrame:
    return _offsets(spark, root)


def _offsets(spark: SparkSession, root: str) -> DataFrame:
    """Episodes and frames before each task of a dataset; one row per task is in the window."""
    tasks = episodes(spark, root, "dataset", "task_slug", "n_steps").where("task_slug IS NOT NULL").groupBy("dataset", "task_slug").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.coalesce(F.sum("n_steps"), F.lit(0)).alias("n_frames")
    )
    w = Window.partitionBy("dataset").orderBy("task_slug").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    return tasks.withColumn("episode_offset", offset("n_episodes")).withColumn("frame_offset", offset("n_frames"))


@query(
    "episode_offset_lookup",
    f"""WITH {EPISODES}, o AS (SELECT dataset, task_slug, n_episodes, (sum(n_episodes) OVER (PARTITION BY dataset ORDER BY task_slug) - n_episodes)::BIGINT AS lo FROM (SELECT dataset, task_slug, count(*) AS n_episodes FROM ep WHERE task_slug IS NOT NULL GROUP BY ALL)),
    g AS (SELECT dataset, ep_key, row_number() OVER (PARTITION BY dataset ORDER BY ep_key) - 1 AS id FROM ep WHERE task_slug IS NOT NULL)
    SELECT ep_key, id, o.task_slug AS task, id - lo AS local_id FROM g JOIN o ON g.dataset = o.dataset AND id >= lo AND id < lo + n_episodes""",
)
def episode_offset_lookup(spark: SparkSession, root: str) -> DataFrame:
    """The task and local number behind each global number of a dataset.

    A task's range of numbers is cut at multiples of OFFSET_BLOCK, so the lookup is a join on (dataset, block) in which a
    number meets only the tasks of its own block, however many tasks or episodes a dataset has.
    """
    tasks = _offsets(spark, root).select("dataset", "task_slug", F.col("episode_offset").alias("lo"), (F.col("episode_offset") + F.col("n_episodes")).alias("hi"))
    blocks = F.sequence(F.floor(F.col("lo") / OFFSET_BLOCK), F.floor((F.col("hi") - 1) / OFFSET_BLOCK))
    tasks = tasks.select(F.col("dataset").alias("_d"), "task_slug", "lo", "hi", F.explode(blocks).alias("_b"))
    df = episodes(spark, root, "dataset", "task_slug").where("task_slug IS NOT NULL").drop("task_slug")
    numbered = ranked(df, ["dataset"], F.col("ep_key"), [F.col("ep_key")], "place").withColumn("id", F.col("place") - 1)
    found = numbered.join(tasks, (F.col("dataset") == F.col("_d")) & (F.floor(F.col("id") / OFFSET_BLOCK) == F.col("_b")) & (F.col("id") >= F.col("lo")) & (F.col("id") < F.col("hi")))
    return found.select("ep_key", "id", F.col("task_slug").alias("task"), (F.col("id") - F.col("lo")).alias("local_id"))


#: Numbers of a dataset that share one key of the lookup.
OFFSET_BLOCK = 4096


@query(
    "line_embedding_pairing",
    """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, (i - 1)::INT AS at, l[i] AS line, embedding[i]::DOUBLE AS v FROM l JOIN embeddings ON vec_id = doc_id, range(1, 65) r(i) WHERE i <= len(l) AND i <= len(embedding)""",
)
def line_embedding_pairing(spark: SparkSession, root: str) -> DataFrame:
    """Each line of a text with the element of its embedding that has the same place."""
    docs = table(spark, root, "documents", "doc_id", "text").where("text IS NOT NULL")
    lines = docs.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("at", "line"))
    values = table(spark, root, "embeddings", F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("at", "v"))
    return lines.join(values, ["doc_id", "at"]).select("doc_id", "at", "line", F.col("v").cast("double").alias("v"))


@query("text_embedding_pairing", f"WITH {FILES} SELECT a.ep_key, a.file_path AS text_path, b.file_path AS embedding_path FROM fl a JOIN fl b ON a.ep_key = b.ep_key WHERE a.kind = 'instructions' AND b.kind = 'umt5_wan'")
def text_embedding_pairing(spark: SparkSession, root: str) -> DataFrame:
    df = files(spark, root)
    a = df.where("kind = 'instructions'").select("ep_key", F.col("file_path").alias("text_path"))
    b = df.where("kind = 'umt5_wan'").select("ep_key", F.col("file_path").alias("embedding_path"))
    return a.join(b, "ep_key")


#: Time steps of a shifted schedule, which are closer together at the start.
_SHIFTED = [1000 * (5.0 * (1.0 - i / 50) / (1.0 + 4.0 * (1.0 - i / 50))) for i in range(50)]


@query(
    "nearest_timestep",
    f"""WITH {STEPS}, g AS (SELECT list(1000 * (5.0::DOUBLE * (1.0 - i / 50) / (1.0 + 4.0::DOUBLE * (1.0 - i / 50))) ORDER BY i) AS ts FROM range(0, 50) r(i)), q AS (SELECT ep_key, t, (t * 37 % 1000)::DOUBLE AS x FROM st),
    d AS (SELECT ep_key, t, ts, list_transform(ts, lambda v: abs(v - x)) AS d FROM q, g)
    SELECT ep_key, t, (list_position(d, list_min(d)) - 1)::BIGINT AS place, round(ts[list_position(d, list_min(d))], 9) AS nearest FROM d""",
)
def nearest_timestep(spark: SparkSession, root: str) -> DataFrame:
    """The place and value of the scheduler's timestep next to each value; the grid is uneven and short, so it is an array and not a join."""
    place = nearest_in(_SHIFTED, (F.col("t") * 37 % 1000).cast("double"))
    df = steps(spark, root).select("ep_key", "t", place.alias("place"))
    return df.select("ep_key", "t", "place", F.round(F.get(F.array(*[F.lit(v) for v in _SHIFTED]), F.col("place").cast("int")), 9).alias("nearest"))


@query("skip_existing", f"WITH {EPISODES}, {FILES}, done AS (SELECT ep_key FROM fl WHERE kind IN ('qpos', 'epos', 'instructions') GROUP BY ep_key HAVING count(DISTINCT kind) = 3) SELECT ep_key, dataset FROM ep WHERE ep_key NOT IN (SELECT ep_key FROM done WHERE ep_key IS NOT NULL)")
def skip_existing(spark: SparkSession, root: str) -> DataFrame:
    """Episodes of which not all outputs exist."""
    done = C.complete_keys(files(spark, root), ["ep_key"], "kind", ["qpos", "epos", "instructions"])
    return C.pending(episodes(spark, root, "dataset"), done, ["ep_key"])


@query(
    "partial_backfill",
    f"""WITH {EPISODES}, {FILES} SELECT ep_key, NOT bool_or(coalesce(kind = 'epos', false)) AS needs_epos, NOT bool_or(coalesce(kind = 'instructions', false)) AS needs_text
    FROM ep LEFT JOIN fl USING (ep_key) GROUP BY ep_key HAVING NOT (bool_or(coalesce(kind = 'epos', false)) AND bool_or(coalesce(kind = 'instructions', false)))""",
)
def partial_backfill(spark: SparkSession, root: str) -> DataFrame:
    """What each episode still lacks, decided output by output."""
    have = files(spark, root).groupBy("ep_key").agg(F.bool_or(F.col("kind") == "epos").alias("e"), F.bool_or(F.col("kind") == "instructions").alias("i"))
    joined = episodes(spark, root, "dataset").select("ep_key").join(have, "ep_key", "left")
    needs = joined.select("ep_key", (~F.coalesce("e", F.lit(False))).alias("needs_epos"), (~F.coalesce("i", F.lit(False))).alias("needs_text"))
    return needs.where("needs_epos OR needs_text")


@query(
    "pending_backfill",
    f"""WITH {FILES}, e AS (SELECT DISTINCT ep_key FROM fl WHERE kind = 'umt5_wan') SELECT dataset, count(*) AS n_texts, count(*) FILTER (e.ep_key IS NULL) AS n_pending, count(e.ep_key) AS n_skipped
    FROM fl LEFT JOIN e USING (ep_key) WHERE kind = 'instructions' GROUP BY dataset""",
)
def pending_backfill(spark: SparkSession, root: str) -> DataFrame:
    """Texts with and without an embedding."""
    df = files(spark, root)
    done = df.where("kind = 'umt5_wan'").select("ep_key").distinct().withColumn("done", F.lit(True))
    texts = df.where("kind = 'instructions'").select("dataset", "ep_key").join(done, "ep_key", "left")
    return texts.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("done").isNull()).alias("n_pending"), F.count("done").alias("n_skipped")
    )


@query(
    "error_report",
    """SELECT kind, count(*) AS n_errors, min(file_path) AS first_path, count(*) FILTER (n_bytes = 0) AS n_empty, count(*) FILTER (file_path LIKE '%.gstmp') AS n_unfinished
    FROM episode_files WHERE n_bytes = 0 OR file_path LIKE '%.gstmp' GROUP BY kind""",
)
def error_report(spark: SparkSession, root: str) -> DataFrame:
    """Faulty files by kind."""
    tmp = F.col("file_path").endswith(".gstmp")
    df = table(spark, root, "episode_files", "kind", "file_path", "n_bytes").where((F.col("n_bytes") == 0) | tmp)
    return df.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_errors"), F.min("file_path").alias("first_path"), F.count_if(F.col("n_bytes") == 0).alias("n_empty"), F.count_if(tmp).alias("n_unfinished")
    )


_OLD = "o AS (SELECT ep_key, signal_kind, min(n_rows) AS n FROM episode_stats WHERE stat_day < DATE '2024-09-01' GROUP BY ALL)"
_NEW = "w AS (SELECT ep_key, signal_kind, max(n_rows) AS n FROM episode_stats WHERE stat_day >= DATE '2024-07-01' GROUP BY ALL)"


def _old_new(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, root, "episode_stats", "ep_key", "signal_kind", "n_rows", "stat_day")
    old = df.where("stat_day < DATE '2024-09-01'").groupBy("ep_key", "signal_kind").agg(F.min("n_rows").alias("n"))
    new = df.where("stat_day >= DATE '2024-07-01'").groupBy("ep_key", "signal_kind").agg(F.max("n_rows").alias("n"))
    return old, new


@query("stats_json_merge", f"WITH {_OLD}, {_NEW} SELECT ep_key, signal_kind, coalesce(w.n, o.n) AS n FROM o FULL JOIN w USING (ep_key, signal_kind)")
def stats_json_merge(spark: SparkSession, root: str) -> DataFrame:
    """Stored and new figures by key; new ones replace stored ones."""
    return C.upsert(*_old_new(spark, root), ["ep_key", "signal_kind"], ["n"])


@query("stats_json_merge_flat", f"WITH {_OLD}, {_NEW} SELECT * FROM o WHERE ep_key IS NULL OR ep_key NOT IN (SELECT ep_key FROM w WHERE ep_key IS NOT NULL) UNION ALL SELECT * FROM w")
def stats_json_merge_flat(spark: SparkSession, root: str) -> DataFrame:
    """The flat form: all stored figures of an episode give way to its new ones."""
    return C.replace_groups(*_old_new(spark, root), ["ep_key"])


@query("jsonl_upsert", f"WITH {_OLD}, {_NEW} SELECT ep_key, signal_kind, coalesce(w.n, o.n) AS n FROM o LEFT JOIN w USING (ep_key, signal_kind)")
def jsonl_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Rows of a list with new values for keys that are in it."""
    return C.patch(*_old_new(spark, root), ["ep_key", "signal_kind"], ["n"])


@query("pointer_patch", f"WITH {_OLD}, {_NEW} SELECT ep_key, signal_kind, CASE WHEN ep_key <= 1000 THEN coalesce(w.n, o.n) ELSE o.n END AS n FROM o LEFT JOIN w USING (ep_key, signal_kind)")
def pointer_patch(spark: SparkSession, root: str) -> DataFrame:
    """Only the first episodes are processed again; the full list keeps its other rows."""
    old, new = _old_new(spark, root)
    return C.patch(old, new.where("ep_key <= 1000"), ["ep_key", "signal_kind"], ["n"])


@query("split_mode_filter", f"WITH {EPISODES} SELECT split, count(*) AS n FROM ep WHERE split IN ('train', 'clean') GROUP BY split")
def split_mode_filter(spark: SparkSession, root: str) -> DataFrame:
    return episodes(spark, root, "split").where(F.col("split").isin("train", "clean")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("signal_alias", "SELECT coalesce(CASE lower(trim(kind)) WHEN 'pos' THEN 'qpos' ELSE lower(trim(kind)) END, 'epos') AS signal, count(*) AS n FROM episode_files GROUP BY ALL")
def signal_alias(spark: SparkSession, root: str) -> DataFrame:
    kind = F.lower(F.trim("kind"))
    alias = F.coalesce(F.when(kind == "pos", "qpos").otherwise(kind), F.lit("epos"))
    return table(spark, root, "episode_files", "kind").groupBy(alias.alias("signal")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "epos_assemble",
    f"""WITH {STEPS}, x AS (SELECT ep_key, t, list_transform(epos, lambda v: v::DOUBLE + 0.0) AS e FROM st WHERE len(epos) >= 7)
    SELECT ep_key, t, e[1:3] AS world, e[4:6] || [e[7]] AS rest FROM x""",
)
def epos_assemble(spark: SparkSession, root: str) -> DataFrame:
    """World vector, and rotation with gripper, of each step that has them; -0.0 is 0.0."""
    df = steps(spark, root, "epos").where(F.col("epos").isNotNull() & (F.size("epos") >= 7))
    x = F.transform(F.col("epos").cast("array<double>"), lambda v: v + F.lit(0.0))
    return df.select("ep_key", "t", F.slice(x, 1, 3).alias("world"), F.concat(F.slice(x, 4, 3), F.array(F.get(x, F.lit(6)))).alias("rest"))


@query(
    "first_n_per_task",
    f"""WITH {EPISODES} SELECT dataset, task_slug, ep_key FROM ep WHERE split <> 'randomized' UNION ALL
    SELECT dataset, task_slug, ep_key FROM (SELECT *, row_number() OVER (PARTITION BY dataset, task_slug ORDER BY CASE WHEN regexp_matches(episode_id, '^[0-9]+$') THEN 0 ELSE 1 END, try_cast(episode_id AS BIGINT), episode_id, ep_key) AS rn FROM ep WHERE split = 'randomized') WHERE rn <= 5""",
)
def first_n_per_task(spark: SparkSession, root: str) -> DataFrame:
    """All episodes, but of the randomized split only the first five of each task, numbers first.

    A rank limit in a window is applied before the shuffle, so a task of any size sends few rows.
    """
    df = episodes(spark, root, "dataset", "split", "task_slug", "episode_id")
    number = F.col("episode_id").try_cast("bigint")
    w = Window.partitionBy("dataset", "task_slug").orderBy(number.asc_nulls_last(), F.col("episode_id"), F.col("ep_key"))
    some = df.where("split = 'randomized'").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    keep = ["dataset", "task_slug", "ep_key"]
    return df.where("split <> 'randomized'").select(*keep).unionByName(some.select(*keep))


@query("chunk_number", f"WITH {EPISODES} SELECT ep_key, ep_key // 1000 AS chunk FROM ep")
def chunk_number(spark: SparkSession, root: str) -> DataFrame:
    return episodes(spark, root, "dataset").select("ep_key", F.expr("ep_key div 1000").alias("chunk"))


@query("rename_map", f"WITH {FILES} SELECT replace(file_path, '/randomized/', '/random/') AS path, file_path AS old_path FROM fl WHERE contains(file_path, '/randomized/') AND replace(file_path, '/randomized/', '/random/') NOT IN (SELECT file_path FROM fl)")
def rename_map(spark: SparkSession, root: str) -> DataFrame:
    """New paths of a folder renaming; those that exist already are skipped."""
    df = files(spark, root).select("file_path")
    moved = df.where(F.col("file_path").contains("/randomized/")).select(F.replace("file_path", F.lit("/randomized/"), F.lit("/random/")).alias("path"), F.col("file_path").alias("old_path"))
    return C.pending(moved, df.select(F.col("file_path").alias("path")), ["path"])


@query(
    "frame_offsets",
    f"WITH {EPISODES} SELECT ep_key, (sum(coalesce(n_steps, 0)) OVER (PARTITION BY dataset ORDER BY ep_key) - coalesce(n_steps, 0))::BIGINT AS first_frame FROM ep",
)
def frame_offsets(spark: SparkSession, root: str) -> DataFrame:
    """The global number of each episode's first frame in its dataset; a dataset of any size is spread over blocks."""
    df = episodes(spark, root, "dataset", "n_steps")
    return running_total(df, ["dataset"], id_block("ep_key"), [F.col("ep_key")], "n_steps", "first_frame").select("ep_key", "first_frame")


@query("split_union", f"WITH {EPISODES} SELECT ep_key, split FROM ep WHERE split = 'train' UNION ALL SELECT ep_key, split FROM ep WHERE split = 'test' UNION ALL SELECT ep_key, split FROM ep WHERE split IN ('clean', 'randomized')")
def split_union(spark: SparkSession, root: str) -> DataFrame:
    """The lists of several splits one after the other, repeats kept."""
    df = episodes(spark, root, "split").select("ep_key", "split")
    parts = [df.where(F.col("split").isin(*s)) for s in (["train"], ["test"], ["clean", "randomized"])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
