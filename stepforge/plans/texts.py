"""Instruction text: cleaning, slugs, grouping, filters, lines and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions import text as T
from stepforge.plans.common import EPISODES, FILES, STEPS, episodes, files, finite, sql_list, steps
from stepforge.registry import query
from stepforge.tables import table

_SLUG = """CASE WHEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '[\\s/\\\\]+', '_', 'g'), '[^a-z0-9_]+', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') = ''
    THEN 'unknown_task' ELSE substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '[\\s/\\\\]+', '_', 'g'), '[^a-z0-9_]+', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 1, 80) END"""
_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+'), lambda w: w <> '')"
_KEPT = f"list_filter({_TOKENS}, lambda w: NOT list_contains({sql_list([*T.STOP_WORDS, *T.COLORS])}, w))"
_KEY = f"array_to_string((CASE WHEN len({_KEPT}) > 0 THEN {_KEPT} ELSE {_TOKENS} END)[1:6], ' ')"


@query("task_slug", f"WITH {EPISODES} SELECT ep_key, {_SLUG.format('instruction')} AS slug FROM ep")
def task_slug(spark: SparkSession, root: str) -> DataFrame:
    return episodes(spark, root, "instruction").select("ep_key", T.task_slug(F.col("instruction")).alias("slug"))


@query("instruction_group_key", f"WITH {EPISODES} SELECT ep_key, {_KEY.format('instruction')} AS group_key FROM ep")
def instruction_group_key(spark: SparkSession, root: str) -> DataFrame:
    return episodes(spark, root, "instruction").select("ep_key", T.group_key(F.col("instruction")).alias("group_key"))


@query(
    "task_grouping",
    f"""WITH {EPISODES}, k AS (SELECT ep.*, task_grouping, {_KEY.format('instruction')} AS key FROM ep JOIN convert_config USING (dataset))
    SELECT dataset, CASE WHEN task_grouping = 'normalized_instruction' THEN {_SLUG.format('key')} ELSE {_SLUG.format('instruction')} END AS slug,
    count(*) AS n_episodes FROM k GROUP BY ALL""",
)
def task_grouping(spark: SparkSession, root: str) -> DataFrame:
    """Episodes per task folder, under the grouping that the dataset is configured with."""
    config = table(spark, root, "convert_config", "dataset", "task_grouping")
    slug = T.grouped_slug(F.col("instruction"), F.col("task_grouping"))
    return (
        episodes(spark, root, "dataset", "instruction")
        .join(config, "dataset")
        .groupBy("dataset", slug.alias("slug"))
        .agg(F.count(F.lit(1)).alias("n_episodes"))
    )


@query(
    "invalid_instruction_filter",
    f"""WITH {EPISODES} SELECT ep_key, instruction FROM ep LEFT JOIN convert_config c USING (dataset)
    WHERE trim(coalesce(instruction, '')) <> '' AND
    len(list_filter(coalesce(invalid_instruction_patterns, []), lambda p: p <> '' AND contains(lower(instruction), p))) = 0""",
)
def invalid_instruction_filter(spark: SparkSession, root: str) -> DataFrame:
    """Episodes whose instruction is neither blank nor hit by a configured pattern."""
    config = table(spark, root, "convert_config", "dataset", "invalid_instruction_patterns")
    joined = episodes(spark, root, "dataset", "instruction").join(config, "dataset", "left")
    return joined.where(~T.is_invalid(F.col("instruction"), F.col("invalid_instruction_patterns"))).select("ep_key", "instruction")


@query(
    "first_non_empty_instruction",
    f"""WITH {EPISODES} SELECT ep_key,
    coalesce(trim(list_filter([split, instruction, task_slug], lambda x: trim(x) <> '' AND x <> split)[1]), '') AS first_text FROM ep""",
)
def first_non_empty_instruction(spark: SparkSession, root: str) -> DataFrame:
    df = episodes(spark, root, "split", "instruction", "task_slug")
    texts = F.array(F.when(F.col("split").isNull(), F.col("split")), F.col("instruction"), F.col("task_slug"))
    return df.select("ep_key", T.first_non_empty(texts).alias("first_text"))


@query(
    "first_instruction_across_columns",
    """SELECT instr_id, CASE WHEN json_valid(instructions) AND json_type(instructions) = 'OBJECT' THEN
    coalesce(nullif(trim(json_extract_string(instructions, '$.language_instruction')), ''),
             nullif(trim(json_extract_string(instructions, '$.language_instruction_2')), ''),
             nullif(trim(json_extract_string(instructions, '$.language_instruction_3')), ''), '') ELSE '' END AS first_text
    FROM instruction_records""",
)
def first_instruction_across_columns(spark: SparkSession, root: str) -> DataFrame:
    """The first of language_instruction, _2 and _3 that isn't blank."""
    df = table(spark, root, "instruction_records", "instr_id", "instructions")
    fields = [F.get_json_object("instructions", f"$.language_instruction{s}") for s in ("", "_2", "_3")]
    valid = F.try_parse_json("instructions").isNotNull()
    return df.select("instr_id", F.when(valid, T.coalesce_text(fields)).otherwise(F.lit("")).alias("first_text"))


_BY_STEP = "(SELECT ep_key, instr_id, k, json_extract_string(instructions, '$.' || f) AS x FROM instruction_records, (SELECT unnest([1, 2, 3]) AS k, unnest(['language_instruction', 'language_instruction_2', 'language_instruction_3']) AS f) WHERE ep_key IS NOT NULL AND json_valid(instructions) AND json_type(instructions) = 'OBJECT')"


@query(
    "first_instruction_by_step",
    f"SELECT ep_key, trim(arg_min(x, instr_id * 10 + k)) AS by_step, trim(arg_min(x, k * 1000000000000 + instr_id)) AS by_column FROM {_BY_STEP} WHERE trim(x) <> '' GROUP BY ep_key",
)
def first_instruction_by_step(spark: SparkSession, root: str) -> DataFrame:
    """The first text of an episode's records: record by record with all fields of each, and field by field over all records."""
    df = table(spark, root, "instruction_records", "ep_key", "instr_id", "instructions").where(F.col("ep_key").isNotNull() & F.try_parse_json("instructions").isNotNull())
    fields = [F.struct(F.lit(k + 1).alias("k"), F.trim(F.get_json_object("instructions", f"$.language_instruction{s}")).alias("x")) for k, s in enumerate(("", "_2", "_3"))]
    long = df.select("ep_key", "instr_id", F.explode(F.array(*fields)).alias("f")).select("ep_key", "instr_id", "f.k", "f.x").where("x <> ''")
    return long.groupBy("ep_key").agg(F.min_by("x", F.struct("instr_id", "k")).alias("by_step"), F.min_by("x", F.struct("k", "instr_id")).alias("by_column"))


@query("meta_prefix", f"""WITH {EPISODES} SELECT ep_key, 'The scene is filmed from above. ' || coalesce(instruction, '') AS line FROM ep""")
def meta_prefix(spark: SparkSession, root: str) -> DataFrame:
    """A fixed scene sentence before each instruction; alone where there is none."""
    df = episodes(spark, root, "instruction")
    return df.select("ep_key", F.concat(F.lit("The scene is filmed from above. "), F.coalesce("instruction", F.lit(""))).alias("line"))


_SUFFIX = "<setup_start>two arms<setup_end><control_start>joints<control_end>."


@query(
    "setup_control_suffix",
    f"""WITH {EPISODES}, x AS (SELECT ep_key, coalesce(instruction, '') AS i FROM ep)
    SELECT ep_key, i || CASE WHEN i = '' OR regexp_matches(i, '[ \\n\\t]$') THEN '' ELSE ' ' END || '{_SUFFIX}' AS prompt FROM x""",
)
def setup_control_suffix(spark: SparkSession, root: str) -> DataFrame:
    df = episodes(spark, root, "instruction")
    return df.select("ep_key", T.with_suffix(F.coalesce("instruction", F.lit("")), "two arms", "joints").alias("prompt"))


_LINES = "list_filter(string_split({0}, chr(10)), lambda x: trim(x) <> '')"


@query(
    "meta_line_split",
    f"""WITH d AS (SELECT doc_id, CASE WHEN len({_LINES.format('text')}) > 0 THEN {_LINES.format('text')} ELSE [trim(text)] END AS l
    FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, (i - 1)::INT AS line_no, l[i] AS line FROM d, range(1, 100000) r(i) WHERE i <= len(l)""",
)
def meta_line_split(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return df.select("doc_id", F.posexplode(T.meta_lines(F.col("text"))).alias("line_no", "line"))


@query(
    "line_lookup_clamped",
    f"""WITH d AS (SELECT doc_id, {_LINES.format('trim(text)')} AS l FROM documents)
    SELECT doc_id, trim(l[least(3, len(l) - 1) + 1]) AS line FROM d""",
)
def line_lookup_clamped(spark: SparkSession, root: str) -> DataFrame:
    """Line 3 of each document, or its last."""
    df = table(spark, root, "documents", "doc_id", "text")
    return df.select("doc_id", T.line_at(F.col("text"), F.lit(3)).alias("line"))


@query(
    "instruction_text_variants",
    f"""WITH d AS (SELECT doc_id, source, trim(text) AS t, {_LINES.format('text')} AS l FROM documents)
    SELECT doc_id, CASE WHEN source IN ('teleop_notes', 'lab_wiki') THEN t
    WHEN source = 'task_cards' THEN coalesce(l[doc_id % greatest(len(l), 1) + 1], '') ELSE coalesce(trim(l[1]), '') END AS instruction
    FROM d""",
)
def instruction_text_variants(spark: SparkSession, root: str) -> DataFrame:
    """The whole file, a chosen line, or the first line, by kind of source."""
    df = table(spark, root, "documents", "doc_id", "source", "text")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    chosen = F.get(lines, (F.col("doc_id") % F.greatest(F.size(lines), F.lit(1))).cast("int"))
    return df.select(
        "doc_id",
        F.when(F.col("source").isin("teleop_notes", "lab_wiki"), F.trim("text"))
        .when(F.col("source") == "task_cards", F.coalesce(chosen, F.lit("")))
        .otherwise(F.coalesce(F.trim(F.get(lines, F.lit(0))), F.lit("")))
        .alias("instruction"),
    )


@query(
    "instruction_from_meta",
    """SELECT instr_id, coalesce(CASE WHEN json_valid(instructions) AND json_type(instructions) = 'OBJECT' THEN
    coalesce(json_extract_string(instructions, '$.captions[0]'), json_extract_string(instructions, '$.task')) END, '') AS instruction
    FROM instruction_records""",
)
def instruction_from_meta(spark: SparkSession, root: str) -> DataFrame:
    """The first text of the list field, else the single field, else ''."""
    df = table(spark, root, "instruction_records", "instr_id", "instructions")
    found = F.coalesce(F.get_json_object("instructions", "$.captions[0]"), F.get_json_object("instructions", "$.task"))
    valid = F.try_parse_json("instructions").isNotNull()
    return df.select("instr_id", F.coalesce(F.when(valid, found), F.lit("")).alias("instruction"))


@query(
    "prompt_template",
    f"""WITH {EPISODES} SELECT ep_key, 'Task: ' || coalesce(task_slug, 'unknown_task') || '. Instruction: ' || coalesce(instruction, '')
    || ' Frames 0 to ' || coalesce(n_steps - 1, 0) || '.' AS prompt FROM ep""",
)
def prompt_template(spark: SparkSession, root: str) -> DataFrame:
    df = episodes(spark, root, "task_slug", "instruction", "n_steps")
    last = F.coalesce(F.col("n_steps") - 1, F.lit(0)).cast("string")
    return df.select(
        "ep_key",
        F.concat(
            F.lit("Task: "), F.coalesce("task_slug", F.lit("unknown_task")), F.lit(". Instruction: "),
            F.coalesce("instruction", F.lit("")), F.lit(" Frames 0 to "), last, F.lit("."),
        ).alias("prompt"),
    )


@query(
    "sanitize_line",
    """SELECT doc_id, coalesce(nullif(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ''), 'No description.') AS line FROM documents""",
)
def sanitize_line(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", T.sanitize_line(F.col("text"), "No description.").alias("line"))


@query(
    "canonicalize",
    """SELECT doc_id, trim(regexp_replace(lower(regexp_replace(replace(text, '_', ' '), '[!-/:-@\\[-`{-~]', '', 'g')), '\\s+', ' ', 'g')) AS clean,
    length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n_clean FROM documents""",
)
def canonicalize(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "documents", "doc_id", "text")
    return df.select(
        "doc_id",
        T.canonicalize(F.col("text")).alias("clean"),
        F.char_length(T.whitespace_clean(F.col("text"))).cast("bigint").alias("n_clean"),
    )


@query("basic_clean")
def basic_clean(spark: SparkSession, root: str) -> DataFrame:
    """HTML entities resolved; Python, as there is no built-in."""
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", T.basic_clean("text").alias("clean"))


_N = "CASE WHEN isfinite(v) THEN v END"


@query(
    "round_to_nearest",
    f"""WITH {STEPS}, x AS (SELECT ep_key, t, epos[6]::DOUBLE * 180 / pi() AS v FROM st WHERE epos IS NOT NULL)
    SELECT ep_key, t, round_even(v / 10, 0) * 10 + 0.0 AS near, floor(v / 8) * 8 AS down FROM x WHERE isfinite(v)""",
)
def round_to_nearest(spark: SparkSession, root: str) -> DataFrame:
    """Angles to the next 10 degrees (halves to even), and down to multiples of 8."""
    df = steps(spark, root, "epos").where("epos IS NOT NULL")
    v = F.get("epos", F.lit(5)).cast("double") * 180 / F.pi()
    df = df.select("ep_key", "t", v.alias("v")).where(finite())
    return df.select("ep_key", "t", T.nearest(F.col("v"), 10).alias("near"), T.round_down(F.col("v"), 8).cast("double").alias("down"))


@query(
    "format_numeric",
    f"""WITH {STEPS}, x AS (SELECT ep_key, t, round(abs(epos[1]::DOUBLE) * 100, 6) AS v FROM st WHERE epos IS NOT NULL)
    SELECT ep_key, t, '' AS none, printf('%.0f', round_even(v / 10, 0) * 10) AS tens, printf('%.0f', round_even(v, 0)) AS whole
    FROM x WHERE isfinite(v)""",
)
def format_numeric(spark: SparkSession, root: str) -> DataFrame:
    df = steps(spark, root, "epos").where("epos IS NOT NULL")
    v = F.round(F.abs(F.get("epos", F.lit(0)).cast("double")) * 100, 6)
    df = df.select("ep_key", "t", v.alias("v")).where(finite())
    styles = {"none": "no_number", "tens": "nearest_10", "whole": "0f"}
    return df.select("ep_key", "t", *[T.format_numeric(F.col("v"), s).alias(n) for n, s in styles.items()])


@query(
    "natural_sort",
    f"""WITH {EPISODES}, k AS (SELECT ep_key, dataset, episode_id, lpad(episode_id, 20, '0') AS key FROM ep WHERE regexp_matches(episode_id, '^[0-9]+$'))
    SELECT ep_key, row_number() OVER (PARTITION BY dataset ORDER BY key, ep_key) AS place FROM k""",
)
def natural_sort(spark: SparkSession, root: str) -> DataFrame:
    """Place of each episode in its dataset by its number, whether it is padded or not.

    Ranks come from running totals, so that a dataset of any size is no single task's work.
    """
    from stepforge.operators.ranking import ranked

    df = episodes(spark, root, "dataset", "episode_id").where(F.col("episode_id").rlike("^[0-9]+$"))
    keyed = df.withColumn("_key", T.natural_key(F.col("episode_id")))
    return ranked(keyed, ["dataset"], F.col("episode_id").cast("bigint"), [F.col("_key"), F.col("ep_key")], "place").select("ep_key", "place")


_LOG = "'[run ' || (ep_key % 7) || '] ' || CASE WHEN ep_key % 5 = 0 THEN 'Traceback (most recent call last)' WHEN ep_key % 5 = 1 THEN 'success_rate: 0.' || lpad((ep_key % 100)::VARCHAR, 2, '0') WHEN ep_key % 5 = 2 THEN 'nothing to see' ELSE 'Success rate: 3/9 => 10%' || chr(10) || chr(27) || '[32mSuccess rate: ' || (ep_key % 9) || '/9 => ' || (ep_key % 101) || '.5%' || chr(27) || '[0m' END"


def eval_logs(spark: SparkSession, root: str) -> DataFrame:
    """A log text for each episode, in the forms that evaluation runs leave."""
    k = F.col("ep_key")
    text = (
        F.when(k % 5 == 0, F.lit("Traceback (most recent call last)"))
        .when(k % 5 == 1, F.concat(F.lit("success_rate: 0."), F.lpad((k % 100).cast("string"), 2, "0")))
        .when(k % 5 == 2, F.lit("nothing to see"))
        .otherwise(F.format_string("Success rate: 3/9 => 10%%\n\x1b[32mSuccess rate: %d/9 => %d.5%%\x1b[0m", k % 9, k % 101))
    )
    df = episodes(spark, root, "task_slug")
    return df.select("ep_key", "task_slug", F.concat(F.format_string("[run %d] ", k % 7), text).alias("log"))


_SCORE = """CASE WHEN contains(log, 'Success rate:') THEN regexp_extract(list_filter(string_split(regexp_replace(log, '\\x1b\\[[0-9;]*m', '', 'g'), chr(10)), lambda x: contains(x, 'Success rate:'))[-1], '=>\\s*(\\d+\\.?\\d*)%', 1)::DOUBLE
    WHEN contains(log, 'success_rate:') THEN round_even(regexp_extract(log, '(\\d+\\.?\\d*)', 1)::DOUBLE * 100, 1) WHEN contains(log, 'Traceback') THEN 0.0 END"""
_SCORES = f"{EPISODES}, lg AS (SELECT ep_key, task_slug, {_LOG} AS log FROM ep), sc AS (SELECT ep_key, task_slug, log, {_SCORE} AS score FROM lg)"


@query("eval_score_extract", f"WITH {_SCORES} SELECT ep_key, score FROM sc")
def eval_score_extract(spark: SparkSession, root: str) -> DataFrame:
    return eval_logs(spark, root).select("ep_key", T.eval_score(F.col("log")).alias("score"))


@query(
    "eval_log_summary",
    f"""WITH {_SCORES} SELECT task_slug, round(avg(score), 6) AS average, count(*) FILTER (score >= 50) AS passed,
    count(*) FILTER (score < 50) AS failed, count(*) FILTER (score IS NULL) AS unknown FROM sc GROUP BY task_slug""",
)
def eval_log_summary(spark: SparkSession, root: str) -> DataFrame:
    """Average score, passes (at least 50) and failures of each task."""
    scores = eval_logs(spark, root).withColumn("score", T.eval_score(F.col("log")))
    return scores.groupBy("task_slug").agg(
        F.round(F.avg("score"), 6).alias("average"),
        F.count_if(F.col("score") >= 50).alias("passed"),
        F.count_if(F.col("score") < 50).alias("failed"),
        F.count_if(F.col("score").isNull()).alias("unknown"),
    )


@query(
    "eval_run_summary",
    f"""WITH {EPISODES}, r AS (SELECT dataset, task_slug, max(CASE WHEN text IS NOT NULL AND regexp_matches(text, 'completed successfully|Success rate|success rate') THEN 1 ELSE 0 END) AS ok
    FROM ep LEFT JOIN documents d USING (task_slug) GROUP BY dataset, task_slug)
    SELECT dataset, count(*) AS n_tasks, sum(ok)::BIGINT AS n_ok, round(100.0 * sum(ok) / count(*), 6) AS rate FROM r GROUP BY dataset""",
)
def eval_run_summary(spark: SparkSession, root: str) -> DataFrame:
    """Tasks with a log that says success, per dataset; a task without a log failed.

    Logs become one flag per task before the join, so no task_slug multiplies rows.
    """
    good = F.col("text").rlike("completed successfully|Success rate|success rate")
    logs = table(spark, root, "documents", "task_slug", "text").groupBy("task_slug").agg(F.max(good.cast("int")).alias("ok"))
    tasks = episodes(spark, root, "dataset", "task_slug").select("dataset", "task_slug").distinct()
    runs = tasks.join(logs, "task_slug", "left").withColumn("ok", F.coalesce("ok", F.lit(0)))
    return runs.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum("ok").alias("n_ok"),
        F.round(F.sum("ok") * 100.0 / F.count(F.lit(1)), 6).alias("rate"),
    )


@query(
    "parse_device_list",
    f"""WITH {EPISODES}, d AS (SELECT ep_key, CASE ep_key % 4 WHEN 0 THEN '0,' || (ep_key % 8) WHEN 1 THEN 'cuda:0, cuda:3' WHEN 2 THEN 'cpu' ELSE 'gpu0' END AS devices FROM ep)
    SELECT ep_key, CASE ep_key % 4 WHEN 0 THEN 'cuda:0,cuda:' || (ep_key % 8) WHEN 1 THEN 'cuda:0,cuda:3' WHEN 2 THEN 'cpu' END AS devices FROM d""",
)
def parse_device_list(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("ep_key")
    spec = F.when(k % 4 == 0, F.format_string("0,%d", k % 8)).when(k % 4 == 1, "cuda:0, cuda:3").when(k % 4 == 2, "cpu").otherwise("gpu0")
    return episodes(spark, root, "dataset").select("ep_key", T.device_list(spec).alias("devices"))


@query("checkpoint_step_parse", "SELECT ep_key, n_rows AS step FROM (SELECT DISTINCT ep_key, n_rows FROM episode_stats WHERE n_rows IS NOT NULL)")
def checkpoint_step_parse(spark: SparkSession, root: str) -> DataFrame:
    stats = table(spark, root, "episode_stats", "ep_key", "n_rows").where("n_rows IS NOT NULL").distinct()
    return stats.select("ep_key", T.checkpoint_step(F.format_string("runs/a/step_%d/model", F.col("n_rows"))).alias("step"))


_FIELD_LIST = sql_list(["caption", "captions", "seen", "language_instruction", "language_instruction_2", "language_instruction_3"])


@query(
    "instruction_json_scan",
    f"""WITH v AS (SELECT instr_id, instructions::JSON AS j FROM instruction_records WHERE json_valid(instructions)),
    o AS (SELECT instr_id, j FROM v WHERE json_type(j) = 'OBJECT' UNION ALL SELECT instr_id, e FROM (SELECT instr_id, unnest(json_extract(j, '$[*]')) AS e FROM v WHERE json_type(j) = 'ARRAY') WHERE json_type(e) = 'OBJECT'),
    f AS (SELECT instr_id, json_extract(j, '$.' || k) AS x FROM o, (SELECT unnest({_FIELD_LIST}) AS k))
    SELECT instr_id, json_extract_string(e, '$') AS text FROM (SELECT instr_id, unnest(json_extract(j, '$[*]')) AS e FROM v WHERE json_type(j) = 'ARRAY') WHERE json_type(e) = 'VARCHAR'
    UNION ALL SELECT instr_id, json_extract_string(x, '$') FROM f WHERE json_type(x) = 'VARCHAR'
    UNION ALL SELECT instr_id, json_extract_string(e, '$') FROM (SELECT instr_id, unnest(json_extract(x, '$[*]')) AS e FROM f WHERE json_type(x) = 'ARRAY') WHERE json_type(e) = 'VARCHAR'""",
)
def instruction_json_scan(spark: SparkSession, root: str) -> DataFrame:
    """One row per instruction text of the nested records."""
    from stepforge.sources.instructions import instruction_rows

    return instruction_rows(table(spark, root, "instruction_records", "instr_id", "instructions"), "instr_id", "instructions")


_PENDING = f"{EPISODES}, {FILES} SELECT ep_key, coalesce(instruction, '') AS text FROM ep WHERE ep_key NOT IN (SELECT ep_key FROM fl WHERE kind = 'umt5_wan' AND ep_key IS NOT NULL)"


@query("text_embed", f"WITH p AS (WITH {_PENDING}) SELECT ep_key, list_transform(range(0, 8), lambda i: (('0x' || substr(md5(text), 2 * i::INT + 1, 2))::INT / 256)::DOUBLE) AS embedding FROM p")
def text_embed(spark: SparkSession, root: str) -> DataFrame:
    """Embeddings of the instructions that have none yet, with a stub for the model."""
    from stepforge.operators.catalog import pending
    from stepforge.operators.models import embed, stub_embedder

    done = files(spark, root).where("kind = 'umt5_wan'").select("ep_key")
    made = embed(pending(episodes(spark, root, "instruction"), done, ["ep_key"]), "ep_key", "instruction", lambda: stub_embedder)
    return made.select("ep_key", F.col("embedding").cast("array<double>").alias("embedding"))


_WINDOW_SQL = f"""WITH {STEPS}, w AS (SELECT ep_key, t, t AS a, t + count(*) OVER (PARTITION BY ep_key ORDER BY t ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS b FROM st)
    SELECT ep_key, t, 'videos/' || ep_key || '.mp4 frames ' || array_to_string(list_sort(list_distinct([a, a + (b - a - 1) // 2, b - 1])), ' ') AS line FROM w"""


@query("window_caption", _WINDOW_SQL)
def window_caption(spark: SparkSession, root: str) -> DataFrame:
    """A line for the window that begins at each step, with a stub for the model."""
    from stepforge.operators.models import caption, stub_captioner
    from stepforge.plans.motion import window_frames

    windows = window_frames(spark, root).withColumn("path", F.format_string("videos/%d.mp4", F.col("ep_key")))
    return caption(windows, ["ep_key", "t"], "path", "frames", lambda: stub_captioner)
