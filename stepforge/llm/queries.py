"""Queries of the problems of texts and training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm.containers import container_summary, fill_containers
from stepforge.llm.leakage import leaked_items
from stepforge.llm.mixture import distinct_items, mix, mixture_report, plan_sources
from stepforge.llm.percentiles import exact_percentiles, long_values, merge_states, state_cells, state_percentiles
from stepforge.llm.records import copies, copy_classes
from stepforge.llm.residue import residue_records, without_residue
from stepforge.llm.toxicity import source_rates, toxicity_scores, train
from stepforge.plans.common import DIGITS, significant
from stepforge.registry import query
from stepforge.tables import table


@query("p1_found")
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return copies(table(spark, root, "instruction_records", "instr_id", "instructions"), "instr_id", "instructions")


@query("p1_records")
def p1_records(spark: SparkSession, root: str) -> DataFrame:
    """One row per distinct content with its number of copies."""
    return copy_classes(table(spark, root, "instruction_records", "instr_id", "instructions"), "instr_id", "instructions")


_RECORDS = ("instr_id", "dataset", "task_slug", "instructions")


@query("p2_found")
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return residue_records(table(spark, root, "instruction_records", *_RECORDS))


@query("p2_kept")
def p2_kept(spark: SparkSession, root: str) -> DataFrame:
    """The records without residue."""
    return without_residue(table(spark, root, "instruction_records", *_RECORDS))


def _episodes(spark: SparkSession, root: str) -> DataFrame:
    episodes = table(spark, root, "episodes", "ep_key", "dataset", "n_steps", "ingested_ts")
    return distinct_items(episodes, "ep_key", "dataset", "n_steps", "ingested_ts")


def _mixture(spark: SparkSession, root: str) -> tuple[DataFrame, list]:
    items = _episodes(spark, root)
    sources = table(spark, root, "multi_dataset", "names", "weights", "max_repeats")
    plans = plan_sources(items, sources, "dataset", "n_steps")
    return mix(items, plans, "ep_key", "dataset", "n_steps"), plans


_MIX_SQL = """
    WITH item AS (
        SELECT ep_key, dataset, n_steps::BIGINT AS n_steps FROM episodes
        WHERE ep_key IS NOT NULL AND dataset IS NOT NULL AND n_steps > 0
        QUALIFY row_number() OVER (PARTITION BY ep_key ORDER BY ingested_ts DESC, n_steps DESC, dataset DESC) = 1),
    held AS (SELECT names, weights, greatest(coalesce(max_repeats, 1), 0) AS r, sum(n_steps)::DOUBLE AS size
             FROM multi_dataset JOIN item ON dataset = names WHERE weights > 0 GROUP BY ALL),
    share AS (SELECT *, weights / (SELECT sum(weights ORDER BY names) FROM held) AS s FROM held),
    whole AS (SELECT min(r * size / s) AS t FROM share),
    rate AS (SELECT names, least(CAST(floor(t * s / size * 1073741824 + 0.5) AS BIGINT), r * 1073741824::BIGINT) AS e,
                    CAST('0x' || substr(md5('0|' || names), 1, 8) AS BIGINT) // 4 AS o FROM share, whole),
    placed AS (
        SELECT ep_key, dataset, n_steps, e, o + e * (row_number() OVER (
            PARTITION BY dataset ORDER BY floor(ep_key / 65536), n_steps DESC, ep_key) - 1) AS b
        FROM item JOIN rate ON names = dataset)
"""


@query(
    "p3_mixture",
    _MIX_SQL
    + """SELECT ep_key, dataset, n_steps, unnest(range(1, (b + e) // 1073741824 - b // 1073741824 + 1)) AS copy_no FROM placed""",
)
def p3_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The episodes of the mixture, one row per copy."""
    return _mixture(spark, root)[0]


@query(
    "p3_shares",
    _MIX_SQL
    + """, m AS (SELECT dataset, n_steps, unnest(range(1, (b + e) // 1073741824 - b // 1073741824 + 1)) AS copy_no FROM placed),
    g AS (SELECT dataset, count(*) AS n_items, sum(n_steps)::BIGINT AS reached_size, max(copy_no) AS most_copies FROM m GROUP BY dataset)
    SELECT names AS dataset, r::INT AS max_repeats, size::BIGINT AS held, s AS target_share, t * s AS target_size, coalesce(n_items, 0) AS n_items,
    coalesce(reached_size, 0) AS reached_size, coalesce(reached_size, 0) / (SELECT sum(reached_size) FROM g)::DOUBLE AS reached_share, coalesce(most_copies, 0) AS most_copies
    FROM share JOIN whole ON true LEFT JOIN g ON dataset = names""",
)
def p3_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached sizes and shares of the sources."""
    mixed, plans = _mixture(spark, root)
    return mixture_report(mixed, plans, "dataset", "n_steps")


PERCENTILES = (0.01, 0.25, 0.5, 0.75, 0.99)
_STATS = ("dataset", "signal_kind")
_VALUES = ("dataset", "signal_kind", "stat", "dim")


def _stat_values(spark: SparkSession, root: str, *group: str) -> DataFrame:
    stats = table(spark, root, "episode_stats", "dataset", "signal_kind", "stat_day", "action_dim", "stat_min", "stat_max")
    return long_values(stats, ["stat_min", "stat_max"], "action_dim", group)


_VALUE_SQL = """each AS (
        SELECT dataset, signal_kind, stat_day, action_dim, 'stat_min' AS stat, stat_min AS x FROM episode_stats
        UNION ALL SELECT dataset, signal_kind, stat_day, action_dim, 'stat_max', stat_max FROM episode_stats),
    v AS (SELECT dataset, signal_kind, stat, stat_day, (i - 1)::INT AS dim, x[i] + 0.0 AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM each)
          WHERE i <= action_dim AND x[i] IS NOT NULL AND NOT isnan(x[i]))"""
#: The grid of the states: signed logarithm, linear next to 0, 64 cells to each doubling.
_CELL_SQL = """cell AS (SELECT *, CASE WHEN isinf(v) THEN sign(v)::INT * 1073741824 ELSE floor(sign(v) * (CASE WHEN abs(v) > 1 THEN ln(abs(v)) + 100 * ln(2.0::DOUBLE)
        ELSE ln(1 + abs(v) * pow(2.0::DOUBLE, 100)) END) / (ln(2.0::DOUBLE) / 64))::INT END AS cell FROM v)"""


@query(
    "p6_percentiles",
    f"""
    WITH {_VALUE_SQL},
    r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY dataset, signal_kind, stat, dim) AS n
          FROM v WINDOW w AS (PARTITION BY dataset, signal_kind, stat, dim ORDER BY v)),
    p AS (SELECT unnest({list(PERCENTILES)}::DOUBLE[]) AS p)
    SELECT dataset, signal_kind, stat, dim, p, n, v AS value FROM r, p WHERE rn = greatest(1, ceil(n * p))
    """,
)
def p6_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Exact percentiles per dataset, signal, statistic and dimension."""
    return exact_percentiles(_stat_values(spark, root, *_STATS), _VALUES, PERCENTILES)


@query("p6_day_states", f"WITH {_VALUE_SQL}, {_CELL_SQL} SELECT dataset, signal_kind, stat, dim, stat_day, cell, count(*) AS n FROM cell GROUP BY ALL")
def p6_day_states(spark: SparkSession, root: str) -> DataFrame:
    """Mergeable states of each day."""
    return state_cells(_stat_values(spark, root, *_STATS, "stat_day"), [*_VALUES, "stat_day"])


@query(
    "p6_merged",
    f"""WITH {_VALUE_SQL}, {_CELL_SQL}, s AS (SELECT dataset, signal_kind, stat, dim, cell, count(*) AS n FROM cell GROUP BY ALL),
    u AS (SELECT *, sum(n) OVER w AS upto, sum(n) OVER (PARTITION BY dataset, signal_kind, stat, dim) AS whole FROM s WINDOW w AS (PARTITION BY dataset, signal_kind, stat, dim ORDER BY cell)),
    k AS (SELECT *, abs((cell + 0.5) * (ln(2.0::DOUBLE) / 64)) AS x FROM u, (SELECT unnest({list(PERCENTILES)}::DOUBLE[]) AS p) WHERE upto >= greatest(1, ceil(whole * p)) AND upto - n < greatest(1, ceil(whole * p)))
    SELECT dataset, signal_kind, stat, dim, p, whole::BIGINT AS n, {DIGITS.format("CASE WHEN abs(cell) = 1073741824 THEN sign(cell) * 'inf'::DOUBLE ELSE sign(cell + 0.5) * CASE WHEN x > 100 * ln(2.0::DOUBLE) THEN exp(x - 100 * ln(2.0::DOUBLE)) ELSE (exp(x) - 1) * pow(2.0::DOUBLE, -100) END END")} AS value FROM k""",
)
def p6_merged(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles from the merged states of all days, within 0.54% of the exact ones."""
    merged = state_percentiles(merge_states(p6_day_states(spark, root), _VALUES), _VALUES, PERCENTILES)
    return merged.withColumn("value", F.when(F.abs("value") < F.lit(float("inf")), significant(F.col("value"))).otherwise(F.col("value")))


def _capacity(spark: SparkSession, root: str) -> int:
    """The configured length of a container; the same for all datasets here, else the least."""
    return table(spark, root, "convert_config", "t5_max_length").agg(F.min("t5_max_length")).first()[0] or 512


@query("p8_containers")
def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of each text's pieces."""
    return fill_containers(table(spark, root, "documents", "doc_id", "text"), _capacity(spark, root))


@query("p8_summary")
def p8_summary(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers are."""
    capacity = _capacity(spark, root)
    return container_summary(fill_containers(table(spark, root, "documents", "doc_id", "text"), capacity), capacity)


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaked_items(table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text"))


@query("p9_found")
def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id")


@query("p9_items")
def p9_items(spark: SparkSession, root: str) -> DataFrame:
    """The items that leaked, with the number of documents that hold them."""
    return _leaks(spark, root).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("part").alias("most"))


def _toxicity(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents", "doc_id", "source", "text")
    return toxicity_scores(documents, train(documents, table(spark, root, "doc_labels", "doc_id", "toxic")))


@query("p10_found")
def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _toxicity(spark, root).where("toxic").select("doc_id")


@query("p10_scores")
def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    """The score of every document."""
    return _toxicity(spark, root)


@query("p10_rates")
def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    """The rate of each source."""
    return source_rates(_toxicity(spark, root))
