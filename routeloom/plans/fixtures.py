"""Tasks, calls and gates derived from the test tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AGENTS = ("click", "error", "purchase", "signup", "view")
REPETITIONS = 3
PRICES = tuple((a, 0.1 * (k + 1), 0.4 * (k + 1)) for k, a in enumerate(AGENTS))
GATES = (
    ("rer_dataset", "min", 0.10, 0.03),
    ("rer_per_question", "min", 0.15, 0.08),
    ("n_datasets", "min", 3.0, 1.0),
    ("all_equal_rate", "max", 0.45, 0.65),
    ("unique_winner_rate", "min", 0.25, 0.15),
    ("min_unique_best_share_scaled", "min", 0.30, 0.10),
    ("max_empty_rate", "max", 0.02, 0.10),
    ("max_error_rate", "max", 0.02, 0.10),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("task_id"), "doc_id", F.col("text").alias("prompt"), F.col("doc_id").cast("string").alias("answer"),
        F.lit("numeric_match").alias("grader"), F.col("source").alias("dataset"), F.col("lang").alias("domain"), F.when(F.col("n_chars") < 800, "easy").when(F.col("n_chars") < 3000, "medium").otherwise("hard").alias("difficulty"),
        F.when(F.col("source").isin("src18", "src19"), "held_out").otherwise("in_distribution").alias("task_group"), F.lit("MIT").alias("license"), (F.col("doc_id") % 3 != 0).alias("redistributable"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form calls; partitioned by task once, for this and what is aggregated by task from it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("agent"), "event_id", "value")
    w = Window.partitionBy("doc_id", "agent").orderBy("event_id")
    c = e.repartition("doc_id").withColumn("repetition", F.row_number().over(w) - 1).where(F.col("repetition") < REPETITIONS)
    is_error, seventeenth = F.col("event_id") % 97 == 0, F.col("event_id") % 17 == 0
    return c.select(
        "doc_id", "agent", "repetition", "event_id", is_error.alias("is_error"), (seventeenth & ~is_error).alias("is_empty"),
        ((F.col("value") > 30.0) & ~seventeenth & ~is_error).alias("correct"), F.floor(F.col("value") * 100).cast("long").alias("latency_ms"),
        (F.floor(F.col("value") * 100) / 8192.0).alias("cost_usd"),  # a sum of these is exact in any order
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of agents made of the nations."""
    key, name = F.col("n_nationkey").cast("long"), F.lower("n_name")
    return table(spark, sf_dir, "nation").select(
        key.alias("index"), name.alias("id"), F.concat(F.lit("v"), F.col("n_regionkey").cast("string"), F.lit("/"), name).alias("slug"), (key % 2 == 0).alias("is_reasoning_model"), (4096 * (key + 1)).alias("context_window"),
        (key / 4).alias("price_per_1m_prompt_usd"), F.col("n_regionkey").cast("double").alias("price_per_1m_output_usd"), F.lit("2026-01-01").alias("verified_at"), (key % 5 == 3).alias("retired"),
    )


def gates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GATES, "metric string, direction string, continue_at double, stop_at double")


TASKS_SQL = """tasks as (select source || '/' || lang || '/' || lpad(cast(doc_id as varchar), 6, '0') as task_id, doc_id, text as prompt, cast(doc_id as varchar) as answer, 'numeric_match' as grader,
  source as dataset, lang as domain, case when n_chars < 800 then 'easy' when n_chars < 3000 then 'medium' else 'hard' end as difficulty,
  case when source in ('src18', 'src19') then 'held_out' else 'in_distribution' end as task_group, 'MIT' as license, doc_id % 3 <> 0 as redistributable from documents)"""

CALLS_SQL = """calls as (select user_id as doc_id, event_type as agent, rn - 1 as repetition, event_id, event_id % 97 = 0 as is_error, event_id % 17 = 0 and event_id % 97 <> 0 as is_empty,
  value > 30 and event_id % 17 <> 0 and event_id % 97 <> 0 as correct, cast(floor(value * 100) as bigint) as latency_ms, floor(value * 100) / 8192.0::double as cost_usd
  from (select *, row_number() over (partition by user_id, event_type order by event_id) as rn from events) where rn <= 3)"""

_AGENTS_SQL = ", ".join(f"('{a}', {k})" for k, a in enumerate(AGENTS))
RM_SQL = CALLS_SQL + f""",
agents(agent, pos) as (values {_AGENTS_SQL}),
rm as (select t.doc_id, a.agent, a.pos, cast(count(*) filter (c.correct) as bigint) as n_correct, count(*) filter (c.is_empty) as n_empty, count(*) filter (c.is_error) as n_error, count(c.event_id) as n_calls, coalesce(sum(c.cost_usd), 0) as cost_usd
  from (select distinct doc_id from calls) t cross join agents a left join calls c on c.doc_id = t.doc_id and c.agent = a.agent group by 1, 2, 3)"""

GATES_SQL = "gates(metric, direction, continue_at, stop_at) as (values " + ", ".join(f"('{m}', '{d}', cast({a} as double), cast({b} as double))" for m, d, a, b in GATES) + ")"
