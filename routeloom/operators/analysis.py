"""Health of a reward matrix: datasets, combinations, per-agent figures, gates and baselines.

Inputs are the long reward matrix ``rm`` (doc_id, agent, pos, n_correct, n_empty,
n_error, n_calls) and ``datasets`` (doc_id, dataset).  Ratios come from integer
counts divided once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERDICTS = ("continue", "warn", "missing", "stop")  # from best to worst
DIGITS = 6


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def error_reduction(oracle: Column, best: Column) -> Column:
    """(oracle - best) / (1 - best), 0 where nothing is left to gain."""
    return F.when(1 - best <= 1e-12, F.lit(0.0)).otherwise((oracle - best) / (1 - best))


def marked(rm: DataFrame) -> DataFrame:
    """rm with each task's best and least count, and how many agents have the best."""
    w = Window.partitionBy("doc_id")
    t = rm.withColumn("top", F.max("n_correct").over(w)).withColumn("low", F.min("n_correct").over(w))
    return t.withColumn("alone", F.sum((F.col("n_correct") == F.col("top")).cast("long")).over(w))


def cells(rm: DataFrame, datasets: DataFrame) -> DataFrame:
    """Everything that health needs, in one pass: sums by (dataset, agent, pos).

    ``top``, ``equal`` and ``unique`` belong to tasks and are the same for each agent of a dataset.  What is derived from
    this table reads its exchange again (Spark reuses it), not the calls.
    """
    won = (F.col("n_correct") == F.col("top")) & (F.col("alone") == 1)
    total = lambda c: F.sum(c.cast("long"))
    return marked(rm).join(datasets, "doc_id").groupBy("dataset", "agent", "pos").agg(
        F.count("*").alias("n_tasks"), *(F.sum(c).alias(c) for c in ("n_correct", "n_empty", "n_error", "n_calls", "top")), F.sum("cost_usd" if "cost_usd" in rm.columns else F.lit(0.0)).alias("cost_usd"),
        total(won).alias("wins"), total(F.col("top") == F.col("low")).alias("equal"), total(F.col("alone") == 1).alias("unique"),
    )


def accuracy_of(cells: DataFrame, repetitions: int) -> DataFrame:
    return cells.select("dataset", "agent", "pos", "n_tasks", "n_correct", (F.col("n_correct") / (F.col("n_tasks") * repetitions)).alias("accuracy"))


def dataset_accuracy(rm: DataFrame, datasets: DataFrame, repetitions: int) -> DataFrame:
    """E(D, M): (dataset, agent, pos, n_tasks, n_correct, accuracy)."""
    g = rm.join(datasets, "doc_id").groupBy("dataset", "agent", "pos").agg(F.count("*").alias("n_tasks"), F.sum("n_correct").alias("n_correct"))
    return accuracy_of(g, repetitions)


def complete(matrix: DataFrame) -> DataFrame:
    """(dataset, agent) pairs that an accuracy matrix lacks; none if it is complete."""
    return matrix.select("dataset").distinct().crossJoin(matrix.select("agent").distinct()).join(matrix, ["dataset", "agent"], "left_anti")


def combination(matrix: DataFrame) -> DataFrame:
    """One row (z, s_star, best_agent, rer, n_datasets): best agent of each dataset against the best single agent.

    The single agent of equal scores that is last by name wins.
    """
    z = matrix.groupBy("dataset").agg(F.max("accuracy").alias("m")).agg(F.avg("m").alias("z"), F.count("*").alias("n_datasets"))
    s = matrix.groupBy("agent").agg(F.round(F.avg("accuracy"), 12).alias("s")).agg(F.max(F.struct("s", "agent")).alias("b"))
    return z.crossJoin(s).select("z", F.col("b.s").alias("s_star"), F.col("b.agent").alias("best_agent"), error_reduction(F.col("z"), F.col("b.s")).alias("rer"), "n_datasets")


def upper_median(latency: Column) -> Column:
    """sorted[n // 2] of the values that aren't null; null if there are none."""
    values = F.array_sort(F.collect_list(latency))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def upper_medians(calls: DataFrame) -> DataFrame:
    """(agent, median_latency_ms) without gathering an agent's calls in one place.

    Calls are counted by value; the median is where the running count passes half, so one row for each distinct value is sorted.
    """
    hist = calls.where("latency_ms is not null").groupBy("agent", "latency_ms").agg(F.count("*").alias("n"))
    w = Window.partitionBy("agent")
    run = hist.withColumn("upto", F.sum("n").over(w.orderBy("latency_ms"))).withColumn("total", F.sum("n").over(w))
    return run.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("agent").agg(F.min("latency_ms").alias("median_latency_ms"))


def per_agent(rm: DataFrame, calls: DataFrame, repetitions: int) -> DataFrame:
    """One row for each agent: mean reward, share of tasks it wins alone, empty and error rates, upper median latency."""
    won = marked(rm)
    g = won.groupBy("agent", "pos").agg(
        F.count("*").alias("n_tasks"),
        F.sum("n_correct").alias("n_correct"),
        F.sum("n_empty").alias("n_empty"),
        F.sum("n_error").alias("n_error"),
        F.sum("n_calls").alias("n_calls"),
        F.sum(((F.col("n_correct") == F.col("top")) & (F.col("alone") == 1)).cast("long")).alias("unique_wins"),
    )
    g = g.join(upper_medians(calls), "agent", "left")
    return g.select(
        "agent", "pos", "n_tasks", "n_correct", "unique_wins", F.coalesce("median_latency_ms", F.lit(0)).alias("median_latency_ms"),
        (F.col("n_correct") / (F.col("n_tasks") * repetitions)).alias("mean_reward"),
        ratio(F.col("unique_wins"), F.col("n_tasks")).alias("unique_best_share"),
        ratio(F.col("n_empty"), F.col("n_calls")).alias("empty_rate"),
        ratio(F.col("n_error"), F.col("n_calls")).alias("error_rate"),
    )


def health(rm: DataFrame, datasets: DataFrame, repetitions: int) -> DataFrame:
    """One row of the twelve flat metrics; total_cost_usd is 0 if the calls had no cost."""
    base = cells(rm, datasets)
    t = base.where("pos = 0").agg(F.sum("n_tasks").alias("n"), *(F.sum(c).alias(c) for c in ("top", "equal", "unique")))
    a = base.groupBy("agent").agg(*(F.sum(c).alias(c) for c in ("n_correct", "n_empty", "n_error", "n_calls", "wins", "cost_usd")))
    a = a.agg(F.max("n_correct").alias("best"), F.sum("cost_usd").alias("cost"), F.max(ratio(F.col("n_empty"), F.col("n_calls"))).alias("empty"), F.max(ratio(F.col("n_error"), F.col("n_calls"))).alias("error"), F.min("wins").alias("wins"), F.count("*").alias("agents"))
    one = t.crossJoin(a).crossJoin(combination(accuracy_of(base, repetitions)))  # one row each
    calls = F.col("n") * repetitions
    oracle, best = F.col("top") / calls, F.col("best") / calls
    return one.select(
        F.col("rer").alias("rer_dataset"),
        error_reduction(oracle, best).alias("rer_per_question"),
        (F.col("equal") / F.col("n")).alias("all_equal_rate"),
        (F.col("unique") / F.col("n")).alias("unique_winner_rate"),
        (F.col("wins") / F.col("n")).alias("min_unique_best_share"),
        (F.col("wins") * F.col("agents") / F.col("n")).alias("min_unique_best_share_scaled"),
        F.col("empty").alias("max_empty_rate"),
        F.col("error").alias("max_error_rate"),
        F.col("n_datasets").cast("double").alias("n_datasets"),
        oracle.alias("oracle_per_question"),
        best.alias("best_single_score"),
        F.col("cost").alias("total_cost_usd"),
    )


def long_metrics(flat: DataFrame) -> DataFrame:
    """(metric, value) of the one row of metrics."""
    return flat.unpivot([], flat.columns, "metric", "value")


def verdict(direction: Column, value: Column, continue_at: Column, stop_at: Column) -> Column:
    low = F.when(value >= continue_at, "continue").when(value <= stop_at, "stop")
    high = F.when(value <= continue_at, "continue").when(value >= stop_at, "stop")
    return F.when(value.isNull(), "missing").otherwise(F.coalesce(F.when(direction == "min", low).otherwise(high), F.lit("warn")))


def gate_verdicts(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """(metric, direction, value, continue_at, stop_at, verdict); a metric that is absent is missing."""
    j = gates.join(F.broadcast(metrics), "metric", "left")  # one row for each metric name
    return j.select("metric", "direction", "value", "continue_at", "stop_at", verdict(F.col("direction"), F.col("value"), F.col("continue_at"), F.col("stop_at")).alias("verdict"))


def rank(v: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), v)


def gate_decision(verdicts: DataFrame) -> DataFrame:
    """One row (decision, n_blocking): the worst verdict, and how many block."""
    return verdicts.agg(F.max_by("verdict", rank(F.col("verdict"))).alias("decision"), F.sum(F.col("verdict").isin("stop", "missing").cast("long")).alias("n_blocking"))


def baselines(rm: DataFrame, repetitions: int) -> DataFrame:
    """One row (best_fixed_agent, best_fixed, uniform, oracle, headroom, n_tasks), none without tasks; the first agent of equal ones is the best."""
    t = rm.groupBy("doc_id").agg(F.max("n_correct").alias("top")).agg(F.sum("top").alias("top"), F.count("*").alias("n_tasks")).where("n_tasks > 0")
    a = rm.groupBy("agent", "pos").agg(F.sum("n_correct").alias("c"))
    a = a.agg(F.max_by("agent", F.struct("c", -F.col("pos"))).alias("best_fixed_agent"), F.max("c").alias("best"), F.sum("c").alias("all"), F.count("*").alias("agents"))
    calls = F.col("n_tasks") * repetitions
    return t.crossJoin(a).select("best_fixed_agent", (F.col("best") / calls).alias("best_fixed"), (F.col("all") / (calls * F.col("agents"))).alias("uniform"), (F.col("top") / calls).alias("oracle"), ((F.col("top") - F.col("best")) / calls).alias("headroom"), "n_tasks")


def redesign_list(verdicts: DataFrame) -> DataFrame:
    """Metrics that call for a redesign: stopped or missing ones."""
    return verdicts.where(F.col("verdict").isin("stop", "missing")).select("metric", "verdict")
