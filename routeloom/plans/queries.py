"""The query catalogue: each entry is a Spark plan and, where SQL can express it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import cos, sin

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routeloom.functions import grading
from routeloom.functions import text as t
from routeloom.operators import analysis, catalog, collection, publish, rewards, routing, taskpool
from routeloom.plans import fixtures as fx
from routeloom.plans.fixtures import AGENTS, CALLS_SQL, GATES_SQL, PRICES, REPETITIONS, RM_SQL, TASKS_SQL
from routeloom.sources import mappers, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R = REPETITIONS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _rm(spark: SparkSession, d: str) -> DataFrame:
    return rewards.reward_matrix(fx.calls(spark, d), AGENTS)


def _datasets(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", F.col("source").alias("dataset"))


# Rewards and their analysis


@query(f"with {RM_SQL} select doc_id, agent, n_correct, n_empty, n_error, n_calls, round(n_correct / 3, 6) as reward from rm")
def reward_matrix(spark, d):
    return _rm(spark, d).select("doc_id", "agent", "n_correct", "n_empty", "n_error", "n_calls", r6(F.col("n_correct") / R).alias("reward"))


WINNERS_SQL = RM_SQL + """,
won as (select doc_id, max(n_correct) as max_correct, min(n_correct) as min_correct from rm group by 1),
best as (select w.doc_id, max_correct, min_correct, count(*) as n_winners, string_agg(agent, ',' order by pos) as best_agents, arg_min(agent, pos) as first_agent
  from won w join rm on rm.doc_id = w.doc_id and rm.n_correct = w.max_correct group by 1, 2, 3)"""


@query(f"with {WINNERS_SQL} select doc_id, max_correct, min_correct, n_winners, best_agents, n_winners > 1 as is_tie, max_correct = min_correct as all_equal from best")
def task_winners(spark, d):
    return rewards.winners(_rm(spark, d)).select("doc_id", "max_correct", "min_correct", "n_winners", "best_agents", (F.col("n_winners") > 1).alias("is_tie"), (F.col("max_correct") == F.col("min_correct")).alias("all_equal"))


E_SQL = RM_SQL + """,
e as (select d.source as dataset, agent, pos, count(*) as n_tasks, cast(sum(n_correct) as bigint) as n_correct, cast(sum(n_correct) as bigint) / (count(*) * 3) as accuracy from rm join documents d using (doc_id) group by 1, 2, 3)"""


@query(f"with {E_SQL} select dataset, agent, n_tasks, n_correct, round(accuracy, 6) as accuracy from e")
def dataset_accuracy(spark, d):
    return analysis.dataset_accuracy(_rm(spark, d), _datasets(spark, d), R).select("dataset", "agent", "n_tasks", "n_correct", r6("accuracy").alias("accuracy"))


@query(f"with {E_SQL}, ds as (select distinct dataset from e), ag as (select distinct agent from e) select count(*) as n_missing from (select dataset, agent from ds cross join ag) x anti join e using (dataset, agent)")
def matrix_completeness(spark, d):
    return analysis.complete(analysis.dataset_accuracy(_rm(spark, d), _datasets(spark, d), R)).agg(F.count("*").alias("n_missing"))


COMB_SQL = E_SQL + """,
z as (select avg(m) as z, count(*) as n_datasets from (select max(accuracy) as m from e group by dataset)),
s as (select agent as best_agent, s as s_star from (select agent, round(avg(accuracy), 12) as s from e group by 1) order by s desc, agent desc limit 1),
comb as (select z, s_star, best_agent, n_datasets, case when 1 - s_star <= 1e-12 then 0.0 else (z - s_star) / (1 - s_star) end as rer from z, s)"""


@query(f"with {COMB_SQL} select round(z, 6) as z, round(s_star, 6) as s_star, best_agent, round(rer, 6) as rer, n_datasets from comb")
def combination_best_single_rer(spark, d):
    return analysis.combination(analysis.dataset_accuracy(_rm(spark, d), _datasets(spark, d), R)).select(r6("z").alias("z"), r6("s_star").alias("s_star"), "best_agent", r6("rer").alias("rer"), "n_datasets")


MEDIAN_SQL = "med as (select agent, list_sort(list(latency_ms))[count(*) // 2 + 1] as median_latency_ms from calls group by 1)"
AGENT_SQL = WINNERS_SQL + f""",
{MEDIAN_SQL},
pa as (select rm.agent, rm.pos, count(*) as n_tasks, cast(sum(n_correct) as bigint) as n_correct, cast(sum(n_empty) as bigint) as n_empty, cast(sum(n_error) as bigint) as n_error, cast(sum(n_calls) as bigint) as n_calls,
  count(*) filter (n_winners = 1 and first_agent = rm.agent) as unique_wins from rm join best using (doc_id) group by 1, 2)"""


@query(f"""with {AGENT_SQL} select agent, n_tasks, n_correct, unique_wins, coalesce(median_latency_ms, 0) as median_latency_ms, round(n_correct / (n_tasks * 3), 6) as mean_reward, round(unique_wins / n_tasks, 6) as unique_best_share,
  round(case when n_calls = 0 then 0 else n_empty / n_calls end, 6) as empty_rate, round(case when n_calls = 0 then 0 else n_error / n_calls end, 6) as error_rate from pa left join med using (agent)""")
def per_agent_health(spark, d):
    a = analysis.per_agent(_rm(spark, d), fx.calls(spark, d), R)
    return a.select("agent", "n_tasks", "n_correct", "unique_wins", "median_latency_ms", *(r6(c).alias(c) for c in ("mean_reward", "unique_best_share", "empty_rate", "error_rate")))


@query(f"with {CALLS_SQL}, {MEDIAN_SQL} select agent, median_latency_ms from med")
def upper_median_latency(spark, d):
    return analysis.upper_medians(fx.calls(spark, d))


HEALTH_SQL = AGENT_SQL + "," + COMB_SQL[len(RM_SQL) + 1 :] + """,
tot as (select count(*) as n, cast(sum(max_correct) as bigint) as top, count(*) filter (max_correct = min_correct) as equal, count(*) filter (n_winners = 1) as uniq from best),
agg as (select max(n_correct) as c, max(case when n_calls = 0 then 0 else n_empty / n_calls end) as empty, max(case when n_calls = 0 then 0 else n_error / n_calls end) as error, min(unique_wins) as wins, count(*) as k from pa),
one as (select rer, top / (n * 3) as oracle, c / (n * 3) as fixed, equal / n as equal, uniq / n as uniq, wins / n as low, wins * k / n as scaled, empty, error, cast(n_datasets as double) as nd from tot, agg, comb),
metrics as (select 'rer_dataset' as metric, rer as value from one union all select 'rer_per_question', case when 1 - fixed <= 1e-12 then 0 else (oracle - fixed) / (1 - fixed) end from one
  union all select 'all_equal_rate', equal from one union all select 'unique_winner_rate', uniq from one union all select 'min_unique_best_share', low from one union all select 'min_unique_best_share_scaled', scaled from one
  union all select 'max_empty_rate', empty from one union all select 'max_error_rate', error from one union all select 'n_datasets', nd from one union all select 'oracle_per_question', oracle from one union all select 'best_single_score', fixed from one union all select 'total_cost_usd', (select sum(cost_usd) from rm))"""


def _metrics(spark, d):
    return analysis.long_metrics(analysis.health(_rm(spark, d), _datasets(spark, d), R))


@query(f"with {HEALTH_SQL} select metric, round(value, 6) as value from metrics")
def health_metrics_long(spark, d):
    return _metrics(spark, d).select("metric", r6("value").alias("value"))


VERDICT_SQL = HEALTH_SQL + f""",
{GATES_SQL},
ver as (select metric, direction, value, continue_at, stop_at, case when value is null then 'missing'
  when direction = 'min' then case when value >= continue_at then 'continue' when value <= stop_at then 'stop' else 'warn' end
  else case when value <= continue_at then 'continue' when value >= stop_at then 'stop' else 'warn' end end as verdict from gates left join metrics using (metric))"""


@query(f"with {VERDICT_SQL} select metric, direction, round(value, 6) as value, continue_at, stop_at, verdict from ver")
def gate_verdicts(spark, d):
    return analysis.gate_verdicts(_metrics(spark, d), fx.gates(spark)).withColumn("value", r6("value"))


@query(f"with {VERDICT_SQL} select arg_max(verdict, case verdict when 'continue' then 0 when 'warn' then 1 when 'missing' then 2 else 3 end) as decision, count(*) filter (verdict in ('stop', 'missing')) as n_blocking from ver")
def gate_decision(spark, d):
    return analysis.gate_decision(analysis.gate_verdicts(_metrics(spark, d), fx.gates(spark)))


HELD = "rmt as (select * from rm semi join (select doc_id from documents where source in ('src18', 'src19')) using (doc_id))"


@query(f"""with {RM_SQL}, {HELD}, tt as (select count(*) as n_tasks, cast(sum(m) as bigint) as top from (select max(n_correct) as m from rmt group by doc_id)),
aa as (select agent, pos, cast(sum(n_correct) as bigint) as c from rmt group by 1, 2), b as (select agent, c from aa order by c desc, pos limit 1), u as (select cast(sum(c) as bigint) as c, count(*) as k from aa)
select b.agent as best_fixed_agent, round(b.c / (n_tasks * 3), 6) as best_fixed, round(u.c / (n_tasks * 3 * k), 6) as uniform, round(top / (n_tasks * 3), 6) as oracle, round((top - b.c) / (n_tasks * 3), 6) as headroom, n_tasks from tt, b, u""")
def baselines(spark, d):
    held = fx.tasks(spark, d).where("task_group = 'held_out'").select("doc_id")
    b = analysis.baselines(_rm(spark, d).join(held, "doc_id", "left_semi"), R)
    return b.select("best_fixed_agent", *(r6(c).alias(c) for c in ("best_fixed", "uniform", "oracle", "headroom")), "n_tasks")


CHOICE_SQL = "choice as (select doc_id, case doc_id % 6 when 0 then 'click' when 1 then 'error' when 2 then 'purchase' when 3 then 'signup' when 4 then 'view' else 'nobody' end as agent from documents)"


def _choices(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, (*AGENTS, "nobody"))), (F.col("doc_id") % 6 + 1).cast("int")).alias("agent"))


@query(f"with {RM_SQL}, {CHOICE_SQL}, x as (select n_correct, max(n_correct) over (partition by doc_id) as top, doc_id, agent from rm), y as (select x.* from x join choice using (doc_id, agent)) select count(*) as n_scored, count(*) filter (n_correct = top) as n_hits, round(count(*) filter (n_correct = top) / count(*), 6) as accuracy from y")
def route_accuracy(spark, d):
    return routing.route_accuracy(_rm(spark, d), _choices(spark, d)).withColumn("accuracy", r6("accuracy"))


@query(f"with {RM_SQL}, {CHOICE_SQL} select count(*) as n_scored, round(cast(sum(n_correct) as bigint) / (count(*) * 3), 6) as reward from rm join choice using (doc_id, agent)")
def routed_reward(spark, d):
    return routing.routed_reward(_rm(spark, d), _choices(spark, d), R).withColumn("reward", r6("reward"))


@query(f"with {CALLS_SQL} select agent, count(*) as n_calls, count(*) filter (is_error) as n_error, count(*) filter (is_empty) as n_empty, round(sum(cast(0.0001 as double) * latency_ms), 4) as cost_usd from calls group by 1")
def collection_progress(spark, d):
    c = fx.calls(spark, d).select("agent", F.when(F.col("is_error"), "HTTP 500").alias("error"), F.col("is_empty").alias("empty"), (F.lit(0.0001) * F.col("latency_ms")).alias("cost_usd"))
    return collection.progress(c).withColumn("cost_usd", F.round("cost_usd", 4))


_PRICES_SQL = ", ".join(f"('{a}', cast({p} as double), cast({o} as double))" for a, p, o in PRICES)


@query(f"with prices(agent, p, o) as (values {_PRICES_SQL}), s as (select cast(sum(length(text)) as bigint) as chars, count(*) as n from documents) select agent, round(3 * (chars / 4 * p / 1e6 + n * 1024.0 * o / 1e6), 6) as cost_usd from s, prices")
def cost_ceiling(spark, d):
    return collection.cost_ceiling(fx.tasks(spark, d), PRICES, R).withColumn("cost_usd", r6("cost_usd"))


@query(f"with {TASKS_SQL}, {CALLS_SQL} select task_id from tasks where doc_id not in (select doc_id from calls)")
def resume_pending(spark, d):
    tasks = fx.tasks(spark, d)
    done = fx.calls(spark, d).select("doc_id").distinct().join(tasks.select("doc_id", "task_id"), "doc_id")
    return collection.pending(tasks, done).select("task_id")


@query(f"with {TASKS_SQL}, a(agent) as (values {', '.join(f"('{a}')" for a in AGENTS)}) select agent, cast(repetition as int) as repetition, count(*) as n_calls, count(distinct task_id) as n_tasks from tasks, a, range(3) r(repetition) group by 1, 2")
def call_plan(spark, d):
    return collection.call_plan(fx.tasks(spark, d), AGENTS, R).groupBy("agent", "repetition").agg(F.count("*").alias("n_calls"), F.count_distinct("task_id").alias("n_tasks"))


@query("with p as (select event_type as agent, event_id % 7 = 0 as long_probe, case when event_id % 1009 = 0 then 'HTTP 500' end as error, case when event_id % 17 = 0 then '' else 'ok' end as text, event_id % 5000 as tok from events), g as (select agent, count(*) filter (not long_probe and error is not null) as errors, avg(case when not long_probe then case when text = '' and error is null then 1 else 0 end end) as empty, bool_or(not long_probe) as usage, bool_or(long_probe and (error is not null or text = '' or tok > 4096)) as bad from p group by 1), v as (select agent, case when errors > 0 then 'call errors' when empty > 0.05 then 'empty replies' when not usage then 'no token counts' when bad then 'ignored the cap' else '' end as reason from g) select agent, case when reason = '' then 'PASS' else 'FAIL' end as verdict, reason from v")
def preflight_verdicts(spark, d):
    e = fx.table(spark, d, "events")
    p = e.select(F.col("event_type").alias("agent"), (F.col("event_id") % 7 == 0).alias("is_length_probe"), F.when(F.col("event_id") % 1009 == 0, "HTTP 500").alias("error"), F.when(F.col("event_id") % 17 == 0, "").otherwise("ok").alias("text"), (F.col("event_id") % 5000).alias("completion_tokens"))
    return collection.preflight(p)


# Task pool

NORM_SQL = r"lower(trim(regexp_replace(trim(regexp_replace(prompt, '\s+', ' ', 'g')), '^\.+|\.+$', '', 'g')))"
DEDUPED_SQL = TASKS_SQL + f""",
ded as (select * from (select *, sha1({NORM_SQL}) as fingerprint, row_number() over (partition by sha1({NORM_SQL}) order by task_id) as rn from tasks) where rn = 1)"""


def _deduped(spark, d):
    return taskpool.deduplicated(fx.tasks(spark, d), grading.ascii_fingerprint_col(F.col("prompt")))


@query(f"with {DEDUPED_SQL} select task_id, fingerprint from ded")
def task_fingerprint_dedupe(spark, d):
    return taskpool.kept_fingerprints(fx.tasks(spark, d), grading.ascii_fingerprint_col(F.col("prompt")))


@query(f"with {DEDUPED_SQL} select (select count(*) from tasks) as n_tasks, (select count(*) from ded) as n_kept, (select count(*) from tasks) - (select count(*) from ded) as n_dropped")
def dedupe_drop_count(spark, d):
    f = fx.tasks(spark, d).select(grading.ascii_fingerprint_col(F.col("prompt")).alias("f"))
    return f.agg(F.count("*").alias("n_tasks"), F.count_distinct("f").alias("n_kept")).select("n_tasks", "n_kept", (F.col("n_tasks") - F.col("n_kept")).alias("n_dropped"))


@query(f"with {TASKS_SQL}, f as (select task_id, sha1(replace({NORM_SQL}, 'ß', 'ss')) as fingerprint from tasks) select min(task_id) as task_id, fingerprint from f group by fingerprint")
def task_fingerprint_unicode(spark, d):
    return taskpool.kept_fingerprints(fx.tasks(spark, d), grading.fingerprint_col(F.col("prompt")))


@query(f"with {TASKS_SQL}, n as (select domain, count(*) as n from tasks group by 1) select domain, n, round(n / sum(n) over (), 6) as share, greatest(cast(0.3 as double), 1 / count(*) over ()) as cap from n")
def domain_shares(spark, d):
    s = taskpool.domain_shares(fx.tasks(spark, d))
    return s.select("domain", "n", r6("share").alias("share"), F.greatest(F.lit(0.3), 1 / F.count("*").over(Window.partitionBy(F.lit(0)))).alias("cap"))


CAP_SQL = DEDUPED_SQL + """,
dn as (select domain, count(*) as n from ded group by 1),
caps as (select unnest(range(1, (select max(n) + 1 from dn))) as cap),
cap as (select coalesce(max(cap), 1) as cap from (select cap, max(least(n, cap)) / sum(least(n, cap)) as worst from caps, dn group by cap) where worst <= greatest(cast(0.3 as double), 1 / (select count(*) from dn)) + 1e-9)"""


@query(f"with {CAP_SQL} select domain, n, cap, greatest(n - cap, 0) as n_removed from dn, cap")
def balance_cap(spark, d):
    n = _deduped(spark, d).groupBy("domain").agg(F.count("*").alias("n"))
    cap = taskpool.largest_cap([r.n for r in n.collect()])
    return n.select("domain", "n", F.lit(cap).cast("long").alias("cap"), F.greatest(F.col("n") - cap, F.lit(0)).cast("long").alias("n_removed"))


BALANCED_SQL = CAP_SQL + """,
bal as (select * from (select *, row_number() over (partition by domain order by md5('42/' || task_id), task_id) as brn from ded), cap where brn <= cap)"""


@query(f"with {BALANCED_SQL} select task_id, domain from bal")
def balanced_pool(spark, d):
    return taskpool.balanced(_deduped(spark, d)).select("task_id", "domain")


SPLIT_SQL = DEDUPED_SQL + """,
str as (select *, row_number() over (partition by domain, difficulty, task_group = 'held_out' order by md5('42/' || task_id), task_id) as srn, count(*) over (partition by domain, difficulty, task_group = 'held_out') as sn from ded),
spl as (select *, case when task_group = 'held_out' then 'test' when srn <= round_even(sn * cast(0.6 as double), 0) then 'train' when srn <= round_even(sn * cast(0.6 as double), 0) + round_even(sn * cast(0.2 as double), 0) then 'validation' else 'test' end as split from str)"""


def _split(spark, d):
    return taskpool.split(_deduped(spark, d))


@query(f"with {SPLIT_SQL} select task_id, domain, difficulty, split from spl")
def stratified_split(spark, d):
    return _split(spark, d).select("task_id", "domain", "difficulty", "split")


@query(f"with {SPLIT_SQL} select s.split, count(x.task_id) as n from (values ('train'), ('validation'), ('test')) s(split) left join spl x on x.split = s.split group by 1")
def split_counts(spark, d):
    return taskpool.split_counts(_split(spark, d))


@query(f"with {TASKS_SQL}, bad as (select task_id, domain, case when doc_id % 211 = 0 then ' ' else answer end as answer, case when doc_id % 307 = 0 then '' else grader end as grader from tasks), n as (select domain, count(*) as n from bad group by 1), s as (select domain, n / sum(n) over () as share, greatest(cast(0.3 as double), 1 / count(*) over ()) as cap from n) select 'domain share' as problem, domain as subject from s where share > cap + 1e-9 union all select 'blank answer', task_id from bad where trim(answer) = '' union all select 'no grader', task_id from bad where grader = '' union all select 'empty split', s from (values ('validation')) v(s)")
def gate2_problems(spark, d):
    bad = fx.tasks(spark, d).select("task_id", "domain", F.when(F.col("doc_id") % 211 == 0, " ").otherwise(F.col("answer")).alias("answer"), F.when(F.col("doc_id") % 307 == 0, "").otherwise(F.col("grader")).alias("grader"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"))
    return taskpool.gate_2(bad)


@query(f"with {TASKS_SQL}, s as (select task_id, task_group, case when doc_id % 2 = 0 then 'train' else 'test' end as split from tasks union all select task_id, task_group, 'test' from tasks where doc_id % 50 = 0) select task_id, 'several splits' as problem from s group by 1 having count(distinct split) > 1 union all select task_id, 'held out' from s where task_group = 'held_out' and split <> 'test'")
def leakage_check(spark, d):
    x = fx.tasks(spark, d)
    s = x.select("task_id", "task_group", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"))
    return taskpool.leaks(s.unionByName(x.where(F.col("doc_id") % 50 == 0).select("task_id", "task_group", F.lit("test").alias("split"))))


@query()
def balanced_pool_compat(spark, d):
    return taskpool.balanced_compat(_deduped(spark, d)).select("task_id", "domain")


@query()
def stratified_split_compat(spark, d):
    return taskpool.split_compat(_deduped(spark, d)).select("task_id", "split")


@query()
def pilot_sample_compat(spark, d):
    return taskpool.sample_per_domain(_deduped(spark, d), {"de": 20, "en": 20, "es": 20, "fr": 20}).select("task_id", "domain")


@query(f"with {SPLIT_SQL} " + " union all ".join(f"select '{c}' as facet, {c} as value, count(*) as n from spl group by 2" for c in ("dataset", "domain", "difficulty", "grader", "split")))
def pool_facets(spark, d):
    return taskpool.facets(_split(spark, d))


@query(f"with {TASKS_SQL} select dataset, count(*) as n, arg_min(domain, task_id) as first_domain, arg_max(license, task_id) as last_license, arg_max(redistributable, task_id) as redistributable from tasks group by 1")
def source_table(spark, d):
    return taskpool.source_table(fx.tasks(spark, d))


# Publication


@query(f"""with {WINNERS_SQL}, {TASKS_SQL}, v as (select doc_id, string_agg(cast(n_correct as varchar), ',' order by pos) as n_correct, string_agg(cast(n_empty as varchar), ',' order by pos) as n_empty, string_agg(cast(n_error as varchar), ',' order by pos) as n_error from rm group by 1)
select task_id, dataset, domain, difficulty, task_group, best_agents, n_winners > 1 as is_tie, cast(3 as bigint) as repetitions, v.n_correct, v.n_empty, v.n_error from best join v using (doc_id) join tasks using (doc_id) where not starts_with(task_id, 'src1')""")
def public_rows(spark, d):
    rm = _rm(spark, d)
    rows = publish.public_rows(rm, fx.tasks(spark, d), AGENTS, R, "v1", excluded_prefixes=("src1",))
    text = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)
    return rows.select("task_id", "dataset", "domain", "difficulty", "task_group", text("best_agents"), "is_tie", "repetitions", text("n_correct"), text("n_empty"), text("n_error"))


@query(f"with {CALLS_SQL}, {TASKS_SQL}, r as (select distinct source || '/' || lang || '/' || lpad(cast(doc_id as varchar), 6, '0') as task_id from documents semi join calls using (doc_id)) select task_id, prompt from r join tasks using (task_id) where doc_id % 10 <> 3 and trim(prompt) <> ''")
def training_prompts(spark, d):
    tasks = fx.tasks(spark, d)
    scored = tasks.join(fx.calls(spark, d).select("doc_id").distinct(), "doc_id", "left_semi").select("task_id")
    some = tasks.where(F.col("doc_id") % 10 != 3)
    return routing.training_rows(scored, some).select("task_id", "prompt")


@query("with v as (select conv_id, turn, case when conv_id % 9 = 0 then '{\"prompt\": 1}' else '{\"n\": 1}' end || coalesce(text, '') as value from conversations) select conv_id, turn from v where contains(value, '\"prompt\"') or contains(value, '\"raw_response\"') or contains(value, '\"answer\"')")
def leak_scan(spark, d):
    c = fx.table(spark, d, "conversations")
    return publish.leaking(c.withColumn("value", F.concat(F.when(F.col("conv_id") % 9 == 0, '{"prompt": 1}').otherwise('{"n": 1}'), F.coalesce("text", F.lit(""))))).select("conv_id", "turn")


@query("select n_nationkey as index, lower(n_name) as agent_id, 'v' || n_regionkey || '/' || lower(n_name) as slug, n_nationkey % 2 = 0 as is_reasoning_model, 4096 * (n_nationkey + 1) as context_window, n_nationkey / 4 as price_per_1m_prompt_usd, cast(n_regionkey as double) as price_per_1m_output_usd, '2026-01-01' as verified_at from nation where n_nationkey % 5 <> 3")
def agent_manifest(spark, d):
    return publish.agent_manifest(fx.agents(spark, d))


# Texts and sources


@query("select conv_id, arg_max(text, turn) as last_user_text from conversations where role = 'user' group by 1")
def last_user_turn(spark, d):
    c = fx.table(spark, d, "conversations")
    return c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_user_text"))


@query(f"with {TASKS_SQL} select task_id, '{collection.SYSTEM}' as system_text, prompt as user_text from tasks")
def chat_messages(spark, d):
    m = fx.tasks(spark, d).select("task_id", collection.messages_col(F.col("prompt")).alias("m"))
    return m.select("task_id", F.col("m")[0]["content"].alias("system_text"), F.col("m")[1]["content"].alias("user_text"))


@query("with d as (select doc_id, row_number() over (order by doc_id) - 1 as i, n_chars % 3 <> 0 as ok from documents), r as (select *, sum(case when ok then 1 else 0 end) over (order by i) - case when ok then 1 else 0 end as before from d), x as (select * from r where before < 100) select case when ok then 'yielded' else 'mapper_returned_none' end as reason, count(*) as n from x group by 1")
def limited_mapping_stats(spark, d):
    rows = fx.table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 3 != 0).alias("ok"))
    return readers.map_stats(readers.limited(rows, "doc_id", F.col("ok"), 100), F.when(~F.col("ok"), "mapper_returned_none"))


@query("select conv_id, turn, regexp_replace(regexp_replace('<think>' || role || '</think><answer x=1>' || text || '</ANSWER>', '<think>.*?</think>', ' ', 'gis'), '</?(?:think|reasoning|delegate|answer)[^>]*>', ' ', 'gi') as body from conversations")
def strip_markup(spark, d):
    c = fx.table(spark, d, "conversations")
    return c.select("conv_id", "turn", t.strip_markup_col(F.concat(F.lit("<think>"), "role", F.lit("</think><answer x=1>"), "text", F.lit("</ANSWER>"))).alias("body"))


@query(r"select doc_id, case when len(m) = 0 then null else m[len(m)] end as last_number from (select doc_id, regexp_extract_all(text, '-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?') as m from documents)")
def extract_last_number(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", t.last_number_col(F.col("text")).alias("last_number"))


def _graded(spark, d, name: str, response: Column, answer: Column) -> DataFrame:
    """Replies made of documents, graded by name."""
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", grading.grade_col(F.lit(name), response, answer).alias("g")).select("doc_id", "g.extracted", "g.correct")


def _by(n: int, *forms: Column | str) -> Column:
    """One of n forms by doc_id; a text is a format string's pieces already."""
    return F.element_at(F.array(*(f if isinstance(f, Column) else F.lit(f) for f in forms)), (F.col("doc_id") % n + 1).cast("int"))


_TEXT, _CHARS = lambda: F.coalesce("text", F.lit("")), lambda: F.col("n_chars")
_LETTER = lambda shift: F.substring(F.lit("ABCDEFGHIJ"), (F.pmod(F.col("n_chars") + shift, F.lit(10)) + 1).cast("int"), F.lit(1))


@query("""with v as (select doc_id, doc_id % 8 as k, substr('ABCDEFGHIJ', n_chars % 10 + 1, 1) as letter, substr('ABCDEFGHIJ', (n_chars + case when doc_id % 3 = 0 then 1 else 0 end) % 10 + 1, 1) as answer from documents)
select doc_id, case when k = 4 then null else letter end as extracted, k <> 4 and letter = answer as correct from v""")
def mcq_grade(spark, d):
    x = _LETTER(0)
    behind = F.concat(_TEXT(), F.lit("\n"))
    forms = (F.concat(behind, F.lit("Answer: "), x), F.concat(F.lit("I think the\nchoice is "), F.lower(x)), F.concat(behind, F.lit("\\boxed{"), x, F.lit("}")), F.concat(behind, F.lit("<answer> "), x, F.lit(" </answer>")), F.lit("none"),
             F.concat(behind, F.lit("final answer is ("), x, F.lit(")")), F.concat(behind, F.lit("Cevap: "), F.lower(x)), F.concat(F.lit("<think>Answer: "), _LETTER(1), F.lit("</think> so\nmaybe ("), x, F.lit(")")))
    return _graded(spark, d, "mcq_letter", _by(8, *forms), _LETTER(F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)))


@query("""with v as (select doc_id, doc_id % 7 as k, n_chars as n from documents)
select doc_id, case k when 0 then format('{:,}', n) when 2 then n || '.0' when 4 then null when 5 then cast(n + 1 as varchar) when 6 then '-' || n else cast(n as varchar) end as extracted, k not in (4, 5, 6) or (k = 6 and n = 0) as correct from v""")
def numeric_grade(spark, d):
    n = _CHARS().cast("string")
    forms = (F.concat(_TEXT(), F.lit("\nso #### "), F.format_number("n_chars", 0)), F.concat(F.lit("Answer: $"), n, F.lit(".")), F.concat(_TEXT(), F.lit("\n\\boxed{"), n, F.lit(".0}")), F.concat(F.lit("<delegate to=m-0731>1</delegate> it is "), n), F.lit("Answer: half"),
             F.concat(F.lit("<think>"), n, F.lit("</think>I say "), (F.col("n_chars") + 1).cast("string")), F.concat(F.lit("<answer>-"), n, F.lit("</answer>")))
    return _graded(spark, d, "numeric_match", _by(7, *forms), n)


_WORD_SQL = "coalesce(nullif(regexp_extract(coalesce(text, ''), '[a-zA-Z]+'), ''), 'x')"


@query(f"""with v as (select doc_id, doc_id % 5 as k, {_WORD_SQL} as w from documents)
select doc_id, case k when 0 then upper(w) || '.' when 1 then w || '  yes' when 2 then upper(w) when 3 then w || ' ' || w else '<b> ' || w end as extracted, k in (0, 2) as correct from v""")
def text_match_grade(spark, d):
    w = F.regexp_extract(_TEXT(), "[a-zA-Z]+", 0)
    w = F.when(w == "", "x").otherwise(w)
    # answer tags are markup like the others, so the second form is read by its last line
    forms = (F.concat(F.lit("Answer:  "), F.upper(w), F.lit(". ")), F.concat(F.lit("no\n<answer> "), w, F.lit("</answer> yes")), F.concat(F.lit("first\n\n "), F.upper(w), F.lit(" \n")), F.concat(F.lit("final answer is "), w, F.lit(" "), w), F.concat(F.lit("so\n<b> "), w))
    return _graded(spark, d, "exact_match_ci", _by(5, *forms), w)


@query("""with v as (select doc_id, doc_id % 5 as k, cast(n_chars as varchar) as n from documents)
select doc_id, case k when 0 then '\\dfrac{1}{' || n || '}' when 1 then n || '.50' when 2 then '\\text{odd}' || n when 3 then 'x+' || n else '\\left(' || n || '\\right)^{\\circ}' end as extracted, k <> 3 as correct from v""")
def latex_grade(spark, d):
    n, cat = _CHARS().cast("string"), lambda *x: F.concat(*(c if isinstance(c, Column) else F.lit(c) for c in x))
    forms = (cat("so \\boxed{\\dfrac{1}{", n, "}}"), cat("\\boxed{", n, ".50}"), cat("\\boxed{\\text{odd}", n, "}"), cat("\\boxed{x+", n, "}"), cat("it is \\boxed{\\left(", n, "\\right)^{\\circ}} then"))
    answers = (cat("$\\frac{1}{", n, "}$"), cat(n, ".5"), cat("ODD", n), cat("x-", n), cat("(", n, ")"))
    return _graded(spark, d, "math_expression", _by(5, *forms), _by(5, *answers))


@query("""with v as (select doc_id, doc_id % 4 as k from documents) select doc_id, case when k in (0, 3) then 'ACCEPT' else 'REVISE' end as extracted, case k when 0 then true when 1 then true when 2 then false else true end as correct from v""")
def verifier_grade(spark, d):
    forms = (F.concat(F.lit("Accepted: "), _TEXT()), F.concat(F.lit("REVISE "), _TEXT()), F.concat(F.lit("hm, ACCEPT "), _TEXT()), F.concat(F.lit("<think>REVISE</think>\n accept\n"), _TEXT()))
    return _graded(spark, d, "verifier_judgment", _by(4, *forms), _by(4, "accept", "REVISE", "ACCEPT", "Accept "))


@query("""with v as (select doc_id, case doc_id % 9 when 0 then '2' when 1 then '4' when 2 then 'b' when 3 then '0' when 4 then 'green' when 5 then '9' when 6 then lang when 7 then ' D ' else cast(n_chars % 6 as varchar) end as k from documents), o as (select ['red', 'green', 'de', ' fr '] as o) select doc_id, case when length(trim(k)) = 1 and upper(trim(k)) in ('A', 'B', 'C', 'D') then upper(trim(k)) when regexp_full_match(trim(k), '[0-9]+') then case when cast(trim(k) as int) < 4 then substr('ABCD', cast(trim(k) as int) + 1, 1) when cast(trim(k) as int) - 1 < 4 then substr('ABCD', cast(trim(k) as int), 1) end when list_position(list_transform(o, lambda x: trim(x)), trim(k)) > 0 then substr('ABCD', list_position(list_transform(o, lambda x: trim(x)), trim(k)), 1) end as letter from v, o""")
def letter_for(spark, d):
    key = _by(9, "2", "4", "b", "0", "green", "9", F.col("lang"), " D ", (F.col("n_chars") % 6).cast("string"))
    return fx.table(spark, d, "documents").select("doc_id", t.letter_col(key, F.array(*map(F.lit, ("red", "green", "de", " fr ")))).alias("letter"))


@query("select doc_id, case when n_chars % 2 = 0 then 'ACCEPT' else 'REVISE' end as truth from documents")
def verifier_truth(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", collection.verifier_truth(F.col("n_chars") % 2 == 0).alias("truth"))


def _catalog(spark, d):
    p = fx.table(spark, d, "part")
    vendor = F.element_at(F.array(*map(F.lit, ("qwen", "meta-llama", "openrouter", "acme", "deepseek", "zeta"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("-instruct", "-thinking", "-coder", "-r1", "", ":free", "-latest"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select(F.concat(vendor, F.lit("/m"), F.floor(F.col("p_partkey") / 42).cast("string"), kind).alias("slug"), F.col("p_name").alias("name"), (F.col("p_size") * 8192).cast("long").alias("context_length"), F.round(F.col("p_retailprice") / 200, 3).alias("output_usd_per_1m"), (F.col("p_partkey") % 3 == 0).alias("supports_reasoning"), F.col("p_partkey").alias("id"))


CATALOG_SQL = """c as (select ['qwen', 'meta-llama', 'openrouter', 'acme', 'deepseek', 'zeta'][p_partkey % 6 + 1] as vendor, ['qwen', 'meta-llama', 'openrouter', 'acme', 'deepseek', 'zeta'][p_partkey % 6 + 1] || '/m' || cast(p_partkey // 42 as varchar) || ['-instruct', '-thinking', '-coder', '-r1', '', ':free', '-latest'][p_partkey % 7 + 1] as slug,
  p_name as name, p_size * 8192 as context_length, round(p_retailprice / 200, 3) as price, p_partkey % 3 = 0 as thinks from part),
d as (select *, lower(slug || ' ' || name) as blob, regexp_matches(lower(slug), '^(deepseek|google/gemma|meta-llama|mistralai|nvidia|qwen)') as open from c),
u as (select *, regexp_matches(blob, 'code|coder|codestral|devstral|swe') as coder, regexp_matches(blob, 'distill|qwq|r1|reason|thinking') as distill from d
  where context_length >= 16384 and price > 0 and vendor <> 'openrouter' and not contains(slug, 'latest') and not ends_with(slug, ':free')),
pr as (select a.slug as direct, b.slug as reasoning, a.price + b.price as price, a.vendor from u a join u b on replace(a.slug, '-instruct', '') = replace(b.slug, '-thinking', '') where contains(a.slug, '-instruct') and contains(b.slug, '-thinking') and a.open and b.open and a.price <= 5 and b.price <= 5),
s as (select slot, -price as k, -context_length as k2, slug as k3, slug, vendor from u, (values ('frontier_a'), ('frontier_b'), ('frontier_c')) f(slot) where not open and price <= 15 and context_length >= 128000
  union all select 'open_distill_reasoning', price, -context_length, slug, slug, vendor from u where open and price <= 5 and thinks and distill
  union all select 'open_mid', price, -context_length, slug, slug, vendor from u where open and price <= 5 and not thinks and not coder
  union all select 'open_cheap_reasoning', price, -context_length, slug, slug, vendor from u where price <= 5 and thinks
  union all select 'open_coder', price, -context_length, slug, slug, vendor from u where price <= 5 and coder
  union all select 'open_direct', price, 0, direct, direct, vendor from pr union all select 'open_reasoning', price, 0, direct, reasoning, vendor from pr)"""


@query(f"with {CATALOG_SQL}, r as (select *, row_number() over (partition by slot order by k, k2, k3, slug) as rank from s) select slot, cast(rank as int) as rank, slug, vendor from r where rank <= 8")
def catalog_proposal(spark, d):
    return catalog.proposals(_catalog(spark, d))


_PICK_SQL = f"""with recursive {CATALOG_SQL}, r as (select *, row_number() over (partition by slot order by k, k2, k3, slug) as rank from s),
slots(i, slot) as (values {", ".join(f"({i}, '{slot}')" for i, slot in enumerate(catalog.SLOTS, 1))}),
cand as (select i, slot, list(slug order by rank) filter (rank <= {catalog.TOP}) as slugs, list(vendor order by rank) filter (rank <= {catalog.TOP}) as vendors from slots left join r using (slot) group by 1, 2),
walk as (select 0 as i, '' as slot, null::varchar as slug, []::varchar[] as used, null::bigint as pair
  union all select n.i, n.slot, n.slugs[n.at], case when n.pairs or n.at is null then n.used else list_append(n.used, n.vendors[n.at]) end, case when n.slot = '{catalog.PAIR[0]}' then n.at else n.pair end
  from (select c.*, w.used, w.pair, c.slot = '{catalog.PAIR[1]}' and w.pair is not null as pairs,
    case when c.slot = '{catalog.PAIR[1]}' and w.pair is not null then w.pair else coalesce(list_filter(range(1, len(c.slugs) + 1), lambda x: not list_contains(w.used, c.vendors[x]))[1], case when len(c.slugs) > 0 then 1 end) end as at
    from walk w join cand c on c.i = w.i + 1) n)
select slot, slug from walk where slug is not null"""


@query(_PICK_SQL)
def catalog_pick(spark, d):
    ranked = [tuple(r) for r in catalog.proposals(_catalog(spark, d)).collect()]  # at most TOP rows a slot
    return spark.createDataFrame(sorted(catalog.distinct_vendors(ranked).items()), "slot string, slug string")


def _mapped(name: str, split: str, ok: str, answer: str, difficulty: str) -> str:
    return f"select '{name}' as source, i as index, case when {ok} then format('{name}/{split}/{{:06d}}', i) end as task_id, case when {ok} then {answer} end as answer, case when {ok} then {difficulty} end as difficulty, case when not ({ok}) then 'mapper_returned_none' end as reason from d"


MAPPED_SQL = "with d as (select doc_id as i, trim(text) as q, n_chars as n from documents) " + " union all ".join(
    _mapped(*x)
    for x in (
        ("aime2025_i", "test", "q <> '' and n <> 0", "cast(n as varchar)", "'hard'"),
        ("gsm8k", "test", "q <> ''", "'1' || n", "'easy'"),
        ("math500", "test", "q <> ''", "cast(n as varchar)", "case n % 6 when 1 then 'easy' when 2 then 'easy' when 3 then 'medium' else 'hard' end"),
        ("mmlu", "test", "q <> '' and n % 5 < 4", "substr('ABCD', n % 5 + 1, 1)", "'medium'"),
        ("mmlu_pro", "test", "q <> ''", "'B'", "'hard'"),
        ("arc_challenge", "test", "q <> ''", "substr('AABCD', n % 5 + 1, 1)", "'medium'"),
        ("rlpr", "train", "q <> ''", "'yes'", "'hard'"),
        ("turkish", "test", "q <> ''", "'B'", "'medium'"),
    )
)


@query(MAPPED_SQL)
def mapped_sources(spark, d):
    """The deterministic benchmark mappers over rows made of documents."""
    docs, options = _raw(spark, d)
    key = F.col("n_chars") % 5
    return _map_all(docs, {
        "aime2025_i": {"question": F.col("q"), "answer": F.col("n_chars")},
        "gsm8k": {"question": F.col("q"), "answer": F.concat(F.lit("so #### 1,"), F.col("n_chars").cast("string"))},
        "math500": {"problem": F.col("q"), "answer": F.col("n_chars").cast("string"), "level": (F.col("n_chars") % 6).cast("int"), "subject": F.lit("algebra")},
        "mmlu": {"question": F.col("q"), "choices": options, "answer": key, "subject": F.lit("law")},
        "mmlu_pro": {"question": F.col("q"), "options": options, "answer": F.lit("B"), "category": F.lit("law")},
        "arc_challenge": {"question": F.col("q"), "choices": F.struct(options.alias("text"), F.array(*map(F.lit, "1234")).alias("label")), "answerKey": key.cast("string")},
        "rlpr": {"prompt": F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content"))), "reward_model": F.struct(F.lit("yes").alias("ground_truth")), "extra_info": F.struct(F.lit("PhD").alias("difficulty")), "ability": F.lit("x")},
        "turkish": {"soru": F.col("q"), "cevap": F.lit("1"), "secenekler": options},
    })


@query()
def shuffled_source(spark, d):
    """The mapper whose options Python's generator shuffles."""
    docs, _ = _raw(spark, d)
    return _map_all(docs, {"gpqa_diamond": {"Question": F.col("q"), "Correct Answer": F.lit("right"), **{f"Incorrect Answer {k}": F.lit(f"wrong {k}") for k in (1, 2, 3)}}})


def _raw(spark, d) -> tuple[DataFrame, Column]:
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("q"), "n_chars")
    return docs, F.array(*(F.concat(F.lit(f"option {k} "), F.col("n_chars").cast("string")) for k in range(4)))


def _map_all(docs: DataFrame, made: dict[str, dict[str, Column]]) -> DataFrame:
    parts = [mappers.map_source(n, docs.select("index", *(c.alias(k) for k, c in cols.items()))).select(F.lit(n).alias("source"), "index", F.col("task.task_id").alias("task_id"), F.col("task.answer").alias("answer"), F.col("task.difficulty").alias("difficulty"), "reason") for n, cols in made.items()]
    return reduce(DataFrame.unionByName, parts)


# Router heads

DIM, HEADS = 64, 5
_W = [[round(sin(1 + k * DIM + j), 6) for j in range(DIM)] for k in range(HEADS)]
_B = [round(cos(k), 6) for k in range(HEADS)]
_WSQL = ", ".join(f"({k}, [{', '.join(f'cast({w} as double)' for w in row)}], cast({b} as double))" for k, (row, b) in enumerate(zip(_W, _B)))


@query(f"with w(k, w, b) as (values {_WSQL}), l as (select vec_id, k, list_dot_product(list_transform(embedding, lambda x: cast(x as double)), w) + b as z from embeddings, w) select vec_id, cast(arg_max(k, round(z, 9)) as int) as pick, round(max(z), 4) as logit from (select * from l order by vec_id, k) group by 1")
def linear_head_route(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", routing.linear_logits(F.col("embedding"), _W, _B).alias("z"))
    return e.select("vec_id", routing.first_best(F.col("z")).alias("pick"), F.round(F.array_max("z"), 4).alias("logit"))


#: Vectors that a head is trained on: training is a search on the driver, and this bounds what it gathers.  Nothing else is taken from this sample.
TRAIN_VECTORS = 500


@query()
def head_vs_baselines(spark, d):
    """A head trained on a bounded sample of embeddings, with rewards made of their labels.

    value is over all embeddings, held_out over those that the head wasn't trained on (null if there are none)."""
    e = fx.table(spark, d, "embeddings").select("embedding", "label", F.md5(F.col("vec_id").cast("string")).alias("digest"))
    rows = e.orderBy("digest").limit(TRAIN_VECTORS).collect()
    x = np.array([r.embedding for r in rows], float)
    rewards_of = np.array([[1.0 if r.label % HEADS == k else 0.0 for k in range(HEADS)] for r in rows])
    theta = routing.train_head(x, rewards_of, generations=20)
    ((w, b),) = routing.unflatten(theta, x.shape[1], HEADS)
    agents = F.array(*((F.pmod("label", F.lit(HEADS)) == k).cast("double") for k in range(HEADS)))
    scored = e.select(routing.first_best(routing.linear_logits(F.col("embedding"), w.tolist(), b.tolist())).alias("pick"), agents.alias("rewards"), (F.col("digest") > rows[-1].digest).alias("new"))
    report = routing.head_summary(scored, HEADS).collect()[0]
    held_out = routing.head_summary(scored.where("new"), HEADS).collect()[0]
    as_value = lambda v: None if v is None else float(v)
    return spark.createDataFrame([(k, as_value(report[k]), as_value(held_out[k])) for k in report.asDict()], "metric string, value double, held_out double")
