"""More of the query catalogue: guards, checks, sinks and texts, each over a whole table with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom import schemas
from routeloom.functions import text as t
from routeloom.operators import analysis, collection, reports, rewards, roles, routing, taskpool
from routeloom.plans import fixtures as fx
from routeloom.plans.fixtures import AGENTS, CALLS_SQL, REPETITIONS, RM_SQL, TASKS_SQL
from routeloom.plans.queries import DEDUPED_SQL, VERDICT_SQL, WINNERS_SQL, query
from routeloom.sources import readers

# Sources and sinks


def _lines(spark, df: DataFrame, name: str) -> str:
    path = readers.work_path(spark, name)
    readers.write_jsonl(df, path)
    return path


@query("select conv_id, turn, role, text from conversations")
def jsonl_round_trip(spark, d):
    c = fx.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return readers.read_jsonl(spark, _lines(spark, c, "conversations"), c.schema)


@query("select doc_id, n_chars from documents")
def mirrored_source(spark, d):
    mirror, _, dataset = d.rstrip("/").rpartition("/")
    return readers.read_source(spark, dataset, "documents.parquet", mirror).select("doc_id", "n_chars")


@query("select part_key, n from (select p_partkey as part_key, length(p_name) as n from part)")
def local_source(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), F.length("p_name").cast("long").alias("n"))
    return readers.read_source(spark, readers.LOCAL + _lines(spark, p, "part"), "any", schema=T.StructType([T.StructField("part_key", T.LongType()), T.StructField("n", T.LongType())]))


@query(f"with {TASKS_SQL} select task_id, prompt, answer, difficulty, case when task_group = 'held_out' then 'test' else 'train' end as split, dataset, redistributable from tasks where trim(prompt) <> ''")
def typed_tasks(spark, d):
    """Tasks written as JSON lines and read with their schema and checks."""
    x = fx.tasks(spark, d).where("trim(prompt) <> ''")
    source = F.struct("dataset", F.lit(None).cast("string").alias("config"), F.lit("test").alias("split"), F.col("doc_id").alias("index"), "license", F.lit(None).cast("string").alias("license_checked_on"), F.lit(None).cast("string").alias("subject"), "redistributable")
    split = F.when(F.col("task_group") == "held_out", "test").otherwise("train")
    rows = x.select("task_id", "prompt", "answer", F.lit("numeric").alias("answer_type"), "grader", "domain", "difficulty", split.alias("split"), "task_group", source.alias("source"))
    got = readers.read_tasks(spark, _lines(spark, rows, "tasks"))
    return got.select("task_id", "prompt", "answer", "difficulty", "split", "source.dataset", "source.redistributable")


@query("select user_id, event_id, event_type from events e semi join (select user_id, max(event_id) as event_id from events group by 1) using (user_id, event_id)")
def last_of_each_user(spark, d):
    return readers.last_of_each(fx.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", F.col("event_id"))


@query("select distinct o_custkey as customer from orders")
def appended_once(spark, d):
    """Three overlapping appends of customers, as replays make them."""
    rows = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("k"))
    path = readers.work_path(spark, "customers")
    for part in (rows.where("k % 3 = 0"), rows.where("k % 2 = 0"), rows):
        readers.append_once(part.select("customer"), path, "customer")
    return spark.read.parquet(path)


@query("select doc_id, substr(sha256(text), 1, 16) as digest from documents")
def text_digest(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", readers.digest_col(F.col("text")).alias("digest"))


# Constraints

_BAD_TASKS = TASKS_SQL + """,
bad as (select case when doc_id % 101 = 0 then dataset || '/' || doc_id else task_id end as task_id, case when doc_id % 103 = 0 then ' ' else prompt end as prompt, case when doc_id % 107 = 0 then null else answer end as answer,
  case when doc_id % 109 = 0 then 'odd' else difficulty end as difficulty, case when doc_id % 113 = 0 then null else 'test' end as split, case when doc_id % 127 = 0 then 'x' else task_group end as task_group from tasks)"""


@query(f"""with {_BAD_TASKS} select task_id, 'blank prompt' as problem from bad where trim(coalesce(prompt, '')) = '' union all select task_id, 'blank answer' from bad where trim(coalesce(answer, '')) = ''
union all select task_id, 'task_id needs two slashes' from bad where length(task_id) - length(replace(task_id, '/', '')) <> 2 union all select task_id, 'unknown difficulty' from bad where difficulty not in ('easy', 'medium', 'hard')
union all select task_id, 'unknown split' from bad where split is null union all select task_id, 'unknown task_group' from bad where task_group not in ('in_distribution', 'held_out')""")
def task_problems(spark, d):
    k, x = F.col("doc_id"), fx.tasks(spark, d)
    swap = lambda n, new, old: F.when(k % n == 0, new).otherwise(F.col(old)).alias(old)
    bad = x.select(swap(101, F.concat_ws("/", "dataset", k.cast("string")), "task_id"), swap(103, F.lit(" "), "prompt"), swap(107, F.lit(None), "answer"), swap(109, F.lit("odd"), "difficulty"), F.when(k % 113 != 0, "test").alias("split"), swap(127, F.lit("x"), "task_group"))
    return schemas.task_violations(bad)


@query(f"with {CALLS_SQL}, r as (select distinct doc_id from calls) select cast(doc_id as varchar) as task_id, 'one reward per agent' as problem from r where doc_id % 7 = 0 union all select cast(doc_id as varchar), 'agent named twice' from r where doc_id % 11 = 0")
def reward_problems(spark, d):
    r = _records(spark, d)
    order = F.when(F.col("doc_id") % 11 == 0, F.concat(F.slice("agent_order", 1, 4), F.slice("agent_order", 1, 1))).otherwise(F.col("agent_order"))
    mean = F.when(F.col("doc_id") % 7 == 0, F.slice("mean_reward", 1, 3)).otherwise(F.col("mean_reward"))
    return schemas.reward_violations(r.select(F.col("doc_id").cast("string").alias("task_id"), order.alias("agent_order"), mean.alias("mean_reward")))


def _records(spark, d) -> DataFrame:
    """Reward vectors of tasks, in the order of the agents."""
    rm = rewards.reward_matrix(fx.calls(spark, d), AGENTS)
    cells = F.sort_array(F.collect_list(F.struct("pos", (F.col("n_correct") / REPETITIONS).alias("r"))))
    return rm.groupBy("doc_id").agg(F.transform(cells, lambda c: c["r"]).alias("mean_reward")).withColumn("agent_order", F.array(*map(F.lit, AGENTS)))


@query(f"with {WINNERS_SQL} select doc_id, best_agents, n_winners > 1 as is_tie from best")
def rederived_winners(spark, d):
    """Stored winners are wrong here, and not trusted."""
    r = _records(spark, d).withColumn("best_agents", F.slice("agent_order", 1, 1)).withColumn("is_tie", F.lit(False))
    return rewards.rederived(r).select("doc_id", F.array_join("best_agents", ",").alias("best_agents"), "is_tie")


@query(f"with {CALLS_SQL}, r as (select distinct doc_id from calls) select cast(doc_id as varchar) as task_id, case when doc_id % 10 = 0 then 'pool_version' when doc_id % 14 = 0 then 'agent_order' else 'repetitions' end as field from r where doc_id % 10 = 0 or doc_id % 14 = 0 or doc_id % 22 = 0")
def unfit_records(spark, d):
    k, r = F.col("doc_id"), fx.calls(spark, d).select("doc_id").distinct()
    agents = F.array(*map(F.lit, AGENTS))
    done = r.select(k.cast("string").alias("task_id"), F.when(k % 10 == 0, "v0").otherwise("v1").alias("pool_version"), F.when(k % 14 == 0, F.reverse(agents)).otherwise(agents).alias("agent_order"), F.when(k % 22 == 0, 2).otherwise(3).alias("repetitions"))
    return collection.unfit(done, "v1", AGENTS, 3)


@query("select s_suppkey as index, case when s_suppkey % 4 = 0 then 'TBD' else 'v/' || s_suppkey end as slug from supplier where s_suppkey % 6 <> 5 and (s_suppkey % 4 = 0 or s_suppkey % 3 = 0)")
def unverified_agents(spark, d):
    k, s = F.col("s_suppkey"), fx.table(spark, d, "supplier")
    agents = s.select(k.alias("index"), F.when(k % 4 == 0, "TBD").otherwise(F.concat(F.lit("v/"), k.cast("string"))).alias("slug"), F.when(k % 3 != 0, "2026-01-01").alias("verified_at"), (k % 6 == 5).alias("retired"))
    return collection.unverified(agents).select("index", "slug")


@query("select s_suppkey, lower('n' || s_nationkey) as id from supplier where s_nationkey % 2 = 1")
def unknown_agents(spark, d):
    pool = fx.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    wanted = fx.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("id"))
    return schemas.unknown_agents(wanted, pool).select("s_suppkey", "id")


# Collection

_EVENT_REPLY = "e as (select event_id, case when event_id % 13 = 0 then 'HTTP ' || (400 + event_id % 5) when event_id % 29 = 0 then 'HTTP 503: busy' end as error, case when event_id % 7 = 0 then ' ' when event_id % 31 = 0 then null else event_type end as said, case when event_id % 3 = 0 then 'length' when event_id % 5 > 0 then 'stop' end as reason, case when event_id % 11 > 0 then event_id % 5000 end as tokens from events)"


@query(f"with {_EVENT_REPLY} select event_id, error is null and trim(coalesce(said, '')) = '' as empty, coalesce(reason = 'length', false) as truncated, coalesce(error in ('HTTP 401', 'HTTP 402', 'HTTP 403'), false) as fatal, error is null and trim(coalesce(said, '')) <> '' as usable, coalesce(tokens > 1.05 * 4096, false) as over_cap from e")
def reply_flags(spark, d):
    k = F.col("event_id")
    e = fx.table(spark, d, "events").select(
        "event_id", F.when(k % 13 == 0, F.concat(F.lit("HTTP "), (400 + k % 5).cast("string"))).when(k % 29 == 0, "HTTP 503: busy").alias("error"), F.when(k % 7 == 0, " ").when(k % 31 != 0, F.col("event_type")).alias("said"),
        F.when(k % 3 == 0, "length").when(k % 5 > 0, "stop").alias("reason"), F.when(k % 11 > 0, k % 5000).alias("tokens"))
    flags = collection.reply_flags(*(F.col(c) for c in ("error", "said", "reason", "tokens")))
    return e.select("event_id", *(c.alias(n) for n, c in flags.items()))


@query("""with c as (select conv_id, turn, text, conv_id % 5 as k from conversations where text is not null)
select conv_id, turn, case when k = 0 then text else '' end as said, case k when 0 then null when 1 then 'HTTP 402: no' when 2 then 'unreadable body' when 3 then 'error: busy' end as error, case when k = 0 then 'length' end as finish_reason, case when k = 0 then turn + 7 end as completion_tokens, k = 1 as fatal from c where k < 4""")
def parsed_bodies(spark, d):
    """Bodies with keep-alive lines, errors within successful responses, and rubbish."""
    c, k = fx.table(spark, d, "conversations").where("text is not null and conv_id % 5 < 4"), F.col("conv_id") % 5
    fine = F.to_json(F.struct(F.struct((F.col("turn") + 7).alias("completion_tokens")).alias("usage"), F.array(F.struct(F.lit("length").alias("finish_reason"), F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    body = F.when(k == 0, F.concat(F.lit(": PROCESSING\n\n: PROCESSING\n"), fine)).when(k == 1, '{"error": {"code": 402, "message": "no"}}').when(k == 2, ": only keep-alive").otherwise('{"error": "busy"}')
    return collection.replies(c.select("conv_id", "turn", body.alias("body"))).drop("body")


def echo(agent: str, said: list, repetition: int) -> collection.Reply:
    """A provider that says how long the prompt is; the second one is one off at its second repetition, the third one fails."""
    if agent == "down":
        return collection.Reply(error="HTTP 400: down")
    n = len(said[1]["content"])
    return collection.Reply(f"So it is.\nAnswer: {n + (agent == 'b' and repetition == 1)}", completion_tokens=n % 4000)


@query("""with a(agent, pos) as (values ('a', 0), ('b', 1), ('down', 2)), v as (select doc_id, agent, cast(r.repetition as int) as repetition, length(text) + case when agent = 'b' and r.repetition = 1 then 1 else 0 end as n, length(text) as tokens, agent = 'down' as bad from documents, a, range(2) r(repetition) where text is not null)
select doc_id, agent, repetition, case when not bad then cast(n as varchar) end as extracted, not bad and n = tokens as correct, false as empty, case when not bad then tokens % 4000 end as completion_tokens, case when bad then 'HTTP 400: down' end as error from v""")
def collected_calls(spark, d):
    tasks = fx.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("prompt"), F.length("text").cast("string").alias("answer"), F.lit("numeric_match").alias("grader"))
    c = collection.collect(tasks, ("a", "b", "down"), echo, 2, store_raw=False)
    return c.select(F.col("task_id").cast("long").alias("doc_id"), "agent", "repetition", "extracted", "correct", "empty", "completion_tokens", "error")


@query(r"select conv_id, turn, regexp_matches(case when turn % 3 = 0 then 'ACCEPT ' when turn % 3 = 1 then 'REVISED ' else 'REVISE' end || text, '^(ACCEPT|REVISE)([^\p{L}\p{N}\p{M}_]|$)') as fits from conversations where text is not null")
def role_grammar(spark, d):
    role, k = roles.Role("verifier", output_grammar=roles.VERIFIER_GRAMMAR), F.col("turn") % 3
    said = F.concat(F.when(k == 0, "ACCEPT ").when(k == 1, "REVISED ").otherwise("REVISE"), F.col("text"))
    return fx.table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", role.fits_col(said).alias("fits"))


@query(f"with {CALLS_SQL} select doc_id, agent, case when event_id % 2 = 0 then 'worker' else 'planner' end as role, cast(sum(case when correct then 1 else 0 end) as bigint) as n_correct from calls where event_id % 5 <> 0 group by 1, 2, 3")
def role_rewards(spark, d):
    k = F.col("event_id")
    c = fx.calls(spark, d).select(F.col("doc_id").alias("task_id"), "agent", F.when(k % 5 == 0, None).when(k % 2 == 0, "worker").otherwise("planner").alias("role"), "correct")
    return roles.role_rewards(c, REPETITIONS).select(F.col("task_id").alias("doc_id"), "agent", "role", "n_correct")


@query(f"with {CALLS_SQL} select event_id, (case when latency_ms % 2 = 0 then 'ACCEPT' else 'REVISE' end) = (case when correct then 'ACCEPT' else 'REVISE' end) as verifier_correct from calls")
def verifier_rewards(spark, d):
    c = fx.calls(spark, d).select("event_id", F.when(F.col("latency_ms") % 2 == 0, "ACCEPT").otherwise("REVISE").alias("judgment"), F.col("correct").alias("worker_correct"))
    return roles.verifier_rewards(c).select("event_id", "verifier_correct")


# Task pool

_WANTED = {"de": 20, "en": 10**6, "es": 0, "xx": 3}


@query(f"with {DEDUPED_SQL}, w(domain, wanted) as (values ('de', 20::bigint), ('en', 1000000), ('es', 0), ('xx', 3)), n as (select domain, count(*) as n from ded group by 1) select domain, wanted, coalesce(n, 0) as n from w left join n using (domain) where coalesce(n, 0) < wanted")
def short_domains(spark, d):
    from routeloom.plans.queries import _deduped

    return taskpool.short_domains(_deduped(spark, d), _WANTED)


@query(f"with {TASKS_SQL} select split_part(task_id, '/', 1) as dataset, count(*) as n from tasks group by 1")
def datasets_of_ids(spark, d):
    return fx.tasks(spark, d).groupBy(taskpool.dataset_of(F.col("task_id")).alias("dataset")).agg(F.count("*").alias("n"))


@query(f"with {TASKS_SQL}, u as (select task_id, dataset from tasks where doc_id % 2 = 0 union all select task_id, dataset from tasks where doc_id % 2 = 1) select task_id, dataset, cast(row_number() over (partition by dataset order by task_id) as int) as position from u")
def pool_order(spark, d):
    """Sources put together, and each one's tasks in the order of their ids."""
    from pyspark.sql.window import Window

    x = fx.tasks(spark, d)
    both = x.where("doc_id % 2 = 0").unionByName(x.where("doc_id % 2 = 1"))
    return both.select("task_id", "dataset", F.row_number().over(Window.partitionBy("dataset").orderBy("task_id")).alias("position"))


# Texts

_OPTIONS = ("red", "green", "blue")


@query(f"""select doc_id, case when doc_id % 5 = 4 then null else 'Question: ' || trim(text) || chr(10) || chr(10) || 'A. red' || chr(10) || 'B. green' || chr(10) || 'C. blue' || chr(10) || chr(10) || '{t.MCQ}' end as choice,
{", ".join(f"'{head}: ' || trim(text) || chr(10) || chr(10) || '{ending}' as {kind}" for kind, (head, ending) in t.ENDINGS.items())} from documents""")
def prompts(spark, d):
    options = F.when(F.col("doc_id") % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, _OPTIONS)))
    return fx.table(spark, d, "documents").select("doc_id", t.mcq_prompt_col(F.col("text"), options).alias("choice"), *(t.prompt_col(F.col("text"), kind).alias(kind) for kind in t.ENDINGS))


@query("select l_orderkey, l_linenumber, case when l_linenumber = 4 then null when l_linenumber = 2 then -cast(round(l_extendedprice, 2) as double) else cast(round(l_extendedprice, 2) as double) end as number from lineitem")
def number_normal_form(spark, d):
    p, k = F.round("l_extendedprice", 2).cast("decimal(18,2)"), F.col("l_linenumber")
    shown = F.format_number(p, 2)
    forms = F.when(k == 1, F.concat(F.lit(" $"), shown, F.lit(". "))).when(k == 2, F.concat(F.lit("("), shown, F.lit(")"))).when(k == 3, F.concat(shown, F.lit("%"))).when(k == 4, F.concat(shown, F.lit("d"))).otherwise(p.cast("string"))
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.number_col(forms).alias("number"))


@query(r"""with v as (select doc_id, '$ \left(\dfrac{' || n_chars || '}{\text{' || lang || '} }\right)\, 5\% ^{\circ}$' as x from documents)
select doc_id, lower(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(x, '$ '), '\\(left|right)', '', 'g'), '\\[!,; ]', '', 'g'), '\\text\{([^}]*)\}', '\1', 'g'), '\\[dt]frac', '\\frac', 'g'), '^{\circ}', ''), '\%', ''), '\s+', '', 'g')) as form from v""")
def latex_normal_form(spark, d):
    x = F.concat(F.lit("$ \\left(\\dfrac{"), F.col("n_chars").cast("string"), F.lit("}{\\text{"), F.col("lang"), F.lit("} }\\right)\\, 5\\% ^{\\circ}$"))
    return fx.table(spark, d, "documents").select("doc_id", t.normalize_latex_col(x).alias("form"))


# Reports


@query(f"""with {RM_SQL}, a as (select agent, pos, cast(sum(n_correct) as bigint) as c, count(*) as n from rm group by 1, 2), top as (select sum(m) as top, count(*) as n from (select max(n_correct) as m from rm group by doc_id)),
b as (select agent, c from a order by c desc, pos limit 1),
l as (select 'always ' || agent as policy, c / (n * 3) as v from a union all select 'best fixed (' || agent || ')', c / (n * 3) from b, top union all select 'uniform', sum(c) / (any_value(n) * 3 * count(*)) from a union all select 'oracle', top / (n * 3) from top)
select '| ' || policy || ' | ' || printf('%.4f', v) || ' |' as line from l""")
def baseline_lines(spark, d):
    """Lines of the report of baselines."""
    rm = rewards.reward_matrix(fx.calls(spark, d), AGENTS)
    text = reports.baselines_report(analysis.per_agent(rm, fx.calls(spark, d), REPETITIONS), analysis.baselines(rm, REPETITIONS), "test")
    lines = [x for x in text.splitlines() if x.startswith("| ") and not x.startswith(("| Policy", "| ---", "| Input"))]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query(f"with {TASKS_SQL}, n as (select domain, count(*) as n from tasks group by 1) select '| ' || domain || ' | ' || n || ' | ' || printf('%.1f', 100 * n / sum(n) over ()) || '% |' as line from n union all select '| ' || dataset || ' | ' || count(*) || ' | ' || arg_max(license, task_id) || ' | ' || case when arg_max(redistributable, task_id) then 'yes' else 'no, ids only' end || ' |' from tasks group by dataset")
def pool_lines(spark, d):
    """Lines by domain and by source of the report of the task pool."""
    x = fx.tasks(spark, d)
    text = reports.pool_report(taskpool.facets(x, ("domain",)), taskpool.source_table(x), {}, {}, 42, 0.3)
    lines = [x for x in text.splitlines() if x.startswith("| ") and not x.startswith(("| domain", "| difficulty", "| split", "| Source", "| Input", "| ---"))]
    return spark.createDataFrame([(x,) for x in lines], "line string")


# Heads


@query("""with v as (select vec_id, embedding as e, list_filter(range(8), lambda k: (vec_id + k) % 3 <> 0) as ks from embeddings)
select vec_id, cast(j as int) as place, round(list_sum(list_transform(ks, lambda k: cast(e[k * 8 + j + 1] as double))) / len(ks), 6) as value from v, range(8) r(j)""")
def pooled_tokens(spark, d):
    """Embeddings read as eight token vectors, pooled under a mask."""
    e = fx.table(spark, d, "embeddings")
    eight = lambda f: F.transform(F.sequence(F.lit(0), F.lit(7)), f)
    tokens = eight(lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    mask = eight(lambda k: F.when((F.col("vec_id") + k) % 3 == 0, 0).otherwise(1))
    return e.select("vec_id", F.posexplode(routing.masked_mean(tokens, mask)).alias("place", "value")).withColumn("value", F.round("value", 6))


@query("""with r as (select vec_id, vec_id % 5 as pick, label % 5 as best, (vec_id * 7) % 10 / 10.0::double as other from embeddings),
a as (select avg(case when pick = best then 1 else other end) as router, avg((1 + 4 * other) / 5) as uniform, avg(greatest(1, other)) as oracle, """ + ", ".join(f"avg(case when best = {k} then 1 else other end) as m{k}" for k in range(5)) + """ from r)
select round(router, 6) as router, round(uniform, 6) as uniform, round(greatest(m0, m1, m2, m3, m4), 6) as best_fixed, round(oracle, 6) as oracle, router > greatest(m0, m1, m2, m3, m4) as beats_best_fixed from a""")
def head_picks(spark, d):
    """The report of a head's picks over all embeddings; here a pick is told by the id."""
    other = (F.col("vec_id") * 7) % 10 / F.lit(10.0)
    e = fx.table(spark, d, "embeddings").select((F.col("vec_id") % 5).cast("int").alias("pick"), F.array(*(F.when(F.col("label") % 5 == k, 1.0).otherwise(other) for k in range(5))).alias("rewards"))
    return routing.head_summary(e, 5).select(*(F.round(c, 6).alias(c) for c in ("router", "uniform", "best_fixed", "oracle")), "beats_best_fixed")


@query(f"""with {VERDICT_SQL} select '| ' || metric || ' | ' || printf('%.4f', value) || ' | ' || printf('%.2f', continue_at) || ' | ' || printf('%.2f', stop_at) || ' | ' || case verdict when 'continue' then 'PASS' when 'warn' then 'WARN' when 'missing' then 'MISSING' else 'FAIL' end || ' |' as line from ver
union all select '| ' || agent || ' | ' || printf('%.4f', n_correct / (n_tasks * 3)) || ' | ' || printf('%.1f', 100 * unique_wins / n_tasks) || '% | ' || printf('%.1f', 100 * n_empty / n_calls) || '% | ' || printf('%.1f', 100 * n_error / n_calls) || '% | ' || median_latency_ms || ' |' from pa join med using (agent)
union all select 'Collection cost ' || printf('%.4f', value) || ' USD.' from metrics where metric = 'total_cost_usd'""")
def health_lines(spark, d):
    """Gates, agents and cost in the report of health."""
    calls = fx.calls(spark, d)
    rm = rewards.reward_matrix(calls, AGENTS)
    datasets = fx.table(spark, d, "documents").select("doc_id", F.col("source").alias("dataset"))
    flat = analysis.health(rm, datasets, REPETITIONS)
    verdicts = analysis.gate_verdicts(analysis.long_metrics(flat), fx.gates(spark))
    text = reports.health_report(analysis.per_agent(rm, calls, REPETITIONS), verdicts, analysis.dataset_accuracy(rm, datasets, REPETITIONS), cost_usd=flat.first().total_cost_usd)
    rows = [x for x in text.splitlines() if x.startswith(("| ", "Collection"))]
    own = [x for x in rows if x.startswith("Collection") or x.split(" | ")[0][2:] in (*AGENTS, *(g[0] for g in fx.GATES))]
    return spark.createDataFrame([(x,) for x in own], "line string")


@query(f"with {TASKS_SQL} " + " union all ".join(f"select '| ' || {c} || ' | ' || count(*) || ' |' as line from tasks group by {c}" for c in ("dataset", "domain", "difficulty")))
def card_lines(spark, d):
    """Breakdowns on the card of published rewards."""
    facets = taskpool.facets(fx.tasks(spark, d), ("dataset", "domain", "difficulty"))
    from routeloom.operators import publish

    text = reports.rewards_card("Rewards", facets, publish.agent_manifest(fx.agents(spark, d)), 0)
    lines = text[text.index("## Distribution") :].splitlines()
    return spark.createDataFrame([(x,) for x in lines if x.startswith("| ") and not x.endswith("rows |") and not x.startswith("| ---")], "line string")
