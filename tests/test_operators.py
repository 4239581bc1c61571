"""Rewards, analysis, routing, task pool, catalogue, collection, publication, reports, sources and streaming."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routeloom import schemas
from routeloom.operators import analysis, catalog, collection, publish, reports, rewards, routing, taskpool
from routeloom.sources import mappers, readers
from routeloom.streaming import collect as streaming

AGENTS = ("a", "b", "c")


def calls(spark, rows):
    """rows: (doc_id, agent, correct, is_empty, is_error)."""
    return spark.createDataFrame([(*r, 100 + k) for k, r in enumerate(rows)], "doc_id long, agent string, correct boolean, is_empty boolean, is_error boolean, latency_ms long")


@pytest.fixture
def rm(spark):
    rows = [(1, "a", True), (1, "a", True), (1, "b", True), (1, "b", True), (1, "c", False), (2, "c", True), (2, "a", False), (3, "a", False), (4, "b", True)]
    return rewards.reward_matrix(calls(spark, [(*r, False, False) for r in rows]), AGENTS)


def test_missing_calls_count_as_wrong(rm):
    got = {(r.doc_id, r.agent): (r.n_correct, r.n_calls) for r in rm.collect()}
    assert len(got) == 12 and got[2, "b"] == (0, 0) and got[2, "c"] == (1, 1)


def test_winners_and_ties(rm):
    got = {r.doc_id: (r.best_agents, r.n_winners, r.first_agent) for r in rewards.winners(rm).collect()}
    assert got == {1: ("a,b", 2, "a"), 2: ("c", 1, "c"), 3: ("a,b,c", 3, "a"), 4: ("b", 1, "b")}


def test_three_tie_breaks(spark, rm):
    data = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "doc_id long, dataset string")
    m = analysis.dataset_accuracy(rm, data, 3)
    assert analysis.complete(m).count() == 0
    c = analysis.combination(m).first()
    assert c.best_agent == "b" and c.n_datasets == 2
    b = analysis.baselines(rm.where("doc_id = 1"), 3).first()
    assert b.best_fixed_agent == "a" and b.headroom == 0
    equal = spark.createDataFrame([("x", "a", 0, 0.5), ("x", "b", 1, 0.5)], "dataset string, agent string, pos int, accuracy double")
    assert analysis.combination(equal).first().best_agent == "b"


def test_error_reduction(spark):
    f = lambda o, b: spark.range(1).select(analysis.error_reduction(F.lit(o), F.lit(b))).first()[0]
    assert abs(f(0.9, 0.8) - 0.5) < 1e-9 and f(1.0, 1.0) == 0


@pytest.mark.parametrize("direction,value,want", [("min", 0.1, "continue"), ("min", 0.03, "stop"), ("min", 0.05, "warn"), ("max", 0.45, "warn"), ("max", 0.02, "continue"), ("max", 0.65, "stop"), ("min", None, "missing")])
def test_verdicts(spark, direction, value, want):
    lim = (0.1, 0.03) if direction == "min" else (0.02, 0.65)
    df = spark.createDataFrame([(direction, value, *lim)], "d string, v double, c double, s double")
    assert df.select(analysis.verdict(F.col("d"), F.col("v"), F.col("c"), F.col("s"))).first()[0] == want


def test_missing_is_worse_than_warn(spark):
    v = spark.createDataFrame([("m1", "warn"), ("m2", "missing"), ("m3", "continue")], "metric string, verdict string")
    assert tuple(analysis.gate_decision(v).first()) == ("missing", 1)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 5), ("a", 1), ("a", 9), ("a", 7), ("a", None), ("b", 2), ("c", None)], "agent string, latency_ms long")
    assert {tuple(r) for r in analysis.upper_medians(df).collect()} == {("a", 7), ("b", 2)}
    assert df.groupBy("agent").agg(analysis.upper_median(F.col("latency_ms")).alias("m")).where("agent = 'a'").first().m == 7


def test_route_accuracy_counts_ties_and_skips_unknowns(spark, rm):
    choices = spark.createDataFrame([(1, "b"), (2, "a"), (4, "b"), (99, "a"), (3, "nobody")], "doc_id long, agent string")
    assert routing.route_accuracy(rm, choices).first().asDict() == {"n_scored": 3, "n_hits": 2, "accuracy": 2 / 3}
    assert routing.routed_reward(rm, choices, 3).first().reward == pytest.approx(3 / 9)


def test_stored_winners_are_not_trusted(spark):
    row = ("s/t/000001", "v1", 3, ["a", "b"], [2 / 3, 0.6666666666666667], ["b"], False, [])
    got = rewards.rederived(spark.createDataFrame([row], schemas.REWARD)).first()
    assert got.best_agents == ["a", "b"] and got.is_tie


def test_reward_records_round_trip(spark):
    c = spark.createDataFrame([("s/t/1", "a", True, False, None), ("s/t/1", "b", False, False, "HTTP 500")], "task_id string, agent string, correct boolean, empty boolean, error string")
    r = rewards.records(c, ("a", "b"), 2, "v1").first()
    assert (r.mean_reward, r.best_agents, r.is_tie, len(r.calls)) == ([0.5, 0.0], ["a"], False, 2)


def test_violations(spark):
    tasks = spark.createDataFrame([("a/b/1", " ", "1", "easy", "train", "held_out"), ("a/b", "p", "1", "tough", "train", "held_out")], "task_id string, prompt string, answer string, difficulty string, split string, task_group string")
    assert {tuple(r) for r in schemas.task_violations(tasks).collect()} == {("a/b/1", "blank prompt"), ("a/b", "task_id needs two slashes"), ("a/b", "unknown difficulty")}
    with pytest.raises(schemas.IntegrityError):
        schemas.must_be_empty(schemas.task_violations(tasks), "tasks")


def test_agents_by_id(spark):
    pool = [{"id": "a", "slug": "v/a"}, {"id": "b", "slug": "v/b"}]
    assert schemas.agent_by_id(pool, "b")["slug"] == "v/b"
    with pytest.raises(KeyError):
        schemas.agent_by_id(pool, "c")


def test_pool_contract():
    agent = lambda k, i, s, **more: {"index": k, "id": i, "slug": s, **more}
    assert schemas.pool_problems([agent(0, "x", "v/m"), agent(2, "y", "v/n"), agent(3, "z", "v/m", retired=True)]) == []
    assert len(schemas.pool_problems([agent(1, "x", "v/m"), agent(0, "x", "v/m")])) == 3
    assert schemas.pool_problems([agent(0, "open_direct", "v/m-instruct-1"), agent(1, "open_reasoning", "v/m-thinking-1")]) == []
    assert schemas.pool_problems([agent(0, "open_direct", "v/m-instruct-1"), agent(1, "open_reasoning", "v/k-thinking-1")])


# Task pool


def pool(spark, counts, held=()):
    rows = [(f"s/t/{d}{k:04d}", f"prompt {d} {k}", "1", "numeric_match", d, ("easy", "hard")[k % 2], "held_out" if k in held else "in_distribution") for d, n in counts.items() for k in range(n)]
    return spark.createDataFrame(rows, "task_id string, prompt string, answer string, grader string, domain string, difficulty string, task_group string")


@pytest.mark.parametrize("counts,cap", [([100, 10, 10], 10), ([5, 5, 5], 5), ([50, 40, 30, 20], 40), ([7], 7), ([], 0), ([1, 1000], 1), ([400, 370, 400], 370)])
def test_largest_cap(counts, cap):
    def fits(c):
        kept = [min(n, c) for n in counts]
        return max(kept) / sum(kept) <= taskpool.effective_share(len(counts)) + 1e-9

    assert taskpool.largest_cap(counts) == max([c for c in range(1, max(counts, default=0) + 1) if fits(c)], default=1 if counts else 0)
    if counts in ([100, 10, 10], [400, 370, 400]):
        assert taskpool.largest_cap(counts) == cap


def test_balance_native_and_compatible(spark):
    p = pool(spark, {"m": 60, "k": 12, "r": 12})
    for f in (taskpool.balanced, taskpool.balanced_compat):
        kept = f(p)
        assert taskpool.domain_counts(kept) == {"m": 12, "k": 12, "r": 12}
        assert sorted(r.task_id for r in kept.collect()) == sorted(r.task_id for r in f(p).collect())
    ids = sorted(r.task_id for r in p.where("domain = 'm'").collect())
    assert sorted(r.task_id for r in taskpool.balanced_compat(p).where("domain = 'm'").collect()) == sorted(random.Random(42).sample(ids, 12))


def test_splits(spark):
    p = pool(spark, {"m": 25, "k": 3}, held=(0, 1))
    for f in (taskpool.split, taskpool.split_compat):
        s = f(p)
        assert taskpool.leaks(s).count() == 0
        got = {(r.domain, r.difficulty, r.split): r["count"] for r in s.where("task_group <> 'held_out'").groupBy("domain", "difficulty", "split").count().collect()}
        assert got["m", "easy", "train"] == 7 and got["m", "easy", "validation"] == 2 and got["m", "easy", "test"] == 3  # 12 tasks
        assert got["k", "easy", "train"] == 1 and ("k", "easy", "test") not in got  # one task goes to train
        with pytest.raises(ValueError):
            f(p, dict(train=0.5, validation=0.2, test=0.2))
    ids = sorted(r.task_id for r in p.where("domain = 'm' and difficulty = 'hard' and task_group <> 'held_out'").collect())
    random.Random("42/('m', 'hard')").shuffle(ids)
    got = {r.task_id: r.split for r in taskpool.split_compat(p).collect()}
    assert [got[i] for i in ids] == ["train"] * 7 + ["validation"] * 2 + ["test"] * 2


def test_ranks_against_a_plain_sort(spark):
    import hashlib

    rows = [(f"t{k % 300:04d}", ("m", "k", None)[k % 3]) for k in range(310)]  # some ids twice
    got = taskpool.ranked(spark.createDataFrame(rows, "task_id string, domain string"), ["domain"], taskpool.seeded(42, F.col("task_id"))).collect()
    for d in ("m", "k", None):
        own = sorted((hashlib.md5(f"42/{i}".encode()).hexdigest(), i) for i, e in rows if e == d)
        assert sorted((r.rn, r.task_id) for r in got if r.domain == d) == [(k, i) for k, (_, i) in enumerate(own, 1)]
        assert {r.n for r in got if r.domain == d} == {len(own)}


def test_dedupe_keeps_the_least_id(spark):
    from routeloom.functions import grading

    p = spark.createDataFrame([("s/t/2", "Straße  x."), ("s/t/1", "STRASSE X"), ("s/t/3", "other")], "task_id string, prompt string")
    assert {r.task_id for r in taskpool.deduplicated(p, grading.fingerprint_col(F.col("prompt"))).collect()} == {"s/t/1", "s/t/3"}


def test_gate_2(spark):
    p = taskpool.split(pool(spark, {"m": 30, "k": 2}))
    assert {tuple(r) for r in taskpool.gate_2(p).collect()} == {("domain share", "m")}
    assert [tuple(r) for r in taskpool.gate_2(p.limit(0)).collect()] == [("empty pool", "")]
    bad = p.withColumn("answer", F.when(F.col("task_id") == "s/t/k0000", " ").otherwise("1")).withColumn("split", F.lit("train"))
    assert {("blank answer", "s/t/k0000"), ("empty split", "test"), ("empty split", "validation")} <= {tuple(r) for r in taskpool.gate_2(bad).collect()}


def test_pilot_sample(spark):
    p = pool(spark, {"m": 30, "k": 3})
    got = sorted(r.task_id for r in taskpool.sample_per_domain(p, {"m": 5, "k": 9}).collect())
    ids = sorted(r.task_id for r in p.where("domain = 'm'").collect())
    assert got == sorted(random.Random("42/m").sample(ids, 5) + [f"s/t/k{k:04d}" for k in range(3)])


# Catalogue


def entry(slug, price=1.0, context=131072, reasoning=False):
    return (slug, slug.split("/")[-1], context, price, reasoning)


def test_proposals_and_distinct_vendors(spark):
    rows = [entry("acme/big", 12.0), entry("zeta/big", 12.0, 200000), entry("acme/latest", 14.0), entry("~x/y", 9.0), entry("acme/m:free", 9.0), entry("openrouter/auto", 9.0), entry("qwen/m-instruct-1", 0.5), entry("qwen/m-thinking-1", 0.7, reasoning=True), entry("deepseek/r1", 0.9, reasoning=True), entry("mistralai/devstral", 0.3), entry("meta-llama/small", 0.1, 8192), entry("meta-llama/mid", 0.2)]
    c = spark.createDataFrame(rows, "slug string, name string, context_length long, output_usd_per_1m double, supports_reasoning boolean")
    got = {}
    for r in catalog.proposals(c).orderBy("slot", "rank").collect():
        got.setdefault(r.slot, []).append(r.slug)
    assert got["frontier_a"] == got["frontier_c"] == ["zeta/big", "acme/big"]
    assert got["open_mid"] == ["meta-llama/mid", "qwen/m-instruct-1"] and got["open_direct"] == ["qwen/m-instruct-1"] and got["open_reasoning"] == ["qwen/m-thinking-1"]
    assert got["open_distill_reasoning"] == ["qwen/m-thinking-1", "deepseek/r1"] and got["open_coder"] == ["mistralai/devstral"]
    pick = catalog.distinct_vendors([tuple(r) for r in catalog.proposals(c).collect()])
    assert pick["frontier_a"] == "zeta/big" and pick["frontier_b"] == "acme/big" and pick["frontier_c"] == "zeta/big" and pick["open_reasoning"] == "qwen/m-thinking-1"


def test_catalogue_entries(spark):
    raw = spark.createDataFrame([("v/m", None, "d" * 500, 1000, ("0.00000215", "oops"), ["reasoning"]), (None, "n", None, None, None, None)], "id string, name string, description string, context_length long, pricing struct<prompt:string,completion:string>, supported_parameters array<string>")
    a, b = catalog.entries(raw).collect()
    assert a.prompt_usd_per_1m == 2.15 and a.output_usd_per_1m == 0.0 and len(a.description) == 400 and a.supports_reasoning and b.slug == "" and not b.supports_reasoning


# Collection


def chat(agent, messages, repetition):
    if agent == "broke":
        return collection.Reply(error="HTTP 402: no credit")
    if agent == "long":
        return collection.Reply("x", completion_tokens=5_000)
    if agent == "mute":
        return collection.Reply(" ")
    if agent == "down":
        return collection.Reply(error="HTTP 500")
    return collection.Reply(f"Answer: {messages[1]['content'][-1]}", completion_tokens=5, cost_usd=0.0001)


@pytest.fixture
def tasks(spark):
    return spark.createDataFrame([(f"s/t/{k}", f"say {k}", str(k), "numeric_match") for k in range(4)], "task_id string, prompt string, answer string, grader string")


def test_collect_grades_every_call(tasks):
    c = collection.collect(tasks, ("ok", "mute", "down"), chat, 2, sleep=lambda _: None)
    rows = c.collect()
    assert len(rows) == 24 and all(r.correct == (r.agent == "ok") for r in rows)
    assert {r.agent: (r.n_calls, r.n_error, r.n_empty) for r in collection.progress(c).collect()} == {"ok": (8, 0, 0), "mute": (8, 0, 8), "down": (8, 8, 0)}
    assert {r.agent: (r.n_calls, r.n_tasks) for r in collection.call_plan(tasks, ("x",), 3).groupBy("agent").agg(F.count("*").alias("n_calls"), F.count_distinct("task_id").alias("n_tasks")).collect()} == {"x": (12, 4)}


def test_calls_are_handed_on_together():
    """Many calls a batch, whole tasks each; long replies fill one sooner."""
    given = pa.RecordBatch.from_arrays([pa.array(x) for x in ([f"t{k}" for k in range(1500)], ["say 7"] * 1500, ["7"] * 1500, ["numeric_match"] * 1500)], ["task_id", "prompt", "answer", "grader"])
    got = list(collection.calls_of(iter([given, given]), ("ok", "mute"), chat, 2, True, 4096, 4))
    assert len(got) <= 7 and all(b.num_rows <= collection.CALL_ROWS for b in got)
    assert [(r["task_id"], r["agent"], r["repetition"], r["correct"]) for b in got for r in b.to_pylist()] == [(f"t{k}", a, n, a == "ok") for _ in range(2) for k in range(1500) for a in ("ok", "mute") for n in range(2)]
    wordy = list(collection.calls_of(iter([given.slice(0, 50)]), ("ok",), lambda *_: collection.Reply("7 " * 150_000), 1, True, 4096, 4))
    assert sum(b.num_rows for b in wordy) == 50 and max(b.num_rows for b in wordy) <= 4
    with pytest.raises(Exception, match="truncated"):
        list(collection.calls_of(iter([given]), ("ok",), lambda *_: collection.Reply("7", completion_tokens=1.5), 1, True, 4096, 4))


def test_parsed_bodies_keep_the_other_columns(spark):
    rows = [(k, None if k % 2 else [k], json.dumps({"choices": [{"message": {"content": "x" * 50_000}}], "usage": {"completion_tokens": k}}) if k % 3 else "rubbish") for k in range(60)]
    got = collection.replies(spark.createDataFrame(rows, "k long, other array<int>, body string").coalesce(1)).orderBy("k").collect()
    assert [(r.k, r.other, r.body) for r in got] == rows
    assert all((r.said, r.completion_tokens, r.error) == (("x" * 50_000, r.k, None) if r.k % 3 else ("", None, "unreadable body")) and r.fatal is False for r in got)


@pytest.mark.parametrize("agent", ["broke", "long"])
def test_fatal_calls_stop_the_run(tasks, agent):
    with pytest.raises(Exception, match="Aborted|ProtocolViolation"):
        collection.collect(tasks, (agent,), chat, 1).collect()


def test_resume(spark, tasks):
    done = spark.createDataFrame([("s/t/1", "v1", ["a"], 3)], "task_id string, pool_version string, agent_order array<string>, repetitions int")
    assert {r.task_id for r in collection.pending(tasks, done).collect()} == {"s/t/0", "s/t/2", "s/t/3"}
    collection.must_fit(done, "v1", ["a"], 3)
    for plan in (("v2", ["a"], 3), ("v1", ["a", "b"], 3), ("v1", ["a"], 2)):
        with pytest.raises(schemas.IntegrityError):
            collection.must_fit(done, *plan)


def test_bodies_and_retries():
    ok = json.dumps({"usage": {"completion_tokens": 3}, "choices": [{"finish_reason": "length", "message": {"content": "hi"}}]})
    r = collection.parse_body(": PROCESSING\n\n: PROCESSING\n" + ok)
    assert r.text == "hi" and r.truncated and r.completion_tokens == 3
    assert collection.parse_body(json.dumps({"error": {"code": 402, "message": "x"}})).fatal
    assert collection.parse_body(": only keep-alive").error and collection.parse_body("[1]").error
    waits, codes = [], [429, 500, None]
    collection.with_retries(lambda: collection.Reply(), lambda _: codes.pop(0), sleep=waits.append)
    assert len(waits) == 2 and 1 <= waits[0] <= 1.5 and 2 <= waits[1] <= 2.5
    said = [collection.parse_body(json.dumps({"error": {"code": 429, "message": "busy"}})), collection.Reply(error="unreadable body"), collection.Reply("fine"), collection.Reply(error="HTTP 400: no")]
    calls = []
    patient = collection.retrying(lambda *x: calls.append(x) or said.pop(0), sleep=waits.append)
    assert patient("a", [], 0).text == "fine" and len(calls) == 3 and len(waits) == 4
    assert patient("a", [], 1).error.startswith("HTTP 400") and len(calls) == 4  # isn't repeated
    assert collection.messages("q", "T {transcript} Q {query}", transcript="so far")[1]["content"] == "T so far Q q"


def test_preflight(spark):
    rows = [(a, False, "ok", None, 3) for a in ("good", "err", "mute", "long", "quiet") for _ in range(3)] + [("good", True, "x", None, 10), ("err", False, None, "HTTP 500", None), ("mute", False, "", None, 1), ("long", True, "x", None, 9999), ("mute", True, "x", None, 1), ("quiet", True, "", None, None)]
    got = {r.agent: r.reason for r in collection.preflight(spark.createDataFrame(rows, "agent string, is_length_probe boolean, text string, error string, completion_tokens long")).collect()}
    assert got == {"good": "", "err": "call errors", "mute": "empty replies", "long": "ignored the cap", "quiet": "ignored the cap"}


# Publication and reports


def test_public_rows_have_no_text(spark, rm):
    t = spark.createDataFrame([(k, f"{'rlpr' if k == 3 else 's'}/t/{k}", "s", "m", "easy", "g", "train", "secret") for k in (1, 2, 3, 4)], "doc_id long, task_id string, dataset string, domain string, difficulty string, task_group string, split string, prompt string")
    p = publish.public_rows(rm, t, AGENTS, 3, "v1")
    assert sorted(p.columns) == sorted(f.name for f in schemas.PUBLIC_ROW) and len(p.columns) == 15
    got = {r.task_id: r for r in p.collect()}
    assert set(got) == {"s/t/1", "s/t/2", "s/t/4"} and got["s/t/1"].best_agents == ["a", "b"] and got["s/t/1"].n_correct == [2, 2, 0]
    with pytest.raises(Exception, match="a reward without its task: 2"):
        publish.public_rows(rm, t.where("doc_id <> 2"), AGENTS, 3, "v1").collect()
    assert publish.leaking(spark.createDataFrame([('{"prompt": 1}',), ('{"n": 1}',)], "value string")).count() == 1


def test_reports_are_reproducible(spark, rm, tmp_path):
    data = spark.createDataFrame([(k, "xy"[k % 2]) for k in range(1, 5)], "doc_id long, dataset string")
    c = calls(spark, [(1, "a", True, False, False), (2, "b", True, False, False)])
    agents = analysis.per_agent(rm, c, 3)
    gates = spark.createDataFrame([("rer_dataset", "min", 0.9, 0.5), ("absent", "min", 1.0, 0.0)], "metric string, direction string, continue_at double, stop_at double")
    verdicts = analysis.gate_verdicts(analysis.long_metrics(analysis.health(rm, data, 3)), gates)
    f = tmp_path / "in.jsonl"
    f.write_text("a\n\nb\n")
    one, two = (reports.health_report(agents, verdicts, analysis.dataset_accuracy(rm, data, 3), {"rewards": f}) for _ in range(2))
    assert one == two and "**STOP**" in one and "| rewards | in.jsonl |" in one and "| 3 |" in one and "- absent" in one
    assert "Headroom" in reports.baselines_report(agents, analysis.baselines(rm, 3), "test")
    assert reports.pct(0.0025) == "0.2%" and reports.num(None) == "n/a"


def test_cards(spark):
    p = taskpool.split(pool(spark, {"m": 5})).withColumn("dataset", F.lit("s")).withColumn("license", F.lit("MIT"))
    facets, sources = taskpool.facets(p), taskpool.source_table(p)
    manifest = publish.agent_manifest(spark.createDataFrame([(0, "a", "v/a", False, 1, 0.1, 0.2, "2026-01-01", False), (1, "b", "v/b", False, 1, 0.1, 0.2, "", True)], schemas.AGENT))
    assert manifest.count() == 1
    assert "| 0 | a | v/a |" in reports.rewards_card("R", facets, manifest, 5, {"s2": "no license"})
    assert "5 tasks, of which 2 have rewards" in reports.tasks_card("T", facets, sources, 5, 2, "R")
    assert "## By domain" in reports.pool_report(facets, sources, {"duplicates": 0}, {"hub": "offline"}, 42, 0.3)


# Sources


def mapped(name, rows):
    return [(r.task, r.reason) for r in mappers.map_source(name, rows).orderBy("index").collect()]


def test_numeric_sources(spark):
    rows = spark.createDataFrame([(0, " q ", "x #### 1,234 "), (1, "q", "no mark"), (2, "", "#### 1"), (3, "q", "#### 1 #### 2")], "index int, question string, answer string")
    got = mapped("gsm8k", rows)
    assert [t and t.answer for t, _ in got] == ["1234", None, None, "2"] and got[1][1] == "mapper_returned_none"
    assert got[0][0].task_id == "gsm8k/test/000000" and got[0][0].prompt.startswith("Problem: q\n\n")
    rows = spark.createDataFrame([(0, "p", "0", 1), (1, "p", "x", 3), (2, "p", "x", 9)], "index int, problem string, answer string, level int")
    assert [t.difficulty for t, _ in mapped("math500", rows)] == ["easy", "medium", "hard"]
    numbers = spark.createDataFrame([(0, "p", 0), (1, "p", 7)], "index int, problem string, answer int")
    assert [t and t.answer for t, _ in mapped("aime2025_ii", numbers)] == [None, "7"]  # the integer 0 counts as absent


def test_choice_sources(spark):
    rows = spark.createDataFrame([(0, "q", ["a", "b", "c"], 2), (1, "q", ["a"], 0), (2, "q", ["a", "b"], 5), (3, "q", [str(k) for k in range(11)], 1)], "index int, question string, choices array<string>, answer int")
    got = mapped("mmlu", rows)
    assert [t and t.answer for t, _ in got] == ["C", None, None, None] and [r for _, r in got] == [None, "mapper_returned_none", "mapper_returned_none", "mapper_error:ValueError"]
    rows = spark.createDataFrame([(0, "q", ["a", " n/a ", "b"], "B", None), (1, "q", ["a", "b"], None, 1)], "index int, question string, options array<string>, answer string, answer_index int")
    assert [t.answer for t, _ in mapped("mmlu_pro", rows)] == ["B", "B"]
    rows = spark.createDataFrame([(0, "q", (["x", "y"], ["1", "2"]), "2"), (1, "q", (["x", "y"], ["A", "B"]), "A"), (2, "q", (["x", "y"], ["A"]), "A")], "index int, question string, choices struct<text:array<string>,label:array<string>>, answerKey string")
    assert [t and t.answer for t, _ in mapped("arc_challenge", rows)] == ["B", "A", None]


def test_shuffled_options_follow_the_generator(spark):
    rows = spark.createDataFrame([(k, "q", "right", "w1", "w2", "w3") for k in range(6)], "index int, Question string, `Correct Answer` string, `Incorrect Answer 1` string, `Incorrect Answer 2` string, `Incorrect Answer 3` string")
    for k, (t, _) in enumerate(mapped("gpqa_diamond", rows)):
        options = ["right", "w1", "w2", "w3"]
        random.Random(f"gpqa/{k}").shuffle(options)
        assert t.answer == "ABCD"[options.index("right")] and f"\n{t.answer}. right" in t.prompt


def test_other_sources(spark):
    turn = "array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([(0, [("user", "first"), ("assistant", "x"), ("user", "second")], ("yes",), ("PhD ",), "law")], f"index int, prompt {turn}, reward_model struct<ground_truth:string>, extra_info struct<difficulty:string>, ability string")
    t = mapped("rlpr", rows)[0][0]
    assert "second" in t.prompt and t.difficulty == "hard" and t.source.subject == "law"
    rows = spark.createDataFrame([(0, "s", "1", ["x", "y"]), (1, "s", "Ankara", None)], "index int, soru string, cevap string, secenekler array<string>")
    got = [t for t, _ in mapped("turkish", rows)]
    assert [(t.answer, t.grader) for t in got] == [("B", "mcq_letter"), ("Ankara", "exact_match_ci")]
    with pytest.raises(ValueError):
        mappers.source(mappers.REGISTRY["mmlu"][0])(lambda r: None)


def test_limited_mapping(spark):
    rows = spark.createDataFrame([(k, k % 3 != 0) for k in range(50)], "i long, ok boolean")
    got = readers.limited(rows, "i", F.col("ok"), 7)
    assert sorted(r.i for r in got.collect()) == list(range(11))
    assert {tuple(r) for r in readers.map_stats(got, F.when(~F.col("ok"), "none")).collect()} == {("yielded", 7), ("none", 4)}
    assert readers.limited(rows.limit(0), "i", F.col("ok"), 7).count() == 0 and readers.limited(rows, "i", F.col("ok"), None).count() == 50


def test_readers_and_sinks(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    assert readers.read_jsonl(spark, path, schemas.GATE).count() == 0
    df = spark.createDataFrame([("é", 2), ("a", 1)], "k string, n int")
    assert readers.write_jsonl_file(df, path, "k") == 2
    assert (tmp_path / "x.jsonl").read_text() == '{"k": "a", "n": 1}\n{"k": "é", "n": 2}\n'
    assert readers.read_source(spark, f"local:{path}", "test").count() == 2
    for missing in ("local:/nowhere/x.jsonl", "org/name"):
        with pytest.raises(readers.SourceUnavailable):
            readers.read_source(spark, missing, "test")
    (tmp_path / "bad.jsonl").write_text('{"metric": "m"\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.GATE).collect()
    assert {tuple(r) for r in readers.last_of_each(spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "k string, v int, o int"), "k", F.col("o")).select("k", "v").collect()} == {("a", 2), ("b", 3)}
    assert readers.first_split(["validation", "test"]) == "test"
    (tmp_path / "c.json").write_text('{"pool_version": "v1"}')
    assert readers.load_config(tmp_path / "c.json", pool_version="v1")
    with pytest.raises(ValueError):
        readers.load_config(tmp_path / "c.json", pool_version="v2")
    table = str(tmp_path / "t")
    for _ in range(2):
        readers.append_once(df, table, "k")
    assert spark.read.parquet(table).count() == 2


# Routing heads


def test_a_flaky_provider_is_asked_again(tasks):
    def flaky(agent, messages, repetition, asked={}):  # noqa: B006
        key = (messages[1]["content"], repetition)
        asked[key] = asked.get(key, 0) + 1
        return collection.Reply(error="HTTP 503") if asked[key] < 3 else collection.Reply(f"Answer: {messages[1]['content'][-1]}")

    assert all(r.correct and r.error is None for r in collection.collect(tasks, ("a",), flaky, 2, sleep=lambda _: None).collect())
    assert all(r.error == "HTTP 503" for r in collection.collect(tasks, ("a",), flaky, 2, attempts=2, sleep=lambda _: None).collect())


def test_the_cost_of_collection(spark):
    c = spark.createDataFrame([(1, "a", True, False, False, 0.5), (1, "b", False, False, False, None), (2, "a", True, False, False, 0.25), (2, "x", True, False, False, 9.0)], "doc_id long, agent string, correct boolean, is_empty boolean, is_error boolean, cost_usd double")
    data = spark.createDataFrame([(1, "s"), (2, "s")], "doc_id long, dataset string")
    assert analysis.health(rewards.reward_matrix(c, ("a", "b")), data, 1).first().total_cost_usd == 0.75
    assert analysis.health(rewards.reward_matrix(c.drop("cost_usd"), ("a", "b")), data, 1).first().total_cost_usd == 0


def test_search_with_many_parameters():
    """Where the covariance is decomposed late, and where it is decomposed each time."""
    for dim, generations in ((40, 60), (700, 120)):
        goal = np.linspace(-1, 1, dim)
        loss = lambda x, goal=goal: float(((x - goal) ** 2).sum())
        best, least = routing.evolve(loss, dim, generations=generations)
        assert least == loss(best) < (0.3 if dim == 40 else 0.95) * loss(np.zeros(dim))


def test_masked_mean(spark):
    rows = [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])]
    got = spark.createDataFrame(rows, "t array<array<double>>, m array<int>").select(routing.masked_mean(F.col("t"), F.col("m")).alias("p")).collect()
    assert [r.p for r in got] == [[2.0, 3.0], [0.0, 0.0]]


def test_head_shapes_and_training():
    assert routing.parameter_count(2048, 5) == 10245
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    r = np.eye(3)[x.argmax(axis=1)]
    theta = routing.train_head(x, r, generations=40)
    rep = routing.head_report(theta, x, r)
    assert rep["router"] > 0.9 and rep["beats_best_fixed"] and rep["oracle"] == 1.0
    assert routing.logits(np.zeros(routing.parameter_count(3, 2, 4)), x, 2, 4).shape == (80, 2)
    with pytest.raises(ValueError):
        routing.unflatten(np.zeros(3), 3, 3)
    assert not routing.head_report(theta, x, np.ones((80, 3)))["beats_best_fixed"]


@pytest.mark.parametrize("trained", [60, 10_000])
def test_head_is_reported_on_all_embeddings(spark, tmp_path, monkeypatch, trained):
    from routeloom.plans import queries

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    label = (x[:, :5].argmax(axis=1) + 5 * rng.integers(0, 3, 400)).tolist()
    spark.createDataFrame([(k, v, y) for k, (v, y) in enumerate(zip(x.tolist(), label))], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = x.astype(np.float32).astype(float)
    r = np.array([[float(y % 5 == k) for k in range(5)] for y in label])
    monkeypatch.setattr(queries, "TRAIN_VECTORS", trained)
    order = np.array(sorted(range(400), key=lambda k: hashlib.md5(str(k).encode()).hexdigest()))
    theta = routing.train_head(x[order[:trained]], r[order[:trained]], generations=20)
    got = {m.metric: m for m in queries.head_vs_baselines(spark, str(tmp_path)).collect()}
    want = lambda at: pytest.approx({k: float(v) for k, v in routing.head_report(theta, x[at], r[at]).items()})
    assert {k: m.value for k, m in got.items()} == want(order)
    if len(rest := order[trained:]):
        assert {k: m.held_out for k, m in got.items()} == want(rest)
    else:
        assert {m.held_out for m in got.values()} == {None}


# Streaming


def test_stream_appends_once_and_refuses_other_plans(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = schemas._struct(("task_id", schemas._S), ("pool_version", schemas._S), ("agent_order", schemas.T.ArrayType(schemas._S)), ("repetitions", schemas._L))
    row = lambda k, v="v1": json.dumps({"task_id": k, "pool_version": v, "agent_order": ["a"], "repetitions": 3}) + "\n"
    (src / "1.json").write_text(row("t1") + row("t2"))
    go = lambda n: streaming.drain(streaming.sink_once(streaming.stream_jsonl(spark, str(src), schema), out, str(tmp_path / f"ck{n}"), "v1", ["a"], 3))
    go(0)
    (src / "2.json").write_text(row("t2") + row("t3"))
    go(1)  # a lost checkpoint replays everything
    assert sorted(r.task_id for r in spark.read.parquet(out).collect()) == ["t1", "t2", "t3"]
    (src / "3.json").write_text(row("t4", "v2"))
    with pytest.raises(Exception, match="can't resume"):
        go(1)


def test_live_health(spark, tmp_path):
    rows = [("2026-01-01 00:00:10", "a", True, None), ("2026-01-01 00:01:00", "a", False, "x"), ("2026-01-01 00:30:00", "b", False, None)]
    spark.createDataFrame(rows, "ts string, agent string, empty boolean, error string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/e")
    s = spark.readStream.schema("ts timestamp, agent string, empty boolean, error string").parquet(f"{tmp_path}/e")
    q = streaming.live_health(s).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.agent, r.n_calls, r.n_empty, r.n_error) for r in spark.table("live").collect()] == [("a", 2, 1, 1)]
