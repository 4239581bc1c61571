"""The stages end to end on a small pool with a scripted provider."""

import json

import pytest
from pyspark.sql import functions as F

from routeloom.operators import collection, roles, routing
from routeloom.plans import fixtures, stages
from routeloom.schemas import IntegrityError


def said(agent, messages, repetition):
    """The oracle knows every answer, the half-wit those of even numbers, the mute nothing."""
    number = messages[1]["content"].split("number ")[1].split()[0]
    right = agent == "oracle" or (agent == "half" and int(number) % 2 == 0)
    if agent == "mute":
        return collection.Reply("")
    return collection.Reply(f"Answer: {number if right else 'none'}", cost_usd=0.001, latency_ms=40 + repetition)


@pytest.fixture(scope="module")
def built(spark):
    rows = {"gsm8k": spark.createDataFrame([(k, f"number {k} please", f"#### {k}") for k in range(30)] + [(30, "number 1  please", "#### 1"), (31, "", "#### 1")], "index int, question string, answer string")}
    rows["rlpr"] = spark.createDataFrame([(k, f"number {k} in words", (str(k),), ("phd",)) for k in range(12)], "index int, prompt string, reward_model struct<ground_truth:string>, extra_info struct<difficulty:string>")
    return stages.build_tasks(spark, {"gsm8k": 100, "rlpr": 100, "mmlu": 5, "nobody": 5, "math500": 0}, rows)


def test_build(built):
    assert set(built.unavailable) == {"mmlu", "nobody"}
    assert {tuple(r) for r in built.stats["gsm8k"].collect()} == {("yielded", 31), ("mapper_returned_none", 1)}
    got = {r.domain: r["count"] for r in built.tasks.groupBy("domain").count().collect()}
    assert got == {"math": 12, "reasoning": 12}


def test_collect_gate_publish_and_train(spark, built, tmp_path):
    tasks = built.tasks.cache()
    path, agents = str(tmp_path / "rewards"), ["half", "mute", "oracle"]
    some = tasks.where("domain = 'math'")
    assert stages.collect_rewards(some, agents, said, path, "v1").count() == 12
    records = stages.collect_rewards(tasks, agents, said, path, "v1")
    assert records.count() == 24 == records.select("task_id").distinct().count()
    with pytest.raises(FileExistsError):
        stages.collect_rewards(tasks, agents, said, path, "v1", resume=False)
    with pytest.raises(IntegrityError):
        stages.collect_rewards(tasks, agents, said, path, "v2")
    g = stages.gate_and_baselines(records, tasks, fixtures.gates(spark))
    by = {r.agent: r for r in g.per_agent.collect()}
    assert by["oracle"].mean_reward == 1 and by["mute"].empty_rate == 1 and by["half"].median_latency_ms == 41
    assert g.stopped and g.baselines.first().best_fixed_agent == "oracle"
    assert stages.publish_rewards(records, tasks, tmp_path / "out") == 12
    lines = [json.loads(x) for x in (tmp_path / "out/rewards.jsonl").read_text().splitlines()]
    assert all(len(x) == 15 and x["task_id"].startswith("gsm8k") and x["n_empty"] == [0, 3, 0] for x in lines)
    e = tasks.select("task_id", F.array(F.lit(1.0), F.rand(1)).alias("embedding"))
    report = stages.train_head(records, e, tasks, tmp_path / "head", generations=10)
    assert report["router"] == 1.0 and not report["beats_best_fixed"] and (tmp_path / "head/head.zip").exists()
    assert routing.training_rows(records, tasks).count() == 24
    with pytest.raises(ValueError):
        routing.training_rows(records.limit(5), tasks)


def test_verify_pool(spark):
    rows = [("a", False, "ok", None, 1), ("a", True, "ok", None, 9)]
    probes = spark.createDataFrame(rows, "agent string, is_length_probe boolean, text string, error string, completion_tokens long")
    assert stages.verify_pool(probes)[0] and not stages.verify_pool(probes.withColumn("text", F.lit("")))[0]


def test_fallback_split():
    train, test = routing.fallback_split(46)
    assert len(test) == 9 and sorted([*train, *test]) == list(range(46)) and len(routing.fallback_split(1)[1]) == 1


def test_roles(spark):
    verifier = roles.Role("verifier", "Check {query} given {transcript}", roles.VERIFIER_GRAMMAR)
    assert verifier.fits("ACCEPT.") and not verifier.fits("ACCEPTED") and not verifier.fits("I ACCEPT")
    assert verifier.messages("q", "t")[1]["content"] == "Check q given t"
    assert roles.by_id([verifier], "verifier") is verifier
    with pytest.raises(KeyError):
        roles.by_id([verifier], "worker")
    df = spark.createDataFrame([("ACCEPT", True), ("REVISE", True), ("REVISE", False)], "judgment string, worker_correct boolean")
    assert [r.verifier_correct for r in roles.verifier_rewards(df).collect()] == [True, False, True]
    c = spark.createDataFrame([("t", "a", "worker", True), ("t", "a", "worker", False), ("t", "a", None, True)], "task_id string, agent string, role string, correct boolean")
    assert [(r.role, r.mean_reward) for r in roles.role_rewards(c, 4).collect()] == [("worker", 0.25)]
    assert df.select(verifier.fits_col(F.col("judgment")).alias("x")).where("x").count() == 3


