"""The pipeline against a brute-force version of its stages, on a small corpus with edge cases."""

import random
from collections import Counter

import corpus_pipeline
from routeloom.llm import decontaminate, quality
from routeloom.llm.tables import labelled_sample

from .test_corpus_operators import brute_mix, brute_pairs, brute_spans, quality_corpus, words_of


def test_stages_are_the_ones_to_build():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "mix"]


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    base = quality_corpus(300, 1)
    item = " ".join(f"b{k}" for k in range(20))
    docs = [(d, t, "en", rng.choice(["s1", "s1", "s2"])) for d, t, _, _ in base]
    good = [d for d, b in zip(docs, base) if b[3]]
    docs += [(10**7 + k, d[1], "en", "s2") for k, d in enumerate(good[:20])]
    docs += [(2 * 10**7 + k, d[1] + " tail", "en", "s1") for k, d in enumerate(good[30:60])]
    docs += [(3 * 10**7 + k, d[1] + " " + item + " end of it", "en", "s1") for k, d in enumerate(good[70:80])] + [(4 * 10**7, None, None, None), (4 * 10**7 + 1, "", "en", None), docs[1], docs[1]]
    rows = [(*d, None if d[1] is None else len(d[1])) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, y) for d, _, _, y in base], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    read = spark.read.parquet
    model = quality.fit(labelled_sample(read(f"{tmp_path}/documents.parquet"), read(f"{tmp_path}/labels.parquet"), "quality").collect())
    import pyarrow as pa

    p = model.probabilities(pa.array([d[1] for d in docs]))
    kept = [d for d, x in zip(docs, p) if x > 0 and x >= model.threshold]
    assert {d[0] for d in good} <= {d[0] for d in kept}
    first = {}
    for d in sorted(kept):
        first.setdefault(d[1], d)
    kept = list(first.values())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in brute_pairs([(d[0], d[1]) for d in kept], 2, 0.6):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    kept = [d for d in kept if find(d[0]) == d[0]]
    out = []
    for d in kept:
        w = d[1].split()
        for a, b in reversed(brute_spans(words_of(d[1]), [words_of(item)])):
            del w[a:b]
        text = decontaminate.cut(d[1], brute_spans(words_of(d[1]), [words_of(item)]))
        out.append((d[0], " ".join(w), d[3], text))
    assert any(d[1] != k[1] for d, k in zip(out, kept))
    probability = dict(zip((d[0] for d in out), model.probabilities(pa.array([d[3] for d in out]))))
    want = brute_mix([d[:3] for d in out], None, None, lambda d: probability[d[0]])

    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    rows = got.collect()
    assert Counter((r.doc_id, r.source, len(r.text.split()), r.copies) for r in rows) == want
    texts = {d[0]: d[1] for d in out}
    assert all(r.text.strip() == texts[r.doc_id] and r.n_chars == len(r.text) for r in rows)


def test_pipeline_of_an_empty_table_and_a_clashing_column(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int"
    docs = [(k, f"some text of document {k} " * 9, "en", "s", None, 5) for k in range(6)] + [(0, "some text of document 0 " * 9, "en", "s", None, 5)]
    for name, rows in (("none", []), ("some", docs)):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality long").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d)
        assert got.columns == [*schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "_copies"]
        assert sorted(r.doc_id for r in got.collect()) == ([] if name == "none" else sorted({r.doc_id for r in got.collect()}))


def test_what_queries_leave_behind(spark):
    """After a query its result's tables are there and nothing else, and clear() deletes them."""
    import os

    from routeloom.llm import queries, tables

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        return
    folder = lambda: os.path.dirname(tables.shared(spark, "x"))
    most = {"op7_mixing": {"keys", "cuts"}, "op8_ngram_join": {"classes"}, "op9_decontamination": {"automata"}, "op10_exact_dedup": {"decisions"}}
    for name, query in [*queries.QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
        tables.clear(spark)
        assert query(spark, data).count() > 0
        there = {x.rsplit("-", 1)[0] for x in os.listdir(folder())} if os.path.isdir(folder()) else set()
        assert there <= most.get(name, {"pipeline-mix"} if name == "pipeline" else set()), name
    tables.clear(spark)
    assert os.listdir(folder()) == []


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from routeloom.llm import tables

    spark = SimpleNamespace(conf={"spark.checkpoint.dir": None}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    spark.conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(ValueError):
        tables.shared(spark, "x")
