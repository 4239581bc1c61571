"""Operators on whole tables against brute force, with nulls, ties, repeats, long texts, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routeloom.llm import decontaminate, exact_dedup, mixing, ngram_join, quality, toxicity
from routeloom.llm import textkit as tk
from routeloom.llm.tables import labelled_sample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, part int, spans int, copies int"


def frame(spark, docs):
    """docs: (doc_id, text[, source]); further columns bear names that operators use themselves."""
    return spark.createDataFrame([(d[0], d[1], "en", d[2] if len(d) > 2 else "s", None if d[1] is None else len(d[1]), "x", 1, 2, 3) for d in docs], SCHEMA)


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(60)]
    docs = []
    for t in base:
        docs.append(t)
        for _ in range(rng.randint(0, 3)):
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    docs += [base[0]] * 4 + [base[1].upper() + "!!"] * 2 + ["", "  ", "...", None, None, "one", "one", "one two", " ".join(rng.choices(vocab, k=30000))]
    docs += [docs[-1] + " tail"]
    rng.shuffle(docs)
    out = list(enumerate(docs, 10))
    return out + [out[3], (None, base[0]), (None, base[0])]


# n-gram Jaccard join


def brute_pairs(docs, n, t):
    share = Fraction(str(t))
    sets, by = {}, defaultdict(set)
    for d, text in docs:
        w = tuple(words_of(text))
        if d is not None and w:
            by[w].add(d)
            sets[w] = {w[i : i + n] for i in range(max(1, len(w) - n + 1))}
    out = {(min(ids), d): 1.0 for ids in by.values() for d in ids if d != min(ids)}
    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both >= share * union:
                x, y = sorted((min(by[a]), min(by[b])))
                out[x, y] = both / union
    return out


@pytest.mark.parametrize("n,t", [(2, 0.6), (1, 0.3), (3, 0.8), (2, 1)])
def test_join_against_brute_force(spark, corpus, n, t):
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.similar_pairs(frame(spark, corpus), n, t).collect()}
    want = brute_pairs(corpus, n, t)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_all_pairs_equal_their_sql(spark, corpus):
    import duckdb
    import pandas as pd

    docs = [d for d in corpus if d[1] is None or len(d[1]) < 5000] + [(12, "another text of document twelve"), (900, "another text of document twelve")]
    con = duckdb.connect()
    con.register("d", pd.DataFrame({"doc_id": pd.array([d[0] for d in docs], "Int64"), "text": [d[1] for d in docs]}))
    con.execute("create view documents as select * from d")
    for n, t in ((2, 0.6), (1, 0.3)):
        got = sorted(tuple(r) for r in ngram_join.all_pairs(frame(spark, docs), n, t).collect())
        assert got == sorted(con.sql(ngram_join.oracle_all(n, t)).fetchall()) and len(got) > 100


@pytest.mark.parametrize("common,pack,parts", [(2, 300, 50), (1, 10**6, 10**7), (8, 20, 2000), (10**9, 500, 100)])
def test_common_grams_and_small_packs_change_nothing(spark, corpus, monkeypatch, common, pack, parts):
    """A gram that all documents have, packs and parts of all sizes."""
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "PACK", pack)
    monkeypatch.setattr(ngram_join, "POSTINGS", 2000)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 0 if common == 1 else 1 << 28)
    docs = [(d, f"every one {t}") for d, t in corpus if t and len(t) < 5000]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.similar_pairs(frame(spark, docs), 2, 0.6, parts).collect()}
    want = brute_pairs(docs, 2, 0.6)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("dense", [0, 16, 10**9])
def test_classes_count_every_link_of_every_document(spark, corpus, monkeypatch, dense):
    """Copies and near copies of copies; each pair of documents counts, which pairs by least ids alone don't tell."""
    import duckdb
    import pandas as pd

    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "BITS", 1 << 12)
    monkeypatch.setattr(ngram_join, "GATHERED", 20)
    monkeypatch.setattr(ngram_join, "TOGETHER", 7)
    docs = [d for d in corpus if d[1] is None or len(d[1]) < 5000] + [(12, "another text of document twelve"), (900, "another text of document twelve")]
    con = duckdb.connect()
    con.register("d", pd.DataFrame({"doc_id": pd.array([d[0] for d in docs], "Int64"), "text": [d[1] for d in docs]}))
    con.execute("create view documents as select * from d")
    for n, t in ((2, 0.6), (1, 0.3)):
        got = sorted(tuple(r) for r in ngram_join.classes(frame(spark, docs), n, t).collect())
        assert got == sorted(con.sql(ngram_join.oracle_classes(n, t)).fetchall())
        links = Counter(x for a, b, _ in con.sql(ngram_join.oracle_all(n, t)).fetchall() for x in (a, b))
        assert all(links[d] == k for d, _, k in got if d not in (12, 900)) and sum(links.values()) > 200
    assert ngram_join.classes(frame(spark, docs).limit(0)).count() == 0


def test_a_large_cluster_meets_in_bounded_pieces(monkeypatch):
    """All pairs of 400 contents, held a few at a time and each once for all grams that follow one another."""
    monkeypatch.setattr(ngram_join, "GATHERED", 1000)
    k, p = 400, 20
    x = np.zeros((k, p, 4), np.uint64)
    x[:, :, 0], x[:, :, 1], x[:, 1:, 3] = np.arange(1, p + 1), np.arange(k)[:, None], np.arange(1, p)
    x[:, :, 2] = (100 << 32) + np.arange(p)
    out = list(ngram_join.join_postings(x.reshape(-1, 4), Fraction(3, 5)))
    assert max(map(len, out)) <= 1400 and sum(map(len, out)) == len(np.unique(np.concatenate(out), axis=0)) == k * (k - 1) // 2


def test_a_gram_of_all_documents_fills_no_part():
    g = np.concatenate([np.array([7 << 40, (k + 1) << 43], np.uint64) for k in range(5000)])
    rare, blob, many = ngram_join.pack_common(g, np.repeat(np.arange(5000, dtype=np.uint16), 2), 16)
    assert rare.sum() == 5000 and sum(len(b) for _, b in many) < 20  # one gram and its number
    ids, counts, owners = ngram_join.unpack_common(blob, 16)
    assert ids.tolist() == [7 << 40] and counts.tolist() == [5000] and owners.tolist() == list(range(5000))


def test_the_filter_of_contents_keeps_its_own(spark):
    rng = np.random.default_rng(3)
    some = rng.integers(-(1 << 62), 1 << 62, 3000)
    df = spark.createDataFrame([(int(c), k) for k, c in enumerate(some)], "content long, k int")
    for n in (0, 1000):
        own = df.where(f"k < {n}").select("content")
        kept = {r.k for r in ngram_join.in_candidates(df, own, n).collect()}
        assert set(range(n)) <= kept and len(kept) < n + 200


def test_suffix_filter_never_loses_a_pair():
    rng = np.random.default_rng(6)
    tight = 0
    for _ in range(400):
        pool = rng.integers(0, rng.choice([40, 10**6]), 60).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(0, 50))) for _ in range(2))
        bound, both = ngram_join.suffix_bound(x, y), len(np.intersect1d(x, y))
        assert both <= bound <= min(len(x), len(y))
        tight += bound < min(len(x), len(y))
    assert tight > 100


def test_sizes_follow_the_memory_of_a_core():
    conf = lambda **x: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: x.get(k.rsplit(".", 1)[1], d)))
    assert ngram_join.scale(conf()) == ngram_join.scale(conf(memory="1800m", cores="2")) == 1
    assert ngram_join.scale(conf(memory="36000m", cores="4")) == 10 and ngram_join.scale(conf(memory="900", cores="1")) == 1


def test_join_of_few_or_no_rows(spark, corpus):
    assert ngram_join.similar_pairs(frame(spark, corpus).limit(0)).count() == 0
    assert ngram_join.one_of_each_group(frame(spark, corpus).limit(0)).count() == 0
    assert ngram_join.similar_pairs(frame(spark, [(1, None), (2, ""), (3, "a b c"), (4, "d e f")])).count() == 0
    with pytest.raises(ValueError):
        ngram_join.similar_pairs(frame(spark, corpus), 2, 0)


def test_one_of_each_group_stays(spark, corpus):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in brute_pairs(corpus, 2, 0.6):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    gone = {d for d in root if find(d) != d}
    df = frame(spark, corpus)
    kept = ngram_join.one_of_each_group(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in corpus if d not in gone)
    assert gone


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 105), (105, 103)]
    random.Random(0).shuffle(edges)
    got = {r.doc_id: r.root for r in ngram_join.components(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 103: 100, 105: 100}
    assert ngram_join.components(spark.createDataFrame([], "doc_a long, doc_b long")).count() == 0


def test_packed_grams_come_back():
    rng = np.random.default_rng(3)
    for docs, n in ((1, 0), (5, 3), (2000, 4), (2000, 9000), (3, 70000), (1, 300)):
        g = rng.integers(0, 1 << 40, n).astype(np.uint64)
        owner = np.sort(rng.integers(0, docs, n)).astype(np.uint16)
        level = rng.integers(0, 256, n).astype(np.uint8)
        a, b, c = ngram_join._unpack(ngram_join._pack(g, owner, docs, level), docs, True)
        assert (a == g).all() and (b == owner).all() and (c == level).all()
        full = g | (rng.integers(0, rng.choice([100, 60000, 1 << 20]), n).astype(np.uint64) << np.uint64(40))
        assert (ngram_join.unpack_set(ngram_join.pack_set(full)) == full).all()


def test_levels_grow():
    got = ngram_join.level_of(np.arange(1, 10**6, 7)).astype(int)
    assert (np.diff(got) >= 0).all() and ngram_join.level_of(np.array([1, 2, 200, 201])).tolist() == [1, 2, 200, 201]


def test_scratch_tables_go_unless_kept(spark):
    import os

    from routeloom.llm.tables import scratch, stored

    where = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    with scratch(spark):
        with scratch(spark):
            a, b = (where(stored(spark.range(3), "t", keep=k)) for k in (False, True))
        assert not os.path.exists(a) and os.path.exists(b)
    assert not os.path.exists(b)
    assert os.path.exists(where(stored(spark.range(3), "t")))


# Exact dedup


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 1000, 20000):
        d = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        f = exact_dedup.PerfectHash.build(d)
        assert sorted(f.slots(d).tolist()) == list(range(n))


@pytest.mark.parametrize("share,size", [(0.0, 50_000), (0.5, 50_000), (1.0, 50_000), (0.0, 7), (0.5, 7), (1.0, 7)])
def test_exact_copies_against_brute_force(spark, corpus, monkeypatch, share, size):
    """Also with many shards, of an empty history too."""
    monkeypatch.setattr(exact_dedup, "SHARD", size)
    seen = []
    own = exact_dedup.build_tables
    monkeypatch.setattr(exact_dedup, "build_tables", lambda d, shards: (seen.append(shards), own(d, shards))[1])
    docs = [d for d in corpus]
    ids = sorted(d for d, _ in docs if d is not None)
    cut = ids[min(len(ids) - 1, int(share * len(ids)))] if share < 1 else 10**9
    old, new = [d for d in docs if d[0] is not None and d[0] < cut], [d for d in docs if d[0] is None or d[0] >= cut]
    winner = {}
    for d, t in sorted((d, t) for d, t in docs if d is not None and t is not None):
        winner.setdefault(t, d)
    got = Counter((r.doc_id, r.winner_id) for r in exact_dedup.decisions(frame(spark, new) if new else frame(spark, docs).limit(0), frame(spark, old) if old else frame(spark, docs).limit(0)).collect())
    assert got == Counter({(d, winner[t]) for d, t in docs if d is not None and t is not None})
    assert (seen[0] > 10) == (size == 7)


def test_a_historical_winner_beats_a_smaller_new_id(spark):
    got = {(r.doc_id, r.winner_id) for r in exact_dedup.decisions(frame(spark, [(1, "a"), (2, "b"), (3, "b")]), frame(spark, [(9, "a"), (8, "a")])).collect()}
    assert got == {(1, 8), (8, 8), (9, 8), (2, 2), (3, 2)}


def test_exact_copies_of_one_table(spark, corpus):
    """Both halves of the ids together: every text's winner is its least id."""
    first = {}
    for d, t in sorted((d, t) for d, t in corpus if d is not None and t is not None):
        first.setdefault(t, d)
    got = Counter((r.doc_id, r.winner_id, r.is_copy) for r in exact_dedup.exact_copies(frame(spark, corpus)).collect())
    assert got == Counter({(d, first[t], d != first[t]) for d, t in corpus if d is not None and t is not None})
    assert exact_dedup.exact_copies(frame(spark, corpus).limit(0)).count() == 0


def test_without_copies(spark, corpus):
    df = frame(spark, corpus)
    kept = exact_dedup.without_copies(df)
    first = {}
    for d, t in sorted((d, t) for d, t in corpus if d is not None and t is not None):
        first.setdefault(t, d)
    want = Counter({d: 1 for d in first.values()}) + Counter(d for d, t in corpus if d is None or t is None)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == want
    assert exact_dedup.without_copies(df.limit(0)).count() == 0


# Decontamination


def brute_spans(words, items):
    covered = set()
    for item in items:
        need = decontaminate.needed(len(item))
        for size in range(need, len(item) + 1):
            for a in range(len(item) - size + 1):
                for k in range(len(words) - size + 1):
                    if words[k : k + size] == item[a : a + size]:
                        covered |= set(range(k, k + size))
    out = []
    for k in sorted(covered):
        if out and out[-1][1] == k:
            out[-1] = (out[-1][0], k + 1)
        else:
            out.append((k, k + 1))
    return out


def test_automaton_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        alphabet = rng.choice(["ab", "abcd", "abcdefghij"])
        items = [rng.choices(alphabet, k=rng.randint(1, 22)) for _ in range(rng.randint(1, 4))]
        words = rng.choices(alphabet + "z", k=20)
        for _ in range(2):
            item = rng.choice(items)
            a = rng.randrange(len(item))
            words += item[a : a + rng.randint(1, 22)] + rng.choices(alphabet + "z", k=rng.randint(0, 4))
        code = {c: k for k, c in enumerate(sorted({*alphabet, "z"}))}
        machine = decontaminate.Automaton()
        for item in items:
            need = decontaminate.needed(len(item))
            if need <= len(item):
                machine.add([code[c] for c in item], need)
        got = decontaminate.merged(machine.finish().spans(np.array([code[c] for c in words], np.uint64)))
        assert got == brute_spans(words, items)


def test_needed_tokens():
    assert [decontaminate.needed(n) for n in (3, 5, 6, 10, 15, 16, 17, 100)] == [5, 5, 5, 8, 12, 13, 13, 13]


ITEM = "The quick, brown fox jumps over the lazy dog and runs far away from here, again and again."


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "too short", "x"), (1, ITEM, "x"), (None, "six tokens make a short item", "x")], "item_id long, text string, spans string")


def test_contamination_cuts_spans_only(spark, benchmark):
    docs = [(1, f"Before. {ITEM} After."), (2, ITEM.upper().replace(" ", "!! ")), (3, "clean text, the quick brown fox jumps over"), (4, None), (5, ""), (None, "a six TOKENS make a short b"), (6, "x " * 50000 + ITEM + " y"), (1, f"Before. {ITEM} After.")]
    got = [(r.doc_id, r.contaminated, r.n_spans, r.removed_tokens, r.text) for r in decontaminate.contamination(frame(spark, docs), benchmark).collect()]
    assert got[0] == (1, True, 1, 18, "Before. After.") == got[7]
    assert got[1][1:] == (True, 1, 18, "")
    assert [g[1] for g in got] == [True, True, False, False, False, True, True, True]
    assert got[2][4] == docs[2][1] and got[3][4] is None and got[4][4] == ""
    assert got[5][4] == "a b" and got[6][4] == "x " * 50000 + "y"


def test_decontaminated_documents(spark, benchmark):
    df = frame(spark, [(1, f"Before. {ITEM} After."), (2, ITEM), (3, "clean"), (4, None), (5, "")])
    got = decontaminate.decontaminated(df, benchmark)
    assert got.schema == df.schema
    assert [(r.doc_id, r.text, r.n_chars) for r in got.collect()] == [(1, "Before. After.", 14), (3, "clean", 5), (4, None, None), (5, "", 0)]
    assert decontaminate.decontaminated(df.limit(0), benchmark).count() == 0
    assert decontaminate.decontaminated(df, benchmark.limit(0)).count() == 5


def test_many_automata_find_the_same(spark, benchmark, monkeypatch):
    """15 automata in several files give what one gives, null ids spread over them, and each is read once for a group of slices."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    items = [" ".join(rng.choices(vocab, k=rng.randint(5, 60))) for _ in range(120)]
    bench = spark.createDataFrame([(None if k % 2 else k, t) for k, t in enumerate(items * 2)], "item_id long, text string")
    docs = []
    for k in range(150):
        w = rng.choices(vocab, k=rng.randint(1, 80))
        if k % 3 == 0:
            own = rng.choice(items).split()
            a = rng.randrange(len(own))
            w[5:5] = own[a : a + rng.randint(1, 40)]
        docs.append((k, " ".join(w)))
    df = frame(spark, docs)
    one = sorted(decontaminate.contamination(df, bench).collect())
    assert [(r.doc_id, r.n_spans, r.removed_tokens) for r in one] == [(k, len(x), sum(b - a for a, b in x)) for k, t in docs for x in [brute_spans(t.split(), [i.split() for i in items])]]
    assert any(r.contaminated for r in one) and not all(r.contaminated for r in one)
    monkeypatch.setattr(decontaminate, "ITEM_TOKENS", 270)
    machines = decontaminate.stored(decontaminate.automata(bench).repartition(4), "machines").repartition(4)
    assert machines.count() >= 13
    monkeypatch.setattr(decontaminate, "automata", lambda *a: machines)
    assert sorted(decontaminate.contamination(df, bench).collect()) == one
    files = sorted(decontaminate.stored(machines, "automata").inputFiles())
    assert len(files) >= 3
    for kept, again in ((0, 4), (1 << 30, 0)):
        monkeypatch.setattr(decontaminate, "KEPT", kept)
        read = Counter()
        matchers = decontaminate.Matchers(files, lambda f: (read.update([f]), decontaminate.read_stored(f))[1])
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in docs])], ["text"])
        monkeypatch.setattr(decontaminate, "GROUP", 1 << 30)
        (group,) = decontaminate.grouped(iter([batch.slice(0, 50), batch.slice(50)]))
        for _ in range(2):
            found = decontaminate.found_in(group, matchers)
        assert [len(x) for f in found for _, x in sorted(f.items())] == [r.n_spans for r in one if r.contaminated]
        assert sum(read.values()) == len(files) + min(again, len(files))


def test_benchmarks_of_no_or_short_items(spark):
    df = frame(spark, [(1, "a b c d e f g"), (2, None)])
    for items in ([(1, "a b"), (None, None)], [(1, "")]):
        got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert [(r.doc_id, r.contaminated, r.text) for r in got] == [(1, False, "a b c d e f g"), (2, False, None)]


# Mixing


def brute_mix(docs, targets, total, weigh=lambda d: 1.0):
    """weigh: a document's weight, as it comes."""
    import hashlib

    by = defaultdict(list)
    for doc in docs:
        d, text, source = doc[:3]
        weight = weigh(doc)
        weight = mixing.LEAST_WEIGHT if weight is None or weight != weight else max(mixing.LEAST_WEIGHT, weight)
        u = (int(hashlib.md5(f"{mixing.SEED}/{d or 0}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        by[source or ""].append((-math.log(u) / weight, d or 0, len((text or "").split()), d))
    shares = {s: 1.0 if targets is None else targets.get(s, 0.0) for s in by}
    total = sum(n for rows in by.values() for _, _, n, _ in rows) if total is None else total
    out = Counter()
    for s, rows in by.items():
        has, budget = sum(r[2] for r in rows), math.floor(shares[s] * float(total) / (sum(shares.values()) or 1.0))
        epochs = budget // has if has else 0
        left = budget - epochs * has
        for key, ident, n, d in rows:
            upto = sum(r[2] for r in rows if r[:2] <= (key, ident))
            copies = epochs + (left > 0 and upto <= left)
            if copies:
                out[d, s, n, copies] += 1
    return out


def weights_of(docs):
    rng = random.Random(8)
    return {d[0]: rng.choice([None, float("nan"), -1.0, 0.0, 0.3, 0.9, 1.0, 40.0]) for d in docs}


@pytest.mark.parametrize("targets,total", [(None, None), ({"a": 3.0, "b": 1.0}, None), ({"a": 1.0}, 100000), ({"b": 2.0, "": 1.0}, 37), ({"none": 1.0}, None)])
def test_mixing_against_brute_force(spark, targets, total):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    docs = [(k, " ".join(rng.choices(["word", "x%%%", "$$", "y"], k=rng.randint(0, 40))), rng.choice("aaab")) for k in range(300)]
    docs += [(500, None, "a"), (501, "", None), (None, "no id", "b"), (None, "no id", "b"), docs[7], (502, "w " * 40000, "c"), (503, None, "empty"), (504, "", "empty")]
    weight = weights_of(docs)
    df = spark.createDataFrame([(d, t, "en", s, 0, "x", 1, 2, 3, weight[d]) for d, t, s in docs], SCHEMA + ", weight double")
    want = brute_mix(docs, targets, total, lambda d: weight[d[0]])
    assert Counter(tuple(r) for r in mixing.selection(df, targets, total, weight=F.col("weight")).collect()) == want
    mixed = mixing.mixed(df, targets, total, weight=F.col("weight"))
    assert mixed.columns == [*df.columns, "_copies"]
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id, r.source or "", len((r.text or "").split()), r["_copies"]] += 1
    assert got == want


def test_tokens_are_counted_without_a_list_of_them(spark):
    texts = [None, "", " ", "a", " a", "a ", "\x0b\f\r\n\ta  b\x1cc \u00a0 d\u2003e\r\n", "x " * 5000, "ä\tö"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", mixing.n_tokens(F.col("text")).alias("n"))
    assert [r.n for r in got.orderBy("k").collect()] == [len(re.findall(r"\S+", t or "", re.ASCII)) for t in texts]
    assert "regexp_extract_all" not in got._jdf.queryExecution().toString()


def test_mixing_an_empty_table(spark):
    from pyspark.sql import functions as F

    empty = frame(spark, [(1, "a")]).limit(0)
    assert mixing.selection(empty).count() == 0
    mixed = mixing.mixed(empty, weight=F.col("n_chars"))
    assert mixed.count() == 0 and mixed.columns == [*empty.columns, "_copies"]


def test_mixing_by_labels_equals_its_sql(spark):
    """Labels of all kinds, copies of labelled documents, sources without labels: the same rows as the SQL gives."""
    import duckdb
    import pandas as pd

    rng = random.Random(4)
    docs = [(k, "w " * rng.randint(0, 30), rng.choice("aabc")) for k in range(200)] + [(None, "x y", "a"), (3, "again", "b"), (201, None, None)]
    labels = [(k, rng.randint(0, 1)) for k in range(90)] + [(5, 1), (5, 0), (None, 1), (7, None), (999, 1), (8, 3)]
    got = mixing.selection(frame(spark, docs), labels=spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    con = duckdb.connect()
    con.register("d", pd.DataFrame({"doc_id": pd.array([d[0] for d in docs], "Int64"), "text": [d[1] for d in docs], "source": [d[2] for d in docs]}))
    con.register("l", pd.DataFrame({"doc_id": pd.array([x[0] for x in labels], "Int64"), "quality": pd.array([x[1] for x in labels], "Int64")}))
    con.execute("create view documents as select * from d")
    con.execute("create view labels as select * from l")
    assert Counter(tuple(r) for r in got) == Counter(con.sql(mixing.oracle()).fetchall())


def test_better_documents_are_taken_more_often(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, [(k, "good words here now", "a") for k in range(4000)])
    taken = [r.doc_id % 2 for r in mixing.selection(docs, {"a": 1.0}, 4000, weight=0.1 + 0.9 * (F.col("doc_id") % 2)).collect()]
    assert sum(taken) > 3 * (len(taken) - sum(taken))


# Classifiers


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    out = []
    for k in range(n):
        w = rng.choices(vocab, k=rng.randint(5, 120))
        y = k % 3 == 0
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "awful"]))
        out.append((k + seed * 10**6, " ".join(w), rng.choice(["en", "de"]), int(y)))
    return out


def labels_of(spark, docs, name):
    return spark.createDataFrame([(d[0], d[3], "z") for d in docs], f"doc_id long, {name} long, text string")


def test_toxicity_on_held_out_documents(spark):
    train, held = toxic_corpus(900, 1), toxic_corpus(400, 2)
    edges = [(1, None, "en", 0), (2, "", "en", 0), (3, "clean " * 50000, None, 0), (None, "vile nasty awful", "xx", 1), (3, "vile", "en", 1)]
    docs = spark.createDataFrame([(*d[:3], 1) for d in train + held + edges], "doc_id long, text string, lang string, score int")
    got = toxicity.toxicity(docs, labels_of(spark, train, "toxic")).collect()
    assert len(got) == len(train + held + edges)
    by = {r.doc_id: r for r in got}
    right = sum(by[d[0]].toxic == bool(d[3]) for d in held)
    assert right / len(held) > 0.97
    assert by[1].score == by[2].score == 0 and not by[1].toxic and by[None].toxic
    none = toxicity.toxicity(docs, labels_of(spark, train, "toxic").limit(0)).collect()
    assert all(r.score == 0 and not r.toxic for r in none if r.doc_id in (1, 2)) and not any(r.toxic for r in none)
    assert toxicity.toxicity(docs.limit(0), labels_of(spark, train, "toxic")).count() == 0


def test_toxic_words_of_a_small_sample():
    sample = [SimpleNamespace(doc_id=k, text=f"first{k} second{k * 7 % 31} third{k}" + " vile" * (k % 10 == 0), lang="en", y=int(k % 10 == 0)) for k in range(80)]
    m = toxicity.fit(sample)
    p = toxicity.sigmoid(m.logits(tk.tokens(pa.array(["some words here", "some vile words"])), m.lookup(), m.tables()))
    assert len(m.known) == len({w for r in sample for w in r.text.split()})  # every word is embedded
    assert p[0] < m.threshold <= p[1]
    alone = toxicity.fit(sample[:10])  # one toxic document: no cross-fitting
    assert alone.threshold == 0.5 and not alone.thresholds
    for y in (0, 1):
        none = toxicity.fit([SimpleNamespace(doc_id=k, text="vile words", lang="en", y=y) for k in range(5)])
        assert not none.fitted and (none.logits(tk.tokens(pa.array(["vile", ""])), none.lookup(), none.tables()) == -np.inf).all()


def test_thresholds_of_languages():
    """Against a brute-force search, and drawn towards the common one."""
    rng = np.random.default_rng(7)
    for _ in range(50):
        s, y = rng.random(30).round(2), rng.integers(0, 2, 30)
        if not 0 < y.sum() < 30:
            continue
        f1 = lambda t: 2 * y[s >= t].sum() / ((s >= t).sum() + y.sum())
        t = toxicity.best_threshold(s, y)
        assert f1(t) == max(f1(x) for x in s)
    m = SimpleNamespace(thresholds={}, threshold=0.0)
    z, lang, y = np.array([-9.0, -8, 8, 9] * 50 + [-9, -8, -2, -1]), np.array(["en"] * 200 + ["de"] * 4), np.array([0, 0, 1, 1] * 50 + [0, 0, 1, 1])
    toxicity.calibrated(m, z, y, lang)
    assert 0.0001 < m.thresholds["de"] < m.thresholds["en"] and abs(m.threshold - m.thresholds["en"]) < 0.5
    toxicity.calibrated(m, z, y, np.where(y > 0, "xx", lang))  # a language without clean documents
    assert "xx" not in m.thresholds


def test_near_copies_of_a_sample_against_brute_force():
    rng = random.Random(5)
    texts = []
    for _ in range(120):
        w = (rng.choice(texts) if texts and rng.random() < 0.6 else " ".join(rng.choices("abcdefghij", k=rng.randint(0, 12)))).split()
        if w and rng.random() < 0.5:
            w[rng.randrange(len(w))] = "z"
        texts.append(" ".join(w))
    hashes = tk.tokens(pa.array(texts)).each()
    keys, want = [], []
    for h in hashes:
        g = [int(x) for x in tk.ngrams(h, 3)]
        own = (min(g), min(int(tk.mix(np.array([x ^ toxicity.SEED], np.uint64))[0]) for x in g)) if g else None
        want.append(own is None or not any(own[0] == k[0] or own[1] == k[1] for k in keys))
        if own:
            keys.append(own)
    assert toxicity.without_near_copies(hashes).tolist() == want and not all(want)


def test_every_language_is_calibrated_on_held_out_documents():
    rng = random.Random(3)
    own = {"en": ["vile", "awful"], "de": ["übel", "mies"], "fr": ["vilain", "nul"]}
    def made(n, first):
        out = []
        for k in range(n):
            lang = ("en", "en", "en", "de", "fr")[k % 5]
            y = int(rng.random() < 0.2)
            w = [f"{lang}{rng.randrange(2000)}" for _ in range(rng.randint(5, 80))] + rng.choices(own[lang], k=2 * y)
            rng.shuffle(w)
            out.append(SimpleNamespace(doc_id=first + k, text=" ".join(w), lang=lang, y=y))
        return out
    train, held = made(800, 0), made(500, 1000)
    m = toxicity.fit(train)
    p = toxicity.sigmoid(m.logits(tk.tokens(pa.array([r.text for r in held])), m.lookup(), m.tables()))
    for lang in own:
        of = [(x >= m.thresholds[lang], r.y) for x, r in zip(p, held) if r.lang == lang]
        assert sum(h for h, y in of if y) >= 0.9 * sum(y for _, y in of)
        assert sum(h for h, y in of if not y) <= 0.05 * sum(1 - y for _, y in of)


def test_training_lowers_the_loss():
    """The loss falls, and leaving a document out of its own words' evidence is what is trained on."""
    docs = [(np.array([k, 100 + k % 3, 7 if k % 2 else 8]), k % 2) for k in range(60)]
    before, after = (toxicity.train(docs, epochs=n) for n in (1, 6))
    loss = lambda m: -np.mean([np.log(np.clip(q if y else 1 - q, 1e-9, 1)) for (d, y), q in ((x, toxicity.sigmoid(m.logits(tk.Tokens(x[0].astype(np.uint64) << np.uint64(64 - toxicity.BITS), np.array([0, len(x[0])])), m.lookup(), m.tables()))[0]) for x in docs)])
    assert loss(after) < loss(before) < 1
    single = toxicity.evidence(np.array([0.0]), np.array([1.0]) - 1, 0.5)
    assert single[0] == 0


def test_long_texts_are_scored_to_their_end():
    sample = [SimpleNamespace(doc_id=k, text=f"first{k} second{k * 7 % 31}" + " vile" * (k % 4 == 0), lang="en", y=int(k % 4 == 0)) for k in range(80)]
    m = toxicity.fit(sample)
    long = "w " * (toxicity.PIECE + 5)
    z = m.logits(tk.tokens(pa.array([long + "vile"])), m.lookup(), m.tables())
    short = m.logits(tk.tokens(pa.array(["w w w vile", "x"])), m.lookup(), m.tables())
    assert z[0] == short[0]
    for limit in (5, 64, 1 << 20):
        words = tk.tokens(pa.array(["ab cd", "", "x" * 100 + " y", "éa-b" * 9]), limit)
        assert (words.hashes == tk.tokens(pa.array(["ab cd", "", "x" * 100 + " y", "éa-b" * 9])).hashes).all() and words.rows.tolist() == [0, 2, 2, 4, 14]


def test_toxicity_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(0)
    col = pa.array([t for _, t, _, _ in toxic_corpus(20, 3)] + ["", None, "one"])
    words = tk.tokens(col)
    known = np.unique(toxicity.buckets(words.hashes))[::2]
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    m = toxicity.Model(known, rng.normal(size=(len(known) + 1, toxicity.DIM)), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], rng.normal(size=n), rng.normal(size=n), 0.3)
    m.embeddings[-1] = 0
    got = m.logits(words, m.lookup(), m.tables())
    row = {b: k for k, b in enumerate(known.tolist())}
    for r in range(len(col)):
        ids = [row.get(b, len(known)) for b in toxicity.buckets(words.row(r)).tolist()]
        if not ids:
            assert got[r] == -np.inf
            continue
        x = m.embeddings[ids + [len(known)] * 2]
        top = np.concatenate([np.max([sum(x[k + j] @ w[j] for j in range(len(w))) for k in range(len(ids))], axis=0) for w in m.filters])
        assert abs(got[r] - (np.maximum(top + m.biases, 0) @ m.weights + m.bias)) < 1e-3


def quality_corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = ["".join(rng.choices("aeioubcdst", k=rng.randint(2, 9))) for _ in range(rng.randint(4, 150))]
        good = k % 2
        out.append((k + seed * 10**6, " ".join(w if good else [x + rng.choice(["%%%", "$$$", "&&&"]) for x in w]), "en", good))
    return out


def test_quality_on_held_out_documents(spark):
    train, held = quality_corpus(400, 1), quality_corpus(300, 2)
    edges = [(1, None, None, 0), (2, "", "en", 0), (3, "ab " * 50000, "en", 1), (None, "some good words", "en", 1)]
    docs = spark.createDataFrame([(*d[:3], 1.0) for d in train + held + edges], "doc_id long, text string, lang string, quality double")
    labels = labels_of(spark, train, "quality")
    by = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert sum(by[d[0]].good == bool(d[3]) for d in held) / len(held) > 0.98
    assert not by[1].good and by[2].quality == 0 and by[3].good
    kept = quality.good_documents(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {d for d, r in by.items() if r.good}
    assert {r.doc_id for r in quality.quality(docs, labels.limit(0)).where("not good").collect()} == {1, 2}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_quality_features_equal_plain_chunks():
    rng = np.random.default_rng(1)
    m = quality.Model(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=2 * quality.FILTERS), 0.1)
    texts = ["x", "short text", "a" * 256, "b" * 257, "ü" * 300, "".join(chr(97 + k % 26) for k in range(1500)), "end"]
    raw, off = tk.buffers(pa.array(texts))
    got = m.features(raw, off)
    long = np.frombuffer(b"".join(bytes([97 + k * k % 26]) for k in range(3 * quality.BLOCK + 100)), np.uint8)
    assert np.allclose(m.features_of_one(long), m.features(long, np.array([0, len(long)])), atol=1e-4)
    for r, t in enumerate(texts):
        data = np.frombuffer(t.encode() + b"\0" * (quality.WIDTH - 1), np.uint8)
        z = np.maximum(m.values(data) + m.biases, 0)
        chunks = [z[a : a + 2 * quality.HOP].max(axis=0) for a in range(0, len(z), quality.HOP) if a == 0 or a + quality.HOP < len(z)]
        assert np.allclose(got[r], np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]), atol=1e-4)


def test_quality_threshold_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        p, y = rng.random(25).round(2), rng.integers(0, 2, 25)
        if 0 < y.sum() < 25:
            cost = lambda t: quality.GOOD_WEIGHT * (p[y == 1] < t).mean() + (p[y == 0] >= t).mean()
            assert cost(quality.best_threshold(p, y)) <= min(cost(t) for t in [*p, 1.0]) + 1e-9
    assert quality.best_threshold(np.array([0.9, 0.8]), np.array([1, 1])) == 0.5
    assert quality.best_threshold(np.array([0.9, 0.8, 0.6]), np.array([1, 1, 0])) > 0.6


def test_long_texts_of_a_sample_give_windows_from_start_to_end(spark):
    from routeloom.llm.tables import windows
    from pyspark.sql import functions as F

    text = "".join(f"{k:05d}" for k in range(20000))
    got = spark.createDataFrame([(text,), ("short",), ("",)], "t string").select(windows(F.col("t"), 800).alias("w")).collect()
    parts = got[0].w.split(" ")
    assert [r.w for r in got[1:]] == ["short", ""] and len(parts) == 8 and {len(x) for x in parts} == {100} and all(x in text for x in parts)
    assert text.startswith(parts[0]) and text.endswith(parts[-1])


def test_sample_is_bounded_and_balanced(spark):
    docs = frame(spark, [(k, f"t{k}") for k in range(100)] + [(5, "t5"), (None, "x")])
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(100)] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 30).collect()
    assert Counter(r.y for r in got) == {0: 15, 1: 15} and len({r.doc_id for r in got}) == 30
