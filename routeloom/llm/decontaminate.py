"""Operator 9: benchmark decontamination with a generalised suffix automaton.

The automaton holds all substrings (of normalised tokens) of all test items.  A
document's tokens stream through it; at each token it knows the longest match
that ends there, and each state knows the least match length that one of its
items forbids.  A match is forbidden if it has at least LENGTH tokens, or covers
at least COVER of an item (and has at least LEAST tokens).  Forbidden spans are
removed from the text, each with the separators that follow it.

Only tokens whose grams (of as many tokens as the least limit) are those of an item
are streamed: a forbidden span consists of such grams, and a lookup of hashed grams
finds them for whole slices at once.

Distinct items are packed into automata of some ITEM_TOKENS tokens, built by one
task each and stored as arrays in the shared folder; their number follows the
benchmark, and the memory of a task doesn't: it keeps up to KEPT bytes of them, and
reads the others one after the other, once for each GROUP bytes of documents.

Defined cases: documents with null or empty text stay as they are; very long ones
are streamed to their end.  Items with a null text or fewer than LEAST tokens are
ignored, repeated ones (with whatever ids, null ones too) change nothing; repeated
documents are repeated in the result.  Spans that overlap or touch are one; a match
exactly as long as the limit is removed.  A null doc_id is kept.  Other columns, whatever
their names, pass through in the filtered table.  Empty tables are allowed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tables import fresh, stored

LENGTH, COVER, LEAST = 13, 0.8, 5
#: Tokens of an automaton; bytes of automata that a task keeps; bytes of documents for which it reads the others once.
ITEM_TOKENS, KEPT, GROUP = 200_000, 64 << 20, 16 << 20
_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}]+")


FAR = 1 << 30


def needed(n: int, length: int = LENGTH, cover: float = COVER, least: int = LEAST) -> int:
    """Tokens of an item of n tokens that a span may not have; more than n if the item is ignored."""
    return max(least, min(length, -int(-round(cover * n, 6) // 1)))


class Automaton:
    """Suffix automaton of several token sequences, to be built; Matcher streams through it."""

    def __init__(self) -> None:
        self.items: list[tuple[list[int], int]] = []
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.need = [FAR]

    def _state(self, length: int, link: int, go: dict[int, int]) -> int:
        self.next.append(go)
        self.link.append(link)
        self.len.append(length)
        self.need.append(FAR)
        return len(self.len) - 1

    def _clone(self, p: int, token: int, q: int) -> int:
        c = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, token, q)
        new = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, token, q)
        return new

    def add(self, item: list[int], need: int) -> None:
        self.items.append((item, need))
        at = 0
        for token in item:
            at = self._extend(at, token)
            self.need[at] = min(self.need[at], need)

    def finish(self) -> Matcher:
        """Spreads each item's limit to all states of its substrings; shorter[v] is the longest forbidden proper suffix class of v, or 0."""
        order = sorted(range(1, len(self.len)), key=lambda v: -self.len[v])
        for v in order:
            p = self.link[v]
            self.need[p] = min(self.need[p], self.need[v])
        self.need[0] = FAR
        shorter = [0] * len(self.len)
        for v in reversed(order):
            p = self.link[v]
            shorter[v] = self.len[p] if self.len[p] >= self.need[p] else shorter[p]
        least = min((need for _, need in self.items), default=1)
        grams = [gram_hashes(np.array(item, np.uint64), least) for item, _ in self.items]
        go = [sorted(x.items()) for x in self.next]
        arrays = {
            "first": np.cumsum([0, *map(len, go)], dtype=np.int32), "tokens": np.array([t for x in go for t, _ in x], np.uint64), "to": np.array([q for x in go for _, q in x], np.int32),
            "link": np.array(self.link, np.int32), "size": np.array(self.len, np.int32), "need": np.minimum(self.need, FAR).astype(np.int32), "shorter": np.array(shorter, np.int32),
            "grams": np.unique(np.concatenate([np.zeros(0, np.uint64), *grams])), "least": np.array([least], np.int32),
        }
        return Matcher(arrays)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    return tk.ngrams(words, n) if len(words) >= n else np.zeros(0, np.uint64)


class Matcher:
    """A finished automaton in flat arrays: a state's transitions lie together, sorted by token."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.nbytes = sum(a.nbytes for a in arrays.values())
        self.grams, self.least = arrays["grams"], int(arrays["least"][0])
        self.first, self.tokens, self.to, self.link, self.size, self.need, self.shorter = (memoryview(arrays[k]) for k in FIELDS[:7])

    @classmethod
    def read(cls, row: dict[str, bytes]) -> Matcher:
        return cls({k: np.frombuffer(row[k], t) for k, t in zip(FIELDS, TYPES)})

    def row(self) -> dict[str, bytes]:
        return {k: a.tobytes() for k, a in self.arrays.items()}

    def find(self, words: tk.Tokens, out: dict[int, list[tuple[int, int]]]) -> None:
        """Adds to each row's list its forbidden token spans [from, to)."""
        n = self.least
        h, ends = words.hashes, words.rows
        if len(h) < n or not len(self.grams):
            return
        g = gram_hashes(h, n)
        at = np.searchsorted(self.grams, g)
        at[at == len(self.grams)] = 0
        hit = np.flatnonzero(self.grams[at] == g)
        row = np.searchsorted(ends, hit, "right") - 1
        inside = hit + n <= ends[row + 1]
        hit, row = hit[inside], row[inside]
        if not len(hit):
            return
        begin = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1])))
        for a, b in zip(begin, np.append(begin[1:], len(hit))):
            r, lo, hi = int(row[a]), int(hit[a]), int(hit[b - 1]) + n
            found: list[tuple[int, int]] = []
            self._stream(h[lo:hi].tolist(), lo - int(ends[r]), found)
            if found:
                out.setdefault(r, []).extend(found)

    def spans(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Forbidden spans of one row."""
        out: dict[int, list[tuple[int, int]]] = {}
        self.find(tk.Tokens(words, np.array([0, len(words)])), out)
        return out.get(0, [])

    def _go(self, state: int, token: int) -> int:
        end = self.first[state + 1]
        k = bisect_left(self.tokens, token, self.first[state], end)
        return self.to[k] if k < end and self.tokens[k] == token else -1

    def _stream(self, tokens: list[int], base: int, out: list[tuple[int, int]]) -> None:
        state = run = 0
        for i, token in enumerate(tokens, base + 1):
            go = self._go(state, token)
            while go < 0 and state > 0:
                state = self.link[state]
                run = self.size[state]
                go = self._go(state, token)
            if go < 0:
                state = run = 0
                continue
            state = go
            run += 1
            hit = run if run >= self.need[state] else self.shorter[state]
            if hit:
                lo = i - hit
                while out and out[-1][1] >= lo:
                    lo = min(lo, out.pop()[0])
                out.append((lo, i))


FIELDS = ("first", "tokens", "to", "link", "size", "need", "shorter", "grams", "least")
TYPES = (np.int32, np.uint64, np.int32, np.int32, np.int32, np.int32, np.int32, np.uint64, np.int32)


def automata(benchmark: DataFrame, length: int = LENGTH, cover: float = COVER, least: int = LEAST) -> DataFrame:
    """One row of arrays for each automaton of the benchmark's distinct texts."""
    words = F.greatest(F.lit(1), F.size(F.split("text", r"\s+")))
    items = benchmark.where("text is not null").select("text").distinct()
    shards = max(1, -(-(items.agg(F.sum(words)).first()[0] or 0) // ITEM_TOKENS))

    def build(t: pa.Table) -> pa.Table:
        a = Automaton()
        for batch in t.select(["text"]).to_batches():
            w = tk.tokens(batch.column("text"))
            for r in range(batch.num_rows):
                item = w.row(r).tolist()
                need = needed(len(item), length, cover, least)
                if need <= len(item):
                    a.add(item, need)
        return pa.table({k: pa.array([v], pa.binary()) for k, v in a.finish().row().items()})

    return items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, ", ".join(f"{k} binary" for k in FIELDS))


def read_stored(file: str) -> Iterator[Matcher]:
    """The automata of a stored file, one after the other."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, path = pafs.FileSystem.from_uri(file)
    with pq.ParquetFile(path, filesystem=fs) as stored_file:
        for batch in stored_file.iter_batches(1, columns=list(FIELDS)):
            yield Matcher.read(batch.to_pylist()[0])


class Matchers:
    """Iterates over the automata of all files, again and again; keeps those of the first files while they fit into KEPT bytes."""

    def __init__(self, files: list[str], read: Callable[[str], Iterable[Matcher]] = read_stored):
        self.files, self.read, self.kept, self.room, self.at = files, read, [], KEPT, 0

    def __iter__(self) -> Iterator[Matcher]:
        yield from self.kept
        for k in range(self.at, len(self.files)):
            own: list[Matcher] | None = []
            for m in self.read(self.files[k]):
                if own is not None:
                    own = [*own, m] if sum(x.nbytes for x in own) + m.nbytes <= self.room else None
                yield m
            if own is not None and k == self.at:
                self.kept += own
                self.room -= sum(x.nbytes for x in own)
                self.at += 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the token spans, from a span's first token to the next token behind it."""
    starts = [m.start() for m in _TOKEN.finditer(text)] + [len(text)]
    at, parts = 0, []
    for lo, hi in spans:
        parts.append(text[at : starts[lo]])
        at = starts[hi]
    return "".join(parts) + text[at:]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of some GROUP bytes together."""
    group: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for s in tk.slices(batch, "text"):
            group.append(s)
            size += pc.sum(pc.binary_length(s.column("text"))).as_py() or 0
            if size > GROUP:
                yield group
                group, size = [], 0
    if group:
        yield group


def found_in(group: list[pa.RecordBatch], matchers: Iterable[Matcher]) -> list[dict[int, list[tuple[int, int]]]]:
    """For each slice the rows with forbidden spans, merged: automata outside, slices inside."""
    words = [tk.tokens(s.column("text")) for s in group]
    out: list[dict[int, list[tuple[int, int]]]] = [{} for _ in group]
    for m in matchers:
        for w, spans in zip(words, out):
            m.find(w, spans)
    return [{r: merged(x) for r, x in spans.items()} for spans in out]


def cleaned(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, cover: float = COVER, least: int = LEAST) -> tuple[DataFrame, str, str]:
    """docs with cut texts and two more columns (counts of spans and of removed tokens), and those columns' names."""
    files = stored(automata(benchmark, length, cover, least), "automata").inputFiles()
    n_spans, n_removed = fresh(docs, "spans"), fresh(docs, "removed")
    schema = f"`{n_spans}` int, `{n_removed}` int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = Matchers(files)
        for group in grouped(batches):
            for s, spans in zip(group, found_in(group, matchers)):
                column = s.column("text")
                counts = np.zeros((2, s.num_rows), np.int32)
                texts = [None] * s.num_rows
                for r, x in spans.items():
                    counts[:, r] = len(x), sum(b - a for a, b in x)
                    texts[r] = cut(column[r].as_py(), x)
                if spans:
                    column = pc.if_else(pa.array(counts[0] > 0), pa.array(texts, column.type), column)
                arrays = [pa.array(counts[0]), pa.array(counts[1]), *(column if n == "text" else s.column(n) for n in s.schema.names)]
                yield pa.RecordBatch.from_arrays(arrays, [n_spans, n_removed, *s.schema.names])

    return docs.mapInArrow(stream, schema), n_spans, n_removed


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_spans, removed_tokens, text) for every document; text is the cleaned one."""
    out, spans, removed = cleaned(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", (F.col(spans) > 0).alias("contaminated"), F.col(spans).alias("n_spans"), F.col(removed).alias("removed_tokens"), "text")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with cleaned texts and, for those, n_chars; a document of which no token is left goes."""
    kept, spans, _ = cleaned(docs, benchmark)
    kept = kept.where((F.col(spans) == 0) | F.col("text").rlike(r"[\p{L}\p{N}\p{M}]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(spans) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*(f"`{c}`" for c in docs.columns))


def oracle(length: int = LENGTH, cover: float = COVER, least: int = LEAST) -> str:
    """The same rows in DuckDB: an item's span of at least m tokens is forbidden, so all its m-grams are."""
    sep = "[^\\p{L}\\p{N}\\p{M}]"
    return f"""
with i as (select {tk.token_sql()} as w from benchmark where text is not null),
n as (select w, greatest({least}, least({length}, cast(ceil(round({cover} * len(w), 6)) as int))) as m from i),
g as (select distinct m, array_to_string(w[k:k + m - 1], ' ') as g from (select w, m, unnest(range(1, len(w) - m + 2)) as k from n where m <= len(w))),
t as (select doc_id, text, {tk.token_sql()} as w from documents),
p as (select doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') as g from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as k from t, (select distinct m from g) where m <= len(w))),
h as (select distinct doc_id, unnest(range(k, k + m)) as k from p semi join g using (m, g)),
c as (select doc_id, count(*) as removed, count(*) filter (k <> before + 1) as spans, list(k) as ks
      from (select doc_id, k, lag(k, 1, -9) over (partition by doc_id order by k) as before from h) group by 1),
s as (select t.doc_id, t.text, coalesce(spans, 0) as spans, coalesce(removed, 0) as removed, ks,
      regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}]+{sep.replace("{", "{{").replace("}", "}}")}*') as bits from t left join c using (doc_id))
select doc_id, spans > 0 as contaminated, cast(spans as int) as n_spans, cast(removed as int) as removed_tokens,
  case when spans = 0 then text else regexp_extract(text, '^{sep.replace("{", "{{").replace("}", "}}")}*') ||
    array_to_string(list_transform(list_filter(range(1, len(bits) + 1), lambda x: not list_contains(ks, x)), lambda x: bits[x]), '') end as text
from s
""".replace("{{", "{").replace("}}", "}")
