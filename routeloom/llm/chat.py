"""Operator 4: chat formatting with minimum-cost role repair.

Legal conversations are those of a small automaton: an optional system turn,
then user and assistant in turn, ending with the assistant.  Each source turn is
emitted as a new turn under its own role (free) or another (RELABEL), or merged
into the turn before it (MERGE, plus RELABEL if that has another role); empty
turns may be inserted anywhere (INSERT).  Dynamic programming over (source turn,
automaton state) finds the cheapest repair.  Equal costs are decided turn by turn
in the order keep, merge, relabel (to system, user, assistant), insert.

The repaired turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``; these
two marks inside a text are broken up by blanks, so that they stay text.  Merged
texts are joined by an empty line.

Defined cases: turns are read in the order of (turn, role, text), nulls last;
rows that repeat all of them count once, so equal turn numbers are ties broken by
role and text.  A null or unknown role fits no state and has to be relabelled;
some common names of roles are understood.  A null text is empty.  Rows with a
null conv_id belong to no conversation and are left out; other ids have to be numbers.
A conversation of any length is repaired as a whole, in time that grows with its turns.
Other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE, RELABEL, INSERT = 2, 5, 4
ROLES = ("system", "user", "assistant")
_NAMES = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "bot": 2, "gpt": 2, "model": 2}
#: State 0 is the start, 1 to 3 are those after a turn of ROLES[state - 1].
_LEGAL = {(0, 0), (0, 1), (1, 1), (2, 2), (3, 1)}
_END = (0, 3)
_FAR = 1 << 60


def role_id(role: str | None) -> int:
    return _NAMES.get((role or "").strip().lower(), -1)


def repair(roles: list[int]) -> tuple[int, list[tuple[str, int]]]:
    """Cost and steps: (keep | merge | relabel | insert, role), one for each source turn and each inserted one."""
    n = len(roles)
    best = [[_FAR] * 4 for _ in range(n + 1)]
    for s in _END if n == 0 else _END[1:]:
        best[n][s] = 0
    for i in range(n, -1, -1):
        row = best[i]
        if i < n:
            r, after = roles[i], best[i + 1]
            for s in range(4):
                cost = row[s]
                for x in range(3):
                    if (s, x) in _LEGAL:
                        cost = min(cost, after[x + 1] + (0 if x == r else RELABEL))
                if s:
                    cost = min(cost, after[s] + MERGE + (0 if s - 1 == r else RELABEL))
                row[s] = cost
        for _ in range(3):  # insertions, until nothing improves
            for s in range(4):
                row[s] = min([row[s], *(row[x + 1] + INSERT for x in range(3) if (s, x) in _LEGAL)])
    steps: list[tuple[str, int]] = []
    i = s = 0
    while i < n or s not in (_END if n == 0 else _END[1:]):
        now, step = best[i][s], None
        if i < n:
            r, after = roles[i], best[i + 1]
            if r >= 0 and (s, r) in _LEGAL and after[r + 1] == now:
                step = ("keep", r)
            elif s and after[s] + MERGE + (0 if s - 1 == r else RELABEL) == now:
                step = ("merge", s - 1)
            else:
                step = next((("relabel", x) for x in range(3) if x != r and (s, x) in _LEGAL and after[x + 1] + RELABEL == now), None)
        if step is None:
            step = next(("insert", x) for x in range(3) if (s, x) in _LEGAL and best[i][x + 1] + INSERT == now)
        steps.append(step)
        s = step[1] + 1
        i += step[0] != "insert"
    return best[0][0], steps


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, int, int, str]:
    """Rendered conversation, its number of turns, the cost, and the steps by their first letters."""
    cost, steps = repair([role_id(r) for r, _ in turns])
    out: list[tuple[int, list[str]]] = []
    texts = iter(turns)
    for step, role in steps:
        text = "" if step == "insert" else next(texts)[1] or ""
        text = text.replace("<|im_start|>", "<| im_start |>").replace("<|im_end|>", "<| im_end |>")
        if step == "merge":
            out[-1][1].append(text)
        else:
            out.append((role, [text]))
    said = "".join(f"<|im_start|>{ROLES[r]}\n{'\n\n'.join(t)}<|im_end|>\n" for r, t in out)
    return said, len(out), cost, "".join(s[0] for s, _ in steps)


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, chat, n_turns, cost, steps) for every conversation."""
    turns = F.array_sort(F.collect_set(F.struct(F.col("turn").isNull().alias("a"), F.col("turn").cast("long").alias("turn"), F.col("role").isNull().alias("b"), F.col("role").cast("string").alias("role"), F.col("text").isNull().alias("c"), F.col("text").cast("string").alias("text"))))
    grouped = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns.alias("t"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                got = [render(list(zip(r, t))) for r, t in zip(s.column("roles").to_pylist(), s.column("texts").to_pylist())]
                yield pa.RecordBatch.from_arrays([s.column("conv_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.string())], ["conv_id", "chat", "n_turns", "cost", "steps"])

    return grouped.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts")).mapInArrow(write, "conv_id long, chat string, n_turns int, cost int, steps string")
