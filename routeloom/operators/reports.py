"""Markdown reports and cards, rendered on the driver from small collected frames; no timestamps, so they are reproducible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame

from routeloom.operators.analysis import VERDICTS
from routeloom.sources.readers import digest

WORDS = dict(zip(VERDICTS, ("PASS", "WARN", "MISSING", "FAIL")))


def shown(x: float | None, form: str) -> str:
    return format(x, form) if x is not None else "n/a"


def pct(x: float | None) -> str:
    return shown(x, ".1%")


def num(x, digits=4):
    return shown(x, f".{digits}f")


def grid(heads: Sequence[str], rows: Sequence[Sequence[object]]) -> list[str]:
    return [f"| {' | '.join(map(str, r))} |" for r in (heads, ["---"] * len(heads), *rows)]


def provenance(title: str, inputs: Mapping[str, Path], settings: Mapping[str, object] | None = None) -> list[str]:
    """Title, and a table of the inputs with digests and numbers of lines (blank ones included)."""
    rows = [(name, p.name, digest(p), len(p.read_text(encoding="utf-8").splitlines())) for name, p in inputs.items()]
    out = [f"# {title}", "", *grid(("Input", "File", "Digest", "Rows"), rows), ""]
    for k, v in (settings or {}).items():
        out.append(f"- {k}: {v}")
    return out + [""] * bool(settings)


def health_report(per_agent: DataFrame, verdicts: DataFrame, accuracy: DataFrame, inputs: Mapping[str, Path] | None = None, cost_usd: float | None = None) -> str:
    """Decision, gate table, E(D, M) and per-agent figures, the cost of collection if it is known, and what to redesign."""
    gates, agents, cells = verdicts.collect(), sorted(per_agent.collect(), key=lambda r: r.pos), accuracy.collect()
    decision = max((g.verdict for g in gates), key=VERDICTS.index, default="missing")
    out = provenance("Health of the reward matrix", inputs or {})
    out += [f"Decision: **{'STOP' if decision in ('stop', 'missing') else 'CONTINUE'}** ({WORDS[decision]})", ""]
    out += grid(("Gate", "Found", "Good from", "Bad from", "Verdict"), [(g.metric, num(g.value), num(g.continue_at, 2), num(g.stop_at, 2), WORDS[g.verdict]) for g in sorted(gates, key=lambda g: g.metric)])
    names = [a.agent for a in agents]
    by = {(c.dataset, c.agent): c.accuracy for c in cells}
    out += ["", "## Accuracy by dataset", "", *grid(("Dataset", *names, "Best"), [(d, *(num(by.get((d, a)), 3) for a in names), max(names, key=lambda a: by.get((d, a), -1.0))) for d in sorted({c.dataset for c in cells})])]
    out += ["", "## Agents", "", *grid(("Agent", "Mean reward", "Wins alone", "Empty", "Errors", "Upper median ms"), [(a.agent, num(a.mean_reward), pct(a.unique_best_share), pct(a.empty_rate), pct(a.error_rate), a.median_latency_ms) for a in agents])]
    if cost_usd is not None:
        out += ["", f"Collection cost {num(cost_usd)} USD."]
    blocking = sorted(g.metric for g in gates if g.verdict in ("stop", "missing"))
    if blocking:
        out += ["", "## To redesign", "", *(f"- {m}" for m in blocking)]
    return "\n".join(out) + "\n"


def baselines_report(per_agent: DataFrame, baselines: DataFrame, split: str, inputs: Mapping[str, Path] | None = None) -> str:
    b = baselines.first()
    rows = [(f"always {a.agent}", num(a.mean_reward)) for a in sorted(per_agent.collect(), key=lambda r: r.agent)]
    rows += [(f"best fixed ({b.best_fixed_agent})", num(b.best_fixed)), ("uniform", num(b.uniform)), ("oracle", num(b.oracle))]
    return "\n".join([*provenance("Baselines", inputs or {}, {"split": split, "tasks": b.n_tasks}), *grid(("Policy", "Mean reward"), rows), "", f"Headroom: {num(b.headroom)}"]) + "\n"


def pool_report(facets: DataFrame, sources: DataFrame, losses: Mapping[str, object], unavailable: Mapping[str, str], seed: int, max_share: float) -> str:
    """Task pool by domain, difficulty, split and source, what was lost, and which sources couldn't be read."""
    cells = facets.collect()
    out = provenance("Task pool", {}, {"seed": seed, "largest share": pct(max_share)})
    for facet in ("domain", "difficulty", "split"):
        own = sorted((c.value, c.n) for c in cells if c.facet == facet)
        total = sum(n for _, n in own) or 1
        out += [f"## By {facet}", "", *grid((facet, "Tasks", "Share"), [(v, n, pct(n / total)) for v, n in own]), ""]
    out += ["## By source", "", *grid(("Source", "Tasks", "License", "Prompts may be published"), [(s.dataset, s.n, s.last_license, "yes" if s.redistributable else "no, ids only") for s in sorted(sources.collect(), key=lambda s: s.dataset)]), ""]
    out += ["## Losses", "", *(f"- {k}: {v}" for k, v in losses.items()), ""]
    if unavailable:
        out += ["## Unavailable", "", *(f"- {k}: {v}" for k, v in sorted(unavailable.items())), ""]
    return "\n".join(out)


def _breakdown(cells: list, facet: str) -> list[str]:
    own = sorted(((c.n, c.value) for c in cells if c.facet == facet), key=lambda x: (-x[0], x[1]))
    return [f"### {facet.capitalize()}", "", *grid((facet, "rows"), [(v, n) for n, v in own]), ""]


def rewards_card(title: str, facets: DataFrame, manifest: DataFrame, n_rows: int, excluded: Mapping[str, str] | None = None) -> str:
    """Card of the published rewards: agents, distribution, what was left out."""
    cells = facets.collect()
    agents = [(a["index"], a.agent_id, a.slug, num(a.price_per_1m_prompt_usd, 2), num(a.price_per_1m_output_usd, 2), a.verified_at) for a in sorted(manifest.collect(), key=lambda a: a["index"])]
    out = ["---", f"pretty_name: {title}", "---", "", f"# {title}", "", f"{n_rows} tasks with the mean reward of each agent. There are no prompts, answers or replies in this dataset.", "", "## Agents", "", *grid(("Index", "Agent", "Model", "Prompt USD", "Output USD", "Verified"), agents), "", "## Distribution", ""]
    for facet in ("dataset", "domain", "difficulty", "split"):
        out += _breakdown(cells, facet)
    if excluded:
        out += ["## Left out", "", *(f"- {k}: {v}" for k, v in sorted(excluded.items())), ""]
    return "\n".join(out)


def tasks_card(title: str, facets: DataFrame, sources: DataFrame, n_tasks: int, n_labelled: int, rewards_name: str) -> str:
    """Card of the published tasks, which rewards join by task_id."""
    cells = facets.collect()
    rows = sorted(sources.collect(), key=lambda s: (-s.n, s.dataset))
    out = ["---", f"pretty_name: {title}", "---", "", f"# {title}", "", f"{n_tasks} tasks, of which {n_labelled} have rewards in {rewards_name}; both join by task_id.", "", "## Sources", "", *grid(("Source", "Tasks", "Domain", "License"), [(s.dataset, s.n, s.first_domain, s.last_license) for s in rows]), ""]
    for facet in ("domain", "difficulty", "grader", "split"):
        out += _breakdown(cells, facet)
    return "\n".join(out)
