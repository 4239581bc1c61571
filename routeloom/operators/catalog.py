"""Model catalogue: predicates, ranked proposals for each slot of a pool, and the choice of distinct vendors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CODE = tuple("code coder codestral devstral swe".split())
DISTILL = tuple("distill qwq r1 reason thinking".split())
OPEN = tuple("deepseek google/gemma meta-llama mistralai nvidia qwen".split())
UNSTABLE = tuple("batch beta extended floor free nitro online".split())
ROUTER_VENDOR = "openrouter"
FRONTIER = tuple(f"frontier_{x}" for x in "abc")
SLOTS = FRONTIER + tuple(f"open_{x}" for x in "distill_reasoning mid direct reasoning cheap_reasoning coder".split())
PAIR = ("open_direct", "open_reasoning")
DIRECT, REASONING = "-instruct", "-thinking"
TOP = 8


def _any(text: Column, words: tuple[str, ...], test: str = "contains") -> Column:
    return reduce(lambda a, b: a | b, (getattr(text, test)(w) for w in words))


def per_million(price: Column) -> Column:
    """Price of a million tokens from that of one, as text; what is no number costs 0."""
    return F.coalesce(F.round(price.try_cast("double") * 1e6, 6), F.lit(0.0))


def entries(raw: DataFrame) -> DataFrame:
    """Catalogue entries of raw rows (id, name, description, context_length, pricing{prompt, completion}, supported_parameters)."""
    return raw.select(
        F.coalesce("id", F.lit("")).alias("slug"), F.coalesce("name", F.lit("")).alias("name"), F.substring(F.coalesce("description", F.lit("")), 1, 400).alias("description"),
        F.coalesce(F.col("context_length").cast("long"), F.lit(0)).alias("context_length"), per_million(F.col("pricing.prompt")).alias("prompt_usd_per_1m"), per_million(F.col("pricing.completion")).alias("output_usd_per_1m"),
        F.coalesce(F.array_contains("supported_parameters", "reasoning"), F.lit(False)).alias("supports_reasoning"),
    )


def described(catalog: DataFrame) -> DataFrame:
    """With vendor, is_free, is_meta_router, looks_like_coder, looks_like_distill, is_open_weight and is_pinned."""
    slug = F.lower("slug")
    blob = F.lower(F.concat_ws(" ", "slug", "name"))
    variant = F.when(F.instr(slug, ":") > 0, F.regexp_extract(slug, "^[^:]*:(.*)$", 1)).otherwise("")
    return catalog.withColumns({
        "vendor": F.substring_index("slug", "/", 1),
        "is_free": F.col("output_usd_per_1m") <= 0,
        "is_meta_router": F.substring_index("slug", "/", 1) == ROUTER_VENDOR,
        "looks_like_coder": _any(blob, CODE),
        "looks_like_distill": _any(blob, DISTILL),
        "is_open_weight": _any(slug, OPEN, "startswith"),
        "is_pinned": ~slug.startswith("~") & ~slug.contains("latest") & ~variant.isin(*UNSTABLE),
    })


def mode_pairs(catalog: DataFrame) -> DataFrame:
    """(direct, reasoning, price): slugs of one model with and without thinking."""
    side = lambda marker, name: catalog.where(F.col("slug").contains(marker)).select(F.replace("slug", F.lit(marker), F.lit("")).alias("stem"), F.col("slug").alias(name), F.col("output_usd_per_1m").alias(f"{name}_usd"))
    return side(DIRECT, "direct").join(side(REASONING, "reasoning"), "stem").select("direct", "reasoning", (F.col("direct_usd") + F.col("reasoning_usd")).alias("price"))


def proposals(catalog: DataFrame, max_output_usd: float = 5.0, max_frontier_usd: float = 15.0) -> DataFrame:
    """(slot, rank, slug, vendor): up to TOP candidates of each slot; equal prices and context lengths are ordered by slug."""
    c = described(catalog)
    usable = c.where((F.col("slug") != "") & (F.col("context_length") >= 16384) & ~F.col("is_free") & ~F.col("is_meta_router") & F.col("is_pinned"))
    cheap, thinks, code, free = F.col("output_usd_per_1m") <= max_output_usd, F.col("supports_reasoning"), F.col("looks_like_coder"), F.col("is_open_weight")
    eligible = {
        "open_distill_reasoning": free & cheap & thinks & F.col("looks_like_distill"),
        "open_mid": free & cheap & ~thinks & ~code,
        "open_cheap_reasoning": cheap & thinks,
        "open_coder": cheap & code,
    }
    frontier = ~free & (F.col("output_usd_per_1m") <= max_frontier_usd) & (F.col("context_length") >= 128_000)
    price = F.col("output_usd_per_1m")
    slots = F.array(*(F.when(frontier, F.struct(F.lit(s).alias("slot"), (-price).alias("k"))) for s in FRONTIER), *(F.when(test, F.struct(F.lit(s).alias("slot"), price.alias("k"))) for s, test in eligible.items()))
    rows = usable.select("slug", "vendor", (-F.col("context_length")).alias("k2"), F.explode(F.filter(slots, lambda x: x.isNotNull())).alias("s")).select("s.slot", "s.k", F.col("k2").cast("double").alias("k2"), F.col("slug").alias("k3"), "slug", "vendor")
    pairs = mode_pairs(usable.where(free & cheap))
    for slot, side in zip(PAIR, ("direct", "reasoning")):
        rows = rows.unionByName(pairs.select(F.lit(slot).alias("slot"), F.col("price").alias("k"), F.lit(0.0).alias("k2"), F.col("direct").alias("k3"), F.col(side).alias("slug"), F.substring_index(side, "/", 1).alias("vendor")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy("k", "k2", "k3"))).where(F.col("rank") <= TOP).select("slot", "rank", "slug", "vendor")


def distinct_vendors(ranked: list[tuple[str, int, str, str]]) -> dict[str, str]:
    """Slug of each slot, slot by slot: the best of a vendor that isn't used yet, else the best; the reasoning slot follows its sibling."""
    by: dict[str, list[tuple[str, str]]] = {}
    for slot, _, slug, vendor in sorted(ranked, key=lambda r: (r[0], r[1])):
        by.setdefault(slot, []).append((slug, vendor))
    out, used = {}, set()
    for slot in SLOTS:
        options = by.get(slot, [])
        if slot == PAIR[1] and PAIR[0] in out:
            out[slot] = options[[s for s, _ in by[PAIR[0]]].index(out[PAIR[0]])][0]
            continue
        pick = next((o for o in options if o[1] not in used), options[0] if options else None)
        if pick:
            out[slot] = pick[0]
            used.add(pick[1])
    return out
