"""Operator 7: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key ``-ln(u) / w``: u is uniform in (0, 1),
from the MD5 digest of seed and doc_id, and w is the quality weight of the document.
Weights are a column (in the pipeline the probability of the quality classifier), or
come from labels: 1 for a document labelled good, the least for one labelled bad, and
for the others the share of good ones among the labelled documents of their source,
with one more of either.  Within a source, documents in the order of their keys are a
weighted sample without replacement.  A source's token budget is its share of the
target weights times the total; as many whole epochs as fit come first, then the
documents in key order of which the running sum of tokens fits into what is left.

The running sum needs no sort of a whole source: keys fall into buckets on a
logarithmic scale, token sums of buckets tell in which bucket a source's cut
lies, and only that bucket's documents are sorted.  Texts aren't shuffled.

Defined cases: a null source counts as the empty name.  A null or empty text
has no tokens; texts of any length are counted to their end.  A weight that is null,
not a number or below LEAST_WEIGHT is LEAST_WEIGHT.  Rows with equal keys and ids, such
as repeated ones, are taken or left together; null ids count as one id, 0, and other
ids have to be numbers.  A source that has no target weight has no budget; without
targets all sources weigh the same.  A source without any token is taken once if it has
a budget.  Other columns, whatever their names, pass through.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .tables import fresh, scratch, stored

SEED = 7
LEAST_WEIGHT = 0.05
#: Buckets for each factor e of the key; a cut's bucket has some 1/4000 of its source.
BUCKETS = 1000


def n_tokens(text: Column) -> Column:
    """Runs of characters other than blanks; each becomes one letter, as regexp_count holds all of a text's runs at once."""
    return F.coalesce(F.length(F.ltrim(F.regexp_replace(text, r"\S+\s*", "x"), F.lit(" \t\n\x0b\f\r"))), F.lit(0)).cast("long")


def at_least(weight: Column) -> Column:
    """The weight, LEAST_WEIGHT where it is less or no number."""
    w = weight.cast("double")
    return F.when(w.isNull() | F.isnan(w), LEAST_WEIGHT).otherwise(F.greatest(F.lit(LEAST_WEIGHT), w))


def sample_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}/"), doc_id.cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def facts(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """(doc_id, id, source, n_tokens, weight) of each document; without a weight all weigh 1."""
    w = F.lit(1.0) if weight is None else at_least(weight)
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n_tokens"), w.alias("weight"))


def facts_by_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """facts() with weights from labels (doc_id, quality); a document that is labelled twice counts by its larger label."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("double").alias("label"))
    rows = facts(docs)
    rows = stored(rows.join(known, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "id", "source", "n_tokens", "label"), "facts")
    share = rows.groupBy(F.col("source").alias("_source")).agg(((F.coalesce(F.sum("label"), F.lit(0.0)) + 1) / (F.count("label") + 2)).alias("share"))
    return rows.join(share, F.col("source") == F.col("_source")).select("doc_id", "id", "source", "n_tokens", at_least(F.coalesce("label", "share")).alias("weight"))


def bucket_of(key: Column) -> Column:
    return F.floor(F.log(key) * BUCKETS)


def keyed(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, id, source, n_tokens, key, bucket) of the facts."""
    return rows.select("doc_id", "id", "source", "n_tokens", sample_key(F.col("id"), F.col("weight"), seed).alias("key")).withColumn("bucket", bucket_of(F.col("key")))


def cuts(rows: DataFrame, targets: dict[str, float] | None, total: int | None) -> DataFrame:
    """(src, epochs, cut_bucket, cut_key, cut_id) by source, stored.

    A document is taken once more than ``epochs`` if its bucket is below cut_bucket, or is cut_bucket and its (key, id) up to the cut's.
    """
    spark = rows.sparkSession
    sums = stored(rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")), "bucket-sums")
    size = sums.groupBy("source").agg(F.sum("tokens").alias("has"))
    if targets is None:
        size = size.withColumn("share", F.lit(1.0))
    else:
        given = spark.createDataFrame(list(targets.items()), T.StructType([T.StructField("source", T.StringType()), T.StructField("share", T.DoubleType())]))
        size = size.join(given, "source", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    every = size.agg(F.coalesce(F.sum("has"), F.lit(0)).alias("all_has"), F.sum("share").alias("all_share"))  # one row
    tokens = F.col("all_has").cast("double") if total is None else F.lit(float(total))
    budget = F.floor(F.col("share") * tokens / F.when(F.col("all_share") > 0, F.col("all_share")).otherwise(F.lit(1.0))).cast("long")
    plan = size.crossJoin(every).withColumn("budget", budget).withColumn("epochs", F.when(F.col("has") > 0, F.floor(F.col("budget") / F.greatest(F.col("has"), F.lit(1)))).otherwise(0).cast("int"))
    plan = plan.select(F.col("source").alias("src"), "has", "share", "epochs", (F.col("budget") - F.col("epochs") * F.col("has")).alias("left"))
    run = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))
    at = run.join(plan, F.col("source") == F.col("src")).where(F.col("upto") > F.col("left")).groupBy("src").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("c"))
    # a source of which all fits (only one without tokens) is cut behind its last bucket
    plan = plan.join(at, "src", "left").select("src", "epochs", "left", F.when(F.col("c").isNull() & (F.col("share") > 0), F.lit((1 << 62) - 1)).otherwise(F.col("c.bucket")).alias("cut_bucket"), F.coalesce("c.before", F.lit(0)).alias("before"))
    near = rows.join(plan.where("left > 0"), (F.col("source") == F.col("src")) & (F.col("bucket") == F.col("cut_bucket")))
    near = near.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", "id")))  # the default frame takes equal rows together
    last = near.where(F.col("upto") <= F.col("left")).groupBy("src").agg(F.max(F.struct("key", "id")).alias("l"))
    out = plan.join(last, "src", "left").select("src", F.col("epochs"), F.when((F.col("left") > 0) | (F.col("cut_bucket") == (1 << 62) - 1), F.col("cut_bucket")).alias("cut_bucket"), F.col("l.key").alias("cut_key"), F.col("l.id").alias("cut_id"))
    return stored(out, "cuts", keep=True)


def _copies(bucket: Column, key: Column, ident: Column, cut: dict[str, Column]) -> Column:
    upto = (key < cut["cut_key"]) | ((key == cut["cut_key"]) & (ident <= cut["cut_id"]))
    inside = (bucket < cut["cut_bucket"]) | ((bucket == cut["cut_bucket"]) & upto)
    return (cut["epochs"] + F.coalesce(inside, F.lit(False)).cast("int")).cast("int")


def selected(found: DataFrame, targets: dict[str, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the facts of documents that are taken at least once."""
    rows = stored(keyed(found, seed), "keys", keep=True)
    edge = cuts(rows, targets, total)
    out = rows.join(edge, F.col("source") == F.col("src"))
    return out.select("doc_id", "source", "n_tokens", _copies(F.col("bucket"), F.col("key"), F.col("id"), {c: F.col(c) for c in ("epochs", "cut_bucket", "cut_key", "cut_id")}).alias("copies")).where("copies > 0")


def selection(docs: DataFrame, targets: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, weight: Column | None = None, labels: DataFrame | None = None) -> DataFrame:
    """selected() of documents, weighed by a column, by labels, or not at all."""
    with scratch(docs.sparkSession):
        return selected(facts(docs, weight) if labels is None else facts_by_labels(docs, labels), targets, total, seed)


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, weight: Column | None = None) -> DataFrame:
    """The documents that are taken, with one more column, copies: each row is compared with its source's cut.  docs is read twice, its weights too."""
    with scratch(docs.sparkSession):
        edge = cuts(stored(keyed(facts(docs, weight), seed), "keys"), targets, total)
    ident, source = F.coalesce(docs["doc_id"].cast("long"), F.lit(0)), F.coalesce(docs["source"], F.lit(""))
    key = sample_key(ident, F.lit(1.0) if weight is None else at_least(weight), seed)
    names = {c: fresh(docs, f"cut_{c}") for c in edge.columns}
    edge = edge.select(*(F.col(c).alias(n) for c, n in names.items()))
    joined = docs.join(F.broadcast(edge), source == F.col(names["src"]))  # one row a source
    copies = fresh(docs, "copies")
    taken = _copies(bucket_of(key), key, ident, {c: F.col(n) for c, n in names.items()})
    return joined.withColumn(copies, taken).where(F.col(copies) > 0).drop(*names.values())


def oracle(seed: int = SEED) -> str:
    """The same rows in DuckDB, with weights from labels and a plain running sum; without targets and with the total of the input."""
    return f"""
with l as (select doc_id, cast(max(quality) as double) as label from labels where doc_id is not null and quality in (0, 1) group by 1),
t as (select doc_id, coalesce(doc_id, 0) as id, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '\\S+')), 0) as n_tokens, label from documents left join l using (doc_id)),
q as (select source, cast(coalesce(sum(label), 0) + 1 as double) / (count(label) + 2) as share from t group by 1),
k as (select t.*, -ln((cast(cast('0x' || substr(md5('{seed}/' || id), 1, 13) as bigint) as double) + cast(0.5 as double)) / cast({1 << 52} as double)) / greatest(cast({LEAST_WEIGHT} as double), coalesce(label, share)) as key from t join q using (source)),
s as (select source, sum(n_tokens) as has from k group by 1),
b as (select source, has, cast(floor(cast((select sum(has) from s) as double) / (select count(*) from s)) as bigint) as budget from s),
e as (select source, case when has > 0 then budget // has else 0 end as epochs, case when has > 0 then budget % has else budget end as rest from b),
r as (select *, sum(n_tokens) over (partition by source order by key, id) as upto from k)
select doc_id, source, n_tokens, cast(epochs + case when rest > 0 and upto <= rest then 1 else 0 end as int) as copies
from r join e using (source) where epochs > 0 or (rest > 0 and upto <= rest)
"""
