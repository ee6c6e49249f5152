"""Mixing sources to target weights: budgets flow down a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_RUN, md5_key, written

LEVELS = ("domain", "lang", "source")
#: Integer target weights by level; a value that is not named weighs 1.
WEIGHTS = {"domain": {}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {}}


def domain_of(source: Column) -> Column:
    """The tables name no domain; a source's domain follows from a digest of its name."""
    return F.concat(F.lit("domain"), (F.ascii(F.substring(F.md5(source), 1, 1)) % 4).cast("string"))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda x: x != "")).cast("long")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def allotments(leaves: DataFrame, budget: int, weights: dict) -> DataFrame:
    """``alloc`` tokens for each leaf (domain, lang, source, cap): ``budget`` goes down level by level.

    A node may take what all below it can hold, so a shortage is met by siblings first, and reaches the
    parent's siblings only once the whole subtree is full. Siblings are filled in one window pass: by
    ascending cap / weight, a node is full if its cap is at most its share of what the nodes before it leave.
    """
    budgets = None
    for depth, level in enumerate(LEVELS):
        own, parents = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights)).where("w > 0")
        nodes = nodes.join(budgets, parents) if parents else nodes.withColumn("budget", F.lit(int(budget)).cast("long"))
        siblings = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
        rank = siblings.orderBy(F.col("cap") / F.col("w"), *own)
        before = F.coalesce(F.sum("cap").over(rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(rank.rowsBetween(0, W.unboundedFollowing))
        nodes = nodes.withColumn("full", F.col("cap") * rest <= F.col("w") * (F.col("budget") - before))
        taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0))
        nodes = nodes.withColumns({"taken": taken, "open_w": F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings)})
        budgets = nodes.select(*own, F.expr("CASE WHEN full THEN cap ELSE w * (budget - taken) DIV open_w END").alias("budget"))
    return budgets.withColumnRenamed("budget", "alloc")


def mix_sources(docs: DataFrame, share: float = 0.5, max_epochs: int = 2, seed: int = 7, weights: dict | None = None, budget: int | None = None) -> DataFrame:
    """How often each document is taken so that the tokens of all leaves meet their target weights.

    ``budget`` tokens (or ``share`` of all tokens) go down the tree of LEVELS; a leaf holds at most
    ``max_epochs`` times its own tokens. A leaf takes whole epochs first; of the last one it takes the
    longest prefix, in an order seeded by (seed, epoch, doc_id), whose tokens fit its rest. Tokens are words
    between ASCII white space. Only a leaf's boundary bucket of the order is sorted: its documents are
    counted by the leading digits of their seeded key, as many digits as make about as many buckets as
    a bucket then has rows, so no task sees a whole hot leaf.

    Returns a row for each document: doc_id, domain, lang, source, n_tokens, alloc (of its leaf) and copies
    (0: not taken). Null lang or source is the empty name, null text has no tokens (taken where the
    prefix reaches it), null ids sort first; rows that repeat an id share one place in the order and
    are taken together or not at all. Other columns are ignored; no rows give no rows.
    """
    weights = WEIGHTS if weights is None else weights
    source = F.coalesce(F.col("source"), F.lit(""))
    rows = written(
        docs.select(F.col("doc_id"), domain_of(source).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), source.alias("source"), n_words(F.col("text")).alias("n_tokens")),
        "tokens",
    )
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget = min(int(total * share) if budget is None else budget, total * max_epochs)
    caps = leaves.select(*LEVELS, (F.col("tokens") * max_epochs).alias("cap"))
    plan = written(
        leaves.join(allotments(caps, budget, weights), list(LEVELS), "left").withColumn("alloc", F.coalesce("alloc", F.lit(0).cast("long")))
        .withColumn("epochs", F.coalesce(F.expr("CASE WHEN tokens > 0 THEN alloc DIV tokens ELSE 0 END"), F.lit(0)))
        .withColumn("rest", F.col("alloc") - F.col("epochs") * F.col("tokens"))
        .withColumn("digits", F.ceil(F.log(16.0, F.sqrt(F.col("rows").cast("double")))).cast("int"))
        .select(*LEVELS, "alloc", "epochs", "rest", "digits"),
        "plan",
    )
    keyed = rows.join(plan, list(LEVELS)).withColumn("key", md5_key(F.lit(seed), F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.expr("substring(key, 1, digits)"))
    run = W.partitionBy(*LEVELS).orderBy("bucket")
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest")).withColumn("upto", F.sum("t").over(run))
    # The first bucket that does not fit as a whole, and the tokens before it.
    edge = written(sums.where("upto > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before")), "bucket").alias("edge")).select(*LEVELS, F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before")), "edge")
    placed = keyed.join(edge, list(LEVELS), "left")
    out = ["doc_id", *LEVELS, "n_tokens", "alloc"]
    clear = placed.where("edge is null or bucket <> edge").withColumn("in_prefix", F.expr("edge is null or bucket < edge"))
    upto = F.col("before") + F.sum("n_tokens").over(W.partitionBy(*LEVELS).orderBy("key"))
    close = placed.where("bucket = edge").withColumn("in_prefix", upto <= F.col("rest"))
    copies = (F.col("epochs") + F.col("in_prefix").cast("long")).alias("copies")
    return clear.select(*out, copies).unionByName(close.select(*out, copies))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix_sources` takes them, with all their columns.

    A row is taken as often as its id is in its own leaf: an id that stands in several leaves has the copies of each only
    there. Rows that repeat an id within a leaf share one place in the order and come as often as one of them.
    Null ids, langs, sources and texts are handled as there; no rows give no rows.
    """
    taken = mix_sources(docs, **how).where("copies > 0").select(F.col("doc_id").alias("taken_id"), *LEVELS, "copies").distinct()
    source = F.coalesce(docs["source"], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), domain_of(source).alias("domain"), F.coalesce(docs["lang"], F.lit("")).alias("lang"), source.alias("source"))
    found = rows.alias("r").join(taken.alias("t"), F.col("r.id").eqNullSafe(F.col("t.taken_id")) & F.expr(" and ".join(f"r.{c} = t.{c}" for c in LEVELS)))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
