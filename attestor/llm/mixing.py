"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions alone.

Leaves are (domain, lang, source). A budget of tokens is handed down the tree: at each node the
children get it in proportion to their weights, but none more than its subtree can give in
``max_epochs`` passes. What a child cannot give is shared among its siblings by weight; only
what all of them together cannot give was never handed to their parent, and so went to the
parent's siblings. Each leaf then takes whole epochs and a prefix of one more, each epoch in its
own seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import stored
from attestor.llm.rules import word_array

LEVELS = ("domain", "lang", "source")
SHARE, MAX_EPOCHS, SEED = 0.5, 3, 17
BUCKET_DIGITS = 3  # hexadecimal digits of the order that split a leaf: 4096 buckets

# stated target weights; what is not listed weighs OTHER
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "code": 2, "news": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
OTHER = 1
SOURCE_DOMAINS = ("web", "books", "code", "news")


def domain_of() -> Column:
    """Of column source: the domain of srcN is the N div 5-th of the list; any other source is of the domain other."""
    at = F.floor(F.expr("try_cast(nullif(regexp_extract(source, '^src([0-9]{1,4})$', 1), '') AS int)") / 5).cast("int")
    named = F.lit("other")
    for i, domain in enumerate(SOURCE_DOMAINS):
        named = F.when(at == i, domain).otherwise(named)
    return named


def weight_of(level: str) -> Column:
    table = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}.get(level, {})
    weight = F.lit(OTHER)
    for name, w in table.items():
        weight = F.when(F.col(level) == name, w).otherwise(weight)
    return weight.cast("double")


def leaves_of(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, tokens): null lang or source count as the empty name."""
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                        F.size(word_array(F.coalesce("text", F.lit("")))).cast("bigint").alias("tokens"))
    return plain.withColumn("domain", domain_of())


def shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``given``: the parent's ``budget`` shared by weight, no child above its ``capacity``.

    Children in order of capacity per weight: the first ones that a proportional share of what is
    left would overfill give all they have, the others share the rest.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = children.withColumn("_level", left / weights)
    full = F.col("capacity") <= F.col("_level") * F.col("weight")
    rest = F.min(F.when(~full, F.struct(F.col("capacity") / F.col("weight"), F.col(name), F.col("_level").alias("level")))).over(whole)
    return (level.withColumn("_rest", rest["level"])
            .withColumn("given", F.when(full, F.col("capacity")).otherwise(F.col("_rest") * F.col("weight")))
            .drop("_level", "_rest"))


def budgets(leaves: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, leaf_tokens, target): the tokens each leaf is to give, as a whole number.

    The tree is small: one row per leaf. All tokens times ``share`` is the budget of the root.
    """
    sizes = stored(leaves.groupBy(*LEVELS).agg(F.sum("tokens").alias("leaf_tokens")), "mixing-leaves")
    budget, above = None, []
    for level in LEVELS:
        path = [*above, level]
        nodes = (sizes.groupBy(*path).agg(F.sum("leaf_tokens").alias("_tokens"))
                 .withColumns({"capacity": (F.col("_tokens") * max_epochs).cast("double"), "weight": weight_of(level)}))
        if above:
            nodes = nodes.join(budget, above)
        else:  # one row per domain
            nodes = nodes.withColumn("budget", F.floor(F.sum("_tokens").over(Window.partitionBy(F.lit(0))) * share).cast("double"))
        budget = shared_out(nodes, above or [F.lit(0)], level).select(*path, F.col("given").alias("budget"))
        above = path
    return sizes.join(budget, list(LEVELS)).select(*LEVELS, "leaf_tokens", F.floor("budget").cast("bigint").alias("target"))


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch): the sampled documents, a row for each epoch.

    A leaf with target t takes t div its tokens whole epochs; of one more epoch it takes, in the
    seeded order of that epoch, the longest prefix of at most the tokens still missing. Documents
    without tokens never fill a budget: they come with the whole epochs, and in a prefix where
    their turn comes. Rows with equal doc_id are equal in order and stay together as far as the
    budget goes. Null texts have no tokens; a null doc_id orders as the empty text.
    An empty table gives no rows.

    The order is cut into buckets by its first digits; bucket sums say which buckets lie inside
    the prefix, so that only the one bucket at its end has to be sorted.
    """
    leaves = stored(leaves_of(docs), "mixing-docs")
    targets = stored(budgets(leaves, share, max_epochs), "mixing-targets")
    targets = targets.withColumn("whole", F.when(F.col("leaf_tokens") > 0, F.floor(F.col("target") / F.col("leaf_tokens"))).otherwise(0).cast("int"))
    targets = targets.withColumn("missing", F.col("target") - F.col("whole") * F.col("leaf_tokens"))
    placed = leaves.join(targets, list(LEVELS))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    full = (placed.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
            .select("doc_id", *LEVELS, "tokens", "epoch"))
    partial = (placed.filter("missing > 0").withColumn("order", order)
               .withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS)))
    key = [*LEVELS, "bucket"]
    earlier = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (partial.groupBy(*key).agg(F.sum("tokens").alias("inside"))
              .select(*key, "inside", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("start")))
    begun = partial.join(starts, key).filter("start <= missing")
    within = Window.partitionBy(*key).orderBy("order", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    sure = begun.filter("start + inside <= missing")
    cut = (begun.filter("start + inside > missing").withColumn("_end", F.col("start") + F.sum("tokens").over(within))
           .filter("_end <= missing"))
    last = [x.select("doc_id", *LEVELS, "tokens", F.col("whole").alias("epoch")) for x in (sure, cut)]
    return full.unionByName(last[0]).unionByName(last[1])
