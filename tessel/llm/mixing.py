"""Mixing of sources to target weights, by weighted fair queueing.

Each use of a document gets a virtual finish time: the tokens its source has put out up to and including it,
in shuffled order and pass after pass, divided by the source's weight.  In the order of these times every source
gets its share; the order is cut where the total budget is reached.  Running sums over a source that holds most
documents, and over the global order, are made in ranges: sums of ranges first, then within each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import cut, parts_for, running_sum, sized_join

#: Documents of a range, about.
RANGE_ROWS = 50_000


def capacities(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source of either table, with its tokens and its weight among the sources that have any.

    Weights that are null or not positive, and caps below 1, count as no target.  Repeated target rows count once.
    """
    has = documents.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    wanted = (
        targets.where((F.col("weight") > 0) & (F.col("max_repeats") >= 1) & F.col("source").isNotNull())
        .groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    )
    both = has.join(wanted, "source", "full").fillna(0, ["tokens", "documents"])
    used = F.when((F.col("tokens") > 0) & F.col("weight").isNotNull(), F.col("weight"))
    total = both.select(F.sum(used).alias("_all"))
    return both.join(F.broadcast(total)).withColumn("share", used / F.col("_all")).drop("_all")


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` and ``uses`` of each chosen document.

    ``documents``: doc_id, source, n_tokens; ``targets``: source, weight, max_repeats.  ``budget``: total tokens;
    without one, the largest total at which every source can reach its share within its ``max_repeats``.  Weights of
    sources without tokens go to the others in proportion.  Documents without tokens, and those whose source is null
    or has no target, are never chosen.  Rows with the same ``doc_id`` count as one document.  Equal virtual times go
    by source, document and pass, so the choice depends on the seed only.
    """
    documents = cut(documents.where(F.col("n_tokens") > 0).dropDuplicates(["doc_id"]).select("doc_id", "source", "n_tokens"))
    sources = cut(capacities(documents, targets).where(F.col("share").isNotNull()))
    if budget is None:
        row = sources.agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("share"))).first()
        budget = int(row[0] or 0)
    # one pass more than the share needs, for the last place in the order
    passes = F.least(F.col("max_repeats"), F.ceil(F.lit(float(budget)) * F.col("share") / F.col("tokens")) + 1).cast("int")
    plan = sources.select("source", "share", passes.alias("_passes"))
    uses = sized_join(documents, plan, ["source"]).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1)))
    uses = uses.withColumn("_dice", F.xxhash64(F.lit(seed), "_pass", "doc_id"))
    ranges = parts_for(documents.count(), RANGE_ROWS, 16)
    uses = uses.withColumn("_place", F.shiftrightunsigned("_dice", 33))
    place = F.floor(F.col("_place") * F.lit(ranges) / F.lit(1 << 31)).cast("bigint")
    uses = uses.withColumn("_range", F.col("_pass") * F.lit(ranges) + place)
    uses = running_sum(uses, ["source"], "_range", ["_place", "doc_id"], "n_tokens", "_upto")
    uses = uses.withColumn("finish", F.col("_upto") / F.col("share"))
    uses = uses.withColumn("_slice", F.floor(F.col("finish") / F.lit(max(float(budget), 1.0)) * F.lit(4 * ranges)).cast("bigint")).withColumn("_one", F.lit(0))
    uses = cut(uses.select("doc_id", "source", "n_tokens", "finish", "_slice", "_one", "_pass"))
    taken = running_sum(uses, ["_one"], "_slice", ["finish", "source", "doc_id", "_pass"], "n_tokens", "_total").where(F.col("_total") <= F.lit(budget))
    return taken.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").cast("int").alias("uses"))


def shares(documents: DataFrame, targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Target and actual share of every source of either table; the actual one is 0 where nothing was chosen."""
    got = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.count("*").alias("documents_used"), F.max("uses").alias("most_uses")
    )
    all_used = got.agg(F.sum("tokens_used").alias("_all"))
    out = capacities(documents, targets).join(got, "source", "left").fillna(0, ["tokens_used", "documents_used", "most_uses"])
    out = out.join(F.broadcast(all_used)).withColumn("actual_share", F.coalesce(F.col("tokens_used") / F.col("_all"), F.lit(0.0)))
    return out.select("source", "weight", F.col("share").alias("target_share"), "actual_share", "max_repeats", "most_uses", "documents", "documents_used", "tokens", "tokens_used")
