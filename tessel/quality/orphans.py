"""References to records that do not exist.

A Bloom filter over the parent keys, of ten bits for each however many there are, proves most orphans without any
shuffle.  Only references that pass it are verified by an exact join with one row of facts for each parent; keys that
hold a thousandth of the references or more (a thousand of them at most) meet their facts by broadcast, in the scan that
finds the definite orphans, so no task gets a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import BloomPass, bloom_passes, hot_keys, in_passes

HOT_SHARE = 0.001


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    ref_key: str = "order_id",
    parent_key: str = "id",
    seen_at: str = "loaded_at",
    parent_seen_at: str = "loaded_at",
    parent_deleted_at: str = "deleted_at",
    keep: tuple[str, ...] = ("shipment_id",),
) -> DataFrame:
    """The columns ``keep`` of each failing reference, with ``kind``; one row for each different result.

    ``missing``: no parent row has the key.  ``late``: the first load of the parent is after the reference was
    seen.  ``deleted``: not late, and some row of the parent was deleted no later than that.

    A null reference is no case.  A null ``seen_at``, or a parent without any load or deletion time, makes no
    case of the kind that needs it.  Repeated rows count once; an empty parent table makes every reference
    ``missing``; other columns of either table, whatever their names, are not read.
    """
    wanted = list(dict.fromkeys(keep))
    refs = refs.where(F.col(ref_key).isNotNull()).select(
        F.col(ref_key).alias("_key"), F.col(seen_at).alias("_seen"), *(F.col(c).alias(f"_keep_{k}") for k, c in enumerate(wanted))
    )
    kept = [F.col(f"_keep_{k}").alias(c) for k, c in enumerate(wanted)]

    def facts(of: DataFrame) -> DataFrame:
        own = of.where(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("_key"))
        return own.agg(F.min(parent_seen_at).alias("_first"), F.min(parent_deleted_at).alias("_gone")).withColumn("_there", F.lit(True))

    hot = [r[0] for r in hot_keys(refs, "_key", HOT_SHARE).collect()]
    key, is_hot = F.col("_key"), F.col("_key").isin(hot)
    kind = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("_first") > F.col("_seen"), "late")
        .when(F.col("_gone") <= F.col("_seen"), "deleted")
    )

    def failing(p: BloomPass) -> DataFrame:
        """The failing references whose keys belong to a pass: one scan for what needs no shuffle, one for what does."""
        own, parent = refs.where(p.own(key)), parents.where(p.own(F.col(parent_key)))
        still = own.where(is_hot | ~p.may(key)).join(F.broadcast(facts(parent.where(F.col(parent_key).isin(hot)))), "_key", "left")
        moved = own.where(p.may(key) & ~is_hot).join(facts(parent), "_key", "left")
        return still.unionByName(moved).withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*kept, "kind")

    return in_passes(bloom_passes(parents, F.col(parent_key), parents.count()), failing).distinct()


def orphan_report(orphans: DataFrame, table_name: str, at: str = "shipped_at", id_column: str = "shipment_id") -> DataFrame:
    """Number of different failing references for each month of ``at`` and kind; a null time has a null month."""
    return (
        orphans.groupBy(F.date_format(at, "yyyy-MM").alias("month"), "kind")
        .agg(F.countDistinct(id_column).alias("n_references"))
        .select(F.lit(table_name).alias("table_name"), "month", "kind", "n_references")
    )
