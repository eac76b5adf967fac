"""Pairs of members of the same group, with hot groups split over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one group that meet in one task: a block pair makes at most this
# number squared comparisons.
BLOCK_ROWS = 2048


def block_of(member: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(member), blocks)


def grouped_pairs(
    members: DataFrame,
    key: str,
    member: str,
    carry: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All unordered pairs ``(key, a, b)`` with ``a < b`` inside each group.

    ``members`` holds each (key, member) once.  A group of n members is cut into
    ``ceil(n / block_rows)`` blocks by hash; every pair of blocks is one join
    key, so the largest piece of work is fixed whatever the group size.  Groups
    of one never reach the join.  ``carry`` columns come back as ``a_*``/``b_*``.
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cut = (
        members.select(key, member, *carry)
        .join(sizes, key)
        .withColumn("_blocks", F.ceil(F.col("_n") / block_rows))
        .withColumn("_block", block_of(F.col(member), F.col("_blocks")))
    )

    def side(name: str, other: Column, first: Column, second: Column) -> DataFrame:
        return cut.select(
            key,
            F.explode(other).alias("_other"),
            "_block",
            F.col(member).alias(name),
            *[F.col(c).alias(f"{name}_{c}") for c in carry],
        ).select(
            key, first.alias("_bi"), second.alias("_bj"), name, *[f"{name}_{c}" for c in carry]
        )

    block, other = F.col("_block"), F.col("_other")
    left = side("a", F.sequence(block, F.col("_blocks") - 1), block, other)
    right = side("b", F.sequence(F.lit(0).cast("long"), block), other, block)
    met = left.join(right, [key, "_bi", "_bj"]).where(
        (F.col("_bi") < F.col("_bj")) | (F.col("a") < F.col("b"))
    )
    swap = F.col("a") > F.col("b")

    def ordered(suffix: str) -> list[Column]:
        lo, hi = F.col(f"a{suffix}"), F.col(f"b{suffix}")
        return [
            F.when(swap, hi).otherwise(lo).alias(f"a{suffix}"),
            F.when(swap, lo).otherwise(hi).alias(f"b{suffix}"),
        ]

    cols = ordered("")
    for c in carry:
        cols += ordered(f"_{c}")
    return met.select(key, *cols)


def pairs_sharing_at_least(
    members: DataFrame,
    key: str,
    member: str,
    minimum: int = 2,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs ``(a, b, shared)`` that share ``minimum`` keys or more, exactly.

    Prefix filtering: order keys by how many members hold them.  A pair sharing
    ``minimum`` keys still shares one after each side sets aside its
    ``minimum - 1`` most common keys, so candidates come from the rarer keys
    alone.  A key that a third of all members hold is thus never paired with
    itself; it only counts when a candidate is verified.
    """
    if minimum < 2:
        raise ValueError("use grouped_pairs for pairs sharing one key")
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    kept = members.select(key, member).join(sizes, key)
    # The keys set aside per member: its ``minimum - 1`` most common ones.
    if minimum == 2:
        held = kept.groupBy(member).agg(
            F.count(F.lit(1)).alias("_keys"),
            F.array(F.max(F.struct("_size", key))).alias("_aside"),
        )
    else:
        by_size = Window.partitionBy(member).orderBy(F.desc("_size"), F.desc(key))
        top = (
            kept.withColumn("_rank", F.row_number().over(by_size))
            .where(F.col("_rank") < minimum)
            .groupBy(member)
            .agg(F.collect_list(F.struct("_size", key)).alias("_aside"))
        )
        held = kept.groupBy(member).agg(F.count(F.lit(1)).alias("_keys")).join(top, member)
    held = held.where(F.col("_keys") >= minimum)
    prefix = (
        kept.join(held, member)
        .where(~F.array_contains("_aside", F.struct("_size", key)))
        .select(key, member, F.transform("_aside", lambda s: s[key]).alias("_aside"))
    )
    pairs = grouped_pairs(prefix, key, member, carry=("_aside",), block_rows=block_rows)
    # Shared keys are: met in both prefixes, set aside by both, or in the prefix
    # of one and set aside by the other.
    both_aside = F.size(F.array_intersect("a__aside", "b__aside"))
    counted = pairs.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("_met"),
        F.first("a__aside").alias("_aa"),
        F.first("b__aside").alias("_ba"),
        F.first(both_aside).alias("_both"),
    )
    cross = (
        counted.select("a", "b", F.col("b").alias(member), F.explode("_aa").alias(key))
        .unionByName(counted.select("a", "b", F.col("a").alias(member), F.explode("_ba").alias(key)))
        .join(prefix.select(key, member), [key, member], "left_semi")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("_cross"))
    )
    return (
        counted.join(cross, ["a", "b"], "left")
        .select(
            "a",
            "b",
            (F.col("_met") + F.col("_both") + F.coalesce("_cross", F.lit(0))).alias("shared"),
        )
        .where(F.col("shared") >= minimum)
    )
