"""Contract versions: latest, update flags, and keep-first deduplication.

Everything here is a partial-then-final aggregation. A contract that holds a large share of all
rows is reduced to one row per input partition before the shuffle, and no task ever has to walk
the rows of one contract in order, as a window would make it do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACT = ("source", "contract_id")
FAR_PAST = -(2**63) + 1


def newest_first(ts: str = "release_date") -> Column:
    """Ascending sort key that puts the newest timestamp first and a missing one last."""
    return -F.coalesce(F.unix_micros(F.col(ts)), F.lit(FAR_PAST))


def keep_first(df: DataFrame, keys: Sequence[str], *order: tuple[str, Column]) -> DataFrame:
    """One row per key: the smallest by ``order``, then by every other column.

    The rest of the row takes part in the order, so the result does not depend on row order.
    Maps cannot be compared; leave them out of ``df``.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[c.alias(f"_by_{name}") for name, c in order], *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}") for c in df.columns])


def latest_versions(df: DataFrame, keys: Sequence[str] = CONTRACT) -> DataFrame:
    """The newest version of every contract; equal timestamps keep the lowest release id."""
    return keep_first(df, keys, ("age", newest_first()), ("release", F.col("release_id")))


#: What a stored release is known by. A portal's release id is its contract id, so the listing's day and amount belong to it.
RELEASE = ("source", "release_id", "contract_id", "release_date", "amount")


def unique_releases(df: DataFrame, *order: tuple[str, Column]) -> DataFrame:
    """Releases stored twice count once: one row per ``RELEASE``, as far as ``df`` has its columns.

    Rows without a release id are the same only if they agree in every column.
    """
    blank = F.trim(F.coalesce("release_id", F.lit(""))) == ""
    keys = [c for c in RELEASE if c in df.columns]
    whole = F.when(blank, F.struct(*[F.col(c) for c in df.columns]))
    return keep_first(df.withColumn("_whole", whole), (*keys, "_whole"), *order).drop("_whole")


def version_flags(df: DataFrame, keys: Sequence[str] = CONTRACT) -> DataFrame:
    """Accepted versions with ``is_update``, true for all but the first of a contract.

    One version per timestamp is accepted, so a version is an update exactly when it is later
    than the first timestamp of its contract. Versions without a timestamp are never accepted
    over a dated one; a contract that has only such versions keeps one of them, no update.
    """
    keys = tuple(keys)
    accepted = keep_first(df, (*keys, "release_date"), ("release", F.col("release_id")))
    # The versions accepted are one per timestamp already, so the first date needs no second scan.
    first = accepted.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("release_date").alias("_first_date"))
    same = [accepted[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = accepted.join(first, reduce(and_, same))
    kept = joined.where(F.col("release_date").isNotNull() | F.col("_first_date").isNull())
    later = F.coalesce(F.col("release_date") > F.col("_first_date"), F.lit(False))
    return kept.withColumn("is_update", later).select(*df.columns, "is_update")
