"""Surveys against the store: what a staged survey changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a feature that end its life.
GONE = ("removed", "dead", "gone")


def classify(staged: DataFrame, latest: DataFrame, attributes: list[str], tolerance: float = 0.0005) -> DataFrame:
    """``id, change, changed`` for every feature of either side.

    ``staged`` and ``latest`` have ``id, x, y, status`` and ``attributes``. ``change`` is ``created``, ``retired`` (its status says so, and it lived), ``moved`` (further than
    ``tolerance`` on an axis), ``updated``, ``unchanged``, or ``absent`` from the survey, which changes nothing; ``changed`` names the attributes that differ. A null staged
    attribute says nothing. A feature staged as gone that the store never had, or has as gone, is ``unchanged``. Of rows that repeat an id one counts, the largest.
    """
    columns = ["x", "y", "status", *attributes]
    one = lambda df, side: df.where("id is not null").groupBy("id").agg(F.max(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])).alias(side))
    both = one(staged, "s").join(one(latest, "l"), "id", "full_outer")
    s, l = F.col("s"), F.col("l")
    ended = lambda r: F.coalesce(F.lower(r["status"]).isin(*GONE), F.lit(False))
    differ = F.array_compact(F.array(*[F.when(s[a].isNotNull() & ~s[a].eqNullSafe(l[a]), F.lit(a)) for a in attributes]))
    far = lambda c: F.coalesce(F.abs(s[c] - l[c]) > tolerance, s[c].isNotNull() & l[c].isNull())
    change = (
        F.when(s.isNull(), "absent").when(ended(s) & (l.isNull() | ended(l)), "unchanged").when(ended(s), "retired").when(l.isNull() | ended(l), "created")
        .when(far("x") | far("y"), "moved").when(F.size(differ) > 0, "updated").otherwise("unchanged")
    )
    return both.select("id", change.alias("change"), F.when(change.isin("moved", "updated"), differ).otherwise(F.array().cast("array<string>")).alias("changed"))
