"""One order of an answer's items from several scores on unlike scales, by Borda count.

Every score ranks the items of an answer by competition ranks with averaged ties; the points of a
rank are the items below it (ties share their mean), so only the order inside each score counts and
no range prevails. Points are weighted, summed and sorted, ties by the identifier.

An answer is one row holding parallel lists, as it went over the wire. Everything is computed inside
the row, so no answer is ever gathered or shuffled. Work is quadratic in the items of one answer,
which the interface bounds at a few dozen.

Defined results
  * A missing entry (null or NaN) has no rank. With ``missing="mid"`` it gets the mean of the points
    of that score, with ``missing="none"`` no credit.
  * A missing or empty list of scores gives every item no points from that score.
  * Null ids are ranked like others and sort after them in a tie; repeated ids keep their places.
  * Lists of unequal length: entries beyond the ids are dropped, absent ones count as missing.
  * A null or empty list of ids gives an empty order. Extra columns pass through; ``out`` replaces
    a column of its name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _points(scores: Column, ids: Column, missing: str) -> Column:
    """Borda points of every item: items beaten + half of the others tied with it.

    Ranked among all n items of the answer, a missing one stands below every present one, so a
    present item at competition rank r (ties averaged) has n - r points.
    """
    n = F.size(ids)
    raw = F.coalesce(scores, F.array().cast("array<double>"))
    full = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.get(raw, i - 1)
    )
    clean = F.transform(full, lambda s: F.when(~F.isnan(s), s))
    present = F.filter(clean, lambda s: s.isNotNull())
    gone = n - F.size(present)

    def one(s: Column) -> Column:
        return F.when(
            s.isNotNull(),
            gone
            + F.aggregate(
                present,
                F.lit(-0.5),
                lambda acc, o: acc + F.when(o < s, F.lit(1.0)).when(o == s, F.lit(0.5)).otherwise(F.lit(0.0)),
            ),
        )

    if missing == "mid":
        other = F.when(F.size(present) > 0, (n - 1) / F.lit(2.0)).otherwise(F.lit(0.0))
    else:
        other = F.lit(0.0)
    return F.transform(clean, lambda s: F.coalesce(one(s), other))


def borda_order(
    df: DataFrame,
    ids: str = "ids",
    scores: Sequence[str] = ("scores", "rerank_scores"),
    weights: Sequence[float] | None = None,
    missing: str = "mid",
    out: str = "ordem",
) -> DataFrame:
    """``df`` with ``out``: array of (id, pontos, posicao) in the combined order."""
    if missing not in ("mid", "none"):
        raise ValueError("missing is 'mid' or 'none'")
    weights = list(weights or [1.0] * len(scores))
    if len(weights) != len(scores):
        raise ValueError("one weight for each score")
    names = [f"__p{k}" for k in range(len(scores))]
    keep = [c for c in df.columns if c != out]
    d = df.select(
        *keep,
        F.when(F.size(ids) > 0, F.col(ids)).alias("__ids"),
        *[F.when(F.size(ids) > 0, _points(F.col(s), F.col(ids), missing)).alias(p) for s, p in zip(scores, names)],
    )
    # Negated keys make the natural order of structs the wanted one; one sort of plain structs.
    total = lambda i: sum((F.get(F.col(p), i) * w for p, w in zip(names, weights)), F.lit(0.0))
    items = F.transform(
        F.sequence(F.lit(0), F.size("__ids") - 1),
        lambda i: F.struct(
            (-F.round(total(i), 9)).alias("menos"),
            F.get(F.col("__ids"), i).isNull().alias("nulo"),
            F.get(F.col("__ids"), i).alias("id"),
            i.alias("lugar"),
        ),
    )
    ordered = F.array_sort(items)
    result = F.transform(
        ordered,
        lambda x, k: F.struct(
            x["id"].alias("id"), (-x["menos"]).alias("pontos"), (k + 1).cast("int").alias("posicao")
        ),
    )
    empty = F.array().cast("array<struct<id:string,pontos:double,posicao:int>>")
    return d.select(*keep, F.coalesce(F.when(F.col("__ids").isNotNull(), result), empty).alias(out))
