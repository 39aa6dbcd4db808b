"""Expressions over an array of class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(p: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def names_array(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def class_map(names: list[str], p: Column) -> Column:
    return F.map_from_arrays(names_array(names), p)


def ranked(names: list[str], p: Column) -> Column:
    """Array of (rank, class, probability), most likely first, ties in class order."""
    cells = F.transform(
        F.arrays_zip(names_array(names).alias("name"), p.alias("p")),
        lambda s, i: F.struct(
            (-s["p"]).alias("key"), i.alias("ord"), s["name"].alias("class"), s["p"].alias("p")
        ),
    )
    return F.transform(
        F.array_sort(cells),
        lambda s, i: F.struct(
            (i + 1).alias("rank"), s["class"].alias("class"), s["p"].alias("probability")
        ),
    )


def softmax(scores: list[Column]) -> Column:
    """Probabilities of linear scores, shifted by their maximum against overflow."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = F.array(*[F.exp(s - top) for s in scores])
    total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return F.transform(parts, lambda e: e / total)
