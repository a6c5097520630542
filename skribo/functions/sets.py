"""Likeness of the sets of words of two strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_set(text: Column) -> Column:
    return F.array_distinct(F.split(text, " "))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words."""
    x, y = word_set(a), word_set(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared words over both numbers of distinct words; 1 if one string holds the other."""
    x, y = word_set(a), word_set(b)
    return F.when(F.contains(a, b) | F.contains(b, a), 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def containment(a: Column, b: Column) -> Column:
    """The share of the distinct words of a that b has."""
    x = word_set(a)
    return F.size(F.array_intersect(x, word_set(b))) / F.size(x)
