"""Set similarity of word arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ratio


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all words; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), ratio(shared(a, b), F.size(F.array_union(a, b)))).otherwise(0.0)


def overlap(a: Column, b: Column, least: int = 3) -> Column:
    """Shared by the words of the smaller; 0 for fewer than `least` shared."""
    return F.when(shared(a, b) >= least, ratio(shared(a, b), F.least(F.size(a), F.size(b)))).otherwise(0.0)


def promotion_duplicate(name_a: Column, name_b: Column, text_a: Column, text_b: Column) -> Column:
    return (jaccard(name_a, name_b) >= 0.5) | (overlap(name_a, name_b) >= 0.5) | (jaccard(text_a, text_b) >= 0.55)


def collision_floor(n: Column) -> Column:
    """Shared documents from which two evidence sets collide: two thirds of n, at least 3."""
    return F.greatest(F.lit(3), F.ceil(n * 2 / 3.0)).cast("long")


def attachment_floor(n: Column) -> Column:
    """Shared documents from which a candidate attaches to a structural theme: half of n, at least 2."""
    return F.greatest(F.lit(2), F.ceil(n * 0.5)).cast("long")
