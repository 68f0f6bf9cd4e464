"""Latent codes, attention and effects as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sceneframe.functions.boxes import argmax_first

__all__ = [
    "argmax_first", "round_bits", "unit_of", "predicate_of", "unit_slice", "atom_string", "action_id",
    "apply_effects", "apply_effects_additive", "hard_onehot", "hard_sigmoid", "diff_map", "abs_diff",
    "weighted_arguments",
]


def round_bits(values: Column) -> Column:
    """Array of scores to 0/1 integers, halves to the even neighbour."""
    return F.transform(values, lambda v: F.rint(v).cast("int"))


def unit_of(index: Column, predicates: int) -> Column:
    return F.floor(index / F.lit(predicates)).cast("int")


def predicate_of(index: Column, predicates: int) -> Column:
    return (index % F.lit(predicates)).cast("int")


def unit_slice(bits: Column, unit: int, predicates: int) -> Column:
    return F.slice(bits, unit * predicates + 1, predicates)


def atom_string(name: Column, arguments: Column, value: Column) -> Column:
    """``name(a, b)`` with a ``~`` prefix when the bit is off."""
    text = F.concat(name, F.lit("("), F.array_join(arguments, ", "), F.lit(")"))
    return F.when(value, text).otherwise(F.concat(F.lit("~"), text))


def action_id(onehot: Column) -> Column:
    """Index of a one-hot action: the sum of value times index."""
    weighted = F.transform(onehot, lambda a, i: a.cast("double") * i)
    return F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v).cast("int")


def apply_effects(pre: Column, add: Column, delete: Column) -> Column:
    """Successor bit: delete wins over add, add wins over the old value."""
    return F.least(F.lit(1) - delete, F.greatest(add, pre))


def apply_effects_additive(pre: Column, add: Column, delete: Column) -> Column:
    """Successor bit as the rounded logistic of ``pre - 0.5 + add - delete``."""
    return F.rint(F.lit(1.0) / (F.lit(1.0) + F.exp(-(pre - F.lit(0.5) + add - delete)))).cast("int")


def hard_onehot(scores: Column) -> Column:
    """Test-time softmax: a one at the first maximum."""
    top = F.array_position(scores, F.array_max(scores)) - 1
    return F.transform(scores, lambda v, i: (i == top).cast("int"))


def hard_sigmoid(score: Column) -> Column:
    """Test-time sigmoid: round half to even."""
    return F.rint(score).cast("int")


def diff_map(x: Column, y: Column) -> Column:
    """Signed difference folded into 0..1."""
    return F.zip_with(x, y, lambda a, b: (b - a + 1) / 2)


def abs_diff(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.abs(a - b))


def weighted_arguments(weights: Column, features: Column, width: int) -> Column:
    """Attention-weighted feature vector of one argument: sum over objects of weight times feature.

    ``weights`` holds one number per object, ``features`` one array of ``width`` numbers per object.
    """
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda f: F.aggregate(
            F.zip_with(weights, features, lambda w, obj: w * F.get(obj, f)),
            F.lit(0.0),
            lambda acc, v: acc + v,
        ),
    )
