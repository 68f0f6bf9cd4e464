"""Encoder output to logical atoms.

A state row holds ``bits`` (unit-major array), ``attention`` (unit, argument, object) and optionally
``object_names``. Bits, bindings and names of a state sit in one row, so atoms need neither a join
nor a shuffle; they are exploded only when rows are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.functions.codes import argmax_first, atom_string

# Default confidence thresholds of the library and of the command line.
LIBRARY_THRESHOLD = 0.6
REPORT_THRESHOLD = 0.5


def bind_arguments(states: DataFrame, attention: str = "attention") -> DataFrame:
    """Add ``bindings`` (first maximum per argument), ``confidences`` and ``unit_confidence``."""
    return (
        states.withColumn("bindings", F.transform(attention, lambda u: F.transform(u, argmax_first)))
        .withColumn("confidences", F.transform(attention, lambda u: F.transform(u, F.array_max)))
        .withColumn("unit_confidence", F.transform("confidences", F.array_min))
    )


def bindings_long(bound: DataFrame, state: str) -> DataFrame:
    """``(state, unit, arg, obj, conf)``."""
    units = bound.select(state, F.posexplode(F.arrays_zip("bindings", "confidences")).alias("unit", "_u"))
    args = units.select(state, "unit", F.posexplode(F.arrays_zip("_u.bindings", "_u.confidences")).alias("arg", "_a"))
    return args.select(state, "unit", "arg", F.col("_a.bindings").alias("obj"), F.col("_a.confidences").alias("conf"))


def _argument_names(bound: Column, names: Column | None) -> Column:
    default = lambda o: F.concat(F.lit("obj_"), o.cast("string"))
    if names is None:
        return F.transform(bound, default)
    return F.transform(bound, lambda o: F.coalesce(F.get(names, o), default(o)))


def _predicate_name(p: Column, names: list[str] | None) -> Column:
    default = F.concat(F.lit("pred_"), p.cast("string"))
    if not names:
        return default
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), p), default)


def atoms(bound: DataFrame, state: str, predicates: int, names: str | None = None,
          predicate_names: list[str] | None = None, threshold: float = LIBRARY_THRESHOLD) -> DataFrame:
    """One row per atom of the units whose confidence reaches ``threshold``.

    Units are filtered before their predicates are exploded.
    """
    keep = [state] + ([names] if names else [])
    unit_rows = bound.select(
        *keep, "bits",
        F.posexplode(F.arrays_zip("bindings", "unit_confidence")).alias("unit", "_u"),
    ).where(F.col("_u.unit_confidence") >= threshold)
    arguments = F.col("_u.bindings")
    named = unit_rows.select(
        state, "unit", arguments.alias("arguments"),
        _argument_names(arguments, F.col(names) if names else None).alias("argument_names"),
        F.col("_u.unit_confidence").alias("confidence"),
        F.slice("bits", F.col("unit") * predicates + 1, F.lit(predicates)).alias("_bits"),
    )
    rows = named.select(
        state, "unit", "arguments", "argument_names", "confidence", F.posexplode("_bits").alias("predicate_idx", "_bit")
    )
    value = F.col("_bit") != 0
    predicate = _predicate_name(F.col("predicate_idx"), predicate_names)
    return rows.select(
        state, "unit", "predicate_idx", predicate.alias("predicate_name"), "arguments", "argument_names",
        value.alias("value"), "confidence", atom_string(predicate, F.col("argument_names"), value).alias("atom_str"),
    )


def active_atoms(rows: DataFrame) -> DataFrame:
    return rows.where("value")


def confidence_filter(units: DataFrame, confidence: str, threshold: float) -> DataFrame:
    return units.where(F.col(confidence) >= threshold)


def state_results(bound: DataFrame, state: str, predicates: int, names: str | None = None,
                  predicate_names: list[str] | None = None, threshold: float = LIBRARY_THRESHOLD) -> DataFrame:
    """One nested row per state: all atoms, active atoms and their strings, code, bindings, confidences."""
    names_col = F.col(names) if names else None

    def unit_atoms(unit: Column) -> Column:
        arguments = F.get(F.col("bindings"), unit)
        argument_names = _argument_names(arguments, names_col)
        confidence = F.get(F.col("unit_confidence"), unit)

        def atom(p: Column) -> Column:
            value = F.get(F.col("bits"), unit * predicates + p) != 0
            predicate = _predicate_name(p, predicate_names)
            return F.struct(
                unit.alias("unit"), p.alias("predicate_idx"), predicate.alias("predicate_name"),
                arguments.alias("arguments"), argument_names.alias("argument_names"), value.alias("value"),
                confidence.alias("confidence"), atom_string(predicate, argument_names, value).alias("atom_str"),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(predicates - 1)), atom)

    unit_ids = F.filter(
        F.sequence(F.lit(0), F.size("bindings") - 1), lambda u: F.get(F.col("unit_confidence"), u) >= threshold
    )
    full = bound.withColumn("atoms", F.flatten(F.transform(unit_ids, unit_atoms)))
    active = full.withColumn("active_atoms", F.filter("atoms", lambda a: a["value"]))
    return active.select(
        state, "atoms", "active_atoms", F.transform("active_atoms", lambda a: a["atom_str"]).alias("active_atom_strs"),
        F.col("bits").alias("latent_code"), "bindings", "confidences",
        (names_col if names else F.lit(None).cast("array<string>")).alias("object_names"),
    )


def bits_with_bindings(bits: DataFrame, bindings: DataFrame, state: str) -> DataFrame:
    """Long form: each bit ``(state, unit, pred, bit)`` with the argument list of its unit.

    ``bindings`` has one row per argument; a unit has a fixed few of them, so they fold into one
    array before the join.
    """
    per_unit = bindings.groupBy(state, "unit").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("arg", "obj"))), lambda a: a["obj"]).alias("arguments"),
        F.min("conf").alias("confidence"),
    )
    return bits.join(per_unit, [state, "unit"])
