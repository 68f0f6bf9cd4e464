"""Writers. Each has a function that builds the rows or lines and one that writes them with Spark.

All tables of an output become visible together, once each is complete; a job that fails leaves the old output as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.session import replacing

DESCRIPTION = "Logical atoms read from latent codes"


def _replace(rows: DataFrame, path: str, kind: str) -> None:
    with replacing(rows.sparkSession, path) as new:
        rows.write.format(kind).save(new)


def _three_digits(value: Column) -> Column:
    """``%.3f`` with exact ties (multiples of 1/16) going to the even digit."""
    exact = value * 16 == F.rint(value * 16)
    return F.format_string("%.3f", F.when(exact, F.bround(value, 3)).otherwise(value))


def atoms_header(results: DataFrame, units: int, arguments: int, predicates: int, objects: int) -> DataFrame:
    """One row: description, number of states and model parameters."""
    return results.agg(F.count("*").alias("num_states")).select(
        F.lit(DESCRIPTION).alias("description"), "num_states",
        F.struct(F.lit(units).alias("U"), F.lit(arguments).alias("A"), F.lit(predicates).alias("P"),
                 F.lit(objects).alias("num_objs")).alias("model_parameters"),
    )


def write_atoms_json(results: DataFrame, path: str, units: int, arguments: int, predicates: int, objects: int) -> None:
    """States as JSON lines under ``states`` and the header row under ``header``."""
    with replacing(results.sparkSession, path, ["states", "header"]) as new:
        results.write.json(f"{new}/states")
        atoms_header(results, units, arguments, predicates, objects).write.json(f"{new}/header")


def atom_blocks(results: DataFrame, state: str, show_negated: bool = False, show_confidence: bool = True) -> DataFrame:
    """``value``: the text block of each state, ending in a blank line; built inside the row."""
    shown = F.col("atoms" if show_negated else "active_atoms")

    def line(atom: Column) -> Column:
        text = F.concat(F.lit("  "), atom["atom_str"])
        if show_confidence:
            text = F.concat(text, F.lit("  [conf="), _three_digits(atom["confidence"]), F.lit("]"))
        return text

    body = F.when(F.size(shown) == 0, F.lit("  (no active predicates)")).otherwise(
        F.array_join(F.transform(shown, line), "\n")
    )
    return results.select(
        state, F.concat(F.lit("State "), F.col(state).cast("string"), F.lit(":\n"), body, F.lit("\n")).alias("value")
    )


def write_atoms_text(results: DataFrame, state: str, path: str, show_negated: bool = False) -> None:
    """Text blocks in state order over ordered part files."""
    _replace(atom_blocks(results, state, show_negated).orderBy(state).select("value"), path, "text")


def usage_report(usage: DataFrame, states: int) -> DataFrame:
    """One row with the totals, the full rate matrix and the three class lists.

    The input has one row per bit of the code, a fixed small number.
    """
    info = F.struct("unit", "predicate", "activation_rate")
    lists = [
        F.array_sort(F.collect_list(F.when(F.col("usage") == c, info))).alias(c) for c in ["always_on", "always_off", "variable"]
    ]
    counts = [F.count_if(F.col("usage") == c).alias(f"num_{c}") for c in ["always_on", "always_off", "variable"]]
    return usage.agg(
        F.lit(states).alias("total_states"),
        F.array_sort(F.collect_list(info)).alias("predicate_activation_rates"), *lists, *counts,
    )


def write_usage_report(usage: DataFrame, states: int, path: str) -> None:
    _replace(usage_report(usage, states), path, "json")


def state_mapping(states: DataFrame, ordinal: str, image: str, names: str) -> DataFrame:
    return states.select(F.col(ordinal).alias("state_idx"), F.col(image).alias("image"), F.col(names).alias("object_names"))


def write_state_mapping(states: DataFrame, ordinal: str, image: str, names: str, path: str) -> None:
    _replace(state_mapping(states, ordinal, image, names), path, "json")


def code_lines(states: DataFrame, *bits: str, action: str | None = None) -> DataFrame:
    """``value``: the codes of a row joined by spaces, with the action id last when asked for."""
    parts = [F.array_join(F.col(b).cast("array<string>"), " ") for b in bits]
    if action:
        parts.append(F.col(action).cast("string"))
    return states.select(F.concat_ws(" ", *parts).alias("value"))


def write_codes_csv(states: DataFrame, path: str, bits: str = "bits") -> None:
    """Space-separated 0/1 codes, one state per line."""
    _replace(code_lines(states, bits), path, "text")


def write_transition_codes_csv(transitions: DataFrame, path: str, pre: str = "pre", suc: str = "suc",
                               action: str | None = None) -> None:
    """Pre bits, suc bits and optionally the action id of each transition."""
    _replace(code_lines(transitions, pre, suc, action=action), path, "text")


def run_tag(network: str, units: int, arguments: int, predicates: int, examples: int | None = None) -> str:
    """Directory name of a run."""
    return f"{network}_U{units}_A{arguments}_P{predicates}" + (f"_n{examples}" if examples is not None else "")


def manifest(summary: DataFrame, category: str | None, strict: bool, fps: int, transition_mode: str) -> DataFrame:
    """One-row load manifest; the video ids stay a table of their own."""
    return summary.agg(F.count("*").alias("num_videos"), F.coalesce(F.sum("states"), F.lit(0)).alias("num_states")).select(
        F.lit(category).cast("string").alias("category_filter"), F.lit(strict).alias("strict"), "num_videos", "num_states",
        F.lit(fps).alias("fps"), F.lit(transition_mode).alias("transition_mode"),
    )


def write_manifest(summary: DataFrame, names: DataFrame, path: str, category: str | None, strict: bool, fps: int,
                   transition_mode: str) -> None:
    """Manifest row, loaded videos with primaries, and object names, each as its own JSON table."""
    with replacing(summary.sparkSession, path, ["manifest", "videos", "object_names"]) as new:
        manifest(summary, category, strict, fps, transition_mode).write.json(f"{new}/manifest")
        summary.write.json(f"{new}/videos")
        names.write.json(f"{new}/object_names")
