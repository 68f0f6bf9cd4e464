"""Extraction plan: encoder output to atoms, usage report and the four output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sceneframe.operators.atoms import REPORT_THRESHOLD, bind_arguments, state_results
from sceneframe.operators.usage import head_states, predicate_usage
from sceneframe.sources import sinks


def extract(states: DataFrame, state: str, path: str, units: int, arguments: int, predicates: int, objects: int,
            names: str | None = None, image: str | None = None, num: int | None = None,
            threshold: float = REPORT_THRESHOLD, show_negated: bool = False) -> None:
    """Write atoms as JSON and text, the state mapping and the usage report of encoded states.

    ``states`` has the state ordinal, ``bits``, ``attention`` and optionally names and an image id.
    The usage report reads the bits directly and never builds atoms.
    """
    chosen = head_states(states, state, num) if num is not None else states
    results = state_results(bind_arguments(chosen), state, predicates, names, threshold=threshold)
    sinks.write_atoms_json(results, f"{path}/atoms", units, arguments, predicates, objects)
    sinks.write_atoms_text(results, state, f"{path}/atoms_text", show_negated)
    if image is not None and names is not None:
        sinks.write_state_mapping(chosen, state, image, names, f"{path}/state_mapping")
    sinks.write_usage_report(predicate_usage(chosen, predicates), chosen.count(), f"{path}/usage")
