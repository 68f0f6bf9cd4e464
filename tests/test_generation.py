"""The law of the next generation of trials."""

from collections import Counter

import pytest

from sceneframe.operators import trials as TR

VALUES = "a array<int>, b array<int>"


def make(spark, evals, b=0):
    rows = [(k, e, {"a": str(k), "b": str(b)}) for k, e in enumerate(evals)]
    return spark.createDataFrame(rows, "trial int, eval double, config map<string,string>")


def test_parents_are_drawn_by_inverse_evaluation(spark):
    """With neighbours in one entry only, a mutation shows its parent; weights are 1, 1/2 and 1/4 of seven quarters."""
    trials = make(spark, [1.0, 2.0, 4.0, 9.0])
    values = spark.createDataFrame([([0, 1, 2, 3], list(range(5000)))], VALUES)
    got = TR.next_generation(trials, values, 6000, 3, seed=3, attempts=1).collect()
    count = Counter(r.config["a"] for r in got if r.config["b"] != "0")
    n = sum(count.values())
    assert n > 2000 and all(abs(count[k] / n - w) < 0.05 for k, w in (("0", 4 / 7), ("1", 2 / 7), ("2", 1 / 7))) and not count["3"]


def test_equal_evaluations_mutate_and_seeds_repeat(spark):
    trials = make(spark, [2.0, 2.0, 2.0])
    values = spark.createDataFrame([([0, 1, 2], [0, 1, 2, 3])], VALUES)
    first, again, other = (sorted(map(str, TR.next_generation(trials, values, 30, 3, seed=s).collect())) for s in (1, 1, 2))
    assert first == again != other and all("mutation" in x for x in first)


def test_known_and_repeated_children_are_left_out(spark):
    trials = make(spark, [1.0, 3.0, None])
    values = spark.createDataFrame([([0, 1, 2], [0, 1])], VALUES)
    got = TR.next_generation(trials, values, 200, 5).collect()
    keys = [(r.config["a"], r.config["b"]) for r in got]
    assert len(keys) == len(set(keys)) and set(keys) == {("0", "1"), ("1", "1")}  # (2, 0) has failed, but is known


def test_no_parents_and_bad_evaluations(spark):
    values = spark.createDataFrame([([0, 1], [0, 1])], VALUES)
    assert TR.next_generation(make(spark, [None]), values, 5, 3).count() == 0
    assert TR.next_generation(make(spark, [1.0]), values, 5, 3).where("kind = 'mutation'").count() > 0
    with pytest.raises(Exception, match="below 0"):
        TR.next_generation(make(spark, [-1.0, 2.0]), values, 5, 3).collect()
