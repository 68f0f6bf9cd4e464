"""Long windows: the sliding median against percentiles built anew, and the stops that use it."""

import numpy as np
import pytest
from scene_helpers import rows

from sceneframe.operators import curves as K


def percentile(values):
    """As Spark sorts and interpolates: nulls do not count, NaN is the largest value."""
    held = sorted((v for v in values if v is not None), key=lambda v: (np.isnan(v), v))
    if not held:
        return None
    low, high = held[(len(held) - 1) // 2], held[len(held) // 2]
    return low if low == high else 0.5 * low + 0.5 * high


@pytest.mark.parametrize("sample", [1, 2, 7, 50, 500])
def test_sliding_median_equals_percentiles(sample):
    rnd = np.random.default_rng(sample)
    values = [rnd.choice([None, float("nan"), 0.5, float("inf"), float(rnd.integers(-9, 9))], p=[.1, .05, .2, .05, .6]) for _ in range(300)]
    known = np.array([v is not None for v in values])
    median, there = K.sliding_median(np.array([np.nan if v is None else v for v in values]), known, sample)
    want = [percentile(values[max(0, i - sample + 1):i + 1]) for i in range(300)]
    assert there.tolist() == [w is not None for w in want]
    assert np.array_equal(median[there], [w for w in want if w is not None], equal_nan=True)


def test_no_values():
    median, there = K.sliding_median(np.full(3, np.nan), np.zeros(3, bool), 2)
    assert not there.any() and np.isnan(median).all()
    assert K.sliding_median(np.zeros(0), np.zeros(0, bool), 2)[0].size == 0


@pytest.mark.parametrize("chunk", [37, 1000])
@pytest.mark.parametrize("stop", [
    lambda log, **k: K.high_value_stop(log, "run", "epoch", "loss", threshold=0.55, **k),
    lambda log, **k: K.linear_bound_stop(log, "run", "epoch", "loss", 900, value_start=0.8, **k)])
def test_both_forms_stop_at_the_same_epoch(spark, monkeypatch, chunk, stop):
    rnd = np.random.default_rng(3)
    log = [(f"r{r}", 3 * e + r, None if rnd.random() < .1 else float(rnd.random() * (.7 + .1 * r)), "extra") for r in range(4) for e in range(300)]
    log = spark.createDataFrame([*log, (None, 1, 0.5, ""), ("short", 1, None, "")], "run string, epoch long, loss double, _note string").repartition(3)
    long = rows(stop(log, sample=70, chunk=chunk))
    monkeypatch.setattr(K, "LONG_WINDOW", 10_000)
    assert long == rows(stop(log, sample=70, chunk=chunk)) and any(r[1] is not None for r in long)
    assert stop(log.limit(0), sample=70, chunk=chunk).count() == 0
