"""The panel index against every pair."""

import numpy as np
import pytest

from sceneframe.operators import grids as G

SHAPES = {"rounded": (5, 5), "plain": (4, 7), "block": (6, 8), "twisted": (9, 6)}


def error(tile, pattern, rule, h, w):
    if rule == "rounded":
        return np.abs(np.rint(tile) - np.rint(pattern)).mean()
    if rule == "plain":
        return np.rint(np.abs(tile - pattern)).mean()
    b = 2 if rule == "block" else 3
    d = np.abs((np.rint(tile) if rule == "twisted" else tile) - pattern).reshape(h // b, b, w // b, b)
    return np.rint(d.mean((1, 3))).mean()


def images(rnd, n, size, kind):
    x = rnd.integers(0, 2, (n, size)).astype(float)
    if kind == "noisy":
        x += rnd.normal(0, 0.1, x.shape)
    elif kind == "grey":
        x = rnd.integers(0, 9, (n, size)) / 8 * rnd.choice([1.0, 2.0], (n, 1))
    return x


@pytest.mark.parametrize("rule", SHAPES)
@pytest.mark.parametrize("kind", ["binary", "noisy", "grey"])
def test_index_equals_all_pairs(spark, rule, kind):
    h, w = SHAPES[rule]
    rnd = np.random.default_rng(len(rule) * 10 + len(kind))
    panels = images(rnd, 60, h * w, kind)
    tiles = np.concatenate([panels[:20] + rnd.normal(0, 0.05, (20, h * w)), panels[20:30], images(rnd, 20, h * w, kind), np.full((1, h * w), 0.5)])
    for t in tiles[:8]:
        t[rnd.integers(h * w)] += 1.0
    limit = 0.08
    want = {i: [p for p in range(60) if error(t, panels[p], rule, h, w) <= limit] for i, t in enumerate(tiles)}
    assert sum(map(len, want.values())) >= 10
    df = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(tiles)] + [(900, None), (901, [1.0])], "cell int, tile array<double>")
    lib = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(panels)], "panel int, pattern array<double>")
    got = {r.cell: r.panels for r in G.match_templates(df, lib, rule, h, w, limit).collect()}
    assert got == want | {900: [], 901: []}


def test_a_large_library_is_joined_by_bucket(spark):
    """5000 panels: each is found again, few pairs are compared, and no array holds the library."""
    rnd = np.random.default_rng(3)
    panels = np.unique(images(rnd, 5000, 64, "binary") * (rnd.random((5000, 1)) < rnd.random((5000, 64))), axis=0)
    lib = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(panels)], "panel int, pattern array<double>")
    tiles = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(panels[::5])], "cell int, tile array<double>")
    found = G.match_templates(tiles, lib, "plain", 8, 8)
    assert {r.cell: r.panels for r in found.collect()} == {i: [5 * i] for i in range(len(panels[::5]))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Subquery" not in plan


def test_more_panels_than_a_slot_holds(spark, monkeypatch):
    monkeypatch.setattr(G, "SLOT_PANELS", 4)
    lib = spark.createDataFrame([(i, [1.0, 0.0, 1.0, 0.0]) for i in range(50)], "panel int, pattern array<double>")
    got = G.match_templates(spark.createDataFrame([(0, [1.0, 0.0, 1.0, 0.0])], "cell int, tile array<double>"), lib, "block", 2, 2).first()
    assert got.panels == list(range(50))
