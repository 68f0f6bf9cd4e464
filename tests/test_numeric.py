"""Numpy brute force for the numeric operators."""

import numpy as np
import pytest
from scene_helpers import rows
from pyspark.sql import functions as F

from sceneframe.operators import bits as N
from sceneframe.operators import errors as E
from sceneframe.operators import grids as G
from sceneframe.operators import noise as X
from sceneframe.operators import pixels as PX
from sceneframe.operators import scoring as SC


def pixel_table(spark, a):
    data = [(i, y, x, float(a[i, y, x])) for i in range(a.shape[0]) for y in range(a.shape[1]) for x in range(a.shape[2])]
    return spark.createDataFrame(data, "img int, y int, x int, v double")


def array_of(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.img, r.y, r.x] = r.v
    return out


def equalized(a):
    hist, edges = np.histogram(a.ravel(), 256)
    cdf = hist.cumsum() / hist.sum()
    return np.interp(a.ravel(), (edges[:-1] + edges[1:]) / 2, cdf).reshape(a.shape)


def test_equalize_and_preprocess(spark):
    a = np.random.default_rng(0).gamma(2.0, 1.0, (3, 6, 5))
    df = pixel_table(spark, a)
    e = equalized(a)
    np.testing.assert_allclose(array_of(PX.equalize_histogram(df), a.shape), e, atol=1e-12)
    n = (e - e.min()) / (e.max() - e.min())
    np.testing.assert_allclose(array_of(PX.preprocess(df), a.shape), np.clip((n - 0.5) * 3, -0.5, 0.5) + 0.5, atol=1e-9)


def test_constant_image(spark):
    a = np.full((1, 2, 2), 7.0)
    df = pixel_table(spark, a)
    assert array_of(PX.normalize_pixels(df), a.shape).max() == 0
    np.testing.assert_allclose(array_of(PX.equalize_histogram(df), a.shape), equalized(a))
    assert array_of(PX.preprocess(df), a.shape).max() == 0


@pytest.mark.parametrize("element", ["se", "bce"])
def test_set_distances(spark, element):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0.05, 0.95, (2, 4, 5, 3))
    f = {"se": lambda a, b: (a - b) ** 2, "bce": lambda a, b: -(a * np.log(b) + (1 - a) * np.log(1 - b))}[element]
    d = f(x[:, :, None], y[:, None]).sum(-1)
    nx, ny = d.min(2), d.min(1)
    want = [np.maximum(nx.max(1), ny.max(1)).mean(), nx.max(1).mean(), ny.max(1).mean(),
            np.maximum(nx.sum(1), ny.sum(1)).mean(), nx.sum(1).mean(), ny.sum(1).mean()]
    df = spark.createDataFrame([(x[i].tolist(), y[i].tolist()) for i in range(4)], "x array<array<double>>, y array<array<double>>")
    got = E.set_distances(df, "x", "y", {"se": E.squared_error, "bce": E.bounded_cross_entropy}[element]).first()
    np.testing.assert_allclose(list(got), want, atol=1e-9)


def test_permuted_sets_have_distance_zero_and_equal_canonical_order(spark):
    objs = np.random.default_rng(2).integers(0, 2, (6, 9)).astype(float)
    perm = X.shared_permutation(6, 3)
    df = spark.createDataFrame([(objs.tolist(),)], "x array<array<double>>").withColumn("y", X.shuffle_object_array(F.col("x"), perm))
    assert E.set_distances(df, "x", "y").first().hausdorff == 0
    r = df.select(N.canonical_object_order(F.col("x")).alias("a"), N.canonical_object_order(F.col("y")).alias("b")).first()
    numbers = sorted(int("".join(str(int(b)) for b in o), 2) for o in objs)
    assert r.a == r.b and [int(s, 2) for s in r.a] == numbers


@pytest.mark.parametrize("rule, size", [("block", 4), ("plain", 3), ("rounded", 3), ("twisted", 6)])
def test_match_errors(spark, rule, size):
    rng = np.random.default_rng(4)
    tile, pattern = rng.uniform(0, 1, (2, size, size))
    if rule == "rounded":
        want = np.abs(np.round(tile) - np.round(pattern)).mean()
    elif rule == "plain":
        want = np.round(np.abs(tile - pattern)).mean()
    else:
        b = 2 if rule == "block" else 3
        d = np.abs((np.round(tile) if rule == "twisted" else tile) - pattern)
        want = np.round(d.reshape(size // b, b, size // b, b).mean((1, 3))).mean()
    df = spark.createDataFrame([(tile.ravel().tolist(), pattern.ravel().tolist())], "t array<double>, p array<double>")
    assert df.select(G.match_error(F.col("t"), F.col("p"), rule, size, size).alias("e")).first().e == pytest.approx(want)


def test_exact_coverage(spark):
    m = spark.createDataFrame([("a", 0, [0]), ("a", 1, [1]), ("a", 2, [1]), ("b", 0, [0]), ("b", 1, [0]), ("b", 2, [1])], "s string, cell int, panels array<int>")
    assert rows(G.grid_validity(m, "s", [0, 1], "exact", [1, 2]).select("s", "valid")) == [("a", True), ("b", False)]
    assert rows(G.grid_validity(m, "s", [0, 1], None).select("s", "valid")) == [("a", True), ("b", True)]


def bilinear(crop, size):
    h, w, c = crop.shape
    out = np.zeros((size, size, c), dtype=np.uint8)
    for i in range(size):
        for j in range(size):
            fy, fx = min(max((i + 0.5) * h / size - 0.5, 0), h - 1), min(max((j + 0.5) * w / size - 0.5, 0), w - 1)
            y0, x0 = int(fy), int(fx)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            dy, dx = fy - y0, fx - x0
            v = (crop[y0, x0] * (1 - dx) + crop[y0, x1] * dx) * (1 - dy) + (crop[y1, x0] * (1 - dx) + crop[y1, x1] * dx) * dy
            out[i, j] = np.rint(v)
    return out


def test_crop_resize(spark):
    img = np.random.default_rng(5).integers(0, 256, (9, 12, 3), dtype=np.uint8)
    boxes = [(0, -2, -1, 5, 6), (1, 4, 4, 4, 9), (2, 3, 1, 40, 40)]
    df = spark.createDataFrame([("i", 9, 12, 3, bytearray(img.tobytes()), boxes)],
                               "image string, height int, width int, channels int, data binary, boxes array<struct<slot:int,x1:int,y1:int,x2:int,y2:int>>")
    got = {r.slot: np.frombuffer(bytes(r.patch), np.uint8).reshape(7, 7, 3) for r in PX.crop_resize(df, 7).collect()}
    np.testing.assert_array_equal(got[0], bilinear(img[0:6, 0:5].astype(float), 7))
    assert got[1].max() == 0
    np.testing.assert_array_equal(got[2], bilinear(img[1:9, 3:12].astype(float), 7))


def test_noise_is_keyed_and_has_the_right_shares(spark):
    base = spark.range(40000)
    x = F.lit(0.5)
    df = base.select("id", X.noise_gaussian(x, F.col("id")).alias("g"), X.noise_salt(x, F.col("id")).alias("s"),
                     X.noise_pepper(x, F.col("id")).alias("p"), X.noise_flip(F.lit(0.2), F.col("id")).alias("f"))
    again = base.repartition(13).select("id", X.noise_gaussian(x, F.col("id")).alias("g")).agg(F.sum(F.round("g", 9))).first()[0]
    r = df.agg(F.avg("g"), F.stddev("g"), F.avg((F.col("s") == 1).cast("int")), F.avg((F.col("p") == 0).cast("int")),
               F.avg((F.col("f") == 0.8).cast("int")), F.sum(F.round("g", 9))).first()
    assert abs(r[0] - 0.5) < 0.01 and 0.24 < r[1] < 0.3
    assert all(abs(v - 0.06) < 0.005 for v in r[2:5])
    assert r[5] == pytest.approx(again)


def test_scores_keep_keys_and_explanations_find_the_rule(spark):
    states = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "s int, x array<double>")
    got = SC.score_states(states, ["s"], "x", {"total": (lambda m: m.sum(1), "double"), "codes": (lambda m: (m > 20).astype("int32"), "array<int>")})
    assert [(r.s, r.total, list(r.codes)) for r in got.orderBy("s").collect()] == [(i, i + 1.0, [int(i > 20), 0]) for i in range(50)]
    table = spark.range(200).select((F.col("id") % 4).alias("a"), (F.col("id") % 5).alias("b"), ((F.col("id") % 4) > 1).cast("int").alias("p"))
    tree = SC.explain_predicates(table, ["a", "b"], ["p"]).first()
    assert tree.accuracy == 1.0 and tree.depth == 1 and "(a " in tree.rules


def plain_tree(x, y, depth, node=1):
    """Reference: grow one tree by trying every split."""
    n, k = len(y), int(y.sum())
    best = None
    if depth and 0 < k < n:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for v, after in zip(values, values[1:]):
                left = x[:, f] <= v
                cost = round(sum(y[s].sum() * (s.sum() - y[s].sum()) / s.sum() for s in (left, ~left)), 9)
                if best is None or (cost, f, v) < best[:3]:
                    best = (cost, f, v, (v + after) / 2)
    if best is None:
        return [(node, n, k, None, None)]
    left = x[:, best[1]] <= best[2]
    return ([(node, n, k, f"f{best[1]}", best[3])] + plain_tree(x[left], y[left], depth - 1, 2 * node) + plain_tree(x[~left], y[~left], depth - 1, 2 * node + 1))


def test_trees_of_all_predicates_equal_one_by_one(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 5, (300, 4)).astype(float)
    y = np.stack([(x[:, 0] > 2) ^ (x[:, 1] > 1), x[:, 2] + x[:, 3] > 4, np.zeros(300, bool), np.ones(300, bool), rng.random(300) < 0.3], axis=1).astype(int)
    df = spark.createDataFrame([(*map(float, a), *map(int, b)) for a, b in zip(x, y)], [f"f{i}" for i in range(4)] + [f"p{i}" for i in range(5)])
    for depth in (0, 3, 60):
        got = SC.predicate_trees(df, [f"f{i}" for i in range(4)], [f"p{i}" for i in range(5)], depth).collect()
        want = [(f"p{i}", *r) for i in range(5) for r in plain_tree(x, y[:, i], depth)]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_tree_counts_leave_a_task_by_value_not_by_row(spark):
    rows = spark.range(0, 5000, 1, 1).selectExpr("cast(id % 2 as int) AS p", "cast(1 + id % 3 as bigint) AS node", "1L AS n", "id % 2 AS n_true",
                                                  "array(double(id % 4), double('nan'), double(id)) AS x")
    counted = rows.mapInArrow(SC._counted, SC.COUNTS).collect()
    want = {}
    for r in rows.collect():
        for f, v in enumerate(r.x):
            key = (r.p, r.node, f, repr(v))
            n, true = want.get(key, (0, 0))
            want[key] = (n + r.n, true + r.n_true)
    assert {(r.p, r.node, r.f, repr(r.value)): (r.n, r.n_true) for r in counted} == want and len(counted) == len(want)


def test_trees_take_nulls(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (None, 1), (3.0, None), (None, None)], "a double, p int")
    got = {r.node: (r.n, r.n_true, r.feature, r.threshold) for r in SC.predicate_trees(df, ["a"], ["p"]).collect()}
    assert got[1] == (3, 2, "a", 1.5) and got[2] == (1, 1, None, None) and len(got) == 5
    assert SC.explain_predicates(df.limit(0), ["a"], ["p"]).count() == 0


def test_code_variance_and_prediction(spark):
    rng = np.random.default_rng(6)
    enc = rng.integers(0, 2, (5, 10, 7))
    df = spark.createDataFrame([(s, enc[s, r].tolist()) for s in range(5) for r in range(10)], "s int, bits array<int>")
    v = enc.var(axis=1)
    np.testing.assert_allclose(list(N.code_variance(df, "s").first()), [v.max(), v.min(), v.mean(), np.median(v)], atol=1e-9)
    t, p = rng.uniform(0, 1, (2, 6, 4))
    match = 1 - np.abs(p - t)
    df = spark.createDataFrame([(t[i].tolist(), p[i].tolist()) for i in range(6)], "t array<double>, p array<double>")
    np.testing.assert_allclose(list(N.prediction_match(df, "t", "p").first()),
                               [np.abs(p - t).mean(), match.mean(0).prod(), match.prod(1).mean()], atol=1e-12)
