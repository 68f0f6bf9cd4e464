import math

import numpy as np
import pytest

from llm_helpers import clashing, rows
from sceneframe.llm import embedding_dedup as d

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, threshold=0.9):
    good = [k for k, (_, x, *_) in enumerate(data) if x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    near = {k: set() for k in range(len(data))}
    vectors = {k: np.array(data[k][1], np.float32).astype(float) for k in good}
    for k in good:
        for m in good:
            if k < m and len(vectors[k]) == len(vectors[m]):
                x, y = vectors[k] / np.abs(vectors[k]).max(), vectors[m] / np.abs(vectors[m]).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[k].add(m)
                    near[m].add(k)
    out, seen = [], {}
    for k in range(len(data)):
        if k not in seen:
            todo, group = [k], {k}
            while todo:
                for m in near[todo.pop()] - group:
                    group.add(m)
                    todo.append(m)
            least = min((data[m][0] for m in group if data[m][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((data[k][0], len(near[k]), seen[k], data[k][0] is not None and data[k][0] == seen[k]))
    return sorted(out, key=repr)


def family(rnd, centre, n, noise):
    return centre + noise * rnd.standard_normal((n, len(centre)))


def data_of(seed, crowd=0):
    """Singles, families of near copies of any tightness, exact copies, odd rows; ``crowd`` near copies in one family."""
    rnd = np.random.default_rng(seed)
    points = [rnd.standard_normal((80, 64))]
    for noise in (0.02, 0.1, 0.2):
        points.append(family(rnd, rnd.standard_normal(64), 9, noise))
    if crowd:
        centre = rnd.standard_normal(64)
        points += [family(rnd, centre, crowd, 0.05), family(rnd, centre, crowd // 2, 0.22)]
    data = [(int(k) * 37 % 100_003, [float(v) for v in x], 0) for k, x in enumerate(np.concatenate(points))]
    same = data[3][1]
    data += [(200_000 + k, same, 1) for k in range(30)] + [data[5], data[5], (None, same, 1), (None, [2 * v for v in same], 1)]
    odd = [None, [], [0.0] * 64, [None] + same[1:], [float("nan")] + same[1:], [float("-inf")] + same[1:], same[:8], same[:8], [-0.0] * 3]
    return data + [(300_000 + k, x, 2) for k, x in enumerate(odd)] + [(None, [0.0], 2), (300_100, [1e30] * 64, 2), (300_101, [1e-30] * 64, 2)]


@pytest.mark.parametrize("seed,crowd,cell", [(0, 0, 256), (1, 90, 16), (2, 40, 8)])
def test_equals_brute_force(spark, seed, crowd, cell):
    data = data_of(seed, crowd)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert rows(d.near_duplicates(df, recall=0.999999, cell=cell)) == brute(data)  # pairs may miss each other with probability 1e-6


def test_recall_of_links_at_the_stated_setting(spark):
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal((1500, 64))
    noise = rnd.standard_normal((1500, 64))
    both = np.concatenate([base, base + 0.45 * noise])  # cosines of 0.86 to 0.95
    data = [(k, [float(v) for v in x], 0) for k, x in enumerate(both)]
    want = {r[0]: r[1] for r in brute_links(both)}
    got = {r.vec_id: r.n_links for r in d.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.95 * sum(want.values()) > 1000


def brute_links(x):
    x = x.astype(np.float32).astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return enumerate(((x @ x.T >= 0.9).sum(1) - 1).tolist())


def test_one_family_is_never_compared_pair_by_pair(spark):
    """A family far larger than a cell lies in one ball, whose units do not meet."""
    rnd = np.random.default_rng(9)
    data = [(k, [float(v) for v in x], 0) for k, x in enumerate(family(rnd, rnd.standard_normal(64), 400, 0.05))]
    _, nodes = d.nodes_of(spark.createDataFrame(data, SCHEMA), "vec_id", "embedding")
    bits, tables = d.shape_of(nodes.count())
    nodes = d.signed(nodes, bits, tables, 11)
    crowded = d.keyed(nodes).groupBy(*d.KEY).count().filter("count > 20")
    ball = d.balls(nodes, crowded, 0.9)
    assert ball.select("ball").distinct().count() == 1 and ball.count() == 400
    named = d.keyed(nodes.join(ball, "node"), "ball", "weight", "body", "keys").join(crowded.select(*d.KEY), d.KEY)
    assert d.cells(named, d.unit_counts(crowded, named, 20)).count() == 0


def test_shape_follows_the_table():
    assert d.shape_of(0)[0] == 4 and d.shape_of(10**9)[0] > d.shape_of(10**5)[0]
    for n in (1, 1000, 10**6):
        bits, tables = d.shape_of(n)
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables >= 0.98


def test_empty_and_clashing(spark):
    data = data_of(4)[:60]
    df = spark.createDataFrame(data, SCHEMA)
    wide = clashing(df).withColumn("node", df.vec_id).withColumn("weight", df.vec_id)
    assert rows(d.near_duplicates(wide, recall=0.999999)) == brute(data)
    assert d.near_duplicates(df.limit(0)).count() == 0
    assert rows(d.near_duplicates(spark.createDataFrame([(1, None, 1), (None, None, 1)], SCHEMA))) == [(1, 0, 1, True), (None, 0, None, False)]
