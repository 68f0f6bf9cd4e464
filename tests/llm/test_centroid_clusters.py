import hashlib
import math
import random

import numpy as np
import pytest

from llm_helpers import clashing, rows
from sceneframe.llm import centroid_clusters as c

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, k=16, rounds=3, length=64):
    good = [(i, [math.floor(64 * float(np.float32(v))) for v in x]) for i, x, *_ in data
            if x is not None and len(x) == length and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(range(len(good)), key=lambda n: (good[n][0] is None, hashlib.sha256(f"1:{good[n][0]}".encode()).hexdigest(), good[n][1]))
    centroids = [list(good[n][1]) for n in order[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min(range(len(centroids)), key=lambda j: (square(x, centroids[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, x in good:
            groups.setdefault(near(x), []).append(x)
        for j, members in groups.items():
            centroids[j] = [sum(col) // len(members) for col in zip(*members)]
    found = [(i, near(x), square(x, centroids[near(x)])) for i, x in good]
    total = {}
    for _, j, d in found:
        total[j] = total.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids]
    return sorted(((i, j, d, total[j], sum(total.values()), sha[j]) for i, j, d in found), key=repr)


def odd_data(seed=0, n=120):
    rnd = random.Random(seed)
    point = lambda spread: [rnd.gauss(0, spread) for _ in range(64)]
    data = [(i * 7919 % 10_007, point(rnd.choice([0.1, 1.0, 20.0])), i % 3) for i in range(n)]
    same = point(1.0)
    data += [(20_000 + i, same, None) for i in range(n // 2)]  # a third of all rows alike
    data += [(30_000, None, 1), (30_001, [], 1), (30_002, same[:63], 1), (30_003, same + [1.0], 1), (30_004, [None] + same[1:], 1)]
    data += [(30_005, [float("nan")] + same[1:], 1), (30_006, [float("inf")] + same[1:], 1), (None, point(1.0), 1)]
    return data + [(20_001, same, None), (5, [0.0] * 64, 0), (6, [-0.0] * 64, 0)]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    data = odd_data(seed)
    assert rows(c.clusters(spark.createDataFrame(data, SCHEMA).repartition(5))) == brute(data)


def test_few_rows_clashing_names_and_no_rows(spark):
    data = odd_data(7)[:5]
    df = spark.createDataFrame(data, SCHEMA)
    wide = clashing(df).withColumn("cluster", df.vec_id).withColumn("x", df.vec_id)
    assert rows(c.clusters(wide)) == brute(data)
    none = c.clusters(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert c.clusters(spark.createDataFrame([(1, None, 1), (2, [1.0], 1)], SCHEMA)).count() == 0


def test_updates_touch_changed_components_only():
    rnd = np.random.default_rng(1)
    x, old = rnd.integers(-90, 90, (50, 64)), rnd.integers(-90, 90, (16, 64))
    new = old.copy()
    new[3, [0, 5]] += 2
    new[9] -= 1
    dots = x @ old.T
    c.move(dots, x, new - old)
    assert (dots == x @ new.T).all()
    cluster, distance = c.nearest(dots, x, new)
    full = ((x[:, None] - new[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_components_out_of_range_are_an_error():
    with pytest.raises(ValueError):
        c.integers(np.array([[2.0**21]]), 64)


def test_old_rounds_are_deleted(spark, tmp_path):
    from pathlib import Path

    from sceneframe.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("centroid-dots-*"))
    c.clusters(spark.createDataFrame(odd_data(3), SCHEMA)).count()
    assert len(set(folder.glob("centroid-dots-*")) - before) == 1
