"""Keyed noise and object shuffles.

Noise is drawn from a hash of the row key, the element and the seed. A retried or repartitioned
task draws the same values, which a per-partition generator would not.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneframe.operators.ordering import stable_hash


def uniform(*keys: Column, seed: int = 0) -> Column:
    """Uniform number in [0, 1) from the keys: the top 53 of the 60 hash bits."""
    return F.shiftright(stable_hash(*keys, seed=seed), 7).cast("double") / F.lit(float(1 << 53))


def normal(*keys: Column, seed: int = 0) -> Column:
    """Standard normal number from two independent uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(*keys, seed=2 * seed)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(*keys, seed=2 * seed + 1))


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def noise_gaussian(value: Column, *keys: Column, sigma: float = 0.3, seed: int = 0) -> Column:
    return clip01(value + F.lit(sigma) * normal(*keys, seed=seed))


def noise_salt(value: Column, *keys: Column, p: float = 0.06, seed: int = 0) -> Column:
    """Set to 1 with probability ``p``; everything is clipped to 0..1."""
    return F.when(uniform(*keys, seed=seed) < p, F.lit(1.0)).otherwise(clip01(value))


def noise_pepper(value: Column, *keys: Column, p: float = 0.06, seed: int = 0) -> Column:
    return F.when(uniform(*keys, seed=seed) < p, F.lit(0.0)).otherwise(clip01(value))


def noise_flip(value: Column, *keys: Column, p: float = 0.06, seed: int = 0) -> Column:
    """Mirror to ``1 - value`` with probability ``p``."""
    return F.when(uniform(*keys, seed=seed) < p, F.lit(1.0) - value).otherwise(value)


def noisy_array(values: Column, key: Column, noise, seed: int = 0) -> Column:
    """Apply a noise function to every element of an array."""
    return F.transform(values, lambda v, i: noise(v, key, i, seed=seed))


def shared_permutation(k: int, seed: int = 0) -> list[int]:
    """One permutation of ``k`` slots: slots in the order of their stable hash."""
    return sorted(range(k), key=lambda s: (int(hashlib.md5(f"{s}|{seed}".encode()).hexdigest()[:15], 16), s))


def shuffle_objects(slots: DataFrame, permutation: list[int], slot: str = "slot") -> DataFrame:
    """Move every state's objects by the same permutation: new slot i holds old slot permutation[i]."""
    place = {old: new for new, old in enumerate(permutation)}
    target = F.array(*[F.lit(place[s]) for s in range(len(permutation))])
    return slots.withColumn(slot, F.get(target, F.col(slot)))


def shuffle_object_array(objects: Column, permutation: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(s) for s in permutation]), lambda s: F.get(objects, s))


def shuffle_objects_per_state(slots: DataFrame, state: str, slot: str = "slot", seed: int = 0) -> DataFrame:
    """An independent permutation per state, by hash order of its slots (a fixed few per state)."""
    order = Window.partitionBy(state).orderBy(stable_hash(state, slot, seed=seed), slot)
    return slots.withColumn("_new", F.row_number().over(order) - 1).drop(slot).withColumnRenamed("_new", slot)
