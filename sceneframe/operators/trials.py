"""Hyperparameter tables: grids, random configurations, parallel trials and the best one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneframe.functions.text import config_key
from sceneframe.operators.ordering import HASH_BITS, stable_hash


def config_grid(values: DataFrame) -> DataFrame:
    """Every combination of the value lists in the array columns of a one-row table.

    Each list is exploded in turn; nothing is joined.
    """
    grid = values
    for name in values.columns:
        grid = grid.withColumn(name, F.explode(name))
    return grid


def random_configs(values: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` configurations, every key drawn independently and uniformly from its list.

    ``values`` is a one-row table of array columns; it enters as one scalar value.
    """
    lists = values.select(F.struct(*values.columns)).scalar()
    drawn = values.sparkSession.range(n).withColumnRenamed("id", "trial").withColumn("_v", lists)
    return drawn.select(
        "trial",
        *[
            F.get(F.col("_v")[name], F.pmod(stable_hash("trial", F.lit(name), seed=seed), F.size(F.col("_v")[name])).cast("int")).alias(name)
            for name in values.columns
        ],
    )


def drop_known(candidates: DataFrame, known: DataFrame, config: str = "config") -> DataFrame:
    """Candidate configurations that were not evaluated yet, compared by canonical key."""
    done = known.select(config_key(F.col(config)).alias("_key"))
    return candidates.withColumn("_key", config_key(F.col(config))).join(done, "_key", "left_anti").drop("_key")


def _unit(*keys: Column | str, seed: int) -> Column:
    """A hashed number between 0 and 1, exclusive."""
    return (stable_hash(*keys, seed=seed).cast("double") + 0.5) / float(1 << HASH_BITS)


def next_generation(trials: DataFrame, values: DataFrame, n: int, population: int, seed: int = 0, attempts: int = 20,
                    eval: str = "eval", order: str = "trial", config: str = "config") -> DataFrame:
    """``(child, kind, config)``: up to ``n`` untried configurations bred from the best ``population`` trials, as one table step.

    A child is a mutation with the probability best / worst evaluation of the population (1 where they are equal), else a crossover.
    Parents are drawn without replacement by weights 1 / evaluation: the least of exponential keys ``-ln(u) * eval``. A crossover
    takes each entry from either parent by a coin; a mutation is one of the parent's untried neighbours in one entry, all alike
    likely. Each child has ``attempts`` tries, the last a mutation; the first untried configuration counts, and of equal children the first.
    All draws are hashes of child, try and ``seed``. Trials without an evaluation are known but never parents; evaluations below 0 are an error.
    ``values`` is a one-row table with the list of each entry; the population and its neighbours are as small as the caller asks.
    """
    done = trials.where(F.col(eval).isNotNull())
    place = F.row_number().over(Window.orderBy(eval, order)) - 1
    best = done.select(eval, order, config).orderBy(eval, order).limit(population).select(place.alias("i"), F.col(eval).cast("double").alias("eval"), F.col(config).alias("config"))
    checked = F.when(F.col("eval") < 0, F.raise_error(F.lit("an evaluation is below 0")).cast("double")).otherwise(F.col("eval"))
    best = best.withColumn("eval", checked)
    options = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.transform(k, lambda v: v.cast("string")).alias("vs")) for k in sorted(values.columns)])).alias("o")
    options = values.select(options).select("o.k", F.explode("o.vs").alias("v"))
    listed = options.agg(F.collect_list(F.struct("k", "v"))).scalar()
    near = best.withColumn("o", F.explode(listed)).where(F.col("config")[F.col("o.k")] != F.col("o.v"))
    changed = F.transform_values("config", lambda k, v: F.when(k == F.col("o.k"), F.col("o.v")).otherwise(v))
    open_near = drop_known(near.select("i", "o", changed.alias("config")), trials.select(F.col(config).alias("config")))
    open_near = open_near.groupBy("i").agg(F.array_sort(F.collect_list("o")).alias("open"))
    parents = best.join(open_near, "i", "left").agg(F.array_sort(F.collect_list(F.struct("i", "eval", "config", "open")), lambda x, y: x["i"] - y["i"])).scalar()

    tries = trials.sparkSession.range(n).select(F.col("id").alias("child"), F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("try"))
    tries = tries.withColumn("parents", parents).where(F.size("parents") > 0)
    keys = F.transform("parents", lambda p: F.struct((-F.ln(_unit("child", "try", p["i"], seed=seed)) * p["eval"]).alias("key"), p["i"].alias("i")))
    tries = tries.withColumn("drawn", F.transform(F.array_sort(keys), lambda d: F.get("parents", d["i"])))
    one, two = F.get("drawn", F.lit(0)), F.get("drawn", F.lit(1))
    ratio = F.coalesce(F.try_divide(F.get("parents", F.lit(0))["eval"], F.try_element_at("parents", F.lit(-1))["eval"]), F.lit(1.0))
    mutates = (F.col("try") == attempts - 1) | (_unit("child", "try", F.lit("kind"), seed=seed) < ratio) | two.isNull()
    crossed = F.transform_values(one["config"], lambda k, v: F.when(_unit("child", "try", k, seed=seed) < 0.5, v).otherwise(two["config"][k]))
    change = F.get(one["open"], F.pmod(stable_hash("child", "try", F.lit("near"), seed=seed), F.greatest(F.size(one["open"]), F.lit(1))).cast("int"))
    picked = F.when(change.isNotNull(), F.transform_values(one["config"], lambda k, v: F.when(k == change["k"], change["v"]).otherwise(v)))
    made = tries.select("child", "try", F.when(mutates, "mutation").otherwise("crossover").alias("kind"), F.when(mutates, picked).otherwise(crossed).alias("config"))
    fresh = drop_known(made.where("config is not null"), trials.select(F.col(config).alias("config")))
    first = fresh.groupBy("child").agg(F.min_by(F.struct("kind", "config"), "try").alias("c")).select("child", "c.*")
    return first.groupBy(config_key(F.col("config")).alias("k")).agg(F.min_by(F.struct("child", "kind", "config"), "child").alias("c")).select("c.*")


def best_trial(trials: DataFrame, eval: str = "eval", order: str = "trial", keep: list[str] = ["config"]) -> DataFrame:
    """The trial with the smallest evaluation; the earliest one on a tie."""
    best = trials.where(F.col(eval).isNotNull()).agg(F.min_by(F.struct(eval, order, *keep), F.struct(eval, order)).alias("_b"))
    return best.select("_b.*")


def run_trials(configs: DataFrame, task: Callable[[dict], float], key: str, config: str = "config",
               skip: tuple[type[Exception], ...] = (ValueError, MemoryError), repeats: int = 1,
               partitions: int | None = None) -> DataFrame:
    """Evaluate every configuration with the user's ``task`` in parallel: ``(key, repeat, eval, error)``.

    Configurations that raise one of ``skip`` have a null ``eval`` and the ``error`` as text; others end the job. Trials are spread over tasks by key, so
    each executor evaluates its own share.
    """
    key_type = dict(configs.dtypes)[key]
    spread = configs.select(key, config, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    spread = spread.repartition(partitions, key, "repeat") if partitions else spread.repartition(key, "repeat")

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for trial, settings, repeat in batch[[key, config, "repeat"]].itertuples(index=False):
                try:
                    done.append((trial, repeat, float(task(dict(settings))), None))
                except skip as failure:
                    done.append((trial, repeat, None, f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(done, columns=[key, "repeat", "eval", "error"])

    return spread.mapInPandas(evaluate, f"{key} {key_type}, repeat int, eval double, error string")


def with_defaults(config: Column, defaults: dict[str, str]) -> Column:
    """Configuration over its defaults, the configuration winning."""
    from sceneframe.operators.rowsets import merge_config

    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return merge_config(base, config)
