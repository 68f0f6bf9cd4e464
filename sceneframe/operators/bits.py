"""Statistics of latent bits and of predicted codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.functions.arrays import exploded


def bit_stats(states: DataFrame, bits: str = "bits", by: list[str] = []) -> DataFrame:
    """Activation, ever-1, ever-0 and effective bits over the table (or per ``by``)."""
    per_bit = exploded(states, bits, "idx", "bit", by).groupBy(*by, "idx").agg(
        F.min("bit").alias("lo"), F.max("bit").alias("hi"), F.sum("bit").alias("total"), F.count("*").alias("n")
    )
    return per_bit.groupBy(*by).agg(
        (F.sum("total") / F.sum("n")).alias("activation"),
        F.sum("hi").cast("double").alias("ever_1"),
        F.sum(1 - F.col("lo")).cast("double").alias("ever_0"),
        F.sum((1 - F.col("lo")) * F.col("hi")).cast("double").alias("effective"),
    )


def code_variance(encodings: DataFrame, state: str, bits: str = "bits", by: list[str] = []) -> DataFrame:
    """Population variance of each (state, bit) over repeated encodings; then max, min, mean, median.

    Rows are moved by state while still packed, then exploded, so the shuffle carries arrays and
    not one row per bit. A state has a fixed number of repeats.
    """
    packed = encodings.select(*by, state, bits).repartition(*by, state)
    variances = exploded(packed, bits, "idx", "bit", [*by, state]).groupBy(*by, state, "idx").agg(
        F.var_pop("bit").alias("v")
    )
    # variances of r repeated 0/1 values take at most r + 1 values, so the exact median keeps few counts
    value = F.round("v", 12)
    return variances.groupBy(*by).agg(
        F.max(value).alias("max"), F.min(value).alias("min"), F.avg("v").alias("mean"),
        F.percentile(value, 0.5).alias("median"),
    )


def row_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def mean_hamming(transitions: DataFrame, pre: str = "pre", suc: str = "suc") -> DataFrame:
    """Mean absolute bit change from pre to suc."""
    change = transitions.select(F.explode(F.zip_with(pre, suc, lambda a, b: F.abs(a - b))).alias("d"))
    return change.agg(F.avg("d").alias("hamming"))


def prediction_match(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``z_mae``, ``z_prob_bitwise`` and ``z_allmatch`` of predicted successor codes.

    The row product is folded inside the row; the bitwise means combine map-side per bit.
    """
    miss = F.zip_with(truth, predicted, lambda a, b: F.abs(b - a).cast("double"))
    rows = predictions.select(miss.alias("miss")).withColumn(
        "row_match", F.aggregate("miss", F.lit(1.0), lambda acc, d: acc * (1 - d))
    )
    # the row product is carried by the first bit only, so one pass serves both means
    per_bit = exploded(rows, "miss", "idx", "d", ["row_match"]).groupBy("idx").agg(
        F.avg("d").alias("miss"), F.count("*").alias("n"),
        F.sum(F.when(F.col("idx") == 0, F.col("row_match"))).alias("row_match"),
    )
    return per_bit.agg(
        (F.sum(F.col("miss") * F.col("n")) / F.sum("n")).alias("z_mae"),
        F.product(1 - F.col("miss")).alias("z_prob_bitwise"),
        (F.sum("row_match") / F.max(F.when(F.col("idx") == 0, F.col("n")))).alias("z_allmatch"),
    )


def code_similarity(transitions: DataFrame, pre: str = "pre", suc: str = "suc") -> DataFrame:
    """Mean cosine proximity (negative) and mean Poisson loss between the codes of both ends."""
    epsilon = 1e-7  # fixed value of the loss

    def total(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    def norm(a: str) -> Column:
        # fixed value 1e-12: floor of the squared norm
        return F.sqrt(F.greatest(total(a, a), F.lit(1e-12)))

    poisson = row_mean(F.zip_with(pre, suc, lambda x, y: (y - x * F.log(y + F.lit(epsilon))).cast("double")))
    return transitions.select((-total(pre, suc) / (norm(pre) * norm(suc))).alias("c"), poisson.alias("p")).agg(
        F.avg("c").alias("cosine"), F.avg("p").alias("poisson")
    )


def repeat_rows(df: DataFrame, n: int, name: str = "repeat") -> DataFrame:
    """Each row ``n`` times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def canonical_object_order(objects: Column) -> Column:
    """The objects of a state as bit strings in ascending order; equal for any permutation.

    Strings of equal width sort like the unsigned big-endian numbers they spell.
    """
    as_text = F.transform(
        objects, lambda o: F.array_join(F.transform(o, lambda b: F.rint(b).cast("int").cast("string")), "")
    )
    return F.array_sort(as_text)


def embedding_activity(states: DataFrame, embeddings: str) -> DataFrame:
    """Mean activation of the per-object embeddings."""
    return states.select(F.explode(F.flatten(embeddings)).alias("v")).agg(F.avg("v").alias("activity"))
