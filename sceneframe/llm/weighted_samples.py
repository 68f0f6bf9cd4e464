"""Document fingerprints by consistent weighted sampling.

A document is a multiset of five-word shingles; a shingle weighs as often as it occurs. For every sample ``k`` and shingle
of weight ``w`` gamma draws that depend on shingle and sample alone give

    t = floor(ln w / r + b),   a = c * exp(-r * (t - b + 1)),   r, c ~ Gamma(2, 1), b ~ Uniform(0, 1),

and the document keeps the least ``a``. Two documents keep the same value exactly when they choose the same shingle and
the same ``t``, and the chance of that is their generalised Jaccard similarity, the sum of the lesser weights over the sum
of the greater ones. A fingerprint is 16 bits of each kept value. A shingle that a text and its edited text hold equally
often is drawn once for both.

The next document by id is needed beside each one. Ranges of ids come from approximate percentiles, so a bucket is a range
of like size whose first id is known; the first document of a range is also sent to the bucket before it. That makes one
shuffle of the texts; windows and both aggregations keep its partitioning.

Defined results: null texts count as empty; a text without a word has an empty fingerprint, alike only to another empty
one; fewer than five words are one shingle; a null id sorts first; rows that repeat an id follow each other by a hash of
the text; a lone document is its own next. Words are compared in lower case. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneframe.llm.text import whole_text, words

SHINGLE = 5
SAMPLES = 48
PER_ROW = 8  # samples that one row draws; as many as compile to methods of a size that the JVM optimizes
BITS = 16
LEAST = -(1 << 63)


def shingle_rows(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``term``, a row per occurrence of a shingle."""
    word = words(F.lower(F.col(text)))
    padded = F.when((F.size("_w") > 0) & (F.size("_w") < SHINGLE), F.concat("_w", F.array_repeat(F.lit(""), SHINGLE - F.size("_w")))).otherwise(F.col("_w"))
    some = rows.select(*keep, word.alias("_w")).select(*keep, padded.alias("_w")).filter(F.size("_w") > 0)
    count = F.size("_w") - (SHINGLE - 1)
    slices = F.arrays_zip(*[F.slice("_w", k + 1, count).alias(f"w{k}") for k in range(SHINGLE)])
    return some.select(*keep, F.inline(slices)).select(*keep, F.xxhash64(*[f"w{k}" for k in range(SHINGLE)]).alias("term"))


def _low(bits: Column, width: int) -> Column:
    """The low ``width`` bits and a half."""
    return bits.bitwiseAND(F.lit((1 << width) - 1)).cast("double") + 0.5


def _value(seed: Column, k: int, log_weight: Column) -> Column:
    """``a`` of one sample: 21 bits each for the two parts of ``r`` and for ``b``, 32 each for the two parts of ``c``.

    Factors that are powers of two bring the bits between 0 and 1; unlike quotients they need no test for zero.
    """
    one, two = F.xxhash64(seed, F.lit(2 * k)), F.xxhash64(seed, F.lit(2 * k + 1))
    r = -F.log(_low(one, 21) * _low(F.shiftrightunsigned(one, 21), 21) * F.lit(2.0 ** -42))
    b = _low(F.shiftrightunsigned(one, 42), 21) * F.lit(2.0 ** -21)
    c = -F.log(_low(two, 32) * _low(F.shiftrightunsigned(two, 32), 32) * F.lit(2.0 ** -64))
    return c * F.exp(-r * (F.floor(log_weight / r + b) - b + 1))


def sampled(weighted: DataFrame, keys: list[str], versions: int, samples: int = SAMPLES, per_row: int = PER_ROW) -> DataFrame:
    """``keys`` and ``signature0``, ... (16 bits a sample) from ``term`` and the weights ``w0``, ... in every version."""
    weights = F.array_remove(F.array_distinct(F.array(*[f"w{v}" for v in range(versions)])), F.lit(0).cast("bigint"))
    # a version that doesn't hold the term at this weight is out of the race
    out = [F.when(F.col(f"w{v}") == F.col("weight"), 0.0).otherwise(F.lit(float("inf"))).alias(f"out{v}") for v in range(versions)]
    rows = weighted.select("*", F.explode(weights).alias("weight"))
    rows = rows.select(*keys, "term", F.log(F.col("weight").cast("double")).alias("lw"), *out)
    rows = rows.select(*keys, "term", "lw", *[f"out{v}" for v in range(versions)], F.explode(F.sequence(F.lit(0), F.lit(samples // per_row - 1))).alias("part"))
    rows = rows.withColumn("seed", F.xxhash64("term", "part"))
    least = rows.groupBy(*keys, "part").agg(*[
        F.min(_value(F.col("seed"), k, F.col("lw")) + F.col(f"out{v}")).alias(f"m{v}_{k}") for k in range(per_row) for v in range(versions)])
    code = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << BITS)).cast("int")
    parts = least.select(*keys, "part", *[
        F.when(F.col(f"m{v}_0") == F.lit(float("inf")), F.array().cast("array<int>")).otherwise(
            F.array(*[code(f"m{v}_{k}") for k in range(per_row)])).alias(f"part{v}") for v in range(versions)])
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", *[f"part{v}" for v in range(versions)]))).alias("parts"))
    return whole.select(*keys, *[F.flatten(F.col("parts")[f"part{v}"]).alias(f"signature{v}") for v in range(versions)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two empty signatures, 0 for an empty and another."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), 0.0).when(F.size(a) == 0, 1.0).otherwise(same / F.size(a))


def rendered(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint")), BITS // 4, "0"))), "")


def in_ranges(docs: DataFrame, key: str, ranges: int) -> DataFrame:
    """Rows with ``bucket``, a range of ids, and ``guest``: a range's first document is a guest of the range before.

    The first document of all is a guest of the last range. The bounds are one id per range.
    """
    order = F.coalesce(F.col(key), F.lit(LEAST))
    wanted = [i / ranges for i in range(1, ranges)] or [0.5]
    found = docs.agg(F.min(order).alias("first"), F.percentile_approx(order, wanted, max(10_000, 20 * ranges)).alias("at")).first()
    first = found["first"]
    bounds = sorted({b for b in found["at"] or [] if b > first})
    if first is None:
        return docs.withColumn("bucket", F.lit(0)).withColumn("guest", F.lit(False))
    # the literal folds to one array; each step halves what is left of it
    array = F.split(F.lit(",".join(map(str, [first, *bounds]))), ",").cast("array<bigint>")
    rows, step = docs.withColumn("bucket", F.lit(0)), 1 << len(bounds).bit_length()
    while step:
        at = F.col("bucket") + step
        rows = rows.withColumn("bucket", F.when((at <= len(bounds)) & (F.get(array, at) <= order), at).otherwise(F.col("bucket")))
        step >>= 1
    last = len(bounds)
    opens = F.get(array, F.col("bucket")) == order
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    places = F.when(opens, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")),
                                   F.struct(before.alias("bucket"), F.lit(True).alias("guest"))))
    places = places.otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))))
    return rows.withColumn("place", F.explode(places)).select(*docs.columns, "place.bucket", "place.guest")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), whole_text(text).alias("text"))
    dealt = in_ranges(rows, "doc", ranges).repartition(ranges, "bucket")
    by_id = Window.partitionBy("bucket").orderBy("guest", F.col("doc").asc_nulls_first(), F.xxhash64("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    placed = (
        dealt.withColumn("place", F.row_number().over(by_id)).withColumn("next", F.lead("text").over(by_id))
        .withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.left(F.coalesce("next", F.lit("")), half)))
    )
    versions = placed.select("bucket", "place", F.explode(F.when(F.col("guest"), F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")))).otherwise(
        F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body"))))).alias("v"))
    keys = ["bucket", "place"]
    terms = shingle_rows(versions.select(*keys, "v.version", "v.body"), "body", [*keys, "version"])
    weight = lambda v: F.count(F.when(F.col("version") == v, 1)).alias(f"w{v}")
    both = sampled(terms.groupBy(*keys, "term").agg(weight(0), weight(1)), keys, 2)
    about = placed.select("bucket", "place", "guest", "doc", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    none = F.array().cast("array<int>")
    whole = about.join(both, keys, "left").withColumns({"own": F.coalesce("signature0", none), "new": F.coalesce("signature1", none)})
    whole = whole.withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("place")))
    return whole.filter(~F.col("guest")).select(
        F.col("doc").alias(key), "n_chars", "edited_sha256", rendered(F.col("own")).alias("fingerprint"), rendered(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
