"""Grid images: tiles against a library of panels, validity and configurations.

Tiles are rows ``(state, cell, tile)``; panels are rows ``(panel, pattern)``, any number of them. Means bound the error of a pair
from below, so a tile meets only panels whose means it can reach: an equi-join over buckets of three means, then
finer means, then the full error. Equal tiles are matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MATCH_ERROR = 0.01      # fixed value: match threshold
TWISTED_ERROR = 0.04    # fixed value: match threshold of twisted images
SLOT_PANELS = 4096      # panels of one bucket that a tile meets in one group
SLACK = 1e-9            # for sums of rounded doubles


def _block_means(values: Column, height: int, width: int, block: int) -> Column:
    """Means of the ``block x block`` squares of a flattened tile."""
    blocks = [
        [(by * block + dy) * width + bx * block + dx for dy in range(block) for dx in range(block)]
        for by in range(height // block) for bx in range(width // block)
    ]
    indexes = F.array(*[F.array(*[F.lit(i) for i in b]) for b in blocks])
    return F.transform(
        indexes,
        lambda ids: F.aggregate(ids, F.lit(0.0), lambda acc, i: acc + F.get(values, i)) / F.size(ids),
    )


def match_error(tile: Column, pattern: Column, rule: str, height: int, width: int) -> Column:
    """Mean error of a tile against a pattern.

    ``block``: absolute difference, 2x2 block mean, round. ``plain``: absolute difference, round.
    ``rounded``: round both, then absolute difference. ``twisted``: round the image, absolute
    difference, 3x3 block mean, round.
    """
    if rule == "rounded":
        error = F.zip_with(tile, pattern, lambda a, b: F.abs(F.rint(a) - F.rint(b)))
    elif rule == "plain":
        error = F.zip_with(tile, pattern, lambda a, b: F.rint(F.abs(a - b)))
    else:
        image = F.transform(tile, F.rint) if rule == "twisted" else tile
        means = _block_means(F.zip_with(image, pattern, lambda a, b: F.abs(a - b)), height, width, 2 if rule == "block" else 3)
        error = F.transform(means, F.rint)
    return F.aggregate(error, F.lit(0.0), lambda acc, v: acc + v) / F.size(error)


def _features(image: Column, rule: str, height: int, width: int, crisp: bool) -> Column:
    """Values, one a unit of the error, whose differences bound the unit's error from below (less 0.5 unless crisp)."""
    if rule in ("block", "twisted"):
        return _block_means(image, height, width, 2 if rule == "block" else 3)
    return F.transform(image, F.rint) if crisp or rule == "rounded" else F.transform(image, lambda v: v)


def _means(features: Column, units: int, parts: int) -> Column:
    """Means of ``parts`` (or fewer) consecutive runs of the features."""
    n = -(-units // parts)
    runs = [(at, min(n, units - at)) for at in range(0, units, n)]
    return F.array(*[F.aggregate(F.slice(features, at + 1, k), F.lit(0.0), lambda acc, v: acc + v) / k for at, k in runs])


def _indexed(images: DataFrame, column: str, rule: str, height: int, width: int, units: int) -> DataFrame:
    """Two rows an image: ``route`` "crisp" for those close to whole numbers, and "any"; with means at two levels.

    Two images that are nowhere 0.25 from a whole number differ, rounded, by no more than their rounded difference, so their means
    bound the error without slack. All other pairs, and all of the rules on blocks, go by "any", where a unit's rounding may hide 0.5.
    """
    image = F.transform(column, F.rint) if rule == "twisted" and column == "tile" else F.col(column)
    if rule == "plain":
        noise = F.aggregate(F.col(column), F.lit(0.0), lambda acc, v: F.greatest(acc, F.abs(v - F.rint(v))))
        crisp = noise < 0.25
    else:
        crisp = F.lit(rule == "rounded")
    routes = F.when(crisp, F.array(F.lit("crisp"), F.lit("any"))).otherwise(F.array(F.lit("any")))
    if rule == "rounded":
        routes = F.array(F.lit("crisp"))
    rows = images.withColumn("_crisp", crisp).withColumn("route", F.explode(routes))
    features = F.when(F.col("route") == "crisp", _features(image, rule, height, width, True)).otherwise(_features(image, rule, height, width, False))
    rows = rows.withColumn("_features", features)
    return rows.withColumns({"_four": _means(F.col("_features"), units, 4), "_many": _means(F.col("_features"), units, 16)}).drop("_features")


def _bucket_keys(four: Column, units: int, run: int, limit: float, coarse: float, slack: float) -> tuple[Column, Column]:
    """Buckets of the whole mean and of the first and last run of a panel, and all such triples that a tile can reach."""
    starts = range(0, units, run)
    whole = sum((F.get(four, F.lit(i)) * (min(run, units - at) / units) for i, at in enumerate(starts)), F.lit(0.0))
    values = [(F.get(four, F.lit(0)), limit * coarse + slack), (F.get(four, F.lit(len(starts) - 1)), limit * coarse + slack), (whole, limit + slack)]
    buckets, reached = [], []
    for value, reach in values:
        reach += SLACK
        buckets.append(F.floor(value / (2 * reach)))
        reached.append(F.sequence(F.floor((value - reach) / (2 * reach)), F.floor((value + reach) / (2 * reach))))
    triples = F.flatten(F.transform(reached[0], lambda x: F.flatten(F.transform(reached[1], lambda y: F.transform(
        reached[2], lambda z: F.struct(x.alias("b0"), y.alias("b1"), z.alias("b2")))))))
    return F.struct(*[b.alias(f"b{i}") for i, b in enumerate(buckets)]), triples


def match_templates(tiles: DataFrame, panels: DataFrame, rule: str, height: int, width: int,
                    threshold: float | None = None) -> DataFrame:
    """Add ``panels``: the panels each tile matches, in panel order.

    A null tile, or one that is too short, matches nothing.
    """
    limit = threshold if threshold is not None else (TWISTED_ERROR if rule == "twisted" else MATCH_ERROR)
    block = {"block": 2, "twisted": 3}.get(rule, 1)
    units = (height // block) * (width // block)
    run = -(-units // 4)
    coarse, fine = (units / ((units - 1) % -(-units // parts) + 1) for parts in (4, 16))  # what the limit allows the shortest run, as a multiple
    slack = F.when(F.col("route") == "crisp", 0.0).otherwise(0.5)

    crisp, loose = (_bucket_keys(F.col("_four"), units, run, limit, coarse, s) for s in (0.0, 0.5))
    bucket, reached = (F.when(F.col("route") == "crisp", c).otherwise(a) for c, a in zip(crisp, loose))
    distinct = tiles.select("tile").where(F.size("tile") >= height * width).distinct()
    asked = _indexed(distinct, "tile", rule, height, width, units)
    library = _indexed(panels.select("panel", "pattern"), "pattern", rule, height, width, units).withColumn("_key", bucket)
    crowd = library.groupBy("route", "_key").agg(F.ceil(F.count("*") / F.lit(SLOT_PANELS)).cast("int").alias("_slots"))
    library = library.join(crowd, ["route", "_key"]).withColumn("_slot", F.pmod(F.xxhash64("panel", "pattern"), F.col("_slots")).cast("int"))
    asked = asked.withColumn("_key", F.explode(reached)).join(crowd, ["route", "_key"])
    asked = asked.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)))
    names = {"_crisp": "_panel_crisp", "_four": "_panel_four", "_many": "_panel_many"}
    pairs = asked.drop("_slots").join(library.drop("_slots").withColumnsRenamed(names), ["route", "_key", "_slot"])
    near = lambda a, b, reach: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= reach + SLACK)
    once = (F.col("route") == "crisp") | ~(F.col("_crisp") & F.col("_panel_crisp"))
    matched = (
        pairs.where(once & near("_four", "_panel_four", limit * coarse + slack))
        .where(near("_many", "_panel_many", limit * fine + slack))
        .where(match_error(F.col("tile"), F.col("pattern"), rule, height, width) <= limit)
        .groupBy("tile").agg(F.array_sort(F.collect_list("panel")).alias("panels"))
    )
    none = F.array().cast(f"array<{dict(panels.dtypes)['panel']}>")
    return tiles.join(matched, "tile", "left").select(*tiles.columns, F.coalesce("panels", none).alias("panels"))


def configs_from_matches(matches: DataFrame, state: str, panels: list[int], position: Column | None = None) -> DataFrame:
    """Configuration per state: for each panel the sum of the positions it was found at.

    ``position`` defaults to the cell; pass the tower index for stacked disks. One aggregation.
    """
    at = position if position is not None else F.col("cell")
    sums = [F.sum(F.when(F.array_contains("panels", p), at).otherwise(F.lit(0))) for p in panels]
    return matches.groupBy(state).agg(F.array(*sums).alias("config"))


def cell_signs(matches: DataFrame) -> DataFrame:
    """On/off boards: ``+1`` for panel 0 and ``-1`` for panel 1 of each cell."""
    panel = F.aggregate("panels", F.lit(0), lambda acc, p: acc + p)
    return matches.withColumn("sign", F.rint(-(panel - F.lit(0.5)) * 2).cast("int"))


def grid_validity(matches: DataFrame, state: str, panels: list[int], coverage: str | None = "at_most_one",
                  ideal: list[int] | None = None) -> DataFrame:
    """Validity of each state from one aggregation.

    Cells must match exactly one panel. ``coverage`` is ``at_most_one`` per panel, ``exact`` (equal to
    ``ideal``) or None for no rule.
    """
    n = F.size("panels")
    covered = [F.sum(F.array_contains("panels", p).cast("int")) for p in panels]
    if coverage == "at_most_one":
        coverage_ok = F.forall(F.array(*covered), lambda c: c <= 1)
    elif coverage == "exact":
        coverage_ok = F.array(*covered) == F.array(*[F.lit(i).cast("long") for i in ideal])
    else:
        coverage_ok = F.lit(True)
    return matches.groupBy(state).agg(
        F.bool_and(n == 1).alias("panels_ok"),
        F.bool_or(n == 0).alias("nomatch"),
        F.bool_or(n > 1).alias("ambiguous"),
        coverage_ok.alias("coverage_ok"),
    ).withColumn("valid", F.col("panels_ok") & F.col("coverage_ok"))


def validity_counts(validity: DataFrame) -> DataFrame:
    """The counts of the validity report in one row."""
    ok, cover = F.col("panels_ok"), F.col("coverage_ok")
    return validity.agg(
        F.count_if(~ok).alias("panels_ng"), F.count_if("nomatch").alias("nomatch"), F.count_if("ambiguous").alias("ambiguous"),
        F.count_if(ok).alias("panels_ok"), F.count_if(ok & ~cover).alias("duplicated"), F.count_if(ok & cover).alias("valid"),
    )
