"""From measures to scores: min-max normalisation, pillars, the composite, references, tiers and wording.

A metric table is long: city, metric, value. Three tests of a degenerate range are offered because the pillars differ:
  low   |hi - lo| <= 1e-8 + 1e-5 |lo|      high  |hi - lo| <= 1e-8 + 1e-5 |hi|      relative  |hi - lo| <= 1e-9 max(|hi|, |lo|)
NaN counts as missing (nan='skip') or makes the range missing (nan='propagate').
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.frames import local, small

# Metric -> (pillar, direction: 1 higher is better, -1 lower is better).
METRICS = {
    "node_density": ("connectivity", 1),
    "link_density": ("connectivity", 1),
    "average_degree": ("connectivity", 1),
    "closeness_centrality": ("connectivity", 1),
    "global_efficiency": ("efficiency", 1),
    "average_shortest_path": ("efficiency", -1),
    "circuity": ("efficiency", -1),
    "rcrc": ("efficiency", 1),
    "hierarchy_betweenness_centrality": ("hierarchy", 1),
    "hierarchy_road_class_distribution": ("hierarchy", 1),
    "hierarchy_clarity": ("hierarchy", 1),
}
PILLARS = ("connectivity", "efficiency", "hierarchy")
RANGE_TEST = {"connectivity": "low", "efficiency": "high", "hierarchy": "relative"}
NAN_POLICY = {"connectivity": "propagate", "efficiency": "propagate", "hierarchy": "skip"}


def metric_specs(spark: SparkSession) -> DataFrame:
    return local(spark, [(m, p, d) for m, (p, d) in METRICS.items()], "metric string, pillar string, direction int")


def known(value: Column) -> Column:
    """value, null if NaN."""
    return F.when(~F.isnan(value), value)


def degenerate(lo: Column, hi: Column, test: str = "low") -> Column:
    if test == "relative":
        return F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    return F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(lo if test == "low" else hi)


def scaled(value: Column, lo: Column, hi: Column, direction: Column | int = 1, test: str = "low") -> Column:
    """0 to 100 within the range (not clipped outside it); 50 for a degenerate range; null without value or range."""
    direction = F.lit(direction) if isinstance(direction, int) else direction
    up, down = 100 * (value - lo) / (hi - lo), 100 * (hi - value) / (hi - lo)
    return F.when(value.isNull() | lo.isNull() | hi.isNull(), None).when(degenerate(lo, hi, test), 50.0).otherwise(F.when(direction >= 0, up).otherwise(down))


def long_form(wide: DataFrame, metrics: list[str], key: str = "city") -> DataFrame:
    return wide.unpivot([key], metrics, "metric", "value").withColumn("value", F.col("value").cast("double"))


def normalised(values: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """city, metric, value, lo, hi, score against the range of all cities, by each pillar's own rules."""
    specs = metric_specs(values.sparkSession) if specs is None else specs
    rows = values.join(small(specs), "metric")
    span = rows.groupBy("metric").agg(F.min(known(F.col("value"))).alias("lo"), F.max(known(F.col("value"))).alias("hi"), F.max(F.coalesce(F.isnan("value"), F.lit(False))).alias("holes"))
    both = rows.join(small(span), "metric")
    score = F.coalesce(*[F.when(F.col("pillar") == p, scaled(known(F.col("value")), F.col("lo"), F.col("hi"), F.col("direction"), RANGE_TEST[p])) for p in PILLARS])
    spoiled = F.col("holes") & F.col("pillar").isin([p for p in PILLARS if NAN_POLICY[p] == "propagate"])
    return both.select("city", "pillar", "metric", "value", "lo", "hi", F.when(~spoiled, score).alias("score"))


def pillar_scores(scores: DataFrame) -> DataFrame:
    """One row per city with a column per pillar: the mean of the scores there are."""
    means = [F.avg(F.when(F.col("pillar") == p, F.col("score"))).alias(f"{p}_score") for p in PILLARS]
    return scores.groupBy("city").agg(*means)


def merged(*pillars: DataFrame) -> DataFrame:
    """Full outer join of one table per pillar (city, <pillar>_score); ValueError if a city occurs twice in one."""
    out = None
    for p in pillars:
        if not p.groupBy("city").count().filter("count > 1").isEmpty():
            raise ValueError("a city occurs twice in a pillar")
        out = p if out is None else out.join(p, "city", "full_outer")
    return out


def composite(pillars: DataFrame) -> DataFrame:
    """The mean of the three pillars, null unless all are there, with its arithmetic check."""
    c, e, h = (F.col(f"{p}_score") for p in PILLARS)
    index = (c + e + h) / 3
    return pillars.withColumn("index_score", index).withColumn("arithmetic_ok", F.abs((c + e + h) / 3 - F.col("index_score")) <= 1e-12)


def validation(index: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Per city: pillars there, all within 0 to 100, index within 0 to 100, city expected."""
    cols = [known(F.col(f"{p}_score")) for p in PILLARS]
    within = lambda c: F.coalesce(c.between(-1e-9, 100 + 1e-9), F.lit(False))  # noqa: E731  # the slack is for rounding
    every = lambda xs: functools.reduce(operator.and_, xs)
    expected = F.col("city").isin(wanted) if wanted else F.lit(True)
    return index.select("city", every([c.isNotNull() for c in cols]).alias("all_pillars_present"), every([within(c) for c in cols]).alias("all_pillars_0_100"), within(known(F.col("index_score"))).alias("index_0_100"), expected.alias("city_expected"))


def check_scores(scores: DataFrame, column: str) -> None:
    """ValueError with all that is wrong: missing, repeated cities, scores out of 0 to 100."""
    bad = scores.agg(F.count_if(F.col(column).isNull() | F.isnan(column)).alias("missing"), F.count_if(~F.col(column).between(0, 100)).alias("outside"), (F.count("city") - F.countDistinct("city")).alias("repeated")).first()
    if bad.missing or bad.outside or bad.repeated:
        raise ValueError(f"{column}: {bad.missing} missing, {bad.outside} outside 0 to 100, {bad.repeated} repeated cities")


def reference_range(index: DataFrame) -> DataFrame:
    """One row: mean, population and sample deviation of the index, the range of a deviation about the mean, pillar means."""
    i = known(F.col("index_score"))
    mean, sd = F.avg(i), F.stddev_pop(i)
    return index.agg(
        F.count(i).alias("n_cities"),
        mean.alias("index_mean"),
        sd.alias("index_sd"),
        F.coalesce(F.stddev_samp(i), F.lit(0.0)).alias("index_sample_sd"),
        (mean - sd).alias("reference_lower"),
        (mean + sd).alias("reference_upper"),
        *[F.avg(known(F.col(f"{p}_score"))).alias(f"{p}_mean") for p in PILLARS],
    )


def tiers(index: DataFrame) -> DataFrame:
    """Tier 1 above the reference range, Tier 2 within it (bounds included), Tier 3 below."""
    both = index.join(small(reference_range(index).select("reference_lower", "reference_upper")))
    i = F.col("index_score")
    return both.select("city", "index_score", F.when(i > F.col("reference_upper"), "Tier 1").when(i >= F.col("reference_lower"), "Tier 2").when(i.isNotNull(), "Tier 3").alias("tier"))


def normalization_reference(scores: DataFrame) -> DataFrame:
    """metric, minimum_reference_value, maximum_reference_value, direction: what a later city is measured against."""
    specs = metric_specs(scores.sparkSession).select("metric", "direction")
    return scores.groupBy("metric").agg(F.min("lo").alias("minimum_reference_value"), F.max("hi").alias("maximum_reference_value")).join(small(specs), "metric").select("metric", "minimum_reference_value", "maximum_reference_value", F.when(F.col("direction") > 0, "higher").otherwise("lower").alias("direction"))


def reference_bounds(reference: DataFrame) -> DataFrame:
    """metric, lo, hi of a saved reference in either layout: one row per metric, or one row per city with a column per metric."""
    columns = {c.lower(): c for c in reference.columns}
    if {"metric", "minimum_reference_value", "maximum_reference_value"} <= set(columns):
        return reference.select(F.col(columns["metric"]).alias("metric"), F.col(columns["minimum_reference_value"]).cast("double").alias("lo"), F.col(columns["maximum_reference_value"]).cast("double").alias("hi"))
    if "city" not in columns:
        raise ValueError(f"neither layout of a reference: {reference.columns}")
    names = [c for c in reference.columns if c.lower() in METRICS]
    return long_form(reference.withColumnRenamed(columns["city"], "city"), names).groupBy("metric").agg(F.min(known(F.col("value"))).alias("lo"), F.max(known(F.col("value"))).alias("hi"))


def ranges_of_others(values: DataFrame) -> DataFrame:
    """city, metric, value, lo, hi: the range of each metric over all other cities, null where there is no other.

    The two smallest and the two largest values of a metric are all that is needed: one aggregation after another, no pairs.
    """
    v = F.col("value")
    ends = values.groupBy("metric").agg(F.min("value").alias("l0"), F.max("value").alias("h0"))
    with_ends = values.join(small(ends), "metric")
    inner = with_ends.groupBy("metric").agg(F.count_if(v == F.col("l0")).alias("nl"), F.count_if(v == F.col("h0")).alias("nh"), F.min(F.when(v > F.col("l0"), v)).alias("l1"), F.max(F.when(v < F.col("h0"), v)).alias("h1"))
    lo = F.when((v == F.col("l0")) & (F.col("nl") == 1), F.col("l1")).otherwise(F.col("l0"))
    hi = F.when((v == F.col("h0")) & (F.col("nh") == 1), F.col("h1")).otherwise(F.col("h0"))
    return with_ends.join(small(inner), "metric").select("city", "metric", "value", lo.alias("lo"), hi.alias("hi"))


def evaluated(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """city, metric, value, lo, hi, score against saved bounds, not clipped."""
    both = values.join(small(metric_specs(values.sparkSession)), "metric").join(small(bounds), "metric")
    return both.select("city", "pillar", "metric", "value", "lo", "hi", scaled(known(F.col("value")), F.col("lo"), F.col("hi"), F.col("direction"), "low").alias("score"))


def side(value: Column, mean: Column) -> Column:
    """Of a pillar: above, below or close to the reference mean, within 5 % of max(|mean|, 1)."""
    slack = 0.05 * F.greatest(F.abs(mean), F.lit(1.0))
    return F.when(value - mean > slack, "above the reference mean").when(value - mean < -slack, "below the reference mean").when(value.isNotNull() & mean.isNotNull(), "close to the reference mean")


def position(value: Column, lower: Column, upper: Column) -> Column:
    return F.when(value < lower, "below the reference range").when(value > upper, "above the reference range").when(value.isNotNull(), "within the reference range")


def interpretation(index: DataFrame, reference: DataFrame) -> DataFrame:
    """city, position, mean_side, one column per pillar, and the sentences with the range, the mean and the pillar means."""
    both = index.join(small(reference))
    i, m = F.col("index_score"), F.col("index_mean")
    mean_side = F.when(i > m, "above").when(i < m, "below").when(i.isNotNull(), "equal to")
    own = [side(F.col(f"{p}_score"), F.col(f"{p}_mean")).alias(f"{p}_side") for p in PILLARS]
    low, high = F.col("reference_lower"), F.col("reference_upper")
    out = both.select("city", "index_score", "index_mean", "reference_lower", "reference_upper", *[f"{p}_{x}" for p in PILLARS for x in ("score", "mean")], position(i, low, high).alias("position"), mean_side.alias("mean_side"), *own)
    parts = [F.format_string(f"{p} is %.2f, %s (%.2f)", F.col(f"{p}_score"), F.col(f"{p}_side"), F.col(f"{p}_mean")) for p in PILLARS]
    text = F.concat_ws("; ", F.format_string("The index of %s is %.2f, %s (%.2f to %.2f) and %s the mean of %.2f", F.col("city"), i, F.col("position"), low, high, F.col("mean_side"), m), *parts)
    return out.withColumn("summary", text)


def resolve(columns: list[str], candidates: list[str], ignore_case: bool = True) -> str:
    """The first candidate among the columns; outer blanks and byte-order marks don't count. ValueError lists what there is."""
    clean = lambda c: c.strip().lstrip("﻿").strip()
    have = {(clean(c).lower() if ignore_case else clean(c)): c for c in reversed(columns)}
    for c in candidates:
        if (c.lower() if ignore_case else c) in have:
            return have[c.lower() if ignore_case else c]
    raise ValueError(f"none of {candidates} among {columns}")


def score_column(df: DataFrame, pillar: str) -> DataFrame:
    """city, <pillar>_score of a saved score table, whatever its columns are called; texts are trimmed and read as numbers."""
    city = resolve(df.columns, ["city", "City", "CITY"])
    column = resolve(df.columns, [f"{pillar}_score", f"{pillar}_score_corrected", f"{pillar} score", f"{pillar} score corrected", pillar])
    return df.select(F.trim(F.col(f"`{city}`")).alias("city"), F.trim(F.col(f"`{column}`").cast("string")).try_cast("double").alias(f"{pillar}_score"))


def winners(scores: DataFrame) -> DataFrame:
    """Per metric the best city (ties: the first name), by score."""
    w = Window.partitionBy("metric").orderBy(F.desc("score"), "city")
    return scores.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


# The order in which reports list the cities they know; others follow by name.
CITY_ORDER = ("Chandigarh", "Jaipur", "Pune", "Kolkata", "Ranipet")


def city_order(city: Column, order: tuple[str, ...] = CITY_ORDER) -> Column:
    """Place of a city in reports, counted from 1; those not listed come after all others."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), city)
    return F.when(place > 0, place).otherwise(len(order) + 1).cast("int")


def interpretation_reference(saved: DataFrame | None, index: DataFrame | None) -> DataFrame:
    """One row of reference_range(): the saved one if there is one, else made from the final scores. ValueError lists missing columns."""
    names = ["index_mean", "index_sd", "reference_lower", "reference_upper", *[f"{p}_mean" for p in PILLARS]]
    if saved is None:
        if index is None:
            raise ValueError("neither a saved reference range nor final scores")
        return reference_range(index).select(*names)
    clean = {c.strip().lstrip("\ufeff").strip(): c for c in saved.columns}
    missing = [n for n in names if n not in clean]
    if missing:
        raise ValueError(f"the saved reference range lacks {missing}")
    return saved.select(*[F.col(f"`{clean[n]}`").try_cast("double").alias(n) for n in names]).limit(1)


def same_cities(*tables: DataFrame) -> list[str]:
    """What the tables' cities lack of each other, as sentences; none if they are equal."""
    have = [{r.city for r in t.select("city").distinct().limit(10_001).collect()} for t in tables]
    if any(len(h) > 10_000 for h in have):
        raise ValueError("more than 10000 cities")
    every = set().union(*have)
    return [f"table {k}: no {c}" for k, h in enumerate(have, 1) for c in sorted(every - h, key=str)]
