"""Seeded sampling without replacement and estimates with confidence, per city.

The order of the nodes is that of an integer hash of id and seed, so a pilot is a prefix of its extension. To take the
first n of a city no city is sorted: nodes below a hash bound that holds n of them with overwhelming probability are
ranked, and only if a city falls short is it ranked whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.defaults import CONFIDENCE, PILOT_FRACTION, PRECISION, SEED
from roadloom.functions.frames import few, local, small, stored
from roadloom.functions.stats import interval, pilot_size, required_by_critical_moments, required_by_size

# A linear congruence over 31 bits that SQL engines can follow.
_FACTOR, _STEP, _SPACE = 1103515245, 12345, 2147483648


def order_hash(node_id: Column, seed: int = SEED) -> Column:
    """Integer in [0, 2^31), the same in any SQL engine with 64-bit integers."""
    once = F.pmod(F.pmod(node_id, F.lit(_SPACE)) * F.lit(_FACTOR) + F.lit(_STEP + 7919 * seed), F.lit(_SPACE))
    turned = F.pmod(once, F.lit(65536)) * 32768 + F.floor(once / 65536)
    return F.pmod(turned * F.lit(_FACTOR) + F.lit(_STEP), F.lit(_SPACE))


def first_n(nodes: DataFrame, wanted: DataFrame, seed: int = SEED) -> DataFrame:
    """(city, node_id) of the first n nodes of each city in hash order. wanted: city, n, population."""
    h = nodes.select("city", "node_id", order_hash(F.col("node_id"), seed).alias("h")).join(small(wanted), "city")
    share = F.col("n") / F.col("population")
    bound = F.when(share >= 0.5, 1.0).otherwise(share + 8 * F.sqrt(share / F.col("population")) + 16 / F.col("population"))
    near = h.filter(F.col("h") < bound * _SPACE)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("city").orderBy("h", "node_id"))).filter("r <= n")
    short = ranked.groupBy("city").agg(F.count("*").alias("got"))
    missing = wanted.join(short, "city", "left").filter("coalesce(got, 0) < least(n, population)").select("city")
    if not missing.isEmpty():
        rest = h.join(small(missing), "city", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("city").orderBy("h", "node_id"))).filter("r <= n")
        ranked = ranked.join(small(missing), "city", "left_anti").unionByName(rest)
    return ranked.select("city", "node_id")


def populations(nodes: DataFrame, size: Callable[[int], int]) -> DataFrame:
    """city, population, n: one row per city, n by the rule."""
    rows = few(nodes.groupBy("city").agg(F.count("*").alias("population")))
    return local(nodes.sparkSession, [(r.city, r.population, int(size(r.population))) for r in rows], "city string, population bigint, n bigint")


def pilot(nodes: DataFrame, fraction: float = PILOT_FRACTION, seed: int = SEED) -> DataFrame:
    return first_n(nodes, populations(nodes, lambda n: pilot_size(n, fraction)), seed)


def moments(values: DataFrame, *columns: str) -> DataFrame:
    """Per city: n, mean and sample deviation of each column, nulls and NaN left out."""
    out = []
    for c in columns:
        ok = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        out += [F.count(ok).alias(f"{c}_n"), F.avg(ok).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(ok), F.lit(0.0)).alias(f"{c}_sd")]
    return values.groupBy("city").agg(*out)


def adaptive(nodes: DataFrame, measure: Callable[[DataFrame], DataFrame], columns: list[str], rule: str = "size", fraction: float = PILOT_FRACTION, precision: float = PRECISION, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """Estimates of the means of columns over all nodes of each city, from as many sources as the precision needs.

    measure maps (city, node_id) sources to one row per source with city, source and the columns. The pilot's rows are
    kept and only the extension of the same order is measured. Only a few numbers per city reach the driver.
    rule: `size` (iterates on n, one column) or `critical` (iterates on the critical value, largest n of all columns).
    """
    spark = nodes.sparkSession
    start = populations(nodes, lambda n: pilot_size(n, fraction))
    first = first_n(nodes, start, seed)
    done = stored(measure(first))
    need = []
    for r in few(start.join(moments(done, *columns), "city", "left")):
        sizes = []
        for c in columns:
            n, mean, sd = r[f"{c}_n"] or 0, r[f"{c}_mean"] or 0.0, r[f"{c}_sd"] or 0.0
            if rule == "size":
                sizes.append(required_by_size(r.population, r.n, mean, sd, precision, confidence))
            else:
                sizes.append(r.population if n < 2 else required_by_critical_moments(r.population, r.n, mean, sd, precision, confidence))
        need.append((r.city, r.population, min(max(*sizes, r.n), r.population), r.n))
    final = local(spark, need, "city string, population bigint, n bigint, pilot bigint")
    rest = first_n(nodes, final.drop("pilot"), seed).join(first, ["city", "node_id"], "left_anti")
    rows = stored(done.unionByName(measure(rest)))
    out = []
    for r in few(final.join(moments(rows, *columns), "city", "left")):
        for c in columns:
            n, mean, sd = r[f"{c}_n"] or 0, r[f"{c}_mean"], r[f"{c}_sd"] or 0.0
            ci = interval(r.population, n, mean or 0.0, sd, confidence)
            out.append((r.city, c, r.population, r.pilot, r.n, n, mean, sd, ci["standard_error"], ci["ci_lower"], ci["ci_upper"], ci["relative_margin"]))
    return local(spark, out, "city string, metric string, population bigint, pilot_size bigint, sample_size bigint, n_finite bigint, estimate double, sd double, standard_error double, ci_lower double, ci_upper double, relative_margin double")
