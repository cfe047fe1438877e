import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import geo, stats


@pytest.mark.parametrize(("df", "value"), [(1, 12.7062047362), (10, 2.2281388520), (30, 2.0422724563), (1000, 1.9623390808)])
def test_t_quantile(df, value):
    assert abs(stats.t_quantile(0.975, df) - value) < 1e-8 and math.isclose(stats.t_quantile(0.025, df), -stats.t_quantile(0.975, df))


def test_required_sizes():
    assert stats.pilot_size(1) == 1 and stats.pilot_size(50) == 2 and stats.pilot_size(1001) == 21
    assert stats.required_by_size(1000, 20, 0.0, 1.0) == 1000 and stats.required_by_size(1000, 20, 5.0, 0.0) == 20
    assert stats.required_by_critical(1000, 20, [float("nan"), 1.0]) == 1000 and stats.required_by_critical(1000, 20, [1.0, 1.0]) == 20 and stats.required_by_critical(1000, 20, [1.0, -1.0]) == 20
    n = stats.required_by_size(10_000, 200, 1.0, 0.2)
    assert 350 < n < 400 and abs(n - stats.required_by_critical_moments(10_000, 200, 1.0, 0.2)) <= 2
    ci = stats.interval(1000, 1000, 2.0, 1.0)
    assert ci["ci_lower"] == ci["ci_upper"] == 2.0 and stats.interval(10, 1, 1.0, 0.0)["margin"] is None
    assert len(set(stats.child_seeds(42, 5))) == 5


def meridian_arc(lat):
    """Length from the equator along a meridian, by numeric integration."""
    a, e2 = geo.SEMI_MAJOR, geo.FLATTENING * (2 - geo.FLATTENING)
    phi = np.linspace(0, math.radians(lat), 200_001)
    return float(np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi))


def test_utm(spark):
    df = spark.createDataFrame([(75.0, 30.0, 32643), (76.7794, 30.7333, 32643), (88.3639, 22.5726, 32645), (-70.5, -33.4, 32719), (80.9, 0.0, 32644)], "lon double, lat double, srid int")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.col("srid"))
    there = df.select("*", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), F.col("srid"))
    rows = there.select("*", lon.alias("lon2"), lat.alias("lat2"), geo.utm_srid(F.col("lon"), F.col("lat")).alias("zone")).collect()
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 and r.zone == r.srid for r in rows)
    assert abs(rows[0].x - 500000) < 1e-6 and abs(rows[0].y - 0.9996 * meridian_arc(30.0)) < 1e-4
    assert rows[3].y > 6e6 and abs(rows[4].y) < 1e-6


def test_columns(spark):
    one = spark.range(1)
    first = lambda *c: one.select(*c).first()
    west, south, east, north = geo.envelope(F.lit(73.8567), F.lit(18.5204))
    r = first(west.alias("w"), south.alias("s"), east.alias("e"), north.alias("n"))
    assert math.isclose(r.n - r.s, 100 / 111.32) and math.isclose(r.e - r.w, 100 / (111.32 * math.cos(math.radians(18.5204))))
    assert first(geo.distance_to_segment(F.lit(0.0), F.lit(3.0), F.lit(1.0), F.lit(0.0), F.lit(5.0), F.lit(0.0)))[0] == math.hypot(1, 3)
    assert first(geo.distance_to_segment(F.lit(2.0), F.lit(3.0), F.lit(2.0), F.lit(1.0), F.lit(2.0), F.lit(1.0)))[0] == 2
    ring = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 1), (5, 1), (5, 4), (1, 4))])
    assert first(geo.ring_area(ring))[0] == 12
    assert first(geo.cell_gap(F.lit(3), F.lit(-1), 500.0))[0] == 1000
    assert [v for v in first(*geo.snapped(F.lit(-1.0), F.lit(1001.0), 500.0))] == [-500.0, 1500.0]
    x, y = geo.to_mercator(F.lit(180.0), F.lit(0.0))
    assert abs(first(x)[0] - math.pi * 6378137) < 1e-6 and abs(first(y)[0]) < 1e-6


def test_ranks_and_quantiles_over_range_partitions(spark):
    import random

    import numpy as np

    from roadloom.operators import ranks, scoring

    rnd = random.Random(4)
    rows = [(c, float(rnd.choice([rnd.randint(0, 30), rnd.random()]))) for c in "AB" for _ in range(200)] + [("C", 7.0), ("A", None)]
    df = spark.createDataFrame(rows, "city string, v double").repartition(5)
    below = {(r.city, r.v): (r.n, r.below) for r in ranks.cumulated(df, "v").collect()}
    got = {r.city: (r.q, r.n) for r in ranks.quantile(df, "v", 0.9, "q").collect()}
    for c in "ABC":
        own = [v for k, v in rows if k == c and v is not None]
        assert got[c][1] == len(own) and abs(got[c][0] - np.percentile(own, 90)) < 1e-12
        assert all(below[c, v] == (own.count(v), sum(u < v for u in own)) for v in own)
    assert ranks.quantile(df.limit(0), "v", 0.5, "q").collect() == []
    v = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 1.0), ("c", "m", 5.0), ("d", "m", 9.0), ("a", "k", 2.0)], "city string, metric string, value double")
    others = {(r.city, r.metric): (r.lo, r.hi) for r in scoring.ranges_of_others(v).collect()}
    assert others == {("a", "m"): (1.0, 9.0), ("b", "m"): (1.0, 9.0), ("c", "m"): (1.0, 9.0), ("d", "m"): (1.0, 5.0), ("a", "k"): (None, None)}


def test_small_tables_are_checked_before_they_are_sent(spark):
    from roadloom.functions.frames import few, small

    big, groups = spark.range(1000).selectExpr("id", "id % 10 as g"), spark.range(10).selectExpr("id as g", "id * 2 as v")
    joined = big.join(small(groups, 10), "g")
    assert joined.count() == 1000 and "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="too many"):
        big.join(small(groups, 9), "g").collect()
    assert len(few(groups, 10)) == 10
    with pytest.raises(ValueError, match="too many"):
        few(groups, 9)
