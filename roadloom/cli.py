"""Command line: run the programme over a folder of node, edge and extent tables.

    python -m roadloom.cli run TABLES OUT [--from-step 2..6] [--city NAME ...] [--force]
    python -m roadloom.cli evaluate TABLES OUT --city NAME
    python -m roadloom.cli validate-seeds TABLES OUT --seeds N [--master-seed M] [--city NAME ...]

Steps: 2 graphs and extents, 3 connectivity, 4 efficiency, 5 hierarchy, 6 composite, validation, ranges and tiers. Each
step keeps its tables under OUT and later runs reuse them; --force makes them anew. All cities go through one plan.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom import pillars
from roadloom.functions.frames import table
from roadloom.functions.stats import child_seeds
from roadloom.operators import network, scoring
from roadloom.sources import files

STEPS = {2: "graphs", 3: "connectivity", 4: "efficiency", 5: "hierarchy", 6: "composite"}


def session() -> SparkSession:
    return SparkSession.builder.appName("roadloom").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()


class Programme:
    """The steps, each reading what the steps before it have kept."""

    def __init__(self, spark: SparkSession, tables: str, out: str, cities: list[str] | None = None, force_from: int = 99):
        self.spark, self.tables, self.out, self.cities, self.force_from = spark, tables, out.rstrip("/"), cities, force_from

    def _only(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("city").isin(self.cities)) if self.cities else df

    def _kept(self, step: int, name: str, make) -> DataFrame:
        suffix = "-".join(sorted(self.cities)).lower() if self.cities else "all"
        return files.reused(self.spark, f"{self.out}/{suffix}/{step}_{STEPS[step]}/{name}", make, step >= self.force_from)

    # step 2
    def nodes(self) -> DataFrame:
        return self._kept(2, "nodes", lambda: self._only(network.clean_nodes(table(self.spark, self.tables, "nodes", "city", "node_id", "x", "y"))))

    def links(self) -> DataFrame:
        raw = table(self.spark, self.tables, "edges", "edge_id", "city", "u", "v", "edge_key", "length", "highway", "loaded_at")
        return self._kept(2, "links", lambda: self._only(network.undirected(network.clean_edges(raw, self.nodes()))))

    def members(self) -> DataFrame:
        return self._kept(2, "largest_component", lambda: network.within_largest(network.components(self.links(), self.nodes())))

    def areas(self) -> DataFrame:
        """km2 of the largest extent given for each city."""
        extents = table(self.spark, self.tables, "city_extents", "city", "extent_area_km2")
        return self._only(extents.filter("extent_area_km2 > 0").groupBy("city").agg(F.max("extent_area_km2").alias("area_km2")))

    # step 3
    def connectivity(self) -> DataFrame:
        return self._kept(3, "metrics", lambda: pillars.connectivity(self.members(), network.induced(self.links(), self.members()), self.areas()))

    # step 4
    def efficiency(self) -> DataFrame:
        return self._kept(4, "metrics", lambda: pillars.efficiency(self.nodes(), self.links()))

    # step 5
    def hierarchy(self) -> DataFrame:
        def make() -> DataFrame:
            simple = network.simple_graph(self.links())
            return pillars.hierarchy(self.links(), simple, self._kept(5, "betweenness", lambda: pillars.betweenness(self.nodes(), simple)))

        return self._kept(5, "metrics", make)

    # step 6
    def scores(self) -> DataFrame:
        return self._kept(6, "scores", lambda: pillars.scores(self.connectivity(), self.efficiency(), self.hierarchy()))

    def index(self) -> DataFrame:
        return self._kept(6, "index", lambda: pillars.index(self.scores()))

    def reports(self) -> None:
        index, where = self.index(), f"{self.out}/reports"
        files.write_csv(index.orderBy(scoring.city_order(F.col("city")), "city"), f"{where}/index")
        files.write_csv(scoring.validation(index), f"{where}/validation")
        files.write_csv(scoring.reference_range(index), f"{where}/reference_range")
        files.write_csv(scoring.tiers(index).orderBy(scoring.city_order(F.col("city")), "city"), f"{where}/tiers")
        files.write_csv(scoring.normalization_reference(self.scores()), f"{where}/normalization_reference")
        files.write_json(self.scores(), f"{where}/scores")

    def run(self, first: int = 2) -> None:
        for step, make in ((2, self.members), (3, self.connectivity), (4, self.efficiency), (5, self.hierarchy), (6, self.index)):
            if step >= first:
                make()
        self.reports()


def evaluate(spark: SparkSession, tables: str, out: str, city: str) -> DataFrame:
    """One city measured anew and read against the reference of all others that a full run has saved under OUT."""
    bounds = scoring.reference_bounds(files.read_csv(spark, f"{out.rstrip('/')}/reports/normalization_reference"))
    where = out.rstrip("/")
    saved = files.read_csv(spark, f"{where}/reports/reference_range") if files.finished(spark, f"{where}/reports/reference_range") else None
    scores = files.read_csv(spark, f"{where}/reports/index") if saved is None else None
    reference = scoring.interpretation_reference(saved, scores and scores.select("city", *[F.col(c).cast("double").alias(c) for c in scores.columns if c.endswith("_score")]))
    own = Programme(spark, tables, f"{out.rstrip('/')}/evaluated", [city])
    wide = own.connectivity().join(own.efficiency(), "city", "full_outer").join(own.hierarchy(), "city", "full_outer")
    index = scoring.composite(scoring.pillar_scores(scoring.evaluated(scoring.long_form(wide, list(scoring.METRICS)), bounds)))
    result = scoring.interpretation(index, reference)
    files.write_csv(result, f"{out.rstrip('/')}/reports/evaluation_{city.lower()}")
    files.write_text(result, f"{out.rstrip('/')}/reports/evaluation_{city.lower()}_text", "summary")
    return result


def validate_seeds(spark: SparkSession, tables: str, out: str, count: int, master: int = 42, cities: list[str] | None = None) -> DataFrame:
    """The adaptive closeness estimate under several seeds, and how the estimates spread."""
    own = Programme(spark, tables, out, cities)
    members, links = own.members(), network.induced(own.links(), own.members())
    runs = None
    for run, seed in enumerate(child_seeds(master, count), 1):
        one = pillars.closeness(members, links, seed % 100_003).select("city", F.lit(run).alias("run"), F.lit(seed).alias("seed"), "estimate", "sample_size", "relative_margin", "ci_lower", "ci_upper")
        runs = one if runs is None else runs.unionByName(one)
    files.write_csv(runs, f"{out.rstrip('/')}/reports/seed_runs")
    return runs.groupBy("city").agg(F.count("*").alias("runs"), F.avg("estimate").alias("mean_estimate"), F.coalesce(F.stddev_samp("estimate"), F.lit(0.0)).alias("sd_estimate"), F.avg("sample_size").alias("mean_sample_size"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="roadloom")
    sub = parser.add_subparsers(dest="what", required=True)
    for name in ("run", "evaluate", "validate-seeds"):
        p = sub.add_parser(name)
        p.add_argument("tables")
        p.add_argument("out")
        p.add_argument("--city", action="append")
        if name == "evaluate":
            p.add_argument("name", nargs="?", help="a city, as with --city")
        if name == "run":
            p.add_argument("--from-step", type=int, default=2, choices=sorted(STEPS))
            p.add_argument("--force", action="store_true")
        if name == "validate-seeds":
            p.add_argument("--seeds", type=int, required=True)
            p.add_argument("--master-seed", type=int, default=42)
    args = parser.parse_args(argv)
    spark = session()
    if args.what == "run":
        cities = args.city or files.known_cities(table(spark, args.tables, "nodes", "city"))
        problems = files.preflight(table(spark, args.tables, "nodes", "city", "x", "y"), table(spark, args.tables, "edges", "city", "length"), table(spark, args.tables, "city_extents", "city"), cities)
        if problems:
            print("\n".join(problems), file=sys.stderr)
            return 1
        Programme(spark, args.tables, args.out, args.city, args.from_step if args.force or args.from_step > 2 else 99).run(args.from_step)
    elif args.what == "evaluate":
        cities = [*(args.city or []), *([args.name] if args.name else [])]
        if not cities:
            parser.error("evaluate needs a city")
        for city in cities:
            evaluate(spark, args.tables, args.out, city).show(truncate=False)
    else:
        validate_seeds(spark, args.tables, args.out, args.seeds, args.master_seed, args.city).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
