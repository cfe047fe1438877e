"""Queries over the operators on texts and training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.frames import stored, table
from roadloom.llm import mixing, packing, repair, spans
from roadloom.operators.multivalue import values_column
from roadloom.plans.problems import class_names


def _reference(spark: SparkSession, sf_dir: str) -> repair.Reference:
    """The canonical list: a fixed table of a few dozen entries (more than 100,000 are refused)."""
    rows = table(spark, sf_dir, "highway_classes", "highway", "label").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the reference list is too long to rank against in every worker")
    return repair.Reference([(r.highway, r.label) for r in rows])


def _free_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges whose text isn't an entry's name; their distinct texts of one value; the entry of each."""
    reference = _reference(spark, sf_dir)
    names = sorted({n for n, _ in reference.forms})
    edges = table(spark, sf_dir, "edges", "edge_id", "highway").filter(F.col("highway").isNotNull() & ~F.col("highway").isin(names))
    single = edges.select("highway").distinct().select("highway", values_column(F.col("highway"), class_names(spark, sf_dir)).alias("values")).filter(F.size("values") == 1).select("highway", F.col("values")[0].alias("text"))
    single = stored(single)  # a row per distinct text: what follows reads it several times
    mapped = repair.map_values(single, "text", reference)
    return edges, single, single.join(mapped.hint("merge"), "text").select("highway", "text", F.col("entry").alias("highway_class"), "score")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, entries = _free_entries(spark, sf_dir)
    return edges.join(entries.select("highway", "highway_class"), "highway").select("edge_id", "highway_class")


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that no entry is meant by, with the number of edges that hold it and its best score."""
    edges, _, entries = _free_entries(spark, sf_dir)
    held = edges.groupBy("highway").agg(F.count("*").alias("n_edges"))
    return held.join(entries.filter(F.col("highway_class") == repair.UNMATCHED), "highway").groupBy("text").agg(F.sum("n_edges").alias("n_edges"), F.round(F.max("score"), 6).alias("best_score"))


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The container sizes; a fixed table of a few rows (more than 1,000 are refused)."""
    rows = table(spark, sf_dir, "pack_capacities", "spec_id", "capacity_tokens").limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("too many container sizes for one pass")
    return [(r.spec_id, r.capacity_tokens) for r in rows]


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents", "doc_id", "text"), _capacities(spark, sf_dir))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container size: containers used and the fewest possible, the share of them filled, and those beyond a limit."""
    return packing.report(p6_pack(spark, sf_dir), table(spark, sf_dir, "pack_capacities", "spec_id", "capacity_tokens"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = mixing.sized(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixing.mixture(held, table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = mixing.sized(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixing.shares(held, table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents", "doc_id", "text"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_amounts(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_unmatched, p6_pack, p6_fill, p7_mix, p7_shares, p8_found, p8_shares)}


# Every window of 200 characters by its hash; those of two documents are joined to runs.
_SPANS = """
d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, i, hash(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, n - 199)) AS i FROM d)),
twice AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
k AS (SELECT doc_id, i FROM w SEMI JOIN twice USING (h)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM k),
x AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 - min(i) AS span_chars FROM x GROUP BY doc_id, run)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": f"WITH {_SPANS} SELECT doc_id, span_start, span_chars FROM spans",
        "p8_shares": f"WITH {_SPANS}, n AS (SELECT doc_id, coalesce(max(length(text)), 0) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id), s AS (SELECT doc_id, CAST(sum(span_chars) AS BIGINT) AS c, count(*) AS k FROM spans GROUP BY doc_id) SELECT doc_id, n_chars, coalesce(c, 0) AS shared_chars, coalesce(k, 0) AS n_spans, CASE WHEN n_chars > 0 THEN coalesce(c, 0) / n_chars ELSE 0 END AS shared_share FROM n LEFT JOIN s USING (doc_id)",
    }
