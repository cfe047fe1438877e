import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {"p1_found", "p2_found", "p3_found", "p5_found", "components", "city_index"} <= set(q)


def test_core_does_not_know_llm():
    code = "import sys; import __spark_entry__ as e, roadloom.plans.network, roadloom.plans.problems, roadloom.cli; sys.exit(any(m.startswith('roadloom.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0


def test_entry(spark, small):
    if small != "/root/testdata/sf0.001":
        pytest.skip("no tables")
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["p2_found", "edges_undirected", "components", "efficiency_mean", "interpretation", "extent_selection", "polygon_area", "road_class_parse", "closeness", "graph_simplify", "graph_simplify_directed", "articulation_bridges", "edge_betweenness", "required_n", "index_metrics", "alternative_extent", "extent_polygon", "osm_roads", "graphml_edges", "building_load", "relation_rings", "admin_classify", "p3_found"])
def test_against_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS FROM '{small}/{t}'")
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rel.fetchall())
    assert sorted(names) == columns and got == want
