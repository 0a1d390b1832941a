"""Plans and folds whose memory, shuffle or time once grew faster than their input."""

import time

import pytest
from pyspark.sql import functions as F

from netloom.operators import packing, paths, shared
from netloom.plans import geometry, network, solids, state


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)


def test_edges_are_dealt_by_their_number(spark, data_dir, small_tasks):
    """6,000 stops in tasks of 500, for the windows and for the counts."""
    assert plan(network.edges_undirected(spark, data_dir)).count(", 12), REPARTITION_BY_NUM") == 2


def test_greedy_pairs_are_dealt_by_their_number(spark, data_dir, small_tasks):
    p = plan(state.greedy_match(spark, data_dir))
    assert ", 12), REPARTITION_BY_NUM" in p and ", 48), REPARTITION_BY_NUM" in p


def test_scan_lines_are_not_shuffled(spark, data_dir):
    """Triangles are dealt by mesh, once; edges and their scan lines stay where they are."""
    p = plan(solids.scan_crossings(spark, data_dir))
    assert p.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(mesh" in p


def test_mesh_edges_meet_their_reverse_without_a_join(spark, data_dir):
    p = plan(geometry.closed_mesh_edges(spark, data_dir))
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1


def test_turned_boxes_are_made_once_a_row(spark, data_dir):
    """The box's corners were worked out anew at each of their uses."""
    assert plan(solids.turned_labels(spark, data_dir)).count("p_partkey") < 40


def test_shapes_are_turned_once():
    xs, ys = (0.0, 30.0, 0.0), (0.0, 0.0, 20.0)
    assert packing.outlines(xs, ys, packing.TURNS, 2.5, 1.25) is packing.outlines(xs, ys, packing.TURNS, 2.5, 1.25)


def test_packing_spreads_by_items(spark, data_dir, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_A_TASK", 100)
    assert ", 15), REPARTITION_BY_NUM" in plan(state.bitmap_pack(spark, data_dir))


def test_a_long_path_is_cut_in_one_walk(spark):
    """Twelve thousand points on a bed that holds them all: each point once looked at all before it."""
    k = F.col("id")
    points = spark.range(12_000).select(F.lit(1).cast("long").alias("path"), k.alias("i"), (k % 7).cast("double").alias("x"), (k % 5).cast("double").alias("y"))
    marks = spark.createDataFrame([(1, 3.0)], "path long, s double")
    began = time.time()
    got = paths.split_for_bed(points, marks, 1.0, 60.0, 40.0).agg(F.count("*"), F.max("piece")).first()
    assert tuple(got) == (12_000, 0) and time.time() - began < 12


def test_markup_is_dealt_by_its_length(spark, data_dir, small_tasks):
    """Tokens, the levels that they ask and the sweep over elements: each in tasks of 500 rows, not in as many as the session has."""
    from netloom.plans import drawings

    nodes = drawings.page_nodes(spark, data_dir)
    assert "markup" in nodes.inputFiles()[0] and nodes.inputFiles()[4:]  # written by more tasks than four
    p = plan(drawings.markup_text(spark, data_dir))
    assert "REPARTITION_BY_NUM" in p


def test_ends_are_dealt_to_few_cells(spark):
    """Two hundred ends far apart meet in some two hundred cells, not in nine each."""
    from netloom.operators import linking

    k = F.col("id")
    ends = spark.range(200).select(F.lit(1).cast("long").alias("grp"), k.alias("end"), (k * 1.37).alias("x"), (k * 0.91).alias("y"))
    near = linking.near_ends(ends, ends, 0.01)
    assert near.filter("a <> b").count() == 0 and near.count() == 200
    assert linking.SIDE >= 8
    # ends at the border of a cell, on both sides and beyond it
    edge = spark.createDataFrame([(1, 1, 0.16 - 0.004, 0.0), (1, 2, 0.16 + 0.004, 0.0), (1, 3, 0.16 + 0.0145, 0.0), (1, 4, -0.004, -0.004), (1, 5, 0.003, 0.003)], "grp long, end long, x double, y double")
    assert sorted((r["a"], r["b"]) for r in linking.near_ends(edge, edge, 0.01).filter("a < b").collect()) == [(1, 2), (4, 5)]
