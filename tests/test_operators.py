import random
import statistics

import pytest
from helpers import as_list, as_set
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetledger.operators.grouping import (
    count_by,
    first_per_key,
    keep_top_values,
    mean_by,
    median_by,
    range_profile,
    top_values,
)
from fleetledger.operators.joins import anti, key_join, left_join, semi
from fleetledger.operators.reshape import (
    comparison_matrices,
    comparison_matrix,
    display_grids,
    explode_combinations,
    header_values,
    interaction_terms,
    one_hot,
    unpivot_metrics,
)
from fleetledger.operators.search import first_keyword, matching_rows, search_columns


def test_left_join_null_keys(rows):
    left = rows([(1, "a"), (None, "b"), (2, "c")], "k int, l string")
    right = rows([(1, "x"), (1, "y"), (None, "n")], "key int, r string")
    keys = [("k", "key")]
    assert as_set(left_join(left, right, keys)) == {
        (1, "a", "x"), (1, "a", "y"), (None, "b", "n"), (2, "c", None)}
    assert (None, "b", None) in as_set(left_join(left, right, keys, null_safe=False))
    assert left_join(left, right, keys, keep_right_keys=True).columns == ["k", "l", "r", "key"]
    with pytest.raises(ValueError):
        key_join(left, right.withColumnRenamed("r", "l"), keys)


def test_left_join_of_a_table_with_itself(rows):
    frame = rows([(1, 10), (2, 20)], "k int, v int")
    totals = frame.groupBy("k").agg(F.sum("v").alias("total"))
    assert as_set(left_join(frame, totals, ["k"])) == {(1, 10, 10), (2, 20, 20)}


def test_set_membership_with_nulls(rows):
    frame = rows([(1,), (2,), (None,)], "k int")
    with_null = rows([(1,), (1,), (None,)], "k int")
    without = rows([(1,)], "k int")
    assert as_set(semi(frame, with_null, "k")) == {(1,), (None,)}
    assert as_set(semi(frame, without, "k")) == {(1,)}
    assert as_set(anti(frame, with_null, "k")) == {(2,)}
    assert as_set(anti(frame, without, "k")) == {(2,), (None,)}


def test_grouped_statistics_leave_out_null_keys(rows):
    frame = rows([("a", 1.0), ("a", None), (None, 9.0), ("b", 4.0)], "k string, v double")
    assert as_set(mean_by(frame, ["k"], "v")) == {("a", 1.0), ("b", 4.0)}
    assert as_set(count_by(frame, ["k"], "v")) == {("a", 1), ("b", 1)}
    assert as_set(range_profile(frame, ["k"], "v", F.col("k") == "b")) == {("b", 4.0, 4.0)}


def test_top_values_break_ties_by_value(rows):
    frame = rows([(v,) for v in [3, 3, 1, 1, 2, 2, 5, None, None, None]], "v int")
    assert [tuple(r) for r in top_values(frame, "v", 2).collect()] == [(1, 2), (2, 2)]
    assert as_list(keep_top_values(frame, "v", 2)) == [(1,), (1,), (2,), (2,)]


def test_first_per_key(rows):
    frame = rows([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 5, "n")], "k string, o int, v string")
    assert as_set(first_per_key(frame, ["k"], ["o"])) == {("a", 1, "y"), (None, 5, "n")}


def test_median_equals_the_median_of_each_group(rows):
    rng = random.Random(7)
    data = [("hot", float(rng.randrange(50))) for _ in range(3000)]
    data += [("wide", rng.random()) for _ in range(1001)] + [("pair", 1.0), ("pair", 2.0), ("one", 7.0)]
    data += [("nothing", None), (None, 1.0), ("copies", 3.0), ("copies", 3.0), ("copies", 3.0)]
    data += [("gap", float(v)) for v in [*range(100), *range(10**9, 10**9 + 100)]] + [("half", 1.0)] * 90 + [("half", 2.0)] * 90
    data += [("nan", 1.0), ("nan", float("nan"))]
    groups = {}
    for key, value in data:
        if key and value is not None and value == value:
            groups.setdefault(key, []).append(value)
    want = {(k, statistics.median(v)) for k, v in groups.items()} | {("nothing", None)}
    frame = rows(data, "k string, v double").repartition(5)
    assert as_set(median_by(frame, ["k"], "v")) == want
    # The way for large groups, first for some of them, then for all.


def test_median_of_extreme_values_and_a_hot_group(spark):
    inf = float("inf")
    data = [("a", v) for v in (-1.7e308, 1.0, 2.0, 3.0, 1.7e308)] + [("b", v) for v in (-inf, 3.0, 5.0, inf)]
    data += [("c", inf), ("c", inf), ("d", None), ("d", float("nan"))]
    frame = spark.createDataFrame(data, "k string, v double")
    assert as_set(median_by(frame, ["k"], "v")) == {("a", 2.0), ("b", 4.0), ("c", inf), ("d", None)}
    hot = spark.range(200_001).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "pmod(id * 7919, 200001) * 0.5 AS v")
    want = {(r.k, r.m) for r in hot.groupBy("k").agg({"v": "median"}).toDF("k", "m").collect()}
    assert as_set(median_by(hot, ["k"], "v")) == want


def test_search(rows):
    frame = rows([("Labor cost", 12, None), ("x", 7, "labor"), (None, 1, "z")], "a string, b int, c string")
    assert as_set(search_columns(frame, "LABOR")) == {("a", 1), ("c", 1)}
    assert as_set(search_columns(frame, "absent")) == set()
    assert matching_rows(frame, "labor|7").count() == 2
    tagged = first_keyword(frame, "a", {"kind": ["cost", "Labor"]})
    assert [r["kind"] for r in tagged.orderBy("b").collect()] == [None, None, "cost"]


MATRIX = [("r1", "x", 1, 1.0), ("r1", "x", 2, None), ("r2", "y", 1, None), ("r2", None, 2, 5.0), ("r3", None, None, 1.0),
          (None, "x", 1, 9.0)]


def test_comparison_matrix_cells(rows):
    frame = rows(MATRIX, "y string, a string, b int, v double")
    total = comparison_matrix(frame, "v", "y", "a", "sum")
    assert total.columns == ["y", "a_x", "a_y"]
    # A group of nulls sums to zero; a missing combination stays null; r3 has no known x at all.
    assert as_set(total) == {("r1", 1.0, None), ("r2", None, 0.0)}
    assert as_set(comparison_matrix(frame, "v", "y", "a", "count")) == {("r1", 1, None), ("r2", None, 0)}
    assert as_set(comparison_matrix(frame, "v", "y", "a", "mean")) == {("r1", 1.0, None), ("r2", None, None)}


def test_comparison_matrices_side_by_side(rows):
    frame = rows(MATRIX, "y string, a string, b int, v double")
    both = comparison_matrices(frame, "v", "y", ["a", "b"], "sum")
    assert both.columns == ["y", "a_x", "a_y", "b_1", "b_2"]
    assert as_set(both) == {("r1", 1.0, None, 1.0, 0.0), ("r2", None, 0.0, 0.0, 5.0)}
    medians = comparison_matrices(frame, "v", "y", ["a", "b"], "median")
    assert as_set(medians) == {("r1", 1.0, None, 1.0, None), ("r2", None, None, None, 5.0)}


def test_matrix_back_to_long_form_is_the_grouped_sum(rows):
    frame = rows([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), ("a", "x", 4.0)], "y string, x string, v double")
    long = unpivot_metrics(comparison_matrix(frame, "v", "y", "x", "sum"), ["y"]).where("value IS NOT NULL")
    want = {(r["y"], f"x_{r['x']}", r["s"]) for r in frame.groupBy("y", "x").agg(F.sum("v").alias("s")).collect()}
    assert as_set(long) == want


def test_headers_are_bounded(rows):
    frame = rows([(i,) for i in range(5)], "v int")
    assert header_values(frame, "v", 5) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        header_values(frame, "v", 4)


def test_display_grids(rows):
    frame = rows([("i", "g", "r1", 1.0), ("i", "h", "r1", 2.0), ("j", "g", "r2", 3.0), ("z", "g", "r2", 9.0)],
                 "ind string, gas string, reg string, v double")
    grid = display_grids(frame, ["ind", "gas"], "reg", ["v"], {"ind": ["i", "j"]})["v"]
    assert grid.columns == ["reg", "ig", "ih", "jg"]
    assert as_set(grid) == {("r1", 1.0, 2.0, None), ("r2", None, None, 3.0)}
    double = frame.union(frame.where("v = 1"))
    with pytest.raises(PySparkException):
        display_grids(double, ["ind", "gas"], "reg", ["v"])["v"].collect()
    assert display_grids(double, ["ind", "gas"], "reg", ["v"], strict=False)["v"].count() == 2


def test_one_hot_gives_null_no_level(rows):
    wide = one_hot(rows([(1, "a"), (2, "b"), (3, None)], "i int, c string"), ["c"])
    assert wide.columns == ["i", "c_a", "c_b"]
    assert as_set(wide) == {(1, 1, 0), (2, 0, 1), (3, 0, 0)}


def test_interaction_terms(rows):
    frame = rows([(1, 0, 1, 5)], "a_1 int, a_2 int, b_1 int, n int")
    wide = interaction_terms(frame, ["a_", "b_"])
    assert wide.columns == ["a_1", "a_2", "b_1", "n", "dummies_constb_1_a_1", "dummies_constb_1_a_2"]
    assert as_set(wide) == {(1, 0, 1, 5, 1, 0)}


def test_explode_combinations(rows):
    frame = rows([(1, ["a", "b"], [7, 8]), (2, [], [9]), (3, ["c"], None)], "i int, x array<string>, y array<int>")
    assert as_set(explode_combinations(frame, ["x", "y"])) == {(1, "a", 7), (1, "a", 8), (1, "b", 7), (1, "b", 8)}


@pytest.mark.parametrize(
    "kind,values,names",
    [("boolean", [True, False], ["x_true", "x_false"]), ("float", [0.1, 2.0], ["x_0.1", "x_2"]), ("double", [1e-05, 12345678.5], ["x_1.0E-5", "x_1.23456785E7"])],
)
@pytest.mark.parametrize("operation", ["sum", "median"])
def test_matrix_columns_of_any_type_are_filled(spark, kind, values, names, operation):
    frame = spark.createDataFrame([("y", v, float(i + 1)) for i, v in enumerate(values)], f"y string, x {kind}, t double")
    (row,) = comparison_matrix(frame, "t", "y", "x", operation).collect()
    assert {n: row[n] for n in names} == {names[0]: 1.0, names[1]: 2.0}


def test_first_keyword_table_equals_the_literal_form(spark):
    from fleetledger.operators.search import first_keyword, first_keyword_table

    texts = [("red ring bolt",), ("large widget",), (None,), ("",), ("ri",), ("a bolt, a ring",), ("a bolt, a ring",)]
    df = spark.createDataFrame(texts, "t string")
    lists = {"shape": ["ring", "bolt", "ri"], "size": ["large", "red"]}
    # 100,000 keywords that no text holds, and rows with a null name or keyword, only make the table longer.
    rows = [(n, w, i) for n, ws in lists.items() for i, w in enumerate(ws)]
    rows += [("shape", f"#{i}#", 10 + i) for i in range(100_000)] + [(None, "ring", 0), ("size", None, 0)]
    table = spark.createDataFrame(rows, "name string, keyword string, priority int")
    got = sorted(map(tuple, first_keyword_table(df, "t", table, list(lists)).collect()), key=str)
    want = sorted(map(tuple, first_keyword(df, "t", lists).collect()), key=str)
    assert got == want
    assert ("ri", "ri", None) in got and (None, None, None) in got
    empty = spark.createDataFrame([("shape", "", 0)], "name string, keyword string, priority int")
    assert sorted(map(tuple, first_keyword_table(df, "t", empty).collect()), key=str) == sorted(
        [(t, None if t is None else "") for (t,) in texts], key=str
    )
