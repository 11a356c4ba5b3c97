"""What to chart, tiles, drift checks and user types, on tables whose answers are plain."""

import pytest

from loomwork.operators import charts, cleaning, quality, shape, taxonomy


def test_chart_columns(spark):
    df = spark.createDataFrame([("a", "1", 5), ("b", "x", 6), ("c", "2", None), ("d", "3", 8), ("e", "4", 9)], "name string, mixed string, n int")
    assert charts.numeric_columns(df) == ["mixed", "n"] and charts.chart_columns(df) == ("name", "n")
    assert charts.chart_columns(df.select("n")) is None and charts.chart_columns(df.select("name")) is None
    assert charts.chart_columns(df.limit(0)) is None


def test_pivot_keys_sort_by_number_only_if_all_are(spark):
    df = spark.createDataFrame([("10", "10"), ("9", "9"), ("-1", "x"), ("10", None)], "a string, b string")
    assert [r.key for r in charts.ordered_keys(df, "a").collect()] == ["-1", "9", "10"]
    assert [r.key for r in charts.ordered_keys(df, "b").collect()] == ["", "10", "9", "x"]


def test_tile_counts_all_rows(spark):
    df = spark.createDataFrame([("3",), ("x",), (None,), ("5",)], "v string")
    assert tuple(charts.kpi(df, "v").first()) == (8.0, 4.0, 4) and tuple(charts.kpi(df.limit(0), "v").first()) == (0.0, None, 0)
    assert charts.kpi_measures("2024 Total (net)", "a`b") == {"_2024_total_net_total": "sum(`a``b`)", "_2024_total_net_average": "avg(`a``b`)", "_2024_total_net_count": "count(*)"}


@pytest.mark.parametrize("column, want", [("total", {"sum_total_by_level", "distribution_total"}), ("level", {"count_by_level"}), ("ts", {"per_day_ts"}), ("gst", {"totals_by_state_of_gst"}), ("died", {"rate_died_by_level"}), ("uid", {"unique_uid"}), ("free", set())])
def test_actions_follow_the_type(column, want):
    types = {"total": "amount", "level": "log_level", "ts": "iso_datetime", "gst": "gstin", "died": "outcome_flag", "uid": "user_id", "free": None}
    assert set(charts.quick_actions(types, column)) == want


def test_rest_of_a_pie_and_of_categories(spark):
    df = spark.createDataFrame([(f"k{i}", float(i)) for i in range(1, 6)] + [("bad", -1.0), (None, 0.5)], "k string, v double")
    assert {r.label: r.total for r in shape.pie_slices(df, "k", "v", top=3).collect()} == {"k5": 5.0, "k4": 4.0, "k3": 3.0, "Other": 3.5}
    assert {r.label for r in shape.pie_slices(df, "k", "v", top=5).collect()} == {"k1", "k2", "k3", "k4", "k5", ""}
    assert {r.category: r.n for r in shape.category_counts(df, "k", top=2).collect()} == {"bad": 1, "k1": 1, "(other)": 4, "(null)": 1}


def test_distribution(spark):
    df = spark.createDataFrame([("1", "aa"), ("2", "aa"), (" ", "aa"), ("x", "bbbb"), (None, None)], "n string, s string")
    score = lambda *a, **k: taxonomy.distribution(df, *a, **k).first().score
    assert score("n", high_cardinality=True) == 1.0 and score("n", numeric=True) == pytest.approx(2 / 3)
    assert score("s", low_cardinality=True) == 0.2 and score("s", high_cardinality=True) == 0.2 and score("s", max_length=3) == 0.75
    assert taxonomy.distribution(df.limit(0), "n", numeric=True).first().score is None


def test_user_types_leave_known_ids_alone(spark):
    types = taxonomy.user_types([{"id": "email", "pattern": "x"}, {"id": "order_ref", "pattern": r"ORD-\d+", "headers": ["ref"]}])
    assert len(types) == len(taxonomy.TYPES) + 1
    found = taxonomy.classify(spark.createDataFrame([("ORD-1",), ("ORD-22",)], "ref string"), types)[0]
    assert (found["type"], found["status"], found["confidence"]) == ("order_ref", "accepted", 1.0)


def test_drift_and_contracts(spark):
    df = spark.createDataFrame([("F",), ("x",), (None,)], "s string")
    check = quality.Check("s_drift", "semantic_drift", "s", {"expected_type": "status", "constraint": {"kind": "accepted_values", "values": ["f", "O"]}})
    assert quality.parse_contract(quality.contract("c", [check])) == [check]
    assert [r.s for r in quality.violations(df, check).collect()] == ["x"]
    for bad in (
        quality.Check("Not good", "completeness", "s"), quality.Check("a", "other", "s"), quality.Check("a", "valid_range", "s", {"min": 2, "max": 1}), quality.Check("a", "format", "s", {"pattern": "(a?)+"}),
        quality.Check("a", "semantic_drift", "s", {"expected_type": "t", "constraint": {"kind": "uniqueness"}}), quality.Check("a", "accepted_values", "s", {"values": list(range(101))}), quality.Check("a", "referential_validity", "s"),
    ):
        with pytest.raises(ValueError):
            quality.parse_contract(quality.contract("c", [bad]))


def test_no_year_columns_give_no_rows(spark):
    assert cleaning.unpivot_years(spark.createDataFrame([(1, 2)], "id int, x int"), "total", ["id"], "total").collect() == []
