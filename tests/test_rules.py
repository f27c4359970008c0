import datetime as dt
import warnings

import pytest
from support import values
from pyspark.sql import functions as F

from clearwell.operators import rules
from clearwell.operators.aggregate import aggregate_daily
from clearwell.operators.casts import cast_types
from clearwell.operators.dateformats import infer_formats
from clearwell.operators.dedup import remove_duplicates
from clearwell.operators.fill import fill_missing
from clearwell.operators.rules import apply_rules, register_transformation
from clearwell.operators.shape import add_audit_columns, filter_rows, rename_columns, select_columns
from clearwell.operators.text import normalize_text, validate_email


# -- duplicates


def test_full_duplicates(people):
    assert remove_duplicates(people, {}).count() == 4


def test_subset_keep_last(people):
    out = remove_duplicates(people, {"subset": ["id"], "keep": "last", "order_by": ["name"]})
    assert out.count() == 4 and out.columns == people.columns


def test_subset_first_and_last_differ(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 1, "w")], "k string, o int, v string")
    first = remove_duplicates(df, {"subset": "k", "order_by": "o"})
    last = remove_duplicates(df, {"subset": "k", "keep": "last", "order_by": "o"})
    assert sorted(values(first, "v")) == ["w", "x"]
    assert sorted(values(last, "v")) == ["y", "z"]


def test_subset_with_map_column(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, o int").withColumn("m", F.create_map("k", "o"))
    out = remove_duplicates(df, {"subset": ["k"], "order_by": ["o"]}).first()
    assert out["m"] == {"a": 1}


def test_keep_none(people):
    assert remove_duplicates(people, {"subset": ["id"], "keep": False}).count() == 3
    assert remove_duplicates(people, {"keep": False}).count() == 3


def test_subset_without_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y")], "k string, o int, v string")
    with pytest.warns(UserWarning, match="order_by"):
        assert remove_duplicates(df, {"subset": ["k"]}).first()["o"] == 1
    result = apply_rules(df, [{"name": "remove_duplicates", "config": {"subset": ["k"]}}])
    assert result.applied == ["remove_duplicates"] and result.data.count() == 1 and result.notes


def test_fills_need_order(people):
    with pytest.raises(ValueError, match="order_by"):
        fill_missing(people, {"strategy": "ffill"})


def test_duplicates_of_empty_frame(spark):
    df = spark.createDataFrame([], "id int, name string")
    assert remove_duplicates(df, {}).count() == 0
    assert remove_duplicates(df, {"subset": ["id"], "order_by": ["name"]}).count() == 0


def test_nan_equals_nan_and_null_equals_null(spark):
    df = spark.createDataFrame([(float("nan"), None), (float("nan"), None), (0.0, "a"), (-0.0, "a")], "x double, y string")
    assert remove_duplicates(df, {}).count() == 2


# -- missing values


def test_constant(people):
    out = fill_missing(people, {"columns": ["name"], "fill_value": "N/A"})
    assert out.filter("name = 'N/A'").count() == 1


def test_mean(people):
    filled = values(fill_missing(people, {"columns": ["score"], "strategy": "mean"}).filter("id = 14"), "score")
    assert filled == pytest.approx([73.5, 73.5])


@pytest.mark.parametrize("strategy", ["mean", "median", "mode", "ffill"])
def test_staged_fill_gives_the_same(people, strategy):
    config = {"columns": ["score"], "strategy": strategy, "order_by": ["id"]}
    plain, staged = fill_missing(people, config), fill_missing(people, {**config, "stage": True})
    assert sorted(values(plain, "score")) == pytest.approx(sorted(values(staged, "score")))


def test_mean_of_text_takes_the_constant(people):
    out = fill_missing(people, {"columns": ["name", "score"], "strategy": "mean"})
    assert "UNKNOWN" in values(out, "name") and None not in values(out, "score")


def test_median_and_mode(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (4, "b"), (10, "a"), (None, None)], "x int, s string")
    assert values(fill_missing(df, {"columns": ["x"], "strategy": "median"}).filter("s is null"), "x") == [3.0]
    assert values(fill_missing(df, {"columns": ["s"], "strategy": "mode"}).filter("x is null"), "s") == ["a"]


def test_mode_of_all_null_takes_the_constant(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert values(fill_missing(df, {"strategy": "mode"}), "s") == ["UNKNOWN", "UNKNOWN"]


def test_all_null_mean_stays_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert values(fill_missing(df, {"strategy": "mean"}), "x") == [None, None]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert sorted(values(fill_missing(df, {"strategy": "mean"}), "x")) == [1.0, 2.0, 3.0]
    assert sorted(values(fill_missing(df, {"fill_value": 9}), "x")) == [1.0, 3.0, 9.0]


def test_drop_and_threshold(people):
    assert fill_missing(people, {"columns": ["name"], "strategy": "drop"}).count() == 4
    assert fill_missing(people, {"threshold": 0.5, "fill_value": 0}).count() == 5
    assert fill_missing(people, {"threshold": 0.1, "fill_value": 0}).count() == 1


def test_constant_that_does_not_fit(people):
    result = apply_rules(people, [{"name": "fill_missing", "config": {"columns": ["age"], "fill_value": "UNKNOWN"}}])
    assert result.data.schema["age"].dataType.simpleString() == "bigint" and "age" in result.notes[0]
    widened = fill_missing(people, {"columns": ["age"], "widen": True})
    assert "UNKNOWN" in values(widened, "age")


def test_fractional_constant_widens_whole_numbers(people):
    out = fill_missing(people, {"columns": ["age"], "fill_value": 0.5})
    assert 0.5 in values(out, "age")


# -- text


def test_normalize(spark):
    df = spark.createDataFrame([("\t A   B\n",), ("NaN",), (None,), ("x\x1cy",)], "s string")
    assert values(normalize_text(df, {}), "s") == ["a b", None, None, "x y"]
    assert values(normalize_text(df, {"lowercase": False}), "s")[0] == "A B"


def test_normalize_casts_other_types(spark):
    df = spark.createDataFrame([(1,)], "n int")
    assert values(normalize_text(df, {"columns": ["n", "absent"]}), "n") == ["1"]


def test_email(people):
    out = validate_email(people, {})
    assert out.filter("email is null").count() == 1 and out.count() == 5
    assert validate_email(people, {"action": "drop"}).count() == 4
    assert validate_email(people.drop("email"), {}).count() == 5


# -- casts


def test_cast_int(spark):
    df = spark.createDataFrame([("1",), ("2",), ("abc",), ("4",)], "count string")
    out = cast_types(df, {"mappings": {"count": "int", "absent": "int"}})
    assert values(out, "count") == [1, 2, None, 4]


@pytest.mark.parametrize(
    "text, number",
    [("1e3", 1000.0), (" 5 ", 5.0), ("1d", None), ("1f", None), ("1_000", None), ("0x10", None), ("nan", None),
     (".5", 0.5), ("5.", 5.0), ("", None), ("inf", float("inf")), ("-Infinity", float("-inf"))],
)
def test_number_grammar(spark, text, number):
    df = spark.createDataFrame([(text,)], "n string")
    assert values(cast_types(df, {"mappings": {"n": "float"}}), "n") == [number]


def test_int_grammar(spark):
    df = spark.createDataFrame([("9007199254740993",), ("5.0",), ("1.5",), ("1e2",)], "n string")
    assert values(cast_types(df, {"mappings": {"n": "int"}}), "n") == [9007199254740993, 5, None, 100]
    kept = apply_rules(df, [{"name": "cast_types", "config": {"mappings": {"n": "int"}, "fractional": "keep"}}])
    assert kept.data.schema["n"].dataType.simpleString() == "string" and "fractional" in kept.notes[0]


def test_cast_datetime(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-06-15",), ("not-a-date",)], "d string")
    out = values(cast_types(df, {"mappings": {"d": "datetime"}}), "d")
    assert out == [dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 15), None]


def test_cast_bool(spark):
    df = spark.createDataFrame([("False",), ("1",), ("",), (None,), ("maybe",)], "b string")
    assert values(cast_types(df, {"mappings": {"b": "bool"}}), "b") == [False, True, None, None, None]
    truthy = cast_types(df, {"mappings": {"b": "bool"}, "truthy": True})
    assert values(truthy, "b") == [True, True, False, False, True]


def test_cast_raise(spark):
    df = spark.createDataFrame([("1",), ("x",)], "n string")
    out = cast_types(df, {"mappings": {"n": "int"}, "errors": "raise"})
    with pytest.raises(Exception, match="cast_types: n to int"):
        out.collect()


def test_cast_to_type_name(spark):
    df = spark.createDataFrame([("12.5",), ("x",)], "n string")
    out = cast_types(df, {"mappings": {"n": "decimal(5,1)"}})
    assert [str(v) for v in values(out, "n")] == ["12.5", "None"]


# -- shape


def test_rename_select(people):
    out = rename_columns(people, {"mapping": {"name": "full_name", "absent": "x"}})
    assert select_columns(out, {"columns": ["age", "absent", "full_name"]}).columns == ["age", "full_name"]
    assert select_columns(out, {"columns": ["absent"]}).columns == out.columns


def test_filter(people):
    assert filter_rows(people, {"expression": "age > 30"}).count() == 3
    assert filter_rows(people, {}).count() == 5
    assert filter_rows(people, {"expression": "age != 28"}).count() == 3
    assert filter_rows(people, {"expression": "age != 28", "null_result": "keep"}).count() == 4


def test_audit(people):
    row = add_audit_columns(people, {"pipeline_name": "p", "run_id": "r", "loaded_at": "2024-01-02T03:04:05"}).first()
    assert (row["_etl_pipeline"], row["_etl_run_id"]) == ("p", "r")
    assert row["_etl_loaded_at"] == dt.datetime(2024, 1, 2, 3, 4, 5)


# -- aggregation


def test_aggregate_drops_null_keys_and_sums_nothing_to_zero(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, 5.0, 3)], "date string, x double, n int")
    out = aggregate_daily(df, {})
    assert out.columns == ["date", "x", "n"] and [tuple(r) for r in out.collect()] == [("a", 0.0, 3)]


def test_aggregate_without_numbers_is_unchanged(spark):
    df = spark.createDataFrame([("a", "b")], "date string, s string")
    assert aggregate_daily(df, {}).columns == ["date", "s"]


def test_aggregate_truncates_days(spark):
    df = spark.sql("select * from values (timestamp'2024-01-01 10:00:00', 1), (timestamp'2024-01-01 11:00:00', 2) t(date, n)")
    assert aggregate_daily(df, {}).count() == 2
    assert [r["n"] for r in aggregate_daily(df, {"truncate": "day"}).collect()] == [3]


def test_first_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, None)], "k string, o int, v string")
    config = {"group_by": ["k"], "agg_config": {"v": "first"}, "order_by": ["o"]}
    assert values(aggregate_daily(df, config), "v") == ["x"]
    assert values(aggregate_daily(df, {**config, "agg_config": {"v": "last"}}), "v") == ["y"]


# -- engine


def test_rules_run_in_order_with_counts(people):
    result = apply_rules(
        people,
        ["remove_duplicates", {"name": "normalize_text"}, {"name": "filter_rows", "config": {"expression": "age > 30"}}],
        observe=True,
    )
    assert result.data.count() == 2
    assert result.applied == ["remove_duplicates", "normalize_text", "filter_rows"]
    assert result.rows == (5, 2)


def test_bad_rules_are_skipped(people):
    result = apply_rules(
        people,
        ["nope", 7, {"name": "filter_rows", "config": {"expression": "no_such_column > 1"}}, {"config": {}}],
    )
    assert result.applied == [] and len(result.notes) == 4 and result.data.count() == 5


def test_no_rules(people):
    assert apply_rules(people, []).data.count() == 5


def test_own_rule(people):
    register_transformation("adults", lambda df, config: df.filter(F.col("age") >= config.get("from", 18)))
    try:
        assert apply_rules(people, [{"name": "adults", "config": {"from": 100}}]).data.count() == 2
    finally:
        del rules.RULES["adults"]


def test_audit_gets_pipeline_and_run(people):
    row = apply_rules(people, ["add_audit_columns"], "customers", "run-9").data.first()
    assert (row["_etl_pipeline"], row["_etl_run_id"]) == ("customers", "run-9")


def test_config_is_not_changed(people):
    rule = {"name": "add_audit_columns", "config": {"run_id": "mine"}}
    apply_rules(people, [rule], "p", "run-1")
    assert rule == {"name": "add_audit_columns", "config": {"run_id": "mine"}}


def test_failed_jobs_fail(people):
    def reads(df, config):
        return df.limit(df.selectExpr("raise_error('no')").count() + len(df.selectExpr("raise_error('no') as e").collect()))

    register_transformation("reads", reads)
    with pytest.raises(Exception, match="no"):
        apply_rules(people, ["reads"])


# -- date formats


def dated(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)


def test_the_order_of_day_and_month_is_voted_on(spark):
    found = infer_formats(dated(spark, ["01/02/2024", "03/04/2024", "25/12/2023", None, " "]), ["t"])["t"]
    assert found.formats == ["d/M/yyyy"] and (found.known, found.read) == (3, 3) and not found.unsettled
    assert found.votes["M/d/yyyy"] == 2
    found = infer_formats(dated(spark, ["01-02-2024 10:30", "12-25-2023"]), ["t"])["t"]
    assert found.formats == ["M-d-yyyy"]


def test_unsettled_orders_and_odd_values_are_reported(spark):
    with pytest.warns(UserWarning, match="reads as M/d/yyyy and as d/M/yyyy"):
        out = cast_types(dated(spark, ["01/02/2024"]), {"mappings": {"t": "datetime"}})
    assert values(out, "t") == [dt.datetime(2024, 1, 2)]
    with pytest.warns(UserWarning, match="1 values of t are no dates"):
        out = cast_types(dated(spark, ["13.02.2024", "soon"]), {"mappings": {"t": "date"}})
    assert sorted(values(out, "t"), key=str) == [dt.datetime(2024, 2, 13), None]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-02-03", (2024, 2, 3)), ("2024-02-03T04:05:06", (2024, 2, 3, 4, 5, 6)), ("2024/2/3", (2024, 2, 3)),
        ("3 Feb 2024", (2024, 2, 3)), ("3-Feb-2024", (2024, 2, 3)), ("Feb 3, 2024", (2024, 2, 3)), ("20240203", (2024, 2, 3)),
        ("3 February 2024 14:15", (2024, 2, 3, 14, 15)), ("February 3, 2024", (2024, 2, 3)), ("23.02.24", (2024, 2, 23)),
        ("2024", (2024, 1, 1)), ("99/99/2024", None), ("20249999", None),
    ],
)
def test_formats_that_are_recognised(spark, text, want):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = cast_types(dated(spark, [text]), {"mappings": {"t": "datetime"}})
    assert values(out, "t") == [want and dt.datetime(*want)]


def test_columns_vote_apart_and_given_formats_stand(spark):
    df = spark.createDataFrame([("13/01/2024", "01/13/2024"), ("02/01/2024", "01/02/2024")], "a string, b string")
    out = cast_types(df, {"mappings": {"a": "datetime", "b": "datetime"}})
    assert sorted(tuple(r) for r in out.collect()) == [(dt.datetime(2024, 1, 2),) * 2, (dt.datetime(2024, 1, 13),) * 2]
    given = cast_types(df, {"mappings": {"a": "datetime"}, "formats": ["MM/dd/yyyy"]})
    assert sorted(values(given, "a"), key=str) == [dt.datetime(2024, 2, 1), None]
