import json

import pytest

from clearwell.operators.autoclean import autoclean, clean_names
from clearwell.operators.charts import before_after, type_groups
from clearwell.operators.profile import profile_columns
from clearwell.operators.quality import LowQualityError, evaluate_quality, quality_gate, summarize_checks
from clearwell.operators.scorecard import scorecard

LIMITS = {
    "max_null_ratio": 0.10,
    "max_duplicate_ratio": 0.05,
    "min_records": 10,
    "required_columns": ["sku"],
    "unique_keys": ["sku"],
    "range_checks": [{"column": "pieces", "min": 0, "max": 1000}],
}


def checks_of(df, config):
    return {r["name"]: r for r in evaluate_quality(df, config).checks.collect()}


def test_faultless_frame_passes_all(stock):
    summary = evaluate_quality(stock, LIMITS, "stock").summary().first()
    assert (summary["composite_score"], summary["failed_checks"], summary["total_records"]) == (1.0, 0, 12)


def expected(bad_stock):
    """The numbers behind the checks, counted from the rows."""
    rows = [tuple(r) for r in bad_stock.collect()]
    known = [r[0] for r in rows if r[0] is not None]
    return {
        "overall_null_ratio": round(sum(v is None for r in rows for v in r) / (3 * len(rows)), 4),
        "required_column_not_null_sku": round(sum(r[0] is None for r in rows) / len(rows), 4),
        "duplicate_row_ratio": round(1 - len(set(rows)) / len(rows), 4),
        "unique_key_sku": float(len(known) - len(set(known))),
        "range_check_pieces": float(sum(not 0 <= r[1] <= 1000 for r in rows)),
        "minimum_record_count": float(len(rows)),
    }


def test_damaged_frame(bad_stock):
    checks = checks_of(bad_stock, LIMITS)
    assert {n: c["actual_value"] for n, c in checks.items()} == expected(bad_stock)
    limits = {"overall_null_ratio": 0.1, "duplicate_row_ratio": 0.05}
    want = {n: v <= limits.get(n, 0) for n, v in expected(bad_stock).items()} | {"minimum_record_count": True}
    assert {n: c["passed"] for n, c in checks.items()} == want


def test_details_are_json(bad_stock):
    checks = checks_of(bad_stock, LIMITS)
    read = lambda name: json.loads(checks[name]["details"])
    assert read("overall_null_ratio")["null_ratio_per_column"] == {"sku": round(1 / 14, 4), "pieces": 0.0, "hall": round(8 / 14, 4)}
    assert read("unique_key_sku") == {"columns": ["sku"], "duplicate_count": 2}
    assert read("range_check_pieces") == {"column": "pieces", "min": 0, "max": 1000}


def test_report_as_dict(bad_stock):
    report = evaluate_quality(bad_stock, LIMITS, "stock").to_dict()
    assert report["pipeline_name"] == "stock" and report["total_records"] == 14
    assert [c["name"] for c in report["checks"]] == list(expected(bad_stock))[:2] + [c["name"] for c in report["checks"]][2:]
    assert report["checks"][-1]["details"] == {"record_count": 14}


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    assert not checks_of(df, {"required_columns": ["email"]})["required_column_exists_email"]["passed"]
    checks = checks_of(df, {"expected_columns": ["id", "x"], "unique_keys": ["x", ["id", "x"]]})
    assert json.loads(checks["expected_schema_columns"]["details"]) == {"missing_columns": ["x"]}
    assert "unique_key_id" in checks and "unique_key_x" not in checks


def test_empty_frame(stock):
    checks = checks_of(stock.limit(0), LIMITS)
    assert not {"overall_null_ratio", "duplicate_row_ratio"} & set(checks)
    assert not checks["minimum_record_count"]["passed"] and not checks["required_column_not_null_sku"]["passed"]
    assert checks["unique_key_sku"]["passed"]


@pytest.mark.parametrize("codes, bad", [(("A-1", "B-22"), 0), (("A-1", "b-2", "C3"), 2), ((None, "A-1"), 0)])
def test_regex(spark, codes, bad):
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    check = checks_of(df, {"regex_checks": [{"column": "code", "pattern": r"^[A-Z]-\d+$"}]})["regex_check_code"]
    assert check["actual_value"] == bad and check["passed"] == (bad == 0)


def test_regex_is_anchored_at_the_start_only(spark):
    df = spark.createDataFrame([("ab1",), ("xab",)], "s string")
    assert checks_of(df, {"regex_checks": [{"column": "s", "pattern": "ab|zz"}]})["regex_check_s"]["actual_value"] == 1


def test_range_over_text_numbers(spark):
    df = spark.createDataFrame([("5",), ("500",), ("n/a",), (None,)], "s string")
    check = checks_of(df, {"range_checks": [{"column": "s", "max": 100}]})["range_check_s"]
    assert check["actual_value"] == 1


def test_unknown_category_counts_as_validity(spark):
    df = spark.createDataFrame([("a", "odd", True, 1.0), ("b", "validity", False, 0.0)], "name string, category string, passed boolean, actual_value double")
    assert summarize_checks(df).first()["composite_score"] == 0.5
    assert summarize_checks(df.limit(0)).first()["composite_score"] == 0.0


def test_gate():
    assert quality_gate(0.9) and not quality_gate(0.7) and not quality_gate(0.1)
    with pytest.raises(LowQualityError):
        quality_gate(0.4, on_low_quality="fail")
    assert not quality_gate(0.6, on_low_quality="fail")


# -- scorecard


def by_name(card):
    return {r.dimension: r for r in card.rows.collect()}


def found(row):
    return [(f.column, f.measure, round(f.value, 3)) for f in row.findings]


def test_empty_scorecard(spark):
    card = scorecard(spark.createDataFrame([], "a int"))
    total = card.total().first()
    assert (total.score, total.grade, total.records, total.columns, total.findings) == (0.0, "F", 0, 0, 5)


def test_scorecard_parts(spark):
    rows = [(i, "x" if i % 2 else "X", str(i) if i < 5 else "n/a", "same", float(i), None if i < 6 else 1) for i in range(10)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "id int, tag string, mixed string, fixed string, v double, gap int")
    card = scorecard(df, "f")
    parts = by_name(card)
    assert parts["completeness"].measures["missing"] == 8 and found(parts["completeness"]) == [("gap", "missing share", 0.667)]
    assert parts["uniqueness"].score == 83.3
    assert found(parts["uniqueness"]) == [(None, "repeated share", 0.167), ("fixed", "distinct values", 1.0)]
    assert parts["validity"].score == 100.0
    assert parts["consistency"].score == round((100 + 50 + 100 + 70) / 4, 1)
    assert set(found(parts["consistency"])) == {("mixed", "numeric share", 0.583), ("tag", "spellings", 1.0)}
    assert parts["timeliness"].score == 75.0
    total = card.total().first()
    want = sum(parts[d].score * w for d, w in zip(parts, (0.30, 0.20, 0.20, 0.15, 0.15)))
    assert total.score == pytest.approx(want, abs=0.051) and total.grade == "B" and total.findings == 6


def test_one_dimension_measures_only_itself(spark):
    card = scorecard(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), dimensions=["completeness"])
    assert [r.dimension for r in card.rows.collect()] == ["completeness"] and card.total().first().score == 75.0


def test_outliers(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(90)] + [(1e6,)] * 10, "v double")
    part = by_name(scorecard(df))["validity"]
    assert part.score == 90.0 and found(part) == [("v", "outlier share", 0.1)]


def test_long_texts(spark):
    df = spark.createDataFrame([("a" * 501,), ("b",)], "s string")
    part = by_name(scorecard(df))["validity"]
    assert part.score == 50.0 and found(part) == [("s", "long share", 0.5)]


def test_timeliness_names(spark):
    rows = [("2024-01-01", "no", True, 5), ("later", None, False, None)]
    df = spark.createDataFrame(rows, "order_date string, status string, is_created boolean, updated int")
    part = by_name(scorecard(df))["timeliness"]
    # Half of the dates parse, no status does, a Boolean never does, half of the numbers are known.
    assert part.score == round((50 + 0 + 0 + 50) / 4, 1) and part.measures["date_columns"] == 4
    assert found(part)[0] == ("order_date", "date share", 0.5)
    assert by_name(scorecard(df, date_limit=3))["timeliness"].score == round(50 / 3, 1)
    assert by_name(scorecard(df, date_columns=["updated"]))["timeliness"].score == 50.0


def test_boolean_column_is_valid(spark):
    assert by_name(scorecard(spark.createDataFrame([(True,), (False,)], "b boolean")))["validity"].score == 100.0


# -- profile and automatic cleaning


def test_profile(spark):
    rows = [(i, None if i < 9 else "x", "c", i / 3) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, rare string, fixed string, v double")
    got = {r["name"]: r for r in profile_columns(df, order_by=["id"]).collect()}
    assert got["id"]["suggested_action"] == "possible ID column" and got["id"]["sample_values"] == ["0", "1", "2"]
    assert got["rare"]["suggested_action"] == "drop (too many nulls)" and got["rare"]["null_pct"] == 0.9
    assert got["rare"]["sample_values"] == ["x"]
    assert got["fixed"]["suggested_action"].startswith("constant") and got["fixed"]["min_val"] is None
    assert (got["v"]["min_val"], got["v"]["max_val"], got["v"]["mean_val"]) == (0.0, 3.0, 1.5)
    assert {r["name"]: r["unique_count"] for r in profile_columns(df, exact=False).collect()}["fixed"] == 1


def test_profile_of_empty_frame(spark):
    row = profile_columns(spark.createDataFrame([], "a int")).first()
    assert row["null_pct"] == 0 and row["sample_values"] == []


def test_clean_names():
    assert clean_names([" First Name ", "a-b.c/d", "__X__", "!!!", "???", "Été"]) == [
        "first_name", "a_b_c_d", "x", "col", "col_2", "été",
    ]


def test_autoclean(spark):
    rows = [
        (1, " a ", None, "10", None), (1, "a", None, "10", None), (2, "None", 1.0, "20", None),
        (3, "", 2.0, "30", None), (4, "nan", 4.0, "x40", 1),
    ]
    df = spark.createDataFrame(rows, "`Row ID` int, Name string, `V.1` double, code string, rare int")
    cleaned, report = autoclean(df, "f.csv")
    got = sorted(tuple(r) for r in cleaned.collect())
    assert cleaned.columns == ["row_id", "name", "v_1", "code"]
    assert got == [(1, "a", 2.0, "10"), (2, "UNKNOWN", 1.0, "20"), (3, "UNKNOWN", 2.0, "30"), (4, "UNKNOWN", 4.0, "x40")]
    assert report.rows == (5, 4) and report.columns == (5, 4)
    assert [tuple(r)[1:] for r in report.step_rows().orderBy("position").collect()] == [
        ("renamed", None, 3), ("dropped", "rare", 1), ("stripped", None, 2), ("repeated rows", None, 1),
        ("filled", "name", 3), ("filled", "v_1", 1),
    ]
    bars = {r["category"]: (r["before"], r["after"]) for r in before_after(report.summary()).collect()}
    assert bars["Rows After Clean"] == (5, 4) and bars["Nulls Filled"] == (0, 4)
    assert report.profiles.where("name = 'code'").first().sample_values


def test_autoclean_casts_numeric_texts(spark):
    df = spark.createDataFrame([(str(i),) for i in range(19)] + [("x",)], "n string")
    cleaned, report = autoclean(df)
    assert cleaned.schema["n"].dataType.simpleString() == "double" and cleaned.filter("n is null").count() == 1
    assert ("made numeric", "n", 19) in report.steps


def test_autoclean_leaves_dates(spark):
    df = spark.sql("select * from values (1, timestamp'2024-01-01'), (2, null) t(id, at)")
    cleaned, report = autoclean(df)
    assert cleaned.filter("at is null").count() == 1 and report.kept_gaps == {"at": 1} and report.steps == []


def test_type_groups(spark):
    df = spark.sql("select 1 a, 1.5D b, 'x' c, true d, current_date() e, array(1) f")
    assert type_groups(df) == {"Numeric": 2, "Text": 1, "Boolean": 1, "DateTime": 1, "Other": 1}
