"""The operators that split what would otherwise be one task, against brute force on small data, and the plans."""

import collections
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clearwell.catalog.base import QUERIES
from clearwell.operators import carry, dedup, quantiles
from clearwell.operators.carry import carry_fill
from clearwell.operators.fill import fill_missing, most_frequent
from clearwell.operators.profile import column_samples, profile_columns
from clearwell.operators.quantiles import column_quantiles, grouped_quantiles
from clearwell.session import materialize


def exact(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("shape", ["spread", "hot", "two", "one"])
def test_grouped_quantiles(spark, shape):
    rng = random.Random(5)
    make = {
        "spread": lambda: rng.gauss(0, 100),
        "hot": lambda: 7.0 if rng.random() < 0.4 else rng.random() * 1000,
        "two": lambda: float(rng.randrange(2)),
        "one": lambda: 3.5,
    }[shape]
    rows = [("big", make()) for _ in range(20_000)] + [("small", make()) for _ in range(7)] + [("single", make())]
    rows += [("big", None), ("small", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    # Small limits, so that the brackets and not the whole-group path do the work; the second one narrows them.
    for accuracy, most_ranked in ((500, 1_000_000), (64, 20)):
        out = grouped_quantiles(df.withColumn("w", -F.col("v")), ["k"], ["v", "w"], probs, accuracy, most_ranked).collect()
        assert {r["k"] for r in out} == {"big", "small", "single"}
        for r in out:
            known = [v for k, v in rows if k == r["k"] and v is not None and v == v]
            assert r["n0"] == r["n1"] == len(known)
            assert r["q0"] == pytest.approx([exact(known, p) for p in probs])
            assert r["q1"] == pytest.approx([exact([-v for v in known], p) for p in probs])


def test_a_task_ranks_few_values_of_any_group(spark):
    """Brackets hold at most the stated number of values besides their ends, however large the group is."""
    df = spark.range(60_000).selectExpr("id % 2 as k", "cast(hash(id) as double) as __v0").repartition(4)
    probs, accuracy, most = [0.05, 0.5, 0.95], 64, 50
    sketches = materialize(df.groupBy("k").agg(*quantiles._sketches(1, probs, accuracy)))
    brackets = quantiles._narrowed(df, sketches, ["k"], 1, probs, accuracy, most)
    joined = df.join(brackets, "k")
    counts = [F.count_if((F.col("__v0") > F.col("__lo")[r]) & (F.col("__v0") < F.col("__hi")[r])) for r in range(3)]
    row = joined.groupBy("k").agg(F.greatest(*counts).alias("most")).agg(F.max("most")).first()[0]
    assert 0 < row <= most


def test_medians_of_several_columns_read_the_table_twice(spark, tmp_path):
    """One scan for the sketches, one for the ranking, whatever the number of columns."""
    spark.range(1000).selectExpr("id % 3 as k", "id as a", "-id as b", "id * 2 as c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = grouped_quantiles(df, ["k"], ["a", "b", "c"], [0.5])
    plan = physical_plan(out)
    assert plan.count(f"{tmp_path}/t]") == 1 and "Python" not in plan
    got = {r["k"]: (r["q0"][0], r["q1"][0], r["q2"][0]) for r in out.collect()}
    assert got[0] == (pytest.approx(499.5), pytest.approx(-499.5), pytest.approx(999.0))


def test_groups_without_values(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0), ("b", 3.0, None)], "k string, v double, w double")
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], ["v", "w"], [0.5]).collect()}
    assert got["a"]["n0"] == 0 and got["a"]["q0"] is None and got["a"]["q1"] == [1.5]
    assert got["b"]["q0"] == [3.0] and got["b"]["q1"] is None
    assert grouped_quantiles(df.limit(0), ["k"], ["v"], [0.5]).collect() == []


def test_column_quantiles_leave_out_unknown_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None), (4, None)], "a int, b double")
    assert column_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0]}
    assert column_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0]}
    assert column_quantiles(df.limit(0), ["a"], [0.5]) == {} and column_quantiles(df, [], [0.5]) == {}


@pytest.mark.parametrize("most_inside", [10, 100_000])
def test_column_quantiles(spark, most_inside):
    """With coarse sketches and tiny brackets every narrowing step is taken."""
    rng = random.Random(3)
    rows = [
        (rng.gauss(0, 9), 7.0 if rng.random() < 0.6 else rng.random() * 20, rng.randrange(3), None if i % 9 else i)
        for i in range(12_000)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c int, d int").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = column_quantiles(df, ["a", "b", "c", "d"], probs, accuracy=50, most_inside=most_inside)
    for i, c in enumerate("abcd"):
        known = [r[i] for r in rows if r[i] is not None]
        assert got[c] == pytest.approx([exact(known, p) for p in probs])


def modes(df, **options):
    found = most_frequent(df, df.columns, **options)
    return tuple(df.sparkSession.range(1).select(*[v.alias(c) for c, v in found.items()]).first())


def test_most_frequent_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b", 1, None), ("a", 1, None), ("a", 2, None), ("b", 2, None)], "s string, n int, x double")
    assert modes(df) == ("a", 1, None)
    assert modes(df.limit(0)) == (None, None, None)


@pytest.mark.parametrize("tracked", [16, 10_000])
def test_most_frequent_of_many_values(spark, tracked):
    """A small sketch forgets values; what it can't decide is grouped."""
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        hot = rng.random()
        rows.append((
            7 if hot < 0.3 else i, f"t{rng.randrange(400):03d}", i, -1.5 if hot < 0.02 else float(rng.randrange(3000)),
            dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(5)), bytes([i % 9]),
        ))
    df = spark.createDataFrame(rows, "a int, b string, c bigint, d double, e timestamp, f binary").repartition(5)
    want = []
    for i in range(6):
        counted = collections.Counter(r[i] for r in rows)
        most = max(counted.values())
        want.append(min(v for v, n in counted.items() if n == most))
    got = modes(df, tracked=tracked)
    assert tuple(bytes(v) if isinstance(v, bytearray) else v for v in got) == tuple(want)


def test_only_undecided_columns_are_grouped(spark):
    df = spark.range(2000).selectExpr("id as k", "id % 3 as few", "if(id % 2 = 0, 'x', string(id)) as half")
    plan = physical_plan(df.select(*[v.alias(c) for c, v in most_frequent(df, ["few", "half"]).items()]))
    assert "Expand" not in plan
    plan = physical_plan(df.select(*[v.alias(c) for c, v in most_frequent(df, df.columns).items()]))
    assert "Aggregate" in plan


def test_fills_keep_the_digits_of_known_values(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, Decimal("0.1234567890123456789"), 1)] * 2 + [(None, None, None)], "a long, b decimal(20,19), c long")
    for strategy in ("mean", "median"):
        out = fill_missing(df, {"strategy": strategy})
        known = out.where("c = 1").first()
        assert known["a"] == big and known["b"] == Decimal("0.1234567890123456789")
        assert dict(out.dtypes)["c"] == "double"
        assert None not in tuple(out.orderBy("c").collect()[0])


def brute_carry(rows, forward, keyed):
    ordered = sorted(rows, key=lambda r: (r[0] or "", r[1]) if keyed else r[1], reverse=not forward)
    seen, out = {}, {}
    for p, o, v in ordered:
        group = p if keyed else None
        if v is not None:
            seen[group] = v
        out[o] = seen.get(group)
    return out


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("rows_per_block, fan", [(7, 3), (40, 1024), (10_000, 1024)])
def test_carry_fill(spark, monkeypatch, forward, keyed, rows_per_block, fan):
    """The first case fills tails of tails, four levels up."""
    monkeypatch.setattr(carry, "FAN", fan)
    rng = random.Random(11)
    # One key owns most rows, one is null, and gaps are longer than a block.
    rows = [
        (rng.choice(["hot"] * 6 + ["a", "b", None]), i, float(i) if rng.random() < 0.08 else None) for i in range(600)
    ]
    df = spark.createDataFrame(rows, "p string, o int, v double").repartition(5)
    out = carry_fill(df, ["v"], ["o"], ["p"] if keyed else [], forward, rows_per_block)
    # "!" marks an operator that refers to a column its input lacks.
    assert "!Filter" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["o"]: r["v"] for r in out.collect()}
    assert len(got) == 600 and got == brute_carry(rows, forward, keyed)


@pytest.mark.parametrize("forward", [True, False])
def test_carry_fill_with_copies(spark, forward):
    """Copies of one row have places of their own; each gets its value and none is lost."""
    rows = [("k", 0, 1.0)] + [("k", 5, None)] * 500 + [("k", 9, None), ("k", 10, 4.0), ("k", 11, None)]
    df = spark.createDataFrame(rows, "p string, o int, v double").repartition(4)
    out = sorted(((r["o"], r["v"]) for r in carry_fill(df, ["v"], ["o"], ["p"], forward, 20).collect()), key=str)
    want = [(0, 1.0)] + [(5, 1.0)] * 500 + [(9, 1.0), (10, 4.0), (11, 4.0)]
    if not forward:
        want = [(0, 1.0)] + [(5, 4.0)] * 500 + [(9, 4.0), (10, 4.0), (11, None)]
    assert out == sorted(want, key=str)


def test_places_are_dense_and_copies_are_dealt_out(spark):
    df = spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) as o", "1 as v").repartition(4)
    placed = carry._placed(df, ["o"], [], True)
    got = [(r["__place"], r["o"]) for r in placed.collect()]
    assert sorted(p for p, _ in got) == list(range(4000))
    assert [o for _, o in sorted(got)] == sorted(o for _, o in got)


def test_no_window_of_a_fill_is_larger_than_a_block(spark):
    """Whatever the keys: windows run by block, joins by block number, and nothing of the table's size is in the plan."""
    df = spark.range(5000).selectExpr("0 as p", "id as o", "if(id % 50 = 0, id, null) as v")
    out = carry_fill(df, ["v"], ["o"], ["p"], True, 100)
    plan = physical_plan(out)
    assert "SinglePartition" not in plan and "from_json" not in plan
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert out.where("v = o div 50 * 50").count() == 5000


def test_carry_fill_of_odd_tables(spark):
    schema = "p string, o int, v double"
    assert carry_fill(spark.createDataFrame([], schema), ["v"], ["o"]).collect() == []
    one = carry_fill(spark.createDataFrame([(None, None, None)], schema), ["v"], ["o"], ["p"])
    assert [tuple(r) for r in one.collect()] == [(None, None, None)]
    # a column may be filled and order or part the rows as well
    rows = [("a", 1, 1.0), ("a", None, None), (None, 3, 2.0)]
    out = carry_fill(spark.createDataFrame(rows, schema), ["p", "v"], ["o"], rows_per_block=1).collect()
    assert sorted(map(tuple, out), key=str) == sorted([("a", 1, 1.0), ("a", None, None), ("a", 3, 2.0)], key=str)


def test_carry_fill_keeps_leading_gaps_and_types(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "x", None), (3, None, None)], "o int, v string, w string")
    out = sorted(tuple(r) for r in carry_fill(df, ["v", "w"], ["o"], rows_per_block=1).collect())
    assert out == [(1, None, "a"), (2, "x", "a"), (3, "x", "a")]


# -- duplicate counts


def some_copies(spark):
    rows = [("a", 1, 1.0), ("a", 1, 1.0), ("a", None, 1.0), (None, 1, 1.0), (None, 1, 1.0), (None, None, None)]
    rows += [(None, None, None), ("b", 2, float("nan")), ("b", 2, float("nan")), ("c", 3, 0.0), ("c", 3, -0.0)]
    rows += [(f"t{i % 40}", i % 20, None) for i in range(200)]
    return spark.createDataFrame(rows, "s string, n int, x double").repartition(4)


@pytest.mark.parametrize("collide", ["none", "first", "some"])
@pytest.mark.parametrize("keys", [None, ["s"], ["n", "x"]])
def test_duplicate_counts(spark, monkeypatch, collide, keys):
    """Also when the first hash puts rows together that differ."""
    if collide == "first":
        monkeypatch.setattr(dedup, "_first_hash", lambda columns: F.lit(1).cast("long"))
    if collide == "some":
        monkeypatch.setattr(dedup, "_first_hash", lambda columns: F.pmod(F.xxhash64(*columns), F.lit(7)))
    df = some_copies(spark)
    want = df.count() - df.groupBy(*(keys or df.columns)).count().count()
    got = dedup.duplicate_counts(df, keys).first()
    assert (got["total"], got["repeats"]) == (df.count(), want)
    assert tuple(dedup.duplicate_counts(df.limit(0), keys).first()) == (0, 0)


def test_duplicate_counts_of_nested_columns(spark):
    df = spark.createDataFrame([([None, "a"],), (["a", None],), (["a", None],)], "v array<string>")
    assert tuple(dedup.duplicate_counts(df).first()) == (3, 1)


def test_duplicate_counts_shuffle_hashes_only(spark, tmp_path):
    """No text goes through an exchange, and without collisions the table is read once."""
    spark.range(500).selectExpr("repeat(string(id % 300), 50) as t", "id % 3 as n").write.parquet(str(tmp_path / "t"))
    out = dedup.duplicate_counts(spark.read.parquet(str(tmp_path / "t")))
    assert out.first()["repeats"] == 500 - len({(i % 300, i % 3) for i in range(500)})
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString()
    final = final[final.index("Final Plan") : final.index("Initial Plan")]
    assert final.count("FileScan") == 1
    exchanges = [x for x in final.splitlines() if "Exchange" in x and "Reused" not in x]
    assert exchanges and not any("__c0" in x or "t#" in x for x in exchanges)


# -- profiles


def some_columns(spark):
    rng = random.Random(4)
    rows = [
        (i, rng.choice(["a", "b", None]), rng.choice([1.5, 0.0, -0.0, float("nan"), None]), i if i > 700 else None,
         [None, "x"] if i % 2 else ["x", None], Decimal(i % 7) / 4, None)
        for i in range(900)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, s string, x double, late int, l array<string>, d decimal(10,2), no string").repartition(5)


def test_profile_measures(spark):
    df = some_columns(spark)
    got = {r["name"]: r for r in profile_columns(df, order_by="k").collect()}
    rows = sorted(df.collect())
    for i, name in enumerate(df.columns):
        known = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        g = got[name]
        assert g["null_count"] == 900 - len(known) and g["unique_count"] == len({str(v).replace("-0.0", "0.0") for v in known})
        if name in ("k", "x", "late", "d"):
            assert (g["min_val"], g["max_val"]) == (float(min(known)), float(max(known)))
            assert g["mean_val"] == pytest.approx(float(sum(known)) / len(known), abs=1e-4)
        assert len(g["sample_values"]) == min(3, len(known))
    assert got["k"]["sample_values"] == ["0", "1", "2"] and got["late"]["sample_values"] == ["701", "702", "703"]
    assert got["s"]["sample_values"] == [r[1] for r in rows if r[1]][:3] and got["no"]["sample_values"] == []


def test_samples_of_ties_go_by_value(spark):
    df = spark.range(1000).selectExpr("0 as o", "1000 - id as v", "if(id < 2, string(id), null) as w").repartition(4)
    got = {r["name"]: r["sample_values"] for r in column_samples(df, "o").collect()}
    assert got["v"] == ["1", "2", "3"] and got["w"] == ["0", "1"] and got["o"] == ["0", "0", "0"]


def test_a_profile_reads_the_table_once(spark, tmp_path):
    some_columns(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = physical_plan(profile_columns(df, samples=False))
    assert plan.count(f"{tmp_path}/t]") == 1 and "Expand" not in plan
    samples = physical_plan(column_samples(df, "k"))
    assert samples.count(f"{tmp_path}/t]") == 2  # the late column and the empty one; the first rows had all others


# -- plans


def physical_plan(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


RULE_QUERIES = [
    "dedup_full", "dedup_subset_first", "dedup_keep_none", "fill_constant", "fill_mean", "fill_median", "fill_mode",
    "fill_ffill", "fill_ffill_by_key", "normalize_text", "validate_email_drop", "cast_int", "cast_datetime",
    "filter_expr", "aggregate_daily_mixed", "aggregate_daily_spread", "quality_checks", "run_sla", "histogram",
    "upsert_merge", "json_records", "text_lines", "log_levels", "alerts",
]


@pytest.mark.parametrize("name", RULE_QUERIES)
def test_no_python_and_no_cross_join(spark, name):
    from support import SF_DIR

    plan = physical_plan(QUERIES[name](spark, SF_DIR))
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_filter_and_columns_reach_the_scan(spark):
    from support import SF_DIR

    plan = physical_plan(QUERIES["checkpoint_filter"](spark, SF_DIR))
    assert "GreaterThan(o_orderdate" in plan
    plan = physical_plan(QUERIES["filter_expr"](spark, SF_DIR))
    assert "GreaterThan(l_quantity,25.0)" in plan and "l_extendedprice" not in plan
    plan = physical_plan(QUERIES["source_columns"](spark, SF_DIR))
    assert "o_custkey" not in plan and "o_orderstatus" not in plan


@pytest.mark.parametrize("name", ["dedup_full", "dedup_subset_first", "dedup_keep_none", "duplicate_summary"])
def test_duplicates_are_combined_before_the_shuffle(spark, name):
    from support import SF_DIR

    plan = physical_plan(QUERIES[name](spark, SF_DIR)).split("\n\n")[0]
    below = plan.rsplit("Exchange", 1)[1]
    assert "Window" not in plan and "Aggregate" in below
