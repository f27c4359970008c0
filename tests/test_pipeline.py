import concurrent.futures
import datetime as dt

import pytest
import yaml
from pyspark.sql import functions as F

from clearwell.operators.merge import upsert
from clearwell.operators.runs import filter_runs, platform_health
from clearwell.plans.bookkeeping import Bookkeeping, active_sources, mask_secrets
from clearwell.plans.pipeline import build, clean_upload, discover, run_folder, run_pipeline
from clearwell.sinks import get_sink, load
from clearwell.sinks import tables
from clearwell.sinks.commitlog import SNAPSHOT, CommitLog, Part, State
from clearwell.sinks.tables import read_table, upsert_table
from clearwell.sinks.writers import merge_statement
from clearwell.streaming.incremental import larger_mark, load_new_files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- sinks


def test_csv_write_then_append(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "id int, s string")
    config = {"type": "csv", "path": str(tmp_path / "out")}
    assert load(df, config).records_loaded == 2
    assert load(df, {**config, "mode": "append"}).load_mode == "append"
    back = spark.read.csv(config["path"], header=True, escape='"')
    assert back.count() == 4 and back.filter("id = 1").first()["s"] == 'a "q", b'
    load(df, config)
    assert spark.read.csv(config["path"], header=True).count() == 2


@pytest.mark.parametrize("compression", ["snappy", "gzip"])
def test_parquet(spark, tmp_path, compression):
    path = str(tmp_path / compression)
    result = load(spark.range(7), {"type": "parquet", "path": path, "compression": compression})
    assert result.success and result.records_loaded == 7 and spark.read.parquet(path).count() == 7
    assert list((tmp_path / compression).glob(f"*.{'gz' if compression == 'gzip' else 'snappy'}.parquet"))


def test_json(spark, tmp_path):
    load(spark.range(3), {"type": "json", "path": str(tmp_path / "j")})
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_load_error_is_returned(spark, tmp_path):
    result = load(spark.range(3), {"type": "parquet", "path": str(tmp_path / "x"), "mode": "upsert"})
    assert not result.success and result.records_failed == 3 and "upsert_key" in result.error
    with pytest.raises(ValueError, match="Unknown loader"):
        get_sink({"type": "ftp"})


def test_merge_statement():
    sql = merge_statement("s.t", "s.i", ["k", "v"], ["k"])
    assert sql == (
        'MERGE INTO s.t t USING s.i s ON t."k" = s."k" WHEN MATCHED THEN UPDATE SET "v" = s."v" '
        'WHEN NOT MATCHED THEN INSERT ("k", "v") VALUES (s."k", s."v")'
    )


def test_merge_in_the_words_of_the_database():
    assert merge_statement("t", "i", ["k", "v"], ["k"], "jdbc:mysql://host/db") == (
        "INSERT INTO t (`k`, `v`) SELECT `k`, `v` FROM i ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"
    )
    assert merge_statement("t", "i", ["k"], ["k"], "jdbc:mariadb://host/db").endswith("UPDATE `k` = VALUES(`k`)")
    assert merge_statement("t", "i", ["k", "v"], ["k"], "jdbc:sqlite:file") == (
        'INSERT INTO t ("k", "v") SELECT "k", "v" FROM i WHERE true ON CONFLICT ("k") DO UPDATE SET "v" = excluded."v"'
    )
    assert merge_statement("t", "i", ["k"], ["k"], "jdbc:sqlite:file").endswith('ON CONFLICT ("k") DO NOTHING')
    assert merge_statement("t", "i", ["k", "v"], ["k"], "jdbc:postgresql://host/db").startswith("MERGE INTO t t USING i s")


def test_upsert_rules(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "k int, v string, o int")
    incoming = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (None, "m", 1), (None, "m", 1)], "k int, v string, o int")
    assert rows(upsert(target, incoming, ["k"], ["o"])) == sorted(
        [(1, "a", 1), (2, "y", 2), (3, "z", 1), (None, "n", 1), (None, "m", 1), (None, "m", 1)], key=str
    )
    with pytest.raises(ValueError):
        upsert(target, incoming, [])
    with pytest.raises(ValueError):
        upsert(target, incoming.withColumn("extra", F.lit(1)), ["k"])
    assert rows(upsert(target, spark.createDataFrame([(1,)], "k int"), ["k"]).filter("k = 1")) == [(1, None, None)]


def test_upsert_table_keeps_untouched_files(spark, tmp_path):
    path = tmp_path / "t"
    upsert_table(spark, str(path), spark.range(1000).selectExpr("id as k", "0 as v"), ["k"], buckets=16)
    before = {p.bucket: p.path for p in CommitLog(spark, str(path)).state().parts}
    assert len(before) == 16
    upsert_table(spark, str(path), spark.createDataFrame([(7, 1), (5000, 1)], "k long, v int"), ["k"])
    after = {p.bucket: p.path for p in CommitLog(spark, str(path)).state().parts}
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2
    assert all((path / p).is_dir() for p in before.values())  # for readers that have started on them
    got = rows(read_table(spark, str(path)))
    assert got == sorted([(i, 1 if i == 7 else 0) for i in range(1000)] + [(5000, 1)], key=str)
    upsert_table(spark, str(path), spark.createDataFrame([(7, 2)], "k long, v int"), ["k"])
    assert sum(not (path / p).is_dir() for p in before.values()) >= 1  # gone with the commit after
    assert read_table(spark, str(path)).where("k = 7").first()["v"] == 2


def test_upsert_table_rules(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", 1.0), (None, "n", 1.0), (2, "b", None)], "k int, v string, w double")
    upsert_table(spark, path, first, ["k"])
    upsert_table(spark, path, spark.createDataFrame([(2, "x"), (None, "m"), (3, "z"), (3, "y")], "k long, v string"), ["k"])
    assert rows(read_table(spark, path)) == sorted(
        [(1, "a", 1.0), (None, "n", 1.0), (2, "x", None), (None, "m", None), (3, "z", None)], key=str
    )
    with pytest.raises(ValueError):
        upsert_table(spark, path, spark.createDataFrame([(1, 1)], "k int, extra int"), ["k"])
    # another key than the table's: all of it is matched
    upsert_table(spark, path, spark.createDataFrame([(9, "a", 5.0)], "k int, v string, w double"), ["v"])
    assert sorted(r["k"] for r in read_table(spark, path).where("v = 'a'").collect()) == [9]
    upsert_table(spark, path, first.limit(0), ["k"])
    assert read_table(spark, path).count() == 5
    assert not list((tmp_path / "t" / "_staging").iterdir())


def test_upsert_takes_over_a_plain_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    upsert_table(spark, path, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    assert rows(read_table(spark, path)) == [(1, "a"), (2, "c")]
    assert not list((tmp_path / "t").glob("part-*"))


def test_two_writers_of_one_bucket(spark, tmp_path, monkeypatch):
    """The second commit of the same bucket is a conflict and starts again from what the first left."""
    path = str(tmp_path / "t")
    upsert_table(spark, path, spark.createDataFrame([(1, 0)], "k int, v int"), ["k"], buckets=1)
    real, met = tables._write, []

    def write(log, rows, layout):
        parts = real(log, rows, layout)
        if not met:
            met.append(True)
            upsert_table(spark, path, spark.createDataFrame([(2, 2)], "k int, v int"), ["k"])
        met.append(True)
        return parts

    monkeypatch.setattr(tables, "_write", write)
    upsert_table(spark, path, spark.createDataFrame([(1, 1)], "k int, v int"), ["k"])
    assert rows(read_table(spark, path)) == [(1, 1), (2, 2)]
    assert len(met) == 4  # the outer merge wrote twice, the inner once


def test_two_writers_of_other_buckets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    upsert_table(spark, path, spark.range(200).selectExpr("id as k", "0 as v"), ["k"], buckets=64)
    bucket = spark.range(200).selectExpr("id as k").withColumn("b", tables._bucket(spark.range(200).toDF("k"), ["k"], 64))
    by = {r["k"]: r["b"] for r in bucket.collect()}
    one, other = 0, next(k for k in by if by[k] != by[0])
    real, met = tables._write, []

    def write(log, rows, layout):
        parts = real(log, rows, layout)
        met.append(True)
        if len(met) == 1:
            upsert_table(spark, path, spark.createDataFrame([(other, 2)], "k long, v int"), ["k"])
        return parts

    monkeypatch.setattr(tables, "_write", write)
    upsert_table(spark, path, spark.createDataFrame([(one, 1)], "k long, v int"), ["k"])
    assert len(met) == 2  # nobody wrote twice
    changed = {r["k"]: r["v"] for r in read_table(spark, path).where("v > 0").collect()}
    assert changed == {one: 1, other: 2} and read_table(spark, path).count() == 200


def test_many_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    frames = [spark.createDataFrame([(n, n), (100, n)], "k int, v int") for n in range(6)]
    with concurrent.futures.ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda df: upsert_table(spark, path, df, ["k"], buckets=4), frames))
    got = {r["k"]: r["v"] for r in read_table(spark, path).collect()}
    assert got.pop(100) in range(6) and got == {n: n for n in range(6)}


def test_rebucket_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert_table(spark, path, spark.range(100).selectExpr("id as k", "0 as v"), ["k"], buckets=2)
    tables.rebucket(spark, path, 8)
    upsert_table(spark, path, spark.range(100).selectExpr("id as k", "1 as v"), ["k"])
    got = read_table(spark, path)
    assert got.count() == 100 and got.where("v = 1").count() == 100
    assert len({p.bucket for p in CommitLog(spark, path).state().parts}) == 8


def test_a_commit_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log._publish(1, "{}") and not log._publish(1, "{}")
    assert log.names("_log") == ["000000000001.json"]


def test_state_needs_few_log_files(spark, tmp_path):
    log, state = CommitLog(spark, str(tmp_path)), State()
    layout = {"schema": "", "keys": [], "buckets": 0}
    for n in range(100):
        state = log.commit(state, [Part(f"data/{n}")], [Part(f"data/{n - 1}")] if n % 2 else [], set(), layout)
    assert log.state().parts == state.parts and log.state().version == 100
    assert len(state.parts) == 50 and len(log.versions()) <= 3 * SNAPSHOT


def test_books_of_many_runs_stay_few_files(spark, tmp_path):
    """Reads do not grow with the runs: after 100 runs a table has a few parts, and all of its rows."""
    store = Bookkeeping(spark, str(tmp_path))
    start = dt.datetime(2024, 5, 1)
    for n in range(100):
        store.append("pipeline_logs", [{"run_id": f"r{n}", "message": "m", "logged_at": start + dt.timedelta(days=n)}])
    parts = CommitLog(spark, store.path("pipeline_logs")).state().parts
    assert len(parts) <= 3 * 7 and max(p.level for p in parts) >= 2
    assert sorted(r["run_id"] for r in store.read("pipeline_logs").collect()) == sorted(f"r{n}" for n in range(100))
    files = [f for f in (tmp_path / "pipeline_logs").rglob("*.parquet")]
    assert len(files) <= 40


def test_upsert_sink_counts_rows(spark, tmp_path):
    config = {"type": "parquet", "path": str(tmp_path / "t"), "mode": "upsert", "upsert_key": "id"}
    assert load(spark.range(5), config).records_loaded == 5
    assert load(spark.range(3, 9), config).records_loaded == 6
    assert read_table(spark, config["path"]).count() == 9


# -- incremental loads


def test_marks_compare_by_type(spark):
    assert larger_mark("9", "10", "bigint", spark) == "10" and larger_mark("9", "10", "string", spark) == "9"
    assert larger_mark(None, "1", "int", spark) == "1" and larger_mark("1", None, "int", spark) == "1"


def test_new_files_are_loaded_once(spark, tmp_path):
    folder, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    rules = [{"name": "filter_rows", "config": {"expression": "id >= 2"}}, "add_audit_columns"]
    for start in (0, 10):
        spark.range(start, start + 5).write.mode("append").parquet(folder)
        load_new_files(spark, folder, "id bigint", rules, target, progress)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [2, 3, 4, 10, 11, 12, 13, 14]


# -- pipelines


@pytest.fixture
def parcels(tmp_path):
    """Sixty parcels in two files whose columns stand in another order; every tenth is entered twice, every fifteenth
    has no town, weights of -1 stand for scales that failed, one mail address is cut off, one line is too long."""
    folder = tmp_path / "parcels"
    folder.mkdir()
    names = ["parcel", "mail", "town", "grams", "posted"]
    records = []
    for i in range(60):
        mail = "desk@" if i == 7 else f"desk{i}@depot.example"
        records.append({"parcel": f"P-{i}", "mail": mail, "town": "" if i % 15 == 0 else f"Town {i % 4}",
                        "grams": -1 if i % 20 == 9 else 100 + i, "posted": f"2024-03-{1 + i % 30:02d}"})
    records += records[::10]
    for file, part, order in (("a.csv", records[::2], names), ("b.csv", records[1::2], names[::-1])):
        lines = [",".join(order), *(",".join(str(r[c]) for c in order) for r in part)]
        (folder / file).write_text("\n".join(lines + (["x,y,z,1,2,3"] if file == "b.csv" else [])) + "\n")
    return str(folder)


def parcel_config(parcels, tmp_path):
    return {
        "source": {"type": "csv", "name": "parcels", "path": parcels, "password": "hidden"},
        "transformations": [
            {"name": "remove_duplicates", "config": {"subset": ["parcel"], "order_by": ["posted"]}},
            {"name": "validate_email", "config": {"column": "mail"}},
            {"name": "fill_missing", "config": {"columns": ["town"], "fill_value": "nowhere"}},
            {"name": "cast_types", "config": {"mappings": {"grams": "int", "posted": "datetime"}}},
            "add_audit_columns",
        ],
        "quality": {"min_records": 50, "unique_keys": ["parcel"], "range_checks": [{"column": "grams", "min": 0}]},
        "destination": {"type": "parquet", "path": str(tmp_path / "clean")},
    }


def test_parcel_pipeline(spark, parcels, tmp_path):
    store = Bookkeeping(spark, str(tmp_path / "books"))
    config = parcel_config(parcels, tmp_path)
    summary = run_pipeline(spark, "parcels", config, store, "test")
    assert (summary["records_extracted"], summary["records_transformed"], summary["records_loaded"]) == (66, 60, 60)
    assert summary["records_failed"] == 1 and "1 lines" in summary["warnings"][-1]
    clean = spark.read.parquet(config["destination"]["path"])
    assert clean.count() == 60 and clean.filter("mail is null").first()["parcel"] == "P-7"
    assert clean.filter("town = 'nowhere'").count() == 4 and clean.filter("grams = -1").count() == 3
    checks = store.read("data_quality_metrics")
    passed = {r["metric_name"]: r["passed"] for r in checks.collect()}
    assert not passed["range_check_grams"] and passed["unique_key_parcel"] and passed["minimum_record_count"]
    run = store.read("pipeline_runs").first()
    assert (run["status"], run["records_loaded"], run["records_failed"]) == ("success", 60, 1)
    assert float(run["quality_score"]) == pytest.approx(100 * summary["quality"]["composite_score"], abs=0.01)
    assert "hidden" not in run["config_snapshot"] and float(run["duration_seconds"]) > 0
    tasks = {r["task_name"]: (r["records_in"], r["records_out"]) for r in store.read("pipeline_tasks").collect()}
    assert tasks == {"extract": (0, 66), "transform": (66, 60), "load": (60, 60)}
    assert "success" in [r["alert_type"] for r in store.read("alert_history").collect()]
    assert platform_health(store.read("pipeline_runs")).first()["health"] == "healthy"


def test_failed_pipeline_is_booked(spark, parcels, tmp_path):
    store = Bookkeeping(spark, str(tmp_path / "books"))
    config = {**parcel_config(parcels, tmp_path), "destination": {"type": "parquet", "path": "x", "mode": "upsert"}}
    with pytest.raises(RuntimeError, match="Load failed"):
        run_pipeline(spark, "parcels", config, store)
    runs = store.read("pipeline_runs")
    assert filter_runs(runs, status="failed").count() == 1 and runs.first()["error_message"]
    assert "failure" in [r["alert_type"] for r in store.read("alert_history").collect()]


def test_halt_on_low_quality(spark, parcels, tmp_path):
    config = {**parcel_config(parcels, tmp_path), "on_low_quality": "fail"}
    config["quality"] = {"min_records": 10_000, "required_columns": ["x"], "max_null_ratio": 0, "max_duplicate_ratio": -1}
    with pytest.raises(RuntimeError, match="quality score"):
        run_pipeline(spark, "parcels", config, Bookkeeping(spark, str(tmp_path / "books")))
    assert not (tmp_path / "clean").exists()


def test_incremental_pipeline(spark, tmp_path):
    store = Bookkeeping(spark, str(tmp_path / "books"))
    folder = str(tmp_path / "orders")
    spark.sql("select id, timestamp_seconds(1700000000 + id * 86400) as at from range(12)").write.parquet(folder)
    spark.read.parquet(folder).createOrReplaceTempView("orders_in")
    config = {
        "incremental": True,
        "source": {
            "type": "sql", "name": "orders", "checkpoint_column": "id",
            "query": "select * from orders_in where :checkpoint is null or id > cast(:checkpoint as bigint)",
        },
        "destination": {"type": "parquet", "path": str(tmp_path / "t"), "mode": "upsert", "upsert_key": ["id"]},
    }
    assert run_pipeline(spark, "orders", config, store)["records_loaded"] == 12
    assert store.checkpoint("orders", "orders") == ("11", "bigint")
    spark.range(9, 15).selectExpr("id", "timestamp_seconds(id) as at").write.mode("append").parquet(folder)
    spark.read.parquet(folder).createOrReplaceTempView("orders_in")
    assert run_pipeline(spark, "orders", config, store)["records_loaded"] == 3
    assert store.checkpoint("orders", "orders") == ("14", "bigint")
    assert run_pipeline(spark, "orders", config, store)["records_loaded"] == 0
    assert store.checkpoint("orders", "orders") == ("14", "bigint")
    assert read_table(spark, str(tmp_path / "t")).count() == 15


def test_build_is_lazy(spark, parcels, tmp_path):
    result = build(spark, "parcels", parcel_config(parcels, tmp_path))
    assert result.data.isStreaming is False and result.before is None and "_etl_run_id" in result.data.columns


def test_folder_of_pipelines(spark, parcels, tmp_path):
    folder = tmp_path / "configs"
    folder.mkdir()
    good = {"source": {"type": "csv", "path": parcels}, "transformations": ["remove_duplicates"],
            "destination": {"type": "csv", "path": str(tmp_path / "out")}}
    (folder / "good.yaml").write_text(yaml.safe_dump(good))
    (folder / "own.yaml").write_text(yaml.safe_dump({**good, "dynamic_dag": False}))
    (folder / "bad.yaml").write_text(yaml.safe_dump({**good, "source": {"type": "nope"}}))
    assert set(discover(str(folder))) == {"good", "bad"}
    results = run_folder(spark, str(folder))
    assert results["good"]["records_loaded"] == 60 and "Unknown source" in results["bad"]["error"]


def test_uploaded_file(spark, parcels):
    cleaned, report, card = clean_upload(spark, parcels)
    summary = report.summary().first()
    assert (summary.rows_in, summary.rows_out, summary.filled_cells) == (66, 60, 4)
    assert cleaned.filter("town = 'UNKNOWN'").count() == 4
    assert card.records == 60 and card.total().first().grade in "AB"


def test_scheduled_run_counts_from_its_interval(spark, parcels, tmp_path):
    store = Bookkeeping(spark, str(tmp_path / "books"))
    start = dt.datetime.now(dt.timezone.utc) - dt.timedelta(hours=24)
    run_pipeline(spark, "parcels", parcel_config(parcels, tmp_path), store, interval_start=start)
    assert float(store.read("pipeline_runs").first()["duration_seconds"]) > 86_000


def test_data_sources(spark, tmp_path):
    store = Bookkeeping(spark, str(tmp_path / "books"))
    source = {"source_id": "1", "name": "crm", "source_type": "api", "is_active": True,
              "connection_config": {"url": "u", "Token": "abc"}, "created_at": dt.datetime(2024, 1, 1)}
    store.append("data_sources", [source, {**source, "source_id": "2", "is_active": False}])
    masked = mask_secrets(store.read("data_sources"))
    assert masked.first()["connection_config"] == {"url": "u", "Token": "***"}
    assert active_sources(masked).count() == 1
    assert store.read("pipeline_logs").count() == 0
