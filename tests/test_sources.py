"""Sources and sinks over real files and tables."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from strata.operators import runs
from strata.sources import read, runlog, write


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.csv").write_text('id,name,empty\n1,"x, y",\n2,"",""\n')
    (folder / "header_only.csv").write_text("id,name\n")
    (folder / "empty.csv").write_text("")
    return folder


def test_staging_is_all_text_and_blank_is_null(spark, landing, rows):
    df = read.read_staging(spark, str(landing / "a.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["string"] * 3
    assert rows(df) == [("1", "x, y", None), ("2", None, None)]


def test_missing_and_empty_sources_are_skipped(spark, landing):
    assert read.read_staging_or_none(spark, str(landing / "a.csv")).count() == 2
    for name in ("gone.csv", "header_only.csv", "empty.csv"):
        assert read.read_staging_or_none(spark, str(landing / name)) is None


def test_dataset_summary(spark, landing, rows):
    summary = read.dataset_summary(spark, str(landing))
    assert rows(summary, "table_name", "row_count", "size_bytes") == [
        ("a", 2, (landing / "a.csv").stat().st_size), ("header_only", 0, 8),
    ]
    totals = read.summary_totals(summary).first()
    assert (totals.table_count, totals.total_rows, totals.total_size_mb) == (2, 2, 0.0)


def test_summary_reads_no_column_of_parquet(spark, sf):
    got = {r.table_name: r.row_count for r in read.dataset_summary(spark, sf, "parquet").collect()}
    assert len(got) == 14 and got["lineitem"] == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_summary_of_tables_that_are_folders(spark, tmp_path, rows):
    for name, n in (("one", 10), ("two", 3)):
        spark.range(n, numPartitions=3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for folder in (str(tmp_path), f"file:{tmp_path}/"):
        assert rows(read.dataset_summary(spark, folder, "parquet"), "table_name", "row_count") == [("one", 10), ("two", 3)]


def test_replace_table_and_namespace(spark, rows):
    write.create_namespace(spark, "strata_test")
    write.create_namespace(spark, "strata_test")
    first = write.replace_table(spark.range(3), "strata_test.t")
    assert first.count() == 3
    second = write.replace_table(spark.range(5).select(F.col("id").alias("other")), "strata_test.t")
    assert second.columns == ["other"] and second.count() == 5
    assert read.read_table(spark, "strata_test.t").count() == 5


def test_ddl_and_insert(spark, rows):
    """Tables declared and filled in SQL text."""
    write.create_namespace(spark, "strata_test")
    spark.sql(
        """CREATE TABLE IF NOT EXISTS strata_test.raw_metadata
           (id STRING, table_name STRING, column_name STRING, data_type STRING, description STRING, created_at TIMESTAMP)
           USING parquet"""
    )
    spark.sql(
        """INSERT INTO strata_test.raw_metadata VALUES
           ('1', 'customers', 'email', 'STRING', 'Mail', current_timestamp()), ('2', 'orders', 'id', 'BIGINT', 'Key', NULL)"""
    )
    assert rows(spark.sql("SELECT id, data_type FROM strata_test.raw_metadata")) == [("1", "STRING"), ("2", "BIGINT")]


def test_exports(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, ["a"], None), (2, [], "x")], "id int, tags array<string>, t string")
    write.export_json(df, str(tmp_path / "json"))
    assert rows(spark.read.schema(df.schema).json(str(tmp_path / "json"))) == rows(df)
    write.export_csv(df.drop("tags"), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text.splitlines()[0] == "id,t"


def test_replaced_files_keep_their_schema(spark, tmp_path):
    df = spark.range(2).select("id", F.lit(None).cast("string").alias("n"))
    write.replace_files(df, str(tmp_path / "t"))
    assert write.replace_files(df.where("id = 1"), str(tmp_path / "t")).count() == 1


def test_run_log(spark, tmp_path, rows):
    folder = str(tmp_path / "runs")
    start = datetime(2024, 7, 1, tzinfo=timezone.utc)
    for n, seconds in enumerate((1.5, 2.25)):
        results = {
            "a": {"row_count": 10 + n, "status": "PASS", "written": True},
            "b": {"row_count": 0, "status": "REJECT", "written": False},
        }
        begun = start + timedelta(days=n)
        runlog.append_run(runlog.run_record(spark, "p", results, begun, begun + timedelta(seconds=seconds)), folder)
    log = runlog.read_runs(spark, folder)
    assert log.count() == 2
    latest = runs.latest_runs(log, tiebreak=("started_at",)).first()
    assert (latest.duration_sec, latest.tables_total, latest.tables_written, latest.rows_written) == (2.25, 2, 1, 11)
    assert [t.status for t in latest.tables] == ["PASS", "REJECT"]
    assert runs.newest(log, 1, time="file_time", tiebreak=("started_at",)).count() == 1
    assert tuple(runs.total_runtime(runs.latest_runs(log)).first()) == (1, 2.25)
    assert runs.total_runtime(log.where("false")).first().runtime_total_sec is None
    one = spark.createDataFrame([("bronze", 1)], "layer string, n int")
    summary = runs.experiment_summary("X-1", "now", log, one, one, spark.range(4)).first()
    assert (summary.experiment_id, summary.pipeline_runtime_total_sec, summary.umt_rows) == ("X-1", 2.25, 4)
    assert summary.pipelines[0].pipeline == "p" and summary.metadata_quality[0].layer == "bronze"
    assert json.loads(log.select(F.to_json(F.struct("*"))).first()[0])["pipeline"] == "p"


def test_dataset_summary_counts_records_with_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert read.dataset_summary(spark, str(tmp_path)).first()["row_count"] == 2


def test_csv_records_by_byte_ranges(spark, tmp_path, rows):
    """Files cut into many ranges, anywhere within quoted fields, against the csv module."""
    import csv
    import random

    draw = random.Random(3)
    want = {}
    for name in ("one", "two", "three", "empty"):
        records = [] if name == "empty" else [[draw.choice(["a", 'q"uote', "line\nbreak", "\n\n", ",", 'x"\n"y', ""]) + "pad" * draw.randint(0, 5), draw.choice(["1", "b\n\n\nb", '"'])] for _ in range(400)]
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerows([["first", "second"], *records])
        want[name] = len(records)
    (tmp_path / "blank.csv").write_text('a,b\n\n1,"x\n\n"\n  \n2,y\n\n')
    (tmp_path / "open.csv").write_text('a\n"x"\n"never\nclosed')
    (tmp_path / "header.csv").write_text("a,b")
    want |= {"blank": 2, "open": 2, "header": 0}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("64", "1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            counted = read.dataset_summary(spark, str(tmp_path))
            assert dict(rows(counted, "table_name", "row_count")) == want
            if size == "64":
                parts = spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions()
                assert parts > 50  # one file, many tasks
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)

def test_a_failed_replacement_keeps_the_old_rows(spark, tmp_path, rows):
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    path = str(tmp_path / "t")
    write.replace_files(spark.range(2).toDF("id"), path)
    write.create_namespace(spark, "strata_kept")
    write.replace_table(spark.range(2).toDF("id"), "strata_kept.t")
    for replace in (lambda: write.replace_files(broken, path), lambda: write.replace_table(broken, "strata_kept.t")):
        with pytest.raises(Exception, match="no"):
            replace()
    assert rows(spark.read.parquet(path)) == rows(spark.table("strata_kept.t")) == [(0,), (1,)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"] and spark.catalog.listTables("strata_kept")[0].name == "t"


def test_a_table_is_replaced_from_itself(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    write.replace_files(spark.range(4).toDF("id"), path)
    assert rows(write.replace_files(spark.read.parquet(path).where("id > 1"), path)) == [(2,), (3,)]
    write.create_namespace(spark, "strata_kept")
    write.replace_table(spark.range(4).toDF("id"), "strata_kept.own")
    assert rows(write.replace_table(spark.table("strata_kept.own").where("id > 1"), "strata_kept.own")) == [(2,), (3,)]


@pytest.mark.parametrize("same_layout", [True, False])
@pytest.mark.parametrize("cut", range(4))
def test_a_cut_off_replacement_leaves_the_old_or_the_new_table(spark, monkeypatch, rows, same_layout, cut):
    """The process ends before its n-th statement that changes the catalog; whoever reads next finds all rows of one state."""
    from strata.plans.layers import Lake

    name = f"cut_{cut}_{same_layout}".lower()
    lake = Lake(spark)
    lake.replace(spark.range(2).toDF("id"), "strata_cut", name)
    fresh = spark.range(5, 8).toDF("id") if same_layout else spark.range(5, 8).select(F.col("id").cast("string").alias("id"))
    plain, calls = type(spark).sql, []

    def dying(self, text, *args, **kwargs):
        if text.startswith(("ALTER", "DROP")):
            calls.append(text)
            if len(calls) > cut:
                raise KeyboardInterrupt(text)
        return plain(self, text, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", dying)
    try:
        write.replace_table(fresh, f"strata_cut.{name}")
        ended = True
    except KeyboardInterrupt:
        ended = False
    monkeypatch.setattr(type(spark), "sql", plain)
    assert ended == (cut >= (1 if same_layout else 3))
    switched = cut >= (1 if same_layout else 2)
    assert rows(lake.read("strata_cut", name)) == rows(fresh if switched else spark.range(2).toDF("id"))
    assert rows(lake.replace(fresh, "strata_cut", name)) == rows(fresh)
    assert rows(lake.replace(spark.range(1).toDF("other"), "strata_cut", name)) == [(0,)]


def test_an_undeleted_version_does_not_come_back(spark, monkeypatch, rows):
    """A switch that is cut off before it deletes the old version leaves files in the table's own folder; the table may be replaced by any layout."""
    write.create_namespace(spark, "strata_left")
    write.replace_table(spark.range(2).toDF("id"), "strata_left.t")
    plain = type(spark.catalog).refreshTable

    def dying(self, name):
        raise KeyboardInterrupt(name)

    monkeypatch.setattr(type(spark.catalog), "refreshTable", dying)
    with pytest.raises(KeyboardInterrupt):
        write.replace_table(spark.range(3).toDF("id"), "strata_left.t")
    monkeypatch.setattr(type(spark.catalog), "refreshTable", plain)
    assert spark.table("strata_left.t").count() == 3
    assert rows(write.replace_table(spark.range(1).select(F.lit("x").alias("other")), "strata_left.t")) == [("x",)]


def test_a_cut_off_replacement_of_files_is_settled(spark, tmp_path, rows):
    from strata.plans.layers import Lake

    lake = Lake(spark, str(tmp_path))
    lake.replace(spark.range(2).toDF("id"), "gold", "t")
    (tmp_path / "gold" / "t").rename(tmp_path / "gold" / "_t-old-1")  # what a crash after the first rename leaves
    spark.range(3).write.parquet(str(tmp_path / "gold" / "_t-new-1"))
    assert rows(lake.read("gold", "t")) == [(0,), (1,)]
    assert rows(lake.replace(spark.range(1).toDF("id"), "gold", "t")) == [(0,)]


def test_reports_of_any_shape_by_time(spark, tmp_path):
    """Files and folders of JSON; the newest of a kind by file time, other files left out."""
    import os

    for n, name in enumerate(["dataset_summary_b.json", "dataset_summary_a.json", "dataset_summary_c.json", "dataset_summary_d.json", "registration_x.json", "notes.json"]):
        (tmp_path / name).write_text(json.dumps({"no": n, "deep": [{"x": None}]}, indent=1))
        os.utime(tmp_path / name, (1_700_000_000 + n, 1_700_000_000 + n))
    runlog.write_report(spark.range(1), str(tmp_path), "registration_y")
    reports = runlog.read_reports(spark, str(tmp_path), (runs.DATASET_SUMMARY, runs.REGISTRATION))
    assert reports.count() == 6
    log = spark.createDataFrame([], "pipeline string, ended_at timestamp, duration_sec double, rows_written bigint")
    one = spark.createDataFrame([("bronze", 1)], "layer string, n int")
    summary = runs.experiment_summary("X", "now", log, one, one, spark.range(4), reports).first()
    assert [(r.report, json.loads(r.document)["no"]) for r in summary.dataset_summaries] == [("dataset_summary_a", 1), ("dataset_summary_c", 2), ("dataset_summary_d", 3)]
    assert [r.report for r in summary.registration_snapshots] == ["registration_x", "registration_y"]
    assert runs.experiment_summary("X", "now", log, one, one, spark.range(4)).first().dataset_summaries == []
