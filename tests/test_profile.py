"""Profiles and gates."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strata.operators import profile


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([("a", 1), (" ", 2), (None, 2), ("a", None)], "t string, n int")


@pytest.mark.parametrize("plan", profile.PLANS)
def test_profile_counts_blanks(frame, rows, plan):
    got = rows(
        profile.profile_columns(frame, "f", plan=plan),
        "position", "column_name", "data_type", "row_count", "null_count", "null_pct", "distinct_count", "completeness_pct",
    )
    assert got == [
        (0, "t", "StringType()", 4, 2, 50.0, 2, 50.0),
        (1, "n", "IntegerType()", 4, 1, 25.0, 2, 75.0),
    ]


@pytest.mark.parametrize("plan", profile.PLANS)
def test_text_mode_counts_blank_as_value(frame, rows, plan):
    got = rows(profile.profile_columns(frame, "f", "text", plan), "column_name", "distinct_count")
    assert got == [("n", 3), ("t", 3)]


def test_plans_agree_on_odd_values(spark, rows):
    df = spark.sql(
        """SELECT * FROM VALUES (0.0D, TIMESTAMP'2024-01-01 00:00:00', true, array(1), map('a', 1)),
           (-0.0D, NULL, false, array(1), map('a', 1)), (double('NaN'), TIMESTAMP'2024-01-01 00:00:01', true, NULL, NULL),
           (double('NaN'), TIMESTAMP'2024-01-01 00:00:00', NULL, array(2), map('b', 1)) AS t(d, ts, b, a, m)"""
    )
    first = rows(profile.profile_columns(df, "f"))
    assert first == rows(profile.profile_columns(df, "f", plan="once"))
    assert [r[7] for r in sorted(first, key=lambda r: r[1])] == [2, 2, 2, 2, 2]


@pytest.mark.parametrize("distinct", profile.DISTINCT_MODES)
def test_empty_table_has_no_column_rows(frame, distinct):
    assert profile.profile_columns(frame.limit(0), "f", distinct).count() == 0
    assert profile.profile_columns(frame.where("false"), "f", plan="once").count() == 0


def test_approx_is_close(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    exact = {r.column_name: r for r in profile.profile_columns(lines, "l").collect()}
    for r in profile.profile_columns(lines, "l", "approx").collect():
        truth = exact[r.column_name]
        assert (r.row_count, r.null_count) == (truth.row_count, truth.null_count)
        assert abs(r.distinct_count - truth.distinct_count) <= 0.15 * truth.distinct_count + 1


def test_gate(frame, spark):
    got = profile.quality_gate(frame, "f").first()
    assert (got.row_count, got.column_count, got.quality_score, got.status) == (4, 2, 62.5, "QUARANTINE")
    empty = profile.quality_gate(frame.where("false"), "f").first()
    assert (empty.row_count, empty.quality_score, empty.status) == (0, 0.0, "REJECT")
    nulls = profile.quality_gate(spark.range(3).select(F.lit(None).cast("string").alias("x")), "f").first()
    assert (nulls.quality_score, nulls.status) == (0.0, "REJECT")


def test_combined_gate(spark):
    row = "table_name string, row_count bigint, column_count bigint, completeness double, quality_score double, status string"
    first = spark.createDataFrame([("b", 10, 3, 90.0, 90.0, "PASS")], row)
    second = spark.createDataFrame([("a", 5, 7, 60.0, 60.0, "QUARANTINE")], row)
    got = profile.combine_gates([first, second]).first().asDict()
    assert got == {
        "table_name": "b + a", "row_count": 15, "column_count": 3, "completeness": 90.0,
        "quality_score": 75.0, "status": "QUARANTINE",
    }


def test_provenance(frame):
    got = profile.profile_with_provenance(frame, "f", 75.0, "QUARANTINE", ["step"], ["raw"]).first()
    assert (got.row_count, got.column_count, got.quality.silver_completeness) == (4, 2, 62.5)
    assert (got.quality.source_score, got.quality.source_status) == (75.0, "QUARANTINE")
    assert got.schema == {"t": "StringType()", "n": "IntegerType()"}
    assert got.columns["t"].null_count == 2 and got.transformations == ["step"] and got.sources == ["raw"]


def test_unknown_modes_are_refused(frame):
    with pytest.raises(ValueError):
        profile.profile_columns(frame, "f", "guess")
    with pytest.raises(ValueError):
        profile.profile_columns(frame, "f", plan="guess")


@pytest.mark.parametrize("plan", profile.PLANS)
def test_long_texts_that_differ_at_the_end_are_distinct(spark, plan):
    long = "x" * 5000
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",), ("short",), (None,)], "t string")
    assert profile.profile_columns(df, "f", plan=plan).first().distinct_count == 3


def test_long_text_and_its_digest_are_two_values(spark):
    text = "a" * 200
    rows = [(text,), (hashlib.sha256(text.encode()).hexdigest(),), (hashlib.sha512(text.encode()).hexdigest() + "+",), (text,)]
    frame = spark.createDataFrame(rows, "t string")
    for plan in ("per_column", "once"):
        assert profile.profile_columns(frame, "x", plan=plan).first()["distinct_count"] == 3


def test_null_inside_nested_values(spark):
    frame = spark.createDataFrame([([None],), (["null"],), (["null"],)], "a array<string>")
    for plan in ("per_column", "once"):
        assert profile.profile_columns(frame, "x", plan=plan).first()["distinct_count"] == 2


def test_batches_of_many_columns(spark, rows, monkeypatch):
    """Every kind of type over several batches gives the rows of the aggregates per column."""
    frame = spark.sql(
        """SELECT id, cast(id AS int) i, cast(id % 3 AS tinyint) b, id % 2 = 0 f, cast(id / 3 AS float) r, if(id % 4 = 0, -0.0D, 0.0D) z,
                  if(id % 5 = 0, double('NaN'), NULL) nan, date_add(DATE'2024-01-01', cast(id % 7 AS int)) d, timestamp_micros(id) t,
                  timestamp_ntz'2024-03-31 02:30:00' + make_dt_interval(0, cast(id % 3 AS int)) n, cast(id AS decimal(20, 3)) m,
                  if(id % 3 = 0, ' ', if(id % 3 = 1, '', NULL)) s, repeat(cast(id % 4 AS string), 100 + cast(id % 4 AS int) * 20) l,
                  cast(cast(id AS string) AS binary) x, array(id % 2, NULL) a, repeat(' ', 200) w FROM range(50)"""
    )
    want = rows(profile.profile_columns(frame, "f", plan="per_column"))
    for batch in (1, 2, 24):
        monkeypatch.setattr(profile, "BATCH", batch)
        assert rows(profile.profile_columns(frame, "f")) == want
    text = rows(profile.profile_columns(frame, "f", "text", "per_column"))
    assert rows(profile.profile_columns(frame, "f", "text")) == text


def test_batched_profile_reads_columns_once_and_joins_nothing(spark, sf):
    """A scan per batch of its own columns; two aggregates; no distinct aggregate over several columns at once."""
    plan = profile.profile_columns(spark.read.parquet(f"{sf}/lineitem.parquet"), "l")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate stack") == 3 and "Expand" not in plan and "Join" not in plan


def test_sketches_of_parts_give_the_profile(spark, sf):
    """Counts exactly, distinct values within four standard errors; a column that a part lacks is NULL there."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("note", F.when(F.col("l_linenumber") > 2, F.lit(" ")))
    exact = {r.column_name: r for r in profile.profile_columns(lines, "l").collect()}
    parts = None
    for k in range(3):
        part = lines.where(f"l_orderkey % 3 = {k}")
        own = profile.column_sketches(part.drop("note") if k == 0 else part, "l").withColumn("part", F.lit(k))
        parts = own if parts is None else parts.unionByName(own)
    parts = parts.unionByName(profile.column_sketches(lines.where("false"), "l").withColumn("part", F.lit(9)))
    got = {r.column_name: r for r in profile.profile_of_sketches(parts).collect()}
    assert got.keys() == exact.keys()
    missing = lines.where("l_orderkey % 3 = 0 AND l_linenumber > 2").count()
    for name, r in got.items():
        truth = exact[name]
        assert (r.row_count, r.null_count, r.data_type) == (truth.row_count, truth.null_count, truth.data_type)
        assert abs(r.distinct_count - truth.distinct_count) <= max(1, 4 * 0.0163 * truth.distinct_count), name
    assert missing and got["note"].null_count == lines.count()


def test_gate_of_stored_profiles_is_the_scanned_gate(spark, sf, rows):
    frames = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("customer", "orders", "labels")}
    frames["holes"] = spark.sql("SELECT if(id % 3 = 0, ' ', 'x') a, if(id % 2 = 0, NULL, id) b, cast(NULL AS int) c FROM range(31)")
    stored = [profile.table_profile(profile.profile_columns(df, n)) for n, df in frames.items()]
    profiles = stored[0]
    for other in stored[1:]:
        profiles = profiles.unionByName(other)
    scanned = [rows(profile.quality_gate(df, n))[0] for n, df in frames.items()]
    assert rows(profile.gate_of_profiles(profiles)) == sorted(scanned, key=repr)
