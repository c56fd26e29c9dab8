"""Refinement operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from strata.operators import catalog, dims, refine


def test_dedup_is_deterministic(spark, rows):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "c", 1), (1, "a", 3)], "k int, x string, y int")
    assert rows(refine.dedup(df.repartition(4), ["k"])) == [(1, "a", 3), (2, "c", 1)]
    assert rows(refine.dedup(df, ["k"], [F.col("y").desc()])) == [(1, "a", 9), (2, "c", 1)]


def test_dedup_of_maps(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('a', 2)), (1, map('a', 1)), (2, NULL) AS t(k, m)")
    assert {r.k: r.m for r in refine.dedup(df, ["k"]).collect()} == {1: {"a": 1}, 2: None}


def test_lookup_keeps_rows_and_never_multiplies(spark, rows):
    facts = spark.createDataFrame([(1, "IF"), (2, "XX"), (3, None)], "id int, p string")
    dim = spark.createDataFrame([("IF", "Informatika"), ("IF", "Zweit")], "p string, name string")
    got = refine.enrich_lookup(facts, dim, "p", ["name"], {"l": ("p", {"IF": "label"})}, {"f": F.col("id") >= 2}, "id")
    assert rows(got, "id", "name", "l", "f") == [
        (1, "Informatika", "label", False), (2, None, None, True), (3, None, None, True),
    ]


def test_status_flags_are_null_for_null_status(spark, rows):
    df = spark.createDataFrame([(1, "Bekerja"), (2, None), (3, "Lain"), (1, "Bekerja")], "id int, s string")
    got = refine.status_flags(df, "s", {"work": "Bekerja", "study": "Studi"}, "any", "id")
    assert rows(got, "id", "work", "study", "any") == [
        (1, True, False, True), (2, None, None, None), (3, False, False, False),
    ]


def test_activity_flag(spark, rows):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    acts = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "id int, kind string")
    assert rows(refine.activity_flag(people, acts, "id", "kind", "f")) == [(1, True), (2, True), (3, False)]
    assert rows(refine.activity_flag(people, acts, "id", "kind", "f", 2)) == [(1, False), (2, True), (3, False)]


def test_union_normalise(spark, rows):
    a = spark.createDataFrame([("1", "x", "True")], "pid string, title string, r string")
    b = spark.createDataFrame([("2", "y", ""), ("1", "z", "False")], "kid string, title string, r string")
    shape = lambda key: {"id": key, "title": "title", "flag": F.col("r").try_cast("boolean")}
    got = refine.union_normalise([(a, shape("pid"), "A"), (b, shape("kid"), "B")], "kind", "id")
    assert rows(got, "id", "title", "flag", "kind") == [("1", "x", True, "A"), ("2", "y", None, "B")]


def test_filter_flag(spark, rows):
    df = spark.createDataFrame([(1, "Aktif", "MBKM"), (2, "Aktif", "Riset"), (3, "x", "MBKM"), (4, None, "Semua")], "id int, s string, l string")
    got = refine.filter_flag(df, F.col("s") == "Aktif", "f", "l", ["MBKM", "Semua"], "id")
    assert rows(got, "id", "f") == [(1, True), (2, False)]


def test_latest_valid(spark, rows):
    data = [
        ("IF", "2016-01-01", "2021-01-01", "a"), ("IF", "2019-01-01", "2030-01-01", "b"),
        ("IF", "2018-01-01", "2030-01-01", "c"), ("MA", "2010-01-01", "2015-01-01", "d"),
        ("TI", "2019-01-01", "2030-01-01", "z"), ("TI", "2019-01-01", "2030-01-01", "y"),
        ("IF", "2020-01-01", "2020-12-31", "newest but expired"),
    ]
    df = spark.createDataFrame(data, "p string, start string, end string, id string")
    got = refine.latest_valid(df, "p", "start", "end", "2024-01-01", ["id"], {"f": F.col("id") == "b"})
    assert rows(got, "p", "id", "f") == [("IF", "b", True), ("TI", "y", False)]


def test_conform(spark, rows):
    df = spark.createDataFrame([("1", "2024-02-30"), ("x", "2024-02-29")], "n string, d string")
    got = refine.conform(df, {"n": "int", "d": "date"}).select("n", F.col("d").cast("string"))
    assert rows(got) == [(1, None), (None, "2024-02-29")]


def test_calendar(spark, rows):
    calendar = dims.calendar_dimension(dims.fixed_years(spark, 2020, 2025))
    assert calendar.count() == 72
    got = rows(calendar.where("calendar_id in (1, 72)"))
    assert got == [(1, 202001, 2020, "Ganjil", 1, 1, "Januari"), (72, 202512, 2025, "Ganjil", 4, 12, "Desember")]


@pytest.mark.parametrize(("number", "expected"), [(1, [1, 2, 3, 4, 5]), (2, [6, 7, 8, 9, 10]), (3, [11, 12])])
def test_page(spark, number, expected):
    got = catalog.page_number(spark.range(1, 13), ["id"], number, 5)
    assert [r.id for r in got.collect()] == expected


def test_merge_by_key_last_list_wins(spark, rows):
    lists = [
        spark.createDataFrame(data, "guid string, v int")
        for data in ([("a", 1), ("b", 1)], [("b", 2), (None, 2)], [("b", 3), ("c", 3)])
    ]
    assert rows(catalog.merge_by_key(lists, "guid")) == [("a", 1), ("b", 3), ("c", 3)]
