"""Scalar expressions on their edge cases."""

import pytest
from pyspark.sql import functions as F

from strata.functions import dates, documents, numbers, predicates, text


def values(spark, column, data, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_blank(spark):
    assert values(spark, predicates.is_blank("x"), ["a", " ", "", None]) == [False, True, True, True]


def test_filled(spark):
    data = ["", "{}", "[]", "null", "x", "0", None, " {} "]
    assert values(spark, predicates.filled("x"), data) == [False, False, False, False, True, True, False, False]


def test_threshold_on_text(spark):
    assert values(spark, predicates.at_least("x", 20), ["20", "19", None, "", "many"]) == [True, False, None, None, None]


def test_text_flag(spark):
    assert values(spark, predicates.text_flag("x"), ["True", "False", "", None]) == [True, False, None, None]


def test_any_of_is_three_valued(spark):
    df = spark.createDataFrame([(True, None), (False, None), (None, None), (False, False)], "a boolean, b boolean")
    got = [r[0] for r in df.select(predicates.any_of(["a", "b"])).collect()]
    assert got == [True, None, None, False]


def test_still_valid_boundary(spark):
    got = values(spark, predicates.still_valid("x", "2024-06-30"), ["2024-06-30", "2024-06-29", "", None])
    assert got == [True, False, None, None]


def test_non_blank_drops_null(spark):
    df = spark.createDataFrame([("",), (None,), ("IF",)], "x string")
    assert [r.x for r in df.where(predicates.non_blank("x")).collect()] == ["IF"]


@pytest.mark.parametrize(
    ("month", "term", "quarter_end"), [(1, "Ganjil", 1), (2, "Genap", 1), (7, "Genap", 3), (8, "Ganjil", 3)]
)
def test_term(spark, month, term, quarter_end):
    got = spark.range(1).select(dates.study_term(F.lit(month), "Ganjil", "Genap"), F.ceil(F.lit(month) / 3)).first()
    assert tuple(got) == (term, quarter_end)


def test_freshness(spark):
    as_of = "2024-07-01T00:00:00Z"
    offsets = [7, 7.1, 30, 90, 180, 181]
    stamps = [
        r[0]
        for r in spark.createDataFrame([(float(d),) for d in offsets], "d double")
        .select(F.date_format(F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.col("d") * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .collect()
    ]
    got = values(spark, dates.freshness_score(dates.first_timestamp("x"), as_of), [*stamps, None, "", "soon"])
    assert got == [100, 90, 90, 75, 60, 40, 0, 0, 0]


def test_first_timestamp_reads_offsets(spark):
    got = values(spark, F.unix_seconds(dates.first_timestamp("x")), ["2024-01-01T07:00:00+07:00", "2024-01-01T00:00:00Z"])
    assert got[0] == got[1]


def test_year_and_period(spark):
    assert values(spark, dates.year_of("x"), ["2021-05-03", "", None]) == [2021, None, None]
    assert values(spark, dates.period_key("x"), ["2021", None, "x"]) == [202112, None, None]


def test_five_point(spark):
    assert values(spark, numbers.five_point(F.col("x")), [0.0, 100.0, 49.0, 70.1], "double") == [1, 5, 2, 4]


def test_gate_status(spark):
    got = values(spark, numbers.gate_status(F.col("x")), [80.0, 79.99, 60.0, 59.99], "double")
    assert got == ["PASS", "QUARANTINE", "QUARANTINE", "REJECT"]


def test_target_status(spark):
    got = values(spark, numbers.target_status(F.col("x"), F.lit(80.0)), [80.0, 64.0, 63.9, None], "double")
    assert got == ["Tercapai", "On Track", "Tidak Tercapai", ""]


def test_attainment_floor(spark):
    got = values(spark, numbers.attainment_pct(F.lit(50.0), F.col("x"), 1), [0.0, None, 25.0], "double")
    assert got == [5000.0, 5000.0, 200.0]
    assert values(spark, numbers.attainment_pct(F.lit(50.0), F.col("x")), [0.0, None], "double") == [None, None]


def test_progress(spark):
    shown = numbers.progress_pct(F.col("x"), F.lit(50.0))
    assert values(spark, shown, [40.0, 140.0, None], "double") == [40.0, 100.0, 0.0]
    relative = numbers.progress_pct(F.col("x"), F.lit(0.5), True)
    assert values(spark, relative, [0.25, 1.0], "double") == [50.0, 100.0]


def test_layer_names(spark):
    data = ["gold.x@c", "etl.x", "", "goldx", "silver.a@c"]
    assert values(spark, text.layer_from_name("x"), data) == ["gold", "unknown", "unknown", "unknown", "silver"]
    own = text.layer_of(F.when(F.col("x") == "etl.x", "bronze").otherwise(""), "x")
    assert values(spark, own, data)[:2] == ["gold", "bronze"]
    assert values(spark, text.layer_tag("x"), ["silver"]) == ["Silver_Layer"]


def test_layer_rank(spark):
    df = spark.createDataFrame([(x,) for x in ("gold", "x", "bronze", "unknown")], "x string")
    assert [r.x for r in df.orderBy(text.layer_rank("x"), "x").collect()] == ["bronze", "gold", "unknown", "x"]


def test_bad_json(spark):
    assert values(spark, documents.json_object("x"), ["zzz", "[1]", None, '{"a":1,"b":{"c":2}}']) == [
        {}, {}, {}, {"a": "1", "b": '{"c":2}'},
    ]
    assert values(spark, documents.json_list("x"), ['["a","b"]', "zzz", None, "[]"]) == [["a", "b"], [], [], []]
    assert values(spark, documents.json_field("x", "a.b", "none"), ['{"a":{"b":1}}', '{"a":{"b":null}}', "zzz"]) == [
        "1", "none", "none",
    ]


def test_column_stats_of_both_shapes(spark):
    nested = '{"columns":{"c":{"null_count":1,"completeness_pct":50.0}}}'
    root = '{"c":{"null_pct":10.0}}'
    other = '{"quality":{"score":1}}'
    got = values(spark, F.map_keys(documents.column_stats("x")), [nested, root, other, None])
    assert got == [["c"], ["c"], [], []]


def test_surrogate_key_is_stable(spark):
    got = values(spark, numbers.surrogate_key("x"), ["a", "a", "b"])
    assert got[0] == got[1] != got[2]


def test_surrogate_key_tells_null_places_apart(spark):
    from strata.functions.numbers import surrogate_key

    frame = spark.createDataFrame([(2000, None), (None, 2000), (None, None), (2000, 2000)], "a int, b int")
    assert frame.select(surrogate_key("a", "b").alias("id")).distinct().count() == 4
