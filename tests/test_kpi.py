"""KPI facts on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import containment, kpi

TARGETS = {2023: {"K": 77, "L": "BB"}, 2024: {"K": 50, "L": "BB", "M": 80}, 2025: {"K": 60, "L": "A"}}


@pytest.fixture
def spec(spark):
    def build(**settings):
        return kpi.Kpi(**{"code": "K", "value": "pct", "targets": kpi.target_table(spark, TARGETS), "fallback_year": 2024, **settings})

    return build


def test_target_table(spark, rows):
    got = rows(kpi.target_table(spark, TARGETS).where("year = 2025"))
    assert got == [(2025, "K", 60.0, None), (2025, "L", None, "A")]


def test_with_target_falls_back(spark, spec, rows):
    years = spark.createDataFrame([(2023,), (1999,), (None,)], "year int")
    assert rows(kpi.with_target(years, spec(), "year")) == [(1999, 50.0), (2023, 77.0), (None, 50.0)]
    assert rows(kpi.with_target(years, spec(unknown_year=0), "year")) == [(1999, 50.0), (2023, 77.0), (None, 0.0)]
    assert rows(kpi.with_target(years, spec(code="?"), "year")) == [(1999, 0.0), (2023, 0.0), (None, 0.0)]


def test_outcome_share_skips_null_flags(spark, spec, rows):
    data = [(2023, "IF", True, False, True), (2023, "IF", False, True, True), (2023, "IF", False, False, False), (2023, "IF", None, None, None)]
    df = spark.createDataFrame(data, "y int, u string, a boolean, b boolean, any boolean")
    got = kpi.outcome_share(df, spec(floor=None), "y", "u", "total", {"na": "a", "nb": "b"}, ("rest", "any"))
    assert rows(got.drop("fact_id")) == [(202312, "IF", 4, 1, 1, 1, 50.0, 77.0, 64.94)]


@pytest.fixture
def students(spark):
    data = [(1, 2024, "IF", True), (2, 2024, "IF", False), (3, 2024, "MA", False), (4, 2023, "IF", None)]
    return spark.createDataFrame(data, "id int, y int, u string, f boolean")


@pytest.fixture
def awards(spark):
    return spark.createDataFrame([(1, 2024), (1, 2024), (3, 2024), (2, 2020)], "id int, ay int")


@pytest.mark.parametrize(
    ("settings", "per_unit", "expected"),
    [
        ({}, False, {("IF", 2024): (2, 1, 2, 3, 150.0), ("MA", 2024): (1, 0, 2, 2, 200.0), ("IF", 2023): (1, None, 0, None, None)}),
        ({}, True, {("IF", 2024): (2, 1, 1, 2, 100.0), ("MA", 2024): (1, 0, 1, 1, 100.0), ("IF", 2023): (1, None, 0, None, None)}),
        ({"numerator": "any"}, False, {("IF", 2024): (2, 1, 1, 1, 50.0), ("MA", 2024): (1, 0, 1, 1, 100.0), ("IF", 2023): (1, None, 0, 0, 0.0)}),
    ],
)
def test_threshold_share(students, awards, spec, settings, per_unit, expected):
    got = kpi.threshold_share(
        students, awards, spec(**settings), "id", "y", "u", "total", "f", "flagged", "ay", "holders", "ok", per_unit
    )
    found = {(r.u, r.period_key // 100): (r.total, r.flagged, r.holders, r.ok, r.pct) for r in got.collect()}
    assert found == expected


@pytest.mark.parametrize(("numerator", "qualified"), [("sum", 3), ("any", 2)])
def test_participation_counts_overlaps(spark, spec, numerator, qualified):
    people = spark.createDataFrame([(1, "IF"), (2, "IF"), (3, "IF")], "id int, u string")
    acts = spark.createDataFrame([(1, 2023, "a"), (1, 2023, "b"), (1, 2023, "a"), (2, 2023, "a"), (2, 2023, "z")], "id int, y int, k string")
    got = kpi.participation_share(
        people, acts, spec(numerator=numerator, unknown_year=0), "id", "y", "u", "k", {"na": "a", "nb": "b"}, "total", "ok"
    )
    by_period = {r.period_key: r for r in got.collect()}
    active = by_period[202312]
    assert (active.total, active.na, active.nb, active.ok) == (2, 2, 1, qualified)
    idle = by_period[202412]
    assert (idle.total, idle.ok, idle.target, idle.attainment) == (1, 0, 0.0, 0.0)


@pytest.mark.parametrize(("numerator", "share"), [("sum", 150.0), ("any", 100.0)])
def test_qualification(spark, spec, numerator, share):
    df = spark.createDataFrame([("IF", True, True), ("IF", False, True)], "u string, a boolean, b boolean")
    got = kpi.qualification_share(df, spec(numerator=numerator), "u", "total", {"na": "a", "nb": "b"}, "ok").first()
    assert (got.pct, got.period_key, got.target) == (share, 202412, 50.0)


def test_output_per_head(spark, spec, rows):
    outputs = spark.createDataFrame([("A", 2023, True, True), ("A", 2023, False, True), ("B", 2023, True, None)], "g string, y int, r boolean, d boolean")
    heads = spark.createDataFrame([("A",)] * 7, "g string")
    got = kpi.output_per_head(outputs, heads, spec(floor=0.01), "y", "g", {"r_n": "r", "d_n": "d"}, "heads", "eligible")
    assert rows(got, "g", "heads", "eligible", "pct") == [("A", 7, 3, 0.4286), ("B", None, None, None)]


@pytest.mark.parametrize(("strict", "hits", "pct"), [(False, 3, 150.0), (True, 2, 100.0)])
def test_coverage(spark, spec, rows, strict, hits, pct):
    universe = spark.createDataFrame([("IF",), ("MA",)], "p string")
    covered = spark.createDataFrame([("IF",), ("IF",), ("MA",), ("TI",), ("",), (None,)], "p string")
    got = kpi.coverage_share(universe, covered, spec(), "p", [2023, 2024], "total", "hits", strict)
    assert rows(got, "period_key", "total", "hits", "pct") == [(202312, 2, hits, pct), (202412, 2, hits, pct)]


def test_coverage_of_nothing(spark, spec):
    none = spark.createDataFrame([], "p string")
    got = kpi.coverage_share(none, none, spec(), "p", [2024], "total", "hits").first()
    assert (got.total, got.hits, got.pct, got.attainment) == (0, 0, 0.0, 0.0)


def test_capped_share(spark, spec, rows):
    df = spark.createDataFrame([(2024, "IF", 10, 7, 6), (2024, "MA", 10, 1, 2)], "y int, u string, n int, a int, b int")
    got = kpi.capped_share(df, spec(), "y", "u", "n", ["a", "b"], "ok")
    assert rows(got, "u", "ok", "pct") == [("IF", 10, 100.0), ("MA", 3, 30.0)]


def test_realisation(spark, rows):
    df = spark.createDataFrame([("100.10", "50.05", 2025), ("0.20", "", 2025), ("10", "10", 1990)], "p string, r string, y int")
    got = kpi.realisation(df, kpi.target_table(spark, TARGETS), "y", "p", "r", "L", "K", "BB")
    assert rows(got.drop("fact_id")) == [
        (199012, None, 95.0, 100.0, 10.0, 10.0, 100.0, "BB", None),
        (202512, "A", 47.4, 49.9, 100.3, 50.05, 49.9, "BB", 60.0),
    ]


def test_scorecard_and_summary(spark, rows):
    fact = spark.createDataFrame(
        [(202412, 80.0, 80.0, 100.0), (202412, 48.0, 80.0, 60.0), (202312, 63.0, 80.0, 78.75)],
        "period_key int, v double, target double, attainment double",
    )
    got = kpi.scorecard([("K", "name", "%", fact, "v")])
    assert rows(got, "period_key", "code", "value", "target", "status") == [
        (202312, "K", 63.0, 80.0, "Tidak Tercapai"), (202412, "K", 64.0, 80.0, "On Track"),
    ]
    summary = kpi.kpi_summary(fact, "f", "v").first()
    assert (summary.value, summary.target, summary.attainment, summary.status) == (63.67, 80.0, 79.58, "Tidak Tercapai")
    assert kpi.kpi_summary(fact.where("false"), "f", "v").first().status == ""


def test_fact_ids_do_not_depend_on_partitions(students, awards, spec, rows):
    def ids(n):
        fact = kpi.threshold_share(
            students.repartition(n), awards, spec(), "id", "y", "u", "total", "f", "flagged", "ay", "holders", "ok"
        )
        return rows(fact, "fact_id", "period_key", "u")

    assert ids(1) == ids(7)


def test_bad_numerator(spec):
    with pytest.raises(ValueError):
        spec(numerator="most")


def test_match_kpi_assets(spark, rows):
    assets = spark.createDataFrame(
        [
            ("gold.fact_a@l", "fact_a", "gold", None),
            ("gold.z@l", "z", "gold", '{"kpi":{"iku_code":"B"}}'),
            ("silver.b@l", "my_b", "silver", None),
            ("gold.y@l", "my_c_x", "gold", None),
        ],
        "qualified_name string, name string, layer string, profiling string",
    )
    kpis = [{"code": c, "fact": f} for c, f in (("A", "fact_a"), ("B", "fact_b"), ("C", "fact_c_x"), ("D", "fact_d"))]
    assert rows(kpi.match_kpi_assets(assets, kpis), "code", "qualified_name") == [
        ("A", "gold.fact_a@l"), ("B", "gold.z@l"), ("C", "gold.y@l"),
    ]


def test_match_kpi_assets_counts_each_asset_once(spark, rows):
    """Repeated rows count, repeated indicators and several reasons do not; null takes no part; an empty part fits all gold names."""
    assets = spark.createDataFrame(
        [("gold.fact_a@l", "fact_a", "gold", '{"kpi":{"iku_code":"A"}}'), ("gold.fact_a@l", "fact_a", "gold", '{"kpi":{"iku_code":"A"}}'), (None, None, None, None), ("x", "a", "silver", None)],
        "qualified_name string, name string, layer string, profiling string",
    )
    kpis = spark.createDataFrame([("A", "fact_a", 1), ("A", "fact_a", 2), ("A", "gold", 3), ("E", "fact_", 4), (None, "x", 5), ("N", None, 6)], "code string, fact string, extra int")
    assert rows(kpi.match_kpi_assets(assets, kpis)) == [("A", "gold.fact_a@l", 2), ("E", "gold.fact_a@l", 2)]
    assert kpi.match_kpi_assets(assets.limit(0), kpis).isEmpty() and kpi.match_kpi_assets(assets, kpis.limit(0)).isEmpty()


def test_containing_equals_brute_force(spark, rows):
    """Random strings of few letters, also none and beyond the Unicode base plane, against every pair."""
    draw = random.Random(5)
    make = lambda most: "".join(draw.choice("aab_\U0001f600é") for _ in range(draw.randint(0, most)))
    texts, patterns = [make(40) for _ in range(150)] + [None], [make(12) for _ in range(150)] + [None]
    got = rows(containment.containing(*(spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in (("t", texts), ("p", patterns)))))
    assert got == sorted({(t, p) for t in texts for p in patterns if t is not None and p is not None and p in t}, key=repr)


def test_indicator_plan_does_not_grow(spark, sf):
    """The plan of ten thousand indicators is the plan of ten, without a nested loop."""
    from strata.queries.assets import document_assets

    assets = document_assets(spark, sf)
    size = lambda n: len(kpi.match_kpi_assets(assets, [{"code": f"C{i}", "fact": f"fact_doc_{i}"} for i in range(n)])._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(10) == size(10_000)
    plan = kpi.match_kpi_assets(assets, assets.select(F.col("name").alias("code"), F.col("name").alias("fact")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_gold_profile_of_dimension(spark):
    got = kpi.gold_profile(spark.range(3), "d", "dimension", ["generated"]).first()
    assert (got.row_count, got.column_count, got.schema, got.sample_kpi) == (3, 1, {"id": "LongType()"}, None)


def test_progress(spark, rows):
    scores = spark.createDataFrame([("a", 120.0, 80.0, "%"), ("b", 0.1, 0.4, "Rasio"), ("c", None, 1.0, "%")], "code string, value double, target double, unit string")
    assert rows(kpi.progress(scores), "code", "progress") == [("a", 100.0), ("b", 25.0), ("c", 0.0)]
