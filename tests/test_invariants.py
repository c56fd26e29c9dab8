"""Properties that hold for any input, and operators on empty and all-NULL tables."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from strata.operators import glossary, governance, kpi, lineage, profile, refine, runs

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
texts = st.one_of(st.none(), st.sampled_from(["", " ", "a", "b", "ab"]))


@few
@given(data=st.lists(st.tuples(texts, texts), min_size=1, max_size=30))
def test_profile_against_python(spark, data):
    df = spark.createDataFrame(data, "x string, y string")
    for plan in profile.PLANS:
        for r in profile.profile_columns(df, "t", plan=plan).collect():
            column = [row[r.position] for row in data]
            blanks = sum(v is None or v.strip() == "" for v in column)
            assert (r.row_count, r.null_count, r.distinct_count) == (len(data), blanks, len(set(column) - {None}))
    gate = profile.quality_gate(df, "t").first()
    assert 0 <= gate.quality_score <= 100
    assert gate.status == ("PASS" if gate.quality_score >= 80 else "QUARANTINE" if gate.quality_score >= 60 else "REJECT")


rows_of_keys = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=40)


@few
@given(data=rows_of_keys)
def test_dedup_keeps_the_first_of_every_key(spark, data):
    df = spark.createDataFrame(data, "k int, v int")
    got = {r.k: r.v for r in refine.dedup(df, ["k"]).collect()}
    assert got == {k: min(v for key, v in data if key == k) for k, _ in data}
    assert refine.dedup(df, ["k"], order=[]).count() == len(got)


@few
@given(data=st.lists(st.tuples(st.integers(0, 9), st.sampled_from("ab"), st.sampled_from("uv")), min_size=1, max_size=40))
def test_any_share_stays_within_100(spark, data):
    targets = kpi.target_table(spark, {2024: {"K": 50}})
    people = spark.createDataFrame([(i, "uv"[i % 2]) for i in range(10)], "id int, u string")
    acts = spark.createDataFrame([(i, 2024, k) for i, k, _ in data], "id int, y int, k string")
    for numerator in ("sum", "any"):
        spec = kpi.Kpi("K", "pct", targets, 2024, numerator=numerator, unknown_year=0)
        got = kpi.participation_share(people, acts, spec, "id", "y", "u", "k", {"na": "a", "nb": "b"}, "total", "ok").collect()
        assert sum(r.total for r in got) == 10
        assert all(0 <= r.pct <= (100 if numerator == "any" else 200) for r in got)


@few
@given(pairs=st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=20))
def test_closure_contains_the_edges_of_the_start(spark, pairs):
    graph = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    start = spark.createDataFrame([(str(pairs[0][0]),)], "node string")
    reached = {r.node: r.depth for r in lineage.traverse(graph, start, 3, "OUTPUT").collect()}
    for a, b in pairs:
        if reached.get(str(a), 9) < 3:
            assert reached[str(b)] <= reached[str(a)] + 1


@pytest.fixture(scope="module")
def spec(spark):
    return kpi.Kpi("K", "pct", kpi.target_table(spark, {2024: {"K": 50, "L": "A"}}), 2024)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_facts_of_nothing_are_empty(spark, spec):
    e = lambda s: empty(spark, s)
    flags = e("id int, y int, u string, a boolean, b boolean, any boolean")
    acts = e("id int, y int, k string")
    facts = [
        kpi.outcome_share(flags, spec, "y", "u", "n", {"na": "a"}, ("rest", "any")),
        kpi.threshold_share(flags, acts, spec, "id", "y", "u", "n", "a", "na", "y", "h", "ok"),
        kpi.participation_share(flags, acts, spec, "id", "y", "u", "k", {"na": "a"}, "n", "ok"),
        kpi.qualification_share(flags, spec, "u", "n", {"na": "a"}, "ok"),
        kpi.output_per_head(flags, flags, spec, "y", "u", {"na": "a"}, "n", "ok"),
        kpi.capped_share(e("y int, u string, n int, p int, q int"), spec, "y", "u", "n", ["p", "q"], "ok"),
        kpi.realisation(e("y int, p string, r string"), spec.targets, "y", "p", "r", "L", "K", "A"),
    ]
    for fact in facts:
        assert fact.count() == 0
    assert kpi.kpi_summary(facts[0], "f", "pct").first().value is None


def test_all_null_flags_give_null_shares(spark, spec):
    df = spark.createDataFrame([(None, "u", None, None)] * 3, "y int, u string, a boolean, any boolean")
    got = kpi.outcome_share(df, spec, "y", "u", "n", {"na": "a"}, ("rest", "any")).first()
    assert (got.period_key, got.n, got.na, got.rest, got.pct, got.attainment) == (None, 3, None, None, None, None)


def test_catalog_of_nothing(spark):
    from strata.operators import catalog
    from tests.test_catalog import AS_OF, SCHEMA

    none = empty(spark, SCHEMA)
    assert [r.entity_count for r in governance.layer_report(governance.asset_scores(none, AS_OF)).collect()] == [0, 0, 0]
    assert governance.coverage(none).agg(F.sum("entity_count")).first()[0] == 0
    assert governance.count_by_tag(none).count() == 0
    assert governance.pass_rate(none).first().pass_pct == 0
    assert catalog.unified_metadata(none).count() == 0
    assert glossary.term_links(none).count() == 0
    assert lineage.completeness(none, empty(spark, "src string, dst string")).count() == 3


def test_refinement_of_nothing(spark):
    df = empty(spark, "id int, s string, d string, e string")
    assert refine.latest_valid(df, "id", "d", "e", "2024-01-01", ["s"]).count() == 0
    assert refine.status_flags(df, "s", {"a": "A"}, "any", "id").count() == 0
    assert refine.activity_flag(df, df, "id", "s", "f").count() == 0
    assert runs.latest_runs(empty(spark, "pipeline string, ended_at string"), tiebreak=()).count() == 0


def test_wide_tables_have_a_flat_plan(spark):
    """Hundreds of columns neither overflow the planner nor the union."""
    wide = spark.range(5).select(*[F.col("id").alias(f"c{i}") for i in range(300)])
    assert profile.quality_gate(wide, "w").first().quality_score == 100.0
    assert profile.profile_columns(wide, "w", plan="once").count() == 300
