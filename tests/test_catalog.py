"""Catalog, governance and glossary on hand-made assets."""

import json

import pytest
from pyspark.sql import functions as F

from strata.functions.text import DATASET
from strata.operators import catalog, glossary, governance

AS_OF = "2024-07-01T00:00:00Z"
TYPES = {"row_count": "bigint", "column_count": "int", "classifications": "array<string>"}
SCHEMA = ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in catalog.ASSET_COLUMNS)


@pytest.fixture
def assets(spark):
    def build(*entries):
        defaults = {"type_name": DATASET}
        data = [tuple({**defaults, **e}.get(c) for c in catalog.ASSET_COLUMNS) for e in entries]
        return spark.createDataFrame(data, SCHEMA)

    return build


def full(layer, **more):
    return {
        "qualified_name": f"{layer}.t@l", "name": "t", "layer": layer, "format": "parquet", "location": f"/w/{layer}/t",
        "description": "d", "row_count": 1, "column_count": 1, "schema_def": '{"a":"x"}', "profiling": "{}",
        "pii_columns": "[]", "classifications": [f"{layer.capitalize()}_Layer"], "ingested_at": AS_OF, "enriched_at": AS_OF,
        **more,
    }


def scores(frame, layer="silver"):
    return governance.asset_scores(frame, AS_OF).where(F.col("evaluated_layer") == layer).first().asDict()


def test_complete_bronze(assets):
    got = scores(assets(full("bronze")), "bronze")
    assert [got[s] for s in governance.SCORES] == [100, 95, 100, 100]


def test_empty_asset(assets):
    got = scores(assets({"classifications": ["Silver_Layer"]}))
    assert [got[s] for s in governance.SCORES] == [0, 0, 0, 20]


@pytest.mark.parametrize(
    ("layer", "quality", "more", "accuracy"),
    [
        ("silver", {"overall_score": 0, "source_status": "PASS"}, {}, 0),
        ("silver", {"source_score": 181.2}, {}, 100),
        ("silver", {"quality_score": 66.6}, {}, 67),
        ("silver", {"source_status": "PASS"}, {}, 90),
        ("silver", {"source_status": "QUARANTINE"}, {}, 70),
        ("silver", {}, {}, 85),
        ("silver", {}, {"row_count": -1}, 0),
        ("silver", {}, {"schema_def": "[]"}, 0),
        ("gold", {}, {"profiling": '{"star_schema":{"table_type":"fact"}}'}, 92),
        ("gold", {}, {"profiling": '{"kpi":{"iku_code":"IKU-1"}}'}, 92),
        ("gold", {}, {"profiling": "zzz"}, 75),
    ],
)
def test_accuracy_rules(assets, layer, quality, more, accuracy):
    entry = full(layer, **{"profiling": json.dumps({"quality": quality}), **more})
    assert scores(assets(entry), layer)["accuracy"] == accuracy


def test_silver_completeness_counts_its_own_checks(assets):
    profiling = {"business": {"owner": "o", "glossary_terms": ["t"]}, "quality": {"a": 1}, "compliance": {"b": 1}}
    assert scores(assets(full("silver", profiling=json.dumps(profiling))))["completeness"] == 100
    assert scores(assets(full("silver")))["completeness"] == round(9 / 13 * 100)


def test_consistency_of_misplaced_asset(assets):
    got = scores(assets(full("bronze", classifications=["Silver_Layer"], location="/w/SILVER/t")))
    assert got["consistency"] == 40


def test_layer_report_has_every_layer(assets):
    report = {r.layer: r for r in governance.layer_report(governance.asset_scores(assets(full("bronze")), AS_OF)).collect()}
    assert set(report) == {"bronze", "silver", "gold"}
    assert (report["bronze"].entity_count, report["bronze"].accuracy, report["bronze"].accuracy_score_1_5) == (1, 95, 5)
    assert (report["gold"].entity_count, report["gold"].accuracy, report["gold"].accuracy_score_1_5, report["gold"].label) == (0, 0, 1, "Gold")


def test_coverage(assets, rows):
    frame = assets(
        full("silver", profiling='{"business":{"owner":"o","glossary_terms":[]}}'),
        full("silver", schema_def="{}", classifications=["PII"], profiling="zzz"),
        {"qualified_name": "gold.x@l"},
    )
    got = {r[0]: tuple(r)[1:] for r in governance.coverage(frame).collect()}
    assert got == {"bronze": (0, 0.0, 0.0, 0.0, 0.0), "silver": (2, 50.0, 50.0, 0.0, 50.0), "gold": (1, 0.0, 0.0, 0.0, 0.0)}


def test_counts(assets, rows):
    frame = assets(full("silver", classifications=["Silver_Layer", "PII", "PII"]), full("gold"), {"qualified_name": "x"})
    assert rows(governance.count_by_layer(frame)) == [("bronze", 0), ("gold", 1), ("silver", 1), ("staging", 0)]
    assert rows(governance.count_by_tag(frame)) == [("Gold_Layer", 1), ("PII", 1), ("Silver_Layer", 1)]


def test_pass_rate(assets):
    tag = lambda t: full("silver", classifications=[t])
    got = governance.pass_rate(assets(tag("Quality_Pass"), tag("Quality_Pass"), tag("Quality_Quarantine"))).first()
    assert tuple(got) == (2, 1, 67)
    assert governance.pass_rate(assets(full("gold"))).first().pass_pct == 0


def test_lifecycle(assets, rows):
    frame = assets(
        full("bronze", qualified_name="a", classifications=["Quality_Quarantine"]), full("bronze", qualified_name="b"),
        full("gold", qualified_name="c"), {"qualified_name": "staging.d"}, {"qualified_name": "e"},
        full("silver", qualified_name="f"),
    )
    assert rows(catalog.lifecycle(frame), "qualified_name", "stage", "zone") == [
        ("a", 9, "Enrichment"), ("b", 7, "Enrichment"), ("c", 13, "Production"), ("e", 3, "Sandbox"),
        ("f", 10, "Production"), ("staging.d", 4, "Sandbox"),
    ]


def test_unified_metadata(assets):
    frame = assets(
        full("silver", profiling='{"business":{"owner":"o","glossary_terms":["x"]},"quality":{"a":1}}', enriched_at=""),
        {"qualified_name": "bronze.b@l", "profiling": "zzz", "pii_columns": "zzz"},
    )
    first, second = catalog.in_layer_order(catalog.unified_metadata(frame)).collect()
    assert (first.asset_qualified_name, first.layer, first.technical.pii_columns, first.last_enriched_at) == ("bronze.b@l", "bronze", [], None)
    assert (second.business.owner, second.business.glossary_terms, second.business.iku_relevance) == ("o", ["x"], [])
    assert (second.operational.quality, second.last_enriched_at) == ('{"a":1}', AS_OF)
    documents = catalog.umt_documents(catalog.unified_metadata(frame)).where("layer = 'silver'").first()
    assert json.loads(documents.technical_json)["schema"] == {"a": "x"}


def test_search(assets, rows):
    frame = assets(
        full("silver", qualified_name="silver.Mahasiswa@l", classifications=["PII"]),
        full("gold", qualified_name="gold.x@l", description="about MAHASISWA"),
        {"qualified_name": "silver.mahasiswa_2@l", "type_name": "other"},
    )
    assert catalog.search(frame, DATASET, "mahasiswa").count() == 2
    assert rows(catalog.search(frame, DATASET, "mahasiswa", "PII"), "qualified_name") == [("silver.Mahasiswa@l",)]
    assert catalog.search(frame).count() == 3
    assert catalog.by_qualified_name(frame, "gold.x@l").count() == 1


def test_upsert(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x"), ("d", 2, "x")], "qualified_name string, v int, s string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 4, "y"), ("c", 1, "y"), ("d", 2, "y")], "qualified_name string, v int, s string")
    assert rows(catalog.upsert(old, new, "v"), "qualified_name", "s") == [("a", "y"), ("b", "x"), ("c", "y"), ("d", "y")]


def test_normalisers(assets, rows):
    frame = assets(
        {"qualified_name": "a", "profiling": '{"quality":{"source_score":80,"source_status":"PASS"},"transformations":["x","",1]}'},
        {"qualified_name": "b", "profiling": '{"quality":{"silver_completeness":1},"business":{"owner":""}}', "pii_columns": '["n"]'},
    )
    assert rows(catalog.quality_meta(frame)) == [("a", 80.0, "PASS"), ("b", None, None)]
    assert rows(catalog.business_meta(frame), "qualified_name", "has_business") == [("a", False), ("b", False)]
    assert rows(catalog.compliance_meta(frame), "qualified_name", "has_compliance", "contains_pii") == [("a", False, None), ("b", True, True)]
    assert rows(catalog.transformations(frame)) == [("a", ["x", "1"]), ("b", [])]


def test_pii_columns(spark, rows):
    profiles = spark.createDataFrame(
        [("t", {"nama": "x", "n": "x"}), ("u", {"nama": "x"}), ("v", {"nama": "x"})], "table_name string, schema map<string,string>"
    )
    got = catalog.with_pii_columns(profiles, {"t": ["nama", "gone"], "u": []})
    assert rows(got, "table_name", "pii_columns") == [("t", ["nama"]), ("u", []), ("v", [])]


def test_glossary(assets, spark, rows):
    term = lambda qn, *terms: {"qualified_name": qn, "profiling": json.dumps({"business": {"glossary_terms": list(terms)}})}
    frame = assets(
        term("silver.a@l", "MBKM", "MBKM", "Neu"), term("silver.b@l", "MBKM", "IKU-9"),
        {"qualified_name": "gold.k@l", "profiling": '{"kpi":{"iku_code":"IKU-9","iku_nama":"Nine"}}'},
    )
    known = glossary.dictionary(spark, {"MBKM": ("Program", "Academic")})
    got = glossary.glossary_terms(frame, known, "About: ")
    assert rows(got) == [
        ("IKU-9", "Nine", "Business", "gold_metadata", 1), ("MBKM", "Program", "Academic", "silver_metadata", 2),
        ("Neu", "About: Neu", "Business", "silver_metadata", 1),
    ]
    assert glossary.term_links(frame).count() == 5
    official = glossary.dictionary(spark, {"mbkm": ("Official", "Academic")})
    local = glossary.dictionary(spark, {"MbKm": ("Local", "X"), "NEU": ("Local", "X"), "Only": ("Local", "Technical")})
    merged = glossary.merge_glossary(official, got, local)
    assert rows(merged) == [
        ("IKU-9", "Nine", "Business", "gold_metadata"), ("Neu", "About: Neu", "Business", "silver_metadata"),
        ("Only", "Local", "Technical", "local"), ("mbkm", "Official", "Academic", "catalog"),
    ]
    assert [r.category for r in glossary.categories(merged).collect()] == ["Academic", "Business", "Technical"]


def test_registration_snapshot(assets, spark):
    got = governance.registration_snapshot(assets(full("silver"), full("gold")), spark.range(3), "gold", AS_OF).first()
    assert tuple(got) == ("gold", AS_OF, 2, 3, 1)


def test_places_and_deep_pages(spark, rows):
    """Places of a frame with a hot first key over many ranges; deep pages are those of a sort."""
    frame = spark.range(3000).selectExpr("if(id % 3 = 0, id % 50, 7) AS a", "cast(pmod(id * 7919, 3001) AS string) AS b")
    order = [F.col("a").desc(), "b"]
    want = sorted(((r.a, r.b) for r in frame.collect()), key=lambda r: (-r[0], r[1]))
    got = sorted(catalog.placed(frame, order).collect(), key=lambda r: r.place)
    assert [(r.a, r.b) for r in got] == want and [r.place for r in got] == list(range(1, 3001))
    for offset in (0, 1234, 2995, 4000):
        page = [tuple(r) for r in catalog.page(frame, order, 10, offset, deep=5).collect()]
        assert page == want[offset : offset + 10] == [tuple(r) for r in catalog.page(frame, order, 10, offset).collect()]
    assert catalog.placed(frame.where("false"), order).collect() == []


def test_a_deep_page_leaves_no_rows_before_it_in_one_task(spark):
    frame = spark.range(1000)
    plan = catalog.page(frame, ["id"], 5, 900, deep=10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "CollectLimit" not in plan


def test_page_after_a_key(spark):
    values = [(1, "b"), (1, None), (None, "a"), (2, "a"), (2, "c"), (None, None), (1, "a")]
    frame = spark.createDataFrame(values, "x int, y string")
    for keys in ([("x", True), ("y", False)], [("x", False), ("y", True)]):
        order = [F.col(n).desc() if d else F.col(n).asc() for n, d in keys]
        want = [tuple(r) for r in frame.orderBy(*order).collect()]
        for k, row in enumerate(want):
            assert [tuple(r) for r in catalog.page_after(frame, keys, row, 3).collect()] == want[k + 1 : k + 4]
