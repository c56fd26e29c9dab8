"""The campus lakehouse as a configuration of the generic operators.

Twelve raw tables, six refined tables, five dimensions and ten facts. Bronze keeps every
column as text; years and amounts are typed where a fact needs them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from strata.functions.dates import year_of
from strata.functions.predicates import at_least, text_flag
from strata.functions.text import label
from strata.operators import catalog, dims, glossary, kpi, lineage, refine
from strata.plans import campus_values as values
from strata.plans.layers import Curated, Lake, LayerRun, Refined, Tables, run_bronze, run_gold, run_silver

YEARS = tuple(values.TARGETS)
TEXTS = ArrayType(StringType())


# -- silver ---------------------------------------------------------------------------


def _students(t: Tables, as_of: str) -> DataFrame:
    return refine.enrich_lookup(
        t["raw_mahasiswa"],
        t["raw_prodi"],
        on="prodi_id",
        dim_columns=["nama_prodi", "jenjang"],
        labels={"nama_jurusan": ("jurusan_id", values.DEPARTMENTS)},
        flags={"is_mbkm": at_least("sks_luar_kampus", 20)},
        key="mahasiswa_id",
    )


def _graduates(t: Tables, as_of: str) -> DataFrame:
    outcomes = {"is_employed": "Bekerja", "is_lanjut_studi": "Studi Lanjut", "is_wirausaha": "Wirausaha"}
    return refine.status_flags(t["raw_lulusan"], "status_pasca_lulus", outcomes, "is_terserap", "lulusan_id")


def _lecturers(t: Tables, as_of: str) -> DataFrame:
    active = refine.activity_flag(
        t["raw_dosen"], t["raw_kegiatan_dosen"], "dosen_id", "jenis_kegiatan", "is_aktif_tridarma"
    )
    return active.withColumns(
        {
            "is_s3": F.col("pendidikan_terakhir") == "S3",
            "is_praktisi": text_flag("berasal_praktisi"),
            "is_serdos": text_flag("sertifikat_dosen"),
        }
    )


def _research(t: Tables, as_of: str) -> DataFrame:
    def columns(key: str) -> dict:
        same = ("judul", "dosen_id", "jurusan_id", "tahun", "dana", "ingested_at")
        return {
            "id": key,
            **{c: c for c in same},
            "is_rekognisi": text_flag("rekognisi_internasional"),
            "is_diterapkan": text_flag("diterapkan_masyarakat"),
        }

    parts = [
        (t["raw_penelitian"], columns("penelitian_id"), "Penelitian"),
        (t["raw_pengabdian"], columns("pkm_id"), "Pengabdian"),
    ]
    return refine.union_normalise(parts, kind="jenis", key="id")


def _partnerships(t: Tables, as_of: str) -> DataFrame:
    active = F.col("status") == "Aktif"
    return refine.filter_flag(t["raw_kerjasama"], active, "is_mbkm", "lingkup", ["MBKM", "Semua"], "kerjasama_id")


def _accreditations(t: Tables, as_of: str) -> DataFrame:
    return refine.latest_valid(
        t["raw_akreditasi"],
        "prodi_id",
        "tanggal_sk",
        "tanggal_berakhir",
        as_of,
        ["akreditasi_id"],
        {"is_internasional": F.col("lembaga") == "Internasional"},
    )


def silver_recipes() -> list[Refined]:
    """The six refined tables."""

    def recipe(name: str, sources: list[str], build, gated: int = 1, gate: str = "skip") -> Refined:
        return Refined(name, sources, sources[:gated], values.STEPS[name], build, gate)

    return [
        recipe("silver_mahasiswa", ["raw_mahasiswa", "raw_prodi"], _students),
        recipe("silver_lulusan", ["raw_lulusan"], _graduates),
        recipe("silver_dosen", ["raw_dosen", "raw_kegiatan_dosen"], _lecturers),
        recipe("silver_penelitian_pkm", ["raw_penelitian", "raw_pengabdian"], _research, 2, "report"),
        recipe("silver_kerjasama_aktif", ["raw_kerjasama"], _partnerships),
        recipe("silver_akreditasi_aktif", ["raw_akreditasi"], _accreditations),
    ]


# -- gold -----------------------------------------------------------------------------


def _shaped(fact: DataFrame, *columns: str) -> DataFrame:
    """A generic fact under the column names and order of the star schema."""
    names = {"period_key": "waktu_id", "target": "target_iku", "attainment": "capaian_iku"}
    return fact.withColumnsRenamed(names).select("fact_id", "waktu_id", *columns, "target_iku", "capaian_iku")


def _calendar(spark: SparkSession, years: tuple[int, int]) -> DataFrame:
    months = dims.calendar_dimension(dims.fixed_years(spark, *years))
    names = {
        "calendar_id": "waktu_id", "year": "tahun", "term": "semester",
        "quarter": "triwulan", "month": "bulan", "month_name": "nama_bulan",
    }
    return months.withColumnsRenamed(names)


def _programmes(t: Tables, faculty: str) -> DataFrame:
    columns = {c: c for c in ("prodi_id", "nama_prodi", "jenjang")}
    columns |= {"nama_jurusan": label("jurusan_id", values.DEPARTMENTS), "nama_fakultas": F.lit(faculty)}
    columns |= {c: c for c in ("tahun_berdiri", "status")}
    return dims.mapped_dimension(t["raw_prodi"], "prodi_id", columns)


def _projection(table: str, key: str, *columns: str, **renamed: str):
    return lambda t: dims.mapped_dimension(t[table], key, {c: renamed.get(c, c) for c in columns})


def _topics(spark: SparkSession) -> DataFrame:
    schema = StructType(
        [
            StructField("topik_id", IntegerType()),
            StructField("nama_topik", StringType()),
            StructField("deskripsi", StringType()),
        ]
    )
    return dims.literal_table(spark, values.TOPICS, schema)


def _undergraduate(programmes: DataFrame) -> DataFrame:
    return programmes.where(F.col("jenjang") == "S1").select("prodi_id")


def gold_specs(
    spark: SparkSession, institution: str, numerator: str = "sum", strict: bool = False, years: tuple[int, int] = (2020, 2025)
) -> list[Curated]:
    """Five dimensions and nine facts.

    ``numerator`` and ``strict`` choose between adding up overlapping categories and
    counting every entity once (see ``Kpi`` and ``coverage_share``). The calendar runs from the first to the last of
    ``years``; an inner join with it drops the facts of other years.
    """
    targets = kpi.target_table(spark, values.TARGETS)

    def spec(code: str, value: str, **settings) -> kpi.Kpi:
        settings = {"fallback_year": values.FALLBACK_YEAR, "numerator": numerator, **settings}
        return kpi.Kpi(code, value, targets, **settings)

    def iku1(t: Tables) -> DataFrame:
        measures = {"lulusan_bekerja": "is_employed", "lulusan_lanjut_studi": "is_lanjut_studi", "lulusan_wirausaha": "is_wirausaha"}
        fact = kpi.outcome_share(
            t["silver_lulusan"].withColumn("tahun", year_of("tanggal_lulus")),
            spec("IKU-1", "persen_terserap", floor=None),
            "tahun", "prodi_id", "total_lulusan", measures, ("lulusan_belum", "is_terserap"),
        )
        return _shaped(fact, "prodi_id", "total_lulusan", *measures, "lulusan_belum", "persen_terserap")

    def iku2(t: Tables) -> DataFrame:
        students = t["silver_mahasiswa"].where(F.col("status_aktif") == "Aktif")
        awards = t["raw_prestasi_mahasiswa"].where(F.col("tingkat").isin("Nasional", "Internasional"))
        fact = kpi.threshold_share(
            refine.conform(students, {"angkatan": "int"}),
            refine.conform(awards, {"tahun": "int"}),
            spec("IKU-2", "persen_iku2"),
            key="mahasiswa_id", year="angkatan", unit="prodi_id", total="total_mahasiswa_aktif", flag="is_mbkm",
            flagged="mahasiswa_sks_luar_20", event_year="tahun", holders="mahasiswa_prestasi_nasional",
            qualified="mahasiswa_memenuhi_iku2",
        )
        return _shaped(
            fact, "prodi_id", "total_mahasiswa_aktif", "mahasiswa_sks_luar_20", "mahasiswa_prestasi_nasional",
            "mahasiswa_memenuhi_iku2", "persen_iku2",
        )

    def iku3(t: Tables) -> DataFrame:
        kinds = {
            "dosen_tridarma_pt_lain": "Tridarma_PT_Lain", "dosen_praktisi_industri": "Praktisi_Industri",
            "dosen_bina_prestasi": "Pembina_Prestasi", "dosen_qs100": "QS100",
        }
        fact = kpi.participation_share(
            t["silver_dosen"],
            refine.conform(t["raw_kegiatan_dosen"], {"tahun": "int"}),
            spec("IKU-3", "persen_iku3", unknown_year=0),
            key="dosen_id", year="tahun", unit="prodi_id", kind="jenis_kegiatan", kinds=kinds,
            total="total_dosen_tetap", qualified="dosen_memenuhi_iku3",
        )
        return _shaped(fact, "prodi_id", "total_dosen_tetap", *kinds, "dosen_memenuhi_iku3", "persen_iku3")

    def iku4(t: Tables) -> DataFrame:
        flags = {"dosen_s3": "is_s3", "dosen_sertifikat_industri": "is_serdos", "dosen_dari_praktisi": "is_praktisi"}
        fact = kpi.qualification_share(
            t["silver_dosen"], spec("IKU-4", "persen_iku4"), "prodi_id", "total_dosen_tetap", flags, "dosen_memenuhi_iku4"
        )
        return _shaped(fact, "prodi_id", "total_dosen_tetap", *flags, "dosen_memenuhi_iku4", "persen_iku4")

    def iku5(t: Tables) -> DataFrame:
        flags = {"output_rekognisi_internasional": "is_rekognisi", "output_diterapkan_masyarakat": "is_diterapkan"}
        fact = kpi.output_per_head(
            refine.conform(t["silver_penelitian_pkm"], {"tahun": "int"}),
            t["silver_dosen"],
            spec("IKU-5", "rasio_per_dosen", floor=0.01, unknown_year=0),
            "tahun", "jurusan_id", flags, "total_dosen", "total_output_eligible",
        )
        return _shaped(fact, "jurusan_id", "total_dosen", *flags, "total_output_eligible", "rasio_per_dosen")

    def covered(code: str, value: str, hits: str, keys):
        def build(t: Tables) -> DataFrame:
            fact = kpi.coverage_share(
                _undergraduate(t["raw_prodi"]), keys(t), spec(code, value), "prodi_id", YEARS, "total_prodi_s1", hits, strict
            )
            return _shaped(fact, "total_prodi_s1", hits, value)

        return build

    def iku7(t: Tables) -> DataFrame:
        counts = ("total_mk", "mk_case_method", "mk_team_based")
        courses = refine.conform(t["raw_metode_pembelajaran"], {"tahun": "int", **{c: "int" for c in counts}})
        fact = kpi.capped_share(
            courses, spec("IKU-7", "persen_iku7"), "tahun", "prodi_id", "total_mk", counts[1:], "mk_memenuhi"
        )
        return _shaped(fact, "prodi_id", *counts, "mk_memenuhi", "persen_iku7")

    def governance(t: Tables) -> DataFrame:
        finance = refine.conform(t["raw_keuangan"], {"tahun": "int"})
        fact = kpi.realisation(finance, targets, "tahun", "pagu", "realisasi", "SAKIP", "Anggaran", "BB")
        names = {
            "period_key": "waktu_id", "label": "predikat_sakip", "index_value": "nilai_sakip",
            "performance": "nilai_kinerja_anggaran", "planned_total": "pagu_total", "realised_total": "realisasi_total",
            "realised_pct": "persen_realisasi", "label_target": "target_sakip", "target": "target_kinerja_anggaran",
        }
        return fact.withColumnsRenamed(names)

    iku6 = covered("IKU-6", "persen_iku6", "prodi_berkerjasama", lambda t: t["silver_kerjasama_aktif"])
    iku8 = covered(
        "IKU-8", "persen_iku8", "prodi_akreditasi_internasional", lambda t: t["silver_akreditasi_aktif"].where("is_internasional")
    )
    lecturer = _projection(
        "silver_dosen", "dosen_id", "dosen_id", "nama", "prodi_id", "status_asn", "pendidikan", "jabatan_fungsional",
        "is_s3", "is_serdos", "is_praktisi", pendidikan="pendidikan_terakhir",
    )
    student = _projection(
        "silver_mahasiswa", "mahasiswa_id", "mahasiswa_id", "prodi_id", "angkatan", "jalur_masuk", "asal_provinsi",
        "jenis_kelamin",
    )
    return [
        Curated("dim_waktu", "dimension", ["generated"], lambda t: _calendar(spark, years)),
        Curated("dim_prodi", "dimension", ["raw_prodi"], lambda t: _programmes(t, institution)),
        Curated("dim_dosen", "dimension", ["silver_dosen"], lecturer),
        Curated("dim_mahasiswa", "dimension", ["silver_mahasiswa"], student),
        Curated("dim_topik_penelitian", "dimension", ["generated"], lambda t: _topics(spark)),
        Curated("fact_iku1_lulusan", "fact", ["silver_lulusan"], iku1, "persen_terserap"),
        Curated("fact_iku2_mbkm", "fact", ["silver_mahasiswa", "raw_prestasi_mahasiswa"], iku2, "persen_iku2"),
        Curated("fact_iku3_dosen_tridarma", "fact", ["silver_dosen", "raw_kegiatan_dosen"], iku3, "persen_iku3"),
        Curated("fact_iku4_kualifikasi_dosen", "fact", ["silver_dosen"], iku4, "persen_iku4"),
        Curated("fact_iku5_penelitian_pkm", "fact", ["silver_penelitian_pkm", "silver_dosen"], iku5, "rasio_per_dosen", "Rasio"),
        Curated("fact_iku6_kerjasama_prodi", "fact", ["silver_kerjasama_aktif", "raw_prodi"], iku6, "persen_iku6"),
        Curated("fact_iku7_metode_pembelajaran", "fact", ["raw_metode_pembelajaran"], iku7, "persen_iku7"),
        Curated("fact_iku8_akreditasi_internasional", "fact", ["silver_akreditasi_aktif", "raw_prodi"], iku8, "persen_iku8"),
        Curated("fact_tata_kelola", "fact", ["raw_keuangan"], governance),
    ]


def scorecard(facts: Tables, specs: Sequence[Curated]) -> DataFrame:
    """Period x indicator over the facts that were written."""
    by_table = {table: (code, name) for code, (name, table, *_) in values.INDICATORS.items()}
    rows = [
        (*by_table[s.name], s.unit, facts[s.name].withColumnRenamed("waktu_id", "period_key"), s.value)
        for s in specs
        if s.name in by_table and s.name in facts
    ]
    names = {
        "period_key": "waktu_id", "code": "iku_kode", "name": "iku_nama", "value": "nilai_capaian",
        "target": "nilai_target", "unit": "satuan", "status": "status_capaian",
    }
    return kpi.scorecard(rows, target="target_iku").withColumnsRenamed(names)


# -- runs and catalog -----------------------------------------------------------------


def refresh(
    lake: Lake,
    landing: str,
    as_of: str,
    institution: str,
    run_folder: str | None = None,
    profile_plan: str = "batched",
    workers: int = 4,
    **gold_options,
) -> dict[str, LayerRun]:
    """Full recompute of bronze, silver and gold from the raw files; every table is replaced."""
    optional = {"raw_metode_pembelajaran": []}
    raw = {**values.PII_COLUMNS, **optional}
    bronze = run_bronze(lake, landing, raw, run_folder, profile_plan=profile_plan, workers=workers)
    silver = run_silver(lake, silver_recipes(), as_of, run_folder, profile_plan, workers)
    specs = gold_specs(lake.spark, institution, **gold_options)
    recap = partial(scorecard, specs=specs)
    gold = run_gold(lake, specs, recap, "fact_rekap_iku_institusi", run_folder, workers)
    return {"bronze": bronze, "silver": silver, "gold": gold}


def _attributes(spark: SparkSession, rows: dict, **types) -> DataFrame:
    schema = StructType(
        [StructField("table_name", StringType()), *[StructField(n, t) for n, t in types.items()]]
    )
    return catalog.static_attributes(spark, rows, schema)


def business_attributes(spark: SparkSession, institution: str) -> DataFrame:
    filled = {
        t: {**v, "business_description": v["business_description"].format(institution=institution)}
        for t, v in values.BUSINESS.items()
    }
    text = StringType()
    return _attributes(
        spark, filled, business_description=text, business_owner=text, iku_relevance=TEXTS, glossary_terms=TEXTS,
        update_frequency=text,
    )


def compliance_attributes(spark: SparkSession) -> DataFrame:
    text = StringType()
    return _attributes(
        spark, values.COMPLIANCE, contains_pii=BooleanType(), pii_columns=TEXTS, data_classification=text,
        retention_policy=text, access_restriction=text,
    )


def kpi_attributes(spark: SparkSession, institution: str) -> DataFrame:
    rows = [
        (
            code, name, fact, formula, unit,
            f"Renstra {institution} 2020-2024, Sasaran {goal}", f"Executive Dashboard — Capaian {code}",
        )
        for code, (name, fact, formula, unit, goal) in values.INDICATORS.items()
    ]
    names = ("code", "name", "fact_table", "formula", "unit", "plan", "panel")
    return dims.literal_table(spark, rows, StructType([StructField(n, StringType()) for n in names]))


def consumption_attributes(spark: SparkSession) -> DataFrame:
    rows = {
        t: {"consumers": readers, "olap_role": role}
        for t, (readers, role) in values.CONSUMPTION.items()
    }
    return _attributes(spark, rows, consumers=TEXTS, olap_role=StringType())


def register(
    spark: SparkSession,
    runs: dict[str, LayerRun],
    institution: str,
    as_of: str,
    cluster: str = "lakehouse",
    landing: str = "s3a://staging",
    warehouse: str = "s3a://warehouse",
) -> tuple[DataFrame, DataFrame]:
    """Assets and ETL processes of a refresh; tables that were not written are left out."""
    bronze, silver, gold = (runs[layer].profiles for layer in ("bronze", "silver", "gold"))
    place = {"cluster": cluster, "warehouse": warehouse, "as_of": as_of}
    assets = [
        catalog.staging_assets(bronze, cluster, landing),
        catalog.bronze_assets(bronze, **place),
        catalog.silver_assets(
            silver, business_attributes(spark, institution), compliance_attributes(spark), **place
        ),
        catalog.gold_assets(gold, kpi_attributes(spark, institution), consumption_attributes(spark), **place),
    ]
    processes = [
        lineage.bronze_processes(bronze, cluster, as_of),
        lineage.silver_processes(catalog.written_only(silver), cluster, as_of),
        lineage.gold_processes(catalog.written_only(gold), cluster, as_of),
    ]
    return refine.union_all(assets), refine.union_all(processes)


def campus_glossary(
    spark: SparkSession, assets: DataFrame, institution: str, catalog_terms: DataFrame | None = None
) -> DataFrame:
    """Terms of the catalog (same columns as the local dictionary), then those collected from the assets, then the local ones.

    A term keeps the definition of the first of the three that has it.
    """
    named = lambda terms: {t: (d.format(institution=institution), c) for t, (d, c) in terms.items()}
    collected = glossary.glossary_terms(
        assets,
        glossary.dictionary(spark, named(values.TERM_DEFINITIONS)),
        values.DEFAULT_DEFINITION.format(institution=institution),
    )
    local = glossary.dictionary(spark, named(values.LOCAL_TERMS))
    return glossary.merge_glossary(local.limit(0) if catalog_terms is None else catalog_terms, collected, local)
