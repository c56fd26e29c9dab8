"""The campus lakehouse end to end, from hand-made CSV files."""


import pytest
from pyspark.sql import functions as F

from strata.operators import catalog, governance, lineage
from strata.plans import campus
from strata.plans.layers import Lake, run_bronze
from strata.sources.runlog import read_runs

AS_OF = "2024-06-30"
FILES = {
    "raw_prodi": (
        "prodi_id,nama_prodi,jenjang,jurusan_id,tahun_berdiri,status,ingested_at",
        ["IF,Informatika,S1,JTK,2014,Aktif,t", "MA,Matematika,S1,JSA,2014,Aktif,t", "MM,Manajemen,S2,XXX,2020,Aktif,t"],
    ),
    "raw_mahasiswa": (
        "mahasiswa_id,nama,prodi_id,jurusan_id,angkatan,jalur_masuk,jenis_kelamin,asal_provinsi,status_aktif,sks_luar_kampus",
        [
            "M1,A,IF,JTK,2021,SNBP,L,Lampung,Aktif,20", "M1,A,IF,JTK,2021,SNBP,L,Lampung,Aktif,20",
            "M2,B,IF,JTK,2021,SNBP,P,Lampung,Aktif,6", "M3,C,MA,ZZZ,2022,SNBT,P,Lampung,Aktif,24",
            "M4,D,ZZ,JSA,2021,SNBT,L,Lampung,Cuti,0",
        ],
    ),
    "raw_prestasi_mahasiswa": (
        "prestasi_id,mahasiswa_id,tingkat,tahun",
        ["P1,M2,Nasional,2021", "P2,M2,Internasional,2021", "P3,M3,Lokal,2022"],
    ),
    "raw_lulusan": (
        "lulusan_id,mahasiswa_id,prodi_id,tanggal_lulus,status_pasca_lulus,nama_perusahaan",
        ["L1,M1,IF,2023-05-01,Bekerja,X", "L2,M2,IF,2023-06-01,Belum Bekerja,", "L3,M3,IF,2023-07-01,Studi Lanjut,", "L4,M4,MA,2024-01-01,Wirausaha,"],
    ),
    "raw_dosen": (
        "dosen_id,nama,prodi_id,jurusan_id,status_asn,pendidikan_terakhir,jabatan_fungsional,sertifikat_dosen,berasal_praktisi",
        ["D1,A,IF,JTK,PNS,S3,Lektor,True,False", "D2,B,IF,JTK,PNS,S2,Lektor,False,True", "D3,C,MA,JSA,PNS,S2,Lektor,False,False"],
    ),
    "raw_kegiatan_dosen": (
        "kegiatan_id,dosen_id,jenis_kegiatan,tahun",
        ["K1,D1,QS100,2023", "K2,D1,Praktisi_Industri,2023", "K3,D2,Lainnya,2023"],
    ),
    "raw_penelitian": (
        "penelitian_id,judul,dosen_id,jurusan_id,tahun,skema,dana,rekognisi_internasional,diterapkan_masyarakat,ingested_at",
        ["R1,x,D1,JTK,2023,s,1,True,False,t", "R2,x,D1,JTK,2023,s,1,False,True,t"],
    ),
    "raw_pengabdian": (
        "pkm_id,judul,dosen_id,jurusan_id,tahun,dana,lokasi,rekognisi_internasional,diterapkan_masyarakat,ingested_at",
        ["S1,x,D3,JSA,2024,1,l,True,True,t"],
    ),
    "raw_kerjasama": (
        "kerjasama_id,lingkup,prodi_id,status",
        ["C1,MBKM,IF,Aktif", "C2,Riset,,Aktif", "C3,Semua,MA,Tidak Aktif", "C4,Semua,MM,Aktif"],
    ),
    "raw_akreditasi": (
        "akreditasi_id,prodi_id,lembaga,predikat,tanggal_sk,tanggal_berakhir",
        ["A1,IF,BAN-PT,A,2016-04-12,2021-04-11", "A2,IF,Internasional,Unggul,2022-10-30,2027-10-29", "A3,MA,BAN-PT,B,2019-01-01,2024-06-30"],
    ),
    "raw_keuangan": (
        "anggaran_id,tahun,pagu,realisasi",
        ["U1,2024,100,80", "U2,2024,100,95", "U3,2025,50,50"],
    ),
    "raw_mbkm": ("mbkm_id,mahasiswa_id,catatan", ["B1,,", "B2,,"]),
}


@pytest.fixture(scope="module")
def refreshed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("campus")
    landing = base / "landing"
    landing.mkdir()
    for name, (header, lines) in FILES.items():
        (landing / f"{name}.csv").write_text("\n".join([header, *lines]) + "\n")
    lake = Lake(spark, str(base / "lake"))
    return lake, campus.refresh(lake, str(landing), AS_OF, "Campus", str(base / "runs"), "once"), base


def read(lake, layer, name, *columns):
    picked = lake.read(layer, name).select(*columns)
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def test_bronze(refreshed):
    lake, runs, _ = refreshed
    assert set(runs["bronze"].results) == set(FILES)
    assert {f.dataType.simpleString() for f in lake.read("bronze", "raw_mahasiswa").schema} == {"string"}
    profile = {r.table_name: r for r in runs["bronze"].profiles.collect()}
    assert profile["raw_mahasiswa"].row_count == 5
    assert profile["raw_mahasiswa"].pii_columns == ["mahasiswa_id", "nama", "asal_provinsi"]
    assert profile["raw_kerjasama"].columns["prodi_id"].null_count == 1


def test_silver(refreshed):
    lake, runs, _ = refreshed
    assert read(lake, "silver", "silver_mahasiswa", "mahasiswa_id", "nama_prodi", "nama_jurusan", "is_mbkm") == [
        ("M1", "Informatika", "Teknik dan Komputer", True), ("M2", "Informatika", "Teknik dan Komputer", False),
        ("M3", "Matematika", None, True), ("M4", None, "Sains", False),
    ]
    assert read(lake, "silver", "silver_dosen", "dosen_id", "is_s3", "is_serdos", "is_praktisi", "is_aktif_tridarma") == [
        ("D1", True, True, False, True), ("D2", False, False, True, True), ("D3", False, False, False, False),
    ]
    assert read(lake, "silver", "silver_akreditasi_aktif", "prodi_id", "akreditasi_id", "is_internasional") == [
        ("IF", "A2", True), ("MA", "A3", False),
    ]
    assert read(lake, "silver", "silver_kerjasama_aktif", "kerjasama_id", "is_mbkm") == [("C1", True), ("C2", False), ("C4", True)]
    assert lake.read("silver", "silver_penelitian_pkm").columns == [
        "id", "judul", "dosen_id", "jurusan_id", "tahun", "dana", "ingested_at", "is_rekognisi", "is_diterapkan", "jenis",
    ]
    assert all(r["status"] == "PASS" and r["written"] for r in runs["silver"].results.values())


def test_gold(refreshed):
    lake, runs, _ = refreshed
    gold = lambda name, *columns: read(lake, "gold", name, *columns)
    assert gold("fact_iku1_lulusan", "waktu_id", "prodi_id", "total_lulusan", "persen_terserap", "target_iku", "capaian_iku") == [
        (202312, "IF", 3, 66.67, 77.0, 86.58), (202412, "MA", 1, 100.0, 78.0, 128.21),
    ]
    assert gold("fact_iku2_mbkm", "waktu_id", "prodi_id", "total_mahasiswa_aktif", "mahasiswa_prestasi_nasional", "persen_iku2") == [
        (202112, "IF", 2, 1, 100.0), (202212, "MA", 1, 0, 100.0),
    ]
    assert gold("fact_iku3_dosen_tridarma", "waktu_id", "prodi_id", "total_dosen_tetap", "dosen_memenuhi_iku3", "target_iku") == [
        (202312, "IF", 2, 2, 20.0), (202412, "MA", 1, 0, 0.0),
    ]
    assert gold("fact_iku4_kualifikasi_dosen", "waktu_id", "prodi_id", "dosen_memenuhi_iku4", "persen_iku4") == [
        (202412, "IF", 3, 150.0), (202412, "MA", 0, 0.0),
    ]
    assert gold("fact_iku5_penelitian_pkm", "waktu_id", "jurusan_id", "total_dosen", "rasio_per_dosen", "target_iku") == [
        (202312, "JTK", 2, 1.0, 0.2), (202412, "JSA", 1, 2.0, 0.25),
    ]
    assert gold("fact_iku6_kerjasama_prodi", "waktu_id", "prodi_berkerjasama", "persen_iku6", "capaian_iku")[-1] == (202512, 2, 100.0, 153.85)
    assert gold("fact_iku8_akreditasi_internasional", "waktu_id", "total_prodi_s1", "persen_iku8")[0] == (202112, 2, 50.0)
    assert gold("fact_tata_kelola", "waktu_id", "predikat_sakip", "persen_realisasi", "nilai_sakip", "target_kinerja_anggaran") == [
        (202412, "BB", 87.5, 83.1, 85.0), (202512, "A", 100.0, 95.0, 87.0),
    ]
    assert lake.read("gold", "dim_waktu").count() == 72
    assert gold("dim_prodi", "prodi_id", "nama_jurusan", "nama_fakultas")[2] == ("MM", None, "Campus")
    assert gold("dim_dosen", "dosen_id", "pendidikan") == [("D1", "S3"), ("D2", "S2"), ("D3", "S2")]
    assert gold("dim_topik_penelitian", "topik_id")[-1] == (4,)


def test_missing_course_table_is_isolated(refreshed):
    _, runs, _ = refreshed
    failed = runs["gold"].results["fact_iku7_metode_pembelajaran"]
    assert failed["status"] == "ERROR" and not failed["written"]
    assert sum(r["written"] for r in runs["gold"].results.values()) == 14


def test_scorecard(refreshed):
    lake, _, _ = refreshed
    got = read(lake, "gold", "fact_rekap_iku_institusi", "waktu_id", "iku_kode", "nilai_capaian", "nilai_target", "satuan", "status_capaian")
    assert (202312, "IKU-1", 66.67, 77.0, "%", "On Track") in got
    assert (202412, "IKU-5", 2.0, 0.25, "Rasio", "Tercapai") in got
    assert len(got) == len({r[:2] for r in got})


def test_facts_join_the_calendar(refreshed):
    lake, _, _ = refreshed
    fact, calendar = lake.read("gold", "fact_rekap_iku_institusi"), lake.read("gold", "dim_waktu")
    joined = fact.join(calendar.select("period_key", "tahun"), fact.waktu_id == F.col("period_key"))
    assert joined.count() == fact.count()


def test_run_log(refreshed, spark):
    *_, base = refreshed
    got = {r.pipeline: r for r in read_runs(spark, str(base / "runs")).collect()}
    assert set(got) == {"staging_to_bronze", "bronze_to_silver", "silver_to_gold"}
    assert (got["bronze_to_silver"].tables_total, got["bronze_to_silver"].tables_written) == (6, 6)
    assert got["staging_to_bronze"].rows_written == sum(len(lines) for _, lines in FILES.values())


def test_catalog(refreshed, spark):
    _, runs, _ = refreshed
    assets, processes = campus.register(spark, runs, "Campus", "2024-06-30T00:00:00Z")
    assets, processes = assets.cache(), processes.cache()
    counts = {r.layer: r.assets for r in governance.count_by_layer(assets).collect()}
    assert counts == {"staging": 12, "bronze": 12, "silver": 6, "gold": 14}
    tags = {r.tag: r.assets for r in governance.count_by_tag(assets).collect()}
    assert (tags["Star_Schema_Dimension"], tags["KPI_Metric"], tags["Quality_Pass"]) == (5, 9, 6)
    student = catalog.by_qualified_name(assets, "silver.silver_mahasiswa@lakehouse").first()
    assert student.description.startswith("Data mahasiswa aktif Campus") and "PII" in student.classifications
    report = {r.layer: r for r in governance.layer_report(governance.asset_scores(assets, "2024-07-01T00:00:00Z")).collect()}
    assert (report["bronze"].completeness, report["silver"].completeness, report["silver"].consistency) == (100, 100, 100)
    assert report["gold"].timeliness == 100
    edges = lineage.edges(processes)
    start = spark.createDataFrame([("gold.fact_iku2_mbkm@lakehouse",)], "node string")
    upstream = {r.node for r in lineage.traverse(edges, start, 6, "INPUT").collect()}
    assert {"silver.silver_mahasiswa@lakehouse", "bronze.raw_prodi@lakehouse", "staging.raw_prestasi_mahasiswa@lakehouse"} <= upstream
    complete = {r.layer: r.with_incoming_pct for r in lineage.completeness(assets, edges).collect()}
    assert complete == {"bronze": 100.0, "silver": 100.0, "gold": round(11 / 14 * 100, 2)}
    terms = {r.term: r for r in campus.campus_glossary(spark, assets, "Campus").collect()}
    assert terms["MBKM"].category == "Academic" and "Campus" in terms["PKS"].definition
    assert terms["IKU-1"].source == "gold_metadata" and terms["Renstra"].source == "local"
    stated = spark.createDataFrame([("mbkm", "As the catalog has it", "Policy"), ("Kelas", "A group", "Policy")], "term string, definition string, category string")
    merged = {r.term: (r.definition, r.source) for r in campus.campus_glossary(spark, assets, "Campus", stated).collect()}
    assert merged["mbkm"] == ("As the catalog has it", "catalog") and merged["Kelas"][1] == "catalog" and "MBKM" not in merged
    assert len(merged) == len(terms) + 1
    years = {s.name: s for s in campus.gold_specs(spark, "Campus", years=(2019, 2020))}["dim_waktu"].build({})
    assert years.count() == 24 and years.agg({"tahun": "min"}).first()[0] == 2019
    umt = catalog.unified_metadata(assets)
    assert umt.count() == 44 and catalog.in_layer(umt, "gold").count() == 14


def test_rejected_table_is_not_written(spark, tmp_path):
    from strata.plans.layers import Refined, run_silver

    lake = Lake(spark, str(tmp_path))
    poor = spark.createDataFrame([("1", None, None)], "id string, a string, b string")
    lake.replace(poor, "bronze", "raw_poor")
    recipe = lambda name, gate: Refined(name, ["raw_poor"], ["raw_poor"], ["step"], lambda t, as_of: t["raw_poor"], gate)
    run = run_silver(lake, [recipe("kept", "report"), recipe("dropped", "skip")], AS_OF)
    assert (run.results["kept"]["status"], run.results["kept"]["written"]) == ("REJECT", True)
    assert (run.results["dropped"]["written"], run.results["dropped"]["row_count"]) == (False, 0)
    assert run.profiles.count() == 1


def test_tables_of_the_session_catalog(spark):
    lake = Lake(spark)
    assert lake.replace(spark.range(3), "strata_bronze", "t").count() == 3
    assert lake.replace(spark.range(2), "strata_bronze", "t").count() == 2
    assert lake.read("strata_bronze", "t").count() == 2


def test_a_rerun_keeps_the_profiles_of_tables_that_fail(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for name in ("raw_a", "raw_b"):
        (landing / f"{name}.csv").write_text("id\n1\n2\n")
    lake = Lake(spark, str(tmp_path / "lake"))
    run_bronze(lake, str(landing), {"raw_a": [], "raw_b": []})
    (landing / "raw_a.csv").write_text("id\n1\n2\n3\n")
    (landing / "raw_b.csv").unlink()
    again = run_bronze(lake, str(landing), {"raw_a": [], "raw_b": []})
    assert sorted(r.table_name for r in again.profiles.collect()) == ["raw_a", "raw_b"]
    assert again.profiles.where("table_name = 'raw_a'").count() == 1


def test_the_gate_follows_the_stored_profiles(spark, tmp_path):
    """The decision needs no scan of the sources; on request it is taken from the rows."""
    from strata.plans import layers

    lake = Lake(spark, str(tmp_path / "lake"))
    (tmp_path / "raw_a.csv").write_text("k,v\n1,x\n2,y\n")
    run_bronze(lake, str(tmp_path), {"raw_a": [], "raw_none": []})
    stored = layers._stored_gates(lake)
    assert stored["raw_a"]["status"] == "PASS" and stored["raw_a"]["row_count"] == 2
    lake.replace(spark.createDataFrame([(None, None)], "k string, v string"), "bronze", "raw_a")  # behind the library's back
    recipe = layers.Refined("silver_a", ["raw_a"], ["raw_a"], ["none"], lambda t, as_of: t["raw_a"])
    assert layers.run_silver(lake, [recipe], AS_OF).results["silver_a"]["status"] == "PASS"
    assert layers.run_silver(lake, [recipe], AS_OF, scan_gate=True).results["silver_a"]["status"] == "REJECT"


@pytest.mark.parametrize("in_catalog", [False, True])
def test_batches_are_appended_and_replaced(spark, tmp_path, in_catalog):
    from strata.plans import layers

    lake = Lake(spark) if in_catalog else Lake(spark, str(tmp_path / "lake"))
    for batch, text in {"a": "k,v\n1,x\n2,\n", "b": "k,v\n3,x\n", "c": "k,v\n"}.items():
        (tmp_path / batch).mkdir()
        (tmp_path / batch / "raw_grown.csv").write_text(text)
    for batch in ("a", "b", "b", "c"):
        run = layers.append_bronze(lake, str(tmp_path / batch), {"raw_grown": ["v"]}, batch)
        if batch == "c":
            assert run.results == {}  # nothing in it
            continue
        entry = run.profiles.where("table_name = 'raw_grown'").first()
    assert sorted(tuple(r) for r in lake.read("bronze", "raw_grown").select("k", "v").collect()) == [("1", "x"), ("2", None), ("3", "x")]
    assert lake.read("bronze", "raw_grown").columns == ["k", "v"]
    assert entry.row_count == 3 and entry["columns"]["v"].null_count == 1 and entry["columns"]["v"].distinct_count == 1 and entry["columns"]["k"].distinct_count == 3
