"""Column profiles, quality gate and dataset summary."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from strata.operators import profile
from strata.operators.refine import union_all
from strata.queries import query, table
from strata.sources.read import dataset_summary as summarise
from strata.sources.read import summary_totals

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Columns of the profiled tables as (name, type name, is text).
COLUMNS = {
    "customer": [
        ("c_custkey", "LongType()", False), ("c_name", "StringType()", True),
        ("c_nationkey", "IntegerType()", False), ("c_acctbal", "DoubleType()", False),
        ("c_mktsegment", "StringType()", True),
    ],
    "supplier": [
        ("s_suppkey", "LongType()", False), ("s_name", "StringType()", True),
        ("s_nationkey", "IntegerType()", False), ("s_acctbal", "DoubleType()", False),
    ],
    "orders": [
        ("o_orderkey", "LongType()", False), ("o_custkey", "LongType()", False),
        ("o_orderstatus", "StringType()", True), ("o_totalprice", "DoubleType()", False),
        ("o_orderdate", "TimestampNTZType()", False), ("o_orderpriority", "StringType()", True),
    ],
    "events": [
        ("event_id", "LongType()", False), ("ts", "TimestampNTZType()", False),
        ("user_id", "LongType()", False), ("event_type", "StringType()", True),
        ("value", "DoubleType()", False), ("props", "StringType()", True),
    ],
    "lineitem": [
        ("l_orderkey", "LongType()", False), ("l_partkey", "LongType()", False),
        ("l_suppkey", "LongType()", False), ("l_linenumber", "IntegerType()", False),
        ("l_quantity", "DoubleType()", False), ("l_extendedprice", "DoubleType()", False),
        ("l_discount", "DoubleType()", False), ("l_tax", "DoubleType()", False),
        ("l_returnflag", "StringType()", True), ("l_linestatus", "StringType()", True),
        ("l_shipdate", "TimestampNTZType()", False),
    ],
    "documents": [
        ("doc_id", "LongType()", False), ("text", "StringType()", True), ("lang", "StringType()", True),
        ("source", "StringType()", True), ("n_chars", "LongType()", False),
    ],
}


def _blank(column: str, textual: bool) -> str:
    return f"{column} IS NULL OR trim(CAST({column} AS VARCHAR)) = ''" if textual else f"{column} IS NULL"


def profile_sql(name: str, columns, source: str | None = None, value="count(DISTINCT {c})") -> str:
    """One aggregate per column, unioned."""
    parts = [
        f"""SELECT '{name}' AS table_name, {i} AS position, '{c}' AS column_name, '{t}' AS data_type,
                   count(*) AS row_count, count(*) FILTER ({_blank(c, textual)}) AS null_count,
                   round(count(*) FILTER ({_blank(c, textual)}) / count(*) * 100, 2) AS null_pct,
                   {value.format(c=c)} AS distinct_count,
                   round((count(*) - count(*) FILTER ({_blank(c, textual)})) / count(*) * 100, 2) AS completeness_pct
            FROM {source or name} HAVING count(*) > 0"""
        for i, (c, t, textual) in enumerate(columns)
    ]
    return "\nUNION ALL\n".join(parts)


@query(profile_sql("customer", COLUMNS["customer"]))
def profile_customer(spark, sf_dir):
    return profile.profile_columns(table(spark, sf_dir, "customer"), "customer")


@query(profile_sql("orders", COLUMNS["orders"]))
def profile_orders(spark, sf_dir):
    return profile.profile_columns(table(spark, sf_dir, "orders"), "orders")


@query(profile_sql("events", COLUMNS["events"]))
def profile_events(spark, sf_dir):
    return profile.profile_columns(table(spark, sf_dir, "events"), "events")


@query(profile_sql("documents", COLUMNS["documents"]))
def profile_documents(spark, sf_dir):
    return profile.profile_columns(table(spark, sf_dir, "documents"), "documents")


@query(profile_sql("lineitem", COLUMNS["lineitem"]))
def profile_lineitem(spark, sf_dir):
    return profile.profile_columns(table(spark, sf_dir, "lineitem"), "lineitem")


@query()
def profile_lineitem_approx(spark, sf_dir):
    """One pass with sketches; compared with the exact profile within its error in the tests."""
    return profile.profile_columns(table(spark, sf_dir, "lineitem"), "lineitem", distinct="approx")


NOTES = """(SELECT doc_id, source, CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN '' WHEN 'es' THEN '  ' ELSE lang END
           AS note FROM documents) notes"""
NOTE_COLUMNS = [("doc_id", "LongType()", False), ("source", "StringType()", True), ("note", "StringType()", True)]


@query(profile_sql("silver_customer", [*COLUMNS["customer"], ("n_name", "StringType()", True)],
                   "(SELECT customer.*, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey > 0)"))
def profile_derived(spark, sf_dir):
    """A joined frame that is not stored, profiled in a single evaluation."""
    nation = table(spark, sf_dir, "nation").where("n_regionkey > 0")
    nation = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = table(spark, sf_dir, "customer").join(nation, "c_nationkey", "left")
    ordered = joined.select(*[c for c, _, _ in COLUMNS["customer"]], "n_name")
    return profile.profile_columns(ordered, "silver_customer", plan="once")


def _notes(spark, sf_dir) -> DataFrame:
    """Documents with a note that is missing, empty, blank or filled, depending on the language."""
    note = F.when(F.col("lang") == "fr", "").when(F.col("lang") == "es", "  ").when(F.col("lang") != "de", F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", note.alias("note"))


@query(profile_sql("notes", NOTE_COLUMNS, NOTES))
def profile_blanks(spark, sf_dir):
    return profile.profile_columns(_notes(spark, sf_dir), "notes")


@query(profile_sql("notes", NOTE_COLUMNS, NOTES, "count(DISTINCT coalesce(CAST({c} AS VARCHAR), ''))"))
def profile_blank_distinct(spark, sf_dir):
    return profile.profile_columns(_notes(spark, sf_dir), "notes", distinct="text")


# Long texts, and texts that look like the digests by which long ones are compared.
DIGESTS = """(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '+' || sha256(text) ELSE left(text, 128) END AS mixed,
              CASE WHEN doc_id % 2 = 0 THEN repeat(' ', 200) ELSE text END AS spaced FROM documents) digests"""
DIGEST_COLUMNS = [("doc_id", "LongType()", False), ("mixed", "StringType()", True), ("spaced", "StringType()", True)]


@query(profile_sql("digests", DIGEST_COLUMNS, DIGESTS))
def profile_digest_column(spark, sf_dir):
    """Long and short texts, digests and long blank texts in one column."""
    documents, text = table(spark, sf_dir, "documents"), F.col("text")
    mixed = F.when(F.col("doc_id") % 3 == 0, text).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("+"), F.sha2(text, 256))).otherwise(F.left(text, F.lit(128)))
    spaced = F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit(" "), F.lit(200))).otherwise(text)
    return profile.profile_columns(documents.select("doc_id", mixed.alias("mixed"), spaced.alias("spaced")), "digests")


NESTED = """(SELECT o_orderkey, [nullif(o_orderpriority, '1-URGENT'), CASE WHEN o_orderstatus = 'O' THEN 'null' ELSE o_orderstatus END] AS listed,
             {'status': nullif(o_orderstatus, 'F'), 'day': o_orderdate::DATE} AS packed, o_orderdate::DATE AS day, o_totalprice > 100000 AS large,
             o_totalprice::DECIMAL(18, 2) AS price FROM orders) nested"""
NESTED_COLUMNS = [
    ("o_orderkey", "LongType()", False), ("listed", "ArrayType(StringType(), True)", False),
    ("packed", "StructType([StructField(''status'', StringType(), True), StructField(''day'', DateType(), True)])", False),
    ("day", "DateType()", False), ("large", "BooleanType()", False), ("price", "DecimalType(18,2)", False),
]


def _nested(spark, sf_dir) -> DataFrame:
    """Orders with a list and a struct that hold NULLs, a date, a flag and a decimal."""
    status = F.col("o_orderstatus")
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array(F.nullif("o_orderpriority", F.lit("1-URGENT")), F.when(status == "O", "null").otherwise(status)).alias("listed"),
        F.struct(F.nullif(status, F.lit("F")).alias("status"), day.alias("day")).alias("packed"),
        day.alias("day"),
        (F.col("o_totalprice") > 100000).alias("large"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )


@query(profile_sql("nested", NESTED_COLUMNS, NESTED))
def profile_nested(spark, sf_dir):
    return profile.profile_columns(_nested(spark, sf_dir), "nested")


@query(profile_sql("nested", NESTED_COLUMNS, NESTED))
def profile_nested_once(spark, sf_dir):
    """The same in a single evaluation, where nested values are compared as JSON texts."""
    return profile.profile_columns(_nested(spark, sf_dir), "nested", plan="once")


def gate_sql(name: str, columns, source: str | None = None) -> str:
    parts = [
        f"round((count(*) - count(*) FILTER ({_blank(c, textual)})) / nullif(count(*), 0) * 100, 2)"
        for c, _, textual in columns
    ]
    mean = f"({' + '.join(parts)}) / {len(parts)}"
    return f"""SELECT table_name, row_count, CAST({len(parts)} AS BIGINT) AS column_count,
                      coalesce(mean, 0.0) AS completeness, round(coalesce(mean, 0.0), 2) AS quality_score,
                      CASE WHEN round(coalesce(mean, 0.0), 2) >= 80 THEN 'PASS'
                           WHEN round(coalesce(mean, 0.0), 2) >= 60 THEN 'QUARANTINE' ELSE 'REJECT' END AS status
               FROM (SELECT '{name}' AS table_name, count(*) AS row_count, {mean} AS mean FROM {source or name})"""


JUDGED = """(SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) judged"""
JUDGED_COLUMNS = [
    ("doc_id", "LongType()", False), ("lang", "StringType()", True), ("source", "StringType()", True),
    ("quality", "IntegerType()", False), ("toxic", "IntegerType()", False),
]
VERDICTS = "(SELECT quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) verdicts"
EMPTY = "(SELECT * FROM customer WHERE c_acctbal > 1e12) nobody"


def _judged(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query(
    "\nUNION ALL\n".join(
        [
            gate_sql("customer", COLUMNS["customer"]),
            gate_sql("orders", COLUMNS["orders"]),
            gate_sql("lineitem", COLUMNS["lineitem"]),
            gate_sql("notes", NOTE_COLUMNS, NOTES),
            gate_sql("judged", JUDGED_COLUMNS, JUDGED),
            gate_sql("verdicts", JUDGED_COLUMNS[3:], VERDICTS),
            gate_sql("nobody", COLUMNS["customer"], EMPTY),
        ]
    )
)
def quality_gate_all(spark, sf_dir):
    """Tables that pass, are quarantined, are rejected, and an empty one."""
    judged = _judged(spark, sf_dir)
    frames = {
        "customer": table(spark, sf_dir, "customer"),
        "orders": table(spark, sf_dir, "orders"),
        "lineitem": table(spark, sf_dir, "lineitem"),
        "notes": _notes(spark, sf_dir),
        "judged": judged,
        "verdicts": judged.select("quality", "toxic"),
        "nobody": table(spark, sf_dir, "customer").where("c_acctbal > 1e12"),
    }
    return union_all([profile.quality_gate(df, name) for name, df in frames.items()])


@query(
    f"""WITH a AS ({gate_sql("judged", JUDGED_COLUMNS, JUDGED)}), b AS ({gate_sql("supplier", COLUMNS["supplier"])})
    SELECT a.table_name || ' + ' || b.table_name AS table_name, a.row_count + b.row_count AS row_count,
           a.column_count, a.completeness, round((a.quality_score + b.quality_score) / 2, 2) AS quality_score,
           CASE WHEN round((a.quality_score + b.quality_score) / 2, 2) >= 80 THEN 'PASS'
                WHEN round((a.quality_score + b.quality_score) / 2, 2) >= 60 THEN 'QUARANTINE'
                ELSE 'REJECT' END AS status
    FROM a, b"""
)
def quality_combined(spark, sf_dir):
    first = profile.quality_gate(_judged(spark, sf_dir), "judged")
    second = profile.quality_gate(table(spark, sf_dir, "supplier"), "supplier")
    return profile.combine_gates([first, second])


@query("\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def dataset_summary(spark, sf_dir):
    """Rows per file; sizes are left out, because SQL sees no files."""
    return summarise(spark, sf_dir, "parquet").select("table_name", "row_count")


@query(
    "SELECT count(*) AS table_count, CAST(sum(n) AS BIGINT) AS total_rows FROM ("
    + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in TABLES)
    + ")"
)
def dataset_totals(spark, sf_dir):
    return summary_totals(summarise(spark, sf_dir, "parquet")).select("table_count", "total_rows")


@query(
    f"""WITH p AS ({profile_sql("customer", COLUMNS["customer"])})
    SELECT table_name, max(row_count) AS row_count, CAST(count(*) AS INTEGER) AS column_count,
           'customer_raw' AS source, CAST(91.5 AS DOUBLE) AS source_score, 'PASS' AS source_status,
           round(avg(completeness_pct), 2) AS silver_completeness,
           CAST(max(distinct_count) FILTER (column_name = 'c_nationkey') AS BIGINT) AS nations
    FROM p GROUP BY table_name"""
)
def profile_provenance(spark, sf_dir):
    """Profile of a refined table with the gate of its source, folded to one row."""
    folded = profile.profile_with_provenance(
        table(spark, sf_dir, "customer"), "customer", 91.5, "PASS", ["DEDUP on c_custkey"], ["customer_raw"]
    )
    return folded.select(
        "table_name",
        "row_count",
        "column_count",
        F.col("sources")[0].alias("source"),
        "quality.source_score",
        "quality.source_status",
        "quality.silver_completeness",
        F.col("columns")["c_nationkey"]["distinct_count"].alias("nations"),
    )
