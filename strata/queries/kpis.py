"""KPI facts over orders, customers, events, suppliers, parts and line items.

Fact ids are hashes without an SQL counterpart; they are left out here and checked by
``fact_ids_unique``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.functions.numbers import target_status
from strata.operators import dims, kpi, refine
from strata.operators.profile import quality_gate
from strata.queries import query, table
from strata.queries.quality import COLUMNS, gate_sql
from strata.queries.refinement import orders_with_flags

FIRST, LAST, FALLBACK = 1995, 2001, 2000
YEARS = range(FIRST, LAST + 1)
# Yearly targets; 2001 has none for OUT and HEAD, so the fallback year's are used.
TARGETS = {
    year: {
        **({"OUT": 60 + i, "HEAD": 0.4 + 0.1 * i} if year != LAST else {}),
        "PREM": 50 + i,
        "PART": 20 + 2 * i,
        "QUAL": 80 + i,
        "COV": 35 + 5 * i,
        "CAP": 70 + i,
        "CERT": 30 + 3 * i,
        "PAID": 94.5 + 0.25 * i,
        "GRADE": "A" if year >= 2000 else "BB",
    }
    for i, year in enumerate(YEARS)
}


def _targets_sql(code: str) -> str:
    rows = ", ".join(f"({y}, CAST({v[code]} AS DOUBLE))" for y, v in TARGETS.items() if code in v)
    return f"(SELECT * FROM (VALUES {rows}) t(ty, target))"


def _kpi(spark, code: str, **settings) -> kpi.Kpi:
    settings = {"value": "value", "fallback_year": FALLBACK, **settings}
    return kpi.Kpi(code=code, targets=kpi.target_table(spark, TARGETS), **settings)


def rounded(value: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal text of a double, as Spark rounds doubles."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def finish_sql(counted: str, code: str, columns: str, floor="1.0", unknown=None, period="y", value="value") -> str:
    """Target, attainment and period of a counted relation with a year ``y`` and a value."""
    fallback = f"coalesce((SELECT max(target) FROM {_targets_sql(code)} WHERE ty = {FALLBACK}), 0.0)"
    target = f"coalesce(t.target, {fallback})"
    if unknown is not None:
        target = f"CASE WHEN y IS NULL THEN {unknown} ELSE {target} END"
    divisor = "target" if floor is None else f"greatest(target, {floor})"
    return f"""SELECT CAST({period} * 100 + 12 AS INTEGER) AS period_key, {columns}, value AS {value}, target,
                      {rounded(f"value / nullif({divisor}, 0) * 100", 2)} AS attainment
               FROM (SELECT c.*, {target} AS target FROM ({counted}) c LEFT JOIN {_targets_sql(code)} t ON c.y = t.ty)"""


OUTCOME = finish_sql(
    """SELECT y, nation_id, total, fulfilled, pending, remaining,
              round((fulfilled + pending) / total * 100, 2) AS value
       FROM (SELECT year(o_orderdate) AS y, c_nationkey AS nation_id, count(*) AS total,
                    count(*) FILTER (o_orderstatus = 'F') AS fulfilled, count(*) FILTER (o_orderstatus = 'P') AS pending,
                    count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS remaining
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""",
    "OUT",
    "nation_id, total, fulfilled, pending, remaining",
    floor=None,
    value="processed_pct",
)


def outcome_fact(spark, sf_dir) -> DataFrame:
    """Per order year and nation: share of orders that are processed, against the year's target."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation_id")
    )
    orders = orders_with_flags(spark, sf_dir).withColumn("year", F.year("o_orderdate"))
    return kpi.outcome_share(
        orders.join(customers, "o_custkey"),
        _kpi(spark, "OUT", value="processed_pct", floor=None),
        year="year",
        unit="nation_id",
        total="total",
        outcomes={"fulfilled": "is_fulfilled", "pending": "is_pending"},
        remainder=("remaining", "is_processed"),
    )


@query(OUTCOME)
def kpi_outcome_share(spark, sf_dir):
    return outcome_fact(spark, sf_dir).drop("fact_id")


@query(
    f"""WITH f AS ({OUTCOME}), g AS ({gate_sql("orders", COLUMNS["orders"])})
        SELECT f.*, CASE WHEN processed_pct >= target THEN 'Tercapai' WHEN processed_pct >= target * 0.8 THEN 'On Track'
                         ELSE 'Tidak Tercapai' END AS status,
               g.quality_score AS source_score, g.status AS source_status
        FROM f, g"""
)
def flagship(spark, sf_dir):
    """Processed orders by year and nation against the target, with the gate of the orders they rest on."""
    gate = quality_gate(table(spark, sf_dir, "orders"), "orders")
    return (
        outcome_fact(spark, sf_dir)
        .drop("fact_id")
        .withColumns(
            {
                "status": target_status(F.col("processed_pct"), F.col("target")),
                "source_score": gate.select("quality_score").scalar(),
                "source_status": gate.select("status").scalar(),
            }
        )
    )


@query(f"SELECT count(*) AS facts, count(*) AS fact_ids FROM ({OUTCOME})")
def fact_ids_unique(spark, sf_dir):
    return outcome_fact(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("facts"), F.count_distinct("fact_id").alias("fact_ids")
    )


PREMIUM_BASE = """WITH buyers AS (SELECT c_custkey, c_mktsegment AS segment, c_acctbal >= 5000 AS is_premium, first_year AS y
                                  FROM customer LEFT JOIN (SELECT o_custkey, min(year(o_orderdate)) AS first_year
                                                           FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey),
                       held AS (SELECT DISTINCT o_custkey AS c_custkey, year(o_orderdate) AS y FROM orders
                                WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 250000)"""
PREMIUM_COLUMNS = "segment, total, premium, holders, qualified"


def _premium_sql(counted: str) -> str:
    valued = f"SELECT *, round(qualified / total * 100, 2) AS value FROM ({counted})"
    return PREMIUM_BASE + finish_sql(valued, "PREM", PREMIUM_COLUMNS)


def _premium(spark, sf_dir, **settings) -> DataFrame:
    """Customers over a balance, with credit for those who placed a big urgent order in their first year."""
    per_unit = settings.pop("per_unit", False)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"), "o_orderpriority", "o_totalprice"
    )
    first = orders.groupBy("c_custkey").agg(F.min("year").alias("year"))
    buyers = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") >= 5000).alias("is_premium"))
        .join(first, "c_custkey", "left")
    )
    big = orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") >= 250000))
    fact = kpi.threshold_share(
        buyers,
        big.withColumnRenamed("year", "event_year"),
        _kpi(spark, "PREM", **settings),
        key="c_custkey",
        year="year",
        unit="segment",
        total="total",
        flag="is_premium",
        flagged="premium",
        event_year="event_year",
        holders="holders",
        qualified="qualified",
        per_unit=per_unit,
    )
    return fact.drop("fact_id")


@query(
    _premium_sql(
        """SELECT g.*, coalesce(h.n, 0) AS holders, premium + coalesce(h.n, 0) AS qualified
           FROM (SELECT y, segment, count(*) AS total, count(*) FILTER (is_premium) AS premium FROM buyers GROUP BY ALL) g
           LEFT JOIN (SELECT y, count(*) AS n FROM held GROUP BY y) h ON g.y = h.y"""
    )
)
def kpi_threshold_sum(spark, sf_dir):
    """Event holders are counted over all segments and added to each."""
    return _premium(spark, sf_dir)


_PER_UNIT = """SELECT b.y, segment, count(*) AS total, count(*) FILTER (is_premium) AS premium,
                      count(h.c_custkey) AS holders, {qualified} AS qualified
               FROM buyers b LEFT JOIN held h ON b.c_custkey = h.c_custkey AND b.y = h.y GROUP BY ALL"""


@query(_premium_sql(_PER_UNIT.format(qualified="count(*) FILTER (is_premium OR h.c_custkey IS NOT NULL)")))
def kpi_threshold_any(spark, sf_dir):
    """Every customer counts once."""
    return _premium(spark, sf_dir, numerator="any")


@query(_premium_sql(_PER_UNIT.format(qualified="count(*) FILTER (is_premium) + count(h.c_custkey)")))
def kpi_threshold_per_unit(spark, sf_dir):
    return _premium(spark, sf_dir, per_unit=True)


KINDS = {"viewers": "view", "clickers": "click", "buyers": "purchase"}
PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH"}


def _participation_sql(activity: str, key: str, year: str, kind: str, kinds: dict, numerator: str) -> str:
    has = ", ".join(f"bool_or({kind} = '{k}') AS h_{m}" for m, k in kinds.items())
    counts = ", ".join(f"count(*) FILTER (h_{m}) AS {m}" for m in kinds)
    either = f"count(*) FILTER ({' OR '.join(f'h_{m}' for m in kinds)})"
    qualified = either if numerator == "any" else " + ".join(kinds)
    inner = f"""SELECT y, nation_id, count(*) AS total, {counts}{f", {either} AS qualified" if numerator == "any" else ""}
                FROM (SELECT c_custkey, c_nationkey AS nation_id, y, {", ".join(f"h_{m}" for m in kinds)}
                      FROM customer LEFT JOIN (SELECT {key} AS k, {year} AS y, {has} FROM {activity} GROUP BY ALL)
                      ON c_custkey = k) GROUP BY y, nation_id"""
    counted = inner if numerator == "any" else f"SELECT *, {qualified} AS qualified FROM ({inner})"
    return finish_sql(
        f"SELECT *, round(qualified / total * 100, 2) AS value FROM ({counted})",
        "PART",
        f"nation_id, total, {', '.join(kinds)}, qualified",
        unknown="0.0",
        period=f"coalesce(y, {FALLBACK})",
    )


def _participation(spark, activity: DataFrame, customers: DataFrame, kind: str, kinds: dict, numerator: str):
    entities = customers.select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation_id"))
    fact = kpi.participation_share(
        entities,
        activity,
        _kpi(spark, "PART", numerator=numerator, unknown_year=0),
        key="entity",
        year="year",
        unit="nation_id",
        kind=kind,
        kinds=kinds,
        total="total",
        qualified="qualified",
    )
    return fact.drop("fact_id")


def _event_participation(spark, sf_dir, numerator: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.year("ts").alias("year"), "event_type"
    )
    return _participation(spark, events, table(spark, sf_dir, "customer"), "event_type", KINDS, numerator)


def _order_participation(spark, sf_dir, numerator: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), "o_orderpriority"
    )
    return _participation(spark, orders, table(spark, sf_dir, "customer"), "o_orderpriority", PRIORITIES, numerator)


@query(_participation_sql("events", "user_id", "year(ts)", "event_type", KINDS, "sum"))
def kpi_participation_sum(spark, sf_dir):
    """Most customers have no event: they keep an unknown year and land in the fallback period."""
    return _event_participation(spark, sf_dir, "sum")


@query(_participation_sql("events", "user_id", "year(ts)", "event_type", KINDS, "any"))
def kpi_participation_any(spark, sf_dir):
    return _event_participation(spark, sf_dir, "any")


@query(_participation_sql("orders", "o_custkey", "year(o_orderdate)", "o_orderpriority", PRIORITIES, "any"))
def kpi_participation_orders(spark, sf_dir):
    return _order_participation(spark, sf_dir, "any")


def _suppliers_with_flags(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    supplier = table(spark, sf_dir, "supplier").withColumns(
        {"is_wealthy": F.col("s_acctbal") >= 5000, "is_debtor": F.col("s_acctbal") < 0}
    )
    return refine.activity_flag(supplier, lines, "s_suppkey", "l_returnflag", "is_active", 3, ["s_nationkey", "s_acctbal"])


def _qualification_sql(qualified: str) -> str:
    return finish_sql(
        f"""SELECT *, {FALLBACK} AS y, round(qualified / total * 100, 2) AS value FROM (
                SELECT s_nationkey AS nation_id, count(*) AS total, count(*) FILTER (s_acctbal >= 5000) AS wealthy,
                       count(*) FILTER (s_acctbal < 0) AS debtors, count(*) FILTER (coalesce(kinds, 0) >= 3) AS active,
                       {qualified} AS qualified
                FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY ALL)
                     ON s_suppkey = l_suppkey GROUP BY s_nationkey)""",
        "QUAL",
        "nation_id, total, wealthy, debtors, active, qualified",
    )


def _qualification(spark, sf_dir, numerator: str) -> DataFrame:
    fact = kpi.qualification_share(
        _suppliers_with_flags(spark, sf_dir).withColumnRenamed("s_nationkey", "nation_id"),
        _kpi(spark, "QUAL", numerator=numerator),
        unit="nation_id",
        total="total",
        flags={"wealthy": "is_wealthy", "debtors": "is_debtor", "active": "is_active"},
        qualified="qualified",
    )
    return fact.drop("fact_id")


_QUALIFIED_SUM = """count(*) FILTER (s_acctbal >= 5000) + count(*) FILTER (s_acctbal < 0)
                    + count(*) FILTER (coalesce(kinds, 0) >= 3)"""
_QUALIFIED_ANY = "count(*) FILTER (s_acctbal >= 5000 OR s_acctbal < 0 OR coalesce(kinds, 0) >= 3)"


@query(_qualification_sql(_QUALIFIED_SUM))
def kpi_qualification_sum(spark, sf_dir):
    """Flags add up and can pass 100 %."""
    return _qualification(spark, sf_dir, "sum")


@query(_qualification_sql(_QUALIFIED_ANY))
def kpi_qualification_any(spark, sf_dir):
    return _qualification(spark, sf_dir, "any")


PER_HEAD = finish_sql(
    """SELECT *, urgent + big AS eligible, round((urgent + big) / greatest(heads, 1), 4) AS value
       FROM (SELECT c_nationkey AS nation_id, year(o_orderdate) AS y, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent,
                    count(*) FILTER (o_totalprice >= 400000) AS big
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
       LEFT JOIN (SELECT c_nationkey AS nation_id, count(*) AS heads FROM customer GROUP BY ALL) USING (nation_id)""",
    "HEAD",
    "nation_id, heads, urgent, big, eligible",
    floor="0.01",
    value="per_head",
)


def per_head_fact(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation_id")
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.year("o_orderdate").alias("year"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"),
        (F.col("o_totalprice") >= 400000).alias("is_big"),
    )
    return kpi.output_per_head(
        orders.join(customers, "o_custkey"),
        customers,
        _kpi(spark, "HEAD", value="per_head", floor=0.01),
        year="year",
        group="nation_id",
        flags={"urgent": "is_urgent", "big": "is_big"},
        head_count="heads",
        eligible="eligible",
    )


@query(PER_HEAD)
def kpi_output_per_head(spark, sf_dir):
    return per_head_fact(spark, sf_dir).drop("fact_id")


def _coverage_sql(code: str, total: str, hits: str, columns: str) -> str:
    years = f"(SELECT unnest(range({FIRST}, {LAST + 1})) AS y)"
    return finish_sql(
        f"""SELECT y, total, hits, round(hits / greatest(total, 1) * 100, 2) AS value
            FROM {years}, (SELECT ({total}) AS total, ({hits}) AS hits)""",
        code,
        columns,
    )


COVERAGE = _coverage_sql(
    "COV",
    "SELECT count(*) FROM nation",
    "SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_acctbal >= 9000",
    "total, hits",
)


def coverage_fact(spark, sf_dir) -> DataFrame:
    return kpi.coverage_share(
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_id")),
        table(spark, sf_dir, "supplier").where("s_acctbal >= 9000").select(F.col("s_nationkey").alias("nation_id")),
        _kpi(spark, "COV"),
        key="nation_id",
        years=list(YEARS),
        total="total",
        hits="hits",
    )


@query(COVERAGE)
def kpi_coverage(spark, sf_dir):
    """Nations with a wealthy supplier among all nations, against every year's target."""
    return coverage_fact(spark, sf_dir).drop("fact_id")


def _certified(spark, sf_dir, strict: bool) -> DataFrame:
    latest = refine.latest_valid(
        table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_linestatus"),
        "l_partkey",
        "l_shipdate",
        None,
        None,
        ["l_orderkey", "l_linenumber", "l_linestatus"],
        {"is_open": F.col("l_linestatus") == "O"},
    )
    fact = kpi.coverage_share(
        table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("part_id")),
        latest.where("is_open").select(F.col("l_partkey").alias("part_id")),
        _kpi(spark, "CERT"),
        key="part_id",
        years=list(YEARS),
        total="parts",
        hits="certified",
        strict=strict,
    )
    return fact.drop("fact_id")


_LATEST_OPEN = """(SELECT l_partkey FROM (
        SELECT l_partkey, l_linestatus, row_number() OVER (PARTITION BY l_partkey
               ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_linestatus) AS rn FROM lineitem)
    WHERE rn = 1 AND l_linestatus = 'O')"""
_SMALL_PARTS = "SELECT count(*) FROM part WHERE p_size <= 25"


@query(_coverage_sql("CERT", _SMALL_PARTS, f"SELECT count(DISTINCT l_partkey) FROM {_LATEST_OPEN}", "total AS parts, hits AS certified"))
def kpi_certified_share(spark, sf_dir):
    """The numerator counts parts of any size, so it can pass 100 %."""
    return _certified(spark, sf_dir, strict=False)


@query(
    _coverage_sql(
        "CERT",
        _SMALL_PARTS,
        f"SELECT count(DISTINCT l_partkey) FROM {_LATEST_OPEN} WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)",
        "total AS parts, hits AS certified",
    )
)
def kpi_certified_share_strict(spark, sf_dir):
    return _certified(spark, sf_dir, strict=True)


@query(
    finish_sql(
        """SELECT *, round(qualified / total * 100, 2) AS value FROM (
               SELECT *, least(returned + open, total) AS qualified FROM (
                   SELECT year(l_shipdate) AS y, p_brand AS brand, count(*) AS total,
                          count(*) FILTER (l_returnflag <> 'N') AS returned, count(*) FILTER (l_linestatus = 'O') AS open
                   FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL))""",
        "CAP",
        "brand, total, returned, open, qualified",
    )
)
def kpi_capped_union(spark, sf_dir):
    """Returned and open lines overlap; their sum is capped by the lines of brand and year.

    Lines are counted per part before the parts are joined.
    """
    per_part = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"), F.year("l_shipdate").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("l_returnflag") != "N").alias("returned"),
            F.count_if(F.col("l_linestatus") == "O").alias("open"),
        )
    )
    measures = ("total", "returned", "open")
    per_brand = (
        per_part.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand")), "p_partkey")
        .groupBy("year", "brand")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    fact = kpi.capped_share(per_brand, _kpi(spark, "CAP"), "year", "brand", "total", ["returned", "open"], "qualified")
    return fact.drop("fact_id")


GRADES = ", ".join(f"({y}, '{v['GRADE']}', CAST({v['PAID']} AS DOUBLE))" for y, v in TARGETS.items())
REALISED = f"""SELECT CAST(y * 100 + 12 AS INTEGER) AS period_key, grade AS label, round(realised_pct * 0.95, 1) AS index_value,
                      realised_pct AS performance, planned_total, realised_total, realised_pct, 'BB' AS label_target, target
               FROM (SELECT *, round(realised_total / planned_total * 100, 2) AS realised_pct
                     FROM (SELECT year(l_shipdate) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS planned_total,
                                  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)
                                      AS realised_total
                           FROM lineitem GROUP BY 1))
               LEFT JOIN (VALUES {GRADES}) t(ty, grade, target) ON y = ty"""


def realisation_fact(spark, sf_dir) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        price.alias("planned"),
        (price * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("paid"),
    )
    return kpi.realisation(
        lines, kpi.target_table(spark, TARGETS), "year", "planned", "paid", "GRADE", "PAID", "BB", "decimal(22,4)"
    )


@query(REALISED)
def kpi_realisation(spark, sf_dir):
    return realisation_fact(spark, sf_dir).drop("fact_id")


STATUS = """CASE WHEN v IS NULL OR t IS NULL THEN '' WHEN v >= t THEN 'Tercapai'
                 WHEN v >= t * 0.8 THEN 'On Track' ELSE 'Tidak Tercapai' END"""


def _score_sql(code: str, name: str, unit: str, fact: str, value: str) -> str:
    return f"""SELECT period_key, '{code}' AS code, '{name}' AS name, round(v, 2) AS value, round(t, 2) AS target,
                      '{unit}' AS unit, {STATUS} AS status
               FROM (SELECT period_key, avg({value}) AS v, avg(target) AS t FROM ({fact}) GROUP BY period_key)"""


SCORECARD = "\nUNION ALL\n".join(
    [
        _score_sql("OUT", "Processed orders", "%", OUTCOME, "processed_pct"),
        _score_sql("HEAD", "Eligible orders per customer", "Rasio", PER_HEAD, "per_head"),
        _score_sql("COV", "Nations with a wealthy supplier", "%", COVERAGE, "value"),
        _score_sql("PAID", "Discounted revenue", "%", REALISED, "realised_pct"),
    ]
)


def _scorecard(spark, sf_dir) -> DataFrame:
    facts = [
        ("OUT", "Processed orders", "%", outcome_fact(spark, sf_dir), "processed_pct"),
        ("HEAD", "Eligible orders per customer", "Rasio", per_head_fact(spark, sf_dir), "per_head"),
        ("COV", "Nations with a wealthy supplier", "%", coverage_fact(spark, sf_dir), "value"),
        ("PAID", "Discounted revenue", "%", realisation_fact(spark, sf_dir), "realised_pct"),
    ]
    return kpi.scorecard(facts).drop("fact_id")


@query(SCORECARD)
def kpi_scorecard(spark, sf_dir):
    return _scorecard(spark, sf_dir)


@query(
    f"""SELECT period_key, code, CASE WHEN value IS NULL OR target IS NULL OR target = 0 THEN 0.0
               ELSE round(least(CASE WHEN unit = 'Rasio' THEN value / target * 100 ELSE value END, 100.0), 2) END AS progress
        FROM ({SCORECARD})"""
)
def kpi_progress(spark, sf_dir):
    return kpi.progress(_scorecard(spark, sf_dir)).select("period_key", "code", "progress")


@query(
    f"""SELECT 'fact_outcome' AS table_name, round(v, 2) AS value, round(t, 2) AS target, round(a, 2) AS attainment,
               {STATUS} AS status, '%' AS unit
        FROM (SELECT avg(processed_pct) AS v, avg(target) AS t, avg(attainment) AS a FROM ({OUTCOME}))"""
)
def kpi_summary(spark, sf_dir):
    return kpi.kpi_summary(outcome_fact(spark, sf_dir), "fact_outcome", "processed_pct")


@query(
    f"""SELECT f.table_name, 'fact' AS table_type, f.row_count, 10 AS column_count, s.value, s.status
        FROM (SELECT 'fact_outcome' AS table_name, count(*) AS row_count FROM ({OUTCOME})) f,
             (SELECT round(v, 2) AS value, {STATUS} AS status
              FROM (SELECT avg(processed_pct) AS v, avg(target) AS t FROM ({OUTCOME}))) s"""
)
def gold_profile(spark, sf_dir):
    fact = outcome_fact(spark, sf_dir)
    summary = kpi.kpi_summary(fact, "fact_outcome", "processed_pct")
    profile = kpi.gold_profile(fact, "fact_outcome", "fact", ["silver_orders", "customer"], summary)
    return profile.select(
        "table_name", "table_type", "row_count", "column_count", "sample_kpi.value", "sample_kpi.status"
    )


@query(
    f"""WITH f AS ({OUTCOME})
        SELECT n_name AS nation, CAST(period_key // 100 AS INTEGER) AS year, total, processed_pct, target, attainment
        FROM f JOIN nation ON nation_id = n_nationkey
             JOIN (SELECT DISTINCT CAST(year(o_orderdate) * 100 + 12 AS INTEGER) AS k FROM orders) ON k = period_key
        ORDER BY attainment DESC, nation, year"""
)
def star_report(spark, sf_dir):
    """Fact joined with its nation and calendar dimensions, best attainment first."""
    nation = dims.mapped_dimension(
        table(spark, sf_dir, "nation"), "nation_id", {"nation_id": "n_nationkey", "nation": "n_name"}
    )
    calendar = dims.calendar_dimension(dims.year_range(table(spark, sf_dir, "orders"), "o_orderdate"))
    return (
        outcome_fact(spark, sf_dir)
        .join(nation, "nation_id")
        .join(calendar.select("period_key", "year"), "period_key")
        .select("nation", "year", "total", "processed_pct", "target", "attainment")
        .orderBy(F.col("attainment").desc(), "nation", "year")
    )


@query(
    """SELECT c_nationkey AS nation_id, n_name AS nation, count(*) AS customers,
              count(*) FILTER (c_acctbal >= 5000) AS premium
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY customers DESC, nation_id"""
)
def group_report(spark, sf_dir):
    """Report in SQL text over registered views."""
    from strata.queries.refinement import enrich_customer

    return spark.sql(
        """SELECT c_nationkey AS nation_id, n_name AS nation, count(*) AS customers,
                  count_if(is_premium) AS premium
           FROM {silver} GROUP BY c_nationkey, n_name ORDER BY customers DESC, nation_id""",
        silver=enrich_customer(spark, sf_dir),
    )
