"""The registered queries of the operators, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards by jump consistent hashing (checksums have no SQL; tested against a loop)."""
    from strata.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


# The rules of op4: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

URL_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""


@query(URL_SQL)
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the rules on every page's url."""
    from strata.llm.urls import judge

    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


EXACT_SQL = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
grouped AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
"""


@query(EXACT_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    from strata.llm.exact import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"), carry=[]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _mix_sql() -> str:
    """The mix in SQL, with the fixed values of :mod:`strata.llm.mixing`."""
    from strata.llm.mixing import BLOCK, MULTIPLIERS, SPLITS

    def turned(x, m, primes, shift):
        return f"((({x}) * (CASE WHEN {m} % {primes[0]} = 0 THEN {primes[1]} ELSE {primes[0]} END) + {shift}) % {m})"

    rounds, last, b = [], "r0", BLOCK
    for r, (primes, (up, down)) in enumerate(zip(MULTIPLIERS, SPLITS)):
        shift = f"((rank + 1) * 7368787 + (epoch + 1) * 15487469 + {(r + 1) * 179424673})"
        back = primes[::-1]
        rounds.append(f"a{r} AS (SELECT * REPLACE ({turned('x', 'blocks', primes, shift)} AS x), greatest(1, blocks * {up} // {down}) AS cut FROM {last})")
        rounds.append(
            f"r{r + 1} AS (SELECT * EXCLUDE (cut) REPLACE (CASE WHEN x < cut THEN {turned('x', 'cut', back, shift)} "
            f"ELSE cut + {turned('x - cut', 'greatest(1, blocks - cut)', back, shift)} END AS x) FROM a{r})"
        )
        last = f"r{r + 1}"
    return f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1)::BIGINT AS rank FROM totals),
weighed AS (SELECT *, [5, 2, 1][(rank % 3) + 1] AS weight, source_size * 3 AS lim FROM ranked),
levels AS (
  SELECT *, lim::DOUBLE / weight AS ratio,
    ((sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
     / sum(weight) OVER (ORDER BY lim::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM weighed),
plan AS (
  SELECT source, rank, source_size,
    least(lim::DOUBLE, coalesce(weight * (SELECT max(level) FROM levels WHERE ratio > level), lim::DOUBLE)) AS target FROM levels),
epochs AS (
  SELECT rank, source_size, (source_size + {b - 1}) // {b} AS blocks, least(round(target)::BIGINT, source_size * 3) AS words,
    unnest(range(0, least(round(target)::BIGINT, source_size * 3) // source_size + 1)) AS epoch FROM plan WHERE source_size > 0),
remaining AS (SELECT *, least(source_size, words - epoch * source_size) AS remains FROM epochs),
r0 AS (
  SELECT rank, epoch, blocks, source_size, remains, place, place AS x
  FROM (SELECT *, unnest(range(0, (remains + {b - 1}) // {b})) AS place FROM remaining WHERE remains > 0)),
{", ".join(rounds)},
draws AS (SELECT rank, x AS block, CASE WHEN remains = source_size THEN {b} ELSE least({b}, remains - place * {b}) END AS words FROM {last}),
known AS (SELECT s.doc_id, s.size, p.rank, p.source_size, p.target FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY ((coalesce(doc_id, size) % 256) + 256) % 256, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM known),
pieces AS (SELECT *, unnest(range(before // {b}, (before + size - 1) // {b} + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT rank, before, sum(greatest(0, least(size, block * {b} + words - before) - greatest(0, block * {b} - before)))::BIGINT AS taken
  FROM pieces JOIN draws USING (rank, block) GROUP BY rank, before)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE coalesce(taken, 0) END::BIGINT AS taken
FROM placed LEFT JOIN taken USING (rank, before)
"""


@query(_mix_sql())
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    from strata.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op3_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Arrow stream files and read back."""
    from strata.llm.arrowfiles import round_trip

    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


@query()
def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    from strata.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from strata.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    from strata.llm.language import identify

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(documents, vocabulary("piece_bpe_32k.model")).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op2_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    from pyspark.sql import functions as F

    from strata.llm.vectors import search

    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query()
def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    from strata.llm.near import near_groups

    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


INFILL_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cut AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::UBIGINT % (len(units) + 1) AS one, ('0x' || h[9:16])::UBIGINT % (len(units) + 1) AS two,
         ('0x' || h[17:24])::UBIGINT % 100 AS plain, ('0x' || h[25:32])::UBIGINT % 100 AS suffix_first FROM drawn),
parts AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR plain >= 90 THEN 'plain'
                               WHEN suffix_first < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(one, two)], '') AS prefix, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1:], '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


@query(INFILL_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle text, by checksums of the output and of the text rebuilt from it."""
    from pyspark.sql import functions as F

    from strata.llm.infill import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


# crc32 of the decimal id, bit by bit, modulo 4; turns as texts of 64 digits, so that prefixes are prefixes of one text.
TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, digest) AS turns FROM turns GROUP BY conv_id),
drawn AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM drawn a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
paths AS (SELECT conv_id, turns, coalesce(array_to_string(list_transform(turns, lambda t: t.d), ''), '') AS path FROM rebuilt),
visits AS (
  SELECT conv_id, d, path[1:64 * d] AS node, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS words, len(turns) = d AS ends
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM visits GROUP BY node, d),
children AS (SELECT node[1:64 * (d - 1)] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
below AS (
  SELECT top AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT n_children, n_convs, words, node[1:64 * unnest(range(0, d + 1))] AS top FROM known) GROUP BY top)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.n_leaves, b.saved_tokens, k.ends_sha256
FROM known k JOIN below b USING (node) LEFT JOIN nodes p ON k.d > 0 AND p.node = k.node[1:64 * (k.d - 1)]
"""


@query(TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    from strata.llm.prefixtrie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


@query()
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    from strata.llm.quality import classify

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(documents, table(spark, sf_dir, "labels").select("doc_id", "quality"), carry=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
