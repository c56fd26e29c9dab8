"""Every operator against a brute-force version, on the smallest tables and on hand-made rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strata.llm import queries as llm

LONG = "wort " * 30_000
TEXTS = [None, "", " \t\n", "One two three four five six", "one TWO three four five six", "one two", "One two", "ÄÖ é one", LONG, LONG, "x" * 50_000, "123 !? 4", "a\nb  c"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, empty and long texts, a column with a clashing name."""
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "s1", "s2"][i % 3], None, f"own{i}") for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "one two three four five six", None, None, None, "null id"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def check_shards(rows, texts):
    places = {}
    for r in rows:
        raw = (texts[r.doc_id] if r.doc_id in texts else None or "") or ""
        if r.doc_id is not None:
            assert r["size"] == len(raw.encode()) + 1 and r.text_crc32 == zlib.crc32(raw.encode())
        assert r.shard == jump(r.doc_id or 0, 16) and r.grown_shard == jump(r.doc_id or 0, 17) and r.law == "key"
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards(spark, sf, odd, none):
    from strata.llm.sharding import shard, shard_documents

    documents = {r.doc_id: r.text for r in llm.table(spark, sf, "documents").collect()}
    check_shards(llm.QUERIES["op1_jump_shards"](spark, sf).collect(), documents)
    check_shards(shard_documents(odd).collect(), dict(enumerate(TEXTS)))
    assert shard_documents(none).collect() == []
    assert {r.shard for r in shard(odd, "doc_id", 3).collect()} <= {0, 1, 2}
    negative = spark.createDataFrame([(-5,), (2**62,), (-(2**63),)], "k long")
    assert {r.k: (r.shard, r.grown_shard) for r in shard(negative, "k", 7).collect()} == {k: (jump(k, 7), jump(k, 8)) for k in (-5, 2**62, -(2**63))}


def test_neighbours(spark, sf):
    from pyspark.sql import functions as F

    from strata.llm.vectors import search

    table = {r.vec_id: np.array(r.embedding, float) for r in llm.table(spark, sf, "embeddings").collect()}
    found = {}
    for r in llm.QUERIES["op2_one_bit_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert set(found) == {i for i in table if i % 20 == 0}
    hits = 0
    for q, rows in found.items():
        scores = {i: float((v * table[q]).sum()) for i, v in table.items() if i != q}
        assert all(abs(s - scores[i]) < 1e-12 for i, s in rows)
        hits += len({i for i, _ in rows} & {i for i, _ in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:20]})
    assert hits >= 0.95 * 20 * len(found)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [3.0, 4.0]), (2, [3.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 0.0]), (8, [1.0]), (9, [-1.0, 0.0]), (20, []), (1, [3.0, 4.0])]
    small = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in search(small, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 3.0), (0, 3, 2, 3.0), (0, 4, 9, -1.0)]
    assert search(small.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def ids_of(name, texts):
    from tokenizers import Tokenizer

    encoded = Tokenizer.from_file(llm.vocabulary(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, 1], "<u4") for e in encoded]


def test_token_files(spark, sf, odd, none, tmp_path):
    from strata.llm.arrowfiles import TokenFile, TokenWriter, round_trip

    documents = sorted((r.doc_id, r.text) for r in llm.table(spark, sf, "documents").collect())
    got = {r.doc_id: r for r in llm.QUERIES["op3_arrow_tokens"](spark, sf).collect()}
    at = 0
    for (i, _), ids in zip(documents, ids_of("word_bpe_49k.json", [t for _, t in documents])):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    file = llm.vocabulary("word_bpe_49k.json")
    rows = round_trip(odd, file).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd.collect()), key=lambda i: (i is not None, i))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert round_trip(none, file).collect() == []

    import pyarrow as pa
    from pyarrow import fs

    path = str(tmp_path / "tokens.arrow")
    with pa.OSFile(path, "wb") as sink, pa.OSFile(str(tmp_path / "docs.arrow"), "wb") as index:
        writer = TokenWriter(sink, index, length=8, rows=4)
        writer.add(1, np.arange(45))
        writer.add(None, np.arange(100, 130))
        writer.close()
    opened = TokenFile(fs.LocalFileSystem(), path)
    assert list(opened.ids(40, 10)) == [40, 41, 42, 43, 44, 100, 101, 102, 103, 104]
    ids, mask = opened.sequence(9)
    assert list(ids) == [127, 128, 129, 0, 0, 0, 0, 0] and mask.to_pylist() == [True] * 3 + [False] * 5


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_exact(name):
    from strata.llm.tokens import Encoder

    texts = [t for t in TEXTS if t is None or len(t) < 1000] + [
        "  a", " a  b ", "a \nb", "\na", "a\nb c\n", "a\n b", "x!!\ny ##\n\nz", "é ́a", "I'm 'sx it's 12 345", "a\tb  c\n\n d", "ΑΣ Σ İ ﬁ", "\x1c a \x1c b", "日本 語", "a\u2003b", "ǅ ŉ ß, Ünï."
    ]
    encoder = Encoder(llm.vocabulary(name))
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() + [1] for g in encoder.encode(texts)] == [i.tolist() for i in ids_of(name, texts)]


def test_urls(spark):
    from strata.llm.urls import judge

    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("a.b.com", "", "block"), ("com", "/fr/x", "block")]
    urls = [None, "", "no url", "http://example.org", "http://EXAMPLE.org/es/1", "x://sub.example.org/en/12?q", "http://badexample.org/es/1", "http://a.b.com/fr/x", "http://z.a.b.com",
            "http://b.com/fr/x/y#z", "http://b.com/fr/y", "http://b.com/frx", "http://org/", "http://example.org./es/", "a://b://c/d", "http://ex.com\n/fr/", "http://com/fr/x" + "y" * 10_000]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), salts=4).collect()}
    for i, url in enumerate(urls * 2):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and rest]
        best = max(fits, default=(0, None, "allow"))
        assert got[i] == (host, path, best[1], best[2]), url
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in judge(pages, empty, salts=4).collect()} == {"allow"}
    assert judge(pages.where("false"), empty, salts=4).collect() == []


def test_mix(spark, sf, odd, none):
    from strata.llm.mixing import mix_documents, mixed_texts

    documents = {r.doc_id: r for r in llm.table(spark, sf, "documents").collect()}
    rows = llm.QUERIES["op5_mix_sources"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, llm.QUERIES["op5_mix_sources"](spark, sf).collect()))
    by_source = {}
    for r in rows:
        assert r["size"] == len(words(documents[r.doc_id].text)) and 0 <= r.taken <= 3 * r["size"]
        by_source.setdefault(documents[r.doc_id].source, []).append(r)
    sizes = {s: sum(r["size"] for r in g) for s, g in by_source.items()}
    weights = dict(zip(sorted(sizes), [5, 2, 1] * len(sizes)))
    targets, full = {}, set()
    while True:  # the excess of the full sources goes to the others until none is above its limit
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        targets = {s: 3.0 * sizes[s] if s in full else weights[s] * level for s in sizes}
        above = {s for s in sizes if targets[s] > 3 * sizes[s]}
        if not above:
            break
        full |= above
    for s, g in by_source.items():
        assert {r.source_size for r in g} == {sizes[s]} and abs(g[0].target - targets[s]) < 1e-6
        assert abs(sum(r.taken for r in g) - targets[s]) <= 64
    taken = {r.doc_id: r.taken for r in rows}
    texts = Counter()
    for r in mixed_texts(llm.table(spark, sf, "documents")).collect():
        texts[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(texts)
    assert mix_documents(odd).count() == odd.count() and mix_documents(none).collect() == []
    assert set(mixed_texts(odd).columns) == set(odd.columns) and mixed_texts(none).collect() == []


def test_shard_draws(spark):
    """Counts per shard are drawn like multinomials, and the slots of all shards together are every place once."""
    from strata.llm.mixing import slots

    plan = spark.createDataFrame([(0, 64 * 5000, 64 * 7500.0), (1, 100, 150.0), (2, 0, 0.0)], "rank long, source_size long, target double")
    rows = slots(plan, 64, 16, chunk=100).collect()
    places, counts = {}, Counter()
    for r in rows:
        places.setdefault((r.rank, r.epoch), []).append((r.place, r.block, r.words))
        counts[r.rank, r.epoch, r.shard] += 1
    assert {k: len(v) for k, v in places.items()} == {(0, 0): 5000, (0, 1): 2500, (1, 0): 2, (1, 1): 1}
    for held in places.values():
        assert sorted(p for p, _, _ in held) == list(range(len(held))) and len({b for _, b, _ in held}) == len(held)
    assert sum(w for _, _, w in places[0, 1]) == 64 * 2500 and [w for _, _, w in places[1, 1]] == [50]
    spread = sum((counts[0, 0, s] - 312.5) ** 2 / 312.5 for s in range(16))
    assert 3 < spread < 45  # neither equal shares nor a skewed draw (15 degrees of freedom)
    for (rank, epoch, shard), n in counts.items():
        own = sorted((r.slot, r.place) for r in rows if (r.rank, r.epoch, r.shard) == (rank, epoch, shard))
        assert [a for a, _ in own] == list(range(n)) and [b - own[0][1] for _, b in own] == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    from strata.llm.mixing import permuted

    rows = spark.range(n).selectExpr("id AS i", f"{n}L AS n", "3L AS rank", "1L AS epoch")
    assert sorted(r.x for r in permuted(rows, "i", "n", "rank", "epoch", "x").collect()) == list(range(n))


def test_language(spark, sf, odd, none):
    from strata.llm.language import Segmenter, identify

    langs = {r.doc_id: r.lang for r in llm.table(spark, sf, "documents").collect()}
    rows = llm.QUERIES["op6_language"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    file = llm.vocabulary("piece_bpe_32k.model")
    got = {r.doc_id: r for r in identify(odd, file).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 11)] == ["und"] * 4 and got[8].lang_pred in ("en", "de") and got[5].shard == "own5"
    assert identify(none, file).collect() == []
    assert {r.lang_pred for r in identify(odd.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang"), file).collect()} == {"und"}

    pieces = {"▁a": 2, "a": 3, "ab": 4, "b": 5, "▁ab": 6, "▁": 7}
    p = np.array([[0], [1e-8], [0.1], [0.2], [0.05], [0.3], [0.07], [0.25]])

    def total(word):  # every segmentation, by recursion
        return 1.0 if not word else sum((p[pieces[word[:k]], 0] if word[:k] in pieces else 1e-8 if k == 1 else 0) * total(word[k:]) for k in range(1, len(word) + 1))

    names = ["ab", "aab", "b", "abab", "axb"]
    assert np.allclose(Segmenter(pieces, p).scores(names)[:, 0], [np.log(total("▁" + w)) for w in names])


def test_language_groups(spark, sf, monkeypatch):
    from strata.llm import language

    documents, file = llm.table(spark, sf, "documents").select("doc_id", "text", "lang"), llm.vocabulary("piece_bpe_32k.model")
    whole = {r.doc_id: r for r in language.identify(documents, file).collect()}
    monkeypatch.setattr(language, "LANGUAGES", 1)
    grouped = language.identify(documents, file).collect()
    assert len({r.lang_pred for r in grouped} - {"und"}) == 4
    assert all(r.lang_pred == whole[r.doc_id].lang_pred and abs(r.score - whole[r.doc_id].score) < 1e-9 for r in grouped)


def test_words_are_whole():
    from strata.llm import language

    assert language.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and language.words_of("x²") == ["x²"] and language.words_of("² 12 ा") == []
    assert language.words_of("ab" * 40) == ["ab" * 40]
    pieces = {"▁a": 2, "a": 3, "ab": 4, "b": 5, "▁ab": 6, "▁": 7}
    p = np.array([[0, 0], [1e-8, 1e-8], [0.1, 0.2], [0.2, 0.1], [0.05, 0.3], [0.3, 0.05], [0.07, 0.1], [0.25, 0.2]])
    model, whole = language.Segmenter(pieces, p), language.Segmenter(pieces, p)
    for word in ("ab" * 20, "abb" * 12 + "x", "a" * 30):  # short enough to be summed without scaling
        lattice = whole.lattice(["▁" + word], len(word) + 1)
        assert np.allclose(model.scores([word])[0], np.log(whole.forward(lattice, 1, len(word) + 1)[-1, 0]))
        sums, one = np.zeros(8), language.Segmenter(pieces, p[:, :1])
        one.long_expected("▁" + word[:20], 2.0, sums)
        assert np.allclose(sums, one.expected([word[:20]], np.array([2.0])))
    assert np.isfinite(model.scores(["x" * 5000])).all() and np.isfinite(model.scores(["ab" * 5000])).all()


def shingles(text):
    w = words(None if text is None else text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(documents):
    sets = {i: shingles(t) for i, t in documents.items()}
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in by_shingle[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates(spark, sf, odd, none, monkeypatch):
    from strata.llm import near

    documents = {r.doc_id: r.text for r in llm.table(spark, sf, "documents").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in llm.QUERIES["op7_minhash_forest"](spark, sf).collect()} == brute_groups(documents)
    got = near.near_groups(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == brute_groups(dict(enumerate(TEXTS)))
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    assert near.near_groups(none).collect() == []
    # a crowd: many near copies of one text and chains of edits, with blocks so small that all are divided
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    crowd = {}
    for i in range(150):
        text = list(base)
        for at in rng.choice(120, rng.integers(0, 8), replace=False):
            text[at] = f"e{i}x{at}"
        crowd[i] = " ".join(text)
    monkeypatch.setattr(near, "REGION", 16)
    monkeypatch.setattr(near, "WEIGHT", 2000)
    frame = spark.createDataFrame(list(crowd.items()), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in near.near_groups(frame).collect()} == brute_groups(crowd)


def test_near_template_crowd(spark, monkeypatch):
    from strata.llm import near

    keep, most = near.stored, []

    def watched(frame, purpose, **options):
        table = keep(frame, purpose, **options)
        if purpose == "near-regions":
            most.append(max(r["count"] for r in table.groupBy("unit").count().collect()))
        return table

    monkeypatch.setattr(near, "stored", watched)
    monkeypatch.setattr(near, "REGION", 64)
    base = [f"w{i}" for i in range(1000)]
    crowd = [(i, " ".join(base[:i] + [f"e{i}"] + base[i + 1 :])) for i in range(600)]
    rows = near.near_groups(spark.createDataFrame(crowd, "doc_id long, text string")).collect()
    assert len(rows) == 600 and {(r.component_id, r.kept) for r in rows} == {(0, True), (0, False)}
    assert len(most) == 1 and most[0] <= 3 * near.REGION


def test_sorted_windows():
    """Windows of sorted keys: whole regions at every batch size, parted where the prefix is shortest, against a plain grouping."""
    import pyarrow as pa

    from strata.llm import near

    most = 8
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 3, (400, near.DEPTH)), np.tile([1, 1, 1, 2, 2], (60, 1))]).astype(">u4")
    keys = np.hstack([rng.integers(0, 2, (len(values), 1)).astype(np.uint8), np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)])
    rows = sorted((k.tobytes(), i.to_bytes(16, "big")) for i, k in enumerate(keys))
    head = 1 + 4 * near.PREFIX
    for size in (1, 7, 1000):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([n for _, n in part], pa.binary())], names=["key", "node"])
            for part in (rows[i : i + size] for i in range(0, len(rows), size))
        ]
        found = [tuple(r.values()) for b in near.windows(iter(batches), most) for r in b.to_pylist()]
        regions, units = {}, {}
        for region, unit, node in found:
            regions.setdefault(region, set()).add(node)
            units.setdefault(unit, set()).add((region, node))
        plain = {}
        for k, n in rows:
            plain.setdefault(k[:head], set()).add(n)
        edge = {rows[0][0][:head], rows[-1][0][:head]}
        assert sorted(map(sorted, regions.values())) == sorted(sorted(v) for k, v in plain.items() if len(v) > 1 or k in edge)
        assert len(found) == sum(map(len, regions.values()))  # every node once in its region
        assert all(len(u) <= most and len({r for r, _ in u}) == 1 for u in units.values())
        whole = [len({u for u, m in units.items() if (r, n) in m}) for r, m in regions.items() for n in m]
        assert set(whole) == {1}
    assert list(near.windows(iter([]), most)) == []
    assert near.parted(np.array([0, 5, 5, 3, 5, 4, 5, 5]), 4) == [0, 3, 7]  # rows 3 to 6, then the rest: as late as equal depths allow


def test_near_crowd_of_two_families(spark, monkeypatch):
    """One region with a large and several small families, parted everywhere: links across windows are found, work stays linear."""
    from strata.llm import near

    keep, rest = near.stored, []

    def watched(frame, purpose, **options):
        table = keep(frame, purpose, **options)
        if purpose == "near-rest":
            rest.append(table.count())
        return table

    monkeypatch.setattr(near, "stored", watched)
    monkeypatch.setattr(near, "REGION", 16)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    crowd = {i: " ".join(base[:a] + [f"e{i}"] + base[a + 1 :]) for i, a in enumerate(rng.integers(0, 200, 300))}
    for i in range(300, 340):  # near the threshold: a tail of other words of growing length
        crowd[i] = " ".join(base[: 200 - (i - 300)] + [f"t{k}" for k in range(i - 300)])
    got = {r.doc_id: tuple(r)[1:] for r in near.near_groups(spark.createDataFrame(list(crowd.items()), "doc_id long, text string")).collect()}
    assert got == brute_groups(crowd)
    assert rest[0] <= 4 * near.TREES * len(crowd)


def check_packing(rows, documents, ids):
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, own in zip(documents, ids):
        at = 0
        for r in sorted(by_document[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return 1 - sum(r.length for r in rows) / (2048 * len(by_sequence))


def test_packing(spark, sf, odd, none):
    from strata.llm.packing import pack_documents

    documents = {r.doc_id: r.text for r in llm.table(spark, sf, "documents").collect()}
    rows = llm.QUERIES["op8_pack_sequences"](spark, sf).collect()
    assert check_packing(rows, documents, ids_of("byte_bpe_50k.json", documents.values())) < 0.03
    file = llm.vocabulary("byte_bpe_50k.json")
    single = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packing(pack_documents(single, file).collect(), dict(enumerate(TEXTS)), ids_of("byte_bpe_50k.json", TEXTS))
    assert pack_documents(odd, file).select("doc_id").distinct().count() == len(TEXTS) + 1 and pack_documents(none, file).collect() == []


def test_differencing():
    from strata.llm.karmarkar import deal
    from strata.llm.packing import windows_of

    rng = np.random.default_rng(3)
    for n, k in ((0, 3), (1, 3), (5, 3), (200, 40), (300, 7)):
        weights = rng.integers(1, 512, n)
        sums = np.bincount(deal(weights, k), weights, k)
        assert sums.sum() == weights.sum() and (n < 200 or sums.max() - sums.min() < 60)
        assert np.bincount(windows_of(weights, 2048), weights, 1).max(initial=0) <= 2048
    assert sorted(np.bincount(deal(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


def test_main_text(spark, sf):
    import html

    from strata.llm.htmltext import extract, main_text

    for r, page in zip(llm.QUERIES["op9_main_text"](spark, sf).orderBy("page_id").collect(), llm.table(spark, sf, "pages").orderBy("page_id").collect()):
        article = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        article = re.sub(r"</?b>", "", re.sub(r"</?(?:h1|p|br)>", " ", article))
        assert r.text == re.sub(r"\s+", " ", html.unescape(article)).strip() and r.n_chars == len(r.text)
    assert main_text(None) == main_text("") == main_text("<nav>x</nav><script>var a='<p>no</p>'</script>") == ""
    page = "<header>site</header><div id=content><h2>Title</h2><p>Long &amp; plain\n text of the page, with words.<p>Another paragraph</div><div class='sidebar'>side</div><section id=comments>said</section><form>f<input></form>"
    assert main_text(page) == "Title Long & plain text of the page, with words. Another paragraph"
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "plain", "t"), (2, "u", "<p>" + "word " * 50_000, "t")], "page_id long, url string, html string, text string")
    assert {r.page_id: r.n_chars for r in extract(odd).collect()} == {1: 0, None: 5, 2: 249_999}
    assert extract(odd.where("false")).collect() == []


def test_main_text_in_frames():
    from strata.llm.htmltext import main_text

    long = "A long sentence of the main text with many words. " * 4
    text = long.strip()
    for page in (
        f'<div class="layout has-sidebar"><article><p>{long}</p></article></div>', f'<div class="header-fixed"><p>{long}</p></div>', f'<div class="no-comments"><p>{long}</p></div>',
        f'<div class="layout sidebar"><article><p>{long}</p></article></div>', f"<body><form><div><p>{long}</p></div></form></body>", f"<form><article><p>{long}</p></article></form>",
        f"<body><nav><a>menu</a><article><p>{long}</p></article></body>", f"<body><div class=ad>Ad<article><p>{long}</p></article></body>", f"<main><nav><a>menu</a><article><p>{long}</p></article></main>",
        f"<html><head><title>t</title><body><p>{long}</body>", f"<main><p>{long}</p></main><aside><article>teaser</article></aside>",
        f"<main><p>{long}</p><section class=comments><article>{long * 3}</article></section></main>", f"<div><p>{long}</p></div><footer>{long * 3}</footer>",
    ):
        assert main_text(page) == text, page
    page = f'<p>{long}</p><section id="discussion"><h2>Discussion</h2><p>{long}</p></section><h2 id="related-work">Related</h2><p>few</p><h2 id="search">Search</h2>'
    assert main_text(f"<article>{page}</article>") == main_text(f"<div>{page}</div>") == f"{text} Discussion {text} Related few Search"
    assert main_text(f"<main><nav>menu<article><p>{long}</p></article><p>tail</p></main>") == f"{text} tail"
    assert main_text(f"<article><p>{long}<span class=ad>buy</span> more</p></article>") == f"{text} more"


def test_main_text_region():
    from strata.llm.htmltext import main_text

    assert main_text(f"<body><div>{'x' * 120}</div><article><h1>Title</h1><p>Short text here.</p></article></body>") == "Title Short text here."
    assert main_text(f"<div>{'x' * 120}</div><article> </article>") == "x" * 120
    first, second = "lead " * 16, "body " * 184
    assert main_text(f"<body><section><p>{first}</p></section><section><p>{second}</p></section></body>") == f"{first}{second}".strip()
    page = "".join(f"<section><p>{'word ' * 40}</p></section>" for _ in range(12))
    assert main_text(f"<body>{page}<section><p>end</p></section></body>") == ("word " * 480 + "end")
    for n in range(1, 60):  # equal ratios, whose mean may be rounded up
        for size in (7, 49, 510):
            assert main_text("<div></div>" + f"<p>{'y' * size}</p>" * n + "<div></div>") == " ".join(["y" * size] * n)


def test_exact(spark, odd, none):
    from strata.llm.exact import deduplicate

    def expected(rows):
        groups = {}
        for i, t in rows:
            groups.setdefault((t or "").translate({c: c + 32 for c in range(65, 91)}), []).append(i)
        return groups

    hot = [(i, "same TEXT" if i % 3 else f"text {i}") for i in range(900)]
    for frame, rows, size in ((odd, [(r.doc_id, r.text) for r in odd.collect()], {}), (spark.createDataFrame(hot, "doc_id long, text string").repartition(7), hot, {"capacity": 16, "start": 1})):
        groups = expected(rows)
        got = deduplicate(frame, **size).collect()
        assert len(got) == len(rows)
        for r in got:
            own = groups[(r.text or "").translate({c: c + 32 for c in range(65, 91)})]
            assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
            assert not r.kept or r.doc_id == r.keep_id
        assert sum(r.kept for r in got) == len(groups)
    assert deduplicate(none).collect() == []


def test_directory_grows(spark, monkeypatch):
    """More rows give a deeper directory and buckets of the same size; a deep one is joined, not broadcast."""
    from pyspark.sql import functions as F
    from strata.llm import exact

    depths = []
    for n in (100, 10000):
        hashes = spark.range(n).select(F.xxhash64("id").alias("hash"))
        found, bits = exact.directory(hashes, 64, 2, n)
        depths.append(bits)
        cells = {r.cell: (r.depth, r.pages) for r in found.collect()}
        held = Counter()
        for r in hashes.collect():
            cell = (r.hash % 2**64) >> (64 - bits)
            held[cell >> (bits - cells[cell][0]), cells[cell][0]] += 1
        assert max(held.values()) <= 64 and {p for _, p in cells.values()} == {1}
        for bucket, depth in held:  # no bucket lies within another
            assert not any((bucket >> up, depth - up) in held for up in range(1, depth + 1))
    assert depths[0] == 6 and depths[1] == 12
    monkeypatch.setattr(exact, "BROADCAST", 0)
    rows = spark.createDataFrame([(i, f"t{i % 40}" if i % 2 else "copy") for i in range(400)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.deduplicate(rows, capacity=8, start=1).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.text, []).append(r.doc_id)
    assert got == {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_pipeline_keeps_uncertain_languages(spark, sf, monkeypatch):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = llm.table(spark, sf, "documents").limit(6)
    monkeypatch.setattr(corpus_pipeline, "identify", lambda d, v: d.withColumn("lang_pred", F.when(F.col("text").isNotNull(), "en").otherwise("und")).withColumn("score", F.lit(0.3)))
    assert corpus_pipeline.language(spark, docs, sf).count() == docs.where("text IS NOT NULL").count() > 0


def test_pipeline(spark, sf, tmp_path):
    """Every stage on its own input: what it keeps, against a brute-force version."""
    import corpus_pipeline

    documents = llm.table(spark, sf, "documents")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 !", None, None, None)], documents.schema)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact", "near", "mix", "pack"]
    known = stages["language"](spark, documents.unionByName(odd), sf).collect()
    assert {r.doc_id for r in known} == {r.doc_id for r in documents.collect()}
    unique = stages["exact"](spark, documents, sf)
    assert unique.columns == documents.columns and unique.count() == len({(r.text or "").lower() for r in documents.collect()})
    kept = stages["near"](spark, documents, sf)
    groups = brute_groups({r.doc_id: r.text for r in documents.collect()})
    assert {r.doc_id for r in kept.collect()} == {i for i, g in groups.items() if g[2]}
    assert stages["mix"](spark, documents, sf).columns == documents.columns
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_sql(spark, sf, name):
    import check

    assert check.difference(spark, check.database(sf), sf, llm.QUERIES[name], llm.ORACLE[name]) is None
