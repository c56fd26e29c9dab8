"""Fill-in-the-middle, the prefix trie and the quality classifier against brute force and on hand-made rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strata.llm import infill, prefixtrie, quality
from strata.llm import queries as llm

TEXTS = [None, "", " \t\n", "One two3 four  five!", "a<P>b c", "ab <S>", "x<M>", "<", "ÄÖß é𝔘 one", "wort " * 4000, "x" * 9000, "日本語 text 🙂", "a", "!!!"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, empty and long texts, columns with clashing names."""
    rows = [(i, t, f"form{i}", None, i) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, "One two", "null id", None, None), (None, None, None, None, None)] + [(100 + i, "Some text, to be cut somewhere " * 3, None, "o", i) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, output string, _text long")


def expected_infill(key, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    one, two, plain, order = (int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or plain % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, len(units))))
    if order % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [1, 7, infill.BLOCK])
def test_infill(spark, odd, block):
    made = infill.fill_in_middle(odd, block=block)
    assert made.columns == ["doc_id", "text", "_text", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("back", infill.restored(made.output, made.form)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected_infill(r.doc_id, r.text or "")
        assert r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(odd.where("false")).collect() == []


def test_unit_tree_finds_every_unit():
    text = "ab, cd" * 7 + "ZzKK" + "é" * 5
    starts = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    for block in (1, 2, 3, 5, 8, 64):
        tree = infill.UnitTree(text, block)
        assert tree.n == len(starts)
        assert [tree.place(k) for k in range(tree.n + 2)] == starts + [len(text)] * 2


def expected_trie(rows):
    """Nodes by brute force: (conv_id, depth, parent, members, children, leaves, saved, hash of ends)."""

    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path) == d))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        parts = [below(c) for c in children[p]]
        count = len(re.findall(rb"[^\x20\x09-\x0d]+", p[-1][1].encode())) if p else 0
        return sum(x for x, _ in parts) or 1, (len(members[p]) - 1) * count + sum(y for _, y in parts)

    return sorted(
        (min(members[p])[0], len(p), min(members[p[:-1]])[0] if p else -1, len(members[p]), len(children[p]), *below(p),
         hashlib.sha256(",".join(map(str, sorted(c for c, e in members[p] if e))).encode()).hexdigest())
        for p in members
    )


def trie_rows(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert frame.columns == names
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


@pytest.fixture(scope="module")
def conversations():
    """Hot first turns, equal conversations, a long one, borrowed turns, turnless results, nulls, ties, repeats."""
    rng = np.random.default_rng(5)
    rows = []
    for c in range(300):
        turns = int(rng.integers(1, 6))
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "hot turn" if t == 0 else f"say {rng.integers(0, 3)} {'x ' * (t % 3)}") for t in range(turns)]
    rows += [(c, t, "user", "equal words here") for c in range(1000, 1080) for t in range(3)]
    rows += [(2000, t, "user", f"long {t % 5}") for t in range(400)] + [(2001, t, "user", f"long {t % 5}") for t in range(390)]
    rows += [(4001, 0, "user", "alone")] + [(c, 0, None, None) for c in range(5001, 5008)]
    rows += [(6000, None, "user", "b"), (6000, None, "user", "a"), (6000, 1, "", "a"), (6000, 1, "a", ""), (6000, 1, "a", ""), (None, 1, "user", "none"), (-7, 0, "user", "below")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_turns, trie_bytes", [(1, 1 << 20), (40, 1 << 20), (40, 0), (10**6, 1 << 20)])
def test_prefix_trie(spark, conversations, shard_turns, trie_bytes):
    frame = spark.createDataFrame([(*r, "x", 1) for r in conversations], SCHEMA + ", path string, shard int")
    got = trie_rows(prefixtrie.prefix_trie(frame, shard_turns, 60, trie_bytes))
    assert got == expected_trie(conversations)


def test_prefix_trie_without_conversations(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    alone = trie_rows(prefixtrie.prefix_trie(spark.createDataFrame([(4001, 0, "user", "alone")], SCHEMA)))
    assert alone == expected_trie([(4001, 0, "user", "alone")])


def test_prefix_trie_of_the_table(spark, sf):
    rows = [tuple(r) for r in llm.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(prefixtrie.prefix_trie(llm.table(spark, sf, "conversations"), 30)) == expected_trie(rows)


def grams(text):
    found = re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[!-/:-@\[-`{-~\x7f]+", text)
    return found, list(zip(found, found[1:]))


@pytest.mark.parametrize("text", ["", "  ", "one two, two!! 33 one two", "é é? 日本 x1y", "a" * 50])
def test_features_count_words_and_pairs(text):
    places, values = quality.features(text)
    singles, pairs = grams(text)
    assert len(places) == len(set(singles)) + len(set(pairs))  # no two of so few share a place
    if singles:
        counts = sorted([singles.count(s) for s in set(singles)] + [pairs.count(p) for p in set(pairs)])
        assert np.allclose(sorted(values), np.sqrt(counts) / np.sqrt(sum(counts)))


def test_features_of_a_long_text_by_chunks(monkeypatch):
    text = "some words, 12 and\nmore!! " * 200
    whole = quality.features(text)
    monkeypatch.setattr(quality, "CHUNK", 100)
    parts = quality.features(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])
    assert len(quality.features("x" * 1000)[0])


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    good = labels.sum()
    return (rank[labels == 1].sum() - good * (good + 1) / 2) / (good * (len(labels) - good))


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in llm.QUERIES["op13_quality"](spark, folder).collect()}
    documents = llm.table(spark, folder, "documents")
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in rows.items())
    labels = llm.table(spark, folder, "labels")
    known = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    scores, marks = map(np.array, zip(*known))
    assert auc(scores, marks) > 0.95
    assert ((scores >= 0.7) == marks).mean() > 0.9


def test_quality_learns_only_from_its_fold_and_stands_odd_rows(spark, odd):
    rows = [(i, "plain words of a text" if i % 2 else "BUY!! NOW!! $$$ text", 1) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    labels = [(i, i % 2) for i in range(400)] + [(3, 1), (None, 1), (5, None), (7, 9)]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(400)]
    flipped = [(i, 1 - q if i is not None and i < 400 and held[i] and q is not None else q) for i, q in labels]
    schema = "doc_id long, quality int"
    weights = quality.learn(documents, spark.createDataFrame(labels, schema))
    assert (weights == quality.learn(documents, spark.createDataFrame(flipped, schema))).all()
    scored = quality.score(documents, weights)
    assert scored.columns == ["doc_id", "text", "extra", "held_out", "score", "predicted"]
    assert all(r.predicted == r.doc_id % 2 for r in scored.collect())
    strange = quality.score(odd.withColumnRenamed("form", "score"), weights).collect()
    assert len(strange) == odd.count()
    assert len({r.score for r in strange if not (r.text or "").strip()}) == 1
    assert quality.score(odd.where("false"), weights).collect() == []
    nothing = quality.learn(documents, spark.createDataFrame([], schema))
    assert not nothing.any() and {r.score for r in quality.score(documents, nothing).collect()} == {0.5}


def test_a_learner_follows_the_gradient():
    learner = quality.Learner(np.zeros(3), np.zeros(3))
    for _ in range(200):
        learner.update(np.array([0]), np.array([1.0]), 1.0)
        learner.update(np.array([1]), np.array([1.0]), 0.0)
    weights = learner.weights(np.arange(3))
    assert weights[0] > 1 > -1 > weights[1]
    rare = quality.Learner(np.array([quality.L1 / 2, 0.0]), np.zeros(2))
    assert rare.weights(np.array([0]))[0] == 0  # small evidence leaves a weight at 0


def test_a_rule_without_path_fits_whole_labels_only(spark):
    from strata.llm.urls import judge

    pages = spark.createDataFrame([(1, "http://orgx/a"), (2, "http://org/a"), (3, "http://a.org"), (4, "http://a.orgx.com/")], "page_id long, url string")
    rules = spark.createDataFrame([("org", "", "block"), ("x.org", "", "allow"), ("orgx.com", "", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge(pages, rules, salts=2).collect()}
    assert got == {1: (None, "allow"), 2: ("org", "block"), 3: ("org", "block"), 4: ("orgx.com", "block")}


def test_columns_with_the_operators_own_names(spark):
    from strata.llm.exact import deduplicate
    from strata.llm.packing import pack

    names = ["cell", "depth", "pages", "_hash", "_text", "_bucket", "in_0"]
    rows = [(i, "AB"[i % 2] * 3 if i % 3 else None, *[f"{n}{i}" for n in names]) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = deduplicate(frame, capacity=2, start=1)
    assert found.columns == [*frame.columns, "keep_id", "group_size", "kept", "text_sha256"]
    for r in found.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names) and r.keep_id >= r.doc_id and r.kept == (r.keep_id == r.doc_id)
    pieces = spark.createDataFrame([(i, 1 + i % 7, f"b{i}", i) for i in range(50)] + [(99, 8, "full", 0)], "doc_id long, length long, _batch string, _window long")
    packed = pack(pieces, capacity=8, batch=10)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    held = defaultdict(int)
    for r in packed.collect():
        assert r["_batch"] == ("full" if r.doc_id == 99 else f"b{r.doc_id}")
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 8 and sorted(held) == list(range(len(held)))


def test_special_tokens_are_those_of_the_library():
    from strata.llm.tokens import Encoder

    for file in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = llm.vocabulary(file)
        for as_text in (False, True):
            encoder = Encoder(path, as_text)
            texts = ["a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "plain, it's DON'T", " x  y\n\nz \n w\n", "", None, "\tß ÀB!! ~", "word word, word."]
            want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
            assert encoder.encode(texts) == want == encoder.encode(texts)
            assert (np.frombuffer(want[1], "<u4").size == 1) == (not as_text)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_word_is_learned_once_whatever_marks_follow(file, monkeypatch):
    from strata.llm.tokens import Encoder

    encoder, learned = Encoder(llm.vocabulary(file)), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new, *rest: learned.append(len(new)) or learn(new, *rest))
    words, marks = [f"qu{a}x{b}ö" for a in "bcdfg" for b in "klmnp"], [".", ",", "!?", ")", ""]
    texts = ["so " + " ".join(w + m for w in words for m in marks), "\n".join(f"so {w}" for w in words)]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want == encoder.encode(texts)
    assert sum(learned) <= len(words) + 5


def test_zero_characters_and_odd_white_space_are_encoded_as_they_stand():
    from strata.llm.tokens import Encoder

    texts = ["a \0b", "\0a b", "\0", "\0\0x y.", "a\n\0b c", "\1a \1b", "\nab", "a\x85\u2028b c", "x \xa0y z", "ab\x1c\x1d c d.", "née, à l'été 12 中文 ok", " ", "  ", "\n", "a ", None]
    for file in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = Encoder(llm.vocabulary(file))
        want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.encode(texts) == want == [encoder.encode([t])[0] for t in texts] and encoder.encode([]) == []


def test_a_memory_is_bounded_and_keeps_what_is_used(monkeypatch):
    from strata.llm import tokens
    from strata.llm.held import Memory, held

    memory = Memory(1000)
    for k in range(100):
        assert not memory.missing({"common"}) or k == 0
        fresh = {"common"} if k == 0 else set()
        memory.add({w: w for w in fresh | {f"w{k}"}}, 100)
        assert len(memory.newer) + len(memory.older) <= 14
    monkeypatch.setattr(tokens, "REMEMBERED", 4000)
    encoder = tokens.Encoder(llm.vocabulary("byte_bpe_50k.json"))
    texts = [f"some w{k}rd and{k} more, {'x' * 70}{k}" for k in range(300)]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode([t])[0] for t in texts] == want and encoder.encode(texts) == want
    assert held("one", list) is held("one", list) and held("two", dict) == {}
