"""The training-text operators against brute force, round trips and their stated cases."""

import itertools
import math
import random
import time
import re
import glob
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowdex.llm import chat, crf, decontaminate, licences, pieces, ppm, pseudonyms, rules, simhash, tokencache
from sparrowdex.llm import queries as registry
from sparrowdex.llm._text import HashIndex, chunks, hash_word, utf8, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, score double, gone boolean, u long, key long"
WORDS = [a + b for a in ("ka", "mo", "ti", "ru", "le", "sa", "no", "vi") for b in ("len", "dar", "pix", "mon", "tas", "rim", "gul", "bek")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", None, None, 1, 0.5, True, 7, 8) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names."""
    rows = [
        (None, None, None, None, None, None, None, None, None, None),
        (1, None, None, None, None, None, None, None, None, None),
        (None, "nameless text of some words", None, None, None, None, None, None, None, None),
        (2, "", "en", "s", 0, 1, 1.0, False, 1, 1),
        (3, "   \n\n  ", "en", "s", 0, 1, 1.0, False, 1, 1),
        (4, "lomo " * 60_000, "en", "s", 0, 1, 1.0, False, 1, 1),
        (5, "x" * 200_000, "en", "s", 0, 1, 1.0, False, 1, 1),
        (6, "tie one two three four five six seven eight nine", "en", "s", 0, 1, 1.0, False, 1, 1),
        (6, "tie one two three four five six seven eight nine", "en", "s", 0, 1, 1.0, False, 1, 1),
        (7, "tie one two three four five six seven eight nine", "en", "s", 0, 1, 1.0, False, 1, 1),
        (8, "日本語 😀 ▁ \x00 é é\r\nline", "en", "s", 0, 1, 1.0, False, 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# text helpers


def test_words_match_a_regular_expression():
    texts = ["Ab cd-EF 12", "", "ÉÀ é", None, "x", "a\nb"]
    data, off = utf8(pa.array(texts))
    hashed, row, start, end = words(data, off)
    want = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t or "")]
    assert [(r, bytes(data[s:e]).decode()) for r, s, e in zip(row, start, end)] == want
    assert [int(h) for h in hashed] == [hash_word(w.lower()) for _, w in want]


def test_hash_index_finds_all_and_only_its_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 5000).astype(np.uint64))
    found = HashIndex(keys).find(np.concatenate([keys, keys + np.uint64(1)]))
    assert (found[: len(keys)] == np.arange(len(keys))).all()
    assert (found[len(keys) :][~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert list(HashIndex(keys[:0]).find(keys[:2])) == [-1, -1]


def test_chunks_cover_every_row_once():
    assert list(chunks(np.array([3, 3, 10, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(chunks(np.zeros(0, int))) == []


# 1: chat formatting


def chats(spark, turns):
    return spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, valid string, seg int")


def test_chat_segments_and_losses(spark):
    t = [(1, 1, "assistant", "yes", "", 1), (1, 0, " User ", "hi", "", 1), (2, 0, "assistant", "no", "", 1), (3, 0, "user", "x", "", 1), (4, 0, None, "x", "", 1), (5, None, "user", "x", "", 1), (None, 0, "user", "x", "", 1), (1, 0, " User ", "hi", "", 1)]
    got = rows(chat.format_chats(chats(spark, t)))
    one = [r for r in got if r[0] == 1]
    assert [(r[1], r[4], r[5]) for r in one] == [(0, "<|user|>\n", 0), (1, "hi", 0), (2, "<|end|>\n", 0), (3, "<|assistant|>\n", 0), (4, "yes", 1), (5, "<|end|>\n", 1)]
    assert {(r[0], r[6], r[7]) for r in got if r[0] != 1} == {(2, False, 1), (3, False, 2), (4, False, 1), (5, False, 1)}


def test_chat_null_text_and_empty_table(spark):
    got = rows(chat.format_chats(chats(spark, [(1, 0, "user", None, "", 1), (1, 1, "assistant", "a", "", 1)])))
    assert got[1][4] == ""
    assert rows(chat.format_chats(chats(spark, []))) == []


def test_chat_machine_has_states_beside_roles(spark):
    moves = {("start", "user"): "asked", ("asked", "tool"): "used", ("used", "assistant"): "done", ("asked", "assistant"): "done"}
    t = chat.Template({r: chat.Role(f"[{r}]", "", r == "assistant") for r in ("user", "tool", "assistant")}, moves, final=frozenset({"done"}))
    got = rows(chat.format_chats(chats(spark, [(1, 0, "user", "q", "", 1), (1, 1, "tool", "t", "", 1), (1, 2, "assistant", "a", "", 1), (2, 0, "user", "q", "", 1), (2, 1, "tool", "t", "", 1), (2, 2, "tool", "t", "", 1)]), t))
    assert {r[0] for r in got if r[6]} == {1} and [r[7] for r in got if r[0] == 2] == [3]


def test_long_conversations_are_cut_and_give_the_same(spark):
    rng, turns = random.Random(21), []
    for conv in range(40):
        role = "system" if rng.random() < 0.3 else "user"
        for k in range(rng.randint(1, 30)):
            turns.append((conv, k, role if rng.random() > 0.02 else rng.choice(["user", "assistant", "tool", None]), rng.choice(["a", "b", None]), "", 1))
            role = "assistant" if role == "user" else "user"
        if conv % 2:
            turns.append((conv, rng.randint(0, 30), "user", "tied", "", 1))
        turns += turns[-2:]
    turns.append((3, None, "user", "no place", "", 1))
    c = chats(spark, turns)
    want = rows(chat.format_chats(c))
    for most in (1, 2, 3, 7):
        assert rows(chat.format_chats(c, most=most)) == want
    assert {r[6] for r in want} == {True, False}


# 2: decontamination


def test_block_max_wand_equals_brute_force():
    rng = random.Random(3)
    items = [(k, prose(rng, rng.randint(5, 60))) for k in range(60)] + [(99, "same words here for a tie of items"), (98, "same words here for a tie of items")]
    size = sum(len(t.split()) for _, t in items)
    index = decontaminate.Index(items, len(items), size / len(items))
    found = 0
    for _ in range(400):
        own = index.post_term[index.post_item == rng.randrange(len(items))]
        terms = np.unique(np.array(rng.sample(list(own), rng.randint(1, len(own))) + [rng.randrange(len(index.most)) for _ in range(15)]))
        want = np.zeros(len(items))
        at = np.isin(index.post_term, terms)
        np.add.at(want, index.post_item[at], index.weight[at])
        got = dict(index.search(terms))
        assert sorted(got) == np.flatnonzero(want >= 1 - 1e-9).tolist()
        assert all(math.isclose(got[k], want[k]) for k in got)
        found += len(got)
    assert found > 100


def test_leaks_are_found_and_clean_documents_are_not(spark, awkward, nothing):
    rng = random.Random(4)
    items = [(k, f"{prose(rng, 20)}. {prose(rng, 9)}.") for k in range(30)]
    bench = spark.createDataFrame([*items, (None, "no id at all here"), (77, None), (78, "too short"), (0, items[0][1])], "item_id long, text string")
    texts = [prose(rng, 300) for _ in range(20)] + [f"{prose(rng, rng.randint(0, 400))} {t.upper()} {prose(rng, 50)}" for _, t in items]
    docs = docs_of(spark, texts)
    got = rows(decontaminate.leaks(docs, bench))
    assert [(r[0], r[1]) for r in got] == sorted(((20 + k, k) for k in range(30)), key=str)
    assert rows(decontaminate.leaks(docs, bench, shard_words=200).select("doc_id", "item_id")) == [(r[0], r[1]) for r in got]
    assert rows(decontaminate.leaks(awkward, bench)) == [] and rows(decontaminate.leaks(nothing, bench)) == []
    assert rows(decontaminate.leaks(docs, bench.limit(0))) == []


def test_short_items_count_where_their_words_stand_in_a_row(spark):
    bench = spark.createDataFrame([(1, "Too short!"), (2, "yes"), (3, "?!"), (4, "too short")], "item_id long, text string")
    docs = docs_of(spark, ["it is too, short for me", "short too", "Yes", None, "too", "yesterday"])
    assert rows(decontaminate.leaks(docs, bench)) == [(0, 1, 1.0, 1.0, 1.0), (0, 4, 1.0, 1.0, 1.0), (2, 2, 1.0, 1.0, 1.0)]
    longer = bench.union(spark.createDataFrame([(5, "alpha beta gamma delta epsilon zeta eta theta")], bench.schema))
    docs = docs_of(spark, ["say yes to alpha beta gamma delta epsilon zeta eta theta"])
    assert [r[:2] for r in rows(decontaminate.leaks(docs, longer))] == [(0, 2), (0, 5)]


def test_a_large_benchmark_makes_several_passes(spark):
    rng = random.Random(14)
    bench = spark.createDataFrame([(k, prose(rng, 20)) for k in range(12)] + [(50, "just two")], "item_id long, text string")
    texts = [r["text"] for r in bench.collect()]
    docs = docs_of(spark, [prose(rng, 30) + " " + t + " " + prose(rng, 5) for t in texts])
    assert rows(decontaminate.leaks(docs, bench, shard_words=60)) == rows(decontaminate.leaks(docs, bench)) != []


def test_passage_scores_equal_brute_force():
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randint(8, 30))) for k in range(25)]
    index = decontaminate.Index(items, 25, sum(len(t.split()) for _, t in items) / 25)
    text = " ".join([prose(rng, 40), items[3][1], prose(rng, 10), " ".join(items[7][1].split()[2:]), prose(rng, 60)])
    hashed, row, _, _ = words(*utf8(pa.array([text])))
    got = {(r, i): (s, q, a) for r, i, s, q, a in index.matches(hashed, row, 1)}
    want = {}
    for _, first, end in zip(*index.passages(np.array([len(hashed)]))):
        known = np.unique(index.terms.find(hashed[first:end]))
        for i in range(25):
            s = index.weight[(index.post_item == i) & np.isin(index.post_term, known)].sum()
            q, a = index._overlaps(i, hashed[max(0, first - index.window) : end + index.window])
            if s >= 1 - 1e-9 and q >= decontaminate.QUESTION and a >= decontaminate.ANSWER:
                item = int(index.item_id[i])
                want[0, item] = max(want.get((0, item), 0), s * index.share)
    assert got.keys() == want.keys() and len(want) == 2
    assert all(math.isclose(got[k][0], want[k]) for k in want)


# 3: quality rules


def junk(rng, n):
    return " ".join(w.upper() + "!!" for w in prose(rng, n).split())


def test_rules_separate_held_out_documents(spark):
    rng = random.Random(6)
    texts = [junk(rng, rng.randint(5, 200)) if k % 4 == 0 else prose(rng, rng.randint(5, 200)) for k in range(600)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(400)] + [(0, 0, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in rules.judge(docs, labels).collect()}
    right = sum(got[k] == (k % 4 != 0) for k in range(400, 600))
    assert right >= 196 and all(got[k] for k in range(400, 600) if k % 4)


def test_rules_statistics_equal_plain_python(spark):
    texts = ["Ab CD #1 |x| !!", "", "a a a b", "l\nl\nm"]
    got = rules.judge(docs_of(spark, texts), spark.createDataFrame([], "doc_id long, quality int")).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        n = len(t)
        assert (r["chars"], r["words"]) == (n, len(t.split()))
        assert r["upper"] == round(sum(c.isupper() for c in t) / n, 6) if n else r["upper"] == 0
        lines = t.split("\n")
        assert r["repeated"] == round(1 - len(set(lines)) / len(lines), 6)
        assert r["keep"] and r["rule"] is None
    assert got[2]["echo"] == 0.5


def test_rule_expression_is_ordered_and_equals_the_list():
    rng = np.random.default_rng(0)
    x = rng.random((900, len(rules.STATS)))
    bad = (x[:, 2] > 0.8) | ((x[:, 4] > 0.7) & (x[:, 5] < 0.3))
    learned = rules.learn(x, bad, np.arange(900) % 3 == 0)
    said = np.zeros(900, bool)
    for r in learned:
        said |= rules.covers(r, x)
    assert (said == bad).mean() > 0.97
    assert rules.learn(x, np.zeros(900, bool), np.arange(900) % 3 == 0) == []


def test_rules_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(2, 0, 0)], "doc_id long, quality int, toxic int")
    assert rules.judge(awkward, labels).count() == 11
    assert rules.judge(nothing, labels).count() == 0
    # contradicting labels count as good, repeated ones once, and documents alike in all statistics can't be told apart
    docs = docs_of(spark, ["same words here"] * 12)
    both = spark.createDataFrame([(k, q, 0) for k in range(12) for q in ((0, 1) if k < 6 else (k % 2,))], "doc_id long, quality int, toxic int")
    assert rules.judge(docs, both).where("keep").count() == 12 and rules.fit(docs, both) == []


# 4: token counts


def test_token_counts_and_cache(spark, awkward, nothing, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    got = rows(tokencache.token_counts(awkward, cache))
    assert len(got) == 11
    plain = {r["text"] for r in awkward.collect() if r["text"] is not None}
    norm = lambda t: re.sub(r"\s+\Z", "", re.sub("\r\n?", "\n", t))
    counts = {r["digest"]: r["n_tokens"] for r in tokencache.token_counts(awkward, cache).collect()}
    assert sorted(v for k, v in counts.items() if k) == sorted(tokencache.count_text(norm(t)) for t in {norm(t) for t in plain})
    assert counts[None] is None
    files = sorted(glob.glob(f"{cache}/**/*.parquet", recursive=True))
    before = spark.read.parquet(cache).count()
    assert before == len({norm(t) for t in plain})
    monkeypatch.setattr(tokencache, "_counter", None)  # nothing is encoded again
    assert rows(tokencache.token_counts(awkward, cache)) == got
    assert sorted(glob.glob(f"{cache}/**/*.parquet", recursive=True)) == files
    assert tokencache.token_counts(nothing, cache).count() == 0


def test_token_cache_appends_only_misses_and_knows_versions(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    tokencache.token_counts(docs_of(spark, ["one two", "three"]), cache).count()
    got = rows(tokencache.token_counts(docs_of(spark, ["one two  ", "four five", "four five"]), cache).select("doc_id", "n_tokens"))
    assert got == [(0, 2), (1, 2), (2, 2)]
    assert spark.read.parquet(cache).count() == 3
    calls = []
    plain = tokencache._encoding(tokencache.VOCABULARY, tokencache.PATTERN)
    for bound in (200_000, 0):  # encoded where it is read, or after a shuffle
        monkeypatch.setattr(tokencache, "BROADCAST_DIGESTS", bound)
        at, texts = str(tmp_path / f"cache-{bound}"), ["one", "two two", "one", "three", "", "two two\r\n"]
        tokencache.token_counts(docs_of(spark, texts[:1]), at).count()
        got = tokencache.token_counts(docs_of(spark, texts), at).collect()
        calls.append(sorted(tuple(r) for r in got))
        assert [r["n_tokens"] for r in sorted(got)] == [len(plain.encode_ordinary(x.rstrip())) for x in texts]
        assert spark.read.parquet(at).count() == 4
    assert calls[0] == calls[1]
    tokencache.token_counts(docs_of(spark, ["one two"]), cache, pattern=r"\S+|\s+").count()
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


# 5: prediction by partial matching


def levels(texts, order):
    paths = ppm._paths(*utf8(pa.array(texts)), order)
    return [ppm._runs(paths & ((1 << (8 * (k + 1))) - 1)) for k in range(order + 1)]


@pytest.mark.parametrize("order", [0, 2, 4])
def test_trie_lookups_equal_plain_trie(order):
    rng = random.Random(8)
    train, test = [prose(rng, 60) for _ in range(20)], [prose(rng, 20), "ünknown \x00 bytes", "", "k"]
    model, trie = ppm.Model(levels(train, order)), ppm.Trie(order)
    for t in train:
        b = bytes(order) + t.encode()
        for k in range(order, len(b)):
            trie.add(b[k - order : k], b[k])
    for t in test:
        b = bytes(order) + t.encode()
        want = sum(trie.bits(b[k - order : k], b[k]) for k in range(order, len(b)))
        assert math.isclose(model.bits(ppm._paths(*utf8(pa.array([t])), order)).sum(), want, abs_tol=1e-9)


def test_scores_use_the_other_half(spark, awkward, nothing):
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(40)]
    docs = docs_of(spark, texts)
    half = ppm._half(pa.array(range(40)))
    tries = [ppm.Trie(), ppm.Trie()]
    for t, h in zip(texts, half):
        b = bytes(4) + t.encode()
        for k in range(4, len(b)):
            tries[h].add(b[k - 4 : k], b[k])
    for r in ppm.score(docs).collect():
        b = bytes(4) + texts[r["doc_id"]].encode()
        want = sum(tries[1 - half[r["doc_id"]]].bits(b[k - 4 : k], b[k]) for k in range(4, len(b)))
        assert abs(r["bits"] - want) < 0.01
    got = {str(r["doc_id"]): r for r in ppm.score(awkward).collect()}
    assert got["1"]["bits"] == 0 and got["1"]["bits_per_byte"] is None and len(ppm.score(awkward).collect()) == 11
    assert ppm.score(nothing).count() == 0


def test_node_bound_keeps_the_most_frequent(spark):
    docs = docs_of(spark, ["abababab" * 20 + "xyz"] * 8)
    folder = ppm.train(docs, 2, 3)
    kept = spark.read.parquet(folder)
    assert kept.groupBy("level", "half").count().agg({"count": "max"}).first()[0] <= 5
    assert kept.agg({"n": "min"}).first()[0] > 8


@pytest.mark.parametrize("held", [0, 50, 400])
def test_scores_use_every_path_however_few_are_held(spark, monkeypatch, held):
    rng = random.Random(19)
    texts = [prose(rng, 40) for _ in range(20)] + ["αβγ rare bytes " + prose(rng, 5), "αβγ rare bytes", "", None]
    docs = docs_of(spark, texts).union(docs_of(spark, texts[:1]))
    monkeypatch.setattr(ppm, "_BUNDLE", 100)
    half = ppm._half(pa.array(range(len(texts))))
    tries = [ppm.Trie(), ppm.Trie()]
    for k, t in [*enumerate(texts), (0, texts[0])]:
        b = bytes(4) + (t or "").encode()
        for i in range(4, len(b)):
            tries[half[k]].add(b[i - 4 : i], b[i])
    got = ppm.score(docs, 4, held).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        b = bytes(4) + (texts[r["doc_id"]] or "").encode()
        want = sum(tries[1 - half[r["doc_id"]]].bits(b[i - 4 : i], b[i]) for i in range(4, len(b)))
        assert abs(r["bits"] - want) < 0.01 and r["n_bytes"] == len(b) - 4


def test_adaptive_beats_even_coding(spark):
    text = b"the cat sat on the mat and the cat sat on the hat " * 4
    assert ppm.adaptive_bits(text) < 3 * len(text)
    assert ppm.adaptive_bits(b"") == 0 and ppm.adaptive_bits(b"a") == 8
    got = ppm.adaptive_scores(docs_of(spark, [text.decode(), None])).orderBy("doc_id").collect()
    assert abs(got[0]["bits"] - ppm.adaptive_bits(text)) < 0.01 and got[1]["bits"] == 0


# 6: SimHash


def test_bit_sliced_pairs_equal_brute_force():
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 62, (40, 2))
    ab = np.concatenate([base ^ np.where(rng.random((40, 2)) < 0.5, 1 << rng.integers(0, 62, (40, 2)), 0) for _ in range(6)] + [rng.integers(0, 1 << 62, (100, 2))])
    bucket = np.sort(np.concatenate([rng.integers(0, 5, 240), np.full(100, 9)]))
    for radius in (0, 3, 20, 64):
        left, right = (np.concatenate(x) for x in zip(*simhash.close_pairs(ab, bucket, radius)))
        bits = simhash._bits(ab)
        want = {(i, j) for i in range(len(ab)) for j in range(i + 1, len(ab)) if bucket[i] == bucket[j] and (bits[i] != bits[j]).sum() <= radius}
        assert set(zip(left.tolist(), right.tolist())) == want and len(left) == len(want)
        root = list(range(len(ab)))
        for _ in ab:
            for i, j in want:
                root[i] = root[j] = min(root[i], root[j])
        assert simhash.forest(ab, bucket, radius).tolist() == root


def test_a_bucket_of_copies_makes_no_list_of_pairs():
    ab = np.random.default_rng(2).integers(0, 1 << 62, (1, 2)).repeat(3000, 0)
    ab[:, 0] ^= np.arange(3000)
    root = simhash.forest(ab, np.zeros(3000, np.int64))
    assert (root == 0).all()


def test_fingerprint_is_the_majority_of_distinct_words():
    a, b = simhash.fingerprints(*utf8(pa.array(["one two three four five six seven eight", "eight seven six five four three two one one"])))
    assert (a[0] == a[1]).all() and list(b) == [8, 9]
    few, _ = simhash.fingerprints(*utf8(pa.array(["one two", "two one", "One, TWO!"])))
    assert (few[0] == few[2]).all() and (few[0] != few[1]).any()


def test_near_copies_recall_against_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(120):
        w = prose(rng, rng.randint(20, 200)).split()
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            texts.append(" ".join(x if rng.random() > 0.05 else rng.choice(WORDS) * 2 for x in w))
    texts += [texts[0]] * 30
    docs = docs_of(spark, texts)
    gone = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_copies(docs).collect()}
    sig, _ = simhash.fingerprints(*utf8(pa.array(texts)))
    bits = simhash._bits(sig.view(np.int64))
    close = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (bits[i] != bits[j]).sum() <= simhash.RADIUS]
    group = lambda k: gone.get(k, k)
    assert sum(group(i) == group(j) for i, j in close) >= 0.9 * len(close)
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in close:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    assert all(find(k) == find(v) and v < k for k, v in gone.items())
    assert all(gone[len(texts) - 1 - k] == 0 for k in range(30))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = dict(tuple(r) for r in simhash.components(chain).collect())
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_near_copies_awkward(spark, awkward, nothing):
    got = rows(simhash.near_copies(awkward))
    assert got == [(7, 6, 2)]
    kept = simhash.drop_near_copies(spark, awkward, "")
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "8", "None", "None"]
    assert simhash.near_copies(nothing).count() == 0 and simhash.drop_near_copies(spark, nothing, "").count() == 0


def test_texts_that_share_a_doc_id_are_judged_each_for_itself(spark):
    a, b, c = "a text of its own with more than eight words", "the quick brown fox jumps over a lazy dog again", "x y z"
    texts = [(5, None), (5, a), (6, c), (6, b), (7, b), (7, c), (8, b), (8, "nothing in common with any of those other lines at all, friends"), (9, "!!"), (9, "!!"), (5, a), (5, a), (None, a)]
    docs = spark.createDataFrame([(k, t, "en", None, None, 1, 0.5, True, 7, 8) for k, t in texts], DOCS)
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in simhash.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted([("5", "None"), ("5", a), ("6", c), ("6", b), ("8", "nothing in common with any of those other lines at all, friends"), ("9", "!!"), ("9", "!!"), ("None", a)])
    assert rows(simhash.near_copies(docs)) == [(7, 6, 3)]


def test_hot_buckets_lose_no_pair(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        w = prose(rng, 60).split()
        texts += [" ".join(x if rng.random() > 0.04 else rng.choice(WORDS) for x in w) for _ in range(4)]
    docs = docs_of(spark, texts)
    assert rows(simhash.near_copies(docs, hot=4)) == rows(simhash.near_copies(docs)) != []


@pytest.mark.parametrize("power", [10, 20, 24, 26, 30])
def test_bands_find_pairs_at_the_radius_for_every_size(power):
    bands = simhash.plan_bands(1 << power)
    hit = math.comb(simhash.BITS - simhash.RADIUS, bands.shape[1]) / math.comb(simhash.BITS, bands.shape[1])
    assert 1 - (1 - hit) ** len(bands) >= simhash.RECALL
    rng = np.random.default_rng(13)
    differs = np.argsort(rng.random((4000, simhash.BITS)), axis=1)[:, : simhash.RADIUS]
    bits = np.zeros((4000, simhash.BITS), bool)
    np.put_along_axis(bits, differs, True, axis=1)
    met = np.zeros(4000, bool)
    for band in bands:
        met |= ~bits[:, band].any(axis=1)
    assert met.mean() > simhash.RECALL - 0.02


# 7: SentencePiece


@pytest.fixture(scope="module")
def model():
    if not os.path.exists(pieces.MODEL):
        pytest.skip("no piece model")
    return pieces.pieces(pieces.MODEL)


TEXTS = ["a  b", "  a", " ", "", "x", "a\tb\r\n c ", "​ A\x00b", "日本語のテキスト 😀😀", "Ünï\ncödé\n\n", "   ", "the quick brown fox " * 20, "y" * 300 + " end"]


def test_without_dropout_it_is_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids, same = pieces.encode_texts(model, pa.array([*TEXTS, None]), np.zeros(len(TEXTS) + 1, np.int64), 0.0)
    assert ids.to_pylist() == [*(sp.encode(t) for t in TEXTS), None]
    assert same.to_pylist() == [True] * len(TEXTS) + [None]


@pytest.mark.parametrize("dropout", [0.05, 0.3, 1.0])
def test_agenda_of_all_units_equals_the_heap(model, dropout):
    rng = random.Random(12)
    units = pa.array([" " + prose(rng, 1) for _ in range(300)] + [" ééàq日", " ", "   x"], pa.large_string())
    lane = np.arange(len(units)) % 3
    ids, count = pieces.encode_units(model, units, lane, dropout, 5)
    keys, at = pieces.unit_keys(units, lane, 5), 0
    for k, u in enumerate(units.to_pylist()):
        sym = [int(model.plane[ord(pieces.SPACE if c == " " else c)]) for c in u]
        sym = np.array([s if s >= 0 else -1 - ord(c) for s, c in zip(sym, u)])
        out = pieces.encode_by_heap_coded(model, sym, int(keys[k]), dropout)
        want = [i for s in out for i in ([s] if 0 <= s < model.size else [int(model.byte[b]) for b in (model.extra[s] if s >= 0 else chr(-1 - s)).encode()])]
        assert ids[at : at + count[k]].tolist() == want
        at += count[k]


def test_agenda_costs_a_fraction_of_the_heap_and_takes_any_columns(model, monkeypatch):
    rng = random.Random(3)
    words = [" " + "".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(3, 14))) for _ in range(40000)]
    units, lane = pa.array(words, pa.large_string()), np.arange(40000)
    symbols = [[int(model.plane[ord(pieces.SPACE if c == " " else c)]) for c in w] for w in words[:4000]]

    def cpu(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    took = [(cpu(lambda: pieces.encode_units(model, units, lane, 0.1, 5)), cpu(lambda: [pieces.encode_by_heap(model, s, 0, 0.0) for s in symbols])) for _ in range(5)]
    assert 4 * min(a for a, _ in took) < 10 * min(h for _, h in took)  # a tenth of the units on the heap, without dropout
    # units of all lengths, characters without a symbol, few columns at once
    odd = pa.array([" " + "".join(rng.choices("aenst\x00\x06é日😀▁", k=k)) for k in [*range(48), *range(48), 60]], pa.large_string())
    want = [x.tolist() for x in pieces.encode_units(model, odd, np.arange(97), 0.2, 5)]
    monkeypatch.setattr(pieces, "_COLUMNS", 3)
    assert [x.tolist() for x in pieces.encode_units(model, odd, np.arange(97), 0.2, 5)] == want
    monkeypatch.setattr(pieces, "LONG_UNIT", 0)  # all on the heap
    assert [x.tolist() for x in pieces.encode_units(model, odd, np.arange(97), 0.2, 5)] == want


def test_dropout_varies_by_seed_and_lane_and_is_lossless(spark, model, awkward, nothing):
    texts = TEXTS + ["▁ literal ▁▁ mark"]
    docs = docs_of(spark, texts * 8)
    got = pieces.encode_documents(docs, dropout=0.2)
    assert rows(got) == rows(pieces.encode_documents(docs.repartition(3), dropout=0.2))
    assert got.where("not lossless").count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(got).collect()}
    assert all(back[k] == texts[k % len(texts)] for k in back)
    long_ = {tuple(r["ids"]) for r in got.collect() if r["doc_id"] % len(texts) == 10}
    assert len(long_) > 2
    assert rows(got) != rows(pieces.encode_documents(docs, dropout=0.2, seed=99))
    assert pieces.encode_documents(awkward).where("lossless or ids is null").count() == 11
    assert pieces.encode_documents(nothing).count() == 0


def test_ids_that_say_something_else_are_not_lossless(model):
    texts = pa.array(["one two", "", "three", None, " four"])
    ids, lossless = pieces.encode_texts(model, texts, np.arange(5))
    assert lossless.to_pylist() == [True, True, True, None, True]
    values, count = ids.flatten().to_numpy().copy(), np.array([len(x or []) for x in ids.to_pylist()])
    values[count[0]] = values[0]  # the third text now begins like the first
    assert pieces._decodes(model, texts, values, count).tolist() == [True, True, False, True, True]
    assert pieces._decodes(model, texts, values[1:], count - np.array([1, 0, 0, 0, 0])).tolist()[0] is False


def test_decoding_takes_null_empty_and_repeated_rows(spark):
    rows_ = [(1, None), (2, []), (None, [262]), (3, [262]), (3, [262])]
    got = spark.createDataFrame(rows_, "doc_id long, ids array<int>")
    out = sorted(((r["doc_id"], r["text"]) for r in pieces.decode_documents(got).collect()), key=str)
    assert [t for i, t in out if i == 1] == [None] and [t for i, t in out if i == 2] == [""] and len(out) == 5
    assert pieces.decode_documents(got.limit(0)).count() == 0


def test_every_occurrence_is_segmented_for_itself(model):
    texts = [" ".join(["international"] * 40)] * 30
    got, same = pieces.encode_texts(model, pa.array(texts), np.arange(30), 0.3, 5)
    assert all(same.to_pylist()) and len({tuple(x) for x in got.to_pylist()}) == 30
    # each equals the plain agenda under its own key
    flat, count = pieces.units_of(pa.array(texts))
    with np.errstate(over="ignore"):
        key = pieces.mix(pieces.mix(np.repeat(np.arange(30), 40).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.tile(np.arange(40), 30).astype(np.uint64))
    ids, per = pieces.encode_units(model, flat, key, 0.3, 5)
    assert got.flatten().to_pylist() == ids.tolist()
    ends = np.cumsum(per)[:40]
    assert len({tuple(ids[e - n : e]) for e, n in zip(ends, per)}) > 8


# 8: conditional random field


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(13)
    first = np.array([1, 0, 0, 0, 1, 1, 0], bool)
    score, t = rng.normal(size=(7, 2)) * 3, rng.normal(size=(2, 2))
    marginal, pair, log_z = crf.forward_backward(score, t, first)
    want, pairs, total = np.zeros((7, 2)), np.zeros((7, 2, 2)), 0.0
    for a, e in ((0, 4), (4, 5), (5, 7)):
        z = 0.0
        for y in itertools.product(range(2), repeat=e - a):
            w = math.exp(sum(score[a + i, v] for i, v in enumerate(y)) + sum(t[p, q] for p, q in itertools.pairwise(y)))
            z += w
            for i, v in enumerate(y):
                want[a + i, v] += w
                if i:
                    pairs[a + i, y[i - 1], v] += w
        want[a:e] /= z
        pairs[a:e] /= z
        total += math.log(z)
    assert np.allclose(marginal, want) and np.allclose(pair, pairs) and math.isclose(log_z, total)


def test_long_chains_stay_finite():
    n = 100_000
    first = np.zeros(n, bool)
    first[0] = True
    marginal, _, log_z = crf.forward_backward(np.random.default_rng(0).normal(size=(n, 2)) * 20, np.array([[3.0, -3], [-3, 3]]), first)
    assert np.isfinite(marginal).all() and np.isfinite(log_z)


def test_lines_have_plain_statistics():
    own = crf.lines_of(*utf8(pa.array(["AB c1\n\nx|y!", "", "a\n", None])))
    assert own.row.tolist() == [0, 0, 0, 1, 2, 2, 3] and own.length.tolist() == [5, 0, 4, 0, 1, 0, 0]
    assert own.first.tolist() == [True, False, False, True, True, False, True]
    assert math.isclose(own.x[0, 0], 2 / 5) and math.isclose(own.x[0, 1], 1 / 5) and math.isclose(own.x[2, 3], 1 / 4)
    assert (own.x[1, crf.OWN : 2 * crf.OWN] == own.x[0, : crf.OWN]).all()


def test_crf_held_out_accuracy_and_cases(spark, awkward, nothing):
    rng = random.Random(14)
    bad = lambda n: "\n".join(junk(rng, 12) for _ in range(n))
    good = lambda n: "\n".join(prose(rng, 12) for _ in range(n))
    docs = docs_of(spark, [bad(rng.randint(1, 9)) if k % 3 == 0 else good(rng.randint(1, 9)) for k in range(300)])
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(200)] + [(None, 0, 0), (3, None, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in crf.line_quality(docs, labels).collect()}
    assert sum(got[k] == (k % 3 != 0) for k in range(200, 300)) >= 97
    assert crf.line_quality(awkward, labels.limit(0)).where("quality = 1 and keep").count() == 11
    assert crf.line_quality(nothing, labels).count() == 0
    fitted = {str(r["doc_id"]) + str(r["n_lines"]): r for r in crf.line_quality(docs.union(awkward.where("doc_id is null or doc_id <> 0").withColumn("doc_id", F.col("doc_id") + 1000)), labels).where("doc_id is null or doc_id >= 1000").collect()}
    assert fitted["10010"]["quality"] == fitted["10020"]["quality"] == 1.0 and all(0 <= r["quality"] <= 1 for r in fitted.values()) and fitted["10041"]["n_lines"] == 1


# 9: pseudonyms


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000, 73049])
def test_feistel_is_a_permutation(size):
    some = range(min(size, 1200))
    out = [pseudonyms.permute(b"k", "t", size, v) for v in some]
    assert len(set(out)) == len(out) and all(0 <= v < size for v in out)
    assert [pseudonyms.permute(b"k", "t", size, v, True) for v in out] == list(some)


def test_pseudonyms_keep_format_and_validity_and_link():
    f, back = pseudonyms.Feistel(b"key"), pseudonyms.Feistel(b"key", True)
    text = 'Call +1 (743) 555-3824 or 743-555-3824, card 4785380592391139 and 4111 1111 1111 1111, ip 152.143.123.131. mail a.b19@mail5.example.com token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" on 2024-02-29 or 31/12/1999, ssn 078-05-1120, GB82 WEST 1234 5698 7654 32'
    new, n = pseudonyms.pseudonymise(text, f)
    assert n == 11 and len(new) == len(text)
    assert re.sub("[0-9]", "9", re.sub("[a-f0-9]{40}", "", new.split("mail ")[0])) == re.sub("[0-9]", "9", re.sub("[a-f0-9]{40}", "", text.split("mail ")[0]))
    for value in ("555-3824", "4785380592391139", "4111 1111 1111 1111", "152.143.123.131", "a.b19@", "24be64", "2024-02-29", "078-05-1120", "1234 5698"):
        assert value not in new
    assert all(pseudonyms.luhn(re.sub(" ", "", c)) for c in re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", new.split("ip")[0]))
    assert pseudonyms.pseudonymise(new, back)[0] == text
    again, _ = pseudonyms.pseudonymise("x 4785380592391139 4785380592391139 y", f)
    a, b = re.findall(r"\d{16}", again)
    assert a == b and a in new


def test_unvalidated_values_stay(spark, awkward, nothing):
    f = pseudonyms.Feistel()
    for text in ("1234567812345678", "999.1.1.1", "2023-02-30", "000-12-3456", "version 4.0", "the year 1999", "plain text", "v1.2.3.4", "12345"):
        assert pseudonyms.pseudonymise(text, f) == (text, 0)
    out = pseudonyms.with_pseudonyms(awkward)
    assert out.columns == awkward.columns and rows(out) == rows(awkward)
    assert pseudonyms.with_pseudonyms(nothing).count() == 0
    docs = docs_of(spark, ["ip 10.20.30.40", None, "clean"])
    got = pseudonyms.with_pseudonyms(docs)
    assert rows(got)[0][1] != "ip 10.20.30.40" and rows(pseudonyms.with_pseudonyms(got, back=True)) == rows(docs)


def test_values_beside_others_and_in_other_forms_are_replaced_and_restored():
    there, back = pseudonyms.Feistel(), pseudonyms.Feistel(back=True)
    card, secret = "4111 1111 1111 1111", "aB3" * 60
    for text, gone in [
        (f"paid {card} 12/27 ok", card), (f"paid {card} 123.", card), (f"no 123 {card}", card), (f"{card} 743 555 3824", "743 555 3824"), ("at 2024-05-06T12:34:56Z", "2024-05-06"),
        ("born 3/4/1990.", "3/4/1990"), ("on 4 March 1990,", "4 March 1990"), ("on Mar 4th, 1990", "Mar 4th, 1990"), ("call 743 555 3824 now", "743 555 3824"), (f"api_key = {secret}!", secret[128:]), ("secret: " + "0f" * 100, "0f" * 36),
    ]:
        said, found = pseudonyms.pseudonymise(text, there)
        assert found and gone not in said, (text, said)
        assert pseudonyms.pseudonymise(said, back)[0] == text, (text, said)
    rest = pseudonyms.pseudonymise(f"{card} 743 555 3824 {card} 12", there)
    assert rest[1] == 3 and rest[0][:19] == rest[0][33:52]
    for k in range(3000):  # cards of other lengths and groups come back too
        body = f"4{k * 7919 % 10**14:014d}"
        number = body + next(c for c in "0123456789" if pseudonyms.luhn(body + c))
        text = f"{number[:4]} {number[4:8]} {number[8:12]} {number[12:]} {k % 999:03d}"
        assert pseudonyms.pseudonymise(pseudonyms.pseudonymise(text, there)[0], back)[0] == text
    for text in ("4111 1111 1111 1112 12", "on 31/31/1990", "4 Marching 1990", "31 February 1990", "123 555 3824"):
        assert pseudonyms.pseudonymise(text, there) == (text, 0)


# 10: licences


def test_licence_spans(spark, awkward, nothing):
    rng = random.Random(15)
    notice = licences.TEMPLATES["gpl-3.0-notice"]
    header = licences.TEMPLATES["apache-2.0-header"].split()
    broken = " ".join(header[:20] + ["inserted", "words"] + header[20:50] + header[52:])
    texts = [prose(rng, 50) + "\n" + notice, prose(rng, 30) + broken, prose(rng, 80), notice + " " + prose(rng, 9) + " " + notice.upper(), "Licensed under the"]
    got = rows(licences.scan(docs_of(spark, texts)))
    assert [(r[0], r[1]) for r in got] == [(0, "gpl-3.0-notice"), (1, "apache-2.0-header"), (3, "gpl-3.0-notice"), (3, "gpl-3.0-notice")]
    assert got[0][2:4] == (50, 61) and got[0][5] == 1.0
    assert licences.scan(awkward).count() == 0 and licences.scan(nothing).count() == 0
    alike = {"b": "one two three four five six", "a": "one two three four five six", "short": "one two"}
    assert [r[1] for r in rows(licences.scan(docs_of(spark, ["see one two three four five six", "see one two three four five six"]), alike))] == ["a", "a"]


# registry and pipeline


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_agrees(spark, name):
    import duckdb

    d = "/root/testdata/sf0.01" if name == "op10_licence_scan" else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = registry.queries()[name](spark, d)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(names)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want))


def test_pipeline_equals_its_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() <= n
        n = docs.count()
    assert rows(docs) == rows(corpus_pipeline.run(spark, sf_dir))
    assert 0 < n


def test_pipeline_stages_take_awkward_rows(spark, awkward, tmp_path, sf_dir):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, sf_dir)
        assert out.columns == (awkward.columns if name != "sentencepiece_encoding" else ["doc_id", "ids", "n_ids", "lossless"]), name
        assert out.count() > 0


def test_pipeline_of_an_empty_table(spark, nothing, tmp_path, sf_dir):
    import corpus_pipeline

    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_the_key_of_the_session_is_used(spark, sf_dir):
    docs = docs_of(spark, ["mail a.b@example.com, version 10.2.3.4, host 10.2.3.4"])
    plain = pseudonyms.mask_documents(spark, docs, sf_dir).first()["text"]
    spark.conf.set(pseudonyms.KEY_SETTING, "another key")
    try:
        other = pseudonyms.mask_documents(spark, docs, sf_dir)
        assert other.first()["text"] != plain and "version 10.2.3.4" in plain and "host 10.2.3.4" not in plain
        assert pseudonyms.with_pseudonyms(other, back=True).first()["text"] == docs.first()["text"]
    finally:
        spark.conf.unset(pseudonyms.KEY_SETTING)


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    from sparrowdex.llm._text import shared_root

    def session(master, folder=None):
        empty = SimpleNamespace(get=lambda *_: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, getConf=lambda: empty))

    assert shared_root(session("local[4]")) == "/tmp/checkpoints" and shared_root(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            shared_root(session(master))
