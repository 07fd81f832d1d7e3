"""Functions over URLs, words and query strings, and numeric operators, against stated examples and brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from sparrowdex.functions import language, parse, urls, words
from sparrowdex.operators import ann, evaluate, learn, retrieve, spelling
from sparrowdex.plans.engine import LADDER, level_for
from sparrowdex.plans.understand import Understanding, analyzer_of


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTP://Example.COM:80/About/../about/?utm_source=x&id=7#team", "http://example.com/about?id=7"),
        ("https://www.example.com/index.html", "https://www.example.com/index.html"),
        ("http://user:pw@h.org:8080//a//b/./c/?b=2&a=1&gclid=9&flag", "http://h.org:8080/a/b/c?a=1&b=2&flag"),
        ("http://h.org/%7euser/%2f", "http://h.org/~user/%2F"),
        ("https://h.org", "https://h.org/"),
        ("ftp://h.org/", None),
        ("/relative", None),
        ("http://h.org:x/", None),
        ("http://[::1]:8080/a", "http://[::1]:8080/a"),
        ("https://[2001:DB8::1]:443/", "https://[2001:db8::1]/"),
        ("https://h.org/?sid=1&Ref=2&jsessionid=3&k=&twclid=4&s_cid=5", "https://h.org/?k=&s_cid=5&twclid=4"),
        ("http://h.org/a b/é", "http://h.org/a%20b/%C3%A9"),
        ("http://h.org/%zz", None),
        (None, None),
    ],
)
def test_canonical_urls(raw, want):
    assert urls.canonical(raw) == want
    assert want is None or urls.canonical(want) == want


def test_registered_domains_and_links():
    assert [urls.registered_domain(h) for h in ("a.b.example.com", "x.co.uk", "y.x.co.uk", "localhost", "10.0.0.1")] == ["example.com", "x.co.uk", "x.co.uk", "localhost", "10.0.0.1"]
    body = "see [ two  words ](/b?utm_x=1) and <https://other.org/> and [self](#top) ![pic](/p.png)"
    assert urls.links("https://h.org/a", body) == [("https://other.org/", ""), ("https://h.org/b", "two words"), ("https://h.org/p.png", "pic")]
    assert urls.outlinks("https://h.org/a", "[x](/b) [y](/b) <https://h.org/b>") == ["https://h.org/b"]
    assert urls.anchor_links("https://h.org/a", "[x](/b) [ ](/c) [x](/b) <https://o.org/> [y  z](c \"title\")") == [("https://h.org/b", "x"), ("https://h.org/b", "x"), ("https://h.org/c", "y z")]
    assert urls.links("https://h.org/a", '<a class="x" href="../c"><b>C</b> d</a>', html=True) == [("https://h.org/c", "C d")]


def test_stems_of_known_words():
    known = "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal hopefulness hope formaliti formal electrical electr goodness good revival reviv adjustment adjust adoption adopt effective effect rate rate controll control roll roll generously generous dying die skies sky inning inning consistency consist knightly knight national nation quickly quick".split()
    assert [words.stem(w) for w in known[::2]] == known[1::2]


def test_analyzers_by_language():
    assert words.analyse("The Running dogs", "en", stopwords=True) == ["run", "dog"]
    assert words.analyse("Été à Noël", "fr") == ["ete", "a", "noel"]
    assert words.segmented("中国人民", frozenset({"中国"})) == ["中国", "人民"] and words.segmented("一") == ["一"] and words.segmented("一二三") == ["一二", "二三"]
    assert words.analyse("ABC 日本語", "ja") == ["abc", "日本", "本語"]


def test_edit_distance_with_swaps():
    assert [words.osa(a, b, 2) for a, b in (("teh", "the"), ("abc", "abc"), ("abcd", "badc"), ("kitten", "sitting"), ("", "ab"))] == [1, 0, 2, -1, 2]


def test_embeddings_are_unit_and_repeatable():
    v = words.embed(["a", "b", "a"])
    assert math.isclose(np.linalg.norm(v), 1) and (v == words.embed(["a", "b", "a"])).all() and not words.embed([]).any()


def test_query_strings():
    q = parse.parse('+must -not "two words" site:WWW.Example.com/ title:Head +body:Red -url:x unknown:x a"b "open end')
    names = lambda terms: [(t.term, t.field) for t in terms]
    assert names(q.terms) == [("head", 0), ("unknown", -1), ("x", -1), ("a", -1), ("b", -1)]
    assert names(q.required) == [("must", -1), ("red", 1)] and names(q.excluded) == [("not", -1), ("x", 2)]
    assert q.phrases == (("two", "words"), ("open", "end")) and q.hosts == ("example.com",)
    assert q.lexical_terms() == ["head", "unknown", "x", "a", "b", "must", "red"]
    assert parse.parse("+ - ").empty() and not parse.parse('"a b"').empty() and parse.parse("site: title:").terms != ()
    assert parse.parse("b a").key() == parse.parse(" A  b").key() != parse.parse('"a b"').key()
    assert parse.parse("title:a").key() != parse.parse("a").key() != parse.parse("a", every=True).key()


def test_queries_are_corrected_expanded_and_given_vectors():
    q = parse.corrected(parse.parse("teh colour hous zz"), lambda t: {"teh": ("correct", "the"), "hous": ("suggest", "house")}.get(t, ("keep", None)))
    assert [t.term for t in q.terms] == ["the", "colour", "hous", "zz"] and q.correction == (("teh", "the", True), ("hous", "house", False))
    e = parse.expanded(q, spelling.expansion())
    assert e.retrieval_terms() == ["the", "colour", "hous", "zz", "color"] and e.key() != q.key()
    assert spelling.expansion()["usa"] == ["america", "of", "states", "united"] and spelling.expansion(split=False)["usa"] == ["united states of america"]
    v = parse.with_vector(q, [0.5, -1.0])
    assert parse.vector_of(v.vector) == [0.5, -1.0] and v.key() != q.key() and not parse.with_vector(q, [0.0, 0.0]).vector


def test_understanding_goes_through_all_parts_in_order():
    detect = lambda t: ("en", "running" in t)
    u = Understanding(detect, analyzer_of, lambda t: ("correct", "runner") if t == "run" else ("keep", None), {"runner": ["jogger"]}, lambda terms: [float(len(terms)), 0.0])
    q = u("running dogs")
    assert (q.lang, q.confident, [t.term for t in q.terms]) == ("en", True, ["runner", "dog"]) and q.retrieval_terms() == ["runner", "dog", "jogger"] and parse.vector_of(q.vector) == [2.0, 0.0]
    q = u("dogs")
    assert (q.lang, q.confident, [t.term for t in q.terms]) == ("en", False, ["dogs"])


def test_detection_of_single_texts():
    d = language.Detector({"en": {" th": 0, "the": 1, "he ": 2, "and": 3}, "de": {" de": 0, "der": 1, "er ": 2, "und": 3}})
    assert d("the and the") == ("en", True) and d("") == ("", False) and d("12") == ("", False)
    assert d("это текст") == ("ru", True) and d("ひらがな 日本") == ("ja", True) and d("latin text with か") == ("ja", False) and d("中文") == ("zh", True)
    assert list(language.CODES.values()) == list(range(17))


def test_query_files_and_replies():
    assert learn.query_file("# note\n\na\tb c\nplain text\n") == [("a", "b c"), ("q0004", "plain text")]
    assert [learn.grade_reply(r) for r in ("Grade: 2", "I'd say 1, no, 3.", "-4", "17")] == [2, 3, 0, 3] and "Query: x" in learn.grade_prompt("x", "t", "b")
    with pytest.raises(ValueError):
        learn.grade_reply("none")


def test_ladder_of_levels():
    assert [level_for(x, 10) for x in (10, 8, 7, 5, 3, 1, 0)] == [0, 0, 1, 2, 3, 4, 4]
    assert LADDER[3].drop == 0.25 and LADDER[4].l1 == 100 and not LADDER[2].dense and LADDER[1].l0 == 250


def test_code_estimates_find_the_nearest():
    rng = np.random.default_rng(4)
    base = retrieve._unit(rng.normal(size=(60, 64)))
    x = np.repeat(base, 50, 0) + 0.35 * rng.normal(size=(3000, 64))
    q = base[:40] + 0.35 * rng.normal(size=(40, 64))
    exact = np.argsort(-(retrieve._unit(q) @ retrieve._unit(x).T), axis=1)[:, :10]

    def recall(guess):
        return np.mean([len(set(a) & set(b)) for a, b in zip(np.argsort(-guess, axis=1)[:, :10], exact)]) / 10

    assert recall(ann.estimates(q, *ann.codes(x, 5))) >= 0.9 and recall(ann.estimates(q, *ann.codes(x, 4))) >= 0.85
    signs = np.packbits(retrieve.rotated(retrieve._unit(x)) > 0, axis=1)
    assert np.corrcoef(ann.hamming_estimates(q, signs, 64).ravel(), (retrieve._unit(q) @ retrieve._unit(x).T).ravel())[0, 1] > 0.5


def test_bootstrap_gains_on_held_out_queries():
    rng = np.random.default_rng(8)
    x = rng.random((600, 3))
    label = np.digitize(x[:, 1], [0.4, 0.6, 0.8]).astype(float)
    out = learn.bootstrap(x, label, np.repeat([f"q{k}" for k in range(30)], 20), rng.random(600), rounds=15)
    assert out.improved and out.trained > 0.9 and out.p < 0.1 and len(out.trees) == 15


def test_rotation_keeps_distances():
    x = np.random.default_rng(1).normal(size=(20, 50))
    r = retrieve.rotated(x)
    assert r.shape == (20, 64) and np.allclose(r @ r.T, x @ x.T)


def test_proximity_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        body = [rng.choice("abcdx") for _ in range(rng.randint(0, 14))]
        query = rng.sample("abc", rng.randint(2, 3))
        n = len(body)
        spans = [c[-1] - c[0] + 1 for c in itertools.combinations(range(n), len(query)) if [body[i] for i in c] == query]
        assert learn._ordered_span(body, query) == min(spans, default=0)
        hits = [(i, t) for i, t in enumerate(body) if t in query]
        want = {t for _, t in hits}
        widths = [j - i + 1 for i in range(n) for j in range(i, n) if want and want <= set(body[i : j + 1])]
        assert learn._smallest_window(hits, len(want)) == (min(widths) if widths else 0)


def test_online_features_of_a_small_case():
    f = {"title": ["red", "car"], "body": ["a", "red", "fast", "car"], "url": ["x"], "anchor": []}
    row = dict(zip(learn.ONLINE, learn.online_row(["red", "car"], f, "red.example.com", {"red": 2.0, "car": 1.0}, {k: 2.0 for k in f}, None)))
    assert row["exact_match_title"] == 1 and row["exact_match"] == 0 and row["ordered_proximity"] == 1 / 4 and row["min_pair_distance"] == 1 / 3
    assert row["first_occurrence"] == 1 / 2 and row["url_exact_host"] == 1 and row["idf_sum"] == 3 and row["dense_cosine"] == -1 and row["bm25_anchor"] == 0


def test_lambdamart_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((280 * 12, 8))
    s = 0.6 * x[:, 0] + 0.8 * x[:, 0] * x[:, 1] + 0.05 * rng.normal(size=len(x))
    y = np.digitize(s, [0.25, 0.45, 0.65, 0.85]).astype(float)
    train = 200 * 12
    trees = learn.lambdamart(x[:train], y[:train], np.full(200, 12), rounds=60)

    def ndcg(score):
        out = []
        for k in range(train, len(x), 12):
            g = 2 ** y[k : k + 12] - 1
            d = 1 / np.log2(np.arange(2, 12))
            best = (np.sort(g)[::-1][:10] * d).sum()
            out.append((g[np.argsort(-score[k : k + 12], kind="stable")][:10] * d).sum() / best if best else 1.0)
        return np.mean(out)

    got = learn.predict(trees, x)
    assert ndcg(got) >= 0.9 and ndcg(got) > max(ndcg(x[:, k]) for k in range(8)) + 0.02


def test_split_and_randomisation():
    a, b = learn.split_queries([f"q{k}" for k in range(10)])
    assert len(b) == 2 and not set(a) & set(b) and learn.split_queries(["x", "y"])[1] and learn.split_queries(["x"]) in ((["x"], []), ([], ["x"]))
    assert evaluate.randomisation(np.full(30, 0.1)) < 0.05 < evaluate.randomisation(np.array([0.1, -0.1] * 15))
