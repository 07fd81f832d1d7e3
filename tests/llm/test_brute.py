"""Registered queries over a small table against plain Python that shares no code with them."""

import hashlib
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from sparrowdex.llm import crf, queries, rules

QUERIES = queries.queries()


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").collect()]
    docs = [(r[0], r[1]) for r in read("documents")]
    return {"documents": docs, "benchmark": read("benchmark"), "labels": {r[0]: r[1] for r in read("labels") if r[0] is not None}}


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text)
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)


# 2


def test_leaks_of_all_documents_equal_plain_scores(spark, sf_dir, tables):
    items = [(i, plain_words(t), t) for i, t in tables["benchmark"]]
    n, mean = len(items), sum(len(w) for _, w, _ in items) / len(items)
    df = Counter(w for _, ws, _ in items for w in set(ws))
    weigh = lambda w, ws: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    window = max(16, *(len(w) for _, w, _ in items))
    grams = lambda ws, k: {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
    want = {}
    for item, ws, text in items:
        weight = {w: weigh(w, ws) for w in set(ws)}
        own = sum(weight.values())
        ends = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if plain_words(s)]
        m = len(plain_words(ends[-1])) if len(ends) > 1 else max(1, len(ws) // 4)
        q, a = grams(ws[:-m], min(3, len(ws[:-m]))), grams(ws[-m:], min(2, m))
        for doc, body in tables["documents"]:
            dw = plain_words(body or "")
            for first in range(0, max(1, len(dw) - window + window // 2), window // 2):
                if not dw or (first and first + window - window // 2 >= len(dw)):
                    break
                share = sum(weight.get(w, 0) for w in set(dw[first : first + window])) / own
                if share < 0.5:
                    continue
                around = dw[max(0, first - window) : first + 2 * window]
                over = [len(g & grams(around, len(next(iter(g))))) / len(g) if g else 1.0 for g in (q, a)]
                if min(over) >= 0.5:
                    old = want.get((doc, item), (0, 0, 0))
                    want[doc, item] = tuple(max(x, y) for x, y in zip(old, (share, *over)))
    got = {(r[0], r[1]): r[2:] for r in map(tuple, QUERIES["op2_benchmark_decontamination"](spark, sf_dir).collect())}
    assert got.keys() == want.keys() and got
    for k, v in got.items():
        assert np.allclose(v, want[k], atol=2e-6)


# 3


def plain_statistics(text):
    t = text or ""
    n, words, lines = len(t.encode("utf-16-le")) // 2, re.findall(r"[^ \t\n\x0b\f\r]+", t), t.split("\n")
    count = lambda f: sum(map(f, t))
    share = lambda x: round(x / n, 6) if n else 0.0
    parts, echo = re.split(r"([ \t\n\x0b\f\r]+)", t), 0
    for k in range(0, len(parts) - 2, 2):
        echo += bool(parts[k]) and parts[k + 1] == " " and parts[k + 2] == parts[k]
    return {
        "chars": float(n), "words": float(len(words)), "upper": share(count(lambda c: unicodedata.category(c) == "Lu")), "digit": share(count(lambda c: c in "0123456789")),
        "symbol": share(count(lambda c: c in "#$%&*@^~<>{}[]\\=_+")), "pipe": share(t.count("|")), "bang": share(t.count("!")), "word_len": round(n / len(words), 6) if words else 0.0,
        "line_len": round(n / len(lines), 6), "repeated": round(1 - len(set(lines)) / len(lines), 6), "echo": round(echo / len(words), 6) if words else 0.0,
    }


def plain_list(rows):
    """Sequential covering by trying every condition on every row. rows: (statistics, bad, held)."""
    holds = lambda rule, s: all(s[k] > c if up else s[k] <= c for k, up, c in rule)
    left, out = list(rows), []
    while any(b and not h for _, b, h in left):
        inside, rule = [r for r in left if not r[2]], []
        while True:
            p0, n0 = sum(r[1] for r in inside), sum(not r[1] for r in inside)
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for stat in rules.STATS:
                own, wrong = np.array([r[0][stat] for r in inside]), np.array([r[1] for r in inside])
                values = sorted(set(own.tolist()))
                for up in (True, False):
                    for x, y in zip(values, values[1:]):
                        cut = (x + y) / 2
                        side = wrong[(own > cut) == up]
                        p = int(side.sum())
                        g = p * (math.log2(p / len(side)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if g > gain + 1e-12:
                            best, gain = (stat, up, float(np.round(cut, 6))), g
            if best is None:
                break
            rule.append(best)
            inside = [r for r in inside if holds([best], r[0])]
        if not rule:
            break

        def tally(r, among):
            hit = [b for s, b, _ in among if holds(r, s)]
            return sum(hit), len(hit) - sum(hit)

        held = [r for r in left if r[2]]
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*tally(r, held))
        chosen = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        p, n = tally(chosen, held)
        if not p or p / (p + n) < rules.MIN_PRECISION:
            chosen, (p, n) = rule, tally(rule, left)
            if p < 3 or p / (p + n) < 0.95:
                break
        out.append(chosen)
        left = [r for r in left if not holds(chosen, r[0])]
    return out, holds


def test_rules_of_all_documents_equal_plain_covering(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table has too few bad documents to learn from
    stats = {r["doc_id"]: plain_statistics(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: (r["quality"], r["h"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality", "xxhash64(doc_id) AS h").collect()}
    labelled = [(stats[d], q == 0, h % 3 == 0) for d, (q, h) in sorted(labels.items()) if d in stats]
    learned, holds = plain_list(labelled)
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, sf_dir).collect()}
    assert got.keys() == stats.keys() and learned
    for d, s in stats.items():
        assert all(abs(got[d][k] - v) < 1.5e-6 for k, v in s.items()), (d, s, got[d])
        assert got[d]["rule"] == next((k for k, r in enumerate(learned, 1) if holds(r, s)), None)
        assert got[d]["keep"] == (got[d]["rule"] is None)


# 8


def test_line_field_equals_a_plain_one(spark, sf_dir, tables):
    """Fit and marginals by one pass over the lines of each document, in logarithms, on the field's own features."""
    features = {d: crf.lines_of(*_bytes(t)) for d, t in tables["documents"]}
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(d,) for d in tables["labels"]], "id long").selectExpr("id", "xxhash64(id)").collect()}
    order = sorted((d for d in tables["labels"] if d in features and dict(tables["documents"])[d] is not None), key=hashes.get)
    x = np.concatenate([features[d].x.astype(np.float32).astype(float) for d in order])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1.0
    chains = [(np.clip((features[d].x.astype(np.float32).astype(float) - mean) / scale, -8, 8), int(tables["labels"][d] != 0)) for d in order]

    def marginals(score, t):
        """score: lines of good against bad; t: 2 x 2. Marginals of good, and expected transitions."""
        n, add = len(score), np.logaddexp
        s = [(0.0, v) for v in score]
        f, b = [s[0]], [(0.0, 0.0)]
        for k in range(1, n):
            f.append(tuple(s[k][j] + add(f[-1][0] + t[0][j], f[-1][1] + t[1][j]) for j in (0, 1)))
        for k in range(n - 1, 0, -1):
            b.append(tuple(add(t[i][0] + s[k][0] + b[-1][0], t[i][1] + s[k][1] + b[-1][1]) for i in (0, 1)))
        b.reverse()
        z = add(f[-1][0], f[-1][1])
        good = np.array([math.exp(f[k][1] + b[k][1] - z) for k in range(n)])
        pair = np.zeros((2, 2))
        for k in range(1, n):
            for i in (0, 1):
                for j in (0, 1):
                    pair[i, j] += math.exp(f[k - 1][i] + t[i][j] + s[k][j] + b[k][j] - z)
        return good, pair

    total, w, m, v = len(x), np.zeros(x.shape[1] + 5), 0.0, 0.0
    for step in range(1, crf.STEPS + 1):
        g, t = np.zeros_like(w), w[-4:].reshape(2, 2)
        for z, y in chains:
            good, pair = marginals(z @ w[:-5] + w[-5], t)
            seen = np.zeros((2, 2))
            seen[y, y] = len(z) - 1
            g += np.concatenate([z.T @ (good - y), [(good - y).sum()], (pair - seen).ravel()])
        g = g / total + crf.RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - crf.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    got = {r["doc_id"]: r for r in QUERIES["op8_crf_quality"](spark, sf_dir).collect()}
    assert got.keys() == features.keys()
    for d, own in features.items():
        good, _ = marginals(np.clip((own.x - mean) / scale, -8, 8) @ w[:-5] + w[-5], w[-4:].reshape(2, 2))
        quality = (good * own.length).sum() / own.length.sum() if own.length.sum() else 1.0
        assert abs(got[d]["quality"] - quality) < 2e-3 and got[d]["n_lines"] == (own.length > 0).sum()


def _bytes(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return data, np.array([0, len(data)])


# 9


def plain_permutation(kind, size, value, key=b"sparrowdex-pseudonyms"):
    """The network written out: two halves of nearly equal radix, eight rounds, walked into the range."""
    a = next(k for k in range(1, size + 2) if k * k >= size)
    b = -(-size // a)
    while True:
        left, right = value // b, value % b
        for i in range(8):
            x, m = (left, b) if i % 2 else (right, a)
            h = hashlib.blake2b(f"{kind}/{size}/{i}/{x}".encode(), key=key, digest_size=16 + m.bit_length() // 8).digest()
            y = int.from_bytes(h, "big") % m
            left, right = (left, (right + y) % b) if i % 2 else ((left + y) % a, right)
        value = left * b + right
        if value < size:
            return value


def test_pseudonyms_of_a_table_equal_plain_ones(spark, tmp_path):
    import datetime

    first = datetime.date(1900, 1, 1).toordinal()
    day = lambda y, m, d: datetime.date.fromordinal(first + plain_permutation("date", 73_049, datetime.date(y, m, d).toordinal() - first))

    def ssn(a, g, s):
        v = plain_permutation("ssn", 898 * 99 * 9999, ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1)
        x, y, z = v // (99 * 9999) + 1, v // 9999 % 99 + 1, v % 9999 + 1
        return f"{x + (x >= 666):03d}-{y:02d}-{z:04d}"

    def card(body):
        while True:
            body = body[0] + f"{plain_permutation('card' + body[0], 10 ** (len(body) - 1), int(body[1:])):0{len(body) - 1}d}"
            digit = next(c for c in "0123456789" if sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(body + c))) % 10 == 0)
            return body + digit

    v = plain_permutation("ip", 90 * 10 * 156 * 10, (((20 - 10) * 10 + 3) * 156 + 200 - 100) * 10 + 4)
    ip = f"{v // 15_600 + 10}.{v // 1560 % 10}.{v // 10 % 156 + 100}.{v % 10}"
    d = day(1987, 3, 14)
    new = card("411111111111111")
    said = [
        ("born 1987-03-14, twice 1987-03-14", f"born {d}, twice {d}", 2),
        ("ssn 123-45-6789 and 000-12-3456", f"ssn {ssn(123, 45, 6789)} and 000-12-3456", 1),
        ("host 20.3.200.4 not 20.3.256.4", f"host {ip} not 20.3.256.4", 1),
        ("card 4111-1111-1111-1111.", f"card {new[:4]}-{new[4:8]}-{new[8:12]}-{new[12:]}.", 1),
        ("card 4111-1111-1111-1112.", "card 4111-1111-1111-1112.", 0),
        ("", "", 0),
        (None, None, 0),
    ]
    spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(said)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op9_pii_pseudonyms"](spark, str(tmp_path)).collect()))
    assert got == [(k, t, n) for k, (_, t, n) in enumerate(said)]
