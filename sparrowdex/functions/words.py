"""Word functions that need Python: folding, segmentation, the English stemmer, edit distance, hash embeddings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
# with ation and ou, which the published algorithm leaves to other suffixes: the index that this one follows strips them
_STEP4 = ("ement", "ation", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.search(f"[{_V}][^{_V}]", w[start:])
        return start + m.end() if m else len(w)

    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if first is None else first
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(f"[{_V}][^{_V}]", w))


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The English (Porter 2) stem of a lower-case ASCII word; other words stay."""
    if len(word) < 3 or not re.fullmatch(r"[a-z']+", word):
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub(f"(^|(?<=[{_V}]))y", "Y", word.removeprefix("'"))
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    end = next((s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(s)), "")
    if end in ("eedly", "eed"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(f"[{_V}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and not (s == "ogi" and not w.endswith("logi")) and not (s == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
                w = w[: len(w) - len(s)] + to
            break
    # 3
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: len(w) - len(s)] + to
            break
    # 4
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def folded(text: str) -> str:
    """NFKC, then letters without their marks."""
    return "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text)) if unicodedata.category(c) != "Mn")


_HAN = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]+")


def segmented(run: str, words: frozenset[str] = frozenset(), longest: int = 6) -> list[str]:
    """Words of a run of ideographs: the longest known ones from the left, overlapping pairs where none is known."""
    out, at, n = [], 0, len(run)
    while at < n:
        known = next((k for k in range(min(longest, n - at), 1, -1) if run[at : at + k] in words), 0)
        if known:
            out.append(run[at : at + known])
            at += known
        elif at + 1 < n:
            out.append(run[at : at + 2])
            at += 1
            if at + 1 >= n:
                break
        else:
            out.append(run[at])
            at += 1
    return out


STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
FOLDING = frozenset(("es", "fr", "it", "pt", "de", "nl"))


def analyse(text: str, lang: str = "", stopwords: bool = False, words: frozenset[str] = frozenset()) -> list[str]:
    """Terms of a text by the analyzer of its language: stems in English, folded accents in Latin languages, segments in Chinese and Japanese."""
    if lang:
        text = folded(text) if lang in FOLDING else unicodedata.normalize("NFKC", text)
    terms = re.findall(r"[^\W_]+", text.lower())
    if lang in ("zh", "ja"):
        terms = [x for t in terms for part in re.split(f"({_HAN.pattern})", t) if part for x in (segmented(part, words) if _HAN.fullmatch(part) else [part])]
    if stopwords:
        terms = [t for t in terms if t not in STOP]
    return [stem(t) for t in terms] if lang == "en" else terms


def stem_udf(column):
    """For distinct terms; join the result back to the postings."""

    @F.pandas_udf("string")
    def run(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for w in words:
            yield w.map(lambda x: None if x is None else stem(x))

    return run(column)


def osa(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours between two words; -1 beyond most."""
    if abs(len(a) - len(b)) > most:
        return -1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = row, before, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, last[j - 2] + 1)
            row.append(best)
        if min(row) > most and (not before or min(before) > most):
            return -1
    return row[-1] if row[-1] <= most else -1


def osa_udf(left, right, most: int):
    @F.pandas_udf("int")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([osa(x, y, most) for x, y in zip(a, b, strict=True)], dtype="int32")

    return run(left, right)


def _finalised(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


@lru_cache(1 << 16)
def _token_vector(token: str, dim: int) -> tuple[tuple[int, float], ...]:
    state, out = xxhash.xxh64_intdigest(token.encode()) ^ 1, {}
    for _ in range(8):
        state = _finalised(state)
        at = (state >> 1) % dim
        out[at] = out.get(at, 0.0) + (1.0 if state & 1 else -1.0)
    norm = sum(v * v for v in out.values()) ** 0.5 or 1.0
    return tuple((k, v / norm) for k, v in out.items())


def embed(tokens: list[str], dim: int = 64) -> np.ndarray:
    """Mean of the tokens' signed hash vectors, unit length; zeros without tokens."""
    v = np.zeros(dim)
    for t in tokens:
        for k, x in _token_vector(t, dim):
            v[k] += x
    n = np.linalg.norm(v)
    return v / n if n else v


def embed_udf(dim: int = 64):
    @F.pandas_udf("array<double>")
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in lists:
            yield pd.Series([embed(list(t) if t is not None else [], dim) for t in x], dtype=object)

    return run
