"""Language identification: script votes and ranked trigram profiles learned from a labelled corpus."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import trigrams

PROFILE, MISS, LEAST = 300, 300, 3
NEAR, APART, SHARE = 0.92, 0.97, 0.60
#: Most rows of profiles that go to the texts.
HELD = 100_000
#: Scripts and their languages; the first of equals wins.
SCRIPTS = {"ko": r"\p{IsHangul}", "ja": r"[\p{IsHiragana}\p{IsKatakana}]", "zh": r"\p{IsHan}", "ru": r"\p{IsCyrillic}", "el": r"\p{IsGreek}", "ar": r"\p{IsArabic}", "he": r"\p{IsHebrew}", "th": r"\p{IsThai}", "hi": r"\p{IsDevanagari}", "latin": r"\p{IsLatin}"}


def scripts(docs: DataFrame) -> DataFrame:
    """(doc_id, script, share) of the script with most letters of each text; any kana makes it Japanese, which then also counts Han."""
    counted = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text")).withColumns({f"n_{s}": F.regexp_count("text", F.lit(p)).cast("long") for s, p in SCRIPTS.items()})
    n = {s: F.col(f"n_{s}") for s in SCRIPTS}
    counted = counted.withColumns({"n_all": sum(n.values(), F.lit(0)), "n_most": F.greatest(*n.values())})
    name = F.lit("latin")
    for s in reversed([s for s in SCRIPTS if s != "latin"]):
        name = F.when((n[s] == F.col("n_most")) & (F.col("n_most") > 0), F.lit(s)).otherwise(name)
    kana = n["ja"] > 0
    votes = F.when(kana, n["ja"] + n["zh"]).otherwise(F.col("n_most"))
    return counted.select("doc_id", F.when(kana, F.lit("ja")).otherwise(name).alias("script"), F.when(F.col("n_all") > 0, votes / F.col("n_all")).otherwise(0.0).alias("share"))


def _ranked(grams: DataFrame, by: str) -> DataFrame:
    n = grams.groupBy(by, "gram").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "gram")).cast("long") - 1)


def profiles(docs: DataFrame) -> DataFrame:
    """(lang, gram, r): the PROFILE most frequent trigrams of each language of docs (lang, text)."""
    return _ranked(docs.where("lang is not null").select("lang", F.explode(trigrams(docs["text"])).alias("gram")), "lang").where(F.col("r") < PROFILE).select("lang", "gram", "r")


def distances(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """(doc_id, lang, distance, grams): the out-of-place distance of each text to each language, over MISS for each of its trigrams.

    Profiles of HELD rows at most (a language has PROFILE) go to the texts, each of which is counted and compared where it is read. More of them
    are joined: a document's trigrams meet only the profiles that have them; what a language lacks is counted, not joined.
    """
    held = profile.limit(HELD + 1).collect()
    if len(held) <= HELD:
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = docs.select("doc_id", F.regexp_extract_all(F.lower(F.coalesce(docs["text"], F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
        return rows.mapInPandas(_compared([(r["lang"], r["gram"], r["r"]) for r in held]), f"doc_id {kind}, lang string, distance double, grams long")
    own = _ranked(docs.select("doc_id", F.explode(trigrams(docs["text"])).alias("gram")), "doc_id")
    size = own.groupBy("doc_id").agg(F.count("*").alias("grams"))
    met = own.join(profile.withColumnRenamed("r", "q"), "gram").groupBy("doc_id", "lang").agg(F.sum(F.abs(F.col("r") - F.col("q"))).alias("moved"), F.count("*").alias("met"))
    every = size.crossJoin(profile.select("lang").distinct()).join(met, ["doc_id", "lang"], "left").na.fill(0, ["moved", "met"])
    return every.select("doc_id", "lang", ((F.col("moved") + (F.col("grams") - F.col("met")) * MISS) / (F.lit(float(MISS)) * F.col("grams"))).alias("distance"), "grams")


def _compared(profile: list[tuple[str, str, int]]):
    langs = sorted({p[0] for p in profile})
    places: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, r in profile:
        places.setdefault(gram, []).append((langs.index(lang), r))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, words in zip(f["doc_id"], f["w"], strict=True):
                counts: Counter[str] = Counter()
                for w, n in Counter(words).items():
                    padded = f" {w} "
                    for i in range(len(w)):
                        counts[padded[i : i + 3]] += n
                if not counts:
                    continue
                moved, n = [0] * len(langs), len(counts)
                met = [0] * len(langs)
                for k, gram in enumerate(sorted(counts, key=lambda g: (-counts[g], g))):
                    for lang, r in places.get(gram, ()):
                        moved[lang] += abs(k - r)
                        met[lang] += 1
                out += [(doc, lang, (moved[i] + (n - met[i]) * MISS) / (float(MISS) * n), n) for i, lang in enumerate(langs)]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "distance", "grams"])

    return run


def detect(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """(doc_id, lang, confident, distance) of every text (doc_id, text) with letters. Other scripts than Latin decide by their share."""
    w = Window.partitionBy("doc_id").orderBy("distance", "lang")
    d = distances(docs, profile).withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("distance").over(w)).where("k = 1")
    latin = (F.col("distance") <= NEAR) & (F.col("second").isNull() | (F.col("distance") < APART * F.col("second"))) & (F.col("grams") >= LEAST)
    out = scripts(docs).join(d, "doc_id", "left")
    other = F.col("script") != "latin"
    return out.where(F.col("grams").isNotNull() | other).select("doc_id", F.when(other, F.col("script")).otherwise(F.col("lang")).alias("lang"), F.when(other, F.col("share") >= SHARE).otherwise(F.coalesce(latin, F.lit(False))).alias("confident"), F.when(~other, F.col("distance")).alias("distance"))


#: Numbers of languages in stored columns; 0 is none.
CODES = {c: k for k, c in enumerate(("", "en", "es", "fr", "de", "it", "pt", "nl", "ru", "zh", "ja", "ko", "ar", "he", "hi", "th", "el"))}


def code(lang: Column) -> Column:
    """The number of a language; 0 for one that has none."""
    pairs = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(lang, F.lit(""))), F.lit(0))


_KINDS = (("ko", "HANGUL"), ("ja", "HIRAGANA"), ("ja", "KATAKANA"), ("zh", "CJK"), ("ru", "CYRILLIC"), ("el", "GREEK"), ("ar", "ARABIC"), ("he", "HEBREW"), ("th", "THAI"), ("hi", "DEVANAGARI"), ("latin", "LATIN"))


class Detector:
    """Detection of single texts, as queries are, by the profiles that detect() uses for tables: (language, sure)."""

    def __init__(self, profiles: dict[str, dict[str, int]]):
        self.profiles = profiles

    @classmethod
    def of(cls, profile: DataFrame) -> Detector:
        """PROFILE rows a language at most."""
        out: dict[str, dict[str, int]] = {}
        for r in profile.where(F.col("r") < PROFILE).collect():
            out.setdefault(r["lang"], {})[r["gram"]] = r["r"]
        return cls(out)

    def __call__(self, text: str) -> tuple[str, bool]:
        votes = Counter(next((s for s, n in _KINDS if n in unicodedata.name(c, "")), None) for c in text if c.isalpha())
        votes.pop(None, None)
        total = sum(votes.values())
        if not total:
            return "", False
        if votes["ja"]:
            return "ja", (votes["ja"] + votes["zh"]) / total >= SHARE
        most = max(votes.values())
        script = next(s for s in SCRIPTS if votes[s] == most)
        if script != "latin":
            return script, most / total >= SHARE
        grams = Counter(f" {w} "[i : i + 3] for w in re.findall(r"[^\W\d_]+", text.lower()) for i in range(len(w)))
        ranked = {g: k for k, (g, _) in enumerate(sorted(grams.items(), key=lambda x: (-x[1], x[0])))}
        far = sorted((sum(abs(k - p[g]) if g in p else MISS for g, k in ranked.items()) / (MISS * len(ranked)), lang) for lang, p in self.profiles.items())
        if not far:
            return "", False
        sure = far[0][0] <= NEAR and (len(far) < 2 or far[0][0] < APART * far[1][0]) and len(ranked) >= LEAST
        return (far[0][1], True) if sure else ("", False)
