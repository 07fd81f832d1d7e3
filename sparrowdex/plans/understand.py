"""Query understanding: detect and analyse, correct, expand, give a vector. Each part can be exchanged for a callable of one's own."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language, parse, words
from ..operators import retrieve, spelling


def analyzer_of(lang: str) -> Callable[[str], list[str]]:
    return partial(words.analyse, lang=lang)


def default_analyzer(lang: str) -> Callable[[str], list[str]]:
    """The index's own analyzer, whatever the language."""
    return words.analyse


class Understanding:
    """Turns query strings into parsed queries.

    detect: text -> (language, sure); select: language -> analyzer; correct: term -> (action, term); expand: term -> other forms; encode:
    terms -> vector. A part that is None is left out. The index is analysed without regard to languages, so by default queries are, too;
    select=analyzer_of analyses them by language.
    """

    def __init__(self, detect=None, select=default_analyzer, correct=None, expand: dict[str, list[str]] | None = None, encode=None, every: bool = False):
        self.detect, self.select, self.correct, self.expand, self.encode, self.every = detect, select, correct, expand, encode, every

    def __call__(self, text: str) -> parse.Parsed:
        q = parse.parse_detected(text, self.detect, self.select, self.every)
        if self.correct is not None:
            q = parse.corrected(q, self.correct)
        if self.expand is not None:
            q = parse.expanded(q, self.expand)
        return parse.with_vector(q, self.encode(q.lexical_terms())) if self.encode is not None else q

    @classmethod
    def over(cls, postings: DataFrame, profile: DataFrame | None = None, dim: int | None = None, select=default_analyzer, every: bool = False) -> Understanding:
        """The parts for a collection: its languages' profiles (lang, gram, r), its vocabulary, the curated expansions, hash vectors of dim.

        A correction looks up one term's variants in the vocabulary's table of deletes; the vocabulary itself stays distributed.
        """
        known = spelling.dictionary(postings.groupBy("term").agg(F.count("*").alias("df")))

        def correct(term: str) -> tuple[str, str | None]:
            r = spelling.corrections(known.sparkSession.createDataFrame([(term,)], "query string"), known).first()
            return r["action"], r["term"]

        return cls(language.Detector.of(profile) if profile is not None else None, select, correct, spelling.expansion(), (lambda t: words.embed(t, dim)) if dim else None, every)


def enforced(pieces: DataFrame, postings: DataFrame, docs: DataFrame, k: int = 10, every: bool = False, statistics: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of a table of parsed queries (parse.pieces_of) with all their conditions: a document has every
    required term (in its field), none of the excluded, every phrase in its body, and stands on one of the hosts. Terms of a field score in
    all fields but have to occur in theirs to count. every: all free terms have to occur."""
    p = pieces.where("term <> ''")
    held = postings.join(p.where("kind <> 'host'").select("term").distinct(), "term", "left_semi")
    there = F.lit(False)
    for f, k_ in parse.FIELD.items():
        there = there | ((F.col("field") == k_) & (F.col(f"tf_{f}") > 0))
    there = there | (F.col("field") == parse.ANY)
    # phrases retrieve on their words, and are checked on the bodies of what is found
    wanted = p.where("kind in ('term', 'other', 'required', 'phrase')").select("query_id", "term", "field").distinct()
    hits = wanted.join(held, "term").where(there).select("query_id", "doc_id", "term").distinct()
    weights = retrieve.posting_weights(held, docs, statistics)
    found = hits.join(weights, ["term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    must = p.where("kind = 'required'" + (" or kind = 'term'" if every else "")).select("query_id", "term", "field").distinct()
    number = must.groupBy("query_id").agg(F.count("*").alias("wanted"))
    has = must.join(held, "term").where(there).groupBy("query_id", "doc_id").agg(F.count("*").alias("has"))
    found = found.join(number, "query_id", "left").join(has, ["query_id", "doc_id"], "left").where("coalesce(has, 0) = coalesce(wanted, 0)")
    banned = p.where("kind = 'excluded'").select("query_id", "term", "field").distinct().join(held, "term").where(there).select("query_id", "doc_id").distinct()
    found = found.join(banned, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "score")
    hosts = p.where("kind = 'host'").groupBy("query_id").agg(F.collect_set("term").alias("hosts"))
    phrases = p.where("kind = 'phrase'").groupBy("query_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("w"))
    phrases = phrases.groupBy("query_id").agg(F.collect_set(F.concat(F.lit(" "), F.array_join("w.term", "  "), F.lit(" "))).alias("phrases"))
    asked = found.join(hosts, "query_id", "left").join(phrases, "query_id", "left")
    plain = asked.where("hosts is null and phrases is null").select("query_id", "doc_id", "score")
    text = F.concat(F.lit(" "), F.array_join(retrieve.tokens(docs["body"]), "  "), F.lit(" "))
    checked = asked.where("hosts is not null or phrases is not null").join(docs.select("doc_id", F.regexp_replace("host", r"^www\.", "").alias("host"), text.alias("t")), "doc_id")
    checked = checked.where(F.col("hosts").isNull() | F.array_contains("hosts", F.col("host"))).where(F.col("phrases").isNull() | F.forall("phrases", lambda x: F.contains(F.col("t"), x)))
    return retrieve.top(plain.unionByName(checked.select("query_id", "doc_id", "score")), k)
