"""Keyword phrases of a parsed question: sources, distinct order, MMR selection and subsumed words.

tokens: array of structs i, text, lemma, pos, dep, head, is_stop, is_punct, like_num; noun_chunks: array of (start, end).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import clean

# Words that never make a keyword.
QUESTION_WORDS = ("what", "why", "how", "when", "where", "which", "who", "whom", "whose")
LIGHT_VERBS = ("be", "do", "have", "use", "show", "make", "take", "give", "put")
OBJECTS = ("dobj", "obj", "pobj", "attr")


def _content(t: Column) -> Column:
    lemma = F.lower(t["lemma"])
    return ~t["is_stop"] & ~t["is_punct"] & ~t["like_num"] & ~lemma.isin(*QUESTION_WORDS) & (F.length(lemma) > 2)


def _lemma(t: Column) -> Column:
    return F.lower(t["lemma"])


def semantic_sources(tokens: Column, chunks: Column) -> Column:
    """Noun chunks, nouns, verbs, verb with object, adjacent pairs, in this order, cleaned and distinct."""
    nouns = F.transform(chunks, lambda c: F.array_join(F.transform(F.filter(F.slice(tokens, c["start"] + 1, c["end"] - c["start"]), _content), _lemma), " "))
    single = F.transform(F.filter(tokens, lambda t: t["pos"].isin("NOUN", "PROPN") & _content(t)), _lemma)
    is_verb = lambda t: (t["pos"] == "VERB") & ~_lemma(t).isin(*LIGHT_VERBS) & ~t["is_stop"]
    verbs = F.filter(tokens, is_verb)
    objects = F.flatten(F.transform(verbs, lambda v: F.transform(F.filter(tokens, lambda t: (t["head"] == v["i"]) & (t["i"] != v["i"]) & t["dep"].isin(*OBJECTS) & _content(t)), lambda t: F.concat(_lemma(v), F.lit(" "), _lemma(t)))))
    content = F.transform(F.filter(tokens, lambda t: ~t["is_stop"] & ~t["is_punct"] & ~t["like_num"]), _lemma)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(content) - 1, F.lit(0))), lambda i: (i + 1 < F.size(content)) & (F.length(F.get(content, i)) > 2) & (F.length(F.get(content, i + 1)) > 2))
    pairs = F.transform(places, lambda i: F.concat_ws(" ", F.get(content, i), F.get(content, i + 1)))
    return distinct_clean(F.concat(nouns, single, F.transform(verbs, _lemma), objects, pairs), "clean_question")


def surface_sources(tokens: Column, chunks: Column) -> Column:
    """The older form: surface noun chunks, adjectives, verb with object; hyphens vanish in cleaning."""
    said = lambda t: ~t["is_stop"] & ~t["is_punct"]
    nouns = F.transform(chunks, lambda c: F.lower(F.array_join(F.transform(F.filter(F.slice(tokens, c["start"] + 1, c["end"] - c["start"]), said), lambda t: t["text"]), " ")))
    adjectives = F.transform(F.filter(tokens, lambda t: (t["pos"] == "ADJ") & ~t["is_stop"]), lambda t: F.lower(t["text"]))
    verbs = F.filter(tokens, lambda t: (t["pos"] == "VERB") & ~t["is_stop"])
    objects = F.flatten(F.transform(verbs, lambda v: F.transform(F.filter(tokens, lambda t: (t["head"] == v["i"]) & (t["i"] != v["i"]) & t["dep"].isin("dobj", "attr", "pobj")), lambda t: F.lower(F.concat_ws(" ", v["lemma"], t["text"])))))
    return drop_subsumed(distinct_clean(F.concat(nouns, adjectives, objects), "clean_keyword"))


def distinct_clean(phrases: Column, cleaner: str) -> Column:
    return F.array_distinct(F.filter(F.transform(phrases, lambda p: clean(p, cleaner)), lambda p: p != ""))


def drop_subsumed(phrases: Column) -> Column:
    """Without single words that a longer phrase has."""
    inside = F.flatten(F.transform(F.filter(phrases, lambda p: F.contains(p, F.lit(" "))), lambda p: F.split(p, " ")))
    return F.array_distinct(F.filter(phrases, lambda p: F.contains(p, F.lit(" ")) | ~F.array_contains(inside, p)))


def mmr(phrases: Column, embeddings: Column, question: Column, k: int = 6, relevance: float = 0.8) -> Column:
    """Positions (from 0) of the phrases that maximal marginal relevance picks, in order of choice."""
    n = F.size(phrases)
    bonus = F.transform(phrases, lambda p: F.when(F.contains(p, F.lit(" ")), 0.03).otherwise(0.0))
    empty = F.array().cast("array<int>")
    # each candidate's greatest similarity to the chosen ones: a pick costs one dot product a candidate
    start = F.struct(empty.alias("chosen"), F.transform(phrases, lambda _: F.lit(None).cast("double")).alias("worst"))

    def select(near: Column) -> Column:
        def pick(acc: Column, _: Column) -> Column:
            score = lambda i: relevance * F.get(near, i) - (1 - relevance) * F.coalesce(F.get(acc["worst"], i), F.lit(0.0)) + F.get(bonus, i)
            left = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains(acc["chosen"], i))
            taken = lambda best: V.let(F.get(embeddings, -best["i"]), lambda v: F.struct(F.concat(acc["chosen"], F.array(-best["i"])).alias("chosen"), F.transform(acc["worst"], lambda w, i: F.greatest(w, V.dot(F.get(embeddings, i), v))).alias("worst")))
            return V.let(F.array_max(F.transform(left, lambda i: F.struct(score(i).alias("s"), (-i).alias("i")))), taken)

        return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(n, F.lit(1)))), start, pick, lambda acc: acc["chosen"])

    return F.when(n == 0, empty).otherwise(V.let(F.transform(embeddings, lambda e: V.dot(e, question)), select))
