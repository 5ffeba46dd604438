"""Splitting texts into arrays of units and packing them by ordered folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CHUNK, RETRIEVAL, apply, is_garbage_line, is_noise, strip
from .vectors import let


def _kept(parts: Column, clean: Callable[[Column], Column] = strip) -> Column:
    return F.filter(F.transform(parts, clean), lambda p: p != "")


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def n_words_collapsed(c: Column) -> Column:
    """``n_words`` of a text that isn't empty and whose white space is collapsed."""
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1


# The patterns that sentences, bullets and numbered items are cut at, here and below.
def sentences(c: Column, cleaned: bool = False) -> Column:
    """Cleaned sentences; common abbreviations lose their full stops first. ``cleaned`` says that white space is collapsed already, as ``CHUNK`` would."""
    t = c if cleaned else apply(c, CHUNK)
    for a, b in (("e.g.", "eg"), ("i.e.", "ie"), ("etc.", "etc")):
        t = F.replace(t, F.lit(a), F.lit(b))
    # one blank is all the white space there is, and it is tested before its neighbours
    return _kept(F.split(t, r" (?:(?<=[.!?] )(?=[A-Z0-9(\[])|(?<=\. )(?=\u2022))"), lambda p: F.trim(p))


def paper_sentences(c: Column) -> Column:
    return _kept(F.split(c, r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"))


def two_sentence_chunks(c: Column, min_chars: int = 8, cleaned: bool = False) -> Column:
    def paired(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i < F.size(s)))
        return F.filter(F.transform(firsts, lambda i: F.array_join(F.slice(s, i + 1, 2), " ")), lambda x: ~is_noise(x, min_chars))

    return let(sentences(c, cleaned), paired)


def lines(c: Column) -> Column:
    return _kept(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1), lambda x: apply(x, CHUNK))


def bullets_or_lines(c: Column) -> Column:
    return _kept(lines(F.replace(c, F.lit("\u2022"), F.lit("\n\u2022 "))), lambda x: apply(F.regexp_replace(x, r"(?U)^\s*[\u2022\-]\s*", ""), CHUNK))


def local_units(c: Column) -> Column:
    """Bullets, numbered items and sentences of three words or more; the whole text where none is left."""

    def cut(t: Column) -> Column:
        parts = F.filter(_kept(F.split(t, r"(?U)\u2022|\b\d+\.\s+|(?<=[.!?])\s+")), lambda p: n_words(p) >= 3)
        whole = lambda found: F.when(t == "", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(t)).otherwise(found)
        return let(parts, whole)

    return let(apply(F.coalesce(c, F.lit("")), RETRIEVAL), cut)


def pack(units: Column, weigh: Callable[[Column], Column], most: int, gap: int = 0) -> Column:
    """Greedy packing: a unit joins the last pack while weights and gaps stay within ``most``; an oversized unit is a pack
    of its own. Each unit is weighed once, and the fold keeps where packs start, not their texts."""
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("sum"), F.lit(0).alias("i"))

    def step(acc: Column, w: Column) -> Column:
        joined = acc["sum"] + gap + w
        opens = (acc["i"] == 0) | (joined > most)
        return F.struct(F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"), F.when(opens, w).otherwise(joined).alias("sum"), (acc["i"] + 1).alias("i"))

    def cut(u: Column) -> Column:
        def joined(starts: Column) -> Column:
            return F.transform(starts, lambda s, k: F.array_join(F.slice(u, s + 1, F.coalesce(F.get(starts, k + 1), F.size(u)) - s), " "))

        return let(F.aggregate(F.transform(u, lambda x: weigh(x).cast("int")), start, step, lambda acc: acc["starts"]), joined)

    return let(units, cut)


def pack_words(units: Column, max_words: int = 40) -> Column:
    return pack(units, n_words, max_words)


def pack_chars(units: Column, max_chars: int = 500, min_chars: int = 120) -> Column:
    """Packs up to ``max_chars``, then packs shorter than ``min_chars`` join the one before."""
    packs = pack(units, F.length, max_chars, gap=1)

    def step(acc: Column, x: Column) -> Column:
        tail = F.concat(F.element_at(acc, -1), F.lit(" "), x)
        return F.when((F.size(acc) > 0) & (F.length(x) < min_chars), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(tail))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(packs, F.array().cast("array<string>"), step)


def ocr_packs(raw_lines: Column, max_words: int = 28) -> Column:
    return pack_words(F.filter(_kept(raw_lines), lambda x: ~is_garbage_line(x)), max_words)


def ocr_packs_by_length(raw_lines: Column, max_words: int = 25, min_chars: int = 8) -> Column:
    """The older form: lines under ``min_chars`` go, whatever they hold."""
    return pack_words(F.filter(_kept(raw_lines, lambda x: apply(x, CHUNK)), lambda x: F.length(x) >= min_chars), max_words)
