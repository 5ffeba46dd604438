"""Text cleaning as declared steps, rendered to Spark columns and, where it can say the same, to DuckDB SQL.

A cleaner is a tuple of steps: ("sub", pattern, replacement), ("lines", pattern, replacement) with ^ and $ at line
breaks, ("swap", old, new) for literals, and ("strip",), ("lower",), ("ascii",). Declaring them once keeps both
renderings in step and lets cleaners compose by concatenation. Patterns are Unicode-aware in Spark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

Step = tuple[str, ...]
Steps = tuple[Step, ...]


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What the compatibility decomposition leaves of each character in ASCII: one character, or several. Most leave nothing."""
    left = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in (*range(0x80, 0xD800), *range(0xE000, 0x110000)) if unicodedata.decomposition(chr(c))}
    return {c: t for c, t in left.items() if len(t) == 1}, {c: t for c, t in left.items() if len(t) > 1}


def _class(chars: Iterable[str]) -> str:
    """Characters as the ranges of a character class. A class tries its members one by one, so a run must be one of them."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


def ascii_fold(text: Column) -> Column:
    """NFKD, then ASCII only: a translation of characters that leave one, then of those that leave several; others go.

    A decomposition doesn't depend on the neighbours, and reordered marks aren't ASCII. Hangul decomposes to letters outside ASCII.
    Most letters are ASCII and most others leave nothing, so a letter is first tested for ASCII and only others meet the large class;
    runs of ASCII stay whole where single characters are spelt out.
    """
    single, several = _folds()
    gone = rf"(?:(?![\x00-\x7F])[^{_class([*single, *several])}])+"
    told = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    pieces = lambda t: F.split(t, r"(?![\x{DC00}-\x{DFFF}])(?:(?<=[^\x00-\x7F])|(?=[^\x00-\x7F]))")
    spelt = lambda t: F.array_join(F.transform(pieces(t), lambda c: F.when(F.octet_length(c) == F.length(c), c).otherwise(F.try_element_at(told, c))), "")
    only_ascii = lambda t: F.length(t) == F.octet_length(t)
    turned = lambda t: let(F.translate(t, "".join(single), "".join(single.values())), lambda u: F.when(only_ascii(u), u).otherwise(spelt(u)))
    kept = lambda t: let(F.regexp_replace(t, gone, ""), lambda u: F.when(only_ascii(u), u).otherwise(turned(u)))
    return let(text, lambda t: F.when(only_ascii(t), t).when(t.isNotNull(), kept(t)))


#: Unicode white space, as the pattern class has it.
SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


#: Patterns as equal ones that fail sooner: a word isn't given back letter by letter.
SOONER: dict[str, str] = {r"(?<!\S)(\S+) (\S+) \1 \2(?!\S)": r"(?<!\S)(\S++) (\S++) \1 \2(?!\S)"}
#: What a text must hold, one of these at least, for a pattern to match; a plain search finds that much sooner.
NEEDS: dict[str, tuple[str, ...]] = {
    r"(https?://)\s+": ("://",), r"([(\[])\s+": ("(", "["), r"\s+([)\]])": (")", "]"), r"\.{2,}": ("..",), r"-{2,}": ("--",),
    r"\(\s*/\s*\)": ("(",), r"\(\s*\)": ("(",), r"\bSource:\s*": ("Source:",), r"\s+Source:\s+": ("Source:",),
}


def _where(c: Column, literals: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """``change`` of texts that hold one of the literals, others as they are."""
    return let(c, lambda t: F.when(reduce(lambda x, y: x | y, [F.contains(t, F.lit(n)) for n in literals]), change(t)).otherwise(t))


def _unless_ascii(c: Column, change: Callable[[Column], Column]) -> Column:
    return let(c, lambda t: F.when(F.length(t) == F.octet_length(t), t).otherwise(change(t)))


def apply(c: Column, steps: Steps) -> Column:
    """The steps as one column expression; null stays null.

    Neighbouring swaps of single characters are one translation, white space is rewritten only where it isn't one blank
    already, and patterns are Unicode-aware only while the text can hold other than ASCII. Once white space is collapsed, blanks are all that
    is left of it: later steps bring no other in, so that only two blanks have to be collapsed again.
    """
    wide = "U"
    blanks = False
    i = 0
    # a white space that becomes another is collapsed with it
    spaces = lambda s: s[0] == "swap" and s[1] and s[2] and not (s[1] + s[2]).strip(SPACE)
    collapse = ("sub", r"\s+", " ")
    while i < len(steps):
        ahead = i
        while ahead < len(steps) and spaces(steps[ahead]):
            ahead += 1
        i = ahead if ahead < len(steps) and steps[ahead] == collapse else i
        kind, *a = steps[i]
        i += 1
        wide = "U" if not all(map(str.isascii, a[1:])) else wide
        if (kind, *a) == collapse:
            if blanks:
                c = _where(c, ("  ",), lambda t: F.regexp_replace(t, " {2,}", " "))
            else:
                c = F.regexp_replace(c, rf"(?{wide})[\s&&[^\x20]]\s*|\x20\s+" if wide else r"[\t\n\x0B\f\r]\s*|\x20\s+", " ")
            blanks = True
            continue
        blanks = blanks and (len(a) < 2 or not any(x in SPACE.replace(" ", "") for x in a[1]))
        if kind in ("sub", "lines"):
            flags = wide + ("md" if kind == "lines" else "")
            change = lambda t, pattern=(f"(?{flags})" if flags else "") + SOONER.get(a[0], a[0]), to=re.sub(r"\\(\d)", r"$\1", a[1]): F.regexp_replace(t, pattern, to)
            c = _where(c, NEEDS[a[0]], change) if a[0] in NEEDS else change(c)
        elif kind == "swap":
            run = [a]
            single = lambda s: len(s[0]) == 1 and len(s[1]) <= 1
            while single(a) and i < len(steps) and steps[i][0] == "swap" and single(steps[i][1:]) and not {steps[i][1]} & {y for x in run for y in x}:
                run.append(list(steps[i][1:]))
                i += 1
            wide = "U" if not all(b.isascii() for _, b in run) else wide
            blanks = blanks and not any(b and b in SPACE.replace(" ", "") for _, b in run)
            if len(run) == 1:
                c = _where(c, (a[0],), lambda t, old=a[0], new=a[1]: F.replace(t, F.lit(old), F.lit(new)))
            else:
                run.sort(key=lambda x: x[1] == "")  # what translate has no counterpart for goes
                turned = lambda t, run=run: F.translate(t, "".join(x[0] for x in run), "".join(x[1] for x in run))
                c = turned(c) if any(x[0].isascii() for x in run) else _unless_ascii(c, turned)
        elif kind == "strip" and blanks:
            c = F.trim(c)
        else:
            c = {"strip": strip, "lower": F.lower, "ascii": ascii_fold}[kind](c)
            wide = "" if kind == "ascii" else wide
    return c


#: Characters of words, as the Unicode-aware word boundary has them.
IN_WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"
_FROM, _TO = rf"(^|[^{IN_WORD}])", rf"($|[^{IN_WORD}])"
#: Patterns with look-arounds or boundaries as RE2 patterns that take the neighbours and give them back. Neighbours that two
#: matches share need a second pass.
RE2: dict[str, tuple[str, str, int]] = {
    r"\b[A-Za-z]\b": (f"{_FROM}[A-Za-z]{_TO}", r"\1 \2", 2),
    r"\b[b-hj-z]\b": (f"{_FROM}[b-hj-z]{_TO}", r"\1 \2", 2),
    r"\bn(?=[A-Z])": (f"{_FROM}n([A-Z])", "\\1 \u2022 \\2", 1),
    r"\bl(?=[A-Z])": (f"{_FROM}l([A-Z])", "\\1 \u2022 \\2", 1),
    r"(?<=[a-z0-9\)])(?=[A-Z])": (r"([a-z0-9\)])([A-Z])", r"\1 \2", 1),
    r"(?<=[.:;,])(?=[A-Za-z])": (r"([.:;,])([A-Za-z])", r"\1 \2", 1),
    r"\bSource:\s*": (rf"{_FROM}Source:\s*", r"\1 Source: ", 1),
    r"[^\w\s.,:;()\-/%]": (rf"[^{IN_WORD}{SPACE}.,:;()\-/%]", "", 1),
    r"\b\d+\b": (rf"{_FROM}\p{{Nd}}+{_TO}", r"\1\2", 2),
    r"(\w)-\n(\w)": (rf"([{IN_WORD}])-\n([{IN_WORD}])", r"\1\2", 1),
    r"(?<!\n)\n(?!\n)": (r"(^|[^\n])\n($|[^\n])", r"\1 \2", 2),
}


def _once_sql(words: str) -> str:
    """``PHRASES`` as a fold over words: the second of two equal pairs goes, and what stands before can't be part of another match."""
    last = "string_split(string_split(a || ' ' || x, chr(2))[-1], ' ')"
    twice = f"len({last}) > 4 AND {last}[-4] = {last}[-2] AND {last}[-3] = x"
    return f"substr(replace(list_reduce(string_split({words}, ' '), lambda a, x: CASE WHEN {twice} THEN left(a, length(a) - length({last}[-2]) - 1) || chr(2) ELSE a || ' ' || x END, ''), chr(2), ''), 2)"


def sql(expression: str, steps: Steps) -> str:
    """The steps as a DuckDB expression. Back-references have none but that of repeated phrases."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for kind, *a in steps:
        if (kind, *a) == REPEATED:
            expression = _once_sql(expression)
        elif kind == "sub" and a[0] in RE2:
            pattern, to, times = RE2[a[0]]
            for _ in range(times):
                expression = f"regexp_replace({expression}, {quote(pattern)}, {quote(to)}, 'g')"
        elif kind in ("sub", "lines"):
            if re.search(r"\(\?[=!<]|\\[1-9]", a[0]):
                raise ValueError(f"no such pattern in RE2: {a[0]}")
            expression = f"regexp_replace({expression}, {quote(('(?m)' if kind == 'lines' else '') + a[0])}, {quote(a[1])}, 'g')"
        elif kind == "swap":
            expression = f"replace({expression}, {quote(a[0])}, {quote(a[1])})"
        elif kind == "strip":
            expression = rf"regexp_replace({expression}, '^\s+|\s+$', '', 'g')"
        elif kind == "lower":
            expression = f"lower({expression})"
        else:
            expression = f"regexp_replace(strip_accents({expression}), '[^\\x00-\\x7F]', '', 'g')"
    return expression


# Characters and their plain forms.
PLAIN = (("\u00a0", " "), ("\u200b", ""), ("\ufeff", ""), ("\u2019", "'"), ("\u2018", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "-"), ("\u2014", "-"), ("\u2217", "*"))
# Contractions that recognised text loses its apostrophe in; the order matters.
CONTRACTIONS = (
    (" Lets", "Let's"), (" doesnt", " does not"), (" doesn't", " does not"), (" didn", " did not"), (" didn't", " did not"), (" doesn", " does not"),
    (" cant", " cannot"), (" can't", " cannot"), (" shouldnt", " should not"), (" shouldn", " should not"), (" haven't", " have not"), (" havent", " have not"),
)

# The patterns of all cleaning steps.
COLLAPSE: Steps = (("sub", r"\s+", " "), ("strip",))
UNICODE_V1: Steps = tuple(("swap", a, b) for a, b in PLAIN)
UNICODE_V2: Steps = (*UNICODE_V1, ("swap", "\u2022", " \u2022 "))
TO_ASCII: Steps = (("ascii",), *COLLAPSE)
LONE_LETTERS_V1: Steps = (("sub", r"\b[A-Za-z]\b", " "), *COLLAPSE)
LONE_LETTERS_V2: Steps = (("sub", r"\b[b-hj-z]\b", " "), *COLLAPSE)
URLS: Steps = (("sub", r"\s+", " "), ("sub", r"(https?://)\s+", r"\1"), ("sub", r"\s+([/.?=&_-])\s*", r"\1"))
BULLETS: Steps = (("sub", r"\bn(?=[A-Z])", " \u2022 "), ("sub", r"\bl(?=[A-Z])", " \u2022 "))
MERGED_TITLE: Steps = (("sub", r"(?<=[a-z0-9\)])(?=[A-Z])", " "),)
MERGED_SENTENCES: Steps = (*MERGED_TITLE, ("sub", r"(?<=[.:;,])(?=[A-Za-z])", " "))
OCR_NOISE: Steps = (
    ("sub", r"\s+([,.;:?!])", r"\1"), ("sub", r"([(\[])\s+", r"\1"), ("sub", r"\s+([)\]])", r"\1"), ("sub", r"\.{2,}", "."), ("sub", r"-{2,}", "-"),
    *(("swap", a, b) for a, b in CONTRACTIONS), ("sub", r"\(\s*/\s*\)", ""), ("sub", r"\(\s*\)", ""),
)
SOURCE_MARK: Steps = (("sub", r"\bSource:\s*", " Source: "), ("sub", r"\s+Source:\s+", " Source: "))
LINES: Steps = (("swap", "\r\n", "\n"), ("swap", "\r", "\n"), ("lines", r"^\s*-\s+", "\u2022 "), ("sub", r"\s+Source:\s+", "\nSource: "), ("strip",))
SYMBOLS: Steps = (("sub", r"[^\w\s.,:;()\-/%]", ""), ("sub", r"\.{2,}", "."), ("sub", r"\s[A-Za-z]\s", ""))
ARTIFACTS: Steps = (("sub", r"\b\d+\b", ""), ("sub", "AI Weekly", ""))
NO_CHINESE: Steps = (("sub", "[\u4e00-\u9fff]", ""),)
LOWER: Steps = (("lower",),)
PAGE_NUMBERS: Steps = (("lines", r"^\s*\d+\s*$", ""),)
TRAILING_NUMBERS: Steps = (("lines", r"\s+\d+$", ""),)
BROKEN_WORDS: Steps = (("sub", r"([A-Za-z]+)\s+([A-Z][a-z]+)", r"\1\2"), ("swap", "Neur IPS", "NeurIPS"))
REPEATED: Step = ("sub", r"(?<!\S)(\S+) (\S+) \1 \2(?!\S)", r"\1 \2")
PHRASES: Steps = (*COLLAPSE, REPEATED)
CHUNK: Steps = (("swap", "\r\n", "\n"), ("swap", "\r", "\n"), ("swap", "\t", " "), *COLLAPSE)
RETRIEVAL: Steps = (("swap", "\n", " "), *COLLAPSE)
QUESTION: Steps = (("sub", r"[^a-zA-Z0-9\s\-]", " "), *COLLAPSE, ("lower",))
KEYWORD: Steps = (("sub", r"[^a-zA-Z0-9\s]", ""), *COLLAPSE, ("lower",))
TITLE_KEY: Steps = (("lower",), ("strip",), ("sub", r"\s+", " "), ("sub", r"[^a-z0-9\s]", ""))
FILENAME: Steps = (("sub", r'[\\/*?:"<>|]', "_"), *COLLAPSE)
PDF_TEXT: Steps = (("sub", r"(\w)-\n(\w)", r"\1\2"), ("sub", r"(?<!\n)\n(?!\n)", " "), ("sub", r"\n{2,}", "\n\n"), ("sub", r"[ \t]+", " "), ("strip",))
PAGE_V1: Steps = (*NO_CHINESE, *PAGE_NUMBERS, *LONE_LETTERS_V1, *TO_ASCII, *UNICODE_V1, *URLS, *OCR_NOISE, *SOURCE_MARK, *PHRASES, *COLLAPSE)
PAGE_V2: Steps = (*NO_CHINESE, *PAGE_NUMBERS, *UNICODE_V2, *TO_ASCII, *URLS, *OCR_NOISE, *SOURCE_MARK, *PHRASES, *COLLAPSE)
TITLE_V2: Steps = (*UNICODE_V2, *TO_ASCII, *OCR_NOISE, *COLLAPSE)
BODY_V1: Steps = PAGE_V1[len(NO_CHINESE) :]
BODY_V2: Steps = PAGE_V2[len(NO_CHINESE) :]

CLEANERS: dict[str, Steps] = {
    "normalize_unicode_v1": UNICODE_V1, "normalize_unicode_v2": UNICODE_V2, "normalize_to_ascii": TO_ASCII, "remove_isolated_v1": LONE_LETTERS_V1,
    "remove_isolated_v2": LONE_LETTERS_V2, "fix_urls": URLS, "expand_bullets": BULLETS, "separate_sentences": MERGED_SENTENCES, "separate_title": MERGED_TITLE,
    "fix_ocr_noise": OCR_NOISE, "source_noise": SOURCE_MARK, "clean_whitespace": COLLAPSE, "split_into_lines": LINES, "remove_noise": SYMBOLS,
    "slide_artifacts": ARTIFACTS, "remove_chinese": NO_CHINESE, "normalize_case": LOWER, "page_numbers": PAGE_NUMBERS, "trailing_numbers": TRAILING_NUMBERS,
    "broken_words": BROKEN_WORDS, "dedupe_phrases": PHRASES, "clean_chunk": CHUNK, "clean_retrieval": RETRIEVAL, "clean_question": QUESTION,
    "clean_keyword": KEYWORD, "title_key": TITLE_KEY, "safe_filename": FILENAME, "clean_pdf": PDF_TEXT, "clean_page_v1": PAGE_V1, "clean_page_v2": PAGE_V2,
}


def clean(c: Column, name: str) -> Column:
    return apply(c, CLEANERS[name])


def title_and_body(c: Column) -> tuple[Column, Column]:
    """First line as the title with collapsed spaces, the rest as the body; a hyphen at a line end joins."""
    parts = F.split(F.replace(c, F.lit("-\n"), F.lit("-")), "\n", 2)
    return apply(F.get(parts, F.lit(0)), COLLAPSE), F.coalesce(strip(F.get(parts, F.lit(1))), F.lit(""))


def clean_slide(c: Column, version: int) -> tuple[Column, Column]:
    """Title and body of a slide. Version 1 folds to ASCII before it maps quotes, and so loses them; 2 keeps them."""
    title, body = title_and_body(apply(c, NO_CHINESE))
    return (title, apply(body, BODY_V1)) if version == 1 else (apply(title, TITLE_V2), apply(body, BODY_V2))


def merge_broken_titles(c: Column) -> Column:
    """Lines that start with a hyphen continue the line before."""
    lines = F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")
    joined = F.aggregate(lines, F.array().cast("array<string>"), lambda acc, x: F.when(~x.startswith("-"), F.concat(acc, F.array(x))).when(F.size(acc) == 0, F.array(F.concat(F.lit(" "), strip(F.regexp_replace(x, "^-+", ""))))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), strip(F.regexp_replace(x, "^-+", "")))))))
    return F.array_join(joined, "\n")


def overlap_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9\-]+"), 0)


# Words that carry no meaning in a question.
STOPWORDS = ("the", "a", "an", "of", "to", "and", "in", "is", "are", "was", "were", "that", "this", "what", "which", "when", "why", "how", "does", "do", "for", "with", "on", "by", "from", "it", "as", "be", "into", "at", "or", "if", "their", "they", "them", "can", "used", "use")


def question_keywords(c: Column) -> Column:
    return F.filter(overlap_tokens(c), lambda t: ~t.isin(*STOPWORDS) & (F.length(t) > 2))


def first_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?U)https?://\S+", 0), F.lit(""))


def domain(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), F.lit(""))


def null_sentinel(c: Column) -> Column:
    """NULL for blank text and for none, null and n/a in any case."""
    t = strip(c)
    return F.when(~F.lower(t).isin("", "none", "null", "n/a"), t)


def or_empty_mark(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("[EMPTY]")).otherwise(c)


def is_noise(c: Column, min_chars: int = 8) -> Column:
    """Too short or without a letter."""
    t = F.coalesce(strip(c), F.lit(""))
    return (F.length(t) < min_chars) | ~t.rlike(r"\p{L}")


def is_garbage_line(c: Column) -> Column:
    """Shorter than 6, under 35 % letters, or without three ASCII letters in a row."""
    t = strip(c)
    return (F.length(t) < 6) | (F.length(F.regexp_replace(t, r"\P{L}+", "")) / F.greatest(F.length(t), F.lit(1)) < 0.35) | ~t.rlike("[A-Za-z]{3,}")


def is_low_value(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\s+", "")) < 8
