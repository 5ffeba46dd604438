"""Personal data in native expressions: generators propose spans, boosted trees choose among them.

Four base kinds (email, ip, card, phone) follow fixed rules and always stay. Beyond them, high-recall generators propose
candidates that may overlap: credentials, identity numbers, telephone numbers without a plus, dates of birth, account numbers, addresses
of version 6 and masked mail addresses. Format and context of each candidate are features; trees that were boosted on synthetic sentences, with a
threshold calibrated on held-out ones, select what is redacted. Everything over the documents is a narrow projection:
no shuffle, no Python.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost

BASE = ("email", "ip", "card", "phone")
#: The fixed patterns, written so that they can't run away: repeats are possessive where nothing could be given back, a
#: mail address starts where its run of characters does or the last match ended, and a card number is a whole run of
#: digits of its length.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LABEL = r"(?:token|secret|passw(?:or)?d|passwort|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)"
_CUE = r"(?:call|phone|tel|telefon|telefono|teléfono|téléphone|fax|mobile|mobil|handy|móvil|portable|whatsapp)"
_BORN = r"(?:born(?:\x20on)?|birth(?:\x20?day)?|date\x20of\x20birth|d\.?o\.?b\.?|geboren(?:\x20am)?|geburtsdatum|née?(?:\x20le)?|nacid[oa](?:\x20el)?)"
_PASS = r"(?:passport|reisepass|passeport|pasaporte)(?:\x20(?:no|nr|number|nummer|numéro|número)\.?)?"
#: Generators of the method, with more recall than precision. None has an upper length but account numbers and keys, whose format has one.
#: secret: labelled values, bearer tokens, tokens that their beginning gives away, key blocks. cued: what follows a word that announces a
#: telephone number, a date of birth or a passport. ipv6: at least four groups, or fewer with a double colon.
GENERATORS = {
    "secret": rf"(?i)(?<![\p{{L}}0-9])(?:[A-Za-z0-9]{{1,40}}+[_-]){{0,6}}{_LABEL}(?:[_-][A-Za-z0-9]++)*+[\x22']?[\x20\t]*+[:=][\x20\t]*+[\x22']?[^\s\x22',;]{{4,}}+|(?<![\p{{L}}0-9])bearer\x20++[A-Za-z0-9._~+/-]{{16,}}+=*+|(?-i:(?<![\p{{L}}0-9_])(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{20,}}+|sk-[A-Za-z0-9_-]{{20,}}+|xox[abprs]-[A-Za-z0-9-]{{10,}}+|eyJ[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+(?:\.[A-Za-z0-9_-]++)?)|-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----[^-]*+(?:-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----)?)",
    "number": r"(?<![0-9\p{L}+.])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,6}(?![0-9\p{L}]))++|(?<![0-9\p{L}])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[0-9]{1,3})?(?![0-9\p{L}])",
    "masked": r"(?i)(?:(?<![\p{L}0-9._-])|\G)[\p{L}0-9._-]++(?:\s?[(\[{]\s?at\s?[)\]}]\s?[\p{L}0-9.-]++(?:\s?[(\[{]\s?dot\s?[)\]}]\s?[\p{L}0-9]++)*+|\x20at\x20[\p{L}0-9-]++(?:\x20dot\x20[\p{L}0-9-]++){0,3}?\x20dot\x20(?:com|org|net|edu|info|io|de|fr|es|uk|eu)(?![\p{L}0-9]))",
    "cued": rf"(?i)(?<![\p{{L}}0-9])(?=\(?[A-Z]{{0,8}}[0-9])(?:(?<=(?<![\p{{L}}0-9]){_CUE}[.:]{{0,2}}\x20{{0,3}})\(?[0-9][0-9()\x20./-]{{4,}}[0-9]|(?<=(?<![\p{{L}}0-9]){_BORN}[.:]{{0,2}}\x20{{0,3}})[0-9]{{1,4}}[./-]\x20?[0-9]{{1,2}}[./-]\x20?[0-9]{{1,4}}|(?<=(?<![\p{{L}}0-9]){_PASS}[.:]{{0,2}}\x20{{0,3}})[A-Z0-9]{{6,9}}(?![\p{{L}}0-9]))",
    "ipv6": r"(?i)(?<![0-9a-z:.])(?:[0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}(?![0-9a-z:])|(?<![0-9a-z:.])(?:[0-9a-f]{1,4}:){1,6}:(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?(?![0-9a-z:])",
}
KINDS = (*BASE, *GENERATORS)
#: What a text has if a pattern matches in it, as cheap searches: characters of it, one of each group, and lower-case words, one of them.
NEEDED: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "email": (("@",), ()), "ip": (("0123456789", "."), ()), "card": (("0123456789",), ()), "phone": (("+", "0123456789"), ()), "number": (("0123456789",), ()), "ipv6": ((":",), ()),
    "secret": ((), ("token", "secret", "passw", "pwd", "passphrase", "key", "credential", "bearer", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyj")), "masked": ((), ("(", "[", "{", " dot ")),
    "cued": (("0123456789",), ("call", "phone", "tel", "fax", "mobil", "handy", "móvil", "portable", "whatsapp", "born", "birth", "dob", "d.o", "do.b", "gebor", "geburt", "né", "nacid", "pass", "pasaporte")),
}
#: Characters before a candidate that are its context.
BEFORE = 40
#: Words that announce personal data, and words that announce harmless numbers.
CUES = r"(?i)(?:phone|tel|fax|mobile|call|ssn|social|passport|iban|account|konto|compte|cuenta|card|licen[cs]e|tax|dob|birth|born|mail|contact|reach|write|login|user)"
HARMLESS = r"(?i)(?:version|isbn|issn|order|page|pages|chapter|figure|table|section|score|price|total|year|between|ratio|build|part|item|release|rfc|example)"
FEATURES = ("length", "digits", "letters", "capitals", "marks", "groups", "cue", "harmless", "quoted", "secret", "number", "masked", "cued", "ipv6", "account", "ssn", "local")
TRAIN_ROWS = 2400


def _spans(text: Column, hits: Column, pattern: str) -> Column:
    """start, end, hit of each match, from the lengths of matches and of the text between them."""
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("i"), empty.alias("got"))

    def step(acc: Column, hit: Column) -> Column:
        at = acc["pos"] + F.length(F.get(gaps, acc["i"]))
        end = at + F.length(hit)
        return F.struct(end.alias("pos"), (acc["i"] + 1).alias("i"), F.concat(acc["got"], F.array(F.struct(at.alias("start"), end.alias("end"), hit.alias("hit")))).alias("got"))

    return F.when(F.size(hits) == 0, empty).otherwise(F.aggregate(hits, start, step, lambda acc: acc["got"]))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(hit, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == "card":
        n = F.length(_digits(hit))
        return (n >= 16) & (n <= 19) & _luhn(_digits(hit))
    if kind == "phone":
        n = F.length(_digits(hit))
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _proposed(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add __s_<kind>: the spans of each pattern in the text column. A pattern runs where the text has what it needs; matches first, so that texts without any are done."""
    rows = rows.withColumns({"__low": F.lower(text), "__digits": F.regexp_like(text, F.lit("[0-9]"))})

    def may(k: str) -> Column:
        groups, needles = NEEDED[k]
        has = [F.col("__digits") if g == "0123456789" else F.contains(F.col(text), F.lit(g)) for g in groups]
        if needles:
            has.append(reduce(or_, (F.contains(F.col("__low"), F.lit(w)) for w in needles)))
        return reduce(and_, has)

    rows = rows.withColumns({f"__h_{k}": F.when(may(k), F.regexp_extract_all(text, F.lit(p), 0)).otherwise(F.array().cast("array<string>")) for k, p in patterns.items()})
    return rows.withColumns({f"__s_{k}": _spans(F.col(text), F.col(f"__h_{k}"), p) for k, p in patterns.items()}).drop("__low", "__digits", *[f"__h_{k}" for k in patterns])


def _features(text: Column, span: Column, kind: str) -> list[Column]:
    """The features of a candidate, in the order of FEATURES."""
    hit, start = span["hit"], span["start"]
    before = F.substring(text, F.greatest(start - BEFORE, F.lit(0)) + 1, F.least(start, F.lit(BEFORE)))
    count = lambda p: F.length(hit) - F.length(F.regexp_replace(hit, p, ""))
    yes = lambda c: F.when(c, 1).otherwise(0)
    like = lambda p: yes(F.regexp_like(hit, F.lit(p)))
    made = [
        F.length(hit), count(r"[0-9]"), count(r"\p{L}"), count(r"\p{Lu}"), count(r"[^\p{L}0-9\s]"), F.size(F.split(hit, r"[\x20./-]")),
        yes(F.regexp_like(before, F.lit(CUES))), yes(F.regexp_like(before, F.lit(HARMLESS))), like(r"[\x22']"),
        *[F.lit(int(kind == k)) for k in GENERATORS], like(r"^[A-Z]{2}[0-9]{2}"), like(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), like(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"),
    ]
    return [c.cast("double") for c in made]


def _sentences(n: int, seed: int) -> list[tuple[str, int]]:
    """Synthetic sentences with one candidate each, and whether it is personal data."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    token = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    personal = (
        lambda: f"{rng.choice(['token', 'secret', 'api_key', 'password'])} {rng.choice('=:')} \"{token(rng.choice([16, 24, 32, 40]))}\"",
        lambda: f"password: {word()}{d(3)}{rng.choice('!@#$')}",
        lambda: f"{rng.choice(['ssn', 'social security number', word()])} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{rng.choice(['call', 'phone', 'tel', 'reach us at', word()])} ({d(3)}) {d(3)}-{d(4)}",
        lambda: f"{rng.choice(['mobile', 'fax', word()])} {d(3)}-{d(3)}-{d(4)}",
        lambda: f"{rng.choice(['iban', 'account', word()])} {rng.choice(['DE', 'FR', 'ES'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{rng.choice(['client', 'db', 'my'])}_{rng.choice(['secret', 'password', 'token'])}{rng.choice(['', '_key', '_2'])} {rng.choice(['=', ':'])} {token(rng.choice([8, 20, 40]))}",
        lambda: f"{rng.choice(['password', 'pwd', 'passwort'])}={word()}{d(rng.choice([1, 2, 3]))}",
        lambda: f"{rng.choice(['Bearer', 'bearer'])} {token(rng.choice([20, 40]))}",
        lambda: rng.choice([f"AKIA{token(16).upper()}", f"ghp_{token(36)}", f"sk-{token(32)}", f"eyJ{token(20)}.{token(40)}.{token(30)}"]),
        lambda: f"-----BEGIN RSA PRIVATE KEY-----{token(64)}-----END RSA PRIVATE KEY-----",
        lambda: f"{rng.choice(['call', 'tel.', 'phone:', 'fax', 'handy'])} 0{d(rng.choice([2, 3]))}{rng.choice(['', ' ', '/', ' / '])}{d(rng.choice([6, 7, 8]))}",
        lambda: f"{rng.choice(['tel', 'mobile', 'portable'])} {' '.join(d(2) for _ in range(5))}",
        lambda: f"{rng.choice(['born', 'dob:', 'date of birth', 'geboren am'])} {rng.randint(1, 28)}{rng.choice('./-')}{rng.randint(1, 12)}{rng.choice('./-')}{rng.randint(1930, 2012)}",
        lambda: f"{rng.choice(['passport', 'passport no.', 'reisepass'])} {rng.choice('CFGHJKL')}{d(8)}",
        lambda: ":".join(token(4) for _ in range(8)),
        lambda: f"{token(4)}:{token(3)}::{token(4)}",
        lambda: f"{word()} [at] {word()} [dot] com",
        lambda: f"{word()} at {word()} dot {rng.choice(['com', 'org', 'de'])}",
        lambda: f"{word()}.{word()}(at){word()}.org",
    )
    harmless = (
        lambda: f"{rng.choice(['token', 'secret', 'password'])}: {word()}",
        lambda: f"the {rng.choice(['token', 'secret'])} = {word()} of {word()}",
        lambda: f"{rng.choice(['version', 'release', 'section', word()])} {d(2)}.{d(2)}",
        lambda: f"{rng.choice(['pages', 'between', 'score', word()])} {d(3)}-{d(3)}",
        lambda: f"{rng.choice(['order', 'item', 'isbn', 'part'])} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{rng.choice(['price', 'total', word()])} {d(3)} {d(3)}",
        lambda: f"{rng.choice(['figure', 'year', word()])} {d(4)}/{d(2)}/{d(2)}",
        lambda: f"{word()} (at) {word()} and {word()}",
        lambda: f"{rng.choice(['score', 'ratio', word()])} {rng.randint(1, 9)}:{rng.randint(1, 9)}:{rng.randint(1, 9)}:{rng.randint(1, 9)}",
        lambda: f"{rng.choice(['year', word()])} {d(2)}.{d(2)}.{d(4)}",
        lambda: f"{rng.choice(['version', 'build', word()])} {d(2)}.{d(2)}.{d(2)}",
    )
    out = []
    for i in range(n):
        label = i % 2
        lead = " ".join(word() for _ in range(rng.randint(2, 8)))
        out.append((f"{lead} {rng.choice(personal if label else harmless)()} {word()} {word()}", label))
    return out


_fitted: dict[int, tuple[boost.Boosted, float]] = {}


def selector(spark: SparkSession, train_rows: int = TRAIN_ROWS) -> tuple[boost.Boosted, float]:
    """Trees and margin threshold. Features of the synthetic sentences are made by the same native expressions."""
    if train_rows not in _fitted:
        sentences = _sentences(train_rows, 11)
        made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"t": t, "y": y} for t, y in sentences])), "array<struct<t string, y int>>")).alias("r")).select("r.t", "r.y")
        spans = _proposed(made, "t", GENERATORS)
        featured = lambda k: lambda s: F.array(*_features(F.col("t"), s, k))
        every = F.concat(*[F.transform(f"__s_{k}", featured(k)) for k in GENERATORS])
        got = spans.select("t", "y", F.explode(every).alias("x")).orderBy("t", "x").collect()
        x, y = np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], float)
        part = np.arange(len(x)) % 3
        model = boost.fit(x[part < 2], y[part < 2], trees=24, depth=3, rate=0.3, n_bins=16)
        held_x, held_y = x[part == 2], y[part == 2]
        model.calibrate(held_x, held_y)
        # the least margin from which on the calibrated chance is nine in ten
        sure = model.lows[model.chances >= 0.9]
        _fitted[train_rows] = model, float(sure.min()) if len(sure) else float("inf")
    return _fitted[train_rows]


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and __spans: array of (kind, start, end, hit), in order of kind and start.

    Positions are code points, ends exclusive. Null texts count as empty and have no spans. Rows are judged alone, so
    repeats, ties and other columns don't matter. Spans of the method may overlap those of the base kinds; a candidate
    inside a base span is dropped as already covered.
    """
    model, threshold = selector(docs.sparkSession)
    rows = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    rows = _proposed(rows, "__text", PATTERNS | GENERATORS)
    name = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"))
    valid = lambda k: lambda s: _valid(k, s["hit"])
    base = [F.transform(F.filter(f"__s_{k}", valid(k)), name(k)) for k in BASE]
    rows = rows.withColumn("__base", F.concat(*base))

    def stays(k: str) -> Callable[[Column], Column]:
        def judge(s: Column) -> Column:
            x = _features(F.col("__text"), s, k)
            covered = F.exists("__base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
            return ~covered & (model.margin_column(lambda i: x[i]) >= threshold)

        return judge

    chosen = [F.transform(F.filter(f"__s_{k}", stays(k)), name(k)) for k in GENERATORS]
    return rows.withColumn("__spans", F.concat("__base", *chosen)).drop("__text", *[f"__s_{k}" for k in KINDS])


def redact(docs: DataFrame, text: str = "text", mask: str = "<{}>") -> DataFrame:
    """``docs`` with every span replaced by its kind. Overlapping spans are merged under the first one's kind."""
    found = find_personal_data(docs, text)
    by_place = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    whole = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    masked = lambda kind: F.concat(F.lit(mask.split("{}")[0]), kind, F.lit(mask.split("{}")[-1]))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["pos"]
        fresh = F.concat(acc["out"], F.substring(whole, acc["pos"] + 1, s["start"] - acc["pos"]), masked(s["kind"]))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(inside, acc["out"]).otherwise(fresh).alias("out"))

    clean = F.aggregate(by_place, start, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["pos"] + 1, F.length(whole))))
    return found.withColumn("__clean", F.when(F.col(text).isNotNull(), clean)).select(*[F.col("__clean").alias(text) if c == text else F.col(c) for c in docs.columns])
