"""Slide records: typed, trust-scored chunks, bibliographic references and the unified chunk list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import splitting as P
from ..functions.text import CHUNK, LONE_LETTERS_V2, apply, domain, first_url, is_noise, strip

# Trust, least characters and first order number of each field.
TRUST = {"title": 1.0, "body": 1.0, "ocr": 0.75, "desc": 0.6, "reference_title": 0.95, "reference_venue": 0.85, "reference_year": 0.8, "reference_url": 0.75, "reference_raw": 0.85}
DEFAULT_TRUST = 0.7
MIN_CHARS = {"title": 2, "body": 8, "ocr": 8, "desc": 12, "reference_title": 4, "reference_venue": 2, "reference_year": 4, "reference_url": 8, "reference_raw": 8}
FIRST = {"title": 0, "body": 100, "ocr": 200, "desc": 300, "reference": 400}
META = "struct<origin:array<double>,block_idx:int,source:string,domain:string>"
CHUNK_TYPE = f"struct<chunk_id:string,slide_id:int,field:string,text:string,`order`:int,trust:double,meta:{META}>"


def meta(origin: Column | None = None, block_idx: Column | None = None, source: str | None = None, host: Column | None = None) -> Column:
    none = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return F.struct(none(origin, "array<double>").alias("origin"), none(block_idx, "int").alias("block_idx"), F.lit(source).cast("string").alias("source"), none(host, "string").alias("domain"))


def chunk(slide: Column, field: str, text: Column, order: Column, sub: Column, about: Column | None = None) -> Column:
    return F.struct(
        F.concat_ws("_", slide.cast("string"), F.lit(field), sub.cast("string")).alias("chunk_id"), slide.cast("int").alias("slide_id"), F.lit(field).alias("field"),
        text.alias("text"), order.cast("int").alias("order"), F.lit(TRUST.get(field, DEFAULT_TRUST)).alias("trust"), (meta() if about is None else about).alias("meta"),
    ).cast(CHUNK_TYPE)


def _none() -> Column:
    return F.array().cast(f"array<{CHUNK_TYPE}>")


def title_chunks(slide: Column, title: Column) -> Column:
    made = lambda t: F.when(is_noise(t, MIN_CHARS["title"]), _none()).otherwise(F.array(chunk(slide, "title", t, F.lit(FIRST["title"]), F.lit(0))))
    return P.let(apply(F.coalesce(title, F.lit("")), CHUNK), made)


def _pieces(raw: Column) -> Column:
    """Pieces of a text whose white space is collapsed: without a bullet it is one line."""
    pairs = P.two_sentence_chunks(raw, MIN_CHARS["body"], cleaned=True)
    listed = P.let(P.bullets_or_lines(raw), lambda parts: F.when(F.size(parts) <= 1, pairs).otherwise(P.pack_words(parts, 40)))
    return F.when(F.contains(raw, F.lit("\u2022")), listed).otherwise(pairs)


def body_chunks(slide: Column, blocks: Column) -> Column:
    """Chunks of raw blocks (text, origin, block_idx): short blocks whole, long ones in pieces; numbered as kept."""
    raw = F.transform(blocks, lambda b: F.struct(apply(apply(F.coalesce(b["text"], F.lit("")), CHUNK), LONE_LETTERS_V2).alias("text"), b["origin"].alias("origin"), b["block_idx"].alias("block_idx")))
    sound = F.filter(raw, lambda b: ~is_noise(b["text"], MIN_CHARS["body"]))

    def cut(b: Column) -> Column:
        whole = P.n_words_collapsed(b["text"]) <= 40
        of = lambda t, source: F.struct(t.alias("text"), b["origin"].alias("origin"), b["block_idx"].alias("block_idx"), F.lit(source).alias("source"))
        parts = F.filter(_pieces(b["text"]), lambda p: ~is_noise(p, MIN_CHARS["body"]))
        return F.when(whole, F.array(of(b["text"], "text_block"))).otherwise(F.transform(parts, lambda p: of(p, "text_block_split")))

    def made(p: Column, i: Column) -> Column:
        about = F.struct(p["origin"].cast("array<double>").alias("origin"), p["block_idx"].cast("int").alias("block_idx"), p["source"].alias("source"), F.lit(None).cast("string").alias("domain"))
        return chunk(slide, "body", p["text"], i + FIRST["body"], i, about)

    return F.transform(F.flatten(F.transform(sound, cut)), made)


def body_chunks_from_text(slide: Column, text: Column) -> Column:
    """The fallback without blocks; numbers are those before short pieces go, which leaves gaps."""
    raw = apply(apply(F.coalesce(text, F.lit("")), CHUNK), LONE_LETTERS_V2)

    def made(t: Column) -> Column:
        listed = F.transform(_pieces(t), lambda p, i: chunk(slide, "body", p, i + FIRST["body"], i, meta(source="body_text_fallback")))
        return F.when(is_noise(t, MIN_CHARS["body"]), _none()).otherwise(F.filter(listed, lambda c: ~is_noise(c["text"], MIN_CHARS["body"])))

    return P.let(raw, made)


def ocr_chunks(slide: Column, lines: Column, by_length: bool = False) -> Column:
    packs = P.ocr_packs_by_length(lines) if by_length else P.ocr_packs(lines)
    return F.transform(packs, lambda p, i: chunk(slide, "ocr", p, i + FIRST["ocr"], i, meta(source="ocr_lines")))


def desc_chunks(slide: Column, text: Column) -> Column:
    def cut(t: Column) -> Column:
        kept = lambda parts: F.filter(F.transform(F.when(F.size(parts) == 0, F.array(t)).otherwise(parts), made), lambda c: ~is_noise(c["text"], MIN_CHARS["desc"]))
        return F.when(is_noise(t, MIN_CHARS["desc"]), _none()).otherwise(P.let(P.two_sentence_chunks(t, MIN_CHARS["desc"], cleaned=True), kept))

    made = lambda p, i: chunk(slide, "desc", p, i + FIRST["desc"], i, meta(source="slide_description"))
    return P.let(apply(F.coalesce(text, F.lit("")), CHUNK), cut)


def split_reference(ref: Column, marks: str = "[,.]") -> Column:
    """title, conference, year of "title, venue, 2017"; null with fewer parts or another ending."""
    parts = F.filter(F.transform(F.split(ref, marks), strip), lambda p: p != "")
    n = F.size(parts)
    year = F.get(parts, n - 1)
    made = F.struct(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), ", ").alias("title"), F.get(parts, n - 2).alias("conference"), F.try_to_number(year, F.lit("9999999999")).cast("int").alias("year"))
    return F.when((n >= 3) & year.rlike(r"^[+-]?[0-9]{1,10}$"), made)


def source_reference(text: Column) -> Column:
    """The first ``Source: ... 2017`` of a text that splits as a reference."""
    found = F.regexp_extract_all(text, F.lit(r"(?iU)Source:\s*(.*?\b\d{4})"), 1)
    parsed = F.transform(found, lambda r: split_reference(F.regexp_replace(strip(r), r"[ .]+$", "")))
    return F.get(F.filter(parsed, lambda p: p.isNotNull()), F.lit(0))


def reference_type(title: Column, url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) != "", "url").when(F.coalesce(title, F.lit("")) != "", "paper").otherwise("structured")


def detect_reference_type(ref: Column, raw: Column | None = None) -> Column:
    """The type of a reference record (url, title ...) or of a raw string: none, url, paper, structured, raw or unknown."""
    raw = F.lit(None).cast("string") if raw is None else raw
    of_raw = F.when(raw.rlike("https?://"), "url").otherwise("raw")
    return F.when(ref.isNotNull(), reference_type(ref["title"], ref["url"])).when(raw.isNotNull(), of_raw).otherwise("none")


def reference_from_parts(parsed: Column, raw: Column | None = None, url: Column | None = None) -> Column:
    """type, raw, title, venue, year, url of a parsed reference; raw is rebuilt where it is missing."""
    url = F.lit(None).cast("string") if url is None else url
    raw = F.lit(None).cast("string") if raw is None else raw

    def made(p: Column) -> Column:
        joined = F.nullif(F.concat_ws(", ", F.nullif(p["title"], F.lit("")), F.nullif(p["conference"], F.lit("")), F.nullif(p["year"], F.lit(0)).cast("string")), F.lit(""))
        return F.when(p.isNotNull(), F.struct(reference_type(p["title"], url).alias("type"), F.coalesce(raw, joined).alias("raw"), p["title"].alias("title"), p["conference"].alias("venue"), p["year"].alias("year"), url.alias("url")))

    return P.let(parsed, made)


def reference_from_text(ref: Column) -> Column:
    """A raw string as a reference: a url where it has one."""
    t = apply(ref, CHUNK)
    url = first_url(t)
    none = F.lit(None)
    return F.when(ref.isNotNull(), F.struct(F.when(url.isNotNull(), "url").otherwise("raw").alias("type"), t.alias("raw"), none.cast("string").alias("title"), none.cast("string").alias("venue"), none.cast("int").alias("year"), url.alias("url")))


def reference_chunks(slide: Column, ref: Column) -> Column:
    """Chunks of title, venue, year, url and raw text; a year has no letter and so never passes the noise rule."""
    parts = (("reference_title", ref["title"], None), ("reference_venue", ref["venue"], None), ("reference_year", ref["year"].cast("string"), None), ("reference_url", ref["url"], domain(ref["url"])), ("reference_raw", ref["raw"], None))
    listed = F.array(*[F.struct(F.lit(f).alias("field"), apply(t, CHUNK).alias("text"), F.lit(TRUST[f]).alias("trust"), (F.lit(None).cast("string") if d is None else d).alias("domain"), (t.isNotNull() & ~is_noise(t, MIN_CHARS[f])).alias("ok")) for f, t, d in parts])

    def made(p: Column, i: Column) -> Column:
        about = F.struct(F.lit(None).cast("array<double>").alias("origin"), F.lit(None).cast("int").alias("block_idx"), F.lit(None).cast("string").alias("source"), p["domain"].alias("domain"))
        return F.struct(F.concat_ws("_", slide.cast("string"), p["field"], i.cast("string")).alias("chunk_id"), slide.cast("int").alias("slide_id"), p["field"].alias("field"), p["text"].alias("text"), (i + FIRST["reference"]).alias("order"), p["trust"].alias("trust"), about.alias("meta")).cast(CHUNK_TYPE)

    return F.when(ref.isNull(), _none()).otherwise(F.transform(F.filter(listed, lambda p: p["ok"]), made))


def unified(*lists: Column) -> Column:
    """All chunks by order number; equal numbers keep the order of the lists."""
    tagged = F.transform(F.concat(*lists), lambda c, i: F.struct(c["order"].alias("o"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(tagged), lambda t: t["c"])


def slide_records(slides: DataFrame) -> DataFrame:
    """The full record from slide_id, title, body, blocks, ocr_lines, desc, reference (null where absent)."""
    s = F.col("slide_id")
    out = slides.select(
        "slide_id", F.coalesce("title", F.lit("")).alias("title_text"), F.coalesce("body", F.lit("")).alias("body_text"), F.array_join(F.coalesce("ocr_lines", F.array().cast("array<string>")), "\n").alias("ocr_text"), F.coalesce("desc", F.lit("")).alias("desc_text"), "reference",
        title_chunks(s, F.col("title")).alias("title_chunks"),
        F.when(F.size(F.coalesce("blocks", F.array().cast(slides.schema["blocks"].dataType))) > 0, body_chunks(s, F.col("blocks"))).otherwise(body_chunks_from_text(s, F.col("body"))).alias("body_chunks"),
        ocr_chunks(s, F.coalesce("ocr_lines", F.array().cast("array<string>"))).alias("ocr_chunks"), desc_chunks(s, F.col("desc")).alias("desc_chunks"), reference_chunks(s, F.col("reference")).alias("reference_chunks"),
    )
    out = out.withColumn("chunks", unified(*map(F.col, ("title_chunks", "body_chunks", "ocr_chunks", "desc_chunks", "reference_chunks"))))
    return out.withColumns({"title": F.col("title_text"), "body": F.col("body_text"), "imgtext": F.col("ocr_text")})


def chunk_counts(records: DataFrame) -> DataFrame:
    return records.select("slide_id", *[F.size(f"{f}_chunks").alias(f"n_{f}") for f in ("title", "body", "ocr", "desc", "reference")], F.size("chunks").alias("n_all"))
