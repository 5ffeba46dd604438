"""Line deduplication by a deletion-neighbourhood join, in native DataFrame operations only.

Two lines are near copies when at most one edit lies between them: a unit replaced, inserted or deleted. Units are words
where both lines have ``LEAST_WORDS``, and characters where both have fewer words but ``LEAST_CHARS`` characters: one edit
is always a small part of a line. A line is dropped when an earlier line (by doc_id, then place in the document) is equal
or a near copy.

1. Equal lines collapse to their earliest place by a partial aggregate, so a line that a third of all documents share
   is one row a task before the shuffle.
2. Lines at one edit share their first or their last half unit by unit. A line whose halves nobody shares can't have
   a neighbour; only the others go on. This loses nothing and spares most of the deletion variants.
3. Each remaining line emits itself and all its variants with one unit deleted, as hashed keys. Equal variants at the
   same place are a replaced unit; a variant equal to a whole line is an inserted one. A key hands on its earliest
   line only, so no pairs within a group are made.
4. The edit distance of each line and the earlier line that its key found is verified on the units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, durable, let, settled

#: Part of the definition of near copies: one edit in so many words or, with fewer words, in so many characters.
LEAST_WORDS, LEAST_CHARS = 4, 12
#: Lines of more units are scanned in two steps, which keeps the work of a very long line in bounds.
SCAN = 256
#: Tells keys of characters from keys of words.
CHARS = 0x5DEECE66D1234567
#: Keys of at most so many candidate lines (16 MB) are broadcast, counted first; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Numbers of dropped lines that are broadcast at most (4 bytes each, 32 MB), of at most BROADCAST_ROWS documents.
BROADCAST_LINES = 8_000_000


def _cleaned(text: Column) -> Column:
    """A text whose lines are compared: lower case, runs of white space within a line as one space.

    The pattern matches only where something must change, which is rare.
    """
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", " ")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _placed(docs: DataFrame) -> DataFrame:
    """line, key (two 64-bit hashes) and spot, which orders lines by document and place, of each line with a word."""
    rows = docs.select("doc_id", F.posexplode(_lines(_cleaned(F.col("text")))).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line != ''")
    return rows.select("line", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("key"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no").alias("spot"))


def _n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _part(line: Column, k: Column) -> Column:
    """The first ``k`` words of a line, or the last ``-k``."""
    return F.call_function("substring_index", line, F.lit(" "), k)


def _halves(line: Column, n_words: Column, n_chars: Column) -> Column:
    """Keys of the first and last half of a line, for its own length and for one unit less; null for the shortest lines."""

    def of(length: Column, kind: str, part: Callable[[Column], Column]) -> list[Column]:
        head, tail = F.ceil(length / 2).cast("int"), F.floor(length / 2).cast("int")
        return [F.xxhash64(length, F.lit(kind + "head"), part(head)), F.xxhash64(length, F.lit(kind + "tail"), part(-tail))]

    def both(n: Column, kind: str, part: Callable[[Column], Column]) -> Column:
        return F.array(*of(n, kind, part), *of(n - 1, kind, part))

    by_chars = both(n_chars, "c", lambda k: F.when(k < 0, F.substring(line, k, -k)).otherwise(F.substring(line, F.lit(1), k)))
    return F.when(n_words >= LEAST_WORDS, both(n_words, "w", lambda k: _part(line, k))).when(n_chars >= LEAST_CHARS, by_chars)


def _units() -> Column:
    return F.when(F.col("by_words"), F.split("line", " ")).otherwise(F.split("line", ""))


def _running(h: Column, start: Column) -> Column:
    """XORs of ``start`` and the first 0, 1, 2 ... elements. A fold copies what it has at every step, so long arrays go in
    two steps. ``h`` is a stored column: it is named many times."""

    def fold(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(x))))

    step = F.ceil(F.sqrt(F.size(h))).cast("int")
    cut = F.transform(F.sequence(F.lit(1), F.size(h), step), lambda at: fold(F.slice(h, at, step), F.lit(0).cast("long")))

    def joined(parts: Column) -> Column:
        def moved(before: Column) -> Column:
            return F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: x.bitwiseXOR(F.get(before, i)))))

        return let(fold(F.transform(parts, lambda p: F.element_at(p, -1)), start), lambda before: F.concat(F.array(start), moved(before)))

    return F.when(F.size(h) <= SCAN, fold(h, start)).otherwise(let(cut, joined))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays differ by at most one replaced, inserted or deleted element."""
    same = lambda s, l: F.zip_with(s, l, lambda x, y: x.eqNullSafe(y))  # noqa: E731, E741
    replaced = F.size(F.filter(same(a, b), lambda x: ~x)) <= 1

    def inserted(s: Column, l: Column) -> Column:  # noqa: E741
        p = F.array_position(same(s, l), False).cast("int")
        return F.slice(l, p + 1, F.size(l)) == F.slice(s, p, F.size(l))

    return F.when(F.size(a) == F.size(b), replaced).when(F.size(a) + 1 == F.size(b), inserted(a, b)).when(F.size(b) + 1 == F.size(a), inserted(b, a)).otherwise(False)


def line_keys(docs: DataFrame) -> DataFrame:
    """key, spot and halves (null for the shortest lines) of each line with a word: what all steps but two need of the texts."""
    rows = _placed(docs).withColumn("words", _n_words(F.col("line")))
    rows = rows.withColumn("chars", F.when(F.col("words") < LEAST_WORDS, F.length("line")))
    return rows.select("key", "spot", _halves(F.col("line"), F.col("words"), F.col("chars")).alias("halves"))


def near_copies(docs: DataFrame, keys: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """key and spot of each distinct line that has an earlier line at one edit, and the ``other`` spot of that line."""
    halved = keys.select(F.explode("halves").alias("half"), F.col("key.a").alias("a"))
    # two different lines share a half: its smallest and largest line keys differ
    shared = durable(halved.groupBy("half").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low != high").select("half"))
    few = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    hits = durable(halved.join(few(shared), "half", "left_semi").select("a").distinct())
    chosen = _placed(docs).withColumn("a", F.col("key.a")).join(few(hits), "a", "left_semi")
    distinct = chosen.groupBy("key").agg(F.min("spot").alias("spot"), F.first("line").alias("line"))
    lines = durable(distinct.withColumn("by_words", _n_words(F.col("line")) >= LEAST_WORDS))

    # a line's key is the XOR of its units' hashes with their places; running XORs of the units before a deleted one and of
    # those after it, moved up by one place, give each variant's key without building it. Words and characters never meet.
    hashed = lambda moved: F.transform(_units(), lambda x, i: F.xxhash64(x, i - moved))
    start = F.when(F.col("by_words"), F.lit(0).cast("long")).otherwise(F.lit(CHARS))
    keyed = lines.select("spot", "by_words", hashed(0).alias("h"), hashed(1).alias("g")).select("spot", _running(F.col("h"), start).alias("p"), _running(F.col("g"), F.lit(0).cast("long")).alias("m"))
    n = F.size("p") - 1
    without = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("p", i).bitwiseXOR(F.get("m", n)).bitwiseXOR(F.get("m", i + 1)).alias("variant"), i.alias("at")))
    itself = F.array(F.struct(F.get("p", n).alias("variant"), F.lit(-1).alias("at")))
    variants = durable(keyed.select("spot", F.explode(F.concat(itself, without)).alias("v")).select("spot", "v.variant", "v.at"))
    replaced = variants.where("at >= 0").groupBy("variant", "at").agg(F.min("spot").alias("other"), F.count("*").alias("m")).where("m > 1").drop("m")
    pairs = variants.join(replaced, ["variant", "at"]).select("spot", "other")
    ends = variants.groupBy("variant").agg(F.min(F.when(F.col("at") < 0, F.col("spot"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("spot"))).alias("longer")).where("whole IS NOT NULL AND longer IS NOT NULL")
    pairs = pairs.unionByName(variants.join(ends, "variant").select("spot", F.when(F.col("at") < 0, F.col("longer")).otherwise(F.col("whole")).alias("other")))
    pairs = pairs.where(F.col("other") < F.col("spot")).distinct()
    units = lines.select("spot", "key", "by_words", _units().alias("w"))
    theirs = units.select(F.col("spot").alias("other"), F.col("by_words").alias("b2"), F.col("w").alias("w2"))
    proven = pairs.join(units, "spot").join(theirs, "other").where((F.col("by_words") == F.col("b2")) & one_edit(F.col("w"), F.col("w2")))
    return proven.groupBy("key", "spot").agg(F.min("other").alias("other"))


def dropped_lines(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id and line_no (from 0) of every line that an earlier one makes redundant."""
    all_keys = durable(line_keys(docs))
    near = settled(lambda: near_copies(docs, all_keys, broadcast_rows).select("key", F.lit(True).alias("near")))
    placed = all_keys.select("key", "spot")
    # of all lines only those that occur twice or have a near copy matter; one row a key and task leaves for the count
    keys = placed.groupBy("key").agg(F.min("spot").alias("first"), F.count("*").alias("n"))
    told = durable(keys.join(near, "key", "left").where("n > 1 OR near").select("key", "first", F.coalesce("near", F.lit(False)).alias("near")))
    gone = placed.join(told, "key").where("near OR spot != first")
    return gone.select("spot.doc_id", "spot.line_no")


def drop_repeated_lines(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` without redundant lines, all columns kept; a document that lost its last word goes.

    Lines without a word stay where they are, and null texts stay null. Rows of one doc_id count as one document:
    their lines at the same place are one place. Null doc_ids come last in the order. Documents that no line leaves are
    returned unchanged, and so are documents without words. Nothing in an extra column matters.
    """
    gone = settled(lambda: dropped_lines(docs, **options).groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_set("line_no")).alias("__gone")))
    size = gone.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("__gone")), F.lit(0)).alias("lines")).head()
    few = size["docs"] <= BROADCAST_ROWS and size["lines"] <= BROADCAST_LINES
    joined = docs.join(F.broadcast(gone) if few else gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["__id"]), "left")
    # the runs of lines between those that go: a walk over the sorted numbers, not a search a line
    gone_at = F.coalesce("__gone", F.array().cast("array<int>"))
    run = lambda x, e, k: let(F.when(k == 0, 0).otherwise(F.get(gone_at, k - 1) + 1), lambda s: F.slice(x, s + 1, F.greatest(e - s, F.lit(0))))
    left = let(_lines(F.col("text")), lambda x: F.flatten(F.transform(F.array_append(gone_at, F.size(x)), lambda e, k: run(x, e, k))))
    # rows without a word lose nothing, even if another row of their id does
    same = F.col("__gone").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    text = F.when(same, F.col("text")).otherwise(F.array_join(left, "\n"))
    cut = joined.withColumn("__text", text).where(same | F.col("__text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.select(*[F.col("__text").alias("text") if c == "text" else docs[c] for c in docs.columns])
