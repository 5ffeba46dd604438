"""Functions against plain Python on texts that the driver's tables lack."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import scoring, splitting, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("c")).head()["c"]


@pytest.mark.parametrize("name,said,wanted", [
    ("fix_ocr_noise", "so it didn't end", "so it did not't end"), ("fix_ocr_noise", "the canticle", "the cannoticle"), ("fix_ocr_noise", "so Lets", "soLet's"),
    ("dedupe_phrases", "a b a b c c d", "a b c c d"), ("dedupe_phrases", "x y x y x y", "x y x y"), ("clean_keyword", "self-attention", "selfattention"),
    ("clean_question", "self-attention?", "self-attention"), ("fix_urls", "http:// a . b /c", "http://a.b/c"), ("remove_isolated_v1", "a big X", "big"),
    ("remove_isolated_v2", "a b big X", "a big X"), ("page_numbers", "a\n 12 \nb", "a\n\nb"), ("clean_whitespace", "  a   b ", "a b"),
    ("remove_chinese", "a表b", "ab"), ("normalize_to_ascii", "éﬁ ’x", "efi x"), ("title_key", " A - b ", "a  b"), ("safe_filename", 'a/b:c', "a_b_c"),
    ("expand_bullets", "nPre lAct", " • Pre  • Act"), ("separate_sentences", "oneTwo.three", "one Two. three"), ("clean_pdf", "learn-\ning a\nb\n\n\nc", "learning a b\n\nc"),
    ("slide_artifacts", "12 a1 AI Weekly", " a1 "), ("source_noise", "x Source:y", "x Source: y"), ("split_into_lines", "a\r\n- b Source: c", "a\n• b\nSource: c"),
])
def test_cleaners(spark, name, said, wanted):
    assert one(spark, text.clean(F.lit(said), name)) == wanted


def test_quotes_are_lost_in_v1_only(spark):
    # version 1 drops the lone letter after the quote and folds to ASCII, so the quote is gone before it can be mapped
    assert one(spark, text.clean(F.lit("it doesn’t"), "clean_page_v1")) == "it does not"
    assert one(spark, text.clean(F.lit("it isn’t"), "clean_page_v1")) == "it isn"
    assert one(spark, text.clean(F.lit("it isn’t"), "clean_page_v2")) == "it isn't"


def test_splitters(spark):
    assert one(spark, splitting.sentences(F.lit("See e.g. this. Next one! (third) x"))) == ["See eg this.", "Next one!", "(third) x"]
    assert one(spark, splitting.two_sentence_chunks(F.lit("First one here. Second one. Third is long."))) == ["First one here. Second one.", "Third is long."]
    assert one(spark, splitting.local_units(F.lit("a b•c d e 1. f g h"))) == ["c d e", "f g h"]
    assert one(spark, splitting.local_units(F.lit("a b"))) == ["a b"]
    assert one(spark, splitting.local_units(F.lit(None).cast("string"))) == []
    assert one(spark, splitting.bullets_or_lines(F.lit("x • y\n- z"))) == ["x", "y", "z"]


def packed(units, fits):
    out = []
    for u in units:
        if out and fits(f"{out[-1]} {u}"):
            out[-1] += f" {u}"
        else:
            out.append(u)
    return out


def test_packing_against_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text", splitting.pack_words(splitting.lines(F.col("text"))).alias("w"), splitting.lines(F.col("text")).alias("l"), splitting.paper_sentences(F.col("text")).alias("s"), splitting.pack_chars(splitting.paper_sentences(F.col("text"))).alias("c"))
    for r in docs.collect():
        assert r["w"] == packed(r["l"], lambda t: len(t.split()) <= 40)
        assert r["s"] == [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", r["text"]) if s.strip()]
        merged = []
        for p in packed(r["s"], lambda t: len(t) <= 500):
            if merged and len(p) < 120:
                merged[-1] += " " + p
            else:
                merged.append(p)
        assert r["c"] == merged


def test_intent_fold_squashes_earlier_ones(spark):
    w = one(spark, vectors.intent_fold(F.array(*[F.lit(0.3)] * 18)))
    assert abs(w[-1] - 0.525) < 0.01 and abs(sum(w) - 1) < 1e-9
    assert all(abs(x - 1 / 18) < 1e-9 for x in one(spark, vectors.softmax(F.array(*[F.lit(3.0)] * 18))))


def test_weights_last_rule_wins(spark):
    w = scoring.question_weights(F.lit("How many are shared, which paper?"))
    assert (one(spark, w["chunk"]), one(spark, w["title"]), one(spark, w["lexical"])) == (1.35, 1.2, 0.2)


def test_zero_vector(spark):
    z, o = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.cosine(z, o)) == 0.0
    assert one(spark, vectors.tile_starts(F.lit(10), F.lit(4), F.lit(3))) == [0, 3, 6]
    assert one(spark, vectors.tile_starts(F.lit(11), F.lit(4), F.lit(3))) == [0, 3, 6, 7]
