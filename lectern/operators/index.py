"""From slides and questions to what the rankers take: indexed pages and chunks, description vectors, keywords.

``encode`` is a column function from texts to vectors (see ``plans.models``), native or Arrow-batched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.splitting import local_units
from ..functions.text import RETRIEVAL, apply, null_sentinel, or_empty_mark
from .phrases import drop_subsumed, mmr, semantic_sources

Encode = Callable[[Column], Column]
FIELDS = ("title", "body", "imgtext", "desc")


def index_pages(slides: DataFrame, encode: Encode, keep: tuple[str, ...] = ()) -> DataFrame:
    """page, the four fields cleaned, and a vector of each, from slide_key (counted from 0) and the fields; columns named in ``keep`` come along.

    Missing and empty fields are empty texts; their vectors are those of the mark [EMPTY].
    """
    cleaned = slides.select((F.col("slide_key").cast("long") + 1).alias("page"), *[apply(F.coalesce(f, F.lit("")), RETRIEVAL).alias(f) for f in FIELDS], *keep)
    return cleaned.withColumns({f"{f}_emb": encode(or_empty_mark(F.col(f))) for f in FIELDS})


def index_chunks(slides: DataFrame, encode: Encode, keep: tuple[str, ...] = ()) -> DataFrame:
    """page, chunk_idx, text, chunk_emb and ``keep``: the local units of body, then of recognised text. A page without units has no row."""
    units = F.concat(*[local_units(apply(F.coalesce(f, F.lit("")), RETRIEVAL)) for f in ("body", "imgtext")])
    made = slides.select((F.col("slide_key").cast("long") + 1).alias("page"), F.posexplode(units).alias("chunk_idx", "text"), *keep)
    return made.withColumn("chunk_emb", encode(F.col("text")))


def description_vectors(slides: DataFrame, active: tuple[str, ...], encode: Encode) -> DataFrame:
    """slide_id, qtype, text, emb of every usable description among the active types of ``qa_descs``."""
    told = slides.select("slide_id", F.explode("qa_descs").alias("qtype", "text")).where(F.col("qtype").isin(*active))
    usable = told.withColumn("text", null_sentinel(F.col("text"))).where(F.col("text").isNotNull())
    return usable.withColumn("emb", encode(F.col("text")))


def semantic_keywords(questions: DataFrame, encode: Encode, k: int = 6, relevance: float = 0.8) -> DataFrame:
    """qid, keywords of parsed questions (qid, question, tokens, noun_chunks): candidates, selection, subsumed words dropped.

    A question without a candidate has no keyword.
    """
    asked = questions.select("qid", encode(F.col("question")).alias("q_emb"), semantic_sources(F.col("tokens"), F.col("noun_chunks")).alias("phrases"))
    each = asked.select("qid", F.posexplode("phrases").alias("pos", "phrase")).withColumn("emb", encode(F.col("phrase")))
    listed = each.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "phrase", "emb"))).alias("c"))
    met = asked.select("qid", "q_emb").join(listed, "qid", "left")
    picked = F.transform(mmr(F.col("p"), F.col("e"), F.col("q_emb"), k, relevance), lambda i: F.get(F.col("p"), i))
    named = met.withColumns({"p": F.transform("c", lambda s: s["phrase"]), "e": F.transform("c", lambda s: s["emb"])})
    return named.select("qid", F.when(F.col("c").isNull(), F.array().cast("array<string>")).otherwise(drop_subsumed(picked)).alias("keywords"))


def first_questions(questions: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` questions by number; fewer, if there are no more."""
    return questions.where(F.col("qnum") < n)
