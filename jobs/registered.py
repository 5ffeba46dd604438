"""The jobs as registered queries, each run twice into a new folder below spark.checkpoint.dir, with DuckDB SQL for their output."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.answer_questions import DIGITS, answer_questions, read_answers
from jobs.common import settings
from jobs.embed_chunks import embed_chunks
from lectern.functions import scoring as S
from lectern.functions import text as T
from lectern.operators.cache import generations
from lectern.plans import queries as Q


def _new_folder(spark: SparkSession, job: str) -> str:
    """Only a local session may go without a shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or f'{tempfile.gettempdir()}/checkpoints').rstrip('/')}/{job}-{uuid.uuid4().hex}"


def job1_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _new_folder(spark, "answers")
    for _ in range(2):
        answer_questions(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, settings("answer_questions"))
    return read_answers(spark, out)


def job2_embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _new_folder(spark, "vectors")
    for _ in range(2):
        embed_chunks(spark, f"{sf_dir}/documents.parquet", f"{out}/table", f"{out}/progress", settings("embed_chunks"))
    told = generations(spark, f"{out}/table")
    digest = F.aggregate(F.transform("emb", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return told.select("generation", "key", "text", "place", F.round(digest, 6).alias("digest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_answer_questions": job1_answer_questions, "job2_embed_chunks": job2_embed_chunks}

_A, _E = settings("answer_questions"), settings("embed_chunks")
_UNIT = "list_transform({0}, lambda x: x / greatest(sqrt(list_sum(list_transform({0}, lambda y: y * y))), 1e-12))"


def _vector(text: str) -> str:
    return f"(SELECT {_UNIT.format('l')} FROM (SELECT {Q.LETTERS.format(text)} AS l))"


def _marked(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN '[EMPTY]' ELSE {text} END"


_BODY = "CASE WHEN contains(t, chr(10)) THEN substr(t, instr(t, chr(10)) + 1) ELSE '' END"
_FIELDS = ("title", "body", "imgtext", "desc")
_COARSE = " + ".join(f"w_{f} * s_{f}" for f in _FIELDS)

ANSWERS = rf"""WITH q AS (SELECT item_id AS qid, question, {_vector(_marked('question'))} AS v, {', '.join(f'{Q._weight_sql(f)} AS w_{f}' for f in S.WEIGHTS)} FROM (SELECT item_id, coalesce(text, '') AS question FROM benchmark)),
d AS (SELECT doc_id + 1 AS page, lang, {Q._collapse_sql("string_split(t, chr(10))[1]")} AS title, {Q._collapse_sql(_BODY)} AS body FROM (SELECT doc_id, lang, replace(coalesce(text, ''), '-' || chr(10), '-') AS t FROM documents)),
p AS (SELECT page, lang, title, body, {_vector(_marked('title'))} AS v_title, {_vector(_marked('body'))} AS v_body, {_vector("'[EMPTY]'")} AS v_imgtext, {_vector("'[EMPTY]'")} AS v_desc FROM d),
u AS (SELECT page, t, list_filter({Q._kept_sql(Q.LOCAL)}, lambda x: {Q.IN_WORDS.format('x')} >= 3) AS u FROM (SELECT page, body AS t FROM d)),
w AS (SELECT page, CASE WHEN t = '' THEN [] WHEN len(u) = 0 THEN [t] ELSE u END AS w FROM u),
c AS (SELECT page, chunk_idx, text, {_vector('text')} AS v FROM (SELECT page, unnest(w) AS text, generate_subscripts(w, 1) AS chunk_idx FROM w)),
s AS (SELECT q.qid, p.page, {', '.join(f'list_dot_product(q.v, v_{f}) AS s_{f}' for f in _FIELDS)} FROM q, p),
k AS (SELECT s.*, q.* EXCLUDE (qid) FROM s JOIN q USING (qid) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round({_COARSE}, 12) DESC, page) <= {_A['candidates']}),
n AS (SELECT qid, page, max(list_dot_product(k.v, c.v)) AS best, arg_max(c.text, (list_dot_product(k.v, c.v), -chunk_idx)) AS content FROM k JOIN c USING (page) GROUP BY ALL),
t AS (SELECT k.*, coalesce(best, -1) AS best, coalesce(content, '') AS content, trim(title || ' ' || body || '  ') AS local, lang FROM k JOIN p USING (page) LEFT JOIN n USING (qid, page)),
f AS (SELECT *, round(w_chunk * best + {_COARSE} + w_lexical * ({Q.OVERLAP.format(k=Q.KEYWORDS, t='local')}) + {Q.NUMBER.format(t='local')} + {Q.PHRASE.format(t='local')}, {DIGITS}) AS confidence FROM t)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY confidence DESC, page)::INT AS rank, question, page AS slide_number, confidence, content, lang FROM f QUALIFY rank <= {_A['answers']}"""

_PAPER = Q._kept_sql(Q._cut_sql("t", "[.!?]", "[A-Z0-9]"))

CHUNKS = rf"""WITH c AS (SELECT doc_id, {T.sql("coalesce(text, '')", T.PDF_TEXT)} AS t FROM documents), u AS (SELECT doc_id, {_PAPER} AS u FROM c),
k AS (SELECT doc_id, string_split({Q._pack_sql('u', 'length({})', _E['max_chars'], 1)}, chr(1)) AS k FROM u),
p AS (SELECT doc_id, string_split(list_reduce(k, lambda a, x: a || CASE WHEN length(x) < {_E['min_chars']} THEN ' ' ELSE chr(1) END || x), chr(1)) AS p FROM k),
e AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS at_ FROM p), d AS (SELECT text, min(printf('%020d.%08d', doc_id, at_)) AS place FROM e WHERE text <> '' GROUP BY text), v AS (SELECT text, place, {Q.LETTERS.format('text')} AS v FROM d)
SELECT 0::BIGINT AS generation, sha256(text) AS key, text, place, {Q.DIGEST.format('v')} AS digest FROM v"""

ORACLES: dict[str, str] = {"job1_answer_questions": ANSWERS, "job2_embed_chunks": CHUNKS}
