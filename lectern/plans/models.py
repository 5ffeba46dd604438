"""Model boundaries. Encoders, parsers and readers are objects with one method on columns; the relational rest is native.

The libraries behind sentence encoders, parsers and character recognition are optional: an adapter says which it lacks.
"""

from __future__ import annotations

import difflib
import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

BATCH = 32


class MissingLibrary(RuntimeError):
    pass


def need(name: str) -> object:
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise MissingLibrary(f"this boundary needs the library {name}") from e


@pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; SQL has none."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def letters26(text: Column) -> Column:
    """A stand-in encoder in pure SQL: unit vectors of letter counts."""
    from ..functions.vectors import l2_normalize, let

    t = F.lower(F.coalesce(text, F.lit("")))
    counts = lambda x: F.array(*[(F.length(x) - F.length(F.replace(x, F.lit(chr(c)), F.lit("")))).cast("double") for c in range(97, 123)])
    return l2_normalize(let(t, counts))


def encoder(encode: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> Callable[[Column], Column]:
    """Any function on lists of texts as a column function, in batches; one instance a task."""

    @pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            said = texts.fillna("").tolist()
            yield pd.Series([list(map(float, v)) for i in range(0, len(said), batch) for v in encode(said[i : i + batch])], index=texts.index, dtype=object)

    return run


def transformer_encoder(model: str, pooled: bool = False) -> Callable[[Column], Column]:
    """Mean-pooled (or pooler output), L2-normalised sentence vectors of a transformer, loaded on first use in a task."""

    def encode(texts: list[str]) -> list[list[float]]:
        torch, tr = need("torch"), need("transformers")
        if model not in _models:
            _models[model] = tr.AutoTokenizer.from_pretrained(model), tr.AutoModel.from_pretrained(model).eval()
        tokenizer, net = _models[model]
        given = tokenizer(texts, padding=True, truncation=True, return_tensors="pt")
        with torch.no_grad():
            out = net(**given)
        mask = given["attention_mask"].unsqueeze(-1).float()
        v = out.pooler_output if pooled else (out.last_hidden_state * mask).sum(1) / mask.sum(1).clamp(min=1e-9)
        return torch.nn.functional.normalize(v, p=2, dim=1).tolist()

    return encoder(encode)


_models: dict[str, tuple] = {}

TOKENS = "array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,is_stop:boolean,is_punct:boolean,like_num:boolean>>"
PARSED = f"struct<tokens:{TOKENS},noun_chunks:array<struct<start:int,end:int>>>"


def parser(model: str = "en_core_web_sm") -> Callable[[Column], Column]:
    """Tokens and noun chunks of a sentence."""

    def run(texts: pd.Series) -> pd.DataFrame:
        nlp = _models.setdefault(model, need("spacy").load(model))
        docs = list(nlp.pipe(texts.fillna("")))
        tokens = [[{"i": t.i, "text": t.text, "lemma": t.lemma_, "pos": t.pos_, "dep": t.dep_, "head": t.head.i, "is_stop": t.is_stop, "is_punct": t.is_punct, "like_num": t.like_num} for t in d] for d in docs]
        return pd.DataFrame({"tokens": tokens, "noun_chunks": [[{"start": c.start, "end": c.end} for c in d.noun_chunks] for d in docs]})

    return pandas_udf(run, PARSED)


def lemmas(tokens: Column, content_only: bool = False) -> Column:
    kept = F.filter(tokens, lambda t: ~t["is_stop"] & ~t["is_punct"]) if content_only else tokens
    return F.array_join(F.transform(kept, lambda t: t["lemma"]), " ")


OCR_ITEMS = "array<struct<text:string,bbox:array<int>,x1:int,y1:int,x2:int,y2:int,cx:double,cy:double,seq:int>>"


def recognizer(recognize: Callable[[bytes], list[tuple[str, tuple[int, int, int, int]]]]) -> Callable[[Column], Column]:
    """Recognised items of an image: any function from bytes to texts with boxes."""

    def run(images: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "bbox": list(b), "x1": b[0], "y1": b[1], "x2": b[2], "y2": b[3], "cx": (b[0] + b[2]) / 2, "cy": (b[1] + b[3]) / 2, "seq": i} for i, (t, b) in enumerate(recognize(x))] for x in images], dtype=object)

    return pandas_udf(run, OCR_ITEMS)


def captioner(caption: Callable[[bytes, str], str]) -> Callable[[Column, Column], Column]:
    """Answers or captions of an image for a prompt."""

    def run(images: pd.Series, prompts: pd.Series) -> pd.Series:
        return pd.Series([caption(i, p) for i, p in zip(images, prompts, strict=True)])

    return pandas_udf(run, StringType())
