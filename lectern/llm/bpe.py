"""Byte-level BPE encoding and decoding by segment trees over adjacent pair ranks.

Every piece of text that the pre-tokeniser yields is encoded with a segment tree whose leaves hold the ranks of its
adjacent token pairs; the root is the leftmost lowest-rank merge, and a merge touches a logarithmic number of nodes.
The trees of all pieces of about one length that are new to a worker advance in lockstep as NumPy arrays, so one step merges
one pair in each; where they are few, as very long runs are, each goes through its tree alone.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import caches, keep_only, small_batches, tidied

#: The split before merges of byte-level BPE (a published constant).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 40
#: Pieces that a worker remembers; beyond it the memory is dropped and filled anew.
REMEMBER = 300_000
#: Tree nodes advanced together.
LOCKSTEP_NODES = 1 << 18
#: Fewer pieces of one width than this are encoded one by one: a step in lockstep costs as much as so many of theirs.
LOCKSTEP_ROWS = 32


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def refuse_others(doc: dict) -> None:
    """Raises ValueError for vocabulary files that ask for more than plain byte-level BPE: their ids would differ."""
    before, model = doc.get("pre_tokenizer") or {}, doc["model"]
    odd = {
        "normalizer": doc.get("normalizer") is not None,
        "pre_tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True),
        "decoder": (doc.get("decoder") or {}).get("type") != "ByteLevel",
        "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": any(t.get(k) for t in doc.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word")),
    }
    if found := [k for k, bad in odd.items() if bad]:
        raise ValueError(f"not a plain byte-level vocabulary: {found}")


class SegmentTreeBPE:
    """Encoder and decoder for one vocabulary file in the JSON format of public byte-level tokenisers."""

    def __init__(self, spec: str) -> None:
        doc = json.loads(spec)
        refuse_others(doc)
        vocab = doc["model"]["vocab"]
        alphabet = byte_alphabet()
        of_char = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in doc.get("added_tokens") or []}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(of_char[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c in alphabet], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in doc["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        key, keep = np.unique(key[order], return_index=True)
        self.pair_key, self.pair_rank, self.pair_made = key, order[keep].astype(np.int64), made[order][keep]
        self.keys, self.ranks, self.made, self.low = (array("q", x.astype(np.int64).tobytes()) for x in (self.pair_key, self.pair_rank, self.pair_made, self.first))
        self.pattern = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memory: dict[str, tuple[str, int, bytes]] = {}

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged token of each pair; NONE where the vocabulary has no such merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], NONE), self.pair_made[at]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each non-empty piece."""
        out: list[list[int]] = [[] for _ in pieces]
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_width.setdefault(max(1, (len(p) - 1).bit_length()), []).append(i)
        for bits, members in by_width.items():
            step = max(1, LOCKSTEP_NODES >> bits)
            if min(len(members), step) < LOCKSTEP_ROWS:
                for i in members:
                    out[i] = self._alone(pieces[i])
                continue
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._lockstep([pieces[i] for i in part], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _alone(self, piece: bytes) -> list[int]:
        """The same tree for one piece, node by node; a point update ends where a minimum stays as it was."""
        keys, ranks, made, low = self.keys, self.ranks, self.made, self.low
        n = len(piece)
        width = 1 << max(0, n - 1).bit_length()
        none = NONE * width
        token = [low[b] for b in piece]
        tree = [none] * (2 * width)

        def place(i: int, j: int) -> tuple[int, int]:
            """Leaf of the pair of the tokens at i and j, and the token that it makes."""
            key = token[i] << 32 | token[j]
            at = bisect_left(keys, key)
            return (ranks[at] * width + i, made[at]) if at < len(keys) and keys[at] == key else (none, -1)

        def put(i: int, value: int) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                least = min(value, tree[node ^ 1])
                node >>= 1
                if tree[node] == least:
                    return
                tree[node] = value = least

        for i in range(n - 1):
            tree[width + i] = place(i, i + 1)[0]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < none:
            at = tree[1] % width
            gone = after[at]
            token[at], token[gone] = place(at, gone)[1], -1
            after[at] = beyond = after[gone]
            put(gone, none)
            if beyond < n:
                before[beyond] = at
            put(at, place(at, beyond)[0] if beyond < n else none)
            if (ahead := before[at]) >= 0:
                put(ahead, place(ahead, at)[0])
        return [t for t in token if t >= 0]

    def _lockstep(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """One tree a row: nodes 1 .. 2 * width - 1, leaves from ``width`` on. A node is rank * width + position."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        column = np.arange(width)
        token = np.where(column < size[:, None], self.first[raw], -1)
        after = np.where(column + 1 < size[:, None], column + 1, width) * np.ones((n, 1), np.int64)
        before = np.broadcast_to(column - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE * width, np.int64)
        rank, _ = self._find(token[:, :-1], token[:, 1:])
        tree[:, width : 2 * width - 1] = rank * width + column[:-1]
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        row = np.arange(n)
        while True:
            row = row[tree[row, 1] < NONE * width]
            if not len(row):
                break
            at = tree[row, 1] % width
            gone = after[row, at]
            _, made = self._find(token[row, at], token[row, gone])
            token[row, at] = made
            token[row, gone] = -1
            beyond = after[row, gone]
            after[row, at] = beyond
            has = beyond < width
            before[row[has], beyond[has]] = at[has]
            self._put(tree, row, gone, np.full(len(row), NONE * width), width)
            following = np.where(has, token[row, np.minimum(beyond, width - 1)], -1)
            rank, _ = self._find(made, following)
            self._put(tree, row, at, np.where(rank < NONE, rank * width + at, NONE * width), width)
            ahead = before[row, at]
            has = ahead >= 0
            rank, _ = self._find(token[row[has], ahead[has]], made[has])
            self._put(tree, row[has], ahead[has], np.where(rank < NONE, rank * width + ahead[has], NONE * width), width)
        alive = token >= 0
        flat, ends = token[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def _put(tree: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        node = at + width
        tree[row, node] = value
        node = node >> 1
        for _ in range(width.bit_length() - 1):
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node = node >> 1

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out

    def learn(self, texts_pieces: Iterable[list[str]]) -> None:
        """Encode the pieces that this worker has not met yet."""
        if len(self.memory) > REMEMBER:
            self.memory.clear()
        new = list({p for ps in texts_pieces for p in ps if p not in self.memory})
        ids = self.encode_pieces([b"" if p in self.special else p.encode("utf-8") for p in new])
        for p, x in zip(new, ids, strict=True):
            x = [self.special[p]] if p in self.special else x
            self.memory[p] = (",".join(map(str, x)), len(x), self.decode_bytes(x))

    def encode(self, text: str) -> list[int]:
        ps = self.pieces(text)
        self.learn([ps])
        return [int(i) for p in ps for i in self.memory[p][0].split(",")]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, SegmentTreeBPE] = {}
caches["bpe"] = _loaded.clear

#: Bytes of text encoded together.
BATCH_BYTES = 1 << 20


def encode_documents(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text with the vocabulary file at the driver's path ``vocabulary``.

    Returns the ``keep`` columns, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, and with
    ``with_ids`` the ids themselves. Null text is encoded as empty: no tokens. Repeated rows are encoded each; other
    columns are ignored. Special tokens that occur in a text become their own ids. Rows never leave their partition.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    # parsed once, here: workers get the arrays, whose size the vocabulary bounds
    shipped, mark = spark.sparkContext.broadcast(SegmentTreeBPE(spec)), hashlib.sha256(spec.encode()).hexdigest()
    source = small_batches(docs).select(*keep, docs["text"].alias("__text"))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in source.dtypes[:-1]], "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("bpe")
        if mark not in _loaded:
            _loaded.clear()
            _loaded[mark] = shipped.value
        bpe = _loaded[mark]
        for whole in batches:
            # texts become Python strings a slice at a time: an Arrow batch of long texts is large already
            texts = whole.column(whole.num_columns - 1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            start = 0
            while start < len(sizes):
                stop, size = start, 0
                while stop < len(sizes) and (stop == start or size + sizes[stop] <= BATCH_BYTES):
                    size += sizes[stop]
                    stop += 1
                cut = [bpe.pieces(t or "") for t in texts.slice(start, stop - start).to_pylist()]
                bpe.learn(cut)
                get = bpe.memory.__getitem__
                n, ids_sha, text_sha, lists = [], [], [], []
                for ps in cut:
                    got = [get(p) for p in ps]
                    n.append(sum(g[1] for g in got))
                    joined = ",".join([g[0] for g in got])
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    # decoding replaces invalid UTF-8, as a public decoder does
                    text_sha.append(hashlib.sha256(b"".join([g[2] for g in got]).decode("utf-8", "replace").encode()).hexdigest())
                    if with_ids:
                        lists.append(np.array(joined.split(",") if joined else [], np.int32))
                kept = [whole.column(i).slice(start, stop - start) for i in range(whole.num_columns - 1)]
                made = [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                if with_ids:
                    made.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
                start = stop

    return source.mapInArrow(tidied(run), schema)
