"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding. A token sequence is the BPE encoding of its bytes exactly if each two neighbours are the encoding of their
concatenation, so every prefix of a piece has one last token. The transducer reads a byte at a time. Its state is the set of places where
a token that covers the next byte may start, each with the tokens up to it; a token is emitted once all places agree on
it, so the lookahead is the longest token at most. States and transitions are made when first met and kept in a bounded
table.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

RANKS = "byte_bpe_50k.tiktoken"
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PUNCTUATION, _LETTERS = "!-/:-@\\[-`{-~", "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Cuts a text only where every match of PATTERN ends: before a single blank, after a run of white space, between a letter or digit and punctuation.
CHUNK = re.compile(f" ?[{_LETTERS}]+(?![^{_PUNCTUATION}{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


class Vocabulary:
    """Ranks of a byte-level BPE and the test of whether two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.longest = max(map(len, ranks))
        self.prefixes = {b[:k] for b in ranks for k in range(1, len(b))}
        self._pairs: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes) -> list[int]:
        """The definition: join the adjacent pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether [left, right] is the encoding of its bytes; left -1 stands for the start of a piece."""
        key = (left + 1) << 32 | right
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            a = self.bytes_of[left] if left >= 0 else b""
            ok = self._pairs[key] = self.merge(a + self.bytes_of[right]) == ([left, right] if left >= 0 else [right])
        return ok


class Transducer:
    """A state holds every place where a later token may start: (bytes since then, token before it, tokens not yet emitted)."""

    def __init__(self, vocabulary: Vocabulary, most_states: int = 300_000) -> None:
        self.v = vocabulary
        self.most = most_states
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._state(((b"", -1, ()),))

    def _state(self, places: tuple) -> int:
        n = self.ids.get(places)
        if n is None:
            n = self.ids[places] = len(self.states)
            self.states.append(places)
        return n

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        ranks, prefixes, fits, b = self.v.ranks, self.v.prefixes, self.v.fits, bytes((byte,))
        token, chain, places = -1, (), []
        for held, before, said in self.states[state]:
            held += b
            if token < 0 and (t := ranks.get(held)) is not None and fits(before, t):
                token, chain = t, (*said, t)
            if held in prefixes:
                places.append((held, before, said))
        if token < 0:
            raise ValueError("the vocabulary lacks a byte")
        # what all places have in common is settled
        n = min((len(p[2]) for p in places), default=len(chain))
        k = 0
        while k < n and all(p[2][k] == chain[k] for p in places):
            k += 1
        if k:
            places = [(held, before, said[k:]) for held, before, said in places]
        return self._state((*places, (b"", token, chain[k:]))), chain[:k]

    def encode(self, piece: bytes) -> list[int]:
        if len(self.next) > self.most:
            self.reset()
        state, out, nxt = self.start, [], self.next
        for byte in piece:
            key = state << 8 | byte
            got = nxt.get(key)
            if got is None:
                got = nxt[key] = self._step(state, byte)
            state, emitted = got
            if emitted:
                out += emitted
        out += self.states[state][-1][2]
        return out


class Utf8Stream:
    """Decodes ids block by block; bytes of an unfinished character wait for the next block. Malformed bytes become U+FFFD at the end of their run."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self._bytes = vocabulary.bytes_of.__getitem__
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self._machine.decode(b"".join(map(self._bytes, ids)), last)


class ChunkCache(dict):
    """The ids of a chunk as little-endian 32-bit words; filled on demand, emptied at a bound."""

    def __init__(self, encode, most: int = 600_000) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[chunk] = np.array(self.encode(chunk), "<u4").tobytes()
        return ids


class Encoder:
    def __init__(self, path: str) -> None:
        self.v = Vocabulary.load(path)
        self.fst = Transducer(self.v)
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.cache = ChunkCache(self._chunk)

    def _chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces.findall(chunk):
            out += self.fst.encode(piece.encode())
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.cache.__getitem__, CHUNK.findall(text))), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _Decimal(dict):
    def __missing__(self, i: int) -> str:
        s = self[i] = str(i)
        return s


BLOCK = 1 << 16


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text; null is taken as empty (no tokens).

    Encodes, then decodes the ids block by block. Texts of any length: beside the text a task holds its ids. Rows with equal
    or null ids are kept as they are; other columns are not read.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        enc, decimal = encoder(path), _Decimal()
        for b in batches:
            n, digest, back = [], [], []
            for text in b.column(1).to_pylist():
                ids = enc.encode(text or "").tolist()
                said, stream, bytes_back = hashlib.sha256(), Utf8Stream(enc.v), hashlib.sha256()
                for i in range(0, len(ids), BLOCK):
                    block = ids[i : i + BLOCK]
                    said.update((" " * bool(i) + " ".join(map(decimal.__getitem__, block))).encode())
                    bytes_back.update(stream.feed(block).encode())
                bytes_back.update(stream.feed([], last=True).encode())
                n.append(len(ids))
                digest.append(said.hexdigest())
                back.append(bytes_back.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"`{id_col}` {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
