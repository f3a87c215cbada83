"""Operator 7: byte-level BPE encoding and decoding.

The ranks of a public vocabulary are loaded into an Aho-Corasick automaton whose patterns are
the tokens with every byte mapped to the Latin-1 character of the same number. A piece is
encoded left to right: at each position the longest token that starts there is tried first;
a token may follow the one before it only if the pair is *compatible*, that is, if encoding
the two tokens' bytes by merges gives exactly those two tokens. When no token fits, the
encoder goes back to the previous token's next shorter prefix. Compatibility of a pair is
decided by undoing merges along the boundary and is memoised; positions found to be dead ends
are remembered, so each position is left at most once and the whole takes linear
time. A sequence whose neighbouring tokens are all compatible is the merge result itself.

Nulls count as empty text and give no ids. Empty texts give no ids, the SHA-256 of nothing.
Repeated rows and ties are encoded alike, texts of any length are encoded whole, and extra
columns of the input are carried through by encode() unless they clash with the output
columns, which then replace them. Work is per row: no shuffle, no state between rows except
bounded caches."""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Pieces up to this many characters are remembered; the table is emptied when it is full.
CACHED_CHARS, CACHED_PIECES = 32, 200_000
#: Compatibility of this many pairs is remembered.
CACHED_PAIRS = 1 << 18


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the text of a rank file."""
    out = {}
    for line in raw.splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


class _Pieces(dict):
    """Packed ids by piece; what is missing is looked up."""

    def __init__(self, own: "Codec"):
        super().__init__()
        self.own = own

    def __missing__(self, piece: str) -> bytes:
        return self.own.look_up(piece)


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        self.ids = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.parts = self._split_table()
        self.merged = {pair: i for i, pair in self.parts.items() if pair[0] != i}
        top = max(ranks.values()) + 1
        self.lengths = [len(self.tokens.get(i, b"")) for i in range(top)]
        self.prefix = self._prefix_table(top)
        self.longest = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.longest.add_word(t.decode("latin-1"), i)
        self.longest.make_automaton()
        self.fits = lru_cache(CACHED_PAIRS)(self._fits)
        self.known = _Pieces(self)
        self.older: dict[str, bytes] = {}

    def _merge(self, token: bytes, limit: int) -> list[bytes]:
        """The merge result of token using only ranks below limit (used for the tables)."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ids.get(parts[i] + parts[i + 1], limit))
            if self.ids.get(parts[best] + parts[best + 1], limit) >= limit:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _split_table(self) -> dict[int, tuple[int, int]]:
        """Each token's last merge, as the ids of its two parts; a byte is its own part."""
        out = {}
        for t, i in self.ids.items():
            halves = self._merge(t, i) if len(t) > 1 else []
            out[i] = (self.ids[halves[0]], self.ids[halves[1]]) if len(halves) == 2 else (i, i)
        return out

    def _prefix_table(self, top: int) -> list[int]:
        """Each token's longest proper prefix that is a token, or -1."""
        out = [-1] * top
        for t, i in self.ids.items():
            out[i] = next((p for n in range(len(t) - 1, 0, -1) if (p := self.ids.get(t[:n])) is not None), -1)
        return out

    def _fits(self, left: int, right: int) -> bool:
        """Whether left then right stay two tokens: undo the latest merge beside the boundary
        again and again; a merge across it that would have come earlier speaks against. At
        equal rank the leftmost merge comes first, so the right side's own rank counts too."""
        parts, merged, bound = self.parts, self.merged, 1 << 62
        while True:
            if merged.get((left, right), bound) < bound:
                return False
            tail, head = parts[left][1], parts[right][0]
            if tail == left and head == right:  # two bytes
                return True
            if head == right or (tail != left and left > right):
                bound, left = left, tail
            else:
                bound, right = right + 1, head

    def piece(self, text: str) -> list[int]:
        """The ids of one match of the pattern."""
        raw = text.encode()
        whole = self.ids.get(raw)
        if whole is not None:
            return [whole]
        n, lengths, shorter, fits = len(raw), self.lengths, self.prefix, self.fits
        longest = [-1] * n  # the longest token that starts at each byte
        for end, i in self.longest.iter(raw.decode("latin-1")):  # of one start, longer ones end later
            longest[end + 1 - lengths[i]] = i
        dead: set[int] = set()
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + lengths[token]
                if end not in dead and (last < 0 or fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                if at < n:
                    token = longest[at]
            else:  # nothing fits here: shorten the token before
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return out

    def look_up(self, text: str) -> bytes:
        """The packed ids of a piece that the newer table doesn't have. When that is full, it
        becomes the older one, so frequent pieces survive."""
        got = self.older.get(text)
        if got is None:
            got = array("I", self.piece(text)).tobytes()
        if len(text) <= CACHED_CHARS:
            if len(self.known) >= CACHED_PIECES:
                self.older = dict(self.known)
                self.known.clear()
            self.known[text] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.pieces(text))) if text else b""

    def forget(self) -> None:
        """Empty the caches."""
        self.known.clear()
        self.older = {}
        self.fits.cache_clear()

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec for each worker process, rank file and pattern."""
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(raw), pattern)
    return _codecs[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Add the ids of each text (binary, little-endian unsigned 32-bit) and their number; with
    decoded, also the bytes decoded from these ids. The rank file is read on the driver and
    shipped once; its size is that of the public file, whatever the input's."""
    spark = df.sparkSession
    with open(ranks_path, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    kept = [c for c in df.columns if c not in (ids, n_tokens, decoded)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())] + ([T.StructField(decoded, T.BinaryType())] if decoded else []))

    def run(batches):
        own = codec(shipped.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(text).to_pylist()
                got = [own.encode(t) for t in texts]
                cols = [part.column(c) for c in kept] + [pa.array(got, pa.binary()), pa.array([len(x) // 4 for x in got], pa.int64())]
                if decoded:
                    cols.append(pa.array([own.decode(x) for x in got], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=kept + [ids, n_tokens] + ([decoded] if decoded else []))
        own.forget()  # the worker may go on to other work

    return df.select([F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text that the ids stand for, from encode()'s binary column; null stays null."""
    spark = df.sparkSession
    with open(ranks_path, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches):
        tokens = {i: t for t, i in parse_ranks(shipped.value).items()}
        for batch in batches:
            out = [None if x is None else b"".join(map(tokens.__getitem__, memoryview(x).cast("I"))).decode(errors="replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, pa.string())], names=[*kept, text])

    return df.mapInArrow(run, schema)


# --- query ---------------------------------------------------------------------------


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document and decode it again, with digests of both."""
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decoded="decoded").drop("text")
    return raw.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
