"""Operator 1: language-model scoring with a probabilistic suffix tree.

A text is its tokens: the words, A-Z lower-cased, then one end. The tree's symbols are tokens. A
node is a context: up to DEPTH whole tokens before, never beyond the start of the text. A context
is retained if it occurs LEAST times, whatever the size of the corpus, and its next-token distribution diverges from its
suffix's: the log-likelihood gain over the suffix's must exceed a quarter of the number of its
different next tokens times the log of its count. A retained context's distribution is smoothed
by its longest retained suffix's (Witten-Bell); the root is the add-one unigram model, in which
unseen words share one symbol. So every distribution sums to one, and a token is scored by its
longest retained suffix. What the tree holds grows with the corpus, as its contexts do.

Every count covers all training texts. Documents are packed into blocks, stored in buckets by
block. For each length of context, a block sends its distinct n-grams (56-bit hashes), dealt out
in ranges, to where they are counted, and gets their counts back. The gain of a context is a sum
over occurrences, so each block adds up its own share, these are summed in the same way, and
every block decides alike. No table of the model is gathered in one place, each key travels once
per block and not once per occurrence, blocks themselves never move, and ranges follow the bytes
of text, so what a task holds does not grow with the input.

Null text counts as empty: one end token. Rows with a null id are trained on and scored.
Repeated rows count each. Texts of any length are taken whole; a block holds one text at least.
Ties cannot occur: nothing is ranked. An empty table gives an empty result. Extra columns of the
input are ignored; the result has the columns of the contract."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Buckets, buffers, held_out, mix, randoms, slices, table, word_hashes

#: Tokens of a context, and how often it must occur, in a corpus of any size. Only a thinned tree
#: asks more of contexts of several tokens: DEEP times the root of the number of training tokens.
DEPTH, LEAST, DEEP = 2, 8, 0.01
#: Tokens in a block, one document at least.
BLOCK_TOKENS = 2_500_000
#: There are as many ranges and buckets as blocks of so many bytes of text would be.
BLOCK_BYTES = 16 << 20
_U = np.uint64
_SHIFT = _U(8)  # keys have 56 bits
_END = _U(0x5851F42D4C957F2D)  # the end token among word hashes
_STEP = randoms(64, 71) | _U(1)


# --- arrays to bytes and back ----------------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    """Non-negative integers, byte planes compressed; sorted ones are best given as steps."""
    planes = np.ascontiguousarray(x.astype(_U)).view(np.uint8).reshape(-1, 8).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(_U).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=_U(0))


# --- keys and their sums ------------------------------------------------------------------


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and summed counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def least_count(depth: int, tokens: int) -> int:
    """How often a context of `depth` tokens must occur in a tree thinned for so many training
    tokens; with tokens 0, in one that isn't thinned."""
    return LEAST if depth < 2 else max(LEAST, math.ceil(DEEP * math.sqrt(tokens)))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, place.astype(np.int32)


_SENT = "kind string, part int, block long, keys binary, counts binary, sums binary"
_ANSWER = "kind string, part int, block long, counts binary, sums binary, n long, v long"


def _dealt(kind: str, block: int, parts: int, keys: np.ndarray, counts: np.ndarray, sums: np.ndarray | None = None):
    """Rows of sorted keys with their counts, or a context's two sums, by range of keys."""
    bound = np.searchsorted(((keys >> _U(24)) * _U(parts)) >> _U(32), np.arange(parts + 1, dtype=_U))
    for i in np.flatnonzero(bound[1:] > bound[:-1]):
        at = slice(bound[i], bound[i + 1])
        yield {"kind": kind, "part": int(i), "block": block, "keys": _pack(_steps(keys[at])), "counts": _pack(counts[at]), "sums": b"" if sums is None else zlib.compress(np.ascontiguousarray(sums[:, at]).tobytes(), 1)}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pydict({c.split()[0]: pa.array([r[c.split()[0]] for r in rows], kinds[c.split()[1]]) for c in schema.split(", ")})


def _totals(sent: DataFrame, parts: int) -> DataFrame:
    """Sums over all blocks of what they sent, for each block's own keys in its order. n and v:
    all counts of a range, and how many keys have any, once."""

    def run(group: pa.Table) -> pa.Table:
        own = [np.cumsum(_unpack(k.as_py()), dtype=_U) for k in group.column("keys")]
        keys, counts = _merged([(k, _unpack(c.as_py()).astype(np.int64)) for k, c in zip(own, group.column("counts"))])
        at = [np.searchsorted(keys, k) for k in own]
        sums = [b""] * len(own)
        if group.column("sums")[0].as_py():
            total = np.zeros((2, len(keys)))
            for i, x in zip(at, group.column("sums")):
                total[:, i] += np.frombuffer(zlib.decompress(x.as_py()), float).reshape(2, -1)
            sums = [zlib.compress(total[1, i].tobytes(), 1) for i in at]
            counts = np.rint(total[0]).astype(np.int64)
        once = [0] * (len(own) - 1)
        return pa.table({
            "kind": group.column("kind"), "part": group.column("part").cast(pa.int32()), "block": group.column("block"), "counts": pa.array([_pack(counts[i]) for i in at], pa.binary()), "sums": pa.array(sums, pa.binary()),
            "n": pa.array([int(counts.sum()), *once], pa.int64()), "v": pa.array([int((counts > 0).sum()), *once], pa.int64()),
        })

    return sent.repartition(parts, "part").groupBy("kind", "part").applyInArrow(run, _ANSWER)


# --- blocks ----------------------------------------------------------------------------------

_BLOCK = "block long, ids array<bigint>, held array<boolean>, words binary, tokens binary, offsets binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Pack (doc_id, text, held_out) into blocks: their different words and, as places among
    these, the texts' tokens."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        ids, held, hashes, sizes, room = [], [], [], [], BLOCK_TOKENS

        def pack():
            words, place = _distinct(np.concatenate(hashes) >> _SHIFT)
            off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([(task << 24) + made], pa.int64()), "ids": pa.array([[x for p in ids for x in p]], pa.list_(pa.int64())), "held": pa.array([[x for p in held for x in p]], pa.list_(pa.bool_())),
                "words": pa.array([_pack(_steps(words))], pa.binary()), "tokens": pa.array([_packed_places(place)], pa.binary()), "offsets": pa.array([off.tobytes()], pa.binary()),
            })

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                h, woff = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h = np.insert(h, woff[1:], _END)
                if hashes and len(h) > room:
                    yield pack()
                    made += 1
                    ids, held, hashes, sizes, room = [], [], [], [], BLOCK_TOKENS
                room -= len(h)
                part = batch.slice(i, j - i)
                ids.append(part.column("doc_id").to_pylist())
                held.append(part.column("held_out").to_pylist())
                hashes.append(h)
                sizes.append(np.diff(woff) + 1)
        if hashes:
            yield pack()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, _BLOCK)


def _packed_places(x: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(x.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class _Block:
    """A block's tokens, and of each token, as far as the answers go, what its contexts say."""

    def __init__(self, row: dict, answers: list[dict] = ()):
        self.block, self.ids = row["block"], row["ids"]
        self.words = np.cumsum(_unpack(row["words"]), dtype=_U)
        planes = np.frombuffer(zlib.decompress(row["tokens"]), np.uint8).reshape(4, -1)
        self.place = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.held = np.array(row["held"], bool)
        self.train = np.repeat(~self.held, np.diff(self.offsets))
        self.answers: dict[str, list[dict]] = {}
        for r in sorted(answers, key=lambda r: (r["kind"], r["part"])):
            self.answers.setdefault(r["kind"], []).append(r)

    def counts(self, kind: str) -> np.ndarray:
        """The answers to a kind of keys, in the order of the sorted keys."""
        return np.concatenate([_unpack(r["counts"]).astype(np.int64) for r in self.answers.get(kind, [])] or [np.zeros(0, np.int64)])

    def sums(self, kind: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(zlib.decompress(r["sums"]), float) for r in self.answers.get(kind, [])] or [np.zeros(0)])

    def trained(self, place: np.ndarray, n: int, train: np.ndarray) -> np.ndarray:
        return np.bincount(place[train], minlength=n)

    def root(self, tokens: int, types: int) -> None:
        """Level 0: each token's count and probability; the n-grams that end in it, so far."""
        self.seen = self.counts("n0")[self.place]
        self.p = np.log((self.seen + 1) / (tokens + types + 1))
        self.gram = self.words[self.place]  # of the tokens at `at`, all of them
        self.at = np.arange(len(self.place))
        self.times = self.seen

    def deeper(self, depth: int, least: list[int]) -> None:
        """The contexts of `depth` tokens that occur often enough, and the n-grams they make:
        at: their tokens' places; context and its count cn; key and place among the keys."""
        first = np.zeros(len(self.place), bool)
        first[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        often = (self.times >= least[depth]) & (self.at + 1 < len(self.place))
        often[often] = ~first[self.at[often] + 1]  # what follows stands in the same text
        self.context, self.cn, self.at = self.gram[often], self.times[often], self.at[often] + 1
        self.key = mix(self.context * _STEP[depth] + self.words[self.place[self.at]]) >> _SHIFT
        self.keys, self.of = _distinct(self.key)

    def share(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts, and of the kinds and the gain of each what this block's texts add."""
        contexts, of = _distinct(self.context)
        mine = self.train[self.at]
        n, cn, of = self.times[mine], self.cn[mine], of[mine]
        gain = np.log(n / cn) - self.p[self.at[mine]]
        return contexts, np.stack([np.bincount(of, 1 / n, len(contexts)), np.bincount(of, gain, len(contexts))])

    def smooth(self, depth: int) -> None:
        """Tokens whose context is retained get its smoothed probability."""
        contexts, of = _distinct(self.context)
        kinds, gain = self.counts(f"g{depth}")[of], self.sums(f"g{depth}")[of]
        keep = (kinds > 0) & (gain > kinds * np.log(np.maximum(self.cn, 1)) / 4)
        at, kinds = self.at[keep], kinds[keep]
        self.p[at] = np.log((self.times[keep] + kinds * np.exp(self.p[at])) / (self.cn[keep] + kinds))

    def upto(self, depth: int, tokens: int, types: int, least: list[int]) -> None:
        """Everything that answers to n-grams of `depth` tokens of context tell."""
        self.root(tokens, types)
        for d in range(1, depth + 1):
            self.deeper(d, least)
            self.times = self.counts(f"n{d}")[self.of]
            self.gram = self.key
            if f"g{d}" in self.answers:
                self.smooth(d)


# --- the distributed steps ---------------------------------------------------------------


def _words(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        for row in _rows(batches):
            own = _Block(row)
            rows = list(_dealt("n0", own.block, parts, own.words, own.trained(own.place, len(own.words), own.train)))
            if rows:
                yield _batch(rows, _SENT)

    return blocks.mapInArrow(run, _SENT)


def _asked(blocks: DataFrame, answers: DataFrame, depth: int, last: bool, parts: int, tokens: int, types: int, least: list[int]) -> DataFrame:
    """What blocks ask at a depth, the answers to lower depths known: counts of the n-grams of
    the contexts one deeper, and their shares of this depth's contexts' gains."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Block(left.to_pylist()[0], right.to_pylist())
        own.upto(depth, tokens, types, least)
        rows = []
        if depth:
            contexts, sums = own.share()
            rows += _dealt(f"g{depth}", own.block, parts, contexts, np.zeros(len(contexts), np.int64), sums)
        if not last:
            own.deeper(depth + 1, least)
            rows += _dealt(f"n{depth + 1}", own.block, parts, own.keys, own.trained(own.of, len(own.keys), own.train[own.at]))
        return pa.Table.from_batches([_batch(rows, _SENT)])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SENT)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(blocks: DataFrame, answers: DataFrame, depth: int, tokens: int, types: int, least: list[int]) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Block(left.to_pylist()[0], right.to_pylist())
        own.root(tokens, types)
        first = own.offsets[:-1]  # every text has an end token
        total = lambda x: np.add.reduceat(x, first) / np.log(10) if len(first) else np.zeros(0)
        base, known = total(own.p), np.add.reduceat((own.seen > 0).astype(np.int64), first)
        own.upto(depth, tokens, types, least)
        return pa.table({"doc_id": pa.array(own.ids, pa.int64()), "held_out": pa.array(own.held), "n_tokens": np.diff(own.offsets), "n_known": known, "base_score": base, "score": total(own.p)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SCORES)


def train_and_score(docs: DataFrame, depth: int = DEPTH, thinned: bool = False) -> DataFrame:
    """Train on docs(doc_id, text, held_out) where held_out is false, with contexts of up to
    `depth` tokens, and score them all. thinned: with fewer contexts the larger the corpus."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // BLOCK_BYTES))
    blocks = Buckets(docs.sparkSession, "blocks", "block", parts).add(_blocks(docs))
    answers = Buckets(docs.sparkSession, "answers", "block", parts)
    keep = lambda sent: answers.add(_totals(sent, parts).repartition(answers.n, "block"))
    told = keep(_words(blocks, parts))
    tokens, types = (x or 0 for x in told.agg(F.sum("n"), F.sum("v")).first())
    least = [least_count(d, tokens if thinned else 0) for d in range(depth + 1)]
    for d in range(depth + 1):
        told = keep(_asked(blocks, told, d, d == depth, parts, tokens, types, least))
    scores = _scores(blocks, told, depth, tokens, types, least)
    return scores.withColumn("train_tokens", F.lit(tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- query ---------------------------------------------------------------------------


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document under a tree trained on those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return train_and_score(docs.withColumn("held_out", held_out(F.col("doc_id"), 7, 2)))
