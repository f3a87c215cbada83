"""Operator 4: language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled texts. A
text is parsed greedily into the longest phrases that occur in a language's sample; the fewer
phrases, the likelier the language. Counts are normalised to the Ziv-Merhav estimate of the
cross entropy, phrases * log2(sample size) / text size, and the lowest one wins. Parsing
restarts every SEGMENT bytes, so that all segments of a batch advance in lockstep through the
automata's transition tables.

Text is lower-cased; digits, punctuation and white space are one symbol each. A text that is
null or has no letter is `und` with score 0. Ties go to the language first in order. Rows with
null or empty text or null lang teach nothing; without any language every text is `und`.
Very long texts are parsed whole, in time proportional to their length. Repeated rows are judged alike. An empty table gives an empty result. Extra columns are
carried through by identify() unless they clash with an output column, which then replaces
them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, fresh, held_out, remainder, slices, stored, table

#: Labelled text for each language: bytes, and rows to choose them from, at most.
SAMPLE_BYTES, SAMPLE_ROWS = 24_000, 1024
#: A language's rows are dealt to so many parts by hash, and as many of each part may be chosen.
PARTS = 256
#: Of a longer text so many characters are taken, from a place that its hash tells.
PIECE = 4000
SEGMENT = 1024
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    samples: tuple[tuple[bytes, ...], ...]


_GROUPS = np.full(256, 255, np.uint8)  # folded byte values; 255 stands for no byte of a text
for _b in range(256):
    _c = chr(_b)
    _GROUPS[_b] = ord(" ") if _b == 32 or 9 <= _b <= 13 else ord("0") if _c.isdigit() and _b < 128 else _b if _b >= 128 or "a" <= _c <= "z" else ord(_c.lower()) if "A" <= _c <= "Z" else ord(".")


class Automata:
    """Transition tables of the languages' suffix automata, side by side."""

    def __init__(self, model: Model):
        folded = [[_GROUPS[np.frombuffer(t, np.uint8)] for t in texts] for texts in model.samples]
        seen = np.unique(np.concatenate([x for texts in folded for x in texts]))
        self.classes = np.zeros(256, np.uint8)  # class 0: never seen, no transition
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.classes = self.classes[_GROUPS]
        self.width = len(seen) + 1
        tables, starts, base = [], [], 0
        for texts in model.samples:
            part = self._build([self.classes[np.frombuffer(t, np.uint8)] for t in texts])
            starts.append(base * self.width)
            tables.append(np.where(part < 0, -1, (part + base) * self.width))
            base += len(part)
        self.table = np.concatenate(tables).astype(np.int32).ravel()
        self.starts = np.array(starts, np.int32)
        first = self.table[self.starts[:, None] + np.arange(self.width)]
        self.restart = np.where(first < 0, self.starts[:, None], first)
        self.bits = np.log2(np.maximum(2, [sum(map(len, t)) for t in model.samples]))

    def _build(self, texts: list[np.ndarray]) -> np.ndarray:
        """next[state, class] of the automaton of all substrings of the texts."""
        room = 2 * sum(map(len, texts)) + 2
        follow = np.full((room, self.width), -1, np.int32)
        link, length, n = [-1] * room, [0] * room, 1
        for text in texts:
            last = 0
            for c in text.tolist():
                q = int(follow[last, c])
                if q >= 0:  # met before in another text
                    if length[q] == length[last] + 1:
                        last = q
                        continue
                    copy, n = n, n + 1
                    follow[copy], link[copy], length[copy] = follow[q], link[q], length[last] + 1
                    p = last
                    while p >= 0 and follow[p, c] == q:
                        follow[p, c] = copy
                        p = link[p]
                    link[q] = copy
                    last = copy
                    continue
                new, n = n, n + 1
                length[new] = length[last] + 1
                p = last
                while p >= 0 and follow[p, c] < 0:
                    follow[p, c] = new
                    p = link[p]
                if p < 0:
                    link[new] = 0
                else:
                    q = int(follow[p, c])
                    if length[q] == length[p] + 1:
                        link[new] = q
                    else:
                        copy, n = n, n + 1
                        follow[copy], link[copy], length[copy] = follow[q], link[q], length[p] + 1
                        while p >= 0 and follow[p, c] == q:
                            follow[p, c] = copy
                            p = link[p]
                        link[q] = link[new] = copy
                last = new
        return follow[:n]

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text under each language, as an array [language, text]."""
        size = np.diff(offsets)
        pieces = -(-size // SEGMENT)
        of = np.repeat(np.arange(len(size)), pieces)
        rank = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][of] + rank * SEGMENT
        length = np.minimum(SEGMENT, offsets[1:][of] - start)
        order = np.argsort(-length, kind="stable")
        of, start, length = of[order], start[order], length[order]
        n = len(of)
        count = np.ones((len(self.starts), n), np.int32)
        if n:
            symbols = self.classes[data]
            state = np.repeat(self.starts[:, None], n, 1)
            live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
            for t in range(int(length[0])):
                m = int(live[t])
                c = symbols[start[:m] + t]
                follow = self.table[state[:, :m] + c]
                ended = follow < 0
                count[:, :m] += ended
                state[:, :m] = np.where(ended, self.restart[:, c], follow)
        out = np.zeros((len(self.starts), len(size)))
        for i in range(len(self.starts)):
            out[i] = np.bincount(of, count[i], len(size))
        return out


_built: dict[Model, Automata] = {}


def _automata(model: Model) -> Automata:
    if model not in _built:
        _built.clear()
        _built[model] = Automata(model)
    return _built[model]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Choose labelled texts for each language in the order of their hashes, whole or a PIECE of
    each, until sample_bytes are reached. The driver holds so many bytes for each language."""
    known = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{lang}`").alias("_lang"), F.lower(f"`{text}`").alias("_text")).filter("_lang is not null and _text <> ''")
    known = known.withColumn("_hash", F.xxhash64("_id", "_text"))
    # the least hashes of each part: no task ranks all rows of a language
    few = known.select("_lang", "_id", "_hash", F.least(F.length("_text"), F.lit(PIECE)).alias("_size"), F.pmod(F.xxhash64("_hash"), F.lit(PARTS)).alias("_part"))
    parts, w = Window.partitionBy("_lang", "_part").orderBy("_hash", "_id"), Window.partitionBy("_lang").orderBy("_hash", "_id")
    few = few.withColumn("_n", F.row_number().over(parts)).filter(F.col("_n") <= SAMPLE_ROWS // PARTS).withColumn("_n", F.row_number().over(w))
    sums = w.rowsBetween(Window.unboundedPreceding, -1)
    few = stored(few.withColumn("_before", F.coalesce(F.sum("_size").over(sums), F.lit(0))).filter(F.col("_before") < sample_bytes).select("_lang", "_hash", "_n"), "chosen")
    start = F.pmod(F.xxhash64("_hash"), F.greatest(F.length("_text") - PIECE + 1, F.lit(1))).cast("int") + 1
    rows = known.join(F.broadcast(few), ["_lang", "_hash"]).select("_lang", "_hash", "_n", F.substring("_text", start, F.lit(PIECE)).alias("_text")).dropDuplicates(["_lang", "_hash"])
    texts: dict[tuple[str, int], bytes] = {}
    chosen: dict[str, list[int]] = {}
    for r in sorted(rows.collect(), key=lambda r: r["_n"]):
        texts[r["_lang"], r["_hash"]] = r["_text"].encode()
        chosen.setdefault(r["_lang"], []).append(r["_hash"])
    if not chosen:
        return Model((), ())
    samples = []
    for name, hashes in sorted(chosen.items()):
        left, own = sample_bytes, []
        for h in hashes:
            if left > 0:
                own.append(texts[name, h][:left])
                left -= len(own[-1])
        samples.append(tuple(own))
    return Model(tuple(sorted(chosen)), tuple(samples))


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those to keep) with the predicted language, and how clearly it won: the runner-up's share of the
    two entropies, from 0.5 (a tie) to 1."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (name, score)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    if not model.languages:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(UNKNOWN).alias(name), F.lit(0.0).alias(score))
    t = F.col(f"`{text}`")
    low, letters = fresh("_low", docs.columns), fresh("_letter", docs.columns)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.lower(t).alias(low), F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias(letters))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_BYTES for each language

    def run(batches):
        own = _automata(shipped.value)
        names = np.array([*shipped.value.languages, UNKNOWN], object)
        for batch in batches:
            data, offsets = buffers(batch.column(low))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                o = offsets[i : j + 1] - offsets[i]
                h = own.phrases(data[offsets[i] : offsets[j]], o) * own.bits[:, None] / np.maximum(np.diff(o), 1)
                best = h.argmin(0)
                least = h.min(0)
                second = np.sort(h, 0)[1] if len(h) > 1 else np.ones(h.shape[1])
                sure = np.where(least + second > 0, second / np.maximum(least + second, 1e-12), 0.5) if len(h) > 1 else np.ones(h.shape[1])
                letter = part.column(letters).to_numpy(zero_copy_only=False).astype(bool)
                best = np.where(letter, best, len(names) - 1)
                sure = np.where(letter, sure, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(names[best], pa.string()), pa.array(sure)], names=[*kept, name, score])

    return rows.mapInArrow(run, schema)


# --- query ---------------------------------------------------------------------------


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from ids whose crc32 mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(remainder(F.col("doc_id"), 5) != 0))
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
