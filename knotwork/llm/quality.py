"""Operator 10: quality classifier, a sparse rule ensemble.

Statistics of each whole text are computed vectorised over Arrow buffers. On a bounded sample
of labelled rows, small trees are boosted on the logistic loss; every path from a root becomes
a rule, a conjunction of thresholds; lasso logistic regression weighs the rules and drops most.
The remaining rules are compiled into one Spark column expression over the statistics.

Null text counts as empty; empty texts have zero statistics and a score like any other. Rows
with null labels or labels other than 0 and 1, or with a null id, teach nothing. Without
labelled rows every score is 0.5; with labels of one kind only, the smoothed share of label 1.
Repeated labels of a document count each. Texts of any length are taken whole. Ties: a statistic at a threshold is not above it; of splits
that gain alike the first is taken. Repeated rows score alike. An empty table gives an
empty result. Extra columns are carried through by score() unless they clash with an output
column, which then replaces them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, held_out, remainder, separators, slices, table, word_hashes

#: Labelled rows to fit on at most: those with the smallest hash of their id.
SAMPLE = 16_000
TREES, DEPTH, BINS, MIN_LEAF, SHRINK = 48, 3, 48, 20, 0.3
#: Penalties tried, strongest first; the best on a fifth of the sample is taken.
PENALTIES = (0.01, 0.003, 0.001, 0.0003, 0.0001)

_U = np.uint64


def _ascii(*spans) -> np.ndarray:
    return separators(c for s in spans for c in ([ord(s)] if len(s) == 1 else range(ord(s[0]), ord(s[-1]) + 1)))


#: Shares of a text's bytes, by class.
CLASSES = {
    "upper": _ascii("A-Z"),
    "lower": _ascii("a-z"),
    "digit": _ascii("0-9"),
    "space": separators([32, *range(9, 14)]),
    "newline": separators([10]),
    "stop": separators(b".,;:"),
    "shout": separators(b"!?"),
    "bar": separators(b"|"),
    "symbol": separators(b"#$%&*+/<=>@[\\]^_`{}~"),
    "quote": separators(b"\"'()-"),
    "high": separators(range(128, 256)),
}
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", *(f"{c}_share" for c in CLASSES), "doubled_share",
    "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "line_words",
)
_TABLE = np.zeros(256, np.uint16)
for _i, _c in enumerate(CLASSES.values()):
    _TABLE[_c] |= 1 << _i


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[offsets]).astype(float)


def _repeats(keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the highest count of one key, for each row."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=_U), np.diff(offsets))
    packed = np.sort((row << _U(42)) | (keys >> _U(22)))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(new)
    of = (packed[at] >> _U(42)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(at, len(packed))).astype(float))
    return np.bincount(of, minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    size = np.diff(offsets).astype(float)
    words, woff = word_hashes(data, offsets)
    lines, loff = word_hashes(data, offsets, separators([10]))
    nw, nl = np.diff(woff).astype(float), np.diff(loff).astype(float)
    flags = _TABLE[data]
    one = np.maximum(size, 1)
    share = [_per_row((flags >> i) & 1, offsets) / one for i in range(len(CLASSES))]
    doubled = np.zeros(len(data), bool)
    doubled[1:] = data[1:] == data[:-1]
    doubled[offsets[:-1][size > 0]] = False
    distinct, top = _repeats(words, woff)
    pairs = words * _U(3) + np.append(words[1:], _U(0))[: len(words)]
    last = woff[1:][nw > 0] - 1
    keep = np.ones(len(words), bool)
    keep[last] = False
    poff = np.concatenate([[0], np.cumsum(np.maximum(nw - 1, 0))]).astype(np.int64)
    pair_kinds, _ = _repeats(pairs[keep] * _U(0x9E3779B97F4A7C15), poff)
    line_kinds, _ = _repeats(lines, loff)
    w1, p1, l1 = np.maximum(nw, 1), np.maximum(nw - 1, 1), np.maximum(nl, 1)
    cols = [
        np.log1p(size), np.log1p(nw), (size - share[3] * one) / w1, *share, _per_row(doubled, offsets) / one,
        distinct / w1, top / w1, np.where(nw > 1, 1 - pair_kinds / p1, 0), np.where(nl > 0, 1 - line_kinds / l1, 0), nw / l1,
    ]
    return np.stack(cols, 1)


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those to keep) with a column s_<name> for each of STATISTICS."""
    names = [f"s_{s}" for s in STATISTICS]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(s, T.DoubleType()) for s in names])

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            for i, j in slices(offsets):
                found = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found[:, k]) for k in range(found.shape[1])], names=kept + names)

    return docs.select([F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]).mapInArrow(run, schema)


# --- fitting -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    bias: float
    #: (weight, ((statistic, above, threshold), ...)): above means greater than the threshold.
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def column(self) -> Column:
        """The score as a column expression over s_<statistic>."""
        parts = [F.lit(self.bias)]
        for weight, terms in self.rules:
            fits = None
            for name, above, at in terms:
                one = F.col(f"s_{name}") > at if above else F.col(f"s_{name}") <= at
                fits = one if fits is None else fits & one
            parts.append(F.when(fits, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(parts) > 1:  # summed in pairs: hundreds of rules nest a few levels deep
            parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-parts[0]))


def _tree(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, features: np.ndarray):
    """Paths ((feature, above, bin), ...) of one small tree, and its predictions."""
    paths, out = [], np.zeros(len(grad))
    todo = [((), np.arange(len(grad)))]
    while todo:
        path, rows = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if len(path) < DEPTH and len(rows) >= 2 * MIN_LEAF:
            for f in features:
                c = codes[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(c, w, BINS)) for w in (grad[rows], hess[rows], None))
                ok = (ns >= MIN_LEAF) & (len(rows) - ns >= MIN_LEAF)
                gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (gain[b], f, b)
        if path:
            paths.append(path)
        if best[1] is None:
            out[rows] = -SHRINK * g / (h + 1)
            continue
        _, f, b = best
        above = codes[rows, f] > b
        todo.append((path + ((int(f), True, b),), rows[above]))
        todo.append((path + ((int(f), False, b),), rows[~above]))
    return paths, out


def _pass(x: np.ndarray, rows: np.ndarray, w: np.ndarray, turn) -> tuple[np.ndarray, np.ndarray]:
    """r = turn(x[rows] @ w, their places) and x[rows].T @ r: in blocks of rows, so that no more than one block
    of the boolean x is ever held as numbers."""
    r, back = np.empty(len(rows), np.float32), np.zeros(x.shape[1], np.float32)
    for i in range(0, len(rows), 512):
        part = x[rows[i : i + 512]].astype(np.float32)
        r[i : i + 512] = turn(part @ w, slice(i, i + 512))
        back += part.T @ r[i : i + 512]
    return r, back


def _lasso(x: np.ndarray, rows: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray], rounds: int = 250) -> tuple[float, np.ndarray]:
    """Logistic regression of y on the given rows of the boolean x, with an L1 penalty on all
    weights but the bias, by accelerated proximal gradient steps (in single precision)."""
    n, one = len(y), np.float32
    v = np.full(x.shape[1], max(1, x.shape[1]) ** -0.5, one)
    for _ in range(20):
        v = _pass(x, rows, v, lambda z, _: z)[1]
        v /= np.linalg.norm(v) or one(1)
    rate = one(4 * n / (float(np.linalg.norm(_pass(x, rows, v, lambda z, _: z)[0])) ** 2 + n))
    bias, w = one(start[0]), start[1].astype(one)
    pb, pw, t, y = bias, w, 1.0, y.astype(one)
    for _ in range(rounds):
        r, slope = _pass(x, rows, pw, lambda z, at: (1 / (1 + np.exp(-(z + pb))) - y[at]) / one(n))
        nb, nw = pb - rate * r.sum(), pw - rate * slope
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * one(penalty), one(0))
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        step = one((t - 1) / nt)
        moved = max(np.abs(nw - w).max(initial=0), abs(nb - bias))
        pb, pw = nb + step * (nb - bias), nw + step * (nw - w)
        bias, w, t = nb, nw, nt
        if moved < 1e-5:
            break
    return float(bias), w


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 10) -> Model:
    """A rule ensemble from statistics x and labels y (0 or 1)."""
    n = len(y)
    if not n:
        return Model(0.0, ())
    prior = (y.sum() + 1) / (n + 2)
    constant = Model(float(np.log(prior / (1 - prior))), ())
    if y.min() == y.max() or n < 4 * MIN_LEAF:
        return constant
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # code > b: x > cut b
    z, found = np.full(n, constant.bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        features = np.sort(rng.permutation(x.shape[1])[: max(2, 2 * x.shape[1] // 3)])
        paths, step = _tree(codes, p - y, p * (1 - p), features)
        z += step
        for path in paths:
            found.setdefault(tuple(sorted(path)))
    rules = {}  # by the rows that fit, a bit each
    for path in found:
        fits = np.ones(n, bool)
        for f, above, b in path:
            fits &= (codes[:, f] > b) if above else (codes[:, f] <= b)
        if 0 < fits.sum() < n:
            rules.setdefault(np.packbits(fits).tobytes(), path)
    if not rules:
        return constant
    m = np.empty((n, len(rules)), bool)
    for i, bits in enumerate(rules):
        m[:, i] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    rules = list(rules.values())
    test = rng.random(n) < 0.2
    fit_on, test_on = np.flatnonzero(~test), np.flatnonzero(test)
    state = (constant.bias, np.zeros(m.shape[1]))
    losses, fitted = [], []
    for penalty in PENALTIES:
        state = _lasso(m, fit_on, y[fit_on], penalty, state)
        z = _pass(m, test_on, state[1].astype(np.float32), lambda z, _: z)[0] + state[0]
        q = np.clip(1 / (1 + np.exp(-z.astype(float))), 1e-6, 1 - 1e-6)
        losses.append(-(y[test] * np.log(q) + (1 - y[test]) * np.log(1 - q)).mean())
        fitted.append(state)
    best = int(np.argmin(losses))
    bias, w = _lasso(m, np.arange(n), y, PENALTIES[best], fitted[best])
    terms = lambda path: tuple((STATISTICS[f], above, float(cuts[f][b])) for f, above, b in path)
    return Model(float(bias), tuple((float(w[i]), terms(rules[i])) for i in np.flatnonzero(np.abs(w) > 1e-6)))


def fit(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on up to `sample` labelled documents; the same rows whatever the partitioning."""
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)  # at most `sample` pairs of numbers
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_id")
    order = ["_id", "_y", *[f"s_{s}" for s in STATISTICS]]
    got = with_statistics(rows, "_text", ["_id", "_y"]).select(*order).orderBy(*order).limit(sample)  # `sample` rows of numbers at most

    def run(group: pa.Table) -> pa.Table:
        """The whole fit in one task, in the rows' order."""
        group = group.sort_by([(c, "ascending") for c in order])
        x = np.stack([group.column(f"s_{s}").to_numpy() for s in STATISTICS], 1)
        return pa.table({"model": [json.dumps(asdict(fit_rules(x, group.column("_y").to_numpy().astype(float))))]})

    told = got.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, "model string").first()
    if told is None:
        return fit_rules(np.zeros((0, len(STATISTICS))), np.zeros(0))
    model = json.loads(told.model)
    return Model(model["bias"], tuple((w, tuple(map(tuple, terms))) for w, terms in model["rules"]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those to keep) with the model's score from 0 to 1; higher: label 1
    likelier."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    return with_statistics(docs, text, kept).select(*[F.col(f"`{c}`") for c in kept], model.column().alias(name))


# --- query ---------------------------------------------------------------------------


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """The model for labels.quality, learnt from rows whose crc32(doc_id) mod 5 is not 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(remainder(F.col("doc_id"), 5) != 0)
    return fit(docs.select("doc_id", "text"), labels, "quality")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and decision for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, quality_model(spark, sf_dir, docs), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
