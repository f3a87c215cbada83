"""Operator 3: exact substring deduplication by deep-shallow suffix sorting.

Every byte of a text covered by a LENGTH-byte string that also starts in a text with a smaller
id is removed. Sorting the suffixes of all texts in one place doesn't scale, so the suffixes
are first dealt out: of the GRAM-byte substrings of each window of LENGTH bytes, the ones with
the least hash are its anchors. Equal windows have equal anchors at equal places, so only
windows around an anchor that two texts share can repeat, and they meet in the anchor's bucket.
There the suffixes that start these windows are sorted deep-shallow: a multikey quicksort on
8-byte words down to a shallow depth, then blind tries, built for all tied groups at once, that
branch on single bytes and skip what a group has in common. Leaves of the tries are the equal
strings; the least id among a leaf's texts decides for each window.

Documents are packed into blocks; a block sends each distinct anchor or context once. An anchor
with very many surroundings, a few in each of many blocks or many in a few (the edge of a
passage that a third of all texts hold), is hot: its windows are dealt out singly, by their own
hash, so no bucket gets more than HOT surroundings of an anchor. Buckets and partitions follow
the number of blocks, so what a task reads does not grow with the input.

Null text counts as empty; texts shorter than LENGTH keep every byte. Rows with a null id are
kept whole and remove nothing. Rows that repeat an id don't remove each other's bytes, as
neither id is smaller. Texts of any length are treated whole. An empty table gives an empty
result. Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, buffers, mix, randoms, slices, stored, table
from .suffix_tree import _merged, _pack, _rows, _steps, _unpack

LENGTH, GRAM, SHALLOW = 50, 20, 16
LEFT = LENGTH - GRAM  # an anchor's windows start so many bytes before it at most
WIDTH = LEFT + LENGTH
#: Bytes of text in a block, one document at least. There are as many buckets as blocks.
BLOCK_BYTES = 10 << 20
#: From so many surroundings, summed over the blocks that hold it, an anchor is hot.
HOT = 4096
_U = np.uint64
_CHUNK = 1 << 19
_BYTES = randoms(256, 31)
_WORDS = randoms(WIDTH // 8 + 1, 32) | _U(1)
_NONE = np.iinfo(np.int64).max


# --- deep-shallow sorting ------------------------------------------------------------------


def _word(text: np.ndarray, at: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Up to 8 bytes from depth of each suffix as a number that orders like them."""
    out = np.zeros(len(at), _U)
    for k in range(min(8, length - depth)):
        out |= text[at + (depth + k)].astype(_U) << _U(56 - 8 * k)
    return out


def _runs(new: np.ndarray) -> np.ndarray:
    return np.flatnonzero(new)


def deep_shallow(text: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes text[s : s + length]. Returns the order, and for each place in it
    whether it begins a group of equal strings."""
    n = len(starts)
    order = np.arange(n)
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    # shallow: quicksort of each tied group by its next word
    tied = np.ones(n, bool)
    for depth in range(0, min(shallow, length), 8):
        at = np.flatnonzero(tied)
        if not len(at):
            break
        word = _word(text, starts[order[at]], depth, length)
        group = np.cumsum(new[at])
        by = np.argsort(word, kind="quicksort")
        by = by[np.argsort(group[by], kind="stable")]
        order[at] = order[at][by]
        word, group = word[by], group[by]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (word[1:] != word[:-1]) | (group[1:] != group[:-1])
        new[at] |= fresh
        tied = ~new | np.append(~new[1:], False)
    # deep: blind tries of the groups still tied; each round adds one level to all of them
    low = np.full(n, min(shallow, length))  # what each place's group has in common at least
    while True:
        at = np.flatnonzero(tied)
        if not len(at):
            break
        head = new[at]
        group = np.cumsum(head) - 1
        first = order[at[head]][group]
        own = order[at]
        differ = np.full(len(at), length)  # the first byte that tells a suffix from its group's first
        depth = low[at]
        open_ = np.flatnonzero(own != first)
        d = depth[open_]
        while len(open_):
            x, y = text[starts[own[open_]] + d], text[starts[first[open_]] + d]
            hit = x != y
            differ[open_[hit]] = d[hit]
            d = d + 1
            more = ~hit & (d < length)
            open_, d = open_[more], d[more]
        branch = np.minimum.reduceat(differ, _runs(head))[group]  # the trie node's depth
        alive = branch < length
        low[at] = branch
        tied[at[~alive]] = False  # a leaf: equal strings
        at, group, branch = at[alive], group[alive], branch[alive]
        if not len(at):
            break
        own = order[at]
        byte = text[starts[own] + branch]
        by = np.lexsort((byte, group))
        order[at] = own[by]
        byte, group = byte[by], group[by]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (byte[1:] != byte[:-1]) | (group[1:] != group[:-1])
        new[at] |= fresh
        alone = new & np.append(new[1:], True)
        tied &= ~alone
    return order, new


# --- anchors ---------------------------------------------------------------------------------


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over each w neighbours, by doubling."""
    y, k = x, 1
    while 2 * k <= w:
        y = best(y[:-k], y[k:])
        k *= 2
    r = w - k
    return best(y[: len(y) - r], y[r:]) if r else y


def _anchors(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows that lie within one document."""
    found, hashes, n = [], [], len(text)
    w = LENGTH - GRAM + 1
    for a in range(0, max(0, n - LENGTH + 1), _CHUNK):
        d = text[a : min(n, a + _CHUNK + LENGTH - 1)]
        p, inv = _powers(len(d) + 1)
        total = np.empty(len(d) + 1, _U)
        total[0] = 0
        np.cumsum(_BYTES[d] * p[: len(d)], out=total[1:])
        h = mix((total[GRAM:] - total[:-GRAM]) * inv[: len(d) - GRAM + 1]) | _U(1)
        least = _slide(h, w, np.minimum)
        edge = np.zeros(len(least) + 1, np.int32)  # windows that cross into the next document
        inner = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, a + len(d), side="left")] - a
        np.add.at(edge, np.clip(inner - LENGTH + 1, 0, len(least)), 1)
        np.add.at(edge, np.clip(inner, 0, len(least)), -1)
        least[np.cumsum(edge[:-1]) > 0] = 0
        pad = np.zeros(w - 1, _U)
        at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), w, np.maximum) == h)
        found.append(at + a)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


def _hashed(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes (a multiple of 8 of them)."""
    words = np.ascontiguousarray(rows).view(_U)
    out = np.zeros(len(words), _U)
    for k in range(words.shape[1]):
        out = mix(out + words[:, k] * _WORDS[k])
    return out


class _Block:
    """A block's texts, and the anchors in them with what surrounds them."""

    def __init__(self, row: dict):
        self.block, self.ids = row["block"], row["ids"]
        raw = zstandard.ZstdDecompressor().decompress(row["text"]) if row["text"] else b""
        self.text = np.frombuffer(raw, np.uint8)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        known = np.array([x is not None for x in self.ids], bool)
        number = np.array([0 if x is None else x for x in self.ids], np.int64)
        self.at, self.hash = _anchors(self.text, self.offsets)
        doc = np.searchsorted(self.offsets, self.at, side="right") - 1
        keep = known[doc] if len(doc) else np.zeros(0, bool)
        self.at, self.hash, self.doc = self.at[keep], self.hash[keep], doc[keep]
        self.left = np.minimum(self.at - self.offsets[self.doc], LEFT)
        self.right = np.minimum(self.offsets[self.doc + 1] - self.at, LENGTH)
        self.id = number[self.doc]
        self.padded = np.concatenate([np.zeros(LEFT, np.uint8), self.text, np.zeros(LENGTH, np.uint8)])
        self.around = np.concatenate([_hashed(self.context(slice(i, i + 20_000))) for i in range(0, len(self.at), 20_000)]) if len(self.at) else np.zeros(0, _U)
        self.around = mix(self.around ^ (self.left * 64 + self.right).astype(_U)) ^ self.hash

    def context(self, which) -> np.ndarray:
        """The WIDTH bytes around anchors, zero beyond the document."""
        at, left, right = self.at[which], self.left[which], self.right[which]
        out = np.lib.stride_tricks.sliding_window_view(self.padded, WIDTH)[at]
        cut = np.flatnonzero((left < LEFT) | (right < LENGTH))
        if len(cut):
            col = np.arange(WIDTH)
            out[cut] *= (col >= LEFT - left[cut, None]) & (col < LEFT + right[cut, None])
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's different anchor hashes; how many surroundings each has, and whether in
        texts of several ids (lowest bit); and each anchor's place among them."""
        order = np.lexsort((self.around, self.hash))
        h, c, who = self.hash[order], self.around[order], self.id[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        other = new.copy()
        other[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        if not len(at):
            return h, np.zeros(0, np.int64), place
        kinds = np.add.reduceat(other.astype(np.int64), at)
        several = np.minimum.reduceat(who, at) != np.maximum.reduceat(who, at)
        return h[at], kinds * 2 + several, place

    def contexts(self, which: np.ndarray):
        """Of the anchors `which`: their different surroundings by (hash, surroundings), one
        anchor that shows each, the least id of each, and each anchor's place among them."""
        order = which[np.lexsort((self.around[which], self.hash[which]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.around[order][1:] != self.around[order][:-1]) | (self.hash[order][1:] != self.hash[order][:-1])
        at = np.flatnonzero(new)
        place = np.zeros(len(self.at), np.int64)
        place[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.id[order], at) if len(at) else np.zeros(0, np.int64)
        return order[at], least, place

    def windows(self, which: np.ndarray):
        """The single windows around the anchors `which`: (anchor, how far before it)."""
        lo = LENGTH - self.right[which]
        count = np.maximum(0, self.left[which] - lo + 1)
        of = np.repeat(which, count)
        return of, np.repeat(lo, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)

    def window_bytes(self, of: np.ndarray, back: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.padded, LENGTH)[self.at[of] - back + LEFT]

    def hot(self, which: np.ndarray):
        """The different single windows of hot anchors: key, one that shows each, least id, and
        all windows with their places among them."""
        of, back = self.windows(which)
        keys = np.empty(len(of), _U)
        for i in range(0, len(of), 20_000):
            raw = np.zeros((len(of[i : i + 20_000]), LENGTH + -LENGTH % 8), np.uint8)
            raw[:, :LENGTH] = self.window_bytes(of[i : i + 20_000], back[i : i + 20_000])
            keys[i : i + 20_000] = _hashed(raw)
        kinds, first, place = np.unique(keys, return_index=True, return_inverse=True)
        least = np.full(len(kinds), _NONE)
        np.minimum.at(least, place, self.id[of])
        return kinds, first, least, of, back, place


# --- the distributed steps ---------------------------------------------------------------------

_BLOCK = "block long, ids array<bigint>, text binary, offsets binary"
_HASHES = "bucket int, block long, keys binary, kinds binary"
_CODES = "what string, bucket int, block long, a binary, b binary, c binary"
_PARTS = "what string, bucket int, block long, keys binary, lens binary, raw binary, ids binary"


def _blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        ids, texts, sizes, room = [], [], [], BLOCK_BYTES

        def pack():
            off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            raw = zstandard.ZstdCompressor(level=3).compress(np.concatenate(texts).tobytes())
            return pa.RecordBatch.from_pydict({"block": pa.array([(task << 24) + made], pa.int64()), "ids": pa.array([[x for p in ids for x in p]], pa.list_(pa.int64())), "text": pa.array([raw], pa.binary()), "offsets": pa.array([off.tobytes()], pa.binary())})

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                d = data[offsets[i] : offsets[j]]
                if texts and len(d) > room:
                    yield pack()
                    made += 1
                    ids, texts, sizes, room = [], [], [], BLOCK_BYTES
                room -= len(d)
                ids.append(batch.column("id").slice(i, j - i).to_pylist())
                texts.append(d.copy())
                sizes.append(np.diff(offsets[i : j + 1]))
        if texts:
            yield pack()

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, _BLOCK)


def _dealt(keys: np.ndarray, buckets: int):
    of = keys % _U(buckets)
    order = np.argsort(of, kind="stable")
    bound = np.searchsorted(of[order], np.arange(buckets + 1, dtype=_U))
    return [(i, order[bound[i] : bound[i + 1]]) for i in range(buckets) if bound[i + 1] > bound[i]]


def _hashes(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's different anchors, dealt to buckets."""

    def run(batches):
        for row in _rows(batches):
            own = _Block(row)
            keys, kinds, _ = own.distinct()
            out = _dealt(keys, buckets)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([i for i, _ in out], pa.int32()), "block": pa.array([own.block] * len(out), pa.int64()), "keys": [_pack(_steps(keys[at])) for _, at in out], "kinds": [_pack(kinds[at]) for _, at in out]})

    return blocks.mapInArrow(run, _HASHES)


def _codes(hashes: DataFrame) -> DataFrame:
    """For each block's anchors: 0 if only one text has it, 1 if several, 2 if it is hot."""

    def run(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(k.as_py()), dtype=_U) for k in group.column("keys")]
        kinds = [_unpack(k.as_py()).astype(np.int64) for k in group.column("kinds")]
        all_keys, total = _merged([(k, (c >> 1) + (np.ones_like(c) << 40)) for k, c in zip(keys, kinds)])
        several = np.zeros(len(all_keys), bool)
        at = [np.searchsorted(all_keys, k) for k in keys]
        for i, c in zip(at, kinds):
            several[i] |= (c & 1) > 0
        holders, around = total >> 40, total & ((1 << 40) - 1)
        code = np.where(around >= HOT, 2, 1)
        code = np.where(several | (holders > 1), code, 0)
        n = group.num_rows
        none = pa.array([b""] * n, pa.binary())
        return pa.table({"what": ["codes"] * n, "bucket": group.column("bucket").cast(pa.int32()), "block": group.column("block"), "a": pa.array([_pack(code[i]) for i in at], pa.binary()), "b": none, "c": none})

    return hashes.groupBy("bucket").applyInArrow(run, _CODES)


def _coded(own: _Block, codes: dict[int, bytes], buckets: int) -> np.ndarray:
    keys, _, place = own.distinct()
    code = np.zeros(len(keys), np.int64)
    for i, at in _dealt(keys, buckets):
        code[at] = _unpack(codes[i]).astype(np.int64)
    return code[place] if len(place) else place


def _parts(blocks: DataFrame, codes: DataFrame, buckets: int) -> DataFrame:
    """What surrounds each block's shared anchors, and the single windows of hot ones."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _PARTS.split(", ")}

        def add(what, i, keys, lens, raw, ids):
            for name, x in zip(out, (what, i, own.block, _pack(_steps(keys)), lens, zstandard.ZstdCompressor(level=1).compress(raw), _pack(ids))):
                out[name].append(x)

        for row in left.to_pylist():
            own = _Block(row)
            code = _coded(own, dict(zip(right.column("bucket").to_pylist(), right.column("a").to_pylist())), buckets)
            shows, least, _ = own.contexts(np.flatnonzero(code == 1))
            for i, at in _dealt(own.hash[shows], buckets):
                s = shows[at]
                add("a", i, own.hash[s], np.stack([own.left[s], own.right[s]]).astype(np.uint8).tobytes(), own.context(s).tobytes(), least[at])
            kinds, first, least, of, back, _ = own.hot(np.flatnonzero(code == 2))
            for i, at in _dealt(kinds, buckets):
                add("w", i, kinds[at], b"", own.window_bytes(of[first[at]], back[first[at]]).tobytes(), least[at])
        return pa.table({k: pa.array(v, {"what": pa.string(), "bucket": pa.int32(), "block": pa.int64()}.get(k, pa.binary())) for k, v in out.items()})

    return blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(run, _PARTS)


def _least_ids(keys: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
    """For each row, the windows around its anchor and the least id that has each window:
    (rows' window counts, least ids), windows nearest to the anchor's right first."""
    width = rows.shape[1]
    hashed = np.concatenate([_hashed(np.pad(rows[i : i + 50_000], ((0, 0), (0, -width % 8)))) for i in range(0, len(rows), 50_000)])
    hashed = mix(hashed ^ (left * 64 + right).astype(_U))
    order = np.lexsort((hashed, keys))
    k, c = keys[order], hashed[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    shows = order[at]
    least = np.minimum.reduceat(ids[order], at)
    same = k[at]
    alone = np.ones(len(at), bool)
    alone[1:] &= same[1:] != same[:-1]
    alone[:-1] &= same[1:] != same[:-1]
    lo = LENGTH - right[shows]
    count = np.maximum(0, left[shows] - lo + 1)
    start = np.cumsum(count) - count
    out = np.repeat(least, count)
    busy = np.flatnonzero(~alone & (count > 0))
    if len(busy):  # several surroundings: sort the suffixes that start the windows
        n = count[busy]
        of = np.repeat(busy, n)
        back = np.repeat(lo[busy], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        text = rows[shows].ravel()
        starts = of * width + (width - LENGTH) - back
        sorted_, begins = deep_shallow(text, starts)
        group = np.cumsum(begins) - 1
        lowest = np.minimum.reduceat(least[of[sorted_]], np.flatnonzero(begins))[group]
        # equal strings around different anchors count too; the same window is told the same
        out[(start[of] + back - lo[of])[sorted_]] = lowest
    return kind, count, start, out


def _solved(parts: DataFrame) -> DataFrame:
    """For each block's contexts and windows, which least ids have their windows, in runs."""

    def run(group: pa.Table) -> pa.Table:
        what = group.column("what")[0].as_py()
        width = WIDTH if what == "a" else LENGTH
        keys = [np.cumsum(_unpack(x.as_py()), dtype=_U) for x in group.column("keys")]
        rows = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint8).reshape(-1, width) for x in group.column("raw")])
        ids = np.concatenate([_unpack(x.as_py()).view(np.int64) for x in group.column("ids")])
        size = [len(k) for k in keys]
        if what == "a":
            lens = np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(2, -1) for x in group.column("lens")], 1).astype(np.int64)
        else:
            lens = np.stack([np.zeros(len(ids), np.int64), np.full(len(ids), LENGTH)])
        kind, count, start, least = _least_ids(np.concatenate(keys), rows, lens[0], lens[1], ids)
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[start[count > 0]] = True
        run_of = np.concatenate([[0], np.cumsum(new)])  # runs before each window
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(least))
        a, b, c, at = [], [], [], 0
        for n in size:
            mine = kind[at : at + n]
            at += n
            r0, r1 = run_of[start[mine]], run_of[start[mine] + count[mine]]
            m = r1 - r0
            pick = np.repeat(r0, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            a.append(_pack(m))
            b.append(_pack(ends[pick] - heads[pick]))
            c.append(_pack(least[heads[pick]]))
        return pa.table({"what": group.column("what"), "bucket": group.column("bucket").cast(pa.int32()), "block": group.column("block"), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "c": pa.array(c, pa.binary())})

    return parts.groupBy("what", "bucket").applyInArrow(run, _CODES)


def _covered(own: _Block, answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged removed spans of a block: (document, start, end), ends exclusive."""
    code = _coded(own, {r["bucket"]: r["a"] for r in answers if r["what"] == "codes"}, buckets)
    given = {(r["what"], r["bucket"]): r for r in answers}
    begins, ends, docs = [], [], []

    def told(what: str, keys: np.ndarray):
        """Runs of each key: how many, and their lengths and ids, in the keys' order."""
        runs, parts = np.zeros(len(keys), np.int64), []
        for i, at in _dealt(keys, buckets):
            r = given[what, i]
            m = _unpack(r["a"]).astype(np.int64)
            runs[at] = m
            parts.append((np.repeat(at, m), _unpack(r["b"]).astype(np.int64), _unpack(r["c"]).view(np.int64)))
        if not parts:
            return runs, np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, n, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(who, kind="stable")
        return runs, n[order], ids[order]

    which = np.flatnonzero(code == 1)
    shows, _, place = own.contexts(which)
    runs, length, least = told("a", own.hash[shows])
    first = np.cumsum(runs) - runs
    m = runs[place[which]]
    of = np.repeat(which, m)
    pick = np.repeat(first[place[which]], m) + np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
    before = np.cumsum(length) - length
    lo = LENGTH - own.right[of] + before[pick] - before[np.repeat(first[place[which]], m)] if len(of) else np.zeros(0, np.int64)
    hit = least[pick] < own.id[of]
    of, lo, n = of[hit], lo[hit], length[pick][hit]
    begins.append(own.at[of] - (lo + n - 1))
    ends.append(own.at[of] - lo + LENGTH)
    docs.append(own.doc[of])

    kinds, _, _, of, back, place = own.hot(np.flatnonzero(code == 2))
    _, _, least = told("w", kinds)
    hit = least[place] < own.id[of] if len(of) else np.zeros(0, bool)
    begins.append(own.at[of[hit]] - back[hit])
    ends.append(own.at[of[hit]] - back[hit] + LENGTH)
    docs.append(own.doc[of[hit]])

    begin, end, doc = (np.concatenate(x) for x in (begins, ends, docs))
    order = np.argsort(begin, kind="stable")
    begin, end, doc = begin[order], end[order], doc[order]
    if not len(begin):
        return doc, begin, end
    reach = np.maximum.accumulate(end)  # spans never cross documents, so reach is the document's own
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], begin[at], np.append(reach[at[1:] - 1], reach[-1])


_RESULT = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _result(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            own = _Block(row)
            doc, begin, end = _covered(own, right.to_pylist(), buckets)
            n = len(own.ids)
            first = np.searchsorted(doc, np.arange(n + 1))
            raw, kept = own.text.tobytes(), []
            for i in range(n):
                a, b = int(own.offsets[i]), int(own.offsets[i + 1])
                s, e = first[i], first[i + 1]
                if s == e:
                    kept.append(raw[a:b])
                    continue
                cuts = [a, *np.stack([begin[s:e], end[s:e]], 1).ravel().tolist(), b]
                kept.append(b"".join(raw[cuts[k] : cuts[k + 1]] for k in range(0, len(cuts), 2)))
            base = own.offsets[doc] if len(doc) else doc
            spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())], names=["start", "end"])
            parts.append(pa.table({"doc_id": pa.array(own.ids, pa.int64()), "n_bytes": np.diff(own.offsets), "spans": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), spans), "kept": pa.array(kept, pa.binary())}))
        return pa.concat_tables(parts)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _RESULT)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row: the removed byte spans, ends exclusive, and
    the remaining bytes."""
    blocks = stored(_blocks(docs, doc_id, text), "blocks")
    buckets = max(1, blocks.select("block").count())
    dealt = lambda df, key: df.repartition(buckets, key)
    codes = stored(_codes(dealt(_hashes(blocks, buckets), "bucket")), "codes")
    solved = _solved(dealt(_parts(dealt(blocks, "block"), dealt(codes, "block"), buckets), "bucket"))
    return _result(dealt(blocks, "block"), dealt(codes.union(solved), "block"), buckets)


# --- query ---------------------------------------------------------------------------------------


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated 50-byte strings are removed."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
