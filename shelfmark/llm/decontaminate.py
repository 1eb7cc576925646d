"""Benchmark decontamination: which documents hold a benchmark item, as a window of the item's size.

Texts are lower-cased; words are runs of ASCII letters, digits and non-ASCII characters; a
shingle is five words (an item of fewer words is one shingle of its own length). A shingle's weight
is 1 / (number of items that hold it), 1 if none does. A document holds an item if a window of the
item's number of words (the whole document, if that is shorter) has weighted multiset Jaccard similarity >= ``similarity`` with it.

1. A document can only hold an item if it holds enough of the item's shingle weight; this exact bound picks the
   documents, the item sizes and the places at which windows are made at all.
2. Every item-sized window there gets a weighted 64-bit SimHash (running sums over the stretch).
3. Eight 8-bit blocks index the items' fingerprints, size by size. Fingerprints within r bits agree up to r // 8
   bits in some block, so looking up a window's eight blocks, each with its neighbours, finds all items within their radius.
   An item's radius is ``radius``, or more where its weights ask for it: a window that reaches the similarity
   differs by at most total * (1 - similarity) / similarity, so only bits whose sum is no larger can turn over,
   and no such window lies outside.
4. Candidates are verified by the exact similarity; the best window of each item is reported. So the result is that
   of comparing every window with every item.

The benchmark is collected and broadcast in slices of at most ``slice_items`` items and ``slice_bytes``
bytes, however many that takes; documents never are, and are never shuffled. If there are several, the
shingles held by two or more items are counted over the whole benchmark first and go with every slice (16 bytes
each), so that a slice weighs windows and items as one slice would.

Defined cases: null, empty or wordless documents and items match nothing; repeated documents give
repeated rows, repeated item ids rows of their own; a document shorter than an item is its one window, n_words being what the window has; ties go to
the earliest window; null ids stay null; extra columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import NOT_ALNUM, NULL_ID, U64, blocks, buffers, hash_spans, ids_out, longs, mix, rolling, valid_runs, words

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
SLICE_ITEMS, SLICE_BYTES = 20_000, 16_000_000
#: Pairs (of a shingle or a window and an item) that are looked at together.
CHUNK = 1 << 21
_BITS = np.arange(64, dtype=np.uint64)


def _hashed(column):
    w = words(*buffers(pc.utf8_lower(column)), NOT_ALNUM)
    return w, hash_spans(w.data, w.starts, w.ends, seed=9)


def _signs(shingles: np.ndarray) -> np.ndarray:
    return ((mix(shingles)[:, None] >> _BITS) & U64(1)).astype(np.float32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


def _find(keys: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The place of each shingle among the keys, which are in order, or -1."""
    if not len(keys):
        return np.full(len(shingles), -1)
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    return np.where(keys[at] == shingles, at, -1)


def _shingles(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    own = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return [rolling(x, min(SHINGLE, len(x))) if len(x) else x for x in own]


def _held(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that two or more items hold, in order, and how many items hold each."""

    def run(batches):
        for t in blocks(batches, "text"):
            w, h = _hashed(t.column("text").combine_chunks())
            key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(x) for x in _shingles(h, w.first))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    shared = items.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    key, n = (shared.column(c).to_numpy() for c in ("key", "n"))
    key = key.view(np.uint64)
    order = np.argsort(key)
    return key[order], n[order]


class Items:
    """The index of one slice of the benchmark."""

    def __init__(self, ids: list, texts: list, radius: int, similarity: float | None = None, held: tuple[np.ndarray, np.ndarray] | None = None):
        w, h = _hashed(pa.array(texts, pa.string()))
        self.ids = ids
        self.size = w.counts
        self.shingles = _shingles(h, w.first)
        self.counts = [Counter(x.tolist()) for x in self.shingles]
        pairs = [(s, d, n) for d, held_ in enumerate(self.counts) for s, n in held_.items()]
        keys = np.array([p[0] for p in pairs], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.key, self.begin = np.unique(keys[order], return_index=True)
        # shingle by shingle, the items that hold it and how often
        self.item, self.often = (np.array([p[i] for p in pairs], np.int64)[order] for i in (1, 2))
        self.end = np.r_[self.begin[1:], len(keys)]
        # shingles in order, and how many items of the whole benchmark hold each; one that is not here weighs 1
        self.held, count = (self.key, self.end - self.begin) if held is None else held
        self.weight_of = 1.0 / count
        self.total = np.array([self.weights(x).sum() for x in self.shingles])
        sums = np.array([(_signs(x) * self.weights(x)[:, None]).sum(0) for x in self.shingles]).reshape(-1, 64)
        self.fp = _pack(sums)
        self.radius = np.full(len(texts), radius)
        if similarity is not None:
            loose = similarity * np.abs(sums) <= (1 - similarity) * self.total[:, None] + 1e-5
            self.radius = np.maximum(radius, loose.sum(1))
        self.short = sorted({int(n) for n in self.size if 0 < n < SHINGLE})
        # For the items of each size: block k, value v -> those whose k-th byte is within a share of the radius of v, as
        # a bit set. Fingerprints within r bits agree up to r // 8 bits in some byte.
        values, bytes_of = np.arange(256, dtype=np.uint8), self.fp.view(np.uint8).reshape(-1, 8)
        self.of_size = {int(n): np.flatnonzero(self.size == n) for n in np.unique(self.size) if n}
        self.index = {n: [np.packbits(np.bitwise_count(values[:, None] ^ bytes_of[None, own, k]) <= self.radius[own] // 8, axis=1) for k in range(8)] for n, own in self.of_size.items()}

    def find(self, shingles: np.ndarray) -> np.ndarray:
        """The row of each shingle in the index, or -1."""
        return _find(self.key, shingles)

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        at = _find(self.held, shingles)
        return np.where(at >= 0, self.weight_of[at], 1.0) if len(self.held) else np.ones(len(shingles))

    def candidates(self, fp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of ``n`` words whose fingerprints the block index brings together, within the item's radius."""
        own, byte = self.of_size[n], fp.view(np.uint8).reshape(-1, 8)
        found = self.index[n][0][byte[:, 0]]
        for k in range(1, 8):
            found |= self.index[n][k][byte[:, k]]
        window, item = np.nonzero(np.unpackbits(found, axis=1, count=len(own)))
        item = own[item]
        near = np.bitwise_count(fp[window] ^ self.fp[item]) <= self.radius[item]
        return window[near], item[near]

    def similarity(self, window: np.ndarray, item: int) -> float:
        mine, theirs = Counter(window.tolist()), self.counts[item]
        both = set(mine) | set(theirs)
        weight = dict(zip(both, self.weights(np.array(list(both), np.uint64)).tolist(), strict=True))
        # Sums in one fixed order, so that equal similarities compare as equal.
        union = sum(weight[s] * max(mine[s], theirs[s]) for s in sorted(both))
        return sum(weight[s] * min(mine[s], theirs[s]) for s in sorted(both)) / union

    def scan(self, h: np.ndarray, first: np.ndarray, similarity: float):
        """(document, item, first word, similarity, words of the window) for each document of a block and each item it holds."""
        for k in [*self.short, SHINGLE]:
            gram = rolling(h, k)
            at = self.find(gram)
            hit = np.flatnonzero((at >= 0) & valid_runs(first, k))
            if not len(hit):
                continue
            doc = np.searchsorted(first, hit, side="right") - 1
            heads = np.flatnonzero(np.r_[True, np.diff(doc) != 0])
            for a, b in zip(heads, [*heads[1:], len(doc)], strict=True):
                d = int(doc[a])
                yield from self._document(gram, hit[a:b], at[hit[a:b]], d, k, int(first[d]), int(first[d + 1]), similarity)

    def _reach(self, at: np.ndarray) -> np.ndarray:
        """The weight of each item that a document with these shingles (rows of the index) could match at best."""
        out = np.zeros(len(self.size))
        row, n = np.unique(at, return_counts=True)
        size = (self.end - self.begin)[row]
        # A shingle can be in any number of items: at most about CHUNK pairs at a time.
        for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1):
            r, per = row[part], size[part]
            pair = np.repeat(self.begin[r] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            out += np.bincount(self.item[pair], np.minimum(np.repeat(n[part], per), self.often[pair]) * np.repeat(self.weights(self.key[r]), per), len(out))
        return out

    def _document(self, gram, hit, at, d, k, begin, end, similarity):
        able = np.flatnonzero(self._reach(at) >= np.maximum(similarity * self.total - 1e-9, 1e-12))
        able = able[np.minimum(self.size[able], SHINGLE) == k]
        for n in np.unique(self.size[able]).tolist():
            size = min(n, end - begin)
            width = size - k + 1  # shingles of a window
            places = {j: hit[np.isin(gram[hit], self.shingles[j])] for j in able[self.size[able] == n].tolist()}
            # Windows that hold a shingle of one of these items.
            pos = np.unique(np.concatenate(list(places.values())))
            lo, hi = np.maximum(pos - width + 1, begin), np.minimum(pos, end - size)
            lo = np.maximum(lo, np.r_[begin, np.maximum.accumulate(hi)[:-1] + 1])
            lo, hi = lo[hi >= lo], hi[hi >= lo]
            met = {j: [] for j in places}
            for a, b in _stretches(lo, hi + 1, max(1, CHUNK // (len(self.of_size[n]) + 64))):
                window, item = self.candidates(self._fingerprints(gram[a : b + width - 1], width), n)
                for j in np.unique(item).tolist():
                    if j in met:  # others lack the weight, wherever the window lies
                        met[j].append(a + window[item == j])
            for j, starts in met.items():
                if starts:
                    yield from self._verify(gram, places[j], np.concatenate(starts), d, j, size, width, begin, similarity)

    def _fingerprints(self, g: np.ndarray, width: int) -> np.ndarray:
        """The weighted fingerprint of each run of ``width`` shingles."""
        sums = np.vstack([np.zeros(64), np.cumsum(_signs(g) * self.weights(g)[:, None], axis=0, dtype=np.float64)])
        return _pack(np.round(sums[width:] - sums[:-width], 6))

    def _verify(self, gram, pos, starts, d, j, n, width, begin, similarity):
        """The most similar of the windows at ``starts`` (in order), if it is similar enough."""
        lo, hi = int(starts[0]), int(starts[-1])
        g = gram[lo : hi + width]
        weight = self.weights(g)
        # Occurrence p of a shingle that the item holds c times is shared with the windows that start
        # at or before p and after the c-th occurrence before p.
        at, turns = np.zeros(len(g) + 1), defaultdict(list)
        for p in (pos - lo).tolist():
            if 0 <= p < len(g):
                before, c = turns[int(g[p])], self.counts[j][int(g[p])]
                at[max(p - width + 1, before[-c] + 1 if len(before) >= c else 0, 0)] += weight[p]
                at[p + 1] -= weight[p]
                before.append(p)
        shared, whole = np.cumsum(at)[: len(g) - width + 1], np.r_[0, np.cumsum(weight)]
        whole = whole[width:] - whole[:-width]
        bound = shared / np.maximum(whole + self.total[j] - shared, 1e-12)  # no window is more similar than this
        met = np.zeros(len(bound), bool)
        met[starts - lo] = True
        bound = np.where(met & (shared > 1e-9), np.minimum(np.where(whole + self.total[j] - shared > 0, bound, 1), 1.0), -1)
        best, where = 0.0, -1
        for s in np.argsort(-bound, kind="stable").tolist():
            if bound[s] + 1e-9 < max(similarity, best):
                break
            exact = self.similarity(g[s : s + width], j)
            if exact > best + 1e-12 or (where > s and exact > best - 1e-12):
                best, where = exact, s
        if best >= similarity - 1e-12:
            yield d, j, lo + where - begin, best, n


def _stretches(begin: np.ndarray, end: np.ndarray, most: int):
    """The intervals in pieces of at most ``most`` numbers."""
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        for c in range(a, b, most):
            yield c, min(b, c + most)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, slice_items: int = SLICE_ITEMS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document and item it holds: id, item id, start_word (0-based), n_words, similarity."""
    inner = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = [_scan(inner, items, similarity) for items in _slices(benchmark, item_col, item_text, radius, similarity, slice_items, slice_bytes)]
    return reduce(DataFrame.union, found).select(F.col("_id").alias(id_col), F.col("item").alias(item_col), "start_word", "n_words", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, slice_items: int = SLICE_ITEMS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item. One pass and no shuffle for each slice of the benchmark."""
    names = docs.columns
    out = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col(text_col).cast("string").alias("_text"))
    for items in _slices(benchmark, item_col, item_text, radius, similarity, slice_items, slice_bytes):
        out = _pass(out, items, similarity)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def _slices(benchmark: DataFrame, item_col: str, item_text: str, radius: int, similarity: float, slice_items: int, slice_bytes: int):
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    slices = max(1, -(-size.n // slice_items), -(-size.b // slice_bytes))
    held = _held(items) if slices > 1 else None  # one slice counts its own
    for k in range(slices):  # hash slices come out a little uneven; each is collected on its own
        rows = sorted((r.item if r.item is not None else NULL_ID, r.text or "") for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k).collect())
        yield Items([None if i == NULL_ID else i for i, _ in rows], [t for _, t in rows], radius, similarity, held)


def _pass(inner: DataFrame, items: Items, similarity: float) -> DataFrame:
    shared = inner.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        for t in blocks(batches, "_text"):
            w, h = _hashed(t.column("_text").combine_chunks())
            keep = np.ones(t.num_rows, bool)
            keep[[d for d, *_ in shared.value.scan(h, w.first, similarity)]] = False
            yield from t.filter(pa.array(keep)).to_batches()

    return inner.mapInArrow(run, inner.schema)


def _scan(inner: DataFrame, items: Items, similarity: float) -> DataFrame:
    shared = inner.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        it = shared.value
        for t in blocks(batches, "_text"):
            w, h = _hashed(t.column("_text").combine_chunks())
            out = list(it.scan(h, w.first, similarity))
            ids = longs(t.column("_id"), NULL_ID)
            docs_, its, at, sim, size = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([ids_out(ids[docs_] if docs_ else np.zeros(0, np.int64)), pa.array([it.ids[j] for j in its], pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(sim, pa.float64())], ["_id", "item", "start_word", "n_words", "similarity"])

    return inner.mapInArrow(run, "_id long, item long, start_word long, n_words long, similarity double")
