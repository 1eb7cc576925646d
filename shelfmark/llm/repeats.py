"""Substring deduplication: remove words covered by a window of words that starts earlier elsewhere.

A window is ``width`` consecutive words of one document. Every word is removed that lies in
a window whose word sequence also starts earlier (smaller id, or same document and earlier
start); windows are judged on the input.

0. Documents become stored blocks (``kernel.packed``); all that follows is asked and answered by block.
1. *Sketch.* A window's *anchors* are its k-word sequences of least hash. Equal windows have equal
   anchors at different places, so the number of places of an anchor is an upper bound on the number of
   places of each window it stands for. Each block sends the cells of its distinct anchors (with a mark on those
   it holds twice) to hash segments, where the block sketches merge by addition into a two-row count-min sketch,
   and gets back one bit for each: "two or more". A segment has two rows of 2^``CELL_BITS`` cells and there are as many segments as
   the corpus asks for, so the sketch is as selective on a large corpus as on a small one, and nothing is broadcast.
2. *Exact pass.* Only windows whose anchor is estimated repeated go on. A block first settles
   repeats within itself; the first place of each window there goes to a hash shard, where
   equal windows meet (96-bit hash) and all but the earliest are marked. A window copied into a
   third of all documents reaches its shard once a block, not once a document; beyond ``fan`` blocks, once for
   each ``fan`` blocks (they settle it among themselves first).
3. *Marks* go back to their block, which cuts the words out.

Defined cases: null and empty texts have no words; documents shorter than a window lose none; rows with
the same id and text are one document seen twice (both rows get the same result); rows with the same id
and different texts are ordered by a hash of the text; null ids come after all others; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import NULL_ID, U64, buffers, from_bytes, grouped, hash_spans, ids_out, joined, longs, mix, packed, rolling, sliding, valid_runs, with_answers, without, words

WIDTH, ANCHOR = 20, 10
#: A segment has two rows of 2^19 cells; an anchor's two cells and its mark go into five bytes.
CELL_BITS, SHARD_WORDS, FAN = 19, 400_000, 1 << 16
_ANSWER = "block long, part long, answer binary"


def _word_hashes(table: pa.Table):
    w = words(*buffers(table.column("_text")))
    return w, hash_spans(w.data, w.starts, w.ends)


def _bodies(batches):
    """(block, body) of each row."""
    for batch in batches:
        yield from zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), strict=True)


class Anchors:
    """The anchors of a block: its distinct ones in order of segment, and where each window finds its own."""

    def __init__(self, h: np.ndarray, first: np.ndarray, width: int, k: int, segments: int, cell_bits: int = CELL_BITS):
        gram, self.whole = rolling(h, k, salt=3), valid_runs(first, width)
        self.least = sliding(gram, width - k + 1, np.minimum)  # of each window, by its start
        if self.whole.any():
            # A place is an anchor if it holds the least hash of some whole window around it.
            top, pad = np.where(self.whole, self.least, U64(0)), np.zeros(width - k, U64)
            best = sliding(np.r_[pad, top, pad], width - k + 1, np.maximum)
            self.distinct, n = np.unique(gram[(best == gram) & (best > 0)], return_counts=True)
        else:
            self.distinct, n = np.zeros(0, U64), np.zeros(0, np.int64)
        h = mix(self.distinct + U64(0x51ED270B))
        segment = (h >> U64(40)) % U64(segments)
        self.order = np.argsort(segment, kind="stable")
        self.segment = segment[self.order].astype(np.int64)
        self.cells = (h & U64((1 << 2 * cell_bits) - 1) | ((n > 1).astype(U64) << U64(39)))[self.order]

    def requests(self) -> tuple[list[int], list[bytes]]:
        """Segments, and the cells of the anchors that fall there, in five bytes each."""
        if not len(self.cells):
            return [], []
        heads = np.flatnonzero(np.r_[True, np.diff(self.segment) != 0])
        five = np.ascontiguousarray(self.cells.view(np.uint8).reshape(-1, 8)[:, :5])
        return self.segment[heads].tolist(), [five[a:b].tobytes() for a, b in zip(heads, np.r_[heads[1:], len(five)], strict=True)]

    def repeated(self, answers: list[bytes]) -> np.ndarray:
        """The windows (whole ones) whose anchor is estimated repeated. ``answers``: of the requests, in their order."""
        if not answers:
            return np.zeros(0, np.int64)
        _, n = np.unique(self.segment, return_counts=True)
        flag = np.zeros(len(self.distinct), bool)
        flag[self.order] = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=c) for a, c in zip(answers, n.tolist(), strict=True)]).astype(bool)
        at = np.flatnonzero(self.whole)
        return at[flag[np.searchsorted(self.distinct, self.least[at])]]


def _merge(batches, cell_bits: int = CELL_BITS):
    """The count-min sketch of a segment from the cells of all blocks, and each block's answer."""
    mask = U64((1 << cell_bits) - 1)
    for g in grouped(batches, "segment"):
        asked = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in g.column("cells").to_pylist()]
        five = np.concatenate(asked)
        wide = np.zeros((len(five), 8), np.uint8)
        wide[:, :5] = five
        code = wide.view(np.uint64).ravel()
        n = 1 + (code >> U64(39)).astype(np.int64)
        rows = [(code & mask).astype(np.int64), (code >> U64(cell_bits) & mask).astype(np.int64)]
        count = np.minimum(*(np.bincount(r, n, 1 << cell_bits)[r] for r in rows))
        ends = np.cumsum([len(x) for x in asked])
        bits = [np.packbits(count[e - len(x) : e] >= 2).tobytes() for x, e in zip(asked, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([g.column("block").combine_chunks(), g.column("segment").combine_chunks(), pa.array(bits, pa.binary())], ["block", "part", "answer"])


def estimate(blocks_: DataFrame, segments: int, width: int, k: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """Per block and segment: one bit for each anchor of the block there (block, part, answer)."""

    def ask(batches):
        for block, body in _bodies(batches):
            w, h = _word_hashes(from_bytes(body))
            segment, cells = Anchors(h, w.first, width, k, segments, cell_bits).requests()
            yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int64()), pa.array([block] * len(segment), pa.int64()), pa.array(cells, pa.binary())], ["segment", "block", "cells"])

    asked = blocks_.select("block", "body").mapInArrow(ask, "segment long, block long, cells binary")
    return asked.repartition("segment").sortWithinPartitions("segment").mapInArrow(lambda batches: _merge(batches, cell_bits), _ANSWER)


# -- exact pass ------------------------------------------------------------------------
_REQUEST = "shard long, block long, docs long, n long, places binary, hashes binary"


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the steps of rising numbers compress better than the numbers."""
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _stretch(value: bytes) -> bytes:
    return pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0).astype(np.int32)


def _places(doc: np.ndarray, start: np.ndarray) -> bytes:
    return _squeeze(_steps(doc), _steps(start))


def _read_places(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    doc, start = np.frombuffer(_stretch(value), np.int32).reshape(2, -1)
    return np.cumsum(doc, dtype=np.int64), np.cumsum(start, dtype=np.int64)


def _request(shard: int, block: int, ids, keys, doc, start, h64, h32) -> list:
    used, low = np.unique(doc, return_inverse=True)
    places = _squeeze(np.diff(ids[used], prepend=np.int64(0)), keys[used], _steps(low), _steps(start), _steps(doc))
    return [shard, block, len(used), len(doc), places, h64.tobytes() + h32.tobytes()]


def _read_request(docs: int, n: int, places: bytes, hashes: bytes) -> tuple[np.ndarray, ...]:
    """Of each window: id, key, start, the block's number of its document, h64, h32."""
    raw = _stretch(places)
    ids = np.cumsum(np.frombuffer(raw, np.int64, docs))
    keys = np.frombuffer(raw, np.int64, docs, 8 * docs)
    low, start, doc = np.cumsum(np.frombuffer(raw, np.int32, 3 * n, 16 * docs).reshape(3, n), axis=1, dtype=np.int64)
    return ids[low], keys[low], start, doc, np.frombuffer(hashes, np.uint64, n), np.frombuffer(hashes, np.uint32, n, 8 * n)


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    names = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if kind == "binary" else pa.int64()) for c, (_, kind) in zip(cols, names, strict=True)], [n for n, _ in names])


def _judged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a block to judge, by id and key, a row that repeats once; and all ids and keys."""
    ids, keys = longs(table.column("_id"), NULL_ID), longs(table.column("_key"), 0)
    order = np.lexsort((keys, ids))
    same = np.r_[False, (np.diff(ids[order]) == 0) & (np.diff(keys[order]) == 0)]
    return order[~same[: len(order)]], ids, keys


def _ask(shards: int, segments: int, width: int, k: int):
    def run(batches):
        for g in grouped(batches, "block"):
            answers = g.column("answer").to_pylist()
            if g.column("part")[0].as_py() != -1:
                raise ValueError("a block lacks its body")
            block, table = g.column("block")[0].as_py(), from_bytes(answers[0])
            rows, ids, keys = _judged(table)
            # Anchors are those of the whole block, as in the request; windows of a row that repeats are left out after.
            w, h = _word_hashes(table)
            at = Anchors(h, w.first, width, k, segments).repeated(answers[1:])
            rank = np.full(table.num_rows, -1)
            rank[rows] = np.arange(len(rows))
            doc = np.searchsorted(w.first, at, side="right") - 1
            start = at - w.first[doc]
            doc = rank[doc]
            mine = np.flatnonzero(doc >= 0)
            by = mine[np.lexsort((start[mine], doc[mine]))]
            at, doc, start = at[by], doc[by], start[by]
            if not len(at):
                continue
            ids, keys = ids[rows], keys[rows]
            h64, h32 = rolling(h, width, salt=1)[at], (rolling(h, width, salt=2)[at] >> U64(32)).astype(np.uint32)
            by = np.lexsort((h32, h64))  # stable: the earliest place of equal windows comes first
            repeat = np.zeros(len(at), bool)
            repeat[by[1:]] = (h64[by[1:]] == h64[by[:-1]]) & (h32[by[1:]] == h32[by[:-1]])
            out = []
            if repeat.any():  # settled here: an earlier place is in this block
                home = int(mix(np.array([block], np.uint64))[0] % U64(shards))
                out.append([-1 - home, block, 0, int(repeat.sum()), _places(doc[repeat], start[repeat]), b""])
            shard = np.where(repeat, -1, (h64 % U64(shards)).astype(np.int64))
            by = np.argsort(shard, kind="stable")[int(repeat.sum()) :]
            heads = np.flatnonzero(np.r_[True, np.diff(shard[by]) != 0])
            for p in np.split(by, heads[1:]) if len(by) else ():
                out.append(_request(int(shard[p[0]]), block, ids, keys, doc[p], start[p], h64[p], h32[p]))
            yield _batch(out, _REQUEST)

    return run


def _settle(last: bool):
    """Equal windows of a shard meet: all but the earliest place are marked. Rows of the next level, unless this is the
    last one, are the requests of windows not marked, with their hashes; marks have no hashes and a negative shard."""

    def run(batches):
        for group in grouped(batches, "key"):
            asked = group.drop_columns(["key"]).to_pylist()
            if asked[0]["shard"] < 0:
                yield _batch([list(r.values()) for r in asked], _REQUEST)
                continue
            parts = [_read_request(r["docs"], r["n"], r["places"], r["hashes"]) for r in asked]
            ids, keys, start, doc, h64, h32 = (np.concatenate([p[i] for p in parts]) for i in range(6))
            by = np.lexsort((start, keys, ids, h32, h64))
            new = np.r_[True, (np.diff(h64[by]) != 0) | (np.diff(h32[by]) != 0)]
            lead = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            later = np.zeros(len(by), bool)
            later[by] = (ids[by] != ids[lead]) | (keys[by] != keys[lead]) | (start[by] != start[lead])
            out, end = [], 0
            for r in asked:
                begin, end = end, end + r["n"]
                mark = later[begin:end]
                if mark.any():
                    out.append([-1 - r["shard"], r["block"], 0, int(mark.sum()), _places(doc[begin:end][mark], start[begin:end][mark]), b""])
                if not last and not mark.all():
                    left = begin + np.flatnonzero(~mark)
                    used, low = np.unique(doc[left], return_inverse=True)
                    at = left[np.unique(low, return_index=True)[1]]
                    places = _squeeze(np.diff(ids[at], prepend=np.int64(0)), keys[at], _steps(low), _steps(start[left]), _steps(doc[left]))
                    out.append([r["shard"], r["block"], len(used), len(left), places, h64[left].tobytes() + h32[left].tobytes()])
            yield _batch(out, _REQUEST)

    return run


def repeated_places(blocks_: DataFrame, width: int = WIDTH, k: int = ANCHOR, segments: int | None = None, cell_bits: int = CELL_BITS, shard_words: int = SHARD_WORDS, fan: int = FAN) -> DataFrame:
    """Per block, the places (document of the block, first word) of windows to remove: block, part, answer."""
    facts = blocks_.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    n_words = max(1, (facts["size"] or 0) // 6)
    # About 2 / (width - k + 2) of all places are anchors; three cells for each in either row.
    segments = segments or int(max(24, (n_words * 6 // (width - k + 2) >> cell_bits) + 1))
    shards = int(max(n_words // shard_words, 32))
    asked = with_answers(blocks_, estimate(blocks_, segments, width, k, cell_bits)).mapInArrow(_ask(shards, segments, width, k), _REQUEST)
    if facts["n"] > fan:  # so many blocks that one window could fill a shard: they settle it in parts first
        part = F.xxhash64("shard", F.pmod(F.xxhash64("block"), F.lit(-(-facts["n"] // fan)))).bitwiseAND(F.lit(2**63 - 1))
        asked = asked.withColumn("key", F.when(F.col("shard") < 0, F.col("shard")).otherwise(part)).repartition("key").sortWithinPartitions("key").mapInArrow(_settle(False), _REQUEST)
    marks = asked.withColumn("key", F.col("shard")).repartition("key").sortWithinPartitions("key").mapInArrow(_settle(True), _REQUEST)
    return marks.where("shard < 0").select("block", (-F.col("shard")).alias("part"), F.col("places").alias("answer"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", width: int = WIDTH) -> DataFrame:
    """All rows and columns of ``docs`` with the repeats cut out of the texts; texts that lose none keep every byte.
    ``size_col``, if there is such a column, becomes the length of a text that was cut."""
    names = docs.columns
    others = [c for c in names if c != text_col]
    plain = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text_in"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))
    cut = remove_repeats(plain, "_doc", "_text_in", width, tuple(f"c{i}" for i in range(len(others))), spaced=False)
    new = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text_col: F.col("kept").cast(docs.schema[text_col].dataType)}
    if size_col in others:
        new[size_col] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[size_col].dataType)).otherwise(new[size_col])
    return cut.select(*(new[c].alias(c) for c in names))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep: tuple[str, ...] = (), spaced: bool = True, segments: int | None = None, cell_bits: int = CELL_BITS, fan: int = FAN) -> DataFrame:
    """One row per document: id, the columns of ``keep``, n_words, n_removed, and ``kept``: the words left, joined by one
    space, or, unless ``spaced``, the text without the removed words and the white space behind them, all other bytes
    untouched (null stays null)."""
    text = F.col(text_col).cast("string")
    inner = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))).alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    kept = [f"_keep_{c}" for c in keep]
    schema = ", ".join(["_id long", *(f"`_keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_words long, n_removed long, kept string"])
    stored = packed(inner, "_text")

    def cut(batches):
        for g in grouped(batches, "block"):
            answers = g.column("answer").to_pylist()
            table = from_bytes(answers[0])
            rows, ids, keys = _judged(table)
            data, offsets = buffers(table.column("_text"))
            w = words(data, offsets)
            gone = np.zeros(len(w.starts), bool)
            if len(answers) > 1:
                doc, start = (np.concatenate(x) for x in zip(*map(_read_places, answers[1:]), strict=True))
                step = np.zeros(len(w.starts) + 1, np.int64)
                at = w.first[rows[doc]] + start
                np.add.at(step, at, 1)
                np.add.at(step, at + width, -1)
                gone = np.cumsum(step)[:-1] > 0
                # A row that repeats is cut like the one that was judged.
                order = np.lexsort((keys, ids))
                new = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(keys[order]) != 0)]
                lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                for a, b in zip(order[~new], lead[~new], strict=True):
                    gone[w.first[a] : w.first[a + 1]] = gone[w.first[b] : w.first[b + 1]]
            lost = np.diff(np.r_[0, np.cumsum(gone)][w.first])
            left = joined(w, ~gone) if spaced else without(w, gone, offsets, pc.is_null(table.column("_text").combine_chunks()))
            yield from pa.Table.from_arrays([ids_out(longs(table.column("_id"), NULL_ID)), *(table.column(c) for c in kept), pa.array(w.counts), pa.array(lost), left], ["_id", *kept, "n_words", "n_removed", "kept"]).to_batches()

    marked = with_answers(stored, repeated_places(stored, width, segments=segments, cell_bits=cell_bits, fan=fan))
    out = marked.mapInArrow(cut, schema)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_keep_{c}").alias(c) for c in keep), "n_words", "n_removed", "kept")
