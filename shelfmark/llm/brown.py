"""Language-model scoring with Brown classes: P(text) = product of P(class | class before) P(word | class).

Counting never joins token by token. Texts become *blocks*: local word numbers plus the
sorted hashes of the block's distinct words, stored once. Each block asks hash shards for
the training counts of its distinct words (one row per block and shard), the shards add up
all blocks' counts, and the answers return to the block. No vocabulary is broadcast, so it
may grow with the corpus, and so may the part of it that is clustered; what reaches the driver is bounded: the
``top`` most frequent words, the bigram table of them, of frequency bands and of the end mark, and that of the classes.

* Symbols: the ``top`` most frequent words one by one; every other word by the power of two
  below its count; words counted once share the class RARE with all unknown words; the end mark.
* Exchange clustering moves each top word, in order of frequency, to the class that raises the
  likelihood of the bigrams most, until a pass moves none (or ``passes``, if given, is reached).
* Every other word counted ``CLUSTERED`` times or more then makes one such move, all at once, to the class that raises the
  likelihood most as the counts stood before (the distributed exchange of Uszkoreit and Brants, 2008): tasks count the
  classes before and after each word, hash shards add them up and decide, and the blocks get the classes of their words.
* P(class | class before) is the bigram estimate with Dirichlet smoothing by the class unigram;
  P(word | class) = count / class count; within RARE an unknown word has the share n1 / (n1 + 2 n2)
  (Good-Turing; n_i: words counted i times, n2 at least 1), the words counted once share the rest.

Defined cases: null and empty texts consist of the end mark alone; null ids are in training;
rows that repeat count as often as they occur; with no training text at all every base probability is 1
and the model falls back on its uniform prior; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import count as count_up

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import discard, durable
from .kernel import NULL_ID, U64, blocks, buffers, grouped, hash_spans, ids_out, longs, lower_ascii, task_id, words

TOP, CLASSES, PRIOR = 1000, 64, 20.0
BANDS = 48
CLUSTERED = 8  # a power of two
_BOUND = "block long, ids binary, held binary, first binary, local binary, counts binary, syms binary, uniq binary"
_BLOCK = "block long, shard long, ids binary, held binary, first binary, local binary, uniq binary, counts binary"


def _column(batch, name, kind):
    return [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]


def squeeze(a: np.ndarray) -> bytes:
    """An array as one compressed value, which stays small in shuffles too."""
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _squeezed(batch, name, kind):
    return [np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True), kind) for x in batch.column(name).to_pylist()]


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of documents (_id, _held, _text): local word numbers (0-based, in order of hash; hash 0 is the
    end mark) and, as ``counts``, how often the block's training documents hold each distinct word."""

    def run(batches):
        for number, t in enumerate(blocks(batches, "_text")):
            data, offsets = buffers(t.column("_text"))
            w = words(lower_ascii(data), offsets)
            h = np.maximum(hash_spans(w.data, w.starts, w.ends, seed=5), U64(1))
            n = w.counts
            first = np.r_[0, np.cumsum(n + 1)]
            tokens = np.zeros(first[-1], U64)
            inner = np.ones(first[-1], bool)
            inner[first[1:] - 1] = False
            tokens[inner] = h
            uniq, local = np.unique(tokens, return_inverse=True)
            held = np.array(t.column("_held").to_pylist(), bool)
            learn = np.repeat(~held, n + 1)
            counts = np.bincount(local[learn], minlength=len(uniq))
            blobs = [x.tobytes() for x in (longs(t.column("_id"), NULL_ID), held, first)]
            blobs += [squeeze(local.astype(np.int32)), uniq.tobytes(), counts.astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([(task_id() << 24) + number]), pa.array([-1]), *(pa.array([b], pa.binary()) for b in blobs)], ["block", "shard", "ids", "held", "first", "local", "uniq", "counts"])

    return docs.mapInArrow(run, _BLOCK)


def count(encoded: DataFrame, shards: int, n_top: int = TOP) -> DataFrame:
    """Answers: per block and shard, the training counts of the block's words in that shard (``counts``);
    per shard, with block -1: ``uniq`` and ``counts`` of its most frequent words and, as ``first``, its words, tokens, n1, n2."""

    def ask(batches):
        for batch in batches:
            for block, uniq, counts in zip(batch.column("block").to_pylist(), _column(batch, "uniq", np.uint64), _column(batch, "counts", np.int64), strict=True):
                shard = (uniq % U64(shards)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(shard[by]) != 0])
                parts = np.split(by, heads[1:])
                yield pa.RecordBatch.from_arrays([pa.array(shard[by][heads]), pa.array([block] * len(parts)), pa.array([uniq[p].tobytes() for p in parts], pa.binary()), pa.array([counts[p].tobytes() for p in parts], pa.binary())], ["shard", "block", "uniq", "counts"])

    def add(batches):
        for g in grouped(batches, "shard"):
            hashes, counts = _column(g, "uniq", np.uint64), _column(g, "counts", np.int64)
            uniq, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(uniq)).astype(np.int64)
            answers = np.split(total[inverse], np.cumsum([len(x) for x in hashes])[:-1])
            own = np.flatnonzero((total > 0) & (uniq > 0))
            best = own[np.lexsort((uniq[own], -total[own]))][:n_top]
            facts = np.array([(total > 0).sum(), total.sum(), (total == 1).sum(), (total == 2).sum()], np.int64)
            shard = g.column("shard")[0].as_py()
            none = [None] * len(answers)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*g.column("block").to_pylist(), -1]), pa.array([shard] * (len(answers) + 1)), pa.array([*none, facts.tobytes()], pa.binary()), pa.array([*none, uniq[best].tobytes()], pa.binary()), pa.array([*(a.tobytes() for a in answers), total[best].tobytes()], pa.binary())],
                ["block", "shard", "first", "uniq", "counts"],
            )

    asked = encoded.select("block", "uniq", "counts").mapInArrow(ask, "shard long, block long, uniq binary, counts binary")
    return asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(add, "block long, shard long, first binary, uniq binary, counts binary")


def _facts(answers: DataFrame, n_top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals (words, tokens, n1, n2) and the most frequent words with their counts."""

    def flat(batches):
        for batch in batches:
            for f, u, c in zip(_column(batch, "first", np.int64), _column(batch, "uniq", np.uint64), _column(batch, "counts", np.int64), strict=True):
                u, c = np.r_[np.arange(4, dtype=np.uint64), u], np.r_[f, c]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(u)) < 4), pa.array(u.view(np.int64)), pa.array(c)], ["fact", "word", "n"])

    rows = answers.where("block = -1").mapInArrow(flat, "fact boolean, word long, n long")
    totals = np.zeros(4, np.int64)
    for r in rows.where("fact").groupBy("word").agg(F.sum("n").alias("n")).collect():  # four rows
        totals[r.word] = r.n
    best = rows.where("not fact").orderBy(F.desc("n"), "word").limit(n_top).collect()  # at most n_top rows
    return totals, np.array([r.word for r in best], np.int64).view(np.uint64), np.array([r.n for r in best], np.int64)


def symbols(uniq: np.ndarray, counts: np.ndarray, top: np.ndarray, n_top: int = TOP) -> np.ndarray:
    """The symbol of each word: its place among ``top``, else n_top + power of two below its count
    (n_top itself: counted once, or unknown), and n_top + BANDS for the end mark."""
    band = np.zeros(len(uniq), np.int64)
    band[counts > 0] = np.floor(np.log2(counts[counts > 0])).astype(np.int64)
    sym = n_top + np.minimum(band, BANDS - 1)
    order = np.argsort(top)
    at = np.minimum(np.searchsorted(top[order], uniq), max(len(top) - 1, 0))
    if len(top):
        hit = top[order][at] == uniq
        sym[hit] = order[at[hit]]
    sym[uniq == 0] = n_top + BANDS
    return sym


def spread(sym: np.ndarray, n_top: int) -> np.ndarray:
    """Which symbols stand for words that shards cluster."""
    return (sym >= n_top + int(np.log2(CLUSTERED))) & (sym < n_top + BANDS)


def bind(encoded: DataFrame, answers: DataFrame, top: np.ndarray, shards: int, n_top: int = TOP) -> DataFrame:
    """Each block with the training count and the symbol of its distinct words; hashes only of words that shards cluster."""

    def run(batches):
        for g in grouped(batches, "block"):
            rows = sorted(g.to_pylist(), key=lambda r: r["shard"])
            body, said = rows[0], rows[1:]
            uniq = np.frombuffer(body["uniq"], np.uint64)
            shard = (uniq % U64(shards)).astype(np.int64)
            counts = np.zeros(len(uniq), np.int64)
            counts[np.argsort(shard, kind="stable")] = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in said])
            sym = symbols(uniq, counts, top, n_top)
            yield pa.RecordBatch.from_arrays([pa.array([body["block"]]), *(pa.array([body[c]], pa.binary()) for c in ("ids", "held", "first", "local")), pa.array([squeeze(counts)], pa.binary()), pa.array([sym.astype(np.int16).tobytes()], pa.binary()), pa.array([uniq[spread(sym, n_top)].tobytes()], pa.binary())], ["block", "ids", "held", "first", "local", "counts", "syms", "uniq"])

    both = encoded.drop("counts").withColumn("counts", F.lit(None).cast("binary")).unionByName(answers.where("block >= 0").drop("first", "uniq"), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(run, _BOUND)


def bigrams(bound: DataFrame, size: int, end: int, fan: int = 256) -> np.ndarray:
    """Counts of neighbouring ``syms`` (fewer than ``size``) over all training documents; the ``end`` mark stands before
    each first word. Tasks' tables are added up by parts, ``fan`` of them at a time, so that no task gathers those of all others."""
    rows_each = 16

    def run(batches):
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            for held, first, local, sym in zip(_column(batch, "held", bool), _column(batch, "first", np.int64), _squeezed(batch, "local", np.int32), _column(batch, "syms", np.int16), strict=True):
                s = sym[local].astype(np.int64)
                before = np.r_[end, s[:-1]]  # each document ends with the end mark
                learn = np.repeat(~held, np.diff(first))
                table += np.bincount((before * size + s)[learn], minlength=size * size)
        at = np.flatnonzero(table)
        if len(at):
            part = at // (size * rows_each)
            heads = np.flatnonzero(np.r_[True, np.diff(part) != 0])
            cells, counts = np.split(at, heads[1:]), np.split(table[at], heads[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), task_id())), pa.array(part[heads]), pa.array([c.astype(np.int32).tobytes() for c in cells], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary())], ["task", "part", "cells", "counts"])

    def add(key, rows):
        cells, counts = (np.concatenate([np.frombuffer(x, k) for x in rows.column(c).to_pylist()]) for c, k in (("cells", np.int32), ("counts", np.int64)))
        uniq, inverse = np.unique(cells, return_inverse=True)
        total = np.bincount(inverse, weights=counts).astype(np.int64)
        task, part = (pa.array([k.as_py()], pa.int64()) for k in key)
        return pa.table({"task": task, "part": part, "cells": pa.array([uniq.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})

    table, schema = np.zeros(size * size, np.int64), "task long, part long, cells binary, counts binary"
    summed = bound.select("held", "first", "local", "syms").mapInArrow(run, schema)
    tasks = bound.rdd.getNumPartitions()
    while tasks > 1:
        summed = summed.withColumn("task", F.floor(F.col("task") / fan)).groupBy("task", "part").applyInArrow(add, schema)
        tasks = -(-tasks // fan)
    for r in summed.select("cells", "counts").collect():  # at most size**2 cells
        table[np.frombuffer(r.cells, np.int32)] = np.frombuffer(r.counts, np.int64)
    return table.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, movable: int, classes: int = CLASSES, passes: int | None = None) -> np.ndarray:
    """The class of each symbol: the first ``movable`` (in order of frequency) are clustered by exchange into
    ``classes`` classes, every other symbol keeps a class of its own."""
    size = len(n)
    classes = max(1, min(classes, movable))
    cls = np.r_[np.arange(movable) % classes, classes + np.arange(size - movable)]
    k = classes + size - movable
    n = n.astype(float)
    hot = np.zeros((size, k))
    hot[np.arange(size), cls] = 1
    N = hot.T @ n @ hot
    out_w, in_w = n.sum(1), n.sum(0)
    for _ in count_up() if passes is None else range(passes):  # each move raises the likelihood, so the passes end
        moved = 0
        for w in range(movable):
            a = cls[w]
            row, col, own = np.bincount(cls, n[w], k), np.bincount(cls, n[:, w], k), n[w, w]
            row[a] -= own
            col[a] -= own
            N[a] -= row
            N[:, a] -= col
            N[a, a] -= own
            left, right = np.bincount(cls, out_w, k)[:classes], np.bincount(cls, in_w, k)[:classes]
            left[a] -= out_w[w]
            right[a] -= in_w[w]
            c = np.arange(classes)
            down, across = _f(N[:classes] + row) - _f(N[:classes]), _f(N[:, :classes] + col[:, None]) - _f(N[:, :classes])
            diag = N[c, c]
            gain = down.sum(1) - down[c, c] + across.sum(0) - across[c, c] + _f(diag + row[:classes] + col[:classes] + own) - _f(diag)
            gain -= _f(left + out_w[w]) - _f(left) + _f(right + in_w[w]) - _f(right)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            cls[w] = b
            moved += b != a
            N[b] += row
            N[:, b] += col
            N[b, b] += own
        if not moved:
            break
    return cls


def contexts(bound: DataFrame, cls: np.ndarray, shards: int, n_top: int, flush: int = 4_000_000) -> DataFrame:
    """For the shards: with block -1, how often training documents hold each class before and after each word to cluster,
    added up over a task's blocks (``uniq``; ``runs``: cells of each word; ``codes``, ``counts``); per block, its words.
    Codes are classes, ``k`` for the word itself; those after a word come k + 1 later than those before it."""
    k = int(cls.max()) + 1
    names = ["shard", "block", "uniq", "runs", "codes", "counts"]

    def pack(held):
        words, codes, counts = summed(held, 2 * k + 2)
        shard = (words % U64(shards)).astype(np.int64)
        by = np.lexsort((codes, words, shard))
        words, codes, counts, shard = words[by], codes[by], counts[by], shard[by]
        heads = np.flatnonzero(np.r_[True, np.diff(shard) != 0])
        rows = []
        for i, j in zip(heads, np.r_[heads[1:], len(shard)], strict=True):
            new = np.flatnonzero(np.r_[True, words[i + 1 : j] != words[i : j - 1]])
            runs = np.diff(np.r_[new, j - i])
            rows.append((int(shard[i]), -1, words[i:j][new].tobytes(), runs.astype(np.int32).tobytes(), codes[i:j].astype(np.int16).tobytes(), counts[i:j].astype(np.int32).tobytes()))
        return _rows(rows, names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for block, held_out, first, local, sym, uniq in zip(batch.column("block").to_pylist(), _column(batch, "held", bool), _column(batch, "first", np.int64), _squeezed(batch, "local", np.int32), _column(batch, "syms", np.int16), _column(batch, "uniq", np.uint64), strict=True):
                place = np.full(len(sym), -1)
                place[np.flatnonzero(spread(sym, n_top))] = np.arange(len(uniq))
                token = cls[sym][local]
                at = np.flatnonzero((place[local] >= 0) & np.repeat(~held_out, np.diff(first)))
                # No such word is an end mark, so one follows each, and the one before the block's first is an end mark.
                left = np.where(at > 0, token[at - 1], cls[n_top + BANDS])
                left[(at > 0) & (local[at - 1] == local[at])] = k
                right = np.where(local[np.minimum(at + 1, len(local) - 1)] == local[at], k, token[np.minimum(at + 1, len(token) - 1)]) + k + 1
                held.append((np.tile(uniq[place[local[at]]], 2), np.r_[left, right], np.ones(2 * len(at), np.int64)))
                size += 2 * len(at)
                shard = (uniq % U64(shards)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(shard[by]) != 0]) if len(by) else []
                yield _rows([(int(shard[p[0]]), block, uniq[p].tobytes(), None, None, None) for p in np.split(by, heads[1:]) if len(p)], names)
                if size >= flush:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    return bound.select("block", "held", "first", "local", "syms", "uniq").mapInArrow(run, "shard long, block long, uniq binary, runs binary, codes binary, counts binary")


def _rows(rows: list, names: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)


def summed(parts: list, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (word, code, count) with each word and code once, in their order."""
    words, codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    uniq, inverse = np.unique(words, return_inverse=True)
    cells, which = np.unique(inverse * n_codes + codes, return_inverse=True)
    return uniq[cells // n_codes], cells % n_codes, np.bincount(which, weights=counts, minlength=len(cells)).astype(np.int64)


def best_classes(words: np.ndarray, codes: np.ndarray, counts: np.ndarray, pair: np.ndarray, classes: int, step: int = 40_000) -> np.ndarray:
    """For each distinct word of the sorted cells, which of the first ``classes`` classes raises the likelihood of the
    class bigrams ``pair`` most when it joins; the first of equals."""
    k = len(pair)
    pair = pair.astype(float)
    starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    out = []
    c = np.arange(classes)
    into, outof, diag = pair.sum(0)[:classes], pair.sum(1)[:classes], pair[c, c]
    # Context by context, what classes hold with it: before it joins, cells of classes in front of it, then behind it.
    context = np.zeros((2 * k + 2, classes))
    context[:k], context[k + 1 : 2 * k + 1] = pair[:, :classes], pair[:classes].T
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + step)))
        lo, hi = starts[i], starts[j] if j < len(starts) else len(words)
        code, n = codes[lo:hi], counts[lo:hi].astype(float)
        word = np.repeat(np.arange(j - i), np.diff(np.r_[starts[i:j], hi]))
        dense = np.zeros((j - i, 2 * k + 2))
        dense[word, code] = n
        col, row, own = dense[:, :classes], dense[:, k + 1 : k + 1 + classes], dense[:, k, None]
        total = dense[:, : k + 1].sum(1, keepdims=True)
        there = context[code]
        part = np.where(((code == k) | (code == 2 * k + 1))[:, None], 0.0, _f(there + n[:, None]) - _f(there))
        gain = np.add.reduceat(part, starts[i:j] - lo)
        gain -= _f(diag + row) + _f(diag + col) - _f(diag + row + col + own) - _f(diag)
        gain -= _f(into + total) - _f(into) + _f(outof + total) - _f(outof)
        out.append(np.argmax(gain, 1))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cluster(bound: DataFrame, cls: np.ndarray, pair: np.ndarray, classes: int, shards: int, n_top: int, keep: int = 2_000_000) -> DataFrame:
    """Blocks with the class of each distinct word as ``syms``. A shard holds the distinct cells of its words and at most
    ``keep`` more, however many tasks count them."""
    k = len(pair)

    def choose(batches):
        shard, held, size, words, chosen = None, [], 0, None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, held, size, words = r["shard"], [], 0, None
                uniq = np.frombuffer(r["uniq"], np.uint64)
                if r["block"] < 0:
                    codes, counts = np.frombuffer(r["codes"], np.int16).astype(np.int64), np.frombuffer(r["counts"], np.int32)
                    held.append((np.repeat(uniq, np.frombuffer(r["runs"], np.int32)), codes, counts))
                    size += len(codes)
                    if size > keep:
                        held, size = [summed(held, 2 * k + 2)], 0
                    continue
                if words is None:
                    cells = summed(held, 2 * k + 2)
                    held, words = [], np.unique(cells[0])
                    chosen = best_classes(*cells, pair, classes).astype(np.int16)
                rows.append((r["block"], shard, chosen[np.searchsorted(words, uniq)].tobytes()))
            yield _rows(rows, ["block", "shard", "syms"])

    def settle(batches):
        for g in grouped(batches, "block"):
            rows = sorted(g.to_pylist(), key=lambda r: r["shard"])
            body, said = rows[0], rows[1:]
            sym, uniq = np.frombuffer(body["syms"], np.int16), np.frombuffer(body["uniq"], np.uint64)
            own = cls[sym].astype(np.int16)
            if said:
                by = np.argsort((uniq % U64(shards)).astype(np.int64), kind="stable")
                own[np.flatnonzero(spread(sym, n_top))[by]] = np.concatenate([np.frombuffer(r["syms"], np.int16) for r in said])
            yield pa.RecordBatch.from_arrays([pa.array([body["block"]]), *(pa.array([x], pa.binary()) for x in (*(body[c] for c in ("ids", "held", "first", "local", "counts")), own.tobytes()))], ["block", "ids", "held", "first", "local", "counts", "syms"])

    asked = contexts(bound, cls, shards, n_top).repartition("shard").sortWithinPartitions("shard", "block")
    answers = asked.mapInArrow(choose, "block long, shard long, syms binary")
    both = bound.withColumn("shard", F.lit(-1).cast("long")).unionByName(answers, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(settle, _BOUND.removesuffix(", uniq binary"))


def transitions(pair: np.ndarray, rare: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class | class before), smoothed, from the counts of class pairs; and how often each class occurs."""
    in_class = pair.sum(0)
    live = in_class > 0
    live[[rare, end]] = True
    prior = np.where(live, in_class + 1, 0)
    prior = prior / prior.sum()
    with np.errstate(divide="ignore"):
        return np.log10((pair + PRIOR * prior) / (pair.sum(1, keepdims=True) + PRIOR)), in_class


def emissions(sym: np.ndarray, counts: np.ndarray, in_class: np.ndarray, unknown: float, alone: int, rare: int = TOP, end: int = TOP + BANDS) -> np.ndarray:
    """P(word | class) of words with these symbols (or classes) and training counts, in classes that occur ``in_class`` times.
    ``alone``: how many words of RARE are known; ``rare``, ``end``: the symbols of RARE and of the end mark."""
    out = np.where(sym == rare, np.where(counts > 0, (1 - unknown) / max(alone, 1), unknown), counts / np.maximum(in_class, 1))
    return np.where(sym == end, 1.0, out)


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, shard_words: int = 400_000, n_top: int = TOP) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.
    ``held_out`` is a boolean column; documents for which it is true (not null) are kept out of training."""
    inner = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text_col).cast("string").alias("_text"))
    n_bytes = inner.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = int(max(24, n_bytes // 6 // shard_words))
    encoded = durable(encode(inner), "lm-blocks")
    answers = durable(count(encoded, shards, n_top), "lm-counts")
    (n_words, n_train, n1, n2), top, top_counts = _facts(answers, n_top)
    bound = durable(bind(encoded, answers, top, shards, n_top), "lm-bound")
    discard(encoded, answers)
    n = bigrams(bound, n_top + BANDS + 1, n_top + BANDS)
    cls = exchange(n, len(top), classes) if len(top) else np.arange(len(n))
    k, rare, end = int(cls.max()) + 1, int(cls[n_top]), int(cls[n_top + BANDS])
    hot = np.zeros((len(n), k))
    hot[np.arange(len(n)), cls] = 1
    settled = durable(cluster(bound, cls, hot.T @ n @ hot, min(classes, len(top)), shards, n_top), "lm-classes")
    discard(bound)
    step, in_class = transitions(bigrams(settled, k, end), rare, end)
    # Words counted once that are among the top words have a class of their own and no share of RARE.
    alone = int(n1 - (top_counts == 1).sum())
    unknown = float(n1 / (n1 + 2 * max(n2, 1))) if alone else 1.0

    def run(batches):
        for batch in batches:
            for ids, held, first, local, counts, sym in zip(_column(batch, "ids", np.int64), _column(batch, "held", bool), _column(batch, "first", np.int64), _squeezed(batch, "local", np.int32), _squeezed(batch, "counts", np.int64), _column(batch, "syms", np.int16), strict=True):
                base = np.log10((counts + 0.1) / (n_train + 0.1 * (n_words + 1)))
                emit = emissions(sym, counts, in_class[sym], unknown, alone, rare, end)
                tokens = sym[local]
                before = np.r_[end, tokens[:-1]]
                log = step[before, tokens] + np.log10(np.maximum(emit, 1e-300))[local]
                at = first[:-1]
                size = np.diff(first)
                known = np.add.reduceat((counts > 0)[local].astype(np.int64), at)
                score = np.add.reduceat(log, at)
                out = [pa.array(held), pa.array(size), pa.array(known), pa.array(np.full(len(ids), n_train, np.int64)), pa.array(np.add.reduceat(base[local], at)), pa.array(score), pa.array(10 ** np.minimum(-score / size, 300))]
                yield pa.RecordBatch.from_arrays([ids_out(ids), *out], ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    scored = settled.drop("block").mapInArrow(run, "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return scored.withColumnRenamed("_id", id_col)
