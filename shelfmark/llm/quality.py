"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or abstain on every document. Expectation-
maximisation over the counts of all vote patterns (at most 3^8, summed over all documents)
estimates how accurate each labeller is and gives every pattern a posterior. Posterior labels of a
bounded sample (``sample`` documents, chosen by a hash of the id, whole texts) train a hashed linear
scorer, which then scores every whole text. The scorer sees the text alone, never a vote: hashed byte trigrams, and in
bins the number of words and the share of word triples that repeat. Toxicity does not
speak for layout quality, so it is judged apart: where ``labels`` mark texts as toxic, words are learned that only toxic texts
hold, and a document that holds one is marked toxic and not kept, whatever its score. Nothing is known to be
toxic without labels; there is no word list.

Defined cases: a null text counts as empty; a text without words is bad (probability 0, not kept); rows
that repeat give repeated rows; null ids stay null and are scored like others; of repeated ids in ``labels`` each row counts;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import NOT_ALNUM, NULL_ID, U64, WHITE, blocks, buffers, hash_spans, ids_out, loads, longs, mix, rolling, valid_runs, words

LABELLERS = ("symbols", "symbol_words", "capitals", "capital_words", "variety", "echoes", "lines", "length")
BUCKETS, SAMPLE, LABELLED, STEPS, RATE = 1 << 16, 1500, 6000, 40, 0.5
#: Bins of the two shapes of a text (words, in powers of two; share of repeated word triples), and their feature value.
BINS, SHAPE_VALUE = 24, 0.1
#: Longest text, in bytes, that is learned from.
MOST_BYTES = 200_000

_SYMBOL = NOT_ALNUM & ~WHITE & (np.arange(256) < 128)
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = True
_ODD = _SYMBOL & ~_PLAIN
_UPPER, _LOWER = (np.array([b < 128 and getattr(chr(b), f)() for b in range(256)]) for f in ("isupper", "islower"))


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums by document, in double precision; the same for the same document, whatever its place in the block."""
    out, some = np.zeros(len(offsets) - 1), np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values, offsets[some], dtype=float)
    return out


def votes_of(column) -> np.ndarray:
    """Votes, documents x labellers; -1 abstains. Detectors of one fault overlap, and speak only when they fire."""
    data, off = buffers(column)
    size = np.maximum(np.diff(off), 1)
    w = words(data, off)
    n = w.counts
    h = hash_spans(w.data, w.starts, w.ends)
    doc = w.doc_of_word()
    by = np.lexsort((h, doc))
    new = np.r_[True, (np.diff(h[by]) != 0) | (np.diff(doc[by]) != 0)] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(doc[by][new], minlength=len(n))
    echo = np.r_[False, (np.diff(h) == 0) & (np.diff(doc) == 0)] if len(h) else np.zeros(0, bool)
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = words(data, off, newline)
    lh, ldoc = hash_spans(lines.data, lines.starts, lines.ends), lines.doc_of_word()
    by = np.lexsort((lh, ldoc))
    again = np.r_[False, (np.diff(lh[by]) == 0) & (np.diff(ldoc[by]) == 0)] if len(lh) else np.zeros(0, bool)
    repeated = np.bincount(ldoc[by][again], minlength=len(n))
    upper, lower = _per_doc(_UPPER[data], off), _per_doc(_LOWER[data], off)

    def in_words(table):  # how many bytes of the table each word holds
        total = np.r_[0, np.cumsum(table[data])]
        return total[w.ends] - total[w.starts]

    def share(flag):
        return np.bincount(doc[flag], minlength=len(n)) / np.maximum(n, 1)

    def vote(value, good, bad, speak=True):
        return np.where(speak & good(value), 1, np.where(speak & bad(value), 0, -1))

    silent = lambda x: np.zeros(len(x), bool)
    out = [
        vote(_per_doc(_ODD[data], off) / size, lambda x: x < 0.005, lambda x: x > 0.05),
        vote(share(in_words(_ODD) > 0), silent, lambda x: x > 0.2),
        vote(upper / np.maximum(upper + lower, 1), lambda x: x < 0.15, lambda x: x > 0.4),
        vote(share((in_words(_UPPER) > 1) & (in_words(_LOWER) == 0)), silent, lambda x: x > 0.3),
        vote(distinct / np.maximum(n, 1), lambda x: x > 0.4, lambda x: x < 0.15, n >= 30),
        vote(share(echo), silent, lambda x: x > 0.15),
        vote(repeated / np.maximum(lines.counts, 1), silent, lambda x: x > 0.6, lines.counts > 5),
        vote(n, lambda x: x >= 40, lambda x: x < 5),
    ]
    votes = np.stack(out, 1)
    votes[n == 0] = 0
    return votes


def toxic_keys(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a column, lower-cased, and of their first six bytes, with the document of each."""
    w = words(*buffers(pc.utf8_lower(column)), NOT_ALNUM)
    doc = w.doc_of_word()
    long = np.flatnonzero(w.ends - w.starts > 6)
    whole = hash_spans(w.data, w.starts, w.ends)
    stem = hash_spans(w.data, w.starts[long], w.starts[long] + 6, seed=1)
    return np.r_[whole, stem], np.r_[doc, doc[long]]


def learn_lexicon(texts: list[str], toxic: np.ndarray, purity: float = 0.97, chance: float = 0.01) -> np.ndarray:
    """Words and word beginnings that nearly only toxic texts hold, in so many of them that among all words less than
    ``chance`` would do so by accident."""
    if not texts or not toxic.any() or toxic.all():
        return np.zeros(0, U64)
    keys, flags = [], []
    for begin in range(0, len(texts), 500):  # in slices, so that memory holds one key a text and word
        key, doc = toxic_keys(pa.array(texts[begin : begin + 500], pa.string()))
        by = np.lexsort((doc, key))
        key, doc = key[by], doc[by]
        new = np.r_[True, (np.diff(key) != 0) | (np.diff(doc) != 0)][: len(key)]
        keys.append(key[new])
        flags.append(toxic[begin + doc[new]])
    key, flag = np.concatenate(keys), np.concatenate(flags)
    uniq, at = np.unique(key, return_inverse=True)
    n, bad = np.bincount(at), np.bincount(at, flag)
    least = np.log(chance / max(len(uniq), 1)) / np.log(toxic.mean())
    return uniq[(n >= least) & (bad >= purity * n)]


def is_toxic(column, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(column), bool)
    key, doc = toxic_keys(column)
    hit = lexicon[np.minimum(np.searchsorted(lexicon, key), len(lexicon) - 1)] == key
    return np.bincount(doc[hit], minlength=len(column)) > 0


def pattern(votes: np.ndarray) -> np.ndarray:
    """Votes as one number in base 3."""
    return (votes + 1) @ (3 ** np.arange(votes.shape[1]))


def unpattern(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, least: tuple[float, float] = (0.02, 0.9)) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good | pattern) of each vote pattern, each labeller's accuracy on bad and on good documents, and the
    share of good ones. Labellers err independently given the class. It starts from "one fault makes a document
    bad": each labeller knows one fault, so on documents with another fault its good votes are wrong as a rule.
    ``least``: accuracies are at least that on bad and on good documents. Faults exclude each other more often than
    independence allows, and without a floor on good documents the two classes can settle as "this fault" and "all else"."""
    said, yes = votes >= 0, votes == 1
    post = np.where((said & ~yes).any(1), 0.05, 0.95)
    accuracy, share = np.zeros((votes.shape[1], 2)), 0.5
    for _ in range(rounds):
        share = float((post @ counts + 1) / (counts.sum() + 2))
        for side, weight in enumerate((counts * (1 - post), counts * post)):
            right = said & (yes == bool(side))
            # A weak prior, and on good documents a floor, keep a labeller from turning round.
            accuracy[:, side] = np.clip((weight @ right + 4) / (weight @ said + 5), least[side], 0.999)
        good = np.log(share) + (said * np.where(yes, np.log(accuracy[:, 1]), np.log(1 - accuracy[:, 1]))).sum(1)
        bad = np.log(1 - share) + (said * np.where(yes, np.log(1 - accuracy[:, 0]), np.log(accuracy[:, 0]))).sum(1)
        new = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post, accuracy, share


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of the byte trigram at each position, and which positions have one inside their document."""
    at = loads(data)[: len(data)] & U64(0xFFFFFF)
    room = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))
    return (mix(at + U64(1)) % U64(BUCKETS)).astype(np.int32), room >= 3


def shapes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two features of each document, beyond the buckets of the trigrams: how many words, and which share of its word
    triples repeats an earlier one, both in bins."""
    w = words(data, off)
    n = w.counts
    triple = rolling(hash_spans(w.data, w.starts, w.ends), 3, salt=5)
    doc = w.doc_of_word()[: len(triple)]
    whole = valid_runs(w.first, 3)[: len(triple)]
    doc = doc[whole]
    key = mix(triple[whole] + mix(doc.astype(U64) + U64(1)))
    order = np.argsort(key)
    same = np.r_[False, key[order][1:] == key[order][:-1]][: len(key)]
    again = np.bincount(doc[order][same], minlength=len(n))
    share = again / np.maximum(n - 2, 1)
    size = np.minimum(np.log2(np.maximum(n, 1)).astype(int), BINS - 1)
    return BUCKETS + np.stack([size, BINS + np.minimum((share * BINS).astype(int), BINS - 1)], 1)


def margins(weight: np.ndarray, bias: float, column) -> np.ndarray:
    data, off = buffers(column)
    b, ok = grams(data, off)
    value = np.where(ok, weight[b], 0)
    return bias + _per_doc(value, off) / np.maximum(_per_doc(ok, off), 1) + SHAPE_VALUE * weight[shapes(data, off)].sum(1)


def train_scorer(texts: list[str], target: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over a text's hashed trigrams (their mean weight) and its shapes, fitted to soft labels."""
    size = BUCKETS + 2 * BINS
    weight, bias = np.zeros(size), 0.0
    if not texts:
        return weight, bias
    data, off = buffers(pa.array(texts, pa.string()))
    b, ok = grams(data, off)
    doc = np.repeat(np.arange(len(texts)), np.diff(off))[ok]
    key, count = np.unique(doc * BUCKETS + b[ok], return_counts=True)
    doc, b = key // BUCKETS, key % BUCKETS
    x = count / np.maximum(np.bincount(doc, count, len(texts)), 1)[doc]
    more = shapes(data, off)
    doc = np.r_[doc, np.repeat(np.arange(len(texts)), more.shape[1])]
    b, x = np.r_[b, more.ravel()], np.r_[x, np.full(more.size, SHAPE_VALUE)]
    classes = np.maximum([(1 - target).sum(), target.sum()], 1e-9)
    importance = target / classes[1] + (1 - target) / classes[0]  # both classes weigh alike
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for n in range(1, steps + 1):
        z = bias + np.bincount(doc, x * weight[b], len(texts))
        diff = importance * (target - 1 / (1 + np.exp(-np.clip(z, -500, 500))))
        g, gb = np.bincount(b, x * diff[doc], size) - 1e-6 * weight, diff.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**n, 1 - 0.99**n
        weight += RATE * 10 * (m / c) / (np.sqrt(v / d) + 1e-9) * (np.abs(g) > 0)
        bias += RATE * 0.1 * (mb / c) / (np.sqrt(vb / d) + 1e-9)
    return weight, bias


def _lexicon(inner: DataFrame, labels: DataFrame | None, id_col: str, labelled: int) -> np.ndarray:
    if labels is None:
        return np.zeros(0, U64)
    own = labels.where(F.col("toxic").isNotNull()).select(F.col(id_col).cast("long").alias("_id2"), (F.col("toxic") > 0).alias("bad"))
    share = min(1.0, 1.2 * labelled / max(own.count(), 1))
    chosen = own.where(F.pmod(F.xxhash64(F.lit("toxic"), "_id2"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * labelled)
    rows = inner.join(F.broadcast(chosen), F.col("_id") == F.col("_id2")).where(F.octet_length("_text") <= MOST_BYTES).select("_text", "bad").limit(4 * labelled)
    got = [(r._text, r.bad) for r in rows.toLocalIterator()]
    return learn_lexicon([t for t, _ in got], np.array([b for _, b in got], bool))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None, sample: int = SAMPLE, labelled: int = LABELLED, threshold: float = 0.5) -> DataFrame:
    """One row per document: id, p_weak (posterior of the labellers), p_quality (the trained scorer), votes
    (one letter a labeller: g, b or -), toxic, keep (p_quality >= threshold and not toxic). ``labels`` (id, toxic 0/1),
    if given, teaches which words are toxic; about ``labelled`` of its rows are learned from."""
    inner = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def vote(batches):
        for t in blocks(batches, "_text"):
            votes = votes_of(t.column("_text").combine_chunks())
            code, n = np.unique(pattern(votes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    rows = inner.select("_text").mapInArrow(vote, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most 3^8
    code, n = np.array([r.code for r in rows], np.int64), np.array([r.n for r in rows], float)
    order = np.argsort(code)
    code, n = code[order], n[order]
    post, _, _ = expectation_maximisation(unpattern(code), n) if len(code) else (np.zeros(0), None, 0.0)
    total = int(n.sum())
    draw = F.pmod(F.xxhash64(F.lit("quality"), "_id"), F.lit(1 << 30))
    chosen = inner.where(F.coalesce(F.octet_length("_text") <= MOST_BYTES, F.lit(True)) & (draw < int(min(1.0, 1.3 * sample / max(total, 1)) * (1 << 30)))).select(draw.alias("draw"), F.coalesce("_text", F.lit("")).alias("_text"))
    texts = [r._text for r in chosen.orderBy("draw", "_text").limit(sample).toLocalIterator()]
    lexicon = _lexicon(inner, labels, id_col, labelled)
    known = dict(zip(code.tolist(), post.tolist(), strict=True))
    column = pa.array(texts, pa.string())
    said = votes_of(column)
    weight, bias = train_scorer(texts, np.array([known[c] for c in pattern(said).tolist()]))
    shared = inner.sparkSession.sparkContext.broadcast((code, post, weight.astype(np.float32), bias, lexicon))

    def score(batches):
        codes, posts, wt, b0, lexicon = shared.value
        for t in blocks(batches, "_text"):
            text = t.column("_text").combine_chunks()
            votes, toxic = votes_of(text), is_toxic(text, lexicon)
            weak = posts[np.searchsorted(codes, pattern(votes))]
            p = 1 / (1 + np.exp(-np.clip(margins(wt, b0, text), -500, 500)))
            empty = words(*buffers(text)).counts == 0
            p[empty] = 0
            said = np.array(["-", "b", "g"])[votes + 1]
            yield pa.RecordBatch.from_arrays([ids_out(longs(t.column("_id"), NULL_ID)), pa.array(weak), pa.array(p), pa.array(["".join(v) for v in said], pa.string()), pa.array(toxic), pa.array((p >= threshold) & ~toxic)], ["_id", "p_weak", "p_quality", "votes", "toxic", "keep"])

    return inner.mapInArrow(score, "_id long, p_weak double, p_quality double, votes string, toxic boolean, keep boolean").withColumnRenamed("_id", id_col)
