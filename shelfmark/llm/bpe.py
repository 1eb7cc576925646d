"""Byte-level BPE: encoding by batched numpy merge rounds, decoding, and token counts of every prefix.

The vocabulary comes from a public ``tokenizers`` JSON file whose path is a parameter; the
driver reads it (a few MB, the size is checked) and broadcasts it (encoding and decoding need a few
flat arrays only, prefix counts its text), so executors need no file of their own. A text is cut at the special strings, then by the tokenizer's pattern
into *pieces*; a piece's tokens do not depend on its surroundings, so each worker keeps a
table of the pieces it has met and works only on new ones.

Defined cases, for every operator here: a null text counts as empty; an empty text has no
tokens and decodes to the empty string; rows repeat as given; columns other than the id and
the text are ignored (or carried, where a function says so); an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import blocks, ids_out, longs, NULL_ID

#: The pattern of the byte-level pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts that hold only ASCII and Latin letters; the standard engine runs it twice as fast.
_LETTERS, _SPACES = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "\t\n\x0b\x0c\r "
LATIN_PATTERN = rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{_SPACES}{_LETTERS}0-9]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
NOT_LATIN = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
ANY_TEXT, LATIN_TEXT = regex.compile(PATTERN), re.compile(LATIN_PATTERN)
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
MAX_VOCAB_BYTES = 64_000_000
#: Bytes of text a worker turns into pieces at a time: pieces take some thirty times the memory of their text.
TEXT_BYTES = 1_500_000
#: Pieces a worker keeps; the table starts anew beyond it (results do not depend on it).
TABLE_PIECES = 200_000
#: The same for prefix counts, which cost far more to make again.
PREFIXED_PIECES = 800_000
NEVER = 1 << 40


def read_vocab(path: str) -> str:
    """The JSON text of a tokenizer file, for broadcasting; refuses files that are too large to broadcast."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_VOCAB_BYTES + 1)
    if len(text) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return text


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else 256 onwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Coder:
    """All that encoding and decoding need of a vocabulary, as flat arrays: light enough to broadcast."""

    def __init__(self, spec: dict):
        letters = _byte_letters()
        of = spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        spelled = {i: bytes(letters[c] for c in t) for t, i in of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.size = max(spelled) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([of[a] * self.size + of[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([of[a + b] for a, b in merges], np.int64)[order]
        self.byte_id = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_id[byte] = of[letter]
        # Spelling of id i: spell[spell_at[i]:spell_at[i + 1]]; the one after the last is empty.
        names = [spelled.get(i, b"") for i in range(self.size + 1)]
        self.spell = np.frombuffer(b"".join(names), np.uint8)
        self.spell_at = np.r_[0, np.cumsum([len(n) for n in names])]
        self.table: _Encoded | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def known(self) -> _Encoded:
        """The worker's table of pieces, kept while the worker is reused."""
        self.table = self.table or _Encoded(self)
        return self.table

    # -- pieces ------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The text's pieces in order; a special string is one piece."""
        if not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        cut = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        for part in re.split(f"({cut})", text):
            out += [part] if part in self.special else self.split(part)
        return out

    def split(self, text: str) -> list[str]:
        """Pieces of a text in which special strings count as ordinary."""
        return (ANY_TEXT if NOT_LATIN.search(text) else LATIN_TEXT).findall(text)

    # -- encoding ----------------------------------------------------------------
    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, back to back, and the number of each. Merge rounds over one flat array:
        in each round every piece merges all occurrences of its lowest-ranked pair."""
        return self.encode_bytes([p.encode("utf-8", "surrogatepass") for p in pieces])

    def encode_bytes(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in raw], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), NEVER, np.int64)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[heads, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, heads), lengths)
            final = least == NEVER
            if final.any():
                done.append((word[final], sym[final]))
            pick = (rank == least) & ~final
            chosen = np.flatnonzero(pick)
            if len(chosen):  # of overlapping occurrences (a a a) every second one merges
                run = np.r_[True, np.diff(chosen) != 1]
                begin = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - begin) % 2 == 0]
                sym[chosen] = self.made[at[chosen]]
                final[chosen + 1] = True
            sym, word = sym[~final], word[~final]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        w, s = (np.concatenate(x) for x in zip(*done, strict=True))
        return s[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(raw))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(text):
            out += [self.special[p]] if p in self.special else self.encode_pieces([p])[0].tolist()
        return out

    # -- decoding ----------------------------------------------------------------
    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run ids[bounds[i]:bounds[i + 1]]; ids that the vocabulary lacks spell nothing."""
        ids = np.where((ids < 0) | (ids >= self.size), self.size, ids)
        sizes = self.spell_at[ids + 1] - self.spell_at[ids]
        ends = np.r_[0, np.cumsum(sizes)]
        data = self.spell[np.repeat(self.spell_at[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        edge = ends[bounds].tolist()
        return [data[b:e].decode("utf-8", "replace") for b, e in zip(edge, edge[1:])]


class Vocab(Coder):
    """A coder with what the prefix dynamic programme needs besides."""

    def __init__(self, text: str):
        spec = json.loads(text)
        super().__init__(spec)
        letters, of = _byte_letters(), spec["model"]["vocab"]
        id_of = {bytes(letters[c] for c in t): i for t, i in of.items()}
        self.longest = max(map(len, id_of))
        self.merge = {}
        self.parts = {}
        for key, rank, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made.tolist(), strict=True):
            a, b = divmod(key, self.size)
            self.merge[a, b] = rank
            if m not in self.parts or rank < self.parts[m][2]:
                self.parts[m] = a, b, rank
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[int, int], bool] = {}
        self.lately: tuple[bytes, list[int], list[int]] = (b"", [-1], [0])
        # Only tokens that their own bytes encode to can end a prefix.
        tokens = list(id_of)
        ids, n = self.encode_bytes(tokens)
        self.ending = {t: id_of[t] for t, i, k in zip(tokens, ids[np.cumsum(n) - n].tolist(), n.tolist(), strict=True) if k == 1 and i == id_of[t]}

    # -- prefix dynamic programme --------------------------------------------------
    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Symbols that stand at the left (0) or right (1) edge of a token while it is built, each with
        the rank that formed it and the rank that consumed it."""
        if token not in self.spines[side]:
            out, now, consumed = [], token, NEVER
            while now in self.parts:
                rank = self.parts[now][2]
                out.append((now, rank, consumed))
                now, consumed = self.parts[now][side], rank
            self.spines[side][token] = [*out, (now, -1, consumed)]
        return self.spines[side][token]

    def _apart(self, left: int, right: int) -> bool:
        """True if the bytes of the two tokens, side by side, encode to just these two."""
        apart = True
        for x, x_made, x_gone in self._spine(left, 1):
            for y, y_made, y_gone in self._spine(right, 0):
                rank = self.merge.get((x, y), NEVER)
                if x_made < rank < x_gone and y_made < rank <= y_gone and rank < NEVER:
                    apart = False
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[left, right] = apart
        return apart

    def prefix_counts(self, raw: bytes) -> list[int]:
        """Tokens of each prefix raw[:1], raw[:2], ... of one piece. The last token of a prefix is the one
        token t, ending there, that stays apart from the last token of what precedes it."""
        get, fits, longest = self.ending.get, self.fits.get, self.longest
        before, last, count = self.lately  # what this piece shares with the one before it is known
        same = len(commonprefix((raw, before)))
        last, count = last[: same + 1], count[: same + 1]
        for i in range(same + 1, len(raw) + 1):
            for j in range(max(0, i - longest), i):
                t = get(raw[j:i])
                if t is not None:
                    if j and (apart := fits((last[j], t))) is None:
                        apart = self._apart(last[j], t)
                    if not j or apart:
                        last.append(t)
                        count.append(count[j] + 1)
                        break
        self.lately = raw, last, count
        return count[1:]


@lru_cache(maxsize=2)
def _coder(text: str) -> Coder:
    return Coder(json.loads(text))


@lru_cache(maxsize=2)
def _vocab(text: str) -> Vocab:
    return Vocab(text)


class _Encoded:
    """A worker's table of pieces: ids of each, back to back."""

    most = TABLE_PIECES

    def __init__(self, vocab: Coder):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.n, self.begin = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, pieces: list[str]) -> np.ndarray:
        if len(self.row) > self.most:
            self.clear()
        row = np.fromiter(map(self.row.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(row < 0).tolist()
        if missing:
            new = sorted({pieces[i] for i in missing})
            ids, n = self.measure(new)
            self.ids, self.n = np.r_[self.ids, ids], np.r_[self.n, n]
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            self.begin = np.cumsum(self.n) - self.n
            row[missing] = [self.row[pieces[i]] for i in missing]
        return row

    def measure(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.vocab.special
        ids, n = self.vocab.encode_pieces(["" if p in special else p for p in new])
        at = np.cumsum(n) - n
        for i in [i for i, p in enumerate(new) if p in special][::-1]:
            ids = np.insert(ids, at[i], special[new[i]])
            n[i] = 1
        return ids.astype(np.int32), n


class _Prefixed(_Encoded):
    """A worker's table of pieces: tokens of each prefix that ends at a character, back to back."""

    most = PREFIXED_PIECES

    def clear(self) -> None:
        super().clear()
        self.total = np.zeros(0, np.int64)

    def measure(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        n, total = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        for k, p in enumerate(new):
            counts = prefix_counts(self.vocab, p)
            flat += counts
            n[k], total[k] = len(counts), counts[-1] if counts else 0
        self.total = np.r_[self.total, total]
        return np.array(flat, np.int32), n


def prefix_counts(vocab: Vocab, piece: str) -> list[int]:
    """Tokens of piece[:1], piece[:2], ... when nothing follows; the last is the piece's own count."""
    if piece in vocab.special:
        return [sum(prefix_counts(vocab, q)[-1] for q in vocab.pieces(piece[:i])) for i in range(1, len(piece))] + [1]
    if piece in CONTRACTIONS:  # cut short, an apostrophe and the letters after it are two pieces
        own = vocab.prefix_counts(piece.encode())
        return [own[0], *(own[0] + vocab.prefix_counts(piece[1:i].encode())[-1] for i in range(2, len(piece))), own[-1]]
    counts = vocab.prefix_counts(raw := piece.encode("utf-8", "surrogatepass"))
    if len(raw) == len(piece):
        return counts
    ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])
    return [counts[e - 1] for e in ends]


def text_prefix_counts(vocab: Vocab, text: str) -> np.ndarray:
    """Token count of text[:1], text[:2], ..., text: exactly what encoding each prefix would give."""
    out, base, prior, run = [], 0, "", 0
    for p in vocab.pieces(text):
        if p in vocab.special:
            # Cut short, the special string is ordinary text after the piece before it.
            before = base - (prefix_counts(vocab, prior)[-1] if prior and prior not in vocab.special else 0)
            lead = prior if prior not in vocab.special else ""
            out += [before + sum(prefix_counts(vocab, q)[-1] for q in vocab.split(lead + p[:i])) for i in range(1, len(p))] if lead else [base + sum(prefix_counts(vocab, q)[-1] for q in vocab.split(p[:i])) for i in range(1, len(p))]
            base += 1
            out.append(base)
        else:
            within = [base + c for c in prefix_counts(vocab, p)]
            if prior.isspace() and p[0].isspace():  # a prefix that ends here has the run of white space as one piece
                within[0] = base - prefix_counts(vocab, prior)[-1] + prefix_counts(vocab, prior + p[0])[-1]
            out += within
            base = base + prefix_counts(vocab, p)[-1]
        prior = p
    return np.array(out, np.int64)


def _texts(table: pa.Table, text: str) -> list[str]:
    return [t or "" for t in table.column(text).to_pylist()]


def _all_pieces(vocab: Coder, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts, and where those of each begin."""
    out: list[str] = []
    first = [0]
    for t in texts:
        out += vocab.pieces(t)
        first.append(len(out))
    return out, np.array(first, np.int64)


def token_prefixes(docs: DataFrame, vocab_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, and ``prefix_tokens`` array<int>, whose i-th element is the exact token
    count of the first i characters. Null and empty texts have an empty array."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab_json)

    def run(batches):
        vocab = _vocab(shared.value)
        for table in blocks(batches, "_text", TEXT_BYTES):
            counts = [text_prefix_counts(vocab, t).astype(np.int32) for t in _texts(table, "_text")]
            yield pa.RecordBatch.from_arrays([ids_out(longs(table.column("_id"), NULL_ID)), pa.array(counts, pa.list_(pa.int32()))], ["_id", "prefix_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "_id long, prefix_tokens array<int>").withColumnRenamed("_id", id_col)


def fits(prefix_tokens, budget: int):
    """Column: the most characters a text may keep so that its tokens stay within ``budget`` (0 if none)."""
    return F.coalesce(F.array_max(F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1))), F.lit(0))


def token_counts(docs: DataFrame, vocab_json: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, and ``cut_chars``, the most characters of the text
    whose tokens stay within ``limit``. All three are read off the prefix table; no text is encoded twice."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab_json)

    def run(batches):
        vocab = _vocab(shared.value)
        vocab.table = known = vocab.table or _Prefixed(vocab)
        for table in blocks(batches, "_text", TEXT_BYTES):
            texts = _texts(table, "_text")
            out = np.zeros((len(texts), 3), np.int64)
            pieces, first = _all_pieces(vocab, texts)
            rows = known.rows(pieces)
            for k, t in enumerate(texts):
                row = rows[first[k] : first[k + 1]]
                n = int(known.total[row].sum())
                out[k] = len(t.encode("utf-8", "surrogatepass")), n, len(t) if n <= limit else _cut(vocab, known, t, pieces[first[k] : first[k + 1]], row, limit)
            yield pa.RecordBatch.from_arrays([ids_out(longs(table.column("_id"), NULL_ID)), *map(pa.array, out.T.copy())], ["_id", "n_bytes", "n_tokens", "cut_chars"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "_id long, n_bytes long, n_tokens long, cut_chars long").withColumnRenamed("_id", id_col)


def _cut(vocab: Vocab, known: _Prefixed, text: str, pieces: list[str], row: np.ndarray, limit: int) -> int:
    """The longest prefix within the limit. No prefix that reaches into a piece which begins at the limit
    fits, save for one that ends in a run of white space, so only the last pieces below it are looked at."""
    if any(p in vocab.special for p in pieces):
        fit = np.flatnonzero(text_prefix_counts(vocab, text) <= limit)
        return int(fit[-1]) + 1 if len(fit) else 0
    base = np.cumsum(known.total[row]) - known.total[row]
    k = int(np.searchsorted(base, limit, side="right")) - 1
    for k in range(min(k + 1, len(pieces) - 1), -1, -1):
        counts = base[k] + known.ids[known.begin[row[k]] : known.begin[row[k]] + known.n[row[k]]].astype(np.int64)
        if k and pieces[k - 1].isspace() and pieces[k][0].isspace():
            counts[0] = base[k - 1] + prefix_counts(vocab, pieces[k - 1] + pieces[k][0])[-1]
        if len(fit := np.flatnonzero(counts <= limit)):
            return sum(map(len, pieces[:k])) + int(fit[-1]) + 1
    return 0


def _ids(coder: Coder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, back to back, and where those of each begin."""
    known = coder.known()
    pieces, first = _all_pieces(coder, texts)
    row = known.rows(pieces)
    size = known.n[row]
    ends = np.r_[0, np.cumsum(size)]
    return known.ids[np.repeat(known.begin[row] - ends[:-1], size) + np.arange(ends[-1])], ends[first]


def _coded(docs: DataFrame, vocab_json: str, id_col: str, text_col: str, keep: tuple[str, ...], decode: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_coder(vocab_json))
    inner = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    schema = ", ".join(["_id long", *(f"`_keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>", *["decoded string"] * decode])

    def run(batches: Iterator[pa.RecordBatch]):
        coder = shared.value
        for table in blocks(batches, "_text", TEXT_BYTES):
            flat, bounds = _ids(coder, _texts(table, "_text"))
            kept = {f"_keep_{c}": table.column(f"_keep_{c}").combine_chunks() for c in keep}
            out = {"_id": ids_out(longs(table.column("_id"), NULL_ID)), **kept, "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))}
            if decode:
                out["decoded"] = pa.array(coder.decode(flat, bounds), pa.string())
            yield from pa.table(out).to_batches()

    out = inner.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_keep_{c}").alias(c) for c in keep), "ids", *["decoded"] * decode)


def bpe_encode(docs: DataFrame, vocab_json: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the columns of ``keep``, and ``ids`` array<int> of the whole text."""
    return _coded(docs, vocab_json, id_col, text_col, keep, decode=False)


def bpe_round_trip(docs: DataFrame, vocab_json: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``bpe_encode`` with ``decoded``, the text of the ids, in one pass: the ids do not leave the worker in between."""
    return _coded(docs, vocab_json, id_col, text_col, keep, decode=True)


def bpe_decode(encoded: DataFrame, vocab_json: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``, the text of its ids. A null list counts as empty; ids that are null or
    that the vocabulary lacks spell nothing; invalid UTF-8 is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(_coder(vocab_json))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields), f"`{out_col}` string"])

    def run(batches):
        for batch in batches:
            lists = batch.column(ids_col)
            bounds = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
            texts = shared.value.decode(longs(lists.flatten(), -1), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return encoded.mapInArrow(run, fields)
