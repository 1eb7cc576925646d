"""Text primitives as column expressions: tokens, trigrams, similarities, edits, accent folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null has none."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def query_tokens(q: Column) -> Column:
    """At most 32 tokens of the first 256 characters."""
    return F.slice(tokens(F.left(F.coalesce(q, F.lit("")), F.lit(256))), 1, 32)


def code_key(code: Column) -> Column:
    """A code without leading zeros; nothing left is null."""
    return F.nullif(F.regexp_replace(code, "^0+", ""), F.lit(""))


def contained_words(text: Column) -> Column:
    """Tokens padded with spaces, so that a substring test matches whole words."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def ordered_trigrams(words: Column) -> Column:
    """Trigrams of each word with two blanks before and one behind, in order, repeats included."""
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))))


def trigrams(words: Column) -> Column:
    return F.array_distinct(ordered_trigrams(words))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two sets, as float; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0)).cast("float")


def word_similarity(a: Column, b: Column) -> Column:
    """The most any run of ``b`` (ordered trigrams) resembles the set ``a``: shared / (size of a + distinct in the run
    - shared). Only runs that begin and end with a shared trigram can be best."""
    at = F.filter(F.transform(b, lambda t, i: F.when(F.array_contains(a, t), i + 1)), lambda i: i.isNotNull())

    def run(i, j):
        part = F.array_distinct(F.slice(b, i, j - i + 1))
        shared = F.size(F.array_intersect(a, part))
        return (shared / (F.size(a) + F.size(part) - shared)).cast("float")

    best = F.transform(at, lambda i: F.array_max(F.transform(F.filter(at, lambda j: j >= i), lambda j: run(i, j))))
    return F.coalesce(F.array_max(best), F.lit(0.0).cast("float"))


def edits1(w: Column) -> Column:
    """Distinct strings one edit away: a letter dropped, two neighbours swapped, a letter changed or added (a-z)."""
    n = F.length(w)
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    head = lambda i: F.substr(w, F.lit(1), i)
    tail = lambda i: F.substr(w, i + 1)
    letters = F.split(F.lit(" ".join(LETTERS)), " ")
    drop = F.transform(upto(n - 1), lambda i: F.concat(head(i), tail(i + 1)))
    swap = F.transform(upto(n - 2), lambda i: F.concat(head(i), F.substr(w, i + 2, F.lit(1)), F.substr(w, i + 1, F.lit(1)), tail(i + 2)))
    change = F.flatten(F.transform(upto(n - 1), lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i + 1)))))
    add = F.flatten(F.transform(upto(n), lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i)))))
    return F.array_except(F.concat(drop, swap, change, add), F.array(w))


def edit_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment: insertions, deletions, changes and swaps of neighbours, each one edit."""
    m, n = F.length(a), F.length(b)
    char = lambda s, i: F.substr(s, i, F.lit(1))
    first = F.sequence(F.lit(0), n)
    count = lambda last: F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

    def row(acc, i):
        before, prior = acc["now"], acc["prior"]

        def cell(built, j):
            same = F.when(char(a, i) == char(b, j), 0).otherwise(1)
            best = F.least(F.element_at(built, -1) + 1, F.get(before, j) + 1, F.get(before, j - 1) + same)
            swapped = (i > 1) & (j > 1) & (char(a, i) == char(b, j - 1)) & (char(a, i - 1) == char(b, j))
            return F.concat(built, F.array(F.when(swapped, F.least(best, F.get(prior, j - 2) + 1)).otherwise(best)))

        return F.struct(before.alias("prior"), F.aggregate(count(n), F.array(i), cell).alias("now"))

    start = F.struct(first.alias("prior"), first.alias("now"))
    return F.aggregate(count(m), start, row, lambda acc: F.element_at(acc["now"], -1))


def _folds() -> tuple[str, str]:
    """Every accented Latin, Greek or Cyrillic letter whose decomposition is one letter and marks, with that letter."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) for c in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folds()


def fold(text: Column) -> Column:
    """Letters without accents; combining marks go."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{M}+", "")


def carries(text: Column, phrase: Column) -> Column:
    """True if the phrase's tokens, run together, begin the text's tokens, run together from some word on.
    Accents do not count; an empty phrase is carried by nothing."""
    own, target = tokens(fold(text)), F.array_join(tokens(fold(phrase)), "")
    starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own))).otherwise(F.array().cast("array<int>"))
    return (target != "") & F.exists(starts, lambda i: F.startswith(F.array_join(F.slice(own, i, F.size(own)), ""), target))
