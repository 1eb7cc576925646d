"""English stop list and Porter2 (Snowball English) stemmer, written from the published algorithm."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The usual Snowball-based English stop list of full-text search.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now""".split()
)
#: Fixed values of the algorithm: irregular words, words left alone after step 1a, and its suffix tables.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
LEFT_ALONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_VOWEL}{_OTHER}")
_SHORT = re.compile(f"(?:^{_VOWEL}{_OTHER}|{_OTHER}{_VOWEL}[^aeiouywxY])$")


def _regions(w: str) -> tuple[int, int]:
    head = re.match("gener|commun|arsen", w)
    m = None if head else _REGION.search(w)
    r1 = head.end() if head else m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _longest(w: str, endings) -> str:
    return max((e for e in endings if w.endswith(e)), key=len, default="")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one lower-case word. Words of one or two letters, and words with a digit, are their own stem."""
    if len(word) <= 2 or any(c.isdigit() for c in word):
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.lstrip("'")
    w = re.sub(f"^y|(?<={_VOWEL})y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    # plural endings
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"{_VOWEL}.", w[:-1]):
        w = w[:-1]
    if w in LEFT_ALONE:
        return w
    # past and gerund endings
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(_VOWEL, w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # derivational suffixes
    end = _longest(w, (*STEP2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif end == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(end)] + STEP2[end]
    end = _longest(w, (*STEP3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + STEP3[end]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    end = _longest(w, (*STEP4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """``vocabulary`` with ``stem``: Arrow batches over distinct words, the only Python in the engine's text work."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield pdf.assign(stem=[stem(w) if w is not None else None for w in pdf[word]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vocabulary.schema.fields)
    return vocabulary.mapInPandas(run, f"{fields}, stem string")


def stems_within(words: Column) -> Column:
    """The distinct stems, in order, of an array of words without its stop words. Each Arrow batch stems its distinct words once."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        known = flat.dictionary.to_pylist()
        found = [stem(w) for w in known]
        at, size = flat.indices.to_pylist(), pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
        out, begin = [], 0
        for n in size:
            out.append(sorted({found[i] for i in at[begin : begin + n]}))
            begin += n
        return pa.array(out, pa.list_(pa.string()))

    return run(F.filter(words, lambda w: ~F.array_contains(stop_array(), w)))


def stem_of_each(words: Column) -> Column:
    """The stem of each word of an array, in place; a stop word has an empty one."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if ws is None else ["" if w in STOP_WORDS else stem(w) for w in ws] for ws in lists.to_pylist()], pa.list_(pa.string()))

    return run(words)


def stop_array():
    return F.array(*(F.lit(w) for w in STOP_WORDS))


def is_stop(word):
    return word.isin(*STOP_WORDS)
