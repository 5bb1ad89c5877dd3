"""The Porter stemmer (M. F. Porter, 1980), applied to the distinct words of each Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Suffix rules of the published algorithm, longest match first.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
    "bli": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)
VOWELS = "aeiou"
LONGEST_WORD = 64


def _consonants(word: str) -> str:
    """The word as a pattern of c (consonant) and v (vowel)."""
    out = []
    for letter in word:
        vowel = letter in VOWELS or (letter == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _consonants(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _consonants(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _after_removal(word: str) -> str:
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1] == "c" and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short(word) else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3 or len(word.encode()) > LONGEST_WORD:
        return word
    if word.endswith("s"):
        if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
            word = word[:-2]
        elif not word.endswith("ss"):
            word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if "v" in _consonants(word[: -len(suffix)]):
                    word = _after_removal(word[: -len(suffix)])
                break
    if word.endswith("y") and "v" in _consonants(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        suffix = _longest(word, rules)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + rules[suffix]
    suffix = _longest(word, STEP_4)
    if suffix and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[-4] in "st"):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _stem_lists(lists: pa.Array) -> pa.Array:
    """array<array<string>> with every word stemmed; each distinct word is stemmed once."""
    inner = lists.values
    words = inner.values.dictionary_encode()
    stems = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string())
    flat = pa.DictionaryArray.from_arrays(words.indices, stems).cast(pa.string())
    rebuilt = pa.ListArray.from_arrays(inner.offsets, flat)
    return pa.ListArray.from_arrays(lists.offsets, rebuilt)


def stem_token_lists(listed: DataFrame, key: str, column: str = "lists") -> DataFrame:
    """(key, lists) with stems in place of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.concat_arrays([batch.column(column)])
            yield pa.RecordBatch.from_arrays([batch.column(key), _stem_lists(lists)], names=[key, column])

    kind = listed.schema[key].dataType.simpleString()
    return listed.select(key, column).mapInArrow(run, f"`{key}` {kind}, `{column}` array<array<string>>")
