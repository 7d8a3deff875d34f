"""The published Porter2 (English) stemming algorithm, for distinct terms."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the algorithm: special words, and the suffix tables of steps 1 to 4.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

_V = "aeiouy"
_R = re.compile(f"[{_V}][^{_V}]")
_SHORT_END = re.compile(f"(?:^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    head = re.match("gener|commun|arsen", word)
    m = _R.search(word)
    r1 = head.end() if head else m.end() if m else len(word)
    m = _R.search(word, r1)
    return r1, m.end() if m else len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub(f"(^|[{_V}])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = re.sub("'s'$|'s$|'$", "", word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_V}]", word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and re.search(f"[{_V}]", word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    # 1c
    word = re.sub(f"(?<=.)(?<=[^{_V}])[yY]$", "i", word) if len(word) > 2 else word
    # 2
    suffix = _longest(word, (*STEP2, "ogi", "li"))
    if suffix and len(word) - len(suffix) >= r1:
        if suffix == "ogi":
            word = word[:-1] if word[:-3].endswith("l") else word
        elif suffix == "li":
            word = word[:-2] if word[:-2].endswith(tuple("cdeghkmnrt")) else word
        else:
            word = word[: -len(suffix)] + STEP2[suffix]
    # 3
    suffix = _longest(word, (*STEP3, "ative"))
    if suffix and len(word) - len(suffix) >= r1:
        if suffix != "ative":
            word = word[: -len(suffix)] + STEP3[suffix]
        elif len(word) - 5 >= r2:
            word = word[:-5]
    # 4
    suffix = _longest(word, (*STEP4, "ion"))
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    # 5
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_udf(terms: pd.Series) -> pd.Series:
    """Stems of a column of terms; null stays null."""
    return terms.map(stem, na_action="ignore")


def stemmed(df: DataFrame, term: str = "term") -> DataFrame:
    """``df`` with its terms stemmed: each distinct term once, then joined back."""
    known = df.select(term).distinct().withColumn("__stem", stem_udf(term))
    return df.join(known, term, "left").withColumn(term, F.col("__stem")).drop("__stem")
