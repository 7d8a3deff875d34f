"""Text functions as Column expressions: lines, tokens, identifier parts, names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line terminators of a text, the token and identifier patterns, the heading pattern.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*"
CAMEL = r"[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+|\d+"
HEADING = r"^(#{1,6})\s+(.*)$"
ALNUM = "[A-Za-z0-9]"
NAME_CHARS = 200

# English function words that carry no weight in a search.
STOPWORDS = frozenset(
    """
    a about above after again against all also am an and any are as at back be
    because been before being below between both but by can could did do does
    doing done down during each either else ever every few for from further get
    gets got had has have having he her here hers herself him himself his how i
    if in into is it its itself just let like may me might more most much must
    my myself no nor not now of off on once one only onto or other ought our ours
    ourselves out over own per s same shall she should so some such t than that
    the their theirs them themselves then there these they this those through to
    too under until up upon us very was we were what when where whether which
    while who whom whose why will with within without would you your yours
    yourself yourselves
    """.split()
)

_LINE_END, _TOKEN, _CAMEL = re.compile(LINE_END), re.compile(TOKEN), re.compile(CAMEL)
#: What a token holds that has parts of its own.
PARTED = "_|.[A-Z0-9]"
_PARTED = re.compile(PARTED)


def split_lines(text: str) -> list[str]:
    """The lines of a text, as the Column ``lines`` gives them."""
    out = _LINE_END.split(text)
    return out[:-1] if out and not out[-1] else out


def lines(text: Column) -> Column:
    """Array of a text's lines; a terminator at the end opens no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def tokens(text: Column) -> Column:
    """Array of the identifiers and words of a text, as they stand."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def identifier_parts(token: Column) -> Column:
    """The token in lower case, then the parts of its underscore- and camel-case pieces."""
    low = F.lower(token)

    def parts(piece: Column) -> Column:
        camel = F.regexp_extract_all(piece, F.lit(CAMEL), F.lit(0))
        alone = F.when(F.lower(piece) != low, F.array(F.lower(piece))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(camel) > 1, F.transform(camel, F.lower)).otherwise(alone)

    pieces = F.filter(F.split(token, "_"), lambda p: p != "")
    return F.concat(F.array(low), F.flatten(F.transform(pieces, parts)))


def words(text: Column) -> Column:
    """Array of a text's search words: identifier parts without stopwords, in order, repeats included."""
    # only a token with an underscore, or with a capital or digit after its first letter, has parts of its own
    split = F.transform(tokens(text), lambda t: F.when(t.rlike(PARTED), identifier_parts(t)).otherwise(F.array(F.lower(t))))
    return F.filter(F.flatten(split), lambda w: ~w.isin(*sorted(STOPWORDS)))


def token_words(token: str) -> tuple[str, ...]:
    """The search words of one token, as the Column ``words`` gives them."""
    low = token.lower()
    out = [low]
    if _PARTED.search(token):
        for piece in filter(None, token.split("_")):
            camel = _CAMEL.findall(piece)
            if len(camel) > 1:
                out += [c.lower() for c in camel]
            elif piece.lower() != low:
                out.append(piece.lower())
    return tuple(w for w in out if w not in STOPWORDS)


def word_counts(text: str, words_of: Callable[[str], Iterable[str]] = token_words) -> dict[str, int]:
    """A text's search words with their numbers; ``words_of`` gives a token's words."""
    out: dict[str, int] = {}
    for token, n in Counter(_TOKEN.findall(text)).items():
        for w in words_of(token):
            out[w] = out.get(w, 0) + n
    return out


def joined_name(names: Column) -> Column:
    """Distinct names in order, joined by bars, cut to the longest name allowed."""
    return F.left(F.array_join(F.array_distinct(names), " | "), F.lit(NAME_CHARS))


def is_documentation(path: Column) -> Column:
    """Whether a path names a text rather than code."""
    return path.endswith(".md") | path.endswith(".txt")
