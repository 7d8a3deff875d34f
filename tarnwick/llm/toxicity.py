"""Toxicity: a learned lexicon met by Levenshtein automata, and scores of the windows around its terms.

The lexicon is learned from labelled documents: words, and beginnings of words,
that stand in toxic documents far more often than chance, by their likelihood
ratio. It is kept as a trie. The Levenshtein automata of all its terms are run
over that trie at once: a state is the set of trie nodes that a word's letters
may have led to, with the errors each took, and states and their steps are kept
as they come up, so a word costs a lookup a letter and dies where no term is
near. A misspelt word counts by its term's weight and its errors, less where
labelled documents show that the word itself is harmless.

What a term means depends on the words around it. Terms between quotation marks
are counted apart, as are those beside words that report speech; the words of
the windows around terms have weights of their own, learned from the windows in
toxic and in other documents; terms that crowd one window count more. A logistic
model over these sums, fitted to the labelled documents, gives the score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .logistic import logistic

#: Labelled documents that are learned from at most (those with the smallest hashes of their ids).
MAX_LABELS = 50_000
#: Terms of the lexicon, words with counts of their own, and words of windows that are kept at most; likelihood ratios from which a term, or a window's word, is taken.
TERMS, WORDS, CONTEXT, SURE = 2048, 20_000, 1024, 12.0
#: Log odds that a term needs, those from which it forgives errors, and those below which a word counts for nothing.
LEAST, FIRM, FAINT = 1.5, 3.0, 0.5
#: Letters of a word's beginnings that can be terms; what an error leaves of a weight; documents that a term's weight counts as beside a word's own.
BEGIN, DECAY, STRENGTH = range(4, 9), 0.4, 2.0
#: Words on each side of a term in its window, and how far a quotation mark may be; characters taken at a time.
WINDOW, QUOTE, STEP = 10, 40, 4 << 20
#: Words, states and counts that a worker remembers.
REMEMBERED = 400_000

_WORD, _SPACE, _MARK = re.compile(r"[^\W\d_]+"), re.compile(r"\s"), re.compile("[\"“”„«»‹›]")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»‹›\n]")
_MARKS = frozenset('"“”„«»‹›')
# Verbs and nouns that report what others say.
REPORTS = frozenset(
    """
    said says wrote writes called calls quoted quote quotes word words term insult insults slur reported
    sagte sagt schrieb nannte zitat wort wörter beleidigung dit écrit appelé mot mots insulte citation
    dijo dice escribió llamó palabra palabras insulto cita
    """.split()
)


def allowed(letters: int, begin: bool = False) -> int:
    """Errors that a term of so many letters forgives, in all of a word or in its beginning."""
    return min(1, letters // 6) if begin else 0 if letters < 4 else 1 if letters < 8 else 2


class _Known(dict):
    """What each word counts as, looked up in the automaton once."""

    def __init__(self, find) -> None:
        self.find = find

    def __missing__(self, word: str) -> tuple[int, int, float] | None:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = self.find(word)
        return found


#: Lexicons of this process, by their terms and weights: a worker's tasks share one automaton.
_HELD: dict[str, Lexicon] = {}


def _lexicon(key: str, weights: dict[str, float], own: dict[str, float]) -> Lexicon:
    if key not in _HELD:
        while len(_HELD) > 1:
            del _HELD[next(iter(_HELD))]
        _HELD[key] = Lexicon(weights, own)
    return _HELD[key]


class Lexicon:
    """Terms with weights in a trie, and the automaton of all words near them. A term that ends in ``*`` is a word's beginning.

    ``own`` are weights of words that have counts of their own, whatever term they are near.
    """

    def __init__(self, weights: dict[str, float], own: dict[str, float] | None = None) -> None:
        self.weights, self.own = weights, own or {}
        self.key = hashlib.sha256(repr((sorted(weights.items()), sorted(self.own.items()))).encode()).hexdigest()
        self.known = _Known(self._find)
        self._built = False

    def __reduce__(self) -> tuple:
        return _lexicon, (self.key, self.weights, self.own)

    def _allowed(self, k: int) -> int:
        term = self.terms[k]
        return allowed(len(term.removesuffix("*")), term.endswith("*")) if self.weights[term] >= FIRM else 0

    def _build(self) -> None:
        self.terms = sorted(self.weights)
        self.children: list[dict[str, int]] = [{}]
        self.whole, self.begin, self.most = [-1], [-1], [0]
        for k, term in enumerate(self.terms):
            begin, letters = term.endswith("*"), term.removesuffix("*")
            errors, node = self._allowed(k), 0
            self.most[0] = max(self.most[0], errors)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    for column, empty in ((self.whole, -1), (self.begin, -1), (self.most, 0)):
                        column.append(empty)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], errors)
            (self.begin if begin else self.whole)[node] = k
        self._forget()
        self._built = True

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple[dict[int, int], tuple[float, int, int]]] = []
        self.steps: list[dict[str, int]] = []
        self._state({0: 0}, (0.0, -1, 0))

    def _state(self, nodes: dict[int, int], held: tuple[float, int, int]) -> int:
        """The number of a state, letters that a word lacks included; ``held`` is the best beginning met so far."""
        open_ = [n for n, e in nodes.items() if e < self.most[n]]
        while open_:
            node = open_.pop()
            errors = nodes[node] + 1
            for child in self.children[node].values():
                if errors <= self.most[child] and errors < nodes.get(child, 9):
                    nodes[child] = errors
                    open_.append(child)
        for node, errors in nodes.items():
            if self.begin[node] >= 0:
                held = max(held, self._match(self.begin[node], errors))
        key = (tuple(sorted(nodes.items())), held)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append((nodes, held))
            self.steps.append({})
        return self.numbers[key]

    def _match(self, k: int, errors: int) -> tuple[float, int, int]:
        """(weight, term, errors) of a term met with so many errors; nothing if it forgives fewer."""
        if k < 0 or errors > self._allowed(k):
            return 0.0, -1, 0
        return self.weights[self.terms[k]] * DECAY**errors, k, errors

    def _step(self, state: int, letter: str) -> int:
        nodes, held = self.states[state]
        to: dict[int, int] = {}
        most, children = self.most, self.children
        for node, errors in nodes.items():
            same = children[node].get(letter)
            if same is not None and errors <= most[same] and errors < to.get(same, 9):
                to[same] = errors
            if (more := errors + 1) <= most[node]:
                if more < to.get(node, 9):  # a letter too many
                    to[node] = more
                for child in children[node].values():  # another letter
                    if child != same and more <= most[child] and more < to.get(child, 9):
                        to[child] = more
        self.steps[state][letter] = number = self._state(to, held)
        return number

    def match(self, word: str) -> tuple[int, int, float] | None:
        """(term, errors, weight) of the term that a word counts as; None if it is near none, or counts for nothing."""
        return self.known[word]

    def _find(self, word: str) -> tuple[int, int, float] | None:
        if not self._built:
            self._build()
        if len(self.states) > REMEMBERED:
            self._forget()
        at = 0
        for letter in word:
            to = self.steps[at].get(letter)
            at = self._step(at, letter) if to is None else to
            if not self.states[at][0] and self.states[at][1][1] < 0:
                return None
        nodes, held = self.states[at]
        weight, term, errors = max([held, *(self._match(self.whole[n], e) for n, e in nodes.items())])
        weight = self.own.get(word, weight)
        return None if term < 0 or weight < FAINT else (term, errors, weight)


def _parts(text: str | None) -> Iterator[tuple[list[str], str]]:
    """(words in lower case, the text they stand in) of a text, some MB at a time."""
    at, text = 0, text or ""
    while at < len(text):
        gap = _SPACE.search(text, at + STEP)
        end = gap.end() if gap else len(text)
        part = text[at:end].lower()
        yield _WORD.findall(part), part
        at = end


def _hits(lexicon: Lexicon, words: list[str]) -> list[tuple[int, tuple[int, int, float]]]:
    """(place, (term, errors, weight)) of the words near a term."""
    met = list(map(lexicon.known.__getitem__, words))
    return [(i, met[i]) for i in compress(range(len(met)), met)]


def quoted(text: str, places: list[int]) -> list[bool]:
    """Whether the words at each of ``places`` have an odd number of quotation marks before them on their line, and one close to them on each side of it."""
    if not places or not _MARK.search(text):
        return [False] * len(places)
    out, wanted, word, inside, opened = [False] * len(places), 0, 0, False, 0
    waiting: list[int] = []  # places behind an opening mark
    for token in _TOKEN.findall(text):
        if token in _MARKS:
            for k in waiting:
                out[k] = word - places[k] <= QUOTE
            waiting, inside, opened = [], not inside, word
        elif token == "\n":
            waiting, inside = [], False
        else:
            if wanted < len(places) and places[wanted] == word:
                if inside and word - opened < QUOTE:
                    waiting.append(wanted)
                wanted += 1
            word += 1
    return out


def _window(words: list[str], i: int) -> list[str]:
    return words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]


FEATURES = ("abuse", "crowded", "terms", "density", "quoted", "reported", "context", "length")


def features(lexicon: Lexicon, context: dict[str, float], text: str | None) -> list[float]:
    """The sums that a text is judged by; all 0 without terms, but for its length. Windows end with a step of a very long text."""
    abuse = crowded = quotes = reported = around = length = 0.0
    terms: set[int] = set()
    for words, part in _parts(text):
        length += len(words)
        found = _hits(lexicon, words)
        plain: list[tuple[int, float]] = []
        for (i, (term, _, weight)), inside in zip(found, quoted(part, [i for i, _ in found])):
            if inside:
                quotes += weight
                continue
            window = _window(words, i)
            abuse += weight
            if not REPORTS.isdisjoint(window):
                reported += weight
            around += weight * sum(map(context.get, window, repeat(0.0))) / max(1, len(window))
            terms.add(term)
            plain.append((i, weight))
        lo, total = 0, 0.0
        for i, weight in plain:
            total += weight
            while plain[lo][0] < i - WINDOW:
                total -= plain[lo][1]
                lo += 1
            crowded = max(crowded, total)
    sums = map(math.log1p, (abuse, crowded, len(terms), 100 * abuse / (length + 20), quotes, reported))
    return [*sums, around / abuse if abuse else 0.0, math.log1p(length)]


class Model:
    """The lexicon, the words of windows and the logistic weights of ``FEATURES``."""

    def __init__(self, lexicon: Lexicon, context: dict[str, float], bias: float, weights: np.ndarray) -> None:
        self.lexicon, self.context, self.bias, self.weights = lexicon, context, bias, weights

    def score(self, text: str | None) -> float:
        x = float(np.dot(features(self.lexicon, self.context, text), self.weights)) + self.bias
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def held_out(id_col: str = "doc_id"):
    """Whether a document's label is kept from learning; a null id has no label to keep."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- learning


def _tallies(of):
    """(term, toxic, other): documents of each label that hold each term ``of`` their text, a bounded number of terms at a time."""

    def batch(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(counts[0] | counts[1])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in reversed(counts))], names=["term", "toxic", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for part in batches:
            for text, toxic in zip(part.column(0), part.column(1).to_pylist()):
                counts[toxic == 1].update(of(text.as_py()))
                if sum(map(len, counts)) > REMEMBERED:
                    yield batch(counts)
                    counts = (Counter(), Counter())
        yield batch(counts)

    return run


def _words(text: str | None) -> set[str]:
    words = {w for found, _ in _parts(text) for w in found}
    return words | {w[:n] + "*" for w in words for n in BEGIN if n < len(w)}


def _around(lexicon: Lexicon):
    def of(text: str | None) -> set[str]:
        return {w for words, _ in _parts(text) for i, _ in _hits(lexicon, words) for w in _window(words, i)}

    return of


def _ratio(n1: int, n0: int):
    """(likelihood ratio, log odds) columns of ``toxic`` and ``other`` documents among n1 and n0."""
    t1, t0 = F.col("toxic").cast("double"), F.col("other").cast("double")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    share = n1 / max(1, n1 + n0)
    both = t1 + t0
    g = 2 * (part(t1, both * share) + part(t0, both * (1 - share)) + part(n1 - t1, (n1 + n0 - both) * share) + part(n0 - t0, (n1 + n0 - both) * (1 - share)))
    odds = F.log((t1 + 0.5) / (n1 - t1 + 0.5)) - F.log((t0 + 0.5) / (n0 - t0 + 0.5))
    return g, odds


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS, sure: float = SURE) -> Model:
    """A model of ``labels`` (doc_id, toxic) and their documents, those that are held out excepted.

    Of more than ``max_labels`` labelled ids those with the smallest hashes are
    read; an id with several labels counts as toxic if one of them is 1. Without
    toxic labels, or without others, all texts have one low score. Counts come
    from Spark; the driver sees the terms that are kept and one row of sums for
    each labelled document.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    taught = stored(texts.join(F.broadcast(sample), "id").select("text", "toxic"), "toxic-labelled")
    n1, n = (int(x or 0) for x in taught.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count(F.lit(1))).first())
    n0 = n - n1
    if not n1 or not n0:
        return Model(Lexicon({}), {}, math.log((n1 + 0.5) / (n0 + 1.5)), np.zeros(len(FEATURES)))

    def tallied(of, name: str) -> DataFrame:
        rows = taught.mapInArrow(_tallies(of), "term string, toxic long, other long")
        return stored(rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), name)

    def best(rows: DataFrame, most: int, n1: int, n0: int, both: bool = False) -> list:
        g, odds = _ratio(n1, n0)
        kept = rows.withColumn("g", g).withColumn("odds", odds).where((F.col("g") >= sure) & (F.lit(both) | (F.col("odds") >= LEAST)))
        return kept.orderBy(F.desc("g"), "term").limit(most).collect()

    counts = tallied(_words, "toxic-terms")
    lexicon = Lexicon({r["term"]: min(8.0, r["odds"]) for r in best(counts, TERMS, n1, n0)})
    caught = counts.where(~F.col("term").endswith("*")).mapInArrow(_caught(lexicon), "term string, toxic long, other long, weight double")
    rows = caught.orderBy(F.desc(F.col("toxic") + F.col("other")), "term").limit(WORDS).collect()
    base = math.log(n1 / n0)

    def own(r) -> float:
        prior = 1 / (1 + math.exp(-base - r["weight"]))
        share = (r["toxic"] + STRENGTH * prior) / (r["toxic"] + r["other"] + STRENGTH)
        return max(0.0, math.log(share / max(1e-9, 1 - share)) - base)

    lexicon = Lexicon(lexicon.weights, {r["term"]: min(8.0, own(r)) for r in rows if r["term"] not in lexicon.weights})
    around = tallied(_around(lexicon), "toxic-windows")
    context = {r["term"]: max(-4.0, min(4.0, r["odds"])) for r in best(around, CONTEXT, n1, n0, both=True)}
    sums = np.array([tuple(r) for r in taught.mapInArrow(_summed(lexicon, context), ", ".join(f"{f} double" for f in (*FEATURES, "y"))).collect()])
    return Model(lexicon, context, *logistic(sums[:, :-1], sums[:, -1]))


def _caught(lexicon: Lexicon):
    """Words near a term, with the weight that it gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [(k, m[2]) for k, m in enumerate(map(lexicon.match, part.column(0).to_pylist())) if m is not None]
            rows = part.take(pa.array([k for k, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([w for _, w in found], pa.float64())], names=["term", "toxic", "other", "weight"])

    return run


def _summed(lexicon: Lexicon, context: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = [[*features(lexicon, context, text.as_py()), float(y == 1)] for text, y in zip(part.column(0), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (zip(*rows) if rows else [()] * (len(FEATURES) + 1))], names=[*FEATURES, "y"])

    return run


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            scores = [model.score(text.as_py()) for text in part.column(2)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5).

    A null or empty text, and any text without terms, has the score of its
    length alone. Very long texts are taken whole, in steps. Ids, null or
    repeated, pass through, and repeated rows have one score. An empty table
    gives no rows; extra columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for the whole of ``documents``, learned from ``labels`` that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
