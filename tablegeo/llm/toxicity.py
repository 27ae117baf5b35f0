"""Toxicity scores from a learned lexicon, misspellings and the context of each hit.

*Lexicon.*  Whole words that mark toxic texts are learned from labelled rows: those whose rate in toxic texts
is far above what chance gives any of the terms tried.  Near copies of a text are one lesson: of texts of one
label with an equal least shingle hash, by three hashes in turn, one is used.  Word beginnings (stems) join them where they mark more toxic texts than any whole word
below them does, as productive insults do.  All form one trie.

*Misspellings.*  Each term has a Levenshtein automaton (0, 1 or 2 edits by its length; a stem's accepts a word
as soon as it has read the stem), and words are run through the product of these automata with the trie, which
is made deterministic state by state as words need it.  A word may hold digits and signs between its letters
(m0ron, tr@sh).  A form that clean labelled texts use is not taken for a misspelling.

*Context.*  The window around a hit tells whether it is quoted (in quotation marks on its line, or on a line
marked as quoted) or meant; a logistic model of the weights, numbers and density of exact, misspelled and
quoted hits, fitted to the labelled rows, gives the score.  A labelled clean text does not excuse its own
forms when the weights are fitted, so that misspellings weigh what they are worth in texts not seen before.

The lexicon and the model are fitted to at most ``max_labelled`` labelled rows, those with the least hash of
their id; nothing else of them is bounded.  Scoring covers every row and whole texts, without a shuffle.  Ids,
languages, sources and labels are no inputs of a score.

Defined results: a null text scores like the empty text; rows without a label, or with a null label, teach
nothing; without both labels among the taught rows everything scores 0; repeated rows get equal scores; an
empty table gives an empty table.  The score is a column expression, so other columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegeo.llm.common import BASE, materialize, mix, staged, text_bytes, values, worker_cache
from tablegeo.llm.jaccard_join import ngram_sets

#: The bound of what is fitted: labelled rows.
MAX_LABELLED = 20_000
STEM = (4, 10)  # lengths of stems
CONTEXT = 80  # characters on each side of a hit in which quotation marks are looked for
#: Words, with digits and signs only between other characters; and their parts without signs.
WORD = re.compile(r"[^\W_]+(?:[@$*!|][^\W_]+)*")
PLAIN = re.compile(r"[^\W\d_]+")
#: Quotations, whose words teach nothing about terms.
QUOTATION = re.compile(r'(?m)"[^"\n]{0,160}"|“[^”\n]{0,160}”|„[^“\n]{0,160}“|«[^»\n]{0,160}»|^[ ]{0,3}>.*$')
#: Tokens that a worker remembers, states of the automaton that it keeps, and terms that a task counts at once;
#: beyond, they are made anew or handed on, with the same results.
CACHE_WORDS, MOST_STATES, TASK_TERMS = 100_000, 6_000, 100_000


def edits(term: str, stem: bool = False) -> int:
    """Edits allowed; one character more is needed of a stem, whose end is open."""
    n = len(term) - stem
    return 0 if n < 5 else 1 if n < 9 else 2


class Lexicon:
    """The trie of the terms (word, stem?), and the lazily determinised product with their automata."""

    def __init__(self, terms: dict[tuple[str, bool], float], clean: dict[str, int] | None = None):
        self.terms, self.clean = terms, clean or {}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]  # a whole word's node
        self.stems: list[tuple[str, bool] | None] = [None]  # a stem's node
        self.most = [0]  # edits that some term below allows
        for term in sorted(terms):
            node, path = 0, [0]
            for c in term[0]:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.stems.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                path.append(node)
            for at in path:
                self.most[at] = max(self.most[at], edits(*term))
            (self.stems if term[1] else self.ends)[node] = term
        self._restart()

    def _restart(self) -> None:
        start = self._closed({0: 0})
        self.numbers: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.steps: list[dict[str, int]] = [{}]
        self.results: list[tuple] = [self._result(start)]

    def _closed(self, least: dict[int, int]) -> tuple:
        """Adds what leaving out characters of a term reaches; a state is the least edits of each node."""
        todo = list(least)
        while todo:
            node = todo.pop()
            for below in self.children[node].values():
                cost = least[node] + 1
                if cost <= self.most[below] and cost < least.get(below, 99):
                    least[below] = cost
                    todo.append(below)
        return tuple(sorted(least.items()))

    def _result(self, state: tuple) -> tuple:
        """(nearest whole word that ends here, nearest stem that has been read), each as (edits, term)."""
        near = lambda kind: min(((cost, kind[node]) for node, cost in state if kind[node] and cost <= edits(*kind[node])), default=None)
        return near(self.ends), near(self.stems)

    def _step(self, number: int, c: str) -> int:
        """The state after one more character: match, change or insertion; -1 is the dead state."""
        least: dict[int, int] = {}
        for node, cost in self.states[number]:
            for letter, below in self.children[node].items():
                new = cost + (letter != c)
                if new <= (self.most[below] if new else new) and new < least.get(below, 99):
                    least[below] = new
            if cost + 1 <= self.most[node] and cost + 1 < least.get(node, 99):
                least[node] = cost + 1
        if not least:
            return -1
        state = self._closed(least)
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.results.append(self._result(state))
        return self.numbers[state]

    def find(self, word: str, own: int = 0) -> tuple[tuple[str, bool], int] | None:
        """(term, edits) of a lower-case word: the term with the fewest edits, of those a whole word first.  A
        misspelling is excused if more than ``own`` clean texts use the form."""
        if len(self.states) > MOST_STATES:
            self._restart()
        number, stem, ended = 0, None, None
        for c in word:
            step = self.steps[number].get(c)
            if step is None:
                step = self.steps[number][c] = self._step(number, c)
            number = step
            if number < 0:
                break
            here = self.results[number][1]
            if here and (stem is None or here < stem):
                stem = here
        else:
            ended = self.results[number][0]
        found = min((x for x in (ended, stem) if x), key=lambda x: (x[0], x[1][1], x[1]), default=None)
        if found is None or (found[0] and self.clean.get(word, 0) > own):
            return None
        return found[1], found[0]


@dataclass
class Model:
    """What is learned; small, and sent to the workers with the code."""

    terms: dict[tuple[str, bool], float] = field(default_factory=dict)
    clean: dict[str, int] = field(default_factory=dict)  # forms near a term, by the clean texts that use them
    weights: list[float] = field(default_factory=list)


class Hits(dict):
    """Raw token -> does any word in it hit the lexicon?  Remembered up to a bound."""

    def __init__(self, lexicon: Lexicon, own: int):
        super().__init__()
        self.lexicon, self.own = lexicon, own

    def __missing__(self, token: str) -> bool:
        hit = any(True for _ in found_in(token, self.lexicon, self.own))
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(token) <= 64:
            self[token] = hit
        return hit


def found_in(text: str, lexicon: Lexicon, own: int = 0) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, (term, edits)) of the words that hit; a word with signs in it that hits nothing is tried part by part."""
    for m in WORD.finditer(text):
        word = m.group()
        if not (plain := word.isalpha()) and not PLAIN.search(word):
            continue
        found = lexicon.find(word, own)
        if found:
            yield m.start(), m.end(), found
        elif not plain:
            for part in PLAIN.finditer(text, m.start(), m.end()):
                if part.group() != word and (found := lexicon.find(part.group(), own)):
                    yield part.start(), part.end(), found


def _tools(model: Model) -> tuple[Lexicon, list[Hits]]:
    def make() -> tuple[Lexicon, list[Hits]]:
        lexicon = Lexicon(model.terms, model.clean)
        return lexicon, [Hits(lexicon, own) for own in (0, 1)]

    key = hash((frozenset(model.terms.items()), frozenset(model.clean.items())))
    held = worker_cache("toxicity", ("model",), dict)  # of one model at a time
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def quoted(text: str, start: int, end: int) -> bool:
    """Is the hit inside quotation marks nearby on its line, or on a line that is marked as quoted?"""
    line = text.rfind("\n", 0, start) + 1
    if text[line : line + 8].lstrip().startswith(">"):
        return True
    stop = text.find("\n", end)
    left = text[max(line, start - CONTEXT) : start]
    right = text[end : min(end + CONTEXT, len(text) if stop < 0 else stop)]
    plain = left.count('"') % 2 == 1 and '"' in right
    return plain or any(left.rfind(a) > left.rfind(b) and b in right for a, b in (("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’")))


def find_hits(text: str, model: Model, own: int = 0) -> tuple[list[dict], int]:
    """The hits of a text with their spans and context, and its number of words (tokens)."""
    lexicon, known = _tools(model)
    lower = text.lower()
    tokens = lower.split()
    if not any(map(known[own].__getitem__, tokens)):
        return [], len(tokens)
    same = len(lower) == len(text)  # else offsets are those of the lower-case text
    hits = []
    for start, end, (term, cost) in found_in(lower, lexicon, own):
        hits.append({"start": start, "end": end, "term": term[0], "edits": cost, "quoted": quoted(text if same else lower, start, end), "_weight": model.terms[term]})
    return hits, len(tokens)


#: What ``features`` tells of a text, in order.
FEATURES = ("constant", "exact", "exact weight", "misspelled", "misspelled weight", "quoted", "quoted weight", "density", "several")


def features(hits: list[dict], words: int) -> list[float]:
    weight = lambda some: math.log1p(sum(h["_weight"] for h in some))
    exact = [h for h in hits if not h["edits"] and not h["quoted"]]
    misspelled = [h for h in hits if h["edits"] and not h["quoted"]]
    marked = [h for h in hits if h["quoted"]]
    return [1.0, float(bool(exact)), weight(exact), float(bool(misspelled)), weight(misspelled), float(bool(marked)), weight(marked), math.log1p(100 * len(exact) / (words + 10)), float(len({h["term"] for h in exact}) > 1)]


def score_of(row: list[float], weights: list[float]) -> float:
    if not weights:
        return 0.0
    z = sum(a * b for a, b in zip(row, weights, strict=True))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fit_logistic(rows: np.ndarray, labels: np.ndarray, penalty: float = 0.3) -> list[float]:
    """Newton steps for a logistic model; the constant is not penalised."""
    w, ridge = np.zeros(rows.shape[1]), np.full(rows.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -50, 50)))
        step = np.linalg.solve((rows.T * np.maximum(p * (1 - p), 1e-6)) @ rows + np.diag(ridge), rows.T @ (p - labels) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def lessons(taught: DataFrame) -> DataFrame:
    """(bytes, label): one of the near copies among the labelled texts; the same one each time."""
    names = ["one", "two", "three"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngram_sets([v])[1] for v in values(batch.column(0))]
            least = [pa.array([int(mix(x + np.uint64(k) * BASE).min() >> np.uint64(1)) if len(x) else -1 for x in sets], pa.int64()) for k in range(1, 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *least], names=["bytes", "label", *names])

    held = taught.mapInArrow(staged("toxicity", run), "bytes binary, label int, one long, two long, three long")
    for name in names:
        rest = [n for n in names if n != name]
        held = held.groupBy("label", name).agg(F.min(F.struct(*rest, "bytes")).alias("m")).select("label", name, "m.*")
    return materialize(held.select("bytes", "label"))


def term_counts(taught: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean): labelled texts with each word and each beginning of a word, quotations
    left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_pydict({"term": pa.array([k[0] for k in keys], pa.string()), "stem": pa.array([k[1] for k in keys], pa.bool_()), "toxic": pa.array([counts[1][k] for k in keys], pa.int64()), "clean": pa.array([counts[0][k] for k in keys], pa.int64())})

        counts = (Counter(), Counter())
        for batch in batches:
            for value, label in zip(values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = {w for w in WORD.findall(QUOTATION.sub(" ", value.decode("utf-8", "replace").lower())) if len(w) <= 64 and PLAIN.search(w)}
                counts[label].update((w, False) for w in words)
                counts[label].update({(w[:n], True) for w in words for n in range(STEM[0], min(len(w), STEM[1]) + 1)})
                if len(counts[0]) + len(counts[1]) > TASK_TERMS:
                    yield emit()
                    counts = (Counter(), Counter())
        yield emit()

    counted = taught.select("bytes", "label").mapInArrow(staged("toxicity", run), "term string, stem boolean, toxic long, clean long")
    return counted.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(rows: list) -> dict[tuple[str, bool], float]:
    """Terms with their weights (log odds).  A stem stands for itself if it marks half as many toxic texts again
    as each whole word below it, and nearly all that the shorter stem above it does; of stems above one another
    the longest such one is taken.  Whole words below a chosen stem follow from it and are left out."""
    words = {r.term: r for r in rows if not r.stem}
    stems = {r.term: r for r in rows if r.stem}
    below: Counter = Counter()
    for w, r in words.items():
        for n in range(STEM[0], len(w) + 1):
            below[w[:n]] = max(below[w[:n]], r.toxic)
    own = {s: r for s, r in stems.items() if r.toxic >= 1.5 * below[s]}
    best: dict[str, object] = {}
    for s in sorted(own, key=lambda s: (len(s), s)):
        above = next((s[:n] for n in range(len(s) - 1, STEM[0] - 1, -1) if s[:n] in best), None)
        if above is None:
            best[s] = own[s]
        elif own[s].toxic >= 0.95 * best[above].toxic:
            del best[above]
            best[s] = own[s]
    chosen = {(s, True): r for s, r in best.items()}
    chosen |= {(w, False): r for w, r in words.items() if not any(w[:n] in best for n in range(STEM[0], len(w) + 1))}
    return {k: max(math.log((r.toxic + 0.5) / (r.clean + 0.5)) + 1, 0.1) for k, r in chosen.items()}


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` (id, label 0/1) names; at most ``max_labelled``."""
    picked = labels.filter(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("label")).distinct()
    picked = picked.orderBy(F.xxhash64("_id"), "_id", "label").limit(max_labelled)  # the bound under which it is broadcast
    taught = materialize(docs.select(F.col(id_column).alias("_id"), text_bytes(text).alias("bytes")).join(F.broadcast(picked), "_id").select("bytes", "label"))
    apart = lessons(taught)
    sizes = {r.label: r["count"] for r in apart.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model()
    rate = sizes[1] / (sizes[0] + sizes[1])
    counts = materialize(term_counts(apart))
    least = math.log(100 * max(counts.count(), 1)) / math.log(1 / rate)  # so many toxic texts alone: once in 100 such samples
    n = F.col("toxic") + F.col("clean")
    above = (F.col("toxic") - n * rate) / F.sqrt(n * rate * (1 - rate))
    marked = counts.filter((F.col("toxic") >= least) & (above >= 6) & (F.col("toxic") > 1.5 * F.col("clean")))
    bare = Model(choose_terms(marked.collect()))  # of a bounded sample

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _tools(bare)[0]
        for batch in batches:
            some = [bool((found := lexicon.find(w)) and found[1]) for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(some, pa.bool_()))

    forms = counts.filter("not stem and clean > 0").select("term", "clean").mapInArrow(staged("toxicity", near), "term string, clean long")
    model = Model(bare.terms, {r.term: r.clean for r in forms.collect()})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(*find_hits(v.decode("utf-8", "replace"), model, own=1 - y)) for v, y in zip(values(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    fitted = taught.select("bytes", "label").mapInArrow(staged("toxicity", rows), "x array<double>, label int").groupBy("x", "label").count().orderBy("x", "label").collect()
    x = np.repeat(np.array([r.x for r in fitted]), [r["count"] for r in fitted], axis=0)
    y = np.repeat(np.array([r.label for r in fitted], float), [r["count"] for r in fitted])
    model.weights = fit_logistic(x, y)
    return model


VERDICT = "score double, hits array<struct<start:int,end:int,term:string,edits:int,quoted:boolean>>"


def scored(text: str | Column, model: Model) -> Column:
    """Column struct<score, hits>: the score of a text and the spans it rests on."""
    kind = pa.struct([("score", pa.float64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())])))])

    def verdict(value: bytes) -> dict:
        hits, words = find_hits(value.decode("utf-8", "replace"), model)
        return {"score": score_of(features(hits, words), model.weights), "hits": hits}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([verdict(v) for v in values(batch)], kind)

    task = staged("toxicity", run)
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(task, VERDICT)(text_bytes(text))
