"""Operator 1: toxicity by Levenshtein automata intersected with a trie of a learned lexicon."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import only, stage, table

TOKEN = re.compile(r"[^\W_]+")
#: Labelled rows of either class that take part in fitting, and the size of the lexicon (documented bounds).
SAMPLE = 6_000
LEXICON = 1_000
#: predicted is 1 from this score on.
THRESHOLD = 0.7
#: Characters looked at on either side of a hit, and the marks and words that make a quotation.
WINDOW = 60
OPENING, CLOSING = "\"“«„‹", "\"”»“›"
REPORTING = re.compile(r"\b(?:said|says|quote[ds]?|called|wrote|according|word|term|dit|sagte|dijo|mot|wort|palabra)\b")
N_FEATURES = 7


# -- lexicon -----------------------------------------------------------------------------------


def grams(text: str) -> set[tuple[str, bool]]:
    """Distinct words (…, False) of a text and the stems (…, True) of 4 to 7 letters they begin with."""
    words = {w for w in TOKEN.findall(text.lower()) if 3 <= len(w) <= 30}
    return {(w, False) for w in words} | {(w[:k], True) for w in words for k in range(4, min(8, len(w)))}


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency by class; a task holds at most about a million grams, then hands them on."""

    def out(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_pydict({
            "gram": pa.array([k[0] for k in keys], pa.string()),
            "stem": pa.array([k[1] for k in keys], pa.bool_()),
            "toxic": pa.array([toxic[k] for k in keys], pa.int64()),
            "clean": pa.array([clean[k] for k in keys], pa.int64()),
        })

    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("__toxic").to_pylist()):
            (toxic if label else clean).update(grams(text or ""))
            if len(toxic) + len(clean) > 1_000_000:
                yield out(toxic, clean)
                toxic, clean = Counter(), Counter()
    yield out(toxic, clean)


def choose(rows: list[tuple[str, bool, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """(term, is stem, log odds) without stems that begin with a chosen shorter one.

    Words stay beside the stems that cover them: a short stem takes no edits, its words do.
    """
    chosen: dict[tuple[str, bool], tuple[float, int]] = {}
    for gram, stem, toxic, clean in sorted(rows, key=lambda r: (len(r[0]), r[0], not r[1])):
        odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        if stem and any((gram[:k], True) in chosen for k in range(4, len(gram))):
            continue
        chosen[gram, stem] = (odds, toxic)
    top = sorted(chosen.items(), key=lambda c: (-c[1][1], c[0]))[:LEXICON]
    return [(g, stem, odds) for (g, stem), (odds, _) in top]


# -- automaton ---------------------------------------------------------------------------------


class Automaton:
    """The Levenshtein automata of all terms, run together on the lexicon's trie.

    A state is a set of (trie node, edits so far); the set of states is made while words are read
    and kept, so a word costs one dictionary look-up a letter, and most die within a few letters.
    The first letter must be right. A stem accepts whatever follows it.
    """

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.depth, self.most = [0], [0]
        for t, (term, stem, _) in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.depth.append(self.depth[node] + 1)
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], self.allowed(term, stem))
            self.ends[node].append(t)
        self._reset()

    @staticmethod
    def allowed(term: str, stem: bool) -> int:
        n = len(term)
        return (n >= 7) if stem else (n >= 5) + (n >= 9)

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.hits: list[tuple] = []
        self._state(frozenset())
        self.start = self._state(frozenset({(0, 0)}))

    def _state(self, s: frozenset) -> int:
        got = self.ids.get(s)
        if got is None:
            got = self.ids[s] = len(self.states)
            self.states.append(s)
            self.moves.append({})
            word = stem = None
            for node, e in s:
                for t in self.ends[node]:
                    term, is_stem, _ = self.terms[t]
                    if e <= self.allowed(term, is_stem):
                        if is_stem:
                            stem = min(stem or (9, 0), (e, t))
                        else:
                            word = min(word or (9, 0), (e, t))
            self.hits.append((word, stem))
        return got

    def _close(self, pairs: set[tuple[int, int]]) -> frozenset:
        """Adds skipped trie letters, keeps the least edits of a node."""
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            if node:
                todo += [(n, e + 1) for n in self.child[node].values()]
        return frozenset(least.items())

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if node == 0:
                if c in self.child[0]:
                    out.add((self.child[0][c], 0))
                continue
            out.add((node, e + 1))
            for d, n in self.child[node].items():
                out.add((n, e if d == c else e + 1))
        if len(self.states) > 200_000:
            raise OverflowError
        return self._state(self._close(out))

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term that the word is a form of."""
        try:
            state, best = self.start, None
            for c in word:
                moves = self.moves[state]
                nxt = moves.get(c)
                if nxt is None:
                    nxt = moves[c] = self._move(state, c)
                if nxt == 0:
                    return best
                state = nxt
                stem = self.hits[state][1]
                if stem is not None and (best is None or stem < best):
                    best = stem
            word_hit = self.hits[state][0]
            return word_hit if word_hit is not None and (best is None or word_hit < best) else best
        except OverflowError:  # states that were made for rare words; made again as needed
            self._reset()
            return self.match(word)


def quotation(text: str, start: int, end: int) -> float:
    """0 (abuse) to 1 (quotation): an open mark before, a closing one behind, a verb of reporting near."""
    before, behind = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    inside = sum(map(before.count, OPENING)) % 2 == 1 and any(m in behind for m in CLOSING)
    return 0.7 * inside + 0.3 * bool(REPORTING.search(before) or REPORTING.search(behind))


class Scorer:
    """Features and score of a text. Words known to be clean are remembered, up to a limit."""

    def __init__(self, terms: list[tuple[str, bool, float]], weights: np.ndarray | None):
        self.terms, self.weights = terms, weights
        self.automaton: Automaton | None = None

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "automaton": None}

    def features(self, text: str | None) -> tuple[np.ndarray, int]:
        if self.automaton is None:
            self.automaton, self.clean, self.found = Automaton(self.terms), set(), {}
        x = np.zeros(N_FEATURES)
        x[0] = 1
        low = (text or "").lower()
        words = TOKEN.findall(low) if self.terms else []
        distinct = set(words)
        for w in distinct - self.clean:
            if w not in self.found:
                hit = self.automaton.match(w[:64])
                if hit is None:
                    self.clean.add(w)
                else:
                    self.found[w] = hit
        if len(self.clean) > 400_000 or len(self.found) > 100_000:
            self.clean, self.found = set(), {w: h for w, h in self.found.items() if w in distinct}
        bad = {w for w in distinct if w in self.found}
        if not bad:
            return x, 0
        abuse = fuzzy = quoted = 0.0
        n, most = 0, 0.0
        for m in TOKEN.finditer(low):
            if m[0] in bad:
                edits, t = self.found[m[0]]
                q = quotation(low, m.start(), m.end())
                n += 1
                quoted += q
                if edits:
                    fuzzy += 1 - q
                else:
                    abuse += 1 - q
                    most = max(most, self.terms[t][2])
        x[1:] = (math.log1p(abuse), math.log1p(fuzzy), math.log1p(quoted), math.log1p(100 * abuse / len(words)), math.log1p(len({self.found[w][1] for w in bad if not self.found[w][0]})), most)
        return x, n

    def score(self, text: str | None) -> tuple[float, int]:
        if self.weights is None:
            return 0.0, 0
        x, n = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.weights))))), n


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


# -- Spark -------------------------------------------------------------------------------------


def held_out():
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 3 is 1 (null id: not so)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Scorer:
    """Lexicon and weights from at most per_class labelled rows of either class, chosen by hash.

    Terms are words and stems that many toxic and hardly any clean sampled documents hold.
    Without rows of both classes the scorer has no terms and rates everything 0.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = known.where("__toxic = 1").orderBy(*order).limit(per_class).unionByName(known.where("__toxic = 0").orderBy(*order).limit(per_class))
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "__toxic"), "toxic-sample")
    n = {r["__toxic"]: r["n"] for r in sample.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Scorer([], None)
    counts = sample.mapInArrow(_gram_counts, "gram string, stem boolean, toxic long, clean long").groupBy("gram", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least = max(3, round(0.002 * n_toxic))
    odd = counts.where((F.col("toxic") >= least) & ((F.col("toxic") + 0.5) / n_toxic >= 25 * (F.col("clean") + 0.5) / n_clean))
    rows = [tuple(r) for r in odd.orderBy(F.desc("toxic"), "gram", "stem").limit(10 * LEXICON).collect()]
    scorer = Scorer(choose(rows, n_toxic, n_clean), None)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [scorer.features(t)[0].tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column("__toxic"), "x": pa.array(xs, pa.list_(pa.float64()))})

    # One row an id, so that what comes to the driver is bounded by the sample, however often an id is repeated.
    once = sample.groupBy("doc_id", "__toxic").agg(F.min("text").alias("text"))
    rated = once.mapInArrow(rate, "y int, x array<double>").collect()
    scorer.weights = logistic(np.array([r["x"] for r in rated]), np.array([r["y"] for r in rated], float))
    return scorer


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted, hits for every row; one scan, no shuffle.

    Null and empty texts get the score of a text without hits. Very long texts are scored whole. Repeated rows are scored
    alike; an empty table gives an empty result. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for batch in batches:
            got = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "score": pa.array([s for s, _ in got], pa.float64()),
                "predicted": pa.array([int(s >= THRESHOLD) for s, _ in got], pa.int32()),
                "hits": pa.array([n for _, n in got], pa.int64()),
            })

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, hits long")


def keep_clean(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs below the threshold, all columns as they are; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([scorer.score(t)[0] < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
