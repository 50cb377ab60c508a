"""Toxicity: Levenshtein automata intersected with a trie of learned terms, scored in context.

1. Terms are learned from a bounded sample of labelled rows: words and word beginnings that
   occur in toxic documents far more than chance allows.
2. The terms form a trie.  The automaton that accepts every word within the edits allowed for a
   term's length is run over the trie lazily: a state is a set of (trie node, edits) pairs, kept
   once computed.  Nearly all words leave it after two or three letters.
3. Each hit is judged in a window of words around it: quotation marks or words of reporting
   point to a quotation, further hits and words of address to abuse.  A logistic model over
   sums of hits per document gives the score.

Null and empty texts have no hits and get the score of a text without hits.  Rows are scored one by one: repeated
rows, ties and extra columns change nothing; an empty table gives no rows.  Without toxic labels
every row scores 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut
from tidelog.llm.kernels import trim
from tidelog.llm.labelled import SAMPLE_ROWS, fold, in_slices, sample
from tidelog.llm.quality import _logistic

EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_~`|#$%&"
QUOTES = frozenset("\"«»„“”‘’")
REPORT = frozenset("said says wrote writes quote quoted called calls reported claims claimed sagte schrieb zitat dit écrit dijo escribió".split())
ADDRESS = frozenset("you your you're youre u du dich dein ihr tu toi te vous usted tú".split())
#: Beginnings of words that are counted while learning terms, and terms kept at most.
SHORTEST, LONGEST, TERMS = 4, 12, 4_000
WINDOW = 12
#: Words whose match a Python worker keeps, and states of the automaton; both are made anew as needed.
CACHE, STATES = 100_000, 60_000


def allowed(length: int) -> int:
    """Edits allowed for a term of that many letters."""
    return 0 if length < 5 else 1 if length < 10 else 2


class Automaton:
    """Words within the allowed edits of a term.  Terms ending in * match any longer word too, without edits."""

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.open: list[bool] = []
        self.most: list[int] = []
        roots = {}
        for t, term in enumerate(terms):
            tail, word = term.endswith("*"), term.rstrip("*")
            k = 0 if tail else allowed(len(word))
            node = roots.setdefault(k, None)
            if node is None:
                node = roots[k] = self._node(k)
            for ch in word:
                nxt = self.child[node].get(ch)
                if nxt is None:
                    nxt = self.child[node][ch] = self._node(k)
                node = nxt
            self.ends[node], self.open[node] = t, self.open[node] or tail
        self.letters = frozenset(ch for c in self.child for ch in c)
        self.roots = {(r, 0) for r in roots.values()}
        self._forget()

    def _forget(self):
        self.sets, self.numbers, self.steps, self.best = [], {}, [], []
        self.start = self._state(self.roots)

    def _node(self, k: int) -> int:
        self.child.append({}), self.ends.append(-1), self.open.append(False), self.most.append(k)
        return len(self.child) - 1

    def _state(self, pairs: set) -> int:
        """The number of a state; pairs are closed under skipping a letter of the term."""
        least, todo = {}, list(pairs)
        while todo:
            n, e = todo.pop()
            if e <= self.most[n] and e < least.get(n, 99):
                least[n] = e
                todo += [(c, e + 1) for c in self.child[n].values()]
        key = frozenset(least.items())
        if not key:
            return -1
        got = self.numbers.get(key)
        if got is None:
            got = self.numbers[key] = len(self.sets)
            self.sets.append(key), self.steps.append({})
            final = [(e, self.ends[n]) for n, e in key if self.ends[n] >= 0]
            stays = [(e, self.ends[n]) for n, e in key if self.ends[n] >= 0 and self.open[n] and e == 0]
            self.best.append((min(final, default=None), min(stays, default=None)))
        return got

    def _step(self, state: int, ch: str) -> int:
        pairs = set()
        for n, e in self.sets[state]:
            c = self.child[n].get(ch)
            if c is not None:
                pairs.add((c, e))
            if e < self.most[n]:
                pairs.add((n, e + 1))
                pairs.update((c, e + 1) for c in self.child[n].values())
        got = self.steps[state][ch] = self._state(pairs)
        return got

    def match(self, word: str):
        """(edits, term) of the best match, or None."""
        if len(self.sets) > STATES:
            self._forget()
        state, steps, letters, found = self.start, self.steps, self.letters, None
        if state < 0:
            return None  # no terms
        for ch in word:
            if ch not in letters:
                ch = ""
            nxt = steps[state].get(ch)
            state = self._step(state, ch) if nxt is None else nxt
            if state < 0:
                return found
            found = self.best[state][1] or found
        return min(filter(None, (self.best[state][0], found)), default=None)


def _prefix_counts(batches):
    """For each batch, how many toxic and other documents have each word (ending in $) and beginning."""
    for b in batches:
        count: dict[str, list[int]] = {}
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen = set()
            for w in set(text.lower().split()):
                w = w.strip(EDGE)
                if len(w) >= SHORTEST:
                    seen.add(w + "$")
                    seen.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
            for s in seen:
                count.setdefault(s, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([c[1] for c in count.values()], pa.int64()), pa.array([c[0] for c in count.values()], pa.int64())], ["term", "bad", "good"])


def learn_terms(texts: DataFrame, most: int = TERMS) -> list[str]:
    """Terms that mark toxic documents, strongest first.  texts: (text, y)."""
    totals = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad:
        return []
    base = bad / (bad + good)
    rate = F.col("bad") / (F.col("bad") + F.col("good"))
    surprise = F.col("bad") * F.log(rate / F.lit(base)) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - rate) / F.lit(1 - base + 1e-12))).otherwise(0.0)
    counted = texts.mapInArrow(_prefix_counts, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    kept = counted.where((F.col("bad") >= 3) & (rate >= 0.8)).withColumn("g", surprise).where("g >= 9" if base < 0.5 else "g >= 2").orderBy(F.desc("g"), "term").limit(20 * most).collect()
    support = {r["term"]: r["bad"] for r in kept}
    longer: dict[str, int] = {}  # the greatest support of a beginning with one letter more
    for x, n in support.items():
        longer[x[:-1]] = max(longer.get(x[:-1], 0), n)
    words, stems = {}, {}
    for r in kept:
        t = r["term"]
        if t.endswith("$"):
            if r["bad"] >= 0.6 * support.get(t[:-1][:LONGEST], 1e9):
                words[t[:-1]] = r["g"]
        elif longer.get(t, 0) < 0.9 * r["bad"]:
            stems[t] = r["g"]
    short = sorted(stems, key=len)
    tails: list[str] = []
    taken, begun = set(), {w[:k] for w in words for k in range(1, len(w) + 1)}
    for s in short:
        ahead = [s[:k] for k in range(1, len(s) + 1)]
        if s not in begun and not any(x in taken or x in words for x in ahead):
            tails.append(s)
            taken.add(s)
    found = [(g, w) for w, g in words.items()] + [(stems[s], s + "*") for s in tails]
    return [w for _, w in sorted(found, key=lambda x: (-x[0], x[1]))[:most]]


class Scorer:
    """Sums of hits for each text."""

    def __init__(self, terms: list[str]):
        self.terms, self.automaton, self.cache = terms, None, {}

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(index of the word, edits, term) for each hit."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        cache, match = self.cache, self.automaton.match
        found = {}
        for w in set(words):
            m = cache.get(w, 0)
            if m == 0:
                if len(cache) > CACHE:
                    cache.clear()
                m = cache[w] = match(w.strip(EDGE).lower())
            if m:
                found[w] = m
        return [(i, *found[w]) for i, w in enumerate(words) if w in found] if found else []

    def features(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), 8))
        for i, t in enumerate(texts):
            words = (t or "").split()
            hits = self.hits(words)
            if not hits:
                continue
            exact = fuzzy = quoted = aimed = dense = 0
            at = [h[0] for h in hits]
            for j, (pos, edits, _) in enumerate(hits):
                around = words[max(0, pos - WINDOW) : pos + WINDOW + 1]
                marks = any(c in QUOTES for c in words[pos]) or (any(w[0] in QUOTES for w in words[max(0, pos - WINDOW) : pos]) and any(w[-1] in QUOTES for w in words[pos + 1 : pos + WINDOW + 1]))
                low = {w.strip(EDGE).lower() for w in around}
                if marks or low & REPORT:
                    quoted += 1
                elif edits:
                    fuzzy += 1
                else:
                    exact += 1
                aimed += bool(low & ADDRESS)
                k = j
                while k < len(at) and at[k] <= pos + WINDOW:
                    k += 1
                dense = max(dense, k - j)
            out[i] = exact > 0, np.log1p(exact), fuzzy > 0, np.log1p(fuzzy), np.log1p(quoted), np.log1p(aimed), np.log1p(dense), 100 * len(hits) / (100 + len(words))
        return out


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the last one the constant.  Without any hit in the sample, the constant alone counts."""
    return _logistic(np.c_[x, np.ones(len(x))], y, ridge=0.3)


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -60, 60)))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS) -> tuple[Scorer, np.ndarray]:
    """Terms and weights from at most ``rows`` labelled documents.  Labels of fold ``held`` are not read."""
    texts = cut(sample(docs, labels, "toxic", folds, held, rows))
    scorer = Scorer(learn_terms(texts))

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(in_slices(scorer.features, b.column(0))), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = texts.mapInArrow(measure, "x array<double>, y int").toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda i: (list(got.x.iat[i]), got.y.iat[i]))]  # any order of tasks gives one model
    y = got.y.to_numpy()
    w = fit(np.array(got.x.tolist(), float).reshape(len(got), 8), y) if y.any() else np.r_[np.zeros(8), -60.0]
    return scorer, w


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut_at: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scorer, w = train(docs, labels, folds, held, rows)

    def mark(batches):
        for b in batches:
            s = apply(w, in_slices(scorer.features, b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut_at).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
            trim()

    rows_in = docs.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "text")
    return rows_in.mapInArrow(mark, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut_at: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``cut_at``.  No shuffle."""
    scorer, w = train(docs, labels, folds, held, rows)
    at = docs.columns.index("text")

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(apply(w, in_slices(scorer.features, b.column(at))) < cut_at))
            trim()

    return docs.mapInArrow(keep, docs.schema)
