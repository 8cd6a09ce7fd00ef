"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, and context.

1. From labelled documents (a sample of at most ``max_train``, by a hash of the
   id) words and word beginnings that mark toxic documents are learned by a
   likelihood-ratio test; they form a trie.
2. A lazily determinised automaton runs a token through the trie and the
   Levenshtein automata of all its terms at once (one edit from 5 letters, two
   from 9; a swap of neighbours is one edit). Beginnings match exactly.
3. A hit's window of words tells quotation from abuse: inside quotation marks,
   or behind a word of reporting, it counts as quoted. A logistic model, fitted
   to the same labelled sample, weighs exact, misspelled and quoted hits.

Nulls and empty texts have no hits and get the model's score for that. Labels
with a null are left out; a document with several labels is toxic if any says
so. Without labels nothing is learned and every score is 0. Repeated rows are
scored alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarmill.llm.splits import held_out
from sonarmill.session import cut

MAX_TRAIN = 20_000
THRESHOLD = 0.7
EVIDENCE = 12.0  # least log-likelihood ratio of a term
PURITY = 0.9
PREFIXES = (4, 5, 6)
WINDOW = 8

TOKEN = re.compile(r"[^\W\d_]+")
#: Marks of quotation and words of reporting.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says say quote quoted wrote called calls word term slur insult insults dijo dice palabra llamó sagte sagt wort nannte dit disait mot appelé".split())

N_FEATURES = 7


def edits_for(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Matches whole tokens against terms with edits, and against beginnings exactly."""

    MAX_STATES = 100_000
    DEAD = 1  # the state that nothing leads out of

    def __init__(self, words: Iterable[str], prefixes: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.prefix: list[str | None] = [None]
        self.slack = [0]  # most edits any term below allows
        for term in words:
            self.word[self._add(term, edits_for(len(term)))] = term
        for term in prefixes:
            self.prefix[self._add(term, 0)] = term
        self._reset()

    def _add(self, term: str, slack: int) -> int:
        at = 0
        self.slack[0] = max(self.slack[0], slack)
        for c in term:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.word.append(None)
                self.prefix.append(None)
                self.slack.append(0)
            at = self.children[at][c]
            self.slack[at] = max(self.slack[at], slack)
        return at

    def _reset(self) -> None:
        start, dead = self._closed({(0, ""): 0}), frozenset()
        self.ids = {start: 0, dead: self.DEAD}
        self.states = [start, dead]
        self.moves: list[dict[str, int]] = [{}, {}]
        self.final: list[tuple[str, int] | None] = [self._final(start), None]
        self.sure: list[tuple[str, int] | None] = [None, None]

    def _closed(self, found: dict[tuple[int, str], int]) -> frozenset:
        """Adds what a dropped letter of a term reaches; keeps the fewest edits of each place."""
        todo = list(found.items())
        while todo:
            (node, owed), used = todo.pop()
            if owed or used != found[node, owed]:
                continue
            for child in self.children[node].values():
                if used < self.slack[child] and found.get((child, ""), 9) > used + 1:
                    found[child, ""] = used + 1
                    todo.append(((child, ""), used + 1))
        return frozenset((node, owed, used) for (node, owed), used in found.items())

    def _final(self, state: frozenset) -> tuple[str, int] | None:
        best = None
        for node, owed, used in state:
            term = self.word[node]
            if term is not None and not owed and used <= edits_for(len(term)) and (best is None or (used, term) < (best[1], best[0])):
                best = (term, used)
        return best

    def _move(self, state: int, c: str) -> int:
        found: dict[tuple[int, str], int] = {}
        sure = None

        def reach(node: int, owed: str, used: int) -> None:
            if used <= self.slack[node] and found.get((node, owed), 9) > used:
                found[node, owed] = used

        for node, owed, used in self.states[state]:
            if owed:
                if owed == c:
                    reach(node, "", used)
                continue
            for d, child in self.children[node].items():
                if d == c:
                    reach(child, "", used)
                    if used == 0 and self.prefix[child] is not None:
                        sure = (self.prefix[child] + "*", 0)
                else:
                    reach(child, "", used + 1)
                    if c in self.children[child]:
                        reach(self.children[child][c], d, used + 1)
            reach(node, "", used + 1)
        key = self._closed(found)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.final.append(self._final(key))
            self.sure.append(sure)
        elif sure:
            self.sure[self.ids[key]] = sure
        self.moves[state][c] = self.ids[key]
        return self.ids[key]

    def match(self, token: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, or of a beginning (with ``*``)."""
        if len(self.states) > self.MAX_STATES:
            self._reset()
        moves, sure, state, begun = self.moves, self.sure, 0, None
        for c in token:
            nxt = moves[state].get(c)
            state = self._move(state, c) if nxt is None else nxt
            if state == self.DEAD:
                return begun
            begun = begun or sure[state]
        found = self.final[state]
        return found if found and (found[1] == 0 or not begun) else begun


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    coef: list[float] = field(default_factory=lambda: [-30.0] + [0.0] * (N_FEATURES - 1))


class Scanner:
    """Finds hits in texts; keeps what it knows of tokens, up to a bound: clean ones in two generations, so that frequent ones stay."""

    KNOWN = 100_000

    def __init__(self, model: Model):
        self.automaton = Automaton(model.words, model.prefixes)
        self.clean: set[str] = set()
        self.stale: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def _new(self, tokens: set[str]) -> None:
        for token in tokens:
            found = self.automaton.match(token)
            if found:
                self.hits[token] = found
            else:
                self.clean.add(token)

    def scan(self, text: str) -> tuple[int, Counter]:
        """Number of tokens; (term, edits, quoted) with how often each occurs."""
        if len(self.clean) > self.KNOWN:  # before anything is taken from the caches for this text
            self.clean, self.stale = set(), self.clean
        if len(self.hits) > self.KNOWN:
            self.hits.clear()
        lower = text.lower()
        tokens = TOKEN.findall(lower)
        distinct = set(tokens) - self.clean
        if self.stale and distinct:
            again = distinct & self.stale
            self.clean |= again
            distinct -= again
        if not distinct:
            return len(tokens), Counter()
        self._new(distinct - self.hits.keys())
        hit = distinct & self.hits.keys()
        found: Counter = Counter()
        if hit:
            seen = list(TOKEN.finditer(lower))
            for k, m in enumerate(seen):
                if m[0] in hit:
                    found[(*self.hits[m[0]], self._quoted(lower, seen, k))] += 1
        return len(tokens), found

    @staticmethod
    def _quoted(lower: str, seen: list, k: int) -> bool:
        first, last = max(0, k - WINDOW), min(len(seen) - 1, k + WINDOW)
        before = lower[seen[first].start() : seen[k].start()]
        after = lower[seen[k].end() : seen[last].end()]
        opened = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
        return opened or any(seen[j][0] in REPORTING for j in range(max(0, k - 3), k))


def features(n_tokens: int, found: Counter, weights: dict[tuple[str, int], float]) -> list[float]:
    own = [(weights.get((t, e), 0.0), e, c) for (t, e, quoted), c in found.items() if not quoted]
    quoted = sum(weights.get((t, e), 0.0) for (t, e, q) in found if q)
    exact = [w for w, e, _ in own if e == 0]
    near = [w for w, e, _ in own if e]
    total = sum(c for w, _, c in own if w > 1)
    return [1.0, max(exact, default=0.0), math.log1p(sum(exact)), max(near, default=0.0), math.log1p(max(0.0, sum(near))), math.log1p(1000.0 * total / max(n_tokens, 20)) / 4, math.log1p(max(0.0, quoted))]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the constant is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("term", pa.string()), ("tox", pa.int64()), ("ok", pa.int64())])
    for batch in batches:
        seen = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(TOKEN.findall((text or "").lower()))
            seen[toxic].update(w for w in words if len(w) >= 3)
            seen[toxic].update({w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n})
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], schema=schema)


def train_sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(text, toxic) of at most about ``max_train`` labelled documents outside the held-out third."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    marks = marks.where(~held_out(F.col("doc_id")))
    n = marks.count()
    share = int(1_000_000 * min(1.0, max_train / max(n, 1))) + 1
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "y")  # the sample's bound is max_train


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    sample = cut(train_sample(docs, labels, max_train), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_tox, n_ok = sizes.get(1, 0), sizes.get(0, 0)
    if not n_tox or not n_ok:
        return Model()
    rate = n_tox / (n_tox + n_ok)
    counts = sample.mapInArrow(_term_counts, "term string, tox long, ok long").groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("ok").alias("ok"))
    p = F.col("tox") / (F.col("tox") + F.col("ok"))
    ratio = F.col("tox") * F.log(p / rate) + F.when(F.col("ok") > 0, F.col("ok") * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    strong = counts.where((F.col("tox") >= 3) & (p >= max(PURITY, (1 + rate) / 2))).withColumn("g", ratio).where(F.col("g") >= EVIDENCE)
    rows = strong.orderBy(F.desc("g"), "term").collect()  # terms of the sample, so max_train bounds them
    prefixes: list[str] = []
    for term in sorted((r["term"][:-1] for r in rows if r["term"].endswith("*")), key=len):
        if not any(term.startswith(q) for q in prefixes):
            prefixes.append(term)
    words = [r["term"] for r in rows if not r["term"].endswith("*")]
    model = Model(words=words, prefixes=prefixes)

    found = sample.mapInPandas(_training_hits(model), "y int, n_tokens long, hits string").toPandas()  # at most the sample's rows
    hits = [_unpack(h) for h in found["hits"]]
    tox, ok = Counter(), Counter()
    for y, h in zip(found["y"], hits, strict=True):
        (tox if y else ok).update({(t, e) for t, e, _ in h})
    for key in tox.keys() | ok.keys():
        a, b = (tox[key] + 0.5) / (n_tox + 1), (ok[key] + 0.5) / (n_ok + 1)
        model.weights[key] = math.log(a / b)
    for term in words:  # a misspelling never seen in the sample
        for e in range(1, edits_for(len(term)) + 1):
            if (term, e) not in model.weights:
                model.weights[term, e] = 0.8 * model.weights.get((term, 0), 0.0)
    x = np.array([features(n, h, model.weights) for n, h in zip(found["n_tokens"], hits, strict=True)])
    y = found["y"].to_numpy(float)
    coef = _fit(x, y)
    # Features 3 and 4 are misspelled hits; where the sample hardly has any, they get part of the exact hits' say.
    for near, exact in ((3, 1), (4, 2)):
        if (x[:, near] > 0).sum() < 50:
            coef[near] = max(coef[near], 0.9 * coef[exact])
    model.coef = coef.tolist()
    return model


def _training_hits(model: Model):
    def run(frames):
        scanner = Scanner(model)
        for frame in frames:
            rows = [scanner.scan(t or "") for t in frame["text"]]
            yield pd.DataFrame({"y": frame["y"], "n_tokens": [n for n, _ in rows], "hits": [";".join(f"{t},{e},{int(q)},{c}" for (t, e, q), c in sorted(h.items())) for _, h in rows]})

    return run


def _unpack(packed: str) -> Counter:
    out: Counter = Counter()
    for item in filter(None, packed.split(";")):
        t, e, q, c = item.split(",")
        out[t, int(e), q == "1"] = int(c)
    return out


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(1).to_pylist():
                n, found = scanner.scan(text or "")
                z = sum(a * b for a, b in zip(model.coef, features(n, found, model.weights), strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                hits.append([{"term": t, "edits": e, "quoted": q, "n": c} for (t, e, q), c in sorted(found.items())])
            kind = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, kind)], names=["doc_id", "score", "hits"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and hits (term, edits, quoted, n) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scored(model), "doc_id long, score double, hits array<struct<term: string, edits: int, quoted: boolean, n: long>>")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
