"""Toxicity scores from deobfuscated text.

A character trigram model is counted over all documents. A token that hides something - digits or signs between letters, a
letter three times in a row, letters dealt out by spaces - becomes a lattice: each sign may stand for the letters it
resembles, for a gap or for nothing, a repeated letter for one. Viterbi decoding under the trigram model picks the cheapest
path; all other tokens have one path, themselves. Restored words and their beginnings carry weights learned from labels (the
lower confidence bound of their log odds), and a logistic function of the largest weight, the sum and their density gives
the score.

The classifier is fitted on at most ``rows`` labelled documents drawn by hash (a documented bound); the language model covers
every document, and scores read whole texts.

Nulls: a null or empty text, like one without known words, gets the score of no evidence. Rows with a null label or id teach
nothing. Repeated rows get equal scores. An empty table gives no rows; without labels of both kinds every score is the share
of toxic labels, or 0. Only the named columns are read; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veriframe.llm.tables import slices

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäæçèéêëìíîïñòóôöùúûüœ"
GAP, SIZE = 0, len(LETTERS) + 1
# What a sign may stand for; fixed values of the channel.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "€": "e", "£": "l",
}
SUBSTITUTE, DROP_SIGN, DROP_REPEAT, KEEP_GAP, DROP_SPACE = 1.0, 1.0, 0.5, 1.5, 0.7  # costs in nats
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
HIDDEN = re.compile(r"[\W\d_]|(.)\1\1")
SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
PREFIXES = (4, 5, 6)
SETTLE = 32  # characters after which the readings' common beginning is set aside


def _symbol_table():
    table = np.zeros(0x180, np.uint8)
    for i, letter in enumerate(LETTERS):
        table[ord(letter)] = i + 1
        if len(letter.upper()) == 1:
            table[ord(letter.upper())] = i + 1
    return table


def character_counts(docs, text_col="text"):
    """Counts of all character trigrams over all texts: {index: count}, at most SIZE ** 3 entries."""

    def count(batches):
        table = _symbol_table()
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, stop in slices([len(t or "") + 2 for t in texts], 1 << 20):
                codes = np.frombuffer("\n\n".join(["", *[t or "" for t in texts[start:stop]], ""]).encode("utf-32-le"), np.uint32)
                symbols = table[np.where(codes < len(table), codes, 0)].astype(np.int32)
                index = (symbols[:-2] * SIZE + symbols[1:-1]) * SIZE + symbols[2:]
                total += np.bincount(index, minlength=SIZE**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])

    rows = docs.select(text_col).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: r["n"] for r in rows}


def language_model(counts):
    """Cost -ln P(c | a, b), smoothed by the bigram."""
    grams = np.zeros(SIZE**3)
    if counts:
        grams[list(counts)] = list(counts.values())
    grams = grams.reshape(SIZE, SIZE, SIZE)
    pairs = grams.sum(axis=0) + 0.1
    pairs /= pairs.sum(axis=1, keepdims=True)
    return -np.log((grams + 2 * pairs[None]) / (grams.sum(axis=2, keepdims=True) + 2))


@dataclass
class Restorer:
    """Viterbi decoding of one token, remembering what it has decoded."""

    costs: np.ndarray
    symbols: dict = field(default_factory=lambda: {c: i + 1 for i, c in enumerate(LETTERS)})

    def __post_init__(self):
        self.table = self.costs.tolist()

    def arcs(self, text):
        """Per character: [(symbol or None for nothing, cost)]."""
        previous = None
        for char in text:
            if char in self.symbols:
                yield [(self.symbols[char], 0.0)] + ([(None, DROP_REPEAT)] if char == previous else [])
            elif char == " ":
                yield [(None, DROP_SPACE), (GAP, KEEP_GAP)]
            else:
                yield [(None, DROP_SIGN), (GAP, KEEP_GAP)] + [(self.symbols[c], SUBSTITUTE) for c in LOOKALIKES.get(char, "")]
            previous = char

    def restore(self, text):
        """The cheapest reading of ``text``, as words.

        What all paths have in common is set aside now and then, so paths stay short however long the text is.
        """
        paths, settled = {(GAP, GAP): (0.0, ())}, []
        for n, arcs in enumerate(self.arcs(text), 1):
            step = {}
            for (a, b), (cost, written) in paths.items():
                for symbol, own in arcs:
                    if symbol is None or (symbol == GAP and b == GAP):
                        state, new = (a, b), (cost + own, written)
                    else:
                        state, new = (b, symbol), (cost + own + self.table[a][b][symbol], (*written, symbol))
                    if state not in step or new < step[state]:
                        step[state] = new
            paths = step
            if n % SETTLE == 0:
                common = commonprefix([written for _, written in paths.values()])
                settled += common
                paths = {state: (cost, written[len(common):]) for state, (cost, written) in paths.items()}
        _, written = min((cost + self.table[a][b][GAP], written) for (a, b), (cost, written) in paths.items())
        return "".join(" " if s == GAP else LETTERS[s - 1] for s in (*settled, *written)).split()


class WordWeights(dict):
    """Weight of a token as it is written: the largest weight of its restored words and their beginnings."""

    LIMIT = 1_000_000  # tokens remembered at a time; others are worked out again

    def __init__(self, restorer, weights):
        super().__init__()
        self.restorer, self.weights = restorer, weights

    def __missing__(self, token):
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = weight = max((self.weights.get(f, 0.0) for f in features(token, self.restorer)), default=0.0)
        return weight


def features(token, restorer):
    """Restored words of a token and their beginnings."""
    core = EDGE.sub("", token.lower())
    words = [core] if core else []
    if not core or HIDDEN.search(core) or len(core) < len(token) - 1:
        words += restorer.restore(token.lower())
    found = set(words)
    for word in words:
        found.update(f"{word[:n]}~" for n in PREFIXES if len(word) > n)
    return found


def tokens_of(text, restorer):
    """Tokens of a text, with the readings of letters dealt out by spaces."""
    tokens = text.split()
    for run in SPACED.finditer(text):
        tokens += restorer.restore(run.group().lower())
    return tokens


def draw_rows(docs, labels, rows, id_col, label_col):
    """At most about ``rows`` labelled documents by hash of the id, with the bounded label side broadcast."""
    labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    total = labels.count()
    chosen = labels.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < min(1.0, rows / max(total, 1)) * (1 << 20))
    return docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"])  # about ``rows`` rows of 12 bytes


@dataclass(frozen=True)
class Model:
    costs: np.ndarray
    weights: dict
    logistic: np.ndarray  # intercept, largest weight, log sum, density; scaled inputs
    prior: float


def evidence(text, words):
    """Largest weight, log of the summed weights, share of tokens with weight."""
    tokens = tokens_of(text or "", words.restorer)
    if not tokens:
        return 0.0, 0.0, 0.0
    weights = np.fromiter(map(words.__getitem__, tokens), np.float64, len(tokens))
    return float(weights.max()), float(np.log1p(weights.sum())), float((weights > 0).mean())


def _logistic(x, y, ridge=1e-3, steps=50):
    """Newton steps on a handful of coefficients."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        change = np.linalg.solve(hessian, gradient)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return w


def fit(docs, labelled_docs, labels, rows=20_000, id_col="doc_id", text_col="text", label_col="toxic"):
    """Language model over ``docs``; word weights and logistic from a bounded sample of ``labelled_docs``."""
    spark = docs.sparkSession
    costs = language_model(character_counts(docs, text_col))
    sample = draw_rows(labelled_docs.select(id_col, text_col), labels, rows, id_col, label_col).select(F.xxhash64("_id").alias("_id"), "_y", F.col(text_col).alias("_text"))
    shared_costs = spark.sparkContext.broadcast(costs)

    def count(batches):
        restorer = Restorer(shared_costs.value)
        found, memo = Counter(), {}
        for batch in batches:
            for key, y, text in zip(*(c.to_pylist() for c in batch.columns)):
                half = key & 1
                own = set()
                for token in set(tokens_of(text or "", restorer)):
                    if token not in memo:
                        memo[token] = features(token, restorer)
                    own |= memo[token]
                found.update((f, half, y > 0) for f in own)
                found[None, half, y > 0] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([bool(k[2]) for k in keys]), pa.array([found[k] for k in keys], pa.int64())],
            ["word", "half", "toxic", "n"],
        )

    n = lambda half, toxic: F.sum(F.when((F.col("half") == half) & (F.col("toxic") == toxic), F.col("n")).otherwise(0)).alias(f"n{half}{int(toxic)}")
    counted = sample.mapInArrow(count, "word string, half int, toxic boolean, n bigint").groupBy("word").agg(n(0, False), n(0, True), n(1, False), n(1, True))
    # words seen in a single toxic row cannot carry weight; the rest is bounded by the sample
    counted = counted.where(F.col("word").isNull() | (F.col("n01") + F.col("n11") >= 2)).collect()
    totals = next((r for r in counted if r["word"] is None), None)
    if totals is None:
        return Model(costs, {}, np.zeros(4), 0.0)
    all_counts = np.array([[totals[f"n{h}{y}"] for y in (0, 1)] for h in (0, 1)], float)
    prior = all_counts[:, 1].sum() / all_counts.sum()
    if not 0 < prior < 1:
        return Model(costs, {}, np.zeros(4), prior)
    words = [r["word"] for r in counted if r["word"] is not None]
    table = np.array([[r["n00"], r["n01"], r["n10"], r["n11"]] for r in counted if r["word"] is not None], float).reshape(-1, 2, 2)
    # weights from each half are tried on the other, so that the logistic sees weights that did not see its rows
    halves = [_weights(words, table[:, h], all_counts[h]) for h in (0, 1)]
    shared = spark.sparkContext.broadcast(halves)

    def measure(batches):
        restorer = Restorer(shared_costs.value)
        known = [WordWeights(restorer, shared.value[1 - half]) for half in (0, 1)]
        for batch in batches:
            out = [(float(y > 0), *evidence(text, known[key & 1])) for key, y, text in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64())] * 4, ["y", "a", "b", "c"])

    seen = np.array(sample.mapInArrow(measure, "y double, a double, b double, c double").collect(), float)  # bounded by the sample
    return Model(costs, _weights(words, table.sum(axis=1), all_counts.sum(axis=0)), _logistic(seen[:, 1:], seen[:, 0]), prior)


def _weights(words, table, totals):
    """Lower 95 % bound of the log odds ratio of a word's presence, where positive."""
    n0, n1 = table[:, 0] + 0.5, table[:, 1] + 0.5
    m0, m1 = totals[0] - table[:, 0] + 0.5, totals[1] - table[:, 1] + 0.5
    bound = np.log(n1 * m0 / (n0 * m1)) - 1.96 * np.sqrt(1 / n0 + 1 / n1 + 1 / m0 + 1 / m1)
    return {words[i]: float(bound[i]) for i in np.flatnonzero(bound > 0)}


def score(docs, model, text_col="text"):
    """``docs`` plus score and predicted (1 from a score of 0.5)."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the alphabet

    def run(batches):
        value = shared.value
        words = WordWeights(Restorer(value.costs), value.weights)
        for batch in batches:
            if value.weights:
                x = np.array([evidence(text, words) for text in batch.column(text_col).to_pylist()], float).reshape(-1, 3)
                scores = 1 / (1 + np.exp(-np.clip(value.logistic[0] + x @ value.logistic[1:], -30, 30)))
            else:
                scores = np.full(len(batch), value.prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")
