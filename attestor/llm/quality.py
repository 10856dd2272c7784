"""A quality classifier from weak labels.

Overlapping heuristic labellers look at each text and say good, bad or nothing. How accurate each
of them is, and how many documents are bad, is estimated by expectation-maximisation over the
counts of all vote patterns in the corpus; no true label is used. The posterior of each pattern
then labels a bounded sample, on which a linear scorer over hashed features is trained; it
scores every document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import per_row, prepared, stored, texts

TRAINING_ROWS = 8192  # at most so many documents train the scorer
DIMENSIONS = 1024
THRESHOLD = 0.3  # a document less likely to be good is rejected
ROUNDS, STEPS, PENALTY = 60, 400, 1e-4

GOOD, BAD, NONE = 1, 2, 0
LABELLERS = ("symbols", "marks", "pipes", "shouting", "exclaiming", "repeats", "neighbours", "prose", "variety")

# the class of each byte: lower case and non-ASCII letters, upper case, digits; all else is itself
_CLASS = np.arange(256)
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3


def measured(text: str) -> dict[str, float]:
    """What the labellers look at, as shares; empty for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return {}
    triples = Counter(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    return {"symbols": sum(text.count(c) for c in "#*$%&<>") / n,
            "shouting": sum(w.isupper() and len(w) > 2 for w in words) / n,
            "exclaiming": text.count("!!") / n,
            "repeats": sum(c for c in triples.values() if c > 1) / n,
            "neighbours": sum(a == b for a, b in zip(words, words[1:])) / n,
            "pipes": words.count("|") / n,
            "casing": sum(w[0].islower() for w in words) / n,
            "lines": 1 - len(set(lines)) / len(lines)}


def votes(m: dict[str, float]) -> list[int]:
    """One vote per labeller. Most know one fault and say nothing where they do not see it."""
    if not m:
        return [NONE] * len(LABELLERS)
    def bad(fault):
        return BAD if fault else NONE
    prose = m["symbols"] < 0.03 and m["pipes"] < 0.03 and m["casing"] > 0.5 and m["exclaiming"] < 0.05
    varied = m["repeats"] < 0.15 and m["neighbours"] < 0.1 and m["lines"] < 0.3
    return [bad(m["symbols"] > 0.2), bad(m["symbols"] + m["pipes"] > 0.12), bad(m["pipes"] > 0.1),
            bad(m["shouting"] > 0.3), bad(m["exclaiming"] > 0.15), bad(m["repeats"] > 0.5), bad(m["neighbours"] > 0.25),
            GOOD if prose else bad(m["casing"] < 0.35), GOOD if varied else bad(m["lines"] > 0.5)]


def pattern(text: str) -> int:
    return sum(v * 3 ** i for i, v in enumerate(votes(measured(text))))


def accuracies(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior probability of good by vote pattern, the labellers' vote tables, and the share of good.

    ``counts`` has at most 3 ** labellers entries however many documents there are. A table says
    how often a labeller gives each vote to bad and to good documents; it starts from labellers
    that are right rather than wrong.
    """
    names = sorted(counts)
    if not names:
        return {}, np.full((len(LABELLERS), 2, 3), 1 / 3), 0.5
    seen = np.array([[p // 3 ** i % 3 for i in range(len(LABELLERS))] for p in names])
    n = np.array([counts[p] for p in names], float)
    tables = np.tile(np.array([[0.4, 0.1, 0.5], [0.4, 0.55, 0.05]]), (len(LABELLERS), 1, 1))
    share = 0.8
    good = np.zeros(len(names))
    for _ in range(rounds):
        log = [np.log(1 - share), np.log(share)]
        for c in (0, 1):
            log[c] = log[c] + sum(np.log(tables[i, c, seen[:, i]]) for i in range(len(LABELLERS)))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        share = float(np.clip((n * good).sum() / n.sum(), 0.01, 0.99))
        for i in range(len(LABELLERS)):
            for c, mass in ((0, n * (1 - good)), (1, n * good)):
                sums = np.bincount(seen[:, i], mass, 3) + 1.0
                tables[i, c] = sums / sums.sum()
    return dict(zip(names, good.tolist())), tables, share


def hashed(text: str) -> np.ndarray:
    """Features of length 1: triples of byte classes, and steps of what repeats, hashed to a table."""
    raw = _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    out = np.zeros(DIMENSIONS, np.float32)
    if len(raw) > 2:
        at = (raw[:-2] * 65599 + raw[1:-1] * 257 + raw[2:] * 31) % (DIMENSIONS - 32)
        out[:] = np.sqrt(np.bincount(at, minlength=DIMENSIONS))
        out /= np.linalg.norm(out)
    m = measured(text)
    for k, name in enumerate(("repeats", "neighbours", "lines")):
        step = min(9, int(10 * m.get(name, 0.0)))
        out[DIMENSIONS - 32 + 10 * k + step] = 0.5
    return out


def fitted(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of a logistic scorer for soft labels y, the constant last; full-batch Adam."""
    w, m, v = np.zeros((3, x.shape[1] + 1))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w[:-1].astype(np.float32) + w[-1])))
        g = np.append(x.T @ (p - y).astype(np.float32) / len(y) + PENALTY * w[:-1], (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def train(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> np.ndarray | None:
    """The scorer of a corpus, or None for an empty one.

    Votes are counted over all documents; the features of at most ``training_rows`` documents, in
    hash order of their keys, are fitted by one task, and only the weights come to the driver.
    """
    patterns = stored(per_row(docs, lambda d, t: (d, pattern(t or "")), "doc_id bigint, pattern int"), "quality-votes")
    posterior, _, _ = accuracies({r["pattern"]: r["count"] for r in patterns.groupBy("pattern").count().collect()})
    keys = patterns.select("doc_id").distinct()
    chosen = stored(keys.filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows), "quality-chosen")
    sample = per_row(docs.join(F.broadcast(chosen), "doc_id"), lambda d, t: (d, hashed(t or "").tobytes(), pattern(t or "")),
                     "doc_id bigint, x binary, pattern int")
    # repeated keys can make more rows than keys; the order is that of keys and features, so any run fits the same rows alike
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x"), "pattern").limit(training_rows)

    def fit(parts):
        parts = [p for p in parts if p.num_rows]
        if parts:
            x = np.concatenate([np.frombuffer(b"".join(p.column("x").to_pylist()), np.float32) for p in parts]).reshape(-1, DIMENSIONS)
            y = np.array([posterior[p] for part in parts for p in part.column("pattern").to_pylist()], np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([fitted(x, y).tolist()], pa.list_(pa.float64()))], ["w"])
    weights = rows.select("x", "pattern").coalesce(1).mapInArrow(fit, "w array<double>").collect()
    return np.array(weights[0].w) if weights else None


def score(text: str | None, weights: np.ndarray) -> float:
    """The probability that a text is good; one without words has nothing for it and gets 0."""
    if not (text or "").split():
        return 0.0
    return float(1 / (1 + np.exp(-(float(hashed(text) @ weights[:-1]) + weights[-1]))))


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, score, kept) of every document; kept means a score of at least THRESHOLD.

    A null, empty or blank text has score 0 and is rejected. Repeated rows get equal scores, a
    null key is scored like any other but never trains; other columns are ignored.
    """
    prepared(docs.sparkSession)
    docs = texts(docs, key, text)
    weights = train(docs, training_rows)
    return per_row(docs, lambda d, t: (d, s := 0.0 if weights is None else score(t, weights), s >= THRESHOLD),
                   "doc_id bigint, score double, kept boolean")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns as they are."""
    prepared(docs.sparkSession)
    weights = train(texts(docs))

    def batches(parts):
        for part in parts:
            good = [weights is not None and score(t, weights) >= THRESHOLD for t in part.column("text").to_pylist()]
            yield part.filter(pa.array(good, pa.bool_()))
    return docs.mapInArrow(batches, docs.schema)
