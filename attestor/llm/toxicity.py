"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Features are words and the beginnings of words; those that lean to toxic examples make up the
vector space, so a text is a handful of weights. The examples lie in an inverted index cut into
blocks of neighbours, with the largest weight of each feature in each block. A search visits
blocks in falling order of the best cosine that they could hold and ends when no block can beat
the k-th best found: the result is that of comparing all examples. Votes of the neighbours,
weighted by cosine, are mapped to rates by a monotone fit on the examples themselves, each
scored without its own vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import mapped, prepared, stored

EXAMPLES = {1: 4000, 0: 8000}  # at most so many labelled rows of each class are indexed
VOCABULARY = 4096  # at most so many features
PREFIXES = (4, 5, 6, 7)
LEAST_COUNT, LEAST_LIFT, LEAST_Z = 3, 4.0, 3.0
NEIGHBOURS, BLOCK = 25, 64
THRESHOLD = 0.3

_WORDS = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def word_counts(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels one may learn from: crc32 of the id as text mod 4 is not 2."""
    return (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(CAST(doc_id AS string)) % 4 <> 2")
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def sampled(rows: DataFrame, sizes: dict[int, int] = EXAMPLES) -> DataFrame:
    """At most so many rows of each class, in hash order of their ids."""
    parts = [rows.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in sizes.items()]
    return parts[0].unionByName(parts[1])


def vocabulary(examples: DataFrame, counts: dict[int, int], most: int = VOCABULARY) -> list[str]:
    """The features of (doc_id, toxic, text) rows that occur in toxic ones far more often than by chance."""
    def work(rows):
        for _, toxic, text in rows:
            for f in {f for w in word_counts(text) for f in word_features(w)}:
                yield f, int(toxic == 1), int(toxic != 1)
    per_feature = (mapped(examples.select("doc_id", "toxic", "text"), work, "f string, pos bigint, neg bigint")
                   .groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") >= LEAST_COUNT))
    lift = F.log(((F.col("pos") + 0.5) / (counts.get(1, 0) + 1)) / ((F.col("neg") + 0.5) / (counts.get(0, 0) + 1)))
    z = lift / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    chosen = (per_feature.withColumn("z", z).filter((lift >= math.log(LEAST_LIFT)) & (F.col("z") >= LEAST_Z))
              .orderBy(F.desc("z"), "f").limit(most))
    return [r["f"] for r in chosen.collect()]  # bounded by the parameter


def vectors(docs: DataFrame, features: list[str]) -> DataFrame:
    """(doc_id, v): the counts of the known features in whole texts, as (feature number, count)."""
    sent = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(features)})  # bounded by VOCABULARY

    def work(rows):
        known, cache = sent.value, {}
        for doc_id, text in rows:
            found: Counter = Counter()
            for w, n in word_counts(text).items():
                ids = cache.get(w)
                if ids is None:
                    if len(cache) > 200_000:
                        cache.clear()
                    ids = cache[w] = tuple(known[f] for f in word_features(w) if f in known)
                for i in ids:
                    found[i] += n
            yield doc_id, sorted(found.items())
    return mapped(docs.select("doc_id", "text"), work, "doc_id bigint, v array<struct<f: int, n: bigint>>")


def weighed(v, idf: np.ndarray) -> dict[int, float]:
    """The TF-IDF vector of length 1; (1 + log n) times idf."""
    raw = {f: (1 + math.log(n)) * float(idf[f]) for f, n in v}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {f: x / norm for f, x in raw.items()} if norm else {}


class BlockMaxIndex:
    """Examples (id, label, vector) in blocks of similar ones."""

    def __init__(self, examples: list[tuple[int, int, dict[int, float]]]):
        examples = sorted((e for e in examples if e[2]), key=lambda e: (sorted(e[2], key=lambda f: (-e[2][f], f)), e[0]))
        self.ids = [e[0] for e in examples]
        self.labels = [e[1] for e in examples]
        self.blocks = -(-len(examples) // BLOCK)
        by_feature: dict[int, list[tuple[int, float]]] = {}
        for at, (_, _, v) in enumerate(examples):
            for f, x in v.items():
                by_feature.setdefault(f, []).append((at, x))
        self.lists = {}
        for f, postings in by_feature.items():
            at = np.array([p for p, _ in postings])
            x = np.array([w for _, w in postings])
            blocks, start = np.unique(at // BLOCK, return_index=True)
            ends = {int(b): (int(i), int(j)) for b, i, j in zip(blocks, start, [*start[1:], len(at)])}
            self.lists[f] = (at, x, blocks, np.maximum.reduceat(x, start), ends)

    def search(self, query: dict[int, float], k: int, skip: int | None = None) -> list[tuple[float, int]]:
        """The k nearest as (cosine, position), best first; examples that share nothing do not count."""
        bound = np.zeros(self.blocks)
        lists = [(w, *self.lists[f]) for f, w in query.items() if f in self.lists]
        for w, _, _, blocks, most, _ in lists:
            bound[blocks] += w * most
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            b = int(b)
            if bound[b] <= 0 or len(best) == k and bound[b] <= best[-1][0]:
                break
            score = np.zeros(BLOCK)
            for w, at, x, _, _, ends in lists:
                if b in ends:
                    i, j = ends[b]
                    score[at[i:j] - b * BLOCK] += w * x[i:j]
            found = [(float(score[i]), b * BLOCK + int(i)) for i in np.flatnonzero(score)]
            best = sorted(best + [p for p in found if self.ids[p[1]] != skip], key=lambda p: (-p[0], p[1]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]], weights: dict[int, float]) -> float:
        """The share of toxic among the neighbours, by cosine squared and class weight."""
        total = [c * c * weights[self.labels[p]] for c, p in near]
        return sum(t for t, (_, p) in zip(total, near) if self.labels[p] == 1) / sum(total)


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """The non-decreasing steps that fit weighted y best, as knots to interpolate between."""
    steps: list[list[float]] = []  # x sum, y sum, weight
    for i in np.argsort(x, kind="stable"):
        steps.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last)]
    return [s[0] / s[2] for s in steps], [s[1] / s[2] for s in steps]


def scored(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] = EXAMPLES) -> DataFrame:
    """(doc_id, score, evidence): evidence is the three nearest examples as (doc_id, label, cosine).

    A document is never its own neighbour. Texts with no known feature, empty and null ones
    among them, get the rate of toxic examples that have none either. Without any labelled row
    of each class every score is the rate of toxic labels, or 0. Repeated rows get equal scores;
    other columns are ignored.
    """
    prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = stored(training_rows(labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic")), "toxic-labels")
    totals = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = stored(sampled(known, sizes), "toxic-chosen")
    examples = docs.join(F.broadcast(chosen), "doc_id")  # bounded by EXAMPLES
    features = vocabulary(examples, {c: min(totals.get(c, 0), n) for c, n in sizes.items()})
    every = stored(vectors(docs, features), "toxic-vectors")
    n_docs = every.count()
    df = {r["f"]: r["count"] for r in every.select(F.explode("v.f").alias("f")).groupBy("f").count().collect()}  # bounded by VOCABULARY
    idf = np.array([math.log((n_docs + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(features))])
    rows = every.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # bounded by EXAMPLES
    taken = Counter(int(r["toxic"]) for r in rows)
    weights = {c: totals.get(c, 0) / taken[c] if taken[c] else 0.0 for c in sizes}
    index = BlockMaxIndex([(r["doc_id"], int(r["toxic"]), weighed(r["v"], idf)) for r in rows])

    def rate(group: list) -> float:
        mass = [weights[int(r["toxic"])] for r in group]
        return sum(m for m, r in zip(mass, group) if r["toxic"] == 1) / sum(mass) if sum(mass) else 0.0
    plain = rate([r for r in rows if not r["v"]] or rows)
    votes = [(index.vote(near, weights), float(r["toxic"]), weights[int(r["toxic"])]) for r in rows if r["v"]
             and (near := index.search(weighed(r["v"], idf), NEIGHBOURS, r["doc_id"]))]
    knots = monotone(*map(np.array, zip(*votes))) if votes else ([0.0, 1.0], [0.0, 1.0])
    sent = docs.sparkSession.sparkContext.broadcast((index, idf, weights, knots, plain))  # bounded by EXAMPLES x VOCABULARY

    def work(rows):
        index, idf, weights, knots, plain = sent.value
        for doc_id, v in rows:
            near = index.search(weighed([(x["f"], x["n"]) for x in v], idf), NEIGHBOURS, doc_id) if v else []
            score = float(np.interp(index.vote(near, weights), *knots)) if near else plain
            yield doc_id, min(1.0, max(0.0, score)), [(index.ids[p], index.labels[p], c) for c, p in near[:3]]
    return mapped(every, work, "doc_id bigint, score double, evidence array<struct<doc_id: bigint, label: int, cosine: double>>")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The score of every document, whether its label was held out, and the verdict."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored(docs, labels).select("doc_id", held_out.alias("held_out"), "score",
                                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
