"""Near-duplicates under other rules than that of the op8 query, and the stage of the pipeline."""

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from attestor.llm import neardup
from attestor.llm.common import table
from tests.llm.test_operators import SCHEMA, near_case


def brute_roots(texts, words, number, part):
    """(doc_id, n_shingles, n_links, root) by comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(words, len(w))
        sets[i] = frozenset(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) if w else frozenset()
    root, linked = {i: i for i in sets}, {i: set() for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and part * len(sets[a] & sets[b]) >= number * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
            if sets[a] != sets[b]:
                linked[a].add(sets[b])
                linked[b].add(sets[a])
    return sorted((i, len(sets[i]), len(linked[i]), root[i]) for i in sets)


@pytest.mark.parametrize("words, number, part", [(5, 80, 100)])
def test_other_rules_against_brute_force(spark, words, number, part, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)  # many blocks
    texts = near_case(3)
    rows = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), rule=neardup.Rule(words, number, part)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in rows) == brute_roots(texts, words, number, part)


def test_lowest_shingles_cover_a_prefix():
    for rule in (neardup.CONTRACT, corpus_pipeline.NEAR):
        assert all(rule.prefix_length(n) <= rule.lowest(n) <= n for n in range(1, 3000))
    assert all(neardup.CONTRACT.lowest(n) == n // 5 + 1 for n in range(2, 3000))


def test_near_stage_takes_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(1000)]
    edited = list(words)
    for at in np.linspace(10, 985, 21).astype(int):
        edited[at] = f"x{at}"  # 5 words: 891 of 1101 shared; 4 words: 913 of 1081, under 0.85
    rows = [(i, " ".join(w), "en", "src1", None) for i, w in ((1, words), (2, edited), (3, [f"y{i}" for i in range(1000)]))]
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_near_stage_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert kept == {i for i, _, _, root in brute_roots(texts, 5, 80, 100) if i == root}


def test_sets_that_share_one_shingle_by_chance_form_no_cluster(spark):
    rows = [(100 + i, i + d, 90) for i in range(40) for d in (0, 1)]  # a chain: each shares one list with the next
    rows += [(h, i, 90 + i % 2) for h in (1, 2, 3) for i in (201, 202)]  # enough lists
    rows += [(h, i, 90) for h in (4, 5) for i in (211, 212)] + [(h, 211, 90) for h in (4, 4)]  # too few, and equal rows
    rows += [(h, i, n) for h in (6, 7, 8) for i, n in ((221, 50), (222, 90))]  # sizes do not fit
    rows += [(9, 231, -10), (9, 232, -11)]  # an equal subset
    rows += [(10, 300 + i, 90) for i in range(neardup.PAIRED + 1)]  # a long list
    lists = spark.createDataFrame(rows, "h long, id long, n long")
    found = {r.id: r.cluster for r in neardup.clusters(lists).collect()}
    assert found == {201: 201, 202: 201, 231: 231, 232: 231} | {300 + i: 300 for i in range(neardup.PAIRED + 1)}


def test_sets_that_link_meet_in_enough_lists():
    draw = np.random.default_rng(5)
    for rule in (neardup.CONTRACT, corpus_pipeline.NEAR, neardup.Rule(2, 40, 100), neardup.Rule(1, 1, 100)):
        for n in (rule.listed, 30, 200):
            s = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
            heavy = np.sort(draw.choice(s, len(s) // 2, replace=False))
            counts = draw.integers(2, 9, len(heavy))
            for gone in range(len(s)):
                t = np.unique(np.concatenate((s[gone:], draw.integers(0, 1 << 63, gone // 2).astype(np.uint64))))
                common = len(np.intersect1d(s, t))
                if rule.part * common >= rule.number * (len(s) + len(t) - common) and len(t) >= rule.listed:
                    assert len(np.intersect1d(*(neardup.list_keys(x, (heavy, counts), rule) for x in (s, t)))) >= rule.shared
