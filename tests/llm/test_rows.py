"""Rows without keys, repeated rows, clashing names, and models against plain computations."""

import itertools
import math

import numpy as np

import corpus_pipeline
from attestor.llm import components, decontaminate, linededup, pii, quality, rules
from tests.llm.test_operators import SCHEMA, documents

NEAR = " ".join(f"w{i}" for i in range(60))


def test_numbers_of_any_length_in_an_address():
    long = "1.2.3." + "0" * 5000 + "1"
    assert ("ip", 0, len(long)) in pii.spans(long)
    assert all(k != "ip" for k, _, _ in pii.spans("1.2.3." + "9" * 5000))


def test_lines_of_a_table_with_clashing_names(spark):
    df = documents(spark, ["a line of some words\nx", "a line of some words\ny"]).selectExpr(
        "*", "1 AS _d", "2 AS _lost", "3 AS _counts", "4 AS d", "5 AS h1", "6 AS N_LINES")
    rows = {r.doc_id: r for r in linededup.deduplicate_rows(df.drop("N_LINES")).collect()}
    assert rows[1].text == "y" and (rows[1]["_d"], rows[1]["_lost"], rows[1]["_counts"]) == (1, 2, 3)


def test_near_stage_keeps_one_row_of_each_group(spark):
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, NEAR, "en", "s", 1), (1, NEAR, "en", "s", 1), (1, other, "en", "s", 2), (2, NEAR + " end", "en", "s", 3), (None, NEAR, "en", "s", 4),
            (None, "alone without any key at all here", "en", "s", 5), (None, "alone without any key at all here", "en", "s", 5), (3, None, "en", "s", 0), (4, "", None, None, None)]
    found = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted({rows[0], rows[2], rows[5], rows[7], rows[8]}, key=repr)


def test_contaminated_rows_go_by_their_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(1, item, "en", "s", 1), (1, "a clean text under the same key", "en", "s", 1), (None, item, "en", "s", 1), (None, "clean", "en", "s", 1), (2, None, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS same", "2 AS same_text", "3 AS gone_id")
    assert sorted((r.text for r in decontaminate.clean(df, bench).collect()), key=repr) == sorted(["a clean text under the same key", "clean", None], key=repr)


def test_blocks_of_a_large_benchmark_give_the_same(spark):
    docs = documents(spark, [" ".join(f"q{i}" for i in range(k, k + 30)) for k in range(0, 200, 10)] + [None, ""])
    bench = spark.createDataFrame([(k, " ".join(f"q{i}" for i in range(k, k + 15))) for k in range(0, 150, 7)], "item_id bigint, text string")
    whole = sorted(map(repr, decontaminate.search_all(docs, bench).collect()))
    assert sorted(map(repr, decontaminate.search_all(docs, bench, block_bytes=200).collect())) == whole


def test_expectation_maximisation_against_all_patterns():
    """The posteriors from counts of patterns equal those of EM over every single document."""
    rng = np.random.default_rng(4)
    patterns = [sum(v * 3 ** i for i, v in enumerate((*p, *(0,) * (len(quality.LABELLERS) - 3)))) for p in itertools.product(range(3), repeat=3)]
    counts = {p: int(rng.integers(1, 40)) for p in patterns}
    found, tables, share = quality.accuracies(counts, rounds=7)
    docs = [[p // 3 ** i % 3 for i in range(len(quality.LABELLERS))] for p, n in counts.items() for _ in range(n)]
    names = [p for p, n in counts.items() for _ in range(n)]
    t = [[[0.4, 0.1, 0.5], [0.4, 0.55, 0.05]] for _ in quality.LABELLERS]
    pi, post = 0.8, []
    for _ in range(7):
        post = []
        for d in docs:
            bad, good = math.log(1 - pi), math.log(pi)
            for i, v in enumerate(d):
                bad, good = bad + math.log(t[i][0][v]), good + math.log(t[i][1][v])
            post.append(1 / (1 + math.exp(bad - good)))
        pi = min(0.99, max(0.01, sum(post) / len(post)))
        for i in range(len(quality.LABELLERS)):
            for c in (0, 1):
                mass = [1.0, 1.0, 1.0]
                for d, g in zip(docs, post):
                    mass[d[i]] += g if c else 1 - g
                t[i][c] = [m / sum(mass) for m in mass]
    assert abs(share - pi) < 1e-9 and np.abs(np.array(t) - tables).max() < 1e-9
    assert all(abs(found[p] - g) < 1e-9 for p, g in zip(names, post))


def test_training_does_not_depend_on_the_order_of_repeated_keys(spark):
    texts = [(i % 40, f"{'good plain words of a text ' * (i % 7 + 1)} {i} {'#$% ' * (i % 5 * 9)}", "en", "s", 1) for i in range(160)]
    a, b = (quality.train(spark.createDataFrame(t, SCHEMA).select("doc_id", "text"), 64) for t in (texts, texts[::-1]))
    assert np.array_equal(a, b)


def test_cascade_of_texts_is_what_the_query_reports(spark):
    texts = ["word " * 60, "a few", "# $ % " * 40 + "many other words here that differ each from all " * 2, " ".join(f"w{i}" for i in range(80)),
             "\n".join(["same line"] * 40), None, "x" * 4000 + " y" * 60]
    df = documents(spark, texts)
    kept = {r.doc_id for r in rules.digest(df).collect() if r.kept}
    assert kept == {r.doc_id for r in rules.filtered(df).collect()}
    assert kept == {r.doc_id for r in rules.digest(df, sample_rows=1).collect() if r.kept}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2000, 2001), (2001, 2000)]
    found = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}
