"""The registered queries against DuckDB, and the pipeline stage by stage against brute force."""

import duckdb
import pytest

import attestor.llm.queries  # noqa: F401  registers the queries
import corpus_pipeline
from attestor.llm.common import table
from attestor.llm.registry import ORACLE, QUERIES
from tests.llm.test_operators import brute_components, found_by_hand, kept_lines

FOLDER = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert ordered(tuple(r[n] for n in names) for r in df.collect()) == ordered(result.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality"](spark, docs, FOLDER)
    kept = {r.doc_id: r for r in good.collect()}
    assert good.columns == docs.columns and all(kept[r.doc_id] == r for r in docs.collect() if r.doc_id in kept)
    assert sum(q == 1 and d not in kept for d, q in labels.items()) <= 1
    assert sum(q == 0 and d in kept for d, q in labels.items()) <= 2

    lines = steps["lines"](spark, good, FOLDER)
    assert lines.columns == docs.columns
    by_hand = {i: dropped for i, _, dropped, _ in kept_lines([(r.doc_id, r.text) for r in kept.values()])}
    after = {r.doc_id: r for r in lines.collect()}
    assert after.keys() == kept.keys() and all(r.n_chars == len(r.text) for r in after.values())
    assert all((kept[i].text != after[i].text) == (by_hand[i] > 0) for i in kept)

    near = steps["near_duplicates"](spark, lines, FOLDER)
    left = {r.doc_id: r for r in near.collect()}
    assert near.columns == docs.columns
    assert set(left) == {i for i, _, _, root in brute_components([(i, r.text) for i, r in after.items()]) if i == root}

    clean = steps["decontamination"](spark, near, FOLDER)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, r in left.items() if not found_by_hand(r.text, items)[-1]}

    mixed = steps["mixing"](spark, clean, FOLDER).collect()
    assert mixed and {r.doc_id for r in mixed} <= set(left)
    assert sum(r.tokens for r in mixed) <= sum(len(r.text.split()) for r in left.values())
    assert len(corpus_pipeline.run(spark, FOLDER).collect()) == len(mixed)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        table(spark, FOLDER, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
