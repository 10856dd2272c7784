"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry
from attestor.operators import mentions
from attestor import session
from attestor.plans import fixtures
from attestor.sources import catalog

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "cat_stats", "typ_log", "con_apply", "fea_decision", "val_fk", "val_overlap", "rec_all", "rec_documented",
    "met_all", "rel_report", "cmp_advice", "txt_linemap", "txt_lint_top", "ext_addcol", "rnd_rel", "rep_examples"])
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    for unwanted in ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"]:
        assert unwanted not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "val_enum")
    assert "ReadSchema: struct<event_type:string>" in text
    assert "PushedFilters: [IsNotNull(event_type)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan(spark, "val_key")


def test_counts_of_many_sets_take_one_grouping(spark):
    # every record set is counted before the only shuffle of the counts
    text = plan(spark, "cat_stats")
    assert text.count("hashpartitioning(schema_id") <= 4
    assert "Join" not in text


@pytest.mark.parametrize("name", ["rep_examples", "rep_failures", "fea_decision", "txt_lint_top", "ext_first"])
def test_first_rows_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name, scans, exchanges", [("rec_all", 12, 12), ("met_all", 60, 40)])
def test_shared_parts_are_computed_once(spark, name, scans, exchanges):
    text = plan(spark, name)
    assert text.count("FileScan") <= scans and text.count("Exchange") <= exchanges


@pytest.mark.parametrize("name", ["con_apply", "rec_columns"])
def test_joins_of_stored_catalogs_need_no_shuffle(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_only_record_sets_that_are_asked_for_are_made(spark, monkeypatch):
    catalog.store_catalog(catalog.LazyCatalog(None, tables=spark.range(1)))  # the other record sets are missing
    made = []
    inputs = fixtures.Inputs(spark, FOLDER)
    table = inputs.table
    monkeypatch.setattr(inputs, "table", lambda name: made.append(name) or table(name))
    stored = catalog.store_catalog(inputs.views(), buckets=2)
    assert stored.enums.columns == ["schema_id", "enum_name", "values"] and "f_relationships" not in made
    before = len(session._scratch)
    entry.queries()["cat_names"](spark, FOLDER), entry.queries()["cat_stats"](spark, FOLDER)
    assert not [path for path in session._scratch[before:] if "catalog-" in path]


def test_numbers_of_columns_meet_their_orders_in_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "WRITTEN", [])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = fixtures.Inputs(spark, FOLDER).table("f_columns")
        text = columns._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange hashpartitioning") == 2  # one of the lines, one of the orders
    assert not [line for line in text.split("\n") if "Exchange" in line and "name" in line]  # names follow from numbers


def test_every_order_keeps_its_columns(spark, tmp_path):
    spark.createDataFrame([(1, 7), (1, 7), (2, None), (None, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 5), (1, 1, 4), (1, None, 6), (2, 3, None), (None, 1, 1), (9, 1, 1)],
                          "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    inputs = fixtures.Inputs(spark, str(tmp_path))
    found = inputs.table("f_columns").select("schema_id", "table_no", "table_name", "ordinal", "p").collect()
    one = [(7, 1, "t_1", 1, 4), (7, 1, "t_1", None, 6)]
    assert sorted(map(tuple, found), key=repr) == sorted([*one, *one, (None, 2, "t_2", 3, None)], key=repr)
    assert sorted(map(tuple, inputs.catalog().columns.select("table_no", "p").collect()), key=repr) == [(1, 4), (1, 4), (1, 6), (1, 6), (2, None)]


def test_buckets_grow_with_the_rows():
    assert [catalog.buckets_for(n) for n in (0, 4_000_000, 4_000_001, 36_000_000, 216_000_000)] == [16, 16, 32, 256, 1024]


def test_both_catalogs_are_views_on_the_same_stored_numbers(spark, tmp_path):
    session.clear_scratch(spark)  # nothing is stored yet
    before = len(session._scratch)
    inputs = fixtures.Inputs(spark, FOLDER)
    for copy in (False, True):
        for name in ("tables", "columns", "constraints", "relationships", "indexes", "enums", "warnings"):
            getattr(inputs.catalog(copy), name)
    made = sorted(path.split("/")[-1].rsplit("-", 1)[0] for path in session._scratch[before:] if "catalog-" in path)
    assert made == ["catalog-n_columns", "catalog-n_tables", "catalog-n_tables_before"]


def test_shares_of_line_items_follow_from_their_rows(spark, tmp_path, monkeypatch):
    """What meets in one task is bounded in rows, as narrow numbers compress to little and would be sorted on disk."""
    spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 1, 5), (1, 1, 4), (2, 1, 6), (None, 1, 1), (3, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(fixtures, "buckets_for", lambda rows: rows * 6)
    columns = fixtures.Inputs(spark, str(tmp_path))._make("n_columns")
    plan = columns._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(table_no#\d+L, (\d+)\)", plan) == ["15", "15"] and plan.count("Exchange") == 2
    assert sorted(map(tuple, columns.collect())) == [(7, 1, 1, 4), (7, 2, 1, 6), (8, 2, 1, 6)]


def test_patterns_meet_each_statement_once(spark):
    statements = spark.createDataFrame([(1, 0, "ALTER TABLE t ADD CONSTRAINT k UNIQUE (a)")], "script_id long, pos int, statement string")

    def tried(df, column):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return len(re.findall(rf"regexp_extract\({column}#|\b{column}#\d+ RLIKE|RLIKE\({column}#", plan))

    assert tried(mentions.added_constraints(statements), "statement") == 1
    assert tried(mentions.added_constraints(statements), "clause") == 1
    assert tried(mentions.extract_tables(statements), "statement") == 1


def test_kinds_begin_in_any_case_and_with_any_white_space(spark):
    texts = ["create\n\tunique  INDEX i ON t (a)", "Alter\x0bTable t add constraint k check (a > 0)", "CREATE TABLES (a int)",
             "CREATE\r\ntable if not exists \"T x\" (a int)", "CREATE INDEXES i ON t (a)", None, "", "ALTER"]
    statements = spark.createDataFrame(list(enumerate(texts)), "pos int, statement string").selectExpr("1L AS script_id", "pos", "statement")
    assert [(r.pos, r.is_unique) for r in mentions.extract_indexes(statements).collect()] == [(0, True)]
    assert [(r.pos, r.constraint_name, r.constraint_type) for r in mentions.added_constraints(statements).collect()] == [(1, "k", "c")]
    assert [(r.pos, r.table_name) for r in mentions.extract_tables(statements).collect()] == [(3, "T x")]


def test_statements_are_read_in_small_shares(spark):
    default = "134217728b"
    spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    fixtures.Inputs(spark, FOLDER)
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) == fixtures.BYTES_PER_TASK
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    fixtures.Inputs(spark, FOLDER)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1m"
    spark.conf.set("spark.sql.files.maxPartitionBytes", default)


def test_tables_are_drawn_without_relationships(spark):
    before = len(session._scratch)
    entry.queries()["rnd_table"](spark, FOLDER)
    made = {path.split("/")[-1].rsplit("-", 1)[0] for path in session._scratch[before:]}
    assert {"drawn-tables", "drawn-columns", "drawn-indexes"} <= made and not made & {"validated", "drawn-relationships"}


def test_scratch_tables_are_written_small(spark):
    session.written(spark.range(3), "small")
    files = spark.read.format("binaryFile").load(session._scratch[-1]).select("path").collect()
    assert files and all(".zstd.parquet" in f.path for f in files)
