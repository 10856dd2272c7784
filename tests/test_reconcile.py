"""Losses and their documentation, on small catalogs and against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attestor import fixed
from attestor.operators import reconcile as ops
from attestor.operators import relations, rules

LOSS = "schema_id long, type string, severity string, table_name string, detail string, lost_count long, description string"
WARNING = "schema_id long, source string, message string"


def tables(spark, *names):
    return spark.createDataFrame([(1, n, t, "") for n, t in enumerate(names)],
                                 "schema_id long, table_no long, table_name string, original_statement string")


def constraints(spark, *rows):
    return spark.createDataFrame([(1, t, k) for t, k in rows], "schema_id long, table_name string, constraint_type string")


def relationships(spark, *rows):
    return spark.createDataFrame(
        [(1, n, a, ["x"], b, ["id"], d, u) for n, (a, b, d, u) in enumerate(rows)],
        "schema_id long, rel_no long, source_table string, source_columns array<string>, target_table string, "
        "target_columns array<string>, on_delete string, on_update string")


def columns(spark, *rows):
    return spark.createDataFrame([(1, t, c) for t, c in rows], "schema_id long, table_name string, column_name string")


def test_a_lost_table_is_critical(spark):
    found = ops.missing_tables(tables(spark, "users", "posts"), tables(spark, "users")).collect()
    assert [(r.type, r.severity, r.table_name) for r in found] == [("MISSING_TABLE", "CRITICAL", "posts")]


def test_a_lost_relationship_is_high(spark):
    a = relationships(spark, ("posts", "users", None, None), ("", "users", None, None))
    found = ops.missing_relationships(a, relationships(spark, ("x", "y", None, None))).collect()
    assert [(r.severity, r.table_name, r.detail) for r in found] == [("HIGH", "posts", "users")]


def test_lost_checks_are_counted_in_kept_tables(spark):
    a = constraints(spark, ("users", "c"), ("users", "c"), ("users", "u"), ("gone", "c"), ("users", "x"))
    found = ops.missing_constraints(a, constraints(spark, ("users", "u")), tables(spark, "users")).collect()
    assert [(r.table_name, r.detail, r.lost_count, r.severity) for r in found] == [("users", "check", 2, "HIGH")]


def test_cascades_are_hidden_unless_the_definition_says_so(spark):
    r = relationships(spark, ("a", "b", "CASCADE", "CASCADE"), ("c", "d", "CASCADE", None), ("e", "f", None, "NO ACTION"))
    found = {x.table_name: x.description for x in ops.hidden_cascades(r).collect()}
    assert set(found) == {"a", "c"} and "DELETE/UPDATE" in found["a"]
    told = r.withColumn("definition", F.when(F.col("source_table") == "a", "on delete cascade"))
    assert [x.table_name for x in ops.hidden_cascades(told).collect()] == ["c"]


def test_lost_columns_only_of_kept_tables(spark):
    a = columns(spark, ("users", "id"), ("users", "email"), ("gone", "id"))
    found = ops.missing_columns(a, columns(spark, ("users", "id")), tables(spark, "users")).collect()
    assert [(r.table_name, r.detail) for r in found] == [("users", "email")]


def test_a_warning_documents_a_loss(spark):
    losses = spark.createDataFrame([
        (1, "MISSING_TABLE", "CRITICAL", "posts", "", 1, ""),
        (2, "MISSING_TABLE", "CRITICAL", "posts", "", 1, ""),
        (1, "MISSING_CONSTRAINT", "MEDIUM", "users", "foreign_key", 1, ""),
        (1, "MISSING_CONSTRAINT", "HIGH", "users", "check", 1, ""),
        (1, "MISSING_COLUMN", "HIGH", "users", "mail", 1, ""),
        (1, "INVISIBLE_CASCADE", "MEDIUM", "posts", "users", 1, "")], LOSS)
    warnings = spark.createDataFrame([
        (1, "t", "Table posts was dropped"), (1, "c", "Dropped check on users"), (1, "c", "users lost e-mail"),
        (1, "x", None)], WARNING)
    silent = {(r.schema_id, r.type, r.detail) for r in ops.silent_only(losses, warnings).collect()}
    assert silent == {(2, "MISSING_TABLE", ""), (1, "MISSING_CONSTRAINT", "foreign_key"), (1, "INVISIBLE_CASCADE", "users")}


@pytest.mark.parametrize("whole_word", [False, True])
def test_finding_names_agrees_with_brute_force(spark, whole_word):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abé_1") for _ in range(draw.choice([0, 1, 1, 2, 3, 4, 5, 9])))
    losses, warnings = [], []
    for n in range(250):
        schema = 1 if draw.random() < 0.5 else draw.randrange(2, 5)
        kind = draw.choice(["MISSING_TABLE", "MISSING_RELATIONSHIP", "MISSING_CONSTRAINT", "MISSING_COLUMN", "INVISIBLE_CASCADE"])
        detail = ("" if kind == "MISSING_TABLE" else draw.choice(list(fixed.CONSTRAINT_KINDS.values()))
                  if kind == "MISSING_CONSTRAINT" else word())
        losses.append((schema, kind, "HIGH", word(), detail, 1, str(n)))
    for _ in range(40):
        parts = [word(), draw.choice(["check", "Unique", "FOREIGN_KEY", word()]), word()]
        warnings.append((1 if draw.random() < 0.6 else draw.randrange(2, 5), "w", " ".join(parts)))

    def stands(name, m):
        if not whole_word:
            return name in m
        return name != "" and re.search(rf"(?<!\w){re.escape(name)}(?!\w)", m) is not None

    def documented(loss):
        schema, kind, _, table, detail, _, _ = loss
        return kind != "INVISIBLE_CASCADE" and any(
            s == schema and stands(table, m)
            and (detail.upper() in m.upper() if kind == "MISSING_CONSTRAINT" else detail == "" or stands(detail, m))
            for s, _, m in warnings)

    marked = ops.mark_documented(spark.createDataFrame(losses, LOSS), spark.createDataFrame(warnings, WARNING), whole_word)
    found = {r.description: r.is_documented for r in marked.collect()}
    assert found == {loss[-1]: documented(loss) for loss in losses}


def test_a_name_of_digits_is_not_found_inside_another(spark):
    losses = spark.createDataFrame([(1, "MISSING_TABLE", "CRITICAL", "t_1", "", 1, "")], LOSS)
    warnings = spark.createDataFrame([(1, "t", "Table t_10 was dropped")] + [(1, "t", f"note {n}") for n in range(500)], WARNING)
    assert ops.mark_documented(losses, warnings).first().is_documented
    assert not ops.mark_documented(losses, warnings, whole_word=True).first().is_documented


def test_many_names_with_one_beginning_meet_only_the_messages_that_hold_them(spark):
    n = 20_000
    losses = spark.range(n).selectExpr(
        "1L AS schema_id", "'MISSING_TABLE' AS type", "'CRITICAL' AS severity", "'order_audit_log_entry_' || lpad(id, 6, '0') AS table_name",
        "'' AS detail", "1L AS lost_count", "'' AS description")
    warnings = losses.selectExpr("schema_id", "'w' AS source", "'Table ' || table_name || ' was dropped' AS message").filter("message LIKE '%7 was%'")
    messages = warnings.select("schema_id", "message", F.md5("message").alias("message_id"))
    # every message holds one name and nothing else is paired with it, though all names share a beginning
    assert ops.mentions(messages, losses.selectExpr("schema_id", "table_name AS name")).count() == n // 10
    marked = ops.mark_documented(losses, warnings).groupBy("is_documented").count().collect()
    assert {r.is_documented: r["count"] for r in marked} == {True: n // 10, False: n - n // 10}


def test_a_null_that_changes_places_is_a_change(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "x", None)], "k long, v string, w string")
    b = spark.createDataFrame([(1, "x", None), (2, "x", None)], "k long, v string, w string")
    assert [(r.k, r.status) for r in ops.reconcile_rows(a, b, ["k"]).collect()] == [(1, "changed")]


def test_relationships_with_null_ends_are_skipped_not_lost(spark):
    known = spark.createDataFrame([(1, "a"), (1, "b")], "schema_id long, table_name string")
    columns = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "schema_id long, table_name string, column_name string")
    rows = [(1, "a", ["x"], "b", ["y"]), (1, "a", ["x"], None, ["y"]), (1, "a", None, "b", ["y"]), (1, "a", ["x"], "b", [None]), (1, "a", [""], "b", ["y"])]
    df = spark.createDataFrame(rows, "schema_id long, source_table string, source_columns array<string>, target_table string, target_columns array<string>")
    found = sorted(str(r.skip_type) for r in relations.validate_relationships(df, known, columns).collect())
    assert found == ["MISSING_SOURCE_COLUMNS", "MISSING_SOURCE_COLUMNS", "MISSING_TARGET_COLUMNS", "MISSING_TARGET_TABLE", "None"]


def test_rows_lost_added_and_changed(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (4, None)], "k long, v string")
    b = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (5, "e"), (4, None)], "k long, v string")
    found = {r.k: r.status for r in ops.reconcile_rows(a, b, ["k"]).collect()}
    assert found == {2: "changed", 3: "changed", 5: "added"}


def test_equal_ranges_are_not_compared_row_by_row(spark):
    a = spark.range(100_000).selectExpr("id AS k", "id % 7 AS v", "IF(id % 3 = 0, NULL, 'x') AS w")
    b = (a.filter("k <> 500").withColumn("v", F.when(F.col("k") == 77, None).otherwise(F.col("v")))
         .unionByName(spark.createDataFrame([(-5, 1, None), (9, 2, "x")], "k long, v long, w string")))
    found = {r.k: (r.status, r.n_before, r.n_after) for r in ops.reconcile_ranges(a, b, ["k"]).collect()}
    assert found == {500: ("lost", 1, 0), 77: ("changed", 1, 1), -5: ("added", 0, 1), 9: ("changed", 1, 2)}
    left, right = ops.differing(a, b, ["k"])
    assert left.count() < 4 * 200 and right.count() < 4 * 200
    assert ops.reconcile_ranges(a, a, ["k"]).count() == 0 and ops.reconcile_ranges(a.limit(0), a.limit(0), ["k"]).count() == 0


def test_rows_reached_through_references_of_any_depth(spark):
    edges = [(i, i + 1) for i in range(30)] + [(30, 5), (100, 101), (None, 3), (7, None), (2, 2)]
    seed = spark.createDataFrame([(3,), (3,), (None,)], "k long")
    found = rules.cascade_closure(seed, spark.createDataFrame(edges, "parent long, child long"))
    assert {r.key: r.level for r in found.collect()} == {k: k - 3 for k in range(3, 31)}
    assert rules.cascade_closure(seed.limit(0), spark.createDataFrame(edges, "parent long, child long")).collect() == []
