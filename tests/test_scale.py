"""The blocked building blocks give what a plain window gives, also across blocks and with hot keys."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor import scale
from attestor.operators import rules


def rows(spark, n=400):
    draw = random.Random(7)
    orders = draw.sample(range(-50, 3000), n)
    # one key holds two thirds of the rows
    data = [(1 if draw.random() < 0.66 else draw.randrange(2, 9), o, f"v{o}") for o in orders]
    return spark.createDataFrame(data, "k long, o long, v string")


def test_numbered_equals_a_plain_window(spark):
    df = rows(spark)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
    blocked = scale.numbered(df, ["k"], "o", "n", width=17)
    assert sorted(plain.collect()) == sorted(blocked.select(plain.columns).collect())


def test_previous_equals_a_plain_lag(spark):
    df = rows(spark)
    plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    blocked = scale.previous(df, ["k"], "o", "v", "p", width=17)
    key = lambda r: (r.k, r.o)
    assert sorted(plain.collect(), key=key) == sorted(blocked.select(plain.columns).collect(), key=key)


def test_a_null_before_is_not_taken_from_the_block_before(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 10, None), (1, 11, "b"), (1, 20, "c")], "k long, o long, v string")
    found = {r.o: r.p for r in scale.previous(df, ["k"], "o", "v", "p", width=10).collect()}
    assert found == {1: None, 10: "a", 11: None, 20: "b"}


def test_running_sum_equals_a_plain_window(spark):
    df = rows(spark).withColumn("n", F.length("v"))
    before = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("s", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocked = scale.running_sum(df, ["k"], "o", "n", "s", width=17)
    assert sorted(plain.collect()) == sorted(blocked.select(plain.columns).collect())


def test_first_rows_limits_before_the_shuffle(spark):
    top = scale.first_rows(rows(spark), ["k"], ["o"], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert {r["count"] for r in top.groupBy("k").count().collect()} == {3}


def test_first_rows_and_total(spark):
    top = scale.first_rows_and_total(rows(spark), ["k"], ["o"], 3)
    totals = {r.k: r["count"] for r in rows(spark).groupBy("k").count().collect()}
    for r in top.collect():
        assert r.n_total == totals[r.k] and r.n_more == max(totals[r.k] - 3, 0)


def test_assemble_keeps_order(spark):
    df = spark.createDataFrame([(2, 2, "b"), (2, 1, "a")], "k long, o long, t string")
    found = scale.assemble(df, ["k"], ["o"], "t", "\n").first()
    assert (found.t, found.n_pieces, found.n_bytes) == ("a\nb", 2, 3)


def test_parts_leave_nothing_out(spark):
    df = rows(spark)
    for per_part in (1, 7, 1000):
        found = scale.parts(df, ["k"], "o", "v", "\n", per_part).orderBy("k", "part_no").collect()
        assert all(r.n_pieces <= per_part for r in found)
        for k in {r.k for r in found}:
            whole = "\n".join(r.v for r in found if r.k == k)
            assert whole == "\n".join(r.v for r in df.filter(F.col("k") == k).orderBy("o").collect())


def test_tally_counts_parts_with_different_columns(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    b = spark.createDataFrame([(3, 5)], "k long, x long")
    found = {r.k: (r.a, r.b) for r in scale.tally(["k"], (a, {"a": scale.one()}), (b, {"b": F.col("x")})).collect()}
    assert found == {1: (2, 0), 2: (1, 0), 3: (0, 5)}


def test_overlaps_equals_comparing_all_pairs(spark):
    draw = random.Random(3)
    data = [(n, 1 if n % 3 else 2, draw.randrange(0, 40000), draw.randrange(1, 900)) for n in range(300)]
    df = spark.createDataFrame(data, "id long, k long, s long, d long").select(
        "id", "k", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds(F.col("s") + F.col("d")).alias("end"))
    brute = {i for i, k, s, d in data if any(k2 == k and (s2, i2) < (s, i) and s2 + d2 > s for i2, k2, s2, d2 in data)}
    for block in ["MINUTE", "HOUR", "YEAR"]:
        found = rules.overlaps(df, "k", "start", "end", "id", block)
        assert {r.id for r in found.collect()} == brute


def test_checks_on_empty_input(spark):
    empty = spark.createDataFrame([], "k long, v long")
    assert rules.null_counts(empty, ["v"]).collect()[0].n_nulls == 0
    assert rules.duplicate_keys(empty, ["k"]).count() == 0
    assert rules.check_rules(empty, {"r": F.col("v") > 0}).collect()[0].n_violations == 0
    assert rules.measured_cardinality(empty, empty, ("k", "k")).collect()[0].most_children == 0


def test_null_keys_and_null_rules_are_met(spark):
    child = spark.createDataFrame([(1,), (None,), (9,)], "p long")
    parent = spark.createDataFrame([(1,)], "id long")
    assert [r.p for r in rules.orphans(child, parent, {"p": "id"}).collect()] == [9]
    assert rules.check_rules(child, {"r": F.col("p") < 5}).collect()[0].n_violations == 1
    assert [r.broken for r in rules.violations(child, {"r": F.col("p") < 5}).collect()] == [["r"]]
