"""Levels, scores and edges of the metrics."""

import pytest
from pyspark.sql import functions as F

from attestor.functions import quality
from attestor.operators import compatibility, metrics


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize("dpmo,expected", [
    (0.0, 6.0), (-1.0, 6.0), (3.0, 6.0), (1e6, 0.0), (2e6, 0.0), (500000.0, 0.5),
    (45500.0, 2.0), (2700.0, 3.0), (340.0, 4.0), (32.0, 5.0)])
def test_sigma(spark, dpmo, expected):
    assert value(spark, quality.sigma(F.lit(dpmo))) == pytest.approx(expected, abs=1e-6)


def test_sigma_is_linear_inside_a_band(spark):
    middle = (1 - (0.9973 + 0.99966) / 2) * 1e6
    assert value(spark, quality.sigma(F.lit(middle))) == pytest.approx(3.5, abs=1e-6)


def test_dpmo_edges(spark):
    assert value(spark, quality.dpmo(F.lit(5), F.lit(0))) == 0
    assert value(spark, quality.dpmo(F.lit(5), F.lit(2))) == 1000000
    assert value(spark, quality.dpmo(F.lit(1), F.lit(4))) == 250000


def test_rate_of_nothing_is_zero(spark):
    assert value(spark, quality.rate(F.lit(0), F.lit(0))) == 0


@pytest.mark.parametrize("sigma,score,grade", [
    (6.0, 0.95, "EXCELLENT"), (6.0, 0.94, "GOOD"), (4.5, 0.99, "ACCEPTABLE"), (3.0, 0.7, "POOR"), (6.0, 0.6, "UNACCEPTABLE")])
def test_grade(spark, sigma, score, grade):
    assert value(spark, quality.grade(F.lit(sigma), F.lit(score))) == grade


def test_a_schema_without_issues_scores_one(spark):
    issues = spark.createDataFrame([(1, "X", "HIGH", "a"), (1, "Y", "LOW", "b")],
                                   "schema_id long, issue_type string, severity string, subject string")
    schemas = spark.createDataFrame([(1,), (2,)], "schema_id long")
    found = {r.schema_id: r.score for r in compatibility.issue_score(issues, schemas).collect()}
    assert found[2] == 1.0 and found[1] == pytest.approx(1 - 4 / 10)
    advice = {r.schema_id: r.advice for r in compatibility.recommendations(issues, schemas).collect()}
    assert set(advice) == {1, 2}


def test_compatibility_with_and_without_changes(spark):
    def score(errors, actual, expected, changes, failures):
        found = metrics.compatibility_of(*[F.lit(x) for x in (errors, actual, expected, changes, failures)])
        return value(spark, found["compatibility"])
    assert score(0, 0, 0, 1, 0) == pytest.approx(1.0)
    assert score(0, 0, 5, 1, 0) == pytest.approx(0.5 + 0.3 * 0.8 + 0.2)
    assert score(0, 0, 5, 0, 0) == pytest.approx(0.7)
    assert score(20, 5, 5, 0, 40) == pytest.approx(0.3)
