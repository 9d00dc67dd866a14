from decimal import Decimal

import pytest

from codestrata.operators import rollups, severity

SCHEMA = "rule_id string, category string, severity string, file string, line int, message string, file1 string, file2 string, lines1 string, lines2 string, findings decimal(38,0)"


@pytest.fixture(scope="module")
def issues(spark):
    def build(rows):
        return spark.createDataFrame([(f"R{i:03d}", c, s, f, 1, m, None, None, None, None, Decimal(1)) for i, (c, s, f, m) in enumerate(rows)], SCHEMA)

    return build


# category, path, message -> impact, likelihood, score, priority
SCORES = [
    ("security", "m.py", "Use of eval() detected", (4, 3, 0.92, "P0 - Critical")),
    ("security", "m.py", "Hardcoded password detected", (3, 3, 0.75, "P1 - High")),
    ("security", "t/test_m.py", "Hardcoded password detected", (3, 1, 0.60, "P1 - High")),
    ("security", "config.py", "Potential SQL injection vulnerability", (4, 4, 1.0, "P0 - Critical")),
    ("security", "main.py", "weak thing", (2, 3, 0.57, "P2 - Medium")),
    ("security", "t/test.py", "weak thing", (2, 1, 0.42, "P2 - Medium")),
    ("style", "m.py", "Line too long (130 characters)", (1, 1, 0.25, "P3 - Low")),
    ("documentation", "m.py", "x", (1, 2, 0.32, "P3 - Low")),
    ("documentation", "app.py", "x", (1, 3, 0.40, "P2 - Medium")),
    ("style", "env.py", "x", (1, 4, 0.47, "P2 - Medium")),
    ("performance", "m.py", "Potential memory leak: x", (3, 2, 0.67, "P1 - High")),
    ("performance", "m.py", "Inefficient loop using range(len())", (2, 2, 0.50, "P2 - Medium")),
    ("testing", "m.py", "No test files found for m.py", (3, 4, 0.82, "P0 - Critical")),
    ("testing", "m.py", "low test coverage", (2, 4, 0.65, "P1 - High")),
    ("complexity", "m.py", "Function 'f' is too long (60 lines)", (2, 3, 0.57, "P2 - Medium")),
    ("duplication", None, "Code duplication detected between small.py and b.py", (1, 4, 0.47, "P2 - Medium")),
    ("duplication", None, "deep.py and copy.py", (3, 2, 0.67, "P1 - High")),
    ("other", "m.py", "console.log( found", (2, 2, 0.50, "P2 - Medium")),
    ("other", "m.py", "this should go", (1, 3, 0.40, "P2 - Medium")),
    ("other", "m.py", "function f { { { {", (2, 2, 0.50, "P2 - Medium")),
]


def test_scores(issues):
    rows = severity.score_issues(issues([(c, "low", f, m) for c, f, m, _ in SCORES])).orderBy("rule_id").collect()
    got = [(r["impact_level"], r["likelihood_level"], r["severity_score"], r["priority"]) for r in rows]
    assert got == [s[3] for s in SCORES]
    assert rows[0]["reasoning"] == "Issue has critical impact and is likely to occur. Severity score: 0.92/1.0. Priority: P0 - Critical."


def test_all_sixteen_scores(spark):
    from pyspark.sql import functions as F

    grid = spark.range(4).select((F.col("id") + 1).cast("int").alias("i")).crossJoin(spark.range(4).select((F.col("id") + 1).cast("int").alias("l")))
    for r in grid.select("i", "l", severity.score_cents(F.col("i"), F.col("l")).alias("c")).collect():
        assert r["c"] == round(round((r["i"] * 0.7 + r["l"] * 0.3) / 4.0, 2) * 100)


def _scored(spark, rows):
    rows = [(p, s, Decimal(n)) for p, s, n in rows]
    return spark.createDataFrame(rows, "priority string, severity_score double, findings decimal(38,0)")


def test_risk_levels(spark):
    low = [("P1 - High", 0.6, 1)] * 3 + [("P3 - Low", 0.25, 1)] * 7
    r = severity.risk_assessment(_scored(spark, low)).first()
    assert (r["risk_level"], r["total_issues"], r["high_issues"]) == ("Low", 10, 3) and r["risk_score"] in (0.35, 0.36)
    r = severity.risk_assessment(_scored(spark, low + [("P1 - High", 0.6, 1)])).first()
    assert r["risk_level"] == "High"
    r = severity.risk_assessment(_scored(spark, [("P0 - Critical", 0.92, 1)] * 21)).first()
    assert r["risk_level"] == "Critical" and len(r["recommendations"]) == 4
    r = severity.risk_assessment(_scored(spark, [("P1 - High", 0.67, 1)])).first()
    assert r["risk_level"] == "Medium"
    r = severity.risk_assessment(_scored(spark, low).where("false")).first()
    assert (r["risk_level"], r["risk_score"], r["recommendations"]) == ("Low", 0.0, ["No issues found. Code quality is good."])


def test_priority_summary_defaults(spark):
    rows = [("P0 - Critical", 0.9, 1), (None, None, 1), ("strange", 0.1, 1), ("P2 - Medium", 0.5, 7)]
    got = {r["priority"]: int(r["issues"]) for r in severity.priority_summary(_scored(spark, rows)).collect()}
    assert got == {"P0 - Critical": 1, "P1 - High": 0, "P2 - Medium": 7, "P3 - Low": 0, "P4 - Info": 1}


def test_rollups(issues):
    df = issues([("style", "critical", "a/x.py", "m"), ("style", "info", "b/x.py", "m"), ("odd", "weird", None, "m"), ("style", "low", "y.py", "m")])
    got = {r["file_name"]: int(r["score"]) for r in rollups.file_complexity(df).collect()}
    assert got == {"x.py": 4, "unknown": 1, "y.py": 1}
    assert {r["category"]: int(r["issues"]) for r in rollups.category_counts(df).collect()} == {"style": 3, "odd": 1}
    matrix = {r["category"]: int(r["P3 - Low"]) for r in rollups.priority_matrix(severity.score_issues(df)).collect()}
    assert matrix["style"] == 3
    assert severity.at_least(df, "low").count() == 2


def test_top_is_a_bounded_plan(issues):
    plan = severity.top_issues(severity.score_issues(issues([("style", "low", "a.py", "m")])), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_ranking_computes_its_rows_once(spark):
    from pyspark.sql import functions as F

    from codestrata.operators.ranking import ranked

    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.range(100, numPartitions=3).mapInPandas(watch, "id long")
    assert [r["rank"] for r in ranked(rows, [F.desc("id")]).orderBy(F.desc("id")).collect()] == list(range(1, 101))
    assert seen.value == 100
