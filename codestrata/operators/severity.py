"""Severity scoring of issues: impact, likelihood, score, priority and a reasoning sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD, computed_once, contains_any
from .ranking import ranked

# Message patterns and word lists of the scoring scheme.
CRITICAL_PATTERNS = [
    r"eval\(", r"exec\(", r"__import__\(", r"shell=True", r"subprocess\.call.*shell=True", r"os\.system\(",
    r"pickle\.loads\(", r"yaml\.load\(", r"SQL.*\+.*%s", r"innerHTML.*=.*\+", r"document\.write\(", r"Function\(",
    r"setTimeout.*eval", r"setInterval.*eval",
]
HIGH_PATTERNS = [
    r"""password\s*=\s*["'][^"']+["']""", r"""api_key\s*=\s*["'][^"']+["']""", r"""secret\s*=\s*["'][^"']+["']""",
    r"\.innerHTML\s*=", r"\.outerHTML\s*=", r"document\.cookie", r"localStorage\.setItem", r"sessionStorage\.setItem",
    r"XMLHttpRequest", r"fetch\(", r"axios\(", r"requests\.get\(", r"requests\.post\(", r"urllib\.request", r"http\.client",
    r"for\s+\w+\s+in\s+range\(len\(", r"while\s+True:", r"while\s+1:", r"for\s+\(;;\)", r"recursive.*function",
    r"deep.*copy", r"pickle\.dump", r"json\.loads", r"yaml\.load",
]
MEDIUM_PATTERNS = [
    r"console\.log\(", r"print\(", r"debugger", r"var\s+\w+", r"==\s*[^=]", r"!=\s*[^=]",
    r"function\s+\w+.*\{.*\{.*\{.*\{", r"if.*\{.*if.*\{.*if.*\{", r"for.*\{.*for.*\{.*for.*\{", r"while.*\{.*while.*\{",
    r"try.*\{.*try.*\{", r"catch.*\{.*catch.*\{", r"def\s+\w+\([^)]{50,}\)", r"function\s+\w+\([^)]{50,}\)",
    r"class\s+\w+.*\{.*\{.*\{.*\{", r"import\s+\*", r"from\s+\w+\s+import\s+\*", r"require\(.*\*", r"global\s+\w+",
    r"nonlocal\s+\w+",
]
SECURITY_CRITICAL = ["injection", "xss", "csrf", "rce", "lfi", "rfi"]
SECURITY_HIGH = ["password", "secret", "key", "token"]
PERFORMANCE_HIGH = ["memory leak", "infinite loop", "deadlock"]
PERFORMANCE_MEDIUM = ["slow", "inefficient", "bottleneck"]
TESTING_HIGH = ["no test", "missing test"]
TESTING_MEDIUM = ["test coverage"]
COMPLEXITY_MEDIUM = ["too complex", "too long", "too many"]
PATH_CERTAIN = ["config", "settings", "env"]
PATH_LIKELY = ["main", "app", "index", "server"]
LIKELIHOOD_BY_CATEGORY = {
    "security": 3, "performance": 2, "testing": 4, "documentation": 2, "complexity": 3, "style": 1, "formatting": 1,
}
MESSAGE_CERTAIN = ["always", "never", "every", "all"]
MESSAGE_POSSIBLE = ["may", "might", "could", "possibly"]
MESSAGE_LIKELY = ["will", "should", "must", "required"]
IMPACT_WORDS = {4: "critical impact", 3: "high impact", 2: "medium impact", 1: "low impact"}
LIKELIHOOD_WORDS = {4: "certain to occur", 3: "likely to occur", 2: "possibly occurring", 1: "unlikely to occur"}
PRIORITIES = ["P0 - Critical", "P1 - High", "P2 - Medium", "P3 - Low", "P4 - Info"]
PRIORITY_FLOORS = [80, 60, 40, 20]
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
UNSCORED_PRIORITY = "P4 - Info"


def any_pattern(patterns: list[str], flags: str = "") -> str:
    """One alternation; white space and word classes follow Unicode."""
    body = "|".join(p.replace(r"\s", SPACE).replace(r"\w", WORD) for p in patterns)
    return f"{flags}(?:{body})"


def _matches(c: Column, patterns: list[str]) -> Column:
    return c.rlike(any_pattern(patterns, "(?iud)"))


def impact_level(message: Column, category: Column) -> Column:
    return _impact(F.lower(message), F.lower(category))


def _impact(m: Column, c: Column) -> Column:
    def tiers(high: tuple[int, list[str]], mid: tuple[int, list[str]], low: int) -> Column:
        return F.when(contains_any(m, high[1]), high[0]).when(contains_any(m, mid[1]), mid[0]).otherwise(low)

    return (
        F.when(_matches(m, CRITICAL_PATTERNS), 4)
        .when(c.isin("security", "vulnerability"), tiers((4, SECURITY_CRITICAL), (3, SECURITY_HIGH), 2))
        .when(c == "performance", tiers((3, PERFORMANCE_HIGH), (2, PERFORMANCE_MEDIUM), 1))
        .when(c == "testing", tiers((3, TESTING_HIGH), (2, TESTING_MEDIUM), 1))
        .when(c == "documentation", 1)
        .when(c == "complexity", F.when(contains_any(m, COMPLEXITY_MEDIUM), 2).otherwise(1))
        .when(c.isin("style", "formatting"), 1)
        .when(_matches(m, HIGH_PATTERNS), 3)
        .when(_matches(m, MEDIUM_PATTERNS), 2)
        .otherwise(1)
    )


def likelihood_level(message: Column, category: Column, path: Column) -> Column:
    return _likelihood(F.lower(message), F.lower(category), F.lower(F.coalesce(path, F.lit(""))))


def _likelihood(m: Column, c: Column, p: Column) -> Column:
    out = (
        F.when(F.contains(p, F.lit("test")), 1)
        .when(contains_any(p, PATH_CERTAIN), 4)
        .when(contains_any(p, PATH_LIKELY), 3)
    )
    for category_name, level in LIKELIHOOD_BY_CATEGORY.items():
        out = out.when(c == category_name, level)
    return (
        out.when(contains_any(m, MESSAGE_CERTAIN), 4)
        .when(contains_any(m, MESSAGE_POSSIBLE), 2)
        .when(contains_any(m, MESSAGE_LIKELY), 3)
        .otherwise(2)
    )


def score_cents(impact: Column, likelihood: Column) -> Column:
    """(0.7 impact + 0.3 likelihood) / 4 in hundredths; every half rounds down, as in binary arithmetic."""
    return F.floor((impact * 7 + likelihood * 3) * F.lit(2.5)).cast("int")


def _words(level: Column, words: dict[int, str]) -> Column:
    chain = None
    for k, v in words.items():
        chain = F.when(level == k, v) if chain is None else chain.when(level == k, v)
    return chain


def score_issues(issues: DataFrame) -> DataFrame:
    """Add severity_score, impact_level, likelihood_level, priority and reasoning."""
    category = F.coalesce(F.col("category"), F.lit("general"))
    message = F.coalesce(F.col("message"), F.lit(""))
    lowered = F.struct(F.lower(message).alias("m"), F.lower(category).alias("c"), F.lower(F.coalesce("file", F.lit(""))).alias("p"))
    # In a lambda, outside the generated method of the stage, which with all these branches would be too long to be compiled.
    levels = computed_once(
        lowered, lambda v: F.struct(_impact(v["m"], v["c"]).alias("impact_level"), _likelihood(v["m"], v["c"], v["p"]).alias("likelihood_level"))
    )
    levels = issues.withColumn("_levels", levels).withColumns({k: F.col(f"_levels.{k}") for k in ("impact_level", "likelihood_level")}).drop("_levels")
    cents = levels.withColumn("_cents", score_cents(F.col("impact_level"), F.col("likelihood_level")))
    priority = None
    for floor, label in zip(PRIORITY_FLOORS, PRIORITIES):
        cond = F.col("_cents") >= floor
        priority = F.when(cond, label) if priority is None else priority.when(cond, label)
    scored = cents.withColumns(
        {"severity_score": F.col("_cents") / F.lit(100.0), "priority": priority.otherwise(PRIORITIES[-1])}
    ).drop("_cents")
    return scored.withColumn(
        "reasoning",
        F.concat(
            F.lit("Issue has "), _words(F.col("impact_level"), IMPACT_WORDS),
            F.lit(" and is "), _words(F.col("likelihood_level"), LIKELIHOOD_WORDS),
            F.lit(". Severity score: "), F.col("severity_score").cast("string"),
            F.lit("/1.0. Priority: "), F.col("priority"), F.lit("."),
        ),
    )


def order_columns() -> list[Column]:
    """Score first, then position: the tie-break that replaces input order."""
    return [
        F.desc("severity_score"), F.asc_nulls_first("file"), F.asc_nulls_first("line"), F.asc("rule_id"), F.asc("message"),
        F.asc_nulls_first("file1"), F.asc_nulls_first("file2"), F.asc_nulls_first("lines1"), F.asc_nulls_first("lines2"),
    ]


def prioritize(issues: DataFrame) -> DataFrame:
    """All issues, scored, in global order."""
    return score_issues(issues).orderBy(*order_columns())


def prioritized(scored: DataFrame) -> DataFrame:
    """Scored issues with their ``rank`` in the global order, as a table that needs no sorting to be read by rank."""
    return ranked(scored, order_columns())


def top_issues(scored: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` in priority order; the planner keeps only ``n`` rows per task."""
    return scored.orderBy(*order_columns()).limit(n)


def severity_rank(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[severity]


def at_least(issues: DataFrame, threshold: str = "medium") -> DataFrame:
    """Optional severity filter."""
    return issues.where(severity_rank(F.col("severity")) >= SEVERITY_RANK[threshold])


def priority_summary(scored: DataFrame) -> DataFrame:
    """One row per priority, zeros included; unscored issues count as P4, unknown labels do not count."""
    p = F.coalesce(F.col("priority"), F.lit(UNSCORED_PRIORITY))
    one = scored.agg(
        *[F.coalesce(F.sum(F.when(p == label, F.col("findings"))), F.lit(0)).alias(label) for label in PRIORITIES]
    )
    pairs = F.array(*[F.struct(F.lit(x).alias("priority"), F.col(f"`{x}`").alias("issues")) for x in PRIORITIES])
    return one.select(F.inline(pairs))


def risk_assessment(scored: DataFrame) -> DataFrame:
    """One row: risk level, average score, counts and recommendations."""
    n = F.col("findings")
    p = F.coalesce(F.col("priority"), F.lit(""))
    cents = F.round(F.coalesce("severity_score", F.lit(0.0)) * 100).cast("bigint")
    totals = scored.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_issues"),
        F.coalesce(F.sum(cents * n), F.lit(0)).alias("cents"),
        F.coalesce(F.sum(F.when(p.startswith("P0"), n)), F.lit(0)).alias("critical_issues"),
        F.coalesce(F.sum(F.when(p.startswith("P1"), n)), F.lit(0)).alias("high_issues"),
    )
    total, crit, high = F.col("total_issues"), F.col("critical_issues"), F.col("high_issues")
    empty = total == 0
    avg = F.when(empty, 0.0).otherwise(F.col("cents") / F.greatest(total, F.lit(1)) / 100)
    level = F.when(crit > 0, "Critical").when(high > 3, "High").when(F.col("avg") > 0.6, "Medium").otherwise("Low")
    # Wording of the recommendations.
    advice = F.filter(
        F.array(
            F.when(empty, F.lit("No issues found. Code quality is good.")),
            F.when(crit > 0, F.concat(F.lit("🚨 "), crit.cast("string"), F.lit(" critical issues require immediate attention"))),
            F.when(high > 0, F.concat(F.lit("⚠️ "), high.cast("string"), F.lit(" high-priority issues should be addressed soon"))),
            F.when(F.col("avg") > 0.5, F.lit("📊 Consider implementing automated code quality checks")),
            F.when(total > 20, F.lit("🔍 Large number of issues detected - consider code review process")),
            F.when(~empty, F.lit("💡 Focus on security and performance issues first")),
        ),
        lambda a: a.isNotNull(),
    )
    return totals.withColumn("avg", avg).select(
        level.alias("risk_level"),
        F.round("avg", 2).alias("risk_score"),
        "total_issues",
        "critical_issues",
        "high_issues",
        advice.alias("recommendations"),
    )
