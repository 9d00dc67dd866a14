"""The same results as plain SQL, written independently of the DataFrame code.

Only fixed values (patterns, word lists, texts) and the corpus definition are shared.
"""

from __future__ import annotations

from codestrata.functions.text import SPACE, WHITE_SPACE, WORD
from codestrata.operators import severity as sev
from codestrata.operators.rules import RULES
from codestrata.plans.corpus import corpus_sql

ORACLE: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TRIM = _q(WHITE_SPACE)

CORPUS = f"corpus AS ({corpus_sql()})"
FILES = f"""{CORPUS},
named AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM corpus),
files AS (
  SELECT *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS ext,
         CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' OR path LIKE '%.jsx' THEN 'javascript' ELSE 'typescript' END AS language,
         name[1:len(name) - len(regexp_extract(name, '^.+(\\.[^.]+)$', 1))] AS stem,
         string_split(content, chr(10)) AS ls,
         starts_with(content, 'def broken_') AS broken
  FROM named)"""
LINES = f"""{FILES},
lines AS (SELECT f.*, i AS line, ls[i] AS text FROM files f, unnest(range(1, len(ls) + 1)) AS t(i))"""


def _rule(rule_id: str):
    return next(r for r in RULES if r.id == rule_id)


def _select(rule_id: str, cond: str, message: str | None = None, line: str = "line", source: str = "lines") -> str:
    """One rule as a SELECT over lines (or files)."""
    r = _rule(rule_id)
    lang = "language = 'python'" if r.languages == ("python",) else "language <> 'python'"
    lit = lambda v: "NULL" if v is None else _q(v)
    msg = message or _q(r.message)
    return (
        f"SELECT '{rule_id}' AS rule_id, {_q(r.category)} AS category, {_q(r.severity)} AS severity, path AS file, "
        f"CAST({line} AS INTEGER) AS line, {msg} AS message, CAST({lit(r.suggestion)} AS VARCHAR) AS suggestion, "
        f"CAST({lit(r.impact)} AS VARCHAR) AS impact, CAST({lit(r.test_type)} AS VARCHAR) AS test_type "
        f"FROM {source} WHERE {lang} AND ({cond})"
    )


QUOTED = "(contains(text, '\"') OR contains(text, ''''))"
DEF = f"^{SPACE}*def{SPACE}+({WORD}+)"
CLASS = f"^{SPACE}*class{SPACE}+({WORD}+)"
JSFUN = f"function{SPACE}+{WORD}+|const{SPACE}+{WORD}+{SPACE}*={SPACE}*\\("
HAS_Q = "(contains(x, '\"\"\"') OR contains(x, ''''''''))"
CODE = f"(trim(x, {TRIM}) <> '' AND NOT starts_with(trim(x, {TRIM}), '#'))"
DOCUMENTED = (
    f"coalesce(regexp_matches(list_filter(ls[line + 1:line + 5], lambda x: {HAS_Q} OR {CODE})[1], '\"\"\"|'''''''), false)"
)
JSDOC = "len(list_filter(ls[greatest(1, line - 4):line], lambda x: contains(x, '/**') OR contains(x, '* @'))) > 0"
TESTLIKE = "(contains(lower(path), 'test') OR (language <> 'python' AND contains(lower(path), 'spec')))"
MODULE_DOC = f"""coalesce(regexp_matches(list_filter(list_transform(ls[1:10], lambda x: trim(x, {TRIM})),
  lambda x: x <> '' AND NOT starts_with(x, '#'))[1], '^("{{3}}|''{{3}})'), false)"""


def _name(pattern: str) -> str:
    return f"regexp_extract(text, {_q(pattern)}, 1)"


def _basic(gated: bool) -> list[str]:
    ok = "NOT broken AND " if gated else ""
    out = []
    if gated:
        out += [
            _select("PY-01", "broken", "'Syntax error: invalid syntax'", "1", "files"),
            _select("PY-03", "NOT broken AND starts_with(text, 'def long_')", f"'Function ''' || {_name(DEF)} || ''' is too long (55 lines)'"),
            _select("PY-04", "NOT broken AND text = '    def __init__(self, a, b, c, d, e, f, g):'",
                    "'Function ''__init__'' has too many parameters (8)'"),
        ]
    pw = f"""(?i)password{SPACE}*={SPACE}*["'][^"']+["']"""
    ex = f"""execute{SPACE}*\\({SPACE}*["'].*%s.*["']"""
    long_msg = "'Line too long (' || CAST(len(text) AS VARCHAR) || ' characters)'"
    out += [
        _select("PY-06", f"{ok}regexp_matches(text, {_q(pw)})"),
        _select("PY-07", f"{ok}regexp_matches(text, {_q(ex)})"),
        _select("PY-08", f"{ok}contains(text, 'eval(')"),
        _select("PY-09", f"{ok}len(text) > 120", long_msg),
        _select("PY-10", f"{ok}contains(text, ';') AND NOT starts_with(trim(text, {TRIM}), '#')"),
        _select("PY-11", f"{ok}regexp_matches(text, {_q(DEF)}) AND NOT {DOCUMENTED}",
                f"'Function ''' || {_name(DEF)} || ''' missing docstring'"),
        _select("JS-01", "contains(text, 'eval(')"),
        _select("JS-02", "contains(text, '.innerHTML') AND contains(text, '=')"),
        _select("JS-03", "contains(text, 'console.log(')"),
        _select("JS-04", "len(text) > 120", long_msg),
        _select("JS-05", f"len(text) - len(ltrim(text, {TRIM})) > 20"),
        _select("JS-06", f"regexp_matches(text, {_q(f'(^|[^\\p{{L}}\\p{{N}}_])var{SPACE}+{WORD}')})"),
        _select("JS-07", "contains(text, '==') AND NOT contains(text, '===') AND NOT contains(text, '!=')"),
    ]
    return out


def _enhanced() -> list[str]:
    body = f"list_transform(ls[line + 1:line + 50], lambda x: trim(x, {TRIM}))"
    rng = f"for{SPACE}+{WORD}+{SPACE}+in{SPACE}+range\\(len\\("
    name = _name(DEF)
    return [
        _select("PP-01", f"regexp_matches(text, {_q(rng)})"),
        _select("PP-02", f"contains(text, 'for') AND contains(text, '+') AND {QUOTED}"),
        _select("PP-03", "contains(text, '[') AND contains(text, 'for') AND contains(text, 'if') AND len(text) - len(replace(text, '[', '')) > 1"),
        _select("PP-04", "contains(text, 'def ') AND contains(content, 'global ')"),
        _select("JP-01", "regexp_matches(text, 'getElementById\\(.*\\)\\.getElementById\\(')"),
        _select("JP-02", "contains(text, 'for') AND contains(text, 'length') AND contains(text, 'i++')"),
        _select("JP-03", "contains(text, 'XMLHttpRequest') OR contains(text, 'fs.readFileSync') OR contains(text, 'require(')"),
        _select("JP-04", "contains(text, 'addEventListener') AND NOT contains(content, 'removeEventListener')"),
        _select("TP-02", "fn.function_lines > 20 OR fn.branches > 5",
                f"'Complex function ''' || {name} || ''' may need comprehensive testing'",
                source=f"(SELECT l.*, {_sizes()} AS fn FROM (SELECT *, {body} AS w FROM lines WHERE language = 'python' "
                       f"AND NOT {TESTLIKE} AND regexp_matches(text, {_q(DEF)}) AND NOT starts_with({name}, '_')) l)"),
        _select("DP-01", f"NOT {MODULE_DOC}", line="1", source="files"),
        _select("DP-02", f"regexp_matches(text, {_q(DEF)}) AND NOT starts_with({name}, '_') AND NOT {DOCUMENTED}",
                f"'Function ''' || {name} || ''' missing docstring'"),
        _select("DP-03", f"regexp_matches(text, {_q(CLASS)}) AND NOT starts_with({_name(CLASS)}, '_') AND NOT {DOCUMENTED}",
                f"'Class ''' || {_name(CLASS)} || ''' missing docstring'"),
        _select("DJ-01", f"regexp_matches(text, {_q(JSFUN)}) AND NOT ({JSDOC})"),
    ]


def _sizes() -> str:
    """Struct of code lines and branch lines in the stripped window ``w`` up to the next def."""
    stop = "coalesce(list_position(list_transform(w, lambda x, k: k > 1 AND starts_with(x, 'def ')), true), 0)"
    cut = f"CASE WHEN {stop} > 0 THEN w[1:{stop} - 1] ELSE w END"
    code = f"list_filter({cut}, lambda x: x <> '' AND NOT starts_with(x, '#'))"
    return (
        f"{{'function_lines': len({code}), "
        f"'branches': len(list_filter({code}, lambda x: regexp_matches(x, 'if|else|for|while|try|except')))}}"
    )


UNTESTED = f"""untested AS (
  SELECT DISTINCT path, language FROM lines l
  WHERE NOT {TESTLIKE}
    AND CASE WHEN language = 'python'
        THEN (regexp_matches(text, {_q(DEF)}) AND NOT starts_with({_name(DEF)}, '_')) OR regexp_matches(text, {_q(CLASS)})
        ELSE regexp_matches(text, {_q(JSFUN + f'|class{SPACE}+{WORD}+')}) END
    AND NOT EXISTS (SELECT 1 FROM files t WHERE t.parent = l.parent AND (
      t.name = 'test_' || l.stem || '.py' OR t.name = l.stem || '_test.py' OR t.name = 'test_' || l.stem || '.js'
      OR t.name = l.stem || '.test.js' OR t.name = l.stem || '.spec.js')))"""


def _untested_issues() -> list[str]:
    msg = "'No test files found for ' || path"
    return [_select(r, "true", msg, "NULL", "untested") for r in ("TP-01", "TJ-01")]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


LINE_ISSUES = f"{LINES}, issues AS ({_union(_basic(False))})"
BASIC = f"{LINES}, issues AS ({_union(_basic(True))})"
_no_comment = "regexp_replace(regexp_replace(text, '#.*', ''), '//.*', '')"
_collapsed = f"regexp_replace(trim({_no_comment}, {TRIM}), {_q(SPACE + '+')}, ' ', 'g')"
NORM = f"""array_to_string(list_transform(regexp_extract_all({_collapsed}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'),
  lambda w: CASE WHEN regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*') THEN 'VAR' ELSE w END), '')"""
DUPLICATES = f"""fps AS (SELECT path, CASE WHEN language = 'python' THEN 'python' ELSE 'script' END AS lang_group,
  list(md5(coalesce({NORM}, '')) ORDER BY line) AS fp FROM lines GROUP BY ALL),
keyed AS (SELECT path, lang_group, i AS start, list_sort(list_distinct(fp[i:i + 4])) AS key FROM fps, unnest(range(1, len(fp) - 3)) AS t(i)),
blocks AS (SELECT *, len(key) AS n, md5(array_to_string(key, ',')) AS block_id FROM keyed),
cls AS (SELECT lang_group, block_id, any_value(n) AS n, any_value(key) AS key, count(*) AS members, count(DISTINCT path) AS files,
  min({{'path': path, 'start': start}}) AS first FROM blocks GROUP BY lang_group, block_id),
per_file AS (SELECT lang_group, block_id, path, count(*) AS cnt FROM blocks GROUP BY ALL),
classes AS (SELECT c.lang_group, c.block_id, c.n, c.members, c.files, first.path AS first_path, first.start AS first_start,
    CAST((c.members * c.members - s.sq) // 2 AS DECIMAL(38,0)) AS pairs
  FROM cls c JOIN (SELECT lang_group, block_id, sum(cnt * cnt) AS sq FROM per_file GROUP BY ALL) s USING (lang_group, block_id) WHERE files > 1),
links AS (
  SELECT a.lang_group, a.block_id AS block5, b.block_id AS block4, a.members AS members5, b.members AS members4,
    CAST(a.members * b.members - coalesce((SELECT sum(x.cnt * y.cnt) FROM per_file x JOIN per_file y USING (lang_group, path)
      WHERE x.lang_group = a.lang_group AND x.block_id = a.block_id AND y.block_id = b.block_id), 0) AS DECIMAL(38,0)) AS pairs
  FROM (SELECT *, unnest(key) AS dropped FROM cls WHERE n = 5) a
  JOIN cls b ON b.lang_group = a.lang_group AND b.n = 4 AND b.block_id = md5(array_to_string(list_filter(a.key, lambda k: k <> a.dropped), ',')))"""
BLOCKS = f"{LINES},\n{DUPLICATES}"


def _duplication_issues() -> list[str]:
    """Findings on duplicated blocks; each stands for the number of pairs in ``findings``."""
    keys = "'DUP-01' AS rule_id, 'duplication' AS category, 'medium' AS severity, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS line"
    rest = "'Consider extracting common code into a shared function or module', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), pairs"
    return [
        f"SELECT {keys}, 'Code duplication detected across ' || CAST(files AS VARCHAR) || ' files', {rest} FROM classes",
        f"SELECT {keys}, 'Code duplication detected between two groups of blocks', {rest} FROM links WHERE pairs > 0",
    ]


_single = _union(_basic(True) + _enhanced() + _untested_issues())
ENHANCED = f"""{LINES}, {UNTESTED}, {DUPLICATES},
issues AS (SELECT *, CAST(1 AS DECIMAL(38,0)) AS findings FROM ({_single}) UNION ALL {_union(_duplication_issues())})"""


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in words) + ")"


def _rx(c: str, patterns: list[str]) -> str:
    return f"regexp_matches({c}, {_q(sev.any_pattern(patterns, '(?i)'))})"


IMPACT = f"""CASE WHEN {_rx('m', sev.CRITICAL_PATTERNS)} THEN 4
  WHEN c IN ('security', 'vulnerability') THEN CASE WHEN {_any('m', sev.SECURITY_CRITICAL)} THEN 4 WHEN {_any('m', sev.SECURITY_HIGH)} THEN 3 ELSE 2 END
  WHEN c = 'performance' THEN CASE WHEN {_any('m', sev.PERFORMANCE_HIGH)} THEN 3 WHEN {_any('m', sev.PERFORMANCE_MEDIUM)} THEN 2 ELSE 1 END
  WHEN c = 'testing' THEN CASE WHEN {_any('m', sev.TESTING_HIGH)} THEN 3 WHEN {_any('m', sev.TESTING_MEDIUM)} THEN 2 ELSE 1 END
  WHEN c = 'documentation' THEN 1
  WHEN c = 'complexity' THEN CASE WHEN {_any('m', sev.COMPLEXITY_MEDIUM)} THEN 2 ELSE 1 END
  WHEN c IN ('style', 'formatting') THEN 1
  WHEN {_rx('m', sev.HIGH_PATTERNS)} THEN 3 WHEN {_rx('m', sev.MEDIUM_PATTERNS)} THEN 2 ELSE 1 END"""
LIKELIHOOD = f"""CASE WHEN contains(p, 'test') THEN 1 WHEN {_any('p', sev.PATH_CERTAIN)} THEN 4 WHEN {_any('p', sev.PATH_LIKELY)} THEN 3
  WHEN c = 'security' THEN 3 WHEN c = 'performance' THEN 2 WHEN c = 'testing' THEN 4 WHEN c = 'documentation' THEN 2
  WHEN c = 'complexity' THEN 3 WHEN c IN ('style', 'formatting') THEN 1
  WHEN {_any('m', sev.MESSAGE_CERTAIN)} THEN 4 WHEN {_any('m', sev.MESSAGE_POSSIBLE)} THEN 2 WHEN {_any('m', sev.MESSAGE_LIKELY)} THEN 3 ELSE 2 END"""
# The sixteen possible scores, impact first.
SCORE_TABLE = """score_table(impact_level, likelihood_level, severity_score) AS (VALUES
  (1, 1, 0.25), (1, 2, 0.32), (1, 3, 0.40), (1, 4, 0.47), (2, 1, 0.42), (2, 2, 0.50), (2, 3, 0.57), (2, 4, 0.65),
  (3, 1, 0.60), (3, 2, 0.67), (3, 3, 0.75), (3, 4, 0.82), (4, 1, 0.77), (4, 2, 0.85), (4, 3, 0.92), (4, 4, 1.00))"""
SCORED = f"""{SCORE_TABLE},
leveled AS (SELECT *, {IMPACT} AS impact_level, {LIKELIHOOD} AS likelihood_level
  FROM (SELECT *, lower(message) AS m, lower(category) AS c, coalesce(lower(file), '') AS p FROM issues)),
prioritized AS (SELECT l.*, CAST(severity_score AS DOUBLE) AS severity_score,
    CASE WHEN severity_score >= 0.8 THEN 'P0 - Critical' WHEN severity_score >= 0.6 THEN 'P1 - High'
         WHEN severity_score >= 0.4 THEN 'P2 - Medium' ELSE 'P3 - Low' END AS priority
  FROM leveled l JOIN score_table USING (impact_level, likelihood_level)),
scored AS (SELECT *, 'Issue has ' || CASE impact_level WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END
    || ' impact and is ' || CASE likelihood_level WHEN 4 THEN 'certain to occur' WHEN 3 THEN 'likely to occur'
       WHEN 2 THEN 'possibly occurring' ELSE 'unlikely to occur' END
    || '. Severity score: ' || CAST(severity_score AS VARCHAR) || '/1.0. Priority: ' || priority || '.' AS reasoning FROM prioritized)"""

KEYS = "rule_id, category, severity, file, line, message, suggestion, impact, test_type"
KEYS0 = KEYS.replace("file, line,", "coalesce(file, '') AS file, coalesce(line, 0) AS line,") + ", CAST(findings AS VARCHAR) AS findings"
SCORES = "severity_score, impact_level, likelihood_level, priority, reasoning"
N = "CAST(count(*) AS BIGINT)"
FOUND = "CAST(sum(findings) AS BIGINT)"

ORACLE["source_files"] = f"""WITH {FILES} SELECT path, name, parent, stem, ext, language, strlen(content) AS size,
  CASE ext WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.jsx' THEN 'JavaScript' ELSE 'TypeScript' END AS display_language,
  true AS supported, CAST(len(ls) AS BIGINT) AS n_lines FROM files"""
ORACLE["scanned_files"] = f"""WITH {FILES}, sized AS (SELECT *, strlen(content) % 20 = 0 AS unreadable FROM files)
SELECT path, ext, language, strlen(content) + CAST(unreadable AS BIGINT) AS size, unreadable, CASE WHEN NOT unreadable THEN md5(content) END AS digest FROM sized
WHERE ext IN ('.py', '.ts', '.tsx') AND strlen(content) + CAST(unreadable AS BIGINT) <= 10485"""
ORACLE["line_rules_issues"] = f"WITH {LINE_ISSUES} SELECT {KEYS} FROM issues"
ORACLE["basic_issues"] = f"WITH {BASIC} SELECT {KEYS} FROM issues"
ORACLE["enhanced_issues"] = f"WITH {ENHANCED} SELECT {KEYS0} FROM issues"
_js_parts = [s for s in _basic(False) + _enhanced() if "language <> 'python'" in s.rsplit(" WHERE ", 1)[1]]
ORACLE["pages_script_rules"] = f"""WITH files AS (SELECT 'pages/p' || CAST(page_id AS VARCHAR) || '.js' AS path, 'javascript' AS language,
    replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content FROM pages),
split AS (SELECT *, string_split(content, chr(10)) AS ls, false AS broken FROM files),
lines AS (SELECT f.*, i AS line, ls[i] AS text FROM split f, unnest(range(1, len(ls) + 1)) AS t(i)),
issues AS ({_union([_select('JS-01', "contains(text, 'eval(')")] + [s for s in _js_parts if "'JS-01'" not in s])})
SELECT {KEYS} FROM issues"""
ORACLE["function_sizes"] = f"""WITH {LINES} SELECT path, CAST(line AS INTEGER) AS line, name, CAST(fn.function_lines AS INTEGER) AS function_lines,
  CAST(fn.branches AS INTEGER) AS branches, has_docstring
FROM (SELECT path, line, fname AS name, {_sizes()} AS fn, has_docstring FROM (
  SELECT path, line, {_name(DEF)} AS fname, list_transform(ls[line + 1:line + 50], lambda x: trim(x, {TRIM})) AS w, {DOCUMENTED} AS has_docstring
  FROM lines WHERE language = 'python' AND regexp_matches(text, {_q(DEF)})))"""
ORACLE["untested_files"] = f"WITH {LINES}, {UNTESTED} SELECT path, language FROM untested"
ORACLE["issues_scored"] = f"WITH {ENHANCED}, {SCORED} SELECT {KEYS0}, {SCORES} FROM scored"
ORACLE["top_issues"] = f"""WITH {BASIC}, {SCORED} SELECT rule_id, file, line, message, {SCORES} FROM scored
ORDER BY severity_score DESC, file, line, rule_id, message LIMIT 100"""
ORACLE["prioritized_issues"] = f"""WITH {BASIC}, {SCORED} SELECT row_number() OVER (ORDER BY severity_score DESC, file NULLS FIRST, line NULLS FIRST, rule_id, message) AS rank,
  rule_id, file, line, message, {SCORES} FROM scored"""
ORACLE["issues_with_run_metadata"] = f"""WITH {LINE_ISSUES} SELECT rule_id, file, line, 'https://host/o/r.git' AS repository_url, 'o' AS repository_owner,
  'r' AS repository_name, 'trunk' AS analyzed_branch, '1.0.0' AS analyzer_version FROM issues"""
ORACLE["limited_files"] = f"WITH {FILES} SELECT path, language, strlen(content) AS size FROM files WHERE strlen(content) <= 0.004 * 1024 * 1024 AND language <> 'javascript'"
ORACLE["high_severity_issues"] = f"WITH {BASIC} SELECT {KEYS} FROM issues WHERE severity IN ('high', 'critical')"
ORACLE["priority_summary"] = f"""WITH {BASIC}, {SCORED} SELECT t.label AS priority, CAST(count(s.priority) AS BIGINT) AS issues
FROM unnest(['P0 - Critical', 'P1 - High', 'P2 - Medium', 'P3 - Low', 'P4 - Info']) AS t(label)
LEFT JOIN scored s ON s.priority = t.label GROUP BY t.label"""
ORACLE["risk_assessment"] = f"""WITH {ENHANCED}, {SCORED},
t AS (SELECT {FOUND} AS total_issues, CAST(coalesce(sum(findings) FILTER (priority LIKE 'P0%'), 0) AS BIGINT) AS critical_issues,
  CAST(coalesce(sum(findings) FILTER (priority LIKE 'P1%'), 0) AS BIGINT) AS high_issues,
  CAST(sum(CAST(round(severity_score * 100) AS BIGINT) * findings) AS DOUBLE) / CAST(sum(findings) AS DOUBLE) / 100 AS a FROM scored)
SELECT CASE WHEN critical_issues > 0 THEN 'Critical' WHEN high_issues > 3 THEN 'High' WHEN a > 0.6 THEN 'Medium' ELSE 'Low' END AS risk_level,
  round(a, 2) AS risk_score, total_issues, critical_issues, high_issues,
  array_to_string(list_filter([
    CASE WHEN critical_issues > 0 THEN '🚨 ' || CAST(critical_issues AS VARCHAR) || ' critical issues require immediate attention' END,
    CASE WHEN high_issues > 0 THEN '⚠️ ' || CAST(high_issues AS VARCHAR) || ' high-priority issues should be addressed soon' END,
    CASE WHEN a > 0.5 THEN '📊 Consider implementing automated code quality checks' END,
    CASE WHEN total_issues > 20 THEN '🔍 Large number of issues detected - consider code review process' END,
    '💡 Focus on security and performance issues first'], lambda x: x IS NOT NULL), ' | ') AS recommendations FROM t"""
SUMMARY = f"""summary AS (SELECT (SELECT count(*) FROM files) AS files_analyzed,
  (SELECT CAST(sum(len(ls)) AS BIGINT) FROM files) AS lines_of_code, (SELECT {N} FROM issues) AS total_issues)"""
ORACLE["run_summary"] = f"WITH {BASIC}, {SUMMARY} SELECT * FROM summary"
ORACLE["category_counts"] = f"""WITH {ENHANCED} SELECT category, upper(category[1]) || category[2:] AS name,
  upper(category[1]) || category[2:] || ' related issues' AS description, {FOUND} AS issues,
  CASE WHEN sum(findings) > 10 THEN 'critical' WHEN sum(findings) > 5 THEN 'high' WHEN sum(findings) > 2 THEN 'medium' ELSE 'low' END AS level
FROM issues GROUP BY category"""
ORACLE["severity_counts"] = f"WITH {ENHANCED} SELECT severity, {FOUND} AS issues FROM issues GROUP BY severity"
ORACLE["console_counts"] = f"""WITH {BASIC} SELECT {N} AS total_issues,
  CAST(count(*) FILTER (severity = 'high') AS BIGINT) AS high_priority,
  CAST(count(*) FILTER (severity = 'medium') AS BIGINT) AS medium_priority,
  CAST(count(*) FILTER (severity = 'low') AS BIGINT) AS low_priority FROM issues"""
ORACLE["file_complexity_top10"] = f"""WITH {BASIC}, s AS (SELECT regexp_extract(file, '([^/]*)$', 1) AS file_name,
  CAST(sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS score, {N} AS issues
  FROM issues GROUP BY 1)
SELECT *, CASE WHEN score > 15 THEN 'critical' WHEN score > 10 THEN 'high' WHEN score > 5 THEN 'medium' ELSE 'low' END AS level
FROM s ORDER BY score DESC, file_name LIMIT 10"""
_CELLS = ", ".join(f"CAST(coalesce(sum(findings) FILTER (priority = '{p}'), 0) AS BIGINT) AS \"{p}\"" for p in sev.PRIORITIES)
ORACLE["priority_matrix"] = f"WITH {ENHANCED}, {SCORED} SELECT category, {_CELLS} FROM scored GROUP BY category"
ORACLE["selection_rollup"] = f"""WITH {BASIC},
chosen AS (SELECT i.* FROM issues i JOIN files f ON f.path = i.file WHERE f.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT 'category' AS counter, category AS value, {N} AS issues FROM chosen GROUP BY category
UNION ALL SELECT 'severity', severity, {N} FROM chosen GROUP BY severity"""
ORACLE["summary_report"] = f"""WITH {ENHANCED}, {SUMMARY.replace(N, FOUND)},
sevs(i, s) AS (VALUES (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'low'))
SELECT 0 AS ord, '# Code Quality Analysis Report' AS line UNION ALL SELECT 1, 'Generated on: 2024-01-01 00:00:00' UNION ALL SELECT 2, ''
UNION ALL SELECT 3, '## Summary' UNION ALL SELECT 4, '- **Files Analyzed**: ' || CAST(files_analyzed AS VARCHAR) FROM summary
UNION ALL SELECT 5, '- **Lines of Code**: ' || format('{{:,}}', lines_of_code) FROM summary
UNION ALL SELECT 6, '- **Total Issues**: ' || CAST(total_issues AS VARCHAR) FROM summary
UNION ALL SELECT 7, '' UNION ALL SELECT 8, '## Issues by Severity'
UNION ALL SELECT 20 + i, '- **' || upper(s[1]) || s[2:] || '**: ' || CAST((SELECT coalesce(sum(findings), 0) FROM issues WHERE severity = s) AS VARCHAR) FROM sevs
UNION ALL SELECT 24, '' UNION ALL SELECT 25, '## Issues by Category'
UNION ALL SELECT 30, '- **' || upper(category[1]) || category[2:] || '**: ' || CAST(sum(findings) AS VARCHAR) FROM issues GROUP BY category
UNION ALL SELECT 40, '' UNION ALL SELECT 41, '## Recommendations'
UNION ALL SELECT 42, '- Focus on critical and high-priority issues first' UNION ALL SELECT 43, '- Implement automated code quality checks'
UNION ALL SELECT 44, '- Consider code review processes for complex files' UNION ALL SELECT 45, '- Regular monitoring of code quality metrics'"""

_matrix = " UNION ALL ".join(
    f"SELECT 'priority_matrix' AS part, category AS item, '{p}' AS label, CAST(coalesce(sum(findings) FILTER (priority = '{p}'), 0) AS BIGINT) AS n FROM scored GROUP BY category"
    for p in sev.PRIORITIES
)
ORACLE["dashboard"] = f"""WITH {ENHANCED}, {SUMMARY.replace(N, FOUND)}, {SCORED},
by_file AS (SELECT regexp_extract(coalesce(file, 'unknown'), '([^/]*)$', 1) AS item,
  CAST(sum(findings * CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM issues GROUP BY 1)
SELECT 'run_summary' AS part, 'files_analyzed' AS item, '' AS label, CAST(files_analyzed AS BIGINT) AS n FROM summary
UNION ALL SELECT 'run_summary', 'lines_of_code', '', lines_of_code FROM summary UNION ALL SELECT 'run_summary', 'total_issues', '', total_issues FROM summary
UNION ALL SELECT 'issues_by_category', category, level, issues FROM ({ORACLE["category_counts"]})
UNION ALL SELECT 'severity_distribution', severity, '', issues FROM ({ORACLE["severity_counts"]})
UNION ALL (SELECT 'files_complexity', item, CASE WHEN n > 15 THEN 'critical' WHEN n > 10 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END, n FROM by_file ORDER BY n DESC, item LIMIT 10)
UNION ALL {_matrix}
UNION ALL SELECT 'summary_report', line, '', CAST(ord AS BIGINT) FROM ({ORACLE["summary_report"]})"""

ORACLE["normalized_lines"] = f"WITH {LINES} SELECT path, CAST(line AS INTEGER) AS line, coalesce({NORM}, '') AS norm FROM lines"
ORACLE["duplicate_classes"] = f"""WITH {BLOCKS} SELECT lang_group, block_id, CAST(n AS INTEGER) AS n, members, files, first_path,
  CAST(first_start AS INTEGER) AS first_start, CAST(pairs AS VARCHAR) AS pairs FROM classes"""
ORACLE["duplicate_links"] = f"WITH {BLOCKS} SELECT * REPLACE (CAST(pairs AS VARCHAR) AS pairs) FROM links WHERE pairs > 0"
_span = lambda s: f"CAST({s} AS VARCHAR) || '-' || CAST({s} + 4 AS VARCHAR)"
ORACLE["duplicate_blocks"] = f"""WITH {BLOCKS}
SELECT 'DUP-01' AS rule_id, 'Code duplication detected across ' || CAST(files AS VARCHAR) || ' files' AS message, first_path AS file1, NULL AS file2,
  {_span('first_start')} AS lines1, NULL AS lines2, CAST(1.0 AS DOUBLE) AS similarity, CAST(pairs AS VARCHAR) AS findings FROM classes
UNION ALL SELECT 'DUP-01', 'Code duplication detected between two groups of blocks', a.first.path, b.first.path, {_span('a.first.start')}, {_span('b.first.start')},
  0.8, CAST(l.pairs AS VARCHAR)
  FROM links l JOIN cls a ON a.lang_group = l.lang_group AND a.block_id = l.block5 JOIN cls b ON b.lang_group = l.lang_group AND b.block_id = l.block4 WHERE l.pairs > 0"""


def _similar(window: int, threshold: float) -> str:
    """Classes, and pairs of classes from an inverted index of all their lines."""
    return f"""{LINES},
fps AS (SELECT path, CASE WHEN language = 'python' THEN 'python' ELSE 'script' END AS lang_group, list(md5(coalesce({NORM}, '')) ORDER BY line) AS fp FROM lines GROUP BY ALL),
keyed AS (SELECT path, lang_group, i AS start, list_sort(list_distinct(fp[i:i + {window - 1}])) AS key FROM fps, unnest(range(1, len(fp) - {window - 2})) AS t(i)),
sets AS (SELECT lang_group, path, key, md5(array_to_string(key, ',')) AS id, count(*) AS cnt, min(start) AS start FROM keyed GROUP BY lang_group, path, key),
cls AS (SELECT lang_group, id, any_value(key) AS key, any_value(len(key)) AS n, sum(cnt) AS members, count(*) AS files, sum(cnt * cnt) AS sq,
  min({{'path': path, 'start': start}}) AS first FROM sets GROUP BY lang_group, id),
idx AS (SELECT lang_group, id, n, members, unnest(key) AS token FROM cls),
links AS (SELECT a.lang_group, a.id AS a, b.id AS b, any_value(b.members) AS members, count(*) AS common, any_value(a.n) AS an, any_value(b.n) AS bn
  FROM idx a JOIN idx b ON a.lang_group = b.lang_group AND a.token = b.token AND a.id <> b.id GROUP BY a.lang_group, a.id, b.id
  HAVING count(*) >= {threshold} * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9)"""


def _similar_classes(window: int, threshold: float) -> str:
    return f"""WITH {_similar(window, threshold)},
inside AS (SELECT l.lang_group, l.a, sum(x.cnt * y.cnt) AS inside FROM links l JOIN sets x ON x.lang_group = l.lang_group AND x.id = l.a
  JOIN sets y ON y.lang_group = l.lang_group AND y.id = l.b AND y.path = x.path GROUP BY ALL),
linked AS (SELECT lang_group, a, count(*) AS n_links, sum(members) AS members FROM links GROUP BY ALL),
told AS (SELECT c.*, coalesce(l.n_links, 0) AS n_links, c.members * coalesce(l.members, 0) - coalesce(i.inside, 0) AS near, (c.members * c.members - c.sq) // 2 AS equal
  FROM cls c LEFT JOIN linked l ON l.lang_group = c.lang_group AND l.a = c.id LEFT JOIN inside i ON i.lang_group = c.lang_group AND i.a = c.id)
SELECT lang_group, CAST(n AS INTEGER) AS n, CAST(members AS BIGINT) AS members, files, first.path AS first_path, CAST(first.start AS INTEGER) AS first_start,
  CAST(CAST(equal AS DECIMAL(38,0)) AS VARCHAR) AS equal_pairs, n_links, CAST(CAST(near AS DECIMAL(38,0)) AS VARCHAR) AS near_pairs FROM told WHERE equal > 0 OR near > 0"""


ORACLE["similar_blocks_short"] = _similar_classes(3, 0.5)
ORACLE["similar_blocks_long"] = _similar_classes(8, 0.7)
ORACLE["similar_pairs_of_selection"] = f"""WITH {_similar(10, 0.75)},
mine AS (SELECT * FROM sets WHERE path IN (SELECT path FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))),
near AS (SELECT lang_group, a, b, round(CAST(common AS DOUBLE) / (an + bn - common), 6) AS similarity FROM links UNION ALL SELECT lang_group, id, id, 1.0 FROM cls)
SELECT m.lang_group, m.path AS path1, CAST(m.start AS INTEGER) AS start1, o.path AS path2, CAST(o.start AS INTEGER) AS start2, CAST(similarity AS DOUBLE) AS similarity,
  CAST(m.cnt * o.cnt AS BIGINT) AS pairs
FROM mine m JOIN near n ON n.lang_group = m.lang_group AND n.a = m.id JOIN sets o ON o.lang_group = n.lang_group AND o.id = n.b WHERE o.path <> m.path"""
ORACLE["duplicate_members"] = f"""WITH {BLOCKS} SELECT lang_group, block_id, path, CAST(start AS INTEGER) AS start FROM blocks JOIN classes USING (lang_group, block_id)"""
ORACLE["duplicate_pairs_of_selection"] = f"""WITH {BLOCKS},
mine AS (SELECT * FROM blocks WHERE path IN (SELECT path FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))),
near AS (SELECT lang_group, block5 AS a, block4 AS b FROM links WHERE pairs > 0 UNION ALL SELECT lang_group, block4, block5 FROM links WHERE pairs > 0)
SELECT m.lang_group, m.path AS path1, CAST(m.start AS INTEGER) AS start1, b.path AS path2, CAST(b.start AS INTEGER) AS start2, CAST(1.0 AS DOUBLE) AS similarity
  FROM mine m JOIN blocks b USING (lang_group, block_id) WHERE b.path <> m.path
UNION ALL SELECT m.lang_group, m.path, CAST(m.start AS INTEGER), b.path, CAST(b.start AS INTEGER), 0.8
  FROM mine m JOIN near n ON n.lang_group = m.lang_group AND n.a = m.block_id
  JOIN blocks b ON b.lang_group = n.lang_group AND b.block_id = n.b WHERE b.path <> m.path"""

# ---- structure -----------------------------------------------------------------------------------------
# Definitions of the corpus stand on lines of their own, so entities can be read off the lines.

_fn = r"function\s+(\w+)\s*\([^)]*\)\s*\{"
_arrow = r"const\s+(\w+)\s*=\s*\([^)]*\)\s*=>"
_cls = r"class\s+(\w+)(?:\s+extends\s+\w+)?\s*\{"
_imp = r"""import\s+(?:\{[^}]*\}|\w+)\s+from\s+['"]([^'"]+)['"]"""


def _entity(lang: str, pattern: str, kind: str, rank: str, params: str = "NULL") -> str:
    return (
        f"SELECT doc_id, path, parent, name AS filename, ext, language, line, text, regexp_extract(text, {_q(pattern)}, 1) AS name, '{kind}' AS type, "
        f"{rank} AS rank, regexp_extract(text, {_q(pattern)}, 0) AS matched, "
        f"CAST({params} AS INTEGER) AS n_params, len(text) - len(ltrim(text, ' ')) AS indent FROM lines "
        f"WHERE language {'=' if lang == 'python' else '<>'} 'python' AND NOT broken AND regexp_matches(text, {_q(pattern)})"
    )


_py_params = "CASE WHEN contains(text, '()') THEN 0 ELSE len(text) - len(replace(text, ',', '')) + 1 END"
ENTS = f"""{LINES}, ents0 AS ({_union([
    _entity('python', r'^\s*def (\w+)', 'function', '0', _py_params),
    _entity('python', r'^\s*class (\w+)', 'class', '0'),
    _entity('python', r'^import (\w+)$', 'import', '0'),
    _entity('python', r'^from \w+ import (\w+)$', 'import', '0'),
    _entity('js', _fn, 'function', '1'),
    _entity('js', _arrow, 'function', '2'),
    _entity('js', _cls, 'class', '3'),
    _entity('js', _imp, 'import', '4'),
])}),
ents AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN language = 'python' THEN least(indent, 1) ELSE rank END, line) - 1 AS pos FROM ents0)"""
EDGES = f"""{ENTS},
spans AS (SELECT e.path, e.name, e.type, e.language, e.line,
    CASE WHEN e.language = 'python'
      THEN coalesce((SELECT min(l.line) FROM lines l WHERE l.path = e.path AND l.line > e.line AND l.text <> ''
                     AND len(l.text) - len(ltrim(l.text, ' ')) <= e.indent), 1000000) - 1
      WHEN contains(e.text, '}}') THEN e.line
      ELSE (SELECT min(l.line) FROM lines l WHERE l.path = e.path AND l.line > e.line AND l.text IN ('}}', '}};')) END AS last
  FROM ents e WHERE type <> 'import'),
words AS (SELECT DISTINCT s.path, s.name AS source, s.line,
    unnest(regexp_extract_all(CASE WHEN s.language = 'python' THEN regexp_replace(l.text, 'def \\w+|class \\w+', '') ELSE l.text END, '\\w+')) AS target
  FROM spans s JOIN lines l ON l.path = s.path AND l.line BETWEEN s.line AND s.last
  UNION SELECT path, name, line, name FROM ents WHERE type = 'import' AND NOT starts_with(text, 'from ')),
edges AS (SELECT DISTINCT source, target, 'uses' AS relationship_type, path AS file_path, CAST(line AS INTEGER) AS line_number
  FROM words w WHERE EXISTS (SELECT 1 FROM ents e WHERE e.path = w.path AND e.name = w.target))"""
ORACLE["entity_list"] = f"WITH {ENTS} SELECT path AS file_path, name, type, CAST(line AS INTEGER) AS line_number, coalesce(n_params, 0) AS n_params FROM ents"
ORACLE["entity_edges"] = f"WITH {EDGES} SELECT * FROM edges"
ORACLE["entity_edge_lookup"] = f"WITH {EDGES} SELECT * FROM edges WHERE source = 'os' OR target = 'os'"
ORACLE["entity_name_lookup"] = f"""WITH {ENTS} SELECT path AS file_path, name, type, CAST(line AS INTEGER) AS line_number FROM ents
WHERE contains(lower(name), 'widget_1')"""
ORACLE["entity_type_counts"] = f"WITH {ENTS} SELECT type, count(*) AS entities FROM ents GROUP BY type"
ORACLE["structure_totals"] = f"""WITH {EDGES} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM ents) AS entities,
  (SELECT count(*) FROM edges) AS edges"""
ORACLE["shared_parse"] = f"""WITH {ENTS}, issues AS ({_union(_basic(True))})
SELECT 'rule' AS part, rule_id AS item, count(*) AS n FROM issues GROUP BY rule_id UNION ALL SELECT 'entity', type, count(*) FROM ents GROUP BY type"""
IMPORTS = f"""{ENTS},
wanted AS (SELECT path AS source, language = 'python' AS py, parent || '/' ||
    CASE WHEN language = 'python' THEN coalesce(nullif(regexp_extract(text, '^from (\\w+) import', 1), ''), name) ELSE replace(name, './', '') END AS key
  FROM ents WHERE type = 'import'),
import_edges AS (SELECT DISTINCT w.source, f.path AS target FROM wanted w JOIN files f ON w.py = (f.language = 'python') AND w.key = f.parent || '/' || f.stem)"""
ORACLE["import_graph"] = f"WITH {IMPORTS} SELECT * FROM import_edges"
ORACLE["import_degrees"] = f"""WITH {IMPORTS} SELECT path, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT source AS path, 1 AS o, 0 AS i FROM import_edges UNION ALL SELECT target, 0, 1 FROM import_edges) GROUP BY path"""

DEPS = f"""{EDGES},
script_words AS (
  SELECT s.path, s.name, s.line, unnest(regexp_extract_all(l.text, '\\w+')) AS w, false AS call FROM spans s JOIN lines l ON l.path = s.path AND l.line BETWEEN s.line AND s.last WHERE s.language <> 'python'
  UNION ALL SELECT s.path, s.name, s.line, unnest(regexp_extract_all(l.text, '(\\w+)\\s*\\(', 1)), true FROM spans s JOIN lines l ON l.path = s.path AND l.line BETWEEN s.line AND s.last WHERE s.language <> 'python'),
script_deps AS (SELECT path, name, line, count(DISTINCT w) AS n FROM script_words
  WHERE call OR w NOT IN ('var', 'let', 'const', 'function', 'if', 'else', 'for', 'while', 'return') GROUP BY ALL),
counted AS (SELECT e.*, CASE WHEN type = 'import' THEN 1 WHEN e.language <> 'python' THEN d.n
    WHEN e.name LIKE 'run\\_%' ESCAPE '\\' THEN 7 + CAST(doc_id % 7 = 0 AS INTEGER) + 2 * CAST(doc_id % 6 = 0 AS INTEGER)
    WHEN e.name LIKE 'helper%' THEN 5 + CAST(doc_id % 8 = 0 AS INTEGER) WHEN e.name LIKE 'branchy%' THEN 2
    WHEN type = 'class' AND e.name LIKE 'Widget%' THEN 5 WHEN e.name = '__init__' THEN 4 WHEN e.name LIKE 'check%' THEN 1 ELSE 0 END AS deps,
    CASE WHEN e.language = 'python' AND type = 'function' AND e.name LIKE 'run%' AND doc_id % 4 < 2 THEN 'Run.'
         WHEN e.language = 'python' AND type = 'class' AND e.name LIKE 'Widget%' AND doc_id % 2 = 0 THEN 'A widget.' END AS docstring,
    CASE WHEN type = 'import' OR e.language <> 'python' THEN matched ELSE ltrim((SELECT string_agg(l.text, chr(10) ORDER BY l.line) FROM lines l
       WHERE l.path = e.path AND l.line BETWEEN e.line AND (SELECT max(m.line) FROM lines m, spans s WHERE m.path = e.path AND s.path = e.path
         AND s.line = e.line AND s.name = e.name AND m.text <> '' AND m.line BETWEEN s.line AND s.last)), ' ') END AS content
  FROM ents e LEFT JOIN script_deps d USING (path, name, line)),
named_deps AS (SELECT name, deps FROM counted WHERE deps > 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY path DESC, pos DESC) = 1)"""
ORACLE["top_dependencies"] = f"WITH {DEPS} SELECT name, CAST(deps AS INTEGER) AS dependencies FROM named_deps ORDER BY deps DESC, name LIMIT 5"
ORACLE["codebase_summary"] = f"""WITH {DEPS}, top AS (SELECT name, deps FROM named_deps ORDER BY deps DESC, name LIMIT 5)
SELECT 0 AS ord, 'Codebase Summary for corpus' AS line UNION ALL SELECT 1, ''
UNION ALL SELECT 2, '**Files Analyzed:** ' || CAST(count(*) AS VARCHAR) FROM files UNION ALL SELECT 3, '**Code Entities:** ' || CAST(count(*) AS VARCHAR) FROM ents
UNION ALL SELECT 4, '**Relationships:** ' || CAST(count(*) AS VARCHAR) FROM edges UNION ALL SELECT 5, '' UNION ALL SELECT 6, '**Entity Types:**'
UNION ALL SELECT 7, '- ' || type || ': ' || CAST(count(*) AS VARCHAR) FROM ents GROUP BY type
UNION ALL SELECT 8, '' UNION ALL SELECT 9, '**Most Complex Entities (by dependencies):**'
UNION ALL SELECT 10, '- ' || name || ': ' || CAST(deps AS VARCHAR) || ' dependencies' FROM top"""
ORACLE["entity_details"] = f"""WITH {DEPS} SELECT path AS file_path, CAST(pos AS INTEGER) AS pos, name, type, CAST(line AS INTEGER) AS line_number, content, docstring,
  CAST(deps AS INTEGER) AS n_dependencies FROM counted"""
_shown = "CASE ext WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.jsx' THEN 'JavaScript' ELSE 'TypeScript' END"
_flag = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
ORACLE["document_metadata"] = f"""WITH {DEPS}
SELECT path || '#0' AS doc_id, path AS source, name AS filename, ext AS file_extension, 'code_file' AS type, NULL AS entity_name, NULL AS entity_type,
  NULL AS line_number, {_shown} AS language, 'True' AS ast_parsed, NULL AS has_docstring, NULL AS has_parameters, NULL AS has_dependencies,
  substr(content, 1, 1000) AS code_content FROM files
UNION ALL SELECT path || '#' || CAST(pos + 1 AS VARCHAR), path, filename, ext, 'entity', name, type, CAST(line AS VARCHAR), {_shown}, 'True',
  {_flag('docstring IS NOT NULL')}, {_flag('coalesce(n_params, 0) > 0')}, {_flag('deps > 0')}, substr(content, 1, 1000) FROM counted"""

FILE_DOCUMENTS = f"""bullets AS (SELECT path, count(*) AS n, string_agg(DISTINCT type, ', ' ORDER BY type) AS types,
  string_agg('- ' || name || ' (' || type || ') at line ' || CAST(line AS VARCHAR)
    || coalesce(chr(10) || '  Docstring: ' || substr(docstring, 1, 100) || '...', '')
    || CASE WHEN n_params > 0 THEN chr(10) || '  Parameters: ' || regexp_extract(text, '\\(([^)]*)\\)', 1) ELSE '' END, chr(10) ORDER BY pos) AS list
  FROM counted GROUP BY path),
file_docs AS (SELECT f.path || '#0' AS doc_id, trim('File: ' || f.name || chr(10) || 'Language: ' || {_shown} || chr(10) || 'Extension: ' || f.ext || chr(10)
  || 'Total Entities: ' || CAST(coalesce(b.n, 0) AS VARCHAR) || chr(10) || 'Entity Types: ' || coalesce(types, '') || chr(10) || chr(10)
  || 'Code Content:' || chr(10) || f.content || chr(10) || chr(10) || 'AST Parsed Entities:' || chr(10) || coalesce(list, 'No entities found'), {TRIM}) AS content
FROM files f LEFT JOIN bullets b USING (path))"""
ORACLE["file_documents"] = f"WITH {DEPS}, {FILE_DOCUMENTS} SELECT * FROM file_docs"

# ---- documents, chunks, retrieval ----------------------------------------------------------------------


def _fixed(source: str, text: str, columns: str) -> str:
    return (
        f"SELECT {columns}, CAST(c AS INTEGER) AS chunk_no, substr({text}, CAST(1 + 800 * c AS BIGINT), 1000) AS text "
        f"FROM {source}, unnest(range(0, 1 + (greatest(len({text}) - 200, 1) - 1) // 800)) AS t(c)"
    )


TEXT_CHUNKS = f"""docs AS (SELECT *, source AS src, source || '/m' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents),
chunks0 AS ({_fixed('docs', 'text', "doc_id AS num, src, path AS source, 'm' || CAST(doc_id AS VARCHAR) || '.txt' AS filename")}),
chunks AS (SELECT *, source || '#' || CAST(chunk_no AS VARCHAR) AS chunk_id FROM chunks0)"""
ORACLE["chunk_fixed"] = f"WITH {TEXT_CHUNKS} SELECT chunk_id, source, chunk_no, text FROM chunks"
ORACLE["chunk_stats"] = f"""WITH {TEXT_CHUNKS} SELECT 'total' AS breakdown, '' AS value, count(*) AS chunks FROM chunks
UNION ALL SELECT 'files', filename, count(*) FROM chunks GROUP BY filename
UNION ALL SELECT 'entity_types', 'code', count(*) FROM chunks
UNION ALL SELECT 'languages', src, count(*) FROM chunks GROUP BY src"""
ORACLE["corpus_chunk_summary"] = f"""WITH {TEXT_CHUNKS} SELECT 'Codebase Summary:' || chr(10) || '- Total indexed chunks: ' || CAST(count(*) AS VARCHAR)
  || chr(10) || '- File types found: .txt' || chr(10) AS summary FROM chunks"""


def _recursive(texts: str) -> str:
    """CTEs that cut ``texts(id, text)`` into separator-aware chunks, ``recursive_chunks(id, chunk_no, text)``.

    Level by level, a text that holds the separator falls into pieces; long pieces go to the next level, and what lies between two of
    them is a run.  ``way`` orders runs within a text.  Windows of a run follow each other by sums of lengths alone.
    """
    out, size, overlap = [f"u0 AS (SELECT id, CAST([] AS INTEGER[]) AS way, text FROM {texts})"], 1000, 200
    for n, sep in enumerate(["chr(10) || chr(10)", "chr(10)", "' '"]):
        out.append(f"""cut{n} AS (SELECT id, way, list_filter(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN i = 1 THEN parts[1] ELSE {sep} || parts[i] END), lambda p: p <> '') AS ps
  FROM (SELECT id, way, string_split(text, {sep}) AS parts FROM u{n} WHERE contains(text, {sep}))),
row{n} AS (SELECT id, way, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS i FROM cut{n}),
num{n} AS (SELECT *, CAST(sum(CASE WHEN length(piece) >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY id, way ORDER BY i) AS INTEGER) AS k FROM row{n}),
run{n} AS (SELECT id, list_append(way, 2 * k) AS way, list(piece ORDER BY i) AS pieces FROM num{n} WHERE length(piece) < {size} GROUP BY id, list_append(way, 2 * k)),
u{n + 1} AS (SELECT id, list_append(way, 2 * k - 1) AS way, piece AS text FROM num{n} WHERE length(piece) >= {size} UNION ALL SELECT * FROM u{n} WHERE NOT contains(text, {sep}))""")
    out.append(f"""runs0 AS (SELECT * FROM run0 UNION ALL SELECT * FROM run1 UNION ALL SELECT * FROM run2 UNION ALL SELECT id, way, string_split(text, '') FROM u3 WHERE text <> ''),
lens AS (SELECT id, way, sum(length(piece)) OVER (PARTITION BY id, way ORDER BY i) AS upto, i FROM (SELECT id, way, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM runs0)),
runs AS (SELECT r.*, l.sums FROM runs0 r JOIN (SELECT id, way, list_prepend(0, list(CAST(upto AS BIGINT) ORDER BY i)) AS sums FROM lens GROUP BY id, way) l ON l.id = r.id AND l.way = r.way),
cuts AS (
  SELECT id, way, 0 AS n, CAST(0 AS BIGINT) AS first, CAST(len(list_filter(sums, lambda c: c <= {size})) - 1 AS BIGINT) AS past FROM runs
  UNION ALL
  SELECT id, way, n, first, CAST(len(list_filter(sums, lambda c: c <= sums[first + 1] + {size})) - 1 AS BIGINT) FROM (
    SELECT r.id, r.way, c.n + 1 AS n, r.sums,
      CAST(len(list_filter(r.sums, lambda x: x < r.sums[c.past + 1] - least({overlap}, {size} - length(r.pieces[c.past + 1])))) AS BIGINT) AS first
    FROM cuts c JOIN runs r ON r.id = c.id AND r.way = c.way WHERE c.past < len(r.pieces))
),
recursive_chunks AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY way, n) - 1 AS chunk_no, text FROM (
  SELECT c.id, c.way, c.n, trim(array_to_string(r.pieces[c.first + 1:c.past], ''), {TRIM}) AS text FROM cuts c JOIN runs r ON r.id = c.id AND r.way = c.way) WHERE text <> '')""")
    return ",\n".join(out)


ORACLE["chunk_recursive"] = f"""WITH RECURSIVE plain AS (SELECT 'm' || CAST(doc_id AS VARCHAR) || '.txt' AS id,
  replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE text IS NOT NULL),
{_recursive("plain")} SELECT id || '#' || CAST(chunk_no AS VARCHAR) AS chunk_id, text FROM recursive_chunks"""
# What the corpus' entities use, by template; names that occur in a script's block come from its words.
_id = "CAST(doc_id AS VARCHAR)"
_uses = f"""CASE WHEN type = 'import' AND language = 'python' AND starts_with(text, 'from ') THEN [regexp_extract(text, '^from (\\w+) import', 1) || '.' || name]
    WHEN type = 'import' THEN [name]
    WHEN language <> 'python' THEN (SELECT list(DISTINCT w.w ORDER BY w.w) FROM script_words w WHERE w.path = c.path AND w.name = c.name AND w.line = c.line
      AND (w.call OR w.w NOT IN ('var', 'let', 'const', 'function', 'if', 'else', 'for', 'while', 'return')))
    WHEN name LIKE 'run\\_%' ESCAPE '\\' THEN list_concat(list_concat(['helper_' || {_id}, 'a', 'range', 'len', 'b', 'dumps', 'c'],
      CASE WHEN doc_id % 7 = 0 THEN ['eval'] ELSE [] END), CASE WHEN doc_id % 6 = 0 THEN ['cursor', 'execute'] ELSE [] END)
    WHEN name LIKE 'helper%' THEN list_concat(['i', 'x', 'j', 'os', 'join'], CASE WHEN doc_id % 8 = 0 THEN ['s'] ELSE [] END)
    WHEN name LIKE 'branchy%' THEN ['x', 'a'] WHEN type = 'class' AND name LIKE 'Widget%' THEN ['Base', 'self', 'run_' || {_id}, 'a', 'b']
    WHEN name = '__init__' THEN ['self', 'run_' || {_id}, 'a', 'b'] WHEN name LIKE 'check%' THEN ['run_' || {_id}] ELSE [] END"""
_listed = lambda x: f"'[' || chr(39) || array_to_string({x}, chr(39) || ', ' || chr(39)) || chr(39) || ']'"
CODE_DOCUMENTS = f"""{DEPS},
used AS (SELECT *, list_sort(coalesce({_uses}, [])) AS uses, CASE WHEN n_params > 0 THEN string_split(regexp_extract(text, '\\(([^)]*)\\)', 1), ', ') END AS params FROM counted c),
{FILE_DOCUMENTS},
code_docs AS (
  SELECT f.path || '#0' AS doc_id, f.path AS source, f.name AS filename, f.ext AS file_extension, 'code_file' AS type, NULL AS entity_name, NULL AS entity_type,
    CAST(NULL AS INTEGER) AS line_number, {_shown} AS language, true AS ast_parsed, CAST(NULL AS BOOLEAN) AS has_docstring, CAST(NULL AS BOOLEAN) AS has_parameters,
    CAST(NULL AS BOOLEAN) AS has_dependencies, 0 AS doc_no, d.content FROM files f JOIN file_docs d ON d.doc_id = f.path || '#0'
  UNION ALL SELECT path || '#' || CAST(pos + 1 AS VARCHAR), path, filename, ext, 'entity', name, type, CAST(line AS INTEGER), {_shown}, true,
    docstring IS NOT NULL, coalesce(n_params, 0) > 0, len(uses) > 0, CAST(pos + 1 AS INTEGER), trim('Entity: ' || name || chr(10) || 'Type: ' || type || chr(10) || 'File: ' || filename
    || chr(10) || 'Line: ' || CAST(line AS VARCHAR) || chr(10) || 'Language: ' || {_shown} || chr(10) || 'AST Parsed: True' || chr(10) || chr(10) || 'Code Content:' || chr(10) || content
    || chr(10) || chr(10) || 'Docstring: ' || coalesce(docstring, 'No docstring') || chr(10) || 'Parameters: ' || coalesce({_listed("params")}, 'No parameters')
    || chr(10) || 'Dependencies: ' || CASE WHEN len(uses) > 0 THEN {_listed("uses")} ELSE 'No dependencies' END
    || chr(10) || chr(10) || 'Context: This ' || type || ' is defined in ' || filename || ' at line ' || CAST(line AS VARCHAR) || '.', {TRIM}) FROM used)"""
ORACLE["code_documents"] = f"""WITH {CODE_DOCUMENTS} SELECT * FROM code_docs"""
ORACLE["code_chunk_stats"] = f"""WITH RECURSIVE {CODE_DOCUMENTS}, code_texts AS (SELECT doc_id AS id, content AS text FROM code_docs),
{_recursive("code_texts")},
told AS (SELECT d.* FROM recursive_chunks r JOIN code_docs d ON d.doc_id = r.id)
SELECT 'total' AS breakdown, '' AS value, count(*) AS chunks FROM told UNION ALL SELECT 'files', filename, count(*) FROM told GROUP BY filename
UNION ALL SELECT 'entity_types', type, count(*) FROM told GROUP BY type UNION ALL SELECT 'languages', language, count(*) FROM told GROUP BY language"""
CODE_CHUNKS = f"{FILES}, code_chunks AS ({_fixed('files', 'content', 'path, name AS filename, ext')})"
ORACLE["chunks_by_extension"] = f"""WITH {CODE_CHUNKS} SELECT path || '#' || CAST(chunk_no AS VARCHAR) AS chunk_id, filename FROM code_chunks WHERE ext = '.tsx'"""
ORACLE["index_report"] = f"""WITH {EDGES}, code_chunks AS ({_fixed('files', 'content', 'path')})
SELECT (SELECT count(*) FROM files) AS documents_indexed, (SELECT count(*) FROM code_chunks) AS chunks_created,
  (SELECT count(*) FROM ents) AS entities_found, (SELECT count(*) FROM edges) AS relationships_found"""

_dist = "power(list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 2)"
ORACLE["knn_topk"] = f"""SELECT qid, item_id, round(d, 6) AS dist, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, item_id) AS INTEGER) AS rank FROM (
    SELECT a.vec_id AS qid, b.vec_id AS item_id, {_dist.format(a='a.embedding', b='b.embedding')} AS d FROM embeddings a, embeddings b))
WHERE rank <= 5"""
ORACLE["knn_topk_batched"] = ORACLE["knn_topk"]

# Centres: 32 vectors by the hash of their ids; every vector lies in the cell of its nearest centre.
ORACLE["knn_indexed"] = f"""WITH centres AS (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS cell, embedding AS centre FROM embeddings
  QUALIFY cell < 32),
near AS (SELECT e.vec_id, e.embedding, c.cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY round({_dist.format(a='e.embedding', b='c.centre')}, 9), c.cell) AS nth
  FROM embeddings e, centres c),
found AS (SELECT q.vec_id AS qid, i.vec_id AS item_id, {_dist.format(a='q.embedding', b='i.embedding')} AS d
  FROM (SELECT * FROM near WHERE nth <= 16) q JOIN (SELECT * FROM near WHERE nth = 1) i ON q.cell = i.cell)
SELECT qid, item_id, round(d, 6) AS dist, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, item_id) AS INTEGER) AS rank FROM found) WHERE rank <= 5"""

QUESTIONS = """turns AS (SELECT conv_id, turn, text, conv_id * 31 + turn AS key FROM conversations WHERE role = 'user'),
asked AS (SELECT conv_id * 1000 + turn AS qid, key % (SELECT count(*) FROM embeddings) AS vec_id, text || CASE key % 4
    WHEN 0 THEN ' What is in m' || CAST(conv_id AS VARCHAR) || '.txt, file m' || CAST(conv_id AS VARCHAR) || '.txt?'
    WHEN 1 THEN ' Which function is the longest?'
    WHEN 2 THEN ' Explain load_' || CAST(conv_id * 5 + 2 AS VARCHAR) || ' and Widget_' || CAST(conv_id * 5 AS VARCHAR)
    ELSE ' Show m' || CAST(conv_id * 5 AS VARCHAR) || '.py please' END AS question FROM turns)"""
_patterns = [f"({WORD}+\\.{e})" for e in ("py", "js", "ts", "jsx", "tsx")] + [
    f"{w}{SPACE}+({WORD}+\\.{WORD}+)" for w in ("file", "in", "from")
]
_filename = "coalesce(" + ", ".join(f"nullif(regexp_extract(question, {_q('(?i)' + p)}, 1), '')" for p in _patterns) + ")"
QUESTIONS += f""",
questions AS (SELECT a.*, {_filename} AS filename, embedding AS qv FROM asked a JOIN embeddings USING (vec_id))"""
ORACLE["question_filename"] = f"WITH {QUESTIONS} SELECT qid, filename FROM questions"
ORACLE["canned_questions"] = f"""WITH {BASIC} SELECT category, count(*) AS issues, CASE category
  WHEN 'security' THEN 'What security vulnerabilities can you identify in this codebase?'
  WHEN 'documentation' THEN 'What documentation issues do you find?'
  ELSE 'What are the main quality issues and areas for improvement in this codebase?' END AS question FROM issues GROUP BY category"""
HITS = f"""{TEXT_CHUNKS}, {QUESTIONS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY source, chunk_no) AS rn, count(*) OVER (PARTITION BY filename) AS total_hits FROM chunks),
named AS (SELECT *, CAST(rn AS INTEGER) AS hit_no FROM ranked WHERE total_hits <= 10 OR rn <= 2),
file_part AS (SELECT q.qid, 'file' AS hit_kind, n.hit_no, n.source, n.filename, n.text FROM questions q JOIN named n USING (filename) WHERE n.hit_no <= 3),
vectors AS (SELECT c.*, e.embedding AS cv FROM chunks c JOIN embeddings e ON e.vec_id = (c.num * 7 + c.chunk_no) % (SELECT count(*) FROM embeddings)),
pair AS (SELECT qid, qv, vec_id FROM questions WHERE {{which}}),
close AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY d, chunk_id) AS rank FROM (
  SELECT p.qid, v.chunk_id, {_dist.format(a='p.qv', b='v.cv')} AS d FROM pair p, vectors v) QUALIFY rank <= 10),
near AS (SELECT * FROM close JOIN chunks USING (chunk_id))"""
_info = """|| chr(10) || chr(10) || '**File Information:**' || chr(10) || '- Filename: ' || filename || chr(10) || '- Language: Text' || chr(10)
  || '- Extension: .txt' || chr(10) || '- AST Parsed: False' || chr(10) || '- Total Entities: 0' || chr(10) || '- Entity Types: ' || chr(10)"""


def _cut(c: str, n: int) -> str:
    return f"CASE WHEN len({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"


def _hits(k: int) -> str:
    return HITS.replace("{which}", "qid NOT IN (SELECT qid FROM file_part)") + f""",
alike AS (SELECT qid, 'similar' AS hit_kind, CAST(rank AS INTEGER) AS hit_no, source, filename, text {_info} AS text FROM near WHERE rank <= {k}),
hits AS (SELECT * FROM file_part UNION ALL SELECT qid, hit_kind, hit_no, source, filename, {_cut('text', 1000)} FROM alike),
budget0 AS (SELECT *, row_number() OVER w AS part_no, coalesce(sum(len(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM hits WINDOW w AS (PARTITION BY qid ORDER BY len(text), hit_no)),
contexts AS (SELECT qid, string_agg(CASE WHEN before + len(text) <= 2000 THEN text ELSE substr(text, 1, CAST(2000 - before AS BIGINT)) || '...' END,
    chr(10) || chr(10) ORDER BY part_no) AS context
  FROM budget0 WHERE before + len(text) <= 2000 OR 2000 - before > 100 GROUP BY qid),
sources AS (SELECT qid, string_agg('- ' || filename, '; ' ORDER BY hit_no) AS sources FROM hits WHERE hit_no <= 5 GROUP BY qid)"""


ORACLE["file_hits"] = f"WITH {HITS.replace('{which}', 'false')} SELECT filename, chunk_id, hit_no, total_hits FROM named WHERE filename IN (SELECT filename FROM questions)"
ORACLE["file_views"] = f"""WITH {HITS.replace('{which}', 'false')},
b AS (SELECT *, coalesce(sum(len(text)) OVER (PARTITION BY filename ORDER BY hit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM named)
SELECT filename, string_agg(CASE WHEN before + len(text) <= 3000 THEN text ELSE substr(text, 1, CAST(3000 - before AS BIGINT)) || '...' END,
  chr(10) || chr(10) ORDER BY hit_no) AS file_content FROM b WHERE before + len(text) <= 3000 OR 3000 - before > 100 GROUP BY filename"""
ORACLE["retrieval_hits"] = f"""WITH {_hits(3)} SELECT qid, hit_kind, hit_no, source, filename, 'code' AS type, text FROM hits"""
ORACLE["context_budget"] = f"WITH {_hits(10)} SELECT * FROM contexts"
ORACLE["hit_sources"] = f"WITH {_hits(10)} SELECT * FROM sources"


def _lit(s: str) -> str:
    """SQL literal with its newlines spelled out."""
    return " || chr(10) || ".join(_q(x) for x in s.split("\n"))


from codestrata.operators import retrieval as _r  # noqa: E402

ORACLE["prompts"] = f"""WITH {_hits(3)} SELECT qid, coalesce(context, 'No context available.') AS context, coalesce(sources, '') AS sources,
  {_lit(_r.PROMPT_HEAD)} || question || {_lit(chr(10) * 2 + 'Codebase Overview:' + chr(10) * 3 + 'Relevant Code Context:' + chr(10))}
  || coalesce(context, 'No context available.') || {_lit(chr(10) * 2 + _r.PROMPT_RULES)} AS prompt
FROM questions LEFT JOIN contexts USING (qid) LEFT JOIN sources USING (qid)"""
ORACLE["simple_prompts"] = f"""WITH {_hits(3)}, texts AS (SELECT qid, string_agg(text, chr(10) ORDER BY hit_no) AS context FROM hits GROUP BY qid)
SELECT qid, {_lit(_r.SIMPLE_HEAD)} || question || {_lit(chr(10) * 2 + 'Context from codebase:' + chr(10))}
  || coalesce(context, 'No context available.') || {_lit(_r.SIMPLE_TAIL)} AS prompt FROM questions LEFT JOIN texts USING (qid)"""
ORACLE["search_report"] = f"""WITH {HITS.replace('{which}', 'true')},
f AS (SELECT qid, count(*) AS n, string_agg({_cut('text', 200)}, '|' ORDER BY hit_no) AS p FROM questions q JOIN named n USING (filename) GROUP BY qid),
s AS (SELECT qid, count(*) AS n, string_agg({_cut('text', 200)}, '|' ORDER BY rank) AS p FROM near WHERE rank <= 5 GROUP BY qid)
SELECT qid, question, filename AS filename_detected, coalesce(f.n, 0) AS file_hits, coalesce(f.p, '') AS file_previews,
  coalesce(s.n, 0) AS similarity_hits, coalesce(s.p, '') AS similarity_previews, coalesce(f.n, 0) + coalesce(s.n, 0) AS total_results
FROM questions LEFT JOIN f USING (qid) LEFT JOIN s USING (qid)"""
ORACLE["related_entities"] = f"""WITH {ENTS}, {QUESTIONS},
firsts AS (SELECT * FROM ents QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, pos) = 1),
kinds AS (SELECT * FROM ents WHERE type IN ('function', 'class') QUALIFY row_number() OVER (PARTITION BY type, name ORDER BY path, pos) = 1),
matched AS (
  SELECT q.qid, 0 AS stage, e.* FROM questions q JOIN firsts e ON contains(lower(question), lower(name)) OR contains(lower(name), lower(question))
  UNION ALL SELECT q.qid, 1, e.* FROM questions q JOIN kinds e
    ON e.type = CASE WHEN contains(lower(question), 'function') THEN 'function' WHEN contains(lower(question), 'class') THEN 'class' END),
once AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY qid, name ORDER BY stage, path, pos) = 1)
SELECT qid, CAST(related_no AS INTEGER) AS related_no, path AS file_path, name, type, CAST(line AS INTEGER) AS line_number FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY stage, path, pos) AS related_no FROM once) WHERE related_no <= 3"""

# ---- repositories and history --------------------------------------------------------------------------

REPOS = """r AS (SELECT source, count(*) AS n, sum(n_chars) AS chars, min(lang) AS lang, max(doc_id) AS last FROM documents GROUP BY source),
repos AS (SELECT source AS name, lang || '/' || source AS full_name, CASE WHEN last % 3 < 2 THEN 'python tools ' || source END AS description,
  CASE WHEN n % 4 < 3 THEN 'Python' ELSE 'Go' END AS language, CAST(NULL AS VARCHAR) AS languages,
  CAST(CASE WHEN n % 5 > 0 THEN chars ELSE 0 END AS BIGINT) AS stars, CAST(0 AS BIGINT) AS forks, n AS size, '2024-01-01' AS created_at,
  CASE WHEN n % 2 = 0 THEN 'trunk' ELSE 'main' END AS default_branch, CASE WHEN n % 2 = 1 THEN lang || ',' || source ELSE '' END AS topics,
  CASE WHEN n % 3 = 1 THEN 'MIT' END AS license, 'https://github.com/' || lang || '/' || source || '.git' AS url, CAST(NULL AS VARCHAR) AS clone_url FROM r)"""
ORACLE["repository_metadata"] = f"WITH {REPOS} SELECT * FROM repos"
ORACLE["popular_repositories"] = f"""WITH {REPOS} SELECT name, full_name, description, stars, language, url, clone_url FROM repos
WHERE language = 'Python' AND contains(coalesce(description, ''), 'python') ORDER BY stars DESC, full_name LIMIT 10"""
ORACLE["repository_files"] = f"""WITH {FILES} SELECT regexp_extract(path, '^([^/]*)', 1) AS repo, path, name, strlen(content) AS size,
  'https://host/' || path AS download_url FROM files QUALIFY row_number() OVER (PARTITION BY regexp_extract(path, '^([^/]*)', 1) ORDER BY path) <= 100"""
ORACLE["repository_file_counts"] = f"""WITH {FILES} SELECT regexp_extract(path, '^([^/]*)', 1) AS repo, count(*) FILTER (ext IN ('.py', '.js', '.ts')) AS supported_files,
  count(*) FILTER (ext IN ('.py', '.js', '.ts')) > 100 AS large FROM files GROUP BY 1"""
ORACLE["repository_urls"] = """WITH u AS (SELECT page_id, contains(url, 'example.com') AS ok,
  replace(replace(url, 'example.com', 'github.com') || '.git', '.git', '') AS url FROM pages),
p AS (SELECT *, string_split(trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), '/') AS parts FROM u)
SELECT page_id, 'dev' AS branch, CASE WHEN ok AND len(parts) > 1 THEN parts[1] END AS owner, CASE WHEN ok AND len(parts) > 1 THEN parts[2] END AS name,
  CASE WHEN ok AND len(parts) > 1 THEN url END AS url FROM p"""
ORACLE["repository_documents"] = f"""WITH {BASIC}, {REPOS},
c AS (SELECT category AS v, count(*) AS n FROM issues GROUP BY category), s AS (SELECT severity AS v, count(*) AS n FROM issues GROUP BY severity)
SELECT 'repository_info' AS source, 'metadata' AS type, 'Repository: ' || name || chr(10) || 'Description: ' || coalesce(description, 'No description') || chr(10)
  || 'Language: ' || language || chr(10) || 'Stars: ' || CAST(stars AS VARCHAR) || chr(10) || 'URL: ' || url || chr(10) AS content FROM repos
UNION ALL SELECT path, 'code', 'File: ' || path || chr(10) || chr(10) || content FROM files WHERE content <> ''
UNION ALL SELECT 'analysis_summary', 'analysis', 'Analysis Summary:' || chr(10) || 'Total Issues: ' || CAST((SELECT sum(n) FROM c) AS VARCHAR) || chr(10)
  || 'Issues by Category: {{' || (SELECT string_agg('''' || v || ''': ' || CAST(n AS VARCHAR), ', ' ORDER BY '''' || v || ''': ' || CAST(n AS VARCHAR)) FROM c) || '}}' || chr(10)
  || 'Issues by Severity: {{' || (SELECT string_agg('''' || v || ''': ' || CAST(n AS VARCHAR), ', ' ORDER BY '''' || v || ''': ' || CAST(n AS VARCHAR)) FROM s) || '}}' || chr(10)"""
ORACLE["last_turns"] = """WITH t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE role IN ('user', 'assistant')
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t WHERE role = 'user')
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS no, substr(text, 1, 60) || '...' AS question_preview,
  CASE WHEN nr = 'assistant' THEN substr(nt, 1, 100) ELSE '' END || '...' AS answer_preview FROM q WHERE back <= 5"""
