"""SQL forms of the bindings, for the checks."""

from __future__ import annotations

CL = """cl AS (
  SELECT 'repo_' || replace(p.p_brand, 'Brand#', '') AS repo_name,
    'src/b' || replace(p.p_brand, 'Brand#', '') || '/p' || CAST(l.l_partkey AS VARCHAR) || '.py' AS file_path,
    'p' || CAST(l.l_partkey AS VARCHAR) || '.py' AS filename,
    l.l_orderkey AS commit_hash, l.l_linenumber AS line_no, l.l_shipdate AS commit_date,
    'dev' || CAST(o.o_custkey % 7 AS VARCHAR) || '@example.org' AS author_email,
    CASE l.l_orderkey % 8 WHEN 0 THEN 'Fix crash in parser' WHEN 1 THEN 'Add docs'
      WHEN 2 THEN 'prefix cleanup' WHEN 3 THEN 'debug tooling' WHEN 4 THEN 'Closes #12'
      WHEN 5 THEN 'memory-leak in cache' WHEN 6 THEN NULL ELSE 'Refactor module' END AS commit_message,
    l.l_returnflag = 'R' AS is_bug_fix,
    CAST(l.l_quantity AS BIGINT) AS lines_added,
    CAST(round(l.l_discount * 100) AS BIGINT) AS lines_deleted,
    CAST(l.l_quantity AS BIGINT) + CAST(round(l.l_discount * 100) AS BIGINT) AS lines_changed,
    l.l_partkey, l.l_suppkey, l.l_quantity, l.l_discount, l.l_tax
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey)"""

# The same text as the Spark binding builds.
SRC = """src AS (
  SELECT *, CASE WHEN commit_hash % 11 = 0 THEN NULL WHEN commit_hash % 13 = 0 THEN '   '
    WHEN commit_hash % 17 = 0 THEN 'def broken(:' ELSE
    'import os' || chr(10)
    || repeat('import mod_a' || chr(10), CAST(round(l_discount * 100) AS BIGINT) % 3)
    || repeat('def f(a, b=1, *args):' || chr(10) || '    if a:' || chr(10) || '        return b' || chr(10)
       || '    return a' || chr(10), CAST(l_quantity AS BIGINT) % 4)
    || repeat('class C:' || chr(10) || '    def m(self, x):' || chr(10) || '        for i in x:' || chr(10)
       || '            if i:' || chr(10) || '                continue' || chr(10) || '            elif x:' || chr(10)
       || '                pass' || chr(10) || '        return x' || chr(10), CAST(round(l_tax * 100) AS BIGINT) % 3)
    || CASE WHEN l_suppkey % 2 = 0 THEN 'try:' || chr(10) || '    v = 1' || chr(10) || 'except ValueError:' || chr(10)
       || '    v = 2' || chr(10) ELSE '' END
    || 'x = ' || CAST(l_partkey AS VARCHAR) || chr(10) END AS source_code
  FROM cl)"""

LAB = """b AS (SELECT min(commit_date) AS lo, max(commit_date) AS hi FROM cl),
w AS (SELECT CAST(k AS BIGINT) AS window_no, lo + to_days(CAST(k * 90 AS INTEGER)) AS window_start,
    lo + to_days(CAST((k + 1) * 90 AS INTEGER)) AS window_end
  FROM b, generate_series(0, 2000) g(k) WHERE lo + to_days(CAST((k + 1) * 90 AS INTEGER)) < hi),
fx AS (SELECT DISTINCT c.repo_name, c.file_path, w.window_no FROM cl c
  JOIN w ON c.commit_date >= w.window_end AND c.commit_date < w.window_end + INTERVAL 90 DAY WHERE c.is_bug_fix),
cnt AS (SELECT c.repo_name, c.file_path, w.window_no, w.window_start, w.window_end, count(*) AS commits_in_window,
    CAST(sum(CASE WHEN c.is_bug_fix THEN 1 ELSE 0 END) AS BIGINT) AS bug_fix_commits_in_window
  FROM cl c JOIN w ON c.commit_date >= w.window_start AND c.commit_date < w.window_end
  GROUP BY ALL HAVING count(*) >= 2),
lab AS (SELECT cnt.*, fx.file_path IS NOT NULL AS is_buggy FROM cnt LEFT JOIN fx USING (repo_name, file_path, window_no))"""


def process(refs: str) -> str:
    """Metrics by definition for distinct ``repo_name, file_path, window_end`` of ``refs``."""
    return f"""refs AS (SELECT DISTINCT repo_name, file_path, window_end FROM {refs}),
past AS (SELECT r.window_end, c.* FROM refs r JOIN cl c
  ON c.repo_name = r.repo_name AND c.file_path = r.file_path AND c.commit_date <= r.window_end),
tops AS (SELECT repo_name, file_path, window_end, max(n) AS top FROM (
  SELECT repo_name, file_path, window_end, author_email, count(*) AS n FROM past GROUP BY ALL) GROUP BY ALL),
sums AS (SELECT repo_name, file_path, window_end, count(*) AS n,
    sum(CASE WHEN is_bug_fix THEN 1 ELSE 0 END) AS f, max(commit_date) AS m,
    sum(CASE WHEN commit_date >= window_end - INTERVAL 30 DAY THEN lines_changed ELSE 0 END) AS churn30,
    sum(CASE WHEN commit_date >= window_end - INTERVAL 90 DAY THEN lines_changed ELSE 0 END) AS churn90,
    count(DISTINCT CASE WHEN commit_date >= window_end - INTERVAL 30 DAY THEN commit_hash END) AS c30,
    count(DISTINCT CASE WHEN commit_date >= window_end - INTERVAL 90 DAY THEN commit_hash END) AS c90,
    count(DISTINCT CASE WHEN commit_date >= window_end - INTERVAL 90 DAY THEN author_email END) AS a90,
    sum(CASE WHEN is_bug_fix AND commit_date >= window_end - INTERVAL 90 DAY THEN 1 ELSE 0 END) AS f90
  FROM past GROUP BY ALL),
proc AS (SELECT repo_name, file_path, window_end,
    CAST(coalesce(churn30, 0) AS BIGINT) AS code_churn_30d, CAST(coalesce(churn90, 0) AS BIGINT) AS code_churn_90d,
    coalesce(c30, 0) AS commit_count_30d, coalesce(c90, 0) AS commit_count_90d, coalesce(a90, 0) AS author_count_90d,
    CAST(coalesce(f90, 0) AS BIGINT) AS bug_fix_count_90d,
    round(coalesce(CAST(f AS DOUBLE) / n, CAST(0 AS DOUBLE)), 6) AS fix_density,
    date_sub('day', m, window_end) AS days_since_last_change,
    CASE WHEN coalesce(c30, 0) > 0 AND 3 * c30 >= 2 * c90 THEN 1 ELSE 0 END AS commit_burst_30d,
    round(coalesce(CAST(top AS DOUBLE) / n, CAST(0 AS DOUBLE)), 6) AS ownership_score
  FROM refs LEFT JOIN sums USING (repo_name, file_path, window_end) LEFT JOIN tops USING (repo_name, file_path, window_end))"""


FM = (
    process("lab")
    + """,
fm AS (SELECT l.repo_name, l.file_path, l.window_no, l.window_start, l.window_end,
    CAST(l.is_buggy AS INTEGER) AS is_buggy, l.commits_in_window, l.bug_fix_commits_in_window,
    p.* EXCLUDE (repo_name, file_path, window_end)
  FROM lab l LEFT JOIN proc p USING (repo_name, file_path, window_end))"""
)

SC = """sc AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
    round(CASE WHEN o_orderstatus = 'F'
      THEN greatest(((o_custkey * 7919 + o_orderkey * 104729) % 1009) / CAST(1009 AS DOUBLE),
                    ((o_custkey * 31 + o_orderkey * 7907) % 1013) / CAST(1013 AS DOUBLE))
      ELSE ((o_custkey * 7919 + o_orderkey * 104729) % 1009) / CAST(1009 AS DOUBLE) END, 4) AS score
  FROM orders)"""

GAPPY = """gm AS (
  SELECT 'repo_' || replace(p_brand, 'Brand#', '') AS repo_name, 'p' || CAST(l_partkey AS VARCHAR) AS file_path,
    l_orderkey AS change, l_linenumber AS line_no,
    CASE WHEN l_partkey % 10 = 0 OR p_brand = 'Brand#11' THEN NULL ELSE l_quantity END AS quantity,
    CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS tax,
    CASE WHEN l_orderkey % 10 < 6 THEN NULL ELSE l_extendedprice END AS price,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_buggy
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

MODULES = """md AS (
  SELECT CASE p_partkey % 3 WHEN 0 THEN 'src/b' || replace(p_brand, 'Brand#', '') || '/p' || CAST(p_partkey AS VARCHAR) || '.py'
    WHEN 1 THEN 'other/p' || CAST(p_partkey AS VARCHAR) || '.py' ELSE 'none_' || CAST(p_partkey AS VARCHAR) END AS file_path,
    CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS is_buggy, p_partkey
  FROM part)"""

BENCH = """bm AS (
  SELECT p_partkey AS row_key, CAST(p_size AS DOUBLE) AS lines_of_code,
    CAST(p_partkey % 17 + 1 AS DOUBLE) AS cyclomatic_complexity,
    CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS halstead_volume,
    CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 23 AS DOUBLE) END AS lines_of_comments,
    CAST(p_partkey % 9 AS DOUBLE) AS branch_count,
    CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS is_buggy,
    CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS module_kind,
    'KC1_module_' || CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS VARCHAR) AS file_path,
    'KC1' AS repo_name, 'PROMISE' AS dataset_source
  FROM part)"""

_ALL = {"cl": CL, "src": SRC, "lab": LAB, "fm": FM, "sc": SC, "gm": GAPPY, "md": MODULES, "bm": BENCH}
_NEEDS = {"src": ["cl"], "lab": ["cl"], "fm": ["cl", "lab"]}


def sql(tables: str, select: str) -> str:
    """``WITH`` the named binding tables (and what they need), then ``select``."""
    wanted: list[str] = []
    for name in tables.split():
        for part in [*_NEEDS.get(name, []), name]:
            if part not in wanted:
                wanted.append(part)
    joined = ",\n".join(_ALL[n] for n in wanted)
    body = select.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {joined},\n{body[5:]}"
    return f"WITH {joined}\n{body}"
