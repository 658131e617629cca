"""Queries: reports, statistics, splits, metrics, models, structure and explanations."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from riskloom.operators import (
    attribution,
    explain,
    graph,
    isotonic,
    joins,
    labels,
    metrics,
    neighbors,
    process,
    reports,
    runs,
    splits,
    statistics,
    structure,
    topk,
    training,
)
from riskloom.operators.history import store_history
from riskloom.plans import bindings as bind
from riskloom.plans import flows
from riskloom.plans.registry import query
from riskloom.plans.sqltext import sql
from riskloom.session import fresh_path
from riskloom.sources.snapshots import latest_source_snapshot
from riskloom.sources.tables import table, write_table

FILE_KEYS = ["repo_name", "file_path"]
ROW_KEYS = ["repo_name", "file_path", "window_no"]
STAT_COLUMNS = ["code_churn_90d", "commit_count_90d", "author_count_90d", "fix_density", "days_since_last_change", "ownership_score"]


def more(tables, ctes, select):
    return sql(tables, f"WITH {ctes}\n{select}")


def union_all(parts):
    return " UNION ALL ".join(parts)


# --- reports -------------------------------------------------------------------


@query(
    "mining_summary",
    sql(
        "cl",
        """SELECT *, round(buggy_files / CAST(total_files AS DOUBLE), 3) AS bug_ratio FROM (
  SELECT count(DISTINCT commit_hash) AS total_commits, count(DISTINCT (repo_name, file_path)) AS total_files,
    count(DISTINCT commit_hash) FILTER (is_bug_fix) AS bug_fix_commits,
    count(DISTINCT (repo_name, file_path)) FILTER (is_bug_fix) AS buggy_files,
    CAST(min(commit_date) AS DATE) AS first_date, CAST(max(commit_date) AS DATE) AS last_date FROM cl)""",
    ),
)
def mining_summary(spark, folder):
    return reports.mining_summary(bind.change_log(spark, folder))


@query(
    "repo_breakdown",
    sql(
        "lab",
        """SELECT repo_name, count(*) AS files, count(*) FILTER (is_buggy) AS buggy,
  round(avg(CAST(is_buggy AS INTEGER)), 6) AS bug_rate FROM lab GROUP BY ALL""",
    ),
)
def repo_breakdown(spark, folder):
    return reports.repo_breakdown(bind.labels(spark, folder))


@query(
    "monthly_activity",
    more(
        "cl",
        """c AS (SELECT * FROM cl),
  s AS (SELECT unnest(generate_series(date_trunc('month', min(commit_date)), date_trunc('month', max(commit_date)), INTERVAL 1 MONTH)) AS m FROM c),
  g AS (SELECT date_trunc('month', commit_date) AS m, count(DISTINCT commit_hash) AS changes,
    count(DISTINCT commit_hash) FILTER (is_bug_fix) AS fix_changes FROM c GROUP BY ALL)""",
        "SELECT CAST(s.m AS DATE) AS month, coalesce(changes, 0) AS changes, coalesce(fix_changes, 0) AS fix_changes FROM s LEFT JOIN g USING (m)",
    ),
)
def monthly_activity(spark, folder):
    return reports.monthly_activity(bind.change_log(spark, folder))


_DESCRIBE = """SELECT count(*) AS n, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, CAST(min({x}) AS DOUBLE) AS min,
  round(quantile_cont(CAST({x} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({x} AS DOUBLE), 0.5), 6) AS p50,
  round(quantile_cont(CAST({x} AS DOUBLE), 0.75), 6) AS p75, CAST(max({x}) AS DOUBLE) AS max FROM d"""


@query(
    "files_per_fix_change",
    more(
        "cl",
        "d AS (SELECT commit_hash, count(*) AS files FROM cl WHERE is_bug_fix GROUP BY ALL)",
        _DESCRIBE.format(x="files"),
    ),
)
def files_per_fix_change(spark, folder):
    return reports.describe(reports.files_per_fix_change(bind.change_log(spark, folder)), "files")


@query(
    "largest_fix_changes",
    sql(
        "cl",
        "SELECT commit_hash, count(*) AS files FROM cl WHERE is_bug_fix GROUP BY ALL ORDER BY files DESC, commit_hash LIMIT 10",
    ),
)
def largest_fix_changes(spark, folder):
    return reports.largest_fix_changes(bind.change_log(spark, folder))


@query(
    "rows_per_file",
    more(
        "lab",
        "d AS (SELECT repo_name, file_path, count(*) AS r FROM lab GROUP BY ALL)",
        _DESCRIBE.format(x="r"),
    ),
)
def rows_per_file(spark, folder):
    return reports.describe(reports.rows_per_file(bind.labels(spark, folder)), "rows")


_MONTHS = [3, 6, 12, 18, 24, 36, 48]


@query(
    "holdout_sweep",
    more(
        "lab",
        "x AS (SELECT max(window_end) AS m FROM lab), t AS (SELECT unnest([3, 6, 12, 18, 24, 36, 48]) AS test_months)",
        """SELECT test_months, count(*) FILTER (window_end <= m - to_months(test_months)) AS train_rows,
  count(*) FILTER (window_end > m - to_months(test_months)) AS test_rows,
  count(*) FILTER (is_buggy AND window_end > m - to_months(test_months)) AS buggy_in_test
FROM lab, x, t GROUP BY test_months""",
    ),
)
def holdout_sweep(spark, folder):
    return reports.holdout_sweep(bind.labels(spark, folder), _MONTHS)


@query(
    "matrix_inventory",
    sql(
        "fm",
        """SELECT count(*) AS rows, CAST(9 AS BIGINT) AS features, count(*) FILTER (is_buggy = 1) AS buggy, count(*) FILTER (is_buggy = 0) AS clean,
  count(DISTINCT repo_name) AS repos, CAST(min(window_end) AS DATE) AS first_date, CAST(max(window_end) AS DATE) AS last_date FROM fm""",
    ),
)
def matrix_inventory(spark, folder):
    return reports.matrix_inventory(bind.feature_matrix(spark, folder), bind.FEATURES)


@query(
    "real_vs_synthetic_dates",
    sql(
        "lab",
        """SELECT CASE WHEN window_end < TIMESTAMP '2000-01-01' THEN 'real' ELSE 'synthetic' END AS date_kind, count(*) AS rows,
  round(avg(CAST(is_buggy AS INTEGER)) * 100, 1) AS buggy_percent FROM lab GROUP BY ALL""",
    ),
)
def real_vs_synthetic_dates(spark, folder):
    return reports.real_vs_synthetic_dates(
        bind.labels(spark, folder), datetime(2000, 1, 1), "window_end"
    )


# --- statistics ------------------------------------------------------------------

_PAIR_LIST = [(a, b) for i, a in enumerate(STAT_COLUMNS) for b in STAT_COLUMNS[i + 1 :]]
_PEARSON = union_all(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM fm" for a, b in _PAIR_LIST
)
_LABEL_R = union_all(
    f"SELECT '{c}' AS feature, round(corr({c}, is_buggy), 6) AS r FROM fm" for c in STAT_COLUMNS
)


@query(
    "label_correlation",
    more(
        "fm",
        f"r AS ({_LABEL_R})",
        """(SELECT *, 'risk' AS side FROM r ORDER BY r DESC, feature LIMIT 5) UNION ALL
(SELECT *, 'protective' AS side FROM r ORDER BY r, feature LIMIT 5)""",
    ),
)
def label_correlation(spark, folder):
    matrix = bind.feature_matrix(spark, folder)
    return statistics.strongest_label_correlations(
        statistics.label_correlation(matrix, STAT_COLUMNS)
    )


@query("pearson_pairs", sql("fm", _PEARSON))
def pearson_pairs(spark, folder):
    return statistics.pearson_pairs(bind.feature_matrix(spark, folder), STAT_COLUMNS)


_RANKED = "SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE) AS {c}" for c in STAT_COLUMNS
)


@query(
    "spearman_pairs",
    more(
        "fm",
        f"k AS ({_RANKED} FROM fm)",
        union_all(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM k" for a, b in _PAIR_LIST
        ),
    ),
)
def spearman_pairs(spark, folder):
    return statistics.spearman_pairs(bind.stored_matrix(spark, folder), STAT_COLUMNS)


@query(
    "correlated_pair_counts",
    more(
        "fm",
        f"pr AS ({_PEARSON}), t AS (SELECT unnest([0.7, 0.85, 0.9, 0.95, 0.1]) AS th)",
        """SELECT CAST(th AS DOUBLE) AS threshold, count(*) FILTER (abs(r) >= th) AS pairs,
  round(count(*) FILTER (abs(r) >= th) / CAST(count(*) AS DOUBLE), 6) AS fraction, max(abs(r)) AS max_abs_r FROM pr, t GROUP BY th""",
    ),
)
def correlated_pair_counts(spark, folder):
    pairs = statistics.pearson_pairs(bind.feature_matrix(spark, folder), STAT_COLUMNS)
    return statistics.pairs_over(pairs, [0.7, 0.85, 0.9, 0.95, 0.1])


@query(
    "correlation_distribution",
    more(
        "fm",
        f"pr AS ({_PEARSON}), s AS (SELECT min(r) AS lo, max(r) AS hi FROM pr)",
        """SELECT CAST(least(floor((r - lo) / ((hi - lo) / CAST(40 AS DOUBLE))), 39) AS INTEGER) AS bin, count(*) AS pairs FROM pr, s GROUP BY ALL""",
    ),
)
def correlation_distribution(spark, folder):
    pairs = statistics.pearson_pairs(bind.feature_matrix(spark, folder), STAT_COLUMNS)
    return statistics.correlation_distribution(pairs)


@query(
    "class_histogram",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, CAST(0.95 AS DOUBLE)) AS top FROM lineitem),
c AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, least(l_extendedprice, top) AS x FROM lineitem, q),
r AS (SELECT label, min(x) AS lo, max(x) AS hi, count(*) AS n FROM c GROUP BY ALL)
SELECT label, CAST(least(floor((x - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS rows,
  round(count(*) / (n * ((hi - lo) / 30)), 6) AS density FROM c JOIN r USING (label) GROUP BY label, bin, n, hi, lo""",
)
def class_histogram(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("is_buggy"), "l_extendedprice"
    )
    return statistics.class_histogram(rows, "l_extendedprice")


_MI_FEATURES = ["code_churn_90d", "commit_count_90d", "fix_density"]


@query(
    "mutual_information",
    more(
        "fm",
        "u AS ("
        + union_all(f"SELECT '{c}' AS feature, is_buggy AS y, CAST({c} AS DOUBLE) AS x FROM fm WHERE {c} IS NOT NULL" for c in _MI_FEATURES)
        + """), o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x) AS rn, count(*) OVER (PARTITION BY feature) AS n FROM u),
  e AS (SELECT DISTINCT feature, x AS edge FROM o, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS i) t WHERE rn = greatest(ceil(i / CAST(10 AS DOUBLE) * n), 1)),
  z AS (SELECT u.feature, u.y, u.x, (SELECT count(*) FROM e WHERE e.feature = u.feature AND e.edge < u.x) AS bin FROM u),
  c AS (SELECT feature, y, bin, count(*) AS n FROM z GROUP BY ALL),
  m AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)""",
        "SELECT feature, round(sum(n / CAST(t AS DOUBLE) * ln(CAST(n AS DOUBLE) * t / (CAST(nb AS DOUBLE) * ny))), 6) AS mutual_information FROM m GROUP BY ALL",
    ),
)
def mutual_information(spark, folder):
    return statistics.mutual_information(bind.stored_matrix(spark, folder), _MI_FEATURES)


# By definition: distances to up to three neighbours on each side, then rows of any class in the open interval.
_NEIGHBORS = (
    "u AS ("
    + union_all(f"SELECT '{c}' AS feature, is_buggy AS y, CAST({c} AS DOUBLE) AS x FROM fm WHERE {c} IS NOT NULL" for c in bind.FEATURES)
    + """), v AS (SELECT feature, y, x, count(*) AS n FROM u GROUP BY ALL),
  z AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY feature, y) AS ny FROM v) WHERE ny > 1),
  a AS (SELECT *, least(3, ny - 1) AS k, list_filter([lag({'x': x, 'n': n}, 1) OVER s, lag({'x': x, 'n': n}, 2) OVER s, lag({'x': x, 'n': n}, 3) OVER s,
      lead({'x': x, 'n': n}, 1) OVER s, lead({'x': x, 'n': n}, 2) OVER s, lead({'x': x, 'n': n}, 3) OVER s], lambda p: p IS NOT NULL) AS near
    FROM z WINDOW s AS (PARTITION BY feature, y ORDER BY x)),
  nb AS (SELECT feature, y, x, n, ny, k, unnest(near) AS p FROM a),
  d AS (SELECT feature, y, x, n, k, abs(p.x - x) AS d, sum(p.n) OVER (PARTITION BY feature, y, x ORDER BY abs(p.x - x)) AS reached FROM nb),
  r AS (SELECT feature, y, x, min(d) AS r FROM d WHERE n - 1 + reached >= k GROUP BY ALL),
  q AS (SELECT a.feature, a.y, a.x, a.n, a.ny, CASE WHEN n > k THEN n ELSE k END AS k, CASE WHEN n > k THEN CAST(0 AS DOUBLE) ELSE r.r END AS r
    FROM a LEFT JOIN r ON r.feature = a.feature AND r.y = a.y AND r.x = a.x),
  nw AS (SELECT feature, x, sum(n) AS n FROM z GROUP BY ALL),
  m AS (SELECT q.feature, q.y, q.x, q.n, q.ny, q.k, CAST(sum(w.n) AS BIGINT) AS m FROM q JOIN nw w ON w.feature = q.feature
      AND CASE WHEN q.r = 0 THEN w.x = q.x ELSE w.x > q.x - q.r AND w.x < q.x + q.r END GROUP BY ALL),
  h AS (SELECT i, sum(CASE WHEN i = 1 THEN 0 ELSE 1 / CAST(i - 1 AS DOUBLE) END) OVER (ORDER BY i) - 0.5772156649015329 AS psi
    FROM (SELECT unnest(range(1, (SELECT 1 + count(*) FROM fm))) AS i)),
  t AS (SELECT m.feature, sum(m.n) AS n, sum(m.n * (hk.psi - hy.psi - hm.psi)) AS s FROM m JOIN h hk ON hk.i = m.k JOIN h hy ON hy.i = m.ny
    JOIN h hm ON hm.i = m.m GROUP BY ALL)"""
)


@query(
    "neighbor_information",
    more("fm", _NEIGHBORS, "SELECT feature, round(greatest(psi + s / t.n, 0), 6) AS information FROM t JOIN h ON h.i = t.n"),
)
def neighbor_information(spark, folder):
    return neighbors.neighbor_information(bind.stored_matrix(spark, folder), bind.FEATURES)


@query(
    "class_balance",
    sql(
        "lab",
        """SELECT *, CASE WHEN bug_ratio < 0.15 THEN 'HIGH IMBALANCE' ELSE 'MANAGEABLE' END AS balance FROM (
  SELECT count(*) FILTER (NOT is_buggy) AS clean, count(*) FILTER (is_buggy) AS buggy,
    round(count(*) FILTER (is_buggy) / CAST(count(*) AS DOUBLE), 4) AS bug_ratio,
    round(count(*) FILTER (NOT is_buggy) / CAST(count(*) FILTER (is_buggy) AS DOUBLE), 1) AS clean_per_buggy FROM lab)""",
    ),
)
def class_balance(spark, folder):
    return statistics.class_balance(bind.labels(spark, folder))


# --- splits ------------------------------------------------------------------------

_DATED = """dt AS (SELECT repo_name, file_path, window_no, is_buggy,
    CASE WHEN window_no % 7 <> 3 THEN window_end END AS commit_date FROM lab)"""


def _dated(spark, folder):
    return bind.labels(spark, folder).select(
        *ROW_KEYS,
        "is_buggy",
        F.when(F.col("window_no") % 7 != 3, F.col("window_end")).alias("commit_date"),
    )


@query(
    "temporal_split",
    more(
        "lab",
        _DATED,
        """SELECT *, CASE WHEN commit_date > (SELECT max(commit_date) FROM dt) - INTERVAL 12 MONTH THEN 'test' ELSE 'train' END AS split FROM dt""",
    ),
)
def temporal_split(spark, folder):
    return splits.temporal_split(_dated(spark, folder))


@query(
    "temporal_split_quantile",
    more(
        "lab",
        _DATED,
        """SELECT *, CASE WHEN epoch_us(commit_date) > (SELECT quantile_cont(CAST(epoch_us(commit_date) AS DOUBLE), 0.8) FROM dt)
  THEN 'test' ELSE 'train' END AS split FROM dt""",
    ),
)
def temporal_split_quantile(spark, folder):
    return splits.temporal_split_quantile(_dated(spark, folder))


_ORDERED = """rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY (id * 7919) % 10007, id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM sc)"""


@query(
    "stratified_holdout",
    more(
        "sc",
        _ORDERED,
        "SELECT id, y, score, CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM rk",
    ),
)
def stratified_holdout(spark, folder):
    return splits.stratified_holdout(
        bind.scored(spark, folder), ["id"], splits.id_hash(F.col("id")), "y"
    )


@query(
    "stratified_kfold",
    more("sc", _ORDERED, "SELECT id, y, score, CAST(rn % 5 AS INTEGER) AS fold FROM rk"),
)
def stratified_kfold(spark, folder):
    return splits.stratified_kfold(
        bind.scored(spark, folder), ["id"], splits.id_hash(F.col("id")), "y"
    )


@query(
    "class_weights",
    sql(
        "lab",
        """SELECT repo_name, file_path, window_no, is_buggy, CASE WHEN is_buggy THEN
  (SELECT round(count(*) FILTER (NOT is_buggy) / CAST(count(*) FILTER (is_buggy) AS DOUBLE), 2) FROM lab) ELSE CAST(1 AS DOUBLE) END AS weight FROM lab""",
    ),
)
def class_weights(spark, folder):
    return splits.class_weights(bind.labels(spark, folder).select(*ROW_KEYS, "is_buggy"))


# --- metrics -----------------------------------------------------------------------

_CURVE = """g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY ALL),
  cu AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""
_SWEEP = """th AS (SELECT t, t / CAST(100 AS DOUBLE) AS threshold FROM generate_series(5, 94) g(t)),
  ct AS (SELECT threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y = 0 AND score >= threshold) AS fp,
    count(*) FILTER (y = 1 AND score < threshold) AS fn FROM sc, th GROUP BY ALL),
  sw AS (SELECT threshold, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall,
    round(CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1 FROM ct)"""


@query(
    "auc_roc",
    more(
        "sc",
        """a AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS r FROM sc)""",
        """SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) AS auc FROM a""",
    ),
)
def auc_roc(spark, folder):
    return metrics.auc_roc(bind.scored(spark, folder))


@query(
    "average_precision",
    more("sc", _CURVE, "SELECT round(sum(pos * (tp / CAST(tp + fp AS DOUBLE)) / CAST(p AS DOUBLE)), 6) AS average_precision FROM cu"),
)
def average_precision(spark, folder):
    return metrics.average_precision(bind.scored(spark, folder))


@query(
    "prf_at_threshold",
    more(
        "sc",
        """c AS (SELECT count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 0 AND score >= 0.5) AS fp,
    count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 0 AND score < 0.5) AS tn FROM sc)""",
        """SELECT *, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
  round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM c""",
    ),
)
def prf_at_threshold(spark, folder):
    return metrics.prf_at_threshold(bind.scored(spark, folder))


@query(
    "precision_at_k",
    sql("sc", "SELECT round(avg(y), 6) AS precision_at_k FROM (SELECT y FROM sc ORDER BY score DESC, id LIMIT 100)"),
)
def precision_at_k(spark, folder):
    return metrics.precision_at_k(bind.scored(spark, folder), 100)


@query(
    "pr_table_at_k",
    more(
        "sc",
        """o AS (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS rn FROM sc), t AS (SELECT unnest([10, 20, 50, 100, 1000000000]) AS k)""",
        """SELECT k, round(sum(y) FILTER (rn <= k) / CAST(k AS DOUBLE), 6) AS precision_at_k, round(sum(y) FILTER (rn <= k) / CAST(sum(y) AS DOUBLE), 6) AS recall_at_k,
  CAST(sum(y) FILTER (rn <= k) AS BIGINT) AS bugs_found, CAST(sum(y) AS BIGINT) AS total_bugs FROM o, t GROUP BY k HAVING k <= count(*)""",
    ),
)
def pr_table_at_k(spark, folder):
    return metrics.pr_table_at_k(bind.scored(spark, folder))


@query("threshold_sweep", more("sc", _SWEEP, "SELECT * FROM sw"))
def threshold_sweep(spark, folder):
    return metrics.threshold_sweep(bind.scored(spark, folder))


@query(
    "best_threshold",
    more(
        "sc",
        _SWEEP,
        """SELECT threshold AS best_threshold FROM ct WHERE tp / CAST(tp + fn AS DOUBLE) >= CAST(0.4 AS DOUBLE) AND tp > 0
ORDER BY tp / CAST(tp + fp AS DOUBLE) DESC, threshold LIMIT 1""",
    ),
)
def best_threshold(spark, folder):
    return metrics.best_threshold(bind.scored(spark, folder))


@query("best_f1_threshold", more("sc", _SWEEP, "SELECT * FROM sw ORDER BY f1 DESC, threshold LIMIT 1"))
def best_f1_threshold(spark, folder):
    return metrics.best_f1_threshold(bind.scored(spark, folder))


@query(
    "roc_points",
    more(
        "sc",
        _CURVE,
        """SELECT score AS threshold, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr FROM cu
UNION ALL SELECT NULL, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""",
    ),
)
def roc_points(spark, folder):
    return metrics.roc_points(bind.scored(spark, folder))


@query(
    "pr_points",
    more(
        "sc",
        _CURVE,
        """SELECT score AS threshold, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(p AS DOUBLE), 6) AS recall,
  round(p / CAST(p + n AS DOUBLE), 6) AS baseline FROM cu""",
    ),
)
def pr_points(spark, folder):
    return metrics.pr_points(bind.scored(spark, folder))


@query(
    "calibration_bins",
    sql(
        "sc",
        """SELECT CAST(len(list_filter([i / CAST(10 AS DOUBLE) FOR i IN range(1, 10)], lambda e: e < score)) AS INTEGER) AS bin, round(avg(score), 6) AS mean_predicted,
  round(avg(y), 6) AS fraction_positive, count(*) AS rows FROM sc GROUP BY ALL""",
    ),
)
def calibration_bins(spark, folder):
    return metrics.calibration_bins(bind.scored(spark, folder))


@query(
    "classification_report",
    more(
        "sc",
        """q AS (SELECT y, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS h FROM sc),
  k AS (SELECT c, count(*) FILTER (h = c AND y = c) / CAST(count(*) FILTER (h = c) AS DOUBLE) AS pr,
      count(*) FILTER (h = c AND y = c) / CAST(count(*) FILTER (y = c) AS DOUBLE) AS re,
      2 * count(*) FILTER (h = c AND y = c) / CAST(count(*) FILTER (h = c) + count(*) FILTER (y = c) AS DOUBLE) AS f,
      count(*) FILTER (y = c) AS s FROM q, (SELECT unnest([0, 1]) AS c) GROUP BY c),
  ac AS (SELECT count(*) FILTER (h = y) / CAST(count(*) AS DOUBLE) AS a, count(*) AS s FROM q)""",
        """SELECT CASE WHEN c = 0 THEN 'Clean' ELSE 'Buggy' END AS class_name, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, s AS support FROM k
UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), s FROM ac
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', round(sum(pr * s) / sum(s), 6), round(sum(re * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM k""",
    ),
)
def classification_report(spark, folder):
    return metrics.classification_report(bind.scored(spark, folder))


@query(
    "fold_summary",
    """WITH f AS (SELECT o_custkey % 5 AS fold, avg(o_totalprice) / 400000 AS auc, min(o_totalprice) / 400000 AS f1, max(o_totalprice) / 1000000 AS ap FROM orders GROUP BY ALL),
s AS (SELECT round(avg(auc), 6) AS mean_auc, round(avg(f1), 6) AS mean_f1, round(avg(ap), 6) AS mean_ap,
  round(stddev_pop(auc), 6) AS std_auc, round(stddev_pop(f1), 6) AS std_f1, round(stddev_pop(ap), 6) AS std_ap FROM f)
SELECT *, CASE WHEN mean_auc < 0.5 THEN 'FAIL: worse than random' WHEN mean_auc < 0.65 THEN 'WARN: below floor'
  WHEN mean_auc < 0.7 THEN 'WARN: below expected range' ELSE 'OK' END AS verdict FROM s""",
)
def fold_summary(spark, folder):
    price = F.col("o_totalprice")
    folds = (
        table(spark, folder, "orders")
        .groupBy((F.col("o_custkey") % 5).alias("fold"))
        .agg(
            (F.avg(price) / 400000).alias("auc"),
            (F.min(price) / 400000).alias("f1"),
            (F.max(price) / 1000000).alias("ap"),
        )
    )
    return metrics.fold_summary(folds)


@query(
    "loss_smoothing",
    """SELECT user_id, step, loss, round(avg(loss) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed,
  min(step) FILTER (loss < 20) OVER (PARTITION BY user_id) AS first_below
FROM (SELECT user_id, event_id AS step, value AS loss FROM events)""",
)
def loss_smoothing(spark, folder):
    losses = table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("step"), F.col("value").alias("loss")
    )
    return training.loss_smoothing(losses, ["user_id"], below=20)


# --- structure ------------------------------------------------------------------------

# Closed forms of the metrics of the generated program texts.
_PARTS = """k AS (SELECT source_code, repo_name, file_path, commit_hash, line_no,
    CAST(round(l_discount * 100) AS BIGINT) % 3 AS i, CAST(l_quantity AS BIGINT) % 4 AS f,
    CAST(round(l_tax * 100) AS BIGINT) % 3 AS c, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS t,
    source_code IS NOT NULL AND trim(source_code) <> '' AS has_text, coalesce(source_code, '') LIKE 'import%' AS parses FROM src)"""


def _closed_form(nesting: str, arguments: str, places: int, usable: str) -> str:
    def value(expression: str) -> str:
        return f"CASE WHEN {usable} THEN CASE WHEN parses THEN {expression} ELSE 0 END END"

    length = f"CASE WHEN f + c > 0 THEN round((4 * f + 7 * c) / CAST(f + c AS DOUBLE), {places}) ELSE CAST(0 AS DOUBLE) END"
    columns = {
        "cyclomatic_complexity": "1 + f + 3 * c + 2 * t",
        "cognitive_complexity": "f + 3 * c + t",
        "max_nesting_depth": nesting,
        "num_functions": "f + c",
        "num_classes": "c",
        "avg_function_length": length,
        "num_imports": "1 + i",
        "ast_node_count": "7 + 2 * i + 15 * f + 21 * c + 12 * t",
        "has_try_except": "t",
        "max_args_per_function": arguments,
    }
    return ", ".join(f"{value(e)} AS {n}" for n, e in columns.items())


_NESTING = "CAST(CASE WHEN c > 0 THEN 5 WHEN f > 0 THEN 2 ELSE t END AS BIGINT)"
_DEPTH = "CAST(CASE WHEN c > 0 THEN 7 WHEN f + t > 0 THEN 5 ELSE 3 END AS BIGINT)"
_ALL_ARGS = "CAST(CASE WHEN f > 0 THEN 3 WHEN c > 0 THEN 2 ELSE 0 END AS BIGINT)"
_PLAIN_ARGS = "CAST(CASE WHEN f > 0 OR c > 0 THEN 2 ELSE 0 END AS BIGINT)"
_REVISION = ["repo_name", "file_path", "commit_hash", "line_no"]


def _structure(spark, folder, variant, missing):
    log = bind.log_with_source(spark, folder).select(*_REVISION, "source_code")
    rows = structure.structure_for(log, "source_code", variant, missing)
    return rows.select(*_REVISION, *structure.METRIC_NAMES)


@query(
    "structure_metrics",
    more("src", _PARTS, f"SELECT repo_name, file_path, commit_hash, line_no, {_closed_form(_NESTING, _ALL_ARGS, 4, 'has_text')} FROM k"),
)
def structure_metrics(spark, folder):
    return _structure(spark, folder, "nesting", "null")


@query(
    "structure_metrics_tree",
    more(
        "src",
        _PARTS,
        f"SELECT repo_name, file_path, commit_hash, line_no, {_closed_form(_DEPTH, _PLAIN_ARGS, 2, 'true')} FROM k",
    ),
)
def structure_metrics_tree(spark, folder):
    return _structure(spark, folder, "tree", "zero")


def _latest(spark, folder, log=None):
    return latest_source_snapshot(bind.log_with_source(spark, folder) if log is None else log)


def _nodes(spark, folder):
    """Node rows of the newest texts, stored because graphs read them more than once."""
    nodes = structure.ast_nodes(structure.distinct_sources(_latest(spark, folder)))
    return write_table(nodes, fresh_path(spark, "ast-nodes"))


@query(
    "ast_nodes",
    more(
        "src",
        """ls AS (SELECT DISTINCT source_code FROM (SELECT source_code, row_number() OVER (PARTITION BY repo_name, file_path
      ORDER BY commit_date DESC, commit_hash DESC, source_code DESC) AS rn FROM src WHERE source_code IS NOT NULL AND trim(source_code) <> '') WHERE rn = 1),
  n AS (SELECT len(regexp_extract_all(source_code, 'def f')) AS f, len(regexp_extract_all(source_code, 'class C')) AS c,
    len(regexp_extract_all(source_code, 'import')) AS i, len(regexp_extract_all(source_code, 'try:')) AS t FROM ls WHERE source_code LIKE 'import%')""",
        """SELECT 'FunctionDef' AS type, CAST(sum(f + c) AS BIGINT) AS nodes FROM n UNION ALL SELECT 'ClassDef', CAST(sum(c) AS BIGINT) FROM n
UNION ALL SELECT 'Import', CAST(sum(i) AS BIGINT) FROM n UNION ALL SELECT 'Try', CAST(sum(t) AS BIGINT) FROM n
UNION ALL SELECT 'If', CAST(sum(f + 2 * c) AS BIGINT) FROM n UNION ALL SELECT 'Module', count(*) FROM n""",
    ),
)
def ast_nodes(spark, folder):
    return (
        structure.nodes_summary(_nodes(spark, folder))
        .filter(F.col("type").isin("FunctionDef", "ClassDef", "Import", "Try", "If", "Module"))
        .select("type", "nodes")
    )


# The newest text of each file and, if it parses, the nodes of its tree in closed form.
_GRAPHS = """rv AS (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY commit_date DESC, commit_hash DESC, source_code DESC) AS rn
    FROM src WHERE source_code IS NOT NULL AND trim(source_code) <> ''),
  gr AS (SELECT repo_name, file_path, sha256(source_code) AS digest, source_code LIKE 'import%' AS parses,
      7 + 2 * len(regexp_extract_all(source_code, 'import mod')) + 15 * len(regexp_extract_all(source_code, 'def f'))
        + 21 * len(regexp_extract_all(source_code, 'class C')) + 12 * len(regexp_extract_all(source_code, 'try:')) AS n_nodes
    FROM rv WHERE rn = 1),
  lb AS (SELECT repo_name, file_path, max(CAST(is_buggy AS INTEGER)) AS is_buggy FROM lab GROUP BY ALL)"""


@query(
    "graph_tables",
    more("src", _GRAPHS.split(",\n  lb AS")[0], "SELECT DISTINCT digest, n_nodes, 2 * (n_nodes - 1) AS n_edges FROM gr WHERE parses"),
)
def graph_tables(spark, folder):
    return graph.graph_sizes(_nodes(spark, folder))


@query("graph_edges")
def graph_edges(spark, folder):
    return graph.graph_edges(graph.graph_nodes(_nodes(spark, folder)))


@query("graph_node_features")
def graph_node_features(spark, folder):
    return graph.node_features(graph.graph_nodes(_nodes(spark, folder)))


def _file_embeddings(spark, folder, log=None):
    """Embedding per file; computed once and read back from the shared folder."""
    latest = _latest(spark, folder, log).select(*FILE_KEYS, F.sha2("source_code", 256).alias("digest"), structure.shape_text(F.col("source_code")).alias("source_code"))
    latest = write_table(latest.withColumn("shape", F.sha2("source_code", 256)), fresh_path(spark, "newest-sources"))
    nodes = write_table(structure.ast_nodes(structure.distinct_sources(latest)), fresh_path(spark, "ast-nodes"))
    embedded = graph.graph_embedding(nodes, named=latest.select("digest", "shape").distinct())
    return latest.select(*FILE_KEYS, "digest").join(embedded, "digest", "left").select(
        *FILE_KEYS, "embedding"
    )


@query("graph_embedding")
def graph_embedding(spark, folder):
    return joins.lookup_vector_or_zero(
        bind.change_log(spark, folder).select(*FILE_KEYS).distinct(),
        _file_embeddings(spark, folder),
        FILE_KEYS,
        graph.EMBEDDING_DIM,
    )


def _graph_dataset(spark, folder, **bounds):
    marked = labels.collapse_any(bind.labels(spark, folder))
    return graph.build_graph_dataset(_latest(spark, folder), marked, **bounds)


@query(
    "build_graph_dataset",
    more(
        "src lab",
        _GRAPHS,
        "SELECT repo_name, file_path, digest, n_nodes, 2 * (n_nodes - 1) AS n_edges, is_buggy FROM gr JOIN lb USING (repo_name, file_path) WHERE parses",
    ),
)
def build_graph_dataset(spark, folder):
    return _graph_dataset(spark, folder).rows


@query(
    "graph_dataset_counts",
    more(
        "src lab",
        _GRAPHS,
        """SELECT count(*) AS files, count(*) FILTER (is_buggy IS NULL) AS unlabeled, count(*) FILTER (is_buggy IS NOT NULL AND NOT parses) AS unparsed,
  count(*) FILTER (is_buggy IS NOT NULL AND parses AND NOT n_nodes BETWEEN 20 AND 90) AS out_of_bounds,
  count(*) FILTER (is_buggy IS NOT NULL AND parses AND n_nodes BETWEEN 20 AND 90) AS kept FROM gr LEFT JOIN lb USING (repo_name, file_path)""",
    ),
)
def graph_dataset_counts(spark, folder):
    """What became of every file, with bounds that leave small and large graphs out."""
    return _graph_dataset(spark, folder, min_nodes=20, max_nodes=90).counts


@query(
    "assemble_matrix",
    more(
        "src fm",
        """rv AS (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY commit_date DESC, commit_hash DESC, source_code DESC) AS rn
    FROM src WHERE source_code IS NOT NULL AND trim(source_code) <> ''),
  st AS (SELECT repo_name, file_path, CASE WHEN source_code LIKE 'import%' THEN len(regexp_extract_all(source_code, 'def ')) ELSE 0 END AS num_functions,
    CASE WHEN source_code LIKE 'import%' THEN 1 + len(regexp_extract_all(source_code, '    if |elif|for ')) + 2 * len(regexp_extract_all(source_code, 'try:')) ELSE 0 END AS ast_cyclomatic_complexity
    FROM rv WHERE rn = 1)""",
        """SELECT fm.repo_name, fm.file_path, fm.window_no, fm.is_buggy, fm.commits_in_window, fm.fix_density, st.num_functions, st.ast_cyclomatic_complexity
FROM fm LEFT JOIN st USING (repo_name, file_path)""",
    ),
)
def assemble_matrix(spark, folder):
    log = bind.stored_log(spark, folder)
    past = store_history(log, stored=True)
    marked = labels.windowed_labels(past.changes, span=past.span)
    marked = marked.withColumn("is_buggy", F.col("is_buggy").cast("int"))
    activity = process.process_features(marked, past.changes, past.span).withColumn(
        "is_buggy", F.lit(-1)
    )
    sources = write_table(latest_source_snapshot(log), fresh_path(spark, "newest-sources"))
    shapes = joins.rename_structure_columns(structure.structure_for(sources).drop("source_code"))
    matrix = joins.assemble_matrix(marked, activity, shapes, ROW_KEYS, FILE_KEYS)
    return matrix.select(
        *ROW_KEYS,
        "is_buggy",
        "commits_in_window",
        "fix_density",
        "num_functions",
        "ast_cyclomatic_complexity",
    )


# --- models -------------------------------------------------------------------------

SMALL_TREES = training.TreeParams(n_estimators=5, max_depth=4, learning_rate=0.2)


@query("train_boosted_trees")
def train_boosted_trees(spark, folder):
    matrix = bind.stored_matrix(spark, folder)
    marked = splits.stratified_holdout(matrix, ROW_KEYS, splits.text_hash(*ROW_KEYS)).withColumn(
        "held_out", F.col("split") == "test"
    )
    model = training.train_boosted_trees(
        marked, bind.FEATURES, SMALL_TREES, validation="held_out"
    )
    return training.feature_importance(spark, model, bind.FEATURES)


@query("score_batch")
def score_batch(spark, folder):
    matrix = bind.stored_matrix(spark, folder)
    path = fresh_path(spark, "model")
    training.refit_final(matrix, bind.FEATURES, SMALL_TREES, 5, path)
    model, names = training.load_model(spark, path)
    return training.score_batch(model, matrix, names).select(*ROW_KEYS, "is_buggy", "score")


def _oof(spark, folder):
    matrix = bind.stored_matrix(spark, folder)
    folded = splits.stratified_kfold(matrix, ROW_KEYS, splits.text_hash(*ROW_KEYS), k=3)
    return training.cv_oof_scores(folded, bind.FEATURES, SMALL_TREES, ROW_KEYS, k=3)


@query("cv_oof_scores")
def cv_oof_scores(spark, folder):
    return _oof(spark, folder)[0]


@query("cv_fold_metrics")
def cv_fold_metrics(spark, folder):
    return metrics.fold_summary(_oof(spark, folder)[1])


@query("hybrid_train")
def hybrid_train(spark, folder):
    matrix = bind.stored_matrix(spark, folder)
    vectors = _file_embeddings(spark, folder)
    stored = write_table(vectors, fresh_path(spark, "embeddings"))
    return training.hybrid_train(
        matrix, bind.FEATURES, stored, FILE_KEYS, graph.EMBEDDING_DIM, SMALL_TREES
    )[1]


@query("three_way_comparison")
def three_way_comparison(spark, folder):
    matrix = bind.stored_matrix(spark, folder)
    vectors = _file_embeddings(spark, folder)
    stored = write_table(vectors, fresh_path(spark, "embeddings"))
    return training.three_way_comparison(
        matrix,
        bind.FEATURES,
        stored,
        FILE_KEYS,
        graph.EMBEDDING_DIM,
        SMALL_TREES,
        ROW_KEYS,
        months=12,
    )


# The plain definition: the largest, over all starts, of the smallest mean from there to any later end.
_ISOTONIC = """sp AS (SELECT id, y, score, CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM rk),
  ds AS (SELECT score AS x, sum(y) AS p, count(*) AS n, row_number() OVER (ORDER BY score) AS i FROM sp WHERE split = 'test' GROUP BY score),
  cs AS (SELECT *, sum(p) OVER (ORDER BY i) AS cp, sum(n) OVER (ORDER BY i) AS cn FROM ds),
  mean AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.p) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m FROM cs a JOIN cs b ON b.i >= a.i),
  low AS (SELECT k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM mean),
  knot AS (SELECT x, level FROM (SELECT i, max(low) AS level FROM low GROUP BY i) JOIN ds USING (i))"""


@query(
    "calibrate_isotonic",
    more(
        "sc",
        _ORDERED + ",\n  " + _ISOTONIC,
        """SELECT id, y, score, round(CASE WHEN l.x IS NULL THEN r.level WHEN r.x IS NULL OR r.x = l.x THEN l.level
    ELSE l.level + (r.level - l.level) * (score - l.x) / (r.x - l.x) END, 6) AS calibrated
FROM sp ASOF LEFT JOIN knot l ON score >= l.x ASOF LEFT JOIN knot r ON score <= r.x WHERE split = 'train'""",
    ),
)
def calibrate_isotonic(spark, folder):
    scored = bind.scored(spark, folder)
    split = splits.stratified_holdout(scored, ["id"], splits.id_hash(F.col("id")), "y")
    calibrated = isotonic.calibrate_isotonic(split.filter("split = 'test'"), split.filter("split = 'train'"))
    return calibrated.select("id", "y", "score", F.round("calibrated", 6).alias("calibrated"))


@query("training_loss")
def training_loss(spark, folder):
    matrix = bind.stored_matrix(spark, folder)
    vectors = training.assemble(matrix, bind.FEATURES)
    model = training.fit_trees(vectors, SMALL_TREES)
    return training.loss_smoothing(training.loss_table(spark, model, vectors), below=1.2)


# --- explanations and reports ------------------------------------------------------------

# A linear score over four metrics, for the additive explanations.
COEFFICIENTS = {
    "fix_density": 2.0,
    "commit_count_90d": 0.25,
    "author_count_90d": -0.125,
    "ownership_score": -1.5,
}
_MEANS = "mn AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in COEFFICIENTS) + " FROM fm)"
_BASE = " + ".join(f"CAST({w} AS DOUBLE) * m_{c}" for c, w in COEFFICIENTS.items())
_LINEAR = (
    _MEANS
    + ",\n  att AS ("
    + union_all(
        f"SELECT repo_name, file_path, window_no, {_BASE} AS base_value, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, CAST({w} AS DOUBLE) * (coalesce({c}, m_{c}) - m_{c}) AS attribution FROM fm, mn"
        for c, w in COEFFICIENTS.items()
    )
    + ")"
)


def _linear(spark, folder):
    return attribution.linear_attributions(
        bind.stored_matrix(spark, folder), COEFFICIENTS, ROW_KEYS
    )


@query(
    "attributions",
    more(
        "fm",
        _LINEAR,
        "SELECT repo_name, file_path, window_no, feature, value, round(attribution, 6) AS attribution, round(base_value, 6) AS base_value FROM att",
    ),
)
def attributions(spark, folder):
    return _linear(spark, folder).withColumns(
        {"attribution": F.round("attribution", 6), "base_value": F.round("base_value", 6)}
    )


@query("tree_attributions")
def tree_attributions(spark, folder):
    matrix = bind.stored_matrix(spark, folder)
    model = training.train_boosted_trees(matrix, bind.FEATURES, SMALL_TREES)
    return attribution.tree_attributions(matrix, model, bind.FEATURES, ROW_KEYS)


@query(
    "tree_attribution_gaps",
    sql("fm", "SELECT repo_name, file_path, window_no, CAST(9 AS BIGINT) AS features, CAST(0 AS DOUBLE) AS gap FROM fm"),
)
def tree_attribution_gaps(spark, folder):
    """Contributions of a fitted model: one per feature, and in sum the row's margin."""
    matrix = bind.stored_matrix(spark, folder)
    model = training.train_boosted_trees(matrix, bind.FEATURES, SMALL_TREES)
    long = attribution.tree_attributions(matrix, model, bind.FEATURES, ROW_KEYS)
    margin = F.log(F.col("score") / (1 - F.col("score"))) / 2
    margins = training.score_batch(model, matrix, bind.FEATURES).select(*ROW_KEYS, margin.alias("margin"))
    return attribution.attribution_gaps(long, margins, ROW_KEYS)


# Two trees over three metrics (tree, id, prediction, cover, left, right, feature, threshold); the first
# splits twice on the same metric.
FIXED_FEATURES = ["code_churn_90d", "commit_count_90d", "fix_density"]
FIXED_NODES = [
    (0, 0, 0.5, 64.0, 1, 2, 0, 60.0), (0, 1, 0.0, 48.0, 3, 4, 2, 0.25), (0, 2, 0.0, 16.0, 5, 6, 1, 2.0),
    (0, 3, -0.5, 12.0, -1, -1, -1, 0.0), (0, 4, 0.0, 36.0, 7, 8, 0, 30.0), (0, 5, 1.0, 4.0, -1, -1, -1, 0.0),
    (0, 6, 2.0, 12.0, -1, -1, -1, 0.0), (0, 7, 0.25, 9.0, -1, -1, -1, 0.0), (0, 8, 0.75, 27.0, -1, -1, -1, 0.0),
    (1, 0, 0.0, 32.0, 1, 2, 2, 0.5), (1, 1, -1.0, 8.0, -1, -1, -1, 0.0), (1, 2, 0.0, 24.0, 3, 4, 1, 1.0),
    (1, 3, 0.5, 18.0, -1, -1, -1, 0.0), (1, 4, 3.0, 6.0, -1, -1, -1, 0.0),
]
FIXED_WEIGHTS = [1.0, 0.5]


def _expected(known: set[int]) -> str:
    """SQL for the ensemble's value if only the features ``known`` are known, by walking every path."""
    nodes = {(t, i): rest for t, i, *rest in FIXED_NODES}

    def walk(tree: int, at: int, factor: str) -> list[str]:
        prediction, cover, left, right, feature, threshold = nodes[tree, at]
        if left < 0:
            return [f"{factor} * {prediction * FIXED_WEIGHTS[tree]}"]
        terms = []
        for child, test in ((left, "<="), (right, ">")):
            share = f"({nodes[tree, child][1]} / {cover})"
            met = f"(CASE WHEN coalesce(CAST({FIXED_FEATURES[feature]} AS DOUBLE), -1) {test} {threshold} THEN 1e0 ELSE 0e0 END)"
            terms += walk(tree, child, f"{factor} * {met if feature in known else share}")
        return terms

    return "(" + " + ".join(term for tree in (0, 1) for term in walk(tree, 0, "1e0")) + ")"


def _shapley(feature: int) -> str:
    """SQL for a feature's Shapley value: the weighted sum over all subsets of the other two."""
    one, two = [f for f in range(3) if f != feature]
    terms = [
        f"{weight} * ({_expected({*rest, feature})} - {_expected(rest)})"
        for rest, weight in ((set(), "1e0 / 3"), ({one}, "1e0 / 6"), ({two}, "1e0 / 6"), ({one, two}, "1e0 / 3"))
    ]
    return " + ".join(terms)


@query(
    "shapley_attributions",
    sql(
        "fm",
        union_all(
            f"SELECT repo_name, file_path, window_no, round({_expected(set())}, 9) AS base_value, '{name}' AS feature, "
            f"CAST({name} AS DOUBLE) AS value, round({_shapley(i)}, 9) + 0e0 AS attribution FROM fm"
            for i, name in enumerate(FIXED_FEATURES)
        ),
    ),
)
def shapley_attributions(spark, folder):
    """Shapley values of stated trees, against the definition over all subsets."""
    matrix = bind.stored_matrix(spark, folder)
    columns = ["tree", "id", "prediction", "cover", "left", "right", "feature", "threshold"]
    nodes = pd.DataFrame(FIXED_NODES, columns=columns)
    long = attribution.shapley_attributions(matrix, nodes, FIXED_WEIGHTS, FIXED_FEATURES, ROW_KEYS)
    return long.withColumns({c: F.round(c, 9) + 0.0 for c in ("attribution", "base_value")})


@query(
    "top_features_per_row",
    more(
        "fm",
        _LINEAR,
        """SELECT repo_name, file_path, window_no, feature, round(value, 4) AS value, round(attribution, 6) AS attribution,
  CASE WHEN attribution > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction, CAST(rn AS INTEGER) AS feature_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_name, file_path, window_no ORDER BY abs(round(attribution, 9)) DESC, feature) AS rn FROM att) WHERE rn <= 3""",
    ),
)
def top_features_per_row(spark, folder):
    rounded = _linear(spark, folder).withColumn("attribution", F.round("attribution", 9))
    return topk.top_features_per_row(rounded, ROW_KEYS, 3).drop("base_value")


@query(
    "global_importance",
    more("fm", _LINEAR, "SELECT feature, round(avg(abs(attribution)), 6) AS importance FROM att GROUP BY ALL"),
)
def global_importance(spark, folder):
    return attribution.global_importance(_linear(spark, folder))


@query(
    "explain_row",
    more(
        "fm",
        _LINEAR
        + """,
  pk AS (SELECT file_path, window_no FROM fm ORDER BY fix_density DESC, commit_count_90d DESC, file_path, window_no LIMIT 1)""",
        """SELECT repo_name, file_path, window_no, feature, round(attribution, 6) AS attribution, round(base_value, 6) AS base_value,
  round(sum(attribution) OVER (), 6) AS attribution_sum FROM att SEMI JOIN pk USING (file_path, window_no)""",
    ),
)
def explain_row(spark, folder):
    matrix = write_table(bind.feature_matrix(spark, folder), fresh_path(spark, "matrix"))
    row = (
        matrix.orderBy(
            F.desc("fix_density"), F.desc("commit_count_90d"), "file_path", "window_no"
        )
        .select(*ROW_KEYS)
        .first()
    )
    where = (F.col("file_path") == row["file_path"]) & (F.col("window_no") == row["window_no"])
    stored = attribution.linear_attributions(matrix, COEFFICIENTS, ROW_KEYS)
    return attribution.explain_row(stored, where, ROW_KEYS)


@query(
    "wide_attributions",
    more(
        "fm",
        _LINEAR,
        "SELECT repo_name, file_path, window_no, "
        + ", ".join(f"round(max(attribution) FILTER (feature = '{c}'), 6) AS {c}" for c in COEFFICIENTS)
        + " FROM att GROUP BY ALL",
    ),
)
def wide_attributions(spark, folder):
    wide = attribution.wide_attributions(_linear(spark, folder), ROW_KEYS, list(COEFFICIENTS))
    stored = write_table(wide, fresh_path(spark, "attributions"))
    return stored.withColumns({c: F.round(c, 6) for c in COEFFICIENTS})


def _scored_attributions(spark, folder):
    """Rows with an id, a score squeezed to 0..1 and their attributions."""
    ident = F.concat_ws("#", "repo_name", "file_path", F.col("window_no").cast("string"))
    long = _linear(spark, folder).withColumn("id", ident).drop(*ROW_KEYS)
    stored = write_table(long, fresh_path(spark, "attributions"))
    total = F.col("base_value") + F.sum("attribution")
    scored = stored.groupBy("id", "base_value").agg(
        F.round(1 / (1 + F.exp(-total)), 6).alias("score")
    )
    return scored.drop("base_value"), stored


_SCORED_AT = """ri AS (SELECT repo_name || '#' || file_path || '#' || CAST(window_no AS VARCHAR) AS id, feature, attribution, base_value FROM att),
  rs AS (SELECT id, round(1 / (1 + exp(-(base_value + sum(attribution)))), 6) AS score FROM ri GROUP BY id, base_value)"""


@query(
    "at_risk_with_attributions",
    more(
        "fm",
        _LINEAR
        + ",\n  "
        + _SCORED_AT
        + """,
  tp AS (SELECT * FROM rs ORDER BY score DESC, id LIMIT 10),
  im AS (SELECT feature FROM ri GROUP BY feature ORDER BY round(avg(abs(attribution)), 6) DESC, feature LIMIT 3)""",
        """SELECT tp.id, tp.score, ri.feature, round(ri.attribution, 6) AS attribution FROM tp JOIN ri USING (id) SEMI JOIN im USING (feature)""",
    ),
)
def at_risk_with_attributions(spark, folder):
    scored, long = _scored_attributions(spark, folder)
    importance = attribution.global_importance(long)
    return joins.at_risk_with_attributions(scored, long, importance).withColumn(
        "attribution", F.round("attribution", 6)
    )


@query(
    "risk_summary_text",
    more(
        "fm",
        _LINEAR
        + ",\n  "
        + _SCORED_AT
        + """,
  o AS (SELECT repo_name || '#' || file_path || '#' || CAST(window_no AS VARCHAR) AS id, feature, round(value, 4) AS value, round(round(attribution, 9), 6) AS a,
    row_number() OVER (PARTITION BY repo_name, file_path, window_no ORDER BY abs(round(attribution, 9)) DESC, feature) AS rn FROM att),
  p AS (SELECT id, string_agg(CASE WHEN a > 0 THEN 'high ' ELSE 'low ' END || feature || ' = ' || printf('%.2f', value) || ' (' || printf('%+.3f', a) || ')', '; ' ORDER BY rn) AS parts
    FROM o WHERE rn <= 3 GROUP BY id)""",
        """SELECT id, CASE WHEN score >= CAST(0.7 AS DOUBLE) THEN 'HIGH' WHEN score >= CAST(0.4 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END
  || ' risk, score ' || printf('%.2f', round(score, 4)) || '; driven by ' || parts || '.' AS summary
FROM (SELECT * FROM rs ORDER BY score DESC, id LIMIT 50) JOIN p USING (id)""",
    ),
)
def risk_summary_text(spark, folder):
    return explain.file_explanation(_report_rows(spark, folder, 50)).select("id", "summary")


def _report_rows(spark, folder, k):
    """Report rows as a finished report holds them: stored, then read back."""
    scored, long = _scored_attributions(spark, folder)
    rounded = long.withColumn("attribution", F.round("attribution", 9))
    return write_table(explain.report_rows(scored, rounded, k), fresh_path(spark, "report-rows"))


@query("risk_report")
def risk_report(spark, folder):
    """On-demand report: activity and structure, scored by a stored model."""
    path = fresh_path(spark, "model")
    log = bind.stored_log(spark, folder)
    matrix = bind.stored_matrix(spark, folder, log)
    training.refit_final(matrix, bind.FEATURES, SMALL_TREES, 5, path)
    model, names = training.load_model(spark, path)
    return flows.analyze(log, model, names, datetime(2001, 6, 1))[0]


@query("training_flow")
def training_flow(spark, folder):
    """Matrix with structure, training matrix, cross-validated model, evaluation."""
    matrix = flows.windowed_matrix(bind.log_with_source(spark, folder))
    stored = write_table(matrix, fresh_path(spark, "flow-matrix"))
    ready, names = flows.training_matrix(stored, {}, 0.3, ROW_KEYS)
    kept = write_table(ready, fresh_path(spark, "flow-training"))
    done = flows.train(kept, names, SMALL_TREES, fresh_path(spark, "flow-model"), ROW_KEYS, k=2)
    return flows.evaluation_tables(done.oof, done.threshold)["summary"]


@query("file_explanation")
def file_explanation(spark, folder):
    rows = _report_rows(spark, folder, 20)
    vectors = _file_embeddings(spark, folder)
    parts = F.split("id", "#")
    with_file = rows.withColumns({"repo_name": parts[0], "file_path": parts[1]})
    own = with_file.join(vectors, FILE_KEYS, "left").select("id", "embedding")
    return explain.file_explanation(rows, own)


# --- run log -------------------------------------------------------------------------


@query(
    "run_leaderboard",
    """WITH g AS (SELECT o_orderpriority AS experiment, CAST(o_custkey AS VARCHAR) AS run_id,
  CASE WHEN o_custkey % 3 <> 0 THEN round(avg(o_totalprice) / CAST(1000000 AS DOUBLE), 4) END AS a,
  round(max(o_totalprice) / CAST(1000000 AS DOUBLE), 4) AS ca, count(*) AS n FROM orders GROUP BY o_orderpriority, o_custkey)
SELECT experiment, run_id, CASE WHEN CAST(run_id AS BIGINT) % 2 = 0 THEN 'run-' || run_id ELSE substr(run_id, 1, 8) END AS run_name, round(coalesce(a, ca, 0), 4) AS auc,
  CAST(0 AS DOUBLE) AS f1, CAST(0 AS DOUBLE) AS precision_at_20, CAST(n AS INTEGER) AS n_features FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY a DESC NULLS LAST, run_id) AS rn FROM g) WHERE rn <= 10""",
)
def run_leaderboard(spark, folder):
    customer = F.col("o_custkey")
    table_ = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("experiment"), customer)
        .agg(
            F.round(F.avg("o_totalprice") / 1000000.0, 4).alias("avg_price"),
            F.round(F.max("o_totalprice") / 1000000.0, 4).alias("cv_mean_auc"),
            F.count(F.lit(1)).cast("int").alias("n_features"),
        )
        .select(
            "experiment",
            customer.cast("string").alias("run_id"),
            F.when(customer % 2 == 0, F.concat(F.lit("run-"), customer.cast("string"))).alias("run_name"),
            F.when(customer % 3 != 0, F.col("avg_price")).alias("AUC"),
            "cv_mean_auc",
            F.lit(None).cast("double").alias("F1"),
            F.lit(None).cast("double").alias("cv_mean_f1"),
            F.lit(None).cast("double").alias("Precision_at_20"),
            "n_features",
        )
    )
    return runs.run_leaderboard(table_)


@query(
    "log_run",
    sql(
        "lab",
        """SELECT 'model-training' AS experiment, 'labels' AS run_name, CAST(NULL AS VARCHAR) AS kind_text, 'n_buggy' AS name, CAST(count(*) FILTER (is_buggy) AS DOUBLE) AS value FROM lab
UNION ALL SELECT 'model-training', 'labels', NULL, 'pct_buggy', round(count(*) FILTER (is_buggy) * 100 / CAST(count(*) AS DOUBLE), 2) FROM lab""",
    ).replace("CAST(NULL AS VARCHAR) AS kind_text, ", "").replace("'labels', NULL, 'pct", "'labels', 'pct"),
)
def log_run(spark, folder):
    stats = labels.label_stats(bind.labels(spark, folder)).first()
    share = round(100 * stats["buggy_samples"] / stats["total_samples"], 2)
    rows = runs.run_rows(
        spark,
        "run-1",
        "model-training",
        "labels",
        {"window_days": 90},
        {"n_buggy": stats["buggy_samples"], "pct_buggy": share},
    )
    log = runs.log_run(rows, fresh_path(spark, "run-log"))
    return log.filter("kind = 'metric'").select("experiment", "run_name", "name", "value")
