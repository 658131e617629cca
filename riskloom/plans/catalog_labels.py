"""Queries: labels, activity metrics, joins and cleaning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskloom.functions.timing import plus_days
from riskloom.operators import cleaning, joins, labels, predicates, process
from riskloom.operators.history import store_history
from riskloom.operators.labels import date_span
from riskloom.plans import bindings as bind
from riskloom.plans import sqltext
from riskloom.plans.registry import query
from riskloom.plans.sqltext import sql
from riskloom.sources import benchmark
from riskloom.sources.tables import table


def more(tables, ctes, select):
    """A check with further common tables after the bindings."""
    return sql(tables, f"WITH {ctes}\n{select}")


# --- labels --------------------------------------------------------------------


@query("label_windows", sql("lab", "SELECT window_no, window_start, window_end FROM w"))
def label_windows(spark, folder):
    return labels.label_windows(bind.change_log(spark, folder))


@query("windowed_labels", sql("lab", "SELECT * FROM lab"))
def windowed_labels(spark, folder):
    return bind.labels(spark, folder)


_LONG_HORIZON = """fy AS (SELECT DISTINCT c.repo_name, c.file_path, v.window_no FROM cl c
    JOIN v ON c.commit_date >= v.window_end AND c.commit_date < v.window_end + INTERVAL 100 DAY WHERE c.is_bug_fix),
  n AS (SELECT c.repo_name, c.file_path, v.window_no, v.window_start, v.window_end, count(*) AS commits_in_window,
    CAST(sum(CASE WHEN c.is_bug_fix THEN 1 ELSE 0 END) AS BIGINT) AS bug_fix_commits_in_window
    FROM cl c JOIN v ON c.commit_date >= v.window_start AND c.commit_date < v.window_end GROUP BY ALL HAVING count(*) >= 2)"""


@query(
    "windowed_labels_long_horizon",
    more(
        "cl",
        """x AS (SELECT min(commit_date) AS lo, max(commit_date) AS hi FROM cl),
  v AS (SELECT CAST(k AS BIGINT) AS window_no, lo + to_days(CAST(k * 60 AS INTEGER)) AS window_start,
    lo + to_days(CAST((k + 1) * 60 AS INTEGER)) AS window_end
    FROM x, generate_series(0, 2000) g(k) WHERE lo + to_days(CAST((k + 1) * 60 AS INTEGER)) < hi),
  """
        + _LONG_HORIZON,
        "SELECT n.*, fy.file_path IS NOT NULL AS is_buggy FROM n LEFT JOIN fy USING (repo_name, file_path, window_no)",
    ),
)
def windowed_labels_long_horizon(spark, folder):
    return labels.windowed_labels(bind.change_log(spark, folder), 60, 100)


@query(
    "simple_labels",
    sql(
        "cl",
        """SELECT repo_name, file_path, bool_or(is_bug_fix) AS is_buggy, count(*) AS total_commits,
  CAST(sum(CASE WHEN is_bug_fix THEN 1 ELSE 0 END) AS BIGINT) AS bug_fix_commits,
  min(commit_date) AS first_seen, max(commit_date) AS last_seen FROM cl GROUP BY ALL""",
    ),
)
def simple_labels(spark, folder):
    return labels.simple_labels(bind.change_log(spark, folder))


@query(
    "label_stats",
    sql(
        "lab",
        """SELECT *, CASE WHEN bug_ratio < 0.1 THEN 'few positives: weight the classes strongly'
  WHEN bug_ratio > 0.4 THEN 'classes are about even' ELSE 'fewer positives than negatives: weight the classes' END AS balance_warning
FROM (SELECT count(*) AS total_samples, count(*) FILTER (is_buggy) AS buggy_samples, count(*) FILTER (NOT is_buggy) AS clean_samples,
  round(count(*) FILTER (is_buggy) / CAST(count(*) AS DOUBLE), 4) AS bug_ratio,
  count(DISTINCT (repo_name, file_path)) AS unique_files FROM lab)""",
    ),
)
def label_stats(spark, folder):
    return labels.label_stats(bind.labels(spark, folder))


@query(
    "min_touch_labels",
    more(
        "cl",
        """g AS (SELECT *, regexp_matches(coalesce(commit_message, ''), '(?i)\\b(fix(es|ed|ing)?|memory[\\s_-]?leak)\\b')
    AND count(*) OVER (PARTITION BY repo_name, commit_hash) <= 15 AS touch FROM cl)""",
        """SELECT repo_name, file_path, CAST(sum(CASE WHEN touch THEN 1 ELSE 0 END) AS BIGINT) AS fix_touches,
  CASE WHEN sum(CASE WHEN touch THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS is_buggy FROM g GROUP BY ALL""",
    ),
)
def min_touch_labels(spark, folder):
    from riskloom.functions.text import fix_flag_strict

    log = bind.change_log(spark, folder).withColumn(
        "is_bug_fix", fix_flag_strict(F.col("commit_message"))
    )
    return labels.min_touch_labels(predicates.large_change_gate(log))


@query("label_fallback", sql("lab", "SELECT * FROM lab"))
def label_fallback(spark, folder):
    return labels.labels_by(bind.change_log(spark, folder), "windowed")


_CAPS = {"repo_11": 0.2, "repo_22": 0.25, "repo_33": 0.9}


@query(
    "cap_positive_rate",
    more(
        "fm",
        """c AS (SELECT *, CASE repo_name WHEN 'repo_11' THEN CAST(0.2 AS DOUBLE) WHEN 'repo_22' THEN CAST(0.25 AS DOUBLE)
    WHEN 'repo_33' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS cap FROM fm),
  d AS (SELECT *, count(*) OVER (PARTITION BY repo_name) AS n, sum(is_buggy) OVER (PARTITION BY repo_name) AS p,
    row_number() OVER (PARTITION BY repo_name, is_buggy ORDER BY fix_density NULLS LAST,
      md5(repo_name || '|' || file_path || '|' || CAST(window_no AS VARCHAR))) AS rn FROM c)""",
        """SELECT repo_name, file_path, window_no, fix_density,
  CASE WHEN is_buggy = 1 AND p / CAST(n AS DOUBLE) > cap AND rn <= p - floor(n * cap) THEN 0 ELSE is_buggy END AS is_buggy FROM d""",
    ),
)
def cap_positive_rate(spark, folder):
    matrix = bind.stored_matrix(spark, folder).select(
        "repo_name", "file_path", "window_no", "fix_density", "is_buggy"
    )
    return labels.cap_positive_rate(
        matrix, _CAPS, 0.3, ids=["repo_name", "file_path", "window_no"]
    )


@query(
    "collapse_any",
    sql("lab", "SELECT repo_name, file_path, max(CAST(is_buggy AS INTEGER)) AS is_buggy FROM lab GROUP BY ALL"),
)
def collapse_any(spark, folder):
    return labels.collapse_any(bind.labels(spark, folder))


@query(
    "collapse_last",
    more(
        "fm",
        """g AS (SELECT * REPLACE (CASE WHEN (window_no + code_churn_90d) % 3 = 0 THEN NULL ELSE code_churn_90d END AS code_churn_90d) FROM fm)""",
        """SELECT repo_name, file_path, arg_max(code_churn_90d, window_end) FILTER (code_churn_90d IS NOT NULL) AS code_churn_90d,
  arg_max(fix_density, window_end) AS fix_density, max(is_buggy) AS is_buggy, max(window_end) AS commit_date FROM g GROUP BY ALL""",
    ),
)
def collapse_last(spark, folder):
    churn = F.col("code_churn_90d")
    matrix = bind.feature_matrix(spark, folder).withColumn(
        "code_churn_90d", F.when((F.col("window_no") + churn) % 3 != 0, churn)
    )
    return labels.collapse_last(matrix, ["code_churn_90d", "fix_density"])


@query(
    "align_labels_by_name",
    more(
        "lab",
        """f AS (SELECT repo_name, file_path, max(CAST(is_buggy AS INTEGER)) AS is_buggy FROM lab GROUP BY ALL),
  e AS (SELECT file_path AS np, max(is_buggy) AS y FROM f GROUP BY ALL),
  m AS (SELECT split_part(file_path, '/', -1) AS nm, CAST(avg(is_buggy) >= 0.5 AS INTEGER) AS y FROM f GROUP BY ALL),
  s AS (SELECT DISTINCT l_partkey, CASE l_partkey % 3 WHEN 0 THEN './' || file_path WHEN 1 THEN 'other/' || filename ELSE 'other/x' || filename END AS file_path FROM cl)""",
        """SELECT s.file_path, coalesce(e.y, m.y) AS is_buggy FROM s
  LEFT JOIN e ON e.np = regexp_replace(s.file_path, '^[./]+', '')
  LEFT JOIN m ON m.nm = split_part(s.file_path, '/', -1) WHERE coalesce(e.y, m.y) IS NOT NULL""",
    ),
)
def align_labels_by_name(spark, folder):
    marked = labels.collapse_any(bind.labels(spark, folder))
    log = bind.change_log(spark, folder, [F.col("l_partkey")])
    kind = F.col("l_partkey") % 3
    sources = log.select(
        F.when(kind == 0, F.concat(F.lit("./"), F.col("file_path")))
        .when(kind == 1, F.concat(F.lit("other/"), F.col("filename")))
        .otherwise(F.concat(F.lit("other/x"), F.col("filename")))
        .alias("file_path")
    ).distinct()
    return labels.align_labels_by_name(sources, marked)


# --- activity metrics -------------------------------------------------------------

_METRICS = {
    "churn_30_90": ["code_churn_30d", "code_churn_90d"],
    "commit_counts": ["commit_count_30d", "commit_count_90d"],
    "author_count": ["author_count_90d"],
    "fix_metrics": ["bug_fix_count_90d", "fix_density"],
    "days_since_change": ["days_since_last_change"],
    "commit_burst": ["commit_burst_30d"],
    "ownership": ["ownership_score"],
}


def _metric_query(name, columns):
    listed = ", ".join(columns)
    statement = sql("fm", f"SELECT repo_name, file_path, window_end, {listed} FROM proc")

    @query(name, statement)
    def run(spark, folder):
        log = bind.change_log(spark, folder)
        span = date_span(log)
        refs = labels.windowed_labels(log, span=span).select("repo_name", "file_path", "window_no")
        metrics = process.metrics_on_grid(refs, log, span)
        return metrics.select("repo_name", "file_path", "window_end", *columns)

    return run


for _name, _columns in _METRICS.items():
    _metric_query(_name, _columns)


@query(
    "process_features",
    sql("fm", "SELECT repo_name, file_path, window_no, is_buggy, window_end, code_churn_30d, code_churn_90d, commit_count_30d, commit_count_90d, author_count_90d, bug_fix_count_90d, fix_density, days_since_last_change, commit_burst_30d, ownership_score FROM fm"),
)
def process_features(spark, folder):
    past = bind.history(spark, folder)
    marked = labels.windowed_labels(past.changes, span=past.span)
    marked = marked.withColumn("is_buggy", F.col("is_buggy").cast("int"))
    return process.process_features(marked, past.changes, past.span)


@query(
    "process_features_pairs",
    more(
        "lab",
        "off AS (SELECT repo_name, file_path, window_end - INTERVAL 7 DAY AS window_end FROM lab),\n"
        + sqltext.process("off"),
        "SELECT * EXCLUDE (bug_fix_count_90d) FROM proc",
    ),
)
def process_features_pairs(spark, folder):
    past = bind.history(spark, folder)
    pairs = labels.windowed_labels(past.changes, span=past.span).select(
        "repo_name", "file_path", plus_days(F.col("window_end"), -7).alias("window_end")
    )
    return process.process_features_pairs(pairs, past)


@query(
    "process_snapshot",
    more(
        "cl",
        """r AS (SELECT TIMESTAMP '2001-06-01 12:00:00' AS ref),
  tp AS (SELECT repo_name, file_path, max(n) AS top FROM (SELECT repo_name, file_path, author_email, count(*) AS n FROM cl GROUP BY ALL) GROUP BY ALL),
  g AS (SELECT repo_name, file_path, ref AS window_end, CAST(min(commit_date) AS DATE) AS first_seen, CAST(max(commit_date) AS DATE) AS last_seen,
    count(*) AS total_commits, CAST(sum(CAST(is_bug_fix AS INTEGER)) AS BIGINT) AS bug_fix_commits,
    CAST(coalesce(sum(lines_changed) FILTER (commit_date >= ref - INTERVAL 30 DAY), 0) AS BIGINT) AS code_churn_30d,
    CAST(coalesce(sum(lines_changed) FILTER (commit_date >= ref - INTERVAL 90 DAY), 0) AS BIGINT) AS code_churn_90d,
    count(*) FILTER (commit_date >= ref - INTERVAL 30 DAY) AS commit_count_30d,
    count(*) FILTER (commit_date >= ref - INTERVAL 90 DAY) AS commit_count_90d,
    count(DISTINCT author_email) FILTER (commit_date >= ref - INTERVAL 90 DAY) AS author_count_90d,
    count(*) FILTER (is_bug_fix AND commit_date >= ref - INTERVAL 90 DAY) AS bug_fix_count_90d,
    greatest(date_sub('day', max(commit_date), ref), 0) AS days_since_last_change
    FROM cl, r GROUP BY repo_name, file_path, ref HAVING count(*) >= 3)""",
        """SELECT g.*, round(bug_fix_count_90d / CAST(greatest(commit_count_90d, 1) AS DOUBLE), 4) AS fix_density,
  round(commit_count_30d / CAST(greatest(commit_count_90d, 1) AS DOUBLE), 4) AS commit_burst_30d,
  round(top / CAST(greatest(total_commits, 1) AS DOUBLE), 4) AS ownership_score FROM g JOIN tp USING (repo_name, file_path)""",
    ),
)
def process_snapshot(spark, folder):
    return process.process_snapshot(bind.change_log(spark, folder), datetime(2001, 6, 1, 12))


@query(
    "process_report",
    more(
        "cl",
        """r AS (SELECT TIMESTAMP '2001-06-01 12:00:00' AS ref),
  fl AS (SELECT DISTINCT repo_name, file_path FROM cl),
  h AS (SELECT cl.*, ref FROM cl, r WHERE commit_date >= ref - INTERVAL 365 DAY),
  tp AS (SELECT repo_name, file_path, max(n) AS top FROM (SELECT repo_name, file_path, author_email, count(*) AS n FROM h GROUP BY ALL) GROUP BY ALL),
  g AS (SELECT repo_name, file_path, count(*) AS n, count(*) FILTER (commit_date >= ref - INTERVAL 30 DAY) AS c30,
    count(*) FILTER (commit_date >= ref - INTERVAL 90 DAY) AS c90,
    count(DISTINCT author_email) FILTER (commit_date >= ref - INTERVAL 90 DAY) AS a90,
    count(*) FILTER (is_bug_fix AND commit_date >= ref - INTERVAL 90 DAY) AS f90,
    greatest(date_sub('day', max(commit_date), ref), 0) AS days FROM h GROUP BY repo_name, file_path, ref)""",
        """SELECT repo_name, file_path, coalesce(c30, 0) AS commit_count_30d, coalesce(c90, 0) AS commit_count_90d,
  coalesce(c30, 0) * 10 AS code_churn_30d, coalesce(c90, 0) * 10 AS code_churn_90d, coalesce(a90, 0) AS author_count_90d,
  coalesce(f90, 0) AS bug_fix_count_90d, round(coalesce(f90, 0) / CAST(greatest(coalesce(c90, 0), 1) AS DOUBLE), 4) AS fix_density,
  coalesce(days, 365) AS days_since_last_change,
  round(coalesce(c30, 0) / greatest(coalesce(c90, 0) / CAST(3 AS DOUBLE), CAST(1 AS DOUBLE)), 4) AS commit_burst_30d,
  coalesce(round(top / CAST(n AS DOUBLE), 4), CAST(1 AS DOUBLE)) AS ownership_score
FROM fl LEFT JOIN g USING (repo_name, file_path) LEFT JOIN tp USING (repo_name, file_path)""",
    ),
)
def process_report(spark, folder):
    log = bind.change_log(spark, folder)
    files = log.select("repo_name", "file_path")
    return process.process_report(files, log, datetime(2001, 6, 1, 12), 365)


# --- joins -----------------------------------------------------------------------


@query(
    "match_modules_to_history",
    more(
        "cl md",
        """a AS (SELECT file_path, max(commit_date) AS d FROM cl GROUP BY ALL),
  n AS (SELECT filename, max(commit_date) AS d FROM cl GROUP BY ALL)""",
        """SELECT md.file_path, md.is_buggy, coalesce(a.d, n.d) IS NOT NULL AS has_git_match,
  coalesce(a.d, n.d, (SELECT max(commit_date) FROM cl)) AS window_end
FROM md LEFT JOIN a ON a.file_path = md.file_path LEFT JOIN n ON n.filename = split_part(md.file_path, '/', -1)""",
    ),
)
def match_modules_to_history(spark, folder):
    return joins.match_modules_to_history(
        bind.modules(spark, folder), bind.change_log(spark, folder)
    )


def _as_of_check(condition):
    return more(
        "src",
        f"""rf AS (SELECT DISTINCT repo_name, file_path, filename, CAST(date_trunc('year', commit_date) AS TIMESTAMP) + INTERVAL 200 DAY AS window_end FROM src),
  c AS (SELECT rf.repo_name, rf.file_path, rf.window_end, s.source_code,
    row_number() OVER (PARTITION BY rf.repo_name, rf.file_path, rf.window_end ORDER BY s.commit_date DESC, sha256(s.source_code) DESC) AS rn
    FROM rf JOIN src s ON s.repo_name = rf.repo_name AND ({condition}) AND s.commit_date <= rf.window_end
    WHERE s.source_code IS NOT NULL)""",
        """SELECT rf.repo_name, rf.file_path, rf.window_end, CASE WHEN trim(c.source_code) <> '' THEN c.source_code END AS source_code,
  CASE WHEN trim(c.source_code) <> '' THEN sha256(c.source_code) END AS digest
FROM rf LEFT JOIN c ON c.repo_name = rf.repo_name AND c.file_path = rf.file_path AND c.window_end = rf.window_end AND c.rn = 1""",
    )


def _yearly_refs(log):
    return log.select(
        "repo_name",
        "file_path",
        plus_days(F.date_trunc("year", "commit_date").cast("timestamp_ntz"), 200).alias("window_end"),
    ).distinct()


@query("source_as_of", _as_of_check("s.file_path = rf.file_path"))
def source_as_of(spark, folder):
    past = bind.history_with_source(spark, folder)
    return joins.source_as_of(_yearly_refs(past.changes), past)


@query(
    "source_as_of_by_name",
    _as_of_check("s.file_path = rf.file_path OR s.filename = rf.filename"),
)
def source_as_of_by_name(spark, folder):
    log = bind.log_with_source(spark, folder)
    past = store_history(log.select("repo_name", "file_path", "commit_date", "source_code"), "source_code")
    return joins.source_as_of(_yearly_refs(past.changes), past, match_names=True)


@query(
    "lookup_vector_or_zero",
    """SELECT o_orderkey AS id, o_totalprice AS total, CASE WHEN e.vec_id IS NULL THEN list_concat([CAST(o_totalprice AS FLOAT)], CAST(repeat([0], 64) AS FLOAT[]))
  ELSE list_concat([CAST(o_totalprice AS FLOAT)], CAST(e.embedding AS FLOAT[])) END AS hybrid
FROM orders LEFT JOIN embeddings e ON e.vec_id = o_orderkey""",
)
def lookup_vector_or_zero(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total")
    )
    known = bind.vectors(spark, folder)
    return joins.lookup_vector_or_zero(rows, known, ["id"], 64, ["total"]).drop("embedding")


_REPAIR = """n AS (SELECT repo_name, file_path, max(commit_date) AS d FROM cl GROUP BY ALL),
  i AS (SELECT DISTINCT repo_name, CASE WHEN l_partkey % 5 = 1 THEN 'gone/' || file_path ELSE file_path END AS file_path, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN TIMESTAMP '2005-05-05'
      ELSE TIMESTAMP '1999-01-01' + to_days(CAST(l_partkey % 900 AS INTEGER)) END AS last_seen,
    CASE WHEN l_partkey % 4 <> 0 THEN l_partkey % 700 END AS days_since_last_change FROM cl),
  k AS (SELECT i.*, n.d, TIMESTAMP '2002-01-01' - to_days(CAST(coalesce(days_since_last_change, 365) AS INTEGER)) AS est
    FROM i LEFT JOIN n USING (repo_name, file_path)),
  z AS (SELECT *, CASE WHEN last_seen < TIMESTAMP '2001-01-01' THEN last_seen ELSE coalesce(CAST(date_trunc('day', d) AS TIMESTAMP), est) END AS f FROM k),
  fixed AS (SELECT repo_name, file_path, days_since_last_change, CASE WHEN f >= TIMESTAMP '2001-01-01' THEN est ELSE f END AS last_seen FROM z)"""


def _repaired(spark, folder):
    log = bind.change_log(spark, folder, [F.col("l_partkey")])
    part = F.col("l_partkey")
    base = F.lit(datetime(1999, 1, 1)).cast("timestamp_ntz")
    raw = log.select("repo_name", "file_path", part).distinct().select(
        "repo_name",
        # Files that the history does not know.
        F.when(part % 5 == 1, F.concat(F.lit("gone/"), "file_path")).otherwise(F.col("file_path")).alias("file_path"),
        F.when(part % 5 == 0, F.lit(None).cast("timestamp_ntz"))
        .when(part % 5 == 1, F.lit(datetime(2005, 5, 5)).cast("timestamp_ntz"))
        .otherwise(plus_days(base, part % 900))
        .alias("last_seen"),
        F.when(part % 4 != 0, part % 700).alias("days_since_last_change"),
    )
    return joins.repair_dates(
        raw, log, datetime(2002, 1, 1), datetime(2001, 1, 1), default_days=365
    )


@query("repair_dates", more("cl", _REPAIR, "SELECT * FROM fixed"))
def repair_dates(spark, folder):
    return _repaired(spark, folder)


@query(
    "real_date_share",
    more(
        "cl",
        _REPAIR,
        """SELECT count(*) FILTER (last_seen < TIMESTAMP '2001-01-01') AS real_dates, count(*) AS total_rows,
  round(count(*) FILTER (last_seen < TIMESTAMP '2001-01-01') * 100 / CAST(count(*) AS DOUBLE), 1) AS real_percent FROM fixed""",
    ),
)
def real_date_share(spark, folder):
    return joins.real_date_share(_repaired(spark, folder), datetime(2001, 1, 1))


@query(
    "choose_event_date",
    sql("cl", "SELECT repo_name, file_path, max(commit_date) AS commit_date, count(*) AS total_commits FROM cl GROUP BY ALL"),
)
def choose_event_date(spark, folder):
    simple = labels.simple_labels(bind.change_log(spark, folder))
    with_both = simple.withColumn("window_end", F.col("first_seen"))
    return joins.choose_event_date(with_both).select(
        "repo_name", "file_path", "commit_date", "total_commits"
    )


@query(
    "date_lookup_join",
    sql(
        "lab",
        """SELECT s.repo_name, s.file_path, s.n, d.window_end FROM (SELECT repo_name, file_path, count(*) AS n FROM cl GROUP BY ALL) s
LEFT JOIN (SELECT repo_name, file_path, min(window_end) AS window_end FROM lab GROUP BY ALL) d USING (repo_name, file_path)""",
    ),
)
def date_lookup_join(spark, folder):
    log = bind.change_log(spark, folder)
    files = log.groupBy("repo_name", "file_path").agg(F.count(F.lit(1)).alias("n"))
    dates = labels.windowed_labels(log)
    return joins.date_lookup_join(files, dates.select("repo_name", "file_path", "window_end"))


@query(
    "coverage_join",
    """SELECT count(*) FILTER (e.vec_id IS NOT NULL) AS covered_rows, count(*) AS total_rows,
  round(count(*) FILTER (e.vec_id IS NOT NULL) * 100 / CAST(count(*) AS DOUBLE), 1) AS covered_percent
FROM orders LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 9 <> 0) e ON e.vec_id = o_orderkey""",
)
def coverage_join(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    zeroed = bind.vectors(spark, folder).withColumn(
        "embedding",
        F.when(
            F.col("id") % 9 == 0, F.transform("embedding", lambda x: x * F.lit(0).cast("float"))
        ).otherwise(F.col("embedding")),
    )
    return joins.coverage_join(rows, joins.non_zero_vectors(zeroed), ["id"])


@query(
    "source_coverage",
    sql(
        "src",
        """SELECT count(*) FILTER (s.file_path IS NOT NULL) AS covered_rows, count(*) AS total_rows,
  round(count(*) FILTER (s.file_path IS NOT NULL) * 100 / CAST(count(*) AS DOUBLE), 1) AS covered_percent
FROM (SELECT DISTINCT repo_name, file_path FROM src) f
LEFT JOIN (SELECT DISTINCT repo_name, file_path FROM src WHERE trim(source_code) <> '') s USING (repo_name, file_path)""",
    ),
)
def source_coverage(spark, folder):
    from riskloom.sources.snapshots import latest_source_snapshot

    log = bind.log_with_source(spark, folder)
    early = log
    files = log.select("repo_name", "file_path").distinct()
    return joins.coverage_join(files, latest_source_snapshot(early), ["repo_name", "file_path"])


# --- cleaning -----------------------------------------------------------------------

_GAPS = ["quantity", "tax", "price"]
_GAP_KEYS = "repo_name, file_path, change, line_no"


@query(
    "impute_global_median",
    sql(
        "gm",
        f"""SELECT {_GAP_KEYS}, is_buggy, price, coalesce(quantity, (SELECT median(quantity) FROM gm)) AS quantity,
  coalesce(tax, (SELECT median(tax) FROM gm)) AS tax FROM gm""",
    ),
)
def impute_global_median(spark, folder):
    return cleaning.impute_global_median(bind.gappy_matrix(spark, folder), ["quantity", "tax"])


@query(
    "impute_group_median",
    more(
        "gm",
        """m AS (SELECT repo_name, median(quantity) AS mq, median(tax) AS mt, median(price) AS mp FROM gm GROUP BY ALL),
  f AS (SELECT gm.* REPLACE (coalesce(quantity, mq) AS quantity, coalesce(tax, mt) AS tax, coalesce(price, mp) AS price) FROM gm JOIN m USING (repo_name))""",
        f"""SELECT {_GAP_KEYS}, is_buggy, coalesce(quantity, (SELECT median(quantity) FROM f)) AS quantity,
  coalesce(tax, (SELECT median(tax) FROM f)) AS tax, round(coalesce(price, (SELECT median(price) FROM f)), 6) AS price FROM f""",
    ),
)
def impute_group_median(spark, folder):
    filled = cleaning.impute_group_median(bind.gappy_matrix(spark, folder), _GAPS)
    return filled.withColumn("price", F.round("price", 6))


@query(
    "drop_sparse_rows",
    sql(
        "gm",
        """SELECT * FROM gm WHERE 5 + CAST(quantity IS NOT NULL AS INTEGER) + CAST(tax IS NOT NULL AS INTEGER)
  + CAST(price IS NOT NULL AS INTEGER) >= 0.8 * 8""",
    ),
)
def drop_sparse_rows(spark, folder):
    return benchmark.drop_sparse_rows(bind.gappy_matrix(spark, folder), 0.8)


@query(
    "clean_benchmark_modules",
    more(
        "bm",
        """k AS (SELECT * FROM bm WHERE 6 + CAST(halstead_volume IS NOT NULL AS INTEGER) + CAST(lines_of_comments IS NOT NULL AS INTEGER)
    + CAST(is_buggy IS NOT NULL AS INTEGER) + CAST(module_kind IS NOT NULL AS INTEGER) >= 7)""",
        """SELECT * EXCLUDE (row_key) REPLACE (coalesce(halstead_volume, (SELECT median(halstead_volume) FROM k)) AS halstead_volume,
  coalesce(lines_of_comments, (SELECT median(lines_of_comments) FROM k)) AS lines_of_comments) FROM k""",
    ),
)
def clean_benchmark_modules(spark, folder):
    loaded = benchmark.load_benchmark_modules(bind.benchmark_rows(spark, folder), "KC1", "row_key")
    return benchmark.clean_benchmark_modules(loaded)


@query(
    "null_audit",
    sql(
        "gm",
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, round(count(*) FILTER ({c} IS NULL) * 100 / CAST(count(*) AS DOUBLE), 1) AS null_percent FROM gm"
            for c in [*_GAPS, "is_buggy"]
        )
        + ")",
    ),
)
def null_audit(spark, folder):
    return cleaning.null_audit(bind.gappy_matrix(spark, folder), [*_GAPS, "is_buggy"])


@query(
    "validate_no_nulls",
    sql("gm", "SELECT count(*) AS valid_rows FROM gm"),
)
def validate_no_nulls(spark, folder):
    filled = cleaning.impute_group_median(bind.gappy_matrix(spark, folder), _GAPS)
    return cleaning.validate_no_nulls(filled, _GAPS).agg(F.count(F.lit(1)).alias("valid_rows"))


@query(
    "quality_report",
    sql(
        "gm",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, round(min({x}), 4) AS min_value, round(max({x}), 4) AS max_value,
  round(avg({x}), 4) AS mean_value, round(stddev_samp({x}), 4) AS std_value, coalesce(min({c}) = max({c}), false) AS zero_variance,
  coalesce(avg({c}) > 0 AND max({c}) > 10 * avg({c}), false) AS heavy_outliers FROM gm"""
            for c, x in [(c, f"CAST({c} AS DOUBLE)") for c in [*_GAPS, "is_buggy", "line_no"]]
        ),
    ),
)
def quality_report(spark, folder):
    return cleaning.quality_report(
        bind.gappy_matrix(spark, folder), [*_GAPS, "is_buggy", "line_no"]
    )


@query(
    "duplicate_rows",
    sql(
        "cl",
        """SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM (
  SELECT repo_name, file_path, commit_hash, count(*) AS c FROM cl GROUP BY ALL)""",
    ),
)
def duplicate_rows(spark, folder):
    log = bind.change_log(spark, folder)
    return cleaning.duplicate_rows(log.select("repo_name", "file_path", "commit_hash"))


@query(
    "group_coverage",
    sql(
        "gm",
        """SELECT 'first' AS column_group, 2 AS columns_in_group, round(avg(CASE WHEN quantity IS NOT NULL OR price IS NOT NULL THEN 1 ELSE 0 END) * 100, 1) AS coverage_percent FROM gm
UNION ALL SELECT 'second', 1, round(avg(CASE WHEN tax IS NOT NULL THEN 1 ELSE 0 END) * 100, 1) FROM gm""",
    ),
)
def group_coverage(spark, folder):
    return cleaning.group_coverage(
        bind.gappy_matrix(spark, folder), {"first": ["quantity", "price"], "second": ["tax"]}
    )


@query(
    "flagship_risky_windows",
    sql(
        "fm",
        """SELECT repo_name, file_path, window_end, is_buggy, fix_density, commit_count_90d, ownership_score
FROM fm ORDER BY fix_density DESC, commit_count_90d DESC, file_path, window_end LIMIT 20""",
    ),
)
def flagship_risky_windows(spark, folder):
    """Labels, metrics as of each window end, then the windows with most fixes."""
    matrix = bind.feature_matrix(spark, folder)
    return (
        matrix.select(
            "repo_name",
            "file_path",
            "window_end",
            "is_buggy",
            "fix_density",
            "commit_count_90d",
            "ownership_score",
        )
        .orderBy(F.desc("fix_density"), F.desc("commit_count_90d"), "file_path", "window_end")
        .limit(20)
    )
