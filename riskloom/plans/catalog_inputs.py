"""Queries: sources, filters, scalar expressions, distinct keys and top-k."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.operators import cleaning, predicates, topk
from riskloom.plans import bindings as bind
from riskloom.plans.registry import query
from riskloom.plans.sqltext import sql
from riskloom.session import fresh_path
from riskloom.sources import benchmark, change_log, committed, dumps, snapshots
from riskloom.sources.tables import read_scored, table, write_table

# --- sources -----------------------------------------------------------------


@query(
    "load_change_log",
    sql(
        "cl",
        """SELECT repo_name, commit_hash, line_no,
  CASE WHEN commit_hash % 50 = 1 THEN commit_date - INTERVAL 2 HOUR ELSE commit_date END AS commit_date,
  CASE WHEN line_no = 3 THEN false ELSE is_bug_fix END AS is_bug_fix,
  CASE WHEN lines_added > 45 THEN 0 ELSE lines_changed END AS lines_changed,
  CASE WHEN l_partkey % 100 = 0 THEN 'unknown' ELSE file_path END AS file_path
FROM cl WHERE commit_hash % 50 <> 0""",
    ),
)
def load_change_log(spark, folder):
    order = F.col("commit_hash")
    raw = bind.change_log(spark, folder, [F.col("l_partkey")]).select(
        "repo_name",
        "commit_hash",
        "line_no",
        F.when(order % 50 == 0, F.lit("not a date"))
        .when(order % 50 == 1, F.concat(F.col("commit_date").cast("string"), F.lit("+02:00")))
        .otherwise(F.col("commit_date").cast("string"))
        .alias("commit_date"),
        F.when(F.col("line_no") != 3, F.col("is_bug_fix")).alias("is_bug_fix"),
        F.when(F.col("lines_added") <= 45, F.col("lines_changed")).alias("lines_changed"),
        F.when(
            F.col("l_partkey") % 100 != 0, F.replace("file_path", F.lit("/"), F.lit("\\"))
        ).alias("file_path"),
    )
    return change_log.clean_change_log(raw)


@query("load_benchmark_modules", sql("bm", "SELECT * EXCLUDE (row_key) FROM bm"))
def load_benchmark_modules(spark, folder):
    return benchmark.load_benchmark_modules(bind.benchmark_rows(spark, folder), "KC1", "row_key")


@query(
    "union_sources",
    """SELECT 'orders' AS dataset_source, o_orderkey AS key, o_orderdate AS at, o_totalprice AS amount, NULL AS kind FROM orders
UNION ALL SELECT 'events', event_id, ts, value, event_type FROM events""",
)
def union_sources(spark, folder):
    union, _ = change_log.union_sources(
        {
            "orders": lambda: table(spark, folder, "orders").select(
                F.col("o_orderkey").alias("key"),
                F.col("o_orderdate").alias("at"),
                F.col("o_totalprice").alias("amount"),
            ),
            "absent": lambda: table(spark, folder, "no_such_table"),
            "events": lambda: table(spark, folder, "events").select(
                F.col("event_id").alias("key"),
                F.col("ts").alias("at"),
                F.col("value").alias("amount"),
                F.col("event_type").alias("kind"),
            ),
        },
        allow_failed=True,
    )
    return union


@query(
    "merge_keep_latest",
    sql(
        "lab",
        """SELECT repo_name, file_path, window_end, commits_in_window, origin FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY window_end DESC, origin DESC) AS rn FROM (
    SELECT *, 'existing' AS origin FROM lab WHERE window_no <= 12
    UNION ALL SELECT *, 'new' FROM lab WHERE window_no >= 12))
WHERE rn = 1""",
    ),
)
def merge_keep_latest(spark, folder):
    marked = bind.labels(spark, folder).select(
        "repo_name", "file_path", "window_no", "window_end", "commits_in_window"
    )
    existing = marked.filter("window_no <= 12").withColumn("origin", F.lit("existing"))
    new = marked.filter("window_no >= 12").withColumn("origin", F.lit("new"))
    return change_log.merge_keep_latest(existing, new).drop("window_no")


@query(
    "merge_committed",
    sql(
        "lab",
        """SELECT repo_name, file_path, window_end, commits_in_window, origin FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY window_end DESC, origin DESC) AS rn FROM (
    SELECT *, 'existing' AS origin FROM lab WHERE window_no <= 12
    UNION ALL SELECT *, 'new' FROM lab WHERE window_no >= 12 AND repo_name < 'repo_3'))
WHERE rn = 1""",
    ),
)
def merge_committed(spark, folder):
    """Two commits to one table; the second replaces the partitions of some repositories."""
    marked = bind.labels(spark, folder).select(
        "repo_name", "file_path", "window_no", "window_end", "commits_in_window"
    )
    path = fresh_path(spark, "committed-labels")
    existing = marked.filter("window_no <= 12").withColumn("origin", F.lit("existing"))
    new = marked.filter("window_no >= 12 and repo_name < 'repo_3'").withColumn("origin", F.lit("new"))
    committed.merge_committed(existing, path, change_log.merge_keep_latest, "repo_name")
    return committed.merge_committed(new, path, change_log.merge_keep_latest, "repo_name").drop("window_no")


@query(
    "fill_missing_from_secondary",
    sql(
        "src",
        """WITH pri AS (SELECT repo_name, file_path, count(*) AS revisions, 'primary' AS origin FROM src
    WHERE is_bug_fix AND commit_date < TIMESTAMP '1997-01-01' GROUP BY ALL),
  sec AS (SELECT repo_name, file_path, count(*) AS revisions, 'secondary' AS origin FROM src GROUP BY ALL)
SELECT * FROM pri UNION ALL
SELECT * FROM sec WHERE NOT EXISTS (SELECT 1 FROM pri WHERE pri.repo_name = sec.repo_name AND pri.file_path = sec.file_path)""",
    ),
)
def fill_missing_from_secondary(spark, folder):
    log = bind.change_log(spark, folder)
    keys = ["repo_name", "file_path"]

    def counted(df, origin):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("revisions")).withColumn(
            "origin", F.lit(origin)
        )

    early = log.filter(F.col("is_bug_fix") & (F.col("commit_date") < F.lit(datetime(1997, 1, 1))))
    return change_log.fill_missing_from_secondary(
        counted(early, "primary"), counted(log, "secondary"), keys
    )


def _matrix_view(view, extra):
    names = ", ".join([*extra, "file_path", "is_buggy", *bind.FEATURES])
    statement = sql("fm", f"SELECT {names} FROM fm").replace(
        "commit_date, file_path", "window_end AS commit_date, file_path"
    )

    @query(f"matrix_{view}", statement)
    def run(spark, folder):
        matrix = bind.feature_matrix(spark, folder).withColumnRenamed("window_end", "commit_date")
        chosen = cleaning.matrix_views(matrix, bind.FEATURES)[view]
        by = ["repo_name"] if "repo_name" in chosen.columns else None
        return write_table(chosen, fresh_path(spark, f"matrix-{view}"), by)

    return run


_matrix_view("clean", [])
_matrix_view("with_repo", ["repo_name"])
_matrix_view("final", ["repo_name", "commit_date"])


@query(
    "latest_source_snapshot",
    sql(
        "src",
        """SELECT repo_name, file_path, source_code FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY commit_date DESC, commit_hash DESC, source_code DESC) AS rn
  FROM src WHERE source_code IS NOT NULL AND trim(source_code) <> '')
WHERE rn = 1""",
    ),
)
def latest_source_snapshot(spark, folder):
    return snapshots.latest_source_snapshot(bind.log_with_source(spark, folder))


@query(
    "path_overlap",
    sql(
        "cl",
        """WITH a AS (SELECT DISTINCT file_path FROM cl WHERE is_bug_fix),
  z AS (SELECT DISTINCT file_path FROM cl WHERE NOT is_bug_fix)
SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM z) AS right_keys,
  (SELECT count(*) FROM a JOIN z USING (file_path)) AS overlap""",
    ),
)
def path_overlap(spark, folder):
    log = bind.change_log(spark, folder)
    return change_log.path_overlap(log.filter("is_bug_fix"), log.filter("not is_bug_fix"))


def n_dump_lines(spark, folder):
    """At most so many: every change has a file."""
    return 2 * table(spark, folder, "lineitem").count()


def dump_lines(spark, folder, header):
    """Dump lines made from the log: a header per change, then its files.

    A thousand changes form one chunk, as a file split would.
    """
    log = bind.change_log(spark, folder)
    headers = log.groupBy("repo_name", "commit_hash").agg(
        F.min("commit_date").alias("at"),
        F.min("author_email").alias("author"),
        F.min("commit_message").alias("subject"),
    )
    chunk = F.floor(F.col("commit_hash") / 1000)
    head = headers.select(
        F.col("repo_name").alias("dump_id"),
        chunk.alias("chunk"),
        (F.col("commit_hash") * 100).alias("pos"),
        header.alias("line"),
    )
    body = log.select(
        F.col("repo_name").alias("dump_id"),
        chunk.alias("chunk"),
        (F.col("commit_hash") * 100 + F.col("line_no")).alias("pos"),
        F.when(F.col("line_no") == 4, F.concat(F.col("file_path"), F.lit(".md")))
        .otherwise(F.col("file_path"))
        .alias("line"),
    )
    return head.unionAll(body)


@query(
    "parse_change_dump",
    sql(
        "cl",
        """WITH h AS (SELECT repo_name, commit_hash, min(commit_date) AS at, min(author_email) AS author,
    coalesce(min(commit_message), 'none') AS subject FROM cl GROUP BY ALL)
SELECT cl.repo_name AS dump_id, CAST(commit_hash AS VARCHAR) AS commit_hash, h.author AS author_email,
  h.at - INTERVAL 2 HOUR AS commit_date, h.subject || ' | more' AS commit_message, file_path
FROM cl JOIN h USING (repo_name, commit_hash) WHERE line_no <> 4""",
    ),
)
def parse_change_dump(spark, folder):
    header = F.concat_ws(
        "|",
        F.col("commit_hash").cast("string"),
        "author",
        F.concat(F.col("at").cast("string"), F.lit(" +02:00")),
        F.concat(F.coalesce("subject", F.lit("none")), F.lit(" | more")),
    )
    return dumps.parse_change_dump(dump_lines(spark, folder, header), n_dump_lines(spark, folder))


@query(
    "parse_date_dump",
    sql(
        "cl",
        """WITH h AS (SELECT repo_name, commit_hash, min(commit_date) AS at FROM cl GROUP BY ALL)
SELECT repo_name AS dump_id, file_path, CAST(date_trunc('day', arg_min(h.at, commit_hash * 100 + line_no)) AS TIMESTAMP) AS last_seen
FROM cl JOIN h USING (repo_name, commit_hash) WHERE line_no <> 4 GROUP BY ALL""",
    ),
)
def parse_date_dump(spark, folder):
    header = F.concat(F.col("at").cast("string"), F.lit(" +0000"))
    return dumps.parse_date_dump(dump_lines(spark, folder, header), n_dump_lines(spark, folder))


@query(
    "scored_roundtrip",
    sql(
        "sc",
        """SELECT CAST(id AS VARCHAR) AS file_path, y AS is_buggy, score AS oof_prob,
  CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS oof_pred FROM sc""",
    ),
)
def scored_roundtrip(spark, folder):
    scored = bind.scored(spark, folder).select(
        F.col("id").cast("string").alias("file_path"),
        F.col("y").alias("is_buggy"),
        F.col("score").alias("oof_prob"),
        (F.col("score") >= 0.5).cast("int").alias("oof_pred"),
    )
    path = fresh_path(spark, "scored")
    write_table(scored, path)
    return read_scored(spark, path)


# --- predicates and expressions ------------------------------------------------


def _flag_query(name, flag, condition):
    statement = sql(
        "cl",
        f"SELECT repo_name, file_path, commit_hash, line_no, coalesce(commit_message, '') AS message, {condition} AS flag FROM cl",
    )

    @query(name, statement)
    def run(spark, folder):
        return bind.change_log(spark, folder).select(
            "repo_name",
            "file_path",
            "commit_hash",
            "line_no",
            F.coalesce("commit_message", F.lit("")).alias("message"),
            flag(F.col("commit_message")).alias("flag"),
        )

    return run


def _matches(message: str, terms) -> str:
    """SQL for a whole-word match of any of the terms."""
    return rf"regexp_matches(coalesce({message}, ''), '(?i)\b(" + "|".join(terms) + r")\b')"


_flag_query(
    "fix_flag_loose",
    text.fix_flag_loose,
    "("
    + " OR ".join(f"contains(lower(coalesce(commit_message, '')), '{w}')" for w in text.FIX_WORDS)
    + "".join(f" OR regexp_matches(lower(coalesce(commit_message, '')), '{p}')" for p in text.ISSUE_REFERENCES)
    + ")",
)
_flag_query(
    "fix_flag_strict",
    text.fix_flag_strict,
    _matches("commit_message", text.STRICT_FIX_TERMS),
)
_flag_query(
    "fix_flag_report",
    text.fix_flag_report,
    _matches("commit_message", text.REPORT_FIX_TERMS),
)


@query(
    "large_change_gate",
    sql(
        "cl",
        """SELECT repo_name, file_path, commit_hash, line_no, n AS files_in_change, is_bug_fix AND n <= 2 AS is_bug_fix
FROM (SELECT *, count(*) OVER (PARTITION BY repo_name, commit_hash) AS n FROM cl)""",
    ),
)
def large_change_gate(spark, folder):
    log = bind.change_log(spark, folder).select(
        "repo_name", "file_path", "commit_hash", "line_no", "is_bug_fix"
    )
    return predicates.large_change_gate(log, max_files=2)


def _renamed_paths(spark, folder):
    """File names in several shapes, to give the path filters something to drop."""
    log = bind.change_log(spark, folder)
    shape = F.col("commit_hash") % 9
    path = F.col("file_path")
    name = (
        F.when(shape == 0, F.replace(path, F.lit("/p"), F.lit("/test_p")))
        .when(shape == 1, F.replace(path, F.lit(".py"), F.lit(".js")))
        .when(shape == 2, F.replace(path, F.lit("/p"), F.lit("/tests/p")))
        .when(shape == 3, F.replace(path, F.lit("/p"), F.lit("/latest_p")))
        .when(shape == 4, F.concat(F.lit("lib/"), path))
        .when(shape == 5, F.replace(path, F.lit("src/"), F.lit("docs/")))
        .otherwise(path)
    )
    return log.withColumn("file_path", name).select(
        "repo_name", "file_path", "commit_hash", "line_no"
    )


_SHAPES = """sh AS (SELECT repo_name, commit_hash, line_no, CASE commit_hash % 9
    WHEN 0 THEN replace(file_path, '/p', '/test_p') WHEN 1 THEN replace(file_path, '.py', '.js')
    WHEN 2 THEN replace(file_path, '/p', '/tests/p') WHEN 3 THEN replace(file_path, '/p', '/latest_p')
    WHEN 4 THEN 'lib/' || file_path WHEN 5 THEN replace(file_path, 'src/', 'docs/') ELSE file_path END AS file_path FROM cl)"""


@query(
    "keep_source_files",
    sql("cl", f"WITH {_SHAPES} SELECT * FROM sh WHERE file_path LIKE '%.py' AND commit_hash % 9 NOT IN (0, 3)"),
)
def keep_source_files(spark, folder):
    return predicates.keep_source_files(_renamed_paths(spark, folder))


_ROOT_REPOS = [f"repo_{n}" for n in range(1, 60) if n % 3]


@query(
    "keep_repo_paths",
    sql(
        "cl",
        f"""WITH {_SHAPES} SELECT * FROM sh
WHERE CAST(substr(repo_name, 6) AS INTEGER) % 3 <> 0
  AND commit_hash % 9 IN (3, 4, 6, 7, 8)""",
    ),
)
def keep_repo_paths(spark, folder):
    roots = {repo: ["src", "missing"] for repo in _ROOT_REPOS}
    return predicates.keep_repo_paths(_renamed_paths(spark, folder), roots)


@query(
    "max_size_filter",
    sql(
        "src",
        """SELECT repo_name, file_path, commit_hash, line_no, source_code FROM src
WHERE coalesce(strlen(source_code), 0) <= 300""",
    ),
)
def max_size_filter(spark, folder):
    log = bind.log_with_source(spark, folder).select(
        "repo_name", "file_path", "commit_hash", "line_no", "source_code"
    )
    return predicates.max_size_filter(log, limit=300)


@query(
    "max_size_filter_documents",
    "SELECT doc_id, n_chars FROM documents WHERE text IS NULL OR strlen(text) <= 4000",
)
def max_size_filter_documents(spark, folder):
    docs = table(spark, folder, "documents")
    return predicates.max_size_filter(docs, "text", 4000).select("doc_id", "n_chars")


@query(
    "history_range",
    sql(
        "cl",
        """SELECT repo_name, file_path, commit_hash, line_no, commit_date FROM cl
WHERE commit_date >= TIMESTAMP '1996-01-01' AND commit_date <= TIMESTAMP '2000-06-30'
  AND commit_date >= TIMESTAMP '2000-12-31' - INTERVAL 730 DAY""",
    ),
)
def history_range(spark, folder):
    log = bind.change_log(spark, folder)
    kept = predicates.history_range(
        log, until=datetime(2000, 6, 30), last_days=730, ref=datetime(2000, 12, 31), since_year=1996
    )
    return kept.select("repo_name", "file_path", "commit_hash", "line_no", "commit_date")


@query(
    "normalize_path",
    """SELECT page_id, replace('.\\x\\' || url, '\\', '/') AS forward,
  regexp_replace(replace('./../' || url, '\\', '/'), '^[./]+', '') AS stripped,
  split_part(url, '/', -1) AS name FROM pages""",
)
def normalize_path(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        text.forward_slashes(F.concat(F.lit(".\\x\\"), url)).alias("forward"),
        text.strip_relative(F.concat(F.lit("./../"), url)).alias("stripped"),
        text.base_name(url).alias("name"),
    )


@query(
    "repo_from_url",
    """SELECT page_id, replace(split_part(rtrim(u, '/'), '/', -1), '.git', '') AS repo FROM (
  SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '.git' ELSE '' END AS u FROM pages)""",
)
def repo_from_url(spark, folder):
    tail = F.when(F.col("page_id") % 3 == 0, "/").when(F.col("page_id") % 3 == 1, ".git").otherwise("")
    return table(spark, folder, "pages").select(
        "page_id", text.repo_from_url(F.concat(F.col("url"), tail)).alias("repo")
    )


@query(
    "change_row_defaults",
    sql(
        "cl",
        """SELECT commit_hash, line_no, substr(coalesce(repeat(commit_message || ' ', 20), ''), 1, 200) AS commit_message,
  CASE WHEN line_no = 2 THEN 'unknown' ELSE author_email END AS author_email,
  CASE WHEN line_no = 3 THEN 0 ELSE lines_added END AS lines_added,
  CASE WHEN line_no = 1 THEN 0 ELSE lines_deleted END AS lines_deleted,
  CASE WHEN line_no = 3 THEN 0 ELSE lines_added END + CASE WHEN line_no = 1 THEN 0 ELSE lines_deleted END AS lines_changed,
  CASE WHEN line_no = 4 THEN filename ELSE file_path END AS file_path
FROM cl""",
    ),
)
def change_row_defaults(spark, folder):
    line = F.col("line_no")
    raw = bind.change_log(spark, folder).select(
        "commit_hash",
        "line_no",
        F.repeat(F.concat(F.col("commit_message"), F.lit(" ")), F.lit(20)).alias("commit_message"),
        F.when(line != 2, F.col("author_email")).alias("author_email"),
        F.when(line != 3, F.col("lines_added")).alias("lines_added"),
        F.when(line != 1, F.col("lines_deleted")).alias("lines_deleted"),
        F.when(line != 4, F.col("file_path")).alias("new_path"),
        F.col("filename").alias("old_path"),
    )
    return change_log.change_row_defaults(raw, 200)


@query(
    "log1p_transform",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + greatest(l_quantity - 10, CAST(0 AS DOUBLE))), 6) AS lines_of_code,
  round(ln(1 + l_extendedprice), 6) AS halstead_effort,
  CASE WHEN l_partkey % 10 <> 0 THEN round(ln(1 + l_tax), 6) END AS halstead_time FROM lineitem""",
)
def log1p_transform(spark, folder):
    raw = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_quantity") - 10).alias("lines_of_code"),
        F.col("l_extendedprice").alias("halstead_effort"),
        F.when(F.col("l_partkey") % 10 != 0, F.col("l_tax")).alias("halstead_time"),
    )
    changed = predicates.log1p_transform(raw)
    return changed.withColumns(
        {c: F.round(c, 6) for c in ("lines_of_code", "halstead_effort", "halstead_time")}
    )


@query(
    "risk_bucket",
    sql(
        "sc",
        """SELECT id, score, CASE WHEN score >= CAST(0.7 AS DOUBLE) THEN 'HIGH' WHEN score >= CAST(0.4 AS DOUBLE) THEN 'MEDIUM'
  ELSE 'LOW' END AS risk_label FROM sc""",
    ),
)
def risk_bucket(spark, folder):
    return bind.scored(spark, folder).select(
        "id", "score", predicates.risk_bucket(F.col("score")).alias("risk_label")
    )


@query(
    "line_count",
    r"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE
  len(regexp_extract_all(text, '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'))
  + CASE WHEN regexp_matches(right(text, 1), '[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]') THEN 0 ELSE 1 END END AS lines
FROM documents""",
)
def line_count(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.line_count(F.col("text")).alias("lines")
    )


@query(
    "drop_leaky_columns",
    sql("fm", "SELECT * EXCLUDE (commits_in_window, bug_fix_commits_in_window, bug_fix_count_90d, window_end) FROM fm"),
)
def drop_leaky_columns(spark, folder):
    from riskloom.schema import LEAKY_FOR_MATRIX

    return cleaning.drop_leaky_columns(bind.feature_matrix(spark, folder), LEAKY_FOR_MATRIX)


@query("drop_sparse_columns", sql("gm", "SELECT * EXCLUDE (price) FROM gm"))
def drop_sparse_columns(spark, folder):
    return cleaning.drop_sparse_columns(
        bind.gappy_matrix(spark, folder), ["quantity", "tax", "price"]
    )


@query(
    "align_features",
    sql(
        "gm",
        """SELECT change, line_no, file_path, tax, CAST(0 AS DOUBLE) AS ast_node_count, quantity,
  CAST(0 AS DOUBLE) AS has_process_data FROM gm""",
    ),
)
def align_features(spark, folder):
    return predicates.align_features(
        bind.gappy_matrix(spark, folder),
        ["tax", "ast_node_count", "quantity", "price"],
        keep=["change", "line_no", "file_path"],
        constants={"has_process_data": 0},
        drop=["price"],
    )


@query(
    "coerce_numeric",
    """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_quantity END AS amount,
  CASE WHEN l_orderkey % 3 = 0 THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_buggy FROM lineitem""",
)
def coerce_numeric(spark, folder):
    from riskloom.schema import require_columns

    raw = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_partkey") % 4 == 0, F.lit("n/a"))
        .otherwise(F.col("l_quantity").cast("string"))
        .alias("amount"),
        F.when(F.col("l_orderkey") % 3 != 0, F.when(F.col("l_returnflag") == "R", "1").otherwise("0")).alias(
            "is_buggy"
        ),
    )
    return predicates.coerce_numeric(require_columns(raw, ["amount", "is_buggy"]), ["amount"], "is_buggy")


@query(
    "feature_groups",
    sql(
        "fm",
        "SELECT feature, count(x) AS present_rows, CASE WHEN feature IN ('window_no', 'commits_in_window') THEN 'structure' ELSE 'process' END AS feature_group FROM (\n"
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM fm"
            for c in [*bind.FEATURES, "window_no", "commits_in_window"]
        )
        + ") GROUP BY feature",
    ),
)
def feature_groups(spark, folder):
    from riskloom.operators.reports import feature_inventory

    return feature_inventory(
        bind.feature_matrix(spark, folder), [*bind.FEATURES, "window_no", "commits_in_window"]
    )


# --- distinct keys, ordering, top-k ----------------------------------------------


@query(
    "dedupe_change_file",
    sql(
        "cl",
        """SELECT repo_name, file_path, commit_hash, line_no, commit_date, lines_changed FROM (
  SELECT *, row_number() OVER (PARTITION BY commit_hash, repo_name, file_path ORDER BY commit_date, line_no, lines_changed) AS rn FROM cl)
WHERE rn = 1""",
    ),
)
def dedupe_change_file(spark, folder):
    log = bind.change_log(spark, folder).select(
        "repo_name", "file_path", "commit_hash", "line_no", "commit_date", "lines_changed"
    )
    return change_log.dedupe_changes(log, ["line_no", "lines_changed"])


@query("distinct_pairs", sql("cl", "SELECT DISTINCT repo_name, file_path, date_trunc('month', commit_date)::TIMESTAMP AS window_end FROM cl"))
def distinct_pairs(spark, folder):
    log = bind.change_log(spark, folder).withColumn(
        "window_end", F.date_trunc("month", "commit_date").cast("timestamp_ntz")
    )
    return topk.distinct_pairs(log, ["repo_name", "file_path", "window_end"])


@query(
    "rank_top_k_risk",
    sql("sc", "SELECT id, y, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc ORDER BY score DESC, id LIMIT 20"),
)
def rank_top_k_risk(spark, folder):
    return topk.rank_top_k_risk(bind.scored(spark, folder), 20)


@query(
    "similar_by_score",
    sql(
        "sc",
        """WITH t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc ORDER BY score DESC, id LIMIT 50)
SELECT id, CAST(rank AS INTEGER) AS rank, list(other ORDER BY d, r) FILTER (rn <= 3) AS similar FROM (
  SELECT a.id, a.rank, b.id AS other, abs(a.score - b.score) AS d, b.rank AS r,
    row_number() OVER (PARTITION BY a.id ORDER BY abs(a.score - b.score), b.rank) AS rn
  FROM t a JOIN t b ON a.id <> b.id)
GROUP BY id, rank""",
    ),
)
def similar_by_score(spark, folder):
    return topk.similar_by_score(topk.rank_top_k_risk(bind.scored(spark, folder), 50))


def _vector_report(spark, folder):
    vectors = bind.vectors(spark, folder)
    scored = vectors.select("id", ((F.col("id") * 7919) % 1009 / F.lit(1009.0)).alias("score"))
    # Zero vectors have no direction and no neighbours.
    known = vectors.withColumn(
        "embedding",
        F.when(
            F.col("id") % 10 == 5, F.transform("embedding", lambda x: x * F.lit(0).cast("float"))
        ).otherwise(F.col("embedding")),
    )
    return topk.rank_top_k_risk(scored, 60), known


@query(
    "cosine_neighbors",
    """WITH s AS (SELECT vec_id AS id, (vec_id * 7919) % 1009 / CAST(1009 AS DOUBLE) AS score FROM embeddings),
t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 60),
v AS (SELECT t.id, t.rank, CAST(embedding AS DOUBLE[]) AS e FROM t JOIN embeddings ON vec_id = t.id WHERE vec_id % 10 <> 5),
p AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS sim, b.rank AS r,
    row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.rank) AS rn
  FROM v a JOIN v b ON a.id <> b.id)
SELECT t.id, CAST(t.rank AS INTEGER) AS rank, coalesce((SELECT list(other ORDER BY rn) FROM p WHERE p.id = t.id AND rn <= 3), []) AS neighbors FROM t""",
)
def cosine_neighbors(spark, folder):
    ranked, known = _vector_report(spark, folder)
    return topk.cosine_neighbors(ranked, known)


@query(
    "top_churned_files",
    sql(
        "cl",
        """SELECT repo_name, file_path, count(DISTINCT commit_hash) AS changes,
  count(DISTINCT CASE WHEN is_bug_fix THEN commit_hash END) AS fix_changes
FROM cl GROUP BY ALL ORDER BY changes DESC, repo_name, file_path LIMIT 10""",
    ),
)
def top_churned_files(spark, folder):
    return topk.top_churned_files(bind.change_log(spark, folder))


@query(
    "top_variance_features",
    sql(
        "fm",
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(var_samp({c}), 6) AS variance FROM fm" for c in bind.FEATURES
        )
        + ") ORDER BY variance DESC, feature LIMIT 5",
    ),
)
def top_variance_features(spark, folder):
    return topk.top_variance_features(bind.feature_matrix(spark, folder), bind.FEATURES)


@query(
    "recent_reports",
    "SELECT o_orderkey AS report_id, o_orderdate AS created_at, o_totalprice AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10",
)
def recent_reports(spark, folder):
    reports = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("report_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("total"),
    )
    return topk.recent_reports(reports)
