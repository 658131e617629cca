"""What must hold of fitted models, graphs and reports, as queries whose result SQL can state.

A model's numbers have no SQL form, but its bounds, counts, orders and sums do: each query
runs the operator over the whole tables and returns what SQL can say about every row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import graph, joins, training
from riskloom.plans import bindings as bind
from riskloom.plans import catalog_models as models
from riskloom.plans import flows
from riskloom.plans.registry import query
from riskloom.plans.sqltext import sql
from riskloom.session import fresh_path
from riskloom.sources.tables import write_table

FILE_KEYS, ROW_KEYS = models.FILE_KEYS, models.ROW_KEYS
_PARSED = models._GRAPHS.split(",\n  lb AS")[0]


def _share(name: str):
    return F.coalesce(F.col(name).between(0, 1), F.lit(False))


# --- graphs ---------------------------------------------------------------------


@query(
    "graph_edge_checks",
    models.more("src", _PARSED, "SELECT DISTINCT digest, 2 * (n_nodes - 1) AS edges, n_nodes - 1 AS downward, n_nodes AS nodes FROM gr WHERE parses"),
)
def graph_edge_checks(spark, folder):
    """Every node but the root has one edge from its parent and one back."""
    edges = graph.graph_edges(graph.graph_nodes(models._nodes(spark, folder)))
    ends = edges.select("digest", "src", "dst", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("digest").agg(
        (F.count(F.lit(1)) / 2).cast("bigint").alias("edges"),
        (F.count_if(F.col("src") < F.col("dst")) / 2).cast("bigint").alias("downward"),
        F.count_distinct("node").alias("nodes"),
    )


_TYPE_SUMS = {"FunctionDef": "f + c", "ClassDef": "c", "Import": "1 + i", "Try": "t", "For": "c", "If": "f + 2 * c", "Module": "1"}


@query(
    "graph_feature_checks",
    models.more(
        "src",
        _PARSED,
        """SELECT digest, n_nodes AS nodes, true AS shares_in_bounds, """
        + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _TYPE_SUMS.items())
        + """ FROM (SELECT DISTINCT gr.digest, n_nodes, len(regexp_extract_all(source_code, 'def f')) AS f, len(regexp_extract_all(source_code, 'class C')) AS c,
    len(regexp_extract_all(source_code, 'import mod')) AS i, len(regexp_extract_all(source_code, 'try:')) AS t
  FROM gr JOIN rv ON rv.rn = 1 AND rv.repo_name = gr.repo_name AND rv.file_path = gr.file_path WHERE parses)""",
    ),
)
def graph_feature_checks(spark, folder):
    """Node features summed per text: how many nodes there are of each type."""
    features = graph.node_features(graph.graph_nodes(models._nodes(spark, folder)))
    at = {name: F.col("features")[graph.NODE_TYPES.index(name)] for name in _TYPE_SUMS}
    n = len(graph.NODE_TYPES)
    shares = F.col("features")[n].between(0, 1) & F.col("features")[n + 1].between(0, 1) & (F.size("features") == n + 2)
    return features.groupBy("digest").agg(
        F.count(F.lit(1)).alias("nodes"), F.min(shares).alias("shares_in_bounds"), *[F.sum(c).alias(name) for name, c in at.items()]
    )


@query(
    "graph_embedding_checks",
    models.more(
        "src",
        _PARSED,
        """SELECT c.repo_name, c.file_path, 32 AS dims, coalesce(parses, false) AS embedded
FROM (SELECT DISTINCT repo_name, file_path FROM cl) c LEFT JOIN gr ON gr.repo_name = c.repo_name AND gr.file_path = c.file_path""",
    ),
)
def graph_embedding_checks(spark, folder):
    """Every file has a vector; it is zero only if the file's newest text gives no graph."""
    files = bind.change_log(spark, folder).select(*FILE_KEYS).distinct()
    found = joins.lookup_vector_or_zero(files, models._file_embeddings(spark, folder), FILE_KEYS, graph.EMBEDDING_DIM)
    return found.select(*FILE_KEYS, F.size("embedding").alias("dims"), F.exists("embedding", lambda x: x != 0).alias("embedded"))


# --- models ---------------------------------------------------------------------


@query("score_batch_checks", sql("fm", "SELECT repo_name, file_path, window_no, is_buggy, true AS in_bounds, CAST(0 AS DOUBLE) AS reload_gap FROM fm"))
def score_batch_checks(spark, folder):
    """A saved and reloaded model scores every row as the fitted one does."""
    matrix = bind.stored_matrix(spark, folder)
    path = fresh_path(spark, "model")
    fitted = training.refit_final(matrix, bind.FEATURES, models.SMALL_TREES, 5, path)
    loaded, names = training.load_model(spark, path)
    one = training.score_batch(fitted, matrix, bind.FEATURES).select(*ROW_KEYS, F.col("score").alias("before"))
    two = training.score_batch(loaded, matrix, names).select(*ROW_KEYS, "is_buggy", "score")
    gap = F.round(F.abs(F.col("score") - F.col("before")), 12)
    return two.join(one, ROW_KEYS).select(*ROW_KEYS, "is_buggy", _share("score").alias("in_bounds"), gap.alias("reload_gap"))


@query(
    "boosted_trees_checks",
    "SELECT 9 AS features, CAST(1 AS DOUBLE) AS importance_sum, true AS in_bounds, true AS trees_in_bounds",
)
def boosted_trees_checks(spark, folder):
    """Importances of the fitted trees are shares of all features; the tree count keeps its limit."""
    matrix = bind.stored_matrix(spark, folder)
    model = training.train_boosted_trees(matrix, bind.FEATURES, models.SMALL_TREES)
    table = training.feature_importance(spark, model, bind.FEATURES, k=1000)
    known = F.col("feature").isin(*bind.FEATURES) & _share("importance") & ~F.col("is_vector_dim")
    return table.agg(
        F.count_distinct("feature").cast("int").alias("features"), F.round(F.sum("importance"), 4).alias("importance_sum"),
        F.min(known).alias("in_bounds"), F.lit(1 <= model.getNumTrees <= models.SMALL_TREES.n_estimators).alias("trees_in_bounds"),
    )


@query(
    "cv_checks",
    sql("fm", "SELECT repo_name, file_path, window_no, is_buggy, CAST(1 AS BIGINT) AS times, true AS in_bounds, true AS cut_by_score FROM fm"),
)
def cv_checks(spark, folder):
    """Every row is scored once, by the model of its own fold, and predicted by its score."""
    oof, folds, _ = models._oof(spark, folder)
    threshold = folds.agg(F.avg("best_threshold")).scalar()
    return oof.groupBy(*ROW_KEYS, "is_buggy").agg(
        F.count(F.lit(1)).alias("times"), F.min(_share("oof_prob")).alias("in_bounds"),
        F.min((F.col("oof_prob") >= threshold).cast("int") == F.col("oof_pred")).alias("cut_by_score"),
    )


@query("cv_fold_checks", "SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS fold, true AS in_bounds, true AS trees_in_bounds")
def cv_fold_checks(spark, folder):
    folds = models._oof(spark, folder)[1]
    bounds = F.lit(True)
    for name in ("auc", "f1", "precision", "recall", "ap", "best_threshold"):
        bounds = bounds & _share(name)
    return folds.select("fold", bounds.alias("in_bounds"), F.col("trees").between(1, models.SMALL_TREES.n_estimators).alias("trees_in_bounds"))


def _hybrid(spark, folder):
    matrix = bind.stored_matrix(spark, folder)
    vectors = write_table(models._file_embeddings(spark, folder), fresh_path(spark, "embeddings"))
    return training.hybrid_train(matrix, bind.FEATURES, vectors, FILE_KEYS, graph.EMBEDDING_DIM, models.SMALL_TREES)


@query(
    "hybrid_importance",
    """SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS place, true AS known, true AS falling, true AS vector_marked, true AS metrics_in_bounds""",
)
def hybrid_importance(spark, folder):
    """The 20 strongest features of the model on tabular columns and vectors, and which are vector dimensions."""
    model, row = _hybrid(spark, folder)
    names = training.hybrid_names(bind.FEATURES, graph.EMBEDDING_DIM)
    top = training.feature_importance(spark, model, names, 20)
    order = Window.orderBy(F.desc("importance"), "feature")
    metrics_ok = row.select((_share("train_auc") & _share("train_ap") & _share("train_f1")).alias("ok")).scalar()
    return top.select(
        F.row_number().over(order).alias("place"), F.col("feature").isin(*names).alias("known"),
        (F.coalesce(F.lag("importance").over(order), F.lit(1.0)) >= F.col("importance")).alias("falling"),
        (F.col("is_vector_dim") == ~F.col("feature").isin(*bind.FEATURES)).alias("vector_marked"), metrics_ok.alias("metrics_in_bounds"),
    )


@query(
    "three_way_checks",
    """SELECT * FROM (VALUES ('baseline_random_split', 9, true, true), ('baseline_temporal_split', 9, true, true),
  ('hybrid_temporal_split', 41, true, true)) t(run_name, n_features, in_bounds, warned_rightly)""",
)
def three_way_checks(spark, folder):
    runs = models.three_way_comparison(spark, folder)
    runs = write_table(runs, fresh_path(spark, "comparison"))
    bounds = F.lit(True)
    for name in ("auc", "f1", "precision", "recall", "precision_at_20"):
        bounds = bounds & _share(name)
    base = runs.where("run_name = 'baseline_temporal_split'").select("auc").scalar()
    due = (F.col("run_name") == "hybrid_temporal_split") & (F.col("auc") <= base)
    return runs.select("run_name", "n_features", bounds.alias("in_bounds"), (F.col("warning").isNotNull() == due).alias("warned_rightly"))


@query("training_loss_checks", "SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS step, true AS positive, true AS falling, true AS smoothed_mean")
def training_loss_checks(spark, folder):
    """One loss per tree; it falls on the training rows, and the smoothed one is the mean of the last five."""
    order = Window.orderBy("step")
    rows = models.training_loss(spark, folder)
    mean = F.avg("loss").over(order.rowsBetween(-4, 0))
    return rows.select(
        "step", (F.col("loss") > 0).alias("positive"), (F.col("loss") <= F.coalesce(F.lag("loss").over(order), F.col("loss"))).alias("falling"),
        (F.abs(F.col("smoothed") - mean) < 1e-6).alias("smoothed_mean"),
    )


# --- reports ---------------------------------------------------------------------


@query(
    "risk_report_checks",
    models.more(
        "src",
        """ls AS (SELECT DISTINCT repo_name, file_path FROM src WHERE commit_date <= TIMESTAMP '2001-06-01' AND source_code IS NOT NULL AND trim(source_code) <> '')""",
        """SELECT 'report-1' AS report_id, 'completed' AS status, 'baseline' AS model_used, count(*) AS total_files_analyzed, true AS predicted_within_total,
  CAST(least(20, count(*)) AS INTEGER) AS rows, true AS ranks_follow_scores, true AS five_features_each FROM ls""",
    ),
)
def risk_report_checks(spark, folder):
    """Totals, length and order of a report scored by a stored model."""
    report = models.risk_report(spark, folder)
    rows = F.col("top_k_results")
    follows = F.forall(
        F.sequence(F.lit(1), F.size(rows) - 1), lambda i: (rows[i]["score"] <= rows[i - 1]["score"]) & (rows[i]["rank"] == i + 1)
    )
    return report.select(
        "report_id", "status", "model_used", "total_files_analyzed",
        (F.col("buggy_files_predicted") <= F.col("total_files_analyzed")).alias("predicted_within_total"), F.size(rows).alias("rows"),
        (follows & (rows[0]["rank"] == 1)).alias("ranks_follow_scores"), F.forall(rows, lambda r: F.size(r["top_features"]) == 5).alias("five_features_each"),
    )


@query(
    "hybrid_report",
    models.more(
        "src",
        """ls AS (SELECT DISTINCT repo_name, file_path FROM src WHERE commit_date <= TIMESTAMP '2001-06-01' AND source_code IS NOT NULL AND trim(source_code) <> '')""",
        """SELECT 'hybrid' AS model_used, count(*) AS total_files_analyzed, CAST(least(20, count(*)) AS INTEGER) AS rows, true AS ranks_follow_scores,
  true AS known_features, true AS not_warned FROM ls""",
    ),
)
def hybrid_report(spark, folder):
    """The report scored by the model on tabular columns and vectors; contributions may name both."""
    log = bind.stored_log(spark, folder)
    matrix = bind.stored_matrix(spark, folder, log)
    vectors = write_table(models._file_embeddings(spark, folder, log), fresh_path(spark, "embeddings"))
    model, _ = training.hybrid_train(matrix, bind.FEATURES, vectors, FILE_KEYS, graph.EMBEDDING_DIM, models.SMALL_TREES)
    names = training.hybrid_names(bind.FEATURES, graph.EMBEDDING_DIM)
    own = names[len(bind.FEATURES) :]
    report, rows = flows.analyze(
        log, model, bind.FEATURES, datetime(2001, 6, 1), vectors=vectors, vector_names=own, wanted_model="hybrid"
    )
    ranked = Window.orderBy("rank")
    seen = rows.select(
        (F.coalesce(F.lag("score").over(ranked), F.lit(1.0)) >= F.col("score")).alias("falls"),
        F.forall("top_features", lambda f: f["feature"].isin(*names)).alias("known"),
        F.col("score").between(0, 1).alias("bounded"),
    ).agg(F.min("falls").alias("falls"), F.min("known").alias("known"), F.min("bounded").alias("bounded"))
    return report.select(
        "model_used", "total_files_analyzed", F.size("top_k_results").alias("rows"), seen.select("falls").scalar().alias("ranks_follow_scores"),
        seen.select("known").scalar().alias("known_features"),
        (seen.select("bounded").scalar() & ~F.exists("warnings", lambda w: w.contains("Vectors"))).alias("not_warned"),
    )


@query("training_flow_checks", "SELECT true AS in_bounds, true AS f1_is_harmonic")
def training_flow_checks(spark, folder):
    row = write_table(models.training_flow(spark, folder), fresh_path(spark, "flow-summary"))
    bounds = F.lit(True)
    for name in ("auc", "average_precision", "f1", "precision", "recall", "precision_at_k"):
        bounds = bounds & _share(name)
    p, r = F.col("precision"), F.col("recall")
    harmonic = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return row.select(bounds.alias("in_bounds"), (F.abs(F.col("f1") - harmonic) < 1e-5).alias("f1_is_harmonic"))


@query(
    "file_explanation_checks",
    models.more(
        "fm",
        models._LINEAR + ",\n  " + models._SCORED_AT + ",\n  tp AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rn FROM rs)",
        """SELECT id, CAST(rn AS INTEGER) AS rank, 4 AS factors, true AS strongest_first, 3 AS similar_rows, true AS neighbors_of_report FROM tp WHERE rn <= 20""",
    ),
)
def file_explanation_checks(spark, folder):
    """Each report row with all factors by size, three rows of similar score, neighbours from the report."""
    rows = write_table(models.file_explanation(spark, folder), fresh_path(spark, "explanations"))
    ids = rows.agg(F.collect_set("id")).scalar()
    falls = F.forall(
        F.sequence(F.lit(1), F.size("waterfall") - 1),
        lambda i: F.abs(F.col("waterfall")[i]["attribution"]) <= F.abs(F.col("waterfall")[i - 1]["attribution"]),
    )
    near = F.coalesce(F.col("neighbors"), F.array())
    inside = F.size(F.array_except(near, ids)) == 0
    return rows.select(
        "id", F.col("rank").cast("int").alias("rank"), F.size("waterfall").alias("factors"), falls.alias("strongest_first"),
        F.size("similar").alias("similar_rows"), (inside & ~F.array_contains(near, F.col("id"))).alias("neighbors_of_report"),
    )
