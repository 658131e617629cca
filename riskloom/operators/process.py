"""Activity metrics of a file as of a reference date."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.timing import DAY_MICROS, micros, plus_days, whole_days
from riskloom.operators.history import KEYS, History
from riskloom.operators.labels import Span

SHORT_DAYS = 30
LONG_DAYS = 90
MIN_ROWS_FOR_FEATURES = 2
MIN_ROWS_FOR_SNAPSHOT = 3
CHURN_PROXY_PER_ROW = 10


def _rows(log: DataFrame) -> DataFrame:
    """Dated changes of a file; a change without repository or path belongs to none."""
    known = F.col("commit_date").isNotNull()
    for key in KEYS:
        known = known & F.col(key).isNotNull()
    return log.filter(known).select(
        *KEYS,
        "commit_hash",
        "author_email",
        "commit_date",
        F.coalesce(F.col("lines_changed"), F.lit(0)).cast("bigint").alias("lines_changed"),
        F.coalesce(F.col("is_bug_fix"), F.lit(False)).cast("bigint").alias("fix"),
    )


def trailing_metrics(served: DataFrame) -> DataFrame:
    """Short and long window sums and distinct counts per (file, ref).

    ``served`` holds a change row for every ref whose long window contains it,
    with ``in_short``. The distinct counts share one aggregation: each row is
    emitted once as a change and once as an author, grouped by that value, then
    counted. Both steps combine before their shuffle, so a hot file never reaches
    one task row by row.
    """
    zero = F.lit(0).cast("bigint")
    tagged = served.select(
        *KEYS,
        "ref",
        F.inline(
            F.array(
                F.struct(
                    F.lit("c").alias("kind"),
                    F.col("commit_hash").cast("string").alias("item"),
                    F.col("in_short").alias("in_short"),
                    F.col("lines_changed").alias("churn"),
                    F.col("fix").alias("fix"),
                ),
                F.struct(
                    F.lit("a").alias("kind"),
                    F.col("author_email").alias("item"),
                    F.lit(False).alias("in_short"),
                    zero.alias("churn"),
                    zero.alias("fix"),
                ),
            )
        ),
    )
    per_item = tagged.groupBy(*KEYS, "ref", "kind", "item").agg(
        F.max("in_short").alias("in_short"),
        F.sum("churn").alias("churn_long"),
        F.sum(F.when(F.col("in_short"), F.col("churn")).otherwise(0)).alias("churn_short"),
        F.sum("fix").alias("fixes"),
    )
    change = (F.col("kind") == "c") & F.col("item").isNotNull()
    author = (F.col("kind") == "a") & F.col("item").isNotNull()
    return per_item.groupBy(*KEYS, "ref").agg(
        F.sum("churn_short").alias("code_churn_30d"),
        F.sum("churn_long").alias("code_churn_90d"),
        F.count_if(change & F.col("in_short")).alias("commit_count_30d"),
        F.count_if(change).alias("commit_count_90d"),
        F.count_if(author).alias("author_count_90d"),
        F.sum("fixes").alias("bug_fix_count_90d"),
    )


def lifetime_metrics(
    refs: DataFrame, slotted: DataFrame, carry: Sequence[str] = ()
) -> DataFrame:
    """Rows, fixes, newest date and the top author's rows up to each ref.

    ``slotted`` holds ``rows, fixes, newest`` per (file, author, slot), where a
    slot is the first ref that the changes serve. Running sums go over slots only,
    so their windows are bounded by a file's refs, not by its changes. The top
    author's count at a ref is the running maximum of all authors' running counts,
    because those only grow.
    """
    by_author = (
        Window.partitionBy(*KEYS, "author_email")
        .orderBy("ref")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    so_far = (
        Window.partitionBy(*KEYS)
        .orderBy("ref")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    author_rows = F.when(F.col("author_email").isNotNull(), F.sum("rows").over(by_author))
    asked = refs.select(*KEYS, "ref", F.lit(1).alias("wanted"), *carry)
    merged = (
        # Keys under new names of their own let the union keep how both sides are dealt out.
        slotted.select(*[F.col(k).alias(k) for k in KEYS], "ref", "rows", "fixes", "newest", author_rows.alias("author_rows"), F.lit(0).alias("wanted"))
        .unionByName(asked, allowMissingColumns=True)
        .groupBy(*KEYS, "ref")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("fixes").alias("fixes"),
            F.max("newest").alias("newest"),
            F.max("author_rows").alias("author_rows"),
            F.max("wanted").alias("wanted"),
            *[F.max(c).alias(c) for c in carry],
        )
    )
    return (
        merged.select(
            *KEYS,
            "ref",
            "wanted",
            *carry,
            F.sum("rows").over(so_far).alias("rows"),
            F.sum("fixes").over(so_far).alias("fixes"),
            F.max("newest").over(so_far).alias("newest"),
            F.max("author_rows").over(so_far).alias("author_rows"),
            F.sum("rows").over(Window.partitionBy(*KEYS)).alias("rows_ever"),
        )
        .filter("wanted = 1")
        .drop("wanted")
    )


def _per_author_and_slot(rows: DataFrame, slot: Column) -> DataFrame:
    return rows.groupBy(*KEYS, slot.alias("ref"), "author_email").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("fix").alias("fixes"),
        F.max("commit_date").alias("newest"),
    )


def _finish(
    lifetime: DataFrame, trailing: DataFrame, ref_date: Column, carry: Sequence[str] = ()
) -> DataFrame:
    counts = {
        c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
        for c in (
            "code_churn_30d",
            "code_churn_90d",
            "commit_count_30d",
            "commit_count_90d",
            "author_count_90d",
            "bug_fix_count_90d",
        )
    }
    share = F.coalesce(F.try_divide("author_rows", "rows"), F.lit(0.0))
    density = F.coalesce(F.try_divide("fixes", "rows"), F.lit(0.0))
    short_count, long_count = counts["commit_count_30d"], counts["commit_count_90d"]
    # At least twice the share of the long count that the short window should have.
    burst = (short_count > 0) & (3 * short_count >= 2 * long_count)
    return lifetime.join(trailing, [*KEYS, "ref"], "left").select(
        *KEYS,
        "ref",
        *carry,
        F.coalesce("rows_ever", F.lit(0)).alias("rows_ever"),
        ref_date.alias("window_end"),
        *[column.alias(name) for name, column in counts.items()],
        F.round(density, 6).alias("fix_density"),
        whole_days(ref_date, F.col("newest")).alias("days_since_last_change"),
        burst.cast("int").alias("commit_burst_30d"),
        F.round(share, 6).alias("ownership_score"),
    )


def metrics_on_grid(
    refs: DataFrame,
    log: DataFrame,
    span: Span,
    window_days: int = 90,
    short_days: int = SHORT_DAYS,
    long_days: int = LONG_DAYS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """All metrics for refs on a grid: ``span.lo + window_days * (window_no + 1)``.

    ``refs`` holds distinct ``(repo_name, file_path, window_no)`` and any ``carry``
    columns; ``span`` comes from ``date_span``. A change finds the refs it serves
    by arithmetic (both ends of a window are closed), so changes and refs are
    never joined.
    """
    width = window_days * DAY_MICROS
    d = F.col("d")
    rows = (
        _rows(log)
        .withColumn("d", micros(F.col("commit_date")) - span.lo_us)
        .withColumn("first", F.greatest(F.ceil(d / F.lit(width)) - 1, F.lit(0).cast("bigint")))
    )
    last = F.floor((d + long_days * DAY_MICROS) / F.lit(width)) - 1
    served = (
        rows.withColumn("last", last)
        .filter(F.col("last") >= F.col("first"))
        .select("*", F.explode(F.sequence("first", "last")).alias("ref"))
        .withColumn("in_short", (F.col("ref") + 1) * width - d <= short_days * DAY_MICROS)
    )
    asked = refs.select(*KEYS, F.col("window_no").alias("ref"), *carry)
    lifetime = lifetime_metrics(asked, _per_author_and_slot(rows, F.col("first")), carry)
    ref_date = span.at((F.col("ref") + 1) * window_days)
    return _finish(lifetime, trailing_metrics(served), ref_date, carry).withColumnRenamed(
        "ref", "window_no"
    )


def next_ref(rows: DataFrame, refs: DataFrame, bounded: bool = False) -> DataFrame:
    """Add ``slot``: the file's first ref at or after each change.

    With ``bounded`` files one window holds a file. Else changes and refs are ordered
    together per (file, day); the next later day with a ref comes from a summary with
    one row per file and day.
    """
    own = [F.col(c).alias(c) if c in KEYS else c for c in rows.columns]
    both = rows.select(*own, F.col("commit_date").alias("at")).unionByName(
        refs.select(*KEYS, "ref", F.col("ref").alias("at")), allowMissingColumns=True
    )
    backwards = Window.orderBy(F.desc("at"), F.desc_nulls_last("ref")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    if bounded:
        slotted = both.withColumn("slot", F.min("ref").over(backwards.partitionBy(*KEYS)))
        return slotted.filter(F.col("ref").isNull()).drop("ref", "at")
    tagged = both.withColumn("day", F.to_date("at"))
    inside = backwards.partitionBy(*KEYS, "day")
    later = (
        Window.partitionBy(*KEYS)
        .orderBy(F.desc("day"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    days = (
        tagged.groupBy(*KEYS, "day")
        .agg(F.min("ref").alias("first_ref"))
        .select(*KEYS, "day", F.min("first_ref").over(later).alias("later_ref"))
    )
    return (
        tagged.withColumn("same_day", F.min("ref").over(inside))
        .filter(F.col("ref").isNull())
        .join(days, [*KEYS, "day"])
        .withColumn("slot", F.coalesce("same_day", "later_ref"))
        .drop("ref", "at", "day", "same_day", "later_ref")
    )


def metrics_as_of(
    refs: DataFrame, log: DataFrame, short_days: int = SHORT_DAYS, long_days: int = LONG_DAYS, bounded: bool = False
) -> DataFrame:
    """All metrics for arbitrary refs: distinct ``(repo_name, file_path, window_end)``.

    ``bounded``: no file has more changes than one task may order.

    A change can only serve refs of its own long-window bucket or the next one,
    so changes and refs meet in an equi-join that stays local in time.
    """
    width = long_days * DAY_MICROS
    asked = refs.filter(F.col("window_end").isNotNull()).select(
        *KEYS, F.col("window_end").alias("ref")
    )
    rows = _rows(log)
    own = F.floor(micros(F.col("commit_date")) / F.lit(width))
    near = rows.withColumn("bucket", F.explode(F.array(own, own + 1)))
    age = micros(F.col("ref")) - micros(F.col("commit_date"))
    served = (
        near.join(
            asked.withColumn("bucket", F.floor(micros(F.col("ref")) / F.lit(width))),
            [*KEYS, "bucket"],
        )
        .filter((age >= 0) & (age <= width))
        .withColumn("in_short", age <= short_days * DAY_MICROS)
    )
    # Changes after a file's last ref still count towards its total history.
    after_all = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    slotted = _per_author_and_slot(next_ref(rows, asked, bounded), F.coalesce("slot", after_all))
    lifetime = lifetime_metrics(asked, slotted)
    return _finish(lifetime, trailing_metrics(served), F.col("ref")).drop("ref")


def process_features(
    labels: DataFrame,
    log: DataFrame,
    span: Span,
    window_days: int = 90,
    carry: Sequence[str] = ("is_buggy",),
    min_changes: int = MIN_ROWS_FOR_FEATURES,
) -> DataFrame:
    """Metrics per label row; files with fewer than ``min_changes`` changes so far are left out.

    ``labels`` holds one row per (file, window); its ``carry`` columns are kept.
    """
    return (
        metrics_on_grid(labels, log, span, window_days, carry=carry)
        .filter(F.col("rows_ever") >= min_changes)
        .drop("rows_ever")
    )


def process_features_pairs(pairs: DataFrame, history: History) -> DataFrame:
    """Metrics per distinct (file, date) pair of files with any change."""
    refs = history.placed(pairs.select(*KEYS, "window_end")).distinct()
    return (
        metrics_as_of(refs, history.changes, bounded=history.buckets is not None)
        .filter(F.col("rows_ever") >= 1)
        .drop("rows_ever", "bug_fix_count_90d")
    )


def process_features_plain(
    pairs: DataFrame, log: DataFrame, short_days: int = SHORT_DAYS, long_days: int = LONG_DAYS
) -> DataFrame:
    """The definition itself, as a join of refs with all earlier changes.

    Its cost grows with refs times changes per file: it is the check for the
    other two forms on small inputs, not a way to run.
    """
    asked = pairs.select(*KEYS, F.col("window_end").alias("ref")).distinct()
    rows = _rows(log)
    age = micros(F.col("ref")) - micros(F.col("commit_date"))
    past = asked.join(rows, list(KEYS)).withColumn("age", age).filter("age >= 0")
    served = past.filter(F.col("age") <= long_days * DAY_MICROS).withColumn(
        "in_short", F.col("age") <= short_days * DAY_MICROS
    )
    per_author = past.groupBy(*KEYS, "ref", "author_email").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fix").alias("f"), F.max("commit_date").alias("m")
    )
    lifetime = per_author.groupBy(*KEYS, "ref").agg(
        F.sum("n").alias("rows"),
        F.sum("f").alias("fixes"),
        F.max("m").alias("newest"),
        F.max(F.when(F.col("author_email").isNotNull(), F.col("n"))).alias("author_rows"),
    )
    ever = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows_ever"))
    full = asked.join(ever, list(KEYS)).join(lifetime, [*KEYS, "ref"], "left")
    return _finish(full, trailing_metrics(served), F.col("ref")).drop("ref")


def process_snapshot(
    log: DataFrame, ref: datetime, min_rows: int = MIN_ROWS_FOR_SNAPSHOT
) -> DataFrame:
    """One reference date for every file, with row counts and 4-place ratios.

    Two aggregations: per (file, author), combined before the shuffle, then per
    file. There is no upper date bound.
    """
    at = F.lit(ref).cast("timestamp_ntz")
    in_short = F.col("commit_date") >= plus_days(at, -SHORT_DAYS)
    in_long = F.col("commit_date") >= plus_days(at, -LONG_DAYS)
    rows = _rows(log)

    def sum_if(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(0))

    per_author = rows.groupBy(*KEYS, "author_email").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("fix").alias("fixes"),
        F.count_if(in_short).alias("n30"),
        F.count_if(in_long).alias("n90"),
        sum_if(in_short, F.col("lines_changed")).alias("churn30"),
        sum_if(in_long, F.col("lines_changed")).alias("churn90"),
        sum_if(in_long, F.col("fix")).alias("fix90"),
        F.min("commit_date").alias("first_date"),
        F.max("commit_date").alias("last_date"),
    )
    named = F.col("author_email").isNotNull()
    per_file = per_author.groupBy(*KEYS).agg(
        F.sum("n").alias("total_commits"),
        F.sum("fixes").alias("bug_fix_commits"),
        F.sum("churn30").alias("code_churn_30d"),
        F.sum("churn90").alias("code_churn_90d"),
        F.sum("n30").alias("commit_count_30d"),
        F.sum("n90").alias("commit_count_90d"),
        F.count_if(named & (F.col("n90") > 0)).alias("author_count_90d"),
        F.sum("fix90").alias("bug_fix_count_90d"),
        F.max(F.when(named, F.col("n"))).alias("top"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    long_rows = F.greatest(F.col("commit_count_90d"), F.lit(1))
    return per_file.filter(F.col("total_commits") >= min_rows).select(
        *KEYS,
        at.alias("window_end"),
        F.to_date("first_date").alias("first_seen"),
        F.to_date("last_date").alias("last_seen"),
        "total_commits",
        "bug_fix_commits",
        "code_churn_30d",
        "code_churn_90d",
        "commit_count_30d",
        "commit_count_90d",
        "author_count_90d",
        "bug_fix_count_90d",
        F.round(F.col("bug_fix_count_90d") / long_rows, 4).alias("fix_density"),
        F.greatest(whole_days(at, F.col("last_date")), F.lit(0).cast("bigint")).alias(
            "days_since_last_change"
        ),
        F.round(F.col("commit_count_30d") / long_rows, 4).alias("commit_burst_30d"),
        F.round(F.coalesce("top", F.lit(0)) / F.greatest("total_commits", F.lit(1)), 4).alias(
            "ownership_score"
        ),
    )


def process_report(
    files: DataFrame, log: DataFrame, ref: datetime, horizon_days: int = 365
) -> DataFrame:
    """Metrics of an on-demand report: every file gets a row.

    The log has no sizes here, so churn is a fixed amount per row. A file without
    changes gets the report's defaults; if the whole log is empty every metric is
    zero.
    """
    at = F.lit(ref).cast("timestamp_ntz")
    in_short = F.col("commit_date") >= plus_days(at, -SHORT_DAYS)
    in_long = F.col("commit_date") >= plus_days(at, -LONG_DAYS)
    since = F.col("commit_date") >= plus_days(at, -horizon_days)
    rows = _rows(log).filter(since)
    per_author = rows.groupBy(*KEYS, "author_email").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(in_short).alias("n30"),
        F.count_if(in_long).alias("n90"),
        F.sum(F.when(in_long, F.col("fix")).otherwise(0)).alias("fix90"),
        F.max("commit_date").alias("last_date"),
    )
    named = F.col("author_email").isNotNull()
    per_file = per_author.groupBy(*KEYS).agg(
        F.sum("n").alias("n"),
        F.sum("n30").alias("n30"),
        F.sum("n90").alias("n90"),
        F.count_if(named & (F.col("n90") > 0)).alias("authors"),
        F.sum("fix90").alias("fix90"),
        F.max(F.when(named, F.col("n"))).alias("top"),
        F.max("last_date").alias("last_date"),
    )
    have_log = rows.select(F.lit(1).alias("one")).limit(1).agg(F.count("one") > 0).scalar()

    def count_of(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    one = F.lit(1)
    ratio_burst = count_of("n30") / F.greatest(count_of("n90") / F.lit(3.0), F.lit(1.0))
    age = whole_days(at, F.col("last_date"))
    days = F.when(age.isNotNull(), F.greatest(age, F.lit(0).cast("bigint")))
    return files.select(*KEYS).distinct().join(per_file, list(KEYS), "left").select(
        *KEYS,
        count_of("n30").alias("commit_count_30d"),
        count_of("n90").alias("commit_count_90d"),
        (count_of("n30") * CHURN_PROXY_PER_ROW).alias("code_churn_30d"),
        (count_of("n90") * CHURN_PROXY_PER_ROW).alias("code_churn_90d"),
        count_of("authors").alias("author_count_90d"),
        count_of("fix90").alias("bug_fix_count_90d"),
        F.round(count_of("fix90") / F.greatest(count_of("n90"), one), 4).alias("fix_density"),
        F.when(have_log, F.coalesce(days, F.lit(horizon_days)))
        .otherwise(0)
        .cast("bigint")
        .alias("days_since_last_change"),
        F.round(ratio_burst, 4).alias("commit_burst_30d"),
        F.when(have_log, F.coalesce(F.round(F.col("top") / F.greatest("n", one), 4), F.lit(1.0)))
        .otherwise(0.0)
        .alias("ownership_score"),
    )
