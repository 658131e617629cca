"""Labels: what happens to a file in the time after a window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordering import null_safe_join, rank_in_groups
from riskloom.functions.text import base_name, strip_relative
from riskloom.functions.timing import DAY_MICROS, micros, plus_days
from riskloom.schema import require_columns

MIN_CHANGES_IN_WINDOW = 2
MIN_FIX_TOUCHES = 2

# Share of positives a repository may have, by repository.
DEFAULT_RATE_CAP = 0.50
STRICT_RATE_CAPS = {
    "django": 0.35,
    "sqlalchemy": 0.40,
    "aiohttp": 0.45,
    "falcon": 0.45,
    "tornado": 0.45,
    "redis-py": 0.45,
    "werkzeug": 0.45,
    "click": 0.45,
    "celery": 0.45,
}


@dataclass(frozen=True)
class Span:
    """First and last date of a log; two values, so they enter plans as literals."""

    lo: datetime
    hi: datetime

    @classmethod
    def of(cls, lo: datetime | None, hi: datetime | None) -> Span:
        """A log without dates has an empty span."""
        epoch = datetime(1970, 1, 1)
        return cls(lo or epoch, hi or epoch)

    @staticmethod
    def _micros(at: datetime) -> int:
        return (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)

    @property
    def lo_us(self) -> int:
        return self._micros(self.lo)

    @property
    def length_us(self) -> int:
        return self._micros(self.hi) - self.lo_us

    def at(self, days: Column) -> Column:
        """The date ``days`` after the first one."""
        return plus_days(F.lit(self.lo).cast("timestamp_ntz"), days)


def date_span(log: DataFrame, date: str = "commit_date") -> Span:
    """First and last date of a log, by one aggregate job."""
    return Span.of(*log.agg(F.min(date), F.max(date)).first())


def label_windows(log: DataFrame, window_days: int = 90) -> DataFrame:
    """Back-to-back windows that end strictly before the last change."""
    span = log.agg(F.min("commit_date").alias("lo"), F.max("commit_date").alias("hi"))
    width = F.lit(window_days * DAY_MICROS)
    count = F.ceil((micros(F.col("hi")) - micros(F.col("lo"))) / width) - 1
    numbers = F.when(count >= 1, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    return span.select("lo", F.explode(numbers).alias("window_no")).select(
        F.col("window_no").cast("bigint").alias("window_no"),
        plus_days(F.col("lo"), F.col("window_no") * window_days).alias("window_start"),
        plus_days(F.col("lo"), (F.col("window_no") + 1) * window_days).alias("window_end"),
    )


def windowed_labels(
    log: DataFrame,
    window_days: int = 90,
    horizon_days: int = 90,
    min_changes: int = MIN_CHANGES_IN_WINDOW,
    span: Span | None = None,
) -> DataFrame:
    """Per (repo, file, window): changes, fixes, and whether a fix follows.

    Window numbers are arithmetic on the date, so nothing is range-joined. Every
    change is emitted once for its own window; a fix is also emitted for each
    window whose horizon ``[window_end, window_end + horizon)`` holds it. One
    aggregation, combined before the shuffle, then gives counts and label.
    """
    require_columns(log, ["commit_date", "file_path", "is_bug_fix", "repo_name"], "change log")
    span = span or date_span(log)
    width = window_days * DAY_MICROS
    d = F.col("d")
    rows = (
        log.filter(F.col("commit_date").isNotNull())
        .select(
            "repo_name",
            "file_path",
            F.coalesce(F.col("is_bug_fix"), F.lit(False)).alias("fix"),
            (micros(F.col("commit_date")) - span.lo_us).alias("d"),
        )
        .select(
            "repo_name",
            "file_path",
            "fix",
            F.floor(d / F.lit(width)).alias("own"),
            F.floor((d - horizon_days * DAY_MICROS) / F.lit(width)).alias("first"),
        )
    )
    # Step 0 is the change's own window; step j the window j before it, whose
    # horizon can reach this far for j up to horizon / window (rounded up).
    steps = range(0, -(-horizon_days // window_days) + 1)
    emitted = (
        rows.select("*", F.explode(F.array(*[F.lit(j) for j in steps])).alias("step"))
        .withColumn("w", F.col("own") - F.col("step"))
        .filter(
            (F.col("w") >= 0)
            & ((F.col("w") + 1) * width < span.length_us)
            & ((F.col("step") == 0) | (F.col("fix") & (F.col("w") >= F.col("first"))))
        )
    )
    own_row = F.col("step") == 0
    grouped = emitted.groupBy("repo_name", "file_path", F.col("w").alias("window_no")).agg(
        F.count_if(own_row).alias("commits_in_window"),
        F.count_if(own_row & F.col("fix")).alias("bug_fix_commits_in_window"),
        F.max(~own_row).alias("is_buggy"),
    )
    return grouped.filter(F.col("commits_in_window") >= min_changes).select(
        "repo_name",
        "file_path",
        "window_no",
        span.at(F.col("window_no") * window_days).alias("window_start"),
        span.at((F.col("window_no") + 1) * window_days).alias("window_end"),
        "is_buggy",
        "commits_in_window",
        "bug_fix_commits_in_window",
    )


def simple_labels(log: DataFrame) -> DataFrame:
    """One label per file over its whole history."""
    fix = F.coalesce(F.col("is_bug_fix"), F.lit(False))
    return log.groupBy("repo_name", "file_path").agg(
        F.max(fix).alias("is_buggy"),
        F.count(F.lit(1)).alias("total_commits"),
        F.sum(fix.cast("bigint")).alias("bug_fix_commits"),
        F.min("commit_date").alias("first_seen"),
        F.max("commit_date").alias("last_seen"),
    )


def label_stats(labels: DataFrame, files: Sequence[str] = ("repo_name", "file_path")) -> DataFrame:
    """Totals, ratio and a balance remark."""
    positive = F.sum(F.col("is_buggy").cast("bigint"))
    total = F.count(F.lit(1))
    ratio = F.round(F.try_divide(positive, total), 4)
    remark = (
        F.when(F.col("bug_ratio") < 0.1, "few positives: weight the classes strongly")
        .when(F.col("bug_ratio") > 0.4, "classes are about even")
        .otherwise("fewer positives than negatives: weight the classes")
    )
    return labels.agg(
        total.alias("total_samples"),
        positive.alias("buggy_samples"),
        (total - positive).alias("clean_samples"),
        ratio.alias("bug_ratio"),
        F.count_distinct(*files).alias("unique_files"),
    ).withColumn("balance_warning", remark)


def min_touch_labels(log: DataFrame, min_touches: int = MIN_FIX_TOUCHES, flag: str = "is_bug_fix") -> DataFrame:
    """A file is positive if enough (already gated) fixes touched it."""
    return log.groupBy("repo_name", "file_path").agg(
        F.sum(F.col(flag).cast("bigint")).alias("fix_touches"),
        (F.sum(F.col(flag).cast("bigint")) >= min_touches).cast("int").alias("is_buggy"),
    )


def labels_by(log: DataFrame, method: str = "windowed", min_rows: int = 0, **window) -> DataFrame:
    """Labels by the method that the caller names; too few of them are an error, never another method."""
    if method not in ("windowed", "simple"):
        raise ValueError(f"unknown label method {method}")
    found = windowed_labels(log, **window) if method == "windowed" else simple_labels(log)
    if min_rows and found.limit(min_rows).count() < min_rows:
        raise ValueError(f"{method} labels: fewer than {min_rows} rows")
    return found


def rank_buckets(df: DataFrame, value: str, digest: Column, n_cuts: int = 255) -> list[Column]:
    """Bucket columns in the order of (value nulls last, digest), at most about 255 * 257 + 256 of them.

    A value that many rows share becomes a cut point, hence a bucket of its own
    that the digest's first byte divides.
    """
    cuts = sorted(set(df.approxQuantile(value, [i / (n_cuts + 1) for i in range(1, n_cuts + 1)], 1 / (4 * n_cuts))))
    at = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    number = F.col(value).cast("double")
    below = F.size(F.filter(at, lambda c: c <= number))
    alone = number.isNull() | F.coalesce(F.array_contains(at, number), F.lit(False))
    return [number.isNull(), F.when(number.isNull(), F.lit(0)).otherwise(below), ~alone, F.when(alone, F.substring(digest, 1, 2)).otherwise("")]


def cap_positive_rate(
    df: DataFrame,
    caps: Mapping[str, float] | None = None,
    default: float | None = None,
    ids: Sequence[str] = ("file_path",),
    order: str = "fix_density",
) -> DataFrame:
    """Flip the least suspicious positives of a repository above its cap, where a cap is given.

    ``n_pos - int(n * cap)`` positives with the lowest ``order`` value become 0;
    nulls go last and an id digest breaks ties. The ranking is split at quantiles
    of the value (a few hundred buckets), and the rows at one cut value, which may
    be very many, by their digest; so no task sorts a whole repository.
    """
    caps = caps or {}
    if not caps and default is None:
        return df
    entries: list[Column] = []
    for repo, cap in caps.items():
        entries += [F.lit(repo), F.lit(float(cap))]
    listed = F.create_map(*entries)[F.col("repo_name")] if entries else F.lit(None).cast("double")
    cap = F.coalesce(listed, F.lit(float(default))) if default is not None else listed
    totals = df.groupBy("repo_name").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col("is_buggy").cast("bigint")).alias("__pos")
    )
    excess = totals.select(
        "repo_name",
        F.when(
            F.col("__pos") / F.col("__n") > cap,
            F.col("__pos") - F.floor(F.col("__n") * cap),
        ).alias("__flip"),
    )
    sized = null_safe_join(df, excess, ["repo_name"])
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids]))
    over = F.coalesce(F.col("__flip") > 0, F.lit(False)) & F.col("is_buggy").cast("boolean")
    value = F.col(order)
    candidates = sized.filter(over)
    ranked = rank_in_groups(
        candidates.withColumn("__digest", digest),
        ["repo_name"],
        rank_buckets(candidates, order, F.col("__digest")),
        [value, F.col("__digest")],
        "__rank",
    )
    label_type = df.schema["is_buggy"].dataType
    flipped = ranked.withColumn(
        "is_buggy",
        F.when(F.col("__rank") <= F.col("__flip"), F.lit(0)).otherwise(1).cast(label_type),
    )
    return sized.filter(~over).select(*df.columns).unionByName(flipped.select(*df.columns))


def collapse_any(labels: DataFrame, keys: Sequence[str] = ("repo_name", "file_path")) -> DataFrame:
    """A file is positive if any of its windows is."""
    return labels.groupBy(*keys).agg(F.max(F.col("is_buggy").cast("int")).alias("is_buggy"))


def collapse_last(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("repo_name", "file_path"),
    date: str = "window_end",
) -> DataFrame:
    """Per file: newest non-null value of every feature, label max, newest date."""
    newest = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(date, c))).alias(c) for c in features
    ]
    return df.groupBy(*keys).agg(
        *newest, F.max(F.col("is_buggy").cast("int")).alias("is_buggy"), F.max(date).alias("commit_date")
    )


def align_labels_by_name(sources: DataFrame, labels: DataFrame) -> DataFrame:
    """Label by normalized path, else the majority over files of that name."""
    exact = labels.groupBy(strip_relative(F.col("file_path")).alias("__path")).agg(
        F.max(F.col("is_buggy").cast("int")).alias("__exact")
    )
    majority = labels.groupBy(base_name(F.col("file_path")).alias("__name")).agg(
        (F.avg(F.col("is_buggy").cast("int")) >= 0.5).cast("int").alias("__majority")
    )
    return (
        sources.withColumn("__path", strip_relative(F.col("file_path")))
        .withColumn("__name", base_name(F.col("file_path")))
        .join(exact, "__path", "left")
        .join(majority, "__name", "left")
        .withColumn("is_buggy", F.coalesce("__exact", "__majority"))
        .filter(F.col("is_buggy").isNotNull())
        .drop("__path", "__name", "__exact", "__majority")
    )
