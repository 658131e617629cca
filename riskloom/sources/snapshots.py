"""Source-text snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.membership import may_be_among
from riskloom.functions.ordering import null_safe_join
from riskloom.functions.text import not_blank
from riskloom.session import fresh_path
from riskloom.sources.tables import write_table

# Names a source-text column may have, in order of preference.
SOURCE_COLUMN_NAMES = ("source_code", "source", "content", "code")


def source_column(df: DataFrame) -> str:
    for name in SOURCE_COLUMN_NAMES:
        if name in df.columns:
            return name
    raise ValueError(f"no source column among {SOURCE_COLUMN_NAMES}")


def latest_source_snapshot(
    log: DataFrame,
    keys: Sequence[str] = ("repo_name", "file_path"),
    order: Sequence[str] = ("commit_date", "commit_hash"),
) -> DataFrame:
    """Newest non-blank source per file; of equal places in ``order`` the largest text counts.

    The newest place of each file is found on narrow rows and stored. Revisions at other places
    are left out by a bitmap of these, before any shuffle. The others meet the places in a hash
    join that holds the places only, so texts pass by unsorted, and few are left to compare.
    ``log`` is read twice, so it should be a stored table.
    """
    text = source_column(log)
    usable = log.filter(not_blank(F.col(text)))
    place = F.struct(*order)
    newest = usable.groupBy(*keys).agg(F.max(place).alias("__at"))
    newest = write_table(newest, fresh_path(log.sparkSession, "newest-places"))
    revisions = usable.select(*keys, place.alias("__at"), F.col(text).alias("source_code"))
    revisions = may_be_among(revisions, newest, [*keys, "__at"])
    found = null_safe_join(revisions, newest.hint("shuffle_hash"), [*keys, "__at"])
    return found.groupBy(*keys).agg(F.max("source_code").alias("source_code"))
