"""Bounded, repeatable samples of labelled rows for training.

Only these samples are bounded; scoring always covers every row.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def _place(what: str) -> Column:
    """A number in [0, 1) that depends on doc_id alone."""
    return F.pmod(F.xxhash64(F.lit(what), "doc_id"), F.lit(1_000_000)) / 1_000_000


def per_class(rows: DataFrame, column: str, most: int, most_rows: int | None = None, most_classes: int = 1000) -> DataFrame:
    """About ``most`` rows of each value of ``column``, chosen by a hash of doc_id; all rows of rarer values.

    The share of each value follows from a count of all rows, so the sample
    stays bounded however large the table is; with ``most_rows``, each value
    gets an equal part of so many rows at most.  Beyond ``most_classes`` values
    the rarest can't be learned, which is said in a warning.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(most_classes + 1).collect()
    if len(counts) > most_classes:
        warnings.warn(f"{column} has more than {most_classes} values; the rarest are not learned", stacklevel=2)
        counts = counts[:most_classes]
    if not counts:
        return rows.where("false")
    most = min(most, max(1, most_rows // len(counts))) if most_rows else most
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, most / r["count"]))])
    return rows.where(_place("sample") < F.try_element_at(share, F.col(column)))


def within_bytes(rows: DataFrame, most_bytes: int) -> DataFrame:
    """The rows (doc_id, text and others), or where their texts have more bytes, a share of them by a hash of doc_id, each with its whole text."""
    rows = stored(rows, "sample")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return rows if total <= most_bytes else rows.where(_place("bytes") < most_bytes / total)
