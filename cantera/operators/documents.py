"""Text documents from items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_pairs(items: DataFrame, key: str, *types: str, metadata: tuple[str, ...] = ()) -> DataFrame:
    """One document per item and text type: ``id, <key>, <metadata>, type, text``.

    The id is a digest of key and type, so that a rerun gives the same documents.
    """
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("text")) for t in types]))
    rows = items.select(key, *metadata, each.alias("d"))
    identity = F.md5(F.concat_ws("|", F.col(key).cast("string"), "d.type"))
    return rows.select(identity.alias("id"), key, *metadata, "d.type", "d.text")


def flattened(documents: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Documents with their metadata as plain columns beside ``id`` and ``text``."""
    return documents.select("id", f"{metadata}.*", "text")
