"""Whether a collection can serve: its state, the service's health, the guards of a request, and the strict manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.rows import whole_number


def index_reason(count: Column, model: Column, chunk: Column, overlap: Column, want_model: str, want_chunk: int = 500, want_overlap: int = 0) -> Column:
    """empty_index, compatible or configuration_mismatch; `chunk` and `overlap` are untyped text."""
    same = (model == want_model) & (whole_number(chunk) == want_chunk) & (whole_number(overlap) == want_overlap)
    return F.when(count == 0, "empty_index").when(F.coalesce(same, F.lit(False)), "compatible").otherwise("configuration_mismatch")


def inspect(collection: DataFrame, metadata: DataFrame, want_model: str, want_chunk: int = 500, want_overlap: int = 0) -> DataFrame:
    """(count, compatible, reason) of a collection for each row (model, chunk, overlap) of its metadata."""
    counted = metadata.crossJoin(F.broadcast(collection.agg(F.count("*").alias("count"))))  # one row
    reason = index_reason(F.col("count"), F.col("model"), F.col("chunk"), F.col("overlap"), want_model, want_chunk, want_overlap)
    return counted.withColumn("reason", reason).withColumn("compatible", F.col("reason") == "compatible")


def health(store: Column, keys: Column, count: Column, compatible: Column) -> Column:
    """The service's status: what is missing first, in order."""
    return F.when(~store, "unavailable").when(~keys, "needs_configuration").when(count == 0, "needs_index").when(~compatible, "needs_reindex").otherwise("ready")


def guard(keys: Column, store: Column, count: Column, compatible: Column, failure: Column) -> Column:
    """The status code of a request; `failure` is what its search or answer ended with, if it failed."""
    before = F.when(~keys, 503).when(~store, 503).when(count == 0, 409).when(~compatible, 409)
    return before.when(failure == "authentication", 502).when(failure == "api", 502).when(failure == "search", 503).when(failure.isNotNull(), 500).otherwise(200)


def strict_reason(readable: Column, count: Column, manifest: Column, valid: Column, same_settings: Column, same_content: Column, manifest_count: Column) -> Column:
    """The first of eight reasons, in order."""
    return (
        F.when(~readable, "index_unavailable").when(count == 0, "empty_index").when(~manifest, "missing_manifest").when(~valid, "invalid_manifest")
        .when(~same_settings, "settings_mismatch").when(~same_content, "content_mismatch").when(manifest_count != count, "chunk_count_mismatch").otherwise("compatible")
    )


def fingerprint(*fields: Column | str) -> Column:
    """SHA-256 of the fields as one JSON object, in the given order (give them sorted by name)."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary"), 256)
