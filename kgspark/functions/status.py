"""Small classification expressions for run logs and model calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, or_empty

# Error classes that may be retried.
RETRYABLE = ("network", "rate_limit", "server")


def log_level(message: Column | str) -> Column:
    text = or_empty(message)
    return (
        F.when(F.contains(text, F.lit("[info]")), "info")
        .when(F.contains(text, F.lit("[error]")), "error")
        .otherwise("debug")
    )


def http_error_class(code: Column | str) -> Column:
    """Error class of a failed call; a missing code means the network failed."""
    c = col(code)
    return (
        F.when(c.isNull(), "network")
        .when(c == 429, "rate_limit")
        .when((c >= 400) & (c < 500), "invalid_request")
        .when((c >= 500) & (c < 600), "server")
        .otherwise("http")
    )


def retryable(code: Column | str) -> Column:
    return http_error_class(code).isin(*RETRYABLE)


def mask_key(key: Column | str) -> Column:
    k = col(key)
    masked = F.concat(F.substring(k, 1, 4), F.lit("..."), F.right(k, F.lit(4)))
    return F.when(F.length(k) <= 8, F.lit("****")).otherwise(masked)


def split_model_ref(ref: Column | str, default_provider: str, default_model: str) -> Column:
    """``provider:model`` at the first colon as a struct; a reference without colon gives the default pair."""
    parts = F.split(col(ref), ":", 2)
    ok = F.size(parts) == 2
    return F.struct(
        F.when(ok, F.get(parts, F.lit(0))).otherwise(F.lit(default_provider)).alias("provider"),
        F.when(ok, F.get(parts, F.lit(1))).otherwise(F.lit(default_model)).alias("model"),
    )
