"""Kinds of errors by message, code and status, and what to do about each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in the order in which they are tried: kind; statuses; whole codes; parts of codes; parts of messages.
KINDS = [
    ("CANCELLATION", (), (), (), ("abort", "cancel")),
    ("RATE_LIMIT", (429,), (), (), ("rate limit", "quota exceeded", "too many requests")),
    ("INVALID_API_KEY", (401, 403), (), (), ("api key", "unauthorized", "authentication")),
    ("NETWORK_ERROR", (), ("ECONNREFUSED", "ENOTFOUND", "ECONNRESET"), ("NETWORK",), ("network", "connection refused", "dns")),
    ("TIMEOUT", (), ("ETIMEDOUT",), (), ("timeout", "timed out")),
    ("API_UNAVAILABLE", (503, 502, 504), (), (), ("unavailable", "service down")),
    ("SERVICE_OVERLOADED", (503,), (), (), ("overload", "capacity")),
    ("INVALID_INPUT", (400,), ("VALIDATION_ERROR", "INPUT_VALIDATION_ERROR"), (), ("validation", "invalid input")),
    ("INVALID_FORMAT", (), (), (), ("format", "parse", "invalid format")),
    ("EMPTY_TEXT", (), (), (), ("empty", "no text", "missing text")),
    ("TRANSLATION_FAILED", (), ("TRANSLATION_ERROR",), (), ("translation failed", "generation failed")),
    ("QUALITY_TOO_LOW", (), (), (), ("quality", "confidence too low")),
    ("CONTENT_POLICY_VIOLATION", (), (), (), ("content policy", "safety", "blocked")),
    ("DATABASE_ERROR", (), (), ("DB_",), ("database", "sql")),
    ("UNSUPPORTED_FILE", (), (), (), ("unsupported file", "file type not supported")),
    ("CONFIGURATION_ERROR", (), (), (), ("configuration", "config", "environment")),
]
#: Action, most retries and whether the error is fatal, by kind.
ACTIONS = {
    "RATE_LIMIT": ("RETRY", 5, False), "NETWORK_ERROR": ("RETRY", 3, False), "TIMEOUT": ("RETRY", 2, False), "API_UNAVAILABLE": ("RETRY", 3, False), "SERVICE_OVERLOADED": ("RETRY", 4, False),
    "INVALID_INPUT": ("FIX_INPUT", 0, True), "INVALID_FORMAT": ("FIX_INPUT", 0, True), "EMPTY_TEXT": ("FAIL", 0, True), "TRANSLATION_FAILED": ("FALLBACK", 2, False), "QUALITY_TOO_LOW": ("FALLBACK", 1, False),
    "CONTENT_POLICY_VIOLATION": ("FALLBACK", 1, False), "INVALID_API_KEY": ("FAIL", 0, True), "UNSUPPORTED_FILE": ("FAIL", 0, True), "DATABASE_ERROR": ("RETRY", 2, False), "CONFIGURATION_ERROR": ("FAIL", 0, True),
    "CANCELLATION": ("FAIL", 0, True), "UNKNOWN": ("RETRY", 1, False),
}


def error_kind(message: Column, code: Column | None = None, status: Column | None = None) -> Column:
    """The first kind that a status, a code (whatever its case) or a part of the message (whatever its case) speaks for; UNKNOWN without one."""
    m = F.lower(F.coalesce(message, F.lit("")))
    c = F.upper(F.coalesce(F.lit("") if code is None else code, F.lit("")))
    s = F.coalesce(F.lit(0) if status is None else status.cast("int"), F.lit(0))
    out = None
    for kind, statuses, codes, parts, words in KINDS:
        fits = s.isin(*statuses) | c.isin(*codes)
        for p in parts:
            fits = fits | c.contains(p)
        for w in words:
            fits = fits | m.contains(w)
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise("UNKNOWN")


def recovery(kind: Column) -> Column:
    """Struct (action, retries, retryable, fatal) of a kind; null for no known one."""
    known = F.create_map(*[x for k, (action, retries, fatal) in ACTIONS.items() for x in (F.lit(k), F.struct(F.lit(action).alias("action"), F.lit(retries).alias("retries"), F.lit(retries > 0).alias("retryable"), F.lit(fatal).alias("fatal")))])
    return F.try_element_at(known, kind)
