"""Retry rules as column expressions: delays, which errors are tried again, and what an error is called."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# The retry settings with their defaults, and below the names of errors.
@dataclass(frozen=True)
class RetryConfig:
    max_retries: int = 3
    initial_delay: float = 1.0
    max_delay: float = 60.0
    exponential_base: float = 2.0
    jitter: bool = True


def backoff(attempt: Column, config: RetryConfig = RetryConfig()) -> Column:  # noqa: B008
    delay = F.least(F.lit(config.initial_delay) * F.pow(F.lit(config.exponential_base), attempt), F.lit(config.max_delay))
    return delay * (F.rand() + 0.5) if config.jitter else delay


def linear_backoff(attempt: Column, retry_delay: float = 2.0) -> Column:
    return F.lit(retry_delay) * (attempt + 1)


SERVER_ERRORS = (500, 599)
RETRIED = ("connection", "timeout")
# What failures are called, and responses by status.
FAILURES = {"connection": "connection_error", "timeout": "timeout"}
RESPONSES = {404: "not_found", 403: "forbidden", 429: "rate_limited"}
SERVER, UNKNOWN = "server_error", "unknown_error"


def is_retryable(kind: Column, status: Column) -> Column:
    """Connection failures and timeouts; of responses only server errors."""
    return kind.isin(*RETRIED) | ((kind == "response") & F.coalesce(status.between(*SERVER_ERRORS), F.lit(False)))


def worth_another_try(kind: str, status: int | None) -> bool:
    """The same for a failure at hand."""
    return kind in RETRIED or kind == "response" and status is not None and SERVER_ERRORS[0] <= status <= SERVER_ERRORS[1]


def error_name(kind: Column, status: Column) -> Column:
    response = F.when(status >= SERVER_ERRORS[0], SERVER).otherwise(F.concat(F.lit("http_"), status.cast("string")))
    for code, name in RESPONSES.items():
        response = F.when(status == code, name).otherwise(response)
    named = F.when(kind == "response", response).otherwise(F.lit(UNKNOWN))
    for failure, name in FAILURES.items():
        named = F.when(kind == failure, name).otherwise(named)
    return named


def name_of_error(kind: str, status: int | None) -> str:
    """The same for a failure at hand."""
    if kind != "response" or status is None:
        return FAILURES.get(kind, UNKNOWN)
    return RESPONSES.get(status) or (SERVER if status >= SERVER_ERRORS[0] else f"http_{status}")
