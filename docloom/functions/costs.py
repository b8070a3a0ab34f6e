"""Token, price, retry and throughput arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# List prices in US dollars per million tokens.
INPUT_USD_PER_MTOK = 2.0
OUTPUT_USD_PER_MTOK = 10.0
CACHE_WRITE_WEIGHT = 1.25
CACHE_READ_WEIGHT = 0.1
# Size of one scoring request.
BATCH_SIZE = 40
MAX_IN_FLIGHT = 32
MAX_TOKENS_BASE = 2048
MAX_TOKENS_PER_ENTRY = 128
INPUT_BASE = 5095
# What a request was observed to use.
EXPECTED_INPUT_BASE = 1521
EXPECTED_BYTES_PER_TOKEN = 2.6
EXPECTED_OUTPUT_PER_ENTRY = 32
# Retry rules.
RETRY_BASE_S = 2.0
RETRY_MAX_S = 30.0
MAX_ATTEMPTS = 3
RETRYABLE_STATUSES = (408, 409, 429)
UNBILLED_STATUSES = (400, 401, 403, 404, 413, 429)
# Limits of one run.
REQUESTS_PER_BATCH = 2
SPARE_REQUESTS = 4
SPARE_OUTPUTS = 3
RUN_TIME_LIMIT_S = 300.0
RUN_COST_LIMIT_USD = 6.0
# Connections one client pool opens.
POOL_LIMIT = 1000


def cost_usd(
    tokens_in: Column, tokens_out: Column, in_price: float = INPUT_USD_PER_MTOK, out_price: float = OUTPUT_USD_PER_MTOK
) -> Column:
    return (tokens_in * F.lit(in_price) + tokens_out * F.lit(out_price)) / F.lit(1e6)


def round_up_cents(x: Column) -> Column:
    return F.ceil(x * F.lit(100.0)).cast("double") / F.lit(100.0)


def about_usd(x: Column) -> Column:
    """A rounded amount to show; a decimal tie rounds up."""
    small = F.concat(F.lit("about $"), F.format_string("%.3f", x))
    large = F.concat(F.lit("about $"), F.format_string("%.2f", x))
    return F.when(x < 0.001, F.lit("under $0.001")).when(x < 0.1, small).otherwise(large)


def requested_delay(headers: Column) -> Column:
    """Seconds the server asked to wait: milliseconds header first, then seconds."""
    def usable(name: str, unit: float) -> Column:
        seconds = headers[name].try_cast("double") * F.lit(unit)
        return F.when(~F.isnan(seconds) & (seconds >= 0) & (seconds < F.lit(float("inf"))), seconds)

    return F.coalesce(usable("retry-after-ms", 0.001), usable("retry-after", 1.0))


def retry_delay(requested: Column, failed_attempt: Column) -> Column:
    backoff = F.lit(RETRY_BASE_S) * F.pow(F.lit(2.0), failed_attempt - 1)
    return F.least(F.coalesce(requested, backoff), F.lit(RETRY_MAX_S))


def fetch_delay(failed_attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), failed_attempt.cast("double")), F.lit(RETRY_MAX_S))


def max_tokens_for(entries: Column) -> Column:
    return (F.lit(MAX_TOKENS_BASE) + F.lit(MAX_TOKENS_PER_ENTRY) * entries).cast("bigint")


def input_bound(payload_bytes: Column) -> Column:
    return (F.lit(INPUT_BASE) + payload_bytes).cast("bigint")


def ideal_throughput(requests: Column, concurrency: Column, latency_s: Column, jitter: Column, pooled: Column) -> Column:
    """Requests per second if only the fixed latency cost time; null with jitter."""
    lanes = F.when(pooled, F.least(concurrency, F.lit(POOL_LIMIT))).otherwise(concurrency)
    rounds = F.ceil(requests / lanes)
    return F.when(jitter <= 0, requests / (rounds * latency_s))


def expected_input_tokens(payload_bytes: Column) -> Column:
    """Halves round to even."""
    return (F.lit(EXPECTED_INPUT_BASE) + F.bround(payload_bytes / F.lit(EXPECTED_BYTES_PER_TOKEN), 0)).cast("bigint")


def billed_input(plain: Column, cache_write: Column, cache_read: Column) -> Column:
    zero = F.lit(0)
    return plain + F.coalesce(cache_write, zero) + F.coalesce(cache_read, zero)


def weighted_input(plain: Column, cache_write: Column, cache_read: Column) -> Column:
    zero = F.lit(0)
    return (
        plain
        + F.coalesce(cache_write, zero) * F.lit(CACHE_WRITE_WEIGHT)
        + F.coalesce(cache_read, zero) * F.lit(CACHE_READ_WEIGHT)
    )


def estimate_tokens(byte_count: Column, overhead: int, bytes_per_token: float = 2.5) -> Column:
    return (F.ceil(byte_count / F.lit(bytes_per_token)) + F.lit(overhead)).cast("bigint")


def is_retryable(status: Column, should_retry: Column) -> Column:
    """Statuses worth another attempt, unless the server says otherwise."""
    worth = status.isin(*RETRYABLE_STATUSES) | (status >= 500)
    return worth & ~F.coalesce(should_retry == "false", F.lit(False))


def age_seconds(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(1e6)
