"""Sinks: CSV reports, and external effects with retries and a rate limit."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# HTTP answers after which a request is tried again.
RETRIED = frozenset({408, 429, 500, 502, 503, 504})


class Cancelled(Exception):
    """The run was told to stop; what raised it has not been applied."""


@F.pandas_udf(StringType())
def six_digits(values: pd.Series) -> pd.Series:
    """Numbers as C's ``%.6g`` writes them."""
    return values.map(lambda v: None if pd.isna(v) else "%.6g" % v)


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header even for no rows; a field is quoted only if it has to be. For reports, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def histogram_path(path: str) -> str:
    """``report.csv`` has its histogram in ``report.histogram.csv``."""
    stem, dot, end = path.rpartition(".")
    return f"{stem}.histogram.{end}" if dot and "/" not in end else f"{path}.histogram"


def retry_delay(attempt_delay: float, retry_after: float | None = None) -> float:
    """Seconds to wait: the back-off, or what the server asks for if that is longer, up to 300."""
    return attempt_delay if retry_after is None else max(attempt_delay, min(retry_after, 300.0))


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds of a Retry-After header: a number, or a date; None for others."""
    from email.utils import parsedate_to_datetime

    try:
        return max(0.0, float((value or "").strip()))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


def backoff(attempt: int, base: float = 1.0, jitter: float = 0.1, rng: random.Random | None = None) -> float:
    delay = min(base * 2**attempt, 32.0)
    return delay * (1 + (rng or random).uniform(-jitter, jitter))


class TokenBucket:
    """A bucket of ten seconds' tokens that refills at a steady rate."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic):
        self.rate, self.capacity, self.clock = rate, max(1, int(10 * rate)), clock
        self.tokens, self.at = float(self.capacity), clock()

    def wait_time(self, n: int = 1) -> float:
        """Takes ``n`` tokens and gives 0, or gives the seconds until there are enough."""
        now = self.clock()
        self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens >= n:
            self.tokens -= n
            return 0.0
        return (n - self.tokens) / self.rate


def send(ops: DataFrame, effect: Callable[[dict], None], rate: float = 2.0, parallel: int = 5, attempts: int = 3, retryable: Callable[[Exception], bool] = lambda e: getattr(e, "status", None) in RETRIED, order: str | None = None, pause: float = 0.1) -> DataFrame:
    """Apply operations by an external effect; ``op_key, status, error`` of each. All partitions together keep to ``rate`` a second.

    With ``order`` they go one after the other in the order of that column. An effect that raises ``Cancelled`` was not applied: it and what its
    task still had to do get no row but one with the status ``cancelled``.
    Effects replace whole states, so one that a re-run task repeats changes nothing. Store the result once and keep it as the checkpoint log.
    """
    parallel = 1 if order else parallel

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(rate / parallel)  # the service sees ``rate`` in all
        stopped = False
        for pdf in batches:
            out = []
            for op in pdf.to_dict("records") if not stopped else []:
                status, error = "failed", None
                for i in range(attempts):
                    while wait := bucket.wait_time():
                        time.sleep(wait)
                    try:
                        effect(op)
                        status, error = "done", None
                        break
                    except Cancelled:
                        status, error, stopped = "cancelled", None, True
                        break
                    except Exception as e:  # noqa: BLE001  the outcome is recorded, whatever it is
                        error = str(e)
                        if not retryable(e) or i == attempts - 1:
                            break
                        time.sleep(retry_delay(backoff(i, pause), getattr(e, "retry_after", None)))
                out.append((op["op_key"], status, error))
                if stopped:
                    break
            yield pd.DataFrame(out, columns=["op_key", "status", "error"])

    dealt = ops.repartition(1).sortWithinPartitions(order) if order else ops.repartition(parallel)
    return dealt.mapInPandas(run, "op_key string, status string, error string")
