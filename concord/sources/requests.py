"""Requests to services: pluggable transports, classes of errors, retries at a shared rate, pages that name their successors.

A transport is a function ``(url, headers) -> (status, headers, body)``. Jobs name it as text, ``module:function``, so that every worker can
import it; so are functions that give headers with credentials, which therefore never stand in a plan.
"""

from __future__ import annotations

import importlib
import json
import time
import zlib
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import parse_qs, urljoin, urlsplit
from urllib.request import Request, urlopen

from concord.sources.sinks import RETRIED, Cancelled, TokenBucket, backoff, retry_after, retry_delay

Transport = Callable[[str, dict], tuple[int, dict, bytes]]

#: A few requests at first, then the steady rate: presets of requests a second.
RATES = {"careful": 2.0, "usual": 10.0}


class ServiceError(Exception):
    """An answer that is no success."""

    def __init__(self, status: int, message: str = "", after: float | None = None):
        super().__init__(f"status {status}{': ' if message else ''}{message}")
        self.status, self.retry_after = status, after


class Unauthorised(Exception):
    """There are no credentials for a service."""


#: Severity by kind of error; the first that fits counts, others are ``info``.
SEVERITIES: list[tuple[type, str]] = [(Cancelled, "fatal"), (Unauthorised, "critical"), (PermissionError, "critical"), (ConnectionError, "warning"), (TimeoutError, "warning"), (URLError, "warning"), (LookupError, "warning")]


def severity(error: Exception) -> str:
    """``fatal`` for a cancelled run, ``critical`` for credentials, ``warning`` for limits, the network and what is not found, else ``info``."""
    status = getattr(error, "status", None)
    if status in (401, 403):
        return "critical"
    if status in RETRIED or status == 404:
        return "warning"
    return next((name for kind, name in SEVERITIES if isinstance(error, kind)), "info")


def retryable(error: Exception) -> bool:
    """Whether a request is tried again: busy or broken servers and the network, never credentials, missing things or a cancelled run."""
    if getattr(error, "status", None) is not None:
        return error.status in RETRIED
    return isinstance(error, (ConnectionError, TimeoutError)) or isinstance(error, URLError) and not isinstance(error, HTTPError)


def named(path: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def http(url: str, headers: dict) -> tuple[int, dict, bytes]:
    """The transport of the standard library."""
    try:
        with urlopen(Request(url, headers=headers), timeout=30) as answer:  # noqa: S310  the service's address is the caller's
            return answer.status, dict(answer.headers), answer.read()
    except HTTPError as e:
        return e.code, dict(e.headers), e.read()


def attempted(call: Callable[[], object], attempts: int = 5, delay: float = 1.0, bucket: TokenBucket | None = None, again: Callable[[Exception], bool] = retryable):
    """What ``call`` gives, tried up to ``attempts`` times with growing pauses or those that the server asks for."""
    for i in range(attempts):
        while bucket and (wait := bucket.wait_time()):
            time.sleep(wait)
        try:
            return call()
        except Exception as e:
            if i == attempts - 1 or not again(e):
                raise
            time.sleep(retry_delay(backoff(i, delay), getattr(e, "retry_after", None)))
    raise ValueError("attempts must be positive")


def get_json(url: str, transport: Transport, headers: dict) -> str:
    """The text of a successful answer; others raise ``ServiceError``."""
    status, answer, body = transport(url, headers)
    if not 200 <= status < 300:
        after = next((v for k, v in answer.items() if k.lower() == "retry-after"), None)
        raise ServiceError(status, body[:200].decode("utf-8", "replace"), retry_after(after) if after else None)
    return body.decode("utf-8")


def follow(first: str, transport: Transport, headers: Callable[[], dict] = dict, base: str | None = None, most: int | None = None, **retries) -> Iterator[tuple[int, str, str]]:
    """``number, url, text`` of a page and all its successors, at most ``most``. A relative ``next`` is one of ``base`` or of its page."""
    url, number = urljoin(base, first) if base else first, 0
    while url and (most is None or number < most):
        text = attempted(lambda url=url: get_json(url, transport, headers()), **retries)
        yield number, url, text
        after = json.loads(text).get("next")
        url, number = urljoin(url if base is None or "://" in (after or "") else base, after) if after else None, number + 1


# ---- recorded answers: a folder of text files that Spark wrote

#: Recorded pages of one file.
CHUNK = 500


class _Folder:
    """The lines of the file that was read last."""

    at: tuple[str, int] | None = None
    lines: list[str] = []

    @classmethod
    def read(cls, folder: str, chunk: int) -> list[str]:
        if cls.at != (folder, chunk):
            from pyarrow import fs

            where, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
            lines: list[str] = []
            for f in sorted(where.get_file_info(fs.FileSelector(f"{path}/chunk={chunk}", allow_not_found=True)), key=lambda f: f.path):
                if f.base_name.startswith("part-"):
                    with where.open_input_stream(f.path) as s:
                        lines += s.read().decode("utf-8").splitlines()
            cls.at, cls.lines = (folder, chunk), lines
        return cls.lines


def recorded_page(url: str, headers: dict) -> tuple[int, dict, bytes]:
    """A transport over pages recorded in order: ``offset`` and ``limit`` of the address name the page, ``folder`` the files."""
    q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
    page = int(q.get("offset", 0)) // int(q["limit"])
    lines = _Folder.read(q["folder"], page // CHUNK)
    if page % CHUNK >= len(lines):
        return 404, {}, b"no such page"
    return 200, {}, lines[page % CHUNK].encode()


def recorded_search(url: str, headers: dict) -> tuple[int, dict, bytes]:
    """A transport over recorded searches: lines ``query TAB answer``, in files by the checksum of the query."""
    q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
    text, chunks = q.get("q", q.get("term", "")), int(q["chunks"])
    for line in _Folder.read(q["folder"], zlib.crc32(text.encode()) % chunks):
        asked, _, answer = line.partition("\t")
        if asked == text:
            return 200, {}, answer.encode()
    return 404, {}, b"not recorded"
