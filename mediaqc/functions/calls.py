"""Calls to the outside world from inside a task: a bounded number in flight, answers in order, permits by time, capped downloads."""

from __future__ import annotations

import http.client
import ssl
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd


class Refused(Exception):
    """An answer that asking again would not change."""


class Permits:
    """At most ``rate`` calls a second, and ``burst`` at once after a pause. The threads of a task share one."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.burst, self.clock, self.sleep = 1 / rate, burst, clock, sleep
        self.next, self.lock = float("-inf"), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.next = max(self.next, now - (self.burst - 1) * self.gap)
            wait, self.next = self.next - now, self.next + self.gap
        if wait > 0:
            self.sleep(wait)


def in_order(call: Callable, items: Iterable, flight: int) -> Iterator:
    """``call`` of each item, in order; at most ``flight`` run or wait to be taken, whatever the number of items."""
    with ThreadPoolExecutor(flight) as pool:
        waiting: deque = deque()
        try:
            for item in items:
                if len(waiting) == flight:
                    yield waiting.popleft().result()
                waiting.append(pool.submit(call, item))
            while waiting:
                yield waiting.popleft().result()
        finally:
            for w in waiting:
                w.cancel()


def answered(pdf: pd.DataFrame, answers: Iterator, size: Callable[[object], int], most: int) -> Iterator[tuple[pd.DataFrame, list]]:
    """Rows with their answers in slices, each ended when its answers reach ``most`` bytes, so that no batch holds them all."""
    start, got, held = 0, [], 0
    for answer in answers:
        got.append(answer)
        held += size(answer)
        if held >= most:
            yield pdf.iloc[start : start + len(got)], got
            start, got, held = start + len(got), [], 0
    if got:
        yield pdf.iloc[start:], got


@dataclass
class Http:
    """Gets (content type, bytes) of a url. Redirects are followed; each wait of the socket, the size and the whole time are limited.

    An answer with pages or data in place of an image, or one that is too large, is refused as soon as that is known.
    """

    connect: float = 8.0
    read: float = 15.0
    deadline: float = 30.0
    most: int = 20 * 1024 * 1024
    redirects: int = 10
    agent: str = "mediaqc"

    def get(self, url: str) -> tuple[str, bytes]:
        ends = time.monotonic() + self.deadline
        for _ in range(self.redirects + 1):
            at = urlsplit(url)
            if at.scheme not in ("http", "https") or not at.hostname:
                raise Refused(f"no address of the web: {url[:80]}")
            secure = {"context": ssl.create_default_context()} if at.scheme == "https" else {}
            made = (http.client.HTTPSConnection if secure else http.client.HTTPConnection)(at.hostname, at.port, timeout=self.connect, **secure)
            try:
                made.connect()
                sock = made.sock
                sock.settimeout(self.read)
                made.request("GET", (at.path or "/") + (f"?{at.query}" if at.query else ""), headers={"User-Agent": self.agent, "Accept": "image/*,*/*;q=0.8"})
                answer = made.getresponse()
                if answer.status in (301, 302, 303, 307, 308) and answer.getheader("Location"):
                    url = urljoin(url, answer.getheader("Location"))
                    continue
                if answer.status >= 400:
                    raise OSError(f"status {answer.status}")
                kind = (answer.getheader("Content-Type") or "").lower()
                if "html" in kind or "json" in kind:
                    raise Refused(f"not an image: {kind}")
                return kind, self._body(answer, sock, ends)
            finally:
                made.close()
        raise Refused("too many redirects")

    def _body(self, answer: http.client.HTTPResponse, sock, ends: float) -> bytes:
        if answer.length is not None and answer.length > self.most:
            raise Refused("too large")
        parts, held, told = [], 0, answer.length
        while True:
            left = ends - time.monotonic()
            if left <= 0:
                raise TimeoutError("the download took too long")
            sock.settimeout(min(self.read, left))
            part = answer.read1(65536)  # what one wait brings, so that a slow sender cannot outlast the deadline
            if not part:
                if told is not None and held < told:
                    raise OSError("the answer ended early")
                return b"".join(parts)
            parts.append(part)
            held += len(part)
            if held > self.most:
                raise Refused("too large")
