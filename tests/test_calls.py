"""Calls in flight inside a task, against a server of this machine."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from mediaqc.functions import calls, models
from mediaqc.sources import readers

WAIT = 0.1


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def do_GET(self):
        name = self.path.split("?")[0].strip("/")
        if name == "moved":
            self.send_response(302)
            self.send_header("Location", "/there?q=1")
            return self.end_headers()
        if name == "gone":
            return self.send_error(404)
        self.send_response(200)
        self.send_header("Content-Type", "text/html" if name == "page" else "image/png")
        if name == "short":
            self.send_header("Content-Length", "10")
        self.end_headers()
        try:
            if name == "endless":
                while True:
                    self.wfile.write(b"x" * 65536)
            elif name == "drip":
                for _ in range(100):
                    self.wfile.write(b"x")
                    self.wfile.flush()
                    time.sleep(0.05)
            else:
                time.sleep(WAIT if name.startswith("slow") else 0)
                self.wfile.write(name.encode())
        except OSError:
            pass


class Server(ThreadingHTTPServer):
    daemon_threads = True
    request_queue_size = 128


@pytest.fixture(scope="module")
def host():
    server = Server(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_limits_of_a_download(host):
    web = calls.Http(deadline=0.5, read=0.4, most=1 << 20)
    assert web.get(f"{host}/a") == ("image/png", b"a") and web.get(f"{host}/moved") == ("image/png", b"there")
    for name in ("endless", "page"):
        with pytest.raises(calls.Refused):
            web.get(f"{host}/{name}")
    for name in ("drip", "gone", "short"):
        start = time.monotonic()
        with pytest.raises((OSError, TimeoutError)):
            web.get(f"{host}/{name}")
        assert time.monotonic() - start < 1.5
    with pytest.raises(calls.Refused):
        web.get("file:///etc/hosts")


def test_slow_urls_overlap_and_keep_their_order(spark, host):
    n = 200
    df = spark.createDataFrame([(k, f"{host}/slow{k}", True, b"old") for k in range(n)], "k int, url string, ok boolean, content binary").coalesce(1)
    small = readers.fetch(df.limit(1), calls.Http, flight=1)
    small.collect()  # the worker is there
    start = time.monotonic()
    got = readers.fetch(df, calls.Http, flight=20, most=100).collect()
    assert time.monotonic() - start < n * WAIT / 5
    assert [(r.k, r.ok, bytes(r.content)) for r in got] == [(k, True, f"slow{k}".encode()) for k in range(n)] and all(r.load_ok for r in got)
    odd = spark.createDataFrame([(f"{host}/{n}",) for n in ("gone", "page", "a")] + [(None,), ("nan",)], "url string")
    assert [r.load_ok for r in readers.fetch(odd.coalesce(1), calls.Http, pause=0).collect()] == [False, False, True, False, False]


def test_no_more_than_the_flight_and_errors_pass():
    running, most, lock = 0, 0, threading.Lock()

    def call(k):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.005 * (k % 3))
        with lock:
            running -= 1
        return k * k

    taken = []
    items = (taken.append(k) or k for k in range(50))
    answers = calls.in_order(call, items, 6)
    assert next(answers) == 0 and len(taken) <= 7  # nothing is read far ahead
    assert list(answers) == [k * k for k in range(1, 50)] and 1 < most <= 6
    with pytest.raises(ZeroDivisionError):
        list(calls.in_order(lambda k: 1 // k, [1, 0, 2], 2))
    assert list(calls.in_order(call, [], 3)) == []


def test_permits_by_time():
    now, waits = [0.0], []
    permits = calls.Permits(10, burst=3, clock=lambda: now[0], sleep=waits.append)
    for _ in range(5):
        permits.take()
    assert waits == pytest.approx([0.1, 0.2])
    now[0] = 10.0
    permits.take()
    assert len(waits) == 2


class Slow(models.Fake):
    def ask(self, prompt, image):
        time.sleep(0.05)
        return super().ask(prompt, image)


def test_models_overlap(spark):
    df = spark.range(60).select("id", F.lit("mine").alias("said"), F.col("id").cast("string").cast("binary").alias("content"))
    models.ask_all(df, models.Fake, "p", tasks=1).collect()
    start = time.monotonic()
    got = models.ask_all(df, Slow, "p", tasks=1, flight=15).collect()
    assert time.monotonic() - start < 60 * 0.05 / 2
    want = {r.id: r.flash_reply for r in models.ask_all(df, models.Fake, "p", tasks=2).collect()}
    assert {r.id: r.flash_reply for r in got} == want and {r.said for r in got} == {"mine"}
