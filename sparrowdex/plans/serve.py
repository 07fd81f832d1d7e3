"""Endpoints over an engine: /search, /healthz and /admin/reload, publish, retire. An answer comes from the snapshot that it began with."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine


class Service:
    """Holds the current snapshot. opened gives a new one for reload; slots: answers at a time, beyond which a request is refused."""

    def __init__(self, opened: Callable[[], Engine], slots: int = 8, deadline: float | None = None, model=None, enforce: bool = False):
        self.opened, self.engine = opened, opened()
        self.deadline, self.model, self.enforce = deadline, model, enforce
        self._slots, self._swap = threading.BoundedSemaphore(slots), threading.Lock()

    def search(self, q: str, k: int = 10) -> tuple[int, dict]:
        if k < 1:
            return 400, {"error": "k is a positive number"}
        if not self._slots.acquire(blocking=False):
            return 503, {"error": "too many requests"}
        try:
            began = time.monotonic()
            a = self.engine.ask(q, k, model=self.model, deadline=self.deadline, budget=self.deadline, enforce=self.enforce)
            return 200, {
                "hits": [{"doc_id": d, "score": s} for d, s in a.hits],
                "complete": a.complete,
                "degrade": a.level,
                "lang": a.lang,
                "correction": [{"from": x, "to": y, "applied": z} for x, y, z in a.correction],
                "cached": a.cached,
                "took_ms": round(1000 * (time.monotonic() - began), 3),
            }
        finally:
            self._slots.release()

    def swap(self, make: Callable[[Engine], Engine]) -> dict:
        """Puts a new snapshot in the old one's place; answers that are under way keep theirs."""
        with self._swap:
            self.engine = make(self.engine)
        return self.engine.health()

    def handle(self, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
        at = urlsplit(target)
        args = {k: v[-1] for k, v in parse_qs(at.query).items()}
        try:
            if (method, at.path) == ("GET", "/search"):
                return self.search(args.get("q", ""), int(args.get("k", 10)))
            if (method, at.path) == ("GET", "/healthz"):
                return 200, {"ok": True, **self.engine.health()}
            if method == "POST" and at.path.startswith("/admin/"):
                said = json.loads(body or b"{}")
                spark = self.engine.docs.sparkSession
                if at.path == "/admin/reload":
                    return 200, self.swap(lambda _: self.opened())
                if at.path == "/admin/publish":
                    more = spark.read.parquet(said["path"])
                    return 200, self.swap(lambda e: e.published(more.select(*e.docs.columns)))
                if at.path == "/admin/retire":
                    ids = spark.createDataFrame([(int(i),) for i in said["doc_ids"]], "doc_id long")
                    return 200, self.swap(lambda e: e.retired(ids))
        except (KeyError, ValueError) as e:
            return 400, {"error": str(e)}
        return 404, {"error": "no such address"}


def served(service: Service, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for the service; serve_forever() runs it, server_port is where."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            code, out = service.handle(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            raw = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
