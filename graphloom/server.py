"""The read-only JSON requests of ``api.handle`` over HTTP, on this machine only."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qsl, urlsplit

from .api import Tools, handle

IDLE = 5.0  # seconds that a client may keep the one thread waiting


def server(tools: Tools, port: int = 8000, idle: float = IDLE) -> HTTPServer:
    """A server of one thread; port 0 takes a free one.  ``serve_forever`` starts it."""

    class Handler(BaseHTTPRequestHandler):
        timeout = idle

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            try:
                status, body = handle(tools, at.path, dict(parse_qsl(at.query)))
            except Exception as e:  # noqa: BLE001
                status, body = 500, json.dumps({"error": type(e).__name__})
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_: object) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
