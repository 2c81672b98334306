"""An HTTP endpoint over a session: POST /sql with {"sql": "..."}; one statement at a time."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from korvid.engine import Engine, Result, result_json
from korvid.errors import SQLError


def answer(engine: Engine, text: str) -> str:
    """The result as JSON; a transaction that the script leaves open is rolled back."""
    try:
        return result_json(engine.execute(text))
    except SQLError as e:
        return result_json(Result(error=str(e)))
    finally:
        if engine.in_transaction:
            engine.execute("ROLLBACK")


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that runs in its own threads until shutdown() is called on it."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            try:
                sql = json.loads(body)["sql"]
            except (ValueError, KeyError, TypeError):
                return self.reply(400, json.dumps({"error": "expected an object with sql"}))
            if self.path != "/sql":
                return self.reply(404, json.dumps({"error": "no such path"}))
            with lock:
                self.reply(200, answer(engine, sql))

        def reply(self, status: int, text: str) -> None:
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
