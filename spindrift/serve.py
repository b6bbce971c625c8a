"""Answers over HTTP: GET / and GET /health, POST /ask with {"question": 3 to 500 characters}."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

LEAST, MOST = 3, 500
DISCLAIMER = "Information from published safety updates, not medical advice."


class State:
    """What the handlers share: ``ask`` is a function from a question to a dict, None until the index is ready; ``why`` says why not."""

    def __init__(self, ask=None, why: str = "starting up"):
        self.ask, self.why = ask, why


def respond(state: State, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
    """(status, JSON) of a request."""
    if (method, path) == ("GET", "/"):
        return 200, {"service": "spindrift", "disclaimer": DISCLAIMER, "endpoints": {"POST /ask": "one question, answered from the indexed articles", "GET /health": "whether this process answers yet"}}
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok", "retriever_ready": state.ask is not None}
    if (method, path) != ("POST", "/ask"):
        return 404, {"detail": "not found"}
    try:
        question = json.loads(body or b"{}").get("question")
    except (ValueError, AttributeError):
        question = None
    if not isinstance(question, str) or not LEAST <= len(question) <= MOST:
        return 422, {"detail": f"question: a text of {LEAST} to {MOST} characters"}
    if state.ask is None:
        return 503, {"detail": f"no index to answer from: {state.why}"}
    got = state.ask(question)
    return 200, {"question": question, "answer": got["answer"], "sources": list(got["sources"]), "disclaimer": DISCLAIMER}


def server(state: State, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _do(self):
            status, out = respond(state, self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            raw = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _do

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
