"""An HTTP front end over a store: GET/PUT/DELETE /key/<key> and POST /query, as text.

    serve(store, port=3000)

``respond`` is the whole of it without a socket: (method, path, body) to (status, text). ``answer`` gives the text in parts, as the entries
come; the server sends them on like that, so that a long range is never held as a whole. Requests go to the log ``tidewell.server``.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from tidewell.plans import dsl
from tidewell.store import Busy, IndexExists, Store, render_parts
from tidewell.txn import Commit, run

OK, NO_CONTENT, NOT_MODIFIED, BUILDING, BAD_REQUEST, NOT_FOUND, TOO_MANY, ERROR, NOT_IMPLEMENTED = 200, 204, 304, 102, 400, 404, 429, 500, 501
RETRIES = 5
Answer = tuple[int, Iterator[str]]
log = logging.getLogger(__name__)


def _text(status: int, text: str = "") -> Answer:
    return status, iter([text] if text else [])


def _found(rows, one: bool) -> Answer:
    parts = render_parts(rows)
    first = next(parts, None)
    if first is None:
        return _text(NOT_FOUND if one else NO_CONTENT)

    def rest():
        yield first
        yield from parts

    return OK, rest()


def _key(store: Store, method: str, key: str, body: str) -> Answer:
    if method == "GET":
        return _found(store.entries(None, key, key), True)
    value = body if method == "PUT" else None
    run(store, lambda t: Commit(t.put(key, value)), RETRIES)
    return _text(NO_CONTENT)


def _query(store: Store, text: str) -> Answer:
    s = dsl.parse(text)
    if isinstance(s, dsl.CreateIndex):
        try:
            store.create_index(s.spec)
        except IndexExists as e:
            return _text(NOT_MODIFIED if e.readable else BUILDING)
        except Busy:
            return _text(TOO_MANY)
        return _text(NO_CONTENT)
    if isinstance(s, dsl.DeleteIndex):
        try:
            store.delete_index(s.spec)
        except Busy:
            return _text(BAD_REQUEST)
        return _text(NO_CONTENT)
    if isinstance(s, dsl.Put):
        store.query(text)
        return _text(NO_CONTENT)
    return _found(store.query(text), isinstance(s, dsl.GetPK) and s.one)


def answer(store: Store, method: str, path: str, body: str = "") -> Answer:
    """The status and the parts of the text. Any error is a 500 with its text; transactions as guest code are not offered (501)."""
    try:
        if path.startswith("/key/") and method in ("GET", "PUT", "DELETE"):
            return _key(store, method, unquote(path[5:]), body)
        if (method, path) == ("POST", "/query"):
            return _query(store, body)
        if (method, path) == ("POST", "/wasm"):
            return _text(NOT_IMPLEMENTED, "pass a Python callable to tidewell.txn.run instead")
        return _text(NOT_FOUND)
    except Exception as e:  # noqa: BLE001
        return _text(ERROR, f"{type(e).__name__}: {e}")


def respond(store: Store, method: str, path: str, body: str = "") -> tuple[int, str]:
    """As ``answer``, with the text in one piece."""
    status, parts = answer(store, method, path, body)
    return status, "".join(parts)


def serve(store: Store, host: str = "127.0.0.1", port: int = 3000) -> ThreadingHTTPServer:
    """A server for the store; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _go(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            status, parts = answer(store, self.command, self.path, body)
            self.send_response(status)
            if status in (NO_CONTENT, NOT_MODIFIED, BUILDING):  # these have no body
                self.end_headers()
                return
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            for part in parts:
                data = part.encode()
                self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))
            self.wfile.write(b"0\r\n\r\n")

        do_GET = do_PUT = do_DELETE = do_POST = _go  # noqa: N815

        def log_message(self, form, *args):
            log.info(form, *args)

    return ThreadingHTTPServer((host, port), Handler)
