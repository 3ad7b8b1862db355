"""The library's calls by name, for every transport: command line, HTTP, and tool calls over standard input and output."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import DataFrame

from quillgrid.api import Library, connect
from quillgrid.errors import BadRequest, LibraryError, NotFound
from quillgrid.session import build_session


def rows_of(df: DataFrame) -> list[dict]:
    """A page of rows; every call here is limited by its arguments or belongs to one paper."""
    return [json.loads(r.j) for r in df.selectExpr("to_json(struct(*)) AS j").collect()]


def _one(df: DataFrame, what: str) -> dict:
    rows = rows_of(df.limit(1))
    if not rows:
        raise NotFound(what)
    return rows[0]


def _whole(value, low: int, high: int, name: str) -> int:
    try:
        n = int(value)
    except (TypeError, ValueError):
        raise BadRequest(f"{name} must be a number") from None
    if not low <= n <= high:
        raise BadRequest(f"{name} must be between {low} and {high}")
    return n


Call = Callable[[Library, dict], object]
CALLS: dict[str, tuple[Call, tuple[str, ...], str]] = {
    "list": (lambda l, a: rows_of(l.list_papers(a.get("query"), _whole(a.get("limit", 50), 1, 1000, "limit"), int(a.get("offset", 0)))), (), "papers, newest first"),
    "find": (lambda l, a: rows_of(l.find_papers(a["query"], _whole(a.get("limit", 50), 1, 1000, "limit"), int(a.get("offset", 0)))), ("query",), "papers by title, abstract or author"),
    "paper": (lambda l, a: _one(l.get_paper(l.key_of(a.get("key"), a.get("url"))), "paper"), (), "one paper by key or url"),
    "outline": (lambda l, a: rows_of(l.outline(a["key"])), ("key",), "the sections of a paper"),
    "read": (lambda l, a: _one(l.read(a["key"], a.get("section"), int(a.get("offset", 0)), int(a.get("max_chars", 0))), "text"), ("key",), "a window of a text"),
    "grep": (lambda l, a: rows_of(l.grep(a["query"], a.get("key"), _whole(a.get("limit", 20), 1, 100, "limit"))), ("query",), "full-text search"),
    "figure": (lambda l, a: _one(l.get_figure(a["key"], a["figure"]), "figure"), ("key", "figure"), "a figure by id, label or place"),
    "figure_image": (lambda l, a: l.figure_payload(a["key"], a["figure"]), ("key", "figure"), "a figure's images"),
    "table": (lambda l, a: _one(l.get_table(a["key"], a["table"]), "table"), ("key", "table"), "a table by id, label or place"),
    "annotate": (lambda l, a: l.annotate(a["key"], a.get("quote", ""), a["note"]) or {"ok": True}, ("key", "note"), "add a note"),
    "annotations": (lambda l, a: rows_of(l.annotations(a["key"])), ("key",), "the notes of a paper"),
    "stats": (lambda l, a: {k: rows_of(v) for k, v in l.stats().items()}, (), "counts"),
    "export": (lambda l, a: l.bibliography(a.get("keys")), (), "BibTeX"),
    "reindex": (lambda l, a: l.reindex(a["captures"], a.get("keys")), ("captures",), "index bundles"),
}


def call(lib: Library, name: str, arguments: dict) -> object:
    if name not in CALLS:
        raise NotFound(f"call {name}", "known: " + ", ".join(sorted(CALLS)))
    run, needed, _ = CALLS[name]
    missing = [n for n in needed if not arguments.get(n)]
    if missing:
        raise BadRequest(f"{name} needs {', '.join(missing)}")
    return run(lib, arguments)


def handle_line(lib: Library, line: str) -> dict | None:
    """The answer to one JSON-RPC message; None for a notification."""
    try:
        message = json.loads(line)
        method, name = message.get("method"), message.get("id")
    except (ValueError, AttributeError):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
    if name is None:
        return None
    answer: dict = {"jsonrpc": "2.0", "id": name}
    if method == "initialize":
        return answer | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quillgrid", "version": "1"}}}
    if method == "tools/list":
        schema = lambda needed: {"type": "object", "required": list(needed), "properties": {n: {"type": "string"} for n in needed}}
        return answer | {"result": {"tools": [{"name": n, "description": about, "inputSchema": schema(needed)} for n, (_, needed, about) in CALLS.items()]}}
    if method == "tools/call":
        params = message.get("params") or {}
        try:
            got = call(lib, params.get("name", ""), params.get("arguments") or {})
            return answer | {"result": {"content": [{"type": "text", "text": got if isinstance(got, str) else json.dumps(got, default=str)}]}}
        except LibraryError as e:
            return answer | {"result": {"isError": True, "content": [{"type": "text", "text": str(e)}]}}
    return answer | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def handler(lib: Library) -> type[BaseHTTPRequestHandler]:
    """``/api/v1/<call>?argument=value`` by GET, or by POST with a JSON object."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, arguments: dict) -> None:
            name = unquote(urlparse(self.path).path).removeprefix("/api/v1/").strip("/")
            try:
                status, body = 200, call(lib, name, arguments)
            except LibraryError as e:
                status, body = {"not_found": 404, "bad_request": 400, "locked": 409}.get(e.code, 500), e.as_dict()
            data = (body if isinstance(body, str) else json.dumps(body, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer({k: v[-1] for k, v in parse_qs(urlparse(self.path).query).items()})

        def do_POST(self) -> None:
            try:
                given = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                given = {}
            self._answer(given if isinstance(given, dict) else {})

        def log_message(self, *_: object) -> None:
            return

    return Handler


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillgrid", description="A library of scholarly documents.")
    parser.add_argument("folder", help="folder of the library's Parquet tables")
    parser.add_argument("call", choices=[*CALLS, "serve", "tools"])
    parser.add_argument("arguments", nargs="*", help="name=value")
    parser.add_argument("--port", type=int, default=8000)
    given = parser.parse_args(argv)
    lib = connect(build_session(), given.folder)
    if given.call == "serve":
        ThreadingHTTPServer(("127.0.0.1", given.port), handler(lib)).serve_forever()
    if given.call == "tools":
        for line in sys.stdin:
            if (answer := handle_line(lib, line)) is not None:
                print(json.dumps(answer, default=str), flush=True)
        return 0
    try:
        got = call(lib, given.call, dict(a.partition("=")[::2] for a in given.arguments))
    except LibraryError as e:
        print(str(e), file=sys.stderr)
        return 1
    print(got if isinstance(got, str) else json.dumps(got, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
