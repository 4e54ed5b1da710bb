"""The tools over HTTP, as a Model Context Protocol server: JSON-RPC by POST, and server-sent event streams.

GET /sse opens a session: its first event names where to post, and replies to what is posted there come on
that stream alone. What is posted to / is answered in the response.
"""

from __future__ import annotations

import inspect
import json
import queue
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from urllib.parse import parse_qs, urlparse

from lorekeep.tools import TOOLS, Tools

# fixed values: where clients expect the endpoint, and versions of the protocol, the newest last
PORT = 3001
VERSIONS = ("2024-11-05", "2025-03-26", "2025-06-18")


def listed() -> list[dict]:
    """Name, description and arguments of every tool."""
    kinds = {"int": "integer", "bool": "boolean", "str": "string"}
    out = []
    for name, (about, method) in TOOLS.items():
        args = [p for p in inspect.signature(method).parameters.values() if p.name != "self"]
        fields = {p.name: {"type": kinds[str(p.annotation).split(" ")[0]]} for p in args}
        out.append({"name": name, "description": about, "inputSchema": {"type": "object", "properties": fields, "required": [p.name for p in args if p.default is p.empty]}})
    return out


def reply(tools: Tools, request: dict) -> dict | None:
    """The JSON-RPC answer to a request; None to a notification, which has no id."""
    if not isinstance(request, dict) or "method" not in request:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
    method, p = request["method"], request.get("params") or {}
    if "id" not in request:
        return None
    head = {"jsonrpc": "2.0", "id": request["id"]}
    try:
        if method == "initialize":
            asked = p.get("protocolVersion")
            return head | {"result": {"protocolVersion": asked if asked in VERSIONS else VERSIONS[-1], "capabilities": {"tools": {}}, "serverInfo": {"name": "lorekeep", "version": "1.0.0"}}}
        if method == "ping":
            return head | {"result": {}}
        if method == "tools/list":
            return head | {"result": {"tools": listed()}}
        if method == "tools/call":
            text = tools.call(p["name"], **p.get("arguments", {}))
            return head | {"result": {"content": [{"type": "text", "text": text}]}}
        return head | {"error": {"code": -32601, "message": "no such method"}}
    except (KeyError, TypeError) as e:
        return head | {"error": {"code": -32602, "message": str(e)}}
    except ValueError as e:
        return head | {"error": {"code": -32000, "message": str(e)}}
    except Exception as e:  # noqa: BLE001 - a client gets an answer whatever happens
        return head | {"error": {"code": -32603, "message": f"{type(e).__name__}: {e}"[:500]}}


def server(tools: Tools, port: int = PORT) -> ThreadingHTTPServer:
    """Not started: call serve_forever()."""
    sessions: dict[str, queue.Queue] = {}

    class Handler(BaseHTTPRequestHandler):
        def respond(self, status: int, body: bytes = b""):
            self.send_response(status)
            if body:
                self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                answer = reply(tools, json.loads(body))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            data = json.dumps(answer, ensure_ascii=False).encode() if answer else b""
            session = parse_qs(urlparse(self.path).query).get("sessionId", [None])[0]
            if session is None:
                self.respond(200 if data else 202, data)
            elif session not in sessions:
                self.respond(404)
            else:
                if data:
                    sessions[session].put(data)
                self.respond(202)

        def do_GET(self):
            if urlparse(self.path).path != "/sse":
                self.respond(404)
                return
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            session = uuid.uuid4().hex
            replies = sessions[session] = queue.Queue()
            try:
                self.wfile.write(f"event: endpoint\ndata: /message?sessionId={session}\n\n".encode())
                while True:
                    try:
                        self.wfile.write(b"event: message\ndata: " + replies.get(timeout=15) + b"\n\n")
                    except queue.Empty:
                        self.wfile.write(b": still here\n\n")  # fails once the client is gone
                    self.wfile.flush()
            except OSError:
                del sessions[session]

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
