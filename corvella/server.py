"""A store over HTTP with the standard library; one request at a time, for small use."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer

from corvella import __version__
from corvella.errors import DeniedError, EmptyStoreError, StoreError
from corvella.sources.store import Store


def answer(store: Store, method: str, path: str, body: dict) -> tuple[int, dict]:
    """Status and JSON of one request."""
    try:
        match method, path.strip("/").split("/"):
            case "GET", ["health"]:
                return 200, {"status": "ok", "version": __version__}
            case "GET", ["api", "v1", "stats"]:
                return 200, store.stats().first().asDict()
            case "GET", ["api", "v1", "namespaces"]:
                return 200, {"namespaces": store.list_namespaces()}
            case "POST", ["api", "v1", "namespaces"]:
                store.create_namespace(body["name"])
                return 200, {"name": body["name"]}
            case "POST", ["api", "v1", "add"]:
                return 200, {"doc_id": store.add(body["text"], body.get("metadata"), body.get("namespace", "default"))}
            case "POST", ["api", "v1", "search"]:
                k = int(body.get("top_k", 10))
                if not 1 <= k <= 100:
                    return 400, {"error": "top_k must be within 1 and 100"}
                found = store.search(body["query"], k, float(body.get("alpha", 0.5)), body.get("namespace"), filters=body.get("filters"), rerank=bool(body.get("rerank")))
                rows = [r.asDict() for r in found.orderBy("place").collect()]
                return 200, {"results": rows, "count": len(rows)}
            case "DELETE", ["api", "v1", "docs", doc_id]:
                return (200, {"deleted": doc_id}) if store.delete(doc_id) else (404, {"error": "no such document"})
        return 404, {"error": "no such path"}
    except KeyError as e:
        return 400, {"error": f"{e} is missing"}
    except EmptyStoreError as e:
        return 404, {"error": str(e)}
    except DeniedError as e:
        return 403, {"error": str(e)}
    except (StoreError, ValueError) as e:
        return 400, {"error": str(e)}


def serve(store: Store, port: int = 8080, host: str = "127.0.0.1") -> HTTPServer:
    """A server that is not yet running; it listens on this machine only unless ``host`` says otherwise, and knows no users."""

    class Handler(BaseHTTPRequestHandler):
        def _run(self):
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, out = answer(store, self.command, self.path, json.loads(raw or b"{}"))
            except ValueError:
                status, out = 400, {"error": "the body is not JSON"}
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _run  # noqa: N815

    return HTTPServer((host, port), Handler)
