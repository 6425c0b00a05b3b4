"""Command line: ``python -m corvella.cli STORE ingest|search|stats|export|serve``."""

from __future__ import annotations

import argparse
import json
import sys

from corvella.session import build_session
from corvella.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvella")
    p.add_argument("store")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest")
    c.add_argument("path")
    c.add_argument("--namespace", default="default")
    c.add_argument("--chunk-size", type=int, default=1000)
    c.add_argument("--chunk-overlap", type=int, default=200)
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--top-k", type=int, default=5)
    c.add_argument("--alpha", type=float, default=0.5)
    c.add_argument("--namespace")
    c.add_argument("--filters", type=json.loads, default=None)
    c.add_argument("--rerank", action="store_true")
    sub.add_parser("stats")
    c = sub.add_parser("export")
    c.add_argument("target")
    c.add_argument("--namespace")
    c = sub.add_parser("serve")
    c.add_argument("--port", type=int, default=8080)
    return p


def main(args: list[str] | None = None, spark=None, out=sys.stdout) -> None:
    a = parser().parse_args(args)
    spark = spark or build_session("corvella", a.master)
    with Store(spark, a.store) as s:
        if a.command == "ingest":
            print(s.ingest(a.path, a.namespace, a.chunk_size, a.chunk_overlap), "chunks", file=out)
        elif a.command == "search":
            for r in s.search(a.query, a.top_k, a.alpha, a.namespace, filters=a.filters, rerank=a.rerank).orderBy("place").collect():
                print(f"{r.place}. {r.score:.4f} [{r.namespace}] {r.text[:500]}", file=out)
        elif a.command == "stats":
            print(json.dumps(s.stats().first().asDict(), indent=2), file=out)
        elif a.command == "export":
            if a.target == "-":
                s.export_document(out, a.namespace)
            else:
                print(s.export(a.target, a.namespace), "documents", file=out)
        else:
            from corvella.server import serve

            serve(s, a.port).serve_forever()


if __name__ == "__main__":
    main()
