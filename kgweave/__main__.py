"""Command line: run, query, path, explain, serve, init."""

from __future__ import annotations

import argparse
import functools
import http.server
import json
import logging
import sys

from pyspark.sql import SparkSession

from kgweave import config, pipeline, tools
from kgweave.sinks import export, page, stores
from kgweave.sources import detect, graph_json


class _Handler(http.server.SimpleHTTPRequestHandler):
    """Files below one folder, by GET and OPTIONS only; the base class keeps paths inside the folder."""

    do_HEAD = do_POST = do_PUT = do_DELETE = lambda self: self.send_error(405)

    def do_OPTIONS(self) -> None:  # noqa: N802
        self.send_response(204)
        self.send_header("Allow", "GET, OPTIONS")
        self.end_headers()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("kgweave")
    sub = p.add_subparsers(dest="command", required=True)
    p.add_argument("--config")
    p.add_argument("--verbose", action="store_true")
    run = sub.add_parser("run", help="files to a stored graph")
    run.add_argument("root")
    run.add_argument("--out", default="kgweave-out")
    run.add_argument("--density", default="normal")
    run.add_argument("--gamma", type=float, default=1.0)
    run.add_argument("--no-cluster", action="store_true")
    run.add_argument("--page", action="store_true")
    for name, args in (("query", ("question",)), ("path", ("start", "end")), ("explain", ("node",))):
        q = sub.add_parser(name)
        for a in args:
            q.add_argument(a)
        q.add_argument("--out", default="kgweave-out")
    serve = sub.add_parser("serve", help="tools over standard input, or files over HTTP")
    serve.add_argument("--out", default="kgweave-out")
    serve.add_argument("--http", type=int)
    init = sub.add_parser("init", help="write a first settings file")
    init.add_argument("--file", default="kgweave.json")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, stream=sys.stderr, format="%(asctime)s %(levelname)s %(message)s")
    if a.command == "init":
        made = config.init_config(a.file)
        print(f"wrote {a.file}" if made else f"{a.file} exists", file=sys.stderr)
        return 0 if made else 1
    if a.command == "serve" and a.http is not None:
        http.server.ThreadingHTTPServer(("127.0.0.1", a.http), functools.partial(_Handler, directory=a.out)).serve_forever()
    spark = spark or SparkSession.builder.appName("kgweave").getOrCreate()
    if a.command == "run":
        settings = config.load_config(a.config)
        found = detect.scan(spark, a.root, {k: tuple(v) for k, v in settings["file_extensions"].items()})
        texts = detect.read_text(spark, a.root).join(found.select("path").distinct(), "path", "left_semi")
        done = pipeline.run(texts.where(~detect.in_ignored_dir(more=(a.out,)) & ~detect.sensitive()), a.density, a.gamma, not a.no_cluster)
        graph_json.write_tables(done.graph, done.communities, a.out)
        stores.write_manifest(texts, f"{a.out}/manifest")
        if a.page:
            with open(f"{a.out}/graph.html", "w") as f:
                f.write(page.html_page(done.graph, done.communities))
        with open(f"{a.out}/report.md", "w") as f:
            f.write(export.report(done.graph, done.communities))
        return 0
    graph, communities = graph_json.read_tables(spark, a.out)
    w = tools.Workspace(graph, communities, stores.stored_conversations(spark, a.out), a.out)
    if a.command == "serve":
        tools.serve(w)
        return 0
    try:
        args = {"query": lambda: {"question": a.question}, "path": lambda: {"start": a.start, "end": a.end}, "explain": lambda: {"node": a.node}}[a.command]()
        print(json.dumps(tools.TOOLS[a.command](w, args), indent=2, default=str))
        return 0
    except tools.ToolError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
