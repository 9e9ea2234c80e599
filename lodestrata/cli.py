"""Command line: ``python -m lodestrata.cli ROOT COMMAND ...``"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .config import EXPECTED_TOTALS
from .functions import text as T
from .operators import golden, graph
from .plans import gate, status
from .plans.ingest import Corpus, build_index, ingest, ingest_dump, to_rows, write
from .plans.retrieval import Engine
from .session import session, stored
from .sources import dumps, files, packages


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata")
    p.add_argument("root", help="folder of the corpus")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest", help="ingest the new and changed files of a folder")
    c.add_argument("folder")
    c.add_argument("--pattern")
    c.add_argument("--flat", action="store_true", help="don't enter subfolders")
    c = sub.add_parser("dump", help="show or store the records of an entity dump")
    c.add_argument("path")
    c.add_argument("--store", action="store_true", help="write them to the corpus")
    c = sub.add_parser("search", help="search one or all collections")
    c.add_argument("text")
    c.add_argument("-k", type=int, default=5)
    c.add_argument("--collection", action="append")
    c.add_argument("--filter", type=json.loads, help="a filter as JSON")
    c.add_argument("--all", action="store_true", help="all collections, with quotas")
    c.add_argument("--probes", type=int, help="read only so many cells of the index")
    c = sub.add_parser("index", help="build the vector index")
    c.add_argument("--cells", type=int)
    c = sub.add_parser("get", help="the row with an id")
    c.add_argument("id")
    sub.add_parser("collections", help="list collections")
    c = sub.add_parser("status", help="coverage, alerts, quarantine and checks")
    c.add_argument("--expected", type=json.loads, default={}, help="expected rows by collection, as JSON")
    c.add_argument("--form", choices=["text", "markdown", "json"], default="text")
    c = sub.add_parser("evaluate", help="recall over golden questions")
    c.add_argument("golden", help="JSON file of questions")
    c.add_argument("-k", type=int)
    c = sub.add_parser("promote", help="publish to production if the gate passes")
    c.add_argument("production")
    c.add_argument("golden")
    c.add_argument("--recall-threshold", type=float)
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--force", action="store_true")
    sub.add_parser("rollback", help="go back to the snapshot before")
    c = sub.add_parser("packages", help="ingest the numeric package folders below a folder")
    c.add_argument("folder")
    c = sub.add_parser("coverage", help="rows against expected rows per collection")
    c.add_argument("--expected", type=json.loads, default={}, help="expected rows by collection, as JSON")
    c = sub.add_parser("crawl", help="pages reached from one, over stored pages (url, html)")
    c.add_argument("pages")
    c.add_argument("seed")
    c.add_argument("--depth", type=int, default=3)
    c.add_argument("--per-page", type=int, default=20)
    c.add_argument("--pages-limit", type=int, default=1000)
    c = sub.add_parser("regression", help="recall against that of another corpus")
    c.add_argument("baseline")
    c.add_argument("golden")
    c.add_argument("-k", type=int)
    return p


def show(df) -> None:
    for line in df.toJSON().collect():
        print(line)


def questions(spark, path: str):
    return spark.read.schema("id string, question string, expected_ids array<string>, filter map<string,string>").option("multiLine", "true").json(path)


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    spark = session()
    corpus = Corpus(spark, a.root)
    engine = Engine(corpus)
    if a.command == "ingest":
        print(json.dumps(ingest(corpus, a.folder, a.pattern, not a.flat)))
    elif a.command == "dump":
        if a.store:
            print(json.dumps(ingest_dump(corpus, a.path)))
        else:
            show(dumps.chunks(dumps.normalise(dumps.read(spark, a.path))).select("collection", "chunk_id", "name", "class", "completeness"))
    elif a.command == "packages":
        rows, result = packages.ingest(files.scan(spark, a.folder))
        write(corpus, to_rows(rows, corpus.settings.default_version, corpus.embed))
        show(result.orderBy("package"))
    elif a.command == "coverage":
        show(status.coverage(engine, a.expected or EXPECTED_TOTALS).orderBy("collection"))
    elif a.command == "crawl":
        pages = spark.read.parquet(a.pages).select(F.concat(T.host(F.col("url")), T.path(F.col("url"))).alias("src"), "url", "html")
        links = pages.select("src", F.posexplode(T.html_links(F.col("url"), F.col("html"))).alias("pos", "link")).select("src", "pos", F.concat(T.host(F.col("link")), T.path(F.col("link"))).alias("dst"))
        seed = spark.range(1).select(F.concat(T.host(F.lit(a.seed)), T.path(F.lit(a.seed))).alias("node"))
        show(graph.budget(graph.crawl(seed, graph.same_host(links), a.depth, a.per_page), a.pages_limit))
    elif a.command == "regression":
        now, _ = gate.evaluate(engine, questions(spark, a.golden), a.k)
        before, _ = gate.evaluate(Engine(Corpus(spark, a.baseline)), questions(spark, a.golden), a.k)
        told = stored(golden.compare(now, before, "id"))
        show(told.orderBy("id"))
        return int(told.filter("status = 'regression'").limit(1).count() > 0)
    elif a.command == "search":
        show(engine.search_all(a.text, a.k, a.filter) if a.all else engine.search(a.text, a.k, a.filter, a.collection, probes=a.probes))
    elif a.command == "index":
        print(json.dumps(build_index(corpus, a.cells)))
    elif a.command == "get":
        show(engine.get(a.id).drop("embedding"))
    elif a.command == "collections":
        show(engine.collections().orderBy("collection"))
    elif a.command == "status":
        print(status.report(engine, a.expected or {r.collection: r.n for r in engine.collections().collect()}, a.form))
    elif a.command == "evaluate":
        per, verdict = gate.evaluate(engine, questions(spark, a.golden), a.k)
        show(per.orderBy("id"))
        show(verdict)
        return int(not verdict.first().passed)
    elif a.command == "promote":
        out = gate.promote(corpus, Corpus(spark, a.production), questions(spark, a.golden), a.recall_threshold, a.dry_run, a.force)
        print(json.dumps(out))
        return int(not (out["passed"] or a.force))
    elif a.command == "rollback":
        print(gate.rollback(corpus))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
