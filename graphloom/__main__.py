"""python -m graphloom: write a store from N-Triples, and run queries over it.

    python -m graphloom load graph.nt store/
    python -m graphloom query store/ 'SELECT ?x WHERE { ?x <http://e/p> ?y }' --show
    python -m graphloom batch store/ queries.txt
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from graphloom import settings


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="graphloom", description="SPARQL queries over a store of triples.")
    top.add_argument("--settings", help="a file of key = value lines (default: $GRAPHLOOM_SETTINGS)")
    top.add_argument("--master", help="Spark master, where spark-submit sets none")
    jobs = top.add_subparsers(dest="job", required=True)
    load = jobs.add_parser("load", help="write a store from N-Triples")
    load.add_argument("triples"), load.add_argument("store")
    load.add_argument("--no-inverse", action="store_true", help="leave out the copy sorted by object")
    load.add_argument("--no-statistics", action="store_true")
    query = jobs.add_parser("query", help="run one query")
    query.add_argument("store"), query.add_argument("text")
    query.add_argument("--show", action="store_true", help="print the rows; else only their number")
    query.add_argument("--rows", type=int, default=1000, help="print so many rows at most")
    query.add_argument("--explain", action="store_true")
    batch = jobs.add_parser("batch", help="time the queries of a file, one a line")
    batch.add_argument("store"), batch.add_argument("file")
    batch.add_argument("--runs", type=int)
    for x in (query, batch):
        x.add_argument("--extended", action="store_true")
        x.add_argument("--cross", action="store_true", help="allow products")
        x.add_argument("--ids", action="store_true", help="do not look up terms")
        x.add_argument("--in-memory", action="store_true", help="load the triples first")
        x.add_argument("--dictionary-in-memory", action="store_true", help="and the dictionary")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    from pyspark.sql import SparkSession

    from graphloom.engine import Engine
    from graphloom.sources.store import Store
    from graphloom.sources.triples import read_ntriples, read_queries

    builder = SparkSession.builder.appName("graphloom")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    s = settings.load(a.settings)
    started = time.time()
    if a.job == "load":
        store = Store.write(spark, read_ntriples(spark, a.triples), a.store, not a.no_inverse, s.statistics and not a.no_statistics, s.class_limit)
        print(f"{len(store.properties)} properties written in {time.time() - started:.1f} s")
        return 0
    store = Store(spark, a.store)
    if a.in_memory or a.dictionary_in_memory:
        store.load(a.dictionary_in_memory)
    s = s.but(**{k: True for k in ("extended", "cross") if getattr(a, k)}, **({"decode": False} if a.ids else {}))
    engine = Engine(store, settings=s)
    if a.job == "batch":
        print(json.dumps(engine.batch(read_queries(a.file), a.runs)))
        return 0
    if a.explain:
        print(engine.explain(a.text))
    if a.show:
        engine.show(a.text, a.rows)
    print(f"{engine.query(a.text, count_only=True).first()['n']} rows in {time.time() - started:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
