"""Stores whose ids come from keys, against stores written from texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.functions.stats import class_stats, pair_sizes, property_stats, with_classes
from graphloom.plans.parser import RDF_TYPE
from graphloom.sources.keyed import KeyedIds
from graphloom.sources.store import Store
from graphloom.sources.terms import KeyTerms

TERMS = KeyTerms("http://e/", {"a", "ab", "B"})


def test_ids_stand_in_the_order_of_texts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "ab", "B"]), rng.randrange(10 ** rng.randrange(1, 16))) for _ in range(500)] + [("a", k) for k in (0, 1, 10, 100, 10**15 - 1)]
    ids = KeyedIds("http://e/", {"a", "ab", "B"})
    got = spark.createDataFrame(rows, "kind string, key long").withColumn("id", ids.of_key(F.col("kind"), F.col("key"))).withColumn("text", ids.text(F.col("id"))).collect()
    assert all(r.text == f"http://e/{r.kind}/{r.key}" for r in got)
    assert [r.text for r in sorted(got, key=lambda r: r.id)] == sorted(r.text for r in got)


@pytest.fixture(scope="module")
def relations(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "ab"]), rng.randrange(200), rng.choice(["B", "a", None]), rng.randrange(40), rng.choice(["", "zz", "http://e/", "http://e/aa", "http", "é", "~"])) for _ in range(600)]
    df = spark.createDataFrame(rows + rows[:50], "k string, x long, j string, y long, t string")
    whole = lambda kind, key, text: F.struct(F.col(kind).alias("kind") if kind else F.lit(None).cast("string").alias("kind"), F.when(F.col(kind).isNotNull(), F.col(key)).alias("key") if kind else F.lit(None).cast("bigint").alias("key"), text.alias("text"))
    none = F.lit(None).cast("string")
    s = whole("k", "x", none).alias("s")
    return {
        "http://e/links": df.where("j is not null").select(s, whole("j", "y", none).alias("o")),
        "http://e/mixed": df.select(s, whole("j", "y", F.when(F.col("j").isNull(), F.col("t"))).alias("o")),
        "http://e/says": df.select(s, whole(None, None, F.col("t")).alias("o")),
        RDF_TYPE: df.select(s, whole(None, None, F.concat(F.lit("class"), (F.col("x") % 3).cast("string"))).alias("o")),
    }


def texts(relations):
    parts = [df.select(TERMS.text(F.col("s")).alias("s"), F.lit(p).alias("p"), TERMS.text(F.col("o")).alias("o")) for p, df in relations.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def same(a, b):
    return Counter(map(tuple, a.select(sorted(a.columns)).collect())) == Counter(map(tuple, b.select(sorted(b.columns)).collect()))


@pytest.mark.parametrize("inverse", [True, False])
def test_a_store_of_keys_is_the_store_of_its_texts(spark, relations, tmp_path, inverse):
    graph = texts(relations).distinct()
    made = Store.write_keyed(spark, relations, TERMS, f"file://{tmp_path}/k", inverse)
    # no dictionary of resources is joined, so none of their texts is shuffled
    assert made.keyed is not None
    assert same(made.texts(), graph) and same(made.decode(made.triples.select("s", "o")), graph.select("s", "o"))
    terms = made.terms.orderBy("id").collect()
    assert [r.term for r in terms] == sorted({t for r in graph.collect() for t in (r.s, r.o)}, key=str.encode)
    other = Store.write(spark, graph, f"file://{tmp_path}/t", inverse)
    q = 'SELECT ?x ?y ?z WHERE { ?x <http://e/mixed> ?y . ?x <http://e/says> ?z FILTER(?y > "http://e/a/2" && ?z < ?y) }'
    assert same(Engine(made).query(q, extended=True), Engine(other).query(q, extended=True))
    assert made.with_texts(spark.createDataFrame([(None,), (terms[0].id,)], "c long"), {"c": "t"}).where("t is null").count() == 1
    for store in (made, other):
        code = {str(r.pid): r.uri for r in spark.read.parquet(f"{store.path}/properties").collect()} | {str(-1 - r.id): "class:" + r.term for r in store.terms.collect()}
        read = lambda t, s=store: spark.read.parquet(f"{s.path}/statistics/{t}")
        assert {(code[str(r.p1)], code[str(r.p2)], r.kind, r.n) for r in read("pairs").collect()} == {tuple(r) for r in pair_sizes(with_classes(graph, RDF_TYPE)).select("p1", "p2", "kind", "n").collect()}
        term = {r.id: r.term for r in store.terms.collect()}
        assert {(code[str(r.p)], r.n, r.distinct_s, term[r.min_s], term[r.max_s], r.distinct_o, term[r.min_o], term[r.max_o]) for r in read("properties").collect()} == {tuple(r) for r in property_stats(graph).collect()}
        assert {(term[r["class"]], r.n, term[r.min_s], term[r.max_s]) for r in read("classes").collect()} == {tuple(r) for r in class_stats(graph.where(F.col("p") == RDF_TYPE)).collect()}


def test_terms_that_fit_no_key_are_written_as_text(spark, relations, tmp_path):
    odd = spark.createDataFrame([("a", -5, "http://e/a/007"), ("a", 10**15, "x")], "k string, x long, t string")
    one = lambda o: {**relations, "http://e/odd": odd.select(F.struct(F.col("k").alias("kind"), F.col("x").alias("key"), F.lit(None).cast("string").alias("text")).alias("s"), TERMS.literal(F.col("t")).alias("o")).where(o)}
    for i, o in enumerate(("s.key < 0", "s.key > 0")):
        made = Store.write_keyed(spark, one(o), TERMS, f"file://{tmp_path}/o{i}")
        assert made.keyed is None and same(made.texts(), texts(one(o)).distinct())
