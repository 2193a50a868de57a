"""Parser, planner, store, statistics and engine, against brute force over small graphs."""

import itertools
import json
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import settings
from graphloom.__main__ import main
from graphloom.engine import Engine
from graphloom.errors import ParseError, UnknownProperty, UnsupportedQuery
from graphloom.functions import stats as S
from graphloom.operators.range_join import range_join
from graphloom.plans.algebra import Const, Group, Pattern, Var
from graphloom.plans.order import base, best_order, connected
from graphloom.plans.parser import RDF_TYPE, parse, unescape
from graphloom.queries import CLOSED, ORACLES, QUERIES, store
from graphloom.settings import Settings
from graphloom.sources.store import Store
from graphloom.sources.triples import PREFIXES, TERMS, by_property, mapped_tables, read_ntriples, read_queries

SF = "/root/testdata/sf0.001"
P = "PREFIX e: <http://e/> "


def brute(triples, patterns, names):
    rows = [{}]
    for s, p, o in patterns:
        new = []
        for r in rows:
            for a, q, b in triples:
                if q != p:
                    continue
                t = dict(r)
                if all((t.setdefault(x[1:], v) if x[0] == "?" else x) == v for x, v in ((s, a), (o, b))):
                    new.append(t)
        rows = new
    return Counter(tuple(r[n] for n in names) for r in rows)


@pytest.fixture(scope="module")
def triples():
    rng = random.Random(5)
    return sorted({(f"n{rng.randrange(8)}", f"http://e/{rng.choice('abc')}", f"n{rng.randrange(8)}") for _ in range(60)})


@pytest.fixture(scope="module")
def graph(spark, triples):
    return spark.createDataFrame(triples * 2, "s string, p string, o string")


@pytest.fixture(scope="module")
def stored(spark, graph, tmp_path_factory):
    return Store.write(spark, graph, f"file://{tmp_path_factory.mktemp('store')}/g")


def text(patterns, names):
    term = lambda x: x if x[0] == "?" else f'"{x}"'
    return P + f"SELECT {' '.join('?' + n for n in names)} WHERE {{ " + " . ".join(f"{term(s)} <{p}> {term(o)}" for s, p, o in patterns) + " }"


def test_random_patterns_in_any_order(spark, graph, triples, stored):
    rng = random.Random(1)
    plain, coded = Engine(by_property(graph)), Engine(stored)
    for _ in range(4):
        patterns, names = [("?v0", f"http://e/{rng.choice('abc')}", "?v1")], ["v0", "v1"]
        for i in range(2, 4):
            old = "?" + rng.choice(names)
            new = rng.choice([f"?v{i}", "n3"])
            patterns.append((old, f"http://e/{rng.choice('abc')}", new) if rng.random() < 0.5 else (new, f"http://e/{rng.choice('abc')}", old))
            names += [new[1:]] if new[0] == "?" else []
        want = brute(triples, patterns, names)
        for order in list(itertools.permutations(patterns))[::3]:
            assert Counter(map(tuple, plain.query(text(order, names)).collect())) == want
        assert Counter(map(tuple, coded.query(text(patterns, names)).collect())) == want


def test_store(spark, stored, triples):
    assert {(r.s, r.o) for r in stored.decode(stored.relation(stored.property_id("http://e/a"))).collect()} == {(s, o) for s, p, o in triples if p == "http://e/a"}
    assert stored.encode(["n1", "absent"])["absent"] is None
    assert stored.load(True).register()[0] == "dictionary" and "InMemoryTableScan" in plan(stored.relation(0))
    assert "InMemoryTableScan" not in plan(stored.unload().relation(0))
    assert spark.table("invprop0").columns == ["o", "s"]
    e = Engine(stored)
    assert e.query(P + 'SELECT ?x WHERE { ?x e:a "absent" }').count() == 0
    ids = e.query(P + "SELECT ?x ?y WHERE { ?x e:a ?y }", decode=False)
    assert ids.dtypes == [("x", "bigint"), ("y", "bigint")]
    assert e.query(P + "SELECT ?x ?y WHERE { ?x e:a ?y }", count_only=True).first().n == sum(p == "http://e/a" for _, p, _ in triples)


@pytest.mark.parametrize(
    "query, error",
    [
        ("SELECT ?x WHERE { ?x ?p ?y }", UnsupportedQuery),
        ("SELECT ?x WHERE { ?x e:a ?x }", UnsupportedQuery),
        ("SELECT ?x WHERE { ?x e:none ?y }", UnknownProperty),
        ("SELECT ?x WHERE { ?x e:a ?y FILTER(?x = ?y) }", UnsupportedQuery),
        ("SELECT ?x WHERE { ?x e:a ?y OPTIONAL { ?x e:b ?z } }", UnsupportedQuery),
        ("SELECT ?x WHERE { { ?x e:a ?y } UNION { ?x e:b ?y } }", UnsupportedQuery),
        ("SELECT ?x WHERE { ?x e:a* ?y }", UnsupportedQuery),
        ("SELECT ?x WHERE { ?x e:a ?y MINUS { ?x e:b ?y } }", UnsupportedQuery),
        ("ASK { ?x e:a ?y }", UnsupportedQuery),
        ("CONSTRUCT { ?x e:a ?y } WHERE { ?x e:a ?y }", UnsupportedQuery),
        ("SELECT DISTINCT ?x WHERE { ?x e:a ?y }", UnsupportedQuery),
        ("SELECT ?x WHERE { ?x e:a ?y } LIMIT 3", UnsupportedQuery),
        ("SELECT ?a WHERE { ?a e:a ?x . ?p e:b ?y }", UnsupportedQuery),
        ("SELECT ?q WHERE { ?x e:a ?y }", UnsupportedQuery),
        ("SELECT ?x { ?x f:a ?y }", ParseError),
        ("SELECT ?x WHERE { ?x e:a ?y", ParseError),
        ("SELECT WHERE { ?x e:a ?y }", ParseError),
    ],
)
def test_errors(graph, query, error):
    with pytest.raises(error):
        Engine(by_property(graph, ["http://e/a", "http://e/b"])).query(P + query)


def test_parser_forms():
    q = parse(P + '# c\nSELECT * { ?x a e:T ; e:p "a\\"b"@en , "5"^^<http://t> . ?x e:q/^e:r ?z . _:b e:p 5 }')
    w = q.where.patterns
    assert [p.p for p in w[:3]] == [RDF_TYPE, "http://e/p", "http://e/p"] and w[1].o == Const('a"b') and w[2].o == Const("5")
    assert w[3].o == w[4].o and w[4].s == Var("z") and w[5].o == Const("5")


def test_statistics(spark, graph, triples, tmp_path):
    got = {(r.p1, r.p2, r.kind): r.n for r in S.pair_sizes(graph.distinct()).collect()}
    for p1, p2, kind in itertools.product({t[1] for t in triples}, {t[1] for t in triples}, ("SS", "SO", "OS", "OO")):
        side = {"S": 0, "O": 2}
        n = sum(a[side[kind[0]]] == b[side[kind[1]]] for a in triples if a[1] == p1 for b in triples if b[1] == p2)
        assert got.get((p1, p2, kind), 0) == n
    stats = S.collect_stats(graph.distinct(), RDF_TYPE)
    assert stats.of("http://e/a").count == sum(t[1] == "http://e/a" for t in triples)
    f = f"file://{tmp_path}/stats.json"
    S.save(spark, stats, f, "m")
    assert S.load(spark, f, "m") == stats and S.load(spark, f, "other") is None and S.load(spark, f"file://{tmp_path}/none") is None
    assert S.merge(S.Stats({"x": S.Property(1, 1, 1)}), stats).of("http://e/a") == stats.of("http://e/a")
    assert S.fingerprint(graph.distinct()) == S.fingerprint(graph.distinct().repartition(3)) != S.fingerprint(graph)


def test_histogram():
    h = S.Histogram(0, 100, 2, 50)
    assert h.rows == 100 and h.equal(5).rows == 2 and h.equal(500).rows == 0
    assert h.less(50).rows == 50 and h.greater(75).rows == 25 and h.not_equal(5).rows == 98
    assert h.join(S.Histogram(50, 150, 1, 10)).rows == 2 * 1 * 5
    assert 0 < h.range_join_rows(h) < h.rows * h.rows


def test_order_prefers_small_intermediates():
    stats = S.Stats({"big": S.Property(1e6, 1e3, 1e3), "mid": S.Property(1e4, 1e4, 10), "one": S.Property(1e4, 1e4, 1e4)}, {})
    patterns = [Pattern(Var("a"), "big", Var("b")), Pattern(Var("b"), "mid", Var("c")), Pattern(Var("c"), "one", Const("k"))]
    order, cost = best_order(patterns, stats)
    assert order[-1] == 0 and connected(patterns) and cost > 0
    assert not connected([patterns[0], Pattern(Var("x"), "mid", Var("y"))])
    long = [Pattern(Var(f"v{i}"), "mid", Var(f"v{i + 1}")) for i in range(15)]
    assert sorted(best_order(long, stats)[0]) == list(range(15))


def test_many_classes_keep_their_counts(spark):
    rows = [(f"x{i}", RDF_TYPE, f"c{i % 1100}") for i in range(2200)] + [("x1", "p", "x2")]
    stats = S.collect_stats(spark.createDataFrame(rows, "s string, p string, o string"), RDF_TYPE)
    assert len(stats.classes) == 1100 and all(n == 2 for n, _, _ in stats.classes.values())
    assert stats.typed and not stats.paired and not any(S.CLASS in a for a, _, _ in stats.pairs)


def test_sources(spark, tmp_path):
    f = tmp_path / "a.nt"
    odd = r"a\\nb\nc\tA\U0001F600\"\\\\u0041\b\f"
    f.write_text('<http://a> <http://p> <http://b> .\n# c\n<http://a> <http://p> "x\\"y"@en .\n<http://a> <http://p> <http://b> .\n' + f'<http://\\u0061> <http://q> "{odd}" .\n')
    want = {("http://a", "http://p", "http://b"), ("http://a", "http://p", 'x"y'), ("http://a", "http://q", 'a\\nb\nc\tA\U0001f600"\\\\u0041\b\f')}
    assert {tuple(r) for r in read_ntriples(spark, f"file://{f}").collect()} == want
    assert unescape(odd) == 'a\\nb\nc\tA\U0001f600"\\\\u0041\b\f'
    f.write_text("_:b <http://p> <http://b> .\n")
    with pytest.raises(Exception, match="not a triple"):
        read_ntriples(spark, f"file://{f}").collect()
    q = tmp_path / "q.txt"
    q.write_text("short\nSELECT ?x WHERE { ?x <http://e/a> ?y }\n")
    assert len(read_queries(str(q))) == 1


def test_comparisons_are_no_iris():
    q = parse(P + "SELECT ?y { ?x<http://e/a>?y FILTER(?y<?z&&?z>?y || (?y)<=3 && ?y = <http://e/x>) }", True)
    assert q.where.patterns[0].p == "http://e/a"
    either = q.where.filters[0]
    assert either.op == "||" and [e.op for e in either.args[0].args] == ["<", ">"] and either.args[1].args[0].op == "<="
    assert either.args[1].args[1].args[1] == Const("http://e/x")


def evaluate(g, triples):
    """The solutions of a group, by its definition: variables without a value are absent."""
    agree = lambda a, b: all(a[k] == b[k] for k in a.keys() & b.keys())
    out = [{}]
    for p in g.patterns:
        new = []
        for r in out:
            for s, q, o in triples:
                if q == p.p:
                    t = dict(r)
                    if all((t.setdefault(x.name, v) if isinstance(x, Var) else x.text) == v for x, v in ((p.s, s), (p.o, o))):
                        new.append(t)
        out = new
    for branches in g.unions:
        rows = [r for b in branches for r in evaluate(b, triples)]
        out = [a | b for a in out for b in rows if agree(a, b)]
    for o in g.optionals:
        rows = evaluate(Group(o.patterns, [], o.optionals, o.unions), triples)
        new = []
        for a in out:
            held = [a | b for b in rows if agree(a, b) and all(true(f, a | b) for f in o.filters)]
            new += held or [a]
        out = new
    return [r for r in out if all(true(f, r) for f in g.filters)]


def true(e, row):
    """Whether an expression is true of a row; unknown is not."""
    return value(e, row) is True


def value(e, row):
    if isinstance(e, Var):
        return row.get(e.name)
    if isinstance(e, Const):
        return e.text
    if e.op == "bound":
        return e.args[0].name in row
    x = [value(a, row) for a in e.args]
    if e.op == "&&":
        return False if False in x else None if None in x else True
    if e.op == "||":
        return True if True in x else None if None in x else False
    if e.op == "!":
        return None if x[0] is None else not x[0]
    if None in x:
        return None
    return {"=": x[0] == x[-1], "!=": x[0] != x[-1], "<": x[0] < x[-1], ">=": x[0] >= x[-1]}[e.op]


GROUPS = [
    "?x e:a ?y OPTIONAL { ?x e:b ?z FILTER(?z = ?y) }",
    "?x e:a ?y OPTIONAL { ?x e:b ?z FILTER(?z < ?y || ?y = \"n3\") }",
    "?x e:a ?y OPTIONAL { ?x e:b ?z } OPTIONAL { ?x e:c ?z }",
    "?x e:a ?y OPTIONAL { ?x e:b ?z } OPTIONAL { ?x e:c ?z FILTER(?z != \"n1\") } FILTER(!BOUND(?z) || ?z >= \"n2\")",
    "{ { ?x e:a ?y } UNION { ?x e:b ?z } { ?w e:a ?y } }",
    "{ ?x e:a ?y } UNION { ?x e:b ?z } OPTIONAL { ?x e:c ?y }",
    "{ ?x e:a ?y } UNION { ?x e:b ?z } . { ?x e:c ?y } UNION { ?z e:c ?x }",
    "?x e:a ?y OPTIONAL { ?y e:b ?z OPTIONAL { ?z e:c ?w FILTER(?w != ?y) } } FILTER(?x = \"n2\" || ?w < \"n5\")",
    "?x e:a \"n4\" FILTER(?x = \"absent\" || !(?x = \"n1\"))",
]


@pytest.mark.parametrize("text", GROUPS)
def test_optional_and_union_by_definition(graph, triples, stored, text):
    query = P + f"SELECT * WHERE {{ {text} }}"
    where = parse(query, True).where
    if not where.patterns and len(where.unions) == 1 and len(where.unions[0]) == 1 and not where.optionals:
        where = where.unions[0][0]
    names = sorted({t.name for t in variables(where)})
    want = Counter(tuple(r.get(n) for n in names) for r in evaluate(where, triples))
    for e in (Engine(by_property(graph, [f"http://e/{x}" for x in "abc"])), Engine(stored)):
        got = e.query(query, extended=True)
        assert sorted(got.columns) == names
        assert Counter(map(tuple, got.select(*names).collect())) == want


def variables(g):
    for p in g.patterns:
        yield from (t for t in (p.s, p.o) if isinstance(t, Var))
    for o in [*g.optionals, *(b for u in g.unions for b in u)]:
        yield from variables(o)


def test_products_must_be_asked_for(graph):
    e = Engine(by_property(graph, [f"http://e/{x}" for x in "abc"]))
    for text in ("?x e:a ?y OPTIONAL { ?z e:b ?w }", "?x e:a ?y . ?z e:b ?w", "{ ?x e:a ?y } { ?z e:b ?w }"):
        with pytest.raises(UnsupportedQuery):
            e.query(P + f"SELECT * WHERE {{ {text} }}", extended=True)
        assert e.query(P + f"SELECT * WHERE {{ {text} }}", extended=True, cross=True).count() > 0


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_range_join(spark, graph, triples, stored, op, monkeypatch):
    rng = random.Random(3)
    a, b = [rng.choice([None, *range(40)]) for _ in range(150)], [rng.choice([None, *range(40)]) for _ in range(90)]
    left, right = (spark.createDataFrame([(i, x) for i, x in enumerate(v)], f"{n} int, {c} int") for v, n, c in ((a, "i", "x"), (b, "j", "y")))
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x is not None and y is not None and {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
    out = range_join(left, "x", op, right, "y")
    assert sorted((r.i, r.j) for r in out.collect()) == want
    assert "Cartesian" not in plan(out) and "NestedLoop" not in plan(out)
    assert range_join(left.limit(0), "x", op, right, "y").count() == 0
    pairs = Counter((o1, s2) for s1, p1, o1 in triples if p1 == "http://e/a" for s2, p2, o2 in triples if p2 == "http://e/b" if {"<": o1 < s2, "<=": o1 <= s2, ">": o1 > s2, ">=": o1 >= s2}[op])
    got = Engine(stored).query(P + f"SELECT ?y ?z WHERE {{ ?x e:a ?y . ?z e:b ?w FILTER(?y {op} ?z) }}", extended=True)
    assert Counter(map(tuple, got.collect())) == pairs


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_order_is_compared_on_ids(triples, stored, op):
    """Ids stand in the order of the terms, so a range of terms is a pushed range of ids."""
    e = Engine(stored)
    for c in ("n3", "n35", "", "zz"):
        for text in (f'?y {op} "{c}"', f'"{c}" {op} ?y'):
            got = e.query(P + f"SELECT ?x ?y WHERE {{ ?x e:a ?y FILTER({text}) }}", extended=True)
            hit = lambda y: eval(text.replace("?y", repr(y)).replace(f'"{c}"', repr(c)))  # noqa: E731, S307
            assert Counter(map(tuple, got.collect())) == Counter((s, o) for s, p, o in triples if p == "http://e/a" and hit(o))
    ids = e.query(P + f'SELECT ?x WHERE {{ ?x e:a ?y FILTER(?y {op} "n35" && ?y != "n1") }}', extended=True, decode=False)
    assert "/dictionary" not in plan(ids) and ("ThanOrEqual(o," in plan(ids) or "LessThan(o," in plan(ids))


def test_ranges_guide_the_planner():
    side = S.Property(1000, 1000, 1000, (0, 999), (0, 999))
    stats = S.Stats({"p": side, "q": S.Property(400, 400, 400, (0, 999), (0, 999)), "r": S.Property(500, 500, 500, (0, 999), (0, 999))})
    patterns = [Pattern(Var("a"), "p", Var("b")), Pattern(Var("a"), "q", Var("c")), Pattern(Var("a"), "r", Var("d"))]
    narrow = {"b": [("<", 20.0), (">=", 10.0)]}
    assert 5 < base(patterns[0], stats, narrow).rows < 15 and base(patterns[0], stats).rows == 1000
    (_, wide), (order, cost) = best_order(patterns, stats), best_order(patterns, stats, narrow)
    assert cost < wide / 5 and 0 in order[:2]


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_functions_of_ones_own(graph, triples):
    e = Engine(by_property(graph, ["http://e/a"]), functions={"http://e/odd": lambda t: F.substring(t, -1, 1).isin("1", "3", "5", "7"), "join": lambda x, y: F.concat(x, y)})
    got = e.query(P + 'SELECT ?x (join(?x, "!") AS ?z) WHERE { ?x e:a ?y FILTER(e:odd(?y)) }', extended=True)
    assert Counter(map(tuple, got.collect())) == Counter((s, s + "!") for s, p, o in triples if p == "http://e/a" and int(o[-1]) % 2)
    with pytest.raises(UnsupportedQuery):
        e.query(P + "SELECT ?x WHERE { ?x e:a ?y FILTER(e:even(?y)) }", extended=True)
    assert e.query(P + "SELECT (?x AS ?s) ?y WHERE { ?x e:a ?y }").columns == ["s", "y"]


def test_constants_reach_the_scans(spark):
    """Constants of tables' keys and of ids are pushed into the Parquet scans, also beyond the basic form."""
    made = Engine(mapped_tables(spark, SF), terms=TERMS)
    text = plan(made.query(PREFIXES + CLOSED["f4_const_subject"]))
    assert "EqualTo(c_custkey,1)" in text and "supplier" not in text
    coded = Engine(store(spark, SF))
    for shape in ("SELECT ?c", "SELECT DISTINCT ?c"):
        assert "EqualTo(o," in plan(coded.query(PREFIXES + shape + ' WHERE { ?c ex:segment "BUILDING" }', extended=True))
    grouped = coded.query(PREFIXES + 'SELECT ?n (COUNT(*) AS ?k) WHERE { ?c ex:locatedIn ?n ; ex:segment "BUILDING" } GROUP BY ?n', extended=True)
    optional = coded.query(PREFIXES + 'SELECT ?c ?n WHERE { ?c ex:segment "BUILDING" OPTIONAL { ?c ex:name ?n } }', extended=True)
    compared = coded.query(PREFIXES + 'SELECT ?c WHERE { ?c ex:segment ?g FILTER(?g = "BUILDING") }', extended=True)
    for df in (grouped, optional, compared):
        assert "EqualTo(o," in plan(df) or "(o#" in plan(df)
    assert "EqualTo(o," in plan(grouped) and "EqualTo(o," in plan(optional)
    # one look-up of terms, of the one column that comes out
    assert plan(grouped).count("dictionary]") == 1 or plan(grouped).count("/dictionary") == 1
    assert "/dictionary" not in plan(coded.query(PREFIXES + 'SELECT DISTINCT ?c WHERE { ?c ex:segment "BUILDING" }', extended=True, decode=False))


def test_statistics_change_the_order_and_not_the_answer(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"a{i}", "http://e/big", f"b{i % 40}") for i in range(2000)] + [(f"b{i}", "http://e/mid", f"c{i % 5}") for i in range(40)]
    rows += [("c1", "http://e/small", "d"), ("c1", RDF_TYPE, "Rare"), *((f"a{i}", RDF_TYPE, "Common") for i in range(300))]
    rng.shuffle(rows)
    made = Store.write(spark, spark.createDataFrame(rows, "s string, p string, o string"), f"file://{tmp_path}/g")
    text = P + "SELECT ?a ?b ?c ?d WHERE { ?a e:big ?b . ?b e:mid ?c . ?c e:small ?d . ?c a <Rare> }"
    orders, answers = [], []
    for s in (True, False):
        e, chosen = Engine(made, settings=Settings(statistics=s)), []
        e.run(parse(text), e.settings, chosen)
        orders.append([p.p.rsplit("/", 1)[-1] for p in chosen[0]])
        answers.append(Counter(map(tuple, e.query(text).collect())))
    assert answers[0] == answers[1] and sum(answers[0].values()) == 400
    assert orders[0] != orders[1] and orders[0][-1] == "big"
    stats = made.stats_of({"http://e/big", "http://e/mid", RDF_TYPE}, {"Rare", "None"})
    big = stats.of("http://e/big")
    assert (big.count, big.distinct_s, big.distinct_o) == (2000, 2000, 40) and big.histogram("O").rows == 2000 and stats.classes["Rare"][0] == 1 and "None" not in stats.classes
    assert stats.pairs["http://e/big", "http://e/mid", "OS"] == 2000 and stats.pairs["http://e/mid", S.CLASS + "Rare", "OS"] == 8
    # statistics of other triples are not used
    spark.read.parquet(f"{made.path}/triples").limit(100).write.mode("overwrite").partitionBy("pid").parquet(f"{made.path}/other")
    spark.read.parquet(f"{made.path}/other").write.mode("overwrite").partitionBy("pid").parquet(f"{made.path}/triples")
    assert Store(spark, made.path).stats_of({"http://e/big"}, set()) is None


def test_settings_and_program(spark, tmp_path, capsys, monkeypatch):
    f = tmp_path / "s.properties"
    f.write_text("# comment\nclass.limit = 7\ncross = on\nruns=2\n")
    assert settings.load(str(f), extended=True) == Settings(extended=True, cross=True, class_limit=7, runs=2)
    monkeypatch.setenv(settings.VARIABLE, str(f))
    assert settings.load().class_limit == 7
    f.write_text("none = 1\n")
    with pytest.raises(ValueError):
        settings.load()
    monkeypatch.delenv(settings.VARIABLE)
    graph, out = tmp_path / "g.nt", f"file://{tmp_path}/store"
    graph.write_text('<http://a> <http://e/p> <http://b> .\n<http://b> <http://e/p> "c" .\n')
    queries = tmp_path / "q.txt"
    queries.write_text("SELECT ?x WHERE { ?x <http://e/p> ?y }\n\nSELECT ?x WHERE { ?x <http://e/none> ?y }\n")
    assert main(["load", f"file://{graph}", out]) == 0
    assert main(["query", out, "SELECT ?x ?z WHERE { ?x <http://e/p> ?y . ?y <http://e/p> ?z }", "--show", "--explain", "--in-memory"]) == 0
    said = capsys.readouterr().out
    assert "1 rows" in said and "http://a" in said and "cost:" in said
    assert main(["batch", out, str(queries), "--runs", "2"]) == 0
    made = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert made["counts"] == [2] and len(made["failed"]) == 1


def test_batch_and_explain(graph):
    e = Engine(by_property(graph, ["http://e/a", "http://e/b"]))
    out = e.batch([P + "SELECT ?x WHERE { ?x e:a ?y }", P + "SELECT ?x WHERE { ?x e:none ?y }"], runs=2)
    assert len(out["ms"]) == 1 and out["geomean"] >= 1 and len(out["failed"]) == 1
    assert "0: Pattern" in e.explain(P + "SELECT ?x WHERE { ?x e:a ?y . ?y e:b ?z }")


@pytest.mark.parametrize("name", ["f2_cycle", "f5_both_const", "ext_group_count", "ext_subselect", "ext_functions", "ext_minmax", "ext_sums", "ext_optional_filter", "ext_optional_twice", "ext_union_unbound", "ext_range_join", "stat_pairs", "store_f2_cycle", "store_ext_order_limit", "store_ext_sums"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert Counter(map(tuple, got[cols].values.tolist())) == Counter(map(tuple, want[cols].values.tolist()))


def test_all_registered_queries_have_sql():
    assert set(QUERIES) - {"store_order_f9"} == set(ORACLES) and set(CLOSED) <= set(QUERIES)


def test_frequent_values_are_joined_in_cells(spark, monkeypatch):
    """One object of many subjects: its pairs are made in more than one task, all of them, and no others."""
    from graphloom.operators import bgp as B

    monkeypatch.setattr(B, "CELL", 8)
    rng = random.Random(7)
    rows = [(f"s{i}", "hot" if i % 3 else f"o{rng.randrange(9)}") for i in range(120)] + [(f"s{i}", "other") for i in range(20)]
    source = {"http://e/a": spark.createDataFrame(rows, "s string, o string").repartition(3), "http://e/b": spark.createDataFrame(rows[30:], "s string, o string")}
    df = Engine(source).query(P + "SELECT ?x ?y ?z WHERE { ?x e:a ?z . ?y e:b ?z }")
    assert Counter(map(tuple, df.collect())) == Counter((a, b, o) for a, o in rows for b, v in rows[30:] if o == v)
    made = df.where(F.col("z") == "hot").groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 4 and Engine(source).query(P + "SELECT ?x WHERE { ?x e:a ?z . ?y e:b ?z }", count_only=True).first().n == df.count()
    keyed = mapped_tables(spark, SF)
    q = PREFIXES + CLOSED["f6_oo_selfjoin"]
    got = Engine(keyed, terms=TERMS).query(q)
    monkeypatch.setattr(B, "CELL", 1 << 20)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, Engine(keyed, terms=TERMS).query(q).collect()))


def test_pairs_by_order_are_made_from_counted_values(spark, monkeypatch):
    from graphloom.operators import bgp as B

    monkeypatch.setattr(B, "RUN", 7)
    asked = []
    join = B.range_join
    monkeypatch.setattr(B, "range_join", lambda left, x, op, right, y: asked.append((left.count(), right.count())) or join(left, x, op, right, y))
    a = [(f"x{i}", f"v{i % 4}") for i in range(60)]
    b = [(f"y{i}", f"v{i % 5}") for i in range(50)]
    source = {"http://e/a": spark.createDataFrame(a, "s string, o string"), "http://e/b": spark.createDataFrame(b, "s string, o string")}
    got = Engine(source).query(P + 'SELECT ?v (CONCAT(?w, "!") AS ?u) WHERE { ?x e:a ?v . ?y e:b ?w FILTER(?v < ?w && ?w != "v3") }', extended=True)
    assert Counter(map(tuple, got.collect())) == Counter((v, w + "!") for _, v in a for _, w in b if v < w and w != "v3")
    assert asked == [(4, 5)]
    got = Engine(source).query(P + "SELECT ?x ?w WHERE { ?x e:a ?v . ?y e:b ?w FILTER(?v >= ?w) } LIMIT 3000", extended=True)
    assert Counter(map(tuple, got.collect())) == Counter((x, w) for x, v in a for _, w in b if v >= w)


def test_counts_make_no_pairs(graph, triples, spark):
    e = Engine(by_property(graph))
    for patterns in ([("?x", "a", "?z"), ("?y", "b", "?z")], [("?x", "a", "?y"), ("?y", "b", "?z"), ("?z", "c", "?x")], [("?x", "a", "n3"), ("?x", "b", "?y")], [("n1", "a", "n2"), ("?x", "b", "?y")]):
        full = [(s, f"http://e/{p}", o) for s, p, o in patterns]
        names = sorted({t[1:] for s, _, o in patterns for t in (s, o) if t[0] == "?"})
        assert e.query(text(full, names), count_only=True).first().n == sum(brute(triples, full, names).values())
    rows = spark.createDataFrame([(f"s{i}", "hot") for i in range(200_000)], "s string, o string")
    assert Engine({"http://e/a": rows}).query(P + "SELECT ?x ?y WHERE { ?x e:a ?z . ?y e:a ?z }", count_only=True).first().n == 200_000**2
