"""SPARQL: cases where duplicates, unbound variables and types matter, and the workload against DuckDB."""

from collections import Counter

import duckdb
import pytest

from graphloom import Mapping, workload
from graphloom.errors import ParsingError, SparqlError

P = "@prefix ex: <http://e/> .\n"
Q = "PREFIX ex: <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    m = Mapping(P + "ex:E [xsd:anyURI ?s, xsd:anyURI ?p, xsd:anyURI ?o] :: { ottr:Triple(?s, ?p, ?o) } . ex:L [xsd:anyURI ?s, ?v] :: { ottr:Triple(?s, ex:v, ?v) } .", spark=spark)
    e = lambda *x: tuple(f"http://e/{k}" for k in x)
    edges = [e("a", "p", "b"), e("b", "p", "c"), e("c", "p", "a"), e("c", "p", "d"), e("a", "q", "a"), e("d", "q", "b"), e("a", "p", "b")]
    m.expand("ex:E", spark.createDataFrame(edges, "s string, p string, o string"))
    m.expand("ex:L", spark.createDataFrame([("http://e/a", 1), ("http://e/b", 2)], "s string, v int"))
    m.expand("ex:L", spark.createDataFrame([("http://e/a", "one"), ("http://e/d", "two")], "s string, v string"))
    return m


def rows(df):
    return Counter(tuple(str(x).replace("http://e/", "") for x in r) for r in df.collect())


@pytest.mark.parametrize(("text", "want"), [
    ("SELECT ?x { ?x ex:q ?x }", ["a"]),
    ("SELECT ?o { ex:a ex:p+ ?o }", ["a", "b", "c", "d"]),
    ("SELECT ?o { ex:z ex:p* ?o }", ["z"]),
    ("SELECT ?s { ?s ex:p+ ex:d }", ["a", "b", "c"]),
    ("SELECT (COUNT(*) AS ?n) { ?s ex:p+ ?o }", ["12"]),
    ("SELECT ?s ?o { ?s (ex:p/ex:q)+ ?o }", ["c a", "c b"]),
    ("SELECT ?s ?o { ?s !(ex:p|ex:v) ?o }", ["a a", "d b"]),
    ("SELECT ?s ?o { ?s !(ex:v|^ex:p|ex:q|ex:p) ?o }", ["a a", "b d", "1 a", "2 b", "one a", "two d"]),
    ("SELECT ?v { ex:a ex:v ?v }", ["1", "one"]),
    ("SELECT ?s { ?s ex:v 1 }", ["a"]),
    ("SELECT ?s { ?s ex:v ?v FILTER(?v > 1) }", ["b"]),
    ("SELECT ?s ?x { ?s ex:p ?o OPTIONAL { ?s ex:q ?x } }", ["a a", "b None", "c None", "c None"]),
    ("SELECT ?s ?x { ?s ex:p ex:b OPTIONAL { ?y ex:none ?x } }", ["a None"]),
    ("SELECT ?a ?b { { ?a ex:q ?b } UNION { ?a ex:v 2 } }", ["a a", "d b", "b None"]),
    ("SELECT ?a ?b ?v { { ?a ex:q ?b } UNION { ?a ex:v 2 } ?b ex:v ?v FILTER(isNumeric(?v)) }", ["a a 1", "d b 2", "b a 1", "b b 2"]),
    ("SELECT ?s { ?s ex:p ?o MINUS { ?x ex:q ?o } }", ["b", "c"]),
    ("SELECT ?s { ?s ex:p ?o MINUS { ?z ex:v 99 } }", ["a", "b", "c", "c"]),
    ("SELECT ?s ?k { ?s ex:q ?o VALUES (?s ?k) { (ex:a 1) (UNDEF 2) } }", ["a 1", "a 2", "d 2"]),
    ("SELECT ?s (COUNT(?x) AS ?n) (COUNT(*) AS ?k) { ?s ex:p ?o OPTIONAL { ?s ex:q ?x } } GROUP BY ?s", ["a 1 1", "b 0 1", "c 0 2"]),
    ("SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?t) { ?s ex:none ?v }", ["0 0"]),
    ("SELECT ?s { ?s ex:p ?o FILTER EXISTS { ?o ex:v ?v MINUS { ?o ex:v 2 } } }", ["c", "c"]),
    ("SELECT ?s { ?s ex:p ?o FILTER(NOT EXISTS { ?s ex:q ?x } && ?o = ex:d) }", ["c"]),
    ("SELECT DISTINCT ?p { ?s ?p ?o }", ["p", "q", "v"]),
    ("SELECT ?p { ex:d ?p ex:b }", ["q"]),
    ("SELECT ?x { } VALUES ?x { 1 2 }", ["1", "2"]),
    ("SELECT (1 + 1 AS ?x) (1 / 0 AS ?y) (\"a\" + 1 AS ?z) { }", ["2 None None"]),
    ("SELECT (IF(1 < 2, \"y\", 3) AS ?x) (COALESCE(1/0, \"k\") AS ?y) (xsd:integer(\"x\") AS ?z) { }", ["y k None"]),
    ("SELECT ?Q ?q { ex:a ex:q ?Q . ex:d ex:q ?q }", ["a b"]),
    ("SELECT ?s { [] ex:p [ ex:q ?s ] }", ["a", "b"]),
])
def test_semantics(graph, text, want):
    assert rows(graph.query(Q + text)) == Counter(tuple(w.split()) for w in want)


def test_forms(graph):
    assert graph.query(Q + "ASK { ex:a ex:p ex:b }") is True and graph.query(Q + "ASK { ex:a ex:p ex:d }") is False
    for bad, error in (("SELECT ?x { ?x", ParsingError), ("DESCRIBE ex:a", SparqlError), ("SELECT ?x { GRAPH ex:g { ?x ex:p ?y } }", SparqlError)):
        with pytest.raises(error):
            graph.query(Q + bad)
    (made,) = graph.query(Q + "CONSTRUCT { _:b ex:of ?s } WHERE { ?s ex:v ?v }")
    assert made.count() == 4 and made.select("subject").distinct().count() == 4


def test_construct_update(spark):
    m = Mapping(P + "ex:E [xsd:anyURI ?s, xsd:anyURI ?o] :: { ottr:Triple(?s, ex:p, ?o) } .", spark=spark)
    m.expand("ex:E", spark.createDataFrame([("http://e/a", "http://e/b"), ("http://e/b", "http://e/c")], "s string, o string"))
    for _ in range(2):
        m.construct_update(Q + "CONSTRUCT { ?s ex:p ?o } WHERE { ?s ex:p/ex:p ?o }")
    assert rows(m.query(Q + "SELECT ?s ?o { ?s ex:p ?o }")) == Counter([("a", "b"), ("b", "c"), ("a", "c")])


def test_star_is_one_scan(spark):
    m = workload.graph(spark, SF, "lineitem")
    plan = m.query(workload.PREFIXES + "SELECT ?q ?f { ?l v:quantity ?q ; v:rflag ?f ; v:tax ?t FILTER(?t > 0.05) }")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_workload(spark, name):
    df = workload.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in workload.SHAPES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(workload.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_keys_that_may_be_unbound_make_equi_joins(spark):
    m = Mapping(P + """ex:T [xsd:anyURI ?s, ? ?a, ? ?b] :: { ottr:Triple(?s, ex:is, "t"), ottr:Triple(?s, ex:a, ?a), ottr:Triple(?s, ex:b, ?b) } .""", spark=spark)
    m.expand("ex:T", spark.createDataFrame([("http://s/1", 1, 1), ("http://s/2", 2, None), ("http://s/3", None, 3), ("http://s/4", None, None), ("http://s/5", 1, 2)], "s string, a int, b int"))
    ask = lambda q: m.query("PREFIX ex: <http://e/> SELECT * { " + q + " }")
    pairs = ask('{ ?x ex:is "t" OPTIONAL { ?x ex:a ?v } } { ?y ex:b ?v }')
    rows = [(1, 1, 1), (2, 2, None), (3, None, 3), (4, None, None), (5, 1, 2)]
    want = sorted(f"http://s/{x[0]} http://s/{y[0]} {y[2]}" for x in rows for y in rows if y[2] is not None and x[1] in (None, y[2]))
    assert sorted(f"{r.x} {r.y} {r.v}" for r in pairs.collect()) == want
    left = ask('?x ex:is "t" OPTIONAL { ?x ex:a ?v } MINUS { ?y ex:b ?v }')
    assert sorted(r.x[-1] for r in left.collect()) == ["3", "4"]
    further = ask('?x ex:is "t" OPTIONAL { ?x ex:a ?v } OPTIONAL { ?y ex:b ?v }')
    want = sorted(f"{x[0]} {y[0] if y else None}" for x in rows for y in ([y for y in rows if y[2] is not None and x[1] in (None, y[2])] or [None]))
    assert sorted(f"{r.x[-1]} {r.y and r.y[-1]}" for r in further.collect()) == [w for w in want]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "OR isnull" not in plan and "<=>" not in plan
    assert "BroadcastNestedLoopJoin" not in left._jdf.queryExecution().executedPlan().toString()


def test_sums_over_terms_that_are_no_numbers(spark):
    m = Mapping(P + """ottr:Triple(ex:a, ex:v, 1) . ottr:Triple(ex:a, ex:v, 2.5) . ottr:Triple(ex:b, ex:v, 1) . ottr:Triple(ex:b, ex:v, "a") .""", spark=spark)
    got = {r.s[-1]: (r.n, r.m) for r in m.query("PREFIX ex: <http://e/> SELECT ?s (SUM(?v) AS ?n) (AVG(?v) AS ?m) { ?s ex:v ?v } GROUP BY ?s").collect()}
    assert got == {"a": (3.5, 1.75), "b": (None, None)}


def test_deep_chain(spark):
    m = Mapping(P + "ex:T [xsd:anyURI ?s, xsd:anyURI ?o] :: { ottr:Triple(?s, ex:next, ?o) } .", spark=spark)
    n = 200
    m.expand("ex:T", spark.createDataFrame([(f"http://s/{i}", f"http://s/{i + 1}") for i in range(n)], "s string, o string"))
    assert m.query("PREFIX ex: <http://e/> SELECT ?a ?b { ?a ex:next+ ?b }").count() == n * (n + 1) // 2


def test_timezone(spark):
    m = Mapping(P + "ex:T [xsd:anyURI ?s, ?o] :: { ottr:Triple(?s, ex:at, ?o) } .", spark=spark)
    m.expand("ex:T", spark.sql("SELECT 'http://s' AS s, timestamp '2030-01-02 03:04:05' AS o"))
    assert [r.z for r in m.query("PREFIX ex: <http://e/> SELECT (TIMEZONE(?o) AS ?z) { ?s ex:at ?o }").collect()] == ["PT0S"]


def test_native_parquet_of_alike_names(spark, tmp_path):
    m = Mapping("@prefix ottr: <http://ns.ottr.xyz/0.4/> . ottr:Triple(<http://x/s>, <http://x/a/b>, 1) . ottr:Triple(<http://x/s>, <http://x/ab>, 2) . ottr:Triple(<http://x/s>, <http://x/c>, 3) .", spark=spark)
    m.write_native_parquet(str(tmp_path))
    assert sorted(r.object for p in tmp_path.glob("*.parquet") for r in spark.read.parquet(str(p)).collect()) == [1, 2, 3]
    assert len(list(tmp_path.glob("*.parquet"))) == 3


def test_decimals(spark):
    m = Mapping(P + "ex:T [xsd:anyURI ?s, ?o] :: { ottr:Triple(?s, ex:v, ?o) } .", spark=spark)
    m.expand("ex:T", spark.sql("SELECT * FROM VALUES ('http://s/1', 0.10BD), ('http://s/2', 0.20BD), ('http://s/3', 100.00BD) AS t(s, o)"))
    one = lambda e: m.query(Q + f"SELECT (STR({e}) AS ?x) {{ }}").first().x
    assert m.query(Q + "ASK { FILTER(0.1 + 0.2 = 0.3) }") is True
    want = {
        "0.1 + 0.2": "0.3", "1 - 0.9": "0.1", "0.1 * 0.1": "0.01", "-1.5 * 2": "-3", "123456789012.5 * 2": "246913578025", "ROUND(-2.5)": "-2", "ROUND(2.5)": "3",
        "CEIL(1.2)": "2", "FLOOR(-1.2)": "-2", "CEIL(1e30)": None, "CEIL(1.5e0)": "2", "ABS(-0.10)": "0.1", "0.1e0 + 0.2": "0.30000000000000004", "xsd:decimal(\"1.50\")": "1.5", "xsd:decimal(\"x\")": None,
        "IF(true, 1, 0.5)": "1", "DATATYPE(1 + 0.5)": "http://www.w3.org/2001/XMLSchema#decimal", "DATATYPE(1.5 / 2)": "http://www.w3.org/2001/XMLSchema#double",
    }
    assert {e: one(e) for e in want} == want
    got = m.query(Q + "SELECT (STR(SUM(?o)) AS ?t) (STR(AVG(?o)) AS ?a) (STR(MAX(?o)) AS ?m) { ?s ex:v ?o }").first()
    assert (got.t, got.m) == ("100.3", "100") and got.a.startswith("33.43333333333333333")
    assert [r.s for r in m.query(Q + "SELECT ?s { ?s ex:v 0.2 }").collect()] == ["http://s/2"]
    assert sorted(r.line.split('"')[1] for r in m.ntriples().collect()) == ["0.1", "0.2", "100"]
