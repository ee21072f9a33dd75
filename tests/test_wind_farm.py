"""A session from templates to updates, over a site model: 4 sites, 40 turbines, aspects between systems, measured series."""

import pytest

from graphloom import Mapping

N = 40
T, C, X = "http://farm.example/templates/", "http://farm.example/classes/", "http://farm.example/things/"
DOCUMENT = f"""@prefix t: <{T}> . @prefix c: <{C}> .
t:Place [xsd:anyURI ?place, ?name] :: {{ ottr:Triple(?place, rdfs:label, ?name), ottr:Triple(?place, rdf:type, c:Place) }} .
t:Aspect [xsd:anyURI ?whole, xsd:anyURI ?part, xsd:anyURI ?node, ?name] :: {{
  ottr:Triple(?whole, c:hasAspect, ?node), ottr:Triple(?part, c:fillsAspect, ?node), ottr:Triple(?node, rdfs:label, ?name) }} .
t:System [xsd:anyURI ?system, xsd:anyURI ?class, ?name] :: {{ ottr:Triple(?system, rdf:type, ?class), ottr:Triple(?system, rdfs:label, ?name) }} .
t:Value [xsd:anyURI ?owner, xsd:anyURI ?node, ?name, ?value] :: {{
  ottr:Triple(?owner, c:hasValue, ?node), ottr:Triple(?node, rdfs:label, ?name), ottr:Triple(?node, c:value, ?value) }} .
t:Series [xsd:anyURI ?owner, xsd:anyURI ?series, ?name, ?key, xsd:anyURI ?unit] :: {{
  ottr:Triple(?owner, c:hasSeries, ?series), ottr:Triple(?series, c:key, ?key), ottr:Triple(?series, c:unit, ?unit), ottr:Triple(?series, rdfs:label, ?name) }} .
"""
Q = f"PREFIX c: <{C}> PREFIX x: <{X}> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
KINDS = ("turbine", "drive", "generator", "weather")
PARTS = (("turbine", "drive"), ("drive", "generator"), ("turbine", "weather"))
SERIES = (("turbine", "State"), ("generator", "Power"), ("weather", "Wind speed"), ("weather", "Wind direction"))


@pytest.fixture(scope="module")
def farm(spark):
    m = Mapping(DOCUMENT, spark=spark)
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} {'bigint' if n == 'value' else 'string'}" for n in names.split()))
    m.expand(T + "Place", frame([(f"{X}place{k}", f"Place {k}") for k in range(4)], "place name"))
    for kind in KINDS:
        m.expand(T + "System", frame([(f"{X}{kind}{i}", C + kind, f"{kind} {i}") for i in range(N)], "system class name"), unique_subset=["system"])
    aspects = [(f"{X}place{i % 4}", f"{X}turbine{i}", f"{X}place-turbine{i}", f"A{i // 4 + 1}") for i in range(N)]
    aspects += [(f"{X}{a}{i}", f"{X}{b}{i}", f"{X}{a}-{b}{i}", f"{b[0].upper()}1") for a, b in PARTS for i in range(N)]
    m.expand(T + "Aspect", frame(aspects, "whole part node name"))
    m.expand(T + "Value", frame([(f"{X}turbine{i}", f"{X}limit{i}", "Limit", 1000 * (i % 3 + 1)) for i in range(N)], "owner node name value"))
    for k, (owner, name) in enumerate(SERIES):
        m.expand(T + "Series", frame([(f"{X}{owner}{i}", f"{X}series{k}-{i}", name, f"key-{k}-{i}", C + ("state" if k == 0 else "number")) for i in range(N)], "owner series name key unit"), unique_subset=["series"])
    return m


def rows(df):
    return sorted(tuple(None if v is None else str(v).replace(X, "").replace(C, "c:") for v in r) for r in df.collect())


def test_size(farm):
    assert farm.triples().count() == 2 * 4 + 2 * 4 * N + 3 * 4 * N + 3 * N + 4 * 4 * N


def test_types(farm):
    got = rows(farm.query(Q + "SELECT ?a ?b { ?a a ?b }"))
    assert got == sorted([(f"place{k}", "c:Place") for k in range(4)] + [(f"{k}{i}", f"c:{k}") for k in KINDS for i in range(N)])


def test_long_pattern(farm):
    got = farm.query(Q + """SELECT ?place ?turbine ?series ?name {
      ?p a c:Place ; rdfs:label ?place ; c:hasAspect ?n . ?t c:fillsAspect ?n ; a c:turbine ; rdfs:label ?turbine ; c:hasAspect ?n2 .
      ?d c:fillsAspect ?n2 ; a c:drive ; c:hasAspect ?n3 . ?g c:fillsAspect ?n3 ; c:hasSeries ?series . ?series rdfs:label ?name ; c:unit c:number .
      FILTER(?place = "Place 2" && ?turbine = "turbine 14") }""")
    assert rows(got) == [("Place 2", "turbine 14", "series1-14", "Power")]


def test_paths(farm):
    direct = rows(farm.query(Q + "SELECT ?place ?t { ?p a c:Place ; rdfs:label ?place ; c:hasAspect/^c:fillsAspect ?t }"))
    assert direct == sorted((f"Place {i % 4}", f"turbine{i}") for i in range(N))
    below = rows(farm.query(Q + "SELECT ?place ?t { ?p a c:Place ; rdfs:label ?place ; (c:hasAspect/^c:fillsAspect)+ ?t }"))
    assert below == sorted((f"Place {i % 4}", f"{k}{i}") for k in KINDS for i in range(N))


def test_values_by_class(farm):
    got = rows(farm.query(Q + "SELECT ?v (COUNT(?t) AS ?n) (SUM(?v) AS ?s) { ?t c:hasValue/c:value ?v } GROUP BY ?v HAVING(COUNT(?t) > 13)"))
    assert got == [("1000", "14", "14000")]


def test_construct_and_update(farm):
    text = Q + 'CONSTRUCT { ?a c:something ?b . x:thing c:nothing ?b } WHERE { ?a a ?b }'
    something, nothing = farm.query(text)
    assert something.columns == ["subject", "verb", "object"] and (something.count(), nothing.count()) == (4 + 4 * N, 5)
    before = farm.triples().count()
    farm.construct_update(text)
    farm.construct_update(text)
    assert farm.triples().count() == before + 4 + 4 * N + 5
    assert rows(farm.query(Q + "SELECT ?b { x:thing c:nothing ?b }")) == sorted([("c:Place",)] + [(f"c:{k}",) for k in KINDS])
    assert farm.query(Q + "SELECT ?a { ?a c:something ?b }").count() == 4 + 4 * N
    assert rows(farm.query(Q + "SELECT ?a { ?a c:unheardOf ?b }")) == []


def test_predicates_of_a_column_are_one_scan(spark, tmp_path):
    p = "@prefix ex: <http://e/> .\n"
    m = Mapping(p + "ex:E [xsd:anyURI ?s, xsd:anyURI ?p, ?o] :: { ottr:Triple(?s, ?p, ?o) } . ex:S [xsd:anyURI ?s, ?o] :: { ottr:Triple(?s, ex:p0, ?o) } .", spark=spark)
    edges = [(f"http://e/{i % 7}", f"http://e/p{i % 4}" if i % 9 else None, i % 5) for i in range(60)]
    spark.createDataFrame(edges, "s string, p string, o int").write.parquet(str(tmp_path / "edges"))
    m.expand("ex:E", spark.read.parquet(str(tmp_path / "edges")), validate=False)
    want = {e for e in edges if e[1]}
    ask = lambda q: m.query("PREFIX ex: <http://e/> " + q)
    everything = ask("SELECT ?s ?p ?o { ?s ?p ?o }")
    assert sorted(map(tuple, everything.collect())) == sorted(want)
    plans = everything._jdf.queryExecution().optimizedPlan().toString(), m.ntriples()._jdf.queryExecution().optimizedPlan().toString()
    assert [x.count("Relation [") for x in plans] == [1, 1]
    assert m.triples().count() == m.ntriples().count() == len(want)
    assert sorted(map(tuple, ask("SELECT ?s ?o { ?s !(ex:p0|ex:p1) ?o }").collect())) == sorted({(s, str(o)) for s, v, o in want if v[-1] in "23"})
    # a predicate that has other rows too is read by itself
    m.expand("ex:S", spark.createDataFrame([("http://e/0", 0), ("http://e/z", 1)], "s string, o int"))
    want |= {("http://e/0", "http://e/p0", 0), ("http://e/z", "http://e/p0", 1)}
    assert sorted(map(tuple, ask("SELECT ?s ?p ?o { ?s ?p ?o }").collect())) == sorted(want)
    m.construct_update('PREFIX ex: <http://e/> CONSTRUCT { ?s ?p "x"@en } WHERE { ?s ?p 1 }')
    tagged = {(s, v) for s, v, o in want if o == 1}
    assert sorted((r.subject, r.predicate) for r in m.triples().where("language = 'en'").collect()) == sorted(tagged)
    assert ask("SELECT ?s ?p { ?s ?p ?x FILTER(LANG(?x) = 'en') }").count() == len(tagged)
