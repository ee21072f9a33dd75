"""Template documents and expansion."""

import datetime as dt
from collections import Counter
from itertools import product, zip_longest

import pytest

from graphloom import Mapping
from graphloom.errors import MappingError, ParsingError, ResolutionError, TypingError
from graphloom.sources.templates import Templates, parse

P = "@prefix ex: <http://e.example/> .\n"


def lines(mapping):
    return sorted(r.line for r in mapping.ntriples().collect())


def test_grammar():
    d = parse(P + """# a comment
PREFIX b: <http://b.example/>
@prefix c:<http://c.example/>.
ex:T [ ! ex:Type ?a, ? List<xsd:int> ?b = (1, -2, 3.5), ?! NEList<NEList<xsd:string>> ?c, LUB<ex:X> ?d, <http://t.example/> ?e = "x"@en-GB ]
  @@ex:Note("hi"), @@cross | ex:Note(++ (1, 2)) :: { cross | ex:U(++ ?b, [], _:x, none, true, 'it''s'^^ex:s) } .
ex:U [?a] :: BASE .
ex:S [ ] .
ex:U("a\\"b\\u00e9", 1.5e3) .
""".replace("'it''s'", "'it'"))
    t = d.templates[0]
    assert [(p.name, p.optional, p.non_blank) for p in t.parameters] == [("a", False, True), ("b", True, False), ("c", True, True), ("d", False, False), ("e", False, False)]
    assert len(t.annotations) == 2 and d.templates[1].body is None and d.instances[0].arguments[0].term.value == 'a"bé'
    assert parse(str(t)).templates[0] == t


@pytest.mark.parametrize(("text", "error"), [
    (P + "ex:T [ ?a ] :: { ex:U(?a) }", ParsingError), ("no:T [ ?a ] .", ResolutionError), (P + "ex:T [ ?a ] :: { ex:U(?a) } .", TypingError),
    (P + "ex:T [?a] :: { ex:T(?a) } .", TypingError), (P + "@prefix ex: <http://other/> .", ResolutionError), (P + "ex:T [?a] :: { ottr:Triple(?b, ex:p, ?a) } .", TypingError),
])
def test_errors(text, error):
    with pytest.raises(error):
        Templates([text])


def test_nested_constants_and_types(spark):
    m = Mapping(P + "ex:A [?s, ?v] :: { ex:B(?s, ?v, 5) , ottr:Triple(?s, rdf:type, ex:C) } . ex:B [xsd:anyURI ?s, ?v, ?k] :: { ottr:Triple(?s, ex:v, ?v), ottr:Triple(?s, ex:k, ?k) } .", spark=spark)
    m.expand("ex:A", spark.createDataFrame([("http://s/1", 1), ("http://s/1", 1)], "s string, v int"))
    assert lines(m) == sorted(['<http://s/1> <http://e.example/v> "1"^^<http://www.w3.org/2001/XMLSchema#int> .', '<http://s/1> <http://e.example/k> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .', "<http://s/1> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e.example/C> ."])


def test_datatypes(spark):
    m = Mapping(P + "ex:T [xsd:anyURI ?s, ?a, ?b, ?c, ?d, ?e, ?f] :: { ottr:Triple(?s, ex:p, ?a), ottr:Triple(?s, ex:p, ?b), ottr:Triple(?s, ex:p, ?c), ottr:Triple(?s, ex:p, ?d), ottr:Triple(?s, ex:p, ?e), ottr:Triple(?s, ex:p, ?f) } .", spark=spark)
    when = dt.datetime(2031, 11, 5, 23, 58, 1, 250000)
    m.expand("ex:T", spark.createDataFrame([("http://s", True, 7, 1.5, when, dt.date(2031, 11, 5), dt.timedelta(days=1, seconds=2))], "s string, a boolean, b long, c float, d timestamp_ntz, e date, f interval day to second"))
    got = {r.datatype.rsplit("#", 1)[1]: r.object for r in m.triples().collect()}
    assert got == {"boolean": "true", "long": "7", "float": "1.5", "dateTime": "2031-11-05T23:58:01.250", "date": "2031-11-05", "duration": "PT86402S"}


def test_lists(spark):
    body = "ex:Q [? xsd:anyURI ?s, ? ?x, ? ?y] :: { ottr:Triple(?s, ex:x, ?x), ottr:Triple(?s, ex:y, ?y) } ."
    rows = spark.createDataFrame([("http://s", [1, 2, 3], [4, None])], "s string, a array<int>, b array<int>")
    want = {"cross": {"1", "2", "3", "4"}, "zipMin": {"1", "2", "4"}, "zipMax": {"1", "2", "3", "4"}}
    for expander, objects in want.items():
        m = Mapping(P + f"ex:T [xsd:anyURI ?s, List<xsd:int> ?a, List<xsd:int> ?b] :: {{ {expander} | ex:Q(?s, ++ ?a, ++ ?b) }} . {body}", spark=spark)
        m.expand("ex:T", rows)
        assert {r.object for r in m.triples().collect()} == objects
    m = Mapping(P + "ex:T [xsd:anyURI ?s] :: { cross | ottr:Triple(?s, ex:l, ++ (1, 2)) } .", spark=spark)
    m.expand("ex:T", spark.createDataFrame([("http://s",)], "s string"))
    assert {r.object for r in m.triples().collect()} == {"1", "2"}


def test_lists_are_crossed_only_where_a_triple_needs_it(spark):
    rows = spark.createDataFrame([("http://s/1", list(range(30_000)), list(range(30_000, 60_000))), ("http://s/2", [1], []), ("http://s/3", None, [2, 2]), ("http://s/4", [3, None], [None])], "s string, a array<int>, b array<int>")
    got = {}
    for given in ("? ?x, ? ?y", "?x, ?y"):  # 9e8 pairs in the first row
        m = Mapping(P + f"ex:T [xsd:anyURI ?s, ? List<xsd:int> ?a, ? List<xsd:int> ?b] :: {{ cross | ex:Q(?s, ++ ?a, ++ ?b) }} . ex:Q [xsd:anyURI ?s, {given}] :: {{ ottr:Triple(?s, ex:x, ?x), ottr:Triple(?s, ex:y, ?y), ottr:Triple(?s, rdf:type, ex:C) }} .", spark=spark)
        m.expand("ex:T", rows)
        got[given] = Counter((r.subject[-1], r.predicate[-4:]) for r in m.triples().collect())
    first = {("1", "le/x"): 30_000, ("1", "le/y"): 30_000, ("1", "type"): 1}
    assert got["? ?x, ? ?y"] == first | {("2", "le/x"): 1, ("2", "type"): 1, ("3", "le/y"): 1, ("3", "type"): 1, ("4", "le/x"): 1, ("4", "type"): 1}
    assert got["?x, ?y"] == first


@pytest.mark.parametrize("expander", ["cross", "zipMin", "zipMax"])
@pytest.mark.parametrize("given", ["? ?x, ? ?y, ? ?z", "?x, ? ?y, ? ?z", "? ?x, ? ?y = 9, ?z = 8", "? ?x, ! ?y, ?z"])
def test_expanders_by_brute_force(spark, expander, given):
    lists = [(1, 2, 2), (4, None), (), None, (5, 6, 7, 8)]
    rows = [(f"http://s/{i}", *map(lambda x: x if x is None else list(x), (a, b, c))) for i, (a, b, c) in enumerate(product(lists, lists, lists[:4]))]
    rows += [rows[-1], ("http://s/0", [1, 3], [4], [5])]
    body = "ottr:Triple(?s, ex:x, ?x), ottr:Triple(?s, ex:y, ?y), ottr:Triple(?s, ex:n, _:b), ottr:Triple(_:b, ex:bx, ?x), ottr:Triple(_:b, ex:bz, ?z), ottr:Triple(?s, rdf:type, ex:C)"
    m = Mapping(P + f"ex:T [xsd:anyURI ?s, ? List<xsd:int> ?a, ? List<xsd:int> ?b, ? List<xsd:int> ?c] :: {{ {expander} | ex:Q(?s, ++ ?a, ++ ?b, ++ ?c) }} . ex:Q [xsd:anyURI ?s, {given}] :: {{ {body} }} .", spark=spark)
    m.expand("ex:T", spark.createDataFrame(rows, "s string, a array<int>, b array<int>, c array<int>"))
    defaults = [int(p.split("=")[1]) if "=" in p else None for p in given.split(",")]
    want, blanks = set(), set()
    for s, *abc in rows:
        if expander == "cross":
            places = product(*[x or [None] for x in abc])
        elif expander == "zipMin":
            places = list(zip(*[x or [] for x in abc], strict=False)) or [(None, None, None)]
        else:  # a list that is null has no places, nor have the others
            places = [] if None in abc else list(zip_longest(*abc))
            places = places or [(None, None, None)]
        for place in places:
            if any(v is None and "?" != p.split()[0] and "=" not in p for v, p in zip(place, given.split(","), strict=True)):
                continue
            x, y, z = (d if v is None else v for v, d in zip(place, defaults, strict=True))
            want |= {(s, "x", x), (s, "y", y), (s, "e", "C")}
            blanks.add((s, place, x, z))
    got = m.triples().collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r.subject, r.predicate[-1], int(r.object) if r.predicate[-1] in "xy" else "C") for r in got if r.subject[:4] == "http" and r.predicate[-2:] != "/n"} == {w for w in want if w[2] is not None}
    of = {r.object: r.subject for r in got if r.predicate[-2:] == "/n"}
    assert {r.subject for r in got if r.subject[:2] == "_:"} <= set(of)
    for name, k in (("bx", 2), ("bz", 3)):
        assert {(of[r.subject], int(r.object)) for r in got if r.predicate.endswith(name)} == {(b[0], b[k]) for b in blanks if b[k] is not None}


@pytest.mark.parametrize("expander", ["cross", "zipMin", "zipMax"])
def test_list_elements_are_compared_only_between_rows_of_a_subject(spark, expander):
    document = P + f"ex:T [xsd:anyURI ?s, ? ?a, ? ?b] :: {{ {expander} | ex:Q(?s, ++ ?a, ++ ?b) }} . ex:Q [xsd:anyURI ?s, ? ?x, ? ?y] :: {{ ottr:Triple(?s, ex:x, ?x), ottr:Triple(?s, ex:y, ?y) }} ."
    rows = [(f"http://s/{i}", [f"a{i % 3}", "u", "u"], ["u", None, f"b{i}"]) for i in range(6)]
    want = {(s, p, o) for s, a, b in rows for p, x in (("x", a), ("y", b)) for o in x if o is not None}
    for copies in ([], [("http://s/2", ["u", "new", "new"], ["u", "b2", "b3"])], rows):
        m = Mapping(document, spark=spark)
        m.expand("ex:T", spark.createDataFrame(rows + copies, "s string, a array<string>, b array<string>").repartition(3))
        t = m.triples()
        got = [(r.subject, r.predicate[-1], r.object) for r in t.collect()]
        assert sorted(got) == sorted(want | {(s, p, o) for s, a, b in copies for p, x in (("x", a), ("y", b)) for o in x if o is not None})
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert ("Aggregate" in plan) == bool(copies)
    m = Mapping(document, spark=spark)
    m.expand("ex:T", spark.createDataFrame([("http://s", [0.0, -0.0, float("nan"), float("nan")], [1.5] * 4)], "s string, a array<double>, b array<double>"))
    assert sorted(r.object for r in m.triples().collect()) == ["0.0", "1.5", "NaN"]


def test_lists_of_declared_keys_need_no_comparison(spark):
    m = Mapping(spark=spark)
    m.expand_default(spark.createDataFrame([("http://s", [1, 2, 1]), ("http://t", [1])], "id string, l array<int>"), "id", predicate_uri_prefix="http://p/")
    t = m.triples()
    assert sorted((r.subject, r.object) for r in t.collect()) == [("http://s", "1"), ("http://s", "2"), ("http://t", "1")]
    assert "Aggregate" not in t._jdf.queryExecution().executedPlan().toString() and not m.store.subjects


def test_checks(spark):
    m = Mapping(P + "ex:T [! xsd:anyURI ?s, ?o = 3] :: { ottr:Triple(?s, ex:p, ?o) } .", spark=spark)
    for rows, schema in (([("_:b", 1)], "s string, o int"), ([(None, 1)], "s string, o int"), ([("http://s", 1, 2)], "s string, o int, z int"), ([(1,)], "o int"), ([(["a"], 1)], "s array<string>, o int")):
        with pytest.raises(MappingError):
            m.expand("ex:T", spark.createDataFrame(rows, schema))
    m.expand("ex:T", spark.createDataFrame([("http://s", None), ("http://t", 4)], "s string, o int"))
    m.expand("ex:T", spark.createDataFrame([("http://u",)], "s string"))
    assert sorted(r.object for r in m.triples().collect()) == ["3", "3", "4"]


def test_default_template_and_tags(spark):
    m = Mapping(spark=spark)
    text = m.expand_default(spark.createDataFrame([("http://s", "http://f", [1, 2], "hi")], "id string, f string, l array<int>, t string"), "id", ["f"], predicate_uri_prefix="http://p/", language_tags={"t": "en"})
    assert "cross" in text and "http://p/l" in text
    assert lines(m) == sorted(["<http://s> <http://p/f> <http://f> .", '<http://s> <http://p/l> "1"^^<http://www.w3.org/2001/XMLSchema#int> .', '<http://s> <http://p/l> "2"^^<http://www.w3.org/2001/XMLSchema#int> .', '<http://s> <http://p/t> "hi"@en .'])


def test_ground_instances_and_blanks(spark):
    m = Mapping(P + "ottr:Triple(ex:a, ex:p, \"x\\\"\\n\") . ex:T [xsd:anyURI ?s] :: { ottr:Triple(?s, ex:b, _:n), ottr:Triple(_:n, ex:c, 1) } .", spark=spark)
    m.expand("ex:T", spark.createDataFrame([("http://s/1",), ("http://s/2",)], "s string"))
    rows = m.triples().collect()
    blanks = {r.object for r in rows if r.object_kind == "blank"}
    assert len(blanks) == 2 and blanks == {r.subject for r in rows if r.predicate.endswith("/c")}
    assert '<http://e.example/a> <http://e.example/p> "x\\"\\n" .' in lines(m)
    assert {repr(t) for t in m.to_triples() if t.object.kind == "literal" and "x" in t.object.value} == {'<http://e.example/a> <http://e.example/p> "x\\"\\n"'}


def test_exports(spark, tmp_path):
    m = Mapping(P + "ex:T [xsd:anyURI ?s, ?v] :: { ottr:Triple(?s, ex:v, ?v) } .", spark=spark, caching_folder=str(tmp_path / "cache"))
    m.expand("ex:T", spark.createDataFrame([("http://s/1", 1), ("http://s/2", 2)], "s string, v int"))
    m.write_ntriples(str(tmp_path / "nt"))
    m.write_native_parquet(str(tmp_path / "pq"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "nt")).collect()) == lines(m)
    (table,) = (tmp_path / "pq").glob("*.parquet")
    assert spark.read.parquet(str(table)).dtypes == [("subject", "string"), ("object", "int")]


def test_stream(spark, tmp_path):
    from graphloom.streaming.expand import expand_stream

    spark.createDataFrame([("http://s/1", 1)], "s string, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, v int").parquet(str(tmp_path / "in"))
    q = expand_stream(P + "ex:T [xsd:anyURI ?s, ?v] :: { ottr:Triple(?s, ex:v, ?v) } .", "ex:T", stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.object for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1"]


def test_declared_types_are_checked(spark):
    inner = "ex:In [xsd:integer ?x, xsd:anyURI ?s] :: { ottr:Triple(?s, ex:v, ?x) } . "
    for kind in ("xsd:integer", "xsd:int", "xsd:unsignedByte", "ottr:IRI"):
        out = P + inner + f"ex:Out [{kind} ?x, xsd:anyURI ?s] :: {{ ex:In(?x, ?s) }} ."
        if kind == "ottr:IRI":
            with pytest.raises(TypingError):
                Mapping(out, spark=spark)
        else:
            Mapping(out, spark=spark)
    for bad in ("xsd:string ?x", "xsd:decimal ?x", "List<xsd:integer> ?x"):
        with pytest.raises(TypingError):
            Mapping(P + inner + f"ex:Out [{bad}, xsd:anyURI ?s] :: {{ ex:In(?x, ?s) }} .", spark=spark)
    Mapping(P + inner + "ex:Out [List<xsd:int> ?x, xsd:anyURI ?s] :: { cross | ex:In(++ ?x, ?s) } .", spark=spark)
    with pytest.raises(TypingError):
        Mapping(P + inner + "ex:Out [xsd:int ?x, xsd:anyURI ?s] :: { cross | ex:In(++ ?x, ?s) } .", spark=spark)
    with pytest.raises(TypingError):
        Mapping(P + "ex:T [xsd:string ?s] :: { ottr:Triple(?s, ex:v, 1) } .", spark=spark)


def test_prefixes_that_differ_are_left_out(spark):
    one = "@prefix a: <http://one/> . @prefix b: <http://b/> . a:T [xsd:anyURI ?s] :: { ottr:Triple(?s, b:p, 1) } ."
    two = "@prefix a: <http://two/> . a:U [xsd:anyURI ?s] :: { ottr:Triple(?s, a:q, 1) } ."
    with pytest.warns(UserWarning, match="prefix a:"):
        m = Mapping([one, two], spark=spark)
    m.expand("http://two/U", spark.createDataFrame([("http://s",)], "s string"))
    m.expand("http://one/T", spark.createDataFrame([("http://s",)], "s string"))
    assert lines(m) == ['<http://s> <http://b/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .', '<http://s> <http://two/q> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .']
    with pytest.raises(TypingError):
        m.templates.find("a:T")


def test_sources(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa

    (tmp_path / "one.stottr").write_text(P + "ex:T [xsd:anyURI ?s, ?v] :: { ottr:Triple(?s, ex:v, ?v) } .")
    (tmp_path / "note.txt").write_text("no template")
    rows = {"s": ["http://s/1", "http://s/2"], "v": [1, 2]}
    for paths in ((str(tmp_path),), (str(tmp_path / "one.stottr"),)):
        made = []
        for frame in (pd.DataFrame(rows), pa.table(rows), spark.createDataFrame(pd.DataFrame(rows))):
            m = Mapping.from_files(*paths, spark=spark)
            m.expand("ex:T", frame)
            made.append(lines(m))
        assert made[0] == made[1] == made[2] and len(made[0]) == 2


def test_fractions_of_seconds(spark):
    m = Mapping(P + "ex:T [xsd:anyURI ?s, ?a, ?b] :: { ottr:Triple(?s, ex:a, ?a), ottr:Triple(?s, ex:b, ?b) } .", spark=spark)
    m.expand("ex:T", spark.sql("SELECT concat('http://s/', i) s, timestamp_ntz '2031-01-02 03:04:10' + i * interval '0.0001' second a, timestamp '2031-01-02 03:04:10' + i * interval '0.0001' second b FROM VALUES (0), (1), (5000) t(i)"))
    got = sorted((r.predicate[-1], r.object) for r in m.triples().collect())
    assert got == sorted((p, f"2031-01-02T03:04:10{f}{z}") for p, z in (("a", ""), ("b", "Z")) for f in ("", ".000100", ".500"))
