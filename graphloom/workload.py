"""The driver's tables as graphs, and queries over them with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .api import Mapping
from .sources.tables import shared_folder

D, V = "http://d.example/", "http://d.example/v#"
PREFIXES = f"PREFIX v: <{V}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX d: <{D}>\n"


def iri(table: str, *keys: str) -> Column:
    return F.concat(F.lit(f"{D}{table}/"), *[c for i, k in enumerate(keys) for c in ([F.lit("-")] if i else []) + [F.col(k).cast("string")]])


#: table -> (subject, IRI columns, literal columns); each as (predicate, column).
SHAPES: dict[str, tuple[Callable[[], Column], list[tuple[str, Callable[[], Column]]], list[tuple[str, str]]]] = {
    "region": (lambda: iri("region", "r_regionkey"), [], [("r_name", "r_name")]),
    "nation": (lambda: iri("nation", "n_nationkey"), [("region", lambda: iri("region", "n_regionkey"))], [("n_name", "n_name")]),
    "customer": (lambda: iri("customer", "c_custkey"), [("nation", lambda: iri("nation", "c_nationkey"))], [("c_name", "c_name"), ("acctbal", "c_acctbal"), ("segment", "c_mktsegment")]),
    "supplier": (lambda: iri("supplier", "s_suppkey"), [("snation", lambda: iri("nation", "s_nationkey"))], [("s_name", "s_name"), ("s_acctbal", "s_acctbal")]),
    "part": (lambda: iri("part", "p_partkey"), [], [("p_name", "p_name"), ("brand", "p_brand"), ("ptype", "p_type"), ("psize", "p_size"), ("price", "p_retailprice")]),
    "orders": (lambda: iri("orders", "o_orderkey"), [("customer", lambda: iri("customer", "o_custkey"))], [("status", "o_orderstatus"), ("total", "o_totalprice"), ("odate", "o_orderdate"), ("priority", "o_orderpriority")]),
    "lineitem": (
        lambda: F.concat(iri("lineitem", "l_orderkey", "l_linenumber"), F.lit("-"), F.md5(F.concat_ws("|", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))),
        [("order", lambda: iri("orders", "l_orderkey")), ("lpart", lambda: iri("part", "l_partkey")), ("lsupp", lambda: iri("supplier", "l_suppkey"))],
        [("line", "l_linenumber"), ("quantity", "l_quantity"), ("extended", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax"), ("rflag", "l_returnflag"), ("lstatus", "l_linestatus"), ("shipdate", "l_shipdate")],
    ),
    "events": (lambda: iri("event", "event_id"), [], [("ts", "ts"), ("user", "user_id"), ("etype", "event_type"), ("value", "value")]),
    "documents": (lambda: iri("doc", "doc_id"), [], [("doc_id", "doc_id"), ("text", "text"), ("lang", "lang"), ("n_chars", "n_chars")]),
    "labels": (lambda: iri("doc", "doc_id"), [], [("quality", "quality"), ("toxic", "toxic")]),
    "conversations": (lambda: iri("turn", "conv_id", "turn"), [("next", lambda: F.concat(F.lit(f"{D}turn/"), F.col("conv_id"), F.lit("-"), F.col("turn") + 1))], [("role", "role"), ("turn", "turn")]),
}


def template(table: str) -> str:
    _, iris, literals = SHAPES[table]
    params = ["xsd:anyURI ?id", *[f"? xsd:anyURI ?{p}" for p, _ in iris], *[f"? ?{p}" for p, _ in literals]]
    body = [f"ottr:Triple(?id, v:{p}, ?{p})" for p, _ in [*iris, *literals]]
    return f"@prefix v: <{V}> . @prefix d: <{D}> .\nd:{table} [{', '.join(params)}] :: {{ {', '.join(body)} }} ."


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    subject, iris, literals = SHAPES[table]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "conversations":  # the last turn of a conversation has no next one
        last = df.groupBy("conv_id").agg(F.max("turn").alias("last"))
        df = df.join(last, "conv_id")
        iris = [(p, (lambda f: lambda: F.when(F.col("turn") < F.col("last"), f()))(f)) for p, f in iris]
    return df.select(subject().alias("id"), *[f().alias(p) for p, f in iris], *[F.col(c).alias(p) for p, c in literals])


def graph(spark: SparkSession, sf_dir: str, *tables: str) -> Mapping:
    mapping = Mapping([template(t) for t in tables], spark=spark)
    for t in tables:
        mapping.expand(D + t, source(spark, sf_dir, t), unique_subset=["id"], validate=False)
    return mapping


def _sparql(tables: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: graph(spark, sf_dir, *tables.split()).query(PREFIXES + text)


def _id(table: str, *keys: str) -> str:
    return f"'{D}{table}/' || " + " || '-' || ".join(keys)


N, C, O, S = _id("nation", "n_nationkey"), _id("customer", "c_custkey"), _id("orders", "o_orderkey"), _id("supplier", "s_suppkey")
R, P, E, DOC = _id("region", "r_regionkey"), _id("part", "p_partkey"), _id("event", "event_id"), _id("doc", "doc_id")
_NEXT = "WITH t AS (SELECT conv_id, turn FROM conversations)"

#: name -> (tables of the graph, SPARQL, SQL)
SPARQL: dict[str, tuple[str, str, str]] = {
    "bgp_scan": ("nation", "SELECT ?n ?name { ?n v:n_name ?name }", f"SELECT {N} AS n, n_name AS name FROM nation"),
    "bgp_const_object": ("nation region", f"SELECT ?n {{ ?n v:region <{D}region/1> }}", f"SELECT {N} AS n FROM nation WHERE n_regionkey = 1"),
    "bgp_const_subject": ("nation", f"SELECT ?name ?r {{ <{D}nation/3> v:n_name ?name ; v:region ?r }}", f"SELECT n_name AS name, '{D}region/' || n_regionkey AS r FROM nation WHERE n_nationkey = 3"),
    "bgp_chain_join": ("customer nation region", 'SELECT ?c ?rn { ?c v:nation ?n . ?n v:region ?r . ?r v:r_name ?rn }', f"SELECT {C} AS c, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "bgp_star_join": ("lineitem", "SELECT ?f ?s (SUM(?q) AS ?sum_q) (COUNT(*) AS ?n) { ?l v:rflag ?f ; v:lstatus ?s ; v:quantity ?q } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sum_q, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "bgp_same_variable": ("customer nation", "SELECT ?x (COUNT(*) AS ?n) { ?c v:nation ?x . ?x v:region ?x2 . FILTER(?x2 != ?x) } GROUP BY ?x", f"SELECT '{D}nation/' || c_nationkey AS x, count(*) AS n FROM customer GROUP BY 1"),
    "cross_product": ("region", "SELECT ?a ?b { ?a v:r_name ?x . ?b v:r_name ?y }", f"SELECT '{D}region/' || a.r_regionkey AS a, '{D}region/' || b.r_regionkey AS b FROM region a, region b"),
    "filter_logic": ("customer", 'SELECT ?c { ?c v:acctbal ?b ; v:segment ?s FILTER((?b > 5000 || ?s = "BUILDING") && !(?b >= 9000)) }', f"SELECT {C} AS c FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') AND NOT c_acctbal >= 9000"),
    "filter_in": ("customer", 'SELECT ?c { ?c v:segment ?s FILTER(?s IN ("BUILDING", "MACHINERY")) }', f"SELECT {C} AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_not_in": ("part", "SELECT ?p { ?p v:psize ?s FILTER(?s NOT IN (1, 2, 3)) }", f"SELECT {P} AS p FROM part WHERE p_size NOT IN (1, 2, 3)"),
    "filter_not_equal": ("orders", 'SELECT ?o { ?o v:status ?s FILTER(?s != "F") }', f"SELECT {O} AS o FROM orders WHERE o_orderstatus <> 'F'"),
    "bind_arith": ("part", "SELECT ?p ?a ?b { ?p v:psize ?s ; v:price ?x BIND(?s * 2 + 1 - 3 AS ?a) BIND(ROUND(?x * 1.0e0 + ?s) AS ?b) }", f"SELECT {P} AS p, CAST(p_size * 2 + 1 - 3 AS BIGINT) AS a, floor(p_retailprice * 1.0 + p_size + 0.5) AS b FROM part"),
    "unary_minus": ("part", "SELECT ?p (-?s AS ?m) (+?s AS ?k) { ?p v:psize ?s }", f"SELECT {P} AS p, -p_size AS m, p_size AS k FROM part"),
    "divide_double": ("part", "SELECT ?p (?s / 4 AS ?q) (?s / 0 AS ?z) { ?p v:psize ?s }", f"SELECT {P} AS p, p_size / 4.0 AS q, CAST(NULL AS DOUBLE) AS z FROM part"),
    "if_coalesce_bound": ("documents labels", 'SELECT ?d ?x ?y ?z { ?d v:n_chars ?n OPTIONAL { ?d v:quality ?q } BIND(IF(BOUND(?q), "yes", "no") AS ?x) BIND(COALESCE(?q, -1) AS ?y) BIND(BOUND(?q) AS ?z) }', f"SELECT {_id('doc', 'd.doc_id')} AS d, CASE WHEN quality IS NOT NULL THEN 'yes' ELSE 'no' END AS x, CAST(coalesce(quality, -1) AS BIGINT) AS y, quality IS NOT NULL AS z FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "fn_date_parts": ("orders", "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) { ?o v:odate ?d }", f"SELECT {O} AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS k FROM orders"),
    "fn_time_parts": ("events", "SELECT ?e (HOURS(?t) AS ?h) (MINUTES(?t) AS ?m) (SECONDS(?t) AS ?s) { ?e v:ts ?t }", f"SELECT {E} AS e, hour(ts) AS h, minute(ts) AS m, second(ts) AS s FROM events"),
    "fn_math": ("customer", "SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?u) (FLOOR(?b) AS ?l) (ROUND(?b) AS ?r) { ?c v:acctbal ?b }", f"SELECT {C} AS c, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS u, CAST(floor(c_acctbal) AS BIGINT) AS l, floor(c_acctbal + 0.5) AS r FROM customer"),
    "fn_concat": ("nation", 'SELECT ?n (CONCAT(?x, "-", STR(?n)) AS ?c) { ?n v:n_name ?x }', f"SELECT {N} AS n, n_name || '-' || {N} AS c FROM nation"),
    "fn_casts": ("part", 'SELECT ?p (xsd:integer(?x) AS ?i) (xsd:string(?s) AS ?t) (xsd:integer(?b) AS ?bad) (xsd:double(STR(?s)) AS ?f) { ?p v:psize ?s ; v:price ?x ; v:brand ?b }', f"SELECT {P} AS p, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS t, CAST(NULL AS BIGINT) AS bad, CAST(p_size AS DOUBLE) AS f FROM part"),
    "fn_strings": ("part", 'SELECT ?p (UCASE(?n) AS ?u) (LCASE(?n) AS ?l) (STRLEN(?n) AS ?k) (SUBSTR(?n, 2, 3) AS ?s) (STRBEFORE(?b, "#") AS ?x) (STRAFTER(?b, "#") AS ?y) (CONTAINS(?n, "a") AS ?h) { ?p v:p_name ?n ; v:brand ?b }', f"SELECT {P} AS p, upper(p_name) AS u, lower(p_name) AS l, length(p_name) AS k, substr(p_name, 2, 3) AS s, CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END AS x, CASE WHEN contains(p_brand, '#') THEN substr(p_brand, instr(p_brand, '#') + 1) ELSE '' END AS y, contains(p_name, 'a') AS h FROM part"),
    "fn_regex_replace": ("customer", 'SELECT ?c (REPLACE(?n, "#0*", "-") AS ?r) (STRSTARTS(?n, "Customer") AS ?s) (STRENDS(?n, "1") AS ?e) { ?c v:c_name ?n FILTER REGEX(?n, "1[0-9]$") }', f"SELECT {C} AS c, regexp_replace(c_name, '#0*', '-') AS r, starts_with(c_name, 'Customer') AS s, ends_with(c_name, '1') AS e FROM customer WHERE regexp_matches(c_name, '1[0-9]$')"),
    "fn_hashes": ("nation", "SELECT ?n (MD5(?x) AS ?a) (SHA256(?x) AS ?b) (SHA1(?x) AS ?c) { ?n v:n_name ?x }", f"SELECT {N} AS n, md5(n_name) AS a, sha256(n_name) AS b, sha1(n_name) AS c FROM nation"),
    "fn_term_kinds": ("nation", "SELECT ?n (isIRI(?n) AS ?i) (isLiteral(?x) AS ?l) (isNumeric(?x) AS ?m) (STR(DATATYPE(?x)) AS ?d) (sameTerm(?n, ?x) AS ?s) { ?n v:n_name ?x }", f"SELECT {N} AS n, true AS i, true AS l, false AS m, 'http://www.w3.org/2001/XMLSchema#string' AS d, false AS s FROM nation"),
    "optional": ("customer orders", 'SELECT ?c ?o { ?c v:segment ?s OPTIONAL { ?o v:customer ?c ; v:priority "1-URGENT" } }', f"SELECT {C} AS c, '{D}orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'"),
    "optional_filter": ("customer orders", "SELECT ?c ?t { ?c v:acctbal ?b OPTIONAL { ?o v:customer ?c ; v:total ?t FILTER(?t > 200000 && ?b > 0) } }", f"SELECT {C} AS c, o_totalprice AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 AND c_acctbal > 0"),
    "optional_duplicates": ("nation customer", "SELECT ?r ?s { ?n v:region ?r OPTIONAL { ?c v:nation ?n ; v:segment ?s } }", f"SELECT '{D}region/' || n_regionkey AS r, c_mktsegment AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey"),
    "union_bag": ("customer supplier", "SELECT ?n { { ?x v:nation ?n } UNION { ?x v:snation ?n } }", f"SELECT '{D}nation/' || c_nationkey AS n FROM customer UNION ALL SELECT '{D}nation/' || s_nationkey FROM supplier"),
    "union_different_vars": ("customer supplier", "SELECT ?x ?b ?s { { ?x v:acctbal ?b } UNION { ?x v:s_name ?s } }", f"SELECT {C} AS x, c_acctbal AS b, NULL AS s FROM customer UNION ALL SELECT {S}, NULL, s_name FROM supplier"),
    "minus": ("customer orders", 'SELECT ?c { ?c v:segment ?s MINUS { ?o v:customer ?c ; v:priority "1-URGENT" } }', f"SELECT {C} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "minus_disjoint": ("region nation", "SELECT ?r { ?r v:r_name ?x MINUS { ?n v:n_name ?y } }", f"SELECT {R} AS r FROM region"),
    "exists": ("customer orders", 'SELECT ?c { ?c v:segment ?s FILTER EXISTS { ?o v:customer ?c ; v:priority "1-URGENT" } }', f"SELECT {C} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "not_exists": ("documents labels", "SELECT ?d { ?d v:lang ?l FILTER NOT EXISTS { ?d v:quality ?q } }", f"SELECT {_id('doc', 'd.doc_id')} AS d FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "exists_in_or": ("documents labels", 'SELECT ?d { ?d v:lang ?l FILTER(?l = "fr" || EXISTS { ?d v:toxic 1 }) }', f"SELECT {_id('doc', 'd.doc_id')} AS d FROM documents d WHERE lang = 'fr' OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)"),
    "exists_correlated_filter": ("customer orders", "SELECT ?c { ?c v:acctbal ?b FILTER EXISTS { ?o v:customer ?c ; v:total ?t FILTER(?t > ?b * 50) } }", f"SELECT {C} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)"),
    "values_join": ("nation", f'SELECT ?n ?k {{ VALUES (?n ?k) {{ (<{D}nation/1> 10) (<{D}nation/2> 20) (<{D}nation/99> 30) }} ?n v:n_name ?x }}', f"SELECT '{D}nation/1' AS n, CAST(10 AS BIGINT) AS k UNION ALL SELECT '{D}nation/2', 20"),
    "values_undef": ("nation", f'SELECT ?n ?r ?k {{ ?n v:region ?r VALUES (?r ?k) {{ (<{D}region/1> 1) (UNDEF 2) }} }}', f"SELECT {N} AS n, '{D}region/' || n_regionkey AS r, CAST(k AS BIGINT) AS k FROM nation, (VALUES (1), (2)) t(k) WHERE k = 2 OR n_regionkey = 1"),
    "order_limit_offset": ("customer", "SELECT ?c ?b { ?c v:acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 20 OFFSET 5", f"SELECT {C} AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, {C} LIMIT 20 OFFSET 5"),
    "distinct": ("customer nation", "SELECT DISTINCT ?r ?s { ?c v:nation ?n ; v:segment ?s . ?n v:region ?r }", f"SELECT DISTINCT '{D}region/' || n_regionkey AS r, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "reduced": ("nation", "SELECT REDUCED ?n { ?n v:n_name ?x }", f"SELECT {N} AS n FROM nation"),
    "group_basic": ("orders", "SELECT ?p (COUNT(?o) AS ?n) (MAX(?t) AS ?m) { ?o v:priority ?p ; v:total ?t } GROUP BY ?p", "SELECT o_orderpriority AS p, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1"),
    "group_count_star": ("customer", "SELECT ?s (COUNT(*) AS ?n) (COUNT(DISTINCT *) AS ?k) { ?c v:segment ?s } GROUP BY ?s", "SELECT c_mktsegment AS s, count(*) AS n, count(*) AS k FROM customer GROUP BY 1"),
    "group_count_distinct": ("customer", "SELECT ?s (COUNT(DISTINCT ?n) AS ?k) { ?c v:segment ?s ; v:nation ?n } GROUP BY ?s", "SELECT c_mktsegment AS s, count(DISTINCT c_nationkey) AS k FROM customer GROUP BY 1"),
    "group_avg_minmax": ("part", "SELECT ?b (ROUND(AVG(?s) * 1000) AS ?a) (MIN(?s) AS ?l) (MAX(?s) AS ?u) (SUM(?s) AS ?t) (SUM(DISTINCT ?s) AS ?d) { ?p v:brand ?b ; v:psize ?s } GROUP BY ?b", "SELECT p_brand AS b, floor(avg(p_size) * 1000 + 0.5) AS a, min(p_size) AS l, max(p_size) AS u, CAST(sum(p_size) AS BIGINT) AS t, CAST(sum(DISTINCT p_size) AS BIGINT) AS d FROM part GROUP BY 1"),
    "group_having": ("customer", "SELECT ?n (COUNT(*) AS ?k) { ?c v:nation ?n } GROUP BY ?n HAVING (COUNT(*) > 60)", f"SELECT '{D}nation/' || c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1 HAVING count(*) > 60"),
    "group_none": ("customer", "SELECT (COUNT(*) AS ?n) (MIN(?b) AS ?l) { ?c v:acctbal ?b }", "SELECT count(*) AS n, min(c_acctbal) AS l FROM customer"),
    "group_concat_distinct": ("customer", 'SELECT ?n (GROUP_CONCAT(DISTINCT ?s; SEPARATOR="|") AS ?g) { ?c v:nation ?n ; v:segment ?s } GROUP BY ?n', f"SELECT '{D}nation/' || c_nationkey AS n, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS g FROM customer GROUP BY 1"),
    "group_sample": ("customer nation", "SELECT ?n (SAMPLE(?x) AS ?one) { ?c v:nation ?n . ?n v:n_name ?x } GROUP BY ?n", f"SELECT DISTINCT {N} AS n, n_name AS one FROM nation JOIN customer ON c_nationkey = n_nationkey"),
    "group_expression": ("orders", "SELECT ?y (COUNT(*) AS ?n) { ?o v:odate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "subselect": ("customer nation", "SELECT ?x ?k { ?n v:n_name ?x { SELECT ?n (COUNT(*) AS ?k) { ?c v:nation ?n } GROUP BY ?n } }", "SELECT n_name AS x, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "path_sequence": ("customer nation region", "SELECT ?c ?x { ?c v:nation/v:region/v:r_name ?x }", f"SELECT {C} AS c, r_name AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inverse": ("nation region", "SELECT ?r ?n { ?r ^v:region ?n }", f"SELECT '{D}region/' || n_regionkey AS r, {N} AS n FROM nation"),
    "path_alternative": ("customer supplier", "SELECT ?x ?n { ?x (v:nation|v:snation) ?n }", f"SELECT {C} AS x, '{D}nation/' || c_nationkey AS n FROM customer UNION SELECT {S}, '{D}nation/' || s_nationkey FROM supplier"),
    "path_optional": ("nation", "SELECT ?a ?b { ?a v:region? ?b FILTER(isIRI(?b) && STRSTARTS(STR(?a), STR(d:nation))) }", f"SELECT {N} AS a, {N} AS b FROM nation UNION SELECT {N}, '{D}region/' || n_regionkey FROM nation"),
    "path_negated": ("nation region", "SELECT ?a ?b { ?a !(v:region|v:r_name) ?b }", f"SELECT {N} AS a, n_name AS b FROM nation"),
    "path_plus": ("conversations", "SELECT ?a ?b { ?a v:next+ ?b }", f"{_NEXT} SELECT '{D}turn/' || a.conv_id || '-' || a.turn AS a, '{D}turn/' || b.conv_id || '-' || b.turn AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn"),
    "path_star": ("conversations", "SELECT ?a ?b { ?a v:role ?x . ?a v:next* ?b }", f"{_NEXT} SELECT '{D}turn/' || a.conv_id || '-' || a.turn AS a, '{D}turn/' || b.conv_id || '-' || b.turn AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <= b.turn"),
    "path_plus_const_start": ("conversations", f"SELECT ?b {{ <{D}turn/1-0> v:next+ ?b }}", f"SELECT '{D}turn/1-' || turn AS b FROM conversations WHERE conv_id = 1 AND turn > 0"),
    "predicate_variable": ("nation region", "SELECT ?s ?p ?o { ?s ?p ?o }", f"SELECT {N} AS s, '{V}n_name' AS p, n_name AS o FROM nation UNION ALL SELECT {N}, '{V}region', '{D}region/' || n_regionkey FROM nation UNION ALL SELECT {R}, '{V}r_name', r_name FROM region"),
    "unknown_predicate": ("nation", "SELECT ?n ?x { ?n v:region ?r OPTIONAL { ?n v:nowhere ?x } }", f"SELECT {N} AS n, CAST(NULL AS VARCHAR) AS x FROM nation"),
    "decimal_sums": ("part", "SELECT ?z (STR(SUM(xsd:decimal(STR(?x)) + 0.1)) AS ?total) { ?p v:psize ?z ; v:price ?x } GROUP BY ?z", "SELECT p_size AS z, rtrim(rtrim(CAST(sum(CAST(CAST(p_retailprice AS VARCHAR) AS DECIMAL(18,4)) + 0.1) AS VARCHAR), '0'), '.') AS total FROM part GROUP BY p_size"),
    "time_terms": ("events", "SELECT ?e (STR(DATATYPE(?t)) AS ?d) (STR(?t) AS ?s) { ?e v:ts ?t }", f"SELECT {E} AS e, 'http://www.w3.org/2001/XMLSchema#dateTime' AS d, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '(\\.000000|000)$', '') AS s FROM events"),
    "type_error_filter": ("nation", "SELECT ?n { ?n v:n_name ?x FILTER(?x > 5 || ?x = 3) }", f"SELECT {N} AS n FROM nation WHERE false"),
    "tpch_q1_like": ("lineitem", "SELECT ?f ?s (SUM(?q) AS ?sum_qty) (ROUND(SUM(?x)) AS ?base) (ROUND(SUM(?x * (1 - ?d))) AS ?disc) (ROUND(AVG(?q) * 100) AS ?avg_qty) (COUNT(*) AS ?n) { ?l v:rflag ?f ; v:lstatus ?s ; v:quantity ?q ; v:extended ?x ; v:discount ?d ; v:shipdate ?t FILTER(?t <= \"1998-09-02T00:00:00\"^^xsd:dateTime) } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sum_qty, floor(sum(l_extendedprice) + 0.5) AS base, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS disc, floor(avg(l_quantity) * 100 + 0.5) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "tpch_q3_like": ("lineitem orders customer", 'SELECT ?o (ROUND(SUM(?x * (1 - ?d)) * 100) AS ?rev) { ?c v:segment "BUILDING" . ?o v:customer ?c ; v:odate ?od . ?l v:order ?o ; v:extended ?x ; v:discount ?d ; v:shipdate ?sd FILTER(?od < "1995-03-15T00:00:00"^^xsd:dateTime && ?sd > "1995-03-15T00:00:00"^^xsd:dateTime) } GROUP BY ?o', f"SELECT {O} AS o, floor(sum(l_extendedprice * (1 - l_discount)) * 100 + 0.5) AS rev FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY 1"),
    "tpch_q5_like": ("lineitem orders customer nation region supplier", 'SELECT ?nn (ROUND(SUM(?x * (1 - ?d))) AS ?rev) { ?r v:r_name "ASIA" . ?n v:region ?r ; v:n_name ?nn . ?c v:nation ?n . ?o v:customer ?c . ?l v:order ?o ; v:lsupp ?s ; v:extended ?x ; v:discount ?d . ?s v:snation ?n } GROUP BY ?nn', "SELECT n_name AS nn, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS rev FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1"),
    "tpch_q6_like": ("lineitem", "SELECT (ROUND(SUM(?x * ?d) * 100) AS ?rev) { ?l v:extended ?x ; v:discount ?d ; v:quantity ?q FILTER(?d >= 0.05 && ?d <= 0.07 && ?q < 24) }", "SELECT floor(sum(l_extendedprice * l_discount) * 100 + 0.5) AS rev FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24"),
}
FLAGSHIP = "tpch_q5_like"

_T = f"@prefix v: <{V}> . @prefix d: <{D}> .\n"


def _triples(mapping: Mapping) -> DataFrame:
    return mapping.triples().select("subject", "predicate", "object", "datatype")


def expand_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(graph(spark, sf_dir, "nation"))


def expand_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping([_T + "d:Outer [xsd:anyURI ?s, ?name] :: { d:Inner(?s, ?name, \"fixed\"), ottr:Triple(?s, rdf:type, d:Nation) } . d:Inner [?s, ?x, ?y] :: { ottr:Triple(?s, v:name, ?x), ottr:Triple(?s, v:tag, ?y) } ."], spark=spark)
    m.expand(D + "Outer", spark.read.parquet(f"{sf_dir}/nation.parquet").select(iri("nation", "n_nationkey").alias("s"), F.col("n_name").alias("name")))
    return _triples(m).select("subject", "predicate", "object")


def expand_optional_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping([_T + "d:Doc [xsd:anyURI ?s, ? ?q, ?lang = \"none\"] :: { ottr:Triple(?s, v:quality, ?q), ottr:Triple(?s, v:lang, ?lang) } ."], spark=spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id", "left").select(iri("doc", "doc_id").alias("s"), F.col("quality").alias("q"), F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    m.expand(D + "Doc", rows)
    return _triples(m).select("subject", "predicate", "object")


def expand_default_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping(spark=spark)
    m.expand_default(spark.read.parquet(f"{sf_dir}/orders.parquet").select(iri("orders", "o_orderkey").alias("o"), iri("customer", "o_custkey").alias("customer"), F.col("o_orderstatus").alias("status")), "o", ["customer"], predicate_uri_prefix=V)
    return _triples(m).select("subject", "predicate", "object")


def _lists(expander: str, body: str) -> Callable[[SparkSession, str], DataFrame]:
    """Lists of all words up to half of each text and from there on."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = Mapping([_T + f"d:L [xsd:anyURI ?s, ? ?a, ? ?b] :: {{ {expander} | {body} }} . d:Pair [? ?s, ? ?x, ? ?y] :: {{ ottr:Triple(?s, v:x, ?x), ottr:Triple(?s, v:y, ?y) }} ."], spark=spark)
        words = F.split("text", " ")
        half = F.floor(F.size(words) / 2).cast("int")
        a, b = F.slice(words, F.lit(1), half), F.slice(words, half + 1, F.size(words) - half)
        rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(iri("doc", "doc_id").alias("s"), a.alias("a"), b.alias("b"))
        m.expand(D + "L", rows)
        return _triples(m).select("subject", "predicate", "object")

    return run


def expand_const_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping([_T + "d:L [xsd:anyURI ?s] :: { cross | ottr:Triple(?s, v:n, ++ (1, 2, 3)) } ."], spark=spark)
    m.expand(D + "L", spark.read.parquet(f"{sf_dir}/region.parquet").select(iri("region", "r_regionkey").alias("s")))
    return _triples(m)


def expand_dynamic_verb(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping([_T + "d:E [xsd:anyURI ?s, xsd:anyURI ?p, ?o] :: { ottr:Triple(?s, ?p, ?o) } ."], spark=spark)
    m.expand(D + "E", spark.read.parquet(f"{sf_dir}/events.parquet").select(iri("event", "event_id").alias("s"), F.concat(F.lit(V), "event_type").alias("p"), F.col("user_id").alias("o")), unique_subset=["s"])
    return _triples(m).select("subject", "predicate", "object")


def tagged(spark: SparkSession, sf_dir: str) -> Mapping:
    m = Mapping([_T + "d:T [xsd:anyURI ?s, ?text] :: { ottr:Triple(?s, v:text, ?text) } ."], spark=spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for lang in ("en", "fr", "de", "es"):
        m.expand(D + "T", docs.where(F.col("lang") == lang).select(iri("doc", "doc_id").alias("s"), "text"), unique_subset=["s"], language_tags={"text": lang}, validate=False)
    return m


def expand_language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).triples().select("subject", F.md5("object").alias("text_md5"), "datatype", "language")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).query(PREFIXES + 'SELECT ?d (STRLEN(?t) AS ?n) (LANG(?t) AS ?l) { ?d v:text ?t FILTER(langMatches(LANG(?t), "fr") || LANG(?t) = "de") }')


def multi_typed_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping([_T + "d:A [xsd:anyURI ?s, ?o] :: { ottr:Triple(?s, v:any, ?o) } ."], spark=spark)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    for c in ("p_size", "p_brand", "p_retailprice"):
        m.expand(D + "A", parts.select(iri("part", "p_partkey").alias("s"), F.col(c).alias("o")), unique_subset=["s"])
    return m.query(PREFIXES + "SELECT ?s ?o { ?s v:any ?o FILTER(?o < 10 || isIRI(?o) || STRLEN(STR(?o)) > 7) FILTER(!isNumeric(?o) || ?o < 10) }")


def ntriples_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "nation", "region").ntriples()


def construct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = graph(spark, sf_dir, "customer", "nation").query(PREFIXES + "CONSTRUCT { ?c v:livesIn ?r . ?r v:home ?s } WHERE { ?c v:nation ?n ; v:segment ?s . ?n v:region ?r }")
    return a.unionByName(b)


def construct_update_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph(spark, sf_dir, "customer", "nation")
    m.construct_update(PREFIXES + "CONSTRUCT { ?c v:livesIn ?r } WHERE { ?c v:nation/v:region ?r }")
    return m.query(PREFIXES + "SELECT ?r (COUNT(?c) AS ?n) { ?c v:livesIn ?r } GROUP BY ?r")


def ask_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph(spark, sf_dir, "nation")
    return spark.createDataFrame([(m.query(PREFIXES + f"ASK {{ ?n v:region <{D}region/{k}> }}"), k) for k in (1, 77)], "answer boolean, k int")


def native_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported tables, read again."""
    folder = shared_folder(spark)
    graph(spark, sf_dir, "orders").write_native_parquet(folder)
    xsd = "httpwwww3org2001XMLSchema"
    read = lambda predicate, kind: spark.read.parquet(f"{folder}/{predicate}_{kind}.parquet")
    totals = read("httpdexamplevtotal", f"{xsd}double").withColumnRenamed("object", "total")
    customers = read("httpdexamplevcustomer", "object_property").withColumnRenamed("object", "customer")
    return totals.join(customers, "subject")


def ntriples_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported lines, read again."""
    folder = shared_folder(spark)
    graph(spark, sf_dir, "events").write_ntriples(folder)
    return spark.read.text(folder).where(F.contains("value", F.lit(f"<{V}ts>"))).withColumnRenamed("value", "line")


def cached_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping(template("supplier"), caching_folder=shared_folder(spark), spark=spark)
    m.expand(D + "supplier", source(spark, sf_dir, "supplier"), unique_subset=["id"])
    return m.query(PREFIXES + "SELECT ?n (COUNT(*) AS ?k) { ?s v:snation ?n ; v:s_acctbal ?b FILTER(?b > 0) } GROUP BY ?n")


def pandas_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the five regions, as a pandas frame."""
    m = Mapping(template("region"), spark=spark)
    m.expand(D + "region", source(spark, sf_dir, "region").toPandas())
    return m.query(PREFIXES + "SELECT ?r ?n { ?r v:r_name ?n }")


def blank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping([_T + "d:S [xsd:anyURI ?s, xsd:anyURI ?nation, ?name] :: { ottr:Triple(?s, v:seat, _:seat), ottr:Triple(_:seat, v:in, ?nation), ottr:Triple(_:seat, v:of, ?name) } ."], spark=spark)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(iri("supplier", "s_suppkey").alias("s"), iri("nation", "s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    m.expand(D + "S", rows, unique_subset=["s"])
    return m.query(PREFIXES + "SELECT ?s ?nation ?name { ?s v:seat ?x . ?x v:in ?nation ; v:of ?name FILTER(isBlank(?x)) }")


def construct_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph(spark, sf_dir, "nation")
    m.construct_update(PREFIXES + "CONSTRUCT { _:b v:inRegion ?r . _:b v:called ?x } WHERE { ?c v:region ?r ; v:n_name ?x }")
    return m.query(PREFIXES + "SELECT ?r ?x { ?b v:inRegion ?r ; v:called ?x FILTER(isBlank(?b)) }")


def column_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples of predicates that come from a column, counted by these."""
    m = Mapping([_T + "d:E [xsd:anyURI ?s, xsd:anyURI ?p, ?o] :: { ottr:Triple(?s, ?p, ?o) } ."], spark=spark)
    m.expand(D + "E", spark.read.parquet(f"{sf_dir}/events.parquet").select(iri("user", "user_id").alias("s"), F.concat(F.lit(V), "event_type").alias("p"), F.col("value").alias("o")))
    return m.query(PREFIXES + "SELECT ?p (COUNT(*) AS ?n) (MAX(?o) AS ?top) { ?s ?p ?o } GROUP BY ?p")


_HALVES = f"WITH w AS (SELECT {DOC} AS s, string_split(text, ' ') AS w FROM documents), z AS (SELECT s, list_slice(w, 1, len(w) // 2) AS a, list_slice(w, len(w) // 2 + 1, len(w)) AS b FROM w)"

CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "expand_basic": (expand_basic, f"SELECT {N} AS subject, '{V}region' AS predicate, '{D}region/' || n_regionkey AS object, '' AS datatype FROM nation UNION ALL SELECT {N}, '{V}n_name', n_name, 'http://www.w3.org/2001/XMLSchema#string' FROM nation"),
    "expand_nested": (expand_nested, f"SELECT {N} AS subject, '{V}name' AS predicate, n_name AS object FROM nation UNION ALL SELECT {N}, '{V}tag', 'fixed' FROM nation UNION ALL SELECT {N}, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{D}Nation' FROM nation"),
    "expand_optional_null": (expand_optional_null, f"SELECT {DOC} AS subject, '{V}quality' AS predicate, CAST(quality AS VARCHAR) AS object FROM labels UNION ALL SELECT {DOC}, '{V}lang', CASE WHEN lang = 'en' THEN 'none' ELSE lang END FROM documents"),
    "expand_default_fk": (expand_default_fk, f"SELECT {O} AS subject, '{V}customer' AS predicate, '{D}customer/' || o_custkey AS object FROM orders UNION ALL SELECT {O}, '{V}status', o_orderstatus FROM orders"),
    "expand_cross_list": (_lists("cross", "d:Pair(?s, ++ ?a, ++ ?b)"), _HALVES + f" SELECT DISTINCT s AS subject, '{V}x' AS predicate, x AS object FROM (SELECT s, unnest(a) AS x FROM z) UNION ALL SELECT DISTINCT s, '{V}y', y FROM (SELECT s, unnest(b) AS y FROM z)"),
    "expand_zip_min": (_lists("zipMin", "d:Pair(?s, ++ ?a, ++ ?b)"), _HALVES + f" SELECT DISTINCT s AS subject, '{V}x' AS predicate, x AS object FROM (SELECT s, unnest(a[1:least(len(a), len(b))]) AS x FROM z WHERE len(a) > 0 AND len(b) > 0) UNION ALL SELECT DISTINCT s, '{V}y', y FROM (SELECT s, unnest(b[1:least(len(a), len(b))]) AS y FROM z WHERE len(a) > 0 AND len(b) > 0)"),
    "expand_zip_max": (_lists("zipMax", "d:Pair(?s, ++ ?a, ++ ?b)"), _HALVES + f" SELECT DISTINCT s AS subject, '{V}x' AS predicate, x AS object FROM (SELECT s, unnest(a) AS x FROM z) UNION ALL SELECT DISTINCT s, '{V}y', y FROM (SELECT s, unnest(b) AS y FROM z)"),
    "expand_const_list": (expand_const_list, f"SELECT {R} AS subject, '{V}n' AS predicate, CAST(k AS VARCHAR) AS object, 'http://www.w3.org/2001/XMLSchema#integer' AS datatype FROM region, (VALUES (1), (2), (3)) t(k)"),
    "expand_dynamic_verb": (expand_dynamic_verb, f"SELECT {E} AS subject, '{V}' || event_type AS predicate, CAST(user_id AS VARCHAR) AS object FROM events"),
    "expand_language_tags": (expand_language_tags, f"SELECT {DOC} AS subject, md5(text) AS text_md5, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS datatype, lang AS language FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')"),
    "language_query": (language_query, f"SELECT {DOC} AS d, length(text) AS n, lang AS l FROM documents WHERE lang IN ('fr', 'de')"),
    "multi_typed_predicate": (multi_typed_predicate, f"SELECT {P} AS s, CAST(p_size AS VARCHAR) AS o FROM part WHERE p_size < 10 UNION ALL SELECT {P}, p_brand FROM part WHERE length(p_brand) > 7"),
    "ntriples_lines": (ntriples_lines, f"SELECT '<' || {N} || '> <{V}n_name> \"' || n_name || '\" .' AS line FROM nation UNION ALL SELECT '<' || {N} || '> <{V}region> <{D}region/' || n_regionkey || '> .' FROM nation UNION ALL SELECT '<' || {R} || '> <{V}r_name> \"' || r_name || '\" .' FROM region"),
    "construct_edges": (construct_edges, f"SELECT {C} AS subject, '{V}livesIn' AS verb, '{D}region/' || n_regionkey AS object FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT DISTINCT '{D}region/' || n_regionkey, '{V}home', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "construct_update_query": (construct_update_query, f"SELECT '{D}region/' || n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "native_parquet": (native_parquet, f"SELECT {O} AS subject, o_totalprice AS total, '{D}customer/' || o_custkey AS customer FROM orders"),
    "ntriples_export": (ntriples_export, f"SELECT '<' || {E} || '> <{V}ts> \"' || regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '(\\.000000|000)$', '') || '\"^^<http://www.w3.org/2001/XMLSchema#dateTime> .' AS line FROM events"),
    "cached_rows": (cached_rows, f"SELECT '{D}nation/' || s_nationkey AS n, count(*) AS k FROM supplier WHERE s_acctbal > 0 GROUP BY 1"),
    "pandas_source": (pandas_source, f"SELECT {R} AS r, r_name AS n FROM region"),
    "blank_nodes": (blank_nodes, f"SELECT '{D}supplier/' || s_suppkey AS s, '{D}nation/' || s_nationkey AS nation, s_name AS name FROM supplier"),
    "construct_blanks": (construct_blanks, f"SELECT '{D}region/' || n_regionkey AS r, n_name AS x FROM nation"),
    "column_predicates": (column_predicates, f"SELECT '{V}' || event_type AS p, count(*) AS n, max(value) AS top FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY 1"),
    "ask_query": (ask_query, "SELECT true AS answer, 1 AS k UNION ALL SELECT false, 77"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _sparql(t, q) for n, (t, q, _) in SPARQL.items()} | {n: f for n, (f, _) in CALLS.items()}
ORACLES: dict[str, str] = {n: s for n, (_, _, s) in SPARQL.items()} | {n: s for n, (_, s) in CALLS.items()}
