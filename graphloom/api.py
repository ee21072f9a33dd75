"""Mapping: templates, a graph, and queries over it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import MappingError, UnsupportedQuery
from .functions.terms import IRI, MIXED, NONE, RDF, STRING, RdfType, ntriples, spark_type
from .operators.expand import Scope, default_template, expand, expand_instance
from .operators.store import GraphStore
from .plans import algebra
from .plans.planner import Planner
from .sources.tables import materialize
from .sources.templates import Templates, read_documents

__all__ = ["Mapping", "Triple", "Node", "to_graph"]


@dataclass(frozen=True)
class Node:
    """kind: iri, blank or literal."""

    kind: str
    value: str
    datatype: str = ""
    language: str = ""

    def __repr__(self) -> str:
        if self.kind == "literal":
            text = '"' + self.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
            return f"{text}@{self.language}" if self.language else text if self.datatype == STRING.datatype else f"{text}^^<{self.datatype}>"
        return self.value if self.kind == "blank" else f"<{self.value}>"


@dataclass(frozen=True)
class Triple:
    subject: Node
    verb: Node
    object: Node

    def __repr__(self) -> str:
        return f"{self.subject} {self.verb} {self.object}"


class Mapping:
    """A graph that is filled by templates over frames and by CONSTRUCT, and asked by SPARQL.

    ``caching_folder``: the rows of each expansion are written there as Parquet and read again, so that later queries
    do not go back to the sources."""

    def __init__(self, documents: list[str] | str | None = None, caching_folder: str | None = None, spark: SparkSession | None = None, unbound_last: bool = True):
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.templates = Templates([documents] if isinstance(documents, str) else list(documents or []))
        self.store, self.caching_folder, self.unbound_last = GraphStore(), caching_folder, unbound_last
        if self.templates.instances:
            one = self.spark.range(1).select()
            for i, instance in enumerate(self.templates.instances):
                expand_instance(self.templates, instance, Scope(one, -1 - i, {}, F.lit(0), None), self.store, f"i{i}")

    @classmethod
    def from_files(cls, *paths: str, **options) -> Mapping:
        """Of files, and all *.stottr files in folders."""
        return cls(read_documents(*paths), **options)

    def _frame(self, df) -> DataFrame:
        return df if isinstance(df, DataFrame) else self.spark.createDataFrame(df)

    def expand(self, template: str, df, unique_subset: list[str] | None = None, language_tags: dict[str, str] | None = None, caching_folder: str | None = None, validate: bool = True) -> None:
        """Adds the template's triples for each row of ``df`` (a Spark, pandas or Arrow frame).

        ``unique_subset``: columns no two rows agree on; saves de-duplication, and joins in star-shaped queries."""
        frame = self._frame(df)
        folder = caching_folder or self.caching_folder
        if missing := [c for c in (*(unique_subset or ()), *(language_tags or ())) if c not in frame.columns]:
            raise MappingError(f"there are no columns {missing}")
        if folder:
            path = f"{folder.rstrip('/')}/source_{uuid4().hex}"  # of its own, whoever else uses the folder
            frame.write.parquet(path)
            frame = self.spark.read.schema(frame.schema).parquet(path)
        expand(self.templates, self.templates.find(template), frame, self.store, unique_subset, language_tags, validate)

    def expand_default(self, df, primary_key_column: str, foreign_key_columns: list[str] | None = None, template_prefix: str | None = None, predicate_uri_prefix: str | None = None, language_tags: dict[str, str] | None = None, caching_folder: str | None = None, validate: bool = True) -> str:
        """Makes a template from the frame's columns and expands it; gives its text back."""
        frame = self._frame(df)
        prefix = template_prefix or "urn:graphloom:template:"
        predicates = predicate_uri_prefix or "urn:graphloom:predicate:"
        name = f"{prefix}default_{len([t for t in self.templates.by_iri if t.startswith(prefix + 'default_')])}"
        template = default_template(frame, primary_key_column, foreign_key_columns or [], name, predicates)
        self.templates.add(template)
        self.expand(name, frame, [primary_key_column], language_tags, caching_folder, validate)
        return str(template)

    def _planner(self) -> Planner:
        return Planner(self.spark, self.store, self.unbound_last)

    def query(self, sparql: str, raw_terms: bool = False):
        """SELECT: a frame with a column for each variable (mixed terms as text, or as structs with
        ``raw_terms``). CONSTRUCT: a frame for each triple of the template. ASK: a boolean."""
        q = algebra.parse(sparql)
        if q.form == "select":
            return self._planner().select(q, raw_terms)
        if q.form == "ask":
            return not self._planner().plan(q.pattern).frame.isEmpty()
        return [df.withColumn("object", F.col("object")["lex"]) if kind == MIXED and not raw_terms else df for df, kind in self._planner().construct(q)]

    def construct_update(self, sparql: str) -> None:
        """Adds what a CONSTRUCT makes to the graph."""
        q = algebra.parse(sparql)
        if q.form != "construct":
            raise UnsupportedQuery("only CONSTRUCT queries add to the graph")
        made = [(materialize(df), kind) for df, kind in self._planner().construct(q)]
        for df, kind in made:
            if kind == NONE:
                continue
            columns = (F.col("subject"), F.col("verb"))
            if kind != MIXED:
                self.store.add_named(kind, df, *columns, F.col("object"), None, False)
                continue
            for r in df.select("object.kind", "object.dt").distinct().collect():
                part = df.where((F.col("object.kind") == r["kind"]) & (F.col("object.dt") == r["dt"]))
                tagged = r["dt"] == RDF + "langString"
                own = IRI if r["kind"] != "literal" else STRING if tagged else RdfType("literal", r["dt"])
                value = F.col("object.lex").try_cast(spark_type(own))
                self.store.add_named(own, part, *columns, value, F.col("object.lang") if tagged else None, False)

    # ---- exports ----
    def triples(self) -> DataFrame:
        """subject, predicate, object, object_kind, datatype, language of all triples, as text."""
        out = None
        for _, rows in self.store.triples():
            part = rows.select("subject", "predicate", F.col("term.lex").alias("object"), F.col("term.kind").alias("object_kind"), F.col("term.dt").alias("datatype"), F.col("term.lang").alias("language"))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], "subject string, predicate string, object string, object_kind string, datatype string, language string") if out is None else out

    def ntriples(self) -> DataFrame:
        """line: the graph in N-Triples."""
        out = None
        subject = F.when(F.startswith("subject", F.lit("_:")), F.col("subject")).otherwise(F.concat(F.lit("<"), "subject", F.lit(">")))
        for _, rows in self.store.triples():
            part = rows.select(F.concat(subject, F.lit(" <"), "predicate", F.lit("> "), ntriples(F.col("term")), F.lit(" .")).alias("line"))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], "line string") if out is None else out

    def write_ntriples(self, path: str, single_file: bool = False) -> None:
        """Text files in the folder ``path``."""
        lines = self.ntriples()
        (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)

    def write_native_parquet(self, path: str) -> None:
        """A Parquet table for each predicate and type of object, with native types. Its name has the letters and digits
        of both; where several would have one name, also a hash of each."""
        named: dict[str, list] = {}
        for t in self.store.tables.values():
            name = "".join(c for c in t.predicate if c.isalnum())
            kind = "object_property" if t.kind == IRI else "".join(c for c in t.kind.datatype if c.isalnum())
            named.setdefault(f"{name}_{kind}".lower(), []).append((f"{name}_{kind}", t))
        for tables in named.values():
            for name, t in tables:
                tail = "_" + md5(f"{t.predicate} {t.kind}".encode()).hexdigest() if len(tables) > 1 else ""
                t.frame().write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}{tail}.parquet")

    def iterate_triples(self) -> Iterator[Triple]:
        for r in self.triples().toLocalIterator():
            subject = Node("blank" if r["subject"].startswith("_:") else "iri", r["subject"])
            yield Triple(subject, Node("iri", r["predicate"]), Node(r["object_kind"], r["object"], r["datatype"], r["language"]))

    def to_triples(self) -> list[Triple]:
        return list(self.iterate_triples())


def to_graph(mapping: Mapping):
    """An rdflib graph; needs rdflib."""
    import rdflib

    graph = rdflib.Graph()
    node = {"iri": lambda n: rdflib.URIRef(n.value), "blank": lambda n: rdflib.BNode(n.value[2:]), "literal": lambda n: rdflib.Literal(n.value, lang=n.language) if n.language else rdflib.Literal(n.value, datatype=rdflib.URIRef(n.datatype))}
    for t in mapping.iterate_triples():
        graph.add(tuple(node[n.kind](n) for n in (t.subject, t.verb, t.object)))
    return graph


