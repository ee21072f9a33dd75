"""Property paths as pairs of nodes, without duplicates.

Closures square the relation (R := R + R.R) until it stops growing, so a chain of n steps takes log2 n rounds; with
a fixed start or end a breadth-first search expands only what it reaches. Each round is cut off by a table in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.terms import IRI, MIXED, RdfType, promote
from ..sources.tables import materialize
from .store import GraphStore, Table, merged


class Paths:
    def __init__(self, store: GraphStore, path: tuple):
        self.store = store
        tables = list(store.tables.values()) if self._reaches_all(path) else [t for p in self._predicates(path) for t in store.of(p)]
        self.kind: RdfType = IRI if all(t.object_type == IRI for t in tables) else MIXED

    def _predicates(self, path: tuple) -> list[str]:
        return [path[1]] if path[0] == "iri" else [p for x in path[1:] if isinstance(x, tuple) for p in self._predicates(x)]

    def _reaches_all(self, path: tuple) -> bool:
        return path[0] in ("not", "star", "opt") or any(self._reaches_all(x) for x in path[1:] if isinstance(x, tuple) and x and x[0] in ("inv", "seq", "alt", "plus", "star", "opt", "not", "iri"))

    def _edges(self, tables: list[Table]) -> DataFrame | None:
        out = None
        for t in tables:
            rows = t.pairs()
            pairs = rows.select(self._node(F.col("subject"), IRI).alias("s"), self._node(F.col("object"), t.object_type).alias("o"))
            out = pairs if out is None else out.unionByName(pairs)
        return out

    def _node(self, column: Column, kind: RdfType) -> Column:
        return column if self.kind == IRI else promote(column, kind)

    def _empty(self, like: DataFrame | None = None) -> DataFrame:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        kind = "string" if self.kind == IRI else "struct<kind:string,lex:string,dt:string,lang:string>"
        return spark.createDataFrame([], f"s {kind}, o {kind}")

    def _nodes(self) -> DataFrame:
        """All nodes of the graph."""
        edges = self._edges(merged(self.store.tables.values()))
        if edges is None:
            return self._empty().select("s")
        return edges.select("s").union(edges.select("o")).distinct()

    def pairs(self, path: tuple, start: Column | None = None, end: Column | None = None) -> DataFrame:
        """s, o; restricted to a constant start or end, if given, as early as may be."""
        out = self._pairs(path, start, end)
        if start is not None:
            out = out.where(F.col("s") == start)
        return out if end is None else out.where(F.col("o") == end)

    def _pairs(self, path: tuple, start: Column | None, end: Column | None) -> DataFrame:
        match path:
            case ("iri", iri):
                edges = self._edges(self.store.of(iri))
                return self._empty() if edges is None else edges.distinct()
            case ("inv", p):
                return self.pairs(p, end, start).select(F.col("o").alias("s"), F.col("s").alias("o"))
            case ("seq", a, b):
                left = self.pairs(a, start, None).withColumnRenamed("o", "m")
                right = self.pairs(b, None, end).withColumnRenamed("s", "m")
                return left.join(right, "m").select("s", "o").distinct()
            case ("alt", a, b):
                return self.pairs(a, start, end).union(self.pairs(b, start, end)).distinct()
            case ("opt", p):
                return self._with_self(self.pairs(p, start, end), start, end)
            case ("plus", p):
                return self._closure(p, start, end)
            case ("star", p):
                return self._with_self(self._closure(p, start, end), start, end)
            case ("not", forward, backward):
                out = None
                for names, turned in ((forward, False), (backward, True)):
                    if names or (not turned and not backward):
                        edges = self._edges(merged(t for t in self.store.tables.values() if t.predicate not in names))
                        if edges is not None:
                            edges = edges.select(F.col("o").alias("s"), F.col("s").alias("o")) if turned else edges
                            out = edges if out is None else out.union(edges)
                return self._empty() if out is None else out.distinct()
        raise AssertionError(path)

    def _with_self(self, pairs: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
        """And each node with itself; a constant end point is one whether or not the graph has it."""
        nodes = self._nodes()
        for c in (start, end):
            if c is not None:
                nodes = nodes.union(nodes.sparkSession.range(1).select(c.alias("s")))
        return pairs.union(nodes.select("s", F.col("s").alias("o"))).distinct()

    def _closure(self, p: tuple, start: Column | None, end: Column | None) -> DataFrame:
        if start is not None or end is not None:
            return self._search(p, start, end)
        # paths of twice the length in each round, made of a new one and any other
        reached = delta = materialize(self.pairs(p).distinct())
        while not delta.isEmpty():
            ahead, back = reached.select(F.col("s").alias("m"), F.col("o").alias("e")), reached.select(F.col("s").alias("b"), F.col("o").alias("m"))
            on = delta.join(ahead, delta["o"] == F.col("m")).select("s", F.col("e").alias("o"))
            before = delta.join(back, delta["s"] == F.col("m")).select(F.col("b").alias("s"), "o")
            delta = materialize(on.union(before).distinct().join(reached, ["s", "o"], "left_anti"))
            reached = materialize(reached.union(delta))
        return reached

    def _search(self, p: tuple, start: Column | None, end: Column | None) -> DataFrame:
        edges = materialize(self.pairs(p))
        a, b, seed = ("s", "o", start) if start is not None else ("o", "s", end)
        seen = frontier = materialize(edges.where(F.col(a) == seed).select(F.col(b).alias("n")).distinct())
        rounds = 0
        while not frontier.isEmpty():
            step = frontier.join(edges.select(F.col(a).alias("n"), F.col(b).alias("to")), "n").select(F.col("to").alias("n")).distinct()
            frontier = materialize(step.join(seen, "n", "left_anti"))
            seen, rounds = seen.union(frontier), rounds + 1
            if rounds % 8 == 0:
                seen = materialize(seen)
        return seen.select(seed.alias(a), F.col("n").alias(b)).select("s", "o")
