"""The graph as typed tables, one for each (predicate, RDF type of the object).

A table is a list of lazy pieces. A piece is a select on a source frame; pieces that are known to hold no
duplicates, alone in their table, are read without a shuffle for de-duplication. Of a list's elements, each once, only
those of subjects with several rows are compared; such subjects are looked for when the table is first read.

Predicates that come from a column are listed when their rows are added, for each has its own table and type. Such a
table is the source under a filter; what reads many of them at once (``merged``) reads the source once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.terms import MIXED, RdfType, promote, spark_type


@dataclass(frozen=True, eq=False)
class Verbs:
    """A frame of which column ``verb`` is the predicate of each row, and all its predicates."""

    frame: DataFrame
    verb: Column
    names: frozenset[str]


@dataclass(eq=False)
class Subjects:
    """A frame's subjects, before its lists become rows."""

    frame: DataFrame
    subject: Column

    @cached_property
    def repeated(self) -> DataFrame | None:
        """Those with several rows, as ``++subject``; None if there are none."""
        found = self.frame.groupBy(self.subject.alias("++subject")).count().where("`++subject` IS NOT NULL AND count > 1").select("++subject")
        return None if found.isEmpty() else found

    def split(self) -> tuple[DataFrame, DataFrame | None]:
        """The rows with a subject of their own, and the others, if any."""
        if self.repeated is None:
            return self.frame, None
        single, several = (self.frame.join(self.repeated, self.subject == F.col("`++subject`"), how) for how in ("left_anti", "left_semi"))
        return single, several


@dataclass
class Piece:
    frame: DataFrame
    subject: Column
    object: Column
    lang: Column | None
    unique: bool
    #: Equal for pieces whose subjects are the same expression of the same frame, unique over its rows; else None.
    star: tuple | None = None
    #: Where the piece is a part of.
    verbs: Verbs | None = None
    #: Where each row of these subjects' frame gives no triple twice; ``made`` gives the piece's frame of some of its rows.
    subjects: Subjects | None = None
    made: Callable[[DataFrame], DataFrame] | None = None

    def rows(self, kind: RdfType, tagged: bool) -> DataFrame:
        columns = [self.subject.alias("subject"), self.object.cast(spark_type(kind)).alias("object")]
        if tagged:
            columns.append((F.lit(None) if self.lang is None else self.lang).cast("string").alias("language_tag"))
        return self.frame.select(*columns).where("subject IS NOT NULL AND object IS NOT NULL")

    def distinct(self, kind: RdfType, tagged: bool) -> DataFrame:
        if self.unique:
            return self.rows(kind, tagged)
        if self.subjects is None:
            return self.rows(kind, tagged).dropDuplicates()
        single, several = self.subjects.split()
        out = replace(self, frame=self.made(single)).rows(kind, tagged)
        return out if several is None else out.unionByName(replace(self, frame=self.made(several)).rows(kind, tagged).dropDuplicates())


@dataclass
class Table:
    #: None: each row has its own.
    predicate: str | None
    kind: RdfType
    pieces: list[Piece] = field(default_factory=list)
    #: Of tables without a predicate: those that are read.
    names: frozenset[str] = frozenset()

    @property
    def tagged(self) -> bool:
        return any(p.lang is not None for p in self.pieces)

    def frame(self) -> DataFrame:
        """subject, object, for tagged strings language_tag, where rows have their own predicates these; without duplicates."""
        if self.predicate is None:
            (piece,) = self.pieces
            source = piece.verbs
            rows = source.frame if self.names == source.names else source.frame.where(source.verb.isin(sorted(self.names)))
            columns = [piece.subject.alias("subject"), piece.object.cast(spark_type(self.kind)).alias("object"), source.verb.alias("predicate")]
            if self.tagged:
                columns.append(piece.lang.cast("string").alias("language_tag"))
            rows = rows.select(*columns).dropna(subset=["subject", "object", "predicate"])
            return rows if piece.unique else rows.dropDuplicates()
        if len(self.pieces) == 1:
            return self.pieces[0].distinct(self.kind, self.tagged)
        parts = [p.rows(self.kind, self.tagged) for p in self.pieces]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates()

    @property
    def object_type(self) -> RdfType:
        return MIXED if self.tagged else self.kind

    def pairs(self) -> DataFrame:
        """subject, object, where rows have their own predicates these; objects of tagged tables as TERM."""
        rows = self.frame()
        return rows.withColumn("object", promote(F.col("object"), self.kind, F.col("language_tag"))).drop("language_tag") if self.tagged else rows

    def verb(self) -> Column:
        """The predicates of the rows of ``frame``."""
        return F.col("predicate") if self.predicate is None else F.lit(self.predicate)


def merged(tables: Iterable[Table]) -> list[Table]:
    """``tables``, of which those that are nothing but parts of one frame are one."""
    out: list[Table] = []
    parts: dict[tuple[int, RdfType], list[Table]] = {}
    for t in tables:
        if len(t.pieces) == 1 and t.pieces[0].verbs is not None:
            parts.setdefault((id(t.pieces[0].verbs), t.kind), []).append(t)
        else:
            out.append(t)
    for alike in parts.values():
        out += alike if len(alike) == 1 else [Table(None, alike[0].kind, alike[0].pieces, frozenset(t.predicate for t in alike))]
    return out


class GraphStore:
    def __init__(self):
        self.tables: dict[tuple[str, RdfType], Table] = {}
        #: By the frame's number and the column.
        self.subjects: dict[tuple[int, str], Subjects] = {}

    def add(self, predicate: str, kind: RdfType, piece: Piece) -> None:
        self.tables.setdefault((predicate, kind), Table(predicate, kind)).pieces.append(piece)

    def add_named(self, kind: RdfType, frame: DataFrame, subject: Column, verb: Column, obj: Column, lang: Column | None, unique: bool) -> None:
        """Rows whose predicates are a column's values, which are read now."""
        names = [r[0] for r in frame.select(verb.alias("v")).where("v IS NOT NULL").distinct().orderBy("v").collect()]
        source = Verbs(frame, verb, frozenset(names))
        for name in names:
            self.add(name, kind, Piece(frame.where(verb == name), subject, obj, lang, unique, verbs=source))

    def of(self, predicate: str) -> list[Table]:
        return [t for (p, _), t in self.tables.items() if p == predicate]

    @property
    def predicates(self) -> list[str]:
        return list(dict.fromkeys(p for p, _ in self.tables))

    def triples(self) -> list[tuple[Table, DataFrame]]:
        """For each table: subject, predicate, object (all as text), kind, datatype, language of the object."""
        out = []
        for t in merged(self.tables.values()):
            rows = t.frame()
            tag = F.col("language_tag") if t.tagged else None
            term = promote(F.col("object"), t.kind, tag)
            out.append((t, rows.select("subject", t.verb().alias("predicate"), term.alias("term"))))
        return out

