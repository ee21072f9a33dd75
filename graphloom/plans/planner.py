"""Algebra to DataFrame plans.

Patterns are evaluated bottom-up. Of a basic graph pattern, triples that ask for several columns of one row (the same
expanded frame, the same subject, unique by declaration) become one select on that frame instead of self-joins; the
rest is joined in a connected order, those with constants first, so that no cross product is made that can be
avoided. Join keys that may be unbound make a null-tolerant condition; all others are plain equi-joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import UnsupportedQuery
from ..functions.expressions import Compiler, Env, Value, harmonised, term
from ..functions.terms import BOOLEAN, DECIMAL, DOUBLE, FLOAT, INTEGER, INTEGERS, IRI, MIXED, NONE, NUMERIC, STRING, RdfType, is_numeric, lexical, promote, spark_type
from ..operators.paths import Paths
from ..operators.store import GraphStore, Piece, Table, merged
from ..sources.templates import Blank, Iri, Literal, Var
from . import algebra as A

_names = count()


def fresh() -> str:
    return f"v{next(_names)}"


@dataclass
class Solutions:
    frame: DataFrame
    vars: dict[str, tuple[str, RdfType]]  # variable -> column, type
    maybe: set[str] = field(default_factory=set)  # may be unbound

    def env(self) -> Env:
        return {n: Value(F.col(c), k) for n, (c, k) in self.vars.items()}


class Planner:
    def __init__(self, spark: SparkSession, store: GraphStore, unbound_last: bool = True):
        self.spark, self.store, self.unbound_last = spark, store, unbound_last

    # ---- leaves ----
    def one(self) -> Solutions:
        return Solutions(self.spark.range(1).select(), {})

    def nothing(self, names: list[str]) -> Solutions:
        columns = {n: (fresh(), NONE) for n in names}
        return Solutions(self.spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c, _ in columns.values()]), columns)

    def bgp(self, triples: list[A.Triple]) -> Solutions:
        if not triples:
            return self.one()
        rest = list(triples)
        parts: list[tuple[int, Solutions]] = []  # rank, solutions
        for group in self._stars(rest):
            parts.append((self._rank(group), self._star(group)))
            rest = [t for t in rest if t not in group]
        parts += [(self._rank([t]), self.triple(t)) for t in rest]
        parts.sort(key=lambda p: p[0])
        out = parts.pop(0)[1]
        while parts:
            at = next((i for i, (_, s) in enumerate(parts) if set(s.vars) & set(out.vars)), 0)
            out = self.join(out, parts.pop(at)[1])
        return out

    @staticmethod
    def _rank(group: list[A.Triple]) -> int:
        """Fewer rows first: constant objects and subjects bind most."""
        return -2 * sum(isinstance(t.s, Iri) for t in group) - sum(isinstance(t.o, Iri | Literal) for t in group)

    def _piece(self, t: A.Triple) -> tuple[Table, Piece] | None:
        if isinstance(t.p, Iri) and isinstance(t.s, Var) and t.s != t.o:
            tables = self.store.of(t.p.value)
            if len(tables) == 1 and len(tables[0].pieces) == 1 and not tables[0].tagged and tables[0].pieces[0].star is not None:
                return tables[0], tables[0].pieces[0]
        return None

    def _stars(self, triples: list[A.Triple]) -> list[list[A.Triple]]:
        groups: dict[tuple, list[A.Triple]] = {}
        for t in triples:
            found = self._piece(t)
            if found:
                groups.setdefault((t.s.name, found[1].star), []).append(t)
        return [g for g in groups.values() if len(g) > 1]

    def _star(self, group: list[A.Triple]) -> Solutions:
        found = [self._piece(t) for t in group]
        s = fresh()
        columns, names, conditions = [found[0][1].subject.alias(s)], {group[0].s.name: (s, IRI)}, [F.col(s).isNotNull()]
        for t, (table, piece) in zip(group, found, strict=True):
            c = fresh()
            columns.append(piece.object.cast(spark_type(table.kind)).alias(c))
            conditions.append(F.col(c).isNotNull())
            if not isinstance(t.o, Var):
                conditions.append(self._is(F.col(c), table.kind, t.o))
            elif t.o.name in names:
                other, kind = names[t.o.name]
                conditions.append(self._same(F.col(c), table.kind, F.col(other), kind))
            else:
                names[t.o.name] = (c, table.kind)
        frame = found[0][1].frame.select(*columns)
        for c in conditions:
            frame = frame.where(c)
        return Solutions(frame.select(*[c for c, _ in names.values()]), names)

    def _is(self, column: Column, kind: RdfType, constant) -> Column:
        """A constant matches by its value in the column's type (5 matches xsd:int 5), strings by language too."""
        v = term(constant)
        if kind == v.kind or is_numeric(kind) and is_numeric(v.kind):
            return column == v.column
        if MIXED in (kind, v.kind):
            return promote(column, kind) == promote(v.column, v.kind)
        if kind.kind == "literal" and v.kind.kind == "literal" and kind.datatype.endswith(("dateTime", "dateTimeStamp", "date")) and v.kind.datatype.endswith(("dateTime", "dateTimeStamp", "date")):
            return column.cast("timestamp") == v.column.cast("timestamp")
        return F.lit(False)

    @staticmethod
    def _same(a: Column, ka: RdfType, b: Column, kb: RdfType) -> Column:
        return a == b if ka == kb else promote(a, ka) == promote(b, kb)

    def triple(self, t: A.Triple) -> Solutions:
        names = [x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)]
        tables = self.store.of(t.p.value) if isinstance(t.p, Iri) else merged(self.store.tables.values())
        parts: list[Solutions] = []
        for table in tables:
            rows, kind = table.pairs(), table.object_type
            if isinstance(t.s, Iri):
                rows = rows.where(F.col("subject") == t.s.value)
            elif not isinstance(t.s, Var):
                rows = rows.where(F.lit(False))
            if not isinstance(t.o, Var):
                rows = rows.where(self._is(F.col("object"), kind, t.o))
            found: dict[str, tuple[Column, RdfType]] = {}
            for node, column, k in ((t.s, F.col("subject"), IRI), (t.p, table.verb(), IRI), (t.o, F.col("object"), kind)):
                if isinstance(node, Var):
                    if node.name in found:
                        rows = rows.where(self._same(*found[node.name], column, k))
                    else:
                        found[node.name] = (column, k)
            columns = {n: (fresh(), k) for n, (_, k) in found.items()}
            parts.append(Solutions(rows.select(*[found[n][0].alias(columns[n][0]) for n in found]), columns))
        if not parts:
            return self.nothing(list(dict.fromkeys(names)))
        out = parts[0]
        for p in parts[1:]:
            out = self.union(out, p)
        return out

    def path(self, p: A.Path) -> Solutions:
        evaluator = Paths(self.store, p.path)
        if any(isinstance(x, Literal) for x in (p.s, p.o)):
            evaluator.kind = MIXED

        def fixed(node) -> Column | None:
            if isinstance(node, Var):
                return None
            v = term(node)
            return v.column if evaluator.kind == IRI else promote(v.column, v.kind)

        rows = evaluator.pairs(p.path, fixed(p.s), fixed(p.o))
        if isinstance(p.s, Var) and p.s == p.o:
            rows = rows.where("s = o")
        columns = {n.name: (fresh(), evaluator.kind) for n in (p.s, p.o) if isinstance(n, Var)}
        picked = {n.name: c for n, c in ((p.o, "o"), (p.s, "s")) if isinstance(n, Var)}
        return Solutions(rows.select(*[F.col(picked[n]).alias(c) for n, (c, _) in columns.items()]), columns)

    def values(self, v: A.Values) -> Solutions:
        columns, maybe = {}, set()
        listed = []
        for i, n in enumerate(v.names):
            cells = [None if r[i] is None else term(r[i]) for r in v.rows]
            made, kind = harmonised([c for c in cells if c is not None])
            it = iter(made)
            columns[n] = (fresh(), kind)
            listed.append([F.lit(None).cast(spark_type(kind)) if c is None else next(it) for c in cells])
            if any(c is None for c in cells):
                maybe.add(n)
        if not v.rows:
            return self.nothing(v.names)
        rows = F.array(*[F.struct(*[listed[i][r].alias(columns[n][0]) for i, n in enumerate(v.names)]) for r in range(len(v.rows))])
        return Solutions(self.spark.range(1).select(F.inline(rows)) if v.names else self.spark.range(len(v.rows)).select(), columns, maybe)

    # ---- joins ----
    def _keys(self, a: Solutions, b: Solutions) -> tuple[Solutions, Solutions, list[str]]:
        """Both sides with their shared variables of one type."""
        shared = [n for n in a.vars if n in b.vars]
        sides = []
        for s, o in ((a, b), (b, a)):
            names, columns = dict(s.vars), {}
            for n in shared:
                c, k = s.vars[n]
                other = o.vars[n][1]
                if k != other:
                    new = fresh()
                    if k == NONE or other == NONE:
                        kind = other if k == NONE else k
                        columns[new], names[n] = F.col(c).cast(spark_type(kind)) if k != NONE else F.lit(None).cast(spark_type(kind)), (new, kind)
                    else:
                        columns[new], names[n] = promote(F.col(c), k), (new, MIXED)
            frame = s.frame.withColumns(columns) if columns else s.frame
            maybe = s.maybe | {n for n in shared if s.vars[n][1] == NONE}
            sides.append(Solutions(frame, names, maybe))
        return *sides, shared

    @staticmethod
    def _patterns(s: Solutions, names: list[str]) -> list[tuple[set[str], DataFrame]]:
        """The rows of ``s`` by which of ``names`` are bound, with these names."""
        out = [(set(), s.frame)]
        for n in names:
            c = F.col(s.vars[n][0])
            out = [(bound | more, frame.where(c.isNotNull() if more else c.isNull())) for bound, frame in out for more in ({n}, set())]
        return out

    def _split(self, a: Solutions, b: Solutions, shared: list[str]) -> list[tuple[Solutions, Solutions, set[str]]] | None:
        """Pairs of parts of ``a`` and ``b`` and the keys bound in both, if no key is always bound: so that each
        pair has plain equi-joins. None where that is needless, or would make too many parts."""
        unsure = [n for n in shared if n in a.maybe or n in b.maybe]
        mine, other = [n for n in shared if n in a.maybe], [n for n in shared if n in b.maybe]
        if not unsure or len(unsure) < len(shared) or len(mine) + len(other) > 3:
            return None
        sure = lambda s, bound: s.maybe - bound
        parts = []
        for p, left in self._patterns(a, mine):
            for q, right in self._patterns(b, other):
                keys = {n for n in shared if (n in p or n not in a.maybe) and (n in q or n not in b.maybe)}
                parts.append((Solutions(left, a.vars, sure(a, p)), Solutions(right, b.vars, sure(b, q)), keys))
        return parts

    def join(self, a: Solutions, b: Solutions, how: str = "inner", condition=None) -> Solutions:
        a, b, shared = self._keys(a, b)
        if how == "inner" or (how == "left" and not b.maybe & set(shared)):
            parts = self._split(a, b, shared)
            if parts:
                out = None
                for x, y, keys in parts:
                    one = self._join(x, y, shared, how, condition, keys)
                    out = one if out is None else self.union(out, one)
                return out
        return self._join(a, b, shared, how, condition, None)

    def _join(self, a: Solutions, b: Solutions, shared: list[str], how: str, condition, keys: set[str] | None) -> Solutions:
        """``keys``: the shared names that are bound in both, where others are bound in one at most."""
        on, picked = None, {}
        for n in shared:
            x, y = F.col(a.vars[n][0]), F.col(b.vars[n][0])
            if keys is not None and n not in keys:
                picked[n] = F.coalesce(x, y)
                continue
            c = x == y
            if n in a.maybe:
                c = c | x.isNull()
            if n in b.maybe:
                c = c | y.isNull()
            on = c if on is None else on & c
            picked[n] = F.coalesce(x, y) if n in a.maybe and how != "left_anti" else x
        if condition is not None:
            both = a.env() | {n: Value(F.col(c), k) for n, (c, k) in b.vars.items() if n not in a.vars}
            both |= {n: Value(picked[n], a.vars[n][1]) for n in shared}
            test = self._condition(condition, both)
            on = test if on is None else on & test
        if how == "inner" and on is None:
            frame = a.frame.crossJoin(b.frame)
        elif on is None:
            frame = a.frame.join(b.frame, F.lit(True), how)
        else:
            frame = a.frame.join(b.frame, on, how)
        if how in ("left_semi", "left_anti"):
            return Solutions(frame, a.vars, a.maybe)
        names, columns = {}, []
        for n, (c, k) in (a.vars | {n: v for n, v in b.vars.items() if n not in a.vars}).items():
            if n in picked and n in a.maybe:
                new = fresh()
                columns.append(picked[n].alias(new))
                names[n] = (new, k)
            else:
                columns.append(F.col(c))
                names[n] = (c, k)
        only_b = set(b.vars) - set(a.vars)
        maybe = (a.maybe & b.maybe) | (a.maybe - set(b.vars)) | (b.maybe & only_b)
        if how == "left":
            maybe |= only_b | a.maybe
        return Solutions(frame.select(*columns), names, maybe)

    def union(self, a: Solutions, b: Solutions) -> Solutions:
        names, left, right = {}, [], []
        for n in [*a.vars, *[x for x in b.vars if x not in a.vars]]:
            new = fresh()
            cells = [Value(F.col(s.vars[n][0]), s.vars[n][1]) if n in s.vars else Value(F.lit(None), NONE) for s in (a, b)]
            kinds = {c.kind for c in cells} - {NONE}
            kind = MIXED if len(kinds) > 1 else kinds.pop() if kinds else NONE
            for c, out in zip(cells, (left, right), strict=True):
                out.append((promote(c.column, c.kind) if kind == MIXED else c.column.cast(spark_type(kind)) if c.kind == NONE else c.column).alias(new))
            names[n] = (new, kind)
        maybe = a.maybe | b.maybe | (set(a.vars) ^ set(b.vars))
        return Solutions(a.frame.select(*left).union(b.frame.select(*right)), names, maybe)

    # ---- expressions with EXISTS ----
    def _condition(self, e: tuple, env: Env) -> Column:
        return F.coalesce(Compiler(env).condition(e), F.lit(False))

    def _correlated(self, outer: Solutions, pattern, how: str) -> Solutions:
        """Semi or anti join with a pattern; filters at its top may use outer variables."""
        conditions = []
        while isinstance(pattern, A.Filter):
            conditions.append(pattern.condition)
            pattern = pattern.inner
        inner = self.plan(pattern)
        own, condition = None, None
        for c in conditions:
            if _variables(c) <= set(inner.vars) and not _has_exists(c):
                own = c if own is None else ("op", "&&", own, c)
            else:
                condition = c if condition is None else ("op", "&&", condition, c)
        if own is not None:
            inner = self.filter(inner, own)
        return self.join(outer, inner, how, condition)

    def with_exists(self, s: Solutions, e: tuple) -> tuple[Solutions, Env]:
        """Solutions with a marker column for each EXISTS in the expression."""
        patterns: list = []
        _collect_exists(e, patterns)
        env = s.env()
        for pattern in patterns:
            mark, row = fresh(), fresh()
            keyed = Solutions(s.frame.withColumn(row, F.struct(*[F.col(c) for c, _ in s.vars.values()]) if s.vars else F.lit(0)), s.vars, s.maybe)
            hits = self._correlated(keyed, pattern, "left_semi").frame.select(F.col(row).alias(f"{row}h")).distinct().withColumn(mark, F.lit(True))
            joined = keyed.frame.join(hits, F.col(row).eqNullSafe(F.col(f"{row}h")), "left").withColumn(mark, F.coalesce(mark, F.lit(False))).drop(row, f"{row}h")
            s = Solutions(joined, s.vars, s.maybe)
            env[f"#exists{id(pattern)}"] = Value(F.col(mark), BOOLEAN)
        return s, env

    def compile(self, s: Solutions, e: tuple) -> tuple[Solutions, Value]:
        if not _has_exists(e):
            return s, Compiler(s.env()).value(e)
        s, env = self.with_exists(s, e)
        return s, Compiler(env, lambda p: env[f"#exists{id(p)}"].column).value(e)

    def filter(self, s: Solutions, e: tuple) -> Solutions:
        match e:
            case ("op", "&&", a, b):
                return self.filter(self.filter(s, a), b)
            case ("exists", pattern):
                return self._correlated(s, pattern, "left_semi")
            case ("op", "!", ("exists", pattern)):
                return self._correlated(s, pattern, "left_anti")
        if _has_exists(e):
            s, env = self.with_exists(s, e)
            test = Compiler(env, lambda p: env[f"#exists{id(p)}"].column).condition(e)
        else:
            test = Compiler(s.env()).condition(e)
        bound = {e[2][1]} if e[:2] == ("call", "BOUND") else set()
        return Solutions(s.frame.where(test), s.vars, s.maybe - bound)

    # ---- operators ----
    def plan(self, p) -> Solutions:
        match p:
            case A.Bgp(triples):
                return self.bgp(triples)
            case A.Path():
                return self.path(p)
            case A.Join(A.Bgp([]), x) | A.Join(x, A.Bgp([])):
                return self.plan(x)
            case A.Join(a, b):
                return self.join(self.plan(a), self.plan(b))
            case A.LeftJoin(a, b, condition):
                left, right = self.plan(a), self.plan(b)
                if condition is not None and _has_exists(condition):
                    matched = self.filter(self.join(left, right), condition)
                    return self.union(matched, self.join(left, matched, "left_anti"))
                return self.join(left, right, "left", condition)
            case A.Filter(inner, condition):
                return self.filter(self.plan(inner), condition)
            case A.Union(a, b):
                return self.union(self.plan(a), self.plan(b))
            case A.Extend(inner, name, e):
                s, v = self.compile(self.plan(inner), e)
                c = fresh()
                return Solutions(s.frame.withColumn(c, v.column.cast(spark_type(v.kind)) if v.kind == NONE else v.column), s.vars | {name: (c, v.kind)}, s.maybe | {name})
            case A.Minus(a, b):
                return self.minus(self.plan(a), self.plan(b))
            case A.Values():
                return self.values(p)
            case A.OrderBy(inner, keys):
                s = self.plan(inner)
                columns = []
                for e, up in keys:
                    s, v = self.compile(s, e)
                    value = [F.coalesce(v.column["lex"].try_cast("double"), F.lit(None)), v.column["lex"]] if v.kind == MIXED else [v.column]
                    last = self.unbound_last or not up
                    columns += [(c.asc_nulls_last() if last else c.asc_nulls_first()) if up else c.desc_nulls_last() for c in value]
                return Solutions(s.frame.orderBy(*columns), s.vars, s.maybe)
            case A.Project(inner, names):
                s = self.plan(inner)
                kept, columns = {}, []
                for n in names:
                    c, k = s.vars.get(n, (None, NONE))
                    new = c or fresh()
                    columns.append(F.col(c) if c else F.lit(None).cast("string").alias(new))
                    kept[n] = (new, k)
                return Solutions(s.frame.select(*columns), kept, (s.maybe & set(names)) | {n for n in names if n not in s.vars})
            case A.Distinct(inner):
                s = self.plan(inner)
                return Solutions(s.frame.distinct(), s.vars, s.maybe)
            case A.Slice(inner, offset, limit):
                s = self.plan(inner)
                frame = s.frame.offset(offset) if offset else s.frame
                return Solutions(frame if limit is None else frame.limit(limit), s.vars, s.maybe)
            case A.Group(inner, keys, aggregates):
                return self.group(self.plan(inner), keys, aggregates)
        raise UnsupportedQuery(f"{type(p).__name__} is not supported")

    def minus(self, a: Solutions, b: Solutions) -> Solutions:
        if not set(a.vars) & set(b.vars):
            return a
        if not (a.maybe | b.maybe) & set(a.vars) & set(b.vars):
            return self.join(a, b, "left_anti")
        # rows that share no bound variable are not taken away
        x, y, shared = self._keys(a, b)
        parts = self._split(x, y, shared)
        if parts:
            # the parts of b, one after the other, take away from each part of a
            left: dict[frozenset, DataFrame] = {}
            for p, q, keys in parts:
                known = frozenset(set(shared) - p.maybe)
                frame = left.get(known, p.frame)
                if keys:
                    on = [F.col(p.vars[n][0]) == F.col(q.vars[n][0]) for n in sorted(keys)]
                    frame = frame.join(q.frame, on, "left_anti")
                left[known] = frame
            out = None
            for frame in left.values():
                out = frame if out is None else out.union(frame)
            return Solutions(out, x.vars, x.maybe)
        compatible, some = F.lit(True), F.lit(False)
        for n in shared:
            p, q = F.col(x.vars[n][0]), F.col(y.vars[n][0])
            compatible = compatible & (F.coalesce(p == q, F.lit(True)))
            some = some | (p.isNotNull() & q.isNotNull())
        return Solutions(x.frame.join(y.frame, compatible & some, "left_anti"), x.vars, x.maybe)

    def group(self, s: Solutions, keys, aggregates) -> Solutions:
        names, by = {}, []
        for n, e in keys:
            if e is not None:
                s, v = self.compile(s, e)
                c = fresh()
                s = Solutions(s.frame.withColumn(c, v.column), s.vars | {n: (c, v.kind)}, s.maybe | {n})
            if n in s.vars:
                names[n] = s.vars[n]
                by.append(s.vars[n][0])
        columns = []
        for n, (_, name, distinct, e, separator) in aggregates:
            c = fresh()
            v = None if e is None else Compiler(s.env()).value(e)
            column, kind = self._aggregate(name, distinct, v, separator, s)
            columns.append(column.alias(c))
            names[n] = (c, kind)
        if not columns:
            frame = s.frame.select(*by).distinct()
        else:
            frame = s.frame.groupBy(*by).agg(*columns) if by else s.frame.agg(*columns)
        return Solutions(frame, names, s.maybe | {n for n, _ in aggregates})

    @staticmethod
    def _aggregate(name: str, distinct: bool, v: Value | None, separator: str, s: Solutions) -> tuple[Column, RdfType]:
        if name == "COUNT":
            if v is None:
                return (F.count_distinct(F.struct(*[F.col(c) for c, _ in s.vars.values()])) if distinct and s.vars else F.count(F.lit(1))), INTEGER
            return (F.count_distinct(v.column) if distinct else F.count(v.column)), INTEGER
        if v is None:
            raise UnsupportedQuery(f"{name}(*) is not supported")
        column, kind = v.column, v.kind
        if name in ("SUM", "AVG"):
            if kind == MIXED:
                # one term that is no number leaves the result unbound
                number = F.when(column["dt"].isin(*sorted(NUMERIC)), column["lex"].try_cast("double"))
                wrong = F.coalesce(F.bool_or(column.isNotNull() & number.isNull()), F.lit(False))
                total, kind = Planner._aggregate(name, distinct, Value(number, DOUBLE), separator, s)
                return F.when(~wrong, total), kind
            elif kind == BOOLEAN:
                column, kind = column.cast("bigint"), INTEGER
            elif kind == NONE:
                return F.count(column), INTEGER  # of nothing: 0
            elif not is_numeric(kind):
                return F.first(F.lit(None).cast("double")), DOUBLE
            whole = kind.datatype in INTEGERS
            spark = "bigint" if whole else spark_type(DECIMAL) if kind == DECIMAL else "double"
            column = column.cast(spark)
            if name == "SUM":
                # an empty group's sum is 0
                total = F.coalesce(F.sum_distinct(column) if distinct else F.sum(column), F.lit(0).cast(spark))
                return (total, INTEGER) if whole else (total.cast(spark_type(kind)), kind)
            mean = F.coalesce(F.sum_distinct(column) / F.nullif(F.count_distinct(column), F.lit(0)) if distinct else F.avg(column), F.lit(0).cast(spark_type(kind)) if kind == DECIMAL else F.lit(0.0))
            return (mean.cast(spark_type(kind)), kind) if kind in (FLOAT, DECIMAL) else (mean, DOUBLE)
        if name in ("MIN", "MAX"):
            f = F.min if name == "MIN" else F.max
            if kind == MIXED:  # numbers before other terms, each by their value
                order = F.struct(column["lex"].try_cast("double").isNull(), column["lex"].try_cast("double"), column["lex"])
                return (F.min_by if name == "MIN" else F.max_by)(column, F.when(column.isNotNull(), order)), MIXED
            return f(column), kind
        if name == "SAMPLE":
            return F.first(column, ignorenulls=True), kind
        if name == "GROUP_CONCAT":
            text = lexical(column, kind)
            return F.coalesce(F.array_join(F.array_sort(F.collect_set(text)), separator) if distinct else F.listagg(text, F.lit(separator)), F.lit("")), STRING
        raise UnsupportedQuery(f"unknown aggregate {name}")

    # ---- results ----
    def select(self, q: A.Query, raw: bool = False) -> DataFrame:
        s = self.plan(q.pattern)
        out = []
        for n in q.names:
            c, k = s.vars[n]
            out.append((F.col(c)["lex"] if k == MIXED and not raw else F.col(c)).alias(n))
        return s.frame.select(*out)

    def construct(self, q: A.Query) -> list[tuple[DataFrame, RdfType]]:
        """A frame (subject, verb, object) for each triple of the template, and the type of its objects."""
        s = self.plan(q.pattern)
        row = F.sha2(F.concat_ws("|", *[F.coalesce(promote(F.col(c), k)["lex"], F.lit("")) for c, k in s.vars.values()]), 256) if s.vars else F.lit("0")
        out = []
        for t in q.template:
            cells = []
            for node in (t.s, t.p, t.o):
                if isinstance(node, Var):
                    c, k = s.vars.get(node.name, (None, NONE))
                    cells.append(Value(F.col(c), k) if c else Value(F.lit(None).cast("string"), NONE))
                elif isinstance(node, Blank):
                    cells.append(Value(F.concat(F.lit(f"_:{node.label}-"), row), IRI))
                else:
                    cells.append(term(node))
            subject, verb, obj = cells
            rows = s.frame
            columns = []
            for v, name in ((subject, "subject"), (verb, "verb")):
                if v.kind == MIXED:
                    rows = rows.where(v.column["kind"].isin("iri", "blank"))
                    columns.append(v.column["lex"].alias(name))
                else:
                    rows = rows if v.kind in (IRI, NONE) else rows.where(F.lit(False))
                    columns.append(v.column.cast("string").alias(name))
            made = rows.select(*columns, obj.column.alias("object")).dropna(subset=["subject", "verb", "object"]).distinct()
            out.append((made, obj.kind))
        return out


def _variables(e) -> set[str]:
    if isinstance(e, tuple) and e and e[0] == "var":
        return {e[1]}
    if isinstance(e, tuple | list):
        return set().union(*[_variables(x) for x in e if isinstance(x, tuple | list)])
    return set()


def _has_exists(e) -> bool:
    found: list = []
    _collect_exists(e, found)
    return bool(found)


def _collect_exists(e, out: list) -> None:
    if isinstance(e, tuple) and e and e[0] == "exists":
        out.append(e[1])
    elif isinstance(e, tuple | list):
        for x in e:
            _collect_exists(x, out)

