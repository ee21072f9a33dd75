"""Template expansion: a frame and a template become triples, by composing column expressions.

Only plans are built here. Arguments are expressions over the source frame; a nested template gets its caller's
expressions, so an expansion without list expanders is one select for each triple, on the same frame.

List expanders multiply rows only where a triple is made, and only by the lists whose elements it has: a triple with
elements of one of two crossed lists needs no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import count
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import MappingError
from ..functions.terms import IRI, NONE, OTTR, XSD, RdfType, infer, parse_literal, spark_type
from ..sources.templates import ANY_URI, TRIPLE, Argument, Basic, Blank, Instance, Iri, ListTerm, Literal, NoneTerm, Parameter, PType, Template, Templates, Term, Var, Wrapped
from .store import GraphStore, Piece, Subjects

_frames, _elements = count(), count()


@dataclass(frozen=True)
class Value:
    """An argument: its expression, RDF type, and whether it is a list."""

    column: Column
    kind: RdfType
    lang: Column | None = None
    is_list: bool = False
    source: str | None = None  # the column of the source frame that it is, unchanged
    constant: str | None = None  # the IRI that it always is
    needs: frozenset[str] = frozenset()  # the list elements that it is made of, by their columns' names
    element: str | None = None  # the one that it is, unchanged


@dataclass(frozen=True)
class Spread:
    """Lists whose elements become rows side by side; one row without elements where there are none."""

    lists: dict[str, Column]  # by the columns that their elements get
    expander: str
    needs: frozenset[str]  # the elements that the lists are made of


@dataclass(frozen=True)
class Scope:
    frame: DataFrame
    frame_id: int
    values: dict[str, Value]
    row: Column  # a number for the row, for blank nodes
    unique: frozenset[str] | None  # a set of source columns with no two rows of the frame alike
    row_needs: frozenset[str] = frozenset()
    spreads: tuple[Spread, ...] = ()  # not yet in the frame
    filled: tuple[Value, ...] = ()  # rows without one of these do not count; not yet in the frame


def _is_uri(ptype: PType | None) -> bool:
    while isinstance(ptype, Wrapped):
        ptype = ptype.inner
    return isinstance(ptype, Basic) and ptype.iri in (ANY_URI, OTTR + "IRI")


def _literal_type(ptype: PType | None) -> str | None:
    while isinstance(ptype, Wrapped):
        ptype = ptype.inner
    return ptype.iri if isinstance(ptype, Basic) and ptype.iri.startswith(XSD) and ptype.iri != ANY_URI else None


def column_types(template: Template, frame: DataFrame, tags: dict[str, str]) -> dict[str, Value]:
    """Checks the frame's columns against the parameters."""
    fields = {f.name: f.dataType for f in frame.schema.fields}
    names = [p.name for p in template.parameters]
    if extra := [c for c in fields if c not in names]:
        raise MappingError(f"the template has no parameters for the columns {extra}")
    out = {}
    for p in template.parameters:
        if p.name not in fields:
            if p.default is None:
                raise MappingError(f"the column {p.name} is missing")
            continue
        kind = fields[p.name]
        is_list = isinstance(kind, T.ArrayType)
        if is_list != isinstance(p.ptype, Wrapped) and p.ptype is not None and not (isinstance(p.ptype, Wrapped) and p.ptype.kind == "LUB"):
            raise MappingError(f"the column {p.name} is {'a' if is_list else 'no'} list, but its type is {p.ptype}")
        if _is_uri(p.ptype):
            if not isinstance(kind.elementType if is_list else kind, T.StringType):
                raise MappingError(f"the column {p.name} holds IRIs and must be of strings")
            rdf = IRI
        else:
            declared = _literal_type(p.ptype)
            rdf = infer(kind) if declared is None else RdfType("literal", declared)
        lang = F.lit(tags[p.name]) if p.name in tags else None
        out[p.name] = Value(F.col(f"`{p.name}`"), rdf, lang, is_list, p.name)
    return out


def check_values(template: Template, frame: DataFrame) -> None:
    """No nulls in columns that are not optional, no blank nodes where none may be: one pass over the frame."""
    tests = {}
    for p in template.parameters:
        if p.name in frame.columns:
            c = F.col(f"`{p.name}`")
            if not p.optional and p.default is None:
                tests[f"the column {p.name} has nulls but is not optional"] = c.isNull()
            if p.non_blank and isinstance(frame.schema[p.name].dataType, T.StringType):
                tests[f"the column {p.name} has blank nodes"] = F.startswith(c, F.lit("_:"))
    if tests:
        found = frame.agg(*[F.bool_or(t).alias(str(i)) for i, t in enumerate(tests.values())]).first()
        for i, message in enumerate(tests):
            if found[str(i)]:
                raise MappingError(message)


def constant(term: Term, ptype: PType | None, scope: Scope, path: str) -> Value:
    match term:
        case Iri(value):
            return Value(F.lit(value), IRI, constant=value)
        case Literal(value, datatype, lang):
            wanted = _literal_type(ptype)
            if wanted is not None and wanted != datatype:
                raise MappingError(f"{term} is not of type {ptype}")
            return Value(parse_literal(value, datatype), RdfType("literal", datatype), F.lit(lang) if lang else None)
        case Blank(label):
            # one node for each row and place of the label
            return Value(F.concat(F.lit(f"_:{label or 'b'}-{path if not label else path.split('/')[0]}-"), scope.row.cast("string")), IRI, needs=scope.row_needs)
        case NoneTerm():
            return Value(F.lit(None).cast("string"), NONE)
        case ListTerm(items):
            inner = ptype.inner if isinstance(ptype, Wrapped) else ptype
            values = [argument(x, inner, scope, f"{path}.{i}") for i, x in enumerate(items)]
            kinds = {v.kind for v in values if v.kind != NONE}
            if len(kinds) > 1:
                raise MappingError(f"the list {term} has items of several types")
            kind = next(iter(kinds), NONE)
            return Value(F.array(*[v.column for v in values]), kind, next((v.lang for v in values if v.lang is not None), None), True, needs=frozenset().union(*[v.needs for v in values]))
    raise MappingError(f"{term} is no constant")


def argument(term: Term, ptype: PType | None, scope: Scope, path: str) -> Value:
    if isinstance(term, Var):
        return scope.values[term.name]
    return constant(term, ptype, scope, path)


def _with_default(v: Value, p: Parameter, scope: Scope, path: str) -> Value:
    if p.default is None:
        return v
    d = constant(p.default, p.ptype, scope, path)
    if v.kind == NONE:
        return d
    return replace(v, column=F.coalesce(v.column, d.column), source=None, constant=None, needs=v.needs | d.needs, element=None)


def _expanded(instance: Instance, values: list[Value], scope: Scope) -> tuple[list[Value], Scope]:
    """Elements in the place of the arguments marked ++."""
    at = [i for i, a in enumerate(instance.arguments) if a.expand]
    if not instance.expander and at:
        raise MappingError(f"{instance.template}: ++ without an expander")
    if not at:
        return values, scope
    if not all(values[i].is_list for i in at):
        raise MappingError(f"{instance.template}: ++ on an argument that is no list")
    names = {i: f"++{next(_elements)}" for i in at}
    groups = [[i] for i in at] if instance.expander == "cross" else [at]
    spreads = [Spread({names[i]: values[i].column for i in g}, instance.expander, frozenset().union(*[values[i].needs for i in g])) for g in groups]
    row = F.concat_ws("-", scope.row.cast("string"), F.xxhash64(*[F.col(f"`{x}`") for x in names.values()]).cast("string"))
    new = [Value(F.col(f"`{names[i]}`"), v.kind, v.lang, needs=frozenset({names[i]}), element=names[i]) if i in names else v for i, v in enumerate(values)]
    return new, replace(scope, row=row, row_needs=scope.row_needs.union(names.values()), spreads=(*scope.spreads, *spreads))


def _plain(kind: T.DataType) -> bool:
    """Of which array_distinct tells the values apart as de-duplication does (zeros have signs), and by hashes."""
    return kind == T.StringType() or isinstance(kind, T.IntegralType | T.BooleanType | T.DecimalType | T.DateType | T.TimestampType | T.TimestampNTZType)


def _spread(frame: DataFrame, spread: Spread, names: list[str]) -> DataFrame:
    """``frame`` with a row for each element (cross) or place (zip) of the lists, and columns for ``names`` of them."""
    if spread.expander == "cross":
        (name,) = names
        return frame.withColumn(name, F.explode_outer(F.array_distinct(spread.lists[name])))  # a graph is a set
    lists = [F.coalesce(x, F.array()) if spread.expander == "zipMin" else x for x in spread.lists.values()]
    sizes = [F.size(x) for x in lists]
    if spread.expander == "zipMin":
        shortest = F.least(*sizes) if len(lists) > 1 else sizes[0]
        cut = {n: F.slice(x, F.lit(1), shortest) for n, x in zip(spread.lists, lists, strict=True)}
    elif len(names) == len(lists):
        cut = spread.lists
    else:  # of the places that only the others have, one stands for all; a list that is null has none, nor have the others
        longest, whole = F.greatest(*sizes), reduce(and_, [x.isNotNull() for x in lists])
        cut = {n: F.when(whole, F.when(F.size(x) < longest, F.concat(x, F.array(F.lit(None)))).otherwise(x)) for n, x in spread.lists.items()}
    if len(names) == 1:
        one = cut[names[0]]
        return frame.withColumn(names[0], F.explode_outer(F.array_distinct(one) if _plain(frame.select(one.alias("l")).schema["l"].dataType.elementType) else one))
    zipped = F.arrays_zip(*[cut[n].alias(f"z{k}") for k, n in enumerate(names)])
    fields = [f.name for f in frame.select(zipped.alias("z")).schema["z"].dataType.elementType.fields]
    frame = frame.withColumn("++", F.explode_outer(zipped))
    return frame.withColumns({n: F.col("`++`").getField(f) for n, f in zip(names, fields, strict=True)}).drop("++")


def _rows(scope: Scope, needs: frozenset[str]) -> tuple[DataFrame, frozenset[str]]:
    """The scope's rows with the elements ``needs`` and those that tell which rows count; these elements."""
    own = {n: s for s in scope.spreads for n in s.lists}
    before = None
    while needs != before:
        before = needs
        for v in scope.filled:
            if v.element is None or own[v.element].expander != "cross":
                needs |= v.needs
            else:  # of a list that is not asked for it is enough that it has a value
                needs |= own[v.element].needs
        for n in needs:
            needs |= own[n].needs
    frame = scope.frame
    for v in scope.filled:
        if not v.needs:
            frame = frame.where(v.column.isNotNull())
    for s in scope.spreads:
        if names := [n for n in s.lists if n in needs]:
            frame = _spread(frame, s, names)
        elif any(v.element in s.lists for v in scope.filled):
            frame = frame.where(F.exists(*s.lists.values(), lambda x: x.isNotNull()))
    for v in scope.filled:
        if v.needs and v.needs <= needs:
            frame = frame.where(v.column.isNotNull())
    return frame, needs


def expand_instance(templates: Templates, instance: Instance, scope: Scope, store: GraphStore, path: str) -> None:
    template = templates.find(instance.template)
    values = [argument(a.term, p.ptype if not a.expand else Wrapped("List", p.ptype), scope, f"{path}.{i}") for i, (a, p) in enumerate(zip(instance.arguments, template.parameters, strict=True))]
    values, scope = _expanded(instance, values, scope)
    if template.iri == TRIPLE:
        _triple(values, scope, store)
        return
    if template.body is None:
        return
    inner = {p.name: _with_default(v, p, scope, path) for p, v in zip(template.parameters, values, strict=True)}
    # an argument without a value for a parameter that needs one makes no instance
    needed = [inner[p.name] for p in template.parameters if not p.optional and p.default is None and (inner[p.name].source is None or scope.spreads) and inner[p.name].constant is None]
    scope = replace(scope, values=inner)
    if scope.spreads:
        scope = replace(scope, filled=(*scope.filled, *needed))
    elif needed and scope.unique is None:
        frame = scope.frame
        for n in needed:
            frame = frame.where(n.column.isNotNull())
        scope = replace(scope, frame=frame, frame_id=next(_frames))
    for i, part in enumerate(template.body):
        expand_instance(templates, part, scope, store, f"{path}/{i}")


def _triple(values: list[Value], scope: Scope, store: GraphStore) -> None:
    subject, verb, obj = values
    if NONE in (subject.kind, verb.kind, obj.kind):
        return
    if subject.kind != IRI or verb.kind != IRI:
        raise MappingError("subjects and verbs are IRIs")
    if subject.is_list or obj.is_list:
        raise MappingError("a triple has no list terms; use an expander")
    lang = obj.lang if obj.kind == RdfType("literal", XSD + "string") else None
    frame, needs = _rows(scope, subject.needs | verb.needs | obj.needs)
    # elements of one list, each once in a row
    once = needs == {obj.element} and not subject.needs | verb.needs and _plain(kind := frame.schema[obj.element].dataType) and kind.simpleString() == spark_type(obj.kind)
    unique = (once or not needs) and scope.unique is not None and scope.unique <= {v.source for v in values}
    star = (scope.frame_id, subject.source) if not scope.spreads and scope.unique is not None and scope.unique == {subject.source} else None
    if verb.constant is not None:
        if subject.source is None and obj.source is None and subject.constant and obj.constant:
            frame = frame.limit(1)  # alike for all rows
        piece = Piece(frame, subject.column, obj.column, lang, unique, star)
        if once and not unique and subject.constant is None:
            subjects = Subjects(scope.frame, subject.column)
            piece.subjects = store.subjects.setdefault((scope.frame_id, subject.source), subjects) if subject.source else subjects
            piece.made = lambda part: _rows(replace(scope, frame=part), needs)[0]
        store.add(verb.constant, obj.kind, piece)
        return
    named = frame.select(subject.column.alias("s"), verb.column.alias("v"), obj.column.alias("o"))
    store.add_named(obj.kind, named, F.col("s"), F.col("v"), F.col("o"), lang, unique)


def expand(templates: Templates, template: Template, frame: DataFrame, store: GraphStore, unique_subset: list[str] | None = None, tags: dict[str, str] | None = None, validate: bool = True) -> None:
    values = column_types(template, frame, tags or {})
    if validate:
        check_values(template, frame)
    unique = frozenset(unique_subset) if unique_subset else frozenset({"*"})  # "*": not known
    hashable = [F.col(f"`{f.name}`").cast("string") for f in frame.schema.fields]
    scope = Scope(frame, next(_frames), {}, F.abs(F.xxhash64(*hashable)) if hashable else F.lit(0), unique)
    for p in template.parameters:
        v = values.get(p.name)
        values[p.name] = constant(p.default, p.ptype, scope, p.name) if v is None else _with_default(v, p, scope, p.name)
    if template.iri == TRIPLE:
        _triple([values[p.name] for p in template.parameters], scope, store)
        return
    scope = replace(scope, values=values)
    for i, part in enumerate(template.body or ()):
        expand_instance(templates, part, scope, store, f"{template.iri.rsplit('/', 1)[-1]}/{i}")


def default_template(frame: DataFrame, key: str, foreign: list[str], name: str, prefix: str) -> Template:
    """A template that makes a triple of each column but the key: the key is the subject's IRI, foreign keys are
    IRIs, others literals; lists are crossed out."""
    for c in [key, *foreign]:
        if c not in frame.columns:
            raise MappingError(f"the column {c} is missing")
        if not isinstance(frame.schema[c].dataType, T.StringType) and not (c != key and isinstance(frame.schema[c].dataType, T.ArrayType)):
            raise MappingError(f"the column {c} holds IRIs and must be of strings")
    parameters, body = [], []
    for f in frame.schema.fields:
        is_list = isinstance(f.dataType, T.ArrayType)
        ptype: PType | None = Basic(ANY_URI) if f.name == key or f.name in foreign else Basic(infer(f.dataType).datatype)
        parameters.append(Parameter(f.name, Wrapped("List", ptype) if is_list else ptype, f.name != key))
        if f.name != key:
            body.append(Instance(TRIPLE, (Argument(Var(key)), Argument(Iri(prefix + f.name)), Argument(Var(f.name), is_list)), "cross" if is_list else ""))
    return Template(name, parameters, body)
