"""SPARQL expressions as (column, RDF type). Errors are null; which operands can be compared is known statically.

Numbers: integers are computed as bigint, decimals with integers as decimals of 18 places, the others and quotients as
double; an overflow, a division by zero or text that is no number gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, functions as F

from ..errors import UnsupportedQuery
from ..sources.templates import Iri, Literal
from .terms import BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, FLOAT, INTEGER, INTEGERS, IRI, MIXED, NONE, NUMERIC, RDF, STRING, XSD, RdfType, is_numeric, lexical, literal, parse_literal, promote, spark_type


@dataclass(frozen=True)
class Value:
    column: Column
    kind: RdfType


Env = dict[str, Value]


def null(kind: RdfType = NONE) -> Value:
    return Value(F.lit(None).cast(spark_type(kind)), kind)


def _number(v: Value) -> Value:
    """A term that may be a number, as a number."""
    if v.kind == MIXED:
        return Value(F.when(v.column["dt"].isin(*sorted(NUMERIC)), v.column["lex"].try_cast("double")), DOUBLE)
    return v if is_numeric(v.kind) else null(DOUBLE)


def _text(v: Value) -> Column:
    return lexical(v.column, v.kind)


_TIMES = {XSD + "dateTime", XSD + "dateTimeStamp", XSD + "date"}


def _both_native(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Columns to compare natively, if the types allow."""
    if is_numeric(a.kind) and is_numeric(b.kind):
        return a.column, b.column
    if a.kind == b.kind and a.kind.kind in ("iri", "literal"):
        return a.column, b.column
    if a.kind.datatype in _TIMES and b.kind.datatype in _TIMES:
        return a.column.cast("timestamp"), b.column.cast("timestamp")
    return None


def equal(a: Value, b: Value) -> Column:
    if NONE in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    native = _both_native(a, b)
    if native:
        return native[0] == native[1]
    if MIXED in (a.kind, b.kind):
        other = b if a.kind == MIXED else a
        same = promote(a.column, a.kind) == promote(b.column, b.kind)
        if is_numeric(other.kind) or other.kind == MIXED:
            return same | F.coalesce(_number(a).column == _number(b).column, F.lit(False))
        return same
    # different kinds of terms are different; null operands stay null
    return F.when(a.column.isNotNull() & b.column.isNotNull(), F.lit(False))


def less(a: Value, b: Value, op: Callable[[Column, Column], Column]) -> Column:
    native = _both_native(a, b)
    if native:
        return op(*native)
    if MIXED in (a.kind, b.kind):
        x, y = _number(a), _number(b)
        if is_numeric(a.kind) or is_numeric(b.kind):
            return op(x.column, y.column)
        p, q = promote(a.column, a.kind), promote(b.column, b.kind)
        return F.coalesce(op(x.column, y.column), F.when((p["kind"] == q["kind"]) & (p["dt"] == q["dt"]) & ~p["dt"].isin(*sorted(NUMERIC)), op(p["lex"], q["lex"])))
    return F.lit(None).cast("boolean")


def boolean(v: Value) -> Column:
    """The effective boolean value."""
    if v.kind == BOOLEAN:
        return v.column
    if is_numeric(v.kind):
        return (v.column != 0) & ~F.isnan(v.column.cast("double"))
    if v.kind == STRING:
        return F.length(v.column) > 0
    if v.kind == MIXED:
        lex, dt = v.column["lex"], v.column["dt"]
        return F.when(dt == BOOLEAN.datatype, lex == "true").when(dt.isin(*sorted(NUMERIC)), lex.try_cast("double") != 0).when(dt.isin(STRING.datatype, RDF + "langString"), F.length(lex) > 0)
    return F.lit(None).cast("boolean")


def harmonised(values: list[Value]) -> tuple[list[Column], RdfType]:
    """Columns of one type: the common one, the wider number, or promoted."""
    kinds = {v.kind for v in values if v.kind != NONE}
    if not kinds:
        return [v.column for v in values], NONE
    if len(kinds) == 1:
        kind = kinds.pop()
    elif all(is_numeric(k) for k in kinds):
        names = {k.datatype for k in kinds}
        kind = INTEGER if names <= INTEGERS else DECIMAL if names <= INTEGERS | {DECIMAL.datatype} else DOUBLE
    else:
        return [promote(v.column, v.kind) for v in values], MIXED
    return [v.column.cast(spark_type(kind)) if v.kind != kind else v.column for v in values], kind


def _product(x: Column, y: Column) -> Column:
    """Of decimals. A product of 38 digits is exact where each side has at most nine before and nine after the point;
    else it is that of doubles, since Spark would cut it to six places."""
    a, b = x.try_cast("decimal(18,9)"), y.try_cast("decimal(18,9)")
    exact = F.try_multiply(a, b).try_cast(spark_type(DECIMAL))
    rounded = F.try_multiply(x.cast("double"), y.cast("double")).try_cast(spark_type(DECIMAL))
    return F.when((a == x) & (b == y), exact).otherwise(rounded)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "-" and a.kind == b.kind and a.kind.datatype in _TIMES:
        return Value(a.column - b.column, literal("duration")) if a.kind != DATE else Value((a.column.cast("timestamp") - b.column.cast("timestamp")), literal("duration"))
    a, b = _number(a), _number(b)
    kinds = {a.kind.datatype, b.kind.datatype}
    whole = kinds <= INTEGERS and op != "/"
    if not whole and op != "/" and kinds <= INTEGERS | {DECIMAL.datatype}:
        x, y = (v.column.try_cast(spark_type(DECIMAL)) for v in (a, b))
        made = _product(x, y) if op == "*" else {"+": F.try_add, "-": F.try_subtract}[op](x, y)
        return Value(made.try_cast(spark_type(DECIMAL)), DECIMAL)
    spark = "bigint" if whole else "double"
    x, y = a.column.cast(spark), b.column.cast(spark)
    out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op](x, y)
    if whole:
        return Value(out, INTEGER)
    if op != "/" and DOUBLE.datatype not in kinds:
        return Value(out.cast(spark_type(FLOAT)), FLOAT)
    return Value(out, DOUBLE)


def term(t) -> Value:
    if isinstance(t, Iri):
        return Value(F.lit(t.value), IRI)
    if isinstance(t, Literal) and t.lang:
        return Value(F.struct(F.lit("literal").alias("kind"), F.lit(t.value).alias("lex"), F.lit(RDF + "langString").alias("dt"), F.lit(t.lang).alias("lang")), MIXED)
    return Value(parse_literal(t.value, t.datatype), RdfType("literal", t.datatype))


def _like(v: Value, column: Column) -> Value:
    """A string made of another, with its language."""
    if v.kind == MIXED:
        return Value(F.when(column.isNotNull(), F.struct(v.column["kind"].alias("kind"), column.alias("lex"), v.column["dt"].alias("dt"), v.column["lang"].alias("lang"))), MIXED)
    return Value(column, STRING)


def _kind_is(v: Value, *kinds: str) -> Column:
    p = promote(v.column, v.kind)
    return F.when(p.isNotNull(), p["kind"].isin(*kinds))


def _datatype(v: Value) -> Value:
    if v.kind == MIXED:
        return Value(F.when(v.column["kind"] == "literal", v.column["dt"]), IRI)
    return Value(F.when(v.column.isNotNull(), F.lit(v.kind.datatype)), IRI) if v.kind.kind == "literal" else null(IRI)


def _lang(v: Value) -> Column:
    return F.when(v.column["kind"] == "literal", v.column["lang"]) if v.kind == MIXED else F.when(v.column.isNotNull(), F.lit("")) if v.kind.kind == "literal" else F.lit(None).cast("string")


def _part(name: str, f) -> Callable[[list[Value]], Value]:
    def run(args: list[Value]) -> Value:
        v = args[0]
        if v.kind == MIXED:
            column = v.column["lex"].try_cast("timestamp_ntz")
        elif v.kind.datatype in _TIMES:
            column = v.column
        else:
            return null(INTEGER)
        return Value(f(column).cast("bigint"), INTEGER)

    return run


def _rounding(f) -> Callable[[list[Value]], Value]:
    """Of whole numbers: themselves; else the type stays."""

    def run(args: list[Value]) -> Value:
        v = _number(args[0])
        if v.kind == DECIMAL:
            return Value(f(v.column).try_cast(spark_type(v.kind)), v.kind)
        return v if v.kind.datatype in INTEGERS else Value(f(v.column.cast("double")).cast(spark_type(v.kind)), v.kind)

    return run


def _whole(f) -> Callable[[list[Value]], Value]:
    """Unbound where the whole number does not fit a bigint."""

    def run(args: list[Value]) -> Value:
        v = _number(args[0])
        fits = F.abs(v.column) < 2.0**63 if v.kind in (FLOAT, DOUBLE) else F.lit(True)
        return Value(F.when(fits, f(v.column).try_cast("bigint")), INTEGER)

    return run


def _flags(args: list[Value], at: int, pattern: Column) -> Column:
    return F.concat(F.concat(F.lit("(?"), _text(args[at]), F.lit(")")), pattern) if len(args) > at else pattern


def _substr(args: list[Value]) -> Value:
    start = args[1].column.cast("int")
    text = _text(args[0])
    if len(args) == 2:
        return _like(args[0], F.substring(text, F.greatest(start, F.lit(1)), F.char_length(text) + 1))
    end = start + args[2].column.cast("int")
    begin = F.greatest(start, F.lit(1))
    return _like(args[0], F.substring(text, begin, F.greatest(end - begin, F.lit(0))))


def _round(x: Column) -> Column:
    return F.floor(x + F.lit(Decimal("0.5")))


def _offset(v: Value) -> Column:
    if v.kind == literal("dateTimeStamp"):
        return F.date_format(v.column, "XXX")
    return F.when(v.column.isNotNull(), F.lit("")) if v.kind == DATETIME else F.lit(None).cast("string")


def _timezone(v: Value) -> Value:
    """The offset as a duration; unbound without one."""
    text = F.when(_offset(v) == "Z", "+00:00").otherwise(F.nullif(_offset(v), F.lit("")))
    hours, minutes = F.substring(text, 2, 2).cast("int"), F.substring(text, 5, 2).cast("int")
    parts = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    lex = F.concat(F.when(F.startswith(text, F.lit("-")), "-PT").otherwise("PT"), F.when(parts == "", "0S").otherwise(parts))
    return Value(F.when(text.isNotNull(), F.struct(F.lit("literal").alias("kind"), lex.alias("lex"), F.lit(XSD + "dayTimeDuration").alias("dt"), F.lit("").alias("lang"))), MIXED)


_digest = {"MD5": lambda c: F.md5(c.cast("binary")), "SHA1": F.sha1, "SHA256": lambda c: F.sha2(c, 256), "SHA384": lambda c: F.sha2(c, 384), "SHA512": lambda c: F.sha2(c, 512)}

FUNCTIONS: dict[str, Callable[[list[Value]], Value]] = {
    "YEAR": _part("year", F.year), "MONTH": _part("month", F.month), "DAY": _part("day", F.dayofmonth),
    "HOURS": _part("hour", F.hour), "MINUTES": _part("minute", F.minute), "SECONDS": _part("second", F.second),
    "ABS": lambda a: Value(F.abs((n := _number(a[0])).column), n.kind), "CEIL": _whole(F.ceil), "FLOOR": _whole(F.floor), "ROUND": _rounding(_round),
    "CONCAT": lambda a: Value(F.concat(*map(_text, a)), STRING),
    "STR": lambda a: Value(_text(a[0]), STRING), "LANG": lambda a: Value(_lang(a[0]), STRING), "DATATYPE": lambda a: _datatype(a[0]),
    "LANGMATCHES": lambda a: Value(F.when(_text(a[1]) == "*", _text(a[0]) != "").otherwise((F.lower(_text(a[0])) == F.lower(_text(a[1]))) | F.startswith(F.lower(_text(a[0])), F.concat(F.lower(_text(a[1])), F.lit("-")))), BOOLEAN),
    "IRI": lambda a: Value(_text(a[0]), IRI), "URI": lambda a: Value(_text(a[0]), IRI),
    "STRLEN": lambda a: Value(F.char_length(_text(a[0])).cast("bigint"), INTEGER), "SUBSTR": _substr,
    "UCASE": lambda a: _like(a[0], F.upper(_text(a[0]))), "LCASE": lambda a: _like(a[0], F.lower(_text(a[0]))),
    "STRSTARTS": lambda a: Value(F.startswith(_text(a[0]), _text(a[1])), BOOLEAN), "STRENDS": lambda a: Value(F.endswith(_text(a[0]), _text(a[1])), BOOLEAN),
    "CONTAINS": lambda a: Value(F.contains(_text(a[0]), _text(a[1])), BOOLEAN),
    "ENCODE_FOR_URI": lambda a: Value(F.replace(F.replace(F.url_encode(_text(a[0])), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), STRING),
    "REPLACE": lambda a: _like(a[0], F.regexp_replace(_text(a[0]), _flags(a, 3, _text(a[1])), _text(a[2]))),
    "REGEX": lambda a: Value(F.rlike(_text(a[0]), _flags(a, 2, _text(a[1]))), BOOLEAN),
    "TZ": lambda a: Value(_offset(a[0]), STRING), "TIMEZONE": lambda a: _timezone(a[0]), "NOW": lambda a: Value(F.current_timestamp(), literal("dateTimeStamp")),
    "RAND": lambda a: Value(F.rand(), DOUBLE), "UUID": lambda a: Value(F.concat(F.lit("urn:uuid:"), F.uuid()), IRI), "STRUUID": lambda a: Value(F.uuid(), STRING),
    **{name: (lambda a, f=f: Value(f(_text(a[0])), STRING)) for name, f in _digest.items()},
    "STRLANG": lambda a: Value(F.when(_text(a[0]).isNotNull(), F.struct(F.lit("literal").alias("kind"), _text(a[0]).alias("lex"), F.lit(RDF + "langString").alias("dt"), _text(a[1]).alias("lang"))), MIXED),
    "STRDT": lambda a: Value(F.when(_text(a[0]).isNotNull(), F.struct(F.lit("literal").alias("kind"), _text(a[0]).alias("lex"), _text(a[1]).alias("dt"), F.lit("").alias("lang"))), MIXED),
    "ISIRI": lambda a: Value(_kind_is(a[0], "iri"), BOOLEAN), "ISURI": lambda a: Value(_kind_is(a[0], "iri"), BOOLEAN), "ISBLANK": lambda a: Value(_kind_is(a[0], "blank"), BOOLEAN),
    "ISLITERAL": lambda a: Value(_kind_is(a[0], "literal"), BOOLEAN),
    "ISNUMERIC": lambda a: Value(F.when(promote(a[0].column, a[0].kind).isNotNull(), promote(a[0].column, a[0].kind)["dt"].isin(*sorted(NUMERIC))), BOOLEAN),
    "SAMETERM": lambda a: Value(promote(a[0].column, a[0].kind) == promote(a[1].column, a[1].kind), BOOLEAN),
    "BNODE": lambda a: Value(F.concat(F.lit("_:"), F.md5(_text(a[0]).cast("binary")) if a else F.replace(F.uuid(), F.lit("-"), F.lit(""))), IRI),
}


def _strbefore(a: list[Value]) -> Value:
    x, y = _text(a[0]), _text(a[1])
    return _like(a[0], F.when(F.contains(x, y), F.substring(x, F.lit(1), F.instr(x, y) - 1)).otherwise(""))


def _strafter(a: list[Value]) -> Value:
    x, y = _text(a[0]), _text(a[1])
    return _like(a[0], F.when(F.contains(x, y), F.substring(x, F.instr(x, y) + F.char_length(y), F.char_length(x))).otherwise(""))


FUNCTIONS |= {"STRBEFORE": _strbefore, "STRAFTER": _strafter}


def cast(v: Value, datatype: str) -> Value:
    kind = RdfType("literal", datatype)
    text = F.when(v.column, "1").otherwise("0") if v.kind == BOOLEAN and datatype in NUMERIC else _text(v)
    if datatype in INTEGERS:
        # numbers are cut off; text must be a whole number
        whole = _number(v).column.try_cast("bigint") if is_numeric(v.kind) else F.trim(text).try_cast("bigint")
        return Value(whole.try_cast(spark_type(kind)), kind)
    if datatype == XSD + "string":
        return Value(_text(v), STRING)
    if datatype == XSD + "boolean" and is_numeric(v.kind):
        return Value(v.column != 0, BOOLEAN)
    if v.kind.datatype in _TIMES and datatype in _TIMES:
        return Value(v.column.cast(spark_type(kind)), kind)
    return Value(F.trim(text).try_cast(spark_type(kind)), kind)


class Compiler:
    """Compiles expressions over the variables of ``env``; ``exists`` gives the marker column of a pattern."""

    def __init__(self, env: Env, exists: Callable[[object], Column] | None = None):
        self.env, self.exists = env, exists

    def value(self, e: tuple) -> Value:
        match e:
            case ("var", name):
                return self.env.get(name) or null()
            case ("term", t):
                return term(t)
            case ("op", "||", a, b):
                return Value(self.condition(a) | self.condition(b), BOOLEAN)
            case ("op", "&&", a, b):
                return Value(self.condition(a) & self.condition(b), BOOLEAN)
            case ("op", "!", a):
                return Value(~self.condition(a), BOOLEAN)
            case ("op", "=", a, b):
                return Value(equal(self.value(a), self.value(b)), BOOLEAN)
            case ("op", "!=", a, b):
                return Value(~equal(self.value(a), self.value(b)), BOOLEAN)
            case ("op", ("<" | "<=" | ">" | ">=") as op, a, b):
                compare = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
                return Value(less(self.value(a), self.value(b), compare), BOOLEAN)
            case ("op", ("+" | "-" | "*" | "/") as op, a, b):
                return arithmetic(op, self.value(a), self.value(b))
            case ("op", "neg", a):
                n = _number(self.value(a))
                return Value(-n.column, n.kind)
            case ("op", "pos", a):
                return _number(self.value(a))
            case ("in", a, items):
                x = self.value(a)
                out = F.lit(False)
                for i in items:
                    out = out | equal(x, self.value(i))
                return Value(out, BOOLEAN)
            case ("exists", pattern):
                if self.exists is None:
                    raise UnsupportedQuery("EXISTS cannot stand here")
                return Value(self.exists(pattern), BOOLEAN)
            case ("call", "BOUND", ("var", name)):
                return Value(self.env[name].column.isNotNull() if name in self.env else F.lit(False), BOOLEAN)
            case ("call", "IF", c, a, b):
                (x, y), kind = harmonised([self.value(a), self.value(b)])
                test = self.condition(c)
                return Value(F.when(test.isNull(), F.lit(None)).when(test, x).otherwise(y), kind)
            case ("call", "COALESCE", *args):
                columns, kind = harmonised([self.value(a) for a in args])
                return Value(F.coalesce(*columns), kind)
            case ("call", name, *args):
                values = [self.value(a) for a in args]
                if name in FUNCTIONS:
                    return FUNCTIONS[name](values)
                if name.startswith(XSD) and len(values) == 1:
                    return cast(values[0], name)
                raise UnsupportedQuery(f"unknown function {name}")
        raise UnsupportedQuery(f"cannot compute {e[0]!r}")

    def condition(self, e: tuple) -> Column:
        return boolean(self.value(e))
