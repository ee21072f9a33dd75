"""RDF terms as Spark columns.

A column whose values all have one RDF type has that type's native Spark type, so that Catalyst can push filters
and compare without conversion; the RDF type stands beside it in the plan. Columns of mixed types, and strings with
language tags, are promoted to a struct of kind, lexical form, datatype and language.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from ..errors import MappingError

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OTTR = "http://ns.ottr.xyz/0.4/"
RDF_TYPE = RDF + "type"

TERM = "struct<kind:string,lex:string,dt:string,lang:string>"


@dataclass(frozen=True)
class RdfType:
    """kind: iri (blank nodes are IRIs that start with "_:"), literal, term (promoted, mixed) or none."""

    kind: str
    datatype: str = ""

    def __str__(self) -> str:
        return f"<{self.datatype}>" if self.datatype else self.kind


IRI, MIXED, NONE = RdfType("iri"), RdfType("term"), RdfType("none")


def literal(name: str) -> RdfType:
    return RdfType("literal", XSD + name)


STRING, BOOLEAN, INTEGER, DECIMAL, FLOAT, DOUBLE = map(literal, ("string", "boolean", "integer", "decimal", "float", "double"))
DATETIME, DATE, DURATION = map(literal, ("dateTime", "date", "duration"))

#: XSD type -> Spark type.
SPARK_TYPES = {
    "boolean": "boolean", "byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "integer": "bigint",
    "unsignedByte": "smallint", "unsignedShort": "int", "unsignedInt": "bigint", "unsignedLong": "decimal(20,0)",
    "nonNegativeInteger": "bigint", "positiveInteger": "bigint", "nonPositiveInteger": "bigint", "negativeInteger": "bigint",
    "float": "float", "double": "double", "decimal": "decimal(38,18)", "string": "string", "date": "date",
    "dateTime": "timestamp_ntz", "dateTimeStamp": "timestamp", "duration": "interval day to second",
}
INTEGERS = {XSD + n for n in SPARK_TYPES if SPARK_TYPES[n] in ("tinyint", "smallint", "int", "bigint", "decimal(20,0)")}
NUMERIC = INTEGERS | {XSD + "float", XSD + "double", XSD + "decimal"}


def is_numeric(t: RdfType) -> bool:
    return t.kind == "literal" and t.datatype in NUMERIC


def spark_type(t: RdfType) -> str:
    if t.kind == "term":
        return TERM
    return SPARK_TYPES.get(t.datatype.removeprefix(XSD), "string") if t.kind == "literal" else "string"


def infer(kind: T.DataType) -> RdfType:
    """The RDF type of a column's values, from its Spark type."""
    names = {
        T.BooleanType: "boolean", T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float",
        T.DoubleType: "double", T.DecimalType: "decimal", T.StringType: "string", T.DateType: "date", T.TimestampNTZType: "dateTime",
        T.TimestampType: "dateTimeStamp", T.DayTimeIntervalType: "duration",
    }
    if isinstance(kind, T.ArrayType):
        return infer(kind.elementType)
    if type(kind) not in names:
        raise MappingError(f"columns of type {kind.simpleString()} have no RDF type")
    return literal(names[type(kind)])


def parse_literal(lexical: str, datatype: str) -> Column:
    """A literal as a column of its native type; null if the text is not in the type's form."""
    name = datatype.removeprefix(XSD)
    try:
        if datatype in INTEGERS:
            return F.lit(int(lexical)).cast(SPARK_TYPES[name])
        if name == "decimal":
            return F.lit(lexical).try_cast(SPARK_TYPES[name])
        if name in ("double", "float"):
            return F.lit(float(lexical.replace("INF", "inf"))).cast(SPARK_TYPES[name])
        if name == "boolean":
            return F.lit({"true": True, "1": True, "false": False, "0": False}[lexical])
        if name == "date":
            return F.lit(dt.date.fromisoformat(lexical[:10]))
        if name in ("dateTime", "dateTimeStamp"):
            when = dt.datetime.fromisoformat(lexical)
            if name == "dateTime":
                when = when.astimezone(dt.UTC).replace(tzinfo=None) if when.tzinfo else when
                return F.to_timestamp_ntz(F.lit(when.isoformat(" ")))
            return F.lit(when.isoformat()).cast("timestamp")
        if name == "duration":
            m = re.fullmatch(r"(-?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", lexical)
            d, h, mi, s = (float(x or 0) for x in m.groups()[1:])
            total = (-1 if m[1] else 1) * (d * 86400 + h * 3600 + mi * 60 + s)
            return F.lit(dt.timedelta(seconds=total))
    except (ValueError, KeyError, AttributeError):
        return F.lit(None).cast(SPARK_TYPES.get(name, "string"))
    return F.lit(lexical)


def _fraction_of_threes(text: Column) -> Column:
    """Times with a fraction of no, three or six digits."""
    head, fraction = F.regexp_extract(text, r"^[^.]*", 0), F.regexp_extract(text, r"\.(\d+)$", 1)
    padded = F.when(F.length(fraction) <= 3, F.rpad(fraction, 3, "0")).otherwise(F.rpad(fraction, 6, "0"))
    return F.when(fraction == "", head).otherwise(F.concat(head, F.lit("."), padded))


def lexical(col: Column, t: RdfType) -> Column:
    """The text of a term: an IRI, or a literal's lexical form."""
    name = t.datatype.removeprefix(XSD)
    if t.kind == "term":
        return col["lex"]
    if name == "dateTime":
        return _fraction_of_threes(F.replace(col.cast("string"), F.lit(" "), F.lit("T")))
    if name == "dateTimeStamp":
        text = F.regexp_replace(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
        return F.concat(_fraction_of_threes(F.when(F.contains(F.date_format(col, "SSSSSS"), F.lit("000000")), F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(text)), F.date_format(col, "XXX"))
    if name == "decimal":
        return F.regexp_replace(col.cast(SPARK_TYPES[name]).cast("string"), r"\.?0+$", "")
    if name == "duration":
        seconds = F.abs(F.extract(F.lit("DAY"), col).cast("decimal(20,6)") * 86400 + F.extract(F.lit("HOUR"), col) * 3600 + F.extract(F.lit("MINUTE"), col) * 60 + F.extract(F.lit("SECOND"), col))
        return F.concat(F.when(col < F.expr("interval '0' second"), "-").otherwise(""), F.lit("PT"), F.regexp_replace(seconds.cast("string"), r"\.?0+$|(?<=\.\d{0,6}[1-9])0+$", ""), F.lit("S"))
    return col.cast("string")


def promote(col: Column, t: RdfType, lang: Column | None = None) -> Column:
    """A column as TERM structs; null stays null."""
    if t.kind == "term":
        return col
    if t.kind == "none":
        return F.lit(None).cast(TERM)
    lex = lexical(col, t)
    if t.kind == "iri":
        kind, datatype = F.when(F.startswith(lex, F.lit("_:")), "blank").otherwise("iri"), F.lit("")
    else:
        kind = F.lit("literal")
        datatype = F.lit(t.datatype) if lang is None else F.when(lang.isNull(), t.datatype).otherwise(RDF + "langString")
    made = F.struct(kind.alias("kind"), lex.alias("lex"), datatype.alias("dt"), (F.lit("") if lang is None else F.coalesce(lang, F.lit(""))).alias("lang"))
    return F.when(lex.isNotNull(), made)


def ntriples(term: Column) -> Column:
    """A TERM as N-Triples text."""
    quoted = term["lex"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    tail = F.when(term["lang"] != "", F.concat(F.lit("@"), term["lang"])).when(term["dt"] == XSD + "string", "").otherwise(F.concat(F.lit("^^<"), term["dt"], F.lit(">")))
    return F.when(term["kind"] == "iri", F.concat(F.lit("<"), term["lex"], F.lit(">"))).when(term["kind"] == "blank", term["lex"]).otherwise(F.concat(F.lit('"'), quoted, F.lit('"'), tail))
