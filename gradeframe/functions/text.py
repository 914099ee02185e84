"""String expressions: template filling and the spellings that identifiers depend on."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

# The characters str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def fill(template: str, **values: Column) -> Column:
    """A ``str.format`` template as one concat; a null value prints as None."""
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(F.coalesce(values[field].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def list_text(c: Column) -> Column:
    """An integer array as ``[1, 0, 2]``, a null array as ``None``."""
    body = F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    return F.when(c.isNull(), "None").otherwise(F.concat(F.lit("["), body, F.lit("]")))


def _code_unit(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))


def _escaped_char(ch: Column) -> Column:
    code = F.ascii(ch)
    high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
    low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
    return (
        F.when(ch == '"', '\\"')
        .when(ch == "\\", "\\\\")
        .when(ch == "\n", "\\n")
        .when(ch == "\r", "\\r")
        .when(ch == "\t", "\\t")
        .when(ch == "\b", "\\b")
        .when(ch == "\f", "\\f")
        .when(code > 0xFFFF, F.concat(_code_unit(high), _code_unit(low)))
        .when((code < 32) | (code > 126), _code_unit(code))
        .otherwise(ch)
    )


def json_string(c: Column) -> Column:
    """A JSON string literal in ASCII, escaped the way ``json.dumps`` does it.

    Plain text takes the first branch; only text with special characters is walked through.
    """
    plain = c.rlike(r'^[ !#-\[\]-~]*$')
    walked = F.array_join(F.transform(F.split(c, ""), _escaped_char), "")
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(walked), F.lit('"'))


def id_json(c: Column, quoted: bool = True) -> Column:
    """``{"id": ...}`` for a string or a number."""
    value = json_string(c.cast("string")) if quoted else c.cast("string")
    return F.concat(F.lit('{"id": '), value, F.lit("}"))
