"""Judge texts to typed rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.schemas import METRICS

_FIELDS = {
    **{m: "struct<comment:string,score:variant>" for m in METRICS},
    "overall_score": "variant",
    "comment": "string",
    "overall_comment": "string",
    "stop_conversation": "variant",
    "stop_reason": "string",
}
_JUDGE = f"struct<{','.join(f'{name}:{kind}' for name, kind in _FIELDS.items())}>"
# What JSON5 allows beyond JSON and a reader option covers; the rest is rewritten, see plain_json.
_LENIENT = {
    "mode": "PERMISSIVE",
    "allowComments": "true",
    "allowSingleQuotes": "true",
    "allowUnquotedFieldNames": "true",
    "allowNumericLeadingZeros": "true",
    "allowUnquotedControlChars": "true",
}
_ANY_ESCAPE = {**_LENIENT, "allowBackslashEscapingAnyCharacter": "true"}
_FALSY_JSON = ("false", "null", "0", "0.0", "-0.0", '""', "{}", "[]")


def json_body(content: Column) -> Column:
    """From the first ``{`` to the last ``}``, null if there is no such span."""
    return F.nullif(F.regexp_extract(content, r"(?s)\{.*\}", 0), F.lit(""))


# The tokens of JSON5. A comma that JSON has no place for goes with the closing bracket behind it, a plus with its number.
_COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*"
_NUMBER = r"0[xX][0-9a-fA-F]++(?![\w.])|\d++\.?+\d*+"
_TOKENS = "|".join(
    [
        r'"(?:[^"\\]++|\\.)*+"',
        r"'(?:[^'\\]++|\\.)*+'",
        _COMMENT,
        rf",(?:\s|{_COMMENT})*+[}}\]]",
        rf"(?<=[:,\[\s/])\+(?:{_NUMBER}|\.\d++|I\w*+)",
        r"[A-Za-z_$][\w$]*+",
        _NUMBER,
        r"(?<![\w.])\.\d++",
        r"[\s:{}\[\]]++",
        ".",
    ]
)
_LOW_DIGITS, _EXACT_DIGITS = 15, 31


def _decimal(digits: Column) -> Column:
    """Hexadecimal digits as a decimal number: exact up to 31 digits, beyond as the nearest double."""
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    size = F.length(digits)

    def whole(part: Column) -> Column:
        low = F.conv(F.right(part, F.lit(_LOW_DIGITS)), 16, 10).cast("decimal(20,0)")
        high = F.conv(F.substring(part, F.lit(1), F.length(part) - _LOW_DIGITS), 16, 10).cast("decimal(20,0)")
        return high * F.lit(16**_LOW_DIGITS).cast("decimal(19,0)") + low

    # 28 digits hold more bits than a double; the last one says whether anything but zeros was cut off
    head, tail = F.left(digits, F.lit(28)), F.substring(digits, F.lit(29), size)
    kept = whole(head)
    sticky = F.when((kept % 2 == 0) & ~tail.rlike("^0*$"), kept + 1).otherwise(kept)
    return (
        F.when(size <= _LOW_DIGITS, F.conv(digits, 16, 10))
        .when(size <= _EXACT_DIGITS, whole(digits).cast("string"))
        .otherwise((sticky.cast("double") * F.pow(F.lit(16.0), size - 28)).cast("string"))
    )


def _plain_string(part: Column) -> Column:
    """A quoted string whose escapes JSON knows, or that stand for the character behind the backslash."""
    free = r"(?<!\\)((?:\\\\)*)\\"  # a backslash that no other one escapes
    known = F.regexp_replace(part, free + r"x([0-9a-fA-F]{2})", r"$1\\u00$2")
    known = F.regexp_replace(known, free + r"v", r"$1\\u000b")
    known = F.regexp_replace(known, free + r"0(?!\d)", r"$1\\u0000")
    known = F.regexp_replace(known, free + "(?:\r\n|[\n\r\u2028\u2029])", "$1")
    return F.when(part.contains("\\"), known).otherwise(part)


def _plain_token(part: Column) -> Column:
    more = F.length(part) > 1
    word = F.when(part.startswith("+") & more, F.substring(part, F.lit(2), F.length(part))).otherwise(part)
    first, second = F.left(word, F.lit(1)), F.substring(word, 2, 1)
    return (
        F.when(first.isin('"', "'"), _plain_string(part))
        .when((first == ",") & more, F.right(part, F.lit(1)))
        .when((first == "/") & second.isin("/", "*"), F.lit(""))
        .when((first == "0") & second.isin("x", "X"), _decimal(F.substring(word, F.lit(3), F.length(word))))
        .when((first == ".") & (second != ""), F.concat(F.lit("0"), word))
        .when(first.between("0", "9") & word.endswith("."), F.concat(word, F.lit("0")))
        .otherwise(word)
    )


def plain_json(body: Column) -> Column:
    """JSON5 text without comments, without commas before a closing bracket, with numbers and escapes spelled as JSON
    does. The text is cut into tokens once; each is rewritten by itself."""
    return F.array_join(F.transform(F.regexp_extract_all(body, F.lit(f"(?s){_TOKENS}"), F.lit(0)), _plain_token), "")


def _one(body: Column, schema: str, options: dict[str, str] = _LENIENT) -> Column:
    """The object that the whole text is, null if there is none or something else follows it."""
    read = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{schema}>", options)
    return F.when(F.size(read) == 1, F.get(read, F.lit(0)))


def lenient_json(df: DataFrame, body: str, schema: str, name: str) -> DataFrame:
    """Adds the parsed body. Only text that fails is rewritten and parsed again; the first result is
    a column of its own, so that no other row is parsed twice."""
    once = df.withColumn("_once", _one(F.col(body), schema))
    retry = _one(plain_json(F.col(body)), schema, _ANY_ESCAPE)
    return once.withColumn(name, F.coalesce("_once", retry)).drop("_once")


def lenient_map(body: str) -> Column:
    """The parsed body as key to JSON text, in the order of the text; rewritten only if it fails."""
    kind = "map<string,string>"
    return F.coalesce(_one(F.col(body), kind), _one(plain_json(F.col(body)), kind, _ANY_ESCAPE))


def score_number(score: Column) -> Column:
    """The number that a score is or spells, else null; a JSON boolean counts as 0 or 1.

    Casting also reads Java's suffixed spellings such as "3d", which are no numbers here.
    """
    kind = F.schema_of_variant(score)
    text = F.try_variant_get(score, "$", "string")
    return (
        F.when(kind == "BOOLEAN", (text == "true").cast("double"))
        .when(kind != "STRING", F.try_variant_get(score, "$", "double"))
        .when(~F.right(text, F.lit(1)).isin("d", "D", "f", "F"), text.try_cast("double"))
    )


def is_number(score: Column) -> Column:
    """Whether a given score is a JSON number or boolean; null if none is given."""
    kind = F.schema_of_variant(score)
    number = (kind == "BOOLEAN") | (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return F.when(kind != "VOID", number)


def is_stop(v: Column) -> Column:
    """Whether a JSON value is truthy: any non-empty string (even "false") counts."""
    return F.coalesce(~F.to_json(v).isin(*_FALSY_JSON), F.lit(False))


def parse_judge(df: DataFrame, col: str = "content") -> DataFrame:
    """Replace the judge's text by typed columns, absent ones filled with defaults.

    Adds per metric struct<comment, score>, comment, overall_comment, overall_score,
    stop_conversation, stop_reason (null if the key is absent), ``texts``: the names of scores that are
    given and are no JSON numbers, and ``parsed``: false if no JSON object with any known key came out.
    """
    rest = [c for c in df.columns if c != col]
    body = df.select(*rest, json_body(F.col(col)).alias("_body"))
    read = lenient_json(body, "_body", _JUDGE, "_j")
    j = F.col("_j")
    given = {**{m: j[m]["score"] for m in METRICS}, "overall": j["overall_score"]}
    texts = F.array_compact(F.array(*[F.when(~is_number(v), F.lit(m)) for m, v in given.items()]))
    metrics = [
        F.struct(
            F.coalesce(j[m]["comment"], F.lit("")).alias("comment"),
            score_number(given[m]).alias("score"),
        ).alias(m)
        for m in METRICS
    ]
    some = F.coalesce(*[F.when(j[k].isNotNull(), True) for k in _FIELDS], F.lit(False))
    return read.select(
        *rest,
        *metrics,
        F.coalesce(j["comment"], F.lit("")).alias("comment"),
        j["overall_comment"].alias("overall_comment"),
        score_number(given["overall"]).alias("overall_score"),
        is_stop(j["stop_conversation"]).alias("stop_conversation"),
        j["stop_reason"].alias("stop_reason"),
        texts.alias("texts"),
        some.alias("parsed"),
    )
