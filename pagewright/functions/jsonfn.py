"""JSON column functions: cleaning model replies, strict validity, truthiness.

All of them are built-in column expressions (they stay inside whole-stage
codegen); none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
# the opening fence removed from every reply is the three backticks, the word
# "json" and one newline.
FENCE_OPEN = "```json\n"
# Keys wrapped around a value to test that it is one complete JSON value.
_SENTINEL_HEAD = '{"__v__":'
_SENTINEL_TAIL = ',"__end__":1}'

# JSON texts that Python treats as false (besides numeric zero).
_FALSY_TEXTS = ["null", '""', "false", "[]", "{}"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_json(col: Column | str, strict: bool = False) -> Column:
    """Text of a model reply with its code fences removed.

    Every opening fence is removed.  With ``strict=True`` everything after the
    last newline is then dropped, exactly as the reference does (this also
    drops a last line that is not a fence, and leaves a fence in when text
    follows it).  The default drops the last closing fence and whatever
    follows it, and nothing when no closing fence is there.
    """
    c = F.replace(_c(col), F.lit(FENCE_OPEN), F.lit(""))
    if strict:
        return F.regexp_replace(c, r"\n[^\n]*\z", "")
    return F.regexp_replace(c, r"\n```[^`]*\z", "")


def is_valid_json(col: Column | str) -> Column:
    """True when the text is exactly one complete JSON value (any type).

    ``from_json`` alone accepts text after the first complete value, so the
    text is wrapped as the value of a sentinel object; the wrapper only parses
    to its two keys when nothing trails the value.  NULL input gives false.
    """
    wrapped = F.concat(F.lit(_SENTINEL_HEAD), _c(col), F.lit(_SENTINEL_TAIL))
    parsed = F.from_json(wrapped, "map<string,string>", {"allowSingleQuotes": "false"})
    return F.coalesce(
        F.map_keys(parsed) == F.array(F.lit("__v__"), F.lit("__end__")), F.lit(False)
    )


def is_truthy_json(json_text: Column | str) -> Column:
    """Python truthiness of a JSON value given as its (minified) JSON text.

    False for null, "", false, [], {} and numeric zero; true otherwise, which
    keeps the strings "0" and "false".  NULL input (key absent) is false.
    """
    t = _c(json_text)
    num = t.try_cast("double")
    return (
        t.isNotNull()
        & ~t.isin(*_FALSY_TEXTS)
        & F.coalesce(num != F.lit(0.0), F.lit(True))
    )


def compute_once(df, **cols):
    """Add derived columns through a one-row generator.

    Filters on the new columns cannot be pushed below a generator, so each
    expression is evaluated once per row (instead of once in the filter and
    again in the projection), and after any repartition above the scan.
    """
    from pyspark.sql import functions as F

    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


# One string literal of a valid JSON text: possessive, so Java matches it without recursion.
_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
# The same body up to the closing mark (a mark escape right before the closing quote).
_BODY_TO_MARK = r'[^"\\]*+(?:\\(?!u0001").[^"\\]*+)*+'
# A control character cannot stand unescaped in valid JSON, so it can fence off numbers.
_FENCE = "\x03"
_STRING_MARK, _NUMBER_MARK = "\x01", "\x02"


def _marked(json_text: Column) -> Column:
    """A valid JSON text, minified, with the kind of every scalar marked.

    Strings (keys too) get ``\\u0001`` at both ends, numbers become strings
    that start with ``\\u0002``.  The parser then neither reformats a number
    nor hides whether a value was a string.
    """
    t = F.regexp_replace(json_text, rf'(?s)("{_BODY}")|[ \t\r\n]+', "$1")
    t = F.regexp_replace(t, rf'(?s)("{_BODY}")|(-?(?:[0-9][-+.0-9eE]*+|Infinity)|NaN)', f"$1{_FENCE}$2{_FENCE}")
    t = F.replace(t, F.lit(_FENCE * 2), F.lit(""))
    t = F.regexp_replace(t, rf'(?s)"({_BODY})"', r'"\\u0001$1\\u0001"')
    return F.regexp_replace(t, f"{_FENCE}([^{_FENCE}]*+){_FENCE}", r'"\\u0002$1"')


def _value_text(marked: Column) -> Column:
    """JSON text of one parsed, marked value: numbers and nested key order as written."""
    first = F.substring(marked, 1, 1)
    nested = F.regexp_replace(marked, rf'(?s)("\\u0001{_BODY}")|"\\u0002([^"]*+)"', "$1$2")
    nested = F.regexp_replace(nested, rf'(?s)"\\u0001({_BODY_TO_MARK})\\u0001"', '"$1"')
    return (
        F.when(marked.isNull(), F.lit("null"))
        .when(first == _STRING_MARK, F.to_json(marked.substr(F.lit(2), F.length(marked) - 2).cast("variant")))
        .when(first == _NUMBER_MARK, marked.substr(F.lit(2), F.length(marked)))
        .otherwise(nested)
    )


def object_entries(json_text: Column | str) -> Column:
    """Ordered entries of a JSON object as ``array<struct<key, value>>``.

    ``value`` is the value's minified JSON text as written: numbers keep their
    form (``1.0``, ``12.50``, ``1e5``), nested objects their key order and
    repeated keys.  Key order and repeated keys of the object are kept too, so
    "last wins" can be decided by position.  Text that is not valid JSON, or
    not an object, gives NULL.
    """
    t = _c(json_text)
    parsed = F.from_json(F.when(is_valid_json(t), _marked(t)), "map<string,string>")
    return F.transform(
        F.map_entries(parsed),
        lambda e: F.struct(
            e["key"].substr(F.lit(2), F.length(e["key"]) - 2).alias("key"), _value_text(e["value"]).alias("value")
        ),
    )


# What json_kind knows, by the first character of a value's text.
_KIND_BY_START = {'"': "string", "{": "object", "[": "array", "t": "boolean", "f": "boolean", "n": "null"}


def json_kind(json_text: Column) -> Column:
    """Kind of a JSON value from its text: string, object, array, boolean, null or number."""
    kinds = F.create_map(*[F.lit(x) for pair in _KIND_BY_START.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.substring(json_text, 1, 1)), F.lit("number"))


def json_children(json_text: Column) -> Column:
    """``array<struct<key, value>>``: an object's entries, an array's items (``key`` NULL), none for other values.

    Values are texts as written, repeated keys are all there.  Text that is
    not valid JSON has no children.
    """
    first = F.substring(json_text, 1, 1)
    items = F.transform(
        F.from_json(F.when((first == "[") & is_valid_json(json_text), _marked(json_text)), "array<string>"),
        lambda v: F.struct(F.lit(None).cast("string").alias("key"), _value_text(v).alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.coalesce(F.when(first == "[", items).otherwise(object_entries(F.when(first == "{", json_text))), none)


# Strings of a JSON text, and all but the brackets.
_NOT_BRACKETS = rf'(?s)"{_BODY}"|[^\[\]{{}}]'


def json_depth(json_text: Column) -> Column:
    """How deep objects and arrays are nested (0: a scalar)."""
    brackets = F.split(F.regexp_replace(json_text, _NOT_BRACKETS, ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, c):
        now = acc["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(brackets, zero, step, lambda acc: acc["most"])
