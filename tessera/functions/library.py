"""Scalar functions with their own semantics, declared as SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN``).

Catalyst inlines the bodies, so they take part in code generation and pushdown like any expression. Names carry the
prefix ``fx_`` so that they never shadow Spark's own. ``expression`` turns a template such as ``UPPER(TRIM({name}))`` into
a Column: fields in braces are quoted, names of the library get the prefix, and Spark does the rest."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PREFIX = "fx_"

# The accented letters that are replaced, and what by.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC"
#: Texts without a character beyond ASCII are left as they are.
UNACCENTED = rf"CASE WHEN s RLIKE '[^\\x00-\\x7F]' THEN translate(s, '{ACCENTED}', '{PLAIN}') ELSE s END"
# What an email address and a URL look like.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$"
URL = r"^https?://[^\\s/$.?#].[^\\s]*$"
# Strftime directives and the Java patterns that print the same.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%j": "DDD", "%I": "hh", "%p": "a", "%%": "%"}

TRUTHY = "(CASE WHEN {0} IS NULL THEN false ELSE lower({0}) NOT IN ('', '0', 'false', '0.0') END)"

#: name -> (parameters, result type, body). Each body is one SQL expression over its parameters.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # text
    "UPPER": ("s STRING", "STRING", "upper(s)"),
    "LOWER": ("s STRING", "STRING", "lower(s)"),
    "TRIM": ("s STRING", "STRING", r"regexp_replace(s, '(?U)^\\s+|\\s+$', '')"),
    "LTRIM": ("s STRING", "STRING", r"regexp_replace(s, '(?U)^\\s+', '')"),
    "RTRIM": ("s STRING", "STRING", r"regexp_replace(s, '(?U)\\s+$', '')"),
    "LENGTH": ("s STRING", "BIGINT", "cast(octet_length(s) AS BIGINT)"),  # bytes
    "SUBSTRING": ("s STRING, start INT, len INT", "STRING", "CASE WHEN start < 0 THEN '' ELSE substring(s, greatest(start, 1), len) END"),
    "REPLACE": ("s STRING, what STRING, by STRING", "STRING", "replace(s, what, by)"),
    "CONCAT": ("a STRING, b STRING", "STRING", "concat_ws('', a, b)"),  # nulls are skipped
    "LEFT": ("s STRING, n INT", "STRING", "left(s, n)"),
    "RIGHT": ("s STRING, n INT", "STRING", "right(s, n)"),
    "REPEAT": ("s STRING, n INT", "STRING", "repeat(s, n)"),
    "REVERSE": ("s STRING", "STRING", "reverse(s)"),
    "SPLIT_PART": ("s STRING, by STRING, n INT", "STRING", "CASE WHEN n < 1 THEN raise_error('part numbers start at 1') ELSE split_part(s, by, n) END"),
    "CAPITALIZE": ("s STRING", "STRING", "concat(upper(left(s, 1)), substring(s, 2))"),
    "TITLE_CASE": ("s STRING", "STRING", r"initcap(trim(regexp_replace(s, '(?U)\\s+', ' ')))"),
    "SLUG": ("s STRING", "STRING", r"trim('-' FROM regexp_replace(lower(s), '[^\\p{L}\\p{N}]+', '-'))"),
    "REMOVE_ACCENTS": ("s STRING", "STRING", UNACCENTED),
    "TRANSLITERATE": ("s STRING", "STRING", UNACCENTED),
    "MASK": ("s STRING, ch STRING, a INT, b INT", "STRING", "CASE WHEN a + b >= char_length(s) THEN s ELSE concat(left(s, a), repeat(ch, char_length(s) - a - b), right(s, b)) END"),
    "TRUNCATE": ("s STRING, n INT, suffix STRING", "STRING", "CASE WHEN char_length(s) > n THEN concat(left(s, n), coalesce(suffix, '...')) ELSE s END"),
    # numbers
    "ABS": ("x DOUBLE", "DOUBLE", "abs(x)"),
    "ROUND": ("x DOUBLE, d INT", "DOUBLE", "sign(x) * floor(abs(x) * pow(10, d) + 0.5D) / pow(10, d)"),  # half away from zero
    "FLOOR": ("x DOUBLE", "BIGINT", "floor(x)"),
    "CEIL": ("x DOUBLE", "BIGINT", "ceil(x)"),
    "POWER": ("x DOUBLE, y DOUBLE", "DOUBLE", "pow(x, y)"),
    "SQRT": ("x DOUBLE", "DOUBLE", "CASE WHEN x < 0 THEN cast(raise_error('square root of a negative number') AS DOUBLE) ELSE sqrt(x) END"),
    "MOD": ("x BIGINT, y BIGINT", "BIGINT", "x % y"),
    # dates
    "CURRENT_DATE": ("", "DATE", "current_date()"),
    "NOW": ("", "TIMESTAMP_NTZ", "localtimestamp()"),
    "DATE_ADD": ("d DATE, n INT", "DATE", "date_add(d, n)"),
    "DATE_DIFF": ("a DATE, b DATE", "BIGINT", "cast(datediff(a, b) AS BIGINT)"),
    "DATE_FORMAT": ("d TIMESTAMP_NTZ, p STRING", "STRING", "date_format(d, p)"),
    "FORMAT_DATE": ("d TIMESTAMP_NTZ, p STRING", "STRING", "date_format(d, p)"),
    "PARSE_DATE": ("s STRING, p STRING", "DATE", "to_date(s, p)"),
    "IS_VALID_DATE": ("s STRING, p STRING", "BOOLEAN", "try_to_date(s, p) IS NOT NULL"),
    "EXTRACT": ("unit STRING, d TIMESTAMP_NTZ", "BIGINT", "cast(CASE upper(unit) WHEN 'YEAR' THEN year(d) WHEN 'QUARTER' THEN quarter(d) WHEN 'MONTH' THEN month(d) WHEN 'WEEK' THEN weekofyear(d) WHEN 'DAY' THEN day(d) WHEN 'DOW' THEN weekday(d) + 1 WHEN 'DOY' THEN dayofyear(d) WHEN 'HOUR' THEN hour(d) WHEN 'MINUTE' THEN minute(d) WHEN 'SECOND' THEN second(d) END AS BIGINT)"),
    "DATE_TRUNC": ("unit STRING, d TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "CASE WHEN lower(unit) IN ('year', 'month', 'day', 'hour', 'minute') THEN cast(date_trunc(unit, d) AS TIMESTAMP_NTZ) END"),
    # nulls and conditions
    "COALESCE": ("a STRING, b STRING", "STRING", "coalesce(nullif(a, ''), nullif(b, ''))"),  # empty text counts as null
    "NULLIF": ("a STRING, b STRING", "STRING", "CASE WHEN a <=> b THEN NULL ELSE a END"),
    "IFNULL": ("a STRING, b STRING", "STRING", "ifnull(a, b)"),
    "IF": ("c BOOLEAN, a STRING, b STRING", "STRING", "if(coalesce(c, false), a, b)"),
    "CASE": ("c1 BOOLEAN, v1 STRING, c2 BOOLEAN, v2 STRING, other STRING", "STRING", "CASE WHEN coalesce(c1, false) THEN v1 WHEN coalesce(c2, false) THEN v2 ELSE other END"),
    "IS_NULL": ("s STRING", "BOOLEAN", "s IS NULL"),
    "IS_NOT_NULL": ("s STRING", "BOOLEAN", "s IS NOT NULL"),
    "IS_EMPTY": ("s STRING", "BOOLEAN", "s IS NULL OR s = ''"),
    "IS_NUMERIC": ("s STRING", "BOOLEAN", r"coalesce(s RLIKE '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$', false)"),
    "IS_EMAIL": ("s STRING", "BOOLEAN", f"coalesce(s RLIKE '{EMAIL}', false)"),
    "IS_URL": ("s STRING", "BOOLEAN", f"coalesce(s RLIKE '{URL}', false)"),
    "AND": ("a BOOLEAN, b BOOLEAN", "BOOLEAN", "coalesce(a, false) AND coalesce(b, false)"),  # two values
    "OR": ("a BOOLEAN, b BOOLEAN", "BOOLEAN", "coalesce(a, false) OR coalesce(b, false)"),
    "NOT": ("a BOOLEAN", "BOOLEAN", "NOT coalesce(a, false)"),
    # patterns
    "REGEX_MATCH": ("s STRING, p STRING", "BOOLEAN", "s RLIKE p"),
    "REGEX_REPLACE": ("s STRING, p STRING, by STRING", "STRING", "regexp_replace(s, p, by)"),
    "REGEX_EXTRACT": ("s STRING, p STRING", "STRING", r"CASE WHEN s RLIKE p THEN regexp_extract(s, p, if(regexp_replace(p, '\\\\\\\\.|[(][?]', '') LIKE '%(%', 1, 0)) END"),
    "REGEX_SPLIT": ("s STRING, p STRING", "ARRAY<STRING>", "split(s, p, -1)"),
    "REGEX_EXTRACT_ALL": ("s STRING, p STRING", "ARRAY<STRING>", "regexp_extract_all(s, p, 0)"),
    # casts: an error on bad input
    "TO_INTEGER": ("s STRING", "BIGINT", "cast(s AS BIGINT)"),
    "TO_FLOAT": ("s STRING", "DOUBLE", "cast(s AS DOUBLE)"),
    "TO_DATE": ("s STRING", "DATE", "to_date(s, 'yyyy-MM-dd')"),
    "TO_TIMESTAMP": ("s STRING", "TIMESTAMP_NTZ", "to_timestamp_ntz(s, 'yyyy-MM-dd HH:mm:ss')"),
    "TO_BOOLEAN": ("s STRING", "BOOLEAN", TRUTHY.format("s")),
    # operators with semantics of their own
    "ADD": ("a DOUBLE, b DOUBLE", "DOUBLE", "a + b"),
    "SUBTRACT": ("a DOUBLE, b DOUBLE", "DOUBLE", "a - b"),
    "MULTIPLY": ("a DOUBLE, b DOUBLE", "DOUBLE", "a * b"),
    "DIVIDE": ("a DOUBLE, b DOUBLE", "DOUBLE", "a / b"),  # an error on zero under ANSI
    "MODULO": ("a BIGINT, b BIGINT", "BIGINT", "a % b"),
    "JOIN_TEXT": ("a STRING, b STRING", "STRING", "concat(a, b)"),
    "EQUALS": ("a STRING, b STRING", "BOOLEAN", "a <=> b"),  # as text; null equals null
    "LESS": ("a STRING, b STRING", "BOOLEAN", "a < b"),  # as text, also for digits
    "LESS_NUMBER": ("a DOUBLE, b DOUBLE", "BOOLEAN", "a < b"),
    "LIKE": ("s STRING, p STRING", "BOOLEAN", r"s RLIKE concat('(?s)^\\Q', replace(p, '%', '\\E.*\\Q'), '\\E$')"),  # only % is a wildcard
    "AND_NULL": ("a BOOLEAN, b BOOLEAN", "BOOLEAN", "CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE a AND b END"),  # null if either is
    "OR_NULL": ("a BOOLEAN, b BOOLEAN", "BOOLEAN", "CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE a OR b END"),
    "NEGATE": ("x DOUBLE", "DOUBLE", "-x"),
    "NOT_TRUTHY": ("s STRING", "BOOLEAN", "NOT " + TRUTHY.format("s")),
    "TRUTHY": ("s STRING", "BOOLEAN", TRUTHY.format("s")),
    "WHEN_TRUTHY": ("c STRING, v STRING, other STRING", "STRING", f"CASE WHEN {TRUTHY.format('c')} THEN v ELSE other END"),
    "JSON_FIELD": ("s STRING, path STRING", "STRING", "get_json_object(s, concat('$.', path))"),
}


def names() -> list[str]:
    return list(FUNCTIONS)


def register(spark: SparkSession, only: Iterable[str] | None = None) -> None:
    """Declares the functions (or ``only`` some) in the session."""
    for name in only or FUNCTIONS:
        parameters, result, body = FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name.lower()}({parameters}) RETURNS {result} RETURN {body}")


def call(name: str, *args: Column | str) -> Column:
    """A function of the library, once registered, over columns."""
    return F.call_function(PREFIX + name.lower(), *args)


def expression(template: str) -> Column:
    """A Column from a template: ``{field}`` names a column, ``NAME(`` in capitals a function of the library, in
    small letters one of Spark."""
    known = "|".join(sorted(FUNCTIONS, key=len, reverse=True))
    text = re.sub(rf"\b({known})\(", lambda m: f"{PREFIX}{m[1].lower()}(", template)
    return F.expr(re.sub(r"\{([^{}]+)\}", lambda m: "`" + m[1].replace("`", "``") + "`", text))


def java_date_pattern(strftime: str) -> str:
    """A strftime pattern as Java's: ``%Y-%m-%d`` becomes ``yyyy-MM-dd``; other letters are quoted."""
    out = []
    for part in re.findall(r"%.|[^%]+", strftime):
        if part in STRFTIME:
            out.append(STRFTIME[part])
        elif part[0] == "%":
            raise ValueError(f"{part} is not supported")
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", part))
    return "".join(out)
