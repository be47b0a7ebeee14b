"""One query for each scalar function, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import functions
from .base import query, table

#: query -> (table, key, expression of the library, the same in the oracle's SQL)
SCALARS: dict[str, tuple[str, str, str, str]] = {
    "h01_upper": ("customer", "c_custkey", "UPPER({c_name})", "upper(c_name)"),
    "h02_lower": ("customer", "c_custkey", "LOWER({c_mktsegment})", "lower(c_mktsegment)"),
    "h03_trim": ("customer", "c_custkey", r"TRIM(concat(' \t\n', {c_name}, '  '))", "c_name"),
    "h04_ltrim": ("customer", "c_custkey", r"LTRIM(concat(' \t', {c_name}, ' '))", "c_name || ' '"),
    "h05_rtrim": ("customer", "c_custkey", r"RTRIM(concat(' ', {c_name}, ' \n'))", "' ' || c_name"),
    "h06_length": ("documents", "doc_id", "LENGTH({text})", "octet_length(encode(text))"),
    "h07_substring": ("documents", "doc_id", "concat(SUBSTRING({text}, 0, 9), '|', SUBSTRING({text}, 3, 4), '|', SUBSTRING({text}, -2, 4))", "substring(text, 1, 9) || '|' || substring(text, 3, 4) || '|'"),
    "h08_replace": ("part", "p_partkey", "REPLACE({p_type}, 'E', '#')", "replace(p_type, 'E', '#')"),
    "h09_concat": ("customer", "c_custkey", "CONCAT({c_name}, nullif({c_mktsegment}, 'BUILDING'))", "concat(c_name, nullif(c_mktsegment, 'BUILDING'))"),
    "h10_left": ("customer", "c_custkey", "LEFT({c_name}, 5)", "left(c_name, 5)"),
    "h11_right": ("customer", "c_custkey", "RIGHT({c_name}, 5)", "right(c_name, 5)"),
    "h12_repeat": ("nation", "n_nationkey", "REPEAT({n_name}, 3)", "repeat(n_name, 3)"),
    "h13_reverse": ("part", "p_partkey", "REVERSE({p_name})", "reverse(p_name)"),
    "h14_split_part": ("part", "p_partkey", "SPLIT_PART({p_brand}, '#', 2)", "split_part(p_brand, '#', 2)"),
    "h15_abs": ("customer", "c_custkey", "ABS({c_acctbal})", "abs(c_acctbal)"),
    "h16_round": ("customer", "c_custkey", "ROUND({c_acctbal}, 1)", "sign(c_acctbal) * floor(abs(c_acctbal) * 10 + 0.5) / 10"),
    "h17_floor": ("customer", "c_custkey", "FLOOR({c_acctbal})", "floor(c_acctbal)::BIGINT"),
    "h18_ceil": ("customer", "c_custkey", "CEIL({c_acctbal})", "ceil(c_acctbal)::BIGINT"),
    "h19_power": ("part", "p_partkey", "POWER({p_size}, 2)", "pow(p_size::DOUBLE, 2)"),
    "h20_sqrt": ("part", "p_partkey", "SQRT({p_size})", "sqrt(p_size::DOUBLE)"),
    "h21_mod": ("orders", "o_orderkey", "MOD(-{o_orderkey}, 7)", "(-o_orderkey) % 7"),
    "h23_date_add": ("orders", "o_orderkey", "DATE_ADD(cast({o_orderdate} AS DATE), 30)", "(o_orderdate::DATE + 30)::DATE"),
    "h24_date_diff": ("orders", "o_orderkey", "DATE_DIFF(cast({o_orderdate} AS DATE), DATE '1995-01-01')", "date_diff('day', DATE '1995-01-01', o_orderdate::DATE)"),
    "h25_date_format": ("orders", "o_orderkey", f"DATE_FORMAT({{o_orderdate}}, '{functions.java_date_pattern('%d/%m/%Y')}')", "strftime(o_orderdate, '%d/%m/%Y')"),
    "h26_coalesce": ("orders", "o_orderkey", "COALESCE(nullif({o_orderstatus}, 'O'), COALESCE('', {o_orderpriority}))", "coalesce(nullif(nullif(o_orderstatus, 'O'), ''), o_orderpriority)"),
    "h27_nullif": ("orders", "o_orderkey", "NULLIF({o_orderstatus}, 'F')", "nullif(o_orderstatus, 'F')"),
    "h28_ifnull": ("orders", "o_orderkey", "IFNULL(nullif({o_orderstatus}, 'F'), 'none')", "ifnull(nullif(o_orderstatus, 'F'), 'none')"),
    "h29_cast": ("orders", "o_orderkey", "TO_INTEGER(cast({o_custkey} AS STRING)) + TO_FLOAT('0.5')", "o_custkey + 0.5::DOUBLE"),
    "h30_if": ("orders", "o_orderkey", "IF({o_totalprice} > 100000, 'large', 'small')", "CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END"),
    "h31_regex_match": ("part", "p_partkey", "REGEX_MATCH({p_type}, '^S.*L$')", "regexp_matches(p_type, '^S.*L$')"),
    "h32_regex_replace": ("part", "p_partkey", "REGEX_REPLACE({p_type}, '[AEIOU]', '_')", "regexp_replace(p_type, '[AEIOU]', '_', 'g')"),
    "h33_regex_extract": ("part", "p_partkey", "concat_ws('|', REGEX_EXTRACT({p_brand}, '#([0-9])'), REGEX_EXTRACT({p_type}, '[A-Z]+$'), REGEX_EXTRACT({p_type}, '[0-9]'))", "concat_ws('|', regexp_extract(p_brand, '#([0-9])', 1), regexp_extract(p_type, '[A-Z]+$'))"),
    "h34_regex_split": ("part", "p_partkey", "array_join(REGEX_SPLIT({p_type}, ' +'), '/')", "array_to_string(string_split_regex(p_type, ' +'), '/')"),
    "h35_regex_extract_all": ("part", "p_partkey", "array_join(REGEX_EXTRACT_ALL({p_type}, '[AEIOU]+'), '/')", "array_to_string(regexp_extract_all(p_type, '[AEIOU]+'), '/')"),
    "h36_parse_date": ("orders", "o_orderkey", "PARSE_DATE(date_format({o_orderdate}, 'dd.MM.yyyy'), 'dd.MM.yyyy')", "o_orderdate::DATE"),
    "h37_format_date": ("orders", "o_orderkey", f"FORMAT_DATE({{o_orderdate}}, '{functions.java_date_pattern('%Y%m%d-%H%M%S')}')", "strftime(o_orderdate, '%Y%m%d-%H%M%S')"),
    "h38_extract": ("events", "event_id", "EXTRACT('YEAR', {ts}) * 1000000 + EXTRACT('DOY', {ts}) * 1000 + EXTRACT('DOW', {ts}) * 100 + EXTRACT('HOUR', {ts})", "year(ts) * 1000000 + dayofyear(ts) * 1000 + isodow(ts) * 100 + hour(ts)"),
    "h40_date_trunc": ("events", "event_id", "DATE_TRUNC('hour', {ts})", "date_trunc('hour', ts)"),
    "h41_is_valid_date": ("orders", "o_orderkey", "IS_VALID_DATE(if({o_orderkey} % 3 = 0, '1995-13-40', if({o_orderkey} % 3 = 1, '1995-02-03', NULL)), 'yyyy-MM-dd')", "o_orderkey % 3 = 1"),
    "h42_case": ("orders", "o_orderkey", "CASE({o_totalprice} > 200000, 'a', {o_totalprice} > 100000, 'b', 'c')", "CASE WHEN o_totalprice > 200000 THEN 'a' WHEN o_totalprice > 100000 THEN 'b' ELSE 'c' END"),
    "h43_is_null": ("orders", "o_orderkey", "IS_NULL(nullif({o_orderstatus}, 'O'))", "nullif(o_orderstatus, 'O') IS NULL"),
    "h44_is_not_null": ("orders", "o_orderkey", "IS_NOT_NULL(nullif({o_orderstatus}, 'O'))", "nullif(o_orderstatus, 'O') IS NOT NULL"),
    "h45_is_empty": ("orders", "o_orderkey", "IS_EMPTY(if({o_orderstatus} = 'O', '', {o_orderstatus}))", "o_orderstatus = 'O'"),
    "h46_is_numeric": ("part", "p_partkey", "IS_NUMERIC(if({p_size} % 2 = 0, cast({p_retailprice} AS STRING), {p_name}))", "p_size % 2 = 0"),
    "h47_is_email": ("customer", "c_custkey", "IS_EMAIL(if({c_custkey} % 2 = 0, concat('c', {c_custkey}, '@example.org'), {c_name}))", "c_custkey % 2 = 0"),
    "h48_is_url": ("pages", "page_id", "IS_URL({url})", r"coalesce(regexp_full_match(url, 'https?://[^\s/$.?#].[^\s]*'), false)"),
    "h49_and": ("orders", "o_orderkey", "AND({o_totalprice} > 100000, nullif({o_orderstatus} = 'F', false))", "o_totalprice > 100000 AND o_orderstatus = 'F'"),
    "h50_or": ("orders", "o_orderkey", "OR({o_totalprice} > 100000, nullif({o_orderstatus} = 'F', false))", "o_totalprice > 100000 OR o_orderstatus = 'F'"),
    "h51_not": ("orders", "o_orderkey", "NOT(nullif({o_orderstatus} = 'F', false))", "o_orderstatus <> 'F'"),
    "h52_capitalize": ("customer", "c_custkey", "CAPITALIZE(lower({c_mktsegment}))", "upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2))"),
    "h53_title_case": ("part", "p_partkey", "TITLE_CASE(concat('  ', {p_type}, '   x '))", "array_to_string(list_transform(string_split(p_type || ' X', ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"),
    "h54_slug": ("part", "p_partkey", "SLUG(concat({p_type}, ' -- ', {p_brand}, '!'))", "trim(regexp_replace(lower(p_type || ' -- ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-')"),
    "h55_remove_accents": ("documents", "doc_id", "REMOVE_ACCENTS({text})", f"translate(text, '{functions.library.ACCENTED}', '{functions.library.PLAIN}')"),
    "h56_transliterate": ("documents", "doc_id", "TRANSLITERATE({text})", f"translate(text, '{functions.library.ACCENTED}', '{functions.library.PLAIN}')"),
    "h57_mask": ("customer", "c_custkey", "MASK({c_name}, '*', 2, 4)", "left(c_name, 2) || repeat('*', length(c_name) - 6) || right(c_name, 4)"),
    "h58_truncate": ("part", "p_partkey", "TRUNCATE({p_type}, 8, NULL)", "CASE WHEN length(p_type) > 8 THEN left(p_type, 8) || '...' ELSE p_type END"),
    "h59_arithmetic": ("lineitem", "l_orderkey, l_linenumber", "MULTIPLY({l_quantity}, SUBTRACT(ADD({l_quantity}, 1), 3))", "l_quantity * ((l_quantity + 1) - 3)"),
    "h60_divide": ("lineitem", "l_orderkey, l_linenumber", "DIVIDE({l_extendedprice}, {l_quantity})", "l_extendedprice / l_quantity"),
    "h61_modulo": ("lineitem", "l_orderkey, l_linenumber", "MODULO({l_orderkey}, 9)", "l_orderkey % 9"),
    "h62_concat_operator": ("customer", "c_custkey", "JOIN_TEXT({c_name}, nullif({c_mktsegment}, 'BUILDING'))", "c_name || nullif(c_mktsegment, 'BUILDING')"),
    "h63_comparisons": ("part", "p_partkey", "concat_ws(',', LESS(cast({p_size} AS STRING), '18'), LESS_NUMBER({p_size}, 18), EQUALS(NULL, NULL))", "concat_ws(',', (p_size::VARCHAR < '18')::VARCHAR, (p_size < 18)::VARCHAR, 'true')"),
    "h64_like": ("part", "p_partkey", "LIKE({p_type}, 'S%L')", "starts_with(p_type, 'S') AND ends_with(p_type, 'L')"),
    "h65_json_field": ("events", "event_id", "JSON_FIELD({props}, 'k')", "props ->> '$.k'"),
    "h66_infix_and_or": ("orders", "o_orderkey", "concat_ws(',', AND_NULL({o_totalprice} > 100000, nullif({o_orderstatus} = 'F', false)), OR_NULL({o_totalprice} > 100000, nullif({o_orderstatus} = 'F', false)))", "concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN (o_totalprice > 100000)::VARCHAR END, CASE WHEN o_orderstatus = 'F' THEN 'true' END)"),
    "h67_unary": ("orders", "o_orderkey", "concat_ws(',', NEGATE({o_custkey}), NOT_TRUTHY(nullif({o_orderstatus}, 'O')), {o_orderstatus} IS NULL)", "concat_ws(',', (-o_custkey::DOUBLE)::VARCHAR, (o_orderstatus = 'O')::VARCHAR, 'false')"),
    "h68_case_when": ("orders", "o_orderkey", "WHEN_TRUTHY(if({o_orderstatus} = 'O', 'false', {o_orderstatus}), 'yes', NULL)", "CASE WHEN o_orderstatus <> 'O' THEN 'yes' END"),
    "h69_truthiness": ("orders", "o_orderkey", "TRUTHY(cast({o_orderkey} % 3 AS STRING))", "o_orderkey % 3 <> 0"),
}


def _scalar(name: str) -> None:
    source, key, template, sql = SCALARS[name]

    @query(name, f"SELECT {key}, {sql} AS v FROM {source}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        functions.register(spark)
        df = table(spark, sf_dir, source)
        return df.select(*[k.strip() for k in key.split(",")], functions.expression(template).alias("v"))


for _name in SCALARS:
    _scalar(_name)


@query("h22_current_date")
def current_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions.register(spark, ["CURRENT_DATE", "DATE_DIFF"])
    return table(spark, sf_dir, "orders").select("o_orderkey", functions.expression("DATE_DIFF(CURRENT_DATE(), cast({o_orderdate} AS DATE)) > 0").alias("v"))


@query("h39_now")
def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions.register(spark, ["NOW"])
    return table(spark, sf_dir, "events").select("event_id", functions.expression("NOW() > cast({ts} AS TIMESTAMP_NTZ)").alias("v"))
