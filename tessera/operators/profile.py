"""Profiling, type and personal-data inference: one aggregation over all columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .percentiles import percentiles
from .rows import number

# What a value of each kind looks like.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "credit_card": r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "ip": r"^(\d{1,3}\.){3}\d{1,3}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "postal_code": r"^\d{5}(-\d{4})?$",
}
#: The same in free text. An email is looked for only where a run of its characters begins, or the last one ended.
IN_TEXT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\(?\b\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
PII = ("ssn", "credit_card", "email", "phone", "ip")
PII_SHARE = 0.7
#: Words in a column's name and the kind they stand for, the first that fits: this library's own choice.
NAMES = {"email": "email|e_mail|mail", "ssn": "ssn|social_security", "phone": "phone|mobile|tel", "credit_card": "card|cc_num", "ip": "ip_addr|ip$", "postal_code": "zip|postal", "url": "url|link|website", "uuid": "uuid|guid", "name": "name$|first_name|last_name", "date": "date|_at$|time",
    "customer_id": "cust(omer)?_?(id|key|no)$", "order_number": "order_?(id|key|no|number)$", "invoice_number": "invoice", "iban": "iban", "account": "account|acct", "passport": "passport", "birth": "birth|dob",
    "gender": "gender|sex$", "age": "^age$|_age$", "address": "address|street", "city": "city|town", "state": "^state$|province", "country": "country|nation", "latitude": "^lat$|latitude", "longitude": "^(lon|lng)$|longitude",
    "currency": "currency", "amount": "amount|price|cost|total", "quantity": "quantity|qty", "percentage": "percent|_pct$|ratio", "company": "company|employer", "job": "job|occupation", "language": "^lang$|language", "status": "status", "description": "description|comment"}
# Names of columns that stand for a kind as a whole, with what a name may end with (_) or hold (*) to stand for it.
COLUMN_KINDS = {
    "email": "email email_address e_mail _email _mail",
    "phone": "phone phone_number telephone mobile cell *phone *tel",
    "person_name": "name full_name fullname person_name customer_name user_name username",
    "address": "address street_address mailing_address billing_address shipping_address _address",
    "city": "city town _city",
    "state": "state province region _state",
    "postal_code": "zip zipcode zip_code postal_code postcode",
    "country": "country country_name _country",
    "country_code": "country_code country_cd iso_country",
    "ssn": "ssn social_security_number social_security",
    "credit_card": "credit_card cc_number card_number creditcard *credit_card",
    "currency_amount": "amount price cost total balance fee _amount _price _cost",
    "timestamp": "timestamp created_at updated_at modified_at deleted_at _timestamp _at",
    "date_of_birth": "dob date_of_birth birth_date birthdate",
    "date": "date start_date end_date _date _dt",
    "url": "url website link _url _link",
    "uuid": "uuid guid _uuid _guid",
    "ip_address": "ip ip_address ipaddress _ip",
    "user_id": "user_id userid uid",
    "sku": "sku product_sku",
    "product_code": "product_code product_id",
    "status": "status _status",
    "description": "description desc notes comments _description _desc",
}
WHOLE_NAME, PART_OF_NAME = 0.9, 0.7
RANKS = {"ssn": 4, "credit_card": 4, "email": 3, "phone": 3, "ip": 2}
CLASSES = {4: "highly_restricted", 3: "restricted", 2: "confidential", 1: "internal", 0: "public"}


def present(c: Column) -> Column:
    """Null, empty text, null and NA count as missing."""
    return c.isNotNull() & ~F.lower(F.trim(c.cast("string"))).isin("", "na", "null")


def _long(df: DataFrame, parts: Sequence[Column]) -> DataFrame:
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def _distinct_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(column, distinct): each column grouped by itself, so that a task holds one column's values and no row is copied for
    another column."""
    one = lambda c, v: df.select(v.alias("v")).filter("v IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("distinct")).select(F.lit(c).alias("column"), "distinct")
    return reduce(DataFrame.unionByName, [one(c, v) for c, v in values.items()])


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False, medians: bool = True) -> DataFrame:
    """A row for each column: rows, nulls, null share, distinct values, cardinality, smallest and largest (as text), and for
    numbers mean, median and population standard deviation, for texts the lengths.

    One pass with sketches: distinct values within some 1 % (one standard deviation), medians within 0.01 % of the rows'
    ranks. ``exact`` counts distinct values, and ranks values for the medians, at the price of a shuffle of each column for
    either; without ``medians`` these are null."""
    parts, numeric, values = [], {}, {}
    for c in columns or df.columns:
        kind = df.schema[c].dataType
        v = F.when(present(F.col(c)), F.col(c))
        x = number(v) if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.lit(None).cast("double")
        numeric[c] = x
        values[c] = v
        distinct = F.lit(None).cast("bigint") if exact else F.approx_count_distinct(v, 0.01)
        size = F.when(F.lit(isinstance(kind, T.StringType)), F.char_length(v.cast("string")))
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(~present(F.col(c))).alias("nulls"), F.try_divide(F.count_if(~present(F.col(c))) * 100.0, F.count(F.lit(1))).alias("null_percent"),
            distinct.alias("distinct_values"), F.try_divide(distinct, F.count(v)).alias("cardinality"), F.min(v).cast("string").alias("smallest"), F.max(v).cast("string").alias("largest"),
            F.avg(x).alias("mean"), (F.percentile_approx(x, 0.5) if medians and not exact else F.lit(None)).cast("double").alias("median"), F.stddev_pop(x).alias("stddev"),
            F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("avg_length"), F.count(v).alias("_some"),
        ))
    found = _long(df, parts)
    out = found.drop("_some")
    if not exact:
        return out
    counted = found.drop("distinct_values", "cardinality").join(F.broadcast(_distinct_values(df, values)), "column")  # a row a column
    out = counted.withColumns({"distinct_values": F.col("distinct"), "cardinality": F.try_divide(F.col("distinct"), F.col("_some"))}).select(*out.columns)
    if not medians:
        return out
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), x.alias("value")) for c, x in numeric.items()])).alias("r")).select("r.*")
    ranked = percentiles(long, ["column"], F.col("value"), {"_median": 0.5})
    return out.join(ranked, "column", "left").withColumn("median", F.col("_median")).select(*out.columns)


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")).select("r.*")


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(column, value, count, rank): the most frequent values of each column, ties by value."""
    from .relational import top_k_per_group

    counts = unpivot(df, columns).filter("value IS NOT NULL").groupBy("column", "value").count()
    return top_k_per_group(counts, ["column"], [F.desc("count"), F.col("value")], k)


def candidate_keys(profiled: DataFrame, threshold: float = 0.95) -> DataFrame:
    return profiled.filter((F.col("cardinality") >= threshold) & (F.col("null_percent") < 1)).select("column", "cardinality")


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, p25, p50, p75) of numeric columns, exact; a column without values has no row."""
    return percentiles(_numbers(df, columns), ["column"], F.col("value"), {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, count) of equal width; the largest value is in the last bin."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = F.col(column).cast("double")
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    width = (F.col("hi") - F.col("lo")) / bins
    return df.filter(F.col(column).isNotNull()).join(F.broadcast(span)).groupBy(at.cast("int").alias("bin"), "lo", width.alias("w")).count().select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "count")


def depth_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high): bounds that cut the values into bins of equal depth, exact."""
    cuts = percentiles(df, [], F.col(column), {f"p{i}": i / bins for i in range(bins + 1)})
    rows = [F.struct(F.lit(i).alias("bin"), F.col(f"p{i}").alias("low"), F.col(f"p{i + 1}").alias("high")) for i in range(bins)]
    return cuts.select(F.inline(F.array(*rows)))


def cardinality_class(cardinality: Column) -> Column:
    return F.when(cardinality >= 0.99, "unique").when(cardinality >= 0.8, "high").when(cardinality >= 0.3, "medium").when(cardinality >= 0.05, "low").otherwise("very_low")


def match_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kind, share): how much of a column's values each pattern fits; cards must pass the Luhn check."""
    parts = []
    for c in columns:
        v = F.trim(F.col(c).cast("string"))
        for kind, pattern in PATTERNS.items():
            fits = v.rlike(pattern)
            if kind == "credit_card":
                digits = F.regexp_replace(v, r"[-\s]", "")
                fits = fits & F.coalesce(F.call_function("luhn_check", F.when(fits, digits)), F.lit(False))
            parts.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.coalesce(F.try_divide(F.count_if(fits), F.count_if(present(F.col(c)))), F.lit(0.0)).alias("share")))
    return _long(df, parts)


def semantic_types(df: DataFrame, columns: Sequence[str], least: float = PII_SHARE) -> DataFrame:
    """(column, kind, share): the best fitting pattern, if it fits more than ``least``."""
    shares = match_shares(df, columns)
    return shares.groupBy("column").agg(F.max(F.struct("share", "kind")).alias("b")).filter(F.col("b.share") > least).select("column", F.col("b.kind").alias("kind"), F.col("b.share").alias("share"))


def type_by_name(names: DataFrame, column: str = "column") -> DataFrame:
    """``kind`` from a column's name, null if none fits."""
    c = None
    for kind, pattern in NAMES.items():
        hit = F.lower(F.col(column)).rlike(pattern)
        c = F.when(hit, kind) if c is None else c.when(hit, kind)
    return names.withColumn("kind", c)


def kinds_by_name(names: DataFrame, column: str = "column") -> DataFrame:
    """``kind`` and ``confidence`` of columns by their names, in small letters and with ``_`` for blanks, dots and hyphens: .9 for
    a name that is listed as a whole, else .7 for the first kind whose ending or part it has; both null if none fits, or without a
    name. A name takes one lookup and one test a kind, so catalogs of any size go through without a join."""
    name = F.translate(F.lower(F.col(column)), "- .", "___")
    whole, part = [], None
    for kind, words in COLUMN_KINDS.items():
        ends, parts = ([w.lstrip("*") for w in words.split() if w[0] == mark] for mark in "_*")
        whole += [F.lit(x) for w in words.split() if w[0] not in "_*" for x in (w, kind)]
        hits = [F.endswith(name, F.lit(w)) for w in ends] + [F.contains(name, F.lit(w)) for w in parts]
        if hits:
            hit = reduce(or_, hits)
            part = F.when(hit, kind) if part is None else part.when(hit, kind)
    out = names.withColumns({"_whole": F.try_element_at(F.create_map(*whole), name), "_part": part})
    sure = F.when(F.col("_whole").isNotNull(), WHOLE_NAME).when(F.col("_part").isNotNull(), PART_OF_NAME)
    return out.select(*names.columns, F.coalesce("_whole", "_part").alias("kind"), sure.alias("confidence"))


def detect_pii(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, by_value, by_name, kind, confidence): values and name agree: mean of both; disagree: value times 0.8; by
    value alone: its share; by name alone: 0.7 of 0.9."""
    values = match_shares(df, columns).filter(F.col("kind").isin(*PII)).groupBy("column").agg(F.max(F.struct("share", "kind")).alias("b"))
    named = type_by_name(values.select("column", "b")).withColumn("by_name", F.when(F.col("kind").isin(*PII), F.col("kind"))).drop("kind")
    by_value = F.when(F.col("b.share") > PII_SHARE, F.col("b.kind"))
    out = named.withColumn("by_value", by_value)
    confidence = F.when(F.col("by_value") == F.col("by_name"), (F.col("b.share") + 0.9) / 2).when(F.col("by_value").isNotNull() & F.col("by_name").isNotNull(), F.col("b.share") * 0.8).when(F.col("by_value").isNotNull(), F.col("b.share")).when(F.col("by_name").isNotNull(), F.lit(0.9 * 0.7))
    return out.select("column", "by_value", "by_name", F.coalesce("by_value", "by_name").alias("kind"), confidence.alias("confidence"))


def classify(pii: DataFrame) -> DataFrame:
    """The class of a whole table: that of its most sensitive column."""
    rank = F.lit(0)
    for kind, r in RANKS.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    names = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return pii.agg(F.coalesce(F.max(rank), F.lit(0)).alias("rank")).select("rank", names[F.col("rank")].alias("class"))


def redact(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(2)), F.lit("***"))


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Drift per column: cardinality and null differences, similarity 1 - (their sum) / 2, drifted if cardinality moved over .1."""
    j = a.select("column", F.col("cardinality").alias("c1"), (F.col("null_percent") / 100).alias("n1")).join(b.select("column", F.col("cardinality").alias("c2"), (F.col("null_percent") / 100).alias("n2")), "column", "full")
    dc, dn = F.abs(F.coalesce("c1", F.lit(0.0)) - F.coalesce("c2", F.lit(0.0))), F.abs(F.coalesce("n1", F.lit(0.0)) - F.coalesce("n2", F.lit(0.0)))
    return j.select("column", dc.alias("cardinality_diff"), dn.alias("null_diff"), (1 - (dc + dn) / 2).alias("similarity"), (dc > 0.1).alias("drifted"))


def quality_issues(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, issue, count): missing, blanks (spaces around), inconsistent_case (neither all upper, lower nor capitalised)."""
    parts = []
    for c in columns:
        v = F.col(c).cast("string")
        blank = v.isNotNull() & (F.trim(v) != v)
        odd = v.isNotNull() & v.rlike("[A-Za-z]") & (F.upper(v) != v) & (F.lower(v) != v) & (F.initcap(v) != v)
        parts += [F.struct(F.lit(c).alias("column"), F.lit(n).alias("issue"), F.count_if(k).alias("count")) for n, k in (("missing", ~present(F.col(c))), ("blanks", blank), ("inconsistent_case", odd))]
    return _long(df, parts).filter("count > 0")


def scan_text(df: DataFrame, column: str) -> DataFrame:
    """``n_<kind>``: occurrences in free text, 0 for null. Patterns run only over texts with an at sign or a digit."""
    digit, at = F.col(column).rlike("[0-9]"), F.contains(F.col(column), F.lit("@"))
    return df.withColumns({f"n_{k}": F.when(at if k == "email" else digit, F.regexp_count(column, F.lit(p))).otherwise(0) for k, p in IN_TEXT.items()})


def profile_tables(tables: dict[str, DataFrame], exact: bool = False, medians: bool = True) -> DataFrame:
    """One profile of many tables, with the table's name."""
    out = None
    for name, df in tables.items():
        part = profile(df, exact=exact, medians=medians).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sketch(df: DataFrame, column: str, batch: Column) -> DataFrame:
    """A mergeable profile of each batch: rows, nulls and a distinct-value sketch."""
    return df.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).isNull()).alias("nulls"), F.hll_sketch_agg(F.col(column).cast("string")).alias("sketch"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))
