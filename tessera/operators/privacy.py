"""Anonymisation, subject requests, retention and consent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import assign_ids

REDACTED = "[REDACTED]"


def hash_with_salt(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(c.cast("string"), F.lit(salt)), 256)


def mask(c: Column, keep_last: int = 4, ch: str = "*") -> Column:
    """All but the last characters; all if there are no more than those."""
    n = F.char_length(c)
    return F.when(n <= keep_last, F.repeat(F.lit(ch), n)).otherwise(F.concat(F.repeat(F.lit(ch), n - keep_last), F.right(c, F.lit(keep_last))))


def generalize(c: Column, kind: str, size: int = 10) -> Column:
    """Ages to ranges, postal codes to prefixes, dates to year or month; else redacted."""
    if kind == "age":
        low = F.floor(c.try_cast("double") / size).cast("bigint") * size
        return F.coalesce(F.concat(low.cast("string"), F.lit("-"), (low + size - 1).cast("string")), F.lit(REDACTED))
    if kind == "postal":
        return F.concat(F.left(c, F.lit(size)), F.repeat(F.lit("*"), F.greatest(F.char_length(c) - size, F.lit(0))))
    if kind in ("year", "month"):
        return F.coalesce(F.date_format(c.try_cast("timestamp"), "yyyy" if kind == "year" else "yyyy-MM"), F.lit(REDACTED))
    return F.lit(REDACTED)


def random_pseudonym() -> Column:
    return F.uuid()


def pseudonyms(df: DataFrame, column: str, prefix: str, to: str = "pseudonym") -> DataFrame:
    """The same pseudonym for equal values, numbered in their order. Distinct values are numbered by ranges in parallel."""
    names = assign_ids(df.select(column).filter(F.col(column).isNotNull()).distinct(), [column], "_n")
    return df.join(names.select(column, F.concat(F.lit(prefix), F.col("_n").cast("string")).alias(to)), column, "left")


def mask_email(c: Column, keep_domain: bool = True) -> Column:
    local, domain = F.split_part(c, F.lit("@"), F.lit(1)), F.split_part(c, F.lit("@"), F.lit(2))
    hidden = F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.char_length(local) - 1, F.lit(0))))
    return F.when(F.contains(c, F.lit("@")), F.concat(hidden, F.lit("@"), domain if keep_domain else F.lit("***"))).otherwise(F.lit("***"))


def mask_phone(c: Column) -> Column:
    """Keeps the first three digits."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.char_length(digits) > 3, F.concat(F.left(digits, F.lit(3)), F.repeat(F.lit("*"), F.char_length(digits) - 3))).otherwise(F.repeat(F.lit("*"), F.char_length(digits)))


def discover_subject(tables: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(table, row): rows, as JSON, that a predicate says belong to the subject."""
    out = None
    for name, (df, mine) in tables.items():
        part = df.filter(mine).select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def subject_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("table").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("row")).alias("bytes"))


def export_subject(found: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "json":
        found.select("table", F.parse_json("row").alias("row")).select(F.to_json(F.struct("table", "row")).alias("value")).write.text(path)
    elif kind == "csv":
        found.write.option("header", True).csv(path)
    elif kind == "xml":
        found.write.format("xml").option("rowTag", "record").save(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def erase(df: DataFrame, mine: Column, how: str, columns: Sequence[str] = (), tombstone: str = "_erased") -> DataFrame:
    """The table without a subject: rows deleted, kept with a flag and empty values (tombstone), or with hashed values
    (anonymize)."""
    mine = F.coalesce(mine, F.lit(False))
    if how == "delete":
        return df.filter(~mine)
    if how == "tombstone":
        return df.withColumns({c: F.when(~mine, F.col(c)) for c in columns} | {tombstone: mine})
    if how == "anonymize":
        return df.withColumns({c: F.when(mine, F.sha2(F.col(c).cast("string"), 256)).otherwise(F.col(c).cast("string")) for c in columns})
    raise ValueError(f"unknown erasure {how}")


def erasure_plan(tables: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """A dry run: (table, rows, affected)."""
    out = None
    for name, (df, mine) in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(mine, F.lit(False))).alias("affected")).select(F.lit(name).alias("table"), "rows", "affected")
        out = part if out is None else out.unionByName(part)
    return out


def verify_erasure(tables: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    return erasure_plan(tables).select("table", F.col("affected").alias("left"), (F.col("affected") == 0).alias("clean"))


def retention(df: DataFrame, created: str, now: Column, min_days: int, max_days: int) -> DataFrame:
    """``decision``: keep under min_days, must_delete over max_days, else may_delete; and when the row expires."""
    age = F.datediff(now, F.col(created).cast("date"))
    decision = F.when(age < min_days, "keep").when(age > max_days, "must_delete").otherwise("may_delete")
    return df.withColumns({"age_days": age, "decision": decision, "expires": F.date_add(F.col(created).cast("date"), max_days)})


def apply_holds(df: DataFrame, holds: DataFrame, subject: str, category: str) -> DataFrame:
    """``blocked`` if the subject or the category is under a hold (kind, value)."""
    of = lambda kind, c: holds.filter(F.col("kind") == kind).select(F.col("value").alias(c)).distinct().withColumn(f"_{kind}", F.lit(True))
    j = df.join(of("subject", subject), subject, "left").join(of("category", category), category, "left")
    return j.select(*df.columns, (F.col("_subject").isNotNull() | F.col("_category").isNotNull()).alias("blocked"))


def consented(df: DataFrame, consents: DataFrame, subject: str, purpose: str) -> DataFrame:
    """Rows whose subject's latest consent for a purpose is granted."""
    last = consents.filter(F.col("purpose") == purpose).groupBy(subject).agg(F.max_by("status", F.struct("ts", "status")).alias("_s")).filter("_s = 'granted'")
    return df.join(last, subject, "left_semi")
