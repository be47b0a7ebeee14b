"""Validation rules, scores and policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import number

# What a violation costs by severity.
PENALTY = {"info": 0.01, "warning": 0.05, "error": 0.15, "critical": 0.30}
DATE = "yyyy-MM-dd"


def _repeated(field: str) -> str:
    return f"_repeated_{field}"


def mark_repeats(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """``df`` with a mark for each UNIQUE rule at rows whose value others have too: repeated values are found by an
    aggregation that combines before the shuffle, then joined, so a hot value can be split and nulls stay where they are."""
    for f in dict.fromkeys(r["field"] for r in rules if r["rule"].upper() == "UNIQUE"):
        often = df.filter(F.col(f).isNotNull()).groupBy(f).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(f, F.lit(True).alias(_repeated(f)))
        df = df.join(often, f, "left").select(*df.columns, _repeated(f))
    return df


def rule_holds(rule: Mapping) -> Column:
    """Whether a row meets a rule; never null. For UNIQUE the rows come from :func:`mark_repeats`."""
    kind, c = rule["rule"].upper(), F.col(rule["field"])
    if kind == "NOT_NULL":
        return c.isNotNull()
    if kind == "REGEX":
        out = c.rlike(rule["pattern"])
    elif kind == "RANGE":
        x = number(c)
        out = (x >= rule.get("min", float("-inf"))) & (x <= rule.get("max", float("inf")))
    elif kind == "IN_SET":
        out = c.cast("string").isin([str(v) for v in rule["values"]])
    elif kind == "LENGTH":
        n = F.octet_length(c)
        out = (n >= rule.get("min", 0)) & (n <= rule.get("max", 1 << 30))
    elif kind == "UNIQUE":
        out = c.isNull() | F.col(_repeated(rule["field"])).isNull()
    elif kind == "DATE_RANGE":
        d = F.coalesce(F.try_to_date(c.cast("string"), rule.get("format", DATE)), F.try_to_date(F.left(c.cast("string"), F.lit(10)), DATE))
        out = (d >= F.lit(rule.get("min", "0001-01-01")).cast("date")) & (d <= F.lit(rule.get("max", "9999-12-31")).cast("date"))
    elif kind == "CROSS_FIELD":
        o = F.col(rule["other"])
        out = {"eq": c == o, "ne": c != o, "lt": c < o, "lte": c <= o, "gt": c > o, "gte": c >= o}[rule["op"]]
    else:
        raise ValueError(f"unknown rule {kind}")
    return F.coalesce(out, F.lit(False))


def with_violations(df: DataFrame, rules: Sequence[Mapping], to: str = "_violations") -> DataFrame:
    """Rows with an array of the (field, rule, value, severity) they break; all rules in one pass, but that UNIQUE needs a
    join."""
    found = [
        F.when(~rule_holds(r), F.struct(F.lit(r["field"]).alias("field"), F.lit(r["rule"].upper()).alias("rule"), F.col(r["field"]).cast("string").alias("value"), F.lit(r.get("severity", "error")).alias("severity")))
        for r in rules
    ]
    return mark_repeats(df, rules).select(*[c for c in df.columns if c != to], F.array_compact(F.array(*found)).alias(to))


def validate(df: DataFrame, rules: Sequence[Mapping], keys: Sequence[str]) -> DataFrame:
    """The violations as rows: keys, field, rule, value, severity."""
    return with_violations(df, rules).select(*keys, F.explode("_violations").alias("v")).select(*keys, "v.*")


def validation_summary(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """rows, valid rows, errors, warnings, and whether there is no error."""
    of = lambda s: F.size(F.filter("_violations", lambda v: v["severity"].isin(*s)))
    errors, warnings = F.coalesce(F.sum(of(["error", "critical"])), F.lit(0)), F.coalesce(F.sum(of(["warning", "info"])), F.lit(0))
    return with_violations(df, rules).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_violations") == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"), (errors == 0).alias("success"))


def quality_score(violations: Column) -> Column:
    """1 less the penalties, 0 at least."""

    def cost(severity: Column) -> Column:
        c = F.lit(0.0)
        for name, penalty in PENALTY.items():
            c = F.when(severity == name, penalty).otherwise(c)
        return c

    return F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(violations, F.lit(0.0), lambda a, v: a + cost(v["severity"])))


def pipeline_rules(required: Sequence[str], email: str | None = None, ordered_dates: tuple[str, str] | None = None, unique: str | None = None) -> list[dict]:
    """Completeness, validity (an email has an at sign), consistency (dates in order) and uniqueness."""
    rules = [{"field": f, "rule": "NOT_NULL", "severity": "error"} for f in required]
    if email:
        rules.append({"field": email, "rule": "REGEX", "pattern": "@", "severity": "warning"})
    if ordered_dates:
        rules.append({"field": ordered_dates[0], "rule": "CROSS_FIELD", "op": "lte", "other": ordered_dates[1], "severity": "error"})
    if unique:
        rules.append({"field": unique, "rule": "UNIQUE", "severity": "critical"})
    return rules


def dataset_dimensions(df: DataFrame, key: str, rules: Sequence[Mapping], updated_at: str, now: str) -> DataFrame:
    """Completeness, uniqueness, validity and timeliness in percent, and an overall score. Timeliness is 100 under an
    hour of age, falls to 0 at seven days. Weights: completeness .3, uniqueness .2, validity .2, timeliness .15, and .15
    for consistency, which is taken as validity."""
    marked = with_violations(df, rules)
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + F.when(F.col(c).isNotNull(), 1).otherwise(0)
    hours = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max(F.col(updated_at).cast("timestamp")))) / 3.6e9
    out = marked.agg(
        (F.sum(cells) * 100.0 / (F.count(F.lit(1)) * len(df.columns))).alias("completeness"),
        (F.count_distinct(key) * 100.0 / F.count(F.lit(1))).alias("uniqueness"),
        (F.count_if(F.size("_violations") == 0) * 100.0 / F.count(F.lit(1))).alias("validity"),
        F.when(hours < 1, 100.0).when(hours >= 168, 0.0).otherwise(100.0 * (168 - hours) / 167).alias("timeliness"),
    )
    return out.withColumn("overall", F.col("completeness") * 0.3 + F.col("uniqueness") * 0.2 + F.col("validity") * 0.2 + F.col("timeliness") * 0.15 + F.col("validity") * 0.15)


def scorecard(df: DataFrame, rules: Sequence[Mapping], by: Sequence[Column]) -> DataFrame:
    """Rows, mean score and violations of each severity per group, such as dataset and period."""
    marked = with_violations(df, rules).withColumn("_score", quality_score(F.col("_violations")))
    n = lambda s: F.sum(F.size(F.filter("_violations", lambda v: v["severity"] == s))).alias(f"{s}_violations")
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg("_score").alias("score"), *[n(s) for s in PENALTY])


def validate_shapes(triples: DataFrame, target_class: str, shapes: Sequence[Mapping], type_predicate: str = "type") -> DataFrame:
    """(s, path, constraint, value): what the instances of a class break. A shape has a path and any of minCount,
    maxCount, datatype, pattern, minLength, in, class (the value is an instance of that class itself)."""
    focus = triples.filter((F.col("p") == type_predicate) & (F.col("o") == target_class)).select("s").distinct()
    paths = [s["path"] for s in shapes]
    values = triples.filter(F.col("p").isin(paths)).join(focus, "s", "left_semi")
    per = values.groupBy("s", F.col("p").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    grid = focus.withColumn("path", F.explode(F.array(*map(F.lit, dict.fromkeys(paths)))))
    counts = grid.join(per, ["s", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = None

    def add(df: DataFrame) -> None:
        nonlocal out
        out = df if out is None else out.unionByName(df)

    for shape in shapes:
        at = counts.filter(F.col("path") == shape["path"])
        own = values.filter(F.col("p") == shape["path"])
        row = lambda df, name, value: df.select("s", F.lit(shape["path"]).alias("path"), F.lit(name).alias("constraint"), value.alias("value"))  # noqa: B023, E731
        if "minCount" in shape:
            add(row(at.filter(F.col("n") < shape["minCount"]), "minCount", F.col("n").cast("string")))
        if "maxCount" in shape:
            add(row(at.filter(F.col("n") > shape["maxCount"]), "maxCount", F.col("n").cast("string")))
        checks = {"datatype": lambda v: F.col("o").try_cast(v).isNotNull(), "pattern": lambda v: F.col("o").rlike(v), "minLength": lambda v: F.char_length("o") >= v, "in": lambda v: F.col("o").isin(v)}
        for name, ok in checks.items():
            if name in shape:
                add(row(own.filter(~F.coalesce(ok(shape[name]), F.lit(False))), name, F.col("o")))
        if "class" in shape:
            members = triples.filter((F.col("p") == type_predicate) & (F.col("o") == shape["class"])).select(F.col("s").alias("o")).distinct()
            add(row(own.join(members, "o", "left_anti"), "class", F.col("o")))
    return out


def validate_json(df: DataFrame, column: str, schema: Mapping) -> DataFrame:
    """``_errors`` of each payload against a flat JSON schema: type, required, enum. Types are checked as JSON has them."""
    c = F.col(column)
    bad = F.try_parse_json(c).isNull()
    errors = [F.when(bad, F.lit("not JSON"))]
    kinds = {"string": r"^STRING", "integer": r"^BIGINT|^TINYINT|^SMALLINT|^INT", "number": r"^BIGINT|^TINYINT|^SMALLINT|^INT|^DECIMAL|^DOUBLE|^FLOAT", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY"}
    for name, spec in schema.get("properties", {}).items():
        value = F.try_variant_get(F.try_parse_json(c), f"$.{name}", "variant")
        text = F.get_json_object(c, f"$.{name}")
        if name in schema.get("required", []):
            errors.append(F.when(~bad & text.isNull(), F.lit(f"{name}: missing")))
        if "type" in spec:
            errors.append(F.when(~bad & text.isNotNull() & ~F.schema_of_variant(value).rlike(kinds[spec["type"]]), F.lit(f"{name}: not {spec['type']}")))
        if "enum" in spec:
            errors.append(F.when(~bad & text.isNotNull() & ~text.isin(*map(str, spec["enum"])), F.lit(f"{name}: not allowed")))
    return df.withColumn("_errors", F.array_compact(F.array(*errors)))


def sla_metrics(df: DataFrame, by: Sequence[Column], latency: str, ok: Column) -> DataFrame:
    """p50, p95, p99 of latency, availability and error rate in percent, and the number of calls."""
    p = lambda q: F.percentile(latency, F.lit(q))
    return df.groupBy(*by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), (F.count_if(ok) * 100.0 / F.count(F.lit(1))).alias("availability"), (F.count_if(~ok) * 100.0 / F.count(F.lit(1))).alias("error_rate"), F.count(F.lit(1)).alias("calls"))


def sla_check(metrics: DataFrame, targets: Sequence[tuple[str, str, float]], by: Sequence[str]) -> DataFrame:
    """(by, metric, value, threshold, met) for (metric, operator, threshold)."""
    ops = {"<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "==": lambda a, b: a == b}
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), ops[o](F.col(m), F.lit(t)).alias("met")) for m, o, t in targets]
    return metrics.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def policy_check(spark: SparkSession, views: Mapping[str, DataFrame], policies: Sequence[Mapping]) -> DataFrame:
    """(policy, severity, violations, passed): a policy's query must return no rows, or for kind ``ask`` one true value.
    Named parameters are bound, not pasted."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = None
    for p in policies:
        found = spark.sql(p["sql"], args=p.get("args", {}))
        n = F.count(F.lit(1)) if p.get("kind", "select") == "select" else F.count_if(~F.coalesce(F.col(found.columns[0]), F.lit(False)))
        row = found.agg(n.alias("violations")).select(F.lit(p["name"]).alias("policy"), F.lit(p.get("severity", "error")).alias("severity"), "violations", (F.col("violations") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def completeness_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    columns = columns or df.columns
    total = F.lit(0)
    for c in columns:
        total = total + F.when(F.col(c).isNotNull(), 1).otherwise(0)
    return total / len(columns)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
