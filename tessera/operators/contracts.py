"""Compatibility of interfaces from their field rows: (interface, system, field, type, required, enum)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def schema_rows(df: DataFrame, interface: str, system: str) -> DataFrame:
    rows = [F.struct(F.lit(interface).alias("interface"), F.lit(system).alias("system"), F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(not f.nullable).alias("required"), F.lit(None).cast("array<string>").alias("enum")) for f in df.schema]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def schema_classes(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(interface, system, class), and the fields of each class (class, field, type, required, enum): interfaces of equal schemas
    are one class. ``enum`` is an array of allowed values, null or absent if there is no restriction."""
    if "enum" not in fields.columns:
        fields = fields.withColumn("enum", F.lit(None).cast("array<string>"))
    rows = fields.select("interface", "system", "field", "type", "required", F.array_sort("enum").alias("enum")).distinct()
    one = F.struct("field", "type", "required", "enum")
    shapes = rows.groupBy("interface", "system").agg(F.sha2(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("s"))), 256).alias("class"))  # an array of an interface's fields
    return shapes, rows.join(shapes, ["interface", "system"]).select("class", "field", "type", "required", "enum").distinct()


def class_issues(of: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p_class, c_class, field, issue) of pairs of classes (p_class, c_class): missing_required, type_mismatch, enum_broadening
    (the producer may send values that the consumer does not take), requiredness_weakened, extra_field."""
    side = lambda x: pairs.join(of.select(F.col("class").alias(f"{x}_class"), "field", F.col("type").alias(f"{x}t"), F.col("required").alias(f"{x}r"), F.col("enum").alias(f"{x}e")), f"{x}_class")
    j = side("p").join(side("c"), ["p_class", "c_class", "field"], "full")
    wider = F.col("ce").isNotNull() & (F.col("pe").isNull() | (F.size(F.array_except("pe", "ce")) > 0))
    issue = F.when(F.col("pt").isNull(), F.when(F.col("cr"), "missing_required")).when(F.col("ct").isNull(), "extra_field").when(F.col("pt") != F.col("ct"), "type_mismatch").when(wider, "enum_broadening").when(F.col("cr") & ~F.col("pr"), "requiredness_weakened")
    return j.select("p_class", "c_class", "field", issue.alias("issue")).filter("issue IS NOT NULL")


def class_pairs(of: DataFrame) -> DataFrame:
    """Ordered pairs of classes that share a field, a class with itself included."""
    a = of.select("field", F.col("class").alias("p_class")).distinct()
    return a.join(of.select("field", F.col("class").alias("c_class")).distinct(), "field").select("p_class", "c_class").distinct()


def _in_classes(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pairs of interfaces with their classes."""
    c = lambda side, x: shapes.select(F.col("interface").alias(side), F.col("class").alias(f"{x}_class")).distinct()
    return pairs.join(c("producer", "p"), "producer").join(c("consumer", "c"), "consumer")


def compatibility(fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """(producer, consumer, field, issue) as in :func:`class_issues`; schemas are compared once for each pair of classes."""
    shapes, of = schema_classes(fields)
    named = _in_classes(pairs, shapes)
    return named.join(class_issues(of, named.select("p_class", "c_class").distinct()), ["p_class", "c_class"]).select("producer", "consumer", "field", "issue")


def interface_pairs(fields: DataFrame) -> DataFrame:
    """Ordered pairs of interfaces of different systems that share a field: pairs of classes, then their members."""
    shapes, of = schema_classes(fields)
    a = shapes.select(F.col("class").alias("p_class"), F.col("interface").alias("producer"), F.col("system").alias("ps"))
    b = shapes.select(F.col("class").alias("c_class"), F.col("interface").alias("consumer"), F.col("system").alias("cs"))
    return class_pairs(of).join(a, "p_class").join(b, "c_class").filter("producer != consumer AND ps != cs").select("producer", "consumer").distinct()


def _scored(pairs: DataFrame, issues: DataFrame, by: list[str]) -> DataFrame:
    bad = F.col("issue").isin("missing_required", "type_mismatch", "enum_broadening")
    n = issues.groupBy(*by).agg(F.count_if(bad).alias("breaking"), F.count_if(~bad).alias("others"))
    j = pairs.join(n, by, "left").na.fill(0, ["breaking", "others"])
    score = F.greatest(F.lit(0.0), 1 - F.col("breaking") * 0.3 - F.col("others") * 0.1)
    return j.withColumns({"score": F.round(score, 6), "state": F.when(F.col("breaking") > 0, "incompatible").when(F.col("others") > 0, "degraded").otherwise("compatible")}).drop("breaking", "others")


def class_matrix(fields: DataFrame) -> DataFrame:
    """(p_class, c_class, score, state): :func:`matrix` by classes of equal schemas, which may be far fewer."""
    _, of = schema_classes(fields)
    pairs = class_pairs(of)
    return _scored(pairs, class_issues(of, pairs), ["p_class", "c_class"])


def matrix(fields: DataFrame) -> DataFrame:
    """(producer, consumer, score, state) of all pairs: 1 less .3 for each breaking issue and .1 for others, 0 at least."""
    shapes, of = schema_classes(fields)
    classes = class_pairs(of)
    scored = _scored(classes, class_issues(of, classes), ["p_class", "c_class"])
    return _in_classes(interface_pairs(fields), shapes).join(scored, ["p_class", "c_class"]).select("producer", "consumer", "score", "state")


def dependency_graph(fields: DataFrame, contracts: DataFrame) -> DataFrame:
    """(src, dst, kind): system exposes interface, contract (contract, interface) governs it, producer integrates consumer."""
    exposes = fields.select(F.col("system").alias("src"), F.col("interface").alias("dst"), F.lit("exposes").alias("kind")).distinct()
    governs = contracts.select(F.col("contract").alias("src"), F.col("interface").alias("dst"), F.lit("governs").alias("kind"))
    integrates = interface_pairs(fields).select(F.col("producer").alias("src"), F.col("consumer").alias("dst"), F.lit("integrates").alias("kind"))
    return exposes.unionByName(governs).unionByName(integrates)


def transformable(issues: DataFrame, mapping: DataFrame) -> DataFrame:
    """Missing fields with whether a mapping rule (producer, consumer, target) supplies them."""
    m = mapping.select("producer", "consumer", F.col("target").alias("field")).distinct().withColumn("covered", F.lit(True))
    return issues.filter("issue = 'missing_required'").join(m, ["producer", "consumer", "field"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def unit_compatibility(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Column pairs (column, from_unit, to_unit, budget) against conversion rules (from_unit, to_unit, error): same, convertible
    within the error budget, over_budget, or incompatible."""
    j = pairs.join(rules, ["from_unit", "to_unit"], "left")
    state = F.when(F.col("from_unit") == F.col("to_unit"), "same").when(F.col("error").isNull(), "incompatible").when(F.col("error") <= F.col("budget"), "convertible").otherwise("over_budget")
    return j.select("column", "from_unit", "to_unit", state.alias("state"))


def binding_coverage(required: DataFrame, bindings: DataFrame, columns: DataFrame) -> DataFrame:
    """(term, state) of required terms: covered, stale (inactive, or its column is gone), unmapped (bound to no column) or
    missing (no binding)."""
    b = bindings.join(columns.select("column").distinct().withColumn("_there", F.lit(True)), "column", "left")
    ok = F.col("active") & F.col("_there").isNotNull()
    best = b.groupBy("term").agg(F.max(ok).alias("ok"), F.max(F.col("column").isNotNull()).alias("bound"))
    j = required.join(best, "term", "left")
    return j.select("term", F.when(F.col("bound").isNull(), "missing").when(F.col("ok"), "covered").when(F.col("bound"), "stale").otherwise("unmapped").alias("state"))


def validation_history(reports: DataFrame, subject: str, time: str, passed: Column, keep: int, tie: str) -> DataFrame:
    """The last ``keep`` reports of each subject, newest first (``n``), with whether the outcome changed from the one before."""
    w = Window.partitionBy(subject).orderBy(F.desc(time), F.desc(tie))
    df = reports.withColumn("passed", passed)
    return df.withColumns({"n": F.row_number().over(w), "changed": F.col("passed") != F.lead("passed").over(w)}).filter(F.col("n") <= keep)
