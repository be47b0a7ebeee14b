"""Projections, predicates, routing, coercion and cleaning: row by row, without a shuffle unless a key table is needed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"(?U)^\s+|\s+$"


def number(c: Column) -> Column:
    """Text or number as a double; null if it isn't one."""
    return F.trim(c.cast("string")).try_cast("double")


def field_op(c: Column, op: Mapping | str) -> Column:
    """One step of a field's chain: a name, or a mapping with ``op`` and its parameters."""
    p = {"op": op} if isinstance(op, str) else dict(op)
    kind = p["op"].upper()
    if kind == "TRIM":
        return F.regexp_replace(c, BLANK, "")
    if kind in ("LOWER", "UPPER"):
        return F.lower(c) if kind == "LOWER" else F.upper(c)
    if kind == "REGEX":
        return F.regexp_replace(c, p["pattern"], p["replacement"])
    if kind == "REPLACE":
        return F.replace(c, F.lit(p["from"]), F.lit(p["to"]))
    if kind == "SPLIT":  # 0-based; empty if there is no such part
        return F.coalesce(F.get(F.split(c, "\\Q" + p["delimiter"] + "\\E", -1), F.lit(p["index"])), F.lit(""))
    if kind == "SUBSTRING":  # 0-based
        return F.substring(c, p["start"] + 1, p.get("length", 1 << 30))
    if kind == "ROUND":
        return F.round(number(c), p["decimals"])
    if kind == "IF_NULL":  # empty text counts as null
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(p["default"]))
    if kind == "CONCAT":
        return F.concat_ws(p.get("separator", ""), *[F.col(x) for x in p["fields"]])
    if kind == "COALESCE":
        return F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in p["fields"]])
    if kind == "FORMAT_DATE":
        return F.date_format(c, p["pattern"])
    if kind == "CUSTOM":
        return F.expr(p["expression"])
    raise ValueError(f"unknown operation {kind}")


def field_transform(df: DataFrame, chains: Mapping[str, Sequence[Mapping | str]]) -> DataFrame:
    done = {}
    for field, ops in chains.items():
        c = F.col(field) if field in df.columns else F.lit(None)
        for op in ops:
            c = field_op(c, op)
        done[field] = c
    return df.withColumns(done)


def modification_counts(df: DataFrame, chains: Mapping[str, Sequence[Mapping | str]]) -> DataFrame:
    """(field, changed, rows): how many values a transformation changes; rows is the same for all."""
    both = df.select(*[F.col(f).alias(f"b{i}") for i, f in enumerate(chains)], *[_chain(f, ops).alias(f"a{i}") for i, (f, ops) in enumerate(chains.items())])
    counts = [F.struct(F.lit(f).alias("field"), F.count_if(~F.col(f"b{i}").eqNullSafe(F.col(f"a{i}"))).alias("changed"), F.count(F.lit(1)).alias("rows")) for i, f in enumerate(chains)]
    return both.agg(F.array(*counts).alias("a")).select(F.inline("a"))


def _chain(field: str, ops: Sequence[Mapping | str]) -> Column:
    c = F.col(field)
    for op in ops:
        c = field_op(c, op)
    return c


def condition(df: DataFrame, tree: Mapping) -> Column:
    """A predicate from a tree: {"type": "and", "conditions": [...]}, {"type": "gt", "field": "a.b", "value": 3}, ...

    Fields may be nested; one that the schema lacks is an error. Values that look like numbers compare as numbers. The
    result is never null."""
    kind = tree["type"]
    if kind in ("and", "or"):
        parts = [condition(df, t) for t in tree["conditions"]]
        out = F.lit(kind == "and")
        for p in parts:
            out = out & p if kind == "and" else out | p
        return out
    if kind == "not":
        return ~condition(df, tree["condition"])
    if kind in ("always", "never"):
        return F.lit(kind == "always")
    df.select(tree["field"])  # raises if there is no such field
    c, v = F.col(tree["field"]), tree.get("value")
    if kind in ("exists", "is_null"):
        return c.isNotNull() if kind == "exists" else c.isNull()
    if kind in ("gt", "lt", "gte", "lte"):
        x = number(c)
        out = {"gt": x > v, "lt": x < v, "gte": x >= v, "lte": x <= v}[kind]
    elif kind in ("equals", "not_equals"):
        same = number(c) == float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else c.cast("string") == str(v)
        same = F.coalesce(same, F.lit(False))
        return same if kind == "equals" else ~same
    elif kind == "contains":
        out = F.contains(c.cast("string"), F.lit(v))
    elif kind == "matches":
        out = c.cast("string").rlike(v)
    elif kind == "in":
        out = c.cast("string").isin([str(x) for x in v])
    else:
        raise ValueError(f"unknown condition {kind}")
    return F.coalesce(out, F.lit(False))


def route(df: DataFrame, routes: Sequence[Mapping], default: str | None = None, to: str = "route") -> DataFrame:
    """The name of the first enabled route, by descending priority, whose condition holds; else ``default``."""
    live = sorted((r for r in routes if r.get("enabled", True)), key=lambda r: -r.get("priority", 0))
    c = F.lit(default).cast("string")
    for r in reversed(live):
        c = F.when(condition(df, r["condition"]), F.lit(r["name"])).otherwise(c)
    return df.withColumn(to, c)


def route_matrix(df: DataFrame, routes: Sequence[Mapping]) -> DataFrame:
    return df.withColumns({f"match_{r['name']}": condition(df, r["condition"]) for r in routes})


def route_stats(df: DataFrame, routes: Sequence[Mapping]) -> DataFrame:
    """(route, rows), with the rows that no route takes under ``unmatched``."""
    hits = {r["name"]: condition(df, r["condition"]) for r in routes}
    none = F.lit(True)
    for c in hits.values():
        none = none & ~c
    parts = [F.struct(F.lit(n).alias("route"), F.count_if(c).alias("rows")) for n, c in {**hits, "unmatched": none}.items()]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def map_fields(df: DataFrame, mapping: Sequence[tuple[str, str, float]], conflict: str = "first_wins", preserve_unmapped: bool = False) -> DataFrame:
    """Renames (source, target, confidence). Of several sources of one target the first, or the most confident, that has
    a value wins; ``conflict="error"`` refuses them."""
    by: dict[str, list[tuple[str, float]]] = {}
    for source, target, confidence in mapping:
        if source in df.columns:
            by.setdefault(target, []).append((source, confidence))
    if conflict == "error" and (twice := [t for t, s in by.items() if len(s) > 1]):
        raise ValueError(f"several sources for {twice}")
    if conflict == "highest_confidence":
        by = {t: sorted(s, key=lambda x: -x[1]) for t, s in by.items()}
    cols = [F.coalesce(*[F.col(s) for s, _ in sources]).alias(target) for target, sources in by.items()]
    used = {s for sources in by.values() for s, _ in sources}
    return df.select(*cols, *[c for c in df.columns if c not in used] if preserve_unmapped else [])


def semantic_map(df: DataFrame, mapping: Sequence[tuple[str, str, float]], threshold: float = 0.95, keep_originals: bool = True) -> DataFrame:
    """:func:`map_fields` with the mappings of at least ``threshold``."""
    return map_fields(df, [m for m in mapping if m[2] >= threshold], "highest_confidence", keep_originals)


def compose_mappings(to_term: DataFrame, from_term: DataFrame) -> DataFrame:
    """(source, target, term, confidence) over a shared term: vendor A's fields to vendor B's."""
    return to_term.alias("a").join(from_term.alias("b"), "term").select(F.col("a.field").alias("source"), F.col("b.field").alias("target"), "term", (F.col("a.confidence") * F.col("b.confidence")).alias("confidence"))


def mapping_coverage(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """(vendor, fields, mapped, coverage)."""
    hit = fields.join(mapping.select("vendor", "field").distinct().withColumn("hit", F.lit(1)), ["vendor", "field"], "left")
    return hit.groupBy("vendor").agg(F.count(F.lit(1)).alias("fields"), F.count("hit").alias("mapped"), (F.count("hit") / F.count(F.lit(1))).alias("coverage"))


def confidence_gate(df: DataFrame, column: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col(column) >= threshold, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def lookup_values(df: DataFrame, column: str, codes: Mapping[str, str], to: str, default: str | None = None) -> DataFrame:
    """Translates codes by a map literal (a code list is small)."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return df.withColumn(to, F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(default)))


def page(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 100, search: tuple[str, str] | None = None) -> DataFrame:
    if search:
        df = df.filter(F.contains(F.lower(F.col(search[0])), F.lit(search[1].lower())))
    return df.orderBy(*order).offset(offset).limit(limit)


def standardize(df: DataFrame) -> DataFrame:
    """Trims every text column."""
    return df.select(*[F.regexp_replace(f.name, BLANK, "").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def coerce(df: DataFrame, target: T.StructType, lengths: Mapping[str, int] | None = None) -> DataFrame:
    """Casts to a schema, columns matched without regard to case; ``_errors`` lists what failed: missing values of
    columns that may not be null, values that don't cast, texts over their length. Failed values become null."""
    have = {c.lower(): c for c in df.columns}
    cols, errors = [], []
    for f in target:
        raw = F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None).cast("string")
        text = F.regexp_replace(raw.cast("string"), BLANK, "")
        blank = text.isNull() | (text == "")
        value = text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)
        if not isinstance(f.dataType, T.StringType):
            errors.append(F.when(~blank & value.isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString()}")))
        if not f.nullable:
            errors.append(F.when(blank, F.lit(f"{f.name}: missing")))
        if lengths and f.name in lengths:
            errors.append(F.when(F.char_length(text) > lengths[f.name], F.lit(f"{f.name}: longer than {lengths[f.name]}")))
        cols.append(value.alias(f.name))
    return df.select(*cols, F.array_compact(F.array(*errors)).alias("_errors") if errors else F.array().cast("array<string>").alias("_errors"))


def validate_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """(column, missing): rows without a value; a column that is absent misses all."""
    parts = [F.struct(F.lit(c).alias("column"), (F.count_if(F.col(c).isNull()) if c in df.columns else F.count(F.lit(1))).alias("missing")) for c in required]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def assign_ids(df: DataFrame, order: Sequence[str], name: str = "id", start: int = 1) -> DataFrame:
    """Consecutive ids in a stable order. Ranges of the order are numbered in parallel: rows are counted per range first,
    then each range numbers its own."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return ranged.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at") + F.lit(start - 1)).drop("_part", "_at", "_before")


def flatten_multi_valued(df: DataFrame, key: Sequence[str], column: str) -> tuple[DataFrame, DataFrame]:
    """Parent rows without the column, and a child table (key, value) of its distinct values."""
    child = df.select(*key, F.explode(column).alias("value")).dropDuplicates()
    return df.drop(column), child


def denormalize(parent: DataFrame, child: DataFrame, key: Sequence[str], values: Sequence[str], to: str = "children") -> DataFrame:
    """Parents with their children's values as a sorted array."""
    grouped = child.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*values))).alias(to))
    return parent.join(grouped, list(key), "left")


def convert_units(df: DataFrame, column: str, scale: float, offset: float = 0.0, to: str | None = None) -> DataFrame:
    return df.withColumn(to or column, F.col(column) * scale + offset)


# Semi-major axis and flattening of WGS 84.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563


def helmert(df: DataFrame, xyz: Sequence[str], shift: Sequence[float], rotation_arcsec: Sequence[float], scale_ppm: float, to: Sequence[str] = ("x2", "y2", "z2")) -> DataFrame:
    """A seven-parameter change of frame, small angles (position vector)."""
    x, y, z = (F.col(c) for c in xyz)
    rx, ry, rz = (r * 3.141592653589793 / (180 * 3600) for r in rotation_arcsec)
    m = 1 + scale_ppm * 1e-6
    out = (shift[0] + m * (x - rz * y + ry * z), shift[1] + m * (rz * x + y - rx * z), shift[2] + m * (-ry * x + rx * y + z))
    return df.withColumns(dict(zip(to, out)))


def to_tangent_plane(df: DataFrame, lat: str, lon: str, alt: str, origin: tuple[float, float, float], to: Sequence[str] = ("east", "north", "up")) -> DataFrame:
    """Geodetic coordinates (degrees, metres) in the local tangent plane at ``origin``."""
    e2 = FLATTENING * (2 - FLATTENING)

    def ecef(la: Column, lo: Column, h: Column) -> tuple[Column, Column, Column]:
        n = F.lit(AXIS) / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
        return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - e2) + h) * F.sin(la)

    la0, lo0 = F.radians(F.lit(origin[0])), F.radians(F.lit(origin[1]))
    p, o = ecef(F.radians(lat), F.radians(lon), F.col(alt)), ecef(la0, lo0, F.lit(origin[2]))
    dx, dy, dz = (a - b for a, b in zip(p, o))
    return df.withColumns({
        to[0]: -F.sin(lo0) * dx + F.cos(lo0) * dy,
        to[1]: -F.sin(la0) * F.cos(lo0) * dx - F.sin(la0) * F.sin(lo0) * dy + F.cos(la0) * dz,
        to[2]: F.cos(la0) * F.cos(lo0) * dx + F.cos(la0) * F.sin(lo0) * dy + F.sin(la0) * dz,
    })


def parse_date_multi(c: Column, formats: Sequence[str]) -> Column:
    """The first format that fits."""
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def unify_sources(sources: Mapping[str, tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Several sources on one target's terms, with their name in ``_source``; absent terms are null."""
    out = None
    for name, (df, mapping) in sources.items():
        part = df.select(*[F.col(s).alias(t) for s, t in mapping.items()], F.lit(name).alias("_source"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# XML Schema types and Spark's.
XSD = {"string": "string", "integer": "bigint", "int": "int", "long": "bigint", "decimal": "decimal(38,10)", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "dateTime": "timestamp"}


def cast_by_xsd(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string").try_cast(XSD[t.rsplit(":", 1)[-1].rsplit("#", 1)[-1]]) for c, t in types.items()})


#: (from, to) -> safe or lossy; what is not named is invalid, equal types are safe.
CONVERSIONS = {
    ("int", "bigint"): "safe", ("int", "double"): "safe", ("int", "string"): "safe", ("bigint", "int"): "lossy", ("bigint", "double"): "lossy", ("bigint", "string"): "safe",
    ("double", "int"): "lossy", ("double", "bigint"): "lossy", ("double", "string"): "safe", ("string", "int"): "lossy", ("string", "bigint"): "lossy", ("string", "double"): "lossy",
    ("string", "date"): "lossy", ("string", "timestamp"): "lossy", ("string", "boolean"): "lossy", ("timestamp", "date"): "lossy", ("date", "timestamp"): "safe", ("timestamp", "string"): "safe",
    ("date", "string"): "safe", ("boolean", "string"): "safe", ("boolean", "int"): "safe",
}


def conversion_report(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """(column, source_type, target_type, verdict, failing, losing): by the table, and how many values in fact don't
    convert or don't come back the same."""
    parts = []
    for c, to in targets.items():
        own = df.schema[c].dataType.simpleString()
        verdict = "safe" if own == to else CONVERSIONS.get((own, to), "invalid")
        if verdict == "invalid":
            failing, losing = F.count(c), F.lit(0).cast("bigint")
        else:
            cast = F.col(c).try_cast(to)
            back = cast.try_cast(own)
            failing = F.count_if(F.col(c).isNotNull() & cast.isNull())
            losing = F.count_if(cast.isNotNull() & ~back.eqNullSafe(F.col(c))) if own != "string" else F.lit(0).cast("bigint")
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(own).alias("source_type"), F.lit(to).alias("target_type"), F.lit(verdict).alias("verdict"), failing.alias("failing"), losing.alias("losing")))
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def resolve_references(df: DataFrame, column: str, keys: DataFrame, natural: str, surrogate: str) -> tuple[DataFrame, DataFrame]:
    """Replaces a natural identifier by its surrogate key. Returns the rows and the key table with new keys, numbered
    after the largest, for identifiers it lacked."""
    new = df.select(F.col(column).alias(natural)).filter(F.col(natural).isNotNull()).distinct().join(keys, natural, "left_anti")
    numbered = assign_ids(new, [natural], "_n")
    top = keys.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("_top"))
    whole = keys.select(natural, surrogate).unionByName(numbered.join(F.broadcast(top)).select(natural, (F.col("_top") + F.col("_n")).cast(keys.schema[surrogate].dataType).alias(surrogate)))
    return df.join(whole.withColumnRenamed(natural, column), column, "left"), whole
