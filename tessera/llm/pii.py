"""Operator 6: personal data by patterns and by bootstrapped contexts (native DataFrame operations only).

Base spans come from one pattern a kind. They seed a bootstrap, as do access keys and what is assigned to a credential's
name: the words around a seed are lexical patterns; a pattern that mostly meets known identifiers is trusted, and unknown
digit groups and tokens of a fitting shape that trusted patterns meet become identifiers too, which in turn vouch for further
patterns. The pattern-instance graph is a table of edges, scored by joins and aggregations, a few rounds long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written without backtracking: atomic runs, and a start only where a run begins or the
#: last match ended. They find the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its kind's pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SPACE = r"\x20\x09-\x0D"
#: Seeds beyond the base kinds: an access key, or a value with a digit that a credential's name is given.
SECRET = "secret"
KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
NAMED = rf"(?i:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?[\"']?"
#: What may turn out to be an identifier: digit groups with one or two separators between them, as long as no letter or at
#: sign is glued to them; or a token with a digit or an at sign, with what is glued to it.
CANDIDATE = rf"(?<![0-9A-Za-z@])[+(]?[0-9]++(?:[\x20().-]{{1,2}}[0-9]++){{1,20}}+(?![0-9A-Za-z@])|(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: It may become an identifier of a kind only if it has this shape.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]+([.:][0-9a-fA-F]+){3,}$",
    "card": r"^[0-9]([ .-]{0,2}[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9]([ ().-]{0,2}[0-9]){6,14}$",
    SECRET: r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z+/_=-]{12,128}$",
}
ALL_KINDS = (*KINDS, SECRET)
CONTEXT, ROUNDS, MIN_SEEDS, MIN_SCORE = 64, 3, 3, 0.8


def located(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, value), in code points, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("spans"))

    def walk(both: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            value = F.get(both["found"], i)
            begin = acc["at"] + F.char_length(F.get(both["pieces"], i))
            return F.struct(
                (begin + F.char_length(value)).alias("at"),
                F.array_append(acc["spans"], F.struct(begin.alias("start"), (begin + F.char_length(value)).alias("end"), value.alias("value"))).alias("spans"),
            )

        some = F.aggregate(F.sequence(F.lit(0), F.size(both["found"]) - 1), start, step, lambda acc: acc["spans"])
        return F.when(F.size(both["found"]) > 0, some).otherwise(start["spans"])

    # an array of one, so that the two scans run once and not once a match
    once = F.array(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found")))
    return F.transform(once, walk)[0]


def luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the sum of all digits must be a multiple of ten."""
    return F.call_function("luhn_check", digits)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _of_kind(text: Column, k: int) -> Column:
    kind = KINDS[k]
    may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    may = may & text.rlike("[0-9]") if kind != "email" else may
    good = F.filter(located(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return F.transform(F.when(may, good).otherwise(none), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """The contract's spans: an array of (start, kind as its place in KINDS, end, value), ordered."""
    return F.array_sort(F.concat(*[_of_kind(text, k) for k in range(len(KINDS))]))


def secret_spans(text: Column, base: Column) -> Column:
    """The seeds beyond the base kinds that no base span meets, in the form of :func:`base_spans`."""
    whole = located(text, rf"{KEY}|{NAMED}[^{SPACE}\"']{{7,127}}[^{SPACE}\"'.,;:!?)]")

    def value(s: Column) -> Column:
        head = F.length(F.regexp_extract(s["value"], rf"^({NAMED})", 1))
        return F.struct((s["start"] + head).alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end"), F.substring(s["value"], head + 1, F.length(s["value"])).alias("value"))

    may = F.contains(text, F.lit("AKIA")) | text.rlike("[=:]")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    return F.when(may, F.filter(_clear_of(F.transform(whole, value), base), lambda s: s["value"].rlike("[0-9]"))).otherwise(none)


def _clear_of(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def span_string(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def contexts(text: Column, start: Column, end: Column, value: Column) -> Column:
    """Lexical patterns around a span: two words before; one before and one after; what is glued before the value."""
    left = F.lower(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
    right = F.lower(F.substring(text, end + 1, F.lit(CONTEXT)))
    glued = F.regexp_extract(left, rf"([^{SPACE}]+)$", 1)
    before = F.regexp_extract(left, rf"([^{SPACE}0-9]+)[{SPACE}]+[^{SPACE}]*$", 1)
    two = F.regexp_extract(left, rf"([^{SPACE}0-9]+[{SPACE}]+[^{SPACE}0-9]+)[{SPACE}]+[^{SPACE}]*$", 1)
    after = F.regexp_extract(right, rf"^[^{SPACE}]*[{SPACE}]+([^{SPACE}0-9]+)", 1)
    found = F.array(
        F.when(two != "", F.concat(F.lit("2<"), two)),
        F.when((before != "") & (after != ""), F.concat(F.lit("<>"), before, F.lit(" "), after)),
        F.when(glued != "", F.concat(F.lit("="), glued)),
    )
    return F.array_compact(found)


def _candidates(text: Column, known: Column) -> Column:
    """What may be an identifier outside all known spans, without the punctuation around it."""
    def trim(s: Column) -> Column:
        head = F.length(F.regexp_extract(s["value"], r"^([^0-9A-Za-z+(]*+)", 1))
        body = F.regexp_replace(F.substring(s["value"], head + 1, F.length(s["value"])), r"[^0-9A-Za-z]++$", "")
        glue = F.length(F.regexp_extract(body, r"^([A-Za-z_]++[=:])", 1))
        body = F.substring(body, glue + 1, F.length(body))
        begin = s["start"] + head + glue
        return F.struct(begin.alias("start"), (begin + F.length(body)).alias("end"), body.alias("value"))

    alone = _clear_of(located(text, CANDIDATE), known)
    any_shape = "|".join(f"(?:{p})" for p in SHAPES.values())
    return F.filter(F.transform(alone, trim), lambda s: s["value"].rlike(any_shape))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, base (array of start, kind, end, value), seeded (the same, the seeds beyond the
    base kinds, which fixed patterns find) and added (what the bootstrap discovers). Starts and ends count code points, ends
    are exclusive; kind is a place in ALL_KINDS.

    A pattern is trusted for a kind if at least ``min_seeds`` different known values of that kind stand in it and they
    are, weighted by confidence, ``min_score`` of all values there; a value is added if the patterns around it give it
    that confidence (noisy or) and its shape fits. Null text counts as empty; rows may repeat and ids may be null; other columns are ignored; an
    empty table gives an empty result."""
    text = F.col("text")
    first = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    first = first.withColumn("base", base_spans(text))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    first = first.withColumn("keys", secret_spans(text, F.col("base")))
    first = first.withColumn("others", F.when(text.rlike("[0-9@]"), _candidates(text, F.concat("base", "keys"))).otherwise(none))
    around = lambda s: contexts(text, s["start"], s["end"], s["value"])
    spans = F.concat(
        F.transform(F.concat("base", "keys"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"), s["kind"].alias("kind"), around(s).alias("patterns"))),
        F.transform("others", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"), F.lit(None).cast("int").alias("kind"), around(s).alias("patterns"))),
    )
    seen = stash(first.select("row", "id", "base", "keys", spans.alias("spans")), "spans")
    one = seen.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    edges = stash(one.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct(), "edges")
    unknown = edges.filter("kind IS NULL").select("pattern", "value").join(edges.filter("kind IS NOT NULL").select("value"), "value", "left_anti")
    known = edges.filter("kind IS NOT NULL").select("pattern", "value", "kind").withColumn("conf", F.lit(1.0))
    sizes = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    added = None
    for _ in range(rounds):
        support = known if added is None else known.unionByName(unknown.join(added, "value"))
        scored = support.groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"), F.count(F.lit(1)).alias("values")).filter(F.col("values") >= min_seeds)
        trusted = scored.join(sizes, "pattern").withColumn("score", F.col("mass") / F.col("n")).filter(F.col("score") >= min_score)
        fits = F.lit(False)
        for k, kind in enumerate(ALL_KINDS):
            fits = fits | ((F.col("kind") == k) & F.col("value").rlike(SHAPES[kind]))
        doubt = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))
        conf = unknown.join(trusted.select("pattern", "kind", "score"), "pattern").filter(fits).groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("conf"))
        best = conf.groupBy("value").agg(F.max(F.struct("conf", (-F.col("kind")).alias("rank"))).alias("b")).filter(F.col("b.conf") >= min_score)
        added = stash(best.select("value", (-F.col("b.rank")).alias("kind"), F.col("b.conf").alias("conf")), "added")
    more = one.filter("kind IS NULL").drop("kind").join(added.select("value", "kind"), "value")
    more = more.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value"))).alias("added"))
    out = seen.select("row", "id", "base", "keys").join(more, "row", "left")
    nothing = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    return out.select(F.col("id").alias(id_col), "base", F.col("keys").alias("seeded"), F.coalesce("added", nothing).alias("added"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`find_pii` of ``documents``: doc_id, the contract's counts, digest and span string, and n_seeded, n_added and
    n_spans, the numbers of seeds beyond the base kinds, of spans that the bootstrap discovered, and of all. Null texts count as empty; rows that repeat have a row each."""
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "seeded", "added"))
    return found.select("doc_id", *counts, F.sha2(span_string(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_string(every).alias("spans"), F.size("seeded").cast("bigint").alias("n_seeded"), F.size("added").cast("bigint").alias("n_added"), F.size(every).cast("bigint").alias("n_spans"))


ORACLE_SQL = None
