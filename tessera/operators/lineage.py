"""Row, column, schema and record lineage as tables."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint_folder, drop_stored, stored, stored_folder

# Changes that break readers.
BREAKING = ("drop_table", "drop_column", "change_type", "set_not_null", "drop_primary_key", "drop_foreign_key")
CRITICAL = r"(?i)prod|fact_|dim_|public"


def capture_rows(before: DataFrame, after: DataFrame, row_id: str, job: str, failed: DataFrame | None = None, reason: str = "filtered") -> DataFrame:
    """(row_id, job, outcome, reason) of a transformation: processed if the id came out, validation_failed if ``failed``
    (row_id, message) has it, else filtered; created if it only came out."""
    ids = before.select(row_id).withColumn("_in", F.lit(True)).join(after.select(row_id).distinct().withColumn("_out", F.lit(True)), row_id, "full")
    if failed is not None:
        ids = ids.join(failed.select(row_id, F.col("message").alias("_m")), row_id, "left")
    else:
        ids = ids.withColumn("_m", F.lit(None).cast("string"))
    outcome = F.when(F.col("_in").isNull(), "created").when(F.col("_out").isNotNull(), "processed").when(F.col("_m").isNotNull(), "validation_failed").otherwise("filtered")
    return ids.select(F.col(row_id).alias("row_id"), F.lit(job).alias("job"), outcome.alias("outcome"), F.when(outcome == "filtered", F.lit(reason)).otherwise(F.col("_m")).alias("reason"))


def dedup_lineage(df: DataFrame, keys: Sequence[str], row_id: str, order: Sequence[str], strategy: str = "first") -> DataFrame:
    """(kept, removed, strategy): each removed row with the one that stays. The survivor is found by an aggregation that
    combines before the shuffle, then joined, so AQE can split a hot key."""
    pick = F.min_by if strategy == "first" else F.max_by
    kept = df.groupBy(*keys).agg(pick(F.col(row_id), F.struct(*order)).alias("kept"))
    return df.join(kept, list(keys)).filter(F.col(row_id) != F.col("kept")).select("kept", F.col(row_id).alias("removed"), F.lit(strategy).alias("strategy"))


def row_journey(events: DataFrame, row: str, time: str, step: str, tie: Sequence[str] = ()) -> DataFrame:
    """Numbered steps of each row with seconds since the one before, and whether it is the last."""
    w = Window.partitionBy(row).orderBy(time, *tie)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return events.select(row, F.row_number().over(w).alias("n"), step, ((us - F.lag(us).over(w)) / 1e6).alias("seconds"), F.lead(step).over(w).isNull().alias("is_last"))


def job_statistics(rows: DataFrame) -> DataFrame:
    """Totals by outcome for each job."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return rows.groupBy("job").agg(F.count(F.lit(1)).alias("total"), n("processed"), n("filtered"), n("validation_failed"), n("created"))


def search_rows(rows: DataFrame, job: str | None = None, outcome: str | None = None, key_part: str | None = None) -> DataFrame:
    for c, v in (("job", job), ("outcome", outcome)):
        if v is not None:
            rows = rows.filter(F.col(c) == v)
    return rows if key_part is None else rows.filter(F.contains(F.col("row_id").cast("string"), F.lit(key_part)))


def column_edges(job: str, mapping: Sequence[tuple[Sequence[str], str, str]], spark) -> DataFrame:  # noqa: ANN001
    """(src, dst, kind, reversible, job) of declared column mappings; kinds are rename, cast, concat, aggregate, ..."""
    rows = [(s, d, k, k in ("rename", "copy", "cast"), job) for sources, d, k in mapping for s in sources]
    return spark.createDataFrame(rows, "src string, dst string, kind string, reversible boolean, job string")


def _items(seq) -> list:  # noqa: ANN001
    return [seq.apply(i) for i in range(seq.size())]


def _how(expression) -> str:  # noqa: ANN001
    """What a named expression does to the columns it refers to."""
    name, child = expression.nodeName(), expression
    if name == "Alias":
        child = expression.child()
        name = child.nodeName()
    if name == "Cast" and child.child().nodeName() == "AttributeReference":
        return "cast"
    if name == "AttributeReference":
        return "rename"
    return "aggregate" if "AggregateExpression" in name or any(x.nodeName() == "AggregateExpression" for x in _items(child.children())) else "derive"


def frame_edges(df: DataFrame, job: str) -> DataFrame:
    """(src, dst, kind, reversible, job): from which columns of which tables each column of ``df`` comes, read from its
    analysed plan. Kinds are copy, rename, cast, aggregate and derive; of several steps the one that changes most. A table
    that is read from files has the name of its folder or file. Filters, join conditions and groupings leave no edge."""
    order = ("copy", "rename", "cast", "derive", "aggregate")
    worst = lambda a, b: max(a, b, key=order.index)

    def walk(node) -> dict[int, dict[str, str]]:  # noqa: ANN001
        children = _items(node.children())
        known: dict[int, dict[str, str]] = {}
        for c in children:
            known |= walk(c)
        if not children:
            table = node.nodeName()
            try:
                table = node.relation().location().rootPaths().apply(0).getName().removesuffix(".parquet")
            except Py4JError:  # a source without files
                pass
            return {a.exprId().id(): {f"{table}.{a.name()}": "copy"} for a in _items(node.output())}
        made = {x.exprId().id(): x for x in _items(node.expressions()) if x.nodeName() == "Alias"}
        for i, o in enumerate(_items(node.output())):
            at = o.exprId().id()
            if node.nodeName() == "Union":
                known[at] = {s: k for c in children for s, k in known[c.output().apply(i).exprId().id()].items()}
            elif at not in known:
                e = made.get(at)
                refs, how = (_items((e if e is not None else node).references().toSeq()), "derive" if e is None else _how(e))
                sources: dict[str, str] = {}
                for ref in refs:
                    for s, k in known.get(ref.exprId().id(), {}).items():
                        sources[s] = worst(sources.get(s, "copy"), worst(k, how))
                known[at] = sources
        return known

    plan = df._jdf.queryExecution().analyzed()
    known = walk(plan)
    rows = [(s, o.name(), k, k in ("copy", "rename", "cast"), job) for o in _items(plan.output()) for s, k in known[o.exprId().id()].items()]
    return df.sparkSession.createDataFrame(rows, "src string, dst string, kind string, reversible boolean, job string")


def trace(edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_hops: int | None = None) -> DataFrame:
    """(start, node, hops): all that is reached, with the fewest hops, at most ``max_hops`` away if that is given. Breadth
    first: each hop is one join of the frontier; nodes that were reached before are left out, so a cycle ends. What a hop
    finds is written once. ``starts`` has a column ``start``."""
    e = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")) if direction == "downstream" else edges.select(F.col("dst").alias("x"), F.col("src").alias("y"))
    checkpoint_folder(edges.sparkSession)
    e = e.distinct().checkpoint()
    frontier = starts.select("start", F.col("start").alias("node")).distinct().checkpoint()
    seen, out, hop = frontier, None, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = frontier.join(e, frontier["node"] == e["x"]).select("start", F.col("y").alias("node")).distinct().join(seen, ["start", "node"], "left_anti").checkpoint()
        if not step.take(1):
            break
        found = step.withColumn("hops", F.lit(hop))
        out = found if out is None else out.unionByName(found)
        seen, frontier = seen.unionByName(step), step
    return out if out is not None else frontier.filter("false").withColumn("hops", F.lit(0))


def _core(e: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) that can be part of a cycle: a node without an edge in or without one out goes, until all have both.
    Edges in and out are counted once; then a round looks only for edges of nodes that went in the one before. ``e`` has no
    nulls and is stored."""
    spark = e.sparkSession
    end = lambda df, c, n_out, n_in: df.select(F.col(c).alias("node"), F.lit(n_out).cast("bigint").alias("n_out"), F.lit(n_in).cast("bigint").alias("n_in"))
    both = lambda a, b: a.unionByName(b).groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    nodes, n, went = stored(both(end(e, "src", 1, 0), end(e, "dst", 0, 1)), f"{at}/nodes-0"), 0, []
    while True:
        gone = stored(nodes.filter("n_out = 0 OR n_in = 0").select("node"), f"{at}/gone-{n}")  # small ones are sent to all tasks
        if gone.isEmpty():
            break
        went.append(f"{at}/gone-{n}")
        less = both(end(e.join(gone, e["src"] == gone["node"]), "dst", 0, 1), end(e.join(gone, e["dst"] == gone["node"]), "src", 1, 0))
        less = less.select("node", F.col("n_out").alias("l_out"), F.col("n_in").alias("l_in"))
        left = lambda c: (F.col(f"n_{c}") - F.coalesce(f"l_{c}", F.lit(0))).alias(f"n_{c}")
        fewer = nodes.filter("n_out > 0 AND n_in > 0").join(less, "node", "left").select("node", left("out"), left("in"))
        nodes, n = stored(fewer, f"{at}/nodes-{n + 1}"), n + 1
        drop_stored(spark, f"{at}/nodes-{n - 1}")
    if went:
        gone = spark.read.schema(gone.schema).parquet(*went)
        for c in ("src", "dst"):
            e = e.join(gone.withColumnRenamed("node", c), c, "left_anti")
    return e.select("src", "dst"), nodes.select("node")


def _without_ends(edges: DataFrame) -> DataFrame:
    """The distinct edges that can be part of a cycle (:func:`_core`)."""
    at = stored_folder(edges.sparkSession, "edges")
    return stored(_core(stored(edges.select("src", "dst").dropna(), f"{at}/all"), at)[0].distinct(), f"{at}/core")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes in a cycle of different nodes, by colouring: each node takes the largest name that reaches
    it; what a colour's own node is reached from within the colour is a component. Then these go, and what is left is coloured
    anew."""
    e, out = _without_ends(edges.filter("src != dst")), None
    while e.take(1):
        colour = e.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")).checkpoint()
        while True:
            sent = e.join(colour, e["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("m"))
            grown = colour.join(sent, "node").select("node", F.greatest("c", "m").alias("c"), (F.col("m") > F.col("c")).alias("up")).checkpoint()
            colour = grown.select("node", "c")
            if not grown.filter("up").take(1):
                break
        of = lambda x: colour.select(F.col("node").alias(x), F.col("c").alias(f"c_{x}"))
        inside = e.join(of("src"), "src").join(of("dst"), "dst").filter("c_src = c_dst").select("src", "dst").checkpoint()
        frontier = colour.filter("node = c")
        found = frontier
        while True:
            frontier = frontier.join(inside, frontier["node"] == inside["dst"]).select(F.col("src").alias("node"), "c").distinct().join(found, ["node", "c"], "left_anti").checkpoint()
            if not frontier.take(1):
                break
            found = found.unionByName(frontier).checkpoint()
        out = found if out is None else out.unionByName(found)
        e = _without_ends(e.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"))
    empty = e.select(F.col("src").alias("node"), F.col("src").alias("component")).filter("false")
    if out is None:
        return empty
    whole = out.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c")  # a node between two components is one of its own
    return out.join(whole, "c").select("node", F.col("c").alias("component"))


def _contracted(e: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of distinct core edges without loops: rings (node, length) of nodes of one edge in and out; chains (node, chain) of such
    nodes between others; and the edges (u, v, w, chain) that are left, a chain as one of its length. Each round doubles how
    far a node of a chain sees, so there are as many as the logarithm of the longest. A ring is whole when the node behind
    its least one sees that one again."""
    spark, kind = e.sparkSession, e.schema["src"].dataType
    none = F.lit(None).cast(kind)
    ends = e.select(F.col("src").alias("node"), F.col("dst").alias("to"), none.alias("from")).unionByName(e.select(F.col("dst").alias("node"), none.alias("to"), F.col("src").alias("from")))
    one = F.max("to").alias("to"), F.max("from").alias("from"), ((F.count("to") == 1) & (F.count("from") == 1)).alias("inner")
    degrees = stored(ends.groupBy("node").agg(*one), f"{at}/degrees")
    number = lambda n: F.lit(n).cast("bigint")
    p = degrees.filter("inner").select("node", "to", "from", number(1).alias("len"), F.col("node").alias("end"), F.col("node").alias("least"), number(0).alias("ahead"), F.lit(True).alias("on"))
    n = 0
    while True:
        far = p.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("len").alias("len2"), F.col("end").alias("end2"), F.col("least").alias("least2"), F.col("ahead").alias("ahead2"))
        q = p.filter("on").join(far, "to", "left")
        go, less = F.col("to2").isNotNull(), F.col("least2") < F.col("least")
        pick = lambda a, b, when: F.when(when, b).otherwise(F.col(a)).alias(a)
        q = q.select("node", pick("to", F.col("to2"), go), "from", pick("len", F.col("len") + F.col("len2"), go), pick("end", F.col("end2"), go), pick("least", F.col("least2"), less), pick("ahead", F.col("len") + F.col("ahead2"), less), go.alias("on"))
        p, n = stored(q.unionByName(p.filter("NOT on")), f"{at}/seen-{n + 1}"), n + 1
        if n > 1:
            drop_stored(spark, f"{at}/seen-{n - 1}")
        whole = p.filter("on AND `from` = least").select("least", (F.col("ahead") + 1).alias("length"))
        if p.filter("on").count() == (whole.agg(F.sum("length")).first()[0] or 0):
            break
    rings = p.filter("on").join(whole, "least").select("node", "length")
    chains = p.filter("NOT on").select("node", F.col("end").alias("chain"), "to", "from", "len")
    long = chains.groupBy("chain").agg(F.max_by("from", "len").alias("u"), F.max("to").alias("v"), (F.max("len") + 1).alias("w")).select("u", "v", "w", "chain")
    outer = stored(degrees.filter("NOT inner").select("node"), f"{at}/outer")
    short = e.join(outer, e["src"] == outer["node"], "left_semi").join(outer, e["dst"] == outer["node"], "left_semi").select(F.col("src").alias("u"), F.col("dst").alias("v"), number(1).alias("w"), none.alias("chain"))
    return rings, chains.select("node", "chain"), stored(short.unionByName(long), f"{at}/left")


def _numbered(node: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), node)


def cycles(edges: DataFrame) -> DataFrame:
    """(node, length) of nodes that reach themselves, by the shortest way, however long.

    What leads nowhere goes; then nodes are numbers, their hashes by the first seed that gives no two the same; chains and
    rings of nodes with one edge in and out are contracted; ways are sought between the branching nodes of each strong
    component only. A ring of any size costs a few rounds and a row a node; a component costs at most the square of its
    branching nodes."""
    at, seed = stored_folder(edges.sparkSession, "cycles"), 0
    e = stored(edges.select("src", "dst").dropna(), f"{at}/edges")
    loops = e.filter("src = dst").select(F.col("src").alias("node"), F.lit(1).cast("bigint").alias("length"))
    core, nodes = _core(e.filter("src != dst"), at)
    while nodes.groupBy(_numbered(F.col("node"), seed)).count().filter("count > 1").take(1):
        seed += 1
    numbered = stored(core.select(_numbered(F.col("src"), seed).alias("src"), _numbered(F.col("dst"), seed).alias("dst")).distinct(), f"{at}/core")
    out, chains, left = _contracted(numbered, at)
    if left.take(1):
        of = strong_components(left.select(F.col("u").alias("src"), F.col("v").alias("dst"))).checkpoint()
        c = lambda x: of.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        inside = left.join(c("u"), "u", "left").join(c("v"), "v", "left").filter("u = v OR c_u = c_v").select("u", "v", "w", "chain").checkpoint()
        steps = inside.filter("u != v").groupBy("u", "v").agg(F.min("w").alias("w")).checkpoint()
        best = steps.select(F.col("u").alias("start"), F.col("v").alias("at"), F.col("w").alias("d"))
        frontier = best
        while True:
            walked = frontier.join(steps, frontier["at"] == steps["u"]).select("start", F.col("v").alias("at"), (F.col("d") + F.col("w")).alias("d2")).filter("start != at").groupBy("start", "at").agg(F.min("d2").alias("d2"))
            frontier = walked.join(best, ["start", "at"], "left").filter("d IS NULL OR d2 < d").select("start", "at", F.col("d2").alias("d")).checkpoint()
            if not frontier.take(1):
                break
            best = best.unionByName(frontier).groupBy("start", "at").agg(F.min("d").alias("d")).checkpoint()
        back = best.select(F.col("start").alias("v"), F.col("at").alias("u"), "d")
        round_ = inside.join(back, ["u", "v"], "left").filter("u = v OR d IS NOT NULL").select("u", "chain", (F.col("w") + F.when(F.col("u") == F.col("v"), 0).otherwise(F.col("d"))).alias("length"))
        out = out.unionByName(round_.select(F.col("u").alias("node"), "length")).unionByName(chains.join(round_, "chain").select("node", "length"))
        out = out.groupBy("node").agg(F.min("length").alias("length"))
    names = nodes.select(_numbered(F.col("node"), seed).alias("_n"), "node")
    out = out.withColumnRenamed("node", "_n").join(names, "_n").select("node", "length")
    return out.unionByName(loops).groupBy("node").agg(F.min("length").alias("length")) if loops.take(1) else out


def impact(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(start, affected, jobs, depth): how many nodes and jobs a change reaches, and how far."""
    reached = trace(edges, starts, "downstream", max_hops)
    jobs = edges.select(F.col("dst").alias("node"), "job").distinct()
    return reached.join(jobs, "node", "left").groupBy("start").agg(F.count_distinct("node").alias("affected"), F.count_distinct("job").alias("jobs"), F.max("hops").alias("depth"))


def critical_dependencies(reached: DataFrame) -> DataFrame:
    return reached.filter(F.col("node").rlike(CRITICAL))


def depth(edges: DataFrame) -> DataFrame:
    """(depth, cyclic), one row: the longest chain of edges, and whether some are in a cycle or behind one, which count for
    nothing. Sources go a layer at a time, so there are as many rounds as the chain is long."""
    checkpoint_folder(edges.sparkSession)
    e, layers = edges.select("src", "dst").distinct().checkpoint(), 0
    n = e.count()
    while n:
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").checkpoint()
        before, n = n, kept.count()
        if n == before:
            break
        e, layers = kept, layers + 1
    return edges.sparkSession.range(1).select(F.lit(layers).alias("depth"), F.lit(n > 0).alias("cyclic"))


def record_edges(events: DataFrame) -> DataFrame:
    """(src, dst, job) from lineage events with record_id, source_refs and run_id."""
    return events.select(F.explode("source_refs").alias("src"), F.col("record_id").alias("dst"), F.col("run_id").alias("job"))


def models_in_chain(events: DataFrame, records: DataFrame) -> DataFrame:
    return events.join(records.select("record_id"), "record_id", "left_semi").select(F.explode("model_refs").alias("model")).distinct()


def source_impact(events: DataFrame, source: str) -> DataFrame:
    """Records, datasets and models that come straight from a source, and the risk: over 5 models critical, over 1 high, over
    100 records medium."""
    hit = events.filter(F.array_contains("source_refs", source))
    models = F.size(F.array_distinct(F.flatten(F.collect_set("model_refs"))))
    out = hit.agg(F.count_distinct("record_id").alias("records"), F.count_distinct("dataset").alias("datasets"), models.alias("models"))
    return out.withColumn("risk", F.when(F.col("models") > 5, "critical").when(F.col("models") > 1, "high").when(F.col("records") > 100, "medium").otherwise("low"))


def root_causes(edges: DataFrame, records: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops) of the upstream nodes that have no source themselves."""
    up = trace(edges, records, "upstream", max_hops)
    return up.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def simulate_change(edges: DataFrame, starts: DataFrame, kind: str) -> DataFrame:
    """:func:`impact` with a risk: removal of a source is critical if it reaches anything, a schema change high over 10 nodes,
    else medium."""
    hit = impact(edges, starts)
    risk = F.lit("critical") if kind == "source_removal" else F.when(F.col("affected") > 10, "high").otherwise("medium")
    return hit.withColumns({"change": F.lit(kind), "risk": risk})


def stale_predictions(predictions: DataFrame, current: DataFrame) -> DataFrame:
    """Predictions of a model version that is not the current one (model_id, model_version)."""
    return predictions.join(current.select("model_id", F.col("model_version").alias("_now")), "model_id").filter(F.col("model_version") != F.col("_now")).withColumnRenamed("_now", "current_version")


def run_lineage(events: DataFrame, time: str, since: Column | None = None, until: Column | None = None, run: str | None = None) -> DataFrame:
    if run is not None:
        events = events.filter(F.col("run_id") == run)
    if since is not None:
        events = events.filter(F.col(time) >= since)
    return events if until is None else events.filter(F.col(time) < until)


def to_openlineage(runs: DataFrame) -> DataFrame:
    """OpenLineage run events (value) of (event_type, event_time, run_id, namespace, job, inputs, outputs)."""
    sets = lambda c: F.transform(c, lambda n: F.struct(F.col("namespace").alias("namespace"), n.alias("name")))
    return runs.select(F.to_json(F.struct(
        F.col("event_type").alias("eventType"), F.col("event_time").cast("string").alias("eventTime"), F.struct(F.col("run_id").alias("runId")).alias("run"),
        F.struct("namespace", F.col("job").alias("name")).alias("job"), sets("inputs").alias("inputs"), sets("outputs").alias("outputs"),
    )).alias("value"))


def from_openlineage(events: DataFrame, column: str = "value") -> DataFrame:
    shape = "eventType string, eventTime string, run struct<runId:string>, job struct<namespace:string,name:string>, inputs array<struct<namespace:string,name:string>>, outputs array<struct<namespace:string,name:string>>"
    e = events.select(F.from_json(column, shape).alias("e"))
    return e.select(F.col("e.eventType").alias("event_type"), F.col("e.eventTime").alias("event_time"), F.col("e.run.runId").alias("run_id"), F.col("e.job.namespace").alias("namespace"), F.col("e.job.name").alias("job"), F.col("e.inputs.name").alias("inputs"), F.col("e.outputs.name").alias("outputs"))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, column, change) between two schemas of (table, column, type, nullable)."""
    j = old.alias("o").join(new.alias("n"), ["table", "column"], "full")
    known = lambda df, name: df.select("table").distinct().withColumn(name, F.lit(True))
    j = j.join(known(old, "_o"), "table", "left").join(known(new, "_n"), "table", "left")
    change = (
        F.when(F.col("_n").isNull(), "drop_table").when(F.col("_o").isNull(), "add_table")
        .when(F.col("n.type").isNull(), "drop_column").when(F.col("o.type").isNull(), "add_column")
        .when(F.col("o.type") != F.col("n.type"), "change_type").when(F.col("o.nullable") & ~F.col("n.nullable"), "set_not_null").when(~F.col("o.nullable") & F.col("n.nullable"), "drop_not_null")
    )
    return j.select("table", "column", change.alias("change")).filter("change IS NOT NULL")


def flag_breaking(changes: DataFrame) -> DataFrame:
    return changes.withColumn("breaking", F.col("change").isin(*BREAKING))


def drift_severity(changes: DataFrame) -> DataFrame:
    """changes, breaking, severity per table: none low (under 5) medium; with breaking ones high (under 3) critical."""
    g = flag_breaking(changes).groupBy("table").agg(F.count(F.lit(1)).alias("changes"), F.count_if("breaking").alias("breaking"))
    b, n = F.col("breaking"), F.col("changes")
    return g.withColumn("severity", F.when(b >= 3, "critical").when(b > 0, "high").when(n >= 5, "medium").when(n > 0, "low").otherwise("none"))


def migration_risk(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """Breaking changes of columns with what reads them: high if anything does, else medium; other changes low."""
    reads = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("readers"))
    c = flag_breaking(changes).withColumn("node", F.concat_ws(".", "table", "column")).join(reads, "node", "left").withColumn("readers", F.coalesce("readers", F.lit(0)))
    return c.select("table", "column", "change", "readers", F.when(F.col("breaking") & (F.col("readers") > 0), "high").when(F.col("breaking"), "medium").otherwise("low").alias("risk"))


def coverage(rows: DataFrame, by: Sequence[str], traced: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(traced).alias("traced"), (F.count_if(traced) * 100.0 / F.count(F.lit(1))).alias("coverage"))


def reverse_lineage(edges: DataFrame, targets: DataFrame, fusions: DataFrame | None = None) -> DataFrame:
    """(start, node, hops[, fusions]): source fields of target columns, and how many fusions (node, entity) touch them."""
    up = root_causes(edges, targets)
    if fusions is None:
        return up
    n = fusions.groupBy("node").agg(F.count_distinct("entity").alias("fusions"))
    return up.join(n, "node", "left").withColumn("fusions", F.coalesce("fusions", F.lit(0)))
