"""Operator 12: repair of conversations by a run-length dynamic program.

A row is a symbol: its role's class and its fault. A symbol's transition is a min-plus matrix over the four states of the
wanted form ``(s?(ua)+)?``. A long conversation is cut into segments; in each, equal consecutive symbols are one run, which
the cached binary powers of its transition cross in a few products. The segments' matrices give the costs ahead of each
segment; then all segments unroll their cheapest edits at once, one audit for each state they may be entered in, and the
chain of segments picks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, stash, table

WHITE = " \t\n\x0b\f\r"
#: Costs of edits by their initials; an undeleted truncated row adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after a system row, after a user row, after an assistant row. STEP[state][role class] or -1.
USER, ASSISTANT, OTHER = 1, 2, 3
STEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
FAR = 1 << 60
#: What it costs to end in a state: the form may end when it is empty or after an assistant row.
FINISH = (0, 2 * INSERT, INSERT, 0)
CLASSES = ("s", "u", "a")
#: Faults of a symbol: none, truncated, or to be deleted (blank or duplicate). A symbol is 3 * class + fault.
FINE, CUT, GONE = 0, 1, 2
#: Rows of a segment; few enough for one task to hold their symbols.
SEGMENT = 8192
Matrix = tuple[tuple[int, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


IDENTITY: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


@cache
def inserting() -> Matrix:
    """The cheapest insertions from state to state; after two of them nothing new is reached."""
    one = [list(r) for r in IDENTITY]
    for s in range(4):
        for role in (USER, ASSISTANT):
            if STEP[s][role] >= 0:
                one[s][STEP[s][role]] = min(one[s][STEP[s][role]], INSERT)
    once = tuple(map(tuple, one))
    return product(product(once, once), once)


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row, (initial, cost, next state), by initial."""
    role, fault = divmod(symbol, 3)
    out = [("D", DELETE, state)]
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        if STEP[state][role] >= 0:
            out.append(("K", KEEP + more, STEP[state][role]))
        out += [("R", REROLE + more, STEP[state][r]) for r in (USER, ASSISTANT) if STEP[state][r] >= 0]
    return out


@cache
def transition(symbol: int) -> Matrix:
    """Of one row: insertions before it, then the row."""
    row = [[FAR] * 4 for _ in range(4)]
    for s in range(4):
        for _, cost, to in choices(symbol, s):
            row[s][to] = min(row[s][to], cost)
    return product(inserting(), tuple(map(tuple, row)))


@cache
def power(symbol: int, k: int) -> Matrix:
    """The transition of 2**k equal rows."""
    return product(power(symbol, k - 1), power(symbol, k - 1)) if k else transition(symbol)


def crossing(symbols: list[int], counts: list[int]) -> Matrix:
    """The transition of a segment: a product for each binary digit of each run's length."""
    m = IDENTITY
    for symbol, run in groupby(zip(symbols, counts), key=lambda r: r[0]):
        n, k = sum(c for _, c in run), 0
        while n:
            if n & 1:
                m = product(m, power(symbol, k))
            n, k = n >> 1, k + 1
    return m


@cache
def before(symbol: int, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The costs ahead of a row from those after it, each less its least, and the difference of the leasts."""
    got = [min(c + a for c, a in zip(row, ahead)) for row in transition(symbol)]
    return tuple(g - min(got) for g in got), min(got)


@cache
def edit(symbol: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The cheapest edits at a row, insertions before it included, and the next state: the ASCII-least of equals. No two edits
    of one initial lead from a state to different ones, so the least initial at each step makes the least audit."""
    now, base = before(symbol, after)
    least = lambda s: min([c + after[to] - base for _, c, to in choices(symbol, s)])
    out = ""
    while True:
        insert = next((STEP[state][r] for r in (USER, ASSISTANT) if STEP[state][r] >= 0 and INSERT + now[STEP[state][r]] == now[state]), None)
        for name, cost, to in choices(symbol, state) if least(state) == now[state] else []:
            if cost + after[to] - base == now[state] and (insert is None or name < "I"):
                return out + name, to
        out, state = out + "I", insert


def finishing(state: int) -> str:
    return "I" * (FINISH[state] // INSERT)


def unroll(symbols: list[int], counts: list[int], ahead: tuple[int, ...], last: bool) -> tuple[list[str], list[int]]:
    """The audits of a segment and the states it leaves, one for each state it is entered in. Costs ahead are kept a row;
    inside a run they soon repeat."""
    rows = [s for s, n in zip(symbols, counts) for _ in range(n)]
    least = min(ahead)
    costs = [tuple(min(a - least, FAR) for a in ahead)]
    for symbol in reversed(rows):
        costs.append(before(symbol, costs[-1])[0])
    costs.reverse()
    audits, exits = [], []
    for state in range(4):
        out = []
        for i, symbol in enumerate(rows):
            text, state = edit(symbol, costs[i + 1], state)
            out.append(text)
        audits.append("".join(out) + (finishing(state) if last else ""))
        exits.append(state)
    return audits, exits


def numbered(rows: DataFrame) -> DataFrame:
    """The distinct (conv, turn, role, digest) of ``rows`` in order: with n (rows), symbol, blank, cut, first (whether role and
    text are new in the conversation) and pos, which grows with the order. A hot conversation is dealt over many partitions."""
    key = ["conv", "turn", "role", "digest"]
    turn = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = rows.groupBy("conv", "role", "digest").agg(F.min(turn).alias("t"))
    marks = rows.select(*key, "blank", "cut", F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("first"))
    marks = marks.unionByName(first.select("conv", F.col("t.turn").alias("turn"), "role", "digest", F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("first")))
    one = marks.groupBy(*key).agg(F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.sum("n").alias("n"), F.max("first").alias("first"))
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    initial = F.left("role", F.lit(1))
    kind = F.coalesce(*[F.when(initial == c, F.lit(i)) for i, c in enumerate(CLASSES)], F.lit(OTHER))
    fault = F.when(F.col("blank") | ~F.col("first"), GONE).when(F.col("cut"), CUT).otherwise(FINE)
    return one.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumns({"symbol": 3 * kind + fault, "pos": F.monotonically_increasing_id()})


def segments(ordered: DataFrame) -> DataFrame:
    """(conv, seg, head, symbols, counts, and sums): the rows of a conversation in pieces of at most SEGMENT. ``head`` is the
    first row's place. Of equal rows the second and later ones are duplicates: a run of their own."""
    steps = F.array_sort(F.collect_list(F.struct("pos", "symbol", "n")))
    later = F.col("n") - F.when(F.col("first"), 1).otherwise(0)
    g = ordered.groupBy("conv", F.expr(f"pos div {SEGMENT}").alias("seg")).agg(
        F.min(F.struct("pos", "turn", "role", "digest")).alias("head"), steps.alias("steps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), later).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & F.col("first") & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    )
    again = lambda s: s["symbol"] - s["symbol"] % 3 + GONE
    pairs = F.flatten(F.transform("steps", lambda s: F.when(s["n"] > 1, F.array(F.struct(s["symbol"].alias("symbol"), F.lit(1).cast("bigint").alias("n")), F.struct(again(s).alias("symbol"), (s["n"] - 1).alias("n")))).otherwise(F.array(F.struct(s["symbol"].alias("symbol"), s["n"].alias("n"))))))
    return g.select("conv", "seg", "head", pairs.alias("runs"), "blank", "duplicate", "truncated")


LEGAL = {(0, 1), (1, 2), (2, 1)}


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each segment's matrix (16 numbers), its illegal neighbours, first and last class."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for runs in batch.column("runs").to_pylist():
            symbols, counts = [r["symbol"] for r in runs], [r["n"] for r in runs]
            kinds = [s // 3 for s in symbols]
            illegal = sum(n - 1 for n in counts) + sum((a, b) not in LEGAL for a, b in zip(kinds, kinds[1:]))
            for x, v in zip(out, ([x for row in crossing(symbols, counts) for x in row], illegal, kinds[0], kinds[-1])):
                x.append(v)
        more = [pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "matrix", "within", "from_kind", "to_kind"])


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's chain of segments: its cost, illegal neighbours, and the costs ahead of each segment's end."""
    for batch in batches:
        cost, illegal, ends = [], [], []
        for chain in batch.column("chain").to_pylist():
            v, got = FINISH, []
            for part in reversed(chain):
                got.append({"seg": part["seg"], "ahead": list(v), "last": not got})
                m = part["matrix"]
                v = tuple(min(m[4 * i + j] + v[j] for j in range(4)) for i in range(4))
            cost.append(v[0])
            illegal.append(sum(p["within"] for p in chain) + sum((p["to_kind"], q["from_kind"]) not in LEGAL for p, q in zip(chain, chain[1:])))
            ends.append(got)
        end = pa.list_(pa.struct([("seg", pa.int64()), ("ahead", pa.list_(pa.int64())), ("last", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()), pa.array(ends, end)], ["conv", "cost", "illegal", "ends"])


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [unroll([r["symbol"] for r in runs], [r["n"] for r in runs], tuple(ahead), last) for runs, ahead, last in zip(*(batch.column(c).to_pylist() for c in ("runs", "ahead", "last")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("seg"), batch.column("head"), pa.array([a for a, _ in both], pa.list_(pa.string())), pa.array([e for _, e in both], pa.list_(pa.int32()))],
            ["conv", "seg", "head", "audits", "exits"],
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each segment of a chain is entered in, from the states that it leaves."""
    for batch in batches:
        out = []
        for chain in batch.column("chain").to_pylist():
            state, got = 0, []
            for part in chain:
                got.append({"seg": part["seg"], "state": state})
                state = part["exits"][state]
            out.append(got)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(out, pa.list_(pa.struct([("seg", pa.int64()), ("state", pa.int32())])))], ["conv", "entered"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations come in order, each segment's audit before its rows: one row at a time is edited and hashed."""
    conv, digest, audit, at, state, some = None, None, "", 0, 0, False

    def put(line: str) -> None:
        nonlocal some
        digest.update(("\n" if some else "").encode() + line.encode("utf-8", "surrogatepass"))
        some = True

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = USER if STEP[state][USER] >= 0 else ASSISTANT
            put("user:" if role == USER else "assistant:")
            at, state = at + 1, STEP[state][role]

    for batch in batches:
        done: tuple[list, list] = ([], [])
        for c, is_row, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "is_row", "role", "text"))):
            if digest is None or c != conv:
                if digest is not None:
                    inserts()
                    done[0].append(conv)
                    done[1].append(digest.hexdigest())
                conv, digest, audit, at, state, some = c, hashlib.sha256(), "", 0, 0, False
            if not is_row:
                inserts()
                audit, at = text, 0
                continue
            inserts()
            what, at = audit[at], at + 1
            if what == "K":
                put(f"{role}:{text}")
                state = STEP[state][CLASSES.index(role[0])]
            elif what == "R":
                user = STEP[state][USER] >= 0
                put(("user:" if user else "assistant:") + text)
                state = STEP[state][USER if user else ASSISTANT]
        yield pa.RecordBatch.from_arrays([pa.array(done[0], batch.schema.field("conv").type), pa.array(done[1], pa.string())], ["conv", "repaired_sha256"])
    if digest is not None:
        inserts()
        yield pa.RecordBatch.from_arrays([pa.array([conv], batch.schema.field("conv").type), pa.array([digest.hexdigest()], pa.string())], ["conv", "repaired_sha256"])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of ``rows``: ``conv_col``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the text's SHA-256. A null conversation is one
    of its own; a null role or text counts as one space. Rows that repeat are duplicates; other columns are ignored; an
    empty table gives an empty result. A conversation's texts are hashed in one task, a row at a time, as its SHA-256 is; all
    else of a long conversation is dealt over segments. An audit must fit in one value."""
    text = F.coalesce(F.col(text_col), F.lit(" "))
    trimmed = F.rtrim(text, F.lit(WHITE))
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    slim = stash(base.select("conv", "turn", "role", "digest", "blank", "cut"), "rows")
    segs = segments(stash(numbered(slim), "numbered"))
    shape = segs.schema
    conv_type, seg_ddl = shape["conv"].dataType.simpleString(), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape)
    crossed = stash(segs.mapInArrow(_crossings, f"{seg_ddl}, matrix array<bigint>, within bigint, from_kind int, to_kind int"), "segments")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    chain = crossed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seg", "matrix", "within", "from_kind", "to_kind"))).alias("chain"))
    costs = stash(chain.mapInArrow(_ahead, f"conv {conv_type}, cost bigint, illegal bigint, ends array<struct<seg:bigint,ahead:array<bigint>,last:boolean>>"), "costs")
    ends = costs.select(F.col("conv").alias("c"), F.explode("ends").alias("e")).select("c", "e.*")
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.c")) & (F.col(f"{a}.seg") == F.col(f"{b}.seg"))
    joined = crossed.select("conv", "seg", "head", "runs").alias("s").join(ends.alias("e"), same("s", "e")).select("s.*", "ahead", "last")
    head = shape["head"].dataType.simpleString()
    rolled = stash(joined.mapInArrow(_unrolled, f"conv {conv_type}, seg bigint, head {head}, audits array<string>, exits array<int>"), "audits")
    chain = rolled.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seg", "exits"))).alias("chain"))
    entered = chain.mapInArrow(_entries, f"conv {conv_type}, entered array<struct<seg:bigint,state:int>>").select(F.col("conv").alias("c"), F.explode("entered").alias("e")).select("c", "e.*")
    chosen = stash(rolled.alias("s").join(entered.alias("e"), same("s", "e")).select("conv", "s.seg", "head", F.get("audits", F.col("state")).alias("audit")), "chosen")

    marks = chosen.select("conv", F.lit(0).alias("is_row"), F.col("head.turn").alias("turn"), F.col("head.role").alias("role"), F.col("head.digest").alias("digest"), F.col("audit").alias("text"))
    stream = base.select("conv", F.lit(1).alias("is_row"), "turn", "role", "digest", "text").unionByName(marks)
    stream = stream.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("turn").asc_nulls_first(), "role", "digest", "is_row").select("conv", "is_row", "role", "text")
    hashes = stream.mapInArrow(_digests, f"conv {conv_type}, repaired_sha256 string")
    audits = chosen.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    turns = slim.groupBy("conv", "turn").agg(F.lit(1).alias("x")).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    counts = crossed.groupBy("conv").agg(*sums)
    out = counts.withColumnRenamed("conv", "c0")
    for i, df in enumerate((turns, costs.drop("ends"), audits, hashes)):
        out = out.join(df.withColumnRenamed("conv", f"c{i + 1}"), F.col("c0").eqNullSafe(F.col(f"c{i + 1}"))).drop(f"c{i + 1}")
    return out.select(F.col("c0").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: conv_id, turn, role, text of the rows that are left."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text = F.crc32(name.cast("binary")) % 20, F.coalesce("text", F.lit(" "))
    hurt = conversations.select(
        "conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).filter("kind <> 0")
    return hurt.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`repair` of the damaged rows of ``conversations``, and zeros, an empty audit and the hash of nothing for
    conversations without any: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = table(spark, sf_dir, "conversations")
    fixed = repair(damaged(rows)).withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
