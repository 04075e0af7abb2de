"""Repair of the structure of conversations: the cheapest edits that make their roles alternate.

Roles must read ``(s?(ua)+)?`` by their initials. Every row is kept (0), given another role
(2) or deleted (3); rows with the initial u or a and no text can be inserted anywhere (2); a
truncated row that stays adds 1, blank and repeated rows have to go. Of the cheapest edits the
ASCII-least string of their initials (D, I, K, R) counts, which also fixes the repaired rows.

Rows are dealt by a hash of their conversation and sorted there. A task reads them in batches of
whole conversations, each of which is repaired by one recursive query of DuckDB: a step
takes the next turn of all conversations of the batch at once and keeps, for each conversation
and grammar state, the least cost and audit (``USING KEY``, so a step replaces the one before).

Long conversations (more than ``LONG`` rows or ``LONG_BYTES`` of text) are not held by one
task's memory. Their rows are range-partitioned by position and cut into pieces of ``PIECE`` rows.
The same recursion, begun in each grammar state, gives a piece's least cost and audit from state to state; pieces are then
joined, ``FAN`` at a time and level by level, by a recursion over pieces. Their repaired text is hashed as
a stream, by one task a conversation, since SHA-256 can't be split; that task holds a batch at a time.

Why least prefixes suffice: two edit strings of equal cost that use the same rows are never prefixes of each other (a rest would be
insertions, which cost), so the least string for a state stays least whatever follows.

Defined cases: a null role, text, turn or conv_id is read as one space (the null conv_id forms one conversation and
is returned as null); rows of one turn go by role and text; repeated rows are duplicates; a role with another initial must be deleted
or replaced; a conversation without rows gives zeros, an empty audit and the hash of the empty
string; an empty table gives an empty result; very long texts are hashed whole; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small

#: A conversation beyond either bound is worked on in pieces.
LONG, LONG_BYTES = 2048, 8 << 20
PIECE = 256
FAN = 64  # pieces joined at once
#: Rows and bytes of text of a batch, at most but for its last conversation.
BATCH, BATCH_BYTES = 16_384, 16 << 20

# fixed values: the grammar's states after nothing, s, u, a; where a role's initial leads
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, ACCEPTED = (0, 1, 2, 3), (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _inserted() -> dict[tuple[int, int], tuple[int, str]]:
    """From state to state by insertions alone: the least cost and their initials."""
    out = {(s, s): (0, "") for s in STATES}
    for _ in STATES:
        for (s, t), (cost, audit) in list(out.items()):
            for initial in "ua":
                to = NEXT.get((t, initial))
                if to is not None:
                    out[s, to] = min(out.get((s, to), (99, "")), (cost + INSERT, audit + "I"))
    return out


def moves() -> list[tuple[str, int, int, int, str]]:
    """(kind, from, to, cost, audit) of the best insertions and edit for a row; its kind is the role's initial (x for others), or that with ! (truncated), or - (has to go)."""
    best: dict[tuple[str, int, int], tuple[int, str]] = {}

    def take(kind: str, s: int, to: int | None, cost: int, audit: str) -> None:
        if to is not None:
            best[kind, s, to] = min(best.get((kind, s, to), (99, "")), (cost, audit))

    for (s, t), (cost, audit) in _inserted().items():
        take("-", s, t, cost + DELETE, audit + "D")
        for initial, open_ in itertools.product("suax", ("", "!")):
            kind, more = initial + open_, TRUNCATED * bool(open_)
            take(kind, s, t, cost + DELETE, audit + "D")
            take(kind, s, NEXT.get((t, initial)), cost + KEEP + more, audit + "K")
            for role in "ua":
                take(kind, s, NEXT.get((t, role)), cost + REROLE + more, audit + "R")
    return [(*k, *v) for k, v in sorted(best.items())]


#: (unit, state0, state, cost, audit): from each state in ``starts`` to each state after a unit's rows, before closing insertions.
_STEPS = """
WITH RECURSIVE step(unit, i, state0, state, cost, audit) USING KEY (unit, state0, state) AS (
  SELECT u.unit, 0, s.state, s.state, 0, '' FROM (SELECT DISTINCT unit FROM kinds) u, starts s
  UNION ALL
  SELECT unit, i, state0, state, best.cost, best.audit FROM (
    SELECT p.unit, p.i + 1 AS i, p.state0, m.target AS state, min({'cost': p.cost + m.cost, 'audit': p.audit || m.audit}) AS best
    FROM step p JOIN kinds k ON k.unit = p.unit AND k.i = p.i + 1 JOIN moves m ON m.kind = k.kind AND m.source = p.state
    GROUP BY p.unit, p.i, p.state0, m.target)
) SELECT unit, state0, state, cost, audit FROM step"""

#: The same over pieces that follow each other; ``path`` has the state after each piece.
_JOINED = """
WITH RECURSIVE step(unit, i, state0, state, cost, audit, path) USING KEY (unit, state0, state) AS (
  SELECT unit, i, state0, state, cost, audit, path FROM pieces WHERE i = 1
  UNION ALL
  SELECT unit, i, state0, state, best.cost, best.audit, best.path FROM (
    SELECT p.unit, k.i, p.state0, k.state, min({'cost': p.cost + k.cost, 'audit': p.audit || k.audit, 'path': p.path || k.path}) AS best
    FROM step p JOIN pieces k ON k.unit = p.unit AND k.i = p.i + 1 AND k.state0 = p.state
    GROUP BY p.unit, k.i, p.state0, k.state)
) SELECT unit, state0, state, cost, audit, path FROM step"""


class Grammar:
    """A DuckDB connection of one thread with the tables of moves, for one task."""

    def __init__(self) -> None:
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        self.db.execute("SET preserve_insertion_order = false")
        self._table("moves", ["kind", "source", "target", "cost", "audit"], moves())
        self._table("closing", ["state", "target", "cost", "audit"], [(s, t, *v) for (s, t), v in _inserted().items() if t in ACCEPTED])
        self._table("every_state", ["state"], [(s,) for s in STATES])
        self._table("first_state", ["state"], [(0,)])

    def _table(self, name: str, columns: list[str], rows: list[tuple]) -> None:
        held = pa.table({c: list(v) for c, v in zip(columns, zip(*rows, strict=True), strict=True)})  # noqa: F841  DuckDB reads it by name
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM held")

    def steps(self, kinds: pa.Table, starts: str) -> str:
        """The query of the least costs and audits of units (unit, i, kind), i from 1."""
        self.db.register("kinds", kinds)
        return _STEPS.replace("starts s", f"{starts} s")

    def joined(self, pieces: pa.Table) -> pa.Table:
        self.db.register("pieces", pieces)
        return self.db.sql(_JOINED).to_arrow_table()

    def repaired(self, rows: pa.Table) -> pa.Table:
        """Results of whole conversations of rows (unit, i, turn, role, text, blank, open)."""
        self.db.register("given", rows)
        self.db.execute(
            """CREATE OR REPLACE TEMP TABLE faults AS SELECT *, CASE WHEN blank THEN 'blank' WHEN again THEN 'duplicate' WHEN open THEN 'truncated' END AS fault FROM (
            SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY unit, role, text ORDER BY i) > 1 AS again FROM given)"""
        )
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE kinds_ AS SELECT unit, i, {_kind_sql('initial', 'fault')} AS kind FROM faults")
        steps = _STEPS.replace("FROM kinds)", "FROM kinds_)").replace("JOIN kinds k", "JOIN kinds_ k").replace("starts s", "first_state s")
        self.db.execute(
            f"""CREATE OR REPLACE TEMP TABLE found AS SELECT unit, best.cost, best.audit FROM (
            SELECT unit, min({{'cost': t.cost + c.cost, 'audit': t.audit || c.audit}}) AS best FROM ({steps}) t JOIN closing c ON c.state = t.state GROUP BY unit)"""
        )
        return self.db.sql(_SUMMARY).to_arrow_table()


def _kind_sql(initial: str, fault: str) -> str:
    return f"CASE WHEN {fault} IN ('blank', 'duplicate') THEN '-' ELSE CASE WHEN {initial} IN ('s', 'u', 'a') THEN {initial} ELSE 'x' END || CASE WHEN {fault} = 'truncated' THEN '!' ELSE '' END END"


# roles of replaced and inserted rows follow from the number of rows that stay: an odd one begins with s, then u and a alternate
_SUMMARY = """
WITH pairs AS (
  SELECT unit, turn, fault, initial, lag(initial) OVER (PARTITION BY unit ORDER BY i) AS before FROM faults
), counts AS (
  SELECT unit, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY unit
), letters AS (
  SELECT unit, unnest(range(1, len(audit) + 1)) AS p, unnest(string_split(audit, '')) AS e FROM found
), placed AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS place, count(*) FILTER (e <> 'D') OVER (PARTITION BY unit) AS n FROM letters WINDOW w AS (PARTITION BY unit ORDER BY p)
), texts AS (
  SELECT l.unit, string_agg(CASE WHEN e = 'K' THEN r.role WHEN (place - n) % 2 <> 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p) AS whole
  FROM placed l LEFT JOIN faults r ON r.unit = l.unit AND r.i = l.i WHERE e <> 'D' GROUP BY l.unit
)
SELECT f.unit, gaps, blank, duplicate, truncated, illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM found f JOIN counts USING (unit) LEFT JOIN texts USING (unit)"""


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): the rows of ``conversations`` with faults dealt by crc32 of their place; copy is 1 for a repeated one."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(place) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), space) for c in ("text", "role"))
    held = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    new_text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return held.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), F.explode(copies).alias("copy"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]


def _marks(text: str) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it is truncated if it isn't."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return last == "", ~last.isin(".", "!", "?")


def repair(rows: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, copy).

    One row for each conv_id of ``whole``, or of the rows themselves.
    """
    bytes_ = F.octet_length("text") + F.octet_length("role")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(bytes_).alias("size"))
    long = cut(sizes.where((F.col("n") > LONG) | (F.col("size") > LONG_BYTES)).select(F.col("conv_id").alias("__long")))
    long = cut(long.withColumn("unit", F.monotonically_increasing_id()))
    blank, open_ = _marks("text")
    rows = rows.withColumns({"blank": blank, "open": open_})
    is_long = F.col("conv_id").eqNullSafe(F.col("__long"))
    some = not long.isEmpty()
    out = _short(rows.join(small(long), is_long, "left_anti") if some else rows)
    if some:
        units = _long(rows.join(small(long), is_long).drop("__long", "conv_id"))
        out = out.unionByName(units.join(long, "unit").withColumnRenamed("__long", "conv_id").drop("unit"))
    if whole is None:
        return out
    every = whole.select(F.col("conv_id").alias("__id")).distinct()
    empty = {c: F.lit(0).cast("long") for c in (*_COUNTS, "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    joined = every.join(out, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("__id").alias("conv_id"), *[F.coalesce(c, v).alias(c) for c, v in empty.items()])


def _batches(stream: Iterator[pa.RecordBatch], key: str, names: list[str]) -> Iterator[pa.Table]:
    """The sorted stream as tables of whole groups of ``key``, with their ``unit``."""
    held: list[pa.RecordBatch] = []

    def of(batches: list[pa.RecordBatch]) -> tuple[pa.Table, list[int]]:
        """The batches as a table, and where its groups begin."""
        table = pa.Table.from_batches(batches).combine_chunks()
        keys = table.column(key).to_pylist()
        return table, [k for k, x in enumerate(keys) if not k or x != keys[k - 1]]

    def given(table: pa.Table, starts: list[int]) -> pa.Table:
        ends = [*starts[1:], table.num_rows]
        unit = [u for u, (a, b) in enumerate(zip(starts, ends, strict=True)) for _ in range(b - a)]
        i = [k + 1 for a, b in zip(starts, ends, strict=True) for k in range(b - a)]
        return table.select(names).append_column("unit", pa.array(unit, pa.int64())).append_column("i", pa.array(i, pa.int64()))

    for batch in stream:
        # parts of a large batch, so that long texts meet in bounded numbers
        step = max(1, min(BATCH, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            held.append(batch.slice(k, step))
            if sum(b.num_rows for b in held) >= BATCH or sum(b.num_rows * b.nbytes // max(1, b.num_rows) for b in held) >= BATCH_BYTES:
                table, starts = of(held)
                if len(starts) > 1:
                    yield given(table.slice(0, starts[-1]), starts[:-1])
                    held = table.slice(starts[-1]).to_batches()
                else:
                    held = table.to_batches()
    if held and sum(b.num_rows for b in held):
        yield given(*of(held))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that a task holds whole."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = None
        for table in _batches(stream, "conv_id", ["conv_id", "turn", "role", "text", "blank", "open"]):
            grammar = grammar or Grammar()
            got = grammar.repaired(table.drop(["conv_id"]))
            ids = table.filter(pa.compute.equal(table["i"], 1)).select(["unit", "conv_id"]).column("conv_id").take(got.column("unit").cast(pa.int64()))
            got = got.drop(["unit"]).add_column(0, "conv_id", ids)
            yield from got.to_batches()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    return dealt.select("conv_id", "turn", "role", "text", "blank", "open").mapInArrow(run, f"conv_id {kind}, {_RESULT}")


def _long(rows: DataFrame) -> DataFrame:
    """(unit, results) of conversations (unit, turn, role, text, copy, blank, open) in pieces, whatever their length."""
    rows = cut(rows)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows can be dealt out too: they differ by where they were read
    order = [F.col("unit"), *_order(), F.col("at")]
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    dealt = cut(dealt.withColumns({"pos": F.monotonically_increasing_id(), "key": key}).drop("at"))
    seen = dealt.where("NOT blank").groupBy("unit", "key").agg(F.min("pos").alias("first"))
    narrow = dealt.select("unit", "turn", "pos", F.substring("role", 1, 1).alias("initial"), "blank", "open", "key")
    again = narrow.where("NOT blank").join(seen, ["unit", "key"]).withColumn("again", F.col("pos") > F.col("first")).drop("first")
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("open"), "truncated")
    both = again.unionByName(narrow.where("blank").withColumn("again", F.lit(False)))
    piece = F.shiftright("pos", PIECE.bit_length() - 1).alias("piece")
    marked = cut(both.select("unit", "turn", "pos", piece, "initial", fault.alias("fault")))

    counts = marked.groupBy("unit").agg(*[F.count_if(F.col("fault") == c).alias(c) for c in ("blank", "duplicate", "truncated")], F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    turns = marked.where("turn IS NOT NULL").select("unit", "turn").distinct().groupBy("unit").agg(F.count("*").alias("k"))
    held = F.array_sort(F.collect_list(F.struct("pos", "initial", F.expr(_kind_sql("initial", "fault")).alias("kind"))))  # at most PIECE
    pieces = marked.groupBy("unit", "piece").agg(held.alias("rows")).select("unit", "piece", F.col("rows")[0]["pos"].alias("first"), F.col("rows.kind").alias("kinds"), F.col("rows.initial").alias("initials"))
    # of a conversation's pieces only the ends meet in one place: a row for each piece
    by_piece = Window.partitionBy("unit").orderBy("piece")
    before = F.lag(F.element_at("initials", -1)).over(by_piece)
    chain = F.when(before.isNull(), F.col("initials")).otherwise(F.concat(F.array(before), "initials"))
    pieces = cut(cut(pieces).select("unit", F.row_number().over(by_piece).cast("long").alias("i"), "first", "kinds", chain.alias("chain")))
    steps = F.zip_with(F.slice("chain", 1, F.size("chain") - 1), F.slice("chain", 2, F.size("chain")), lambda a, b: F.concat(a, b))
    illegal = pieces.groupBy("unit").agg(F.sum(F.size(F.filter(steps, lambda x: x.isNotNull() & ~x.isin("su", "ua", "au")))).cast("long").alias("illegal"))

    costs = cut(pieces.select("unit", "i", "kinds").repartition("unit", "i").mapInArrow(_piece_costs, _COSTS))
    level, n = costs, costs.agg(F.max("i")).first()[0]
    while n > 1:
        group = F.floor((F.col("i") - 1) / FAN).alias("g")
        level = cut(level.withColumn("g", group).groupBy("unit", "g").applyInArrow(_join_pieces, _COSTS))
        n = -(-n // FAN)
    ends = {s: min(v for (a, t), v in _inserted().items() if a == s and t in ACCEPTED) for s in STATES}
    more, rest = (F.element_at(F.array(*[F.lit(ends[s][k]) for s in STATES]), F.col("state") + 1) for k in (0, 1))
    best = F.min(F.struct((F.col("cost") + more).alias("cost"), F.concat("audit", rest).alias("audit"), "path", rest.alias("rest")))
    best = cut(level.where("state0 = 0").groupBy("unit").agg(best.alias("best")).select("unit", "best.*"))

    # the edits of a piece are those between the states before and after it
    chosen = best.select("unit", F.posexplode(F.split("path", "")).alias("k", "state"), "path").where("state <> ''")
    start = F.when(F.col("k") == 0, 0).otherwise(F.expr("substring(path, k, 1)").cast("int"))
    chosen = chosen.select("unit", (F.col("k") + 1).cast("long").alias("i"), start.alias("state0"), F.col("state").cast("int").alias("state"))
    edits = chosen.join(costs, ["unit", "i", "state0", "state"]).join(pieces.select("unit", "i", "first"), ["unit", "i"])
    edits = edits.select("unit", "first", F.posexplode(F.regexp_extract_all("audit", F.lit("(I*[KRD])"), 1)).alias("k", "edit")).select("unit", (F.col("first") + F.col("k")).alias("pos"), "edit")
    stay = F.length(F.translate("audit", "D", "")).alias("stay")
    texts = dealt.select("unit", "pos", "role", "text").join(edits, ["unit", "pos"]).join(best.select("unit", stay, "rest"), "unit")
    hashed = texts.repartition("unit").sortWithinPartitions("unit", "pos").select("unit", "role", "text", "edit", "stay", "rest").mapInArrow(_hash_stream, "unit long, repaired_sha256 string")
    out = best.select("unit", "cost", "audit")
    for facts in (counts, turns, illegal, hashed):
        out = out.join(facts, "unit", "left")
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("k"), F.lit(0))
    return out.select("unit", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


_COSTS = "unit long, i long, state0 int, state int, cost long, audit string, path string"
_COSTS_ARROW = pa.schema([("unit", pa.int64()), ("i", pa.int64()), ("state0", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())])


def _piece_costs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least costs and audits of pieces (unit, i, kinds), from each state to each."""
    grammar = None
    for batch in stream:
        grammar = grammar or Grammar()
        for a in range(0, batch.num_rows, FAN):
            part = batch.slice(a, FAN)
            lists = part.column(2).to_pylist()
            rows = [(n, k + 1, kind) for n, kinds in enumerate(lists) for k, kind in enumerate(kinds)]
            table = pa.table(dict(zip(("unit", "i", "kind"), map(list, zip(*rows, strict=True)), strict=True)))
            got = grammar.db.sql(grammar.steps(table, "every_state")).to_arrow_table()
            at = got.column("unit").combine_chunks()
            columns = [part.column(0).take(at), part.column(1).take(at), got["state0"], got["state"], got["cost"], got["audit"], pa.compute.cast(got["state"], pa.string())]
            yield from pa.table(columns, names=_COSTS_ARROW.names).cast(_COSTS_ARROW).to_batches()


def _join_pieces(table: pa.Table) -> pa.Table:
    """Up to FAN pieces of one conversation that follow each other, as one."""
    g = table["g"][0].as_py()
    numbered_ = table.set_column(table.column_names.index("i"), "i", pa.compute.subtract(table["i"], g * FAN)).select(_COSTS_ARROW.names)
    got = Grammar().joined(numbered_)
    return got.append_column("i", pa.array([g + 1] * got.num_rows, pa.int64())).select(_COSTS_ARROW.names).cast(_COSTS_ARROW)


def _hash_stream(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, hash) of repaired rows, from rows (unit, role, text, edit, stay, rest) in order."""
    unit, place, stay, rest, whole = None, 0, 0, "", hashlib.sha256()

    def put(role: str | None, text: str) -> None:
        nonlocal place
        place += 1
        role = role if role is not None else "assistant" if (place - stay) % 2 == 0 else "user"
        whole.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))

    def ended() -> pa.RecordBatch:
        for _ in rest:
            put(None, "")
        return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([whole.hexdigest()], pa.string())], ["unit", "repaired_sha256"])

    for batch in stream:
        for now, role, text, edit, n, closing in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != unit:
                if unit is not None:
                    yield ended()
                unit, place, stay, rest, whole = now, 0, n, closing, hashlib.sha256()
            for letter in edit:
                if letter == "I":
                    put(None, "")
                elif letter != "D":
                    put(role if letter == "K" else None, text)
    if unit is not None:
        yield ended()


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(rows), rows)


# rows, grammar and edits as above, one edit at a time; crc32 by its table, bytes of a place are digits, "-", ":" and " "
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS fault
  FROM conversations, crc
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM given, (VALUES (0), (1)) c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial FROM rows_
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id
), next AS (SELECT * FROM (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')) n(source, initial, target)
), pads AS (SELECT * FROM (VALUES ('', '', 0, ''), ('', 'u', 2, 'I'), ('', 'a', 4, 'II'), ('s', 's', 0, ''), ('s', 'u', 2, 'I'), ('s', 'a', 4, 'II'), ('u', 'u', 0, ''), ('u', 'a', 2, 'I'), ('a', 'a', 0, ''), ('a', 'u', 2, 'I')) p(source, target, cost, audit)
), step AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS state, 0 AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit FROM (
    SELECT s.conv_id, f.i, e.target AS state, min({'cost': s.cost + p.cost + e.cost + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN 1 ELSE 0 END, 'audit': s.audit || p.audit || e.edit}) AS best
    FROM step s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN pads p ON p.source = s.state
    JOIN (SELECT source, initial, target, 0 AS cost, 'K' AS edit FROM next UNION ALL SELECT source, NULL, target, 2, 'R' FROM next WHERE initial <> 's'
      UNION ALL SELECT DISTINCT source, NULL, source, 3, 'D' FROM (SELECT source FROM next UNION ALL SELECT target FROM next)) e
      ON e.source = p.target AND (e.edit = 'D' OR f.fault IS NULL OR f.fault = 'truncated') AND (e.initial IS NULL OR e.initial = f.initial)
    GROUP BY s.conv_id, f.i, e.target)
), found AS (
  SELECT conv_id, best.cost, best.audit FROM (
    SELECT s.conv_id, min({'cost': s.cost + p.cost, 'audit': s.audit || p.audit}) AS best FROM step s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i JOIN pads p ON p.source = s.state WHERE p.target IN ('', 'a') GROUP BY s.conv_id)
), letters AS (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS p, unnest(string_split(audit, '')) AS e FROM found
), laid AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS place, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id) AS n FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), texts AS (
  SELECT l.conv_id, string_agg(CASE WHEN e = 'K' THEN r.role WHEN (n - place) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p) AS whole
  FROM laid l LEFT JOIN faults r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE e <> 'D' GROUP BY l.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
