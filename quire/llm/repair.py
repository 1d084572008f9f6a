"""Repair of the structure of conversations by least-cost edits, with precomputed block tables (Four Russians).

A conversation is a string over nine symbols: a turn that must go, or a turn of a system, a user, an assistant or anyone
else, each whole or truncated. Good conversations are ``(s?(ua)+)?`` over the initials of roles, an automaton of four
states. The costs of finishing from each state, less their least, are one of a few vectors; how a vector turns into the
one before a block of ``BLOCK`` symbols is looked up in a table made for every vector and every block. Looking blocks up
from the last to the first gives the vectors between blocks; a block is then expanded against that direction: its
inner vectors come back symbol by symbol, and the edits that are least in ASCII among the cheapest are read off them.
Long conversations are cut into pieces: the same tables give a piece's effect on every vector and state.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, materialise

BLOCK = 4
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
ADJACENT = {"su", "ua", "au"}
#: 0: must go; otherwise 1 + 2 * (kind, 0 for others) + truncated.
SYMBOLS = 9
#: A piece is closed after so many turns or so many code points.
PIECE_TURNS, PIECE_CHARS = 4096, 1 << 20
SPACE = r"[^\x20\x09-\x0D]"
LAST = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]*\Z")


def symbol(role: str, text: str, duplicate: bool) -> tuple[int, str]:
    """A turn's symbol and its first fault."""
    last = LAST.search(text)
    if not last:
        return 0, "blank"
    if duplicate:
        return 0, "duplicate"
    cut = text[last.start()] not in ".!?"
    return 1 + 2 * KINDS.get(role[:1], 0) + cut, "truncated" if cut else ""


def _before(after: tuple[int, ...], sym: int) -> tuple[int, ...]:
    """Costs of finishing from each state before a turn, from those after it."""
    kind, cut = divmod(sym - 1, 2)
    own = []
    for q in range(4):
        costs = [DELETE + after[q]]
        if sym:
            costs.append(REROLE + cut * TRUNCATED + after[INSERTED[q]])
            if (q, kind) in LEGAL:
                costs.append(cut * TRUNCATED + after[kind])
        own.append(min(costs))
    return _with_inserts(own)


def _with_inserts(own: list[float]) -> tuple:
    user, assistant = min(own[USER], INSERT + own[ASSISTANT]), min(own[ASSISTANT], INSERT + own[USER])
    return min(own[START], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant


class Tables:
    """All normalised vectors (number 0: at the end), their steps, the blocks' tables, and the edits of each step."""

    def __init__(self):
        end = _with_inserts([0, float("inf"), float("inf"), 0])
        self.vectors, number, todo = [end], {end: 0}, [0]
        steps: dict[tuple[int, int], int] = {}
        self.drop: dict[tuple[int, int], int] = {}
        while todo:
            m = todo.pop()
            for sym in range(SYMBOLS):
                full = _before(self.vectors[m], sym)
                least = min(full)
                v = tuple(x - least for x in full)
                if v not in number:
                    number[v] = len(self.vectors)
                    self.vectors.append(v)
                    todo.append(number[v])
                steps[m, sym], self.drop[m, sym] = number[v], least
        n = len(self.vectors)
        self.step = np.array([[steps[m, s] for s in range(SYMBOLS)] for m in range(n)], np.int16)
        #: (vector after, symbol, state before): edits, roles put in before the turn, the turn's new role or None if deleted ('' if kept), state after
        self.edits = {(m, s, q): self._edits(m, s, q) for m in range(n) for s in range(SYMBOLS) for q in range(4)}
        self.exit = np.array([[[self.edits[m, s, q][3] for q in range(4)] for s in range(SYMBOLS)] for m in range(n)], np.int8)
        self._make_blocks(n)

    def _edits(self, m: int, sym: int, q: int) -> tuple[str, tuple[str, ...], str | None, int]:
        """The edits least in ASCII (D, I, K, R) among the cheapest ones up to and with a turn."""
        after, before, drop = self.vectors[m], self.vectors[self.step[m, sym]], self.drop[m, sym]
        kind, cut = divmod(sym - 1, 2)
        made, roles = "", []
        while True:
            left = before[q] + drop
            if left == DELETE + after[q]:
                return made + "D", tuple(roles), None, q
            if before[q] == INSERT + before[INSERTED[q]]:
                q = INSERTED[q]
                made += "I"
                roles.append(NAMES[q])
            elif sym and (q, kind) in LEGAL and left == cut * TRUNCATED + after[kind]:
                return made + "K", tuple(roles), "", kind
            else:
                return made + "R", tuple(roles), NAMES[INSERTED[q]], INSERTED[q]

    def _make_blocks(self, n: int) -> None:
        """For each vector after a block and each block (first symbol in the highest place): the vector before it, and
        for each state before it the state after it."""
        codes = np.arange(SYMBOLS**BLOCK)
        vector = np.repeat(np.arange(n, dtype=np.int16)[:, None], len(codes), axis=1)
        inner = []
        for k in range(BLOCK):  # from the last symbol to the first
            sym = codes // SYMBOLS**k % SYMBOLS
            inner.append((vector, sym))
            vector = self.step[vector, sym]
        state = np.broadcast_to(np.arange(4, dtype=np.int8), (n, len(codes), 4)).copy()
        for after, sym in reversed(inner):
            state = np.take_along_axis(self.exit[after, sym], state.astype(np.int64), axis=2)
        self.block, self.block_exit = vector, state

    def look_up(self, symbols: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes of the blocks, vectors after each block, vectors before the first), for vectors that stand after the symbols.
        Symbols that fill no block stand at the beginning and are left to the caller."""
        rest = len(symbols) % BLOCK
        codes = symbols[rest:].reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        between = np.empty((len(codes), len(after)), np.int16)
        for j in range(len(codes) - 1, -1, -1):
            between[j] = after
            after = self.block[after, codes[j]]
        return codes, between, after

    def effect(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a piece does: for every vector after it the vector before it, and for every state before it the state after it."""
        n = len(self.vectors)
        codes, between, vector = self.look_up(symbols, np.arange(n, dtype=np.int16))
        first = []
        for s in symbols[: len(symbols) % BLOCK][::-1]:
            first.append((vector, s))
            vector = self.step[vector, s]
        state, rows = np.tile(np.arange(4, dtype=np.int8), (n, 1)), np.arange(n)[:, None]
        for after, s in reversed(first):
            state = self.exit[after, s][rows, state]
        for code, after in zip(codes, between, strict=True):
            state = self.block_exit[after, code][rows, state]
        return vector.astype(np.int16), state

    def trace(self, symbols: np.ndarray, after: int, state: int) -> Iterator[tuple[str, tuple[str, ...], str | None, int]]:
        """The edits of each turn of a piece, given the vector after it and the state before it: blocks are expanded
        one at a time from the vectors that looking them up has left between them."""
        rest = len(symbols) % BLOCK
        _, between, first = self.look_up(symbols, np.array([after], np.int16))
        for low in range(-(BLOCK - rest) if rest else 0, len(symbols), BLOCK):
            own = symbols[max(low, 0) : low + BLOCK].tolist()
            m = int(first[0]) if low < 0 else int(between[(low - rest) // BLOCK, 0])
            inner = []
            for s in reversed(own):
                inner.append(m)
                m = int(self.step[m, s])
            for s, m in zip(own, reversed(inner), strict=True):
                made = self.edits[m, s, state]
                state = made[3]
                yield made

    def ending(self, state: int) -> tuple[str, tuple[str, ...]]:
        """The insertions after the last turn."""
        made, roles = "", []
        while self.vectors[0][state]:
            state = INSERTED[state]
            made += "I"
            roles.append(NAMES[state])
        return made, tuple(roles)


@cache
def tables() -> Tables:
    return Tables()


# -- Spark jobs


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) after the contract's damage; null roles and texts become one space, and so
    do null ids and turns in the key alone. A row to be repeated has two copies."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    picked = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), blank(role_col).alias("r"), blank(text_col).alias("x"), (F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("x", ".!?", "")).otherwise(F.col("x"))
    return picked.where("k <> 0").select(
        F.col("c").alias(conv_col), F.col("t").alias(turn_col), F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("r")).alias(role_col), text.alias(text_col), F.when(F.col("k") == 3, 2).otherwise(1).alias("copies")
    )


PIECES = "conv string, worker int, part long, whole boolean, roles array<string>, texts array<string>, symbols binary, faults array<long>, initials array<string>"
PARTS = "conv string, worker int, part long, whole boolean, audit string, roles array<string>, texts array<string>, faults array<long>, initials array<string>, cost long"


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """Rows (conv, worker, part, whole, audit, roles, texts, faults, initials, cost): each conversation's repaired turns
    in one or more parts, in the order (worker, part), with the edits that made them. faults counts a part's blank,
    duplicate and truncated turns and its illegal neighbours; initials are its first and last turn's before the repair.

    Turns are taken in the order of turn (nulls first), role, digest of the text. Null roles and texts count as one space;
    rows with a null conversation id form one conversation; rows that repeat, or say so in ``copies_col``, are copies
    that follow each other. An empty table gives no rows; other columns are ignored, whatever their names.

    Equal rows are counted before they are sorted, and the turns are dealt out by ranges of (conversation, turn), so that
    a conversation with a third of all rows is spread over many tasks. Where a role and text were seen in an earlier
    turn is found by aggregation; such rows are told by markers that sort right before them. Conversations within one
    task are repaired there. Of the others each piece sends its effect (a few hundred bytes) to where pieces are
    chained, and gets back the vector after it and the state before it.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col(copies_col).cast("long") if copies_col else F.lit(1)
    picked = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), blank(role_col).alias("r"), blank(text_col).alias("x"), copies.alias("n"))
    known = picked.select("c", "t", "r", F.unhex(F.sha2("x", 256)).alias("h"))
    at = F.struct(F.col("t").isNotNull().alias("a"), F.col("t").alias("b"))
    firsts = known.groupBy("c", "r", "h").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").select(F.col("c").alias("fc"), F.col("r").alias("fr"), F.col("h").alias("fh"), "first")
    later = known.join(firsts, F.col("c").eqNullSafe(F.col("fc")) & (F.col("r") == F.col("fr")) & (F.col("h") == F.col("fh"))).where(at > F.col("first"))
    markers = later.select("c", "t", "r", "h").distinct().withColumns({"x": F.lit(None).cast("string"), "n": F.lit(0).cast("long")})
    counted = picked.groupBy("c", "t", "r", "x").agg(F.sum("n").alias("n")).select("c", "t", "r", F.unhex(F.sha2("x", 256)).alias("h"), "x", "n")
    dealt = counted.unionByName(markers).repartitionByRange(n, "c", "t", "r", "h").sortWithinPartitions("c", "t", "r", "h", "n")
    pieces = materialise(dealt.select(F.col("c").cast("string").alias("conv"), "r", "x", "n").mapInArrow(lambda batches: _cut(batches, piece_turns), PIECES), "pieces")

    split = pieces.where("not whole")
    effects = split.select("conv", "worker", "part", "symbols").mapInArrow(_effects, "conv string, worker int, part long, vectors binary, states binary")
    chained = effects.repartition(n, "conv").sortWithinPartitions("conv", "worker", "part").mapInArrow(_chain, "w int, p long, after int, state int, final boolean")
    whole = pieces.where("whole").withColumns({"after": F.lit(0), "state": F.lit(START), "final": F.lit(True)})
    placed = split.join(chained, (F.col("worker") == F.col("w")) & (F.col("part") == F.col("p"))).drop("w", "p")
    return whole.unionByName(placed).mapInArrow(_expand, PARTS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _cut(batches: Iterator[pa.RecordBatch], piece_turns: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the sorted turns. A conversation that begins or ends a task may go on in a neighbouring one."""
    worker, part, first, conv, pieces, marked = TaskContext.get().partitionId(), 0, True, None, [], False
    begun = False

    def fresh() -> None:
        nonlocal roles, texts, symbols, faults, size, ends
        roles, texts, symbols, faults, size, ends = [], [], bytearray(), [0, 0, 0, 0], 0, ["", ""]

    def close() -> None:
        nonlocal part
        part += 1
        pieces.append([conv, worker, part, True, roles, texts, bytes(symbols), faults, ends])
        fresh()

    def ready(edge: bool) -> pa.RecordBatch:
        whole = not edge and len(pieces) == 1
        out = pa.RecordBatch.from_pylist([dict(zip(_NAMES, [*p[:3], whole, *p[4:]], strict=True)) for p in pieces], _schema(PIECES))
        pieces.clear()
        return out

    roles, texts, symbols, faults, size, ends = [], [], bytearray(), [0, 0, 0, 0], 0, ["", ""]
    for c, role, text, n in _rows(batches):
        if not begun or c != conv:
            if begun:
                if symbols:
                    close()
                if pieces:
                    yield ready(first)
                first = False
            begun, conv = True, c
        if not n:
            marked = True
            continue
        initial = role[:1]
        for k in range(n):
            sym, fault = symbol(role, text, marked or k > 0)
            if symbols:
                faults[3] += ends[1] + initial not in ADJACENT
            else:
                ends[0] = initial
            ends[1] = initial
            symbols.append(sym)
            roles.append(role if sym else "")
            texts.append(text if sym else "")
            size += len(text) if sym else 0
            if fault:
                faults[("blank", "duplicate", "truncated").index(fault)] += 1
            if len(symbols) >= piece_turns or size >= PIECE_CHARS:
                close()
                if len(pieces) > 8:
                    # a conversation of many pieces isn't whole anyhow
                    yield ready(True)
                    first = True
        marked = False
    if begun:
        if symbols:
            close()
        if pieces:
            yield ready(True)


_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [tables().effect(np.frombuffer(s, np.uint8).astype(np.int64)) for s in batch.column("symbols").to_pylist()]
        own = [pa.array([x[k].tobytes() for x in made], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *own], ["conv", "worker", "part", "vectors", "states"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece the vector after it, the state before it, and whether it is its conversation's last."""
    own: list[tuple] = []

    def settle() -> pa.RecordBatch:
        after, state, out = [0], START, []
        for x in reversed(own):
            after.append(int(np.frombuffer(x[3], np.int16)[after[-1]]))
        for k, x in enumerate(own):
            m = after[len(own) - 1 - k]
            out.append((x[1], x[2], m, state, k == len(own) - 1))
            state = int(np.frombuffer(x[4], np.int8).reshape(-1, 4)[m, state])
        own.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["w", "p", "after", "state", "final"])

    for x in _rows(batches):
        if own and own[-1][0] != x[0]:
            yield settle()
        own.append(x)
    if own:
        yield settle()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t, schema = tables(), _schema(PARTS)
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            audit, roles, texts, cost, state = [], [], [], 0, x["state"]
            symbols = np.frombuffer(x["symbols"], np.uint8)
            for sym, role, text, (made, put, new, after) in zip(symbols.tolist(), x["roles"], x["texts"], t.trace(symbols.astype(np.int64), x["after"], state), strict=True):
                audit.append(made)
                roles += put
                texts += [""] * len(put)
                state = after
                cost += INSERT * len(put)
                if new is None:
                    cost += DELETE
                    continue
                cost += (REROLE if new else 0) + (TRUNCATED if sym % 2 == 0 else 0)
                roles.append(new or role)
                texts.append(text)
            if x["final"]:
                made, put = t.ending(state)
                audit.append(made)
                roles += put
                texts += [""] * len(put)
                cost += INSERT * len(put)
            out.append({**{k: x[k] for k in ("conv", "worker", "part", "whole", "faults", "initials")}, "audit": "".join(audit), "roles": roles, "texts": texts, "cost": cost})
        yield pa.RecordBatch.from_pylist(out, schema)


DIGESTS = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest_repairs(parts: DataFrame) -> DataFrame:
    """Per conversation, from its parts: counts of faults, the cost, all edits and the digest of the repaired turns. No
    parts give no rows. A conversation in several parts is digested by one task, through which its turns stream: a digest is
    defined one byte after another, and its edits are one value by the contract."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = F.encode(F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda z: F.concat(z["roles"], F.lit(":"), z["texts"])), "\n"), "UTF-8")
    # one empty turn's line and no line at all differ
    shown = parts.select("conv", "worker", "part", "whole", "audit", "faults", "initials", "cost", F.size("roles").alias("lines"), said.alias("said"))
    shown = shown.withColumns({"sha": F.when(F.col("whole"), F.sha2("said", 256)), "said": F.when(~F.col("whole"), F.col("said"))})
    return shown.repartition(n, "conv").sortWithinPartitions("conv", "worker", "part").mapInArrow(_digest, DIGESTS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, conv, begun = _schema(DIGESTS), None, False
    for batch in batches:
        done = []
        for x in batch.to_pylist():
            if begun and x["conv"] != conv:
                done.append((conv, *counts, cost, "".join(audit), digest.hexdigest()))
                begun = False
            if x["whole"]:
                done.append((x["conv"], *x["faults"], x["cost"], x["audit"], x["sha"]))
                continue
            if not begun:
                begun, conv, counts, cost, audit, digest, lines, last = True, x["conv"], [0, 0, 0, 0], 0, [], hashlib.sha256(), False, None
            counts = [a + b for a, b in zip(counts, x["faults"], strict=True)]
            if last is not None:
                counts[3] += last + x["initials"][0] not in ADJACENT
            last = x["initials"][1]
            cost += x["cost"]
            audit.append(x["audit"])
            if x["lines"]:
                digest.update((b"\n" if lines else b"") + x["said"])
                lines = True
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True) if done else [[]] * len(schema), schema, strict=True)], schema=schema)
    if begun:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (conv, *counts, cost, "".join(audit), digest.hexdigest()), strict=True))], schema)


def repair_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The contract's result: every conversation of ``rows``, damaged, repaired and counted. Conversations of which the
    damage leaves nothing have zeros, no edits and the digest of nothing; null ids are one conversation; an empty table
    gives no rows."""
    hurt = damage(rows.select(conv_col, turn_col, role_col, text_col), conv_col, turn_col, role_col, text_col)
    parts = repair_conversations(hurt, conv_col, turn_col, role_col, text_col, "copies")
    turns = hurt.select(F.col(conv_col).alias("gc"), F.col(turn_col).alias("t")).distinct().groupBy("gc").agg((F.max("t") - F.min("t") + 1 - F.count("t")).cast("long").alias("gaps"))
    digests = digest_repairs(parts)
    key = free_name(digests, conv_col)
    out = rows.select(F.col(conv_col).alias(key)).distinct().join(turns, F.col(key).eqNullSafe(F.col("gc")), "left").drop("gc")
    out = out.join(digests, F.col(key).cast("string").eqNullSafe(F.col("conv")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col(key).alias(conv_col), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )


#: crc32 bit by bit, then a recursion from the last turn to the first that keeps for each state (cost, edits, lines) of the best way to finish.
SQL = r"""
WITH RECURSIVE
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(key) + 1), lambda j: ascii(key[j])::BIGINT)),
    lambda x, b: list_reduce(list_concat([xor(x, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT) % 20 AS m FROM k),
d AS (
  SELECT conv_id, turn, CASE m WHEN 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE m WHEN 3 THEN 2 ELSE 1 END))
  FROM h WHERE m <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
g AS (
  SELECT *, CASE WHEN z = '' THEN 'b' WHEN seen THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
v AS (
  SELECT conv_id, n + 1 AS i, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS e, {'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']} AS s, {'c': 2, 'a': 'I', 'r': ['assistant:']} AS u, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS a
  FROM o WHERE i = n
  UNION ALL
  SELECT conv_id, i, least(e, {'c': u.c + 2, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}), least(s, {'c': u.c + 2, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}), u, a
  FROM (
    SELECT conv_id, i, e, s, least(u, {'c': a.c + 2, 'a': 'I' || a.a, 'r': list_prepend('assistant:', a.r)}) AS u, least(a, {'c': u.c + 2, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}) AS a
    FROM (
      SELECT g.conv_id, g.i,
        least({'c': v.e.c + 3, 'a': 'D' || v.e.a, 'r': v.e.r},
              CASE WHEN fault NOT IN ('b', 'd') AND role[1] = 's' THEN {'c': v.s.c + w, 'a': 'K' || v.s.a, 'r': list_prepend(role || ':' || text, v.s.r)} END,
              CASE WHEN fault NOT IN ('b', 'd') AND role[1] = 'u' THEN {'c': v.u.c + w, 'a': 'K' || v.u.a, 'r': list_prepend(role || ':' || text, v.u.r)} END,
              CASE WHEN fault NOT IN ('b', 'd') THEN {'c': v.u.c + w + 2, 'a': 'R' || v.u.a, 'r': list_prepend('user:' || text, v.u.r)} END) AS e,
        least({'c': v.s.c + 3, 'a': 'D' || v.s.a, 'r': v.s.r},
              CASE WHEN fault NOT IN ('b', 'd') AND role[1] = 'u' THEN {'c': v.u.c + w, 'a': 'K' || v.u.a, 'r': list_prepend(role || ':' || text, v.u.r)} END,
              CASE WHEN fault NOT IN ('b', 'd') THEN {'c': v.u.c + w + 2, 'a': 'R' || v.u.a, 'r': list_prepend('user:' || text, v.u.r)} END) AS s,
        least({'c': v.u.c + 3, 'a': 'D' || v.u.a, 'r': v.u.r},
              CASE WHEN fault NOT IN ('b', 'd') AND role[1] = 'a' THEN {'c': v.a.c + w, 'a': 'K' || v.a.a, 'r': list_prepend(role || ':' || text, v.a.r)} END,
              CASE WHEN fault NOT IN ('b', 'd') THEN {'c': v.a.c + w + 2, 'a': 'R' || v.a.a, 'r': list_prepend('assistant:' || text, v.a.r)} END) AS u,
        least({'c': v.a.c + 3, 'a': 'D' || v.a.a, 'r': v.a.r},
              CASE WHEN fault NOT IN ('b', 'd') AND role[1] = 'u' THEN {'c': v.u.c + w, 'a': 'K' || v.u.a, 'r': list_prepend(role || ':' || text, v.u.r)} END,
              CASE WHEN fault NOT IN ('b', 'd') THEN {'c': v.u.c + w + 2, 'a': 'R' || v.u.a, 'r': list_prepend('user:' || text, v.u.r)} END) AS a
      FROM v JOIN (SELECT *, CASE fault WHEN 't' THEN 1 ELSE 0 END AS w FROM g) g ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND v.i = g.i + 1))),
best AS (SELECT conv_id, e FROM v WHERE i = 1),
t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""
