"""Repair of the turn structure of conversations at least cost.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. What it costs to get from any turn on to a
well-formed end, from each of four states of that grammar, is found backward over the turns; then a forward walk takes at
each turn the ASCII-least edit among those on a cheapest way. The turns rebuilt that way are hashed.

A conversation of any length is worked through in pieces of PIECE turns. A piece's costs from state to state are a
4 x 4 table; tables are joined from the last piece to the first, so each piece knows the costs behind it and is walked by
itself. Texts only stream past: they are never held together for a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainledger.llm.common import cut, table
from grainledger.llm.prefix_trie import turn_digest
from grainledger.llm.turns import numbered

#: Turns of a piece.
PIECE = 4096
NEVER = 1 << 50
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Conversations may end in 0 and 3.
ENDING = (0, NEVER, NEVER, 0)
#: The state after a user's or an assistant's turn is put or made there.
ONWARD = (2, 2, 3, 2)
DELETE, INSERT, RENAME, TRUNCATED = 2, 5, 1, 5
#: State after keeping a turn of role s, u, a or another, by the state before; -1: not allowed.
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
#: A turn's code is the letter at 4 * kind + fault. Kinds: s, u, a, other; faults: none, blank, duplicate, truncated.
CODES = "ABCDEFGHIJKLMNOP"


def _edits(code: str) -> list[list[tuple[str, int, int]]]:
    """By state: (initial, cost, next state) of each edit that uses up the turn."""
    kind, fault = divmod(CODES.index(code), 4)
    more = TRUNCATED if fault == 3 else 0
    out = []
    for q in range(4):
        ways = [("D", DELETE, q)]
        if fault not in (1, 2):
            if KEPT[kind][q] >= 0:
                ways.append(("K", more, KEPT[kind][q]))
            ways.append(("R", RENAME + more, ONWARD[q]))
        out.append(ways)
    return out


EDITS = {c: _edits(c) for c in CODES}


def _with_inserts(f: list[int]) -> tuple[int, ...]:
    user, assistant = min(f[2], INSERT + f[3]), min(f[3], INSERT + f[2])
    return (min(f[0], INSERT + user), min(f[1], INSERT + user), user, assistant)


def costs(codes: str, behind: tuple[int, ...], last: bool = True) -> list[tuple[int, ...]]:
    """For each place before a turn, and behind all: the least cost of the rest from each state, given that behind the turns.

    ``last``: whether turns may still be inserted at the place behind.
    """
    f = [_with_inserts(list(behind)) if last else tuple(behind)]
    for c in reversed(codes):
        g = f[-1]
        f.append(_with_inserts([min(cost + g[to] for _, cost, to in ways) for ways in EDITS[c]]))
    f.reverse()
    return f


def across(codes: str) -> list[int]:
    """The piece's table: costs from state q before it to state r behind its last turn, at 4 * q + r."""
    columns = [costs(codes, tuple(0 if r == k else NEVER for k in range(4)), last=False)[0] for r in range(4)]
    return [min(NEVER, columns[r][q]) for q in range(4) for r in range(4)]


def behind_each(tables: list[list[int]]) -> list[tuple[int, ...]]:
    """For each piece, in order, the costs at the place behind it."""
    f, out = _with_inserts(list(ENDING)), []
    for t in reversed(tables):
        out.append(f)
        f = tuple(min(NEVER, min(t[4 * q + r] + f[r] for r in range(4))) for q in range(4))
    return out[::-1]


def walk(codes: str, behind: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """(initials of the cheapest edits, the ASCII-least of such; state behind them), starting in ``state``."""
    f, out = costs(codes, behind, last=last), []
    for i in range(len(codes) + 1):
        while True:
            left = f[i][state]
            ways = EDITS[codes[i]][state] if i < len(codes) else []
            tight = [(e, to) for e, cost, to in ways if left == cost + f[i + 1][to]]
            if (i < len(codes) or last) and left == INSERT + f[i][ONWARD[state]] and left < NEVER:
                tight.append(("I", ONWARD[state]))
            if not tight:
                break
            edit, state = min(tight)
            out.append(edit)
            if edit != "I":
                break
    return "".join(out), state


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with every twentieth turn dropped, emptied, cut off, doubled or renamed, by its crc32.

    Null roles, texts, and ids and turns in the hashed text are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("fate")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fate).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "fate")
    return rows.withColumn("again", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "again")


def _coded(rows: DataFrame, size: int) -> DataFrame:
    """(conv_id, piece, codes) from numbered rows; ``size`` codes in a piece at most."""
    seen = rows.groupBy("conv_id", "digest").agg(F.min("pos").alias("first")).select(F.col("conv_id").alias("of"), F.col("digest").alias("d"), "first")
    narrow = rows.select("conv_id", "pos", "digest", F.substring("role", 1, 1).alias("initial"), "blank", "cut_off")
    joined = narrow.join(seen, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("d")))
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("cut_off"), 3).otherwise(0)
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = F.substring(F.lit(CODES), kind * 4 + fault + 1, F.lit(1))
    pieces = joined.select("conv_id", F.expr(f"pos div {size}").alias("piece"), F.struct("pos", code.alias("code")).alias("turn"))
    return pieces.groupBy("conv_id", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda t: t["code"]), "").alias("codes"))


@F.pandas_udf(T.StringType())
def _audit_whole(codes: pd.Series) -> pd.Series:
    return codes.map(lambda c: walk(c, ENDING, 0, True)[0])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _across(codes: pd.Series) -> pd.Series:
    return codes.map(across)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _behind(tables: pd.Series) -> pd.Series:
    return tables.map(lambda t: [list(f) for f in behind_each([list(x) for x in t])])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _exits(codes: pd.Series, behind: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([[walk(c, tuple(ENDING if z else b), q, bool(z))[1] for q in range(4)] for c, b, z in zip(codes, behind, last)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _entries(exits: pd.Series) -> pd.Series:
    def run(maps: list) -> list[int]:
        out = [0]
        for m in maps[:-1]:
            out.append(int(m[out[-1]]))
        return out

    return exits.map(run)


@F.pandas_udf(T.StringType())
def _audit_piece(codes: pd.Series, behind: pd.Series, last: pd.Series, entry: pd.Series) -> pd.Series:
    return pd.Series([walk(c, tuple(ENDING if z else b), int(q), bool(z))[0] for c, b, z, q in zip(codes, behind, last, entry)])


def _audits(pieces: DataFrame) -> DataFrame:
    """(conv_id, piece, codes, audit): the edits of each piece."""
    pieces = cut(pieces)
    long_ids = pieces.where("piece > 0").select(F.col("conv_id").alias("of")).distinct()
    if long_ids.isEmpty():
        return pieces.select("*", _audit_whole("codes").alias("audit"))
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    whole = pieces.join(long_ids, same, "left_anti").select("*", _audit_whole("codes").alias("audit"))
    parts = pieces.join(long_ids, same, "left_semi")
    tables = parts.select("conv_id", F.struct("piece", _across("codes").alias("t")).alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    behind = tables.select(F.col("conv_id").alias("of"), F.size("x").alias("n"), F.posexplode(_behind(F.col("x.t"))).alias("at", "behind"))
    known = cut(parts.join(behind, same & (F.col("piece") == F.col("at"))).select("conv_id", "piece", "codes", "behind", (F.col("piece") == F.col("n") - 1).alias("last")))
    exits = known.select("conv_id", F.struct("piece", _exits("codes", "behind", "last").alias("e")).alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    entries = exits.select(F.col("conv_id").alias("of"), F.posexplode(_entries(F.col("x.e"))).alias("at", "entry"))
    walked = known.join(entries, same & (F.col("piece") == F.col("at"))).select("conv_id", "piece", "codes", _audit_piece("codes", "behind", "last", "entry").alias("audit"))
    return whole.unionByName(walked)


class _Conversation:
    """What is known of a conversation while its turns stream past."""

    def __init__(self, conv_id: int | None):
        self.id, self.state, self.lines, self.hash = conv_id, 0, 0, hashlib.sha256()
        self.low = self.high = self.turn = None
        self.turns = self.cost = self.illegal = 0
        self.faults, self.audit, self.ahead, self.at, self.codes, self.before = [0, 0, 0, 0], [], "", 0, "", None

    def piece(self, codes: str, audit: str) -> None:
        self._inserts()
        self.codes, self.ahead, self.at = iter(codes), audit, 0
        self.audit.append(audit)
        for c in codes:
            kind, fault = divmod(CODES.index(c), 4)
            self.faults[fault] += 1
            self.illegal += self.before is not None and (self.before, kind) not in ((0, 1), (1, 2), (2, 1))
            self.before = kind

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _inserts(self) -> None:
        while self.at < len(self.ahead) and self.ahead[self.at] == "I":
            self.state = ONWARD[self.state]
            self._line("user" if self.state == 2 else "assistant", "")
            self.cost += INSERT
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self._inserts()
        edit, code = self.ahead[self.at], next(self.codes)
        self.at += 1
        ways = {e: (cost, to) for e, cost, to in EDITS[code][self.state]}
        cost, self.state = ways[edit]
        self.cost += cost
        if edit != "D":
            self._line(role if edit == "K" else "user" if self.state == 2 else "assistant", text)

    def done(self) -> tuple:
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TYPES = (*[pa.int64()] * 7, pa.string(), pa.string())
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id, pos and kind: a piece's codes and edits stand before its turns."""
    now: _Conversation | None = None
    for batch in batches:
        done = []
        for conv, kind, turn, role, text, codes, audit in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if now is None or conv != now.id:
                if now is not None:
                    done.append(now.done())
                now = _Conversation(conv)
            now.row(turn, role, text) if kind else now.piece(codes, audit)
        yield _batch(done)
    if now is not None:
        yield _batch([now.done()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def repair(turns: DataFrame, size: int = PIECE) -> DataFrame:
    """RESULT: a row for each conv_id of ``turns`` (conv_id, turn, role, text; no null role or text).

    A null conv_id is a conversation. Turns go by number, nulls first, ties by role and the digest of role and text. Blank:
    no character but white space (space, tab to carriage return); duplicate: an earlier turn has this role and text;
    truncated: the last such character is none of ``.!?``; of several the first counts. Blank and duplicate turns are deleted.
    """
    marked = turns.withColumn("digest", turn_digest(F.col("role"), F.col("text"))).withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("cut_off", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
    rows = numbered(marked, "conv_id", ["turn", "role", "digest"])
    audits = _audits(_coded(rows, size))
    nothing = F.lit(None).cast("string")
    heads = audits.select("conv_id", (F.col("piece") * size).alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"), "codes", "audit")
    body = rows.select("conv_id", "pos", F.lit(1).alias("kind"), "turn", "role", "text", nothing.alias("codes"), nothing.alias("audit"))
    together = body.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    return together.select("conv_id", "kind", "turn", "role", "text", "codes", "audit").mapInArrow(_streamed, RESULT)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    every = conversations.select(F.col("conv_id").cast("long").alias("of")).distinct()
    got = every.join(repair(damaged(conversations)), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _NAMES[1:7]]
    return got.select(F.col("of").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
