"""Repair of conversations whose turns are missing, empty, repeated, cut off or out of order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.llm.common import SPACES, heavy, join_unique, materialize, registry, table

QUERIES, SQL, query = registry()

#: Rows of a conversation that are searched together, as a power of two; and blocks that are combined at a time.
BLOCK_BITS, FAN = 10, 64
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}

# --- the search --------------------------------------------------------------------
#: What has been kept so far: nothing, a system turn, a user's, an assistant's.  A repaired conversation ends with the first or the last.
STATES = "-sua"
_NEXT = {"-": "su", "s": "u", "u": "a", "a": "u"}
#: A row's code is its role's initial (``o`` for any other), in upper case if the row is cut off; ``x`` has to go.
_GONE = "x"


def _moves(state: str, code: str | None):
    """Edits open in ``state`` before a row: ``(cost, letter, next state, row used)``."""
    if code is not None:
        yield DELETE, "D", state, True
    for role in _NEXT[state]:
        if role in ROLES:
            yield INSERT, "I", role, False
    if code is not None and code != _GONE:
        extra = TRUNCATED if code.isupper() else 0
        if code.lower() in _NEXT[state]:
            yield extra, "K", code.lower(), True
        for role in _NEXT[state]:
            if role in ROLES:
                yield REROLE + extra, "R", role, True


def _bounds(codes: str, goal: str) -> list[dict[str, int]]:
    """The least cost from each place and state to ``goal``, from the last row back: a bound for every suffix."""
    least: list[dict[str, int]] = [{} for _ in range(len(codes) + 1)]
    for i in range(len(codes), -1, -1):
        row = codes[i] if i < len(codes) else None
        here = {goal: 0} if row is None else {}
        for state in STATES:
            for cost, _, to, used in _moves(state, row):
                if used and to in least[i + 1]:
                    here[state] = min(here.get(state, 1 << 60), cost + least[i + 1][to])
        for _ in range(2):  # two insertions in a row are the most that can help
            for state in STATES:
                for cost, _, to, used in _moves(state, None):
                    if not used and to in here:
                        here[state] = min(here.get(state, 1 << 60), cost + here[to])
        least[i] = here
    return least


def search(codes: str, start: str, goal: str) -> tuple[int, str] | None:
    """The cheapest edits that take ``start`` to ``goal`` over all of ``codes``: ``(cost, audit)``, of ties the ASCII-least.

    Depth-first branch and bound on an explicit stack.  A prefix is given up
    if its cost and the bound of what is left exceed the incumbent's, or equal
    them with a greater audit, or if its place and state were reached before
    by one as cheap with an audit as small.  (Of two audits of equal cost over
    the same rows neither begins with the other, so prefixes can be compared.)
    """
    bounds = _bounds(codes, goal)
    if start not in bounds[0]:
        return None
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, str], tuple[int, str]] = {}
    stack = [(0, "", 0, start)]
    while stack:
        cost, audit, i, state = stack.pop()
        left = bounds[i].get(state)
        if left is None or (best and (cost + left, audit) >= (best[0], best[1][:len(audit)]) and (cost + left > best[0] or audit > best[1][:len(audit)])):
            continue
        before = seen.get((i, state))
        if before and before <= (cost, audit):
            continue
        seen[i, state] = cost, audit
        if i == len(codes) and state == goal and (best is None or (cost, audit) < best):
            best = cost, audit
        ahead = [(cost + c, audit + letter, i + used, to) for c, letter, to, used in _moves(state, codes[i] if i < len(codes) else None)]
        # The most promising is looked at first: the smallest bound, then the smallest letter.
        ahead = [n for n in ahead if n[3] in bounds[n[2]]]
        stack.extend(sorted(ahead, key=lambda n: (n[0] + bounds[n[2]][n[3]], n[1]), reverse=True))
    return best


@lru_cache(maxsize=50_000)
def _block(codes: str, first: bool, last: bool) -> tuple[tuple[str, int, str], ...]:
    """``(start and goal, cost, audit)`` of each way through a block that can matter."""
    found = [(s + g, search(codes, s, g)) for s in (STATES[0] if first else STATES) for g in ("-a" if last else STATES)]
    return tuple((ends, *way) for ends, way in found if way)


def replay(codes: str, state: str, audit: str) -> list[tuple[int, str | None]]:
    """What an audit leaves of a block: ``(row, new role)`` in order, no row (-1) where one is inserted, no role where it stays."""
    out: list[tuple[int, str | None]] = []
    i = 0
    for edit in audit:
        role = next((r for r in _NEXT[state] if r in ROLES), "")
        if edit == "K":
            state = codes[i].lower()
            out.append((i, None))
        elif edit in "RI":
            state = role
            out.append((i if edit == "R" else -1, ROLES[role]))
        i += edit != "I"
    return out


# --- faults, native ------------------------------------------------------------------
def _key(conv: str) -> Column:
    """A conversation's id as a string that is never null and is null's own."""
    return F.when(F.col(conv).isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col(conv).cast("string"))).alias("_k")


def _or_space(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(" "))


_ORDER = ["_k", "_turn", "_role", "_text", "_copy"]


def placed_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every row with its place and its first fault: ``_k, _conv, _pos, _block, _turn, _role, _text, _initial, _fault``.

    ``_pos`` orders the rows of a conversation by turn (nulls first), then
    role and text.  Rows are put in order by range over all conversations, so
    a long one is spread over many tasks; ``_block`` holds up to 1,024 rows of
    one conversation that follow each other.  ``_fault`` is ``blank``,
    ``duplicate``, ``truncated`` or null.  Repeated rows are one row per task
    until they are put in order; of a text said again under later turns only
    hashes meet.
    """
    rows = turns.select(_key(conv), F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), _or_space(role).alias("_role"), _or_space(text).alias("_text"))
    rows = rows.groupBy("_k", "_conv", "_turn", "_role", "_text").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumns({"_a": F.xxhash64(F.lit(1), "_role", "_text"), "_b": F.xxhash64(F.lit(2), "_text", "_role")})
    rows = materialize(rows, "turns-rows")
    order = F.struct(F.col("_turn").isNotNull().alias("there"), F.col("_turn").alias("turn"))
    said = rows.groupBy("_k", "_a", "_b").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1")
    said = materialize(said, "turns-said")
    again = F.coalesce(~F.col("_first").eqNullSafe(order), F.lit(False)) & F.col("_first").isNotNull()
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")
    rows = join_unique(rows, said, ["_k", "_a", "_b"], heavy(said, "_times", rows.count())).select(
        "_k", "_conv", "_turn", "_role", "_text", again.alias("_again"), copies)
    rows = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    rows = rows.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_block", F.shiftright("_pos", BLOCK_BITS))
    bare = F.rtrim("_text", F.lit(SPACES))
    fault = F.when(bare == "", "blank").when(F.col("_again") | (F.col("_copy") > 1), "duplicate").when(
        ~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    return materialize(rows.select("_k", "_conv", "_pos", "_block", "_turn", "_role", "_text", F.substring("_role", 1, 1).alias("_initial"),
                                   fault.alias("_fault")), "turns-placed")


def _blocks(placed: DataFrame) -> DataFrame:
    """``_k, _idx, _of, low, codes, first, last, illegal`` per block: which of how many it is, its first place, a letter per row, its unlawful neighbours."""
    known = F.when(F.col("_initial").isin("s", "u", "a"), F.col("_initial")).otherwise("o")
    lost = F.col("_fault").isin("blank", "duplicate")
    code = F.when(lost, _GONE).when(F.col("_fault") == "truncated", F.upper(known)).otherwise(known)
    rows = placed.groupBy("_k", "_block").agg(F.array_sort(F.collect_list(F.struct("_pos", code.alias("code"), known.alias("role")))).alias("_rows"))
    roles = F.transform("_rows", lambda r: r["role"])
    pairs = F.zip_with(F.slice(roles, 1, F.size(roles) - 1), F.slice(roles, 2, F.size(roles)), lambda x, y: F.concat(x, y))
    blocks = rows.select("_k", "_block", F.element_at("_rows", 1)["_pos"].alias("low"), F.array_join(F.transform("_rows", lambda r: r["code"]), "").alias("codes"),
                         F.element_at(roles, 1).alias("first"), F.element_at(roles, -1).alias("last"),
                         F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"))
    blocks = materialize(blocks, "turns-blocks")
    of_one = W.partitionBy("_k")
    numbered = blocks.select("_k", "_block", (F.row_number().over(of_one.orderBy("_block")) - 1).alias("_idx"), F.count(F.lit(1)).over(of_one).alias("_of"))
    return blocks.join(numbered, ["_k", "_block"]).drop("_block")


# --- blocks searched and combined ------------------------------------------------------
_WAY = pa.struct([("ends", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())])
_WAYS = "array<struct<ends:string,cost:long,audit:string,path:string>>"


def _named(ways) -> list[dict]:
    return [{"ends": e, "cost": c, "audit": a, "path": p} for e, c, a, p in ways]


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("codes", "_idx", "_of")]
        ways = [_named((e, c, a, e) for e, c, a in _block(codes, i == 0, i == n - 1)) for codes, i, n in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, pa.list_(_WAY))], [*batch.schema.names, "ways"])


def _through(blocks: list[list[dict]]) -> list[dict]:
    """Ways through blocks that follow each other: per pair of ends the cheapest, of ties the ASCII-least audit."""
    done = [(w["ends"], w["cost"], w["audit"], w["path"]) for w in blocks[0]]
    for block in blocks[1:]:
        best: dict[str, tuple] = {}
        for ends, cost, audit, path in done:
            for w in block:
                if w["ends"][0] == ends[1]:
                    name = ends[0] + w["ends"][1]
                    total = cost + w["cost"]
                    if name not in best or total <= best[name][0]:
                        way = (total, audit + w["audit"], path + w["path"][1:])
                        best[name] = min(best.get(name, way), way)
        done = [(name, *way) for name, way in best.items()]
    return _named(done)


def _combine_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_k", "_idx", "first", "last", "illegal", "ways"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(_WAY)]
    for batch in batches:
        for row in batch.to_pylist():
            parts = row["parts"]
            seams = sum(x["last"] + y["first"] not in ("su", "ua", "au") for x, y in zip(parts, parts[1:], strict=False))
            out = (row["_k"], row["_idx"], parts[0]["first"], parts[-1]["last"], seams + sum(p["illegal"] for p in parts), _through([p["ways"] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], names)


def _combined(searched: DataFrame) -> DataFrame:
    """``_k, illegal, cost, audit, path`` per conversation; ``path`` holds the state at the ends of each of its blocks.

    Blocks are combined :data:`FAN` at a time, in rounds whose number grows
    with the logarithm of the longest conversation.
    """
    columns = ["_k", "_idx", "first", "last", "illegal", "ways"]
    single, rest = searched.where("_of = 1").select(*columns), searched.where("_of > 1").select(*columns)
    most = searched.agg(F.max("_of")).first()[0] or 0
    while most > 1:
        part = F.struct("_idx", "first", "last", "illegal", "ways")
        groups = rest.groupBy("_k", F.floor(F.col("_idx") / FAN).cast("int").alias("_to")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
        groups = groups.select("_k", F.col("_to").alias("_idx"), "parts")
        rest = materialize(groups.mapInArrow(_combine_blocks, f"_k string, _idx int, first string, last string, illegal long, ways {_WAYS}"), "turns-combined")
        most = -(-most // FAN)
    best = F.array_min(F.transform("ways", lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"), w["path"].alias("path"))))
    return single.unionByName(rest).select("_k", "illegal", best.alias("_best")).select("_k", "illegal", "_best.*")


def _replay_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())]))
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("codes", "ends", "audit")]
        left = [[{"row": i, "role": r} for i, r in replay(codes, ends[0], audit)] for codes, ends, audit in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("low"), pa.array(left, kind)], ["_k", "low", "left"])


class Repair(NamedTuple):
    """``report``: a row per conversation that has rows, ``_k, gaps, blank, duplicate, truncated, illegal, cost, audit``;
    ``rows``: the repaired turns, ``_k, _conv, _pos, _seq, role, text``, in the order of ``_pos`` and ``_seq``."""

    report: DataFrame
    rows: DataFrame


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Find what is wrong with each conversation and the cheapest edits that mend it.

    Rows are read by turn, nulls first, then role and text.  The first fault
    of a row counts: blank, said before by the same role, or not ended by
    ``. ! ?``.  A row may be kept (free), given the role user or assistant
    (3) or deleted (4; blank and repeated rows must be); an empty turn of
    either role may be inserted anywhere (3); a cut-off row that is not
    deleted adds 3.  Afterwards the first letters of the roles read
    ``(s?(ua)+)?``.  Of equally cheap edits the ASCII-least audit (letters
    ``D I K R``) is taken.

    A conversation's rows are cut into blocks.  For each state before and
    after a block :func:`search` finds the best edits, and blocks are combined
    by cost and audit, which is exact since neither of two audits of the same
    rows and cost begins with the other.  So no task holds a long conversation.

    Null roles and texts are one space; null ids are one conversation; a null
    turn is no gap; an empty role fits nowhere and has to be replaced or
    deleted.  Repeated rows are duplicates of each other.  Empty tables give
    empty results; other columns are not read.
    """
    placed = placed_rows(turns, conv, turn, role, text)
    blocks = _blocks(placed)
    schema = f"_k string, low long, codes string, first string, last string, illegal long, _idx int, _of long, ways {_WAYS}"
    searched = materialize(blocks.select("_k", "low", "codes", "first", "last", "illegal", "_idx", "_of").mapInArrow(_search_blocks, schema), "turns-searched")
    best = materialize(_combined(searched), "turns-best")

    ends = best.select("_k", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("path") - 1), lambda i: F.substr("path", i, F.lit(2)))).alias("_idx", "ends"))
    chosen = searched.join(ends, ["_k", "_idx"])
    chosen = chosen.select("_k", "low", "codes", "ends", F.explode("ways").alias("way")).where("way.ends = ends").select("_k", "low", "codes", "ends", "way.audit")
    left = chosen.mapInArrow(_replay_blocks, "_k string, low long, left array<struct<row:int,role:string>>")
    # An inserted turn has the place of the row that comes next, so places and numbers within a block give the order.
    left = materialize(left.select("_k", "low", F.posexplode("left").alias("_seq", "l")).select("_k", "low", "_seq", "l.row", "l.role"), "turns-left")
    of_rows = placed.select("_conv", "_pos", "_role", "_text")
    stay = left.where("row >= 0").withColumn("_pos", F.col("low") + F.col("row")).join(of_rows, "_pos").select(
        "_k", "_conv", F.col("low").alias("_pos"), "_seq", F.coalesce("role", "_role").alias("role"), F.col("_text").alias("text"))
    convs = placed.groupBy("_k").agg(F.first("_conv").alias("_conv"))
    new = left.where("row < 0").join(convs, "_k").select("_k", "_conv", F.col("low").alias("_pos"), "_seq", "role", F.lit("").alias("text"))

    counts = placed.groupBy("_k").agg(F.max("_turn").alias("_high"), F.min("_turn").alias("_low"),
                                      *[F.count_if(F.col("_fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    turns_in = placed.where("_turn is not null").select("_k", "_turn").distinct().groupBy("_k").agg(F.count(F.lit(1)).alias("_turns"))
    gaps = F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_turns"), F.lit(0)).cast("long").alias("gaps")
    report = counts.join(turns_in, "_k", "left").join(best, "_k").select("_k", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(report, stay.unionByName(new))


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per conversation over sorted rows, one hash state at a time."""
    now, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for k, line in zip(batch.column("_k").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if k != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = k, hashlib.sha256(line.encode())
            else:
                state.update(b"\n")
                state.update(line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["_k", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["_k", "repaired_sha256"])


def repaired_digests(rows: DataFrame) -> DataFrame:
    """``_k, repaired_sha256``: of a repaired conversation's ``role:text`` lines.

    SHA-256 reads a conversation from its first byte to its last, so its rows
    pass through one task in order; the task holds one row and one state.
    """
    lines = rows.select("_k", "_pos", "_seq", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("_k").sortWithinPartitions("_k", "_pos", "_seq").select("_k", "line")
    return lines.mapInArrow(_hash_rows, "_k string, repaired_sha256 string")


def repair_report(originals: DataFrame, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """What :func:`repair` says of ``turns`` for every conversation of ``originals``: zeros where no row is left."""
    fixed = repair(turns, conv, turn, role, text)
    every = originals.select(_key(conv), F.col(conv).alias("_conv")).groupBy("_k").agg(F.first("_conv").alias("_conv"))
    out = every.join(fixed.report, "_k", "left").join(repaired_digests(fixed.rows), "_k", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_conv").alias(conv), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# --- the query -------------------------------------------------------------------------
def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` with some rows dropped, emptied, robbed of their ends, repeated or given to the user, by a checksum of id and turn."""
    name = F.concat_ws(":", F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(F.encode(name, "utf-8")), F.lit(20)).alias("_kind")
    rows = turns.select(F.col(conv), F.col(turn), _or_space(role).alias(role), _or_space(text).alias(text), kind).where("_kind <> 0")
    said = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    return rows.select(conv, turn, F.when(F.col("_kind") == 4, "user").otherwise(F.col(role)).alias(role), said.alias(text),
                       F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_time")).drop("_time")


def _plus(way: str, cost: str, letter: str) -> str:
    return f"printf('%09d', CAST(left({way}, 9) AS INT) + {cost}) || substr({way}, 10) || '{letter}'"


_AFTER = {x: f"CASE WHEN {x} IS NOT NULL THEN " for x in "esua"}
_STEP = ",\n    ".join((
    f"{_AFTER['e']}{_plus('e', '4', 'D')} END AS e0",
    f"least({_AFTER['s']}{_plus('s', '4', 'D')} END, CASE WHEN code = 's' AND e IS NOT NULL THEN {_plus('e', 'cut', 'K')} END) AS s0",
    f"least({_AFTER['u']}{_plus('u', '4', 'D')} END, "
    + ", ".join(f"CASE WHEN code = 'u' AND {x} IS NOT NULL THEN {_plus(x, 'cut', 'K')} END, CASE WHEN code <> 'x' AND {x} IS NOT NULL THEN {_plus(x, '3 + cut', 'R')} END" for x in "esa") + ") AS u0",
    f"least({_AFTER['a']}{_plus('a', '4', 'D')} END, CASE WHEN code = 'a' AND u IS NOT NULL THEN {_plus('u', 'cut', 'K')} END, CASE WHEN code <> 'x' AND u IS NOT NULL THEN {_plus('u', '3 + cut', 'R')} END) AS a0"))
_TO_U = ", ".join(f"{_AFTER['e'].replace('e IS', x + '0 IS')}{_plus(x + '0', '3', 'I')} END" for x in "esa")


@query("op11_conversations", rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(name, ''), lambda z: [ord(z)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda z, y: xor(xor(z, y) >> 1, (xor(z, y) & 1) * 3988292384)), 4294967295::BIGINT) % 20 AS kind FROM c),
b AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
g AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
n AS (SELECT g.g, b.*, row_number() OVER (PARTITION BY g.g ORDER BY turn NULLS FIRST, role, text) AS i FROM b JOIN g ON b.conv_id IS NOT DISTINCT FROM g.conv_id),
m AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS again FROM n),
f AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM m),
r AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE initial END AS code, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM f),
t AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, max(i) AS n FROM r GROUP BY g),
l AS (SELECT g, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT g, lag(initial) OVER (PARTITION BY g ORDER BY i) || initial AS pair FROM r) GROUP BY g),
w AS (SELECT g, 0 AS i, '000000000' AS e, CAST(NULL AS VARCHAR) AS s, '000000003I' AS u, '000000006II' AS a FROM t
  UNION ALL
  SELECT g, i, e0, s0, u1, least(a0, CASE WHEN u1 IS NOT NULL THEN {_plus('u1', '3', 'I')} END) FROM (
    SELECT *, least(u0, {_TO_U}) AS u1 FROM (
      SELECT w.g, r.i,
    {_STEP}
      FROM w JOIN r ON w.g = r.g AND r.i = w.i + 1))),
o AS (SELECT w.g, least(e, a) AS best FROM w JOIN t ON w.g = t.g AND w.i = t.n),
e AS (SELECT g, j, best[9 + j] AS letter, count(*) FILTER (WHERE best[9 + j] <> 'I') OVER (PARTITION BY g ORDER BY j) AS i FROM o, range(1, length(best) - 8) AS u(j)),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY j) AS m, count(*) OVER (PARTITION BY g) AS total FROM e WHERE letter <> 'D'),
q AS (SELECT p.g, p.j, CASE WHEN letter = 'K' THEN r.role WHEN (m - total) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END AS line
  FROM p LEFT JOIN r ON p.g = r.g AND p.i = r.i),
h AS (SELECT g, string_agg(line, chr(10) ORDER BY j) AS joined FROM q GROUP BY g)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(joined, '')) AS repaired_sha256
FROM g LEFT JOIN t USING (g) LEFT JOIN l USING (g) LEFT JOIN o USING (g) LEFT JOIN h USING (g)""")
def conversations(spark, sf):
    turns = table(spark, sf, "conversations")
    return repair_report(turns, damaged(turns))
