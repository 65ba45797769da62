"""Operator 13: repair of damaged conversations by the cheapest edits, least audits by prefix doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corvane.llm.common import bounded_batches, dropped, table, written
from corvane.llm.crc import crc32_sql

SPACES = " \t\n\x0b\x0c\r"
INITIALS, FAULTS = ("s", "u", "a"), ("", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
UNIT = 4096  # rows of a conversation that are solved at a time
SOLVED, PRODUCTS = 1 << 18, 1024  # rows whose nodes are held at a time; units whose costs from state to state are
_FAR = np.int64(1) << 40
# States: nothing said, after system, after user, after assistant. _NEXT: the state after a turn that is made or given a
# role, which is user but after user. _KEPT[initial, state]: the state after a turn that keeps its role, -1 where it can't.
_NEXT = np.array([2, 2, 3, 2])
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)  # in their order; 0 ends an audit


def damaged(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations after damage, drawn by the checksum of conv_id:turn; nulls of any column are one space there."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = chats.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return drawn.where("k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("again")).drop("again")


def _codes(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, codes): a letter for each row of a conversation, in order, that says its initial and its first fault.

    Texts aren't shuffled, only 16 bytes of each. Rows are laid in ranges of
    (conversation, turn, role, digest), so those of a large conversation are
    dealt to many tasks; the first place of each thing said is found by an
    aggregation that combines before it shuffles, and met in a join that Spark
    splits. What meets in one task of a conversation is a letter for each row.
    """
    told = F.rtrim(F.col("text"), F.lit(SPACES))
    slim = turns.select(
        F.col("conv_id"), F.col("turn"), F.col("role"), F.unhex(F.md5("text")).alias("digest"), (F.length(told) == 0).alias("blank"), (~F.right(told, F.lit(1)).isin(".", "!", "?")).alias("cut")
    )
    slim, slim_path = written(slim.withColumn("tie", F.monotonically_increasing_id()), "repair-rows")
    order = ("conv_id", "turn", "role", "digest", "tie")
    laid = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    laid, laid_path = written(laid.drop("tie"), "repair-order")
    said = ("conv_id", "role", "digest")
    first, first_path = written(laid.groupBy(*said).agg(F.min("place").alias("first")).select(F.struct(*said).alias("said"), "first"), "repair-firsts")
    met = laid.withColumn("said", F.struct(*said)).join(first, "said")
    fault = F.when(F.col("blank"), 1).when(F.col("place") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), F.left("role", F.lit(1))), F.lit(0))
    code = F.char(F.lit(65) + 4 * fault + F.when(initial == 0, 3).otherwise(initial - 1))
    letters = lambda by, x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, x))), lambda p: p["code"]), "")
    runs = met.select("conv_id", "place", code.alias("code")).groupBy("conv_id", F.shiftright("place", 33).alias("run")).agg(letters("place", "code").alias("code"))
    coded = runs.groupBy("conv_id").agg(letters("run", "code").alias("codes"))
    seen = laid.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    both = coded.join(seen, coded["conv_id"].eqNullSafe(seen["conv_id"])).select(coded["conv_id"], F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "codes")
    out, _ = written(both, "repair-codes")
    dropped(turns.sparkSession, slim_path, laid_path, first_path)
    return out


def _with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs of states (last axis) once turns may be put in there: two at most, as more come back to a state."""
    out = cost.copy()
    out[..., 2] = np.minimum(cost[..., 2], INSERT + cost[..., 3])
    out[..., 3] = np.minimum(cost[..., 3], INSERT + cost[..., 2])
    for s in (0, 1):
        out[..., s] = np.minimum(cost[..., s], INSERT + out[..., 2])
    return out


def _arcs(initial: np.ndarray, fault: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Costs of (delete, keep, rerole) for each state (last axis) of rows, given the costs after them."""
    cut = np.where(fault == 3, CUT, 0)[:, None]
    gone = (fault == 1) | (fault == 2)
    shape = (...,) if after.ndim == 2 else (slice(None), None)
    to = _KEPT[initial]
    picked = np.take_along_axis(after, np.broadcast_to(np.maximum(to, 0)[shape], after.shape), -1)
    keep = np.where((to < 0)[shape] | gone.reshape(-1, *[1] * (after.ndim - 1)), _FAR, KEEP + cut[shape] + picked)
    rerole = np.where(gone.reshape(-1, *[1] * (after.ndim - 1)), _FAR, REROLE + cut[shape] + after[..., _NEXT])
    return [DELETE + after, keep, rerole]


def _units(codes: bytes) -> list[np.ndarray]:
    c = np.frombuffer(codes, np.uint8).astype(np.int64) - 65
    return [c[i : i + UNIT] for i in range(0, len(c), UNIT)]


def _padded(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Units side by side, ends aligned: codes (units, longest) with -1 before a unit's first row."""
    size = np.array([len(u) for u in units])
    out = np.full((len(units), int(size.max(initial=0))), -1, np.int64)
    for k, u in enumerate(units):
        out[k, out.shape[1] - len(u) :] = u
    return out, size


_LAST = np.array([0, _FAR, _FAR, 0])  # only these states may be the last


def _through(units: list[np.ndarray]) -> np.ndarray:
    """(units, 4, 4): the cost from each state before a unit's rows to each state after them, nothing put in after the last."""
    codes, _ = _padded(units)
    cost = np.tile(np.where(np.eye(4, dtype=bool), np.int64(0), _FAR), (len(units), 1, 1))  # (unit, state after, state before)
    for j in range(codes.shape[1] - 1, -1, -1):
        on = np.flatnonzero(codes[:, j] >= 0)
        c = codes[on, j]
        cost[on] = np.minimum(_with_inserts(np.minimum.reduce(_arcs(c & 3, c >> 2, cost[on]))), _FAR)
    return cost.transpose(0, 2, 1)


def _ranked(units: list[np.ndarray], ends: np.ndarray, last: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Doubled pointers and letters of the optimal arcs of units whose costs at the end are known; entry nodes and their costs by state.

    Nodes are (row, state), rows of a unit one after the other and then its end;
    an arc is optimal if its cost and its target's make up the node's own. Each
    node has at most one optimal arc of a letter. Nodes are ranked by their
    first letter, then by their audits' first 2, 4, 8 ... letters: the rank of
    a node and of the node that its pointer has come to, ranked as pairs. By
    those ranks each node takes the arc whose letter and target are least.
    """
    codes, size = _padded(units)
    wide = codes.shape[1] + 1
    node = (np.arange(len(units))[:, None] * wide + np.arange(wide))[..., None] * 4 + np.arange(4)  # (unit, row, state)
    cost = np.empty((len(units), wide, 4), np.int64)
    target = np.full((4, len(units), wide, 4), -1, np.int64)  # by letter: delete, insert, keep, rerole
    cost[:, -1] = np.where(last[:, None], _with_inserts(ends), ends)
    for s in (1, 2):  # after the last row of all, what is missing is put in; ends of other units lead on to the next unit
        on = last & (cost[:, -1, s] == INSERT + cost[:, -1, _NEXT[s]])
        target[1, on, -1, s] = node[on, -1, _NEXT[s]]
    for j in range(wide - 2, -1, -1):
        c = np.maximum(codes[:, j], 0)
        arcs = _arcs(c & 3, c >> 2, cost[:, j + 1])
        cost[:, j] = _with_inserts(np.minimum.reduce(arcs))
        on = (codes[:, j] >= 0)[:, None]
        to = (node[:, j + 1], node[:, j + 1][np.arange(len(units))[:, None], np.maximum(_KEPT[c & 3], 0)], node[:, j + 1][:, _NEXT])
        for letter, arc, t in zip((0, 2, 3), arcs, to):
            target[letter, :, j] = np.where(on & (arc == cost[:, j]), t, -1)
        target[1, :, j] = np.where(on & (INSERT + cost[:, j][:, _NEXT] == cost[:, j]), node[:, j][:, _NEXT], -1)
    target, own = target.reshape(4, -1), node.ravel()
    ends_here = np.all(target < 0, 0)
    letter = np.where(ends_here, 0, np.argmax(target >= 0, 0) + 1)
    pointer = np.where(ends_here, own, np.take_along_axis(target, np.maximum(letter - 1, 0)[None], 0)[0])
    rank, pointers = letter, [pointer]
    while np.any(pointers[-1] != pointers[-1][pointers[-1]]):
        rank = np.unique(rank * (rank.max() + 1) + rank[pointers[-1]], return_inverse=True)[1]
        pointers.append(pointers[-1][pointers[-1]])
    rank = np.unique(rank * (rank.max() + 1) + rank[pointers[-1]], return_inverse=True)[1]
    key = np.where(target >= 0, np.arange(1, 5)[:, None] * (rank.max() + 1) + rank[np.maximum(target, 0)], np.iinfo(np.int64).max)
    best = np.argmin(key, 0)
    letter = np.where(ends_here, 0, best + 1)
    pointers = [np.where(ends_here, own, np.take_along_axis(target, best[None], 0)[0])]
    while np.any(pointers[-1] != pointers[-1][pointers[-1]]):
        pointers.append(pointers[-1][pointers[-1]])
    entry = np.arange(len(units)), wide - 1 - size
    return pointers, letter, node[entry], cost[entry]


def _walks(pointers: list[np.ndarray], letter: np.ndarray, start: np.ndarray) -> list[str]:
    """The letters from some nodes to the ends of their paths: places 2**k and on are those before, 2**k arcs further."""
    path = start[:, None]
    for p in pointers:
        if not letter[path[:, -1]].any():
            break
        path = np.concatenate([path, p[path]], axis=1)
    return [row.tobytes().rstrip(b"\0").decode() for row in _LETTERS[letter[path]]]


def audits(conversations: list[bytes]) -> tuple[list[int], list[str]]:
    """The least cost of each conversation's edits, and of the edits that cost so much the least audit.

    Conversations are cut into units of UNIT rows. For those of several units,
    the costs from every state before a unit to every state after it are found
    for many units side by side; going back over a conversation's units gives
    the costs at each one's end. Going forward, each unit begins in the state
    that the one before it ends in. Conversations are taken by length, so that
    those held side by side are of like length.
    """
    order = sorted(range(len(conversations)), key=lambda k: len(conversations[k]))
    cut = [_units(conversations[k]) for k in order]
    units = [u for own in cut for u in own]
    many = [u for own in cut if len(own) > 1 for u in own]
    through = iter([m for at in range(0, len(many), PRODUCTS) for m in _through(many[at : at + PRODUCTS])])
    ends, last = [], []
    for own in cut:
        after, made = _with_inserts(_LAST), [_LAST] * bool(own)
        for m in [next(through) for _ in own if len(own) > 1][:0:-1]:
            after = np.min(m + after, 1)
            made.append(after)
        ends += made[::-1]
        last += [False] * (len(own) - 1) + [True] * bool(own)
    parts, costs, at, state, begins = [], [], 0, 0, True
    while at < len(units):
        to = longest = 0
        while at + to < len(units) and (not to or (to + 1) * max(longest, len(units[at + to])) <= SOLVED and len(units[at + to]) <= 2 * len(units[at])):
            longest = max(longest, len(units[at + to]))
            to += 1
        pointers, letter, start, cost = _ranked(units[at : at + to], np.array(ends[at : at + to]), np.array(last[at : at + to]))
        leads, states = pointers[-1][start] % 4, np.zeros(to, np.int64)
        for u in range(to):
            states[u] = state
            if begins:
                costs.append(int(cost[u, 0]))
            begins = last[at + u]
            state = 0 if begins else int(leads[u, state])
        parts += _walks(pointers, letter, start[np.arange(to), states])
        at += to
    part, cost = iter(parts), iter(costs)
    made = dict(zip(order, [(next(cost) if own else 0, "".join(next(part) for _ in own)) for own in cut]))
    return [made[k][0] for k in range(len(cut))], [made[k][1] for k in range(len(cut))]


def _solved(codes: pa.Array) -> pa.Array:
    """Counts of faults and of ill-matched neighbours, cost and audit of each conversation's letters."""
    texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in codes]
    costs, found = audits(texts)
    whole = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) - 65
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    count = lambda which, of: np.bincount(of[which], minlength=len(texts)).astype(np.int64)
    ill = (owner[:-1] == owner[1:]) & ~np.isin((whole[:-1] & 3) * 4 + (whole[1:] & 3), _LEGAL)
    columns = [*(count(whole >> 2 == k, owner) for k in (1, 2, 3)), count(ill, owner[1:]), np.array(costs, np.int64)]
    return pa.StructArray.from_arrays([*map(pa.array, columns), pa.array(found, pa.string())], [*FAULTS[1:], "illegal", "cost", "audit"])


_LEGAL = [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]  # su, ua, au


def repairs(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit`` of each conv_id of conversations, from its rows (conv_id, turn, role, text) in turns.

    Rows go by turn, null first, then by role and a digest of their text. The
    first fault of a row counts: blank (nothing but ASCII white space),
    duplicate (role and text said before in the conversation), truncated (the
    last character that isn't such white space is none of .!?). Edits keep a row,
    give it another role (3), delete it (4; the only way for blank and duplicate
    ones) or put an empty turn in (3); truncated rows that stay cost 3 more. The
    roles' initials must come to (s?(ua)+)?. Of the cheapest edits the audit
    least in ASCII is taken. gaps are turns missing between least and greatest.

    Null roles and texts are a space. Rows that repeat are duplicates; rows of a
    null conv_id are one conversation; texts of any length are taken whole; a
    conversation without rows has zeros and an empty audit; an empty table gives
    no rows; other columns aren't looked at, whatever their names.

    A task holds a letter for each row of a conversation, as many as its audit
    has, and solves it in units of bounded size (see audits, _ranked).
    """
    bounded_batches(turns.sparkSession)
    told = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    coded = _codes(told)
    ids = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv_id").alias("id"))
    kind = ", ".join(f"{n} long" for n in (*FAULTS[1:], "illegal", "cost")) + ", audit string"
    met = ids.join(coded, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), F.coalesce("codes", F.lit("")).alias("codes"))
    solved = met.select("conv_id", "gaps", F.arrow_udf(_solved, kind).asNondeterministic()("codes").alias("made")).select("conv_id", "gaps", "made.*")
    return written(solved, "repairs")[0]


def repaired(turns: DataFrame, made: DataFrame) -> DataFrame:
    """``conv_id``, ``nth`` (from 0), ``role`` and ``text`` of turns' conversations after the edits that made (of repairs) names.

    Rows of a conversation follow one another. Whole texts are shuffled once;
    a conversation's rows pass, in order, through one task, which holds a batch
    of them and the audit.
    """
    bounded_batches(turns.sparkSession)
    told = turns.select("conv_id", F.lit(1).alias("kind"), "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(None).cast("string").alias("audit"))
    heads = made.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    order = ("conv_id", "kind", "turn", "role", "digest")
    rows = heads.unionByName(told).withColumn("digest", F.unhex(F.md5("text"))).repartition("conv_id").sortWithinPartitions(*order)
    schema = StructType([turns.schema["conv_id"], StructField("nth", LongType()), StructField("role", StringType()), StructField("text", StringType())])
    return rows.select("conv_id", "role", "text", "audit").mapInArrow(_rewritten, schema)


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, audit, at, nth, state = None, "", 0, 0, 0
    for b in batches:
        out: list[tuple] = []

        def put(role: str, text: str, to: int) -> None:
            nonlocal nth, state
            out.append((own, nth, role, text))
            nth, state = nth + 1, to

        def put_in() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put(ROLES[_NEXT[state]], "", _NEXT[state])
                at += 1

        for conv, role, text, head in zip(*(c.to_pylist() for c in b.columns)):
            if head is not None:
                own, audit, at, nth, state = conv, head, 0, 0, 0
            else:
                edit, at = audit[at], at + 1
                if edit == "K":
                    put(role, text, _KEPT[INITIALS.index(role[:1]), state])
                elif edit == "R":
                    put(ROLES[_NEXT[state]], text, _NEXT[state])
            put_in()
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["conv_id", "nth", "role", "text"])


ROLES = ("", "system", "user", "assistant")  # by the state after a turn


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256`` of conversations whose rows follow one another in a task, as those of repaired do: a running digest, so no text is held."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, running = None, None
        kind = None
        for b in batches:
            kind, done = b.schema.field(0).type, []
            for conv, nth, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if nth == 0:
                    if running:
                        done.append((own, running.hexdigest()))
                    own, running = conv, hashlib.sha256()
                running.update(f"{chr(10) * (nth > 0)}{role}:{text}".encode())
            yield _digested(done, kind)
        if running:
            yield _digested([(own, running.hexdigest())], kind)

    return turns.select("conv_id", "nth", "role", "text").mapInArrow(digest, StructType([turns.schema["conv_id"], StructField("repaired_sha256", StringType())]))


def _digested(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    turns = damaged(chats)
    made = repairs(turns, chats)
    said = digests(repaired(turns, made)).withColumnRenamed("conv_id", "id")
    joined = made.join(said, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _sql_step(state: int) -> str:
    """SQL for the best of (cost, audit, text) in a state before a row, nothing put in: structs compare field by field."""
    nxt = int(_NEXT[state])
    keeps = " ".join(f"WHEN ini = '{INITIALS[i]}' THEN {{c: v{int(_KEPT[i, state])}.c + cut, a: 'K' || v{int(_KEPT[i, state])}.a, t: chr(10) || role || ':' || text || v{int(_KEPT[i, state])}.t}}" for i in range(3) if _KEPT[i, state] >= 0)
    none = "{c: 1000000000, a: '', t: ''}"
    return _least(
        f"{{c: {DELETE} + v{state}.c, a: 'D' || v{state}.a, t: v{state}.t}}",
        f"CASE WHEN gone THEN {none} {keeps} ELSE {none} END",
        f"CASE WHEN gone THEN {none} ELSE {{c: {REROLE} + cut + v{nxt}.c, a: 'R' || v{nxt}.a, t: chr(10) || '{ROLES[nxt]}:' || text || v{nxt}.t}} END",
    )


def _sql_insert(v: str, role: str) -> str:
    return f"{{c: {INSERT} + {v}.c, a: 'I' || {v}.a, t: chr(10) || '{role}:' || {v}.t}}"


_SQL_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
SQL = f"""
    WITH RECURSIVE {crc32_sql(f"SELECT DISTINCT {_SQL_KEY} AS s FROM conversations")},
    k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc.crc % 20 AS k FROM conversations JOIN crc ON crc.s = {_SQL_KEY}),
    d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM k, (VALUES (1), (2)) n(n) WHERE k <> 0 AND (n = 1 OR k = 3)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS told, left(role, 1) AS ini FROM d),
    f AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS pre,
                 CASE WHEN told = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(told, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
    c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                 count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND pre || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
    v(conv_id, i, v0, v1, v2, v3) AS (
        SELECT conv_id, n + 1, {{c: 0, a: '', t: ''}}, {_sql_insert(_sql_insert("{c: 0, a: '', t: ''}", "assistant"), "user")}, {_sql_insert("{c: 0, a: '', t: ''}", "assistant")}, {{c: 0, a: '', t: ''}} FROM c
        UNION ALL
        SELECT conv_id, i, {_least("b0", _sql_insert("w2", "user"))}, {_least("b1", _sql_insert("w2", "user"))}, w2, {_least("b3", _sql_insert("b2", "user"))}
        FROM (SELECT *, {_least("b2", _sql_insert("b3", "assistant"))} AS w2 FROM (
            SELECT conv_id, i, {", ".join(f"{_sql_step(s)} AS b{s}" for s in range(4))}
            FROM (SELECT f.*, v0, v1, v2, v3, fault IN (1, 2) AS gone, CASE fault WHEN 3 THEN {CUT} ELSE 0 END AS cut FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i - 1)))
    )
    SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(substr(v0.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM a.conv_id AND v.i = 1
"""
