import hashlib
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF, connect, same

from corvane.llm import turn_repair as module
from corvane.llm.turn_repair import audits, damaged, digests, op13_turn_repair, repaired, repairs

SPACE = " \t\n\x0b\x0c\r"
FINAL = re.compile(r"(s?(ua)+)?")


def best_edits(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault) by plain recursion over suffixes and the last role put out."""

    @lru_cache(None)
    def best(i, said, put_in):
        options = []
        if i == len(rows) and said in ("", "a"):
            options.append((0, "", ()))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[said]
        if i < len(rows):
            role, text, fault = rows[i]
            options.append(add(4, "D", None, best(i + 1, said, 0)))
            if fault not in ("blank", "duplicate"):
                cut = 3 * (fault == "truncated")
                if role[:1] and role[:1] in follows:
                    options.append(add(cut, "K", (role, text), best(i + 1, role[:1], 0)))
                for new in ("user", "assistant"):
                    if new[0] in follows:
                        options.append(add(3 + cut, "R", (new, text), best(i + 1, new[0], 0)))
        if put_in < 3:
            for new in ("user", "assistant"):
                if new[0] in follows:
                    options.append(add(3, "I", (new, ""), best(i, new[0], put_in + 1)))
        return min(options, default=(10**9, "", ()))

    def add(cost, letter, row, rest):
        return (cost + rest[0], letter + rest[1], ((row,) if row else ()) + rest[2])

    return best(0, "", 0)


def brute(rows):
    """Result rows by the definition, of rows (conv_id, turn, role, text) before damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        out[conv] = result(own)
    return out


def result(own):
    own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in own:
        told = text.rstrip(SPACE)
        faults.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    cost, audit, kept = best_edits(tuple((role, text, f) for (_, role, text), f in zip(own, faults)))
    assert FINAL.fullmatch("".join(r[0] for r, _ in kept))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_query_matches_sql(spark):
    same(op13_turn_repair(spark, SF), module.SQL, connect())


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op13_turn_repair(spark, SF)) == brute(rows)


def plain(codes):
    return best_edits(tuple(("suax"[(c - 65) & 3], "t", ("", "blank", "duplicate", "truncated")[(c - 65) >> 2]) for c in codes))[:2]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(65, 80), max_size=14).map(bytes), max_size=5), st.sampled_from([1, 2, 5, 4096]))
def test_least_audits(conversations, unit):
    whole, module.UNIT = module.UNIT, unit
    try:
        assert list(zip(*audits(conversations))) == [plain(c) for c in conversations]
    finally:
        module.UNIT = whole


def test_every_short_conversation():
    """All sequences of up to three rows of each initial and fault, in one call."""
    made = [bytes(c) for n in range(3) for c in product(range(65, 81), repeat=n)] + [bytes(c) for c in product(b"ABCFGMNO", repeat=3)]
    assert list(zip(*audits(made))) == [plain(c) for c in made]


def test_ties_of_different_lengths(monkeypatch):
    """Three deletions cost as much as four turns put in, so equal costs come with audits of different lengths."""
    made = [bytes(c) for c in product(b"BCN", repeat=6)]
    monkeypatch.setattr(module, "UNIT", 4)
    monkeypatch.setattr(module, "SOLVED", 64)
    assert list(zip(*audits(made))) == [plain(c) for c in made]


def test_long_conversations():
    """Far more rows than a unit has: units meet, and the work is shared among few large arrays."""
    costs, found = audits([b"BC" * 30_000, b"ABC" + b"BB" * 5000 + b"C", b"B" * 9000])
    assert costs == [0, 3 * 4999 + 3, 3 * 9000 // 2]
    assert found[0] == "K" * 60_000 and len(found[1].replace("I", "")) == 10_004 and len(found[2].replace("I", "")) == 9000


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi there."), (1, 2, "assistant", "Hello!"), (1, 4, "user", "no end"), (1, None, "user", "null turn?"), (1, None, None, "null role."),
    (2, 0, "assistant", None), (2, 1, None, None), (2, None, None, None), (None, 0, "user", "x."), (None, 1, "assistant", "y."), (None, 1, "assistant", "y."), (3, 5, "user", "z" * 300_000 + "."),
    (4, 0, "", "empty role."), (4, 0, "tool", "tie."), (4, 0, "tool", "tie b."), (5, -3, "user", " "), (5, 2**40, "assistant", "far.\t\n "), (6, 0, "user", ""), *((7, k, "user", "same.") for k in range(40)),
]


@pytest.mark.parametrize("partitions", [1, 5])
def test_odd_rows(spark, tmp_path, partitions):
    schema = "conv_id long, turn long, role string, text string, audit string, place string, said string"
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in ODD], schema).repartition(partitions)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(op13_turn_repair(spark, str(tmp_path))) == brute(ODD)
    made = connect(SF)
    made.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    same(op13_turn_repair(spark, str(tmp_path)), module.SQL, made)
    assert repairs(damaged(df.limit(0)), df.limit(0)).count() == 0


def test_undamaged_rows_and_their_repair(spark):
    """The operator itself takes any rows; what it puts out is read by a user, not only digested."""
    rows = [("a", 0, "user", "One."), ("a", 1, "user", "Two."), ("b", 0, "assistant", "Three."), ("c", 0, "system", "Only.")]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    made = repairs(turns, turns.select("conv_id").union(spark.sql("SELECT 'd'")))
    assert {r.conv_id: (r.cost, r.audit) for r in made.collect()} == {"a": (3, "KR"), "b": (3, "IK"), "c": (4, "D"), "d": (0, "")}
    said = repaired(turns, made)
    assert sorted(map(tuple, said.collect())) == [("a", 0, "user", "One."), ("a", 1, "assistant", "Two."), ("b", 0, "user", ""), ("b", 1, "assistant", "Three.")]
    assert {r.conv_id: r.repaired_sha256 for r in digests(said).collect()} == {"a": hashlib.sha256(b"user:One.\nassistant:Two.").hexdigest(), "b": hashlib.sha256(b"user:\nassistant:Three.").hexdigest()}


def test_a_conversation_of_most_rows_is_split(spark):
    """Its rows are laid in several runs, which are put together in order."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)] + [(c, 0, "user", "x.") for c in range(2, 50)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    kept = []
    real, module.dropped = module.dropped, lambda spark, *paths: kept.extend(paths)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (r,) = repairs(turns, turns).where("conv_id = 1").collect()
        laid = spark.read.parquet(next(p for p in kept if "repair-order" in p)).where("conv_id = 1").selectExpr("shiftright(place, 33) AS run").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        module.dropped = real
    assert laid > 1 and (r.cost, r.audit, r.duplicate, r.illegal) == (0, "K" * 3000, 0, 0)
