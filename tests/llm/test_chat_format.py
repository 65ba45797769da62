import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from oracle import SF, connect, same
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.llm import chat_format
from corvane.llm.chat_format import LAYOUTS, ROW_LAYOUTS, TRICKY, canonical_turns, digests, escape, field_paths, format_chats, op9_chat_format, read_back, unescape, value_paths, _udf


def test_query_matches_sql(spark):
    same(op9_chat_format(spark, SF), chat_format.SQL, connect())


@given(st.text(st.sampled_from("<|^>ab\n")))
def test_escaping_turns_back(text):
    assert unescape(escape(text)) == text
    assert "<|" not in escape(text)


def test_tricky_conversation(spark):
    rows = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY), (-1, 2, "assistant", "<^|<^^|<")], "conv_id long, turn long, role string, text string")
    out = format_chats(canonical_turns(rows))
    r = out.withColumn("back", _udf(read_back, f"turns {chat_format.TURNS}, loss string")("formatted", "loss")).first()
    assert [tuple(t) for t in r.back.turns] == [("user", TRICKY), ("assistant", TRICKY), ("assistant", "<^|<^^|<")]
    assert r.back.loss == TRICKY + "<^|<^^|<"
    assert r.formatted.count("<|im_start|>") == 3


RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"content": None, "role": "system"}]}, [("system", "")]),
    ({"messages": []}, []),
    ({"turns": [{"role": "human", "text": "é"}]}, [("user", "é")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": 5}]}, [("user", "q"), ("assistant", "5")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"response": "r", "prompt": "p"}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": None}, [("user", "i"), ("assistant", "")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"unheard": "of"}, None),
    ({"id": 1, "messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "bot", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"meta": {"tags": []}, "prompt": "p", "completion": {}}, [("user", "p"), ("assistant", "{}")]),
    ({"id": 1, "turns": []}, []),
    ({"messages": [{"role": "user"}, {"content": "x"}, None, {}]}, [("user", ""), ("", "x"), ("", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "parts"}]}]}, None),
    ({"prompt": "p", "completion": "c", "response": "r"}, None),
    ({"prompt": "p", "messages": [{"role": "user", "content": "a"}]}, [("user", "a")]),
    ({"prompt": "p", "completion": "c", "messages": [{"role": "user", "content": "a"}]}, [("user", "a")]),
    ({"prompt": "p", "instruction": "i", "input": "x", "output": "o", "turns": []}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"messages": [{"role": "user", "content": "a"}], "turns": [{"role": "user", "text": "b"}]}, None),
    ({"messages": None}, None),
    ("not an object", None),
]


def test_layouts_row_by_row(spark):
    texts = [json.dumps(r) for r, _ in RECORDS] + ["{broken", "", None, '{"prompt": NaN, "completion": ""}', "[" * 100_000, '{"prompt": "\\ud800", "completion": "c"}']
    df = spark.createDataFrame([(*r, "x") for r in enumerate(texts)], "conv_id long, record string, turns string")
    rows = canonical_turns(df).orderBy("conv_id").collect()
    got = [None if r.turns is None else [tuple(x) for x in r.turns] for r in rows]
    assert got == [t for _, t in RECORDS] + [None] * 5 + [[("user", "\ufffd"), ("assistant", "c")]]
    assert {r.layout for r in rows} == {x.name for x in LAYOUTS} | {None}
    assert all((r.layout is None) == (r.turns is None) for r in rows)
    formatted = {r.conv_id: r.formatted for r in format_chats(canonical_turns(df)).collect()}
    assert formatted[2] == "" and formatted[10] is None and formatted[0].startswith("<|im_start|>user")


def kind_of(layout):
    if layout.turns:
        top, role, text = layout.turns
        return StructType.fromDDL(f"{top} array<struct<{role}: string, {text}: string>>")
    return StructType.fromDDL(", ".join(f"{p} string" for p in layout.paths))


@pytest.mark.parametrize("layout", LAYOUTS, ids=lambda x: x.name)
def test_layouts_by_type(spark, layout):
    record, turns = next((r, t) for r, t in RECORDS if isinstance(r, dict) and t and set(r) == {p.split("[")[0] for p in layout.paths})
    kind = kind_of(layout)
    assert sorted(field_paths(kind)) == sorted(layout.paths) == sorted(value_paths(record))
    for extra in (False, True):  # fields of no layout are left aside
        own = StructType.fromDDL("id long, meta struct<a: array<int>>") if extra else StructType([])
        df = spark.createDataFrame([(1, json.dumps(record))], "conv_id long, r string").select("conv_id", F.from_json("r", StructType([*kind, *own])).alias("record"))
        assert format_chats(canonical_turns(df)).first().formatted == "".join(f"<|im_start|>{r}<|im_sep|>{t}<|im_end|>\n" for r, t in turns)


def test_rows_by_their_columns(spark):
    df = spark.createDataFrame([(7, 2, "bot", "b", "x"), (7, 1, "human", "a", "x")], "conversation_id long, message_id long, role string, content string, `a.b` string")
    (r,) = canonical_turns(df).collect()
    assert (r.conv_id, r.layout, [tuple(t) for t in r.turns]) == (7, "message_rows", [("user", "a"), ("assistant", "b")])
    with pytest.raises(ValueError):
        canonical_turns(df.drop("role"))


COLUMNS = sorted({p.split("[")[0] for x in LAYOUTS for p in x.paths} | {p for x in ROW_LAYOUTS for p in x.paths} | {"record", "layout", "turn", "m", "nth", "made", "read"})


@pytest.mark.parametrize("layout", ROW_LAYOUTS, ids=lambda x: x.name)
def test_columns_of_other_layouts_change_nothing(spark, layout):
    key, nth, role, text = layout.rows
    rows = [(1, 1, "gpt", "b"), (1, 0, "human", "a"), (None, 0, "user", "c"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, f"{key} long, {nth} long, {role} string, {text} string")
    want = sorted(map(repr, canonical_turns(df).collect()))
    assert len(want) == 3
    own = [c for c in COLUMNS if c not in layout.rows]
    together = own if layout is ROW_LAYOUTS[0] else [c for c in own if c not in ROW_LAYOUTS[0].paths]
    for extra in (*([c] for c in own), together):
        for value in (F.lit('{"prompt": "p", "completion": "c"}'), F.lit(None).cast("array<struct<role: string, content: string>>")):
            assert sorted(map(repr, canonical_turns(df.withColumns({c: value for c in extra})).collect())) == want


def test_mappings_decide_in_the_query(spark, monkeypatch):
    whole = {r.conv_id: r for r in op9_chat_format(spark, SF).collect()}
    assert whole[-1].n_turns == 2
    monkeypatch.setattr(chat_format, "LAYOUTS", tuple(x for x in LAYOUTS if x.name != "messages"))
    without = {r.conv_id: r for r in op9_chat_format(spark, SF).collect()}
    assert without.pop(-1).n_turns is None
    assert all(whole[k] == r for k, r in without.items())
    monkeypatch.setattr(chat_format, "ROW_LAYOUTS", ROW_LAYOUTS[1:])
    with pytest.raises(ValueError):
        op9_chat_format(spark, SF)


def test_unknown_type_is_an_error(spark):
    with pytest.raises(ValueError):
        canonical_turns(spark.createDataFrame([(1, (2,))], "conv_id long, record struct<x: long>"))


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "x"), (None, 0, None, None), (1, None, "user", "null turn first"), (1, 0, "user", "tie b"), (1, 0, "user", "tie a"), (1, 0, "user", "tie a"),
        (2, 0, "assistant", "z" * 300_000), (3, 0, "user", ""),
    ]
    df = spark.createDataFrame([(*r, "m", "made") for r in rows], "conv_id long, turn long, role string, text string, m string, made string")
    got = {r.conv_id: r for r in digests(format_chats(canonical_turns(df))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 2, 1: 4, 2: 1, 3: 1}
    assert got[2].loss_chars == 300_000 and got[3].loss_chars == 0
    turns = canonical_turns(df).where("conv_id = 1").first().turns
    assert [m.text for m in turns] == ["null turn first", "tie a", "tie a", "tie b"]
    assert digests(format_chats(canonical_turns(df.limit(0)))).count() == 0
