from collections import Counter

import pytest
from pyspark.sql import functions as F
from oracle import SF, connect, same

from corvane.llm import line_dedup as module
from corvane.llm.line_dedup import line_dedup, mark_repeated_lines, op10_line_dedup


def kept(spark, rows):
    out = mark_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.row.doc_id: (r.kept_text, r.n_lines, r.n_removed) for r in out}


def test_query_matches_sql(spark):
    same(op10_line_dedup(spark, SF), module.SQL, connect())


def test_first_occurrence_stays(spark):
    rows = [(2, "x\na\nb\nc\nd\ny"), (1, "a\nb\nc\nd"), (3, "a\nb\nq\nb\nc"), (4, "p\na\nb\nc")]
    assert kept(spark, rows) == {1: ("a\nb\nc\nd", 4, 0), 2: ("x\ny", 6, 4), 3: ("a\nb\nq\nb\nc", 5, 0), 4: ("p", 4, 3)}


def test_repeats_within_a_document(spark):
    assert kept(spark, [(1, "\n".join("aaaaaa"))]) == {1: ("a\na\na", 6, 3)}
    assert kept(spark, [(1, "a\nb\nc\nz\na\nb\nc\n")]) == {1: ("a\nb\nc\nz\n", 8, 3)}


def test_copies_do_not_shield_passages(spark):
    for n in (3, 4, 10):
        passage = [f"passage {i}" for i in range(n)]
        host = "\n".join(["a", "b", *passage, "c", "d"])
        for copies in ([], [(3, host)]):
            out = kept(spark, [(1, "\n".join(passage)), (2, host), *copies])
            assert out[1][2] == 0 and out[2] == ("a\nb\nc\nd", n + 4, n)
            assert all(out[i] == ("", n + 4, n + 4) for i, _ in copies)
    inner = "a\nb\nc\nz\na\nb\nc\nq"  # repeats its own lines
    assert kept(spark, [(1, inner), (2, inner)]) == {1: ("a\nb\nc\nz\nq", 8, 3), 2: ("", 8, 8)}
    both = "\n".join(["x", "p", "q", "r", "s", "y"] * 2)  # a passage of another document, twice, with the same lines around it
    assert kept(spark, [(1, "p\nq\nr\ns"), (2, both)])[2][0] == "x\ny"


def test_bitmaps_tell_marked_places(spark):
    size = 1 << 17
    marked = {*range(0, 300, 7), 32767, 32768, 65535, 65536, size - 1}
    marks = module._marks(spark.createDataFrame([(x,) for x in marked], "p long"), F.col("p"))
    met = spark.range(size).join(marks, F.shiftright("id", module.CHUNK_BITS) == F.col("chunk"), "left")
    assert {r.id for r in met.where(module._is_marked(F.col("id"))).collect()} == marked


def test_untouched_texts_pass_by(spark, tmp_path):
    rows = [(i, f"a {i}\nb {i}\nc {i}\nd", "y") for i in range(500)] + [(1000 + i, "p\nq\nr\ns\nt", "y") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, chunk string").write.parquet(f"{tmp_path}/d")
    out = mark_repeated_lines(spark.read.parquet(f"{tmp_path}/d")).collect()
    assert {r.row.doc_id: r.n_removed for r in out if r.n_removed} == {1001: 5, 1002: 5} and len(out) == 503
    assert all(r.kept_text == r.row.text and r.n_lines == 4 for r in out if r.row.doc_id < 1000)


def test_odd_rows(spark, odd_docs, no_docs):
    out = mark_repeated_lines(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by_text = {(r.row.doc_id, r.row.text): r for r in out}
    shared = "one two three four five six\nseven\neight\nnine"
    # Its first window is its own, though the row is there twice; its second one is in document -5 already.
    assert by_text[1, shared].n_removed == 3 and by_text[1, shared].kept_text == "one two three four five six"
    assert by_text[3, None].kept_text is None and by_text[3, None].n_lines == 0
    assert by_text[2, ""].kept_text == "" and by_text[2, ""].n_lines == 1
    assert by_text[5, "\n\n\n\n"].kept_text == "\n\n" and by_text[5, "\n\n\n\n"].n_removed == 2
    kept_docs = line_dedup(odd_docs)
    assert kept_docs.columns == odd_docs.columns and kept_docs.count() == odd_docs.count()
    assert mark_repeated_lines(no_docs).count() == 0 and line_dedup(no_docs).count() == 0


def test_null_ids_come_last_and_emptied_documents_go(spark):
    text = "some line\nnext line\nlast line"
    rows = [(None, text), (5, text), (7, text), (8, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.row.doc_id: r.n_removed for r in mark_repeated_lines(df).collect()}
    assert out == {None: 3, 5: 0, 7: 3, 8: 0, 9: 0}
    assert sorted(r.doc_id for r in line_dedup(df).collect()) == [5, 8, 9]


def brute(docs):
    """(doc_id, lines lost, text left) of each row by the definition."""
    own = {(i, t): (t or "").split("\n") for i, t in docs}
    at = [(i, t, k, tuple(lines[k : k + 3])) for (i, t), lines in own.items() if t is not None for k in range(len(lines) - 2)]
    first = {}
    for i, _, _, w in at:
        first[w] = min(first.get(w, (True, 0)), (i is None, i or 0))
    out = []
    for i, t in docs:
        mine = [(k, w) for j, u, k, w in at if (j, u) == (i, t)]
        places = {w: [k for k, v in mine if v == w] for _, w in mine}
        elsewhere = {w for _, w in mine if first[w] != (i is None, i or 0)}
        cover = lambda ks: {k + d for k in ks for d in range(3)}
        gone = cover(k for k, w in mine if w in elsewhere)
        gone |= cover(k for k, w in mine if w not in elsewhere and k > places[w][0]) - cover(p[0] for w, p in places.items() if w not in elsewhere and len(p) > 1)
        out.append((i, len(gone), t if not gone else "\n".join(x for k, x in enumerate(own[i, t]) if k not in gone)))
    return Counter(out)


def removed(df):
    return Counter((r.row.doc_id, r.n_removed, r.kept_text) for r in mark_repeated_lines(df).collect())


def run_sql(tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    made = connect()
    made.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return Counter((r[0], r[2], r[3]) for r in made.execute(module.SQL).fetchall())


PASSAGE = [f"passage {i}" for i in range(4)]
HOST = "\n".join(["a", "b", *PASSAGE, "c", "d"])


def test_rows_that_repeat_lose_what_one_would(spark, tmp_path):
    for n in (1, 2, 3):
        rows = [(1, "\n".join(PASSAGE)), *[(2, HOST)] * n]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert removed(df) == brute(rows) == Counter({(1, 0, "\n".join(PASSAGE)): 1, (2, 4, "a\nb\nc\nd"): n})
        assert run_sql(tmp_path / str(n), df) == brute(rows)
        assert sorted(map(tuple, line_dedup(df).collect())) == sorted([(1, "\n".join(PASSAGE)), *[(2, "a\nb\nc\nd")] * n])


@pytest.mark.parametrize("partitions", [1, 6])
def test_brute_force_on_odd_rows(spark, odd_docs, tmp_path, partitions):
    more = [(2, HOST), (2, HOST), (2, "\n".join(PASSAGE)), (None, HOST), (None, HOST), (None, "a\na\na\na\na"), (50, "a\na\na\na\na\nq"), (50, "x\ny\nz\nx\ny\nz"), (50, "x\ny\nz\nx\ny\nz"), (51, "y\nz\nx\ny")]
    df = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(partitions)
    rows = [tuple(r) for r in df.collect()]
    assert removed(df) == brute(rows) == run_sql(tmp_path, df)


def test_a_window_of_most_documents_is_split(spark, tmp_path):
    """The join on a window that all texts share is one that Spark divides among tasks."""
    spark.range(20_000).selectExpr("id AS doc_id", "concat('p\nq\nr\nown ', id) AS text").repartition(8).write.parquet(f"{tmp_path}/d")
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        removals = module._removals(spark.read.parquet(f"{tmp_path}/d"))
        assert removals.count() == 19_999
        removals.collect()
        assert "SortMergeJoin(skew=true)" in removals._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
