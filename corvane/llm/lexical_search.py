"""Operator 11: ranked lexical search by an Aho-Corasick scan of whole texts, without an index of the documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from corvane.llm.common import bounded_batches, table, written

TOP = 20
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 17  # most items of a block, and distinct terms unless one item has more
SCORES = 1 << 21  # scores held at a time
# Bytes that part terms become spaces, A-Z become a-z; all others, those of non-ASCII characters too, stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def spaced(text: str | None) -> bytes:
    """A text's terms, in lower case, between spaces."""
    return b" " + (text or "").encode().translate(_TERM_BYTES) + b" "


def terms_of(text: str | None) -> list[str]:
    return [t.decode() for t in spaced(text).split()]


@dataclass
class Block:
    """A bounded number of items: their terms, and for each term the items that have it and how often (lists by start, as in owner[start[t] : start[t + 1]])."""

    terms: list[str]
    start: np.ndarray
    owner: np.ndarray
    repeats: np.ndarray
    items: int
    weight: np.ndarray | None = None
    docs: int = 0
    all_terms: int = 0
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # each worker makes its own, once

    @property
    def automaton(self) -> ahocorasick.Automaton:
        """Matches whole terms only: each pattern is a term with a space on both sides, and terms in a text share the space between them."""
        if self._automaton is None:
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, t in enumerate(self.terms):
                made.add_word(f" {t} ", k)
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def found(self, raw: bytes) -> np.ndarray:
        """Numbers of the terms in a spaced text, one for each occurrence, in order."""
        return np.fromiter(map(itemgetter(1), self.automaton.iter(raw.decode())), np.int64) if self.terms else np.zeros(0, np.int64)


def block_of(texts: list[list[str]]) -> Block:
    counts = [Counter(t) for t in texts]
    names = sorted(set().union(*counts))
    number = {t: k for k, t in enumerate(names)}
    rows = sorted((number[t], i, n) for i, c in enumerate(counts) for t, n in c.items())
    each = np.array(rows, np.int64).reshape(-1, 3)
    return Block(names, np.searchsorted(each[:, 0], np.arange(len(names) + 1)), each[:, 1].copy(), each[:, 2].copy(), len(texts))


def blocks_of(rows: Iterable[Row]) -> Iterator[tuple[list, Block]]:
    """(ids, block) of items (item_id, text), of bounded size each."""
    ids, texts, seen = [], [], set()
    for r in rows:
        own = terms_of(r.text)
        if ids and (len(ids) == BLOCK_ITEMS or len(seen.union(own)) > BLOCK_TERMS):
            yield ids, block_of(texts)
            ids, texts, seen = [], [], set()
        ids.append(r.item_id)
        texts.append(own)
        seen.update(own)
    if ids:
        yield ids, block_of(texts)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text"):
        yield spaced(x.as_py())


def _statistics(docs: DataFrame, block: Block) -> Block:
    """The block with its terms' weights, from document counts over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held, docs_with, all_terms = np.zeros(len(own.terms), np.int64), 0, 0
        for b in batches:
            for raw in _texts(b):
                n = len(raw.split())
                docs_with += n > 0
                all_terms += n
                held[np.unique(own.found(raw))] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(held[some], [docs_with, all_terms]))], ["term", "n"])

    summed = {r.term: r.n for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    shared.unpersist()
    n = summed.get(-1, 0)
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * summed.get(k, 0) + 1))) for k in range(len(block.terms))]
    return Block(block.terms, block.start, block.owner, block.repeats, block.items, np.array(weight, np.int64), n, summed.get(-2, 0))


def _scores(block: Block, raws: list[bytes]) -> np.ndarray:
    """Scores (texts, items) of spaced texts, in 64-bit numbers throughout."""
    out = np.zeros((len(raws), block.items), np.int64)
    found = [block.found(raw) for raw in raws]
    at, tf = np.unique(np.repeat(np.arange(len(raws)), [len(f) for f in found]) * len(block.terms) + np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
    if not len(at):
        return out
    doc, term = np.divmod(at, len(block.terms))
    length = np.array([75 + 25 * len(raw.split()) * block.docs // block.all_terms for raw in raws], np.int64)
    gain = block.weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * length[doc]))
    size = block.start[term + 1] - block.start[term]
    each = np.repeat(block.start[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    np.add.at(out.ravel(), np.repeat(doc, size) * block.items + block.owner[each], np.repeat(gain, size) * block.repeats[each])
    return out


def _best(docs: DataFrame, block: Block, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each item, at most top for each task."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        rows = max(1, SCORES // max(1, own.items))
        items, scores, places = (np.zeros(0, np.int64) for _ in range(3))
        ids = pa.array([], id_type)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                made = _scores(own, list(_texts(part)))
                least = np.zeros(own.items, np.int64)  # the lowest score of each item that is already full
                np.maximum.at(least, items[places == top - 1], scores[places == top - 1])
                doc, item = np.nonzero((made > 0) & (made >= least))
                items, scores = np.append(items, item), np.append(scores, made[doc, item])
                ids = pa.concat_arrays([ids, part.column("doc_id").take(pa.array(doc))])
                by_id = np.empty(len(ids), np.int64)
                by_id[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                order = np.lexsort((by_id, -scores, items))
                first = np.concatenate([[True], np.diff(items[order]) != 0])[: len(order)]
                place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
                order, places = order[place < top], place[place < top]
                items, scores, ids = items[order], scores[order], ids.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([pa.array(items), ids, pa.array(scores)], ["item", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(search, f"item long, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id``, ``rank`` (int, from 1), ``doc_id`` and ``score``: each item's best documents with a score above 0.

    Terms are runs of letters and digits of ASCII and of any other characters
    beyond it, A-Z in lower case. N documents have a term, L terms are in all; a
    term in df documents weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a
    document of n terms has m = 75 + 25 n N div L. Its score sums w (10^9 tf div
    (1000 tf + 12 m)) over the item's terms, repeats included. Equal scores go
    by doc_id, null last.

    Items are taken in blocks of bounded size, as they come; a block's terms
    make one automaton, which is broadcast. Each block reads all texts twice:
    once for document counts, once for scores. No text, term or posting of a
    document is stored or shuffled; a task holds the best of each item, and
    what it returns is ranked in two steps, so that no task gets all of it.

    Null and empty texts have no terms, so no rows; texts of any length are
    scanned whole. Rows that repeat, documents or items, count as rows of their
    own. Empty tables give no rows; other columns aren't looked at, whatever
    their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = []
    salts = math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    kind = items.schema["item_id"].dataType.simpleString()
    numbered = items.select("item_id", "text")
    for ids, block in blocks_of(numbered.toLocalIterator()):
        found = _best(docs, _statistics(docs, block), top)
        by = (F.desc("score"), F.asc_nulls_last("doc_id"))
        nth = F.row_number().over(Window.partitionBy("item", "salt").orderBy(*by))
        some = found.withColumn("salt", F.spark_partition_id() % salts).withColumn("nth", nth).where(F.col("nth") <= top)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(ids)), f"number long, item_id {kind}")  # of one block
        named = best.join(F.broadcast(names), F.col("item") == F.col("number")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        parts.append(written(named, "ranked")[0])
    if not parts:
        return docs.select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
    WITH i AS (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS terms FROM benchmark),
    q AS (SELECT k, item_id, unnest(terms) AS term FROM i),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
    a AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
    p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY term, n_docs),
    m AS (SELECT r, doc_id, 75 + (25 * len(terms) * n_docs) // n_terms AS m FROM d, a WHERE len(terms) > 0),
    s AS (SELECT k, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
          FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY k, item_id, r, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
