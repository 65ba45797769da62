"""Operator 5: secret spans and multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import table, written

SCOPE = 200  # code points between the end of one part of a credential and the start of the next


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + f"|{_any_case('api')}_?{_any_case('key')}"
_USERS = "|".join(map(_any_case, ("user", "username", "login", "account"))) + f"|{_any_case('client')}_?{_any_case('id')}"
_GIVEN = """["']?\\x20*[:=]\\x20*["']?"""
#: Kinds in the order used for equal starts: pattern, least length of the measured group, greatest (0: any), measured group.
#: The first three always count; the others are weak candidates that need complementary parts nearby.
KINDS: dict[str, tuple[str, int, int, int]] = {
    "assign": (f"({_NAMES}){_GIVEN}([A-Za-z0-9+/_.=-]+)", 8, 0, 2),
    "access": ("AKIA[A-Z0-9]+", 16, 0, 0),
    "hex": ("[0-9a-f]{32,}", 32, 0, 0),  # whole runs of 32 or more: those that [0-9a-f]+ finds and the length keeps
    "user": (f"({_USERS}){_GIVEN}([A-Za-z0-9._@-]+)", 3, 0, 2),
    "key": ("[A-Za-z0-9/+]{40,}", 40, 40, 0),
    "endpoint": ("https?://[^\\x20\\x09-\\x0D\"'<>]+", 12, 0, 0),
}
BASE = ("assign", "access", "hex")
_NUMBER = {k: i for i, k in enumerate(KINDS)}
_ANY_BASE = f"({_NAMES}){_GIVEN}[A-Za-z0-9+/_.=-]{{8}}|AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}"


def _hits(text: Column, kind: str) -> Column:
    """Matches of one kind, in order: the code points before each since the one before it, its own, and whether it counts."""
    pattern, least, most, group = KINDS[kind]
    p = F.lit(pattern)
    both = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("value")
    )
    counts = lambda n: (n >= least) & (n <= most) if most else n >= least
    return F.transform(
        F.filter(both, lambda x: x["hit"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(_NUMBER[kind]).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), counts(F.length(x["value"])).alias("ok")
        ),
    )


def _spans(found: DataFrame) -> DataFrame:
    """(id, twin, kind, start, end) of every match that counts, once for rows that repeat."""
    rows = found.select("id", "twin", F.explode("hits").alias("h")).select("id", "twin", "h.*").dropDuplicates(["id", "twin", "kind", "nth"])
    so_far = Window.partitionBy("id", "twin", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return ends.where("ok").select("id", "twin", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _linked(spans: DataFrame) -> DataFrame:
    """Weak spans with the parts that make a credential of them within SCOPE.

    A user name needs an assigned or hexadecimal secret; a bare 40-character
    key needs an access identifier, and must not lie in a base span; an
    endpoint needs a secret and an identifier. What counts is the gap between
    two spans, not their lengths. Parts meet by an equi-join on document and
    stretch of SCOPE code points: a weak span is in each that it covers, a part
    also in those that lie up to SCOPE before and after it. A stretch holds few
    spans however long the document is, and a span as many rows as its length asks.
    """
    n_base = len(BASE)
    stretches = lambda first, last: F.sequence(F.floor(first / SCOPE), F.floor(last / SCOPE))
    part = spans.where(F.col("kind") != _NUMBER["endpoint"]).select(
        F.col("id").alias("p_id"), F.col("twin").alias("p_twin"), F.col("kind").alias("p_kind"), F.col("start").alias("p_start"), F.col("end").alias("p_end"),
        F.explode(stretches(F.col("start") - SCOPE, F.col("end") + SCOPE)).alias("stretch"),
    )
    weak = spans.where(F.col("kind") >= n_base).withColumn("stretch", F.explode(stretches(F.col("start"), F.col("end"))))
    near = (F.col("p_start") - F.col("end") <= SCOPE) & (F.col("start") - F.col("p_end") <= SCOPE)
    met = weak.join(part, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("twin") == F.col("p_twin")) & (weak["stretch"] == part["stretch"]) & near)
    is_kind = lambda *names: F.coalesce(F.bool_or(F.col("p_kind").isin([_NUMBER[n] for n in names])), F.lit(False))
    flags = met.groupBy("id", "twin", "kind", "start", "end").agg(
        is_kind("assign", "hex").alias("secret"), is_kind("access").alias("access"), is_kind("access", "user").alias("name"),
        F.bool_or((F.col("p_kind") < n_base) & (F.col("p_start") < F.col("end")) & (F.col("start") < F.col("p_end"))).alias("inside"),
    )
    of = lambda name: F.col("kind") == _NUMBER[name]
    keep = (of("user") & F.col("secret")) | (of("key") & F.col("access")) | (of("endpoint") & F.col("secret") & F.col("name"))
    return flags.where(keep & ~F.col("inside")).select("id", "twin", "kind", "start", "end")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (array of (start, kind number, end)) for each input row, in no fixed order.

    Positions are code points, ends exclusive. Base kinds are the leftmost
    non-overlapping matches of each pattern whose measured part is long enough;
    weak kinds are reported only beside complementary parts. Null and empty
    texts have no spans. Rows that repeat get the same spans each; rows of one
    doc_id with other texts are told apart by a hash of the text. Texts of any
    length are scanned whole; an empty table gives no rows, and other columns
    aren't looked at, whatever their names.

    Texts are read once and never shuffled: a first pattern lets only texts
    with a base match through to the costlier ones, since weak candidates need
    a base part. Its matches (a few numbers each) are written to the shared
    folder, so that nothing later scans texts again.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    nothing = F.expr("cast(array() as array<struct<kind int, nth int, gap int, size int, ok boolean>>)")
    hits = F.when(text.rlike(_ANY_BASE), F.concat(*(_hits(text, k) for k in KINDS))).otherwise(nothing)
    found, _ = written(docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("twin"), hits.alias("hits")), "secret-hits")
    kept, _ = written(_spans(found.where(F.size("hits") > 0)), "secret-spans")
    every = kept.where(F.col("kind") < len(BASE)).unionByName(_linked(kept))
    listed = every.groupBy("id", "twin").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    all_rows = found.select("id", "twin")
    joined = all_rows.alias("a").join(listed.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.twin") == F.col("b.twin")), "left")
    none = F.expr("cast(array() as array<struct<start bigint, kind int, end bigint>>)")
    return joined.select(F.col("a.id").alias("doc_id"), F.coalesce("b.spans", none).alias("spans"))


def _as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(spans: str, number: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == number)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *(F.size(_of_kind("spans", _NUMBER[k])).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_as_text(base), 256).alias("base_sha256"),
        _as_text(F.col("spans")).alias("spans"),
    )


def _sql_hits(kind: str) -> str:
    pattern, least, most, group = KINDS[kind]
    p = pattern.replace("'", "''")
    return f"""
        SELECT doc_id, {_NUMBER[kind]} AS kind, unnest(range(1, len(hit) + 1)) AS nth, unnest(gap[:len(hit)]) AS gap, unnest(hit) AS hit, unnest(value) AS value, {least} AS least, {most or 10**9} AS most
        FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gap, regexp_extract_all(text, '{p}', 0) AS hit, regexp_extract_all(text, '{p}', {group}) AS value FROM d)"""


def _sql_text(condition: str) -> str:
    return f"coalesce(string_agg({list(KINDS)}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e){condition}, '')"


SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    h AS ({" UNION ALL ".join(map(_sql_hits, KINDS))}),
    c AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS BIGINT) AS e FROM h),
    s AS (SELECT doc_id, kind, e - length(hit) AS s, e FROM c WHERE length(value) BETWEEN least AND most),
    f AS (
        SELECT w.doc_id, w.kind, w.s, w.e, bool_or(p.kind IN (0, 2)) AS secret, bool_or(p.kind = 1) AS access, bool_or(p.kind IN (1, 3)) AS name,
               bool_or(p.kind < 3 AND p.s < w.e AND w.s < p.e) AS inside
        FROM s w JOIN s p ON w.doc_id = p.doc_id AND w.kind >= 3 AND p.kind < 5 AND p.s - w.e <= {SCOPE} AND w.s - p.e <= {SCOPE} GROUP BY ALL
    ),
    a AS (
        SELECT doc_id, kind, s, e FROM s WHERE kind < 3
        UNION ALL SELECT doc_id, kind, s, e FROM f WHERE NOT inside AND ((kind = 3 AND secret) OR (kind = 4 AND access) OR (kind = 5 AND secret AND name))
    )
    SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           sha256({_sql_text(" FILTER (kind < 3)")}) AS base_sha256, {_sql_text("")} AS spans
    FROM d LEFT JOIN a ON d.doc_id = a.doc_id GROUP BY d.doc_id
"""
