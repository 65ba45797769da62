"""CRC-32 in DuckDB SQL, which has no function for it."""

from __future__ import annotations


def crc32_sql(strings: str) -> str:
    """Common table expressions (for WITH RECURSIVE) that end in crc(s, crc): the CRC-32 of the UTF-8 bytes of each s of a query."""
    return f"""
    crc_step(i, k, c) AS (
        SELECT i, 0, i::UBIGINT FROM range(256) t(i)
        UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM crc_step WHERE k < 8
    ),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
    crc_of AS (SELECT s, [('0x' || x)::UBIGINT for x in regexp_extract_all(hex(encode(s)), '..')] AS b FROM ({strings})),
    crc AS (SELECT s, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)::BIGINT])), 4294967295::UBIGINT) AS crc FROM crc_of, crc_table)"""
