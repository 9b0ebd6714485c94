"""CRC-32 of decimal numbers in plain SQL, for engines without such a function."""

from __future__ import annotations

#: Tables ``crc_table`` (its 256 entries as one list) and ``crcs`` (v, crc) for the values v of a table ``crc_of``.
TABLES = """
crc_steps(i, c, k) AS (
  SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS entries FROM crc_steps WHERE k = 8),
crcs AS (
  SELECT v, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(v AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1])), 4294967295) AS crc
  FROM crc_of, crc_table)"""
