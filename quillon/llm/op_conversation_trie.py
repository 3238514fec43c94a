"""Query of the conversation prefix trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie
from .common import table


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.encode(table(spark, sf_dir, "conversations")).drop("preorder", "end")


QUERIES = {"op13_conversation_trie": op13_conversation_trie}
ORACLES = {
    "op13_conversation_trie": r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
                  coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'role': role, 'said': said} ORDER BY i) AS own, CAST(c AS VARCHAR) AS name FROM t GROUP BY c),
h AS (SELECT c, own, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(name) + 1), lambda k: CAST(ascii(substr(name, k, 1)) AS BIGINT))),
        lambda s, byte: list_reduce(list_prepend(xor(s, byte), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))) AS crc FROM o),
r AS (SELECT h.c, list_concat(coalesce(b.own, [])[1:(3 - CAST(h.crc % 4 AS INTEGER))], h.own[(4 - CAST(h.crc % 4 AS INTEGER)):]) AS whole FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
p AS (SELECT c, unnest(range(0, len(whole) + 1)) AS depth, whole FROM r),
m AS (SELECT c, depth, whole[1:depth] AS path, len(whole) = depth AS ends FROM p),
n AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(CASE WHEN depth > 0 THEN path[depth].said ELSE '' END, '[^\x20\x09-\x0D]+')) AS words,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.above = n.path),
u AS (SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS c2, b.depth AS d2 FROM m x JOIN f b ON b.path = x.path JOIN m y ON y.c = x.c AND y.depth <= x.depth JOIN f a ON a.path = y.path),
s AS (SELECT u.conv_id, u.depth, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved FROM u JOIN f ON f.conv_id = u.c2 AND f.depth = u.d2 GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (conv_id, depth) LEFT JOIN f q ON f.depth > 0 AND q.path = f.path[1:f.depth - 1]"""
}
