"""SQL twins of the corpus queries, for DuckDB.

Missing are those that SQL cannot express: parsing HTML, tokenizers, XXH64 digests, runs, and learned models.
"""

from __future__ import annotations

from probestats.llm.quality import STRICT, WIDE

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {10 * group + 1}, 10))::BIGINT >> {35 - 5 * i}) & 31) + 1, 1)"
    for group in range(4)
    for i in range(8)
)

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
     s AS (SELECT page_id, html, first, sha1(html) AS sha FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM s
"""


def _failed(limits: dict[str, float]) -> str:
    return (
        f"((n_symbols > {limits['symbols']}::DOUBLE * n_words)::INT + (n_dup_lines > {limits['lines']}::DOUBLE * n_lines)::INT"
        f" + (n_stutters > {limits['stutters']}::DOUBLE * n_words)::INT + (word_chars > {limits['word_length']}::DOUBLE * n_words)::INT)"
    )


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, host, text, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM d
),
windows AS (SELECT rid, i, list_slice(ws, i, i + 4) AS five FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(5)) AS k) GROUP BY rid),
stutters AS (
  SELECT rid, count(*) AS n FROM (SELECT rid, ws, unnest(range(1, len(ws))) AS i FROM w) WHERE ws[i] = ws[i + 1] GROUP BY rid
),
m AS (
  SELECT rid, doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines, coalesce(stutters.n, 0) AS n_stutters
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN stutters USING (rid)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed::INT + {_failed(STRICT)} AS n_failed FROM b),
h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (WHERE n_failed > 0)::DOUBLE AS k FROM f GROUP BY host),
s AS (SELECT count(*) AS hosts, sum(n) AS n, sum(k) AS k, sum(n * n) AS n2, sum(k * k / n) AS k2n FROM h),
r AS (
  SELECT k / n AS mean,
         CASE WHEN n - n2 / n - (hosts - 1) > 0 AND k > 0 AND k < n
              THEN (k2n - k * k / n - (hosts - 1) * (k / n) * (1 - k / n)) / ((n - n2 / n - (hosts - 1)) * (k / n) * (1 - k / n)) ELSE 0 END AS rho
  FROM s
),
rates AS (SELECT h.host, (h.k + mean * strength) / (h.n + strength) AS rate FROM h, (SELECT mean, greatest(1, 1 / greatest(rho, 1e-6) - 1) AS strength FROM r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed,
       NOT (base_failed OR {_failed(WIDE)} > 0 OR (n_failed > base_failed::INT AND rate > 0.3)) AS kept
FROM f JOIN rates ON f.host IS NOT DISTINCT FROM rates.host
"""


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= 20
"""


def _way(script: str, cost: str | int, edits: str) -> str:
    """A script, written as ten digits of cost and its edits, with further edits: the least text is the best script."""
    return f"lpad((left({script}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({script}, 11) || '{edits}'"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _stay(edits: str, initial: str, cost: str, *scripts: str) -> str:
    """The row kept or given another role, behind any of the scripts."""
    asked = f"NOT gone AND initial = '{initial}'" if edits == "K" else "NOT gone"
    return f"CASE WHEN {asked} THEN {_least(*(_way(x, cost, edits) for x in scripts))} END"


CONVERSATIONS = rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs
),
keyed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x FROM conversations
),
hashed AS (
  SELECT conv_id, turn, r, x,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm
  FROM keyed, t
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE r END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text,
         unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE harm <> 0
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^ 	-]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][ 	-]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS last_initial
  FROM numbered
),
f AS (SELECT *, blank OR seen AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM judged),
ids AS (SELECT DISTINCT conv_id FROM conversations),
-- the best scripts that lead to each last initial, inserted messages included
best AS (
  SELECT conv_id, 0::BIGINT AS i, '0000000000' AS e, NULL::VARCHAR AS s, '0000000005I' AS u, '0000000010II' AS a FROM ids
  UNION ALL
  SELECT conv_id, i, e, s, u1 AS u, {_least("a0", _way("u1", 5, "I"))} AS a FROM (
    SELECT *, {_least("u0", _way("e", 5, "I"), _way("s", 5, "I"), _way("a0", 5, "I"))} AS u1 FROM (
      SELECT b.conv_id, f.i, {_way("b.e", 2, "D")} AS e,
             {_least(_way("b.s", 2, "D"), _stay("K", "s", "more", "b.e"))} AS s,
             {_least(_way("b.u", 2, "D"), _stay("K", "u", "more", "b.e", "b.s", "b.a"), _stay("R", "u", "more + 1", "b.e", "b.s", "b.a"))} AS u0,
             {_least(_way("b.a", 2, "D"), _stay("K", "a", "more", "b.u"), _stay("R", "a", "more + 1", "b.u"))} AS a0
      FROM best b JOIN f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = b.i + 1
    )
  )
),
chosen AS (
  SELECT conv_id, left(least(e, a), 10)::BIGINT AS cost, substr(least(e, a), 11) AS audit FROM best QUALIFY i = max(i) OVER (PARTITION BY conv_id)
),
edits AS (
  SELECT conv_id, j, c, count(*) FILTER (WHERE c <> 'I') OVER w AS i, count(*) FILTER (WHERE c <> 'D') OVER w AS nth, count(*) FILTER (WHERE c <> 'D') OVER (PARTITION BY conv_id) AS n
  FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS j, substr(audit, j, 1) AS c FROM chosen) WINDOW w AS (PARTITION BY conv_id ORDER BY j)
),
messages AS (
  SELECT e.conv_id, j, CASE WHEN c = 'K' THEN role WHEN (nth - n) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN c = 'I' THEN '' ELSE text END AS message
  FROM edits e LEFT JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i WHERE c <> 'D'
),
repaired AS (SELECT conv_id, string_agg(message, chr(10) ORDER BY j) AS whole FROM messages GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND seen) AS duplicate,
         count(*) FILTER (WHERE NOT gone AND cut) AS truncated, count(*) FILTER (WHERE last_initial IS NOT NULL AND last_initial || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM chosen c LEFT JOIN counts n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""
