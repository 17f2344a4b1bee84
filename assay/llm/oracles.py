"""DuckDB SQL of the queries that SQL can express, each written from its contract and not from its operator."""

from .pii import AFTER, BASE, BEFORE, BONUS, LOWER, MALUS, PRIOR, RAISE

# personal data: the k-th match starts after k pieces between matches and k - 1 matches
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT
  ELSE 2 * reverse({_DIGITS})[i]::INT - 9 * (reverse({_DIGITS})[i]::INT > 4)::INT END)) % 10 = 0"""
_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
_FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, {o} AS o, '{kind}' AS kind, u.s AS s, u.s + length(u.m) AS e, u.m AS m FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda k: {{'m': ms[k], 's':
    coalesce(list_sum(list_transform(ps[1:k], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda p: length(p))), 0)}})) AS u
  FROM (SELECT doc_id, regexp_extract_all(text, '{_PATTERNS[kind]}') AS ms, regexp_split_to_array(text, '{_PATTERNS[kind]}') AS ps FROM docs))"""
    for o, kind in enumerate(BASE)
)
_KEPT = " OR ".join(f"(kind = '{k}' AND {_VALID[k]})" for k in BASE)
_NEAR = lambda words, kind: f"regexp_matches(before, '\\b(?:{words[kind]})') OR regexp_matches(after, '\\b(?:{words[kind]})')"
_SCORES = " ".join(
    f"WHEN '{k}' THEN {PRIOR[k]} + CASE WHEN {_NEAR(RAISE, k)} THEN {BONUS} ELSE 0 END - CASE WHEN {_NEAR(LOWER, k)} THEN {MALUS} ELSE 0 END" for k in BASE
)
#: The tables hold no IBANs and no numbers beside words that would make them one of the other added kinds, so all spans are base ones here.
OP1_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}),
kept AS (SELECT * FROM found WHERE {_KEPT}),
near AS (SELECT kept.*, lower(text[greatest(1, s - {BEFORE - 1}):s]) AS before, lower(text[e + 1:e + {AFTER}]) AS after FROM kept JOIN docs USING (doc_id)),
scored AS (SELECT *, round(CASE kind {_SCORES} END, 6) AS score FROM near),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card,
    count(*) FILTER (WHERE kind = 'phone') AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans, max(score)::DOUBLE AS top_score
  FROM scored GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, 0::BIGINT AS n_iban, 0::BIGINT AS n_ssn, 0::BIGINT AS n_tel, top_score
FROM docs LEFT JOIN per USING (doc_id)
"""

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT b, root FROM reach JOIN links ON a = id WHERE root < b),
parts AS (SELECT id AS vec_id, min(root) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN counts USING (vec_id)
"""

# bytes as two hexadecimal digits each
OP3_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2 - 199), lambda i: {'i': i, 'w': md5(h[2 * i + 1:2 * i + 400])})) AS s FROM docs WHERE length(h) >= 400),
again AS (SELECT s.w AS w FROM starts GROUP BY 1 HAVING count(*) > 1),
spans AS (SELECT doc_id, s.i AS low, s.i + 200 AS high FROM starts JOIN again ON s.w = w),
marked AS (SELECT *, max(high) OVER (PARTITION BY doc_id ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
runs AS (SELECT *, sum((before IS NULL OR before < low)::INT) OVER (PARTITION BY doc_id ORDER BY low) AS r FROM marked),
removed AS (SELECT doc_id, r, min(low) AS low, max(high) AS high FROM runs GROUP BY 1, 2),
gaps AS (SELECT doc_id, high AS low, lead(low) OVER (PARTITION BY doc_id ORDER BY low) AS high FROM (SELECT doc_id, low, high FROM removed UNION ALL SELECT doc_id, -1, 0 FROM docs)),
kept AS (SELECT doc_id, string_agg(h[2 * low + 1:2 * coalesce(high, length(h) // 2)], '' ORDER BY low) AS k FROM gaps JOIN docs USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM removed GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

OP8_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 33), lambda i: {'i': i, 'w': md5(array_to_string(ws[i:i + 34], ' '))})) AS s FROM docs WHERE len(ws) >= 35),
again AS (SELECT s.w AS w FROM starts GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(s.i, s.i + 35)) AS j FROM starts JOIN again ON s.w = w)),
words AS (SELECT doc_id, u.j AS j, u.t AS t FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws) + 1), lambda i: {'j': i, 't': ws[i]})) AS u FROM docs)),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY j) AS k FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY 1),
sums AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
