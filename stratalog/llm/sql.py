"""DuckDB SQL over the whole tables, for the queries that SQL can express fast enough.

Without SQL here, and held against brute force in tests/llm: trained models (op3, op4, op6), tree matching (op5), stored
media (op7), merges (op9), seeded XXH64 and components (op10).
"""

from __future__ import annotations

import string

_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)

OP1 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT item, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
windows AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)
),
hits AS (SELECT doc_id, k, n, item FROM windows JOIN grams USING (n, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP8 = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM docs WHERE len(w) >= 13)
),
firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT doc_id, unnest(range(k, k + 13)) AS p FROM windows JOIN firsts USING (g) WHERE doc_id > least)
),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT words.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY words.p) AS kept
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

#: Kinds in the order that breaks ties: pattern, and what a match needs to be kept.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = {
    "assign": (_ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 1)) >= 12"),
    "access": ("AKIA[A-Z0-9]+", "length(m) >= 18"),
    "hex": ("[0-9a-f]+", "length(m) >= 16"),
    "forge_token": ("gh[pousr]_[A-Za-z0-9]+", "length(m) >= 24"),
    "chat_token": ("xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
    "private_key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    "web_token": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(m) >= 40"),
}


def _matches(rank: int, kind: str, pattern: str, kept: str) -> str:
    """Where the matches of a kind start: after the text between them and the matches before."""
    cut = f"SELECT n, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM docs"
    each = f"SELECT n, unnest(ms) AS m, unnest(gaps[1 : len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM ({cut})"
    placed = f"SELECT n, m, i, sum(length(gap)) OVER (PARTITION BY n ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ({each})"
    return f"SELECT n, {rank} AS r, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM ({placed}) WHERE {kept}"


OP2 = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_matches(r, kind, *x) for r, (kind, x) in enumerate(_KINDS.items()))}),
joined AS (
  SELECT n, count(*) FILTER (r = 0) AS a, count(*) FILTER (r = 1) AS b, count(*) FILTER (r = 2) AS c,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS every
  FROM spans GROUP BY n
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN joined USING (n)
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1, "op2_secrets": OP2, "op8_substring_dedup": OP8}
