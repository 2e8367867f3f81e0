"""Long SQL for the registry: checksums, fronts, splines, tests and subsequence scores, written out for DuckDB."""

from __future__ import annotations

_BYTES = "[CAST('0x' || x AS UBIGINT) FOR x IN regexp_extract_all(hex(encode({0})), '..')]"


def _step(polynomial: str) -> str:
    return f"list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, x: CASE WHEN s % 2 = 1 THEN xor(s >> 1, {polynomial}::UBIGINT) ELSE s >> 1 END)"


#: Tables of both checksums, from their polynomials.
TABLES = f"t AS (SELECT list(v ORDER BY i) AS crc, list(w ORDER BY i) AS crc64 FROM (SELECT i, {_step('3988292384')} AS v, {_step('4823603603198064275')} AS w FROM range(256) r(i)))"


def crc(table: str, data: str, start: str) -> str:
    return f"xor(list_reduce(list_prepend({start}::UBIGINT, {data}), lambda s, x: xor(s >> 8, {table}[CAST(xor(s, x) & 255 AS BIGINT) + 1])), {start}::UBIGINT)"


CHECKSUMS = f"""WITH {TABLES}, b AS (SELECT doc_id, {_BYTES.format('text')} AS data FROM documents)
SELECT doc_id, CAST({crc('crc', 'data', '4294967295')} AS BIGINT) AS crc32, CAST({crc('crc64', 'data', '18446744073709551615')} AS VARCHAR) AS crc64,
 CAST((len(data) + list_sum(list_transform(data, lambda x, i: x * CAST(len(data) - i + 1 AS UBIGINT)))) % 65521 * 65536 + (1 + list_sum(data)) % 65521 AS BIGINT) AS adler32 FROM b, t"""

SEGMENTS = """WITH l AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents),
b AS (SELECT doc_id, unnest(l) AS x, (generate_subscripts(l, 1) - 1) // 4096 AS seg FROM l),
c AS (SELECT doc_id, seg, x, count(*) AS n FROM b GROUP BY ALL),
p AS (SELECT doc_id, seg, n / sum(n) OVER (PARTITION BY doc_id, seg) AS p FROM c),
e AS (SELECT doc_id, seg, greatest(0, -sum(p * log2(p))) AS h FROM p GROUP BY ALL)
SELECT doc_id, count(*) AS n_segments, count(*) FILTER (h < 7.5) AS n_compressible, round(avg(h), 6) AS mean_entropy FROM e GROUP BY doc_id"""

#: Tiers by peeling: what no point before it (larger x, or the same and larger y) reaches stays in its tier, the rest goes on.
TIERS = """WITH RECURSIVE p AS (SELECT p_brand AS suite, CAST(p_partkey AS VARCHAR) AS codec, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part),
s AS (SELECT suite, codec, x, y, 1 AS tier FROM p UNION ALL
 SELECT suite, codec, x, y, tier + 1 FROM (SELECT *, max(y) OVER (PARTITION BY suite ORDER BY x DESC, y DESC, codec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s) WHERE m >= y - 1e-7),
t AS (SELECT suite, codec, x, y, max(tier) AS tier FROM s GROUP BY ALL),
o AS (SELECT * FROM t WHERE tier = 1),
n AS (SELECT suite, count(*) AS n FROM o GROUP BY suite),
inner_ AS (SELECT DISTINCT b.suite, b.codec FROM o a JOIN o b ON a.suite = b.suite AND a.x < b.x JOIN o c ON c.suite = b.suite AND c.x > b.x WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) >= -1e-7)
SELECT t.suite, t.codec, t.x, t.y, CAST(t.tier AS BIGINT) AS tier, t.tier = 1 AS is_optimal, t.tier = 1 AND i.codec IS NULL AS on_hull FROM t LEFT JOIN inner_ i ON i.suite = t.suite AND i.codec = t.codec"""

#: Slopes are held to the circle one interval after the other: the second changed slope is the next interval's first.
SPLINE = """WITH RECURSIVE d AS (SELECT p_brand AS suite, p_retailprice AS x, CAST(min(p_size) AS DOUBLE) AS y FROM part GROUP BY ALL),
k AS (SELECT *, row_number() OVER w - 1 AS k, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s FROM d WINDOW w AS (PARTITION BY suite ORDER BY x)),
m AS (SELECT *, lag(s) OVER w AS before, count(*) OVER (PARTITION BY suite) AS n FROM k WINDOW w AS (PARTITION BY suite ORDER BY x)),
i AS (SELECT suite, k, n, x, y, h, s, CASE WHEN s = 0 OR before = 0 THEN 0 WHEN before IS NULL THEN s WHEN s IS NULL THEN before WHEN before * s <= 0 THEN 0 ELSE (before + s) / 2 END AS m FROM m),
g AS (SELECT i.suite, i.k, i.n, i.x, i.y, i.h, i.s, i.m, j.m AS m2, j.y AS y2 FROM i LEFT JOIN i j ON j.suite = i.suite AND j.k = i.k + 1),
r(suite, k, a, b) AS (
 SELECT suite, k, CASE WHEN s <> 0 AND sqrt((m / s) ** 2 + (m2 / s) ** 2) > 3 THEN 3 / sqrt((m / s) ** 2 + (m2 / s) ** 2) * (m / s) * s ELSE m END,
  CASE WHEN s <> 0 AND sqrt((m / s) ** 2 + (m2 / s) ** 2) > 3 THEN 3 / sqrt((m / s) ** 2 + (m2 / s) ** 2) * (m2 / s) * s ELSE m2 END FROM g WHERE k = 0 AND n > 1
 UNION ALL SELECT g.suite, g.k, CASE WHEN g.s <> 0 AND sqrt((r.b / g.s) ** 2 + (g.m2 / g.s) ** 2) > 3 THEN 3 / sqrt((r.b / g.s) ** 2 + (g.m2 / g.s) ** 2) * (r.b / g.s) * g.s ELSE r.b END,
  CASE WHEN g.s <> 0 AND sqrt((r.b / g.s) ** 2 + (g.m2 / g.s) ** 2) > 3 THEN 3 / sqrt((r.b / g.s) ** 2 + (g.m2 / g.s) ** 2) * (g.m2 / g.s) * g.s ELSE g.m2 END
 FROM r JOIN g ON g.suite = r.suite AND g.k = r.k + 1 WHERE g.k < g.n - 1),
f AS (SELECT r.suite, r.k, r.a, coalesce(q.a, r.b) AS b, g.x, g.y, g.h, g.y2, g.n FROM r JOIN g ON g.suite = r.suite AND g.k = r.k LEFT JOIN r q ON q.suite = r.suite AND q.k = r.k + 1),
e AS (SELECT suite, min(x) AS lo, max(x) AS hi FROM d GROUP BY suite),
q AS (SELECT suite, lo + (hi - lo) * j / 32 AS px, j FROM e, range(33) t(j)),
z AS (SELECT q.suite, q.px, f.a, f.b, f.y, f.y2, f.h, (least(q.px, f.x + f.h) - f.x) / f.h AS t FROM q JOIN f ON f.suite = q.suite AND ((q.j < 32 AND q.px >= f.x AND q.px < f.x + f.h) OR (q.j = 32 AND f.k = f.n - 2)))
SELECT suite, round(px, 6) AS x, round((1 + 2 * t) * (1 - t) ** 2 * y + t * (1 - t) ** 2 * h * a + t ** 2 * (3 - 2 * t) * y2 + t ** 2 * (t - 1) * h * b, 6) AS y FROM z
UNION ALL SELECT suite, round(x, 6), round(y, 6) FROM (SELECT suite, min(x) AS x, min(y) AS y FROM d GROUP BY suite HAVING count(*) = 1), range(33)"""

#: The tail of Student's t by Simpson's rule over the angle.
VERDICT = """WITH a AS (SELECT l_linestatus AS metric, avg(l_tax) AS m, stddev_samp(l_tax) AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_linestatus AS metric, avg(l_tax) AS m, stddev_samp(l_tax) AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
w AS (SELECT metric, (b.m - a.m) / sqrt(a.s * a.s / a.n + b.s * b.s / b.n) AS t, power(a.s * a.s / a.n + b.s * b.s / b.n, 2) / (power(a.s * a.s / a.n, 2) / (a.n - 1) + power(b.s * b.s / b.n, 2) / (b.n - 1)) AS df, (b.m - a.m) / a.m * 100 AS d FROM a JOIN b USING (metric)),
g AS (SELECT *, atan(abs(t) / sqrt(df)) AS lo, least(pi() / 2, atan(abs(t) / sqrt(df)) + 40 / sqrt(df + 1)) AS hi FROM w),
p AS (SELECT metric, d, least(1, 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * (hi - lo) / 6000 * sum(CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * power(greatest(cos(lo + (hi - lo) * j / 2000), 1e-300), df - 1))) AS p FROM g, range(2001) r(j) GROUP BY metric, d, df, lo, hi)
SELECT metric, round(p, 6) AS p, CASE WHEN p >= 0.05 OR abs(d) <= 3 THEN 'no change' WHEN d > 0 THEN 'increase' ELSE 'decrease' END AS verdict FROM p"""


def subsequence(columns: str, source: str, target: str, pattern: str) -> str:
    """A table s: the columns, and the points of a target's leftmost subsequence and its places from 0; points are null where there is none."""
    inner = f"SELECT {columns}, {target} AS target, lower({target}) AS low FROM {source}"
    for k, c in enumerate(pattern):
        start = f"p{k - 1}" if k else "0"
        inner = f"SELECT *, CASE WHEN {start} IS NOT NULL AND instr(substr(low, {start} + 1), '{c.lower()}') > 0 THEN {start} + instr(substr(low, {start} + 1), '{c.lower()}') END AS p{k} FROM ({inner})"
    points = []
    for k, c in enumerate(pattern):
        at, before = f"substr(target, CAST(p{k} AS BIGINT), 1)", f"substr(target, CAST(p{k} AS BIGINT) - 1, 1)"
        points.append(f"10 + CASE WHEN {at} = '{c}' THEN 5 ELSE 0 END + CASE WHEN p{k} = 1 OR contains('/\\_-. ', {before}) THEN 30 WHEN {before} <> upper({before}) AND {at} <> lower({at}) THEN 25 ELSE 0 END")
        if k:
            points.append(f"CASE WHEN p{k} = p{k - 1} + 1 THEN 20 ELSE -(p{k} - p{k - 1} - 1) END")
    whole = f"CASE WHEN low = '{pattern.lower()}' THEN 500 WHEN starts_with(low, '{pattern.lower()}') THEN 200 ELSE 0 END"
    places = " || ',' || ".join(f"(p{k} - 1)" for k in range(len(pattern)))
    return f"SELECT {columns}, {' + '.join(points)} + {whole} AS points, {places} AS places FROM ({inner})"


FUZZY = f"""WITH e AS (SELECT p_partkey AS id, p_brand || '/' || p_type || '/' || p_name AS path, p_name AS name FROM part), a AS ({subsequence('id, path, name', 'e', 'name', 'smwd')}), b AS ({subsequence('id, path, name', 'e', 'path', 'smwd')})
SELECT b.path, b.name, CAST(coalesce(a.points + 100, b.points) AS BIGINT) AS score, CASE WHEN a.points IS NOT NULL THEN a.places ELSE b.places END AS places FROM b JOIN a ON a.id = b.id WHERE a.points IS NOT NULL OR b.points IS NOT NULL"""
