"""DuckDB SQL of the queries that SQL can express."""

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP3 = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM l),
f AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM x WHERE NOT regexp_matches(line, '^[ \t\n\x0B\f\r]*$')),
p AS (SELECT doc_id, place, line, lead(line) OVER (PARTITION BY doc_id ORDER BY place) AS line2 FROM f),
r AS (SELECT doc_id, place, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, place) AS k FROM p WHERE line2 IS NOT NULL),
q AS (SELECT doc_id, place, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS k FROM f WHERE len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) > 50),
g AS (SELECT DISTINCT doc_id, unnest([place, place + 1]) AS place FROM r WHERE k > 1 UNION SELECT doc_id, place FROM q WHERE k > 1),
y AS (SELECT x.doc_id, x.pos, x.line, g.place IS NOT NULL AS gone FROM x LEFT JOIN f USING (doc_id, pos) LEFT JOIN g ON g.doc_id = f.doc_id AND g.place = f.place),
z AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM y)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM z GROUP BY doc_id
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
opens AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM later)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM opens GROUP BY doc_id, g),
edges AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d)),
kept AS (SELECT doc_id, string_agg(substring(h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (a - from_) AS BIGINT)), '' ORDER BY a, b) AS h FROM edges JOIN d USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n AS i ON i.doc_id = x JOIN n AS j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.root), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = w.doc_id GROUP BY w.doc_id
"""


def url_sql(rules: list[tuple[str, str]]) -> str:
    """The tree of url_filter.judge, level by level."""
    from . import url_filter as U

    rule = verdict = "NULL"
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{word}' ELSE {verdict} END"
    part = lambda k: f"lower(coalesce(string_split(path, '/')[{k + 1}], ''))"  # noqa: E731
    plain = lambda k: f"regexp_replace(regexp_replace({part(k)}, '^[0-9a-f]*[0-9][0-9a-f]*-[0-9a-f-]{{8,}}$|^[0-9a-f]{{16,}}$', '#', 'g'), '[0-9]+', '#', 'g')"  # noqa: E731
    keys = [f"g{k}" for k in range(1, U.DEPTH + 2)]
    segments = ", ".join(f"{plain(k)} AS g{k}" for k in range(1, U.DEPTH + 1)) + f", CASE WHEN {part(U.DEPTH + 1)} = '' THEN '' ELSE '*' END AS g{U.DEPTH + 1}"
    out = [
        "WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages)",
        f"h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {AZ}), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)",
        f"v AS MATERIALIZED (SELECT *, {rule} AS rule, {verdict} AS ruled, {segments} FROM h)",
        f"t0 AS MATERIALIZED (SELECT host, {', '.join(keys)}, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked, '' AS p0 FROM v GROUP BY ALL)",
    ]
    for k in range(1, U.DEPTH + 1):
        out.append(f"c{k} AS (SELECT host, p{k - 1}, count(*) AS d, sum(m) AS m FROM (SELECT host, p{k - 1}, g{k}, sum(n) AS m FROM t{k - 1} GROUP BY ALL) GROUP BY ALL)")
        out.append(f"t{k} AS MATERIALIZED (SELECT t.*, t.p{k - 1} || '/' || CASE WHEN d > {U.FANOUT} AND m < d * {U.ROWS_PER_VALUE} AND g{k} <> '' THEN '*' ELSE g{k} END AS p{k} FROM t{k - 1} t JOIN c{k} c ON t.host = c.host AND t.p{k - 1} = c.p{k - 1})")
    out.append(f"q0 AS (SELECT *, CAST({U.PRIOR} AS DOUBLE) AS purity, CAST(0 AS DOUBLE) AS up_n, CAST(0 AS DOUBLE) AS up_b FROM t{U.DEPTH})")
    differ = lambda n, b, m, c: f"({b} * {m} - {c} * {n}) * ({b} * {m} - {c} * {n}) * ({n} + {m}) > {U.Z * U.Z} * ({b} + {c}) * ({n} + {m} - {b} - {c}) * {n} * {m}"  # noqa: E731
    for k in range(U.DEPTH + 1):
        apart = differ("s.n", "s.b", "up_n", "up_b") if k else "true"
        up = f"host, p{k - 1}" if k else "host"
        out.append(f"k{k} AS MATERIALIZED (SELECT {up}, p{k}, CAST(sum(labelled) AS DOUBLE) AS n, CAST(sum(blocked) AS DOUBLE) AS b FROM q{k} GROUP BY ALL)")
        if k:
            out.append(f"l{k} AS (SELECT *, lag(n) OVER w AS n1, lag(b) OVER w AS b1 FROM (SELECT {up}, n, b, count(*) AS m FROM k{k} WHERE n > 0 GROUP BY ALL) WINDOW w AS (PARTITION BY {up} ORDER BY b / n, n))")
            out.append(f"j{k} AS (SELECT *, sum(CASE WHEN {differ('n', 'b', 'n1', 'b1')} THEN 1 ELSE 0 END) OVER (PARTITION BY {up} ORDER BY b / n, n) AS alike FROM l{k})")
            out.append(f"o{k} AS (SELECT *, sum(m * n) OVER (PARTITION BY {up}, alike) AS n_, sum(m * b) OVER (PARTITION BY {up}, alike) AS b_ FROM j{k})")
            out.append(f"s{k} AS (SELECT k.host, k.p{k}, coalesce(n_, 0) AS n, coalesce(b_, 0) AS b FROM k{k} k LEFT JOIN o{k} o ON k.host = o.host AND k.p{k - 1} = o.p{k - 1} AND k.n = o.n AND k.b = o.b)")
        else:
            out.append("s0 AS (SELECT * FROM k0)")
        out.append(
            f"q{k + 1} AS MATERIALIZED (SELECT q.* EXCLUDE (purity, up_n, up_b), CASE WHEN {apart} THEN (s.b + {U.SMOOTHING} * purity) / (s.n + {U.SMOOTHING}) ELSE purity END AS purity,"
            f" CASE WHEN {apart} THEN s.n ELSE up_n END AS up_n, CASE WHEN {apart} THEN s.b ELSE up_b END AS up_b FROM q{k} q JOIN s{k} s ON q.host = s.host AND q.p{k} = s.p{k})"
        )
    same = " AND ".join(f"v.{c} = q.{c}" for c in ("host", *keys))
    return ", ".join(out) + f" SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.ruled, CASE WHEN q.purity >= {U.REJECT} THEN 'block' ELSE 'allow' END) AS verdict FROM v LEFT JOIN q{U.DEPTH + 1} q ON {same}"


#: Damage by a bitwise CRC; then costs from each row to the end for what stands before it (nothing, system, user, assistant), from the last row back, and
#: from the first row on the first edit by its initial that reaches the cost.
OP12 = r"""WITH RECURSIVE named AS (SELECT *, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_concat([4294967295], range(8 * length(name))), lambda h, k: xor((CASE WHEN k % 8 = 0 THEN xor(h, CAST(ascii(substring(name, k // 8 + 1, 1)) AS BIGINT)) ELSE h END) >> 1,
  3988292384 * ((CASE WHEN k % 8 = 0 THEN xor(h, CAST(ascii(substring(name, k // 8 + 1, 1)) AS BIGINT)) ELSE h END) & 1))), 4294967295) % 20 AS dmg FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN dmg = 4 THEN 'user' ELSE r0 END AS role, CASE dmg WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS text, unnest(range(CASE WHEN dmg = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE dmg <> 0),
lined AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, substring(role, 1, 1) AS x, right(regexp_replace(text, '[ 	
]+$', ''), 1) AS z FROM damaged),
faulty AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lead(x) OVER (PARTITION BY conv_id ORDER BY i) AS nx FROM lined),
rows_ AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END AS m FROM faulty),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (nx IS NOT NULL AND x || nx NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY 1),
back AS (SELECT DISTINCT conv_id, n + 1 AS i, 0 AS c0, 6 AS cs, 3 AS cu, 0 AS ca FROM rows_
  UNION ALL SELECT conv_id, i, least(b0, 3 + bu, 6 + ba), least(bs, 3 + bu, 6 + ba), least(bu, 3 + ba), least(ba, 3 + bu) FROM (SELECT r.conv_id, r.i,
    least(4 + c0, m + 3 + cu, CASE x WHEN 's' THEN m + cs WHEN 'u' THEN m + cu ELSE 2000000000 END) AS b0, least(4 + cs, m + cu + CASE WHEN x = 'u' THEN 0 ELSE 3 END) AS bs,
    least(4 + cu, m + ca + CASE WHEN x = 'a' THEN 0 ELSE 3 END) AS bu, least(4 + ca, m + cu + CASE WHEN x = 'u' THEN 0 ELSE 3 END) AS ba FROM back b JOIN rows_ r ON r.conv_id = b.conv_id AND r.i = b.i - 1)),
costs AS (SELECT conv_id, i, unnest(['', 's', 'u', 'a']) AS st, unnest([c0, cs, cu, ca]) AS c FROM back),
steps AS (SELECT a.conv_id, a.i, a.st, a.c, d.c AS after, e.c AS inserted, r.m, r.x, r.role, r.text, CASE WHEN a.st = 'u' THEN 'a' ELSE 'u' END AS want, CASE WHEN r.x = 's' AND a.st = '' THEN 's' ELSE CASE WHEN a.st = 'u' THEN 'a' ELSE 'u' END END AS keeps
  FROM costs a LEFT JOIN rows_ r ON r.conv_id = a.conv_id AND r.i = a.i LEFT JOIN costs d ON d.conv_id = a.conv_id AND d.i = a.i + 1 AND d.st = a.st LEFT JOIN costs e ON e.conv_id = a.conv_id AND e.i = a.i AND e.st = CASE WHEN a.st = 'u' THEN 'a' ELSE 'u' END),
edits AS (SELECT *, CASE WHEN m IS NULL AND c = 0 THEN '' WHEN m IS NOT NULL AND 4 + after = c THEN 'D' WHEN 3 + inserted = c THEN 'I' WHEN x = keeps AND m + (SELECT k.c FROM costs k WHERE k.conv_id = s.conv_id AND k.i = s.i + 1 AND k.st = s.keeps) = c THEN 'K' ELSE 'R' END AS edit FROM steps s),
walk AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, '' AS st, '' AS audit, CAST(NULL AS VARCHAR) AS lines, false AS done FROM (SELECT DISTINCT conv_id FROM rows_)
  UNION ALL SELECT w.conv_id, CASE WHEN edit IN ('', 'I') THEN w.i ELSE w.i + 1 END, CASE edit WHEN 'K' THEN keeps WHEN 'D' THEN w.st WHEN '' THEN w.st ELSE want END, w.audit || edit,
    CASE WHEN edit IN ('', 'D') THEN w.lines ELSE coalesce(w.lines || chr(10), '') || CASE edit WHEN 'K' THEN e.role || ':' || e.text ELSE CASE want WHEN 'u' THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN e.text ELSE '' END END END, edit = ''
  FROM walk w JOIN edits e ON e.conv_id = w.conv_id AND e.i = w.i AND e.st = w.st WHERE NOT w.done)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(c0, 0) AS BIGINT) AS cost,
  coalesce(w.audit, '') AS audit, sha256(coalesce(w.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id = o.conv_id LEFT JOIN back b ON b.conv_id = o.conv_id AND b.i = 1 LEFT JOIN walk w ON w.conv_id = o.conv_id AND w.done"""


def oracle_sql() -> dict[str, str]:
    from .queries import URL_RULES

    return {"op2_decontamination": OP2, "op3_line_dedup": OP3, "op4_url_filter": url_sql(URL_RULES), "op8_suffix_dedup": OP8, "op10_jaccard_join": OP10, "op12_conversation_repair": OP12}
