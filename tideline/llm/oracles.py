"""SQL oracles of the operators that SQL can express; the others are tested against plain versions in tests/llm."""

from __future__ import annotations

from . import rules
from .mixing import BUDGET, CAP, SLOPES, WEIGHTS
from .secrets import LEAST_VALUE, RULES


# DuckDB's patterns have no look-around: the same rule for whole keys; of a key without its END line, a short last line isn't in it.
_PEM = (
    "-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
    "|(?:\\s{1,4}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\\n]*){0,9}(?:\\s{1,40}[A-Za-z0-9+/=]{16,})*)"
)


def _secrets() -> str:
    parts = " UNION ALL ".join(
        f"SELECT rid, '{kind}' AS kind, {i} AS ord, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {int(kind == 'assign')}) AS vs, string_split_regex(t, '{p}') AS gs FROM d"
        for i, (kind, p) in enumerate((k, r.replace("'", "''")) for k, r in (RULES | {"pem": _PEM}).items())
    )
    total = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: length(x))), 0)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ({parts}),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
s AS (SELECT rid, kind, ord, {total("ms[1:i - 1]")} + {total("gs[1:i]")} AS a, length(ms[i]) AS n, length(vs[i]) AS v FROM e),
f AS (SELECT rid, kind, ord, a, kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + n AS BIGINT) AS VARCHAR) AS span FROM s WHERE kind <> 'assign' OR v >= {LEAST_VALUE}),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
 string_agg(span, ',' ORDER BY a, ord) FILTER (WHERE ord < 3) AS base, string_agg(span, ',' ORDER BY a, ord) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.rid = g.rid"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAM = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(ws[i:i + n - 1], ' ') AS p FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0) x),
w AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS p FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) q WHERE len(ws) >= n) x),
h AS (SELECT w.rid, w.i, w.n, p.item FROM w JOIN p ON w.p = p.p AND w.n = p.n),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) y GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) z GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN t ON d.rid = t.rid"""

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_MIX = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_SIZE} AS size, sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || sha256(coalesce(text, ''))) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
k AS (SELECT *, CAST({CAP} * n AS DOUBLE) AS cap, {CAP} * n / w AS r FROM s),
u AS (SELECT *, ({BUDGET} * sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY r, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY r, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM k),
t AS (SELECT source, n AS source_size, w, least(cap, w * (SELECT arg_min(unit, r) FROM u WHERE unit * w <= cap)) AS target, CASE w WHEN 3 THEN {SLOPES[3]} WHEN 1 THEN {SLOPES[1]} ELSE {SLOPES[2]} END AS slope FROM u),
p AS (SELECT d.*, t.source_size, t.target, t.slope, CAST(round(t.target) AS BIGINT) AS goal, sum(size) OVER (PARTITION BY d.source ORDER BY o, rid) - size AS a FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(greatest(0, least(size, goal - a)) AS BIGINT) AS p1, CAST(greatest(0, least(size, goal - a - source_size)) AS BIGINT) AS p2, CAST(a AS DOUBLE) / target AS s1, CAST(a + source_size AS DOUBLE) / target AS s2, 1 - slope AS b FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, p1 + p2 AS taken,
 CASE WHEN p1 > 0 THEN CASE WHEN slope = 0 THEN s1 ELSE (sqrt(b * b + 4 * slope * s1) - b) / (2 * slope) END END AS position,
 CASE WHEN p2 > 0 THEN CASE WHEN slope = 0 THEN s2 ELSE (sqrt(b * b + 4 * slope * s2) - b) / (2 * slope) END END AS position2 FROM q"""

_BASE32 = "array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> k) & 31 AS BIGINT) + 1, 1)), '')), '')"
_WARC = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages), t AS (SELECT h, n, max(page_id) AS top FROM p GROUP BY h, n)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, {_BASE32.replace("(h,", "(p.h,")} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
 FROM p JOIN t ON p.h = t.h AND p.n = t.n"""


def _rules() -> str:
    left = lambda keep: f"length(regexp_replace(t, '{keep}', '', 'g'))"
    classes = [left(p) for p in ("[^a-z]+", "[^A-Z]+", "[^0-9]+", "[^\\x20\\x09-\\x0D]+", "[^!-/:-@\\[-`{-~]+")]
    common = "[" + ", ".join("'" + w + "'" for w in rules.COMMON) + "]"
    k, m = len(rules.CLASSES) + 1, len(rules.COMMON) + 1
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"
    refs = f"{sums('classes', k)} AS rc, {sums('common', m)} AS rm"

    def distance(p: str, q: str) -> str:
        x, y = (f"CAST({a}[i] AS DOUBLE) / list_sum({a})" for a in (p, q))
        term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0.0 END"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(x, y)} + {term(y, x)})) / 2)), 6) END"

    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
e AS (SELECT rid, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls, [{", ".join(classes)}] AS cs FROM d),
f AS (SELECT rid, doc_id, lang, len(ws) AS n_words, length(t) - cs[{list(rules.CLASSES).index("space") + 1}] AS word_chars, {left("[^#*$%&|<>]+")} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
 list_append(cs, length(t) - list_sum(cs)) AS classes FROM e),
w AS (SELECT rid, i, lower(ws[i]) AS lw, CASE WHEN i <= len(ws) - 2 THEN ws[i:i + 2] END AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM e WHERE len(ws) > 0) x),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM w WHERE g IS NOT NULL) y WHERE n > 1) z GROUP BY rid),
c AS (SELECT rid, [{", ".join(f"count(*) FILTER (WHERE pl = {i})" for i in range(1, m))}, count(*) FILTER (WHERE pl = 0)] AS common FROM (SELECT rid, coalesce(list_position({common}, lw), 0) AS pl FROM w) x GROUP BY rid),
a AS (SELECT f.*, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(common, list_transform(range({m}), lambda i: 0)) AS common FROM f LEFT JOIN r ON f.rid = r.rid LEFT JOIN c ON f.rid = c.rid),
ra AS (SELECT {refs} FROM a), rl AS (SELECT lang, {refs} FROM a WHERE lang IS NOT NULL GROUP BY lang),
b AS (SELECT a.*, coalesce(rl.rc, ra.rc) AS rc, coalesce(rl.rm, ra.rm) AS rm FROM a CROSS JOIN ra LEFT JOIN rl ON a.lang = rl.lang),
g AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 CASE WHEN n_words >= {rules.LEAST_CLASS} THEN {distance("classes", "rc")} END AS class_distance, CASE WHEN n_words >= {rules.LEAST_COMMON} THEN {distance("common", "rm")} END AS common_distance FROM b)
SELECT *, NOT base_failed AND coalesce(class_distance, 0) <= {rules.FAR_CLASS} AND coalesce(common_distance, 0) <= {rules.FAR_COMMON} AS kept FROM g"""


ORACLES: dict[str, str] = {"op1_secret_scan": _secrets(), "op3_quality_rules": _rules(), "op4_mixing": _MIX, "op5_warc": _WARC, "op7_decontamination": _DECONTAM}
