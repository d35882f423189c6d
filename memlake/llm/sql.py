"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w
), sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
hit AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), edge AS (
  SELECT a, b FROM hit WHERE 100 * c >= 85 * (na + nb - c)
), sides AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON e.a = r.other
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.root AS component_id, s.doc_id = r.root AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id) r USING (doc_id)
"""


_METRICS = ("symbols", "dup_lines", "repeats", "word_length")
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = f"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda l: translate(l, {_SPACE}, '') <> '') AS ls FROM t
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS g FROM w WHERE len(ws) >= 3
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS pos FROM twice) GROUP BY doc_id
), s AS (
  SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(translate(text, {_SPACE}, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END AS repeats,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length FROM s
), v AS (
  SELECT lang, source, unnest({list(_METRICS)}) AS metric, unnest([symbols, dup_lines, repeats, word_length]) AS x FROM m WHERE NOT base_failed
), b AS (
  SELECT lang, source, metric, CASE WHEN x <= 0 THEN 0 ELSE 1 + CAST(floor(ln(x) / ln(1.02)) AS INT) END AS bucket FROM v
), leveled AS (
  SELECT 2 AS level, lang, source, metric, bucket, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, metric, bucket, count(*) FROM b GROUP BY ALL
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS up_to,
    CASE WHEN bucket = 0 THEN 0.0 ELSE pow(1.02, bucket) END AS x FROM leveled
), q AS (
  SELECT level, lang, source, metric, max(docs) AS docs, min(x) FILTER (4 * up_to >= docs) AS q1, min(x) FILTER (4 * up_to >= 3 * docs) AS q3 FROM r GROUP BY ALL
), l AS (
  SELECT level, lang, source, CAST(max(docs) AS DOUBLE) AS docs, {', '.join(f"max(q1) FILTER (metric = '{k}') AS {k}_q1, max(q3) FILTER (metric = '{k}') AS {k}_q3" for k in _METRICS)} FROM q GROUP BY ALL
), j1 AS (
  SELECT m.*, 10000 / word_chars AS symbols_step, 10000 / n_lines AS dup_lines_step, 20000 / n_lines AS repeats_step, word_length / n_words AS word_length_step,
    coalesce(b.docs, 0.0::DOUBLE) AS n1, {', '.join(f"coalesce(b.{k}_{x}, 0.0) AS {k}_{x}_1, c.{k}_{x} AS {k}_{x}_0" for k in _METRICS for x in ("q1", "q3"))}
  FROM m LEFT JOIN l b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM m.lang LEFT JOIN l c ON c.level = 0
), j2 AS (
  SELECT *, {', '.join(f"(n1 * {k}_{x}_1 + 100.0 * {k}_{x}_0) / (n1 + 100.0) AS {k}_{x}_p" for k in _METRICS for x in ("q1", "q3"))} FROM j1
), j AS (
  SELECT j2.*, {', '.join(f"(coalesce(a.docs, 0.0::DOUBLE) * coalesce(a.{k}_{x}, 0.0) + 100.0 * {k}_{x}_p) / (coalesce(a.docs, 0.0::DOUBLE) + 100.0) AS {k}_{x}" for k in _METRICS for x in ("q1", "q3"))}
  FROM j2 LEFT JOIN l a ON a.level = 2 AND a.lang IS NOT DISTINCT FROM j2.lang AND a.source IS NOT DISTINCT FROM j2.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(f"coalesce({k} <= {k}_q3 + 3 * greatest({k}_q3 - {k}_q1, {k}_step), true)" for k in _METRICS)}
  AND coalesce(word_length >= word_length_q1 - 3 * greatest(word_length_q3 - word_length_q1, word_length_step), true) AS kept
FROM j
"""

OP5 = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rhost, rpath, verdict)
), best AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""


#: Kind, regex, the group that is measured, its least length, and the group that a match begins with but isn't part of it (0: none).
_SECRETS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, 0),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, 0),
    ("hex", r"[0-9a-f]+", 0, 16, 0),
    ("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 24, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, 0),
    ("jwt", r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 2, 30, 1),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, 0),
)


def _secret_sql() -> str:
    parts = []
    for i, (kind, regex, group, least, before) in enumerate(_SECRETS):
        regex = regex.replace("'", "''")
        found = f"regexp_extract_all(text, '{regex}', {before})" if before else "[]"
        parts.append(
            f"SELECT doc_id, {i} AS k, '{kind}' AS kind, {least} AS least, m, g, p, h FROM (SELECT doc_id, regexp_extract_all(text, '{regex}') AS m, "
            f"regexp_extract_all(text, '{regex}', {group}) AS g, string_split_regex(text, '{regex}') AS p, {found} AS h FROM t) WHERE len(m) > 0"
        )
    base = [s[0] for s in _SECRETS[:3]]
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(parts)}),
x AS (SELECT doc_id, k, kind, least, m, g, p, h, unnest(range(1, len(m) + 1)) AS i FROM f),
y AS (
  SELECT doc_id, k, kind, least, length(m[i]) AS n, length(g[i]) AS good, coalesce(length(h[i]), 0) AS skipped,
    CAST(list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS BIGINT) AS pos FROM x
), z AS (SELECT doc_id, k, kind, pos + skipped AS pos, kind || ':' || (pos + skipped) || ':' || (pos + n) AS span FROM y WHERE good >= least)
SELECT t.doc_id, {', '.join(f"count(z.k) FILTER (kind = '{k}') AS n_{k}" for k in base)},
  sha256(coalesce(string_agg(span, ',' ORDER BY pos, k) FILTER (k < {len(base)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY pos, k), '') AS spans
FROM t LEFT JOIN z USING (doc_id) GROUP BY t.doc_id
"""


OP11 = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p
), g AS (
  {" UNION ALL ".join(f"SELECT lang, {k} AS words, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS phrase FROM w WHERE len(ws) >= {k}" for k in (1, 2, 3, 4))}
), f AS (
  SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang
), c AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= 30
), cuts AS (
  SELECT lang, phrase, a, ws, unnest(range(1, words)) AS k FROM c
), s AS (
  SELECT u.lang, u.phrase, u.a, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * u.a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.ws[1:u.k], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.ws[u.k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, u.k) = 1
), sizes AS (
  SELECT lang, a, ws, words, unnest(range(2, words)) AS size FROM c
), inside AS (
  SELECT lang, a, ws, size, unnest(range(1, words - size + 2)) AS i FROM sizes
), longer AS (
  SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM inside GROUP BY ALL
), kept AS (
  SELECT s.* FROM s LEFT JOIN longer b ON b.lang = s.lang AND b.phrase = s.phrase WHERE b.longer IS NULL OR 100 * b.longer < 80 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, substring(text, 1, lo) AS prefix, substring(text, lo + 1, hi - lo) AS middle, substring(text, hi + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": OP1,
    "op2_quality_rules": OP2,
    "op5_url_filter": OP5,
    "op9_secret_scan": _secret_sql(),
    "op11_collocations": OP11,
    "op13_fill_in_middle": OP13,
}
