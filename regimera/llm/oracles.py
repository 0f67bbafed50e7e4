"""DuckDB statements of the corpus queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"[x FOR x IN regexp_split_to_array({}, '[\x20\x09-\x0D]+') IF x <> '']"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Words with their places, and windows of five from neighbours: no list is repeated for its elements.
_PLACES = "u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w)"
_FIVES = "v AS (SELECT doc_id, i, " + " || ' ' || ".join(["x", *(f"lead(x, {k}) OVER o" for k in range(1, 5))]) + " AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i))"

JACCARD_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
  {_PLACES}, {_FIVES}, s AS (SELECT DISTINCT doc_id, g FROM v WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e2.b, r.root FROM r JOIN e2 ON r.doc_id = e2.a), m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
  SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id"""

_COUNTS = f"""d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS stratum FROM documents), w AS (SELECT doc_id, t, stratum, {_SPLIT.format('t')} AS w FROM d),
  {_PLACES}, {_FIVES}, g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM v WHERE g IS NOT NULL),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS rep FROM (SELECT doc_id, i FROM g WHERE c > 1), (SELECT unnest(range(0, 5)) AS k) GROUP BY 1),
  ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE length(translate(l, {_BLANK}, '')) > 0 GROUP BY 1),
  b AS (SELECT w.doc_id, t, stratum, len(w) AS n_words, length(translate(t, {_BLANK}, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    length(t) - length(translate(t, '{UPPER}', '')) AS n_upper, len(list_distinct(w)) AS n_distinct, coalesce(ln.n, 0) AS n_lines, coalesce(ln.n - ln.u, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words
    FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN ln ON ln.doc_id = w.doc_id),
  f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    [CAST(floor(100 * coalesce(least(1.0, x.a / CAST(nullif(x.b, 0) AS DOUBLE)), 0.0)) AS INTEGER) FOR x IN [{{'a': n_symbols, 'b': word_chars}}, {{'a': n_upper, 'b': word_chars}}, {{'a': n_dup_lines, 'b': n_lines}}, {{'a': n_repeat_words, 'b': n_words}}, {{'a': n_words - n_distinct, 'b': n_words}}]] AS stats FROM b)"""

#: alpha 0.02 shared by five rules; delta 0.05 by rules and strata.
QUALITY_RULES = f"""WITH {_COUNTS}, q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1 HAVING max(quality) IS NOT NULL),
  h AS (SELECT stratum, quality = 1 AS good, unnest(range(0, 5)) AS rule, unnest(stats) AS level FROM (SELECT stratum, min(quality) AS quality, any_value(stats) AS stats FROM f JOIN q ON q.doc_id = f.doc_id WHERE NOT base_failed GROUP BY stratum, t)),
  c AS (SELECT stratum, rule, level, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM h GROUP BY 1, 2, 3),
  t AS (SELECT *, sum(g) OVER (PARTITION BY stratum, rule) AS ng, sum(b) OVER (PARTITION BY stratum, rule) AS nb, sum(g) OVER (PARTITION BY stratum, rule ORDER BY level DESC) AS lost, sum(b) OVER (PARTITION BY stratum, rule ORDER BY level DESC) AS caught FROM c),
  p AS (SELECT *, CASE WHEN ng = 0 OR lost >= ng * 0.004 THEN 1.0 ELSE list_sum([exp(lgamma(ng + 1) - lgamma(i + 1) - lgamma(ng - i + 1) + i * ln(0.004) + (ng - i) * ln(0.996)) FOR i IN range(0, CAST(lost AS BIGINT) + 1)]) END AS p FROM t WHERE level > 0),
  o AS (SELECT *, sum(CASE WHEN p > 0.05 / (5 * (SELECT count(DISTINCT stratum) FROM c)) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY level DESC) AS bad, caught / greatest(nb, 1) - 5.0 * lost / ng AS gain FROM p),
  k AS (SELECT stratum, rule, level FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, level DESC) AS r FROM o WHERE bad = 0 AND caught > 0 AND gain > 0) WHERE r = 1),
  x AS (SELECT doc_id, bool_or(s >= k.level) AS hit FROM (SELECT doc_id, stratum, unnest(range(0, 5)) AS rule, unnest(stats) AS s FROM f) y JOIN k ON k.stratum = y.stratum AND k.rule = y.rule GROUP BY 1)
  SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    base_failed, NOT base_failed AND NOT coalesce(hit, false) AS kept FROM f LEFT JOIN x ON x.doc_id = f.doc_id"""

_PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(v) >= 6"),
    ("access", r"(AKIA[A-Z0-9]{16,})", "length(v) >= 20"),
    ("hex", r"([0-9a-f]{24,})", "length(v) >= 24"),
    (
        "generic",
        r"""(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?|://[A-Za-z0-9._%+-]+:[^\x20\x09-\x0D/:@]{6,}@|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+-----END|[A-Za-z0-9+/_=-]{16,})""",
        "length(v) >= 8 AND ((length(v) - length(translate(v, '0123456789', '')) >= 3 AND length(translate(v, '0123456789+/_=-', '')) >= 3 AND regexp_matches(v, '[A-Za-z0-9]{16}')) OR starts_with(v, '://') OR starts_with(v, '-----BEGIN ') OR regexp_matches(v, '^eyJ[^.]+\\.'))",
    ),
)
_FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, owner, repo, {rank} AS rank, '{kind}' AS kind, v, s, s + length(m) AS e FROM (SELECT doc_id, owner, repo, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS s
    FROM (SELECT doc_id, owner, repo, unnest(regexp_extract_all(t, '{p}', 0)) AS m, unnest(regexp_extract_all(t, '{p}', 1)) AS v, unnest(regexp_split_to_array(t, '{p}')[1:len(regexp_extract_all(t, '{p}', 0))]) AS gap,
      unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) AS i FROM d)) WHERE {test}"""
    for rank, (kind, p, test) in enumerate(_PATTERNS)
)
_LIST = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER ({}), '')"

#: Few: one, or a tenth of the corpus's owners and of its repositories.
SECRET_SCAN = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('s' || source, 'n') AS owner, coalesce('s' || source, 'n') || chr(31) || coalesce('s' || lang, 'n') AS repo FROM documents), f AS ({_FOUND}),
  c AS (SELECT * FROM f WHERE rank < 3 UNION ALL SELECT * FROM f g WHERE rank = 3 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.rank < 3 AND b.doc_id = g.doc_id AND b.s < g.e AND g.s < b.e)),
  n AS (SELECT greatest(1, floor(0.1 * count(DISTINCT owner))) AS few_o, greatest(1, floor(0.1 * count(DISTINCT repo))) AS few_r FROM d),
  o AS (SELECT v, count(DISTINCT owner) <= any_value(few_o) AND count(DISTINCT repo) <= any_value(few_r) AS live FROM c, n GROUP BY 1),
  u AS (SELECT x.*, o.live FROM (SELECT DISTINCT doc_id, e - length(v) AS s, e, v FROM c) x JOIN o ON o.v = x.v),
  j AS (SELECT doc_id, rank, kind, s, e, false AS live, false AS value FROM c WHERE rank < 3 UNION ALL SELECT doc_id, 4, 'owned', s, e, live, true FROM u),
  r AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h, {_LIST.format('rank < 3')} AS base, {_LIST.format('rank < 3 OR live')} AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (value AND NOT live) AS n_example FROM j GROUP BY 1)
  SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""
