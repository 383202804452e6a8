"""DuckDB SQL for the operator queries that SQL can express. Written from the contracts, not from the Spark plans."""

from turnwise.llm.license_scan import CUE_TERM, CUES, FOREIGN, LEAST_COSINE, TEMPLATES

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_CTES = r"""
d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, list_slice(ws, i, i + 7) AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
s AS (SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (r)),
g AS (SELECT *, length(t) - length(translate(t, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')) AS n_punct FROM s JOIN (SELECT r, t FROM d) USING (r)),
h AS (SELECT * EXCLUDE (t), coalesce(n_symbols * 1000000 // nullif(word_chars, 0), 0)::BIGINT AS symbol_rate,
             coalesce(n_dup_lines * 1000000 // nullif(n_words, 0), 0)::BIGINT AS dup_line_rate,
             coalesce(n_punct * 1000000 // nullif(word_chars, 0), 0)::BIGINT AS punct_rate,
             coalesce(word_chars * 1000 // nullif(n_words, 0), 0)::BIGINT AS word_len,
             CASE WHEN n_words = 0 THEN 0 ELSE (length(bin(n_words)) - 2) * 256 + ((n_words * 256) >> (length(bin(n_words)) - 1)) END::BIGINT AS log_words FROM g),
m AS (UNPIVOT (SELECT lang, source, symbol_rate, dup_line_rate, punct_rate, word_len, log_words FROM h WHERE n_words > 0)
      ON symbol_rate, dup_line_rate, punct_rate, word_len, log_words INTO NAME metric VALUE x),
v AS (SELECT lang, source, metric, (x >> greatest(0, length(bin(x)) - 9)) << greatest(0, length(bin(x)) - 9) AS v FROM m),
f(metric, slack, times) AS (VALUES ('symbol_rate', 50000, 6), ('dup_line_rate', 50000, 6), ('punct_rate', 5000, 6), ('word_len', 100, 6), ('log_words', 64, 6)),
q AS (SELECT lang, source, metric, GROUPING(lang, source) AS level, count(*) AS total, quantile_disc(v, 0.5) AS q50,
             least(quantile_disc(v, 0.9) - quantile_disc(v, 0.5), quantile_disc(v, 0.5) - quantile_disc(v, 0.1)) AS spread
      FROM v GROUP BY GROUPING SETS ((lang, source, metric), (lang, metric), (metric))),
b AS (SELECT q.*, q50 - greatest(slack, spread * times) AS low, q50 + greatest(slack, spread * times) AS high FROM q JOIN f USING (metric)),
lim AS (SELECT o.lang, o.source, o.metric, CASE WHEN o.total >= 100 THEN o.low WHEN l.total >= 100 THEN l.low ELSE a.low END AS low,
               CASE WHEN o.total >= 100 THEN o.high WHEN l.total >= 100 THEN l.high ELSE a.high END AS high
        FROM (SELECT * FROM b WHERE level = 0) o
        JOIN (SELECT * FROM b WHERE level = 1) l ON o.metric = l.metric AND o.lang IS NOT DISTINCT FROM l.lang
        JOIN (SELECT * FROM b WHERE level = 3) a ON o.metric = a.metric),
lp AS (SELECT lang, source, max(high) FILTER (metric = 'symbol_rate')::BIGINT AS symbol_rate_max, max(high) FILTER (metric = 'dup_line_rate')::BIGINT AS dup_line_rate_max,
              max(high) FILTER (metric = 'punct_rate')::BIGINT AS punct_rate_max, max(high) FILTER (metric = 'word_len')::BIGINT AS word_len_max,
              max(high) FILTER (metric = 'log_words')::BIGINT AS log_words_max, max(low) FILTER (metric = 'punct_rate')::BIGINT AS punct_rate_min,
              max(low) FILTER (metric = 'word_len')::BIGINT AS word_len_min, max(low) FILTER (metric = 'log_words')::BIGINT AS log_words_min
       FROM lim GROUP BY lang, source),
j AS (SELECT h.*, lp.* EXCLUDE (lang, source), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
      FROM h LEFT JOIN lp ON h.lang IS NOT DISTINCT FROM lp.lang AND h.source IS NOT DISTINCT FROM lp.source),
op1 AS (SELECT *, NOT base_failed AND coalesce(symbol_rate <= symbol_rate_max AND dup_line_rate <= dup_line_rate_max AND punct_rate BETWEEN punct_rate_min AND punct_rate_max
                  AND word_len BETWEEN word_len_min AND word_len_max AND log_words BETWEEN log_words_min AND log_words_max, true) AS kept FROM j)
"""

OP1 = f"""WITH {OP1_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, symbol_rate, dup_line_rate, punct_rate, word_len, log_words,
       symbol_rate_max, dup_line_rate_max, punct_rate_max, word_len_max, log_words_max, punct_rate_min, word_len_min, log_words_min FROM op1"""

OP2 = r"""WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '%(UP)s', '%(LOW)s'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)""" % {"UP": UP, "LOW": LOW}

OP9 = r"""WITH
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '%(UP)s', '%(LOW)s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '%(UP)s', '%(LOW)s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, list_slice(w, k, k + least(13, len(w)) - 1) AS win
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, k, list_slice(w, k, k + n - 1) AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n)),
occ AS (SELECT r, dw.n, k, item FROM dw JOIN win ON dw.n = win.n AND dw.win = win.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, list_sort(list_distinct(list(item))) AS items FROM occ GROUP BY r),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
             sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256
      FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r))
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM o""" % {"UP": UP, "LOW": LOW}

OP10 = r"""WITH
u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, row_number() OVER () AS r, translate(regexp_extract(rest, '^[^/?#]*'), '%(UP)s', '%(LOW)s') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
rules(h, f, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT r, h || f AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || f) DESC, length(h) DESC) AS k
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (r)""" % {"UP": UP, "LOW": LOW}

OP6 = r"""WITH
p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS last FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM q LEFT JOIN m ON q.payload_digest = m.payload_digest AND payload_bytes >= 1000"""

_VALUES = ", ".join("('%s', '%s', '%s')" % (name, f"{name}/{k}", text) for name, texts in TEMPLATES.items() for k, text in enumerate(texts))

OP8 = rf"""WITH
t0(license, template, line) AS (VALUES {_VALUES}),
t AS (SELECT license, template, term, count(*) AS tf FROM (SELECT license, template, unnest(regexp_split_to_array(lower(line), '[^0-9a-z]+')) AS term FROM t0) WHERE term <> '' GROUP BY ALL),
f AS (SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN (doc_id // 1000) || '/LICENSE'
        WHEN doc_id % 100 = 0 THEN (doc_id // 1000) || '/' || (doc_id // 100) || '/LICENSE'
        ELSE (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path FROM documents),
l AS (SELECT doc_id, k, ls[k] AS body FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM f))
      WHERE regexp_matches(ls[k], '{CUES}')),
n AS (SELECT count(*) AS total FROM l),
v AS (SELECT doc_id, k, term, count(*) AS n FROM (SELECT doc_id, k, unnest(regexp_split_to_array(lower(body), '[^0-9a-z]+')) AS term FROM l) WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM v WHERE term IN (SELECT term FROM t) GROUP BY term),
idf AS (SELECT DISTINCT term, ln((total + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) + 1 AS idf FROM t LEFT JOIN df USING (term), n),
w AS (SELECT license, template, term, tf * idf AS w FROM t JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS tn FROM w GROUP BY template),
x AS (SELECT doc_id, k, term, n * coalesce(idf, ln(total + 1.0::DOUBLE) + 1) AS x, idf FROM v LEFT JOIN idf USING (term), n),
xn AS (SELECT doc_id, k, sqrt(sum(x * x)) AS xn FROM x GROUP BY ALL),
c AS (SELECT doc_id, k, license, round(sum(x * w) / (any_value(xn) * any_value(tn)), 6) AS cosine
      FROM x JOIN w USING (term) JOIN xn USING (doc_id, k) JOIN tn USING (template) GROUP BY doc_id, k, license, template),
-- windows as long as a template around each cue term; a window must hold the template's own terms
sz AS (SELECT license, template, sum(tf)::INTEGER AS size FROM t GROUP BY license, template),
lt AS (SELECT doc_id, k, list_filter(regexp_split_to_array(lower(body), '[^0-9a-z]+'), lambda x: x <> '') AS ts FROM l),
cue AS (SELECT doc_id, k, ts, i - 1 AS i FROM (SELECT doc_id, k, ts, unnest(range(1, len(ts) + 1)) AS i FROM lt) WHERE regexp_matches(ts[i], '{CUE_TERM}')),
pl AS (SELECT DISTINCT doc_id, k, size, array_to_string(list_slice(ts, s + 1, s + size), ' ') AS win
       FROM (SELECT doc_id, k, ts, size, unnest(range(greatest(0, i - (size - 1)), least(i, greatest(0, len(ts) - size)) + 1)) AS s FROM cue, (SELECT DISTINCT size FROM sz))),
wt AS (SELECT size, win, term, count(*) AS n FROM (SELECT size, win, unnest(string_split(win, ' ')) AS term FROM (SELECT DISTINCT size, win FROM pl)) GROUP BY ALL),
wx AS (SELECT size, win, term, n * coalesce(idf, {FOREIGN}::DOUBLE) AS x FROM wt LEFT JOIN idf USING (term)),
wn AS (SELECT size, win, sqrt(sum(x * x)) AS wn FROM wx GROUP BY size, win),
own AS (SELECT w.license, w.template, w.term, w.w, sz.size,
               (list_contains(regexp_split_to_array(lower(w.license), '[^0-9a-z]+'), w.term) OR (SELECT count(DISTINCT license) FROM t WHERE t.term = w.term) = 1)::INTEGER AS own
        FROM w JOIN sz USING (template)),
nd AS (SELECT template, sum(own) AS needed FROM own GROUP BY template),
wc AS (SELECT size, win, license, round(sum(x * w) / (any_value(wn) * any_value(tn)), 6) AS cosine
       FROM wx JOIN own USING (term, size) JOIN wn USING (size, win) JOIN tn USING (template) JOIN nd USING (template)
       GROUP BY size, win, license, template HAVING sum(own) = any_value(needed)),
ab AS (SELECT doc_id, k, cosine, 1 << 30 AS size, license FROM c WHERE cosine >= {LEAST_COSINE}
       UNION ALL SELECT doc_id, k, cosine, size, license FROM pl JOIN wc USING (size, win) WHERE cosine >= {LEAST_COSINE}),
b AS (SELECT doc_id, k, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY cosine DESC, size DESC, license DESC) AS r FROM ab) WHERE r = 1),
o AS (SELECT doc_id, count(*) AS n_lines, arg_max(license, (cosine, license)) AS own_license, max(cosine) AS cosine FROM b GROUP BY doc_id),
fo AS (SELECT f.doc_id, path, own_license, cosine, coalesce(n_lines, 0)::BIGINT AS n_lines FROM f LEFT JOIN o USING (doc_id)),
h AS (SELECT path, regexp_replace(path, '/LICENSE$', '') AS dir, own_license FROM fo WHERE ends_with(path, '/LICENSE') AND own_license IS NOT NULL),
u AS (SELECT fo.doc_id, h.path AS hp, h.own_license AS ol, row_number() OVER (PARTITION BY fo.doc_id ORDER BY length(h.dir) DESC) AS r
      FROM fo JOIN h ON starts_with(fo.path, h.dir || '/') WHERE fo.own_license IS NULL)
SELECT fo.doc_id, path, own_license, cosine, n_lines, coalesce(own_license, ol) AS license, CASE WHEN own_license IS NULL THEN hp END AS from_path
FROM fo LEFT JOIN (SELECT * FROM u WHERE r = 1) u USING (doc_id)"""
