"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from tessella.llm.license_scan import FAMILIES, LEAST_SCORE, LICENCE_FILES, MARKS, NOTICES, SURE_SCORE, WINDOW_LINES, traits

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    return f"""
WITH rules(verdict, host, path) AS (VALUES {_values(rules)}),
p AS (SELECT page_id, coalesce({_FOLD.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS k
  FROM (SELECT DISTINCT host, path FROM p WHERE host <> '') p JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON p.host = f.host AND p.path = f.path
"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_WORDS = "list_filter(regexp_split_to_array(" + _FOLD + ", '[^a-z0-9]+'), lambda x: x <> '')"


def license_scan(path: str) -> str:
    files = ", ".join(f"'{x}'" for x in LICENCE_FILES)
    texts = [(name, k, text) for name in sorted(NOTICES) for k, text in enumerate(NOTICES[name])]
    sizes = ", ".join(f"({n}, {max(1, n // 4)})" for n in WINDOW_LINES)
    quoted = lambda own: ", ".join(f"'{x}'" for x in own)
    families, marks = quoted(FAMILIES), quoted(sorted({m for own in MARKS.values() for m in own} | set(FAMILIES)))
    kinds = ((name, k, *traits(name, text)) for name, k, text in texts)
    kinds = ", ".join(f"('{name}', '{k}', {tier}, {size}, [{quoted(needs)}]::VARCHAR[], [{quoted(family)}]::VARCHAR[])" for name, k, tier, size, needs, family in kinds)
    scored = lambda rows: f"""
  (WITH c AS (SELECT w.doc_id, w.i, w.t, count(*) * any_value(idf.idf) AS x FROM ({rows}) w JOIN idf ON w.t = idf.t GROUP BY ALL),
  norms AS (SELECT doc_id, i, sqrt(sum(x * x)) AS norm FROM c GROUP BY ALL),
  dots AS (SELECT c.doc_id, c.i, tv.name, tv.k, sum(c.x * tv.unit) AS dot FROM c JOIN tv ON c.t = tv.t GROUP BY ALL),
  closest AS MATERIALIZED (SELECT doc_id, i, name, k, round(dot / norm, 6) AS score FROM dots JOIN norms USING (doc_id, i) WHERE round(dot / norm, 6) >= {LEAST_SCORE}),
  has AS (SELECT doc_id, i, list(DISTINCT t) AS have FROM c WHERE t IN ({marks}) AND (doc_id, i) IN (SELECT (doc_id, i) FROM closest) GROUP BY ALL)
  SELECT doc_id, max({{'tier': tier, 'sure': score >= {SURE_SCORE}, 'size': size, 'score': score, 'name': name}}) AS best FROM closest JOIN traits USING (name, k) LEFT JOIN has USING (doc_id, i)
  WHERE len(list_filter(needs, lambda x: NOT list_contains(coalesce(have, []), x))) = 0 AND len(list_filter(coalesce(have, []), lambda x: list_contains([{families}], x) AND NOT list_contains(family, x))) = 0
  GROUP BY doc_id)"""  # noqa: E731
    return f"""
WITH notices(name, k, notice) AS (VALUES {_values(texts)}),
traits(name, k, tier, size, needs, family) AS (VALUES {kinds}),
d AS (SELECT doc_id, {path} AS path, coalesce(text, '') AS text FROM documents),
total AS (SELECT count(*) AS n FROM d),
nt AS (SELECT name, k, t, count(*) AS c FROM (SELECT name, k, unnest({_WORDS.format("notice")}) AS t FROM notices) GROUP BY ALL),
dt AS (SELECT t, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_WORDS.format("text")}) AS t FROM d) GROUP BY t),
idf AS MATERIALIZED (SELECT t, ln(((SELECT n FROM total) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM dt FULL JOIN (SELECT DISTINCT t FROM nt) USING (t)),
tv AS MATERIALIZED (SELECT name, k, t, c * idf / sqrt(sum(c * idf * c * idf) OVER (PARTITION BY name, k)) AS unit FROM nt JOIN idf USING (t)),
lines AS MATERIALIZED (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\n\r]+'), lambda line: {_WORDS.format("line")}), lambda x: len(x) > 0) AS l FROM d),
sizes(s, step) AS (VALUES {sizes}),
wins AS (SELECT doc_id, l, s, unnest(list_distinct(list_append(range(0, greatest(len(l) - s, 0) + 1, step), greatest(len(l) - s, 0)))) AS start FROM lines, sizes WHERE 2 * len(l) > s),
ww AS MATERIALIZED (SELECT doc_id, s * 1000000 + start AS i, unnest(flatten(l[start + 1 : start + s])) AS t FROM wins),
f AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS folder, split_part(lower(regexp_extract(path, '[^/]*$')), '.', 1) IN ({files}) AS is_file FROM d),
header AS {scored("SELECT * FROM ww")},
whole AS {scored(f"SELECT doc_id, 1 AS i, unnest({_WORDS.format('text')}) AS t FROM d WHERE doc_id IN (SELECT doc_id FROM f WHERE is_file)")},
own AS (SELECT f.*, CASE WHEN whole.best IS NOT NULL AND (header.best IS NULL OR whole.best.tier > 0 OR header.best.tier = 0) THEN whole.best ELSE header.best END AS best,
  CASE WHEN whole.best IS NOT NULL AND (header.best IS NULL OR whole.best.tier > 0 OR header.best.tier = 0) THEN 'file' WHEN header.best IS NOT NULL THEN 'header' END AS origin
  FROM f LEFT JOIN header ON f.doc_id = header.doc_id LEFT JOIN whole ON f.doc_id = whole.doc_id),
licensed AS (SELECT folder AS above, max(best) AS given FROM own WHERE is_file AND best IS NOT NULL GROUP BY folder),
inherited AS (SELECT o.folder, l.above, l.given, row_number() OVER (PARTITION BY o.folder ORDER BY length(l.above) DESC) AS k
  FROM (SELECT DISTINCT folder FROM own) o JOIN licensed l ON o.folder = l.above OR starts_with(o.folder, l.above || '/'))
SELECT o.doc_id, o.path, coalesce(o.best.name, i.given.name) AS license, coalesce(o.best.score, i.given.score) AS score,
  CASE WHEN o.best IS NULL AND i.given IS NOT NULL THEN 'inherited' ELSE o.origin END AS origin,
  CASE WHEN o.best IS NULL AND i.given IS NOT NULL THEN i.above END AS directory
FROM own o LEFT JOIN (SELECT * FROM inherited WHERE k = 1) i ON o.folder = i.folder
"""


_SPLIT = "list_filter(regexp_split_to_array(" + _FOLD + ", '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"

DECONTAMINATE = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_SPLIT.format("text")} AS w FROM documents WHERE text IS NOT NULL),
iw AS MATERIALIZED (SELECT item_id, {_SPLIT.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
i5 AS MATERIALIZED (SELECT item_id, len(w) AS l, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda p: array_to_string(w[p : p + least(5, len(w)) - 1], ' '))) AS s FROM iw WHERE len(w) > 0),
ic AS (SELECT item_id, s, count(*) AS c FROM i5 GROUP BY ALL),
sizes AS (SELECT DISTINCT item_id, l, k FROM i5),
ds AS MATERIALIZED (SELECT doc_id, len(w) AS n, k.k, unnest(range(0, len(w) - k.k + 1)) AS p, unnest(list_transform(range(1, len(w) - k.k + 2), lambda p: array_to_string(w[p : p + k.k - 1], ' '))) AS s
  FROM dw, (SELECT DISTINCT k FROM sizes) k WHERE len(w) >= k.k),
hit AS MATERIALIZED (SELECT ds.doc_id, ds.n, ds.p, ds.s, ic.item_id, ic.c FROM ds JOIN ic ON ds.s = ic.s JOIN sizes z ON z.item_id = ic.item_id AND z.k = ds.k),
pairs AS (SELECT DISTINCT h.doc_id, h.n, h.item_id, z.k, least(z.l, h.n) AS span, z.l - z.k + 1 AS ni FROM hit h JOIN sizes z USING (item_id)),
wins AS (SELECT *, unnest(range(0, n - span + 1)) AS start FROM pairs),
common AS (SELECT w.doc_id, w.item_id, w.start, w.span, w.k, w.ni, h.s, least(count(*), any_value(h.c)) AS c
  FROM wins w JOIN hit h ON w.doc_id = h.doc_id AND w.item_id = h.item_id AND h.p BETWEEN w.start AND w.start + w.span - w.k GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, span, sum(c) / (span - k + 1 + ni - sum(c)) AS similarity FROM common GROUP BY doc_id, item_id, start, span, k, ni)
SELECT doc_id, item_id, start::BIGINT AS start, span::BIGINT AS n_words, similarity::DOUBLE AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM scored WHERE similarity >= 0.8) WHERE r = 1
"""

#: One step of CRC-32 over the bits of an ASCII string: the register and the number of the bit.
_MET = "xor(c, if(i % 8 = 0, ord(substr(k, (i // 8 + 1)::INTEGER, 1)), 0)::BIGINT)"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], range(8 * length(k))), lambda c, i: xor({_MET} >> 1, 3988292384 * ({_MET} & 1))), 4294967295)"

LANGUAGE_ID = f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, coalesce({_CRC} % 5 = 0, false) AS held_out,
  trim(regexp_replace({_FOLD.format("text")}, '[^\\p{{L}}]+', ' ', 'g')) AS t FROM (SELECT *, doc_id::VARCHAR AS k FROM documents)),
p AS (SELECT doc_id, string_split(' ' || t || ' ', '') AS l FROM d WHERE t <> ''),
g AS (SELECT doc_id, unnest(l) AS g FROM p UNION ALL
  SELECT doc_id, unnest(list_transform(list_zip(l, l[2:]), lambda z: z[1] || z[2])) FROM p UNION ALL
  SELECT doc_id, unnest(list_transform(list_filter(list_zip(l, l[2:], l[3:]), lambda z: z[2] <> ' '), lambda z: z[1] || z[2] || z[3])) FROM p),
c AS MATERIALIZED (SELECT doc_id, g, count(*) AS c FROM g WHERE g IS NOT NULL AND g <> ' ' GROUP BY ALL),
own AS (SELECT * FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, g) - 1 AS r FROM c) WHERE r < 300),
learned AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, g) - 1 AS r
  FROM c JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g) WHERE r < 300),
far AS (SELECT o.doc_id, l.lang, sum(coalesce(abs(o.r - x.r), 300)) AS far, count(*) AS n
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM learned) l LEFT JOIN learned x ON x.lang = l.lang AND x.g = o.g GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) AS k FROM far) WHERE k = 1)
SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - far::DOUBLE / (n * 300), 0.0)::DOUBLE AS score
FROM d LEFT JOIN best b USING (doc_id)
"""


_PLAIN = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"

SUBSTRING_DEDUP = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, p, sha256(array_to_string(w[p : p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM win JOIN low USING (h) WHERE lo < doc_id),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.k) AS text, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d) x ANTI JOIN gone USING (doc_id, k) GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_FOLDED = "list_filter(regexp_split_to_array(coalesce(" + _FOLD.format("text") + ", ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_FOLDED} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p : p + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
named AS MATERIALIZED (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN sha256(array_to_string(s, chr(10))) END AS cls, s FROM s),
classes AS MATERIALIZED (SELECT cls, any_value(n) AS n, min(doc_id) AS least, any_value(s) AS s FROM named WHERE cls IS NOT NULL GROUP BY cls),
held AS MATERIALIZED (SELECT cls, n, unnest(s) AS g FROM classes),
pairs AS MATERIALIZED (SELECT a.cls AS a, b.cls AS b FROM held a JOIN held b ON a.g = b.g AND a.cls < b.cls GROUP BY a.cls, b.cls HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(cls, root) AS (SELECT cls, cls FROM classes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.cls = e.a),
best AS (SELECT r.cls, min(c.least) AS component_id FROM reach r JOIN classes c ON r.root = c.cls GROUP BY r.cls),
links AS (SELECT a AS cls, count(*) AS n_links FROM edges GROUP BY a)
SELECT named.doc_id, named.n::BIGINT AS n_shingles, coalesce(best.component_id, named.doc_id) AS component_id, coalesce(links.n_links, 0)::BIGINT AS n_links
FROM named LEFT JOIN best USING (cls) LEFT JOIN links USING (cls)
"""


def vector_codes(rounds: int) -> str:
    assigned = """a{r} AS MATERIALIZED (SELECT vec_id, part, m % 1000 AS entry, m // 1000 AS away FROM (SELECT p.vec_id, p.part,
  min(1000 * list_sum(list_transform(list_zip(p.x, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + e.entry) AS m
  FROM p JOIN e{r} e ON p.part = e.part GROUP BY ALL))"""
    moved = """n{r} AS (SELECT part, entry, list(f ORDER BY i) AS c FROM (SELECT p.part, a.entry, i, floor(sum(p.x[i])::DOUBLE / count(*))::BIGINT AS f
  FROM p JOIN a{r} a ON p.vec_id = a.vec_id AND p.part = a.part, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY ALL) GROUP BY ALL),
e{s} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(n.c, e.c) AS c FROM e{r} e LEFT JOIN n{r} n ON e.part = n.part AND e.entry = n.entry)"""
    steps = ",\n".join(f"{assigned.format(r=r)},\n{moved.format(r=r, s=r + 1)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS part)),
e0 AS MATERIALIZED (SELECT part, entry, c FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p) WHERE entry < 256),
{steps},
{assigned.format(r=rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(away)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM e{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)
"""
