"""DuckDB SQL of the registered queries, over the page view said again in SQL."""

from .scan import GLYPHS, SQL as SCAN

LETTER = r"\p{L}"
# Ordinal of a label by a table of all roman numbers.
NUMERALS = """
roman AS MATERIALIZED (SELECT v, repeat('m', v // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][(v // 100) % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][(v // 10) % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][v % 10 + 1] AS r FROM range(1, 4000) t(v))
"""
LABELS = rf"""
filled AS (SELECT *, trim(line) AS s FROM page_lines WHERE trim(line) <> ''),
ends AS (SELECT volume_id, pos, arg_min(s, ln) AS t, arg_max(s, ln) AS b, count(*) AS n FROM filled GROUP BY ALL),
sides AS (SELECT volume_id, pos, 'top' AS edge, CASE WHEN n > 1 THEN t END AS s FROM ends UNION ALL SELECT volume_id, pos, 'bottom', b FROM ends),
{NUMERALS.strip()},
tok AS (
  SELECT volume_id, pos, edge, s, s AS token, 0 AS k, NULL AS rest FROM sides WHERE s IS NOT NULL
  UNION ALL SELECT volume_id, pos, edge, s, regexp_extract(s, '^([0-9]{{1,4}}|[mdclxvi]{{2,}})\s+(.+)$', 1), 1, regexp_extract(s, '^([0-9]{{1,4}}|[mdclxvi]{{2,}})\s+(.+)$', 2) FROM sides WHERE s IS NOT NULL
  UNION ALL SELECT volume_id, pos, edge, s, regexp_extract(s, '^(.+?)\s+([0-9]{{1,4}}|[mdclxvi]{{2,}})$', 2), 2, regexp_extract(s, '^(.+?)\s+([0-9]{{1,4}}|[mdclxvi]{{2,}})$', 1) FROM sides WHERE s IS NOT NULL
),
okay AS (
  SELECT tok.* FROM tok LEFT JOIN roman ON token = r WHERE token <> ''
   AND ((regexp_full_match(token, '[0-9]{{1,4}}') AND TRY_CAST(token AS INT) BETWEEN 1 AND 9999) OR (r IS NOT NULL AND length(token) >= 2))
   AND (k = 0 OR (length(regexp_replace(rest, '[^\p{{L}}]', '', 'g')) >= 2 AND length(regexp_replace(rest, '[^\p{{Lu}}]', '', 'g')) >= 0.7 * length(regexp_replace(rest, '[^\p{{L}}]', '', 'g'))))
),
lab AS (SELECT volume_id, pos, edge, arg_min(token, k) AS label FROM okay GROUP BY ALL),
edges AS MATERIALIZED (SELECT e.volume_id, e.pos, t.label AS label_top, b.label AS label_bottom FROM ends e LEFT JOIN lab t ON t.volume_id = e.volume_id AND t.pos = e.pos AND t.edge = 'top' LEFT JOIN lab b ON b.volume_id = e.volume_id AND b.pos = e.pos AND b.edge = 'bottom'),
obs AS MATERIALIZED (
  SELECT volume_id, pos, label, 'printed-' || edge AS source, 1.0::DOUBLE AS weight, coalesce(TRY_CAST(label AS INT), v) AS value,
         CASE WHEN TRY_CAST(label AS INT) IS NOT NULL THEN 'arabic' ELSE 'roman-lower' END AS style
  FROM lab LEFT JOIN roman ON label = r
)
"""
CANDIDATES = r"""
filled AS (SELECT *, trim(line) AS s FROM page_lines WHERE trim(line) <> ''),
nth AS (SELECT *, row_number() OVER (PARTITION BY volume_id, pos ORDER BY ln) AS nth FROM filled),
cand AS MATERIALIZED (SELECT volume_id, pos, ln, nth, line, regexp_replace(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '^[0-9]+\s*', ''), '\s*[0-9]+$', '') AS norm,
  coalesce(nullif(regexp_extract(s, '^([0-9]{1,4})\s+\S', 1), ''), nullif(regexp_extract(s, '\S\s+([0-9]{1,4})$', 1), '')) AS number FROM nth WHERE nth <= 3),
heads AS (SELECT volume_id, norm, count(*)::BIGINT AS n FROM cand WHERE length(norm) > 5 GROUP BY ALL HAVING count(*) >= 3)
"""
HISTOGRAM = """
lastln AS (SELECT *, max(ln) OVER (PARTITION BY volume_id, pos) AS last FROM {lines}),
hist AS MATERIALIZED (SELECT volume_id, length(line) AS len, count(*) AS n, min(pos * 1000000 + ln) AS first FROM lastln WHERE ln < last AND trim(line) <> '' GROUP BY ALL),
peak AS (SELECT volume_id, arg_min(len, (-n) * 1000000000000 + first) AS mode_len, max(n) AS peak FROM hist GROUP BY volume_id),
below AS (SELECT volume_id, mode_len, peak, unnest(range(1, 1 + mode_len)) AS len FROM peak),
rare AS (SELECT b.volume_id, max(b.len) AS l FROM below b LEFT JOIN hist h USING (volume_id, len) WHERE coalesce(h.n, 0) < 0.25 * peak GROUP BY b.volume_id),
limits AS MATERIALIZED (SELECT volume_id, mode_len, coalesce(l, mode_len - 1) AS threshold FROM peak LEFT JOIN rare USING (volume_id))
"""
NOTES = rf"""
srt AS (SELECT volume_id, pos, ln, rtrim(line) AS line, CASE WHEN regexp_matches(line, '^[0-9]{{1,3}}\)') THEN regexp_extract(rtrim(line), '^([0-9]{{1,3}})\)\s?(.*)$', 1)::INT END AS num, regexp_extract(rtrim(line), '^([0-9]{{1,3}})\)\s?(.*)$', 2) AS txt FROM page_lines),
roles AS MATERIALIZED (SELECT *, count(num) OVER w AS nth, CASE WHEN count(num) OVER w > 0 THEN 'note' ELSE 'body' END AS role FROM srt WINDOW w AS (PARTITION BY volume_id, pos ORDER BY ln ROWS UNBOUNDED PRECEDING)),
joined AS (SELECT volume_id, pos, nth, max(num) AS num, trim(string_agg(CASE WHEN num IS NOT NULL THEN txt ELSE line END, ' ' ORDER BY ln)) AS text FROM roles WHERE role = 'note' GROUP BY ALL),
defs AS MATERIALIZED (SELECT volume_id, pos, num, arg_max(text, nth) AS text FROM joined GROUP BY ALL),
bod AS (SELECT volume_id, pos, string_agg(line, chr(10) ORDER BY ln) AS body FROM roles WHERE role = 'body' GROUP BY ALL),
own AS (SELECT volume_id, pos, list(num ORDER BY num) AS nums, list(num ORDER BY num)[1] AS a, list(num ORDER BY num)[2] AS b, list(num ORDER BY num)[3] AS c FROM defs GROUP BY ALL)
"""


def _marked() -> str:
    """Markers of up to three notes set in the body, glued ones first."""
    steps, last = [], "b0"
    for mode, (before, put) in enumerate(((r"[^\s0-9]", " ["), (r"\s", "["))):
        for c in "abc":
            name = f"m{mode}{c}"
            tail = rf"(\z|[^\p{{L}}\p{{N}}_])"
            pattern = rf"'(?s)^(.*?{before})' || {c} || '{tail}'"
            hit = f"{c} IS NOT NULL AND NOT list_contains(done, {c}) AND regexp_matches(body, {pattern})" if mode else f"{c} IS NOT NULL AND regexp_matches(body, {pattern})"
            steps.append(rf"{name} AS (SELECT * EXCLUDE (body, done), CASE WHEN {hit} THEN regexp_replace(body, {pattern}, '\1{put}' || {c} || ']\2') ELSE body END AS body, CASE WHEN {hit} THEN list_append(done, {c}) ELSE done END AS done FROM {last})")
            last = name
    return "b0 AS (SELECT volume_id, pos, body, []::INT[] AS done, nums, a, b, c FROM bod LEFT JOIN own USING (volume_id, pos)),\n" + ",\n".join(steps) + f",\nbodies AS MATERIALIZED (SELECT volume_id, pos, body, nums FROM {last})"


MARKED = _marked()
PARAS = r"""
par AS MATERIALIZED (SELECT volume_id, pos AS para, replace(body, chr(10), ' ') AS text, nums AS notes FROM bodies WHERE nums IS NOT NULL),
mk AS (SELECT volume_id, para, text, string_split_regex(text, '\[[0-9]{1,3}\]') AS ps, regexp_extract_all(text, '\[([0-9]{1,3})\]', 1) AS ms FROM par),
mi AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM mk),
present AS MATERIALIZED (SELECT volume_id, para, ms[i]::INT AS num, max(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x) + 2)), 0))::INT AS "at" FROM mi GROUP BY ALL),
owed AS (SELECT volume_id, para, unnest(notes) AS num FROM par),
missing AS (SELECT o.* FROM owed o LEFT JOIN present p USING (volume_id, para, num) WHERE p."at" IS NULL),
gap0 AS (SELECT m.volume_id, m.para, m.num, max(CASE WHEN p.num < m.num THEN p.num END) AS lower, min(CASE WHEN p.num > m.num THEN p.num END) AS upper FROM missing m JOIN present p USING (volume_id, para) GROUP BY ALL),
gaps AS MATERIALIZED (SELECT g.volume_id, g.para, g.num, g.lower, g.upper, l."at" AS start, u."at" AS stop FROM gap0 g JOIN present l ON l.volume_id = g.volume_id AND l.para = g.para AND l.num = g.lower JOIN present u ON u.volume_id = g.volume_id AND u.para = g.para AND u.num = g.upper WHERE u."at" >= l."at"),
conf(num, glyphs) AS (VALUES (1, 'lIiıj'), (2, 'zZ²'), (3, 'B8³'), (4, 'Aı''⁴'), (5, 'S⁵'), (6, 'bG&⁶'), (7, 'T⁷'), (8, 'B&⁸'), (9, 'gq⁹')),
masked AS (SELECT g.*, par.text, regexp_replace(regexp_replace(substr(par.text, start + 1, stop - start), '\[[0-9]\]', '   ', 'g'), '\[[0-9]{2}\]', '    ', 'g') AS span FROM gaps g JOIN par USING (volume_id, para)),
chars AS (SELECT *, unnest(range(1, length(span) + 1)) AS i FROM masked),
found AS MATERIALIZED (
  SELECT volume_id, para, c.num, (start + i - 1)::INT AS "at", substr(span, i, 1) AS glyph, CASE WHEN i > 1 THEN substr(span, i - 1, 1) ELSE '' END AS l, substr(span, i + 1, 1) AS r, text
  FROM chars c JOIN conf ON conf.num = c.num AND contains(glyphs, substr(span, i, 1))
  WHERE substr(span, i + 1, 1) = '' OR substr(span, i + 1, 1) = ' ' OR contains('.,;:!?»“"’'')]', substr(span, i + 1, 1))
),
seen AS (SELECT volume_id, num, glyph, count(*) AS seen, sum(count(*)) OVER (PARTITION BY volume_id, num) AS total FROM found GROUP BY volume_id, num, glyph),
scored AS MATERIALIZED (
  SELECT f.volume_id, para, f.num, "at", f.glyph, s.seen, s.total >= 3 AS informed,
         least(1.0, round_even(CASE WHEN s.total >= 3 THEN round_even(0.2 + 0.4 * s.seen / s.total, 2) ELSE 0.4 END + CASE WHEN l <> '' AND (regexp_matches(l, '^\p{L}$') OR contains('.!?»“"’'')(', l)) THEN 0.3 ELSE 0 END + CASE WHEN r <> '' AND contains('.,;:!?»“"’'')]', r) THEN 0.2 ELSE 0.1 END, 2))::DOUBLE AS confidence,
         trim(regexp_replace(substr(text, greatest("at" - 30, 0) + 1, least(length(text), "at" + 31) - greatest("at" - 30, 0)), '\s+', ' ', 'g')) AS context
  FROM found f JOIN seen s ON s.volume_id = f.volume_id AND s.num = f.num AND s.glyph = f.glyph
)
"""
BODY_LINES = rf"""
kept AS MATERIALIZED (SELECT r.volume_id, r.pos, r.ln, r.line, e.label_bottom AS label FROM roles r JOIN edges e USING (volume_id, pos) WHERE role = 'body' AND NOT regexp_matches(r.line, '^STUDIES IN ') AND NOT regexp_full_match(r.line, '[0-9]+'))
"""
HARD = r"(?i)^\s*(und|oder|bis|sowie|wie|als|zur?|zum?|noch|aber)($|[^\p{L}\p{N}_])"


#: A state machine, line by line: whether a paragraph and a word are open, and the number of the paragraph.
PARAGRAPHS = rf"""
ln0 AS (SELECT volume_id, pos, ln, rtrim(line) AS s, label, row_number() OVER (PARTITION BY volume_id ORDER BY pos, ln) AS i, lead(line) OVER (PARTITION BY volume_id, pos ORDER BY ln) AS nx FROM kept),
ln1 AS MATERIALIZED (
  SELECT l.*, trim(s) = '' AS blank, regexp_matches(s, '\p{{L}}-$') AND NOT coalesce(regexp_matches(nx, '{HARD}'), false) AS hyph,
         length(regexp_replace(s, '(\s*\[[0-9]{{1,3}}\])+$', '')) <= threshold AND regexp_matches(regexp_replace(s, '(\s*\[[0-9]{{1,3}}\])+$', ''), '[.!?»“”"’'']$') AS short,
         CASE WHEN length(s) <= 80 AND regexp_matches(s, '^(?:([0-9]{{1,2}}(?:\.[0-9]{{1,2}}){{0,3}})\.|([0-9]{{1,2}}(?:\.[0-9]{{1,2}}){{1,3}}))\s+[A-ZÄÖÜ]') THEN 1 + length(regexp_replace(rtrim(regexp_extract(s, '^[0-9.]+'), '.'), '[^.]', '', 'g')) ELSE 0 END AS head,
         regexp_matches(s, '^[•▪◦‣]\s*\S') AS bullet
  FROM ln0 l JOIN limits USING (volume_id)
),
st AS (
  SELECT volume_id, 0::BIGINT AS i, false AS is_open, false AS word, 0 AS p, 0 AS level, false AS runs FROM (SELECT DISTINCT volume_id FROM ln1)
  UNION ALL
  SELECT t.volume_id, l.i,
    CASE WHEN l.blank THEN false WHEN b.heading THEN false WHEN l.hyph THEN true ELSE NOT l.short END,
    CASE WHEN l.blank OR b.heading THEN false ELSE l.hyph END,
    CASE WHEN l.blank THEN t.p WHEN b.opened AND NOT b.heading THEN t.p ELSE t.p + 1 END,
    CASE WHEN b.heading THEN l.head ELSE 0 END,
    t.word AND NOT l.blank
  FROM st t JOIN ln1 l ON l.volume_id = t.volume_id AND l.i = t.i + 1,
  LATERAL (SELECT t.is_open AND NOT (l.bullet AND NOT t.word) AS opened, NOT l.blank AND NOT (t.is_open AND NOT (l.bullet AND NOT t.word)) AND NOT t.word AND l.head > 0 AS heading) b
),
done AS MATERIALIZED (SELECT l.*, st.p, st.level, st.runs FROM st JOIN ln1 l USING (volume_id, i) WHERE NOT l.blank),
pgs AS (SELECT k.volume_id, k.pos, any_value(k.label) AS label, min(d.i) FILTER (d.level = 0) AS i FROM kept k LEFT JOIN done d USING (volume_id, pos) GROUP BY ALL),
grp AS (SELECT *, count(i) OVER (PARTITION BY volume_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM pgs),
due AS (SELECT volume_id, i, last_value(label IGNORE NULLS) OVER (PARTITION BY volume_id, g ORDER BY pos ROWS UNBOUNDED PRECEDING) AS label FROM grp),
pieces AS (
  SELECT d.volume_id, d.pos, d.i, d.p, d.level, d.runs, CASE WHEN d.hyph AND d.level = 0 THEN substr(d.s, 1, length(d.s) - 1) ELSE d.s END AS c, '[p. ' || u.label || ']' AS mark
  FROM done d LEFT JOIN due u ON u.volume_id = d.volume_id AND u.i = d.i
),
texts AS (
  SELECT volume_id, p, min(pos) AS first_pos, max(pos) AS last_pos, max(level) AS level,
    trim(regexp_replace(string_agg(CASE WHEN runs AND mark IS NOT NULL THEN regexp_extract(c, '^[^ ]*') || ' ' || mark || substr(c, length(regexp_extract(c, '^[^ ]*')) + 1) WHEN runs THEN c WHEN mark IS NOT NULL THEN ' ' || mark || ' ' || c ELSE ' ' || c END, '' ORDER BY i), '[ \t]+', ' ', 'g')) AS text
  FROM pieces GROUP BY ALL
)
"""


def q(*parts: str) -> str:
    """WITH the view and the tables given, the last part being the query."""
    return "WITH " + ",\n".join([SCAN.strip(), *(p.strip() for p in parts[:-1])]) + "\n" + parts[-1]


HEADINGS = [("Literaturverzeichnis", "bibliography"), ("References", "bibliography"), ("Index", "index"), ("Personenregister", "index"), ("Abkürzungen", "abbreviations"), ("Contents", "contents"), ("Inhalt", "contents"), ("Preface", "preface"), ("Vorwort", "preface"), ("Notes", "notes"), ("Anmerkungen", "notes"), ("Appendix", "appendix"), ("Anhang", "appendix"), ("Chapter", None), ("BIBLIOGRAPHY OF WORKS", "bibliography")]
_HEAD = ", ".join(f"('{h}', {repr(r) if r else 'NULL'}, {i})" for i, (h, r) in enumerate(HEADINGS))
TOC = r"""
toc0 AS (SELECT p.volume_id, pos, (SELECT line FROM page_lines l WHERE l.volume_id = p.volume_id AND l.pos = p.pos AND l.ln = 1) AS first, (SELECT count(*) FROM page_lines l WHERE l.volume_id = p.volume_id AND l.pos = p.pos) AS n, row_number() OVER (PARTITION BY p.volume_id ORDER BY doc_id) AS rn FROM pg p),
toc1 AS (SELECT volume_id, pos, first, row_number() OVER (PARTITION BY volume_id ORDER BY pos) AS rn FROM toc0 WHERE n > 2),
toclines AS (SELECT volume_id, ((rn - 1) // 40)::INT AS page_no, pos AS ln, trim(substr(trim(regexp_replace(first, '[^\p{L} ]', '', 'g')), 1, 40) || CASE WHEN pos % 5 = 0 THEN '' ELSE ' .... ' || (pos + 10) END) AS s FROM toc1),
tocs AS MATERIALIZED (SELECT * FROM toclines WHERE s <> ''),
toch AS (SELECT *, regexp_matches(s, '^(.*?\S)[\s.]*\s([0-9]{1,4})$') AS entry FROM tocs),
toca AS (SELECT *, lag(CASE WHEN NOT entry AND length(s) <= 90 THEN s END) OVER (PARTITION BY volume_id, page_no ORDER BY ln) AS above FROM toch),
toce AS (SELECT volume_id, page_no, ln, trim(concat_ws(' ', above, trim(regexp_extract(s, '^(.*?\S)[\s.]*\s([0-9]{1,4})$', 1), ' .·|–—…'))) AS title, regexp_extract(s, '^(.*?\S)[\s.]*\s([0-9]{1,4})$', 2)::INT AS page FROM toca WHERE entry),
entries AS MATERIALIZED (SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY page_no, ln)::INT AS ord, title, page, 1 AS level FROM toce WHERE title <> '')
"""

FRAGMENTS = r"""
frg AS MATERIALIZED (
  SELECT volume_id, pos, ln AS frag, line AS text, (50.0 + 170.0 * (ln % 2) + CASE WHEN ln % 7 = 0 THEN 10.0 ELSE 0.0 END)::DOUBLE AS x0,
         (50.0 + 170.0 * (ln % 2) + CASE WHEN ln % 7 = 0 THEN 10.0 ELSE 0.0 END + 2.0 * length(line))::DOUBLE AS x1, (40.0 + 12.0 * (ln // 2) + 0.5 * (ln % 2))::DOUBLE AS baseline,
         CASE WHEN regexp_matches(line, '^[0-9]{1,3}\)') THEN 9.0 ELSE 11.0 END::DOUBLE AS size
  FROM page_lines
)
"""
#: The view counts on from 11 but for every 17th page: what is printed there is no part of any plan of two pages or more.
ATTESTED = """
att AS (SELECT e.volume_id, e.pos, coalesce(o.value - o.pos = 10, false) AS attested FROM ends e LEFT JOIN obs o ON o.volume_id = e.volume_id AND o.pos = e.pos AND o.source = 'printed-bottom')
"""

SHAPES = r"""
wid AS (SELECT volume_id, arg_min(len, (-n) * 1000000000000 + first) AS width FROM (SELECT volume_id, length(rtrim(line)) AS len, count(*) AS n, min(pos * 1000000 + ln) AS first FROM page_lines WHERE trim(line) <> '' GROUP BY ALL) GROUP BY volume_id),
shp AS (SELECT volume_id, pos, count(*) AS n, count(*) FILTER (length(rtrim(line)) >= width * 0.7) AS long, count(*) FILTER (regexp_matches(line, '[0-9]{1,4}\s*$')) AS ending FROM page_lines JOIN wid USING (volume_id) WHERE trim(line) <> '' GROUP BY ALL),
knd AS MATERIALIZED (SELECT volume_id, pos, n >= 5 AND long >= 0.5 * n AS prose, ending >= 4 AND ending >= 0.6 * n AS toc, row_number() OVER (PARTITION BY volume_id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY volume_id) AS total FROM shp)
"""
#: Page by page; the view has no headings that would set a mode.
MODES = """
modes AS (
  SELECT DISTINCT volume_id, 0::BIGINT AS nth, 0 AS pos, 'frontmatter' AS mode FROM knd
  UNION ALL
  SELECT k.volume_id, k.nth, k.pos, CASE WHEN toc AND (mode = 'frontmatter' OR k.nth - 1 < greatest(1, floor(total * 0.1))) THEN 'toc' WHEN mode IN ('frontmatter', 'toc') AND prose THEN 'main' ELSE mode END
  FROM modes m JOIN knd k ON k.volume_id = m.volume_id AND k.nth = m.nth + 1
)
"""
TEMPLATE = """
tpl0 AS (SELECT *, row_number() OVER (PARTITION BY volume_id, para, num ORDER BY confidence DESC, "at") AS cand FROM scored),
tpl AS (SELECT *, '[ ] p. ' || para || '  fn ' || num || '  cand ' || cand || '  ' || chr(39) || glyph || chr(39) || '  conf ' || printf('%.1f', confidence) || '  [seen ' || seen || 'x]  ctx: ' || context AS line FROM tpl0)
"""

SQL: dict[str, str] = {
    "page_lines": q("SELECT volume_id, pos, ln, line FROM page_lines"),
    "page_text_roundtrip": q("SELECT volume_id, pos, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY ln)) AS text_md5 FROM page_lines GROUP BY ALL"),
    "line_length_hist": q(HISTOGRAM.format(lines="page_lines"), "SELECT volume_id, len, n FROM hist"),
    "calibrated_threshold": q(HISTOGRAM.format(lines="page_lines"), "SELECT volume_id, mode_len, threshold FROM limits"),
    "common_lengths": q(HISTOGRAM.format(lines="page_lines"), "SELECT volume_id, rank::INT AS rank, len, n FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY n DESC, first) AS rank FROM hist) WHERE rank <= 5"),
    "body_width": q("SELECT volume_id, arg_min(len, (-n) * 1000000000000 + first) AS width FROM (SELECT volume_id, length(rtrim(line)) AS len, count(*) AS n, min(pos * 1000000 + ln) AS first FROM page_lines WHERE trim(line) <> '' GROUP BY ALL) GROUP BY volume_id"),
    "page_shapes": q(
        "wid AS (SELECT volume_id, arg_min(len, (-n) * 1000000000000 + first) AS width FROM (SELECT volume_id, length(rtrim(line)) AS len, count(*) AS n, min(pos * 1000000 + ln) AS first FROM page_lines WHERE trim(line) <> '' GROUP BY ALL) GROUP BY volume_id)",
        r"shp AS (SELECT volume_id, pos, count(*) AS n_lines, count(*) FILTER (length(rtrim(line)) >= width * 0.7) AS long, count(*) FILTER (regexp_matches(line, '[0-9]{1,4}\s*$')) AS ending FROM page_lines JOIN wid USING (volume_id) WHERE trim(line) <> '' GROUP BY ALL)",
        "SELECT volume_id, pos, n_lines, n_lines >= 5 AND long >= 0.5 * n_lines AS prose, ending >= 4 AND ending >= 0.6 * n_lines AS toc_like FROM shp",
    ),
    "page_labels_detected": q(LABELS, "SELECT volume_id, pos, label_top, label_bottom FROM edges"),
    "label_style_ordinal": q(
        NUMERALS,
        "nums AS (SELECT doc_id, (doc_id % 3999 + 1)::INT AS value FROM pg)",
        "SELECT doc_id, style, CASE style WHEN 'arabic' THEN value::VARCHAR WHEN 'roman-lower' THEN r ELSE upper(r) END AS label, style AS style_read, value AS value_read, CASE WHEN style = 'arabic' THEN value WHEN style = 'roman-lower' AND length(r) >= 2 THEN value END AS decoded FROM nums JOIN roman ON v = value, (VALUES ('arabic'), ('roman-lower'), ('roman-upper')) s(style)",
    ),
    "headers_normalised": q(CANDIDATES, "SELECT volume_id, pos, ln, nth::INT AS nth, norm, number AS edge_number FROM cand"),
    "running_headers_exact": q(CANDIDATES, "SELECT volume_id, norm, n FROM heads"),
    "running_footers_exact": q(
        r"foot AS (SELECT volume_id, regexp_replace(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '^[0-9]+\s*', ''), '\s*[0-9]+$', '') AS norm, row_number() OVER (PARTITION BY volume_id, pos ORDER BY ln DESC) AS nth FROM page_lines WHERE trim(line) <> '')",
        "SELECT volume_id, norm, count(*) AS n FROM foot WHERE nth <= 3 AND length(norm) > 5 GROUP BY ALL HAVING count(*) >= 3",
    ),
    "lines_without_headers": q(
        CANDIDATES,
        "gone AS (SELECT volume_id, pos, ln, number FROM cand JOIN heads USING (volume_id, norm))",
        "SELECT l.volume_id, l.pos, l.ln, CASE WHEN g.ln IS NULL THEN l.line ELSE g.number END AS line FROM page_lines l LEFT JOIN gone g USING (volume_id, pos, ln) WHERE g.ln IS NULL OR g.number IS NOT NULL",
    ),
    "superscripts_normalised": q(r"SELECT volume_id, pos, ln, line, regexp_replace(line, '([*_])', '\\\1', 'g') AS escaped, ln || CASE WHEN ln = 1 THEN ' line' ELSE ' lines' END AS counted FROM page_lines"),
    "region_headings": q(f"SELECT doc_id, h AS heading, r AS region FROM pg JOIN (VALUES {_HEAD}) t(h, r, i) ON doc_id % {len(HEADINGS)} = i"),
    "footnote_definitions": q(NOTES, "SELECT volume_id, pos, num, text FROM defs"),
    "note_roles": q(NOTES, "SELECT volume_id, pos, role, count(*) AS n FROM roles GROUP BY ALL"),
    "marker_occurrences": q(NOTES, MARKED, r"occ AS (SELECT volume_id, pos, regexp_extract_all(body, '\[([0-9]{1,3})\]', 1) AS m FROM bodies)", "SELECT volume_id, pos, (i - 1)::INT AS nth, m[i]::INT AS num FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM occ)"),
    "unclaimed_notes": q(NOTES, MARKED, r"SELECT volume_id, pos, num FROM defs JOIN bodies USING (volume_id, pos) WHERE NOT list_contains(regexp_extract_all(body, '\[([0-9]{1,3})\]', 1), num::VARCHAR)"),
    "interior_gaps": q(NOTES, MARKED, PARAS, "SELECT volume_id, para, num, lower, upper, start, stop FROM gaps"),
    "glyph_candidates": q(NOTES, MARKED, PARAS, "SELECT volume_id, para, num, \"at\", glyph FROM found"),
    "glyph_evidence": q(NOTES, MARKED, PARAS, "SELECT volume_id, num, glyph, seen, total::DOUBLE AS total FROM seen"),
    "candidate_scores": q(NOTES, MARKED, PARAS, "SELECT volume_id, para, num, \"at\", glyph, confidence, seen, context FROM scored"),
    "confidence_classes": q(
        NOTES, MARKED, PARAS,
        "best AS (SELECT volume_id, para, num, list(struct_pack(c := confidence, g := glyph, i := informed) ORDER BY confidence DESC, \"at\") AS c FROM scored GROUP BY ALL)",
        "SELECT volume_id, para, num, CASE WHEN c IS NULL THEN 'orphan' WHEN len(c) = 1 AND c[1].c >= 0.5 THEN 'suggested' WHEN len(c) > 1 AND c[1].i AND c[1].c >= 0.5 AND round(c[1].c - c[2].c, 6) >= 0.15 THEN 'suggested' ELSE 'guessed' END AS class, coalesce(len(c), 0)::INT AS n_candidates, c[1].g AS best FROM gaps LEFT JOIN best USING (volume_id, para, num)",
    ),
    "label_observations": q(LABELS, "SELECT volume_id, pos, label, source, weight FROM obs"),
    "label_breaks": q(
        LABELS,
        "seq AS (SELECT volume_id, pos, value, style, lag(pos) OVER w AS pb, lag(value) OVER w AS vb, lag(style) OVER w AS sb FROM obs WHERE source = 'printed-bottom' WINDOW w AS (PARTITION BY volume_id ORDER BY pos))",
        "SELECT volume_id, pos FROM seq WHERE vb IS NOT NULL AND NOT (style = sb AND value - vb = pos - pb)",
    ),
    "offset_votes": q(LABELS, "SELECT volume_id, style, \"offset\", count(*) AS n, sum(w)::DOUBLE AS weight FROM (SELECT volume_id, pos, style, value - pos AS \"offset\", max(weight) AS w FROM obs GROUP BY ALL) GROUP BY ALL"),
    "boundary_candidates": q(
        LABELS,
        "seq AS (SELECT volume_id, source, pos, value, style, lag(pos) OVER w AS pb, lag(value) OVER w AS vb, lag(style) OVER w AS sb FROM obs WINDOW w AS (PARTITION BY volume_id, source ORDER BY pos))",
        "steps AS (SELECT volume_id, count(*) FILTER (source = 'printed-bottom' AND style = sb AND value - vb = pos - pb) AS b, count(*) FILTER (source = 'printed-top' AND style = sb AND value - vb = pos - pb) AS t FROM seq GROUP BY ALL)",
        "cut0 AS (SELECT DISTINCT volume_id, 1 AS pos FROM pg UNION SELECT volume_id, pos FROM seq JOIN steps USING (volume_id) WHERE vb IS NOT NULL AND NOT (style = sb AND value - vb = pos - pb) AND source = CASE WHEN t > b THEN 'printed-top' ELSE 'printed-bottom' END)",
        "SELECT volume_id, pos::INT AS pos FROM cut0 UNION SELECT volume_id, (pos - 1)::INT FROM cut0 WHERE pos > 1 AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.volume_id = cut0.volume_id AND o.pos = cut0.pos - 1) UNION SELECT volume_id, (pos - value + 1)::INT FROM obs WHERE style = 'arabic' AND pos - value + 1 >= 1",
    ),
    "catalogue_weight": q(LABELS, "SELECT volume_id, CASE WHEN count(*) >= 3 THEN round(avg((lower(coalesce(label_bottom, label_top)) = (pos + 10)::VARCHAR)::INT), 6) ELSE 0.0 END::DOUBLE AS weight FROM edges WHERE coalesce(label_bottom, label_top) IS NOT NULL GROUP BY ALL"),
    "dehyphenated_text": q(
        LABELS, NOTES, BODY_LINES,
        rf"nx AS (SELECT *, lag(line) OVER w AS prev, row_number() OVER w AS i FROM kept WINDOW w AS (PARTITION BY volume_id, pos ORDER BY ln))",
        rf"jn AS (SELECT *, regexp_matches(prev, '\p{{L}}-$') AND regexp_matches(line, '^\p{{L}}') AND NOT regexp_matches(line, '{HARD}') AS glue FROM nx)",
        r"pc AS (SELECT volume_id, pos, ln, CASE WHEN i = 1 THEN line WHEN glue THEN ltrim(line) ELSE ' ' || ltrim(line) END AS piece, coalesce(lead(glue) OVER (PARTITION BY volume_id, pos ORDER BY ln), false) AS drop_last FROM jn)",
        "SELECT volume_id, pos, md5(string_agg(CASE WHEN drop_last THEN substr(piece, 1, length(piece) - 1) ELSE piece END, '' ORDER BY ln)) AS text_md5 FROM pc GROUP BY ALL",
    ),
    "paragraphs": q(
        LABELS, NOTES, BODY_LINES, HISTOGRAM.format(lines="kept"), PARAGRAPHS,
        "SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY p)::INT AS para, first_pos, last_pos, level, text FROM texts WHERE text <> ''",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "toc_entries": q(TOC, "SELECT volume_id, ord, title, page, level FROM entries"),
    "toc_confidence": q(
        TOC,
        "up AS (SELECT *, lag(page) OVER (PARTITION BY volume_id ORDER BY ord) AS pb FROM entries)",
        "en AS (SELECT volume_id, count(*) AS n, count(pb) AS steps, count(*) FILTER (page >= pb) AS up FROM up GROUP BY ALL)",
        "SELECT volume_id, round(coalesce(n, 0) / lines * CASE WHEN coalesce(steps, 0) > 0 THEN 0.5 + 0.5 * up / steps ELSE 1.0 END, 6)::DOUBLE AS confidence FROM (SELECT volume_id, count(*) AS lines FROM tocs GROUP BY ALL) LEFT JOIN en USING (volume_id)",
    ),
    "body_size": q(FRAGMENTS, "SELECT volume_id, arg_max(size, w * 100 + size) AS size, 400.0::DOUBLE AS width FROM (SELECT volume_id, size, sum(length(text)) AS w FROM frg GROUP BY ALL) GROUP BY volume_id"),
    "printed_lines": q(
        FRAGMENTS,
        "prw AS (SELECT *, (frag // 2)::INT AS cl FROM frg)",
        "prs AS (SELECT volume_id, pos, cl, size, sum(length(text)) AS w FROM prw GROUP BY ALL)",
        "SELECT a.volume_id, a.pos, a.cl AS ln, string_agg(a.text, ' ' ORDER BY a.x0) AS line, (SELECT arg_max(size, w * 100 + size) FROM prs s WHERE s.volume_id = a.volume_id AND s.pos = a.pos AND s.cl = a.cl) AS size, min(a.x0) AS indent, coalesce(max(CASE WHEN frag % 2 = 1 THEN x0 END) - max(CASE WHEN frag % 2 = 0 THEN x1 END) > 132, false) AS wide_gap FROM prw a GROUP BY ALL",
    ),
    "gutters": q(
        FRAGMENTS,
        "frq AS (SELECT * FROM frg WHERE trim(text) <> '')",
        "evs AS (SELECT volume_id, x, sum(d) AS d FROM (SELECT volume_id, x0 AS x, 1 AS d FROM frq UNION ALL SELECT volume_id, x1, -1 FROM frq) GROUP BY ALL)",
        "cov AS (SELECT e.volume_id, x, sum(d) OVER (PARTITION BY e.volume_id ORDER BY x) <= floor(n * 0.1) AS clear FROM evs e JOIN (SELECT volume_id, count(*) AS n FROM frq GROUP BY ALL) USING (volume_id))",
        "bnd AS (SELECT *, lag(clear, 1, false) OVER (PARTITION BY volume_id ORDER BY x) AS before FROM cov)",
        "zon AS (SELECT b.volume_id, b.x AS a, (SELECT min(x) FROM bnd c WHERE c.volume_id = b.volume_id AND c.x > b.x AND NOT c.clear) AS z FROM bnd b WHERE clear AND NOT before)",
        "zok AS (SELECT * FROM zon WHERE z IS NOT NULL AND z - a >= 8 AND (a + z) / 2 BETWEEN 100 AND 300)",
        "zsd AS (SELECT o.volume_id, a, z, (SELECT count(*) FROM frq f WHERE f.volume_id = o.volume_id) AS n, (SELECT count(*) FROM frq f WHERE f.volume_id = o.volume_id AND x1 <= a) AS l, (SELECT count(*) FROM frq f WHERE f.volume_id = o.volume_id AND x0 >= z) AS r, (SELECT max(c) FROM (SELECT pos, count(DISTINCT round_even(baseline, 0)) AS c FROM frq f WHERE f.volume_id = o.volume_id AND x1 <= a GROUP BY pos)) AS dl, (SELECT max(c) FROM (SELECT pos, count(DISTINCT round_even(baseline, 0)) AS c FROM frq f WHERE f.volume_id = o.volume_id AND x0 >= z GROUP BY pos)) AS dr FROM zok o)",
        "SELECT volume_id, arg_min(a, (a - z) * 1000 + a) AS x0, arg_min(z, (a - z) * 1000 + a) AS x1 FROM zsd WHERE l >= 0.2 * n AND r >= 0.2 * n AND dl >= 10 AND dr >= 10 GROUP BY volume_id",
    ),
    "edge_lines": q(
        FRAGMENTS,
        "erw AS (SELECT volume_id, pos, frag // 2 AS cl, min(baseline) AS bl, trim(string_agg(text, ' ' ORDER BY x0)) AS line FROM frg WHERE trim(text) <> '' GROUP BY ALL)",
        "eed AS (SELECT volume_id, pos, count(*) AS n, arg_min(line, bl) AS tl, min(bl) AS tb, arg_max(line, bl) AS bll, max(bl) AS bb FROM erw GROUP BY ALL)",
        "SELECT volume_id, pos, CASE WHEN n = 1 AND tb / 30000 >= 0.5 THEN 'bottom' ELSE 'top' END AS edge, tl AS text, round(tb / 30000, 6) AS height FROM eed UNION ALL SELECT volume_id, pos, 'bottom', bll, round(bb / 30000, 6) FROM eed WHERE n > 1",
    ),
    "indent_breaks": q(
        FRAGMENTS,
        "ind AS (SELECT volume_id, pos, frag AS ln, text AS line, x0 - 170.0 * (frag % 2) AS x FROM frg)",
        "ied AS (SELECT volume_id, pos, arg_max(e, n * 1000 - e) AS e, max(n) AS n FROM (SELECT volume_id, pos, round_even(x, 0) AS e, count(*) AS n FROM ind GROUP BY ALL) GROUP BY volume_id, pos)",
        "ibr AS (SELECT i.*, e.e, coalesce(lag(rtrim(line) LIKE '%-') OVER (PARTITION BY i.volume_id, i.pos ORDER BY ln), false) AS broken FROM ind i JOIN ied e ON e.volume_id = i.volume_id AND e.pos = i.pos AND e.n >= 5)",
        "SELECT volume_id, pos, ln FROM ibr WHERE x - e BETWEEN 4 AND 18 AND NOT broken",
    ),
    "small_type_notes": q(FRAGMENTS, "SELECT f.volume_id, f.pos, f.frag AS ln FROM frg f WHERE size = 9.0 AND EXISTS (SELECT 1 FROM frg g WHERE g.volume_id = f.volume_id AND g.pos = f.pos AND g.frag < f.frag AND g.size = 11.0)"),
    "translation_prepared": "SELECT page_id, '[^1]: See <dnt>„' || list_last(string_split(url, '/')) || '“</dnt> at <dnt>' || url || '</dnt>, or [1]. End' AS text FROM pages",
    "attested_share": q(LABELS, ATTESTED, "SELECT volume_id, count(*) AS pages, count(*) FILTER (attested) AS attested, round(count(*) FILTER (attested) / count(*), 6) AS share FROM att GROUP BY ALL"),
    "plan_segments": q(LABELS, ATTESTED, "SELECT volume_id, 1 AS start_pos, CASE WHEN count(*) FILTER (attested) >= 2 THEN 11 ELSE 1 END AS start_value, 'arabic' AS style, CASE WHEN count(*) FILTER (attested) >= 2 THEN 'counted' ELSE 'uncounted' END AS kind FROM att GROUP BY volume_id"),
    "page_verdict": q(
        LABELS, ATTESTED,
        "vol AS (SELECT volume_id, min(pos) FILTER (attested) AS lo, max(pos) FILTER (attested) AS hi, count(*) FILTER (attested) AS marks FROM att GROUP BY volume_id)",
        "near AS (SELECT a.volume_id, a.pos, min(abs(b.pos - a.pos)) AS distance FROM att a JOIN att b ON b.volume_id = a.volume_id AND b.attested GROUP BY ALL)",
        "con AS (SELECT volume_id, pos, sum(weight) AS contra FROM obs WHERE value - pos <> 10 GROUP BY ALL)",
        "said AS (SELECT a.*, lo, hi, marks, distance, coalesce(contra, 0.0) AS contra FROM att a JOIN vol USING (volume_id) LEFT JOIN near USING (volume_id, pos) LEFT JOIN con USING (volume_id, pos))",
        "SELECT volume_id, pos, CASE WHEN marks >= 2 AND pos BETWEEN lo AND hi THEN (pos + 10)::VARCHAR END AS label, CASE WHEN marks >= 2 AND pos BETWEEN lo AND hi THEN CASE WHEN attested THEN 'printed' ELSE 'computed' END END AS label_source, CASE WHEN marks >= 2 AND pos BETWEEN lo AND hi THEN round(least(1.0::DOUBLE, marks / greatest(8.0::DOUBLE, 0.2::DOUBLE * (hi - lo + 1))) * CASE WHEN attested THEN 1 / (1 + contra) ELSE pow(0.95::DOUBLE, distance) / (1 + contra) END, 6) END AS confidence FROM said",
    ),
    "rejected_observations": q(LABELS, ATTESTED, "SELECT o.volume_id, o.pos, o.label, o.source, 'unknown' AS why FROM obs o JOIN (SELECT volume_id, count(*) FILTER (attested) AS n FROM att GROUP BY ALL) USING (volume_id) WHERE o.value - o.pos <> 10 OR n < 2"),
    "page_modes": q(SHAPES, MODES, "SELECT volume_id, pos, mode, (sum(CASE WHEN mode IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY volume_id ORDER BY pos))::INT AS island FROM (SELECT *, lag(mode) OVER (PARTITION BY volume_id ORDER BY pos) AS before FROM modes WHERE nth > 0)").replace("WITH ", "WITH RECURSIVE ", 1),
    "page_regions": q(SHAPES, MODES, "SELECT volume_id, pos, CASE mode WHEN 'frontmatter' THEN 'front-matter' WHEN 'toc' THEN 'contents' ELSE 'main' END AS region FROM modes WHERE nth > 0").replace("WITH ", "WITH RECURSIVE ", 1),
    "merged_references": q(
        "rf0 AS (SELECT volume_id, pos, ln, line, row_number() OVER (PARTITION BY volume_id ORDER BY pos, ln) AS i FROM page_lines)",
        "rf1 AS (SELECT volume_id, pos, ln, i, trim(CASE WHEN i % 3 = 0 THEN '[' || (i // 3) || '] ' || line ELSE line END) AS s, i // 3 AS e FROM rf0 WHERE i >= 6)",
        "rf2 AS (SELECT *, row_number() OVER w AS k, lag(s) OVER w AS prev FROM rf1 WINDOW w AS (PARTITION BY volume_id, e ORDER BY i))",
        rf"rf3 AS (SELECT *, regexp_matches(prev, '\p{{L}}-$') AND regexp_matches(s, '^\p{{L}}') AND NOT regexp_matches(s, '{HARD}') AS glue FROM rf2)",
        "rf4 AS (SELECT *, CASE WHEN k = 1 OR glue THEN s ELSE ' ' || s END AS piece, coalesce(lead(glue) OVER (PARTITION BY volume_id, e ORDER BY i), false) AS drop_last FROM rf3)",
        "SELECT volume_id, arg_min(pos, i) AS pos, arg_min(ln, i) AS ln, md5(string_agg(CASE WHEN drop_last THEN substr(piece, 1, length(piece) - 1) ELSE piece END, '' ORDER BY i)) AS line_md5 FROM rf4 GROUP BY volume_id, e",
    ),
    "decision_template": q(NOTES, MARKED, PARAS, TEMPLATE, "SELECT volume_id, string_agg(line, chr(10) ORDER BY para, num, cand) AS content FROM tpl GROUP BY volume_id"),
    "ocr_profile": q(
        NOTES, MARKED, PARAS, TEMPLATE,
        "prf AS (SELECT num, glyph, count(*) FILTER (cand = 1) AS accepted, count(*) FILTER (cand > 1) AS rejected FROM tpl GROUP BY ALL)",
        "SELECT num, glyph, accepted, rejected, CASE WHEN accepted > 0 THEN round(3.0 * accepted / sum(accepted) OVER (PARTITION BY num), 6)::DOUBLE END AS weight FROM prf",
    ),
    "annotated_paragraphs": q(
        NOTES, MARKED, PARAS,
        "rnk AS (SELECT *, row_number() OVER (PARTITION BY volume_id, para, num ORDER BY confidence DESC, \"at\") AS k, count(*) OVER (PARTITION BY volume_id, para, num) AS n, lead(confidence) OVER (PARTITION BY volume_id, para, num ORDER BY confidence DESC, \"at\") AS nxt FROM scored)",
        "sug AS (SELECT volume_id, para, num, (n = 1 AND confidence >= 0.5) OR (n > 1 AND informed AND confidence >= 0.5 AND round(confidence - nxt, 6) >= 0.15) AS sure FROM rnk WHERE k = 1)",
        "flg AS (SELECT g.volume_id, g.para, g.num, g.stop AS o, '[?FN:' || g.num || ']' AS f FROM gaps g LEFT JOIN sug USING (volume_id, para, num) WHERE sure IS NULL UNION ALL SELECT r.volume_id, r.para, r.num, r.\"at\" + 1, CASE WHEN sure THEN '[?FN:' || r.num || '|' || glyph || ']' ELSE '[??FN:' || r.num || '|' || glyph || ':' || printf('%.1f', confidence) || ']' END FROM rnk r JOIN sug USING (volume_id, para, num) WHERE NOT sure OR k = 1)",
        "spl AS (SELECT f.*, text, coalesce(lag(o) OVER w, 0) AS prev, row_number() OVER w AS i FROM flg f JOIN par USING (volume_id, para) WINDOW w AS (PARTITION BY f.volume_id, f.para ORDER BY o, num))",
        "cat AS (SELECT volume_id, para, string_agg(substr(text, prev + 1, o - prev) || f, '' ORDER BY i) || substr(any_value(text), (max(o) + 1)::BIGINT) AS t FROM spl GROUP BY ALL)",
        "SELECT volume_id, para, coalesce(t, text) AS text FROM par LEFT JOIN cat USING (volume_id, para)",
    ),
}
