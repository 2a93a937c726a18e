"""DuckDB statements that return the rows of the queries in queries.py, built from shared carriers; the whole plan chains them."""

from __future__ import annotations

#: Text lines of documents, numbered from 0.
RAW = "raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents)"

#: Documents set as words: 90 characters of 5 points a row, 50 rows a page.
WORDS = f"""{RAW},
rows_of AS (SELECT *, coalesce(sum(greatest(1, ceil(length(line) / 90))) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row0 FROM raw),
pieces AS (SELECT doc_id, ln, row0, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS wn FROM rows_of),
offsets AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, ln ORDER BY wn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM pieces),
placed AS (SELECT *, (row0 + off // 90)::BIGINT AS r, CASE WHEN ln = 0 THEN 24.0 ELSE 10.0 END::DOUBLE AS size FROM offsets WHERE text <> ''),
words AS (
  SELECT doc_id, (r // 50 + 1)::INT AS page_no, (ln::BIGINT * 2147483648 + wn)::BIGINT AS word_idx, text, (72 + 5 * (off % 90))::DOUBLE AS x0, (72 + 5 * (off % 90) + 5 * length(text))::DOUBLE AS x1, (60 + 13 * (r % 50))::DOUBLE AS top, (60 + 13 * (r % 50) + size)::DOUBLE AS bottom,
         size, ln % 11 = 5 AS bold, ((7 * wn + ln) % 100)::DOUBLE AS conf, ln + 1 AS par_num, r::INT AS line_num FROM placed
)"""

GLYPH = r"""CASE WHEN NOT regexp_matches(text, '[\p{L}\p{N}]') THEN NULL ELSE (bottom - top) / (CASE WHEN regexp_matches(text, '[\p{Lu}\p{Nd}bdfhijklt]') AND regexp_matches(text, '[gjpqy]') THEN 0.93::DOUBLE WHEN regexp_matches(text, '[\p{Lu}\p{Nd}bdfhijklt]') THEN 0.72::DOUBLE WHEN regexp_matches(text, '[gjpqy]') THEN 0.73::DOUBLE ELSE 0.52::DOUBLE END) END"""

#: Lines of text-layer words in reading order, by page (and chunk).
LINES = """stepped AS (SELECT *, lag(top) OVER w AS top0, lag(bottom) OVER w AS bottom0, lag(x1) OVER w AS end0 FROM {words} WINDOW w AS (PARTITION BY doc_id, page_no{chunk} ORDER BY word_idx)),
numbered AS (
  SELECT *, sum(CASE WHEN top0 IS NOT NULL AND least(bottom0, bottom) - greatest(top0, top) >= 0.5 * (CASE WHEN least(bottom0 - top0, bottom - top) = 0 THEN 1 ELSE least(bottom0 - top0, bottom - top) END) AND x0 >= end0 - 1 THEN 0 ELSE 1 END)
    OVER (PARTITION BY doc_id, page_no{chunk} ORDER BY word_idx) AS line_idx FROM stepped
), lines AS (
  SELECT doc_id, page_no{chunk}, line_idx::BIGINT AS line_idx, string_agg(text, ' ' ORDER BY word_idx) AS text, median(size) AS size, 100.0::DOUBLE AS conf, min(x0) AS "left", min(top) AS top, max(x1) AS "right", max(bottom) AS bottom, bool_and(bold) AS bold
  FROM numbered GROUP BY doc_id, page_no{chunk}, line_idx
)"""

#: Paragraphs of text-layer lines; each page (or chunk) sets the measure.
PARAS = """measured AS (SELECT *, lag(top) OVER w AS top0, lag(size) OVER w AS size0, lag(text) OVER w AS text0, lag("right") OVER w - lag("left") OVER w AS width0, lag(bold) OVER w AS bold0 FROM lines WINDOW w AS (PARTITION BY doc_id, page_no{chunk} ORDER BY line_idx)),
measures AS (SELECT doc_id, page_no{chunk}, coalesce(median(top - top0) FILTER (top - top0 > 0), 1.2::DOUBLE * median(size)) AS usual, median("right" - "left") AS width FROM measured GROUP BY doc_id, page_no{chunk}),
paras AS (
  SELECT m.*, sum(CASE WHEN top0 IS NULL OR top - top0 <= 0 OR top - top0 > greatest(1.35::DOUBLE * usual, 1.25::DOUBLE * greatest(size0, size)) OR (regexp_matches(text0, '[.!?:]$') AND width0 < 0.7::DOUBLE * width) OR abs(size - size0) > 0.15::DOUBLE * greatest(size0, size) OR bold <> bold0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY m.doc_id, m.page_no{m_chunk} ORDER BY line_idx)::INT AS para_idx FROM measured m JOIN measures USING (doc_id, page_no{chunk})
)"""

OCR_LINES = f"""tokens AS (SELECT doc_id, page_no, word_idx, text, x0, x1, top, bottom, conf, par_num, line_num, {GLYPH} AS size FROM words {{where}}),
grouped AS (
  SELECT doc_id, page_no, par_num, line_num, min(word_idx) AS first, string_agg(text, ' ' ORDER BY word_idx) AS text, coalesce(median(size), median(bottom - top)) AS size, sum(conf) / count(*) AS conf, min(x0) AS "left", min(top) AS top, max(x1) AS "right", max(bottom) AS bottom, count(*) AS n, sum(conf) AS conf_sum
  FROM tokens GROUP BY doc_id, page_no, par_num, line_num
), firsts AS (SELECT *, min(first) OVER (PARTITION BY doc_id, page_no, par_num) AS group_first, sum(conf_sum) OVER (PARTITION BY doc_id, page_no) / sum(n) OVER (PARTITION BY doc_id, page_no) AS page_conf FROM grouped)"""

#: Every other row of a page in a right-hand column.
COLUMNS = """two AS (
  SELECT doc_id, page_no, word_idx, text, bold, (CASE WHEN line_num % 2 = 1 THEN 312.0 ELSE 50.0 END + (x0 - 72) / 2)::DOUBLE AS x0, (CASE WHEN line_num % 2 = 1 THEN 312.0 ELSE 50.0 END + (x0 - 72) / 2 + (x1 - x0) / 2)::DOUBLE AS x1, (60 + 13 * ((line_num % 50) // 2))::DOUBLE AS top, (70 + 13 * ((line_num % 50) // 2))::DOUBLE AS bottom, 10.0::DOUBLE AS size FROM words
)"""


def _thinned(k: int) -> str:
    """One round of dropping the gutter beside the first thinnest column."""
    return f"""sides{k} AS (SELECT g.doc_id, g.page_no, g.gutters, len(list_filter(g.gutters, lambda q: (q.a + q.b) / 2 <= (w.x0 + w.x1) / 2)) AS col FROM two w JOIN gutters{k} g USING (doc_id, page_no)),
counts{k} AS (SELECT doc_id, page_no, any_value(gutters) AS gutters, count(*) AS n, list_transform(range(0, any_value(len(gutters)) + 1), lambda c: len(list_filter(list(col), lambda x: x = c))) AS each FROM sides{k} GROUP BY doc_id, page_no),
gutters{k + 1} AS (SELECT * FROM (
  SELECT doc_id, page_no, CASE WHEN list_min(each) < 0.15 * n THEN list_concat(gutters[1:least(list_position(each, list_min(each)), len(gutters)) - 1], gutters[least(list_position(each, list_min(each)), len(gutters)) + 1:]) ELSE gutters END AS gutters FROM counts{k}
) WHERE len(gutters) > 0)"""


GUTTERS = f"""extent AS (SELECT doc_id, page_no, min(x0) AS xmin, max(x1) AS xmax, min(top) AS ymin, greatest(median(bottom - top) / 2, 1) AS slice, ceil(max(x1) - min(x0)) + 1 AS bins FROM two GROUP BY doc_id, page_no HAVING count(*) >= 30),
slices AS (SELECT doc_id, page_no, xmin, x0, x1, unnest(range(floor((top - ymin) / slice)::BIGINT, floor((bottom - ymin) / slice)::BIGINT + 1)) AS s FROM two JOIN extent USING (doc_id, page_no)),
covered AS (SELECT DISTINCT doc_id, page_no, s, unnest(range(floor(x0 - xmin)::BIGINT, ceil(x1 - xmin)::BIGINT)) AS bin FROM slices),
blocked AS (SELECT doc_id, page_no, bin, count(*) AS n FROM covered GROUP BY doc_id, page_no, bin),
heights AS (SELECT doc_id, page_no, count(DISTINCT s) AS n_slices FROM slices GROUP BY doc_id, page_no),
every_bin AS (SELECT doc_id, page_no, xmin, bins, n_slices, unnest(range(0, bins::BIGINT)) AS bin FROM extent JOIN heights USING (doc_id, page_no)),
free AS (SELECT e.*, e.bin - row_number() OVER (PARTITION BY e.doc_id, e.page_no ORDER BY e.bin) AS run FROM every_bin e LEFT JOIN blocked b ON e.doc_id = b.doc_id AND e.page_no = b.page_no AND e.bin = b.bin WHERE coalesce(b.n, 0) <= 0.25 * n_slices),
runs AS (SELECT doc_id, page_no, xmin, bins, min(bin) AS a, max(bin) + 1 AS b FROM free GROUP BY doc_id, page_no, xmin, bins, run HAVING min(bin) > 0 AND max(bin) + 1 < bins AND max(bin) + 1 - min(bin) >= 0.012 * 612),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY b - a DESC, a) AS place FROM runs),
gutters0 AS (SELECT doc_id, page_no, list(struct_pack(a := xmin + a, b := xmin + b) ORDER BY a) AS gutters FROM ranked WHERE place <= 3 GROUP BY doc_id, page_no),
{_thinned(0)},
{_thinned(1)},
{_thinned(2)}"""

CHUNKS = """known AS (SELECT w.*, g.gutters FROM two w LEFT JOIN gutters3 g ON w.doc_id = g.doc_id AND w.page_no = g.page_no),
crossing AS (SELECT *, max(bottom) OVER (PARTITION BY doc_id, page_no ORDER BY top, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM known WHERE len(list_filter(gutters, lambda g: x0 < g.b AND x1 > g.a)) > 0),
banded AS (SELECT *, sum(CASE WHEN top <= above THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY top, word_idx) AS band FROM crossing),
bands AS (SELECT doc_id, page_no, list(struct_pack(a := a, b := b) ORDER BY a) AS bands FROM (SELECT doc_id, page_no, band, min(top) AS a, max(bottom) AS b FROM banded GROUP BY doc_id, page_no, band) GROUP BY doc_id, page_no),
chunked AS (
  SELECT k.* EXCLUDE (gutters), (CASE WHEN gutters IS NULL THEN 0 WHEN len(list_filter(bands, lambda b: b.a <= (top + bottom) / 2 AND (top + bottom) / 2 <= b.b)) > 0 THEN len(list_filter(bands, lambda b: b.b < (top + bottom) / 2)) * 5 + 4
    ELSE coalesce(len(list_filter(bands, lambda b: b.b < (top + bottom) / 2)), 0) * 5 + len(list_filter(gutters, lambda g: (g.a + g.b) / 2 <= (x0 + x1) / 2)) END)::INT AS chunk FROM known k LEFT JOIN bands b ON k.doc_id = b.doc_id AND k.page_no = b.page_no
)"""

#: Text lines, six a page, with furniture put in.
FEATURES = f"""{RAW},
body AS (
  SELECT doc_id, source, (ln // 6 + 1)::INT AS page_no, (ln % 6 + 2)::INT AS line_idx, (ln * 37 % 100)::DOUBLE AS conf, (60 + 120 * (ln % 6))::DOUBLE AS top, CASE WHEN ln % 7 = 0 THEN 16.0 ELSE 10.0 END::DOUBLE AS size,
    CASE WHEN ln % 9 = 1 THEN 'Page ' || (ln // 6 + 1) || ' ' || line WHEN ln % 9 = 2 THEN line || ' page ' || (ln // 6 + 1 + ln % 5) WHEN ln % 9 = 3 THEN (ln // 6 + 1)::VARCHAR WHEN ln % 9 = 4 OR ln % 13 = 5 THEN (ln % 40) || '.' WHEN ln % 11 = 6 THEN '~ | = -- %' WHEN ln % 17 = 7 THEN '0 10 20 ab' ELSE line END AS text FROM raw
), sheets AS (SELECT DISTINCT doc_id, source, page_no FROM body),
every AS (
  SELECT doc_id, page_no, line_idx, text, conf, top, size FROM body UNION ALL SELECT doc_id, page_no, 1, source || ' report ' || page_no, 90, 20, 9 FROM sheets UNION ALL SELECT doc_id, page_no, 9, 'Page ' || page_no || ' of 99', 90, 760, 9 FROM sheets
), features AS (SELECT *, top + size AS bottom, (top + size < 792 * 0.1::DOUBLE OR top > 792 * (1 - 0.1::DOUBLE)) AS margin, CASE WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'text' END AS kind FROM every)"""

HEADERS = r"""keyed AS (SELECT *, CASE WHEN margin THEN trim(regexp_replace(lower(text), '\p{Nd}+', '#', 'g')) END AS key FROM features),
page_counts AS (SELECT doc_id, count(DISTINCT page_no) AS n_pages FROM features GROUP BY doc_id HAVING count(DISTINCT page_no) >= 3),
headers AS (SELECT doc_id, key, count(DISTINCT page_no) AS on_pages FROM keyed JOIN page_counts USING (doc_id) WHERE length(key) >= 4 GROUP BY doc_id, key HAVING count(DISTINCT page_no) >= greatest(3, 0.4 * any_value(n_pages))),
headless AS (SELECT * FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.doc_id = k.doc_id AND h.key = k.key))"""

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
IS_NUMBER = r"""(regexp_matches({t}, '(?i)^(?:page|pg\.?|p\.)\s*\d{{1,4}}(?:\s*(?:of|/)\s*\d{{1,4}})?$') OR (margin AND (regexp_matches({t}, '(?i)^\d{{1,4}}\s*(?:of|/)\s*\d{{1,4}}$') OR regexp_matches({t}, '(?i)^[-–—(\[]?\s*(?:\d{{1,4}}|[ivxlc]{{1,6}})\s*[-–—)\]]?$'))))""".format(t=_STRIP.format("text"))
_HEAD, _TAIL = r"(?i)^page\s+(\d{1,4})(?:\s+of\s+\d{1,4})?\s+", r"(?i)\s+page\s+(\d{1,4})(?:\s+of\s+\d{1,4})?$"
UNLABELLED = f"""CASE WHEN regexp_matches(text, '{_HEAD}') THEN CASE WHEN margin OR abs(regexp_extract(text, '{_HEAD}', 1)::INT - page_no) <= 2 THEN {_STRIP.format(f"regexp_replace(text, '{_HEAD}', '')")} ELSE text END
  WHEN regexp_matches(text, '{_TAIL}') THEN CASE WHEN margin OR abs(regexp_extract(text, '{_TAIL}', 1)::INT - page_no) <= 2 THEN {_STRIP.format(f"regexp_replace(text, '{_TAIL}', '')")} ELSE text END ELSE text END"""
MARKER = r"^(?:\d{1,3}[.)]|[•●▪◦·∙‣○■□►▶➢✓»¢©°«*+-])$"
JUNK = rf"""(SELECT CASE WHEN n = 0 THEN true WHEN regexp_matches(s, '{MARKER}') THEN false WHEN alnum / n < 0.5 THEN true WHEN kind <> 'ocr' THEN false ELSE conf < 30 OR (conf < 55 AND alpha / n < 0.6) OR alnum <= 2 OR (len(w) >= 3 AND conf < 75 AND len(list_filter(w, lambda x: length(x) <= 2)) / len(w) > 0.7) END
  FROM (SELECT s, length(s) AS n, length(regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum, length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) AS alpha, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM (SELECT regexp_replace(text, '\s+', '', 'g') AS s)))"""


def reattached(source: str, alone: str = "true") -> str:
    """Lone markers in runs: odd ones go to what follows."""
    return f"""lone AS (SELECT *, {alone} AND regexp_matches({_STRIP.format("text")}, '{MARKER}') AS lone FROM {source}),
lone_runs AS (SELECT *, sum(CASE WHEN lone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_idx) AS run FROM lone),
odd AS (SELECT *, lone AND row_number() OVER (PARTITION BY doc_id, page_no, run, lone ORDER BY line_idx) % 2 = 1 AS gives FROM lone_runs),
attached AS (SELECT * EXCLUDE (text), CASE WHEN lag(gives) OVER w THEN {_STRIP.format("lag(text) OVER w")} || ' ' || text ELSE text END AS text FROM odd WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_idx))"""


CLEANED = f"""unlabelled AS (SELECT * EXCLUDE (text), {UNLABELLED} AS text FROM headless WHERE NOT {IS_NUMBER}),
cleaned AS (SELECT * FROM (SELECT *, {JUNK} AS junk FROM unlabelled) WHERE NOT junk)"""


def joined(texts: str, known: str = "[]::VARCHAR[]") -> str:
    """Left fold of a list of lines; a hyphen at a line's end goes if the dictionary wants it."""
    left, right = (rf"lower(regexp_replace({x}, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g'))" for x in (r"regexp_extract(a, '(\S+)-$', 1)", r"regexp_extract(t, '^\S+')"))
    clean = f"list_filter(list_transform({texts}, lambda y: {_STRIP.format('y')}), lambda y: y <> '')"
    fold = rf"""list_reduce({clean}, lambda a, t: CASE WHEN ends_with(a, chr(173)) THEN left(a, length(a) - 1) || t
      WHEN regexp_matches(a, '\S-$') AND regexp_matches(regexp_extract(a, '(\S+)-$', 1), '[\p{{L}}\p{{N}}]') THEN CASE WHEN {left} <> '' AND {right} <> '' AND list_contains({known}, {left} || {right}) AND NOT list_contains({known}, {left} || '-' || {right}) THEN left(a, length(a) - 1) || t ELSE a || t END ELSE a || ' ' || t END)"""
    return f"(CASE WHEN len({clean}) = 0 THEN '' ELSE {fold} END)"


GROUPS = rf"""jumps AS (SELECT *, (line_idx // 3)::INT AS para_idx, lag(size) OVER (PARTITION BY doc_id, page_no, line_idx // 3 ORDER BY line_idx) AS size0 FROM features),
grp_lines AS (SELECT *, sum(CASE WHEN greatest(size0, size) / 10 >= 1.2::DOUBLE AND greatest(size0, size) / greatest(least(size0, size), 1e-6) > 1.2::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, para_idx ORDER BY line_idx)::INT AS grp FROM jumps),
gathered AS (SELECT doc_id, page_no, kind, para_idx, grp, list(text ORDER BY line_idx) AS ls, median(size) AS size, min(line_idx) AS first_line FROM grp_lines GROUP BY doc_id, page_no, kind, para_idx, grp),
groups AS (SELECT *, {joined("ls")} AS text, size / 10 AS rel FROM gathered),
flagged AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS alpha FROM groups),
headed AS (SELECT *, alpha >= 2 AND ((rel >= 1.5 AND n <= 25 AND len(ls) <= 4) OR (rel >= 1.2 AND len(ls) = 1 AND n <= 10 AND NOT regexp_matches(text, '[.,;]$'))) AS heading FROM flagged)"""

#: Lines of one size, most with a list marker, some with a second item on the line.
MARKED = "marked AS (SELECT * EXCLUDE (text, size), 10.0::DOUBLE AS size, ['1. ', '2. ', '', '• ', '- ', '3. ', ''][(line_idx + page_no) % 7 + 1] || text || CASE WHEN (line_idx + page_no) % 7 = 1 THEN ' 3. Third' ELSE '' END AS text FROM features)"

_ORDERED, _BULLET = r"^(\d{1,3})[.)]\s+(\S.*)$", r"^(?:[•●▪◦·∙‣○■□►▶➢✓»¢©°«]\s*|[-–—*+]\s+)(\S.*)$"


def lists(item: str, source: str = "items") -> str:
    """Items of the lists of groups (headed) that are no headings, items on one line apart; item: text of the parts of one."""
    return rf"""flat AS (SELECT doc_id, page_no, para_idx, grp, first_line, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM headed WHERE NOT heading),
parsed AS (SELECT * EXCLUDE (t), {_STRIP.format("t")} AS t, try_cast(regexp_extract({_STRIP.format("t")}, '{_ORDERED}', 1) AS INT) AS num, regexp_extract({_STRIP.format("t")}, '{_ORDERED}', 2) AS num_text, coalesce(nullif(regexp_extract({_STRIP.format("t")}, '{_BULLET}', 1), ''), nullif(regexp_extract({_STRIP.format("t")}, '^[eo]\s+([A-Z].*)$', 1), '')) AS bul FROM flat),
states AS (
  SELECT doc_id, page_no, para_idx, grp, 0 AS i, '' AS kind, 0 AS last, false AS plain, 0 AS lst, '' AS label, NULL::INT AS n, '' AS text, 0 AS item FROM headed WHERE NOT heading
  UNION ALL
  SELECT doc_id, page_no, para_idx, grp, i, CASE WHEN ordered THEN 'ol' WHEN bulleted THEN 'ul' ELSE kind END, CASE WHEN ordered THEN num ELSE last END, plain OR (NOT ordered AND NOT bulleted AND kind = ''), lst + CASE WHEN begins OR (NOT ordered AND bulleted AND kind = '') THEN 1 ELSE 0 END,
    CASE WHEN ordered THEN 'ol' WHEN bulleted THEN 'ul' WHEN kind = '' THEN 'p' ELSE '+' END, CASE WHEN ordered THEN num END, CASE WHEN ordered THEN num_text WHEN bulleted THEN bul ELSE t END, item + CASE WHEN ordered OR bulleted THEN 1 ELSE 0 END
  FROM (
    SELECT *, begins OR goes_on AS ordered FROM (
      SELECT s.doc_id, s.page_no, s.para_idx, s.grp, p.i, s.kind, s.last, s.plain, s.lst, s.item, p.num, p.num_text, p.bul, p.t, p.num IS NOT NULL AND s.kind = 'ol' AND p.num = s.last + 1 AS goes_on,
        p.num IS NOT NULL AND ((s.kind = '' AND (NOT s.plain OR p.num = 1)) OR (s.kind = 'ul' AND p.num = 1)) AS begins, p.bul IS NOT NULL AND s.kind IN ('', 'ul') AS bulleted
      FROM states s JOIN parsed p ON p.doc_id = s.doc_id AND p.page_no = s.page_no AND p.para_idx = s.para_idx AND p.grp = s.grp AND p.i = s.i + 1
    )
  )
), items AS (SELECT doc_id, page_no, para_idx, grp, lst, item, min(label) FILTER (label <> '+') AS kind, min(n) AS n, list(text ORDER BY i) AS parts FROM states WHERE item > 0 GROUP BY doc_id, page_no, para_idx, grp, lst, item),
split AS (
  SELECT doc_id, page_no, para_idx, grp, lst, item, kind, n, 0 AS piece, {item} AS rest, NULL::VARCHAR AS done FROM {source}
  UNION ALL
  SELECT doc_id, page_no, para_idx, grp, lst, item, kind, n + 1, piece + 1, regexp_extract(rest, '^(?s)(.*?)\s' || (n + 1) || '[.)]\s+([A-Z0-9"''“‘(].*)$', 2), NULL FROM split WHERE kind = 'ol' AND regexp_matches(rest, '\s' || (n + 1) || '[.)]\s+[A-Z0-9"''“‘(]')
), texts AS (
  SELECT *, CASE WHEN kind = 'ol' AND regexp_matches(rest, '\s' || (n + 1) || '[.)]\s+[A-Z0-9"''“‘(]') THEN {_STRIP.format('''regexp_extract(rest, '^(?s)(.*?)\\s' || (n + 1) || '[.)]\\s+([A-Z0-9"''“‘(].*)$', 1)''')} ELSE rest END AS part FROM split
)"""


#: Text lines as loose blocks, and their left fold per document: each step's state is the block that the rows so far end in.
MERGES = r"""loose AS (
  SELECT doc_id, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS i, CASE WHEN ln % 10 < 2 THEN 'h' WHEN ln % 10 = 3 THEN 'ol' WHEN ln % 10 = 9 THEN 'ul' ELSE 'p' END AS kind,
    CASE WHEN ln % 10 IN (4, 6, 8) THEN lower(t) ELSE t END AS t, (ln // 2 + 1)::INT AS page, CASE WHEN ln % 10 < 2 THEN (ln // 10) % 2 + 1 ELSE 0 END::INT AS level, (100 + ln % 2 * 20)::DOUBLE AS top, (14 + ln % 5 * 2)::DOUBLE AS size
  FROM (SELECT doc_id, ln, CASE WHEN ln % 3 < 2 THEN regexp_replace(trim(line), '[.!?:;]+$', '') ELSE trim(line) END AS t FROM raw WHERE ln % 10 <> 7 AND trim(line) <> '')
), fold AS (
  SELECT doc_id, i, ln AS home, kind, page, level, t AS whole, t AS shown, top + size AS bottom, size FROM loose WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN joins OR goes_on THEN home ELSE ln END, CASE WHEN joins OR goes_on THEN k0 ELSE kind END, CASE WHEN joins THEN p0 ELSE page END, CASE WHEN joins OR goes_on THEN l0 ELSE level END,
    CASE WHEN joins OR goes_on THEN concat_ws(' ', nullif(whole, ''), nullif(t, '')) ELSE t END, CASE WHEN joins OR (goes_on AND k0 = 'p') THEN concat_ws(' ', nullif(shown, ''), nullif(t, '')) WHEN goes_on THEN shown || ' / ' || t ELSE t END,
    CASE WHEN goes_on THEN b0 ELSE top + size END, CASE WHEN joins OR goes_on THEN s0 ELSE size END
  FROM (
    SELECT b.doc_id, b.i, b.ln, f.home, b.kind, f.kind AS k0, b.page, f.page AS p0, b.level, f.level AS l0, f.whole, f.shown, b.t, b.top, b.size, f.bottom AS b0, f.size AS s0,
      b.kind = 'h' AND f.kind = 'h' AND b.page = f.page AND b.level = f.level AND NOT regexp_matches(f.whole, '[.!?:;][''"”’)\]]?$') AND b.top - f.bottom >= 0 AND b.top - f.bottom < 1.2::DOUBLE * greatest(f.size, b.size) AS joins,
      b.kind = 'p' AND f.kind <> 'h' AND b.page = f.page + 1 AND regexp_matches(b.t, '^\p{Ll}') AND NOT regexp_matches(f.whole, '[.!?:;][''"”’)\]]?$') AS goes_on
    FROM fold f JOIN loose b ON b.doc_id = f.doc_id AND b.i = f.i + 1
  )
)"""


_TERMINAL = r"""[.!?:;][''"”’)\]]?$"""

#: The dictionary for line-end hyphens: words of the benchmark.
KNOWN = r"known_words AS (SELECT list(DISTINCT w) AS ws FROM (SELECT lower(regexp_replace(unnest(string_split_regex(text, '\s+')), '[^\p{L}\p{N}_]', '', 'g')) AS w FROM benchmark) WHERE w <> '')"

#: Words as the layout takes them: ligatures spelt out, no blank ones.
SPELT = rf"two AS (SELECT * FROM (SELECT * EXCLUDE (text), {_STRIP.format("""replace(replace(replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), chr(160), ' ')""")} AS text FROM words) WHERE text <> '')"

#: Chunk lines in the order of the page, sentences that go on in the next chunk kept together; then what cleaning needs.
PAGE_LINES = rf"""ordered AS (SELECT *, lag(chunk) OVER w AS c0, lag(para_idx) OVER w AS p0, lag(text) OVER w AS t0, row_number() OVER w AS nth FROM (SELECT doc_id, page_no, chunk, line_idx, para_idx, text, size, conf, top, bottom, bold FROM paras) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY chunk, line_idx)),
features AS (
  SELECT doc_id, page_no, nth AS line_idx, text, size, conf, top, bottom, bold, 'text' AS kind, (bottom < 792 * 0.1::DOUBLE OR top > 792 * (1 - 0.1::DOUBLE)) AS margin,
    sum(CASE WHEN c0 <> chunk AND NOT regexp_matches(t0, '{_TERMINAL}') AND regexp_matches(text, '^\p{{Ll}}') THEN 0 WHEN c0 IS NULL OR c0 <> chunk OR p0 <> para_idx THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY nth)::INT AS para_idx FROM ordered
)"""

#: Cleaned lines to size groups, told apart as headings or not.
PAGE_GROUPS = rf"""bodies AS (SELECT doc_id, median(size) AS body FROM words WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]') GROUP BY doc_id),
jumps AS (SELECT a.*, coalesce(body, 1.0)::DOUBLE AS body, lag(size) OVER (PARTITION BY a.doc_id, page_no, para_idx ORDER BY line_idx) AS size0 FROM attached a LEFT JOIN bodies b ON a.doc_id = b.doc_id WHERE NOT gives),
grp_lines AS (SELECT *, sum(CASE WHEN greatest(size0, size) / body >= 1.2::DOUBLE AND greatest(size0, size) / greatest(least(size0, size), 1e-6) > 1.2::DOUBLE AND size0 IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, para_idx ORDER BY line_idx)::INT AS grp FROM jumps),
gathered AS (SELECT doc_id, page_no, para_idx, grp, list(text ORDER BY line_idx) AS ls, median(size) AS size, any_value(body) AS body, arg_min(top, line_idx) AS top, arg_max(bottom, line_idx) AS bottom, bool_and(bold) AS bold, min(line_idx) AS first_line FROM grp_lines GROUP BY doc_id, page_no, para_idx, grp),
groups AS (SELECT gathered.*, {joined("ls", "ws")} AS text, CASE WHEN body <> 0 THEN size / body ELSE 1 END AS rel FROM gathered, known_words),
flagged AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS alpha FROM groups),
headed AS MATERIALIZED (
  SELECT *, alpha >= 2 AND ((rel >= 1.5 AND n <= 25 AND len(ls) <= 4) OR (rel >= 1.2 AND len(ls) = 1 AND n <= 10 AND NOT regexp_matches(text, '[.,;]$')) OR (bold AND len(ls) = 1 AND n <= 12 AND rel >= 0.95::DOUBLE AND NOT ends_with(text, '.'))) AS heading FROM flagged
)"""

#: Blocks of the groups, numbered in order, with the level of each heading. Of a list, t is its last item.
PAGE_BLOCKS = rf"""made AS (
  SELECT doc_id, page_no, first_line, 0 AS pos, 'h' AS kind, {_STRIP.format("regexp_replace(text, '#+$', '')")} AS t, NULL::STRUCT(n INT, t VARCHAR)[] AS items, rel, top, bottom, size FROM headed WHERE heading
  UNION ALL
  SELECT h.doc_id, h.page_no, first_line, 0, 'p', p.t, NULL, rel, top, bottom, size
  FROM (SELECT doc_id, page_no, para_idx, grp, {joined("ls", "ws")} AS t FROM (SELECT doc_id, page_no, para_idx, grp, list(text ORDER BY i) AS ls FROM states WHERE label = 'p' GROUP BY doc_id, page_no, para_idx, grp), known_words) p JOIN headed h USING (doc_id, page_no, para_idx, grp)
  UNION ALL
  SELECT h.doc_id, h.page_no, first_line, lst, l.kind, items[-1].t, items, rel, top, bottom, size
  FROM (SELECT doc_id, page_no, para_idx, grp, lst, kind, list(struct_pack(n := CASE WHEN kind = 'ol' THEN n END, t := part) ORDER BY item, piece) AS items FROM texts GROUP BY doc_id, page_no, para_idx, grp, lst, kind) l JOIN headed h USING (doc_id, page_no, para_idx, grp)
), tiers AS (
  SELECT doc_id, list_reduce(list_transform(sizes, lambda x: [x]), lambda a, b: CASE WHEN b[1] < a[-1] * 0.88::DOUBLE THEN list_concat(a, b) ELSE a END) AS tiers
  FROM (SELECT doc_id, list_reverse_sort(list(DISTINCT round_even(rel, 3))) AS sizes FROM made WHERE kind = 'h' GROUP BY doc_id)
), loose AS MATERIALIZED (
  SELECT m.doc_id, page_no AS page, row_number() OVER (PARTITION BY m.doc_id ORDER BY page_no, first_line, pos) AS i, kind, t, items, top, bottom, size,
    (CASE WHEN kind <> 'h' THEN 0 WHEN rel < 1.2::DOUBLE THEN least(greatest(len(list_filter(tiers, lambda t: t >= 1.2::DOUBLE)) + 1, 2), 3) ELSE least(coalesce(list_position(list_transform(tiers, lambda t: rel >= t * 0.88::DOUBLE - 1e-9), true), len(tiers)), 3) END)::INT AS level
  FROM made m LEFT JOIN tiers USING (doc_id)
)"""

#: Left fold of the blocks of a document: each step's state is the block that the blocks so far end in; whole: its text or last item.
PAGE_MERGES = rf"""fold AS (
  SELECT doc_id, i, i AS home, kind, page, level, t AS whole, bottom, size FROM loose WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN joins OR goes_on THEN home ELSE i END, CASE WHEN joins OR goes_on THEN k0 ELSE kind END, page, CASE WHEN joins OR goes_on THEN l0 ELSE level END,
    CASE WHEN joins OR goes_on THEN {joined("[whole, t]", "ws")} ELSE t END, bottom, CASE WHEN joins OR goes_on THEN s0 ELSE size END
  FROM (
    SELECT b.doc_id, b.i, f.home, b.kind, f.kind AS k0, b.page, b.level, f.level AS l0, f.whole, b.t, b.bottom, b.size, f.size AS s0, ws,
      b.kind = 'h' AND f.kind = 'h' AND b.page = f.page AND b.level = f.level AND NOT regexp_matches(f.whole, '{_TERMINAL}') AND b.top - f.bottom >= 0 AND b.top - f.bottom < 1.2::DOUBLE * greatest(f.size, b.size) AS joins,
      b.kind = 'p' AND f.kind <> 'h' AND b.page = f.page + 1 AND regexp_matches(b.t, '^\p{{Ll}}') AND NOT regexp_matches(f.whole, '{_TERMINAL}') AS goes_on
    FROM fold f JOIN loose b ON b.doc_id = f.doc_id AND b.i = f.i + 1, known_words
  )
), ended AS (SELECT doc_id, home, kind, level, whole FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, home ORDER BY i DESC) = 1)"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}"


def escaped(t: str) -> str:
    return rf"CASE WHEN regexp_matches({t}, '^\d{{1,9}}[.)](\s|$)') THEN regexp_replace({t}, '^(\d+)([.)])', '\1\\\2') WHEN regexp_matches({t}, '^(#{{1,6}}|[>+*-])(\s|$)') THEN '\' || {t} ELSE {t} END"


#: Markdown of blocks (home: their order, opens: 0 if one is tight with the block before it) per document.
RENDERED = rf"""parts AS (SELECT doc_id, part, string_agg(md, chr(10) ORDER BY home) AS md FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY home) AS part FROM mds) GROUP BY doc_id, part),
rendered AS (SELECT doc_id, {_STRIP.format('string_agg(md, chr(10) || chr(10) ORDER BY part)')} || chr(10) AS markdown FROM parts WHERE regexp_matches(md, '\S') GROUP BY doc_id)"""

RAW_PAGES = """raw_pages AS (
  SELECT doc_id // 10 AS doc_id, (doc_id % 10 + 1)::INT AS page_no, (500 + doc_id % 3 * 100)::DOUBLE AS width, 792.0::DOUBLE AS height, doc_id % 30 >= 10 AS has_fonts, length(regexp_replace(CASE WHEN doc_id % 7 = 0 OR doc_id // 10 % 5 = 4 THEN ' ' ELSE text END, '[^\\p{L}\\p{N}]', '', 'g')) AS chars FROM documents
), files AS (
  SELECT *, NOT has_fonts OR text_chars < greatest(20, 2 * pages) AS image_only FROM (SELECT doc_id, count(*) AS pages, bool_or(has_fonts) AS has_fonts, sum(chars)::BIGINT AS text_chars, count(*) FILTER (chars < 10) AS pages_without_text, first(width ORDER BY width * height DESC, page_no) AS largest_width FROM raw_pages GROUP BY doc_id)
), profiles AS (
  SELECT *, has_fonts AND image_only AS hidden_text_layer, CASE WHEN has_fonts AND image_only THEN 'hidden/empty (fonts, no extractable text)' WHEN image_only THEN 'none (image-only)' WHEN pages_without_text > 0 THEN 'partial (' || pages_without_text || ' pages without)' ELSE 'present' END AS text_layer,
    CASE WHEN image_only OR pages_without_text > 0 THEN '--redo-ocr,--force-ocr' ELSE '--skip-text' END AS modes FROM files
)"""

RESOURCES = f"""{RAW_PAGES},
asked AS (SELECT *, CASE WHEN doc_id % 11 = 10 THEN NULL ELSE (doc_id * 173 % 5000)::DOUBLE END AS free, (doc_id % 16 + 1)::INT AS cpus, doc_id % 6 = 5 AS forced FROM profiles),
timed AS (SELECT *, CASE WHEN NOT forced AND coalesce(free >= 1500, false) THEN 'concurrent' ELSE 'sequential' END AS schedule, CASE WHEN forced THEN 'forced by setting' WHEN free IS NULL THEN 'free memory could not be read' ELSE CASE WHEN free >= 1500 THEN '' ELSE 'only ' END || format('{{:,}}', free::BIGINT) || ' MB free (threshold 1,500 MB)' END AS reason FROM asked),
budgets AS (SELECT *, free * 0.75::DOUBLE / CASE WHEN schedule = 'concurrent' THEN 2 ELSE 1 END AS budget, 100 + 14 * least(largest_width / 72 * 300 * 792.0::DOUBLE / 72 * 300, 60000000) / 1e6 AS high, 100 + 14 * least(largest_width / 72 * 200 * 792.0::DOUBLE / 72 * 200, 60000000) / 1e6 AS low FROM timed),
chosen AS (SELECT *, CASE WHEN high > budget THEN 200 ELSE 300 END AS dpi, CASE WHEN high > budget THEN low ELSE high END AS per, greatest(1, cpus // 2) AS half FROM budgets),
manned AS (
  SELECT *, CASE WHEN free IS NULL THEN w ELSE greatest(1, least(w, floor(budget / per))) END::INT AS ocr_workers, CASE WHEN free IS NULL THEN j ELSE greatest(1, least(j, floor((budget - 130) / per))) END::INT AS jobs
  FROM (SELECT *, CASE WHEN schedule = 'concurrent' THEN greatest(1, cpus - half) ELSE cpus END AS w, CASE WHEN schedule = 'concurrent' THEN half ELSE cpus END AS j FROM chosen)
), planned AS (SELECT *, trunc(CASE WHEN schedule = 'concurrent' THEN ocr_workers * per + 130 + jobs * per ELSE greatest(ocr_workers * per, 130 + jobs * per) END)::INT AS est_peak_mb FROM manned)"""


def _title(x: str) -> str:
    return f"CASE WHEN {x} THEN 'True' ELSE 'False' END"


def sql() -> dict[str, str]:
    lines, paras = LINES.format(words="words", chunk=""), PARAS.format(chunk="", m_chunk="")
    chunk_lines, chunk_paras = LINES.format(words="chunked", chunk=", chunk"), PARAS.format(chunk=", chunk", m_chunk=", m.chunk")
    cut_word = "CASE WHEN (i - 1) % 7 = 3 AND length(x) >= 4 THEN substr(x, 1, length(x) // 2) || '-' || chr(10) || substr(x, length(x) // 2 + 1) WHEN (i - 1) % 12 = 11 THEN x || chr(10) ELSE x || ' ' END"
    largest = "largest_width * pages / 72 * 300 * (792.0::DOUBLE * 4 / 72 * 300)"
    return {
        "typeset_pages": _with(WORDS, select="SELECT doc_id, page_no, count(*) AS n_words, sum(x0) AS sum_x0, sum(x1) AS sum_x1, sum(top) AS sum_top, min(word_idx) AS first_word FROM words GROUP BY doc_id, page_no"),
        "glyph_sizes": _with(WORDS, select=f"SELECT text, bottom - top AS height, count(*) AS n, any_value({GLYPH}) AS glyph_size FROM words GROUP BY text, bottom - top"),
        "words_to_lines": _with(WORDS, lines, select="SELECT * FROM lines"),
        "ocr_lines": _with(WORDS, OCR_LINES.replace("{where}", "WHERE conf >= 5"), select='SELECT doc_id, page_no, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY group_first)::INT AS group_idx, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY group_first, first)::INT AS line_idx, text, size, conf, "left", top, "right", bottom, page_conf FROM firsts'),
        "ocr_confidence": _with(WORDS, OCR_LINES.replace("{where}", ""), select="SELECT doc_id, count(*) AS ocr_pages, round(avg(page_conf), 1) AS mean_conf FROM (SELECT DISTINCT doc_id, page_no, page_conf FROM firsts) GROUP BY doc_id"),
        "body_sizes": _with(WORDS, select=r"SELECT doc_id, 'text' AS source, median(size) AS body FROM words WHERE regexp_matches(text, '[\p{L}\p{N}]') GROUP BY doc_id"),
        "refine_paragraphs": _with(WORDS, lines, paras, select="SELECT doc_id, page_no, line_idx, para_idx, text FROM paras"),
        "gutters": _with(WORDS, COLUMNS, GUTTERS, select="SELECT doc_id, page_no, pos::INT AS pos, g.a AS gutter_left, g.b AS gutter_right FROM (SELECT doc_id, page_no, unnest(gutters) AS g, generate_subscripts(gutters, 1) - 1 AS pos FROM gutters3)"),
        "column_chunks": _with(WORDS, COLUMNS, GUTTERS, CHUNKS, select="SELECT doc_id, page_no, chunk, count(*) AS n_words, min(word_idx) AS first_word FROM chunked GROUP BY doc_id, page_no, chunk"),
        "cross_column_lines": _with(WORDS, COLUMNS, GUTTERS, CHUNKS, chunk_lines, chunk_paras, f"ordered AS (SELECT *, lag(chunk) OVER w AS c0, lag(para_idx) OVER w AS p0, lag(text) OVER w AS t0, row_number() OVER w AS nth FROM (SELECT doc_id, page_no, chunk, line_idx, para_idx, text FROM paras) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY chunk, line_idx))", select=rf"SELECT doc_id, page_no, sum(CASE WHEN c0 <> chunk AND NOT regexp_matches(t0, '{_TERMINAL}') AND regexp_matches(text, '^\p{{Ll}}') THEN 0 WHEN c0 IS NULL OR c0 <> chunk OR p0 <> para_idx THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY nth)::INT AS para_idx, nth::INT AS line_idx, text FROM ordered"),
        "running_headers": _with(FEATURES, HEADERS, select="SELECT * FROM headers"),
        "drop_running_headers": _with(FEATURES, HEADERS, select="SELECT doc_id, page_no, line_idx, text FROM headless"),
        "page_numbers": _with(FEATURES, select=f"SELECT doc_id, page_no, line_idx, text FROM features WHERE {IS_NUMBER}"),
        "edge_labels": _with(FEATURES, select=f"SELECT doc_id, page_no, line_idx, {UNLABELLED} AS stripped FROM features"),
        "junk_lines": _with(FEATURES, select=f"SELECT doc_id, page_no, line_idx, {JUNK} AS junk FROM features"),
        "marker_reattach": _with(FEATURES, reattached("features"), select="SELECT doc_id, page_no, line_idx, text FROM attached WHERE NOT gives"),
        "clean_pages": _with(FEATURES, HEADERS, CLEANED, reattached("cleaned"), select="SELECT doc_id, page_no, line_idx, text FROM attached WHERE NOT gives"),
        "join_lines": _with(KNOWN, rf"toks AS (SELECT doc_id, string_split(array_to_string(list_transform(list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> ''), lambda x, i: {cut_word}), ''), chr(10)) AS ls FROM documents)", select=f"SELECT doc_id, {joined('ls', 'ws')} AS joined FROM toks, known_words"),
        "size_groups": _with(FEATURES, GROUPS, select="SELECT doc_id, page_no, para_idx, line_idx, grp FROM grp_lines"),
        "headings": _with(FEATURES, GROUPS, select="SELECT doc_id, page_no, first_line, rel, heading FROM headed"),
        "heading_tiers": _with(
            RAW, "sized AS (SELECT doc_id, (1 + (length(line) % 16) / 16)::DOUBLE AS rel, count(*) AS n FROM raw GROUP BY doc_id, rel)", "listed AS (SELECT doc_id, list_reverse_sort(list(DISTINCT round_even(rel, 3))) AS sizes FROM sized GROUP BY doc_id)",
            "tiered AS (SELECT doc_id, list_reduce(list_transform(sizes, lambda x: [x]), lambda a, b: CASE WHEN b[1] < a[-1] * 0.88::DOUBLE THEN list_concat(a, b) ELSE a END) AS tiers FROM listed)",
            select="SELECT s.doc_id, rel, (CASE WHEN rel < 1.2::DOUBLE THEN least(greatest(len(list_filter(tiers, lambda t: t >= 1.2::DOUBLE)) + 1, 2), 3) ELSE least(coalesce(list_position(list_transform(tiers, lambda t: rel >= t * 0.88::DOUBLE - 1e-9), true), len(tiers)), 3) END)::INT AS level, n FROM sized s JOIN tiered USING (doc_id)",
        ),
        "list_blocks": _with(FEATURES, MARKED, GROUPS.replace("FROM features", "FROM marked"), lists(f"CASE WHEN kind = 'ol' THEN {joined('parts')} ELSE array_to_string(parts, ' / ') END"), select="SELECT t.doc_id, t.page_no, (h.first_line::BIGINT * 2147483648 + t.lst)::BIGINT AS block_idx, t.kind, (row_number() OVER (PARTITION BY t.doc_id, t.page_no, t.para_idx, t.grp, t.lst ORDER BY t.item, t.piece) - 1)::INT AS pos, CASE WHEN t.kind = 'ol' THEN t.n END AS n, t.part AS parts FROM texts t JOIN headed h ON h.doc_id = t.doc_id AND h.page_no = t.page_no AND h.para_idx = t.para_idx AND h.grp = t.grp", recursive=True),
        "merge_blocks": _with(RAW, MERGES, select="SELECT doc_id, page AS page_no, home AS block_idx, kind, level, shown AS text FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, home ORDER BY i DESC) = 1", recursive=True),
        "render_markdown": _with(
            KNOWN, WORDS, SPELT, GUTTERS, CHUNKS, chunk_lines, chunk_paras, PAGE_LINES, HEADERS, CLEANED, reattached("cleaned", "count(*) OVER (PARTITION BY doc_id, page_no, para_idx) = 1"), PAGE_GROUPS, lists(joined("parts", "ws"), "items, known_words"), PAGE_BLOCKS, PAGE_MERGES,
            r"shown AS (SELECT e.*, list_concat(items[:-2], [struct_pack(n := items[-1].n, t := whole)]) AS items FROM ended e JOIN loose b ON b.doc_id = e.doc_id AND b.i = e.home)",
            f"mds AS (SELECT *, CASE kind WHEN 'h' THEN repeat('#', level) || ' ' || whole WHEN 'p' THEN {escaped('whole')} ELSE array_to_string(list_transform(items, lambda x: coalesce(x.n || '. ', '- ') || x.t), chr(10)) END AS md, CASE WHEN lag(kind) OVER w = kind AND kind IN ('ol', 'ul') THEN 0 ELSE 1 END AS opens FROM shown WINDOW w AS (PARTITION BY doc_id ORDER BY home))",
            RENDERED, select="SELECT * FROM rendered", recursive=True,
        ),
        "render_blocks": _with(
            RAW, f"kinds AS (SELECT doc_id, ln, CASE WHEN ln % 8 = 0 THEN 'h' WHEN ln % 8 < 3 THEN 'ol' WHEN ln % 8 < 5 THEN 'ul' ELSE 'p' END AS kind, CASE WHEN ln % 8 = 6 THEN '7. ' || line WHEN ln % 8 = 7 THEN '# ' || line ELSE line END AS text, {_STRIP.format('line')} AS item FROM raw)",
            f"mds AS (SELECT *, ln AS home, CASE kind WHEN 'h' THEN repeat('#', (ln % 3 + 1)::INT) || ' ' || text WHEN 'p' THEN {escaped('text')} WHEN 'ol' THEN (ln % 8) || '. ' || item ELSE '- ' || item END AS md, CASE WHEN lag(kind) OVER w = kind AND kind IN ('ol', 'ul') THEN 0 ELSE 1 END AS opens FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY ln))",
            RENDERED, select="SELECT * FROM rendered",
        ),
        "pdf_profile": _with(RAW_PAGES, select="SELECT doc_id, pages, has_fonts, text_chars, pages_without_text, image_only, hidden_text_layer, text_layer, largest_width, modes FROM profiles"),
        "page_routing": _with(RAW_PAGES, select="SELECT r.doc_id, page_no, CASE WHEN image_only OR chars < 10 THEN 'ocr' ELSE 'text' END AS route FROM raw_pages r JOIN profiles USING (doc_id)"),
        "resource_plan": _with(
            RESOURCES,
            select=f"""SELECT doc_id, schedule, reason, dpi, ocr_workers, jobs, est_peak_mb, printf('file=f%d.pdf size=%.1fMB pages=%d fonts=%s text_chars=%d pages_without_text=%d hidden_text_layer=%s image_only=%s | dpi=%d schedule=%s ocr_workers=%d ocrmypdf_jobs=%d ocrmypdf_modes=%s est_peak=%dMB free=%sMB', doc_id, text_chars * 1000 / 1048576, pages, {_title("has_fonts")}, text_chars, pages_without_text,
            {_title("hidden_text_layer")}, {_title("image_only")}, dpi, schedule, ocr_workers, jobs, modes, est_peak_mb, coalesce(format('{{:,}}', free::BIGINT), 'unknown')) AS preflight, CASE WHEN {largest} > 60000000 THEN greatest(72, trunc(300 * sqrt(60000000 / ({largest})))::INT) ELSE 300 END AS capped_dpi FROM planned""",
        ),
        "attempt_outcomes": """
            WITH tries AS (SELECT doc_id // 2 AS doc_id, doc_id % 2 AS k, CASE WHEN doc_id % 2 = 0 THEN '--redo-ocr' ELSE '--force-ocr' END AS mode, [0, 6, 2, 9, 137, 10, -9, 0][n_chars % 8 + 1] AS rc, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE n_chars END AS chars FROM documents),
            judged AS (SELECT *, rc IN (0, 10) AND chars > 0 AS ok, (rc IN (0, 10) AND chars > 0) OR rc < 0 OR rc IN (137, 3, 8, 9) AS stop FROM tries),
            ran AS (SELECT * FROM judged j WHERE NOT EXISTS (SELECT 1 FROM judged b WHERE b.doc_id = j.doc_id AND b.k < j.k AND b.stop))
            SELECT doc_id, coalesce(max(mode) FILTER (ok), 'failed') AS outcome, CASE WHEN NOT bool_or(ok) THEN 'No searchable PDF was made: ' || string_agg(mode || CASE WHEN rc IN (0, 10) THEN ': ended well but its pages hold no text' ELSE ': exit code ' || rc || CASE rc WHEN 2 THEN ' (bad input file)' WHEN 6 THEN ' (text was there before)' WHEN 9 THEN ' (invalid settings)' WHEN 137 THEN ' (out of memory)' WHEN -9 THEN ' (killed)' ELSE '' END END, '; ' ORDER BY k) END AS warning, count(*)::INT AS tried FROM ran GROUP BY doc_id""",
        "table_markdown": r"""SELECT n_regionkey, '| Nation | Key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_nationkey || '\|x' END || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey""",
        "inline_runs": r"""SELECT page_id, trim(regexp_replace(string_agg(CASE WHEN trim(x) = '' THEN x || ' ' ELSE m || CASE WHEN i % 4 = 3 THEN '[' || trim(x) || '](http://x)' ELSE trim(x) END || reverse(m) || ' ' END, '' ORDER BY i), '\s+', ' ', 'g')) AS md
            FROM (SELECT *, CASE WHEN i % 4 = 1 THEN '**' ELSE '' END || CASE WHEN i % 3 = 2 THEN '*' ELSE '' END AS m FROM (SELECT page_id, unnest(string_split(url, '/')) AS x, generate_subscripts(string_split(url, '/'), 1) - 1 AS i FROM pages)) GROUP BY page_id""",
        "list_counters": """WITH items AS (SELECT l_orderkey AS path, l_linenumber * 1000000 + l_partkey AS pos, max(l_quantity::INT % 3) AS ilvl FROM lineitem GROUP BY path, pos),
            reset AS (SELECT *, CASE ilvl WHEN 0 THEN 0 WHEN 1 THEN sum((ilvl < 1)::INT) OVER w ELSE sum((ilvl < 2)::INT) OVER w END AS stretch FROM items WINDOW w AS (PARTITION BY path ORDER BY pos))
            SELECT path, pos, ilvl, row_number() OVER (PARTITION BY path, ilvl, stretch ORDER BY pos) AS n FROM reset""",
        "docx_markdown": r"""WITH items AS (SELECT DISTINCT l_orderkey AS o, l_linenumber * 1000000 + l_partkey AS pos, l_partkey AS part, l_partkey % 5 AS kind, CASE WHEN l_partkey % 5 = 1 THEN l_partkey // 5 % 2 ELSE 0 END AS ilvl FROM lineitem),
            near AS (SELECT *, kind IN (1, 2) AS listed, coalesce(lag(kind IN (1, 2)) OVER (PARTITION BY o ORDER BY pos), false) AS before FROM items),
            runs AS (SELECT *, sum(CASE WHEN listed AND before THEN 0 ELSE 1 END) OVER (PARTITION BY o ORDER BY pos) AS run FROM near),
            depth AS (SELECT *, CASE ilvl WHEN 0 THEN 0 ELSE sum((ilvl < 1)::INT) OVER (PARTITION BY o, run, kind ORDER BY pos) END AS stretch FROM runs),
            told AS (SELECT *, CASE kind WHEN 0 THEN CASE WHEN o % 2 = 0 THEN '###' ELSE '##' END || ' Part ' || part WHEN 1 THEN repeat('   ', ilvl) || row_number() OVER (PARTITION BY o, run, kind, ilvl, stretch ORDER BY pos) || '. Part ' || part
                WHEN 2 THEN '- Part ' || part WHEN 3 THEN '**Note** ' || part ELSE '| Part | Key |' || chr(10) || '| --- | --- |' || chr(10) || '| P\| | ' || part || ' |' END AS md FROM depth),
            parts AS (SELECT o, run, string_agg(md, chr(10) ORDER BY pos) AS md FROM told GROUP BY o, run)
            SELECT o::VARCHAR AS path, trim(CASE WHEN o % 2 = 0 THEN '# Order ' || o || chr(10) || chr(10) ELSE '' END || string_agg(md, chr(10) || chr(10) ORDER BY run)) || chr(10) AS markdown FROM parts GROUP BY o""",
        "safe_names": r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url || ' (Final)', '[^/]*$'), '[^\p{L}\p{N}_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'document') || '.pdf' AS name FROM pages""",
        "content_keys": "SELECT doc_id, concat_ws('|', sha256(text), '300', 'false', 'eng', '1.5') AS key FROM documents",
        "previews": "SELECT doc_id, CASE WHEN length(t) <= 1000 THEN t WHEN cut > 0 AND cut < 1000 THEN left(t, cut) ELSE left(t, 1000) END AS preview FROM (SELECT doc_id, t, 1000 - nullif(instr(reverse(left(t, 1000)), chr(10) || chr(10)), 0) - 1 AS cut FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents))",
        "escaped_starts": _with(FEATURES, select=f"SELECT doc_id, page_no, line_idx, {escaped('t')} AS escaped FROM (SELECT *, ['', '# ', '12) ', '> ', '+ ', '- ', '#hash'][line_idx % 7 + 1] || text AS t FROM features)"),
        "done_documents": "WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents) SELECT key, min(doc_id) AS doc_id FROM d WHERE key NOT IN (SELECT key FROM d WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY key",
    }
