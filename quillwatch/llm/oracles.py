"""SQL for DuckDB that gives the rows of those queries that SQL can express, from the definitions and not from the plans."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from . import licenses, line_dedup, quality_rules, url_filters

SPACE_WORD = r"[^\x20\x09-\x0D]+"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate({text}, '{ascii_uppercase}', '{ascii_lowercase}')"


MINHASH = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{SPACE_WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.root) AS component_id, r.doc_id = min(r.root) AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

_RATES = ", ".join(f"sum(({rule})::INT) AS k_{r}" for r, rule in quality_rules.RULES.items())
_MOMENTS = ", ".join(f"(sum(k_{r}) + 0.5) / (sum(n) + 1) AS m_{r}, greatest((sum(k_{r} * k_{r} / n) - sum(k_{r}) * sum(k_{r}) / sum(n)) / sum(n), 0) AS s_{r}" for r in quality_rules.RULES)
_STRENGTH = ", ".join(f"m_{r}, CASE WHEN s_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / s_{r} - 1, 1), 1e4) ELSE 1e4 END AS t_{r}" for r in quality_rules.RULES)
_SHRUNK = ", ".join(f"(k_{r} + m_{r} * t_{r}) / (n + t_{r})" for r in quality_rules.RULES)
QUALITY_RULES = f"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i : i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM words) WHERE regexp_matches(l, '{SPACE_WORD}') GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, d.source, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN lines l ON l.doc_id = d.doc_id),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {_RATES} FROM counted GROUP BY source),
prior AS (SELECT {_STRENGTH} FROM (SELECT {_MOMENTS} FROM hosts)),
verdicts AS (SELECT source, greatest({_SHRUNK}) > {quality_rules.MAX_HOST_RATE} AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM (SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, v.rejected FROM counted c JOIN verdicts v ON v.source IS NOT DISTINCT FROM c.source)
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{ITEM_WORD}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{ITEM_WORD}') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS x FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc_windows AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS x FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lengths WHERE len(w) >= m)),
found AS (SELECT DISTINCT d.doc_id, d.m, d.i, b.item_id FROM doc_windows d JOIN item_windows b ON b.m = d.m AND b.x = d.x),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""

LINE_DEDUP = f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
common AS (
  SELECT x.source, x.l FROM (SELECT source, l, count(DISTINCT doc_id) AS n FROM lines WHERE regexp_matches(l, '{SPACE_WORD}') GROUP BY source, l) x
  JOIN totals t ON t.source IS NOT DISTINCT FROM x.source WHERE x.n >= {line_dedup.MIN_LINE_PAGES} AND x.n > {line_dedup.MAX_RATIO}::DOUBLE * t.n),
marked AS (SELECT lines.*, c.l IS NOT NULL AS gone FROM lines LEFT JOIN common c ON c.source IS NOT DISTINCT FROM lines.source AND c.l = lines.l),
texts AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_lines_dropped, length(t.t)::BIGINT AS n_chars_kept, md5(t.t) AS kept_md5 FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id
"""

_quote = lambda s: "'" + s.replace("'", "''") + "'"
_KNOWN = ", ".join(f"({_quote(s)}, {_quote(i)})" for s, i in {s: i for i, s in licenses.SENTENCES}.items())
_ENDS = {"line": licenses.LINE_OR_SENTENCE_END, "joined": licenses.SENTENCE_END}
_READ = """
{name}_parts AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '{plus}', '\1 or later ', 'g'), {end}) AS p FROM documents)),
{name}_known AS (SELECT doc_id, count(*) AS n, string_agg(y.id, ',' ORDER BY k) AS ids
  FROM (SELECT doc_id, k, {unfilled} AS s FROM (SELECT doc_id, k, trim(regexp_replace(regexp_replace(s, '[.]+([^a-z0-9.]|$)', ' \\1', 'g'), '[^a-z0-9.]+', ' ', 'g'), ' .') AS s FROM {name}_parts)) p JOIN known y ON y.s = p.s GROUP BY doc_id)"""
_UNFILLED = "CASE " + " ".join(f"WHEN starts_with(s, {_quote(a)}) AND ends_with(s, {_quote(b)}) AND length(s) BETWEEN {len(a + b) + 1} AND {len(a + b) + licenses.BLANK_CHARS} THEN {_quote(a + licenses.BLANK + b)}" for a, b in licenses.blanks()) + " ELSE s END"
_FITS = lambda out: "CASE " + " ".join(f"WHEN contains(p, ',{','.join(seq)},') THEN {out(name, free)}" for name, free, seq in licenses.RULES) + " END"
_EACH = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(p, ',{','.join(seq)},') THEN {_quote(name)} END" for name, _, seq in licenses.RULES) + "], lambda x: x IS NOT NULL))"
_NAMES = ", ".join(_quote(n) for n in dict.fromkeys(name for name, _, _ in licenses.RULES))
LICENSES = f"""
WITH known(s, id) AS (VALUES {_KNOWN}),
{','.join(_READ.format(name=name, end=_quote(end), unfilled=_UNFILLED, plus=licenses.PLUS) for name, end in _ENDS.items())},
chosen AS (SELECT d.doc_id, CASE WHEN coalesce(j.n, 0) > coalesce(l.n, 0) THEN j.ids ELSE coalesce(l.ids, '') END AS ids FROM documents d LEFT JOIN line_known l ON l.doc_id = d.doc_id LEFT JOIN joined_known j ON j.doc_id = d.doc_id)
SELECT doc_id, ids AS license_sentences, array_to_string(list_filter([{_NAMES}], lambda n: list_contains(e, n)), ',') AS licenses, {_FITS(lambda n, f: _quote(n))} AS license, {_FITS(lambda n, f: str(f).lower())} AS permissive
FROM (SELECT *, {_EACH} AS e FROM (SELECT *, concat(',', ids, ',') AS p FROM chosen))
"""


def _rule_sql(pick) -> str:
    """CASE over the rules, the longest first."""
    arms = ""
    for verdict, rule in sorted(url_filters.RULES, key=lambda r: -len(r[1])):
        host, slash, rest = rule.partition("/")
        arms += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{rest}') THEN '{pick(rule, verdict)}'"
    return f"CASE{arms} END"


_NUMBER = "^[0-9]+([.][a-z0-9]{1,5})?$"
_SEGMENT = f"CASE WHEN regexp_matches(s, '{_NUMBER}') THEN concat('{{n}}', regexp_extract(s, '{_NUMBER}', 1)) WHEN regexp_matches(s, '^[0-9a-fA-F-]{{16,}}$') THEN '{{h}}' ELSE s END"
_LEVELS = ""
for _d in range(1, url_filters.MAX_DEPTH + 1):
    _LEVELS += f""",
b{_d} AS (SELECT host, template, shape[{_d}] AS segment, sum(n) AS n, sum(bad) AS bad, sum(labelled) AS labelled FROM t{_d - 1} WHERE len(shape) >= {_d} GROUP BY 1, 2, 3),
c{_d} AS (SELECT *, count(*) OVER p AS branches, sum(n) OVER p AS all_n, sum(bad) OVER p AS all_bad, sum(labelled) OVER p AS all_labelled FROM b{_d} WINDOW p AS (PARTITION BY host, template)),
d{_d} AS (SELECT *, (all_bad - bad + 1) / (all_labelled - labelled + 2)::DOUBLE AS siblings, (bad + 1) / (labelled + 2)::DOUBLE AS own FROM c{_d}),
e{_d} AS (SELECT host, template, segment,
    (branches >= {url_filters.MIN_VALUES} AND all_n < {url_filters.MAX_URLS_A_VALUE} * branches)
    OR (branches >= {url_filters.MIN_BRANCHES} AND 2 * n < all_n AND (all_labelled = 0 OR (labelled > 0 AND all_labelled > labelled AND abs(own - siblings) <= {url_filters.MAX_DEVIATION} * sqrt(siblings * (1 - siblings) / (labelled + 2))))) AS wild FROM d{_d}),
t{_d} AS (SELECT t.host, t.shape, t.n, t.bad, t.labelled, concat(t.template, CASE WHEN len(t.shape) < {_d} THEN '' WHEN e.wild THEN '/*' ELSE concat('/', t.shape[{_d}]) END) AS template
  FROM t{_d - 1} t LEFT JOIN e{_d} e ON e.host = t.host AND e.template = t.template AND len(t.shape) >= {_d} AND e.segment = t.shape[{_d}])"""
_pure = lambda t: f"({t}.l - {t}.b + {url_filters.SMOOTHING / 2}) / ({t}.l + {url_filters.SMOOTHING})::DOUBLE"
_LAST = f"t{url_filters.MAX_DEPTH}"
URL_FILTERS = f"""
WITH cut AS (SELECT page_id, {_lower("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
parts AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS p, {_rule_sql(lambda r, v: r)} AS rule, {_rule_sql(lambda r, v: v)} AS rule_verdict FROM cut),
shaped AS (SELECT *, CASE WHEN path = '' THEN [] WHEN len(p) > {url_filters.MAX_DEPTH} THEN list_append(list_transform(p[1 : {url_filters.MAX_DEPTH}], lambda s: {_SEGMENT}), '**') ELSE list_transform(p, lambda s: {_SEGMENT}) END AS shape FROM parts),
t0 AS (SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE rule_verdict = 'block') AS bad, count(rule_verdict) AS labelled, '' AS template FROM shaped GROUP BY host, shape){_LEVELS},
totals AS (SELECT host, template, regexp_replace(template, '/[^/]*$', '') AS above, sum(labelled) AS l, sum(bad) AS b FROM {_LAST} GROUP BY host, template),
beside AS (SELECT host, above, sum(l) AS l, sum(b) AS b FROM totals GROUP BY host, above),
hosts AS (SELECT host, sum(l) AS l, sum(b) AS b FROM totals GROUP BY host),
pure AS (SELECT t.host, t.template, CASE WHEN t.l > 0 THEN {_pure('t')} WHEN s.l > 0 THEN {_pure('s')} ELSE {_pure('h')} END AS purity
  FROM totals t JOIN beside s ON s.host = t.host AND s.above = t.above JOIN hosts h ON h.host = t.host)
SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.rule_verdict, CASE WHEN p.purity < {url_filters.MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, t.template, p.purity
FROM shaped s JOIN {_LAST} t ON t.host = s.host AND t.shape = s.shape JOIN pure p ON p.host = t.host AND p.template = t.template
"""

EXACT_DEDUP = """
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
SELECT p.doc_id, g.keep_id, g.group_size, p.doc_id = g.keep_id AS kept, sha256(p.t) AS text_sha256 FROM plain p JOIN groups g ON g.t = p.t
"""

#: SQL has no crc32: each distinct word's bytes are folded with the polynomial's table, which is made by its rule.
RESAMPLING = f"""
WITH RECURSIVE steps(b, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS f FROM steps WHERE k = 8),
docs AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{ITEM_WORD}') AS w FROM documents),
doc_words AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM docs) GROUP BY ALL),
item_words AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_lower("coalesce(text, '')")}, '{ITEM_WORD}')) AS w FROM benchmark) GROUP BY w),
digits AS (SELECT w, list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || hex(w)[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM (SELECT w FROM doc_words UNION SELECT w FROM item_words)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, f[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS b FROM digits, crc_table),
s AS (SELECT b, sum(n) AS n FROM doc_words JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS n FROM item_words JOIN hashed USING (w) GROUP BY b),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t_all),
gains AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t ON t.b = s.b, totals),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM doc_words JOIN hashed USING (w) JOIN gains USING (b) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(x.n, 0) AS n_features, CASE WHEN x.n IS NULL THEN 0 ELSE (x.total - ((x.total % x.n) + x.n) % x.n) // x.n END AS weight,
    floor(-1000 * ln(-ln((('0x' || sha256(concat('2024:', d.doc_id))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM docs d LEFT JOIN weights x ON x.doc_id = d.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.weight + s.noise AS score, r.rank
FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id AND r.rank <= (SELECT count(*) * 10 // 100 FROM ranked)
"""

ORACLES = {
    "op1_minhash": MINHASH,
    "op4_quality_rules": QUALITY_RULES,
    "op6_decontamination": DECONTAMINATION,
    "op7_url_filters": URL_FILTERS,
    "op8_license_scans": LICENSES,
    "op10_line_dedup": LINE_DEDUP,
    "op12_exact_dedup": EXACT_DEDUP,
    "op13_resampling": RESAMPLING,
}
