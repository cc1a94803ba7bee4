"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from ..functions.config import ALIASES, FIELDS, HOOKS, METRICS, ROLES, STOP_WORDS, SUGGESTED_ROLES, NoiseConfig
from ..sources.corpus import md_docs_sql

WS = r"[\s\x0B\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ltrim(x):
    return f"regexp_replace({x}, '^{WS}+', '')"


def rtrim(x):
    return f"regexp_replace({x}, '{WS}+$', '')"


def trim(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def split_before(x, head):
    return f"string_split(regexp_replace({x}, '(?m)^({head})', chr(1) || '\\1', 'g'), chr(1))"


def blocks(x, head):
    return f"list_filter(list_transform({split_before(x, head)}, lambda s: {trim('s')}), lambda s: s <> '')"


def units(x):
    return f"CAST(len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+|[^\\s\\x0B\\p{{L}}\\p{{N}}]')) AS BIGINT)"


def heading(x):
    return trim(f"regexp_extract({x}, '(?m)^(#{{1,3}})\\s+(.+?)\\s*$', 2)")


def h1(x):
    return f"regexp_extract({x}, '(?m)^#[ \\t]+(.+?)[ \\t]*$', 1)"


def words(x):
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda w: lower(w))"


STOPS = ", ".join(map(q, sorted(set(STOP_WORDS))))


def significant(x):
    return f"list_filter(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)), lambda w: length(w) >= 3 AND w NOT IN ({STOPS}))"


def half_up(x, n):
    return f"floor(({x}) * {10**n}.0 + 0.5) / {10**n}.0"


def snippet(x):
    return f"CASE WHEN length({x}) > 240 THEN {rtrim(f'substr({x}, 1, 240)')} || '...' ELSE {x} END"


def has(x, term):
    """An ASCII word boundary on either side; term is a Python string."""
    import re

    return "false" if not term else f"regexp_matches({x}, {q('(?i)' + chr(92) + 'b' + re.sub(r'([.*+?^${}()|[' + chr(92) + chr(93) + chr(92) + chr(92) + '])', lambda m: chr(92) + m[0], term) + chr(92) + 'b')})"


def clamp(x):
    return f"CASE WHEN length({x}) > 4000 THEN substr({x}, 1, 4000) || chr(10) || '…[truncated]' ELSE {x} END"


def collapse(x):
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


MD = f"md_docs AS ({md_docs_sql('string_agg(sec, chr(10) || chr(10) ORDER BY doc_id)')})"
FLAT = """^[A-Za-z_]\\w*:(?:[ \\t]+(?:"[^"]*"|''[^'']*''|[^"''\\s][^\\n]*)?)?[ \\t]*$"""


def _field(f):
    raw = trim(f"regexp_extract(yaml, '(?m)^{f}:[ \\t]*(.*)$', 1)")
    return f"""CASE WHEN fm_present AND regexp_matches(yaml, '(?m)^{f}:') AND {raw} NOT IN ('', '~', 'null')
  THEN regexp_replace(regexp_replace({raw}, '^"(.*)"$', '\\1'), '^''(.*)''$', '\\1') END AS {f}"""


FM = f"""{MD},
fm1 AS (SELECT *, {ltrim('markdown')} AS l FROM md_docs),
fm2 AS (SELECT *, CASE WHEN starts_with(l, '---') THEN instr(substr(l, 4), '---') ELSE 0 END AS c FROM fm1),
fm3 AS (SELECT *, CASE WHEN c > 0 THEN {trim('substr(l, 4, c - 1)')} END AS yaml, CASE WHEN c > 0 THEN {ltrim('substr(l, c + 6)')} ELSE markdown END AS body FROM fm2),
fm4 AS (SELECT *, list_filter(string_split(yaml, chr(10)), lambda x: {trim('x')} <> '') AS yl FROM fm3),
fm5 AS (SELECT *, coalesce(c > 0 AND len(yl) > 0 AND len(list_filter(yl, lambda x: NOT regexp_matches(x, '{FLAT}'))) = 0, false) AS fm_present FROM fm4),
fm AS (SELECT doc_index, doc_name, markdown, body, fm_present, {', '.join(map(_field, FIELDS))} FROM fm5)"""


def posexplode(source, keys, array, pos, item):
    """Rows of an array with their place, from 0."""
    return f"SELECT {keys}, CAST(unnest(range(len({array}))) AS BIGINT) AS {pos}, unnest({array}) AS {item} FROM {source}"


H1 = f"""{FM}, h1a AS (SELECT doc_index, doc_name, coalesce(topic, '') AS topic, list_filter({blocks('body', '#[ ' + chr(92) + 't]+')}, lambda s: regexp_matches(s, '^#[ \\t]+')) AS b FROM fm),
h1s AS ({posexplode('h1a', 'doc_index, doc_name, topic', 'b', 'section_index', 'text')})"""
HB = f"""{FM}, hb AS (SELECT doc_index, topic, {blocks('body', '#{1,3}' + chr(92) + 's+')} AS b FROM fm),
hbs AS ({posexplode('hb', 'doc_index', 'b', 'sec', 'text')})"""
# The greedy fold: a recursive walk over paragraphs in order; grp counts the groups closed.
FOLD = """{name}f AS (
  SELECT k, 1 AS i, 0 AS grp, CASE WHEN n > 0 THEN [ps[1]] END AS now, ts[1] AS s, ts[1] AS last_t, CAST([] AS VARCHAR[][]) AS done, ps, ts, n FROM {name}p WHERE n > 0
  UNION ALL
  SELECT k, i + 1, grp,
    CASE WHEN s + ts[i + 1] > {budget} THEN CASE WHEN last_t < {carry} THEN [ps[i], ps[i + 1]] ELSE [ps[i + 1]] END ELSE list_append(now, ps[i + 1]) END,
    CASE WHEN s + ts[i + 1] > {budget} THEN CASE WHEN last_t < {carry} THEN last_t ELSE 0 END ELSE s END + ts[i + 1],
    ts[i + 1],
    CASE WHEN s + ts[i + 1] > {budget} THEN list_append(done, now) ELSE done END, ps, ts, n
  FROM {name}f WHERE i < n),
{name}g AS (SELECT k, list_append(done, now) AS groups FROM {name}f WHERE i = n)"""
CHUNKS = f"""{HB}, one AS (SELECT doc_index, sec, text, {units('text')} AS t FROM hbs),
cp AS (SELECT doc_index * 100000 + sec AS k, ps, list_transform(ps, lambda p: {units('p')}) AS ts, len(ps) AS n FROM (SELECT doc_index, sec, list_filter(string_split_regex(text, '\\n\\n+'), lambda p: {trim('p')} <> '') AS ps FROM one WHERE t > 600)),
{FOLD.format(name='c', budget=512, carry=75)},
pieces AS (SELECT doc_index, sec, sub, {heading('o.text')} AS header, array_to_string(parts, chr(10) || chr(10)) AS text FROM ({posexplode('cg', 'k', 'groups', 'sub', 'parts')}) x JOIN one o ON o.doc_index * 100000 + o.sec = x.k),
every AS (SELECT doc_index, sec, 0 AS sub, {heading('text')} AS header, text, t AS token_count, false AS oversized_resplit FROM one WHERE t <= 600
  UNION ALL SELECT doc_index, sec, sub, header, text, {units('text')}, true FROM pieces),
chunks AS (SELECT doc_index, row_number() OVER (PARTITION BY doc_index ORDER BY sec, sub) - 1 AS chunk_index, header, text, token_count, oversized_resplit FROM every)"""

_CFG = NoiseConfig()
NOISE_LINE = "^(?:" + "|".join(_CFG.patterns).replace("'", "''") + ")$"
_HEAD8 = f"array_to_string(list_filter(string_split_regex(lower({trim('s')}), '\\s+'), lambda w: w <> '')[1:8], ' ')"
CLOSING = "(" + " OR ".join(f"contains({_HEAD8}, {q(p)})" for p in _CFG.closing) + ")"
_LINES = f"list_filter(list_transform(string_split(s, chr(10)), lambda x: {trim('x')}), lambda x: x <> '')"
TITLE_ONLY = f"(len({_LINES}) > 0 AND starts_with({_LINES}[1], '#') AND (len({_LINES}) = 1 OR len({_LINES}) = 2 AND length({_LINES}[2]) < 80))"


def noise(source: str, key: str) -> str:
    """CTEs up to noise(key, cleaned, original_slides, kept_slides, dropped_slides, stripped)."""
    return f"""n0 AS (SELECT {key}, {blocks('markdown', '#' + chr(92) + 's+')} AS b FROM {source}),
n1 AS (SELECT *, b[1] AS s FROM n0), n2 AS (SELECT {key}, b, coalesce(CASE WHEN len(b) > 0 THEN {TITLE_ONLY} END, false) AS f FROM n1),
n3 AS (SELECT {key}, b, f, CASE WHEN f THEN b[2:] ELSE b END AS t FROM n2), n4 AS (SELECT *, t[len(t)] AS s FROM n3),
n5 AS (SELECT {key}, b, f, t, coalesce(CASE WHEN len(t) > 0 THEN {CLOSING} END, false) AS z FROM n4),
n6 AS (SELECT {key}, b, f, z, CASE WHEN z THEN t[1:len(t) - 1] ELSE t END AS t FROM n5),
n7 AS (SELECT *, list_filter(list_transform(t, lambda s: {trim(f"array_to_string(list_filter(string_split(s, chr(10)), lambda x: NOT regexp_matches({trim('x')}, '{NOISE_LINE}')), chr(10))")}), lambda s: s <> '') AS k,
  list_sum(list_transform(t, lambda s: len(list_filter(string_split(s, chr(10)), lambda x: regexp_matches({trim('x')}, '{NOISE_LINE}'))))) AS n FROM n6),
noise AS (SELECT {key}, {collapse("array_to_string(k, chr(10) || chr(10))")} AS cleaned, CAST(len(b) AS BIGINT) AS original_slides, CAST(len(k) AS BIGINT) AS kept_slides,
  concat_ws(' | ', CASE WHEN f THEN 'first (title-only)' END, CASE WHEN z THEN 'last (thank-you / Q&A / closing)' END) AS dropped_slides, CAST(coalesce(n, 0) AS BIGINT) AS noise_lines_stripped FROM n7)"""


BULLET = r"^\s*(?:[-*+]\s+|\d+\.\s+)"
_at = lambda k: f"(CASE WHEN i > {k} THEN l[i - {k}] END)"
_ends = lambda x: f"(ends_with(regexp_replace({trim(x)}, '[*_`]+$', ''), ':') AND NOT starts_with({trim(x)}, '#') AND NOT regexp_matches({x}, '{BULLET}'))"
_set = lambda x: f"({x} IS NOT NULL AND {trim(x)} <> '')"
LEAD = f"(CASE WHEN {_set(_at(1))} THEN {_ends(_at(1))} WHEN {_set(_at(2))} THEN {_ends(_at(2))} WHEN {_set(_at(3))} THEN {_ends(_at(3))} ELSE false END)"
BAD = f"len(list_filter(list_transform(l, lambda x, i: regexp_matches(x, '{BULLET}') AND NOT coalesce(regexp_matches({_at(1)}, '{BULLET}'), false) AND NOT {LEAD}), lambda x: x)) > 0"


def issues(source: str, key: str, entity: str = "Acme") -> str:
    """CTEs up to issues(key, phase, section, sub, rule, check, severity, location, message) from
    source(key, markdown, body, fm_present, the fields)."""
    need = "\n".join(f"UNION ALL SELECT {key}, 1, 0, {k}, 0, 'frontmatter', 'error', 'frontmatter.{f}', 'Required field {f} is missing or empty.' FROM {source} WHERE coalesce({f}, '') = ''" for k, f in enumerate(FIELDS))
    stray = "len(regexp_extract_all(markdown, '(?m)^---\\s*$'))"
    return f"""v0 AS (SELECT {key}, {blocks('body', '#' + chr(92) + 's+')} AS b FROM {source}), v1 AS ({posexplode('v0', key, 'b', 'section', 's')}),
v2 AS (SELECT *, {units('s')} AS t, string_split(s, chr(10)) AS l, '# ' || {trim("regexp_extract(string_split(s, chr(10))[1], '^#\\s+([^\\r\\n]+)$', 1)")} AS place FROM v1),
v3 AS (SELECT {key}, section, {split_before('s', '##' + chr(92) + 's+')} AS p FROM v2), v4 AS ({posexplode('v3', f'{key}, section', 'p', 'sub', 'piece')}),
v5 AS (SELECT *, {units('piece')} AS t FROM v4 WHERE sub > 0),
issues AS (SELECT {key}, 0 AS phase, 0 AS section, 0 AS sub, 0 AS rule, 'frontmatter' AS "check", 'error' AS severity, 'top' AS location, 'Frontmatter is missing or cannot be read.' AS message FROM {source} WHERE NOT fm_present
{need}
UNION ALL SELECT {key}, 2, 0, 0, 0, 'frontmatter', 'warn', 'body', 'Found ' || {stray} || ' separator lines; two are expected.' FROM {source} WHERE {stray} > 2
UNION ALL SELECT {key}, 3, 0, 0, 0, 'structure', 'warn', 'body', 'The body has no section.' FROM v0 WHERE len(b) = 0
UNION ALL SELECT {key}, 4, section, 0, 0, 'token_min', 'warn', place, 'Chunk has ' || t || ' tokens; at least 70 are expected.' FROM v2 WHERE t < 70
UNION ALL SELECT {key}, 4, section, 0, 1, 'token_max', 'warn', place, 'Chunk has ' || t || ' tokens; at most 512 are expected.' FROM v2 WHERE t > 512
UNION ALL SELECT {key}, 4, section, 0, 2, 'entity', 'warn', place, 'Entity {entity} does not appear in the body.' FROM v2 WHERE NOT contains(lower(s), {q(entity.lower())})
UNION ALL SELECT {key}, 5, section, sub, 0, 'merge_short_h2', 'info', {trim("string_split(piece, chr(10))[1]")}, 'Subsection has ' || t || ' tokens; consider merging it.' FROM v5 WHERE t < 70
UNION ALL SELECT {key}, 6, section, 0, 0, 'bridge_sentence', 'info', place, 'A list has no sentence that leads in.' FROM v2 WHERE {BAD}
UNION ALL SELECT {key}, 7, 0, 0, 0, 'explicit_contact', 'info', 'body', 'Contact is asked for without a number or address.' FROM {source}
  WHERE regexp_matches(body, '(?i)\\bcontact\\s+(us|me)\\b') AND NOT regexp_matches(body, '\\+?\\d[\\d\\s\\-()]{{7,}}') AND NOT regexp_matches(body, '[\\w.%+\\-]+@[\\w.-]+\\.\\w+')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY phase, section, sub, rule) AS ord FROM issues)"""


ISSUES = f"{FM}, {issues('fm', 'doc_index')}"
PLAN = f"""{ISSUES}, typed AS (SELECT *, CASE "check" WHEN 'frontmatter' THEN 'fix_frontmatter' WHEN 'token_min' THEN 'merge_short' WHEN 'token_max' THEN 'shrink' WHEN 'entity' THEN 'rewrite' WHEN 'bridge_sentence' THEN 'rewrite' END AS type FROM numbered),
plan AS (SELECT doc_index, ord, type, location, message, CASE WHEN type = 'fix_frontmatter' THEN 0 ELSE coalesce(TRY_CAST(regexp_extract(message, '(\\d+)\\s+tokens?', 1) AS BIGINT), 0) END AS current_tokens
  FROM typed WHERE type IS NOT NULL QUALIFY type <> 'fix_frontmatter' OR row_number() OVER (PARTITION BY doc_index, type ORDER BY ord) = 1)"""


def issue_rows(*checks: str) -> str:
    return f"""WITH {ISSUES} SELECT doc_index, "check", severity, location, message FROM numbered WHERE "check" IN ({', '.join(map(q, checks))})"""


BASE = "tok AS (SELECT doc_id, {w} AS w FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"


def bm25(chunks: str, key: str, corpus: str, asked: str, k: int) -> str:
    """CTEs up to ranked(corpus, query_id, rank, key, s) from chunks(corpus, key, text)."""
    c = f"{corpus}, " if corpus else ""
    on = lambda a, b: f"{a}.{corpus} = {b}.{corpus}" if corpus else "true"
    return f"""asked AS ({asked}), qt AS (SELECT query_id, unnest({words('query')}) AS term FROM asked),
tk AS (SELECT {c}{key}, {words('text')} AS w FROM {chunks}), st AS (SELECT {c}count(*) AS n, avg(len(w)) AS al FROM tk {f'GROUP BY {corpus}' if corpus else ''}),
tf AS (SELECT {c}{key}, dl, term, count(*) AS tf FROM (SELECT {c}{key}, len(w) AS dl, unnest(w) AS term FROM tk) GROUP BY ALL),
df AS (SELECT {c}term, count(*) AS df FROM tf GROUP BY ALL),
hit AS (SELECT {'tf.' + corpus + ', ' if corpus else ''}query_id, tf.{key}, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS s
  FROM qt JOIN tf USING (term) JOIN df ON df.term = tf.term AND {on('df', 'tf')} JOIN st ON {on('st', 'tf')} GROUP BY ALL),
allp AS (SELECT {'tk.' + corpus + ', ' if corpus else ''}query_id, {key} FROM tk, (SELECT query_id FROM asked WHERE len({words('query')}) > 0) a{f', st WHERE st.{corpus} = tk.{corpus} AND al > 0' if corpus else ''}),
ranked AS (SELECT {'p.' + corpus + ', ' if corpus else ''}p.query_id, p.{key}, coalesce(s, 0) AS s, row_number() OVER (PARTITION BY {'p.' + corpus + ', ' if corpus else ''}p.query_id ORDER BY {half_up('coalesce(s, 0)', 9)} DESC, p.{key}) AS rank
  FROM allp p LEFT JOIN hit h ON h.query_id = p.query_id AND h.{key} = p.{key} AND {on('h', 'p')} QUALIFY rank <= {k})"""


ASKED = f"SELECT item_id AS query_id, array_to_string(({words('text')})[1:5], ' ') AS query FROM benchmark"


WHOLE = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _suggestions() -> str:
    alias = "CASE " + " ".join(f"WHEN contains(lt, {q(k)}) OR lt IN ({', '.join(q(n.lower()) for n in v)}) THEN list_filter([{', '.join(f'CASE WHEN NOT {has(chr(116) + chr(101) + chr(120) + chr(116), n)} THEN {q(n)} END' for n in [k, *v])}], lambda x: x IS NOT NULL)[1:1]" for k, v in ALIASES) + " ELSE [] END"
    lack = lambda names, n: f"list_filter([{', '.join(f'CASE WHEN NOT {has(chr(116) + chr(101) + chr(120) + chr(116), x)} THEN {q(x)} END' for x in names)}], lambda x: x IS NOT NULL)[1:{n}]"
    hook = "CASE " + " ".join(f"WHEN {has('text', k)} THEN {lack(v, 3)}" for k, v in HOOKS) + " ELSE [] END"
    no_role = " AND ".join(f"NOT {has('text', r)}" for r in ROLES)
    role = f"CASE WHEN regexp_matches(text, '(?i)(?:steps?|langkah|prosedur|how to|cara)\\b') AND {no_role} THEN [{', '.join(map(q, SUGGESTED_ROLES))}] ELSE [] END"
    metric = "CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}) THEN CASE WHEN {' AND '.join(f'NOT {has(chr(116) + chr(101) + chr(120) + chr(116), x)}' for x in v)} THEN [{', '.join(map(q, v[:2]))}] ELSE [] END" for p, v in METRICS) + " ELSE [] END"
    return f"""{CHUNKS}, sg AS (SELECT c.doc_index, chunk_index, text, lower({trim("coalesce(topic, '')")}) AS lt FROM chunks c JOIN fm USING (doc_index)),
s4 AS (SELECT doc_index, chunk_index, 0 AS ord, 'entity_alias' AS category, 'warn' AS severity, {alias} AS t FROM sg
UNION ALL SELECT doc_index, chunk_index, 1, 'question_hook', 'info', {hook} FROM sg
UNION ALL SELECT doc_index, chunk_index, 2, 'role_tag', 'info', {role} FROM sg
UNION ALL SELECT doc_index, chunk_index, 3, 'metric_label', 'info', {metric} FROM sg),
suggestions AS (SELECT doc_index, chunk_index, CAST(ord AS BIGINT) AS ord, category, severity, array_to_string(t, ' | ') AS suggested_terms FROM s4 WHERE len(t) > 0)"""


SUGGEST = _suggestions()


def inserted(text: str, term: str) -> str:
    head, known, relates = f"string_split({text}, chr(10))[1]", q(f"This section is also known by the term **{term}**."), q(f"This section relates to **{term}**.")
    rest = f"substr({text}, length({head}) + 1)"
    return f"""CASE WHEN {has(text, term)} THEN {text}
 WHEN starts_with({head}, '# ') THEN CASE WHEN length({head}) < 80 AND NOT contains({head}, '(') THEN {head} || ' ({term})' || {rest} ELSE {head} || chr(10) || chr(10) || {known} || {rest} END
 ELSE {relates} || chr(10) || chr(10) || {text} END"""


PAIRS = f"""sec AS (SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS d, doc_id AS s, text, source FROM documents),
{BASE.format(w=significant('text'))}, nn AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), nn),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
dots AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term JOIN sec x ON x.s = a.doc_id JOIN sec y ON y.s = b.doc_id WHERE (x.d, x.s) < (y.d, y.s) AND x.d <> y.d GROUP BY ALL),
pairs AS (SELECT x.d || ':' || x.s || '__' || y.d || ':' || y.s AS pair_id, x.d AS a_doc, x.s AS a_sec, y.d AS b_doc, y.s AS b_sec, {half_up('dot / (p.norm * q.norm)', 4)} AS similarity,
  x.text AS a_text, y.text AS b_text, x.source AS a_name, y.source AS b_name
  FROM dots JOIN nrm p ON p.doc_id = i JOIN nrm q ON q.doc_id = j JOIN sec x ON x.s = i JOIN sec y ON y.s = j WHERE dot / (p.norm * q.norm) >= 0.12
  ORDER BY similarity DESC, a_doc, a_sec, b_doc, b_sec LIMIT 80),
judged AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, a_doc, a_sec, b_doc, b_sec) - 1 AS o FROM pairs)"""
SHARED = f"list_sort(list_distinct(list_intersect({significant('a_text')}, {significant('b_text')})))"
FIRST = f"{H1}, first AS (SELECT doc_index, markdown, text, {h1('text')} AS heading FROM h1s JOIN md_docs USING (doc_index) WHERE section_index = 1)"


def replaced(md: str, old: str, new: str) -> str:
    return f"CASE WHEN {old} <> '' AND contains({md}, {old}) THEN substr({md}, 1, instr({md}, {old}) - 1) || {new} || substr({md}, instr({md}, {old}) + length({old})) ELSE {md} END"


_QUIET = "regexp_replace(text, '[\\\\\"\\x00-\\x1f]', ' ', 'g')"
VERDICTS = """j2 AS (SELECT *, CASE WHEN o % 7 = 0 THEN 'maybe' WHEN similarity >= 0.9 THEN 'duplicate' WHEN similarity >= 0.5 THEN 'overlap' ELSE 'distinct' END AS verdict,
  CASE o % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'neither' END AS dominant, CASE o % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE similarity END AS said FROM judged)"""
HTML = "coalesce(html, '')"
for _tag in ("script", "style", "nav", "footer", "head"):
    HTML = f"regexp_replace({HTML}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', '', 'g')"
HTML = f"regexp_replace({HTML}, '(?s)<!--.*?-->', '', 'g')"
for _n in (1, 2, 3):
    HTML = f"regexp_replace({HTML}, '(?i)<h{_n}\\b[^>]*>', chr(10) || chr(10) || '{'#' * _n} ', 'g')"
HTML = f"regexp_replace({HTML}, '(?i)<li\\b[^>]*>', chr(10) || '- ', 'g')"
HTML = f"regexp_replace({HTML}, '(?i)</(?:h[1-6]|p|div|ul|ol|article|table)\\s*>|<p\\b[^>]*>', chr(10) || chr(10), 'g')"
HTML = f"regexp_replace({HTML}, '(?i)<br\\s*/?>|</tr\\s*>', chr(10), 'g')"
HTML = f"regexp_replace({HTML}, '<[^>]*>', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_a}', '{_b}')"
HTML = f"{trim(collapse(f'regexp_replace({HTML}, {q(chr(91) + ' ' + chr(92) + 't]+' + chr(92) + 'n')}, chr(10), {q('g')})'))} || chr(10)"

_Q = "replace(text, '\"', '')"
FENCED = "'```markdown' || chr(10) || text || chr(10) || '  ```js ' || chr(10) || 'one' || chr(10) || '```' || chr(10) || 'two ```' || chr(10) || '```' || repeat(chr(10), 4) || '  tail ' || chr(10)"

SQL = {
    "md_compose": f"WITH {MD} SELECT doc_index, doc_name, md5(markdown) AS md5, length(markdown) AS chars FROM md_docs",
    "zip_archives": f"WITH {MD} SELECT doc_name, md5(markdown) AS md5 FROM md_docs",
    "frontmatter_parse": f"WITH {FM} SELECT doc_index, fm_present, {', '.join(FIELDS)}, md5(body) AS body_md5 FROM fm",
    "frontmatter_build": f"""WITH {FM} SELECT doc_index, '---' || chr(10) || 'department: "' || coalesce(department, '') || '"' || chr(10) || 'topic: "' || coalesce(topic, '') || '"' || chr(10) || 'course_id: ' || coalesce(course_id, '') || chr(10) || 'course_name: "' || coalesce(course_name, '') || '"' || chr(10) || '---' || chr(10) AS block FROM fm WHERE fm_present""",
    "frontmatter_fix": f"""WITH {MD}, a AS (SELECT *, {ltrim('markdown')} AS l FROM md_docs), b AS (SELECT *, CASE WHEN starts_with(l, '---') THEN instr(substr(l, 4), chr(10) || '---') ELSE 0 END AS c FROM a), d AS (SELECT *, substr(l, c + 7) AS rest FROM b)
SELECT doc_index, md5('---' || chr(10) || 'department: "Global"' || chr(10) || 'topic: "Topic of ' || doc_name || '"' || chr(10) || 'course_id: 0' || chr(10) || 'course_name: "Course"' || chr(10) || '---' || chr(10) || chr(10) ||
 CASE WHEN c > 0 THEN CASE WHEN contains(rest, chr(10)) THEN {ltrim('substr(rest, instr(rest, chr(10)) + 1)')} ELSE '' END ELSE l END) AS md5 FROM d""",
    "chunks_by_header": f"WITH {HB} SELECT doc_index, sec AS chunk_index, {heading('text')} AS header, {units('text')} AS tokens, md5(text) AS md5 FROM hbs",
    "h1_sections": f"WITH {H1} SELECT doc_index, topic, section_index, {h1('text')} AS heading, {units('text')} AS token_count, md5(text) AS md5 FROM h1s",
    "h1_sections_validator": f"WITH {FM}, {issues('fm', 'doc_index')} SELECT doc_index, section, substr(place, 3) AS title, md5(s) AS md5 FROM v2",
    "chunk_table": f"WITH RECURSIVE {CHUNKS} SELECT doc_index, chunk_index, header, token_count, oversized_resplit, md5(text) AS md5, CASE WHEN token_count > 512 THEN 'oversize' WHEN token_count < 70 THEN 'undersize' ELSE 'ok' END AS flag FROM chunks",
    "chunk_summary": f"WITH RECURSIVE {CHUNKS} SELECT doc_index, count(*) AS total, CAST(sum(CAST(oversized_resplit AS INT)) AS BIGINT) AS oversized_resplit, max(token_count) AS max_tokens, min(token_count) AS min_tokens, {half_up('avg(token_count)', 1)} AS avg_tokens FROM chunks GROUP BY doc_index",
    "chunk_resplit": f"WITH RECURSIVE rp AS (SELECT doc_id AS k, ps, list_transform(ps, lambda p: {units('p')}) AS ts, len(ps) AS n FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: {trim('p')} <> '') AS ps FROM documents)), {FOLD.format(name='r', budget=60, carry=15)} SELECT k AS doc_id, piece, CAST(len(parts) AS BIGINT) AS paragraphs, md5(array_to_string(parts, chr(10) || chr(10))) AS md5 FROM ({posexplode('rg', 'k', 'groups', 'piece', 'parts')})",
    "noise_clean": f"WITH {MD}, {noise('md_docs', 'doc_index')} SELECT doc_index, md5(cleaned) AS md5, length(cleaned) AS chars FROM noise",
    "noise_stats": f"WITH {MD}, {noise('md_docs', 'doc_index')} SELECT doc_index, original_slides, kept_slides, dropped_slides, noise_lines_stripped FROM noise",
    "slide_drop_flags": f"WITH {MD}, a AS (SELECT doc_index, {blocks('markdown', '#' + chr(92) + 's+')} AS b FROM md_docs), e AS ({posexplode('a', 'doc_index', 'b', 'slide', 's')}) SELECT doc_index, slide, {TITLE_ONLY} AS title_only, {CLOSING} AS closing FROM e",
    "issues_all": f'WITH {ISSUES} SELECT doc_index, ord, "check", severity, location, message FROM numbered',
    "issues_frontmatter": issue_rows("frontmatter", "structure"),
    "issues_entity": issue_rows("entity"),
    "issues_bridge": issue_rows("bridge_sentence"),
    "issues_contact": issue_rows("explicit_contact"),
    "issues_tokens": issue_rows("token_min", "token_max", "merge_short_h2"),
    "issue_summary": f"WITH {ISSUES} SELECT d.doc_index, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info FROM md_docs d LEFT JOIN issues USING (doc_index) GROUP BY d.doc_index",
    "fix_plan": f"WITH {PLAN} SELECT doc_index, ord, type, location, current_tokens FROM plan",
    "fix_list": f"WITH {PLAN}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_index ORDER BY ord) AS k FROM plan) SELECT doc_index, string_agg(k || '. [' || type || '] ' || location || ' (' || current_tokens || ' tokens): ' || message, chr(10) ORDER BY k) AS fix_list FROM n GROUP BY doc_index",
    "fix_route": f"WITH {PLAN} SELECT doc_index, CASE WHEN type = 'fix_frontmatter' THEN 'here' ELSE 'model' END AS made, count(*) AS fixes FROM plan GROUP BY ALL",
    "issue_view": f"""WITH {ISSUES} SELECT doc_index, ord, CAST(CASE severity WHEN 'error' THEN 0 ELSE 1 END AS BIGINT) AS rank, "check" FROM numbered WHERE severity <> 'info'""",
    "section_issues": f"""WITH {H1}, sx AS (SELECT doc_index * 100000 + section_index AS k, '---' || chr(10) || '---' || chr(10) || text AS markdown, text AS body, true AS fm_present, 'x' AS department, 'x' AS topic, '1' AS course_id, 'x' AS course_name FROM h1s), {issues('sx', 'k')},
 kept AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY phase, section, sub, rule) + CAST(len(regexp_extract_all(x.markdown, '(?m)^---\\s*$')) > 2 AS INT) AS o FROM issues JOIN sx x USING (k) WHERE "check" <> 'frontmatter')
 SELECT CAST(k // 100000 AS BIGINT) AS doc_index, CAST(k % 100000 AS BIGINT) AS section_index, o AS ord, "check" FROM kept""",
    "bm25_topk": f"WITH ch AS (SELECT doc_id AS chunk_index, text FROM documents), {bm25('ch', 'chunk_index', '', ASKED + ' WHERE item_id = 0', 5)} SELECT rank, chunk_index, {half_up('s', 4)} AS score, {heading('text')} AS header, {snippet('text')} AS snippet FROM ranked JOIN ch USING (chunk_index)",
    "bm25_topk_multi": f"WITH ch AS (SELECT doc_id AS chunk_index, text FROM documents), {bm25('ch', 'chunk_index', '', ASKED, 5)} SELECT query_id, rank, chunk_index, {half_up('s', 4)} AS score FROM ranked",
    "bm25_index_topk": f"WITH ch AS (SELECT doc_id AS chunk_index, text FROM documents), {bm25('ch', 'chunk_index', '', WHOLE, 5)} SELECT query_id, rank, chunk_index, {half_up('s', 4)} AS score, {heading('text')} AS header, {snippet('text')} AS snippet FROM ranked JOIN ch USING (chunk_index)",
    "bm25_index_document": f"WITH RECURSIVE {CHUNKS}, {bm25('chunks', 'chunk_index', 'doc_index', WHOLE, 3)} SELECT doc_index, query_id, rank, chunk_index, {half_up('s', 4)} AS score FROM ranked",
    "bm25_topk_document": f"WITH RECURSIVE {CHUNKS}, {bm25('chunks', 'chunk_index', 'doc_index', ASKED + ' WHERE item_id = 0', 3)} SELECT doc_index, rank, chunk_index, {half_up('s', 4)} AS score FROM ranked",
    "bm25_idf": f"WITH {BASE.format(w=words('text'))}, nn AS (SELECT count(*) AS n FROM documents) SELECT term, df, {half_up('ln((n - df + 0.5) / (df + 0.5) + 1)', 6)} AS idf FROM df, nn",
    "bm25_snippet": f"SELECT doc_id, {snippet('text')} AS snippet FROM documents",
    "suggest_all": f"WITH RECURSIVE {SUGGEST} SELECT * FROM suggestions",
    "suggest_alias": f"WITH RECURSIVE {SUGGEST} SELECT * FROM suggestions WHERE ord = 0",
    "suggest_hook": f"WITH RECURSIVE {SUGGEST} SELECT * FROM suggestions WHERE ord = 1",
    "suggest_role": f"WITH RECURSIVE {SUGGEST} SELECT * FROM suggestions WHERE ord = 2",
    "suggest_metric": f"WITH RECURSIVE {SUGGEST} SELECT * FROM suggestions WHERE ord = 3",
    "insert_term": f"WITH RECURSIVE {CHUNKS} SELECT doc_index, chunk_index, md5({inserted('text', 'playbook')}) AS md5 FROM chunks",
    "apply_term": f"WITH RECURSIVE {CHUNKS}, n AS (SELECT doc_index, chunk_index, text, markdown, {inserted('text', 'playbook')} AS new FROM chunks JOIN md_docs USING (doc_index)) SELECT doc_index, chunk_index, new <> text AND contains(markdown, text) AS applied, md5({replaced('markdown', 'text', 'new')}) AS md5 FROM n",
    "tfidf_weights": f"WITH {BASE.format(w=significant('text'))}, nn AS (SELECT count(*) AS n FROM documents) SELECT doc_id, term, tf, df, {half_up('tf * (ln((n + 1) / (df + 1)) + 1)', 6)} AS w FROM tf JOIN df USING (term), nn",
    "candidate_pairs": f"WITH {PAIRS} SELECT pair_id, a_doc, a_sec, b_doc, b_sec, similarity FROM pairs",
    "pair_bands": f"WITH {PAIRS} SELECT pair_id, similarity, CASE WHEN similarity >= 0.8 THEN 'high' WHEN similarity >= 0.6 THEN 'mid' ELSE 'low' END AS band FROM pairs",
    "shared_tokens": f"WITH {PAIRS} SELECT pair_id, CAST(len({SHARED}) AS BIGINT) AS shared, md5(array_to_string({SHARED}, ',')) AS md5 FROM pairs",
    "highlight_segments": f"WITH {PAIRS}, r AS (SELECT pair_id, regexp_extract_all(a_text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS r, {SHARED} AS s FROM pairs) SELECT pair_id, CAST(len(s) AS BIGINT) AS shared, CAST(len(r) AS BIGINT) AS runs, CAST(len(list_filter(r, lambda x: list_contains(s, lower(x)))) AS BIGINT) AS hits FROM r",
    "section_replace": f"WITH {FIRST} SELECT doc_index, contains(markdown, text) AS replaced, md5({replaced('markdown', 'text', q('# New') + ' || chr(10) || chr(10) || ' + q('Body.'))}) AS md5 FROM first",
    "section_delete": f"WITH {FIRST} SELECT doc_index, heading, md5(CASE WHEN contains(markdown, text) THEN {rtrim(collapse(replaced('markdown', 'text', q(''))))} || chr(10) ELSE markdown END) AS md5 FROM first",
    "section_undo": f"WITH {FIRST} SELECT doc_index, true AS restored FROM first WHERE contains(markdown, text)",
    "docset_upsert": f"""WITH {MD}, loaded AS (SELECT 0 AS b, doc_index AS o, doc_name AS name, markdown FROM md_docs UNION ALL SELECT 1, -doc_index, CASE WHEN doc_index % 2 = 0 THEN doc_name ELSE 'new-' || doc_name END, '# Replaced' FROM md_docs WHERE doc_index % 3 = 0)
SELECT CAST(first(b ORDER BY b, o) AS BIGINT) AS place_batch, CAST(first(o ORDER BY b, o) AS BIGINT) AS place_ord, name, md5(first(markdown ORDER BY b DESC, o DESC)) AS md5 FROM loaded GROUP BY name""",
    "judge_batches": f"WITH {PAIRS} SELECT pair_id, o AS original_order, CAST(o // 8 AS BIGINT) AS batch_no FROM judged",
    "judge_render": f"""WITH {PAIRS}, r AS (SELECT o, CAST(o // 8 AS BIGINT) AS batch_no, '### ' || pair_id || chr(10) || 'cosine: 1' || chr(10) || 'A (' || a_name || ', ' || {h1('a_text')} || '):' || chr(10) || {clamp('a_text')} || chr(10) || 'B (' || b_name || ', ' || {h1('b_text')} || '):' || chr(10) || {clamp('b_text')} AS t FROM judged)
SELECT batch_no, count(*) AS pairs, md5(string_agg(t, chr(10) || chr(10) ORDER BY o)) AS md5 FROM r GROUP BY batch_no""".replace(f"|| {clamp('a_text')} ||", f"|| ({clamp('a_text')}) ||").replace(f"|| {clamp('b_text')} AS t", f"|| ({clamp('b_text')}) AS t"),
    "verdict_normalize": f"WITH {PAIRS}, {VERDICTS} SELECT pair_id, verdict, {half_up('said', 4)} AS similarity, dominant FROM j2 WHERE verdict <> 'maybe'",
    "verdict_enrich": f"WITH {PAIRS}, {VERDICTS} SELECT pair_id, verdict, o AS original_order, similarity, dominant <> 'neither' AS offer_delete FROM j2 WHERE verdict IN ('duplicate', 'overlap')",
    "fix_all_layering": f"""WITH {PAIRS}, cl AS (SELECT o, a_doc AS d, a_sec AS s FROM judged UNION ALL SELECT o, b_doc, b_sec FROM judged), f AS (SELECT o, min(o) OVER (PARTITION BY d, s) AS m FROM cl), ok AS (SELECT o, bool_and(o = m) AS accepted FROM f GROUP BY o)
SELECT pair_id, o AS original_order, accepted FROM judged JOIN ok USING (o)""",
    "fence_strip": "SELECT item_id, md5(" + trim(collapse("regexp_replace(" + FENCED + ", '(?m)^[ \\t]*```\\w*[ \\t]*$', '', 'g')")) + " || chr(10)) AS md5 FROM benchmark",
    "section_clamp": f"SELECT doc_id, length({clamp('text')}) AS chars, md5({clamp('text')}) AS md5 FROM documents",
    "standardize_render": "SELECT doc_id, md5(CASE WHEN doc_id % 3 > 0 AND source <> '' AND lang <> '' AND text <> '' THEN 'Rewrite the notes below as a knowledge document with frontmatter.' || chr(10) || 'Department: ' || source || chr(10) || 'Topic: ' || lang || chr(10) || 'Course: ' || doc_id || ' Course' || chr(10) || chr(10) || text END) AS md5 FROM documents",
    "standardize_stub": f"SELECT doc_id, md5({trim(collapse(q('Rewrite the notes below as a knowledge document with frontmatter.') + ' || chr(10) || ' + q('Department: ') + ' || source || chr(10) || ' + q('Topic: ') + ' || lang || chr(10) || ' + q('Course: ') + ' || doc_id || ' + q(' Course') + ' || chr(10) || chr(10) || text'))} || chr(10)) AS md5 FROM documents",
    "rewrite_parse": f"""WITH b AS (SELECT item_id, trim({_QUIET}) AS t FROM benchmark) SELECT item_id, CASE WHEN item_id % 2 = 0 THEN t ELSE 'A' END AS section_a, CASE WHEN item_id % 2 = 0 THEN 'B' ELSE t END AS section_b FROM b""",
    "questions_parse": f"""WITH b AS (SELECT item_id, {_QUIET} AS t FROM benchmark) SELECT item_id, concat_ws(' | ', nullif(t, ''), 'Why ' || item_id || '?') AS questions FROM b""",
    "sse_decode": f"""WITH c AS (SELECT conv_id, turn, nullif({_QUIET}, '') AS w FROM conversations)
SELECT conv_id AS stream_id, CAST(count(w) + count(*) FILTER (turn = 0) AS BIGINT) AS deltas, md5(coalesce(string_agg(w, '' ORDER BY turn), '')) AS md5 FROM c GROUP BY conv_id""",
    "running_text": "SELECT conv_id AS stream_id, turn AS seq, md5(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '')) AS md5 FROM conversations",
    "idle_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), b AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS bursts, CAST(sum(n) AS BIGINT) AS edits, max(n) AS longest FROM b GROUP BY user_id""",
    "html_to_md": f"SELECT page_id, length({HTML}) AS chars, md5({HTML}) AS md5 FROM pages",
    "conv_to_md": f"SELECT conv_id, count(*) AS n_rows, md5('# ' || conv_id || chr(10) || chr(10) || string_agg('**' || coalesce(role, '') || ':** ' || {trim(chr(99) + 'oalesce(text, ' + q('') + ')')}, chr(10) || chr(10) ORDER BY turn, '**' || coalesce(role, '') || ':** ' || {trim('coalesce(text, ' + q('') + ')')}) || chr(10)) AS md5 FROM conversations GROUP BY conv_id",
    "parse_pipeline": f"WITH pg AS (SELECT page_id AS job_id, {HTML} AS markdown FROM pages WHERE page_id % 5 <> 0), {noise('pg', 'job_id')} SELECT job_id, original_slides, kept_slides, noise_lines_stripped, md5(cleaned) AS md5 FROM noise",
    "scan_counts": "SELECT count(*) FILTER (p_partkey % 7 IN (0, 1)) AS kept, count(*) FILTER (p_partkey % 7 NOT IN (0, 1)) AS skipped, count(*) FILTER (p_partkey % 7 IN (0, 1)) = 0 AS nothing FROM part",
    "first_headings": f"WITH {MD} SELECT doc_index, {heading('markdown')} AS heading, {h1('markdown')} AS h1 FROM md_docs",
    "term_presence": f"SELECT doc_id, {has('text', 'the')} AS has_0, {has('text', 'de')} AS has_1, {has('text', 'und.')} AS has_2, false AS has_3 FROM documents",
    "significant_words": f"SELECT doc_id, CAST(len({significant('text')}) AS BIGINT) AS words, md5(array_to_string({significant('text')}, ' ')) AS md5 FROM documents",
    "review_flags": f"""WITH {FIRST}, sx AS (SELECT doc_index AS k, '' AS markdown, '# New ' || text AS body, true AS fm_present, 'x' AS department, 'x' AS topic, '1' AS course_id, 'x' AS course_name FROM first), {issues('sx', 'k')}
SELECT doc_index, {h1("('# New ' || text)")} <> heading AS heading_changed, EXISTS (SELECT 1 FROM issues i WHERE i.k = doc_index AND severity <> 'info') AS badge FROM first""",
    "file_gate": """WITH n AS (SELECT p_partkey, p_name || ' é.' || (['md', 'Markdown', 'pdf', 'PPTX', 'ppt', 'xlsx', 'txt'])[p_partkey % 7 + 1] AS name FROM part),
r AS (WITH RECURSIVE b(p, v, s) AS (SELECT p_partkey, p_partkey, '' FROM part UNION ALL SELECT p, v // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(v % 36 AS INT) + 1, 1) || s FROM b WHERE v > 0) SELECT p, CASE WHEN p = 0 THEN '0' ELSE s END AS s FROM b WHERE v = 0)
SELECT p_partkey, p_partkey % 7 IN (0, 1) AS markdown, (['refused', 'refused', 'parse', 'parse', 'legacy', 'spreadsheet', 'refused'])[p_partkey % 7 + 1] AS gate, p_partkey % 7 IN (2, 3, 4) AS server,
 'uploads/' || s || '-r0-' || regexp_replace(name, '[^a-zA-Z0-9._-]', '_', 'g') AS key, CASE WHEN p_partkey % 3 > 0 THEN name ELSE 'knowledge' END || '.md' AS sink FROM n JOIN r ON p = p_partkey""",
    "pair_rewrite": f"""WITH {H1}, a AS (SELECT doc_index AS a_doc, CASE WHEN doc_index % 4 = 3 THEN text || ' gone' ELSE text END AS a_text FROM h1s WHERE section_index = 0), b AS (SELECT doc_index AS b_doc, text AS b_text FROM h1s WHERE section_index = 1),
e AS (SELECT a.*, b.*, x.markdown AS a_md, y.markdown AS b_md FROM a JOIN b ON a_doc + 1 = b_doc JOIN md_docs x ON x.doc_index = a_doc JOIN md_docs y ON y.doc_index = b_doc), f AS (SELECT *, contains(a_md, a_text) AND contains(b_md, b_text) AS ok FROM e)
SELECT a_doc AS original_order, ok, md5(CASE WHEN ok THEN {replaced('a_md', 'a_text', q('# A'))} ELSE a_md END) AS a_md5, md5(CASE WHEN ok THEN {replaced('b_md', 'b_text', q('# B'))} ELSE b_md END) AS b_md5 FROM f""",
}

_first = lambda cond: f"nullif(list_position(list_transform(ls, lambda x: coalesce({cond}, false)), true), 0)"
SQL["issue_line"] = f"""WITH {ISSUES}, a AS (SELECT n.doc_index, ord, location, string_split(markdown, chr(10)) AS ls, {trim('location')} AS p FROM numbered n JOIN md_docs USING (doc_index)),
b AS (SELECT *, regexp_extract(p, '^frontmatter\\.(\\w+)', 1) AS f, regexp_extract(p, '^#{{1,3}}[ ]+(.*)$', 1) AS h FROM a)
SELECT doc_index, ord, location, CAST(coalesce(CASE WHEN p IN ('', 'top') THEN 1 WHEN f <> '' THEN {_first("regexp_matches(x, '(?i)^\\s*' || f || '\\s*:')")}
 WHEN regexp_matches(p, '^#{{1,3}} ') THEN coalesce({_first(trim('x') + ' = p')}, {_first("regexp_matches(x, '^#{1,3}\\s') AND " + trim("regexp_replace(x, '^#{1,3}\\s+', '')") + ' = ' + trim('h'))})
 WHEN p = 'body' THEN {_first("regexp_matches(x, '^#\\s+')")} ELSE {_first('contains(x, p)')} END, 1) AS BIGINT) AS line FROM b"""


# Nested WITH keeps the names of the first plan apart from those of the second.
_FORM = "'---' || chr(10) || 'department: \"Global\"' || chr(10) || 'topic: \"Topic\"' || chr(10) || 'course_id: 0' || chr(10) || 'course_name: \"Course\"' || chr(10) || '---' || chr(10) || chr(10)"
_REPLY = f"{trim(collapse(q('') + ' || local || chr(10) || chr(10) || ' + q('# Acme') + ' || chr(10) || chr(10) || ' + q('Acme.')))} || chr(10)"
SQL["fix_apply"] = f"""WITH planned AS (WITH {PLAN} SELECT doc_index, bool_or(type = 'fix_frontmatter') AS here, bool_or(type <> 'fix_frontmatter') AS asked FROM plan GROUP BY doc_index),
first_issues AS (WITH {ISSUES} SELECT doc_index, count(*) AS n FROM issues GROUP BY doc_index),
x0 AS (WITH {MD} SELECT m.doc_index, doc_name, markdown, coalesce(here, false) AS here, coalesce(asked, false) AS asked, {ltrim('markdown')} AS l FROM md_docs m LEFT JOIN planned USING (doc_index)),
x1 AS (SELECT *, CASE WHEN starts_with(l, '---') THEN instr(substr(l, 4), chr(10) || '---') ELSE 0 END AS c FROM x0), x2 AS (SELECT *, substr(l, c + 7) AS rest FROM x1),
x3 AS (SELECT *, CASE WHEN here THEN {_FORM} || CASE WHEN c > 0 THEN CASE WHEN contains(rest, chr(10)) THEN {ltrim('substr(rest, instr(rest, chr(10)) + 1)')} ELSE '' END ELSE l END ELSE markdown END AS local FROM x2),
fixed AS (SELECT doc_index, doc_name, here, asked, CASE WHEN asked THEN {_REPLY} ELSE local END AS markdown FROM x3),
after_issues AS (WITH {ISSUES.replace(MD, "md_docs AS (SELECT doc_index, doc_name, markdown FROM fixed)", 1)} SELECT doc_index, count(*) AS n FROM issues GROUP BY doc_index)
SELECT f.doc_index, CASE WHEN asked THEN 'model' WHEN here THEN 'local' ELSE 'clean' END AS state, md5(markdown) AS md5, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after
FROM fixed f LEFT JOIN first_issues b ON b.doc_index = f.doc_index LEFT JOIN after_issues a ON a.doc_index = f.doc_index"""
_EDITS = f"""{H1}, sa AS (SELECT doc_index AS a_doc, CASE WHEN doc_index % 4 = 3 THEN text || ' gone' ELSE text END AS a_text FROM h1s WHERE section_index = 0), sb AS (SELECT doc_index AS b_doc, text AS b_text FROM h1s WHERE section_index = 1),
ed AS (SELECT a_doc AS o, a_doc, b_doc, a_text, b_text, '# New A ' || a_doc || chr(10) || chr(10) || a_text AS new_a, '# New B ' || a_doc || chr(10) || chr(10) || b_text AS new_b, contains(x.markdown, a_text) AND contains(y.markdown, b_text) AS ok
 FROM sa JOIN sb ON a_doc + 1 = b_doc JOIN md_docs x ON x.doc_index = a_doc JOIN md_docs y ON y.doc_index = b_doc)"""
SQL["rewrite_commit"] = f"""WITH {_EDITS} SELECT o AS original_order, a_doc, b_doc, CASE WHEN ok THEN 'done' ELSE 'stale' END AS state FROM ed
UNION ALL SELECT o + 1000000000, a_doc, b_doc, 'claimed' FROM ed WHERE o % 5 = 0"""
SQL["rewrite_undo"] = f"""WITH {_EDITS}, done AS (SELECT * FROM ed WHERE ok),
v0 AS (SELECT m.doc_index, m.markdown, b.b_text, b.new_b, a.a_text, a.new_a, b.o AS bo, a.o AS ao FROM md_docs m LEFT JOIN done b ON b.b_doc = m.doc_index LEFT JOIN done a ON a.a_doc = m.doc_index),
s1 AS (SELECT *, CASE WHEN bo IS NULL THEN markdown ELSE {replaced("markdown", "b_text", "new_b")} END AS m0 FROM v0),
s2 AS (SELECT *, CASE WHEN ao IS NULL THEN m0 ELSE {replaced('m0', 'a_text', 'new_a')} END AS m1 FROM s1),
s3 AS (SELECT *, CASE WHEN ao % 3 = 0 THEN {replaced('m1', 'new_a', 'a_text')} ELSE m1 END AS m2 FROM s2),
s4 AS (SELECT *, CASE WHEN bo % 3 = 0 THEN {replaced('m2', 'new_b', 'b_text')} ELSE m2 END AS m3 FROM s3)
SELECT doc_index, 0 AS version, md5(markdown) AS md5 FROM md_docs UNION ALL SELECT doc_index, 1, md5(m1) FROM s2 WHERE ao IS NOT NULL OR bo IS NOT NULL
UNION ALL SELECT doc_index, 2, md5(m3) FROM s4 WHERE ao % 3 = 0 OR bo % 3 = 0"""
SQL["review_pairs"] = f"""WITH {_EDITS}, sides AS (SELECT o, o * 2 AS k, new_a AS text FROM ed WHERE ok UNION ALL SELECT o, o * 2 + 1, new_b FROM ed WHERE ok),
sx AS (SELECT k, '' AS markdown, text AS body, true AS fm_present, 'x' AS department, 'x' AS topic, '1' AS course_id, 'x' AS course_name FROM sides), {issues('sx', 'k')}
SELECT o AS original_order, {h1('new_a')} <> {h1('a_text')} AS a_changed, {h1('new_b')} <> {h1('b_text')} AS b_changed, EXISTS (SELECT 1 FROM issues i WHERE i.k // 2 = o AND severity <> 'info') AS badge FROM ed WHERE ok"""
SQL["delete_report"] = f"""WITH {_EDITS} SELECT o AS original_order, CASE WHEN o % 2 = 0 THEN 'a' ELSE 'b' END AS deleted_side, CASE WHEN o % 2 = 0 THEN {h1('a_text')} ELSE {h1('b_text')} END AS deleted_heading,
 CASE WHEN o % 2 = 0 THEN {h1('b_text')} ELSE {h1('a_text')} END AS kept_heading FROM ed"""
SQL["verdict_lists"] = f"WITH {PAIRS}, {VERDICTS} SELECT verdict, string_agg(pair_id, ',' ORDER BY o) AS pairs FROM j2 WHERE verdict IN ('duplicate', 'overlap') GROUP BY verdict"
# Asked at 0, 2, ... 118 seconds: sixty times at most.
SQL["parse_poll"] = """WITH p AS (SELECT page_id, page_id % 75 AS pending, CASE WHEN page_id % 75 >= 60 THEN 'TIMED_OUT' WHEN page_id % 11 = 0 THEN 'CANCELED' WHEN page_id % 7 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS state FROM pages)
SELECT page_id, state, least(pending + 1, 60) AS polls, CASE WHEN state = 'SUCCESS' THEN CASE WHEN page_id % 2 = 0 THEN '# ' ELSE 'page ' END || page_id END AS parsed FROM p"""
SQL["sheet_stats"] = f"""WITH c AS (SELECT printf('s%02d', conv_id % 40) AS sheet, conv_id, bool_or(conv_id % 40 % 7 <> 3 AND {trim("coalesce(text, '')")} <> '') AS used FROM conversations GROUP BY ALL),
s AS (SELECT sheet, count(*) FILTER (used) AS n FROM c GROUP BY sheet) SELECT count(*) AS original_sheets, CAST(sum(n) AS BIGINT) AS kept_chunks, coalesce(string_agg(sheet, ',' ORDER BY sheet) FILTER (n = 0), '') AS dropped_sheets FROM s"""
SQL["parse_source"] = SQL["parse_pipeline"]
SQL["ingest_upsert"] = SQL["docset_upsert"]
SQL["dictionary_terms"] = """WITH t AS (SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark) WHERE length(w) >= 4),
d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents)
SELECT doc_id, term, count(*) AS n FROM d JOIN t ON w = term GROUP BY doc_id, term"""
SQL["versions_as_of"] = f"""WITH {FIRST}, step AS (
  SELECT doc_index, 1 AS version, markdown FROM md_docs
  UNION ALL SELECT doc_index, 2, CASE WHEN contains(markdown, text) THEN {rtrim(collapse(replaced('markdown', 'text', q(''))))} || chr(10) ELSE markdown END FROM first WHERE doc_index % 3 = 2 AND contains(markdown, text)
  UNION ALL SELECT doc_index, 3, CASE WHEN contains(markdown, text) THEN {replaced('markdown', 'text', "('# New' || chr(10) || chr(10) || text)")} ELSE markdown END FROM first WHERE doc_index % 3 = 0
  UNION ALL SELECT doc_index, 4, NULL FROM first WHERE doc_index % 6 = 1
  UNION ALL SELECT doc_index, 5, markdown FROM first WHERE doc_index % 3 = 2 AND contains(markdown, text)),
latest AS (SELECT v.as_of, s.*, row_number() OVER (PARTITION BY v.as_of, doc_index ORDER BY version DESC) AS r FROM step s, (SELECT unnest([1, 2, 3, 4, 5]) AS as_of) v WHERE s.version <= v.as_of)
SELECT as_of::BIGINT AS as_of, doc_index, version::BIGINT AS version, md5(markdown) AS md5 FROM latest WHERE r = 1 AND markdown IS NOT NULL"""
SQL["sse_stream"] = f"SELECT stream_id, md5 FROM ({SQL['sse_decode']}) s"
SQL["idle_sessions_stream"] = SQL["idle_sessions"].replace("SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL", "SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)").replace("SELECT user_id, sum(new)", "SELECT user_id, ts, sum(new)")
SQL["issues_rollup"] = f"""SELECT grouping(severity, "check")::BIGINT AS level, severity, "check", count(*) AS issues, count(DISTINCT doc_index) AS documents FROM ({SQL['issues_all']}) i GROUP BY ROLLUP (severity, "check")"""
SQL["issues_contact_rows"] = r"""SELECT doc_id, 'info' AS severity, 'body' AS location FROM documents
WHERE NOT regexp_matches(coalesce(text, ''), '\+?\d[\d\s\-()]{7,}') AND NOT regexp_matches(coalesce(text, ''), '[\w.%+\-]+@[\w.-]+\.\w+')"""
