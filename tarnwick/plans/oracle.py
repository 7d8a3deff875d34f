"""DuckDB SQL for the engine's queries, and the literal inputs that some of them share."""

from __future__ import annotations

import re

from ..functions.text import STOPWORDS

# ---------------------------------------------------------------- shared pieces


def _values(rows) -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _camel(p: str) -> str:
    for pattern in ("([A-Z]+)([A-Z][a-z])", "([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        p = rf"regexp_replace({p}, '{pattern}', '\1 \2', 'g')"
    return f"string_split({p}, ' ')"


_PARTS = f"""list_concat([lower(t)], flatten(list_transform(list_filter(string_split(t, '_'), lambda p: p <> ''), lambda p:
    CASE WHEN len({_camel("p")}) > 1 THEN list_transform({_camel("p")}, lambda c: lower(c)) WHEN lower(p) <> lower(t) THEN [lower(p)] ELSE []::VARCHAR[] END)))"""


def _words(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
    return f"list_filter(flatten(list_transform(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: {_PARTS})), lambda w: NOT list_contains([{stop}], w))"


_PATH = "concat_ws('/', 'corpus', source, doc_id)"
_LINES = "CASE WHEN t LIKE '%' || chr(10) OR t = '' THEN string_split(t, chr(10))[:-2] ELSE string_split(t, chr(10)) END"
_FILES = f"SELECT doc_id, source AS project, {_PATH} AS path, coalesce(text, '') AS t FROM documents"
_QUESTIONS = "SELECT item_id AS qid, array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % 3 = 1), ' ') AS q FROM benchmark"

_LEXICAL = f"""
q AS ({_QUESTIONS}), tok AS (SELECT doc_id AS idx, {_words("coalesce(text, '')")} AS w FROM documents),
post AS (SELECT idx, term, count(*) AS tf FROM (SELECT idx, unnest(w) AS term FROM tok) GROUP BY ALL), lens AS (SELECT idx, len(w) AS dl FROM tok),
av AS (SELECT count(*) AS n, avg(dl::DOUBLE) AS avgdl FROM lens),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term), av),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""{_LEXICAL},
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_words("q")}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT qid, idx, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
       FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN lens USING (idx), av GROUP BY ALL),
bm25 AS (SELECT qid, idx, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, idx) AS rank FROM q CROSS JOIN lens LEFT JOIN sc USING (qid, idx))"""


def _buckets(name: str, key: str, text: str, table: str) -> str:
    return f"""{name}_c AS (SELECT {key} AS k, ('0x' || right(md5(w), 2))::INT % 64 AS b, count(*)::DOUBLE AS c
      FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS w FROM {table}) GROUP BY ALL),
{name} AS (SELECT k, b, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS v FROM {name}_c)"""


_DENSE = f"""{_buckets("dv", "doc_id", "coalesce(text, '')", "documents")}, {_buckets("qv", "qid", "q", "q")},
ds AS (SELECT qv.k AS qid, dv.k AS idx, round(sum(qv.v * dv.v), 6) AS score FROM qv JOIN dv USING (b) GROUP BY ALL),
dense AS (SELECT qid, idx, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, idx) AS rank FROM q CROSS JOIN lens LEFT JOIN ds USING (qid, idx))"""
_FUSED = f"""{_BM25}, {_DENSE},
both_ AS (SELECT qid, idx, 0 AS list, rank FROM bm25 WHERE rank <= 60 UNION ALL SELECT qid, idx, 1, rank FROM dense WHERE rank <= 60),
fs AS (SELECT qid, idx, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list * 1000 + rank) AS first FROM both_ GROUP BY ALL),
fused AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM fs)"""
_NAMED = f"""files AS ({_FILES}), f60 AS (SELECT qid, idx, rank, path, project FROM fused JOIN files ON doc_id = idx WHERE rank <= 60)"""


def _capped(n: int) -> str:
    return f"(SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY nth > {n}, rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, project ORDER BY rank) AS nth FROM f60))"


_RELS = f"rels AS (SELECT DISTINCT item_id AS qid, path FROM benchmark b JOIN ({_FILES}) d ON contains(d.t, b.text))"
_LISTS = f"""lists AS (SELECT 'bm25' AS key, qid, path, rank FROM bm25 JOIN files ON doc_id = idx WHERE rank <= 10
  UNION ALL SELECT 'dense', qid, path, rank FROM dense JOIN files ON doc_id = idx WHERE rank <= 10
  UNION ALL SELECT 'hybrid', qid, path, rank FROM f60 WHERE rank <= 10 UNION ALL SELECT 'hybrid+cap', qid, path, rank FROM {_capped(1)} WHERE rank <= 10)"""


def _metrics(key: str, lists: str = "lists", asked: str = "q") -> str:
    """hits, labels, the metrics ``m`` (key, qid, ...) of the lists."""
    hit = ", ".join(f"CASE WHEN first_hit_rank <= {k} THEN 1.0::DOUBLE ELSE 0 END AS hit_rate_at_{k}" for k in (1, 3, 5, 10))
    rec = ", ".join(f"CASE WHEN nrel > 0 THEN coalesce(f{k}, 0)::DOUBLE / nrel ELSE 0 END AS recall_at_{k}" for k in (1, 3, 5, 10))
    cnt = ", ".join(f"count(*) FILTER (rank <= {k}) AS f{k}" for k in (1, 3, 5, 10))
    return f"""h AS (SELECT {key}, qid, path, min(rank) AS rank FROM {lists} JOIN rels USING (qid, path) WHERE rank <= 10 GROUP BY ALL),
g AS (SELECT {key}, qid, min(rank) AS first_hit_rank, {cnt}, sum(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)) AS dcg FROM h GROUP BY ALL),
n AS (SELECT qid, count(*) AS nrel FROM rels GROUP BY qid), ks AS (SELECT DISTINCT {key} FROM {lists}),
m AS (SELECT {key}, qid, first_hit_rank, {hit}, {rec}, coalesce(1.0::DOUBLE / first_hit_rank, 0) AS mrr,
        CASE WHEN nrel > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(nrel, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) ELSE 0 END AS ndcg_at_10
      FROM {asked} CROSS JOIN ks LEFT JOIN n USING (qid) LEFT JOIN g USING ({key}, qid))"""


_NAMES = [f"{m}_at_{k}" for m in ("hit_rate", "recall") for k in (1, 3, 5, 10)] + ["mrr", "ndcg_at_10"]
_ALL = f"WITH {_FUSED}, {_NAMED}, {_RELS}, {_LISTS}, {_metrics('key')}"
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT key, qid, '{m.replace('_at_', '@')}' AS metric, {m} AS value FROM m" for m in _NAMES) + ")"

# ---------------------------------------------------------------- sources

CORPUS_INVENTORY = f"""
WITH f AS (SELECT project, len({_LINES}) AS n FROM ({_FILES}))
SELECT project, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS lines FROM f GROUP BY ROLLUP (project)
"""
FILE_ENTRIES = f"SELECT path, project, len({_LINES})::INT AS lines, sha256(t) AS sha256 FROM ({_FILES})"
MANIFEST_DIFF = f"""
WITH f AS (SELECT lang, project, path, len({_LINES}) AS lines, sha256(t) AS sha256 FROM ({_FILES}) JOIN documents USING (doc_id)),
e AS (SELECT * FROM f WHERE lang IS DISTINCT FROM 'fr'),
a AS (SELECT project, path, CASE WHEN project = 'src5' THEN lines + 1 ELSE lines END AS lines, CASE WHEN project = 'src3' THEN 'changed' ELSE sha256 END AS sha256 FROM f WHERE lang IS DISTINCT FROM 'es'),
j AS (SELECT coalesce(e.project, a.project) AS project, coalesce(e.path, a.path) AS path, e.lines AS el, a.lines AS al,
        CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'not in manifest' WHEN e.sha256 <> a.sha256 THEN 'content differs' WHEN e.lines <> a.lines THEN 'line count differs' END AS problem
      FROM e FULL JOIN a ON e.project = a.project AND e.path = a.path)
SELECT project, path, problem, CASE WHEN problem = 'line count differs' THEN el || ' vs ' || al END AS detail FROM j WHERE problem IS NOT NULL
"""
LINE_TABLE = f"""
WITH f AS (SELECT doc_id, {_LINES} AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
w AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[A-Za-z0-9]')) AS w FROM f)
SELECT doc_id, len(l)::INT AS n_lines, len(w)::INT AS n_worded, list_min(w)::INT AS first, list_max(w)::INT AS last FROM w
"""
LABELS = "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"

# ---------------------------------------------------------------- text

TOKENS_TOPK = f"""
WITH w AS (SELECT unnest({_words("coalesce(text, '')")}) AS term FROM documents)
SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY n DESC, term LIMIT 50
"""
#: Shapes of identifiers that name a document by its source, language and number.
IDENTIFIERS = ("HTTP%2$sServer%3$d", "set_%1$s", "__%1$s__", "parseXML%3$dJson", "MAX_%2$s_%1$s", "_", "io%1$sError_NOW", "%2$sOf%1$s_%3$d")


def _format(shape: str) -> str:
    """A shape as DuckDB joins it."""
    parts = re.split(r"(%\d\$[sd])", shape)
    names = {"%1$s": "coalesce(source, 'none')", "%2$s": "coalesce(lang, 'x')", "%3$d": "doc_id"}
    return "concat(" + ", ".join(names.get(p, f"'{p}'") for p in parts if p) + ")"


IDENTIFIER_PARTS = f"""
WITH t AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*'), [{", ".join(map(_format, IDENTIFIERS))}])) AS t FROM documents)
SELECT t AS token, array_to_string({_PARTS}, ',') AS parts FROM t
"""
# Words of the published sample vocabulary of the English stemmer, with their stems.
_STEMS = {
    "consign": "consign consigned consigning consignment", "consist": "consist consisted consistency consistent consistently consisting consists", "consol": "consolation consolations console consoled consoles consoling consolingly consols",
    "consolatori": "consolatory", "consolid": "consolidate consolidated consolidating", "conson": "consonant", "consort": "consort consorted consorting", "conspicu": "conspicuous conspicuously", "conspiraci": "conspiracy", "conspir": "conspirator conspirators conspire conspired conspiring",
    "constabl": "constable constables", "constanc": "constance constancy", "constant": "constant", "knack": "knack knacks", "knackeri": "knackeries", "knag": "knag", "knave": "knave knaves", "knavish": "knavish", "knead": "kneaded kneading", "knee": "knee knees", "kneel": "kneel kneeled kneeling kneels",
    "knell": "knell", "knelt": "knelt", "knew": "knew", "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight knightly knights", "knit": "knit knits knitted knitting", "knive": "knives", "knob": "knob knobs", "knock": "knock knocked knocking knocks", "knocker": "knocker knockers", "knot": "knot knots",
}
STEM_WORDS = sorted(w for words in _STEMS.values() for w in words.split())
_DOC_LINES = f"SELECT doc_id, {_LINES} AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
STEMMED_TERMS = f"""
WITH s(place, stem) AS (VALUES {_values((STEM_WORDS.index(w), stem) for stem, words in _STEMS.items() for w in words.split())}),
d AS (SELECT doc_id, unnest(range(len(l))) AS i FROM ({_DOC_LINES}))
SELECT doc_id AS qid, stem AS term, count(*) AS qtf FROM d JOIN s ON place = (doc_id * 31 + i * 7) % {len(STEM_WORDS)} GROUP BY ALL
"""
# DuckDB has no CRC-32: its bits are spelled out
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(label, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT)"
DERIVED_SEEDS = f"SELECT label, (20260917 + {_CRC}) % 4294967296 AS seed FROM (SELECT DISTINCT concat_ws('/', source, lang, 'mrr') AS label FROM documents)"

# ---------------------------------------------------------------- chunks

# windows of 250 words (254 less the 4 of "path :: lines n-n"); a line beyond them is a window in pieces of 242 words
_WINDOWS = f"""RECURSIVE f AS (SELECT project, path, {_LINES} AS l FROM ({_FILES})),
d AS (SELECT project, path, len(l) AS n, list_transform(l, lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS w,
        list_transform(range(1, len(l) + 1), lambda k: list_sum(list_transform(l[1:k], lambda x: len(regexp_extract_all(x, '[^ \\t\\n\\r\\f\\v]+'))))) AS c FROM f WHERE len(l) > 0),
r AS (SELECT project, path, n, w, c, 0::BIGINT AS lo, greatest(0, len(list_filter(c, lambda x: x <= 250)) - 1) AS hi FROM d
  UNION ALL
  SELECT project, path, n, w, c, nlo, greatest(nlo, len(list_filter(c, lambda x: x <= c[nlo] + 250)) - 1) FROM (
    SELECT *, CASE WHEN big THEN lo + 1 ELSE greatest(hi + 1 - floor((hi - lo + 1) * 0.25)::BIGINT, lo + 1) END AS nlo FROM (
      SELECT *, lo = hi AND c[lo + 1] - CASE WHEN lo = 0 THEN 0 ELSE c[lo] END > 250 AS big FROM r) WHERE big OR hi < n - 1) WHERE nlo < n),
windows AS (SELECT project, path, lo, hi, CASE WHEN big > 250 THEN ceil(big / 242.0)::BIGINT WHEN list_contains(w[lo + 1:hi + 1], true) THEN 1 ELSE 0 END AS pieces
            FROM (SELECT *, CASE WHEN lo = hi THEN c[lo + 1] - CASE WHEN lo = 0 THEN 0 ELSE c[lo] END ELSE 0 END AS big FROM r))"""
WINDOW_CHUNKS = f"WITH {_WINDOWS} SELECT path, sum(pieces)::BIGINT AS n_windows, min(lo + 1)::INT AS first, max(hi + 1)::INT AS last FROM windows WHERE pieces > 0 GROUP BY path"
# Section i of a document is a heading line and its i-th line, k of them; a section of more than 248 words is a heading and pieces of 242 words.
# Sections are packed while their 2 + c words and the 4 of path, name and lead stay within 254; 7 of these are the names where a heading of pieces joins.
MERGED = f"""
WITH RECURSIVE f AS (SELECT path || '.md' AS path, {_LINES} AS l FROM ({_FILES})),
s AS (SELECT path, i, l[i] AS t, len(regexp_extract_all(l[i], '[^ \\t\\n\\r\\f\\v]+')) AS c, regexp_matches(l[i], '[A-Za-z0-9]') AS w FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM f)),
e AS (SELECT *, w AND c > 248 AS big, 2 * i - CASE WHEN w THEN 0 ELSE 1 END AS last, CASE WHEN w THEN c ELSE 0 END AS own FROM s),
r AS (SELECT path, i, big, CASE WHEN NOT big THEN i END AS start, 2 + c AS held, false AS joins, NULL::BIGINT AS before FROM e WHERE i = 1
  UNION ALL
  SELECT e.path, e.i, e.big, CASE WHEN e.big THEN NULL WHEN fits THEN q.start ELSE e.i END, CASE WHEN fits THEN q.held ELSE 0 END + 2 + e.c, e.big AND coalesce(7 + q.held + 2 <= 254, false), q.start
  FROM (SELECT r.path, r.start, CASE WHEN r.start IS NOT NULL THEN r.held END AS held, r.i, coalesce(4 + CASE WHEN r.start IS NOT NULL THEN r.held END + 2 + n.own <= 254, false) AS fits FROM r JOIN e n ON n.path = r.path AND n.i = r.i + 1) q
  JOIN e ON e.path = q.path AND e.i = q.i + 1),
runs AS (SELECT r.path, r.start, max(e.last) AS last FROM r JOIN e ON e.path = r.path AND e.i = r.i WHERE r.start IS NOT NULL GROUP BY r.path, r.start),
heads AS (SELECT r.path, r.i, r.joins, r.before, 1 + ceil(e.c / 242.0)::BIGINT AS n FROM r JOIN e ON e.path = r.path AND e.i = r.i WHERE r.big),
spans AS (SELECT runs.path, CASE WHEN heads.i IS NULL THEN 'part' ELSE 'part | part (1/' || heads.n || ')' END AS name, 2 * start - 1 AS first, coalesce(2 * heads.i - 1, last) AS last FROM runs LEFT JOIN heads ON heads.path = runs.path AND heads.joins AND heads.before = runs.start
  UNION ALL SELECT path, 'part (1/' || n || ')', 2 * i - 1, 2 * i - 1 FROM heads WHERE NOT joins),
sized AS (SELECT spans.path, name, first, last, 6 + last - first + 6 * ((last + 1) // 2 - first // 2) + coalesce((SELECT sum(len(e.t)) FROM e WHERE e.path = spans.path AND 2 * e.i BETWEEN spans.first AND spans.last), 0) AS n_chars FROM spans),
pieces AS (SELECT h.path, 'part (' || k || '/' || n || ')' AS name, 2 * h.i AS first, 2 * h.i AS last, 6 + len(array_to_string(regexp_extract_all(e.t, '[^ \\t\\n\\r\\f\\v]+')[242 * (k - 2) + 1:242 * (k - 1)], ' ')) AS n_chars
  FROM (SELECT *, unnest(range(2, n + 1)) AS k FROM heads) h JOIN e ON e.path = h.path AND e.i = h.i)
SELECT path || '::markdown_section::' || name || '::' || first AS chunk_id, 'markdown_section' AS kind, first::INT AS start_line, last::INT AS end_line, n_chars::INT AS n_chars FROM (SELECT * FROM sized UNION ALL SELECT * FROM pieces)
"""
# line i of a document stands under a heading of level length % 6 + 1; headings above one are those that none of their level or a lower one follows before it
MARKDOWN_SECTIONS = f"""
WITH f AS (SELECT path, {_LINES} AS l FROM ({_FILES})),
d AS (SELECT path, list_transform(l, lambda x: length(x) % 6 + 1) AS v, list_transform(l, lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS w FROM f WHERE len(l) > 0),
h AS (SELECT path, v, w, unnest(range(1, len(v) + 1)) AS i FROM d)
SELECT path, array_to_string(list_transform(list_filter(range(1, i + 1), lambda g: g = i OR list_min(v[g + 1:i]) > v[g]), lambda g: 'h' || ((g - 1) % 9)), ' > ') AS name, (2 * i)::INT AS start_line, (CASE WHEN w[i] THEN 2 * i + 1 ELSE 2 * i END)::INT AS end_line FROM h
UNION ALL SELECT path, '(preamble)', 1, 1 FROM d
"""
# what is declared where in the sources that are rendered for a document of n lines
CODE_UNITS = f"""
WITH d AS (SELECT doc_id, len(l) AS n FROM ({_DOC_LINES})),
m AS (SELECT doc_id, n, unnest(range(n)) AS k FROM d),
u AS (SELECT 'py' AS s, doc_id, 'module level' AS name, 'preamble' AS kind, 1 AS lo, 1 AS hi FROM d
  UNION ALL SELECT 'py', doc_id, 'D' || doc_id, 'class', 4, CASE WHEN n > 0 THEN 7 ELSE 6 END FROM d
  UNION ALL SELECT 'py', doc_id, 'D' || doc_id || '.m' || k, 'method', 8 + 4 * k, 10 + 4 * k FROM m
  UNION ALL SELECT 'py', doc_id, 'f' || doc_id, 'function', 9 + 4 * n, 13 + 4 * n FROM d
  UNION ALL SELECT 'py', doc_id, 'module level', 'preamble', 16 + 4 * n, 16 + 4 * n FROM d WHERE doc_id % 7 = 0
  UNION ALL SELECT 'java', doc_id, 'module level', 'preamble', 1, 1 FROM d
  UNION ALL SELECT 'java', doc_id, 'D' || doc_id, 'class', 3, 6 FROM d
  UNION ALL SELECT 'java', doc_id, 'D' || doc_id || '.m' || k, 'method', 7 + 5 * k, 10 + 5 * k FROM m
  UNION ALL SELECT 'java', doc_id, 'D' || doc_id || '.Kind', 'enum', 7 + 5 * n, 7 + 5 * n FROM d)
SELECT 'corpus/demo/D' || doc_id || '.' || s AS path, name, kind, lo::INT AS start_line, hi::INT AS end_line FROM u
"""
PAYLOADS = f"""
WITH {_WINDOWS}, one AS (SELECT w.project, CASE WHEN big > 250 THEN least(242, big - 242 * k) + 5 ELSE words + 4 END AS tokens
  FROM (SELECT project, pieces, big, words, unnest(range(pieces)) AS k FROM (SELECT *, CASE WHEN lo = hi THEN words ELSE 0 END AS big FROM (SELECT x.*, d.c[hi + 1] - CASE WHEN lo = 0 THEN 0 ELSE d.c[lo] END AS words FROM windows x JOIN d USING (path)))) w)
SELECT project, count(*) AS n_chunks, max(tokens)::BIGINT AS max_tokens, sum(tokens)::BIGINT AS tokens, count(*) FILTER (tokens > 254) AS over FROM one GROUP BY project
"""
CHUNK_SIZES = f"""
WITH {_WINDOWS}, one AS (SELECT project, path, hi - lo + 1 AS n, unnest(range(pieces)) FROM windows WHERE pieces > 0),
g AS (SELECT project, list_sort(list(n)) AS s, count(*) AS k, count(DISTINCT path) AS files FROM one GROUP BY project)
SELECT project, k AS n_chunks, s[k // 2 + 1]::INT AS median_lines, s[least(k - 1, floor(0.95::DOUBLE * k)::BIGINT) + 1]::INT AS p95_lines, s[k]::INT AS max_lines, files FROM g
"""
CHUNK_IDS = """
WITH r AS (SELECT doc_id, concat_ws('::', source, lang) AS id, row_number() OVER (PARTITION BY source, concat_ws('::', source, lang) ORDER BY doc_id) - 1 AS n FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN id || '#' || n ELSE id END AS chunk_id FROM r
"""

# ---------------------------------------------------------------- retrieval

BM25_TERMS = f"WITH {_LEXICAL} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM terms"
BM25_TOPK = f"WITH {_BM25} SELECT qid, idx, score, rank::INT AS rank FROM bm25 WHERE rank <= 10"
BM25_BOUNDED = f"WITH {_BM25}, hit AS (SELECT qid, idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM sc) SELECT qid, idx, score, rank::INT AS rank FROM hit WHERE rank <= 10"
BM25_FILLERS = f"""
WITH {_LEXICAL}, ask AS (SELECT idx AS qid, min(term) AS term FROM terms JOIN post USING (term) WHERE df <= 3 AND regexp_full_match(term, '[a-z]+') GROUP BY idx
  UNION ALL SELECT -1, arg_min(term, (-df, term)) FROM terms WHERE regexp_full_match(term, '[a-z]+') UNION ALL SELECT -2, NULL),
sc AS (SELECT qid, idx, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM ask JOIN terms USING (term) JOIN post USING (term) JOIN lens USING (idx), av GROUP BY ALL)
SELECT qid, idx, rank::INT AS rank FROM (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, idx) AS rank FROM ask CROSS JOIN lens LEFT JOIN sc USING (qid, idx)) WHERE rank <= 10
"""
HASH_EMBED = f"""
WITH {_buckets("dv", "doc_id", "coalesce(text, '')", "documents")},
g AS (SELECT k, max(v) AS largest, arg_min(b, (-v, b)) AS bucket, count(*) AS filled FROM dv GROUP BY k)
SELECT doc_id AS idx, round(coalesce(largest, 0), 6) AS largest, coalesce(bucket, 0)::BIGINT AS bucket, coalesce(filled, 0)::INT AS filled FROM documents LEFT JOIN g ON k = doc_id
"""
_NEAR = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
near AS (SELECT a.vec_id AS qid, b.vec_id AS idx, b.label, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM near)"""
DENSE_TOPK = f"WITH {_NEAR} SELECT qid, idx, score, rank::INT AS rank FROM top WHERE rank <= 10"
RRF_FUSION = f"WITH {_FUSED} SELECT qid, idx, rank::INT AS rank FROM fused WHERE rank <= 20"
FILE_CAP = f"""
WITH {_NEAR}, t AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS nth FROM top WHERE rank <= 60),
c AS (SELECT qid, idx, label, row_number() OVER (PARTITION BY qid ORDER BY nth > 2, rank) AS rank FROM t)
SELECT qid, idx, label, rank::INT AS rank FROM c WHERE rank <= 10
"""
_SPLIT = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \t\n\r\f\v]+'), lambda w: w <> ''))"
RERANK_OVERLAP = f"""
WITH {_BM25}, p AS (SELECT qid, idx, rank AS before, len(list_intersect({_SPLIT.format("q")}, {_SPLIT.format("coalesce(text, '')")}))::DOUBLE AS score
   FROM bm25 JOIN q USING (qid) JOIN documents ON doc_id = idx WHERE rank <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM p)
SELECT qid, idx, score, rank::INT AS rank FROM r WHERE rank <= 10
"""



def _overlap(text: str) -> str:
    """The first thirty fused, by the words they share with the question."""
    shared = f"len(list_intersect({_SPLIT.format('q')}, {_SPLIT.format(text)}))"
    return f"(SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY {shared} DESC, fused.rank) AS rank FROM fused JOIN q USING (qid) JOIN files ON doc_id = idx WHERE fused.rank <= 30)"


_PREFIXED = "project || ' :: ' || project || chr(10) || t"
SEARCHED = f"""
WITH {_FUSED}, {_NAMED}, capped AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY nth > 1, rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, project ORDER BY rank) AS nth FROM f60)),
found AS (SELECT 'bm25' AS strategy, qid, idx, rank FROM bm25 UNION ALL SELECT 'dense', qid, idx, rank FROM dense UNION ALL SELECT 'hybrid', qid, idx, rank FROM fused UNION ALL SELECT 'hybrid+cap', qid, idx, rank FROM capped
  UNION ALL SELECT 'hybrid+rerank', qid, idx, rank FROM {_overlap("t")} UNION ALL SELECT 'hybrid+rerank+prefix', qid, idx, rank FROM {_overlap(_PREFIXED)})
SELECT strategy, qid, idx, rank::INT AS rank FROM found WHERE rank <= 10
"""

# ---------------------------------------------------------------- evaluation

BM25_QUALITY = f"""
WITH {_BM25}, files AS ({_FILES}), {_RELS}, lists AS (SELECT 'bm25' AS key, qid, path, rank FROM bm25 JOIN files ON doc_id = idx WHERE rank <= 10),
asked AS (SELECT DISTINCT qid FROM rels), {_metrics("key", "lists", "asked")}
SELECT count(*) AS n, {", ".join(f"round(avg({m}), 6) AS {m}" for m in ("hit_rate_at_1", "hit_rate_at_5", "recall_at_5", "mrr", "ndcg_at_10"))} FROM m
"""
QUESTION_METRICS = f"{_ALL} SELECT key, qid, first_hit_rank::INT AS first_hit_rank, {', '.join(f'round({m}, 6) AS {m}' for m in _NAMES)} FROM m"
LEADERBOARD = f"{_ALL}, {_LONG} SELECT key, metric, round(avg(value), 6) AS value, count(*) AS n FROM long GROUP BY ALL"
PAIRS = (
    ("fused vs lexical", "hybrid", "bm25", ("hit_rate@1", "hit_rate@5", "mrr", "ndcg@10")),
    ("fused vs vectors", "hybrid", "dense", ("hit_rate@1", "mrr")),
    ("capped vs fused", "hybrid+cap", "hybrid", ("hit_rate@5", "recall@5", "mrr")),
    ("an absent side", "hybrid", "nothing", ("mrr",)),
)
_TAIL = "list_reduce(list_prepend([pow(0.5::DOUBLE, n), 0.0::DOUBLE], list_transform(range(0, least(b, w) + 1), lambda i: [i::DOUBLE, 0.0::DOUBLE])), lambda s, x: [s[1] * (n - x[1]) / (x[1] + 1), s[2] + s[1]])[2]"
_SIGN = f"CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * {_TAIL}) END"
PAIRED = f"""{_ALL}, {_LONG}, pairs(label, a, b, metric) AS (VALUES {_values((label, a, b, m) for label, a, b, ms in PAIRS for m in ms)}),
j AS (SELECT p.label, p.a AS a_key, p.b AS b_key, p.metric, x.value AS va, y.value AS vb, x.value - y.value AS d FROM pairs p JOIN long x ON x.key = p.a AND x.metric = p.metric JOIN long y ON y.key = p.b AND y.metric = p.metric AND y.qid = x.qid),
s AS (SELECT label, a_key, b_key, metric, avg(va) AS a_value, avg(vb) AS b_value, avg(d) AS diff, count(*) FILTER (d > 1e-12) AS b, count(*) FILTER (d < -1e-12) AS w, count(*) FILTER (abs(d) <= 1e-12) AS same FROM j GROUP BY ALL)
SELECT label, a_key AS a, b_key AS b, metric, round(a_value, 6) AS a_value, round(b_value, 6) AS b_value, round(diff, 6) AS diff, t.b AS better, t.w AS worse, same, round({_SIGN.replace("(b,", "(t.b,").replace(", w)", ", t.w)")}, 6) AS sign_test_p
FROM (SELECT *, b + w AS n FROM s) t
"""
SIGN_TEST = f"""
WITH g AS (SELECT source, lang, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 OR toxic = 1) AS w FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
SELECT source, lang, b AS better, w AS worse, round({_SIGN}, 9) AS p FROM (SELECT *, b + w AS n FROM g)
"""
_ROUNDED = "rm AS (SELECT key, qid, first_hit_rank, " + ", ".join(f"printf('%.4f', {m}::DOUBLE)::DOUBLE AS {m}" for m in _NAMES) + " FROM m)"
STORED_METRICS = f"{_ALL}, {_ROUNDED} SELECT key, qid, first_hit_rank::INT AS first_hit_rank, {', '.join(_NAMES)} FROM rm"


def _resampled(rows: str, keys: str, resamples: int) -> str:
    """``m`` (keys, b, mean) of rows (keys, ord, value), by draws in whole numbers."""
    same = " AND ".join(f"p.{k.strip()} IS NOT DISTINCT FROM v.{k.strip()}" for k in keys.split(","))
    named = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""v AS (SELECT {keys}, value, row_number() OVER (PARTITION BY {keys} ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS n FROM {rows}),
p AS (SELECT {keys}, b, ((b * 7919 + pos * 104729 + b * pos * 31) % 1000003) % n AS pick FROM v, range({resamples}) r(b)),
rs AS (SELECT {named}, b, avg(v.value) AS mean FROM p JOIN v ON {same} AND v.pos = p.pick GROUP BY ALL)"""


PAIRED_INTERVALS = f"""{_ALL}, {_ROUNDED}, {_LONG.replace(" FROM m", " FROM rm")}, pairs(label, a, b, metric) AS (VALUES {_values((label, a, b, m) for label, a, b, ms in PAIRS for m in ms)}),
j AS (SELECT p.label, p.a AS ka, p.b AS kb, p.metric, x.qid AS ord, x.value - y.value AS value FROM pairs p JOIN long x ON x.key = p.a AND x.metric = p.metric JOIN long y ON y.key = p.b AND y.metric = p.metric AND y.qid = x.qid),
{_resampled("j", "label, ka, kb, metric", 1000)},
span AS (SELECT label, ka, kb, metric, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM rs GROUP BY ALL),
mean AS (SELECT label, ka, kb, metric, round(avg(value), 9) AS value FROM j GROUP BY ALL)
SELECT label, ka AS a, kb AS b, metric, value, low, high, low <= 0 AND high >= 0 AS within_noise FROM span JOIN mean USING (label, ka, kb, metric)
"""
BOOTSTRAP_HASH = """
WITH v AS (SELECT lang, quality::DOUBLE AS value, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM labels JOIN documents USING (doc_id)),
p AS (SELECT lang, n, b, ((b * 7919 + pos * 104729 + b * pos * 31) % 1000003) % n AS pick FROM v, range(10000) r(b)),
m AS (SELECT p.lang, b, avg(v.value) AS mean FROM p JOIN v ON v.lang IS NOT DISTINCT FROM p.lang AND v.pos = p.pick GROUP BY ALL)
SELECT m.lang, round((SELECT avg(value) FROM v WHERE v.lang = m.lang), 6) AS value, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY m.lang
"""
CAP_SELECTION = f"""
WITH {_FUSED}, {_NAMED}, {_RELS},
lists AS (SELECT 0 AS cap, qid, path, rank FROM f60 WHERE rank <= 10 {" ".join(f"UNION ALL SELECT {c}, qid, path, rank FROM {_capped(c)} WHERE rank <= 10" for c in (3, 2, 1))}),
{_metrics("cap")}, hs AS (SELECT *, CASE WHEN qid % 2 = 0 THEN 'dev' ELSE 'test' END AS half FROM m), e AS (SELECT * FROM hs UNION ALL SELECT * REPLACE ('all' AS half) FROM hs),
a AS (SELECT cap, half, avg(mrr) AS mrr, avg(hit_rate_at_5) AS h, avg(recall_at_5) AS r FROM e GROUP BY ALL),
best AS (SELECT cap FROM a WHERE half = 'dev' ORDER BY round(mrr, 6) DESC, round(r, 6) DESC, cap = 0 DESC, cap DESC LIMIT 1)
SELECT nullif(cap, 0) AS per_file, half, round(mrr, 6) AS mrr, round(h, 6) AS hit_rate_at_5, round(r, 6) AS recall_at_5, cap = (SELECT cap FROM best) AS chosen FROM a
"""
_SHARES = f"""WITH {_FUSED}, {_NAMED}, {_RELS}, {_LISTS}, pr AS (SELECT DISTINCT qid, string_split(path, '/')[2] AS project FROM rels),
t AS (SELECT key, l.qid, l.path, pr.project IS NULL AS wrong, rels.path IS NOT NULL AS hit, regexp_matches(l.path, '[0-2]$') AS doc
      FROM lists l LEFT JOIN rels ON rels.qid = l.qid AND rels.path = l.path LEFT JOIN pr ON pr.qid = l.qid AND pr.project = string_split(l.path, '/')[2] WHERE rank <= 5),
s AS (SELECT key, qid, count(*) FILTER (doc) / 5.0::DOUBLE AS d, count(*) FILTER (wrong) / 5.0::DOUBLE AS w, bool_or(hit) AS hit FROM t GROUP BY ALL)"""
FAILURE_SHARES = f"""{_SHARES}
SELECT key, count(*) FILTER (NOT hit) AS n_misses, count(*) FILTER (hit) AS n_hits,
  {", ".join(f"round(coalesce(avg({c}){f}, 0), 6) AS {n}_share_{k}" for c, n in (("d", "doc"), ("w", "wrong_project")) for k, f in (("misses", " FILTER (NOT hit)"), ("hits", " FILTER (hit)"), ("all", "")))} FROM s GROUP BY key
"""
FAILURE_DIFFERENCES = f"""{_SHARES},
x AS (SELECT key, qid AS ord, hit, 'doc_share' AS name, d AS value FROM s UNION ALL SELECT key, qid, hit, 'wrong_project_share', w FROM s),
{_resampled("x", "key, name, hit", 1000)},
both_sides AS (SELECT a.key, a.name, a.mean - c.mean AS mean FROM rs a JOIN rs c ON a.key = c.key AND a.name = c.name AND a.b = c.b WHERE NOT a.hit AND c.hit),
span AS (SELECT key, name, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM both_sides GROUP BY ALL)
SELECT key, name, coalesce(low, 0) AS low, coalesce(high, 0) AS high FROM (SELECT DISTINCT key, name FROM x) LEFT JOIN span USING (key, name)
"""
SPLIT = """
SELECT doc_id AS qid, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) <= count(*) OVER (PARTITION BY lang) // 2 THEN 'dev' ELSE 'test' END AS half FROM documents
"""
KAPPA = """
WITH o AS (SELECT count(*) AS n, avg((quality = toxic)::INT::DOUBLE) AS agreement, avg(quality::DOUBLE) AS pa, avg(toxic::DOUBLE) AS pb FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
x AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS expected FROM o)
SELECT n, round(agreement, 6) AS agreement, round(expected, 6) AS expected, round(CASE WHEN expected < 1 THEN (agreement - expected) / (1 - expected) END, 6) AS kappa FROM x
"""
ADJUDICATION = """
WITH r AS (SELECT doc_id, (CASE WHEN doc_id % 5 = 0 THEN toxic = 0 ELSE quality = 1 END)::INT AS x, (toxic = 0)::INT AS y, CASE WHEN doc_id % 3 > 0 AND (quality = 1) <> (toxic = 0) THEN (quality = 1)::INT END AS z
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
s AS (SELECT 'labelled' AS stage, x, y FROM r UNION ALL SELECT 'decided', coalesce(z, x), coalesce(z, y) FROM r),
o AS (SELECT stage, count(*) AS n, avg((x = y)::INT::DOUBLE) AS agreement, avg(x::DOUBLE) AS pa, avg(y::DOUBLE) AS pb FROM s GROUP BY stage),
e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS expected FROM o)
SELECT stage, n, round(agreement, 6) AS agreement, round(expected, 6) AS expected, round(CASE WHEN expected < 1 THEN (agreement - expected) / (1 - expected) END, 6) AS kappa FROM e
"""
