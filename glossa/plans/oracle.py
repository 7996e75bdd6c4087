"""The same queries as DuckDB SQL, written apart from the Spark plans."""

from __future__ import annotations

from glossa.functions import dims


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def _case(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in table.items()) + " END"


_PLAIN = f"translate(replace(coalesce(text, ''), '—', '--'), '‘’‚‛′“”„‟″«»–', {q(chr(39) * 5 + chr(34) * 7 + '-')})"
_LF = f"replace(regexp_replace({_PLAIN}, '\\r\\n?', chr(10), 'g'), chr(160), ' ')"
NORM = rf"regexp_replace(regexp_replace(regexp_replace({_LF}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"

_SENTS = rf"""
n AS (SELECT doc_id, {NORM} AS norm FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(norm, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM n),
s AS (SELECT doc_id, unnest(range(len(ss))) AS sent_id, unnest(ss) AS sentence FROM l)"""

_UNDOUBLE = "CASE WHEN length({x}) >= 2 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND regexp_matches(right({x}, 1), '\\pL') THEN left({x}, length({x}) - 1) ELSE {x} END"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _y(x: str) -> str:
    return f"(SELECT CASE WHEN z LIKE '%i' THEN left(z, length(z) - 1) || 'y' ELSE z END FROM (SELECT {x} AS z))"


_RULES = [
    ("NOT regexp_matches(w, '\\pL')", "w", 0),
    (f"w IN {_in(dims.IDENTITY)}", "w", 0),
    (f"w IN {_in(dims.IRREGULAR.values())}", _case("w", {v: k for k, v in dims.IRREGULAR.items()}), 12),
    ("w LIKE 'un%' AND length(w) > 2", "substr(w, 3)", 9),
    ("w LIKE '%ing' AND length(w) > 4", "u3", 3),
    ("w LIKE '%ied' AND length(w) > 3", f"{_cut(3)} || 'y'", 2),
    ("w LIKE '%ed' AND length(w) > 3", "u2", 2),
    ("w LIKE '%ies' AND length(w) > 3", f"{_cut(3)} || 'y'", 1),
    ("regexp_matches(w, '(s|x|z|ch|sh)es$')", _cut(2), 1),
    ("w LIKE '%s' AND length(w) > 2", _cut(1), 1),
    ("w LIKE '%ly' AND length(w) > 3", f"CASE WHEN {_cut(2)} LIKE '%i' THEN {_cut(3)} || 'y' ELSE {_cut(2)} END", 8),
    ("w LIKE '%est' AND length(w) > 4", "CASE WHEN u3 LIKE '%i' THEN left(u3, length(u3) - 1) || 'y' ELSE u3 END", 7),
    ("w LIKE '%er' AND length(w) > 3", "CASE WHEN u2 LIKE '%i' THEN left(u2, length(u2) - 1) || 'y' ELSE u2 END", 6),
]
_ROOT = "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r, _ in _RULES) + " ELSE w END"
_CODE = "CASE " + " ".join(f"WHEN {c} THEN {k}" for c, _, k in _RULES) + " ELSE 0 END"
_BARE = r"regexp_replace(lower(word), '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')"
_TAG = (
    "CASE WHEN b = '' THEN 'PUNCT' WHEN regexp_matches(b, '^[0-9]+([.,][0-9]+)*$') THEN 'NUM' "
    + " ".join(f"WHEN b IN {_in(ws.split())} THEN '{t}'" for t, ws in dims.TAGGER.items())
    + " "
    + " ".join(f"WHEN regexp_matches(b, '^.{{2,}}({'|'.join(e)})$') THEN '{t}'" for t, e in dims.TAG_SUFFIXES.items())
    + r" WHEN tok_id > 0 AND regexp_matches(word, '^[^\pL\pN]*\p{Lu}') THEN 'PROPN' ELSE 'NOUN' END"
)
_TOKS = (
    _SENTS
    + rf""",
w0 AS (SELECT doc_id, sent_id, list_filter(string_split_regex(sentence, '\s+'), lambda x: x <> '') AS ws FROM s),
w1 AS (SELECT doc_id, sent_id, len(ws) AS n_tok, unnest(range(len(ws))) AS tok_id, unnest(ws) AS word FROM w0),
w2 AS (SELECT *, lower(word) AS w, {_BARE} AS b FROM w1),
w3 AS (SELECT *, {_UNDOUBLE.format(x=_cut(3))} AS u3, {_UNDOUBLE.format(x=_cut(2))} AS u2 FROM w2),
t AS (SELECT doc_id, sent_id, tok_id, n_tok, word, b, {_ROOT} AS root, {_CODE} AS code, {_TAG} AS tag FROM w3)"""
)

_COORD = dims.coordinates()
_KNOWN = "".join(_COORD)
_NOT_KNOWN = "[^" + "".join("\\" + c if not c.isalnum() else c for c in _KNOWN) + "]"


def _mapped(x: str, at: int) -> str:
    to = "".join(chr(48 + v[at]) for v in _COORD.values()) + chr(48 + dims.UNKNOWN[at])
    return f"translate(regexp_replace(lower({x}), {q(_NOT_KNOWN)}, chr(1), 'g'), {q(_KNOWN)} || chr(1), {q(to)})"


_PAIRS = (
    _TOKS
    + f""",
b0 AS (SELECT doc_id, sent_id, tok_id, code, tag, length(root) AS n, CASE WHEN tok_id = 0 AND sent_id = 0 THEN '0' WHEN tok_id = 0 THEN '6' ELSE '5' END || '6' || {_mapped('root', 0)} || '6' || CASE WHEN tok_id < n_tok - 1 THEN '5' ELSE '' END AS body FROM t),
b1 AS (SELECT *, unnest(range(length(body) - 1)) AS i FROM b0),
p AS (SELECT doc_id, sent_id, tok_id, i, substr(body, i + 1, 1)::BIGINT AS prev, substr(body, i + 2, 1)::BIGINT AS cls, CASE WHEN i > 0 AND i <= n THEN code ELSE 0 END AS code, CASE WHEN i > 0 AND i <= n THEN tag ELSE 'X' END AS tag, tok_id = 0 AND i = 0 AS opens FROM b1)"""
)

_DISTS = (
    _PAIRS
    + """,
syms AS (SELECT DISTINCT doc_id, cls FROM p),
n1 AS (SELECT doc_id, prev, cls, count(*) AS n FROM p WHERE NOT opens GROUP BY ALL),
f1 AS (SELECT DISTINCT c.doc_id, c.prev, y.cls FROM p c JOIN syms y USING (doc_id)),
p1 AS (SELECT doc_id, prev, cls, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER w + count(*) OVER w)::DOUBLE AS p1 FROM f1 LEFT JOIN n1 USING (doc_id, prev, cls) WINDOW w AS (PARTITION BY doc_id, prev)),
n2 AS (SELECT doc_id, code, cls, count(*) AS n FROM p GROUP BY ALL),
codes AS (SELECT DISTINCT doc_id, code FROM t),
f2 AS (SELECT DISTINCT c.doc_id, c.code, y.cls FROM (SELECT doc_id, code FROM p UNION SELECT doc_id, code FROM codes) c JOIN syms y USING (doc_id)),
p2 AS (SELECT doc_id, code, cls, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER w + count(*) OVER w)::DOUBLE AS p2 FROM f2 LEFT JOIN n2 USING (doc_id, code, cls) WINDOW w AS (PARTITION BY doc_id, code)),
n3 AS (SELECT doc_id, tag, code, count(*) AS n FROM t GROUP BY ALL),
tags AS (SELECT DISTINCT doc_id, tag FROM t),
s3 AS (SELECT doc_id, tag, code, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER w + count(*) OVER w)::DOUBLE AS q FROM (SELECT tags.doc_id, tag, code FROM tags JOIN codes USING (doc_id)) LEFT JOIN n3 USING (doc_id, tag, code) WINDOW w AS (PARTITION BY doc_id, tag)),
x3 AS (SELECT doc_id, tag, code, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id, tag) AS q FROM (SELECT DISTINCT doc_id, tag FROM p EXCEPT SELECT doc_id, tag FROM tags) JOIN codes USING (doc_id)),
m3 AS (SELECT doc_id, tag, cls, sum(q * p2) AS m FROM (SELECT * FROM s3 UNION ALL SELECT * FROM x3) JOIN p2 USING (doc_id, code) GROUP BY ALL),
p3 AS (SELECT doc_id, tag, cls, m / sum(m) OVER (PARTITION BY doc_id, tag) AS p3 FROM m3)"""
)

_BPB = (
    _DISTS
    + """,
sp AS (SELECT doc_id, 1.0::DOUBLE / count(DISTINCT tag) AS sp FROM t GROUP BY 1),
j AS (SELECT doc_id, prev, code, tag, cls, count(*) AS n FROM p GROUP BY ALL),
bits AS (SELECT doc_id, sum(n) AS n_symbols, sum(-n * log2(greatest((p1 + p2 + sp * p3) / (2 + sp), 1e-10))) AS bits FROM j JOIN p1 USING (doc_id, prev, cls) JOIN p2 USING (doc_id, code, cls) JOIN p3 USING (doc_id, tag, cls) JOIN sp USING (doc_id) GROUP BY 1),
bpb AS (SELECT doc_id, coalesce(n_symbols, 0)::BIGINT AS n_symbols, round(coalesce(bits, 0), 4) AS bits, round(CASE WHEN strlen(coalesce(text, '')) > 0 THEN coalesce(bits, 0) / strlen(text) END, 4) AS bpb, strlen(text) AS bytes, lang FROM documents LEFT JOIN bits USING (doc_id))"""
)

_IRR = dims.IRREGULAR


def _stem(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[^aeiou]*[aeiou][bdgklmnprt]$') THEN {x} || right({x}, 1) WHEN {x} LIKE '%e' THEN left({x}, length({x}) - 1) ELSE {x} END"


_Y = "regexp_matches(root, '[^aeiou]y$')"
_S_FORM = f"CASE WHEN {_Y} THEN left(root, length(root) - 1) || 'ies' WHEN regexp_matches(root, '(s|x|z|ch|sh)$') THEN root || 'es' ELSE root || 's' END"
_PAST = f"coalesce({_case('root', _IRR)}, CASE WHEN {_Y} THEN left(root, length(root) - 1) || 'ied' ELSE {_stem('root')} || 'ed' END)"
_MINUS = "left(root, length(root) - 1)"
_SURFACE = f"""CASE code WHEN 0 THEN root
 WHEN 12 THEN CASE WHEN root IN {_in(dims.IDENTITY)} THEN root ELSE {_PAST} END
 WHEN 9 THEN CASE WHEN root LIKE 'un%' THEN root ELSE 'un' || root END
 WHEN 8 THEN CASE WHEN root LIKE '%ly' THEN root WHEN root LIKE '%y' AND length(root) > 1 THEN {_MINUS} || 'ily' WHEN root LIKE '%le' AND length(root) > 2 THEN left(root, length(root) - 2) || 'ly' ELSE root || 'ly' END
 WHEN 6 THEN coalesce({_case('root', dims.COMPARATIVES)}, CASE WHEN root LIKE '%y' AND length(root) > 1 THEN {_MINUS} || 'ier' WHEN root LIKE '%e' THEN root || 'r' ELSE root || 'er' END)
 WHEN 7 THEN coalesce({_case('root', dims.SUPERLATIVES)}, CASE WHEN root LIKE '%y' AND length(root) > 1 THEN {_MINUS} || 'iest' WHEN root LIKE '%e' THEN root || 'st' ELSE root || 'est' END)
 WHEN 1 THEN {_S_FORM} WHEN 5 THEN {_S_FORM} WHEN 2 THEN {_PAST} WHEN 4 THEN {_PAST} WHEN 3 THEN {_stem('root')} || 'ing' ELSE root END"""

_GRAPH = r"""
ln AS (SELECT unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line FROM documents),
ws AS (SELECT list_filter(string_split_regex(regexp_replace(line, '[^0-9A-Za-z_\s]+', '.', 'g'), '\s+'), lambda x: x <> '') AS ws FROM ln),
wd AS (SELECT unnest(ws) AS w FROM ws),
c0 AS (SELECT '^' || w || '$' AS m, count(*) AS n FROM wd GROUP BY 1),
c1 AS (SELECT substr(m, i, 1) AS cur, substr(m, i + 1, 1) AS nxt, n FROM (SELECT m, n, unnest(range(1, length(m))) AS i FROM c0)),
c2 AS (SELECT * FROM c1 UNION ALL SELECT u.cur, u.nxt, k.n FROM (SELECT sum(len(ws) - 1) AS n FROM ws WHERE len(ws) > 0) k, (VALUES ('$', '_'), ('_', '^')) u(cur, nxt) WHERE k.n > 0),
c3 AS (SELECT cur, nxt, sum(n)::BIGINT AS n FROM c2 GROUP BY ALL),
g AS (SELECT cur, nxt, n, round(n / (sum(n) OVER (PARTITION BY cur))::DOUBLE, 8) AS p FROM c3)"""

_CONN = [(c, r, len(c.split())) for r, cs in dims.CONNECTIVES.items() for c in cs]
_CONN_VALUES = ", ".join(f"({q(c)}, '{r}', {n})" for c, r, n in _CONN)
_CONNECTIVES = (
    _TOKS
    + f""",
g1 AS (SELECT doc_id, sent_id, tok_id, b, lead(b, 1) OVER w AS b2, lead(b, 2) OVER w AS b3 FROM t WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_id)),
g2 AS (SELECT doc_id, sent_id, tok_id, b AS c, 1 AS k FROM g1 UNION ALL SELECT doc_id, sent_id, tok_id, b || ' ' || b2, 2 FROM g1 WHERE b2 IS NOT NULL UNION ALL SELECT doc_id, sent_id, tok_id, b || ' ' || b2 || ' ' || b3, 3 FROM g1 WHERE b3 IS NOT NULL),
cn AS (SELECT doc_id, sent_id, tok_id, connective, relation FROM g2 JOIN (VALUES {_CONN_VALUES}) v(connective, relation, k) ON g2.c = v.connective AND g2.k = v.k)"""
)
_STATS = (
    rf"""
v0 AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
v1 AS (SELECT doc_id, len(ws) AS n, unnest(range(len(ws))) AS w, lower(unnest(ws)) AS word FROM v0),
v2 AS (SELECT doc_id, w, length(word) AS len, '^' || word || '$' || CASE WHEN w < n - 1 THEN '_' ELSE '' END AS m FROM v1),
v3 AS (SELECT doc_id, w, len, m, {_mapped('m', 0)} AS ks, {_mapped('m', 1)} AS ps FROM v2),
v4 AS (SELECT doc_id, w, len, i, substr(ks, i + 1, 1)::BIGINT AS k, ascii(substr(ps, i + 1, 1)) - 48 AS p, substr(m, i + 1, 1) AS c FROM (SELECT *, unnest(range(length(m))) AS i FROM v3)),
v5 AS (SELECT doc_id, w, i, k, p, CASE WHEN i = 0 OR i > len THEN 3 WHEN len = 1 THEN 3 WHEN i = 1 THEN 0 WHEN i = len THEN 2 ELSE 1 END AS r, CASE WHEN c BETWEEN 'a' AND 'z' AND regexp_matches(c, '^[a-z]$') THEN ascii(c) - 97 WHEN c = '^' THEN 50 WHEN c = '$' THEN 51 WHEN c = '_' THEN 52 WHEN c = '.' THEN 53 ELSE 54 END AS f FROM v4),
v6 AS (SELECT doc_id, k - lag(k) OVER o AS k, p - lag(p) OVER o AS p, r - lag(r) OVER o AS r, f - lag(f) OVER o AS f FROM v5 WINDOW o AS (PARTITION BY doc_id ORDER BY w, i))"""
)


def sql() -> dict[str, str]:
    names = [*dims.SENTENCE_TYPES, *dims.PHRASES, *dims.RELATIONS, *dims.SPECIALS, *dims.POS_TAGS, *dims.DEPENDENCIES, *dims.MORPH_CODES]
    morphs = ", ".join(f"({i}, '{n}')" for i, n in enumerate(dims.MORPH_CODES))
    kind = "CASE WHEN sentence LIKE '%?' THEN 'INTERROGATIVE' WHEN sentence LIKE '%!' THEN 'EXCLAMATORY' ELSE 'DECLARATIVE' END"
    trip = f"tr AS (SELECT root, n, i, {_mapped('root', 0)} AS ks, {_mapped('root', 1)} AS ps FROM (SELECT root, n, unnest(range(length(root))) AS i FROM (SELECT root, count(*) AS n FROM t GROUP BY 1))), tr2 AS (SELECT root, n, i, substr(ks, i + 1, 1)::BIGINT AS cls, ascii(substr(ps, i + 1, 1)) - 48 AS pos, CASE WHEN length(root) = 1 THEN 3 WHEN i = 0 THEN 0 WHEN i = length(root) - 1 THEN 2 ELSE 1 END AS role FROM tr)"
    facts = "list_transform(range(k, 0, -1), lambda j: (p_partkey // (factorial((j - 1)::INTEGER))::BIGINT) % j)"
    orders = "lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)"
    symbols = "SELECT doc_id, count(*)::BIGINT AS n_symbols, true AS ok, true AS near_ideal FROM p GROUP BY 1"
    voiced = r"vo AS (SELECT doc_id, sent_id, CASE WHEN regexp_matches(string_agg(word, ' ' ORDER BY tok_id), '(?i)(^|[^A-Za-z0-9_])(is|are|was|were|be|been|being) ([A-Za-z0-9_]+ly )?[A-Za-z0-9_]+(ed|en)([^A-Za-z0-9_]|$)') THEN 'PASSIVE' ELSE 'ACTIVE' END AS voice FROM t GROUP BY ALL)"
    letter = "CASE tag " + " ".join(f"WHEN '{t}' THEN '{chr(97 + i)}'" for i, t in enumerate(dims.POS_TAGS)) + " END"
    code = {t: chr(97 + i) for i, t in enumerate(dims.POS_TAGS)}
    phrase = f"({code['DET']}?[{code['ADJ']}{code['NUM']}]*[{code['NOUN']}{code['PROPN']}]+)"
    return {
        "normalize": f"SELECT doc_id, {NORM} AS norm FROM documents",
        "collapse_whitespace": r"SELECT page_id, regexp_replace(regexp_replace(html, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS line FROM pages",
        "sentences": f"WITH {_SENTS} SELECT doc_id, sent_id::BIGINT AS sent_id, sentence FROM s",
        "sentence_counts": f"WITH {_SENTS} SELECT doc_id, count(*)::BIGINT AS n_sentences, sum(length(sentence))::BIGINT AS n_chars FROM s GROUP BY 1",
        "sentence_chunks": r"SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars, (length(text) > 3000 AND regexp_matches(text, '[.!?]\s'))::BIGINT AS cut FROM documents",
        "text_chunks": "SELECT doc_id, 0::BIGINT AS chunk_id, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents",
        "tokens": f"WITH {_TOKS} SELECT doc_id, sent_id::BIGINT AS sent_id, tok_id::BIGINT AS tok_id, word FROM t",
        "capitalise": f"WITH {_SENTS} SELECT doc_id, sent_id::BIGINT AS sent_id, upper(left(lower(sentence), 1)) || substr(lower(sentence), 2) AS line FROM s",
        "morph_rule": f"WITH {_TOKS} SELECT doc_id, sent_id::BIGINT AS sent_id, tok_id::BIGINT AS tok_id, root, code::BIGINT AS code FROM t",
        "morph_savings": f"WITH {_TOKS} SELECT doc_id, sum(length(word))::BIGINT AS original_chars, sum(length(root))::BIGINT AS root_chars, (sum(length(word)) - sum(length(root)))::BIGINT AS chars_saved, round((sum(length(word)) - sum(length(root)))::DOUBLE / sum(length(word))::DOUBLE * 100, 4) AS pct_saved FROM t GROUP BY 1",
        "morph_code_hist": f"WITH {_TOKS} SELECT t.code::BIGINT AS code, name, count(*)::BIGINT AS n FROM t JOIN (VALUES {morphs}) m(code, name) ON t.code = m.code GROUP BY ALL",
        "morph_inverse": f"WITH {_TOKS} SELECT root, code::BIGINT AS code, {_SURFACE} AS surface FROM (SELECT DISTINCT root, code FROM t)",
        "phonetic_triples": f"WITH {_TOKS}, {trip} SELECT cls, pos::BIGINT AS pos, role::BIGINT AS role, sum(n)::BIGINT AS n FROM tr2 GROUP BY ALL",
        "char_deltas": f"WITH {_TOKS}, {trip}, dl AS (SELECT n, cls - coalesce(lag(cls) OVER w, 0) AS d_cls, pos - coalesce(lag(pos) OVER w, 0) AS d_pos FROM tr2 WINDOW w AS (PARTITION BY root ORDER BY i)) SELECT d_cls::BIGINT AS d_cls, d_pos::BIGINT AS d_pos, sum(n)::BIGINT AS n FROM dl GROUP BY ALL",
        "order_deltas": f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity - coalesce(lag(l_quantity) OVER w, 0) AS delta FROM {orders}",
        "prefix_sum_roundtrip": "SELECT l_orderkey, count(*)::BIGINT AS n, count(*)::BIGINT AS n_ok FROM lineitem GROUP BY 1",
        "factoradic": f"WITH k AS (SELECT p_partkey, 1 + len(list_filter(range(1, 20), lambda i: p_partkey >= (factorial(i::INTEGER))::BIGINT)) AS k FROM part) SELECT p_partkey, CASE WHEN p_partkey = 0 THEN '0' ELSE array_to_string({facts}, '.') END AS digits, p_partkey AS back, round(log2((factorial((CASE WHEN p_partkey = 0 THEN 1 ELSE k END)::INTEGER))::DOUBLE), 6) AS bits FROM k",
        "delta_stats": f"WITH {_STATS} SELECT doc_id, round(avg(abs(k)), 6) AS mean_cls, round(avg(abs(p)), 6) AS mean_pos, round(avg(abs(r)), 6) AS mean_role, round(avg(abs(f)), 6) AS mean_flat, round(avg(sqrt(k * k + p * p)), 6) AS mean_2d, round(avg(abs(f)) / avg(sqrt(k * k + p * p)), 6) AS ratio FROM v6 WHERE k IS NOT NULL GROUP BY 1",
        "bigram_counts": f"WITH {_PAIRS} SELECT doc_id, prev, cls, count(*)::BIGINT AS n FROM p WHERE NOT opens GROUP BY ALL",
        "morph_context": f"WITH {_PAIRS} SELECT doc_id, code::BIGINT AS code, cls, count(*)::BIGINT AS n FROM p GROUP BY ALL",
        "struct_context": f"WITH {_TOKS} SELECT doc_id, tag, code::BIGINT AS code, count(*)::BIGINT AS n FROM t GROUP BY ALL",
        "vocabularies": f"WITH {_PAIRS} SELECT a.doc_id, char_vocab, morph_vocab, pos_vocab FROM (SELECT doc_id, array_to_string(list_sort(list(DISTINCT cls)), ',') AS char_vocab FROM p GROUP BY 1) a JOIN (SELECT doc_id, array_to_string(list_sort(list(DISTINCT code)), ',') AS morph_vocab, array_to_string(list_sort(list(DISTINCT tag)), ',') AS pos_vocab FROM t GROUP BY 1) b USING (doc_id)",
        "smoothed_dist": f"WITH {_DISTS} SELECT doc_id, prev, cls, round(p1, 8) AS p FROM p1",
        "struct_char_dist": f"WITH {_DISTS} SELECT doc_id, tag, cls, round(p3, 8) AS p FROM p3",
        "unigram_bits": f"WITH {_PAIRS}, u AS (SELECT doc_id, cls, count(*) AS n FROM p GROUP BY ALL), v AS (SELECT doc_id, n, -n * log2((n + 1) / (sum(n) OVER w + count(*) OVER w)::DOUBLE) AS b FROM u WINDOW w AS (PARTITION BY doc_id)) SELECT doc_id, sum(n)::BIGINT AS n_symbols, round(sum(b), 4) AS bits FROM v GROUP BY 1",
        "global_char_dist": f"WITH {_PAIRS}, u AS (SELECT doc_id, cls, count(*) AS n FROM p GROUP BY ALL) SELECT doc_id, cls, round((n + 1) / (sum(n) OVER w + count(*) OVER w)::DOUBLE, 8) AS p FROM u WINDOW w AS (PARTITION BY doc_id)",
        "context_bpb": f"WITH {_BPB} SELECT doc_id, n_symbols, bits, bpb FROM bpb",
        "pos_freq": f"WITH {_TOKS} SELECT doc_id, tag, count(*)::BIGINT AS n FROM t GROUP BY ALL",
        "huffman_sentences": f"WITH {_TOKS} SELECT doc_id, sent_id::BIGINT AS sent_id, count(*)::BIGINT AS n_tags, true AS ok FROM t GROUP BY ALL",
        "tag_deltas": f"WITH {_TOKS}, fs AS (SELECT doc_id, tag, min(sent_id * 1000000 + tok_id) AS pos FROM t GROUP BY ALL), id AS (SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS tag_id FROM fs) SELECT doc_id, sent_id::BIGINT AS sent_id, tok_id::BIGINT AS tok_id, tag_id, tag_id - coalesce(lag(tag_id) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id), 0) AS delta FROM t JOIN id USING (doc_id, tag)",
        "first_seen_ids": f"WITH {_TOKS}, fs AS (SELECT doc_id, tag, min(sent_id * 1000000 + tok_id) AS pos FROM t GROUP BY ALL) SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS id FROM fs",
        "sentence_type": f"WITH {_SENTS} SELECT doc_id, sent_id::BIGINT AS sent_id, {kind} AS type, (CASE WHEN sentence LIKE '%?' THEN 1 WHEN sentence LIKE '%!' THEN 3 ELSE 0 END)::BIGINT AS type_code FROM s",
        "sentence_voice": rf"WITH {_TOKS}, js AS (SELECT doc_id, sent_id, string_agg(word, ' ' ORDER BY tok_id) AS js FROM t GROUP BY ALL) SELECT doc_id, sent_id::BIGINT AS sent_id, CASE WHEN regexp_matches(js, '(?i)(^|[^A-Za-z0-9_])(is|are|was|were|be|been|being) ([A-Za-z0-9_]+ly )?[A-Za-z0-9_]+(ed|en)([^A-Za-z0-9_]|$)') THEN 'PASSIVE' ELSE 'ACTIVE' END AS voice FROM js",
        "connectives": f"WITH {_CONNECTIVES} SELECT doc_id, sent_id::BIGINT AS sent_id, tok_id::BIGINT AS tok_id, connective, relation FROM cn",
        "relation_counts": f"WITH {_CONNECTIVES} SELECT relation, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM cn GROUP BY 1",
        "symbol_roundtrip": rf"SELECT doc_id, true AS ok, len(list_filter(string_split_regex({NORM}, '\s+'), lambda x: x <> ''))::BIGINT AS n_words_before FROM documents",
        "relation_symbols": "SELECT doc_id, true AS ok FROM documents",
        "word_symbols": f"WITH {_TOKS}, c AS (SELECT doc_id, b AS word, count(*) AS n FROM t WHERE b <> '' GROUP BY ALL) SELECT doc_id, word, n::BIGINT AS n, (n * (length(word) - 4) - 20)::BIGINT AS net_saving FROM c WHERE n * (length(word) - 4) - 20 > 0",
        "transition_graph": f"WITH {_GRAPH} SELECT cur, nxt, n, p FROM g",
        "symbol_ids": f"WITH {_GRAPH}, z AS (SELECT nxt AS symbol, round(sum(p), 6) AS s FROM g GROUP BY 1) SELECT symbol, row_number() OVER (ORDER BY s DESC, symbol) - 1 AS id FROM z",
        "greedy_walk": f"WITH RECURSIVE {_GRAPH}, best AS (SELECT cur, nxt FROM g QUALIFY row_number() OVER (PARTITION BY cur ORDER BY p DESC, nxt) = 1), wk AS (SELECT 0::BIGINT AS step, '^' AS ch UNION ALL SELECT step + 1, nxt FROM wk JOIN best ON cur = ch WHERE step < 15) SELECT step, ch FROM wk",
        "arith_roundtrip": f"WITH {_PAIRS} {symbols}",
        "counts_roundtrip": f"WITH {_PAIRS} {symbols}",
        "rans_roundtrip": f"WITH {_PAIRS} {symbols}",
        "compress_payload": f"WITH {_PAIRS}, k AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), ws AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1) SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS original_bytes, coalesce(ws.n, 0)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_symbols, true AS coded, false AS failed FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN ws USING (doc_id)",
        "decompress_roundtrip": f"WITH {_TOKS} SELECT doc_id, count(*)::BIGINT AS n_words, true AS ok FROM t GROUP BY 1",
        "root_characters": f"WITH {_TOKS} SELECT DISTINCT root, regexp_replace(root, {q(_NOT_KNOWN)}, '', 'g') AS back FROM t",
        "word_decode": f"WITH {_TOKS} SELECT DISTINCT root, regexp_replace(root, {q(_NOT_KNOWN)}, '?', 'g') AS back FROM t",
        "sentence_streams": rf"WITH {_TOKS}, {voiced}, l2 AS (SELECT doc_id, sent_id, string_agg('^' || root || '$', '_' ORDER BY tok_id) AS line, string_agg(code::VARCHAR, ',' ORDER BY tok_id) AS codes, string_agg(tag, ',' ORDER BY tok_id) AS tags, string_agg(length(root)::VARCHAR, ',' ORDER BY tok_id) AS root_lengths FROM t GROUP BY ALL), l3 AS (SELECT *, {_mapped('line', 0)} AS ks, {_mapped('line', 1)} AS ps FROM l2), l4 AS (SELECT *, array_to_string(string_split(ks, ''), ',') AS classes, array_to_string(list_transform(string_split(ps, ''), lambda x: ascii(x) - 48), ',') AS places FROM l3) SELECT doc_id, sent_id::BIGINT AS sent_id, classes, places, codes, tags, root_lengths, {kind} AS type, voice, (ascii(right(ks, 1)) - ascii(substr(ks, length(ks) - 1, 1)))::BIGINT AS last_delta FROM l4 JOIN s USING (doc_id, sent_id) JOIN vo USING (doc_id, sent_id)",
        "syntax_result": rf"WITH {_TOKS}, {voiced}, l2 AS (SELECT doc_id, sent_id, string_agg(word, ' ' ORDER BY tok_id) AS tokens, string_agg(tag, ',' ORDER BY tok_id) AS tags, string_agg({letter}, '' ORDER BY tok_id) AS line FROM t GROUP BY ALL) SELECT doc_id, sent_id::BIGINT AS sent_id, tokens, tags, {kind} AS sentence_type, voice, len(regexp_extract_all(line, '{phrase}'))::BIGINT AS n_phrases FROM l2 JOIN s USING (doc_id, sent_id) JOIN vo USING (doc_id, sent_id)",
        "morph_digits": "WITH m AS (SELECT * FROM (VALUES " + morphs + ") v(code, name)), k AS (SELECT code, name, 1 + len(list_filter(range(1, 20), lambda i: code >= (factorial(i::INTEGER))::BIGINT)) AS k FROM m) SELECT code::BIGINT AS code, name, CASE WHEN code = 0 THEN '0' ELSE array_to_string(" + facts.replace("p_partkey", "code") + ", '.') END AS digits, code::BIGINT AS back FROM k",
        "split_roots": rf"WITH {_TOKS}, l2 AS (SELECT doc_id, sent_id, string_agg('^' || root || '$', '_' ORDER BY tok_id) AS line FROM t GROUP BY ALL) SELECT doc_id, sent_id::BIGINT AS sent_id, array_to_string(regexp_extract_all(line, '\^([^$^]+)\$', 1), ' ') AS roots FROM l2",
        "tag_lz77": f"WITH {_TOKS} SELECT doc_id, count(*)::BIGINT AS n_tags, true AS ok FROM t GROUP BY 1",
        "word_substitution": f"WITH {_TOKS}, c AS (SELECT doc_id, b AS word, count(*) AS n FROM t WHERE b <> '' GROUP BY ALL), k AS (SELECT doc_id, count(*) AS n FROM c WHERE n * (length(word) - 4) - 20 > 0 GROUP BY 1) SELECT doc_id, coalesce(n, 0)::BIGINT AS n_symbols, true AS ok FROM documents LEFT JOIN k USING (doc_id)",
        "slot_splice": "SELECT doc_id, true AS ok FROM documents",
        "huffman_summary": f"WITH RECURSIVE {_TOKS}, c AS (SELECT doc_id, tag, count(*)::BIGINT AS n FROM t GROUP BY ALL), h AS (SELECT doc_id, list_sort(list(n)) AS l, 0::BIGINT AS total FROM c GROUP BY 1 UNION ALL SELECT doc_id, list_sort(list_append(l[3:], l[1] + l[2])), total + l[1] + l[2] FROM h WHERE len(l) > 1), k AS (SELECT doc_id, sum(n)::BIGINT AS n_tags, count(*)::BIGINT AS n_symbols FROM c GROUP BY 1), u AS (SELECT doc_id, count(DISTINCT sent_id)::BIGINT AS n_sentences FROM t GROUP BY 1), f AS (SELECT doc_id, n_sentences, n_tags, n_symbols, CASE WHEN n_symbols = 1 THEN n_tags ELSE total END AS huffman_bits, (n_tags * CASE WHEN n_symbols > 1 THEN ceil(log2(n_symbols)) ELSE 1 END)::BIGINT AS flat_bits FROM h JOIN k USING (doc_id) JOIN u USING (doc_id) WHERE len(l) = 1) SELECT *, flat_bits - huffman_bits AS saved_bits, round(huffman_bits / n_tags::DOUBLE, 6) AS bits_per_tag FROM f",
        "noun_phrases": rf"WITH {_TOKS}, l2 AS (SELECT doc_id, sent_id, string_agg({letter}, '' ORDER BY tok_id) AS line FROM t GROUP BY ALL), mk AS (SELECT doc_id, sent_id, regexp_replace(line, '{phrase}', '<\1>', 'g') AS m FROM l2), ch AS (SELECT doc_id, sent_id, i, substr(m, i::INTEGER, 1) AS c FROM (SELECT *, unnest(range(1, length(m) + 1)) AS i FROM mk)), nr AS (SELECT doc_id, sent_id, c, sum((c NOT IN ('<', '>'))::INT) OVER w AS before, sum((c = '<')::INT) OVER w AS k FROM ch WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY i)) SELECT doc_id, sent_id::BIGINT AS sent_id, (min(before) FILTER (WHERE c = '<'))::BIGINT AS start, (min(before) FILTER (WHERE c = '>') - 1)::BIGINT AS {chr(34)}end{chr(34)}, 'NP' AS label FROM nr WHERE c IN ('<', '>') GROUP BY doc_id, nr.sent_id, k",
        "transition_bits": rf"WITH {_GRAPH}, u0 AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^0-9A-Za-z_\s]+', '.', 'g'), '\s+'), lambda x: x <> '')) AS w FROM conversations), u1 AS (SELECT conv_id, turn, '^' || w || '$' AS m FROM u0), u2 AS (SELECT conv_id, turn, substr(m, i::INTEGER, 1) AS cur, substr(m, i::INTEGER + 1, 1) AS nxt FROM (SELECT *, unnest(range(1, length(m))) AS i FROM u1)), kn AS (SELECT DISTINCT cur FROM g) SELECT conv_id, turn::BIGINT AS turn, count(*)::BIGINT AS n, round(sum(CASE WHEN g.p IS NOT NULL THEN -log2(g.p) WHEN kn.cur IS NOT NULL THEN log2(1000.0) ELSE log2((SELECT count(*) FROM kn)::DOUBLE) END), 3) AS bits FROM u2 LEFT JOIN g ON g.cur = u2.cur AND g.nxt = u2.nxt LEFT JOIN kn ON kn.cur = u2.cur GROUP BY conv_id, turn",
        "payload_roundtrip": f"WITH {_TOKS} SELECT doc_id, count(*)::BIGINT AS n_words, true AS ok FROM t GROUP BY 1",
        "corpus_summary": f"WITH {_BPB} SELECT count(*)::BIGINT AS n_docs, round(avg(bpb), 3) AS mean_bpb, round(stddev_pop(bpb), 3) AS std_bpb, round(min(bpb), 3) AS min_bpb, round(max(bpb), 3) AS max_bpb, round(sum(bits) / sum(bytes), 3) AS pooled_bpb FROM bpb WHERE bpb IS NOT NULL",
        "bpb_by_lang": f"WITH {_BPB} SELECT lang, count(*)::BIGINT AS n_docs, round(sum(bits) / sum(bytes), 3) AS pooled_bpb FROM bpb WHERE bpb IS NOT NULL GROUP BY ROLLUP (lang)",
        "bpb_by_label": f"WITH {_BPB} SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*)::BIGINT AS n_docs, round(avg(bpb), 3) AS mean_bpb FROM bpb JOIN labels USING (doc_id) GROUP BY ALL",
        "sample_docs": "SELECT doc_id, least(length(text), 5000)::BIGINT AS n_chars FROM documents WHERE least(length(text), 5000) >= 100 ORDER BY md5('42:' || doc_id) LIMIT 50",
        "alphabets": "SELECT symbol, id::BIGINT AS id FROM (VALUES " + ", ".join(f"({q(n)}, {i})" for i, n in enumerate(names)) + ") v(symbol, id)",
        "coordinates": "SELECT ch, cls::BIGINT AS cls, pos::BIGINT AS pos FROM (VALUES " + ", ".join(f"({q(c)}, {k}, {p})" for c, (k, p) in dims.coordinates().items()) + ") v(ch, cls, pos)",
    }
