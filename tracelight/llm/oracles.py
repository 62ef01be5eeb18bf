"""SQL for the corpus queries that SQL can express, by brute force and apart from their methods.

op1, op5, op7 learn models and op9 needs a tokenizer: those have tests instead. The SQL of op2
leaves account numbers (mod-97) out, so it agrees on tables without them."""

from __future__ import annotations

_BLANKS = r"[ \t\n\x0B\f\r]+"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '')"
_LAST = "9223372036854775807"

# A window that also starts earlier is cut out: windows that touch or overlap are one span.
OP3 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT rid, i, coalesce(doc_id, {_LAST})::HUGEINT * 1099511627776 + i AS place, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT *, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
f AS (SELECT s, min(place) AS place FROM w GROUP BY s),
m AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM w JOIN f ON w.s = f.s AND w.place > f.place),
g AS (SELECT rid, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS span FROM m),
sp AS (SELECT rid, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY rid, span),
k AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS pb FROM sp),
r AS (SELECT k.rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a) AS kept FROM k JOIN d ON k.rid = d.rid GROUP BY k.rid)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN r ON d.rid = r.rid"""

OP4 = rf"""WITH RECURSIVE c AS MATERIALIZED (SELECT min(doc_id) AS text_id, count(*) AS copies, t, {_WORDS.replace("coalesce(text, '')", "t")} AS w FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL) GROUP BY t),
n AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM c),
s AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM n),
z AS (SELECT id, count(*) AS size FROM s GROUP BY id),
b AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM s x JOIN s y ON x.sh = y.sh AND x.id <> y.id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT b.a, b.b FROM b JOIN z p ON p.id = b.a JOIN z q ON q.id = b.b WHERE b.n >= 0.8 * (p.size + q.size - b.n) - 0.000001),
r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT r.a, min(n.text_id) AS class_id FROM r JOIN n ON r.b = n.id GROUP BY r.a),
l AS (SELECT e.a, count(*) AS texts, sum(n.copies) AS documents FROM e JOIN n ON e.b = n.id GROUP BY e.a)
SELECT d.doc_id, class_id, text_id, CAST(coalesce(copies - 1 + coalesce(documents, 0), 0) AS BIGINT) AS n_links, coalesce(texts, 0) AS n_text_links FROM documents d LEFT JOIN n ON d.doc_id IS NOT NULL AND coalesce(d.text, '') = n.t LEFT JOIN k ON n.id = k.a LEFT JOIN l ON n.id = l.a"""

OP6 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(doc_id, {_LAST}) AS own, doc_id, {_WORDS} AS w FROM documents),
v AS MATERIALIZED (SELECT rid, own, i, md5(array_to_string(w[i:i + 12], ' ')) AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(own) AS own FROM v GROUP BY s),
m AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM v JOIN f ON v.s = f.s AND v.own > f.own),
g AS (SELECT rid, i, sum(CASE WHEN p IS NULL OR i > p + 13 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS span FROM m),
sp AS (SELECT rid, min(i) AS a, max(i) + 13 AS b FROM g GROUP BY rid, span),
k AS (SELECT *, lag(b, 1, 1) OVER (PARTITION BY rid ORDER BY a) AS pb FROM sp),
r AS (SELECT k.rid, sum(b - a) AS n_removed, max(b) AS last, flatten(list(w[pb:a - 1] ORDER BY a)) AS kept FROM k JOIN d ON k.rid = d.rid GROUP BY k.rid)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_concat(coalesce(kept, []), w[coalesce(last, 1):]), ' ')) AS kept_sha256 FROM d LEFT JOIN r ON d.rid = r.rid"""

OP8 = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.uid <> c.uid AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20"""

OP13 = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.uid, a.vec_id AS anchor_id, c.uid AS other, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.uid <> c.uid AND len(a.v) = len(c.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.uid, p.place, p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.uid, p.place ORDER BY n.score DESC, n.vec_id) AS rank
FROM p JOIN s n ON p.uid = n.uid AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

_TOKENS = rf"list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '.,;:!?\"''()[]{{}}<>*#%&$_-/\|`~=+@^', ''), '{_BLANKS}'), lambda x: x <> '')"

# Tokens that agree, by document, item and shift. A best window begins at one of them, or as late
# as both texts allow.
OP10 = rf"""WITH d AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE doc_id IS NOT NULL), b AS MATERIALIZED (SELECT item_id, {_TOKENS} AS w FROM benchmark WHERE item_id IS NOT NULL),
x AS (SELECT DISTINCT doc_id, len(w) AS n, unnest(w) AS tok, unnest(range(0, len(w))) AS p FROM d), y AS (SELECT DISTINCT item_id, len(w) AS m, unnest(w) AS tok, unnest(range(0, len(w))) AS p FROM b WHERE len(w) >= 5),
a AS (SELECT doc_id, item_id, x.p - y.p AS shift, n, m, least(13, m) AS width, list(DISTINCT y.p) AS hit FROM x JOIN y ON x.tok = y.tok GROUP BY doc_id, item_id, x.p - y.p, n, m HAVING count(DISTINCT y.p) >= 4),
s AS (SELECT *, least(m, n - shift) - width AS latest, CASE WHEN width > 5 THEN ceil(width * 0.8 - 0.000000001) ELSE width END AS need FROM a),
c AS (SELECT *, list_max(list_transform(hit, lambda p: len(list_filter(hit, lambda q: q >= least(p, latest) AND q < least(p, latest) + width)))) AS agreeing FROM s WHERE latest >= greatest(0, -shift)),
o AS (SELECT doc_id, item_id, max(agreeing) AS agreeing FROM c WHERE agreeing >= need GROUP BY doc_id, item_id)
SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, CAST(max(agreeing) AS BIGINT) AS agreeing FROM o GROUP BY doc_id"""


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '', 'g')"


def _luhn(m: str) -> str:
    digits = f"string_split(reverse({_digits(m)}), '')"
    return f"list_sum(list_transform({digits}, lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN c >= '5' THEN 9 ELSE 0 END END)) % 10 = 0"


_BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS DOUBLE) > 255)) = 0"),
    "card": (r"[0-9](?:[ -]?[0-9])+", f"length({_digits('m')}) BETWEEN 13 AND 19 AND {_luhn('m')}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({_digits('m')}) BETWEEN 9 AND 15"),
}
# Runs of the letters that may not stand beside a span, with the span's place in the run.
_MORE = {
    "ssn": (r"[0-9-]+", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "NOT regexp_matches(m, '^(000|666|9[0-9]{2})|-00-|-0000$') AND regexp_matches(around, 'ssn|social security') AND NOT regexp_matches(around, 'part|model|serial')"),
    "tel": (r"[0-9A-Za-z+.()-]+(?: [0-9.-]+)?", r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}", "regexp_matches(around, 'phone|call|tel|mobile|fax') OR NOT regexp_matches(around, 'part|model|serial|isbn')"),
}


def _places(kind: str, order: int, pattern: str, valid: str) -> str:
    """(rid, kind, order, start, match) of the leftmost matches of a pattern that do not overlap."""
    cut = f"SELECT rid, t, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM d"
    each = f"SELECT rid, t, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS a FROM ({cut}) WHERE len(ms) > 0"
    return f"SELECT rid, '{kind}' AS kind, {order} AS o, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b, m, lower(substr(t, greatest(CAST(a AS BIGINT) - 40, 0) + 1, least(CAST(a AS BIGINT), 40)) || ' ' || substr(t, CAST(a AS BIGINT) + length(m) + 1, 40)) AS around FROM ({each}) WHERE {valid}"


def _op2() -> str:
    base = " UNION ALL ".join(_places(kind, n, pattern, valid) for n, (kind, (pattern, valid)) in enumerate(_BASE.items()))
    ssn = f"SELECT * FROM ({_places('ssn', 5, _MORE['ssn'][0], 'regexp_matches(m, ' + chr(39) + _MORE['ssn'][1] + chr(39) + ')')}) WHERE {_MORE['ssn'][2]}"
    # two spans never overlap, and what stands before and behind one is looked at in the text
    tel = f"SELECT s.* FROM ({_places('tel', 6, _MORE['tel'][1], 'true')}) s JOIN d ON s.rid = d.rid WHERE (a = 0 OR NOT regexp_matches(substr(t, a, 1), '[0-9A-Za-z+-]')) AND NOT regexp_matches(substr(t, b + 1, 1), '[0-9-]') AND ({_MORE['tel'][2]})"
    joined = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a)"
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), base AS MATERIALIZED ({base}),
more AS ({ssn} UNION ALL {tel}), apart AS (SELECT * FROM more x WHERE NOT EXISTS (SELECT 1 FROM base y WHERE y.rid = x.rid AND y.a < x.b AND x.a < y.b)),
n AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE)}, {joined} AS spans FROM base GROUP BY rid), every AS (SELECT rid, {joined} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM apart) GROUP BY rid)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE)}, sha256(coalesce(n.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN every ON d.rid = every.rid"""


# crc32 of the decimal id, bit by bit
_CRC = "xor(list_reduce(list_concat([4294967295], range(0, 8 * length(c))), lambda r, i: CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(r, ascii(c[i // 8 + 1])) ELSE r END) % 2 = 1 THEN xor((CASE WHEN i % 8 = 0 THEN xor(r, ascii(c[i // 8 + 1])) ELSE r END) // 2, 3988292384) ELSE (CASE WHEN i % 8 = 0 THEN xor(r, ascii(c[i // 8 + 1])) ELSE r END) // 2 END), 4294967295)"

# A node is named by the turns that lead to it; what lies in its subtree is found from each node
# below by the nodes on its way.
OP12 = rf"""WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o,
md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^ 	
]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c FROM t)),
r AS (SELECT c.conv_id, 0 AS own, o, m, words FROM c JOIN t ON t.conv_id = c.base AND t.o <= c.h UNION ALL SELECT c.conv_id, 1, o, m, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.o > c.h),
f AS MATERIALIZED (SELECT conv_id, list(m ORDER BY own, o) AS ms, list(words ORDER BY own, o) AS ws FROM r GROUP BY conv_id),
q AS MATERIALIZED (SELECT conv_id, d, md5(array_to_string(ms[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(ms[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(ms) AS ends
FROM (SELECT *, unnest(range(0, len(ms) + 1)) AS d FROM (SELECT c.conv_id, coalesce(ms, []) AS ms, coalesce(ws, []) AS ws FROM c LEFT JOIN f USING (conv_id)))),
n AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM q GROUP BY k, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up, d),
w AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.k = kids.up AND n.d = kids.d),
a AS (SELECT x.k, x.d, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved FROM w JOIN q x ON x.conv_id = w.conv_id AND x.d <= w.d GROUP BY x.k, x.d)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN a ON w.k = a.k AND w.d = a.d LEFT JOIN n p ON p.k = w.up AND p.d = w.d - 1"""


ORACLES = {"op12_conversation_trie": OP12, "op13_hard_negatives": OP13, "op2_pii": _op2(), "op3_suffix": OP3, "op4_jaccard": OP4, "op6_substring": OP6, "op8_topk": OP8, "op10_decontaminate": OP10}
