"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .quality_rules import CELLS, COMMON, GUARD, MAX_CHAR_DISTANCE, MAX_REPEAT, MAX_WORD_DISTANCE, MIN_WORDS, OTHER

_UPPER = "".join(map(chr, range(65, 91)))
_WORDS = "list_filter(regexp_split_to_array({t}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _lowered(t: str) -> str:
    return _WORDS.format(t=f"translate(coalesce({t}, ''), '{_UPPER}', '{_UPPER.lower()}')")


NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_lowered("text")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
"""

DECONTAMINATION = f"""
WITH i AS (SELECT item_id, {_lowered("text")} AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[p:p+least(len(w), 5)-1], ' ') AS g FROM i, unnest(range(1, len(w) - least(len(w), 5) + 2)) r(p) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM x GROUP BY 1),
d AS (SELECT doc_id, {_lowered("text")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p+k-1], ' ') AS g FROM d, (SELECT DISTINCT k FROM x) ks, unnest(range(1, len(w) - k + 2)) r(p)),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM s JOIN x USING (k, g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.75 * n_item
"""


def _listed(words: list[str]) -> str:
    each = ", ".join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in words)
    return f"[{each}, len(list_filter(w, lambda x: x NOT IN ({', '.join(repr(c) for c in words)})))]"


_COUNTS = "CASE language " + " ".join(f"WHEN '{k}' THEN {_listed(v)}" for k, v in COMMON.items()) + f" ELSE {_listed(OTHER)} END"
_N = "length(regexp_replace(t, '[^{c}]', '', 'g'))"
_JS = "sqrt(greatest(0, list_sum([(CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] * log2({q}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END) / 2 for i in range(1, {k})])))"

QUALITY_RULES = f"""
WITH b AS (SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS language, coalesce(text, '') AS t, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p+1], w[p+2]) AS c FROM b, unnest(range(1, len(w) - 1)) r(p)),
c AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM g, range(3) t(o) WHERE c > 1 GROUP BY 1),
f AS (SELECT b.doc_id, language, len(w)::BIGINT AS n_words, length(t) AS n_chars, w,
  {_N.format(c="\\x20\\x09-\\x0D")} AS space, {_N.format(c="A-Z")} AS upper, {_N.format(c="0-9")} AS digit, {_N.format(c="#*$%&|<>")} AS symbols, {_N.format(c=".,;:!?''\"()\\-")} AS punctuation,
  length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) AS beyond,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN c USING (doc_id)),
h AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, {_COUNTS} AS common,
  [space, upper, digit, symbols, punctuation, beyond, n_chars - space - upper - digit - symbols - punctuation - beyond] AS classes FROM f),
v AS (SELECT *, list_transform(classes, lambda x: x / greatest(list_sum(classes), 1)) AS cs, list_transform(common, lambda x: x / greatest(n_words, 1)) AS ws FROM h),
u AS (SELECT language, i, floor((cs || ws)[i] * {CELLS} + 0.5) AS step, count(*) AS n FROM v, range(1, 19) r(i) WHERE NOT base_failed GROUP BY ALL),
o AS (SELECT *, sum(n) OVER (PARTITION BY language, i ORDER BY step) AS seen, sum(n) OVER (PARTITION BY language, i) AS total FROM u),
m AS (SELECT language, i, min(step) / {CELLS} AS m FROM o WHERE 2 * seen >= total GROUP BY ALL),
a AS (SELECT language, list(m ORDER BY i) AS m FROM m GROUP BY 1),
q AS (SELECT language, list_transform(m[1:7], lambda x: x / greatest(list_sum(m[1:7]), 1e-9)) AS cr, list_transform(m[8:18], lambda x: x / greatest(list_sum(m[8:18]), 1e-9)) AS wr FROM a),
z AS (SELECT v.*, {_JS.format(p="cs", q="cr", k=8)} AS char_distance, {_JS.format(p="ws", q="wr", k=12)} AS word_distance FROM v LEFT JOIN q USING (language))
SELECT doc_id, n_words, (n_chars - space)::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance <= {MAX_CHAR_DISTANCE} + {GUARD} / sqrt(greatest(n_words, 1)) AND word_distance <= {MAX_WORD_DISTANCE} + {GUARD} / sqrt(greatest(n_words, 1)), true) AS kept
FROM z
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS e, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(e[i+1:i+200]) AS s FROM d, unnest(range(0, n - 199)) r(i)),
c AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
x AS (SELECT doc_id, i FROM w SEMI JOIN c USING (s)),
m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM x),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
k AS (SELECT doc_id, string_agg(h[2*z+1:2*a], '' ORDER BY a) AS head, max(b) AS last, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || h[2*coalesce(last, 0)+1:])) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL = {"op4_suffix_dedup": SUFFIX_DEDUP, "op1_quality_rules": QUALITY_RULES, "op5_ngram_join": NGRAM_JOIN, "op8_decontamination": DECONTAMINATION}
