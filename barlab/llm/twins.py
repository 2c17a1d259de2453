"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from barlab.llm import license_scan as lic
from barlab.llm import quality_rules as rules


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\^[]{}|$*&-" else c for c in chars) + "]"


QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS again FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
tr AS (SELECT doc_id, line, regexp_replace(line, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') AS t FROM ln),
so AS (SELECT *, regexp_replace(t, '[ \t\x0B\f\r]', '', 'g') AS s FROM tr),
fi AS (SELECT doc_id, line, t, length(t) AS al, length(s) AS n,
  length(s) - length(regexp_replace(s, '{_quoted(_class(rules.MARKS))}', '', 'g')) AS marks,
  length(s) - length(regexp_replace(s, '{_quoted(_class(rules.BARS))}', '', 'g')) AS bars,
  length(t) - length(replace(t, '!!', '!')) AS calls FROM so),
ve AS (SELECT *, n > 0 AND ((marks * 10 > n AND marks >= 3) OR (calls >= 3 AND calls * 4 >= al - n + 1)
  OR (bars >= 2 AND bars * 5 >= al - n + 1) OR (al - n + 1 <= 3 AND n <= {rules.MENU_CHARS} AND NOT regexp_matches(t, '{_quoted(rules.SENTENCE_END)}'))
  OR (al - n + 1 <= {rules.BOILERPLATE_WORDS} AND regexp_matches(t, '{_quoted(rules.BOILERPLATE)}'))) AS bad FROM fi),
pl AS (SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
  count(*) FILTER (WHERE bad) AS n_lines_removed, coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS left_chars FROM ve GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '{_quoted(_class(rules.SYMBOLS))}', '', 'g')) AS BIGINT) AS n_symbols,
  n_dup_lines, CAST(coalesce(again, 0) AS BIGINT) AS n_repeat_words, n_lines_removed,
  CASE WHEN len(ws) > 0 THEN 1 - CAST(left_chars AS DOUBLE) / length(array_to_string(ws, '')) ELSE 0.0 END AS lost
  FROM w JOIN pl USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND lost <= {rules.MAX_LOST} AS kept FROM b"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _terms(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


RANKED = rf"""WITH t AS (SELECT r, doc_id, unnest(ws) AS term FROM (
  SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS ws FROM documents)),
p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY r, term),
dl AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY r),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM dl),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, nn),
i AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
  CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN dl USING (r), c GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank,
  doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""


def _gram_values() -> str:
    rows = lic.template_grams(lic.BASE + lic.NOTICES)
    return ", ".join("(" + ", ".join(f"'{_quoted(v)}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


LICENSES = rf"""WITH g AS (SELECT * FROM (VALUES {_gram_values()}) AS v(tp, label, base, len, p, w0, w1, w2)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS ws FROM documents),
e AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d),
m AS (SELECT r, tp, label, base, len, i - 1 - p AS dg, p FROM e JOIN g ON ws[i] = w0 AND ws[i + 1] = w1 AND ws[i + 2] = w2),
dg AS (SELECT r, tp, label, base, len, dg, list_sort(list(DISTINCT p)) AS ps, dg + min(p) AS a, dg + max(p) + {lic.K} AS z
  FROM m GROUP BY r, tp, label, base, len, dg),
b AS (SELECT r, label, a, 1.0 AS score FROM dg WHERE base AND len(ps) = len - {lic.K - 1}),
n1 AS (SELECT *, coalesce(a - max(z) OVER (PARTITION BY r, tp ORDER BY a, dg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {lic.MAX_GAP}
  OR abs(dg - lag(dg) OVER (PARTITION BY r, tp ORDER BY a, dg)) > {lic.MAX_SHIFT}, true) AS fresh FROM dg WHERE NOT base),
n2 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY r, tp ORDER BY a, dg ROWS UNBOUNDED PRECEDING) AS ch FROM n1),
n3 AS (SELECT *, max(z) OVER (PARTITION BY r, tp, ch) - min(a) OVER (PARTITION BY r, tp, ch) <= len + {lic.MAX_SHIFT} AS fits FROM n2),
n4 AS (SELECT r, tp, label, len, a, z, unnest(ps) AS p, ch, CASE WHEN fits THEN NULL ELSE dg END AS pt FROM n3),
n5 AS (SELECT r, tp, label, len, min(a) AS a, max(z) AS z, len(list_distinct(flatten(list([p, p + 1, p + 2])))) AS cov
  FROM n4 GROUP BY r, tp, label, len, ch, pt),
n6 AS (SELECT *, coalesce(a >= max(z) OVER (PARTITION BY r ORDER BY a, z, tp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh
  FROM n5 WHERE cov * 10 >= len * 9),
n7 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY r ORDER BY a, z, tp ROWS UNBOUNDED PRECEDING) AS grp FROM n6),
n8 AS (SELECT r, label, cov / len AS score FROM n7 QUALIFY rank() OVER (PARTITION BY r, grp ORDER BY cov DESC, len) = 1),
bs AS (SELECT r, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM (SELECT r, label, score FROM b UNION ALL SELECT r, label, score FROM n8) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN al USING (r)"""
