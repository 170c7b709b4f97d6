"""SQL for DuckDB with the results of the catalogue's queries."""

from __future__ import annotations

import re
import unicodedata

from textloom.operators.candidates import SORTS
from textloom.operators.plugins import decoding_parameters
from textloom.operators.vocabulary import STOPWORDS
from textloom.plans.catalogue import INSTRUCTION, JUDGE, LABELS, PAIR, TOP, TRAINED, TRUNCATED


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Inputs.
LONG = """SELECT (doc_id - doc_id % 4) // 4 AS example_id, CAST(doc_id % 4 + 1 AS INT) AS candidate_id, source AS instruction, text AS response, doc_id,
  ((doc_id * 7919) % 1000) / 1E3 AS similarity_score, ((doc_id * 104729) % 997) / 997E0 AS educational_score, ((doc_id * 15485863) % 991) / 991E0 AS bleu_score, ((doc_id * 31) % 5) / 4E0 AS overlap_keys FROM documents"""
CANDIDATES = f"candidates AS (SELECT *, (overlap_keys + educational_score + similarity_score) / 3 AS cumulative_score FROM ({LONG}))"
RANKED = f"{CANDIDATES}, ranked AS (SELECT *, row_number() OVER (ORDER BY cumulative_score DESC, example_id, candidate_id) AS r FROM candidates)"


def coded(code: str) -> str:
    return f"coded AS (SELECT l_orderkey AS order_id, string_agg({code}, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, {code}) AS codes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"


TYPES = coded("p_type") + ", labelled AS (SELECT order_id, list_transform(string_split(codes, ' '), lambda x: lower(x[1:3])) AS labels FROM coded)"
LABEL_ROWS = ", ".join(f"({i}, {quoted(x)})" for i, x in enumerate(LABELS))
LOGITS = f"""{TYPES}, logits AS (SELECT CASE WHEN order_id % 3 = 0 THEN 'second' ELSE 'first' END AS dataset, order_id AS sample, label, CAST(list_contains(labels, label) AS INT) AS y,
  ((order_id * 31 + i * 17) % 201 - 100) / 25E0 + i / 1E3 AS logit FROM labelled, (VALUES {LABEL_ROWS}) t(i, label)),
  predicted AS (SELECT *, 1 / (1 + exp(-logit)) AS prob, CAST(1 / (1 + exp(-logit)) > 0.5 AS INT) AS p FROM logits)"""
DICTIONARY = "dictionary AS (SELECT p_brand AS code, p_name AS term, min(p_partkey) AS place FROM part GROUP BY ALL)"
def _spelled() -> tuple[str, str, str]:
    """From the character database: what has one ASCII character, which that is, and a nest of replacements for what has more."""
    one, to, nest = "", "", "{}"
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]):
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one, to = one + c, to + plain
        elif plain:
            nest = f"replace({nest}, '{c}', '{plain}')"
    return one, to, nest


ONE, TO, NEST = _spelled()


def normal(column: str) -> str:
    spaced = f"translate({column}, '–—−-', '    ')"
    longer = "".join(re.findall(r"'([^\x00-\x7F])'", NEST))
    spelled = f"CASE WHEN regexp_matches({spaced}, '[{longer}]') THEN {NEST.replace('{}', spaced)} ELSE {spaced} END"
    folded = f"CASE WHEN regexp_matches({spaced}, '[^\\x00-\\x7FÀ-ÿ]') THEN translate({spelled}, '{ONE}', {quoted(TO)}) ELSE strip_accents({spaced}) END"  # the letters of Latin-1 have one letter each
    plain = f"regexp_replace({folded}, '[^\\x20-\\x2F\\x3A-\\x7E]', '', 'g')"
    return f"trim(regexp_replace(lower(regexp_replace({plain}, '[!-/:-@\\[-`{{-~]', ' ', 'g')), ' +', ' ', 'g'))"


def words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '\\p{{L}}+')"


def firsts(source: str, key: str, words: str) -> str:
    """Tables w (key and list) and f (key and ``firsts``, the distinct items in the order of their first occurrence)."""
    return f"""w AS (SELECT {key}, {words} AS w FROM {source}), each AS (SELECT {key}, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
 once AS (SELECT {key}, x, min(i) AS i FROM each GROUP BY {key}, x), f AS (SELECT {key}, list(x ORDER BY i) AS firsts FROM once GROUP BY {key})"""


def confusion(*keys: str) -> str:
    return f"SELECT {', '.join(keys)}, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn FROM predicted GROUP BY {', '.join(keys)}"


THREE = {
    "f1": "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END",
    "precision": "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END",
    "recall": "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END",
}
HAMMING = "SELECT dataset, round(avg(CAST(y <> p AS INT)), 6) AS hamming_loss FROM predicted GROUP BY dataset"
JACCARD = f"SELECT dataset, round(avg(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE tp / (tp + fp + fn)::DOUBLE END), 6) AS jaccard FROM ({confusion('dataset', 'sample')}) GROUP BY dataset"
MACRO = f"SELECT dataset, {', '.join(f'round(avg({e}), 6) AS macro_{k}' for k, e in THREE.items())} FROM ({confusion('dataset', 'label')}) GROUP BY dataset"
MICRO = f"SELECT dataset, {', '.join(f'round({e}, 6) AS micro_{k}' for k, e in THREE.items())} FROM ({confusion('dataset')})"
AT_K = """SELECT dataset, round(avg(2 * tp3 / (3 + pos)::DOUBLE), 6) AS f1_at_3, round(avg(2 * tp5 / (5 + pos)::DOUBLE), 6) AS f1_at_5 FROM
  (SELECT dataset, sample, sum(y) AS pos, sum(CASE WHEN r <= 3 THEN y ELSE 0 END) AS tp3, sum(CASE WHEN r <= 5 THEN y ELSE 0 END) AS tp5 FROM
   (SELECT *, row_number() OVER (PARTITION BY dataset, sample ORDER BY prob DESC, label) AS r FROM predicted) GROUP BY ALL) GROUP BY dataset"""

COUNTS = f"counts AS (SELECT word, count(*) AS n FROM (SELECT unnest({words('text')}) AS word FROM documents) GROUP BY word)"
BAND = "band AS (SELECT quantile_cont(n, 0.85) AS low, quantile_cont(n, 0.995) AS high FROM counts)"
STOPS = ", ".join(map(quoted, STOPWORDS))

PAIRS = f"""{RANKED}, ends AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY r) AS up, row_number() OVER (PARTITION BY example_id ORDER BY r DESC) AS down FROM ranked),
  pairs AS (SELECT CAST(row_number() OVER (ORDER BY b.r) AS INT) AS rank, b.instruction, b.response AS chosen, w.response AS rejected,
  b.similarity_score AS c1, b.educational_score AS c2, b.bleu_score AS c3, b.cumulative_score AS c4, w.similarity_score AS w1, w.educational_score AS w2, w.bleu_score AS w3, w.cumulative_score AS w4
  FROM ends b JOIN ends w USING (example_id) WHERE b.up = 1 AND w.down = 1 AND b.r <= {TOP})"""

TOKENS = "regexp_extract_all(lower(t.{0}), '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]')"
BLEU = f"""WITH texts AS (SELECT 'n' || d.doc_id AS pair, d.text, e.text AS other FROM documents d JOIN documents e ON e.doc_id - 1 = d.doc_id
  UNION ALL SELECT 's' || doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w, i: (i - 1) % 7 <> 6), ' '), text FROM documents),
 tokens AS (SELECT pair, {TOKENS.format("text")} AS h, {TOKENS.format("other")} AS r FROM texts t),
 orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
 hg AS (SELECT pair, n, gram, count(*) AS c FROM (SELECT pair, n, unnest(list_transform(generate_series(1, len(h) - n + 1), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS gram FROM tokens, orders) GROUP BY ALL),
 rg AS (SELECT pair, n, gram, count(*) AS c FROM (SELECT pair, n, unnest(list_transform(generate_series(1, len(r) - n + 1), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS gram FROM tokens, orders) GROUP BY ALL),
 m AS (SELECT pair, n, sum(least(hg.c, rg.c)) AS m FROM hg JOIN rg USING (pair, n, gram) GROUP BY ALL),
 p AS (SELECT pair, n, coalesce(m, 0) AS m, greatest(1, len(h) - n + 1) AS d, len(h) AS lh, len(r) AS lr FROM tokens CROSS JOIN orders LEFT JOIN m USING (pair, n)),
 s AS (SELECT pair, any_value(lh) AS lh, any_value(lr) AS lr, sum(CASE WHEN n = 1 THEN m END) AS m1, sum(0.25 * ln(CASE WHEN m = 0 THEN 0.1 ELSE m END / d)) AS l FROM p GROUP BY pair)
SELECT pair, round(CASE WHEN lh = 0 OR m1 = 0 THEN 0 ELSE (CASE WHEN lh > lr THEN 1 ELSE exp(1 - lr / lh::DOUBLE) END) * exp(l) END, 6) AS bleu FROM s"""

# The n-th gram of a kind, as a row.
def grams(source: str) -> str:
    return f"""SELECT t, gram, row_number() OVER (PARTITION BY t, gram ORDER BY i) AS nth, count(*) OVER (PARTITION BY t) AS n FROM
  (SELECT t, unnest(generate_series(1, greatest(length(t), 3) - 2)) AS i, substr(rpad(t, greatest(length(t), 3)::INT, chr(1)), i, 3) AS gram FROM {source})"""


def pairs(asked: str, terms: str) -> str:
    """Tables a and b, the grams of two tables of t, and alike: (text, term, n_term, similarity) of at least 0.8 by their shared rarest grams."""
    return f"""a AS ({grams(asked)}), b AS ({grams(f"(SELECT t FROM {terms} WHERE length(t) >= 3)")}),
 counts_of AS (SELECT gram, nth, count(*) AS df FROM b GROUP BY ALL),
 lb AS (SELECT t, gram, nth, n FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY df, gram, nth) AS r FROM b JOIN counts_of USING (gram, nth)) WHERE r <= n - ceil(0.8 * n - 1E-9) + 1),
 met AS (SELECT DISTINCT a.t AS text, lb.t AS term FROM a JOIN lb USING (gram, nth) WHERE lb.n >= 0.8 * a.n - 1E-9 AND lb.n <= a.n / 0.8 + 1E-9),
 alike AS (SELECT text, term, any_value(b.n) AS n_term, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS similarity FROM met JOIN a ON a.t = text JOIN b ON b.t = term AND a.gram = b.gram AND a.nth = b.nth GROUP BY text, term
  HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE >= 0.8 - 1E-12)"""


FUZZY = f"""WITH said AS (SELECT unnest({words("text")}) AS t FROM benchmark UNION SELECT p_name FROM part), known AS (SELECT unnest({words("text")}) AS t FROM documents UNION SELECT p_name FROM part),
 asked AS (SELECT DISTINCT t FROM (SELECT t || 's' AS t FROM said UNION ALL SELECT substr(t, 1, 2) || substr(t, 4) FROM said) WHERE t <> ''),
 terms AS (SELECT DISTINCT {normal("t")} AS t FROM known), {pairs("asked", "terms")}
SELECT text, term, round(similarity, 6) AS similarity FROM alike"""

SPANS = f"""sentences AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s) <> '') AS s FROM documents),
 tokens AS (SELECT doc_id, k, regexp_extract_all(s[k], '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]') AS t FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS k FROM sentences)),
 placed AS (SELECT *, coalesce(sum(len(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM tokens),
 starts AS (SELECT *, unnest(generate_series(1, len(t))) AS i FROM placed),
 runs AS (SELECT *, unnest(generate_series(1, least(5, len(t) - i + 1))) AS l FROM starts),
 spans AS (SELECT doc_id, CAST(place + i - 1 AS INT) AS start, CAST(place + i - 1 + l AS INT) AS "end", array_to_string(t[i:i + l - 1], ' ') AS span FROM runs
  WHERE lower(t[i]) NOT IN ({STOPS}) AND lower(t[i + l - 1]) NOT IN ({STOPS}) AND regexp_full_match(t[i], '[\\p{{L}}\\p{{N}}]+') AND NOT (l = 1 AND regexp_full_match(t[i], '\\p{{N}}+')))"""



def chosen(best: str, longest: int = 5) -> str:
    """Tables up to taken: of ``best`` (doc_id, start, end, match), with each pair of ends once, the greedy choice, one length after the other.

    Of one length, a fold along the text takes each span that begins at or after the end of the last.
    """
    tables = []
    for n in range(longest, 0, -1):
        every = f"SELECT doc_id, start FROM {best} WHERE \"end\" - start = {n}"
        above = [f"SELECT doc_id, start + o AS token FROM taken{m}, generate_series(0, {m - 1}) g(o)" for m in range(n + 1, longest + 1)]
        held = f" EXCEPT SELECT doc_id, token - o AS start FROM ({' UNION ALL '.join(above)}), generate_series(0, {n - 1}) g(o)" if above else ""
        fold = f"list_reduce(list([start] ORDER BY start), lambda kept, x: CASE WHEN x[1] >= kept[len(kept)] + {n} THEN list_concat(kept, x) ELSE kept END)"
        tables += [f"free{n} AS ({every}{held})", f"taken{n} AS (SELECT doc_id, unnest({fold}) AS start FROM free{n} GROUP BY doc_id)"]
    ends = " UNION ALL ".join(f"SELECT doc_id, start, start + {n} AS \"end\" FROM taken{n}" for n in range(1, longest + 1))
    return ", ".join(tables) + f", taken AS (SELECT doc_id, CAST(start AS INT) AS start, CAST(\"end\" AS INT) AS \"end\", match FROM ({ends}) JOIN {best} USING (doc_id, start, \"end\"))"


OVERLAPS = f"""WITH {SPANS}, best AS (SELECT doc_id, start, "end", span AS match FROM spans), {chosen("best")} SELECT * FROM taken"""
KEYWORDS = f"""WITH {COUNTS}, {BAND}, words_kept AS (SELECT word FROM counts, band WHERE n BETWEEN low AND high AND length(word) > 2 AND word NOT IN ({STOPS})), {SPANS},
 normals AS (SELECT doc_id, start, "end", {normal("span")} AS t FROM spans), terms AS (SELECT DISTINCT {normal("word")} AS t FROM words_kept),
 asked AS (SELECT DISTINCT t FROM normals WHERE t <> '' AND length(t) <= (SELECT 2 + 1.25 * max(greatest(1, length(t) - 2)) FROM terms)), {pairs("asked", "terms")},
 best AS (SELECT doc_id, start, "end", arg_min(term, {{'n': n_term, 'term': term}}) AS match FROM normals JOIN alike ON t = text GROUP BY doc_id, start, "end"), {chosen("best")},
 once AS (SELECT doc_id, match, min(start) AS start FROM taken GROUP BY doc_id, match), lists AS (SELECT doc_id, string_agg(match, ', ' ORDER BY start) AS keywords FROM once GROUP BY doc_id)
SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN lists USING (doc_id)"""


# What occurs next to what, and the likelihoods that make a sentence model of it.
def kind_of(word: str) -> str:
    bare = f"lower(regexp_replace({word}, '\\.+$', ''))"
    return f"CASE WHEN regexp_matches({bare}, '^[0-9]+([.''’-][0-9]+)*$') THEN '##number##' ELSE {bare} END"


def log_l(k: str, n: str, p: str) -> str:
    held = f"greatest(1E-12, least(1 - 1E-12, {p}))"
    return f"(({k}) * ln({held}) + (({n}) - ({k})) * ln(1 - {held}))"


def dunning(both: str, a: str, b: str, n: str) -> str:
    apart = log_l(both, a, f"{both} / ({a})::DOUBLE") + " + " + log_l(f"{b} - {both}", f"{n} - {a}", f"({b} - {both}) / greatest({n} - {a}, 1)::DOUBLE")
    return f"2 * ({apart} - {log_l(both, a, f'{b} / ({n})::DOUBLE')} - {log_l(f'{b} - {both}', f'{n} - {a}', f'{b} / ({n})::DOUBLE')})"


DOTS = "(length(type) - length(replace(type, '.', '')))"
SENTENCES = f"""WITH w AS (SELECT regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}.''’-]*') AS w FROM documents),
 each AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(generate_series(1, len(w))) AS i FROM w)),
 pairs AS (SELECT {kind_of("a")} AS type, ends_with(a, '.') AS period, CASE WHEN b IS NOT NULL THEN {kind_of("b")} END AS next, regexp_matches(b, '^\\p{{Lu}}') AS upper, CAST(count(*) AS BIGINT) AS n FROM each GROUP BY ALL),
 counts AS (SELECT type, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (period), 0)::BIGINT AS dotted FROM pairs GROUP BY type),
 sums AS (SELECT sum(total)::BIGINT AS big_n, sum(dotted)::BIGINT AS dots FROM counts),
 scored AS (SELECT type, 2 * ({log_l("dotted", "total", "0.99E0")} - {log_l("dotted", "total", "dots / big_n::DOUBLE")}) * exp(-(length(type) - {DOTS})) * ({DOTS} + 1) * pow((length(type) - {DOTS})::DOUBLE, -(total - dotted)) AS score FROM counts, sums WHERE dotted > 0 AND type <> '##number##'),
 short AS (SELECT * FROM scored WHERE score >= 0.3),
 dotted AS (SELECT type, next, type IN (SELECT type FROM short) OR regexp_matches(type, '^\\p{{L}}$') OR type = '##number##' AS bound, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (upper), 0) AS uppers FROM pairs WHERE period GROUP BY ALL),
 ends AS (SELECT coalesce(sum(n), 0)::BIGINT AS breaks FROM dotted WHERE NOT bound),
 after AS (SELECT next, sum(n)::BIGINT AS joint, any_value(total) AS total FROM dotted JOIN counts ON next = counts.type WHERE NOT bound GROUP BY next),
 starters AS (SELECT next, {dunning("joint", "breaks", "total", "big_n")} AS score FROM after, ends, sums WHERE joint / breaks::DOUBLE > total / big_n::DOUBLE),
 linked AS (SELECT d.type, next, {dunning("n", "a.total", "b.total", "big_n")} AS score FROM dotted d JOIN counts a ON d.type = a.type JOIN counts b ON next = b.type, sums WHERE bound AND n > 1 AND n / a.total::DOUBLE > b.total / big_n::DOUBLE),
 inside AS (SELECT next, coalesce(sum(n) FILTER (upper), 0) AS up, sum(n) AS every FROM pairs WHERE NOT period GROUP BY next)
SELECT 'abbreviation' AS kind, type AS first, NULL::VARCHAR AS second, round(score, 6) AS score FROM short UNION ALL SELECT 'starter', next, NULL, round(score, 6) FROM starters WHERE score >= 30
 UNION ALL SELECT 'collocation', type, next, round(score, 6) FROM linked WHERE score >= 7.88 UNION ALL SELECT 'common', next, NULL, every::DOUBLE FROM inside WHERE up = 0 AND next IN (SELECT next FROM dotted WHERE bound AND uppers > 0)"""


def drawn(n: str, *parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('~', {', '.join(parts)}, '42')), 1, 8))::BIGINT % ({n}) + 1 AS INT)"


PICKED = "list_transform(list_sort(list_transform(terms, lambda t: {'h': md5(concat_ws('~', sample, code, t, '42')), 't': t}))[1:k], lambda x: x.t)"
TERMS = f"{DICTIONARY}, terms AS (SELECT code, list(term ORDER BY place) AS terms FROM dictionary GROUP BY code)"
RANDOM = f"""WITH {TERMS}, wanted AS (SELECT range AS sample, {drawn("3", "'n'", "range")} AS c, {drawn("2", "'k'", "range")} AS k FROM range(200)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY md5(concat_ws('~', concat_ws('~', sample, code), '42')), code) AS r FROM wanted, terms),
 picked AS (SELECT sample, r, code, {PICKED} AS p FROM ranked WHERE r <= c)
SELECT sample, string_agg(code, ' ' ORDER BY r) AS codes, CAST(count(*) AS INT) AS n_codes, array_to_string(flatten(list(p ORDER BY r)), ', ') AS keywords, CAST(len(flatten(list(p ORDER BY r))) AS INT) AS n_kws FROM picked GROUP BY sample"""
BY_NUMBER = f"""WITH terms AS (SELECT 'o' || o_orderkey AS code, [o_orderpriority, o_orderstatus] AS terms, row_number() OVER (ORDER BY 'o' || o_orderkey) - 1 AS number FROM orders),
 wanted AS (SELECT range AS sample, {drawn("3", "'n'", "range")} AS c, {drawn("2", "'k'", "range")} AS k FROM range(1000)),
 draws AS (SELECT sample, c, k, j, {drawn("(SELECT count(*) FROM terms)", "'code'", "sample", "j")} - 1 AS number FROM wanted, (SELECT unnest(generate_series(1, 28)) AS j)),
 firsts AS (SELECT sample, c, k, number, min(j) AS j FROM draws GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY j) AS r FROM firsts),
 picked AS (SELECT sample, r, code, {PICKED} AS p FROM ranked JOIN terms USING (number) WHERE r <= c)
SELECT sample, string_agg(code, ' ' ORDER BY r) AS codes, CAST(count(*) AS INT) AS n_codes, array_to_string(flatten(list(p ORDER BY r)), ', ') AS keywords, CAST(len(flatten(list(p ORDER BY r))) AS INT) AS n_kws FROM picked GROUP BY sample"""
ASSOCIATED = f"""WITH {TERMS}, {coded("p_brand")}, own AS (SELECT order_id AS sample, string_split(codes, ' ')[1] AS principal, string_split(codes, ' ')[2:] AS others FROM coded),
 sized AS (SELECT *, CASE WHEN len(others) = 0 THEN 0 ELSE {drawn("least(3, greatest(len(others), 1))", "'n'", "sample")} END AS c, {drawn("2", "'k'", "sample")} AS k FROM own),
 each AS (SELECT sample, c, k, i - 1 AS pos, others[i] AS code FROM (SELECT *, unnest(generate_series(1, len(others))) AS i FROM sized)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY md5(concat_ws('~', concat_ws('~', sample, pos), '42')), pos) AS r FROM each),
 chosen AS (SELECT sample, k, 0 AS r, principal AS code FROM sized UNION ALL SELECT sample, k, r, code FROM ranked WHERE r <= c),
 picked AS (SELECT sample, r, code, {PICKED} AS p FROM chosen JOIN terms USING (code)),
 put AS (SELECT sample, string_agg(code, ' ' ORDER BY r) AS codes, flatten(list(p ORDER BY r)) AS w FROM picked GROUP BY sample)
SELECT sample, codes, CAST(c AS INT) AS n_codes, array_to_string(w, ', ') AS keywords, CAST(len(w) AS INT) AS n_kws FROM put JOIN sized USING (sample) WHERE len(w) > 0"""


def chunked(size: int, stride: int) -> str:
    marks = f"least(len(real) + 1, {size})"
    joined = lambda x: f"array_to_string({x}, ' ')"
    return f"""WITH docs AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '\\S+'), lambda t: length(t) + 1) AS ids FROM documents),
 starts AS (SELECT *, unnest(generate_series(0, len(ids) - 1, {stride})) AS s FROM docs),
 cut AS (SELECT doc_id, CAST(s // {stride} AS INT) AS chunk, ids[s + 1:s + {size}] AS real FROM starts),
 f AS (SELECT *, list_concat(real, list_transform(generate_series(1, {size} - len(real)), lambda x: 0)) AS padded, {marks} AS m FROM cut)
SELECT doc_id, chunk, {joined("padded")} AS input_ids, {joined(f"list_transform(generate_series(1, {size}), lambda i: CASE WHEN i <= m THEN 1 ELSE 0 END)")} AS attention_mask,
 {joined(f"list_transform(generate_series(1, {size}), lambda i: CASE WHEN i <= m THEN padded[i] ELSE -100 END)")} AS labels FROM f"""


SPLIT = "CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('~', {0}, '42')), {0}) <= ceil(0.1 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split"
GOOD = "'ok {\"score\": ' || quality || '.' || doc_id % 10 || ',' || chr(10) || '}'"

GENERATED = "SELECT doc_id, " + ", ".join(f"text || ' [{i}]' AS response_{i}, " + ", ".join(f"{v!r} AS {k}_{i}" if isinstance(v, int) else f"{v!r}::DOUBLE AS {k}_{i}" for k, v in decoding_parameters(i).items()) for i in range(1, 5)) + " FROM documents"
JUDGED = f"""WITH t AS (SELECT doc_id, {TOKENS.format("p")} AS w FROM (SELECT doc_id, replace({quoted(JUDGE)}, '{{INSTRUCTION}}', text) AS p FROM documents) t)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE CAST(printf('%.3f', len(list_distinct(w)) / len(w)::DOUBLE) AS DOUBLE) END AS educational_score FROM t"""

PAIR_JUDGED = f"""WITH t AS (SELECT doc_id, {TOKENS.format("p")} AS w FROM (SELECT a.doc_id, replace(replace({quoted(PAIR)}, '{{TEXT1}}', a.text), '{{TEXT2}}', b.text) AS p FROM documents a JOIN documents b ON b.doc_id - 1 = a.doc_id) t)
SELECT doc_id, CAST(printf('%.3f', len(list_distinct(w)) / len(w)::DOUBLE) AS DOUBLE) AS similarity_score FROM t"""
EIGHTHS = "eighths AS (SELECT * REPLACE (floor(educational_score * 8) / 8 AS educational_score, floor(similarity_score * 8) / 8 AS similarity_score) FROM candidates)"
BEST_BY_SORT = f"WITH {CANDIDATES}, {EIGHTHS} " + " UNION ALL ".join(f"(SELECT '{name}' AS sort, example_id, candidate_id FROM eighths ORDER BY {', '.join(f'{c} DESC' for c in columns)}, example_id, candidate_id LIMIT 50)" for name, columns in SORTS.items())

ORACLES: dict[str, str] = {
    "pair_judge_stub": PAIR_JUDGED,
    "best_by_sort": BEST_BY_SORT,
    "preferred_output": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'tie' END AS preferred FROM labels",
    "newline_to_space": "SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents",
    "generation_stub": GENERATED,
    "judge_stub": JUDGED,
    "normalize_text": f"SELECT doc_id, {normal('text')} AS normalized FROM documents",
    "remove_symbols": "SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g') AS plain FROM documents",
    "code_prefix": "SELECT p_partkey, lower(substr(p_brand, 1, 3)) AS prefix, 'a-' || p_type AS slug FROM part",
    "split_marker": "SELECT doc_id, CASE WHEN contains(text, '###') THEN regexp_replace(string_split(text, '###')[1], '^\\s+|\\s+$', '', 'g') ELSE text END AS head FROM documents",
    "instruction_build": f"""WITH {firsts('documents', 'doc_id', words('text'))} SELECT doc_id, replace(replace({quoted(INSTRUCTION)}, '{{keywords}}', array_to_string(coalesce(firsts, [])[1:5], ', ')), '{{knowledge_base}}', '') AS instruction
  FROM w LEFT JOIN f USING (doc_id)""",
    "given_or_extracted": f"""WITH {firsts('documents', 'doc_id', words('text'))} SELECT doc_id, CASE WHEN substr(md5(concat_ws('~', doc_id, '42')), 1, 1) < '8' THEN array_to_string(coalesce(firsts, [])[1:3], ', ') ELSE source END AS keywords
  FROM documents LEFT JOIN f USING (doc_id)""",
    "pair_prompt": f"""SELECT a.doc_id, replace(replace({quoted(PAIR)}, '{{TEXT1}}', a.text || ' {{TEXT2}}'), '{{TEXT2}}', b.text) AS prompt FROM documents a
  JOIN documents b ON b.doc_id - 1 = a.doc_id""",
    "judge_prompt": f"SELECT doc_id, replace({quoted(JUDGE)}, '{{INSTRUCTION}}', text) AS prompt FROM documents",
    "sft_text_concat": """SELECT u.conv_id, u.turn, u.text || a.text AS text FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn
  WHERE u.role = 'user' AND a.role = 'assistant'""",
    "judge_score_parse": f"""SELECT doc_id, coalesce(try_cast(regexp_extract(CASE doc_id % 7 WHEN 0 THEN '{{"score": 2}}' WHEN 1 THEN 'score: 0.5' WHEN 2 THEN '{{"score": 0.5, "why": "x"}}' WHEN 3 THEN '{{ "score" : 1 }}' ELSE {GOOD} END,
  '\\{{\\s*"score"\\s*:\\s*([01](?:\\.\\d+)?)\\s*,?\\s*\\}}', 1) AS DOUBLE), 0) AS score FROM labels""",
    "heading_order_check": """SELECT page_id, regexp_matches(html, '(?s)<title>.*?<nav>.*?<article>') AS in_order, regexp_matches(html, '(?s)<article>.*?<title>') AS reversed
  FROM pages""",
    "literal_list_parse": "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 2) THEN '' ELSE p_name || '|' || p_type END AS items FROM part",
    "invert_norm_keywords": f"""WITH f AS (SELECT {normal('p_name')} AS n, arg_min(upper(p_name), p_partkey) AS o FROM part GROUP BY 1) SELECT p_partkey, o || ', ' || o AS originals
  FROM part JOIN f ON {normal('p_name')} = n""",
    "code_to_terms": f"WITH {DICTIONARY} SELECT code, string_agg(term, ', ' ORDER BY place) AS terms FROM dictionary GROUP BY code",
    "code_lookup": f"""WITH {DICTIONARY}, {coded('p_brand')}, t AS (SELECT code, count(*) AS n FROM dictionary
  GROUP BY code) SELECT order_id, count(*) AS n_codes, CAST(sum(n) AS BIGINT) AS n_terms FROM (SELECT order_id, unnest(string_split(codes, ' ')) AS code
  FROM coded) JOIN t USING (code) GROUP BY order_id""",
    "code_int_map": f"""WITH {coded('p_brand')}, m AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS k FROM (SELECT DISTINCT p_brand AS code
  FROM part)), e AS (SELECT order_id, unnest(generate_series(1, len(string_split(codes, ' ')))) AS i, string_split(codes, ' ') AS c
  FROM coded) SELECT order_id, string_agg(k::VARCHAR, ' ' ORDER BY i) AS numbers FROM e JOIN m ON c[i] = code GROUP BY order_id""",
    "reverse_dictionary": f"""WITH forms AS (SELECT unnest([p_name, upper(p_name), replace(p_name, ' ', '-')]) AS term, p_partkey
  FROM part), firsts AS (SELECT term, min(p_partkey) AS place FROM forms GROUP BY term) SELECT {normal('term')} AS normal, string_agg(term, '|'
  ORDER BY place, term) AS originals FROM firsts GROUP BY 1""",
    "random_codes": RANDOM,
    "random_codes_by_number": BY_NUMBER,
    "assoc_codes": ASSOCIATED,
    "positional_zip": "SELECT a.doc_id // 2 AS row, a.doc_id, b.doc_id AS public_doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0",
    "unpivot_candidates": f"""WITH {CANDIDATES} SELECT example_id, candidate_id, first_value(instruction) OVER (PARTITION BY example_id
  ORDER BY candidate_id) AS instruction, md5(response) AS response, round(similarity_score, 6) AS similarity_score, round(educational_score, 6) AS educational_score, round(bleu_score, 6) AS bleu_score, round(cumulative_score, 6) AS cumulative_score
  FROM candidates""",
    "cumulative_score": f"""WITH {CANDIDATES} SELECT example_id, {', '.join(f'round(max(CASE WHEN candidate_id = {i} THEN cumulative_score END), 6) AS cumulative_score_{i}' for i in range(1, 5))}
  FROM candidates GROUP BY example_id""",
    "score_stats": f"WITH {CANDIDATES} " + " UNION ALL ".join(f"SELECT '{s}' AS metric, round(avg({s}), 6) AS mean, round(max({s}), 6) AS max, round(min({s}), 6) AS min, round(median({s}), 6) AS median FROM candidates" for s in ("similarity_score", "cumulative_score")),
    "sorted_candidates": f"WITH {RANKED} SELECT r AS rank, example_id, candidate_id, round(cumulative_score, 6) AS cumulative_score FROM ranked",
    "sft_top": f"WITH {RANKED} SELECT example_id, candidate_id, instruction, md5(response) AS response FROM ranked WHERE r <= {TOP}",
    "eval_top": f"""WITH {CANDIDATES} SELECT example_id, candidate_id, round(similarity_score, 6) AS similarity_score FROM candidates
  ORDER BY similarity_score DESC, example_id, candidate_id LIMIT {TOP}""",
    "kto_pairs": f"""WITH {RANKED}, both_ AS (SELECT *, true AS label FROM ranked WHERE r <= {TOP} UNION ALL SELECT *, false FROM ranked WHERE r > (SELECT count(*)
  FROM ranked) - {TOP}) SELECT instruction, label, md5(response) AS response, md5(response) AS completion, instruction AS prompt FROM both_""",
    "dpo_pairs": f"""WITH {PAIRS} SELECT rank, instruction, md5(chosen) AS chosen, md5(rejected) AS rejected, round(c1, 6) AS chosen_similarity_score, round(c2, 6) AS chosen_educational_score, round(c3, 6) AS chosen_bleu_score, round(c4, 6) AS chosen_cumulative_score, round(w1, 6) AS rejected_similarity_score, round(w2, 6) AS rejected_educational_score, round(w3, 6) AS rejected_bleu_score, round(w4, 6) AS rejected_cumulative_score
  FROM pairs""",
    "dpo_trainer_input": f"""WITH {PAIRS} SELECT rank, instruction AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected, {SPLIT.format('rank')} FROM pairs
  WHERE rank <= {TRAINED}""",
    "below_score": f"WITH {CANDIDATES} SELECT example_id, candidate_id, round(educational_score * 10, 6) AS educational_score FROM candidates WHERE educational_score * 10 < 6",
    "stage_counts": f"""WITH {PAIRS}, n AS (SELECT count(*) AS n FROM candidates) SELECT 'documents' AS stage, n FROM n UNION ALL SELECT 'candidates', n FROM n
  UNION ALL SELECT 'sft', least(n, {TOP}) FROM n UNION ALL SELECT 'kto', 2 * least(n, {TOP}) FROM n UNION ALL SELECT 'dpo', (SELECT count(*) FROM pairs)
  FROM n""",
    "semi_any_medical": f"""WITH {CANDIDATES}, f AS (SELECT c.*, coalesce(toxic = 1, false) AS medical FROM candidates c LEFT
  JOIN labels l USING (doc_id)) SELECT example_id, candidate_id, medical FROM f WHERE example_id IN (SELECT example_id FROM f WHERE medical)""",
    "keyword_overlap": f"""WITH {firsts('documents', 'doc_id', words('text'))}, k AS (SELECT doc_id, {normal('text')} AS n, string_split(array_to_string(coalesce(firsts, [])[2:7], ', '), ', ') AS keys
  FROM documents LEFT JOIN f USING (doc_id)) SELECT doc_id, round(len(list_filter(keys, lambda x: contains(n, x))) / len(keys)::DOUBLE, 6) AS overlap
  FROM k""",
    "bleu_score": BLEU,
    "cosine_similarity": """SELECT a.vec_id, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS cosine FROM embeddings a
  JOIN embeddings b ON b.vec_id - 1 = a.vec_id""",
    "window_min_similarity": """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings
  GROUP BY label), c AS (SELECT v.label, vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS c FROM embeddings v
  JOIN f USING (label)) SELECT label, round((arg_max(c, vec_id) + min(c)) / 2, 6) AS similarity FROM c GROUP BY label""",
    "label_counts": f"""WITH {TYPES}, e AS (SELECT order_id, labels[i] AS label, i - 1 AS pos FROM (SELECT *, unnest(generate_series(1, len(labels))) AS i
  FROM labelled)) SELECT label, count(*) AS n, min(order_id) AS first_key, CAST(arg_min(pos, (order_id, pos)) AS INT) AS first_pos FROM e GROUP BY label""",
    "distinct_labels": f"WITH {TYPES} SELECT DISTINCT unnest(labels) AS label FROM labelled",
    "label_topk": f"WITH {TYPES} SELECT label, count(*) AS n FROM (SELECT order_id, unnest(labels) AS label FROM labelled) GROUP BY label ORDER BY n DESC, min(order_id) LIMIT 4",
    "label_top_pct": f"""WITH {TYPES} SELECT label, count(*) AS n FROM (SELECT order_id, unnest(labels) AS label FROM labelled) GROUP BY label
  ORDER BY n DESC, min(order_id) LIMIT 3""",
    "multilabel_samples": f"""WITH {TYPES} SELECT order_id, array_to_string(list_filter(labels, lambda x: x IN ('eco', 'med', 'pro'))[1:3], ' ') AS labels FROM labelled
  WHERE len(list_filter(labels, lambda x: x IN ('eco', 'med', 'pro'))) > 0""",
    "multi_hot": f"WITH {TYPES} SELECT order_id, {' || '.join(f'CAST(list_contains(labels, {quoted(x)}) AS INT)::VARCHAR' for x in LABELS)} AS hot FROM labelled",
    "pos_weights": f"WITH {LOGITS} SELECT label, CAST(sum(y) AS BIGINT) AS pos, round((count(*) - sum(y)) / greatest(sum(y), 1)::DOUBLE, 6) AS weight FROM logits GROUP BY label",
    "metrics_hamming": f"WITH {LOGITS} {HAMMING}",
    "metrics_jaccard": f"WITH {LOGITS} {JACCARD}",
    "metrics_macro": f"WITH {LOGITS} {MACRO}",
    "metrics_micro": f"WITH {LOGITS} {MICRO}",
    "metrics_f1_at_k": f"WITH {LOGITS} {AT_K}",
    "metrics_by_dataset": f"""WITH {LOGITS} SELECT * FROM ({HAMMING}) JOIN ({JACCARD}) USING (dataset) JOIN ({MACRO}) USING (dataset) JOIN ({MICRO}) USING (dataset)
  JOIN ({AT_K}) USING (dataset)""",
    "vocab_counts": f"WITH {COUNTS} SELECT * FROM counts",
    "vocab_percentile_band": f"WITH {COUNTS}, {BAND} SELECT round(low, 6) AS low, round(high, 6) AS high FROM band",
    "vocab_filtered": f"WITH {COUNTS}, {BAND} SELECT word, n FROM counts, band WHERE n BETWEEN low AND high AND length(word) > 2 AND word NOT IN ({STOPS})",
    "fuzzy_match": FUZZY,
    "candidate_spans": f"WITH {SPANS} SELECT * FROM spans",
    "resolve_overlaps": OVERLAPS,
    "sentence_model": SENTENCES,
    "keyword_extraction": KEYWORDS,
    "ordered_dedup": f"WITH {coded('p_brand')}, {firsts('coded', 'order_id', "string_split(codes, ' ')")} SELECT order_id, array_to_string(firsts, ', ') AS keywords FROM f",
    "train_test_split": f"SELECT doc_id, {SPLIT.format('doc_id')} FROM documents",
    "sample_rows": "SELECT doc_id, source FROM documents ORDER BY md5(concat_ws('~', doc_id, '42')), doc_id LIMIT 100",
    "shuffle_rows": "SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('~', doc_id, '42')), doc_id) AS position FROM documents",
    "head_rows": "SELECT doc_id, n_chars FROM documents WHERE doc_id < 50",
    "dataset_size_all": "SELECT doc_id, n_chars FROM documents",
    "token_chunks": chunked(64, 64),
    "token_chunks_overlapping": chunked(64, 48),
    "token_truncate": "WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) > " + str(TRUNCATED) + " THEN array_to_string(w[1:" + str(TRUNCATED) + "], ' ') ELSE text END AS text FROM t",
    "sliding_windows": """WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w
  FROM documents), s AS (SELECT *, unnest(generate_series(0, greatest(len(w) - 128, 0), 64)) AS s
  FROM t) SELECT doc_id, CAST(s // 64 AS INT) AS "window", array_to_string(w[s + 1:s + 128], ' ') AS tokens FROM s""",
    "csv_chunk_ids": "SELECT event_id, CAST(event_id // 1000 AS INT) AS chunk FROM events",
}
