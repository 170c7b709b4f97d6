r"""SQL for DuckDB with the results of those operators that it can express."""

from __future__ import annotations

import string

from textloom.llm.line_dedup import BREAKS, HIDDEN, TAG
from textloom.llm.url_filter import BLOCK_AT, DAMPING, LINK, ROUNDS, RULES

BLANKS = r"[\x20\x09-\x0D]"

MIXING = r"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
 sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM sized GROUP BY source),
 weighed AS (SELECT source, source_size, source_size * 2E0 AS ceiling, CASE k WHEN 0 THEN 3E0 WHEN 1 THEN 1E0 ELSE 2E0 END AS w FROM sources),
 totals AS (SELECT 1.5E0 * sum(source_size) AS goal, sum(w) AS all_w FROM weighed),
 steps AS (SELECT *, ceiling / w AS ratio, coalesce(sum(ceiling) OVER before, 0) AS held, coalesce(sum(w) OVER before, 0) AS gone FROM weighed WINDOW before AS (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 level AS (SELECT arg_min((goal - held) / (all_w - gone), ratio) AS level FROM steps, totals WHERE ratio >= (goal - held) / (all_w - gone)),
 targets AS (SELECT source, source_size, CASE WHEN w * level > ceiling THEN ceiling ELSE w * level END AS target FROM weighed, level),
 ranked AS (SELECT doc_id, size, s.source, t.source_size, target, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY s.source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) AS r FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
 drawn AS (SELECT source AS drawn_for, g.k, ('0x' || substr(md5(concat_ws('~', 'mix', source, g.k)), 1, 13))::BIGINT / 4503599627370496E0 AS u FROM sources, generate_series(0, 15) g(k)),
 tried AS (SELECT source, k, u, any_value(target) AS target, sum((floor(u + r * rate) - floor(u + (r - 1) * rate)) * size) AS words FROM ranked JOIN drawn ON source IS NOT DISTINCT FROM drawn_for GROUP BY ALL),
 offsets AS (SELECT source AS offset_of, arg_min(u, {'off': CASE WHEN abs(words - target) <= target * 0.01E0 THEN 0 ELSE abs(words - target) END, 'k': k}) AS u FROM tried GROUP BY source),
 copied AS (SELECT *, CAST(floor(u + r * rate) - floor(u + (r - 1) * rate) AS INT) AS copies FROM ranked JOIN offsets ON source IS NOT DISTINCT FROM offset_of)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied"""


def own_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {own_words("text")} AS w FROM documents),
 b AS (SELECT item_id, {own_words("text")} AS w FROM benchmark),
 sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
 windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM sized)),
 placed AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM sized))),
 found AS (SELECT doc_id, item_id, i, n FROM placed JOIN windows USING (n, g)),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

# Five hexadecimal digits are four digits in base 32.
BASE32 = "array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INT) + 1, 1)), '')"
WARC = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

TRIMMED = f"regexp_replace(l, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def lines(key: str, site: str, rows: str) -> str:
    """Line deduplication of ``rows``, a query for (key, site, text)."""
    shown = site + ", " if site == "host" else ""
    return f"""WITH rows AS ({rows}),
 lines AS (SELECT {key}, {site}, i, s[i] AS l FROM (SELECT {key}, {site}, string_split(text, chr(10)) AS s, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM rows)),
 keyed AS (SELECT *, {TRIMMED} AS k FROM lines),
 sites AS (SELECT {site}, count(*) AS n FROM rows GROUP BY {site}),
 bad AS (SELECT {site}, k FROM (SELECT {site}, k, count(DISTINCT {key}) AS pages FROM keyed WHERE k <> '' GROUP BY ALL) JOIN sites USING ({site}) WHERE pages >= least(5, greatest(2, ceil(n / 2))) AND pages > n * 0.01E0),
 marked AS (SELECT keyed.*, bad.k IS NOT NULL AS dropped FROM keyed LEFT JOIN bad ON keyed.{site} = bad.{site} AND keyed.k = bad.k)
SELECT {key}, {shown}count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS text_sha256 FROM marked GROUP BY ALL"""


def lowered(text: str) -> str:
    return f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def host(url: str) -> str:
    return lowered(f"regexp_extract(coalesce({url}, ''), '(?s)://([^/?#]*)', 1)")


def page_text(html: str) -> str:
    shown = f"regexp_replace(coalesce({html}, ''), '{HIDDEN}', '', 'g')"
    return f"regexp_replace(regexp_replace({shown}, '{BREAKS}', chr(10), 'g'), '{TAG}', '', 'g')"


def url_filter() -> str:
    """The rounds are spelled out, one common table expression each."""
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in rules) + " END"
    link = LINK.replace("'", "''")
    rounds = ",\n ".join(
        f"""s{k} AS (SELECT st.host, st.good + coalesce(t, 0) * {DAMPING!r} AS trust, st.bad + coalesce(d, 0) * {DAMPING!r} AS distrust FROM start st
  LEFT JOIN (SELECT dst AS host, sum(ft * trust) AS t, sum(fd * distrust) AS d FROM flows JOIN s{k - 1} ON src = s{k - 1}.host GROUP BY dst) USING (host))"""
        for k in range(1, ROUNDS + 1)
    )
    return f"""WITH placed AS (SELECT page_id, html, {host("url")} AS host, regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 ruled AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS rule_verdict FROM placed),
 seeds AS (SELECT host, count(*) AS pages, count(*) FILTER (rule_verdict = 'allow') AS good, count(*) FILTER (rule_verdict = 'block') AS bad FROM ruled GROUP BY host),
 links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS l FROM placed),
 edges AS (SELECT src, CASE WHEN contains(l, '://') THEN {host("l")} WHEN starts_with(l, '//') THEN {host("'x:' || l")} END AS dst, count(*) AS n FROM links GROUP BY ALL HAVING dst <> src),
 hosts AS (SELECT host FROM seeds UNION SELECT src FROM edges UNION SELECT dst FROM edges),
 start AS (SELECT host, coalesce(good, 0)::DOUBLE AS good, coalesce(bad, 0)::DOUBLE AS bad FROM hosts LEFT JOIN seeds USING (host)),
 shared AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS t, n / sum(n) OVER (PARTITION BY dst) AS d FROM edges),
 flows AS (SELECT src, dst, sum(t) AS ft, sum(d) AS fd FROM (SELECT src, dst, t, 0E0 AS d FROM shared UNION ALL SELECT dst, src, 0E0, d FROM shared) GROUP BY ALL),
 s0 AS (SELECT host, good AS trust, bad AS distrust FROM start),
 {rounds},
 blocked AS (SELECT host FROM seeds JOIN s{ROUNDS} USING (host) WHERE distrust > trust AND distrust >= pages * {BLOCK_AT!r})
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""

def terms(text: str) -> str:
    return rf"regexp_extract_all({lowered(f"coalesce({text}, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


LEXICAL = f"""WITH tokens AS (SELECT doc_id, unnest({terms("text")}) AS term FROM documents),
 postings AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
 lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id),
 totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
 asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({terms("text")}) AS term FROM benchmark) GROUP BY ALL),
 weights AS (SELECT term, CAST(floor(1000 * ln((2E0 * big_n + 2) / (2E0 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
 scored AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""

#: Orders are made by joining letters; each document goes at the first filter of an order that it fails.
AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
 f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(first < doc_id, false) AS e FROM w),
 l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
 m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM f LEFT JOIN l USING (doc_id)),
 letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 steps AS (SELECT o, CAST(s AS INT) AS step, o[s] AS own, o[1:s - 1] AS before FROM orders, generate_series(1, 5) g(s)),
 counted AS (SELECT part, o, step, own,
  count(*) FILTER (translate(fails, before || own, '') = fails) AS kept,
  count(*) FILTER (contains(fails, own) AND translate(fails, before, '') = fails) AS removed,
  count(*) FILTER (contains(fails, own) AND translate(fails, before, '') <> fails) AS redundant,
  count(*) FILTER (fails = own) AS unique_fails,
  coalesce(sum(good) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS good_lost,
  coalesce(sum(bad) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT part, o AS filter_order, step, kept, removed, redundant, unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted"""

PRODUCTS = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter(),
    "op4_mixing": MIXING,
    "op5_decontamination": DECONTAMINATION,
    "op8_warc": WARC,
    "op10_line_dedup": lines("page_id", "host", f"SELECT page_id, {host('url')} AS host, {page_text('html')} AS text FROM pages"),
    "line_dedup_by_source": lines("doc_id", "source", "SELECT doc_id, source, text FROM documents"),
    "op11_lexical_search": LEXICAL,
    "op12_filter_audit": AUDIT,
    "op13_bit_sliced": PRODUCTS,
}
