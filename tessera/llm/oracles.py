"""SQL over whole tables that states the results of some of the queries."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bench_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


BENCHMARK_HITS = f"""
    WITH d AS (SELECT doc_id, {_bench_words('text')} AS ws FROM documents),
    b AS (SELECT item_id, ws, least(len(ws), 10) AS l FROM (SELECT item_id, {_bench_words('text')} AS ws FROM benchmark) WHERE len(ws) > 0),
    bi AS (SELECT item_id, ws, l, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b),
    bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS k FROM bi),
    di AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT l FROM bw)),
    dw AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS k FROM di),
    m AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, k)),
    h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

REPEATED_PASSAGES = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) > 12),
    w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM i),
    f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (k) WHERE first < doc_id),
    x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
    y AS (SELECT x.doc_id, count(g.p) AS gone, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y ON y.doc_id = d.doc_id"""


def _terms(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


RANKED_SEARCH = f"""
    WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_terms('text')} AS ws FROM documents),
    s AS (SELECT CAST(count(*) FILTER (len(ws) > 0) AS BIGINT) AS docs, CAST(sum(len(ws)) AS BIGINT) AS words FROM d),
    p AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p SEMI JOIN q USING (term) GROUP BY term),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s),
    g AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0
    WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10"""
