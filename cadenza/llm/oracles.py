"""SQL for the queries that SQL can express, written plainly and without regard to scale."""

from __future__ import annotations

from . import licenses, quality

#: op4: measures by lists, host rates and verdicts as in quality.judged.
OP4 = f"""
WITH words AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
    SELECT row, p, list_slice(w, p, p + 2) AS three FROM words, unnest(range(1, greatest(len(w) - 1, 1))) AS u(p)
), again AS (
    SELECT row, p FROM windows QUALIFY count(*) OVER (PARTITION BY row, three) > 1
), repeated AS (
    SELECT row, count(DISTINCT p + k) AS n_repeat_words FROM again, range(3) AS r(k) GROUP BY row
), lines AS (
    SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines
    FROM words, unnest(string_split(text, chr(10))) AS l(line) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row
), measured AS (
    SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
    FROM words LEFT JOIN repeated USING (row) LEFT JOIN lines USING (row)
), marked AS (
    SELECT *, n_words < {quality.LEAST_WORDS} OR n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
        n_symbols > {quality.MOST_SYMBOLS} * greatest(word_chars, 1) OR n_symbols > 0.5 * greatest(n_words, 1)
        OR (n_dup_lines >= {quality.LEAST_DUP_LINES} AND n_dup_lines > {quality.MOST_DUP_LINES} * n_lines) OR n_capitals > {quality.MOST_CAPITALS} * greatest(word_chars, 1)
        OR greatest(word_chars, 1) < {quality.SHORT_WORD} * greatest(n_words, 1) OR greatest(word_chars, 1) > {quality.LONG_WORD} * greatest(n_words, 1) AS rule_failed
    FROM measured
), hosts AS (
    SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR rule_failed)::DOUBLE AS bad FROM marked GROUP BY host
), total AS (
    SELECT sum(bad) / sum(n) AS m, sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) ** 2 AS spread, count(*) / sum(n) AS k FROM hosts
), prior AS (
    SELECT m, CASE WHEN spread - m * (1 - m) * k > 0 THEN least(1e6, greatest(1, m * (1 - m) / (spread - m * (1 - m) * k) - 1)) ELSE 1e6 END AS strength FROM total
), rates AS (
    SELECT host, m, (bad + m * strength) / (n + strength) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND rate < {quality.BAD_HOST} AND (NOT rule_failed OR rate < {quality.GOOD_HOST} * m) AS kept
FROM marked JOIN rates USING (host)
"""

#: op8: the articles of the given pages, whose other parts stand outside of them.
OP8 = r"""
WITH article AS (
    SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g'),
        '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', '', 'g') AS t FROM pages
), decoded AS (
    SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM article
), joined AS (
    SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(t, chr(1)), lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> ''), ' ') AS text FROM decoded
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined
"""

def _found(phrase: str) -> str:
    words = phrase.split()
    first, rest = words[0], "".join(f" AND w[i + {k + 1}] = '{word}'" for k, word in enumerate(words) if k)
    return f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: w[i + 1] = '{first}'{rest})"


_LABELS = ", ".join(f"CASE WHEN len({_found(p)}) > 0 THEN '{label}' END" for p, label in {**licenses.BASE, **licenses.MORE}.items())
_BASE = ", ".join(f"CASE WHEN len({_found(p)}) > 0 THEN '{label}' END" for p, label in licenses.BASE.items())
_FREEDOM = " ".join(f"WHEN '{label}' THEN {value}" for label, value in licenses.FREEDOM.items())

#: op10: phrases by comparing words; the given documents have no licence expressions.
OP10 = f"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), found AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, list_concat({', '.join(f'{_found(p)}' for p in licenses.BASE)}) AS places,
        list_sort(list_distinct(list_filter([{_BASE}], lambda x: x IS NOT NULL))) AS base, list_sort(list_distinct(list_filter([{_LABELS}], lambda x: x IS NOT NULL))) AS labels FROM words
), freed AS (
    SELECT *, CASE WHEN list_has_any(labels, ['cc-by-nc', 'cc-by-nd', 'cc-by-sa']) AND list_contains(base, 'cc-by') THEN list_filter(labels, lambda x: x <> 'cc-by') ELSE labels END AS own FROM found
)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(base, ',') AS base_labels,
    array_to_string(labels, ',') AS labels, coalesce(list_min(list_transform(own, lambda x: (CASE x {_FREEDOM} END)::DOUBLE)), 0.0::DOUBLE) AS score FROM freed
"""

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op11: whole counts over every (lang, source) and every kept term.
OP11 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWERED.format("coalesce(text, '')")} AS text FROM documents
), words AS (
    SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), counted AS (
    SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
    FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
    SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM dense
), lang_counts AS (
    SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term
), lang_shares AS (
    SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM lang_counts
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), all_pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares JOIN lang_shares USING (lang, term) WHERE shares.n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_TERMS = "unnest(regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"

#: op12: every document that holds a term of the item is scored.
OP12 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, {_LOWERED.format("coalesce(text, '')")} AS text FROM documents
), words AS (
    SELECT row, doc_id, {_TERMS.format("text")} AS term FROM docs
), sizes AS (
    SELECT row, count(*) AS n FROM words GROUP BY row
), total AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), asked AS (
    SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS.format(_LOWERED.format("coalesce(text, '')"))} AS term FROM benchmark)
), postings AS (
    SELECT row, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total
), scored AS (
    SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (row), total GROUP BY item_id, row, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
