"""SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from cpdspark.llm.line_quality import LineRules

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_ITEM_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PLAIN_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

_ESCAPED = "replace(replace(replace(replace({0}, '~', '~0'), '</s>', '~1'), '[INST]', '~2'), '[/INST]', '~3')"
_PIECE = f"6 + length({_ESCAPED.format('role')}) + 7 + length({_ESCAPED.format('text')}) + 4"

PREFIX_TARGETS = f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    g AS (
        SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
            sum({_PIECE}) AS formatted_chars, count(*) FILTER (WHERE role = 'assistant') AS n_examples
        FROM c GROUP BY conv_id)
    SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
        CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
        CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(n_examples AS BIGINT) AS n_examples
    FROM g"""

NEAR_DEDUP = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN_WORDS.format(_LOWERED)} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 2, 2))) t(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reach AS (SELECT doc_id, doc_id AS least FROM d UNION SELECT b, least FROM reach JOIN links ON a = doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(least) AS component_id, d.doc_id = min(least) AS kept
    FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n"""

DECONTAMINATE = f"""
    WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS n
        FROM b, unnest(range(1, greatest(len(w) - 8, 2))) t(i) WHERE len(w) > 0),
    at_ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM d, (SELECT DISTINCT n FROM win) z, unnest(range(1, len(w) - n + 2)) t(i)),
    hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM at_ JOIN win USING (s, n)),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) x(p) GROUP BY 1),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def line_quality(r: LineRules = LineRules()) -> str:
    matching = lambda p: f"len(list_filter(w, lambda x: regexp_matches(x, {_quoted(p)})))"
    packed = "regexp_replace({0}, '[\\x20\\x09-\\x0D]+', '', 'g')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_PLAIN_WORDS.format("coalesce(text, '')")} AS words FROM documents),
    l AS (SELECT doc_id, k, line, {_PLAIN_WORDS.format('line')} AS w
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d)),
    j AS (SELECT *, len(w) > 0 AND ({matching(r.noise)} >= len(w) * {r.noisy_share}::DOUBLE
        OR (len(w) >= {r.unpunctuated_words} AND NOT regexp_matches(line, {_quoted(r.sentence_mark)}))
        OR {matching(r.separator)} >= {r.separators}
        OR (len(w) <= {r.menu_words} AND {matching(r.menu)} = len(w))
        OR regexp_matches(line, {_quoted(r.boilerplate)})
        OR (len(w) >= {r.repeated_from} AND len(list_distinct(w)) < len(w) * {r.distinct_share}::DOUBLE)) AS failed FROM l),
    f AS (SELECT doc_id, count(*) FILTER (failed) AS n_failed_lines,
        coalesce(sum(length({packed.format('line')})) FILTER (failed), 0) AS lost_chars,
        bool_or(NOT failed AND len(w) > 0) AS something, count(*) FILTER (len(w) > 0) AS n_lines,
        count(DISTINCT CASE WHEN len(w) > 0 THEN line END) AS n_distinct FROM j GROUP BY 1),
    win AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(words) - 3)) t(i)),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM rep, unnest(range(i, i + 5)) x(p) GROUP BY 1),
    m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length({packed.format('text')})::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (n_lines - n_distinct)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
        lost_chars::BIGINT AS lost_chars, n_failed_lines::BIGINT AS n_failed_lines, something
        FROM d JOIN f ON f.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND something AND lost_chars <= word_chars * {r.max_loss}::DOUBLE AS kept,
        lost_chars, n_failed_lines FROM m"""


_FAILS = [f"f{k}" for k in range(1, 6)]
_EARLIER = " OR ".join(f"{_FAILS[j - 1]} AND position({x!r} IN filter_order) < step" for j, x in enumerate("ABCDE", 1))
_THIS = " OR ".join(f"{_FAILS[j - 1]} AND letter = {x!r}" for j, x in enumerate("ABCDE", 1))
_OTHER = " OR ".join(f"{_FAILS[j - 1]} AND letter <> {x!r}" for j, x in enumerate("ABCDE", 1))

FILTER_AUDIT = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
            {_PLAIN_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    d AS (SELECT part, len(w) < 200 AS f1, 100 * len(list_distinct(w)) < 50 * len(w) AS f2,
            100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS f3,
            regexp_matches(text, '[#$%&*|]') AS f4, doc_id > min(doc_id) OVER (PARTITION BY text) AS f5,
            coalesce(quality = 1, FALSE) AS good, coalesce(toxic = 1, FALSE) AS toxic
        FROM t LEFT JOIN labels USING (doc_id)),
    c AS (SELECT part, f1, f2, f3, f4, f5, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
        FROM d GROUP BY ALL),
    x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    o AS (SELECT a.x || b.x || p.x || q.x || r.x AS filter_order FROM x a, x b, x p, x q, x r
        WHERE a.x <> b.x AND a.x <> p.x AND a.x <> q.x AND a.x <> r.x AND b.x <> p.x AND b.x <> q.x AND b.x <> r.x
            AND p.x <> q.x AND p.x <> r.x AND q.x <> r.x),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM o, (VALUES (1), (2), (3), (4), (5)) z(step)),
    j AS (SELECT part, filter_order, step, letter, n, good, toxic, {_EARLIER} AS earlier, {_THIS} AS fails, {_OTHER} AS others FROM c, s),
    g AS (SELECT part, filter_order, step, letter,
            coalesce(sum(n) FILTER (NOT earlier AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed,
            coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (fails AND NOT others), 0) AS unique_fails,
            coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS toxic_lost
        FROM j GROUP BY ALL)
    SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
        unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
        (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g"""


SOURCE_DIVERGENCE = f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all({_LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY 1, 2, 3),
    k AS (SELECT lang, term, sum(n)::BIGINT AS total FROM c GROUP BY 1, 2 HAVING sum(docs) >= 10),
    l AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS whole FROM k GROUP BY 1),
    g AS (SELECT DISTINCT lang, source FROM d),
    o AS (SELECT c.lang, c.source, sum(n)::BIGINT AS whole FROM c JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY 1, 2),
    p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
            1 + (1000000000 * (coalesce(n, 0) + 2)) // (coalesce(o.whole, 0) + 2 * v) AS p, 1 + (1000000000 * (total + 2)) // (l.whole + 2 * v) AS q
        FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 10"""


ORACLES = {
    "op1_prefix_targets": PREFIX_TARGETS,
    "op6_near_dedup": NEAR_DEDUP,
    "op7_decontaminate": DECONTAMINATE,
    "op8_line_quality": line_quality(),
    "op11_filter_audit": FILTER_AUDIT,
    "op12_source_divergence": SOURCE_DIVERGENCE,
}
