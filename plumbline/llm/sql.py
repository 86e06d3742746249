"""DuckDB SQL equivalent to the registered queries."""

from __future__ import annotations

from . import adaptive_quality as aq
from . import captures as cap
from . import chat_prefix as cp
from . import licence_rules as lr
from . import revisits as rv

# The class is written out: DuckDB's patterns know \\x09 as well, but not inside every function.
_SPACE = "[ \\x09-\\x0D]+"


def text_measures(table: str) -> str:
    """CTE bodies `words` and `measured` over the documents of `table`."""
    return f"""
    words AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS t,
               list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)),
                           lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l
        FROM {table}
    ), windows AS (
        SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
    ), twice AS (
        SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
    ), repeated AS (
        SELECT doc_id, sum(least(5, i - before))::BIGINT AS n_repeat_words
        FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -9) AS before FROM twice)
        GROUP BY doc_id
    ), counted AS (
        SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words,
               length(array_to_string(w, ''))::BIGINT AS word_chars,
               (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
               len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
               coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM words w LEFT JOIN repeated r ON w.doc_id = r.doc_id
    ), measured AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
    )"""


def judged(table: str) -> str:
    """CTE bodies up to `judged`, the measures with `kept`."""
    formulas = {name: formula.replace(" div ", " // ") for name, (formula, *_) in aq.RULES.items()}
    long = " UNION ALL ".join(
        f"SELECT lang, source, '{n}' AS rule, ({f})::BIGINT AS v FROM measured WHERE NOT base_failed"
        for n, f in formulas.items()
    )
    group = "PARTITION BY rule, lang, source"
    share = f"u * r * (s + {aq.PRIOR}) + {aq.PRIOR} * (v * r + {aq.PRIOR} * w)"
    points = ", ".join(
        f"min(bin) FILTER (100 * ({share}) >= {p} * (t + {aq.PRIOR}) * r * (s + {aq.PRIOR})) AS p{p}" for p in (10, 50, 85, 99)
    )
    ctes = [text_measures(table), f"""
    long AS ({long}),
    fine AS (
        SELECT rule, lang, source, (v >> d) << d AS bin, count(*)::HUGEINT AS n
        FROM (SELECT *, greatest(length(bin(v)) - 7, 0) AS d FROM long) GROUP BY ALL
    ), by_lang AS (SELECT rule, lang, bin, sum(n) AS n FROM fine GROUP BY ALL),
    by_rule AS (SELECT rule, bin, sum(n) AS n FROM fine GROUP BY ALL),
    grid AS (
        SELECT g.*, a.bin, coalesce(f.n, 0) AS n, coalesce(l.n, 0) AS m, a.n AS k
        FROM (SELECT DISTINCT rule, lang, source FROM fine) g JOIN by_rule a USING (rule)
        LEFT JOIN by_lang l ON l.rule = g.rule AND l.lang IS NOT DISTINCT FROM g.lang AND l.bin = a.bin
        LEFT JOIN fine f ON f.rule = g.rule AND f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source
            AND f.bin = a.bin
    ), upto AS (
        SELECT *, {", ".join(f"sum({c}) OVER ({group} ORDER BY bin) AS {x}, sum({c}) OVER ({group}) AS {y}"
                             for c, x, y in (("n", "u", "t"), ("m", "v", "s"), ("k", "w", "r")))} FROM grid
    ), quantiles AS (SELECT rule, lang, source, {points} FROM upto GROUP BY ALL)"""]
    joins, tests = [], ["NOT base_failed"]
    for i, (name, (_, upper, reach, has_low)) in enumerate(aq.RULES.items()):
        joins.append(f"""
        LEFT JOIN quantiles q{i} ON q{i}.rule = '{name}' AND q{i}.lang IS NOT DISTINCT FROM m.lang
             AND q{i}.source IS NOT DISTINCT FROM m.source""")
        value = f"(CASE WHEN base_failed THEN 0 ELSE {formulas[name]} END)::BIGINT"
        drop = f"greatest(length(bin({value})) - 7, 0)"
        own = f"(({value} >> {drop}) << {drop})"
        high, low = f"q{i}.p{upper}", f"q{i}.p10"
        tests.append(f"coalesce({own} <= {high} + {reach} * ({high} - q{i}.p50), true)")
        if has_low:
            tests.append(f"coalesce({own} >= {low} - {reach} * (q{i}.p50 - {low}), true)")
    ctes.append(f"""
    judged AS (SELECT m.*, {' AND '.join(tests)} AS kept FROM measured m {''.join(joins)})""")
    return ",".join(ctes)


def adaptive_quality() -> str:
    return f"""WITH {judged('documents')}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""


def water_filling() -> str:
    return """
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'))::BIGINT AS size,
               ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS u
        FROM documents
    ), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
    ), r AS (
        SELECT *, 3 * source_size AS cap,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
        FROM s
    ), ordered AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS j FROM r
    ), levels AS (
        SELECT j, w, cap, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
               / (sum(w) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
        FROM ordered
    ), t AS (
        SELECT source, source_size,
               least(cap::DOUBLE, w * (SELECT arg_min(level, j) FROM levels WHERE w * level <= cap)) AS target
        FROM r
    ), spec AS (
        SELECT *, least(floor(target / greatest(source_size, 1))::BIGINT, 3) AS whole FROM t
    ), placed AS (
        SELECT d.doc_id, d.size, source_size, target, whole, floor(target - whole * source_size)::BIGINT AS rest,
               coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY u, doc_id, d.size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
        FROM sized d JOIN spec s ON d.source IS NOT DISTINCT FROM s.source
    )
    SELECT doc_id, size, source_size, target,
           (size * whole + greatest(0, least(size, rest - reached)))::BIGINT AS taken
    FROM placed"""


def chat_prefix() -> str:
    def escaped(x: str) -> str:
        for plain, entity in cp.ENTITIES:
            x = f"replace({x}, '{plain}', '{entity}')"
        return x

    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
               count(*) OVER (PARTITION BY conv_id) AS n,
               length({escaped('text')}) + CASE role WHEN 'user' THEN {len(cp.USER + cp.USER_END)}
                   WHEN 'assistant' THEN {len(cp.ANSWER + cp.ANSWER_END)} ELSE 11 + length({escaped('role')}) END AS chars
        FROM turns
    ), run AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM placed)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
    FROM run GROUP BY conv_id"""


def near_vectors() -> str:
    """All pairs, as the tables that SQL is checked on are small; components by widening minima."""
    return """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    ), unit AS (
        SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
        WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b
          ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
    ), reach AS (
        SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    ), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a
    ), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
    FROM v LEFT JOIN degree d ON d.a = vec_id LEFT JOIN least l ON l.a = vec_id"""


def licence_rules() -> str:
    known = ", ".join(f"('{sentence}', '{ident}')" for ident, sentence in lr._distinct())
    unit = {"p": "\\n[ \\t\\r]*\\n", "q": "\\n"}
    cuts = ", ".join(
        f"regexp_split_to_array(regexp_replace(t, '{u}', chr(1), 'g'), '[.!?:;]+(?:[ \\t\\r\\n]+|$)|[\\x01]') AS {k}"
        for k, u in unit.items()
    )
    reads = []
    for k in unit:
        reads.append(f"""
    s_{k} AS (
        SELECT doc_id, i, replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), 'licence', 'license') AS s
        FROM (SELECT doc_id, unnest({k}) AS s, generate_subscripts({k}, 1) AS i FROM cut)
    ), seq_{k} AS (
        SELECT doc_id, string_agg('|' || ident || '|', '' ORDER BY i) AS r0
        FROM s_{k} JOIN known ON s = sentence GROUP BY doc_id
    )""")
        steps = f"seq_{k}"
        for n, (name, idents) in enumerate(lr.RULES):
            rule = lr.rule_text(idents)
            reads.append(f"""
    m_{k}{n} AS (
        SELECT * EXCLUDE (r{n}), contains(r{n}, '{rule}') AS f{n}, replace(r{n}, '{rule}', '#') AS r{n + 1}
        FROM {steps}
    )""" if n else f"""
    m_{k}0 AS (SELECT *, contains(r0, '{rule}') AS f0, replace(r0, '{rule}', '#') AS r1 FROM {steps})""")
            steps = f"m_{k}{n}"
        found = ", ".join(f"CASE WHEN f{n} THEN '{name}' END" for n, (name, _) in enumerate(lr.RULES))
        reads.append(f"""
    done_{k} AS (
        SELECT doc_id, r0, [{found}] AS found, len(regexp_extract_all(r{len(lr.RULES)}, '\\|[^|]+\\|')) AS rest
        FROM {steps}
    )""")
    return f"""
    WITH known(sentence, ident) AS (VALUES {known}),
    cut AS (
        SELECT doc_id, {cuts} FROM (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '(?m)^[ \\t]*(?:/\\*+|\\*+/?|//+|#+|;+|--+)', '', 'g') AS t
            FROM documents)
    ), {','.join(reads)}
    SELECT d.doc_id,
           coalesce(array_to_string(list_sort(list_distinct(list_filter(
               list_concat(coalesce(p.found, []), coalesce(q.found, [])), lambda x: x IS NOT NULL))), ','), '') AS licences,
           coalesce(p.r0, '') || '/' || coalesce(q.r0, '') AS sentences,
           CASE WHEN q.r0 IS NULL THEN coalesce(p.rest, 0) WHEN p.r0 IS NULL THEN q.rest
                ELSE least(p.rest, q.rest) END::BIGINT AS unmatched
    FROM documents d LEFT JOIN done_p p ON d.doc_id = p.doc_id LEFT JOIN done_q q ON d.doc_id = q.doc_id"""


def revisits() -> str:
    def headers(fields: list[tuple[str, str, str]]) -> str:
        items = ", ".join(
            f"CASE WHEN {when} THEN {{'name': '{name}', 'value': {value}}} END" for when, name, value in fields
        )
        return f"list_filter([{items}], lambda x: x IS NOT NULL)"

    def first(table: str, name: str) -> str:
        return f"list_filter({table}.headers, lambda x: lower(x.name) = '{name}')[1].value"

    barred = ", ".join(f"'{x}'" for x in rv.HOP_BY_HOP + rv.CONTENT_BOUND)
    url = rv._URL.replace("\\\\", "\\")
    good = ", ".join(f"'{x}'" for x in rv.RESOLVED)
    return f"""
    WITH base AS (
        SELECT page_id, url, md5(html) AS digest, strlen(html)::BIGINT AS n_bytes,
               ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT AS h FROM pages
    ), timed AS (SELECT *, {cap.FIRST_AT} AS first_at FROM base
    ), made AS (
        SELECT concat('r', page_id) AS record_id, 'response' AS kind, url, first_at AS captured_at, 200 AS status,
               {headers(cap.RESPONSE)} AS headers, digest AS payload_digest FROM timed
        UNION ALL
        SELECT concat('q', page_id), 'response', concat(url, '#again'), first_at + 500000, 200,
               {headers(cap.CHANGED)}, reverse(digest) FROM timed WHERE h % 4 = 0
        UNION ALL
        SELECT concat('v', page_id, '-', i), 'revisit', regexp_replace(url, '^https?://(www[.])?', 'HTTP://www.'),
               first_at + i * 400000 - 100000, 304, {headers(cap.REVISIT)}, NULL
        FROM timed, (VALUES (0), (1), (2)) AS n(i) WHERE (h + i) % 3 <> 2
    ), parts AS (
        SELECT *, regexp_replace(lower(regexp_extract(trim(url), '{url}', 1)), '^www[0-9]*\\.|:(?:80|443)$', '', 'g') AS host,
               regexp_replace(regexp_extract(trim(url), '{url}', 2), '/+$', '') AS path,
               array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(url), '{url}', 3), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(lower(x), '{rv.TRACKING}'))), '&') AS query
        FROM made
    ), c AS (
        SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM parts
    ), latest AS (
        SELECT v.record_id, max({{'at': r.captured_at, 'id': r.record_id}}) AS key
        FROM c v JOIN c r ON v.canonical_url = r.canonical_url AND r.captured_at < v.captured_at
        WHERE v.kind = 'revisit' AND r.kind = 'response' GROUP BY v.record_id
    ), joined AS (
        SELECT v.record_id, v.canonical_url, v.captured_at, v.headers AS new, r.headers AS old, r.status,
               r.record_id AS refers_to, r.captured_at AS refers_to_at, r.payload_digest,
               {first('r', 'etag')} AS old_tag, {first('v', 'etag')} AS new_tag,
               {first('r', 'last-modified')} AS old_date, {first('v', 'last-modified')} AS new_date,
               list_transform(string_split(lower(coalesce({first('v', 'connection')}, '')), ','), lambda x: trim(x)) AS listed
        FROM c v LEFT JOIN latest l ON l.record_id = v.record_id LEFT JOIN c r ON r.record_id = l.key.id
        WHERE v.kind = 'revisit'
    ), judged AS (
        SELECT *, CASE WHEN refers_to IS NULL THEN 'no_earlier_response'
            WHEN regexp_replace(old_tag, '^W/', '') = regexp_replace(new_tag, '^W/', '') THEN 'same_etag'
            WHEN old_tag IS NOT NULL AND new_tag IS NOT NULL THEN 'other_etag'
            WHEN old_date = new_date THEN 'same_date'
            WHEN old_date IS NOT NULL AND new_date IS NOT NULL THEN 'other_date'
            WHEN new_tag IS NULL AND new_date IS NULL THEN 'no_validator' ELSE 'validator_missing' END AS outcome,
            list_filter(new, lambda x: NOT list_contains(list_concat([{barred}], listed), lower(x.name))) AS update_
        FROM joined
    ), merged AS (
        SELECT *, outcome IN ({good}) AS good, list_transform(update_, lambda x: lower(x.name)) AS names FROM judged
    )
    SELECT record_id, canonical_url, captured_at, outcome, refers_to, refers_to_at,
           CASE WHEN good THEN status END AS status, CASE WHEN good THEN payload_digest END AS payload_digest,
           array_to_string(list_sort(list_transform(
               CASE WHEN good THEN list_concat(list_filter(old, lambda x: NOT list_contains(names, lower(x.name))), update_) ELSE new END,
               lambda x: lower(x.name) || ': ' || x.value)), chr(10)) AS headers
    FROM merged"""


def source_divergence() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {lower} AS t
        FROM documents
    ), w AS (
        SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
    ), kept AS (
        SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3
    ), c AS (
        SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
    ), g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
    s AS (
        SELECT g.lang, g.source, v, lang_n, coalesce(sum(c.n), 0) AS size
        FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL
    ), p AS (
        SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n,
            1 + 1000000000 * (coalesce(c.n, 0) + 1) // (size + v) AS p, 1 + 1000000000 * (total + 1) // (lang_n + v) AS q
        FROM s JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
    ), pair AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), every AS (
        SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
        FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source
        LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """


def hard_negatives() -> str:
    return """
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scores AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
        FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q) AND a.vec_id <> b.vec_id
    ), positive AS (
        SELECT anchor_id, id, score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    ), negative AS (
        SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
        FROM positive AS p JOIN scores AS s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    )
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM negative WHERE rank <= 10
    """
