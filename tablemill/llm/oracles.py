"""SQL for DuckDB that the queries of this package must agree with."""

from __future__ import annotations

from collections.abc import Sequence

from tablemill.llm.fingerprints import BRANCH_DIGITS, LEAF_END, SECTION_END
from tablemill.llm.quality import CLASSES, OTHER, SYMBOLS, QualityRules
from tablemill.llm.sharding import ShardPlan, fill_table
from tablemill.llm.url_filters import Rule

# Words of a text: what is left of it between runs of white space.
WORDS = r"list_filter(regexp_split_to_array(COALESCE({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sharding(plan: ShardPlan) -> str:
    """Rows of one id are spread by source too if they are more than the hot share of an even shard."""
    table = ",".join(map(str, fill_table(plan.shards, plan.slots)))
    names = ", ".join(map(_text, plan.shards))

    def number(*parts: str) -> str:
        joined = " || '/' || ".join(f"COALESCE('=' || CAST({p} AS VARCHAR), 'null')" for p in parts)
        return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"

    return f"""
    WITH t AS (SELECT unnest(string_split({_text(table)}, ',')) AS k, generate_subscripts(string_split({_text(table)}, ','), 1) - 1 AS slot),
    n AS (SELECT doc_id, source, COUNT(*) OVER (PARTITION BY doc_id) AS own, COUNT(*) OVER () AS total FROM documents),
    p AS (
        SELECT doc_id, source,
            CASE WHEN own > total * {plan.hot_share} / {len(plan.shards)} THEN {number("doc_id", "source")} ELSE {number("doc_id")} END % {plan.slots} AS slot
        FROM n
    )
    SELECT p.doc_id, p.source, CAST(p.slot AS INTEGER) AS slot, [{names}][CAST(t.k AS INTEGER) + 1] AS shard FROM p JOIN t USING (slot)
    """


MIXING = rf"""
WITH d AS (
    SELECT doc_id, source, CAST(len({WORDS.format(text="text")}) AS BIGINT) AS size, md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
s AS (SELECT source, SUM(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, CAST(source_size AS DOUBLE) AS ss, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM s),
f AS (SELECT *, no % 3 + 1 AS weight, 3 * ss / (no % 3 + 1) AS full_at FROM w),
l AS (
    SELECT *, (SUM(ss) OVER () - COALESCE(SUM(3 * ss) OVER before, 0)) / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER before, 0)) AS level
    FROM f WINDOW before AS (ORDER BY full_at, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
g AS (SELECT *, (SELECT arg_min(level, full_at) FROM l WHERE full_at >= level) AS own FROM l),
t AS (SELECT source, CAST(ss AS BIGINT) AS source_size, LEAST(3 * ss, COALESCE(own * weight, 3 * ss)) AS target FROM g),
q AS (SELECT *, LEAST(CAST(FLOOR(target + 0.5) AS BIGINT), 3 * source_size) AS quota FROM t),
o AS (
    SELECT d.*, q.source_size, q.target, q.quota // GREATEST(q.source_size, 1) AS passes, q.quota % GREATEST(q.source_size, 1) AS rest,
        SUM(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
    CAST(passes * size + GREATEST(LEAST(start + size, rest) - LEAST(start, rest), 0) AS BIGINT) AS taken
FROM o
"""


def url_filters(rules: Sequence[Rule]) -> str:
    """Pages of the given tables state no links, so the usual redirects alone connect urls there.

    Stated links are read as the operator does, but for `.` and `..` in relative ones.
    """
    listed = ", ".join(f"({_text(r.host)}, {_text(r.path)}, {_text(r.host + r.path)}, {_text(r.verdict)})" for r in rules)
    return rf"""
    WITH RECURSIVE rules(rhost, rpath, rule, said) AS (VALUES {listed}),
    p AS (
        SELECT page_id, url, html,
            translate(regexp_extract(COALESCE(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(COALESCE(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
            regexp_extract(COALESCE(url, ''), '^[^?#]*\?([^#]*)', 1, 's') AS query
        FROM pages
    ),
    c AS (
        SELECT *, list_aggregate(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), 'string_agg', '&') AS kept FROM p
    ),
    fits AS (SELECT DISTINCT host, path, rule, said FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
    best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said FROM fits GROUP BY host, path),
    j AS (
        SELECT c.*, best.rule, best.said,
            CASE WHEN c.host <> '' THEN 'https://' || regexp_replace(c.host, '^www\.', '') || regexp_replace(c.path, '/+$', '')
                || CASE WHEN COALESCE(kept, '') <> '' THEN '?' || kept ELSE '' END END AS alias
        FROM c LEFT JOIN best USING (host, path)
    ),
    tags AS (
        SELECT url, replace(regexp_extract(tag, '(?:href\s*=\s*|url\s*=\s*)["'']?([^"''\s>]+)', 1, 'i'), '&amp;', '&') AS link
        FROM (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?(?:-->|\z)', '', 'gs'),
            '<(?:link|meta)\b[^>]*(?:canonical|http-equiv\s*=\s*["'']?refresh)[^>]*>', 0, 'i')) AS tag FROM pages)
    ),
    linked AS (
        SELECT url, link, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') AS site,
            regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM tags
    ),
    stated AS (
        SELECT url AS a, CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN link WHEN scheme = '' OR site = '' THEN NULL
            WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN scheme || '://' || site || link
            WHEN starts_with(link, '?') THEN scheme || '://' || site || path || link
            WHEN link <> '' AND NOT starts_with(link, '#') AND NOT regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:')
                THEN scheme || '://' || site || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || link END AS b
        FROM linked
    ),
    ways AS (
        SELECT a, b FROM (SELECT url AS a, alias AS b FROM j UNION SELECT a, b FROM stated) WHERE a IS NOT NULL AND b <> '' AND a <> b
    ),
    both_ways AS (SELECT a, b FROM ways UNION SELECT b, a FROM ways),
    bad(url) AS (SELECT DISTINCT url FROM j WHERE said = 'block' AND url IS NOT NULL UNION SELECT b FROM bad JOIN both_ways ON bad.url = both_ways.a)
    SELECT page_id, host, path, rule,
        COALESCE(said, CASE WHEN url IN (SELECT url FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
    FROM j
    """


def _cut(text: str, ends: str, place: str) -> str:
    """The text cut behind each match of `ends`; `place` names the lambda's variables."""
    cut = f"string_split(regexp_replace({text}, '({ends})', '\\1' || chr(0), 'g'), chr(0))"
    return f"list_filter({cut}, lambda {place}, {place}_i: {place} <> '' OR {place}_i = 1)"


def _short(hashes: str) -> str:
    return f"list_transform({hashes}, lambda h: h[1:{BRANCH_DIGITS}])"


def _compared(a: str, b: str, out: str) -> str:
    """Likeness of two fingerprints' branches, and the sections and paragraphs only the first has, by levels."""
    only = lambda x, y: f"list_filter({x}, lambda v: NOT list_contains({y}, v))"
    both = lambda x, y: f"list_filter({x}, lambda v: list_contains({y}, v))"
    below = lambda x, mark: f"list_distinct(flatten(list_transform({x}, lambda v: string_split(v[{BRANCH_DIGITS + 2}:], '{mark}'))))"
    leaves = lambda x: f"COALESCE(list_sum(list_transform({x}, lambda v: length(v) - length(translate(v, ',|', '')) + 1)), 0)::BIGINT"
    return f"""
{out}_s AS (SELECT doc_id, {a} AS ra, {b} AS rb, list_distinct(string_split({a}[66:], ';')) AS a, list_distinct(string_split({b}[66:], ';')) AS b FROM sides),
{out}_p AS (SELECT doc_id, ra, rb, {leaves(both("a", "b"))} AS shared, len({only("a", "b")})::BIGINT AS sections,
    {below(only("a", "b"), "|")} AS a, {below(only("b", "a"), "|")} AS b FROM {out}_s),
{out}_l AS (SELECT doc_id, ra, rb, shared + {leaves(both("a", "b"))} AS shared, sections, len({only("a", "b")})::BIGINT AS paragraphs,
    {below(only("a", "b"), ",")} AS a, {below(only("b", "a"), ",")} AS b FROM {out}_p),
{out} AS (SELECT doc_id, ra[:64] = rb[:64] AS same, sections, paragraphs,
    CASE WHEN ra[:64] = rb[:64] THEN 1.0::DOUBLE ELSE ROUND(2 * (shared + len({both("a", "b")}))::DOUBLE / (2 * shared + len(a) + len(b)), 6) END AS near FROM {out}_l)"""


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
ring AS (
    SELECT doc_id, text, COALESCE(lead(text) OVER w, first_value(text) OVER w) AS next_text, COALESCE(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
    FROM d WINDOW w AS (ORDER BY doc_id DESC)
),
e AS (
    SELECT doc_id, next_id, length(text) AS n_chars, text,
        substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited
    FROM ring
),
texts AS (SELECT doc_id, 'own' AS kind, text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e),
leaves AS (
    SELECT doc_id, kind, list_transform({_cut("replace(replace(text, chr(1), chr(1) || chr(2)), chr(0), chr(1) || chr(3))", SECTION_END, "s")},
        lambda s: list_transform({_cut("s", chr(92) + "n", "p")}, lambda p: list_transform({_cut("p", LEAF_END, "x")}, lambda x: sha256(x)))) AS t
    FROM texts
),
lines AS (SELECT doc_id, kind, t, list_transform(t, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, '')))) AS g FROM leaves),
hashed AS (SELECT doc_id, kind, t, g, list_transform(g, lambda s: sha256(array_to_string(s, ''))) AS h FROM lines),
prints AS (
    SELECT doc_id, kind, sha256(array_to_string(h, '')) || ':' || array_to_string(list_transform(t, lambda s, i: h[i][1:{BRANCH_DIGITS}] || '=' ||
        array_to_string(list_transform(s, lambda p, j: g[i][j][1:{BRANCH_DIGITS}] || '>' || array_to_string({_short("p")}, ',')), '|')), ';') AS print
    FROM hashed
),
sides AS (
    SELECT e.doc_id, n_chars, edited, a.print AS a, b.print AS b, c.print AS c FROM e JOIN prints a ON a.kind = 'own' AND a.doc_id = e.doc_id
    JOIN prints b ON b.kind = 'edited' AND b.doc_id = e.doc_id JOIN prints c ON c.kind = 'own' AND c.doc_id = e.next_id
),{_compared("a", "b", "edit")},{_compared("a", "c", "beside")}
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, sides.a AS fingerprint, sides.b AS edited_fingerprint, edit.near AS near_edited, beside.near AS near_next,
    CASE WHEN edit.same THEN 0 ELSE edit.sections END AS changed_sections, CASE WHEN edit.same THEN 0 ELSE edit.paragraphs END AS changed_paragraphs
FROM sides JOIN edit USING (doc_id) JOIN beside USING (doc_id)
"""


def quality(rules: QualityRules) -> str:
    """Base measures by rows of words; histograms as rows of (document, kind, place, count)."""
    lists = ", ".join(f"({_text(k)}, {_text(w)}, {n})" for k, v in rules.common.items() for n, w in enumerate(v.split(), 1))
    longest = max(len(v.split()) for v in rules.common.values())
    names = ", ".join(map(_text, rules.common))
    taken = [f"length(text) - length(regexp_replace(text, {_text(p + '+')}, '', 'g'))" for p in CLASSES.values()]
    rest = f"length(text) - ({' + '.join(taken)})"
    return rf"""
    WITH d AS (
        SELECT doc_id, COALESCE(text, '') AS text, CASE WHEN lang IN ({names}) THEN lang ELSE {_text(OTHER)} END AS key,
            {WORDS.format(text="text")} AS words, list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
        FROM documents
    ),
    placed AS (SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM d),
    windows AS (SELECT doc_id, i, x, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
    again AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, x, y, z) AS c FROM windows WHERE z IS NOT NULL),
    covered AS (SELECT doc_id, COUNT(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again WHERE c > 1) GROUP BY doc_id),
    base AS (
        SELECT d.doc_id, key, length(text) AS chars, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            (length(text) - length(regexp_replace(text, '{SYMBOLS}+', '', 'g')))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, COALESCE(n, 0)::BIGINT AS n_repeat_words
        FROM d LEFT JOIN covered USING (doc_id)
    ),
    classes AS (SELECT doc_id, key, unnest([{", ".join([*taken, rest])}]) AS c, unnest(range({len(taken) + 1})) AS place FROM d),
    listed(key, word, place) AS (VALUES {lists}),
    spoken AS (SELECT doc_id, key, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '')) AS word FROM d),
    met AS (SELECT doc_id, key, COALESCE(place, {longest + 1}) AS place, COUNT(*) AS c FROM spoken LEFT JOIN listed USING (key, word) GROUP BY ALL),
    common AS (
        SELECT doc_id, key, place, COALESCE(c, 0) AS c FROM (SELECT doc_id, key, unnest(range(1, {longest + 2})) AS place FROM d) LEFT JOIN met USING (doc_id, key, place)
    ),
    counts AS (SELECT *, 'classes' AS kind FROM classes UNION ALL SELECT doc_id, key, c, place, 'common' FROM common),
    refs AS (SELECT key, kind, place, SUM(c) / SUM(SUM(c)) OVER (PARTITION BY key, kind) AS q FROM counts GROUP BY key, kind, place),
    shares AS (SELECT doc_id, kind, SUM(c) OVER (PARTITION BY doc_id, kind) AS n, c / SUM(c) OVER (PARTITION BY doc_id, kind) AS p, q FROM counts JOIN refs USING (key, kind, place)),
    far AS (
        SELECT doc_id, kind, n, ROUND(SQRT(GREATEST(SUM(CASE WHEN p > 0 THEN p * LOG2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * LOG2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 4) AS far
        FROM shares WHERE n > 0 GROUP BY doc_id, kind, n
    ),
    known AS (
        SELECT base.*, n_words < {rules.least_words_base} OR 100 * n_repeat_words > {rules.most_repeated_percent} * n_words AS base_failed,
            CASE WHEN chars >= {rules.least_chars} THEN a.far END AS class_distance,
            CASE WHEN b.n >= {rules.least_words} AND key <> {_text(OTHER)} THEN b.far END AS word_distance
        FROM base LEFT JOIN far a ON a.doc_id = base.doc_id AND a.kind = 'classes' LEFT JOIN far b ON b.doc_id = base.doc_id AND b.kind = 'common'
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
        NOT base_failed AND COALESCE(class_distance, 0) <= {rules.most_class_distance} AND COALESCE(word_distance, 0) <= {rules.most_word_distance} AS kept
    FROM known
    """

LEXICAL_SEARCH = r"""
WITH doc AS (
    SELECT row_number() OVER () AS row_no, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
item AS (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS times FROM item GROUP BY ALL),
size AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM doc WHERE len(terms) > 0),
held AS (
    SELECT row_no, doc_id, n, term, count(*) AS tf
    FROM (SELECT row_no, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM held GROUP BY term), size),
gain AS (
    SELECT row_no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS gain
    FROM held JOIN weight USING (term), size),
scored AS (
    SELECT item, item_id, row_no, doc_id, sum(times * gain)::BIGINT AS score
    FROM asked JOIN gain USING (term) GROUP BY ALL HAVING sum(times * gain) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 20
"""
