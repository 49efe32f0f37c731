"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from locuspark.llm import license_rules, licenses
from locuspark.llm.quality_rules import BOUND, DEVIATIONS, HOST_RATE, LEAST_WORDS, REPEAT_PERCENT, RULES
from locuspark.llm.secret_scan import BARE, BARE_DIFFERENT, LIVE_REPOSITORIES, WIDE_OWNERS, WIDE_REPOSITORIES

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: int, pattern: str, least: int, group: int) -> str:
    """doc, kind, start, end, value of one kind's matches: pieces between matches give the places."""
    return f"""
    SELECT rid, doc_id, owner, repository, {kind} AS kind, pos - len_m AS s, pos AS e, value FROM (
      SELECT rid, doc_id, owner, repository, value, length(m) AS len_m,
             sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS pos
      FROM (SELECT rid, doc_id, owner, repository, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g,
                   unnest(regexp_extract_all(text, '{pattern}', {group})) AS value
            FROM (SELECT rid, doc_id, owner, repository, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM d WHERE regexp_matches(text, '{pattern}'))))
    WHERE length(value) >= {least}"""


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS owner, coalesce(length(source) || ':' || source, '-') || coalesce('=' || lang, '') AS repository FROM documents),
base AS ({_matches(0, _ASSIGN, 8, 2)} UNION ALL {_matches(1, "AKIA[A-Z0-9]+", 16, 0)} UNION ALL {_matches(2, "[0-9a-f]{32,}", 32, 0)}),
bare AS (SELECT * FROM ({_matches(3, BARE, 16, 0)}) b
         WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {BARE_DIFFERENT}
           AND NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = b.rid AND x.s < b.e AND b.s < x.e)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
stats AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM cand GROUP BY value),
judged AS (SELECT cand.*, owners, repositories, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS shown FROM cand JOIN stats USING (value)),
per AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               string_agg(shown, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(shown, ',' ORDER BY s, kind, e) FILTER (kind < 3 OR (owners = 1 AND repositories <= {LIVE_REPOSITORIES})) AS spans,
               count(*) FILTER (kind = 3 AND owners = 1 AND repositories <= {LIVE_REPOSITORIES}) AS n_live, count(*) FILTER (owners >= {WIDE_OWNERS} OR repositories >= {WIDE_REPOSITORIES}) AS n_wide, count(*) FILTER (owners = 1) AS n_single, max(owners) AS most_owners, max(repositories) AS most_repositories,
               string_agg(shown || ':' || CASE WHEN owners >= {WIDE_OWNERS} OR repositories >= {WIDE_REPOSITORIES} THEN 'wide' WHEN owners = 1 AND repositories <= {LIVE_REPOSITORIES} THEN 'live' WHEN owners = 1 THEN 'single' ELSE 'shared' END, ',' ORDER BY s, kind, e) FILTER (kind < 3 OR (owners = 1 AND repositories <= {LIVE_REPOSITORIES})) AS classes
        FROM judged GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_wide, 0) AS n_wide, coalesce(n_single, 0) AS n_single, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories, coalesce(classes, '') AS classes
FROM d LEFT JOIN per USING (rid)
"""

_FAILS = {"few_words": f"n_words < {LEAST_WORDS}", "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words", "dup_lines": "2 * n_dup_lines > n_lines"}


def _shrunk(r: str) -> str:
    """The posterior rate, held within the host's own limits, and its lower bound, as a struct."""
    z2, f = float(DEVIATIONS * DEVIATIONS), f"f_{r}"
    weight = f"least(greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * noise, 1e-9) - 1, 1.0), 1e6)"
    width = f"{DEVIATIONS} * sqrt({f} * (documents - {f}) / documents + {z2 / 4})"
    rate = f"greatest(({f} + {z2 / 2} - {width}) / (documents + {z2}), least(({f} + {z2 / 2} + {width}) / (documents + {z2}), ({f} + {weight} * m_{r}) / (documents + {weight})))"
    return f"{rate} AS p_{r}, p_{r} - {BOUND} * sqrt(p_{r} * (1 - p_{r}) / (documents + {weight} + 1)) AS b_{r}"


OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source AS host FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY rid),
m AS (SELECT rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN rep USING (rid)),
hosts AS (SELECT host, count(*) AS documents, {", ".join(f"count(*) FILTER ({c}) AS f_{r}" for r, c in _FAILS.items())} FROM m GROUP BY host),
prior AS (SELECT avg(1 / documents) AS noise, {", ".join(f"avg(f_{r} / documents) AS m_{r}, var_pop(f_{r} / documents) AS v_{r}" for r in RULES)} FROM hosts),
p AS (SELECT host, documents, {", ".join(map(_shrunk, RULES))} FROM hosts, prior),
v AS (SELECT host, greatest({", ".join(f"p_{r}" for r in RULES)}) AS rate, greatest({", ".join(f"b_{r}" for r in RULES)}) AS least_rate FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_FAILS["few_words"]} OR {_FAILS["repeats"]}) AS base_failed,
       NOT ({_FAILS["few_words"]} OR {_FAILS["repeats"]}) AND NOT least_rate > {HOST_RATE} AS kept, m.host, least_rate > {HOST_RATE} AS host_rejected, round(rate, 6) AS host_rate, round(least_rate, 6) AS host_least
FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host
"""

OP2 = """
WITH f AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p
      FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
      FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM f, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT rid, s.n, i, item_id FROM s JOIN p ON s.n = p.n AND s.p = p.p),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM h, range(13) r(k) WHERE k < n GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM f LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


def op11() -> str:
    """Every rule on every text that has its gates, and the levels one after the other."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({r['rule']}, {r['level']}, {quoted(r['label'])}, {quoted(' ' + r['gate'] + ' ')}, [{', '.join(map(quoted, r['more']))}]::VARCHAR[], {quoted(r['pattern'])})" for r in licenses.table())
    base = ", ".join(f"({-1 - n}, -1, {quoted(label)}, {quoted(licenses.spelled(phrase))}, []::VARCHAR[], {quoted(licenses.spelled(phrase))})" for n, (phrase, label) in enumerate(licenses.BASE.items()))
    inside = "e.rid = d.rid AND e.s <= d.s AND e.e >= d.e AND (e.s < d.s OR e.e > d.e OR e.rule < d.rule)"
    levels, before = [], "SELECT NULL::BIGINT AS rid, 0 AS s, 0 AS e WHERE false"
    for n in range(len(license_rules.LEVELS)):
        levels.append(f"a{n} AS (SELECT * FROM found d WHERE level = {n} AND NOT EXISTS (SELECT 1 FROM ({before}) k WHERE k.rid = d.rid AND k.s < d.e AND d.s < k.e))")
        levels.append(f"k{n} AS (SELECT * FROM a{n} d WHERE NOT EXISTS (SELECT 1 FROM a{n} e WHERE {inside}))")
        before = " UNION ALL ".join(f"SELECT rid, s, e FROM k{i}" for i in range(n + 1))
    kept = " UNION ALL ".join(f"SELECT * FROM k{n}" for n in range(len(license_rules.LEVELS)))
    score = "CASE level " + " ".join(f"WHEN {n} THEN {x!r}::DOUBLE" for n, x in enumerate(license_rules.LEVELS)) + " END"
    return f"""
WITH r(rule, level, label, gate, more, pattern) AS (VALUES {rules}, {base}),
d AS (SELECT row_number() OVER () AS rid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.SEPARATORS}', '  ', 'g')) AS w FROM documents),
t AS (SELECT rid, doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS t FROM d),
open AS (SELECT rid, t, r.* FROM t JOIN r ON contains(t, gate) AND len(list_filter(more, lambda g: NOT contains(t, g))) = 0),
ms AS (SELECT rid, rule, level, label, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS gs FROM open WHERE regexp_matches(t, pattern)),
one AS (SELECT rid, rule, level, label, unnest(range(len(ms))) AS i, unnest(list_transform(ms, lambda m: (length(m) - length(replace(m, ' ', ''))) // 2)) AS own, unnest(list_transform(gs[:len(ms)], lambda m: (length(m) - length(replace(m, ' ', ''))) // 2)) AS gap FROM ms),
placed AS (SELECT rid, rule, level, label, own, sum(gap + own) OVER (PARTITION BY rid, rule ORDER BY i) AS e FROM one),
found AS (SELECT rid, rule, level, label, e - own AS s, e FROM placed WHERE level >= 0),
base AS (SELECT rid, label, e - own AS s FROM placed WHERE level < 0),
{", ".join(levels)},
kept AS ({kept}),
b AS (SELECT rid, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
k AS (SELECT rid, count(*) AS n_kept, max({score}) AS score, string_agg(label || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, e DESC, rule) AS spans FROM kept GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM kept) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_found FROM found GROUP BY rid)
SELECT doc_id, CAST((length(t) - length(replace(t, ' ', ''))) // 2 AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score, coalesce(n_kept, 0) AS n_kept, coalesce(n_found, 0) - coalesce(n_kept, 0) AS n_suppressed, coalesce(spans, '') AS spans
FROM t LEFT JOIN b USING (rid) LEFT JOIN k USING (rid) LEFT JOIN l USING (rid) LEFT JOIN n USING (rid)
"""


OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, CAST(length(regexp_replace(t, '[A-Za-z]+', 'a', 'g')) AS BIGINT) AS n, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             coalesce(array_to_string(u[:least(h1 % (n + 1), h2 % (n + 1))], ''), '') AS p, coalesce(array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], ''), '') AS m, coalesce(array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], ''), '') AS s FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
