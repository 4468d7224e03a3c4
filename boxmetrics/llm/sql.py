"""Results of the operators that SQL can express, for DuckDB over the Parquet tables."""

from __future__ import annotations

from boxmetrics.llm import clustering, filter_audit, line_rules, secrets

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _spans(kind: str, rank: int, pattern: str, condition: str = "TRUE") -> str:
    """Matches of a pattern that meet a condition, with their places."""
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, upto - length(hit) AS start_at, upto AS end_at FROM (
        SELECT doc_id, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto
        FROM (
            SELECT doc_id, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM (
                SELECT doc_id, regexp_extract_all(t, {_text(pattern)}) AS hits,
                       string_split_regex(t, {_text(pattern)}) AS gaps
                FROM d WHERE regexp_matches(t, {_text(pattern)}))))
    WHERE {condition}"""


def op2() -> str:
    value = f"length(regexp_extract(hit, {_text(secrets.ASSIGNED)}, 1)) >= {secrets.LEAST_ASSIGNED}"
    mixed = "length(hit) >= 20 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')"
    listed = "string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, rank)"
    base = _spans("assign", 0, secrets.ASSIGN, value)
    base += " UNION ALL " + _spans("access", 1, secrets.ACCESS) + " UNION ALL " + _spans("hex", 2, secrets.HEX)
    weak = _spans("identifier", 3, "[A-Za-z0-9_]+", "regexp_full_match(hit, '[A-Z][A-Z0-9]{11,}')")
    weak += " UNION ALL " + _spans("string", 4, "[A-Za-z0-9+/]+", mixed)
    weak += " UNION ALL " + _spans("endpoint", 5, secrets.WEAK["endpoint"])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
weak AS (
    SELECT * FROM ({weak}) w
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id
                      AND w.start_at < b.end_at AND b.start_at < w.end_at)),
parts AS (
    SELECT doc_id, start_at, end_at, CASE kind WHEN 'access' THEN 'identifier' WHEN 'hex' THEN 'string'
                                       WHEN 'assign' THEN 'string' ELSE kind END AS part
    FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
linked AS (
    SELECT w.* FROM weak w
    WHERE EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.part <> w.kind
                  AND p.start_at <= w.end_at + {secrets.SCOPE} AND p.end_at >= w.start_at - {secrets.SCOPE})),
counts AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex, {listed} AS listed
    FROM base GROUP BY doc_id),
everything AS (
    SELECT doc_id, {listed} AS listed FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(c.listed, '')) AS base_sha256,
       coalesce(e.listed, '') AS spans
FROM d LEFT JOIN counts c USING (doc_id) LEFT JOIN everything e USING (doc_id)"""


def op4() -> str:
    split = (
        f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
        "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    )
    return f"""
WITH d AS (SELECT doc_id, {split} AS w FROM documents),
b AS (SELECT item_id, {split} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, w[i:i + 9] AS win, len(w[i:i + 9]) AS size
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
hits AS (
    SELECT doc_id, i, windows.size, item_id
    FROM (SELECT doc_id, i, size, w[i:i + size - 1] AS win
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes
          WHERE i + size - 1 <= len(w)) places
    JOIN windows ON windows.win = places.win AND windows.size = places.size),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op7() -> str:
    spaces = "'[\\x20\\x09-\\x0D]+'"
    filled = "regexp_matches(line, '[^\\x20\\x09-\\x0D]')"
    return f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t,
           list_filter(string_split_regex(coalesce(text, ''), {spaces}), lambda x: x <> '') AS w
    FROM documents),
windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 7]) AS n
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
repeated AS (
    SELECT doc_id, count(DISTINCT p) AS n
    FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (
    SELECT doc_id, line, len(list_filter(string_split_regex(line, {spaces}), lambda x: x <> '')) AS n,
           length(line) - length(regexp_replace(line, {_text(line_rules.SEPARATED)}, '', 'g')) AS bars,
           length(regexp_replace(line, {_text(line_rules.NOT_MARKS)}, '', 'g')) AS marks,
           length(regexp_replace(line, {spaces}, '', 'g')) AS size
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (
    SELECT doc_id, n, line, {filled} AS filled,
           (bars >= {line_rules.LEAST_BARS} AND bars * {line_rules.WORDS_PER_BAR} >= n)
           OR (n <= {line_rules.BOILERPLATE_WORDS} AND regexp_matches(line, {_text(line_rules.BOILERPLATE)}))
           OR marks * 100 > size * {line_rules.MOST_MARKS_PERCENT} AS removed
    FROM lines),
by_line AS (
    SELECT doc_id, CAST(coalesce(sum(n) FILTER (removed AND filled), 0) AS BIGINT) AS removed_words,
           count(*) FILTER (filled) - count(DISTINCT line) FILTER (filled) AS dup
    FROM judged GROUP BY doc_id),
counted AS (
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(t, {spaces}, '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           dup AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, removed_words AS n_removed_words
    FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN by_line USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND n_removed_words * 100 <= n_words * {line_rules.MOST_REMOVED_PERCENT} AS kept
FROM counted"""


def op12() -> str:
    spaces = "'[\\x20\\x09-\\x0D]+'"
    names = filter_audit.FILTERS
    failed = {
        "A": f"len(w) < {filter_audit.LEAST_WORDS}",
        "B": f"100 * list_unique(w) < {filter_audit.LEAST_DISTINCT_PERCENT} * len(w)",
        "C": f"100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {filter_audit.MOST_CAPITALS_PERCENT} * length(t)",
        "D": "regexp_matches(t, '[#$%&*|]')",
        "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)",
    }
    flags = ", ".join(f"CASE WHEN {test} THEN '{name}' ELSE '' END AS f{name}" for name, test in failed.items())
    letters = ", ".join(f"'{name}'" for name in names)
    return f"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           list_filter(string_split_regex(coalesce(text, ''), {spaces}), lambda x: x <> '') AS w
    FROM documents),
l AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
           max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, {flags} FROM d),
sets AS (
    SELECT part, {" || ".join(f"f{name}" for name in names)} AS failed, count(*) AS n,
           sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
letters AS (SELECT unnest([{letters}]) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
met AS (
    SELECT part, filter_order, step, failed, n, good, toxic,
           contains(failed, filter_order[step]) AS fails,
           regexp_matches(failed, '[' || filter_order[1:step] || ']') AS gone,
           step > 1 AND regexp_matches(failed, '[' || filter_order[1:greatest(step - 1, 1)] || ']') AS went,
           failed = filter_order[step] AS alone
    FROM sets, steps)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (fails AND NOT went), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (fails AND went), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (fails AND NOT went), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (fails AND NOT went), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(sum(n) FILTER (fails AND NOT went)) OVER (PARTITION BY part, filter_order[step]), 0) AS BIGINT)
           AS shapley
FROM met GROUP BY part, filter_order, step"""


def op13() -> str:
    """Each round is written out: distances to all centroids, then the means of the clusters."""
    count, rounds, scale = clustering.CENTROIDS, clustering.ROUNDS, clustering.SCALE
    size = clustering.COMPONENTS
    parts = [
        f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id,
           list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = {size}
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {size}),
c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY sha256('{clustering.SEED_PREFIX}' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c
    FROM kept ORDER BY sha256('{clustering.SEED_PREFIX}' || vec_id), v LIMIT {count})"""
    ]
    for number in range(rounds + 1):
        parts.append(f"""
a{number} AS MATERIALIZED (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, cluster := cluster)) AS nearest
    FROM (SELECT r, vec_id, v, cluster,
                 CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
          FROM kept, c{number})
    GROUP BY r)""")
        if number < rounds:
            parts.append(f"""
s{number + 1} AS (
    SELECT cluster, list(m ORDER BY i) AS c FROM (
        SELECT cluster, i, CAST(CASE WHEN sum(x) >= 0 THEN sum(x) // count(*)
                                     ELSE -((count(*) - 1 - sum(x)) // count(*)) END AS BIGINT) AS m
        FROM (SELECT nearest.cluster AS cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{number})
        GROUP BY cluster, i)
    GROUP BY cluster),
c{number + 1} AS MATERIALIZED (
    SELECT c{number}.cluster, coalesce(s{number + 1}.c, c{number}.c) AS c
    FROM c{number} LEFT JOIN s{number + 1} USING (cluster))""")
    return ",".join(parts) + f"""
SELECT vec_id, cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM (SELECT vec_id, nearest.cluster AS cluster, nearest.d AS distance FROM a{rounds})
JOIN c{rounds} USING (cluster)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secrets": op2(),
        "op4_decontamination": op4(),
        "op7_line_rules": op7(),
        "op12_filter_audit": op12(),
        "op13_clustering": op13(),
    }
