"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"


def quality_measures(source: str) -> str:
    """CTE text: base(doc_id, text, ws, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    return rf"""
    raw AS (SELECT doc_id, coalesce(text, '') AS text,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_replace(l, '{_WS}', '', 'g') <> '') AS ls
            FROM {source}),
    win AS (SELECT doc_id, i, ws[i:i + 7] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM raw)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
    base AS (SELECT raw.doc_id, text, ws, len(ws) AS n_words,
                    length(regexp_replace(text, '{_WS}', '', 'g')) AS word_chars,
                    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                    coalesce(rep.n, 0) AS n_repeat_words
             FROM raw LEFT JOIN rep USING (doc_id)),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                    100 * n_symbols > 10 * word_chars
                    OR 100 * n_dup_lines > 60 * len(string_split(text, chr(10)))
                    OR strlen(regexp_replace(text, '{_WS}', '', 'g')) < 2 * n_words OR word_chars > 20 * n_words
                    OR 100 * len(list_filter(ws, lambda w: length(w) > 1 AND upper(w) = w AND lower(w) <> w)) > 40 * n_words
                    OR 100 * len(list_filter(ws, lambda w: NOT regexp_matches(w, '\p{{L}}'))) > 50 * n_words
                    OR 100 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > 30 * n_words
                    OR 100 * len(list_filter(ws, lambda w: w[1] = '<' AND w[-1] = '>')) > 20 * n_words AS rules_failed
               FROM base)"""


def clustering(rounds: int) -> str:
    """SQL of operator 13: a pair of CTEs a round."""
    nearest = lambda r: f"""near{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(n, (d, n)) AS cluster, min(d) AS distance
        FROM (SELECT vec_id, k.v, n, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT AS d FROM kept AS k, cen{r} AS c) GROUP BY vec_id, v)"""  # noqa: E731
    moves = lambda r: f"""cen{r + 1} AS MATERIALIZED (SELECT cen{r}.n, coalesce(m.v, cen{r}.v) AS v FROM cen{r} LEFT JOIN (
        SELECT cluster AS n, list(floor(s::DOUBLE / c)::BIGINT ORDER BY i) AS v FROM (
            SELECT cluster, i, sum(v[i]) AS s, count(*) AS c FROM near{r}, range(1, 65) AS t(i) GROUP BY cluster, i) GROUP BY cluster) AS m USING (n))"""  # noqa: E731
    steps = ", ".join(f"{nearest(r)}, {moves(r)}" for r in range(rounds))
    return f"""
    WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    cen0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS n, v FROM (SELECT * FROM kept ORDER BY sha256('2:' || vec_id) LIMIT 40)),
    {steps}, {nearest(rounds)}
    SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(cen{rounds}.v, ',')) AS centroid_sha256
    FROM near{rounds} JOIN cen{rounds} ON cluster = n"""


SQL = {
    "op2_quality_rules": f"""
    WITH {quality_measures("documents")}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rules_failed AS kept FROM judged""",
    "op4_substring_dedup": rf"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS ws FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS m FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
    dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY m) AS f FROM win) WHERE f < doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM dup),
    each AS (SELECT doc_id, p, ws[p] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op7_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
    FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)""",
    "op12_minhash_dedup": rf"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
    u AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
    met AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n, b.n AS m, count(*) AS common FROM u AS a JOIN u AS b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS (SELECT x, y FROM met WHERE 100 * common >= 80 * (n + m - common)),
    two AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
    reach AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT two.y, reach.root FROM reach JOIN two ON two.x = reach.node)
    SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM s JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) USING (doc_id)""",
    "op13_centroid_clustering": clustering(5),
    "op11_periodic_runs": rf"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS ws,
        xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) AS h FROM documents),
    a AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, 3 + (h // 10) % 8 AS k FROM w),
    t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE ws END AS ws FROM a),
    u AS (SELECT doc_id, n, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS i FROM t),
    same AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM u JOIN u AS v ON u.doc_id = v.doc_id AND u.x = v.x AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
    part AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same),
    long AS (SELECT doc_id, q, min(i) AS s, max(i) + q + 1 - min(i) AS l FROM part GROUP BY doc_id, q, g HAVING max(i) + q + 1 - min(i) >= greatest(6, 4 * q)),
    run AS (SELECT doc_id, s, l, min(q) AS q FROM long GROUP BY doc_id, s, l),
    of AS (SELECT doc_id, count(*) AS n_runs, arg_min((s, l, q), (-(l::DOUBLE / q), s, q)) AS b, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS r FROM run GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS c FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b[1] AS start, b[2] AS length, b[3] AS period, 1000 * b[2] // b[3] AS exponent_milli, sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
    FROM t LEFT JOIN of USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
