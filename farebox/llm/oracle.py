"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

_CHAT = r"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS i,
        replace(coalesce(role, 'user'), '<|', '<\|') AS role, replace(coalesce(text, ''), '<|', '<\|') AS body,
        coalesce(role, 'user') AS r0, coalesce(text, '') AS t0
    FROM conversations WHERE conv_id IS NOT NULL),
opening AS (SELECT conv_id, r0, t0 FROM turns WHERE i = 1),
ranked AS (SELECT conv_id, min(conv_id) OVER (PARTITION BY r0, t0) AS leader FROM opening),
pairs AS (SELECT leader AS chosen_id, conv_id AS rejected_id FROM ranked WHERE conv_id > leader
    UNION SELECT a.conv_id, b.conv_id FROM opening a JOIN opening b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
split AS (SELECT p.chosen_id, p.rejected_id, least(c.n, r.n) AS short,
        min(x.i) FILTER (x.r0 <> y.r0 OR x.t0 <> y.t0) - 1 AS differ
    FROM pairs p JOIN sizes c ON c.conv_id = p.chosen_id JOIN sizes r ON r.conv_id = p.rejected_id
    JOIN turns x ON x.conv_id = p.chosen_id JOIN turns y ON y.conv_id = p.rejected_id AND y.i = x.i
    GROUP BY ALL),
cuts AS (SELECT chosen_id, rejected_id, coalesce(differ, short) AS shared FROM split),
shown AS (SELECT *, '<|im_start|>' || role || chr(10) AS head, body || '<|im_end|>' AS rest FROM turns),
sides AS (SELECT c.chosen_id, c.rejected_id, c.shared, s.side, t.*
    FROM cuts c CROSS JOIN (VALUES ('c'), ('r')) s(side)
    JOIN shown t ON t.conv_id = CASE s.side WHEN 'c' THEN c.chosen_id ELSE c.rejected_id END),
placed AS (SELECT *, i > shared AS behind, coalesce(sum(length(head) + length(rest) + 1) OVER (
        PARTITION BY chosen_id, rejected_id, side, i > shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM sides)
SELECT chosen_id, rejected_id, CAST(any_value(shared) AS INTEGER) AS shared_turns,
    coalesce(string_agg(head || rest || chr(10), '' ORDER BY i) FILTER (side = 'c' AND NOT behind), '') AS prompt,
    coalesce(string_agg(head || rest || chr(10), '' ORDER BY i) FILTER (side = 'c' AND behind), '') AS chosen,
    coalesce(string_agg((pos + length(head))::BIGINT || '-' || (pos + length(head) + length(rest))::BIGINT, ',' ORDER BY i)
        FILTER (side = 'c' AND behind AND r0 = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg(head || rest || chr(10), '' ORDER BY i) FILTER (side = 'r' AND behind), '') AS rejected,
    coalesce(string_agg((pos + length(head))::BIGINT || '-' || (pos + length(head) + length(rest))::BIGINT, ',' ORDER BY i)
        FILTER (side = 'r' AND behind AND r0 = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY chosen_id, rejected_id
"""

_TOP_K = """
WITH fit AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM fit q JOIN fit c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_MIX = rf"""
WITH rows AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size FROM documents),
one AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM rows GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(place - 1) % 3 + 1] AS w, source_size * 3.0::DOUBLE AS cap,
    sum(source_size) OVER () AS total FROM one),
levels AS (SELECT *, row_number() OVER f AS k,
    (total - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed WINDOW f AS (ORDER BY cap / w, place)),
free AS (SELECT arg_min(level, k) AS level, min(k) AS k FROM levels WHERE cap > level * w),
goal AS (SELECT l.source, l.source_size, CASE WHEN f.k IS NULL OR l.k < f.k THEN l.cap ELSE f.level * l.w END AS target
    FROM levels l, free f),
given AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM goal),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '-' || md5(text)) || ':mix'), doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto FROM rows WHERE size > 0)
SELECT doc_id, size, source_size, target,
    (words // source_size * size + greatest(0, least(upto, words % source_size) - (upto - size)))::BIGINT AS taken
FROM placed JOIN given ON given.source IS NOT DISTINCT FROM placed.source
UNION ALL SELECT doc_id, size, source_size, target, 0::BIGINT FROM rows JOIN given ON given.source IS NOT DISTINCT FROM rows.source WHERE size = 0
"""

_WARC = """
WITH known AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha, octet_length(encode(coalesce(html, '')))::BIGINT AS n, url FROM pages),
led AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS leader,
    row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place FROM known)
SELECT page_id, n AS payload_bytes, sha AS payload_digest,
    CASE WHEN leader IS NOT NULL AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN place > 1 THEN leader END AS refers_to
FROM led
"""


_FIM = r"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM whole),
sized AS (SELECT *, len(u)::BIGINT AS n FROM units),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM sized),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


def _centroids(clusters: int = 8, rounds: int = 10) -> str:
    """Every round spelled out: components in rows (n, i, x), centroids in rows (c, i, x)."""
    steps = [f"""
fit AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), vec_id NULLS FIRST, embedding) AS n, vec_id,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (n - 1)::INTEGER AS c, v FROM fit WHERE n <= {clusters})"""]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT n, vec_id, c, f.v, list_sum(list_transform(list_zip(f.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM fit f, c{r} k),
a{r} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(c, (d, c)) AS c FROM d{r} GROUP BY n)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS m
    FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{r} k LEFT JOIN m{r} m ON m.c = k.c)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} k USING (c)
"""


_MINHASH = rf"""
WITH RECURSIVE words AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
tokens AS (SELECT r, len(w) AS m, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words),
runs AS (SELECT r, m, i, hash(concat_ws(' ', t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o)) AS x FROM tokens WINDOW o AS (PARTITION BY r ORDER BY i)),
own AS (SELECT r, list(DISTINCT x) AS s FROM runs WHERE i <= greatest(m - 3, 1) GROUP BY r),
sets AS MATERIALIZED (SELECT doc_id, words.r, coalesce(s, []) AS s FROM words LEFT JOIN own ON own.r = words.r),
held AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
ranked AS (SELECT r, n, x, row_number() OVER (PARTITION BY r ORDER BY f, x) AS k FROM held JOIN (SELECT x, count(*) AS f FROM held GROUP BY x) USING (x)),
rare AS (SELECT r, n, x FROM ranked WHERE k <= n - (80 * n + 99) // 100 + 1),  -- sets that share 80 % share one of these
near AS (SELECT DISTINCT a.r AS u, b.r AS v FROM rare a JOIN rare b ON a.x = b.x AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
linked AS (SELECT u, v FROM near JOIN sets a ON a.r = u JOIN sets b ON b.r = v
    WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
links AS MATERIALIZED (SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked),
reach(u, v) AS (SELECT r, r FROM sets UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
found AS (SELECT reach.u AS r, min(s.doc_id) AS component_id FROM reach JOIN sets s ON s.r = reach.v GROUP BY reach.u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM sets JOIN found USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _CHAT, "op2_impact_top_k": _TOP_K, "op4_source_mixing": _MIX,
            "op9_warc_transactions": _WARC, "op11_fill_in_middle": _FIM, "op12_centroid_clustering": _centroids(),
            "op13_minhash_dedup": _MINHASH}
