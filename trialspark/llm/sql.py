"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
runs AS (
    SELECT doc_id, p, list_slice(lines, p + 1, p + 3) AS run
    FROM docs, UNNEST(range(0, len(lines) - 2)) AS places(p)
),
ranked AS (
    SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS place
    FROM runs
    WHERE trim(array_to_string(run, ''), ' ' || chr(9) || chr(13)) <> ''
),
covered AS (
    SELECT DISTINCT doc_id, p + j AS p
    FROM ranked, UNNEST(range(0, 3)) AS steps(j)
    WHERE place > 1
),
lines AS (
    SELECT doc_id, p, lines[p + 1] AS line
    FROM docs, UNNEST(range(0, len(lines))) AS places(p)
),
kept AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n
    FROM lines ANTI JOIN covered USING (doc_id, p)
    GROUP BY doc_id
)
SELECT docs.doc_id,
       CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines,
       (coalesce(len(lines), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed
FROM docs LEFT JOIN kept USING (doc_id)
"""

TOP_SCORES = r"""
WITH numbered AS (
    SELECT DISTINCT vec_id, pos, floor(256 * x::DOUBLE)::BIGINT AS x
    FROM embeddings, UNNEST(embedding) WITH ORDINALITY AS parts(x, pos)
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
    FROM numbered q JOIN numbered c ON q.pos = c.pos AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
    GROUP BY ALL
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

FILL_IN_MIDDLE = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS sha,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS parts
    FROM documents
),
numbers AS (
    SELECT *, len(parts)::BIGINT AS n, ('0x' || substr(sha, 1, 8))::BIGINT AS h1,
           ('0x' || substr(sha, 9, 8))::BIGINT AS h2, ('0x' || substr(sha, 17, 8))::BIGINT AS h3,
           ('0x' || substr(sha, 25, 8))::BIGINT AS h4
    FROM units
),
forms AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                  OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
),
cut AS (
    SELECT *, array_to_string(list_slice(parts, 1, low), '') AS prefix,
           array_to_string(list_slice(parts, low + 1, high), '') AS middle,
           array_to_string(list_slice(parts, high + 1, n), '') AS suffix
    FROM forms
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

# The state after each row is the least (cost, audit) of every place in ``(s?(ua)+)?``.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS letters
    FROM conversations
),
marked AS (
    SELECT * EXCLUDE letters, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(letters, lambda x: unicode(x)::BIGINT)),
        lambda crc, x: list_reduce(
            list_prepend(xor(crc, x), range(8)),
            lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END
        )
    )) % 20 AS code
    FROM coded
),
turns AS (
    SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
           CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM marked, UNNEST(range(0, CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(copy)
),
placed AS (
    SELECT *, substr(role, 1, 1) AS initial,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
    FROM turns
),
faults AS (
    SELECT *, CASE WHEN trimmed = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                   WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair
    FROM placed
),
counts AS (
    SELECT conv_id, count(*) AS size,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pos > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
),
walk AS (
    SELECT conv_id, 0::BIGINT AS pos, {'c': 0::BIGINT, 'a': ''} AS begun,
           {'c': 1000000000::BIGINT, 'a': ''} AS opened, {'c': 2::BIGINT, 'a': 'I'} AS asked,
           {'c': 4::BIGINT, 'a': 'II'} AS answered
    FROM counts
    UNION ALL
    SELECT conv_id, pos, begun, opened, asked,
           list_sort([answered, {'c': asked.c + 2, 'a': asked.a || 'I'}])[1] AS answered
    FROM (
        SELECT conv_id, pos, begun, opened, answered,
               list_sort([asked, {'c': begun.c + 2, 'a': begun.a || 'I'},
                          {'c': opened.c + 2, 'a': opened.a || 'I'},
                          {'c': answered.c + 2, 'a': answered.a || 'I'}])[1] AS asked
        FROM (
            SELECT w.conv_id, f.pos,
                   {'c': begun.c + 3, 'a': begun.a || 'D'} AS begun,
                   list_sort([{'c': opened.c + 3, 'a': opened.a || 'D'},
                              {'c': CASE WHEN initial = 's' THEN begun.c + stay ELSE 2000000000 END,
                               'a': begun.a || 'K'}])[1] AS opened,
                   list_sort([{'c': asked.c + 3, 'a': asked.a || 'D'},
                              {'c': least(begun.c, opened.c, answered.c) + turned + stay,
                               'a': list_sort([begun, opened, answered])[1].a
                                    || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END}])[1] AS asked,
                   list_sort([{'c': answered.c + 3, 'a': answered.a || 'D'},
                              {'c': asked.c + answering + stay,
                               'a': asked.a || CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END}])[1] AS answered
            FROM walk w JOIN (
                SELECT *, CASE fault WHEN 'none' THEN 0 WHEN 'truncated' THEN 1 ELSE 1000000000 END AS stay,
                       CASE WHEN initial = 'u' THEN 0 ELSE 2 END AS turned,
                       CASE WHEN initial = 'a' THEN 0 ELSE 2 END AS answering
                FROM faults
            ) f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = w.pos + 1
        )
    )
),
best AS (
    SELECT conv_id, least.c AS cost, least.a AS audit
    FROM (
        SELECT w.conv_id, list_sort([begun, answered])[1] AS least
        FROM walk w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.size
    )
),
edits AS (
    SELECT conv_id, i, edit,
           sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS pos,
           sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY i) - 1 AS place,
           sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id) % 2 AS system
    FROM (
        SELECT conv_id, unnest(range(1, length(audit) + 1)) AS i,
               unnest(string_split(audit, '')) AS edit
        FROM best WHERE audit <> ''
    )
),
repaired AS (
    SELECT e.conv_id, string_agg(
               CASE WHEN edit = 'K' THEN f.role WHEN (place - system) % 2 = 0 THEN 'user' ELSE 'assistant' END
               || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY i) AS lines
    FROM edits e LEFT JOIN faults f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.pos = f.pos AND e.edit <> 'I'
    WHERE edit <> 'D' GROUP BY e.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""

STATEMENTS: dict[str, str] = {
    "op5_line_dedup": LINE_DEDUP,
    "op8_top_scores": TOP_SCORES,
    "op12_conversation_repair": CONVERSATION_REPAIR,
    "op13_fill_in_middle": FILL_IN_MIDDLE,
}
