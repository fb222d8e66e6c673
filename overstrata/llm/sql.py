"""DuckDB SQL for the rows of those queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_url_filter": f"""
        WITH rules(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
            ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        u AS (SELECT row_number() OVER () AS n, page_id,
            CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        hit AS (SELECT n, max({{'len': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': verdict}}) AS best
            FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (n)
    """,
    "op4_warc_normaliser": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
        d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32),
            lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i::INT + 1, 1)::INT + 8 * substr(bits, 5 * i::INT + 2, 1)::INT
            + 4 * substr(bits, 5 * i::INT + 3, 1)::INT + 2 * substr(bits, 5 * i::INT + 4, 1)::INT + substr(bits, 5 * i::INT + 5, 1)::INT, 1)), '') AS payload_digest FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM w
    """,
    "op5_perspective_rotation": r"""
        WITH c AS (SELECT conv_id, coalesce(floor(turn / 64)::BIGINT, -1) AS part, turn, role, replace(coalesce(text, ''), '<|', '< |') AS body,
            CASE WHEN role = 'system' THEN 'system' WHEN role IS NULL THEN 'user' ELSE 'user name=' || translate(replace(role, '<|', '< |'), chr(13) || chr(10), '  ') END AS name FROM conversations),
        q AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role NULLS FIRST, body) - 1) // 64 AS piece FROM c),
        p AS (SELECT DISTINCT conv_id, role AS participant FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
        s AS (SELECT q.conv_id, participant, part, piece, row_number() OVER (PARTITION BY q.conv_id, participant, part, piece ORDER BY turn NULLS FIRST, role NULLS FIRST, body) AS n,
            coalesce(role = participant, false) AS own, body || '<|im_end|>' AS body,
            '<|im_start|>' || CASE WHEN role = participant THEN 'assistant' ELSE name END || chr(10) AS head
            FROM q JOIN p ON q.conv_id IS NOT DISTINCT FROM p.conv_id),
        o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, part, piece ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS s FROM s),
        r AS (SELECT conv_id, participant, part, piece, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
            coalesce(string_agg(s || ':' || (s + length(body)), ' ' ORDER BY n) FILTER (WHERE own), '') AS mask FROM o GROUP BY ALL)
        SELECT conv_id, participant, part, piece, n_turns, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, participant ORDER BY part, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char,
            rendered, mask FROM r
    """,
}
