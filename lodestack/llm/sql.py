"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 of a decimal number's text, bit by bit: a byte is taken in, then eight bits are shifted out.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""

ORACLES = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op6_mixing": r"""
        WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
                          CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
                     CAST(3 * source_size AS DOUBLE) AS most FROM s),
        f AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER b, 0))
                        / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
                     sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS shared
              FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_max(level, shared) AS level FROM f WHERE level * weight < most),
        t AS (SELECT f.source, source_size, CASE WHEN f.level * weight >= most THEN most ELSE l.level * weight END AS target FROM f LEFT JOIN l ON true),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
        r AS (SELECT d.*, e.source_size, e.target, e.epochs, greatest(0, e.target - e.epochs * e.source_size) AS budget,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
              FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (epochs + CASE WHEN upto - size / 2 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
    "op9_warc_revisits": r"""
        WITH c AS (SELECT page_id, md5(coalesce(html, '')) AS etag, length(coalesce(html, '')) AS size, count(*) OVER () AS n,
                          regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''),
                            '([?&])(?i:utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '\1', 'g'), '&{2,}', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', '') AS u FROM pages),
        p AS (SELECT page_id, etag, size, n,
                     regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
                     || regexp_replace(regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '\.html(\?|$)', '\1', 'g'), '/(\?|$)', '\1', 'g') AS url FROM c),
        k AS (SELECT page_id, url, size, n, CASE WHEN page_id % 10 > 2 THEN etag END AS etag, CASE WHEN page_id % 10 IN (1, 2) THEN 'm' || left(etag, 1) END AS changed FROM p),
        r AS (SELECT *, 2 * page_id AS captured FROM k),
        v AS (SELECT *, 2 * page_id + n + 1 - n % 2 AS captured FROM k),
        j AS (SELECT v.page_id, v.url, v.n, v.etag, v.changed, r.page_id AS response_page_id, r.etag AS r_etag, r.changed AS r_changed, r.size AS r_size,
                     CASE WHEN r.page_id IS NULL THEN 'missing' WHEN v.etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN v.etag = r.etag THEN 'resolved' ELSE 'changed' END
                          WHEN v.changed IS NOT NULL AND r.changed IS NOT NULL THEN CASE WHEN v.changed = r.changed THEN 'resolved' ELSE 'changed' END ELSE 'unchecked' END AS status
              FROM v ASOF LEFT JOIN r ON v.url = r.url AND v.captured > r.captured)
        SELECT page_id, url, response_page_id, status,
               concat_ws('&', 'content-length=' || CASE WHEN status IN ('resolved', 'unchecked') THEN r_size ELSE 0 END, 'date=' || (page_id + n),
                         'etag=' || CASE WHEN etag IS NOT NULL THEN 'W/' || etag WHEN status IN ('resolved', 'unchecked') THEN r_etag END,
                         'last-modified=' || CASE WHEN changed IS NOT NULL THEN changed WHEN status IN ('resolved', 'unchecked') THEN r_changed END) AS headers
        FROM j""",
    "op11_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
                   FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT c, turns, {_CRC32.format("c")} % 6 AS h FROM t),
        b AS (SELECT h.c, list_concat(coalesce(base.turns, [])[1:h], h.turns[h + 1:]) AS turns FROM h LEFT JOIN t base ON base.c = h.c - h.c % 100),
        p AS (SELECT c, len(turns) AS total, d, turns[1:d] AS node, turns[1:d - 1] AS parent, CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS size
              FROM b, unnest(range(len(turns) + 1)) AS u(d)),
        n AS (SELECT node, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                     sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = total), '')) AS ends_sha256 FROM p GROUP BY node, d),
        k AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        s AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, d)),
        a AS (SELECT s.node[1:e] AS node, e AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
              FROM s, unnest(range(s.d + 1)) AS u(e) GROUP BY ALL)
        SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, CASE WHEN s.d > 0 THEN q.conv_id END AS parent_conv_id, s.n_convs, s.n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, s.ends_sha256
        FROM s JOIN a USING (node, d) LEFT JOIN n q ON q.node = s.parent AND q.d = s.d - 1""",
    "op13_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 5)) AS u(k), unnest(range(1, len(w) - k + 2)) AS v(i)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
        t AS (SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.f) // (x.f + y.f) AS BIGINT) AS score
              FROM c, unnest(range(1, c.k)) AS u(j) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
        b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        i AS (SELECT c.lang, array_to_string(c.w[s:s + z - 1], ' ') AS phrase, max(f) AS longer FROM c, unnest(range(2, c.k)) AS u(z), unnest(range(1, c.k - z + 2)) AS v(s) GROUP BY ALL),
        d AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i USING (lang, phrase) WHERE NOT coalesce(100 * longer >= 80 * a, false))
        SELECT lang, rank, phrase, a, l, r, n, score FROM d JOIN n USING (lang) WHERE rank <= 2000""",
}
