"""SQL of DuckDB for the queries that SQL can state."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CODE_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WHITE_WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"
# the table of the checksum's 256 byte steps, and the checksum of a list of bytes
CRC_TABLE = """
        step(b, c, k) AS (
            SELECT b, b, 0 FROM range(256) r(b)
            UNION ALL SELECT b, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM step WHERE k < 8
        ), crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS tab FROM step WHERE k = 8)"""


def _crc(data: str) -> str:
    hexed = f"hex(encode({data}))"
    values = f"list_transform(range(0, length({hexed}) // 2), lambda i: CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT))"
    step = "xor(c >> 8, tab[CAST(xor(c & 255, v) AS BIGINT) + 1])"
    return f"CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {values}), lambda c, v: {step}), 4294967295) AS BIGINT)"


ORACLE = {
    "op5_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raws FROM documents),
        raw AS (SELECT doc_id, unnest(raws) AS raw, unnest(range(1, len(raws) + 1)) AS place FROM d),
        line AS (
            SELECT doc_id, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i,
                   regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line,
                   len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words
            FROM raw WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
        ), ahead AS (
            SELECT *, lead(line) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(words) OVER w AS words2
            FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), run AS (
            SELECT doc_id, i, 1 AS n, line AS run FROM ahead WHERE words >= 13
            UNION ALL SELECT doc_id, i, 2, line || chr(10) || line2 FROM ahead WHERE words + words2 >= 13
            UNION ALL SELECT doc_id, i, 3, line || chr(10) || line2 || chr(10) || line3 FROM ahead WHERE line3 IS NOT NULL
        ), later AS (
            SELECT doc_id, i, n FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM run) WHERE k > 1
        ), gone AS (
            SELECT doc_id, place FROM line SEMI JOIN (SELECT doc_id, i + unnest(range(n)) AS i FROM later) USING (doc_id, i)
        ), kept AS (
            SELECT doc_id, string_agg(raw, chr(10) ORDER BY place) AS text FROM raw ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
        ), sums AS (SELECT doc_id, count(*) AS n FROM line GROUP BY doc_id),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, coalesce(sums.n, 0) AS n_lines, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(text, '')) AS text_sha256
        FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op7_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, {CODE_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {CODE_WORDS} AS w FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win
            FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                  FROM (SELECT *, least(len(w), 13) AS k FROM b WHERE len(w) > 0))
        ), lengths AS (SELECT DISTINCT k FROM bw),
        dw AS (
            SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN lengths ON len(w) >= k)
        ), hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
        ), listed AS (
            SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items
            FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op9_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {WHITE_WORDS} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
        ), link AS (
            SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
        ), edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM d
            UNION
            SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.other
        ), least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least_of USING (doc_id)""",
    "op11_periodic_runs": rf"""
        WITH RECURSIVE {CRC_TABLE},
        plain AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("CAST(doc_id AS VARCHAR)")} AS h
            FROM documents, crc
        ), placed AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM plain),
        period AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
        d AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
                list_transform(range(0, n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE w END AS w
            FROM period
        ), word AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM d),
        same AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
            WHERE 4 * (y.i - x.i) <= x.n
        ), streak AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same),
        stretch AS (
            SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM streak GROUP BY doc_id, q, g
            HAVING count(*) + q >= greatest(6, 4 * q)
        ), run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY ALL),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        listed AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
                   first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best
            FROM run GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
               1000 * best.l // best.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
               sha256(coalesce(text, '')) AS collapsed_sha256
        FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_collocations": rf"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        f AS (
            SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) r(k) WHERE len(w) >= k)
            GROUP BY ALL HAVING count(*) >= 30
        ), c AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
        inside AS (
            SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longest
            FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) r(m) WHERE m < k)
            GROUP BY ALL
        ), free AS (
            SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase)
            WHERE longest IS NULL OR CAST(100 AS HUGEINT) * longest < CAST(80 AS HUGEINT) * a
        ), cut AS (
            SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS front, array_to_string(w[j + 1 : k], ' ') AS back
            FROM (SELECT *, unnest(range(1, k)) AS j FROM free)
        ), scored AS (
            SELECT cut.*, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * cut.a // (x.a + y.a) AS BIGINT) AS score
            FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = front JOIN f y ON y.lang = cut.lang AND y.phrase = back
        ), least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least_cut)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_sharding": rf"""
        WITH RECURSIVE {CRC_TABLE},
        d AS (
            SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {_crc("coalesce(text, '')")} AS text_crc32,
                   md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS token
            FROM documents, crc
        ), jump(token, shards, key, shard, landing) AS (
            SELECT DISTINCT token, m, CAST('0x' || substr(token, 1, 15) AS HUGEINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM d, (VALUES (24), (25)) v(m)
            UNION ALL
            SELECT token, shards, k, landing,
                   CAST(floor((landing + 1) * (CAST(2147483648 AS DOUBLE) / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
            FROM (
                SELECT *, (key * CAST('2862933555777941757' AS HUGEINT) + 1) % CAST('18446744073709551616' AS HUGEINT) AS k
                FROM jump WHERE landing < shards
            )
        ), landed AS (SELECT token, shards, CAST(shard AS INTEGER) AS shard FROM jump WHERE landing >= shards)
        SELECT doc_id, size, text_crc32, 'key' AS law, x.shard AS shard,
               row_number() OVER (PARTITION BY x.shard ORDER BY token, doc_id) - 1 AS slot, y.shard AS grown_shard
        FROM d JOIN landed x USING (token) JOIN landed y USING (token) WHERE x.shards = 24 AND y.shards = 25""",
}
