"""The same results in DuckDB's SQL, for the operators that SQL can express."""

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _raked(cycles: int = 8, exponent: float = 0.7, keep: float = 0.9, rounds: int = 6) -> str:
    """Goals and raking written out step by step: each step has the weights of all cells."""
    dims, steps, last = ("source", "lang", "topic"), [], "w0"
    for d in dims:
        steps.append(f"m_{d} AS MATERIALIZED (SELECT {d}, sum(tokens)::DOUBLE AS have, pow(sum(tokens)::DOUBLE, {exponent}) / sum(pow(sum(tokens)::DOUBLE, {exponent})) OVER () AS target FROM cells GROUP BY {d})")
        steps.append(f"l_{d}_0 AS (SELECT budget / sum(target) AS scale FROM m_{d}, total GROUP BY budget)")
        for r in range(1, rounds + 1):
            given, left = "coalesce(sum(have) FILTER (have <= target * scale), 0)", "sum(target) FILTER (have > target * scale)"
            steps.append(f"l_{d}_{r} AS MATERIALIZED (SELECT coalesce((budget - {given}) / {left}, scale) AS scale FROM m_{d}, l_{d}_{r - 1}, total GROUP BY budget, scale)")
        steps.append(f"t_{d} AS (SELECT {d}, least(have, target * scale) AS goal FROM m_{d}, l_{d}_{rounds})")
    steps.append("w0 AS (SELECT source, lang, topic, tokens, tokens * (budget / everything) AS w FROM cells, total)")
    for i in range(1, 3 * cycles + 1):
        d = dims[(i - 1) % 3]
        steps.append(f"w{i} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(tokens::DOUBLE, w * (goal / sum(w) OVER (PARTITION BY {d}))) AS w FROM {last} JOIN t_{d} USING ({d}))")
        last = f"w{i}"
    return f"""
WITH words AS (
    SELECT doc_id, unnest({WORDS}) AS word FROM documents
), counted AS (
    SELECT doc_id, word, count(*) AS n FROM words GROUP BY doc_id, word
), per_doc AS (
    SELECT doc_id, sum(n) AS tokens, arg_min(word, (-n, word)) FILTER (length(word) >= 5) AS best FROM counted GROUP BY doc_id
), described AS (
    SELECT d.doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(tokens, 0)::BIGINT AS tokens,
           't' || CASE WHEN best IS NULL THEN 0 ELSE (instr('0123456789abcdef', substr(md5(best), 1, 1)) - 1) % 8 END AS topic
    FROM documents d LEFT JOIN per_doc USING (doc_id)
), cells AS (
    SELECT source, lang, topic, sum(tokens) AS tokens FROM described GROUP BY ALL HAVING sum(tokens) > 0
), total AS (SELECT sum(tokens)::DOUBLE AS everything, {keep}::DOUBLE * sum(tokens)::DOUBLE AS budget FROM cells), {", ".join(steps)},
ratios AS (
    SELECT source, lang, topic, w / tokens AS p FROM {last}
), chances AS (
    SELECT doc_id, source, lang, topic, tokens, CASE WHEN tokens > 0 THEN coalesce(p, 0) ELSE 0 END::DOUBLE AS p
    FROM described LEFT JOIN ratios USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, tokens, round(p, 9) AS probability,
       ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < p AS kept
FROM chances
"""


FEATURES = f"regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    # The checksum is worked out byte by byte, once per distinct word.
    "op13_importance": f"""
WITH crc AS (
    SELECT list(v ORDER BY k) AS tab FROM (
        SELECT k, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS v FROM range(256) t(k))
), raw AS (
    SELECT doc_id, unnest({FEATURES}) AS w FROM documents
), aim AS (
    SELECT unnest({FEATURES}) AS w FROM benchmark
), words AS (
    SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM raw UNION SELECT w FROM aim)
), bucketed AS (
    SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                              lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b
    FROM words, crc
), s AS (
    SELECT b, count(*)::DOUBLE AS n FROM raw JOIN bucketed USING (w) GROUP BY b
), t AS (
    SELECT b, count(*)::DOUBLE AS n FROM aim JOIN bucketed USING (w) GROUP BY b
), total AS (
    SELECT (SELECT count(*) FROM raw)::DOUBLE AS s_all, (SELECT count(*) FROM aim)::DOUBLE AS t_all
), gains AS (
    SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1) * (s_all + 10000) / ((s.n + 1) * (t_all + 10000))))::BIGINT AS gain
    FROM s LEFT JOIN t USING (b), total
), weighed AS (
    SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM raw JOIN bucketed USING (w) JOIN gains USING (b) GROUP BY doc_id
), scored AS (
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents LEFT JOIN weighed USING (doc_id)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
""",
    "op1_line_dedup": f"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, {WHITE}), {UPPER}, {LOWER}) AS key FROM lines
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), judged AS (
    SELECT doc_id, pos, line, key IN (SELECT key FROM frequent) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op2_warc": """
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT payload_digest, min(page_id) AS first_id FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payloads.payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)
""",
    "op7_minhash": f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {WORDS} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
    SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (
    SELECT x, min(y) AS m FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON x = doc_id
""",
    "op9_top_k": f"""
WITH words AS (
    SELECT doc_id, unnest({WORDS}) AS w FROM documents
), tf AS (
    SELECT doc_id, w, count(*) AS tf FROM words GROUP BY ALL
), lens AS (
    SELECT doc_id, len({WORDS}) AS n FROM documents
), total AS (
    SELECT count(*)::DOUBLE AS docs, sum(n) / count(*) AS mean FROM lens
), df AS (
    SELECT w, count(*) AS df FROM tf GROUP BY w
), scores AS (
    SELECT q.doc_id AS query_id, d.doc_id,
           sum(round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * n / mean))) * 1e9)::BIGINT) AS units
    FROM tf q JOIN df USING (w) JOIN tf d USING (w) JOIN lens ON lens.doc_id = d.doc_id CROSS JOIN total
    WHERE q.doc_id % 100 = 0 GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS rank FROM scores
)
SELECT query_id, rank, doc_id, round(units / 1e9, 6) AS score FROM ranked WHERE rank <= 10
""",
    "op10_mixing": _raked(),
    "op6_suffix_dedup": """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
    SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s
    FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM texts)
), marked AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1
), steps AS (
    SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM marked
), spans AS (
    SELECT doc_id, min(p) AS a, max(p) + 100 AS b
    FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM steps) GROUP BY doc_id, k
), cuts AS (
    SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM texts
), kept AS (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS x, a AS y FROM cuts
), parts AS (
    SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x, y) AS k FROM kept JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(length(h) // 2 - length(k) // 2 AS BIGINT) AS n_removed,
       (SELECT count(*) FROM spans WHERE spans.doc_id = texts.doc_id) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM texts JOIN parts USING (doc_id)
""",
}
