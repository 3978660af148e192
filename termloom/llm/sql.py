"""SQL that must give the same rows as the registered queries."""

_CLEAN = """
WITH c AS (SELECT term, doc_id, tf FROM (
    SELECT term, doc_id, coalesce(term_frequency, len(positions)) AS tf,
           row_number() OVER (PARTITION BY term, doc_id ORDER BY indexed_at DESC NULLS LAST, coalesce(term_frequency, len(positions)) DESC NULLS LAST) AS k
    FROM postings WHERE term <> '' AND doc_id IS NOT NULL) WHERE k = 1),
d AS (SELECT term, count(*) AS df, coalesce(sum(tf), 0)::BIGINT AS occurrences FROM c GROUP BY term),
n AS (SELECT sum(document_count)::BIGINT AS n, sum(total_tokens) / sum(document_count) AS avgdl FROM collection_stats)
"""
_MARK = "CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.38::DOUBLE * n THEN 'common' END"

_RE2_UNSPACED = "[" + "".join(rf"\p{{{x}}}" for x in "Han Hiragana Katakana Bopomofo Yi Thai Lao Khmer Myanmar Tibetan Javanese Balinese Tai_Le New_Tai_Lue Tai_Tham Tai_Viet".split()) + r"\x{30FC}\x{FF70}]"
_RE2_MARKS = r"\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{303D}\x{30FB}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}"

SQL = {
    "p1_found": _CLEAN
    + "SELECT doc_id, c.term FROM c JOIN d ON c.term = d.term, n WHERE tf > 0 AND (1 + ln(tf)) * (ln(n / df) + 1) >= 2 * (1 + ln(n)) * (1 - 1e-12::DOUBLE)",
    "p1_weights": _CLEAN
    + """, l AS (SELECT doc_id, coalesce(sum(tf), 0)::BIGINT AS length FROM c GROUP BY doc_id)
SELECT c.doc_id, c.term, c.tf, d.df, l.length, round(CASE WHEN tf IS NULL THEN NULL WHEN tf <= 0 THEN 0
  ELSE ln(1 + (greatest(n - df, 0) + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl)) END, 6) AS weight
FROM c JOIN d ON c.term = d.term JOIN l ON c.doc_id = l.doc_id, n""",
    # Every pair that shares a shingle, counted.
    "p3_found": """
WITH t AS (SELECT id, regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z0-9\\x{80}-\\x{10FFFF}]+') AS t FROM corpus_docs WHERE content IS NOT NULL AND id IS NOT NULL),
s AS (SELECT DISTINCT id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS s FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM t)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k >= 0.6::DOUBLE * (x.n + y.n - k)
""",
    # The same words by other patterns (RE2 has no intersection of classes): characters of unspaced scripts set apart, marks blanked, then runs of letters.
    "p3_links": f"""
WITH w AS (SELECT doc_id AS id, CASE WHEN regexp_matches(coalesce(text, ''), '[^\\s\\x{{0B}}\\x{{85}}\\p{{Z}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]') THEN regexp_extract_all(
        regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '({_RE2_UNSPACED}\\p{{M}}*)', ' \\1 ', 'g'), '[{_RE2_MARKS}]', ' ', 'g'),
        '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+') ELSE [] END AS t FROM documents),
r AS (SELECT row_number() OVER () AS r, id, t FROM w),
s AS (SELECT DISTINCT r, t[i] || ' ' || coalesce(t[i + 1], '') || ' ' || coalesce(t[i + 2], '') || ' ' || coalesce(t[i + 3], '') || ' ' || coalesce(t[i + 4], '') AS s
      FROM (SELECT r, t, unnest(range(1, greatest(len(t) - 3, least(len(t) + 1, 2)))) AS i FROM r)),
k AS (SELECT r, string_agg(s, chr(10) ORDER BY s) AS k, count(*) AS n FROM s GROUP BY r),
c AS (SELECT coalesce(k, '') AS k, min(id) AS class_id, count(*) AS copies, min(r.r) AS one, coalesce(max(n), 0) AS n FROM r LEFT JOIN k ON r.r = k.r GROUP BY ALL),
e AS (SELECT one, n, s FROM c JOIN s ON c.one = s.r),
p AS (SELECT a.one AS a, b.one AS b FROM e a JOIN e b ON a.s = b.s AND a.one <> b.one GROUP BY ALL HAVING count(*) >= 0.8::DOUBLE * (max(a.n) + max(b.n) - count(*))),
l AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT r.id, class_id, copies, coalesce(links, 0) AS links FROM r LEFT JOIN k ON r.r = k.r JOIN c ON c.k = coalesce(k.k, '') LEFT JOIN l ON l.a = c.one
""",
    "p5_found": _CLEAN + f"SELECT * FROM (SELECT term, {_MARK} AS mark FROM d, n) WHERE mark IS NOT NULL",
    "p5_frequencies": _CLEAN + f"SELECT term, occurrences, df, {_MARK} AS mark FROM d, n",
    "p6_found": """
SELECT query, ranker, rank_no, document_id FROM (
  SELECT query, ranker, document_id, row_number() OVER (PARTITION BY query, ranker ORDER BY s DESC, document_id)::INT AS rank_no FROM (
    SELECT query, ranker, document_id, max(CASE WHEN score = 0 THEN 0 ELSE score END) AS s FROM search_results
    WHERE score IS NOT NULL AND NOT isnan(score) AND document_id IS NOT NULL GROUP BY ALL)) WHERE rank_no <= 5
""",
}
