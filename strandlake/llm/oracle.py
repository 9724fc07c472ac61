"""DuckDB statements for the queries of this subpackage, written from the problem statements."""

from strandlake.plans.oracle_coverage import INCLUDED

BASES = "regexp_replace(upper(seq), '[^ACGT]', 'N', 'g')"
HAS_SEQ = "seq IS NOT NULL AND seq NOT IN ('', '*')"

P1_FOUND = f"""WITH rec AS (
  SELECT 'read' AS rec_kind, record_id AS rec_id, {BASES} AS s FROM reads_raw WHERE {HAS_SEQ}
  UNION ALL SELECT 'bundle', bundle_id, upper(s) FROM seq_bundles),
 win AS (SELECT rec_kind, rec_id, p, substr(s, p + 1, 40) AS w FROM (
    SELECT *, unnest(range(0, length(s) - 39)) AS p FROM rec WHERE length(s) >= 40) WHERE NOT regexp_matches(substr(s, p + 1, 40), '[^ACGT]')),
 dup AS (SELECT w FROM win GROUP BY w HAVING count(DISTINCT (rec_kind, rec_id)) > 1),
 hit AS (SELECT rec_kind, rec_id, p, lag(p) OVER (PARTITION BY rec_kind, rec_id ORDER BY p) AS q FROM win WHERE w IN (SELECT w FROM dup)),
 isl AS (SELECT *, sum(CASE WHEN q IS NULL OR p > q + 40 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_kind, rec_id ORDER BY p) AS g FROM hit)
 SELECT rec_kind, rec_id, CAST(min(p) AS BIGINT) AS span_start, CAST(max(p) + 40 AS BIGINT) AS span_end FROM isl GROUP BY rec_kind, rec_id, g"""

P1_AMOUNT = f"""SELECT rec_kind, rec_id, count(*) AS n_spans, CAST(sum(span_end - span_start) AS BIGINT) AS shared_bases,
 max(span_end - span_start) AS longest FROM ({P1_FOUND}) GROUP BY 1, 2"""

P2_FOUND = f"""WITH {INCLUDED},
 val AS (SELECT 'mapq' AS metric, chrom_id, mapq AS v FROM inc WHERE mapq IS NOT NULL AND mapq <> 255
   UNION ALL SELECT 'qual', chrom_id, v FROM (SELECT chrom_id, unnest(qual) AS v FROM inc) WHERE v BETWEEN 0 AND 93),
 lim(pct, top) AS (VALUES (10, 8), (50, 20)),
 big AS (SELECT chrom_id FROM inc GROUP BY 1 HAVING count(*) >= 30)
 SELECT metric, CAST(pct AS BIGINT) AS pct, chrom_id FROM val, lim WHERE chrom_id IN (SELECT chrom_id FROM big)
 GROUP BY metric, pct, top, chrom_id HAVING count(*) FILTER (WHERE v < top) * 100 >= pct * count(*)"""

P4_FOUND = f"""WITH s AS (SELECT {BASES} AS seq FROM reads_raw WHERE {HAS_SEQ})
 SELECT seq FROM s GROUP BY seq HAVING count(*) * 200 >= (SELECT count(*) FROM s)"""

P5_FOUND = f"""WITH {INCLUDED}, r AS (SELECT record_id, ingested_at, flag & 192 AS mate, flag,
   nullif(upper(regexp_extract(qname, '([A-Za-z0-9]+(:[A-Za-z0-9]+){{6}})', 1)), '') AS name,
   CASE WHEN mapq <> 255 THEN mapq END AS mq, coalesce(len(list_filter(qual, lambda x: x BETWEEN 0 AND 93)), 0) AS qn,
   coalesce(list_sum(list_filter(qual, lambda x: x BETWEEN 0 AND 93)), 0) AS qs FROM inc)
 SELECT keep_id, coalesce(mapq_id, keep_id) AS mapq_id, coalesce(qual_id, keep_id) AS qual_id FROM (
 SELECT first(record_id ORDER BY (flag & 1024) <> 0, (flag & 512) <> 0, coalesce(mq, -1) DESC, qs DESC, ingested_at DESC, record_id) AS keep_id,
   first(record_id ORDER BY ingested_at DESC, record_id) FILTER (WHERE mq IS NOT NULL) AS mapq_id,
   first(record_id ORDER BY qn DESC, qs DESC, ingested_at DESC, record_id) FILTER (WHERE qn > 0) AS qual_id
 FROM r WHERE name IS NOT NULL GROUP BY name, mate HAVING count(*) >= 2)"""

ORACLES = {
    "p1_found": P1_FOUND,
    "p1_shared_amount": P1_AMOUNT,
    "p2_found": P2_FOUND,
    "p4_found": P4_FOUND,
    "p5_found": P5_FOUND,
}

P7_FOUND = r"""SELECT spec_id, doc_id FROM documents, pack_specs
 WHERE text IS NOT NULL AND regexp_matches(text, '[^ \t\n\v\f\r]') AND octet_length(encode(text)) + 1 > capacity"""

_TOKENS = r"""regexp_extract_all(regexp_replace(lower(text),
  '<[^<>]*>(?:[\s>]*[a-z]+="[^"<>]*"\s*/?>)?|\[[^\[\]]*\]|&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});', ' ', 'g'), '[\p{L}\p{N}]+')"""

P8_FOUND = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
 i AS (SELECT item_id, {_TOKENS} AS w FROM eval_items WHERE text IS NOT NULL),
 dw AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS p FROM d)),
 iw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS p FROM i))
 SELECT DISTINCT item_id, doc_id FROM dw JOIN iw USING (g)"""

P8_CLEAN = f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({P8_FOUND}))"

P8_LEAKS = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
 i AS (SELECT item_id, {_TOKENS} AS w FROM eval_items WHERE text IS NOT NULL),
 dw AS (SELECT doc_id, p, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS p FROM d)),
 iw AS (SELECT item_id, q, array_to_string(w[q:q + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS q FROM i)),
 h AS (SELECT item_id, doc_id, p, q, p - row_number() OVER (PARTITION BY item_id, doc_id, p - q ORDER BY p) AS island FROM dw JOIN iw USING (g)),
 e AS (SELECT item_id, doc_id, p, max(p) OVER (PARTITION BY item_id, doc_id, p - q, island) + 12 AS stop FROM h),
 m AS (SELECT item_id, doc_id, p, max(stop) AS stop FROM e GROUP BY ALL),
 n AS (SELECT *, stop > coalesce(max(stop) OVER (PARTITION BY item_id, doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh FROM m)
 SELECT item_id, doc_id, count(*) AS n_spans, max(stop - p) AS longest FROM n WHERE fresh GROUP BY 1, 2"""

ORACLES |= {"p8_leaks": P8_LEAKS, "p7_found": P7_FOUND, "p8_found": P8_FOUND, "p8_clean_documents": P8_CLEAN}

_QUAL_SUM = f"""{INCLUDED}, v AS (SELECT chrom_id, list_sum(list_filter(qual, lambda q: q BETWEEN 0 AND 93)) AS v FROM inc WHERE qual IS NOT NULL)"""
P2_RANK_ERROR = f"""WITH {_QUAL_SUM} SELECT chrom_id, pct, count(*) AS n, true AS contains, true AS within FROM v, (SELECT CAST(unnest([10, 25, 50, 75, 90]) AS BIGINT) AS pct) GROUP BY ALL"""

ORACLES |= {"p2_rank_error": P2_RANK_ERROR, "p2_compression": "SELECT true AS compressed, true AS open, true AS bounded"}

P9_AGREEMENT = """SELECT count(*) AS graded, true AS recall, true AS precision FROM documents JOIN
 (SELECT doc_id FROM reading_labels WHERE read_level IS NOT NULL GROUP BY 1) USING (doc_id) WHERE lang = 'en'"""

ORACLES |= {"p9_agreement": P9_AGREEMENT, "p9_held_out": "SELECT true AS accurate, true AS ordered"}

P7_CHECK = r"""SELECT spec_id, count(*) AS n_docs, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS needless, CAST(0 AS BIGINT) AS doubled, true AS filled
 FROM documents, pack_specs WHERE regexp_matches(text, '[^ \t\n\v\f\r]') GROUP BY 1"""
P4_CHECK = f"""WITH s AS (SELECT {BASES} AS seq FROM reads_raw WHERE {HAS_SEQ}), c AS (SELECT seq, count(*) AS n FROM s GROUP BY 1)
 SELECT CAST((SELECT sum(n) FROM c) AS BIGINT) AS total, count(*) FILTER (WHERE n > 0.001 * (SELECT sum(n) FROM c)) AS frequent, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS outside, true AS tight FROM c"""

ORACLES |= {"p7_check": P7_CHECK, "p4_check": P4_CHECK}

ORACLES |= {"p5_planted": "SELECT count(*) AS n, true AS accurate, true AS beats_votes, true AS settled FROM ordered_reads"}
