"""DuckDB statements for p3 and p6, written from the problem statements."""

NAMES = """names AS (SELECT k, min(chrom_id) AS chrom_id FROM (
    SELECT lower(trim(contig_name)) AS k, chrom_id FROM contigs UNION ALL SELECT lower(trim(alt_name)), chrom_id FROM contig_aliases) GROUP BY k)"""

INCLUDED = f"""{NAMES}, inc AS (SELECT r.* EXCLUDE (chrom), n.chrom_id FROM reads_raw r JOIN names n ON lower(trim(r.chrom)) = n.k
    WHERE (flag & 2308) = 0 AND pos >= 1)"""

_STRETCHES = f"""WITH {INCLUDED}, st AS (
  SELECT 'read' AS origin, source_file_id, chrom_id, pos AS a,
    pos + list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))) - 1 AS b
  FROM inc WHERE cigar IS NOT NULL AND cigar <> '*'
  UNION
  SELECT 'match', m.source_file_id, n.chrom_id, least(p_min, p_max), greatest(p_min, p_max)
  FROM motif_matches m JOIN names n ON lower(trim(m.chrom)) = n.k WHERE p_max IS NOT NULL AND p_min IS NOT NULL),
 run AS (SELECT *, max(b) OVER (PARTITION BY origin, source_file_id, chrom_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
   FROM st WHERE b >= a)"""

P3_FOUND = f"""{_STRETCHES} SELECT origin, source_file_id, chrom_id, CAST(prev + 1 AS BIGINT) AS gap_start, CAST(a - 1 AS BIGINT) AS gap_end FROM run WHERE a > prev + 1"""

P3_PERIODS = f"""{_STRETCHES}, isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR a > prev + 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY origin, source_file_id, chrom_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM run)
 SELECT origin, source_file_id, chrom_id, CAST(min(a) AS BIGINT) AS period_start, CAST(max(b) AS BIGINT) AS period_end
 FROM isl GROUP BY origin, source_file_id, chrom_id, island"""

P6_FOUND = f"""WITH {NAMES}, rr AS (SELECT 'reads_raw' AS in_table, n.chrom_id FROM reads_raw r LEFT JOIN names n ON lower(trim(r.chrom)) = n.k),
 both_t AS (SELECT * FROM rr UNION ALL SELECT 'ordered_reads', chrom_id FROM ordered_reads),
 tot AS (SELECT in_table, count(*) AS t FROM both_t GROUP BY 1)
 SELECT b.in_table, b.chrom_id FROM both_t b JOIN tot USING (in_table) WHERE b.chrom_id IS NOT NULL
 GROUP BY b.in_table, b.chrom_id, t HAVING count(*) * 20 >= t"""

P6_PROFILE = f"""WITH {NAMES}, rr AS (SELECT 'reads_raw' AS in_table, n.chrom_id,
   nullif(upper(regexp_extract(qname, '([A-Za-z0-9]+(:[A-Za-z0-9]+){{6}})', 1)), '') AS name,
   CASE WHEN seq IS NULL OR seq IN ('', '*') THEN NULL ELSE length(seq) END AS l_seq, pos
   FROM reads_raw r LEFT JOIN names n ON lower(trim(r.chrom)) = n.k)
 SELECT in_table, chrom_id, count(*) AS n_rows, count(DISTINCT name) AS n_names, CAST(sum(l_seq) AS BIGINT) AS n_bases,
   min(pos) AS first_pos, max(pos) AS last_pos FROM rr GROUP BY 1, 2
 UNION ALL SELECT 'ordered_reads', chrom_id, count(*), count(DISTINCT read_id), CAST(sum(l_seq) AS BIGINT), min(pos), max(pos)
 FROM ordered_reads GROUP BY 2"""

ORACLES = {"p3_found": P3_FOUND, "p3_periods": P3_PERIODS, "p6_found": P6_FOUND, "p6_contig_profile": P6_PROFILE}
