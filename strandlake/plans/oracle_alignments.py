"""DuckDB statements for the read queries, written from the problem statements and the order table."""

from strandlake.functions.patterns import orientations
from strandlake.plans.alignments import MOTIFS, PALINDROMES, REGIONS, WINDOW
from strandlake.plans.oracle_coverage import INCLUDED, NAMES
from strandlake.schema import Strand

SCOPE = f"""{NAMES}, rd AS (SELECT r.record_id, r.qname, r.flag, r.pos, r.mapq, r.cigar, r.qual, r.aux, r.source_file_id, r.bam_offset,
  regexp_replace(upper(r.seq), '[^ACGT]', 'N', 'g') AS seq, length(r.seq) AS l_seq, o.chrom_id, o.read_id, o.build_id, o.s_start, c.contig_name AS chrom
  FROM reads_raw r JOIN ordered_reads o USING (record_id) JOIN contigs c ON c.chrom_id = o.chrom_id)"""


def _words(patterns: list[str], strand: Strand = Strand.COMPLETE) -> str:
    rows = ", ".join(f"('{p}', '{w}', '{s}')" for p in patterns for w, s in orientations(p, strand))
    return f"pat(pattern, word, strand) AS (VALUES {rows})"


def _hits(patterns: list[str], strand: Strand = Strand.COMPLETE, where: str = "true") -> str:
    """CTE hit: every occurrence, off 0-based."""
    return f"""{SCOPE}, {_words(patterns, strand)},
 cand AS (SELECT rd.*, pattern, word, strand, length(word) AS w FROM rd JOIN pat ON contains(rd.seq, word) WHERE {where}),
 hit AS (SELECT * FROM (SELECT *, unnest(range(0, l_seq - w + 1)) AS off FROM cand) WHERE substr(seq, off + 1, w) = word)"""


_OPS = """ops AS (SELECT record_id, pos, idx, CAST(regexp_extract(o, '[0-9]+') AS BIGINT) AS len, right(o, 1) AS op FROM (
    SELECT record_id, pos, unnest(l) AS o, unnest(range(0, len(l))) AS idx FROM (SELECT record_id, pos, regexp_extract_all(coalesce(cigar, ''), '[0-9]+[MIDNSHP=X]') AS l FROM rd))),
 pl AS (SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M','I','S','=','X') THEN len ELSE 0 END) OVER b, 0) AS BIGINT) AS rs,
    CAST(pos + coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END) OVER b, 0) AS BIGINT) AS fs FROM ops
    WINDOW b AS (PARTITION BY record_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 nb AS (SELECT *, last_value(CASE WHEN op IN ('M','=','X') AND len > 0 THEN fs + len - 1 END IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pa,
    first_value(CASE WHEN op IN ('M','=','X') THEN fs END IGNORE NULLS) OVER f AS na, first_value(CASE WHEN op IN ('M','=','X') THEN rs END IGNORE NULLS) OVER f AS nr FROM pl
    WINDOW f AS (PARTITION BY record_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


def _place(alias: str, offset: str, right: bool) -> str:
    inserted = f"coalesce({alias}.na, {alias}.pa, h.pos)" if right else f"coalesce({alias}.pa, h.pos)"
    return f"""CASE WHEN {alias}.op IN ('M','=','X') THEN {alias}.fs + {offset} - {alias}.rs WHEN {alias}.op = 'I' THEN {inserted}
   WHEN {alias}.op = 'S' THEN CASE WHEN {alias}.pa IS NULL OR {alias}.na IS NULL THEN coalesce({alias}.pa, {alias}.na, h.pos)
     WHEN {offset} - {alias}.rs = {alias}.nr - ({offset}) THEN least({alias}.pa, {alias}.na)
     WHEN {offset} - {alias}.rs < {alias}.nr - ({offset}) THEN {alias}.pa ELSE {alias}.na END ELSE h.pos END"""


def _located(patterns: list[str], strand: Strand = Strand.COMPLETE, where: str = "true") -> str:
    """CTE loc: hits with p_min and p_max."""
    on = lambda a, off: f"{a}.record_id = h.record_id AND {a}.op IN ('M','I','S','=','X') AND {a}.rs <= {off} AND {off} < {a}.rs + {a}.len"
    end = "h.off + h.w - 1"
    return f"""{_hits(patterns, strand, where)}, {_OPS}, ends AS (SELECT h.*, {_place('a', 'h.off', False)} AS x, {_place('z', end, True)} AS y
  FROM hit h LEFT JOIN nb a ON {on('a', 'h.off')} LEFT JOIN nb z ON {on('z', end)}),
 loc AS (SELECT *, CAST(least(x, y) AS BIGINT) AS p_min, CAST(greatest(x, y) AS BIGINT) AS p_max FROM ends)"""


_REPORT = "SELECT pattern, strand, chrom, p_min, p_max, read_id FROM loc"
_SA_KEY = "translate(substr(seq, off + 1), 'ACGTN', 'ABCDE') || 'F'"
_ORD = f"CAST(row_number() OVER (ORDER BY pattern, strand <> '+', chrom, p_min, p_max, read_id, {_SA_KEY}) - 1 AS BIGINT) AS ord"


def _count(patterns: list[str], strand: Strand = Strand.COMPLETE) -> str:
    return f"WITH {_hits(patterns, strand)} SELECT pattern, count(off) AS n FROM (SELECT DISTINCT pattern FROM pat) LEFT JOIN hit USING (pattern) GROUP BY pattern"


def _greedy(patterns: list[str]) -> str:
    return f"""WITH RECURSIVE {_hits(patterns)}, ho AS (SELECT pattern, record_id, w, off FROM hit),
 walk AS (SELECT pattern, record_id, w, min(off) AS place FROM ho GROUP BY ALL
  UNION ALL SELECT k.pattern, k.record_id, k.w, (SELECT min(off) FROM ho WHERE ho.pattern = k.pattern AND ho.record_id = k.record_id AND ho.off >= k.place + k.w) AS nx
  FROM walk k WHERE k.place IS NOT NULL)
 SELECT pattern, count(place) AS n FROM (SELECT DISTINCT pattern FROM pat) LEFT JOIN walk USING (pattern) GROUP BY pattern"""


def _region(pattern: str, chrom: str, a: int, b: int, select: str) -> str:
    return f"WITH {_located([pattern])} SELECT {select} FROM loc WHERE chrom = '{chrom}' AND p_min <= {b} AND p_max >= {a}"


BIG = 1 << 62
_SPAN = "coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))), 0)"
_GREEDY_WINDOWS = f"""firsts AS (SELECT build_id, chrom_id, min(s_start) AS l FROM ordered_reads GROUP BY ALL),
 wl AS (SELECT * FROM firsts UNION ALL
   SELECT build_id, chrom_id, (SELECT min(s_start) FROM ordered_reads o WHERE o.build_id = wl.build_id AND o.chrom_id = wl.chrom_id AND o.s_start >= wl.l + {WINDOW}) AS l FROM wl WHERE l IS NOT NULL),
 ws AS (SELECT * FROM wl WHERE l IS NOT NULL), rw AS (SELECT o.*, w.l FROM ordered_reads o ASOF JOIN ws w ON o.build_id = w.build_id AND o.chrom_id = w.chrom_id AND o.s_start >= w.l)"""
_WINDOWS = f"""WITH RECURSIVE {SCOPE}, {_GREEDY_WINDOWS}, lastr AS (SELECT build_id, max(read_id) AS m FROM ordered_reads GROUP BY 1),
 wt AS (SELECT w.build_id, w.chrom_id, l, CAST(max(w.s_start + w.l_seq) - CASE WHEN max(w.read_id) = any_value(m) THEN 1 ELSE 0 END AS BIGINT) AS r, min(w.read_id) AS first_read_id, max(w.read_id) AS last_read_id,
   arg_min(w.pos, w.read_id) AS genomic_start, CAST(max(w.pos + greatest({_SPAN} - 1, 0)) AS BIGINT) AS genomic_end
   FROM rw w JOIN rd USING (record_id) JOIN lastr ON lastr.build_id = w.build_id GROUP BY w.build_id, w.chrom_id, l)"""

_FILL = "list_transform(range(1, l_seq + 1), lambda i: CASE WHEN qual[i] IS NULL OR qual[i] = 255 THEN 0 ELSE qual[i] END)"
_QUAL = f"WITH {SCOPE}, ql AS (SELECT record_id, {_FILL} AS qual FROM rd)"

_SA = """WITH sx AS (SELECT bundle_id AS text_id, unnest(range(0, length(s) + 1)) AS s_pos, s FROM seq_bundles),
 sa AS (SELECT text_id, s_pos, row_number() OVER (PARTITION BY text_id ORDER BY translate(substr(s, s_pos + 1), 'ACGTN#', 'BCDEFG')) - 1 AS row,
   CASE WHEN s_pos = length(s) THEN '$' ELSE substr(s, s_pos + 1, 1) END AS code, CASE WHEN s_pos = 0 THEN '$' ELSE substr(s, s_pos, 1) END AS bwt FROM sx)"""
_CODES = "(VALUES ('$', 0), ('A', 1), ('C', 2), ('G', 3), ('T', 4), ('N', 5), ('#', 6)) AS k(code, ord)"

#: Bytes of a number with seven bits a byte.
_VARINT = "(1 + " + " + ".join(f"CAST({{v}} >= {1 << 7 * k} AS BIGINT)" for k in range(1, 6)) + ")"
_BEFORE = "CAST(coalesce(sum(n) OVER (PARTITION BY {} ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"

_regions = ", ".join(f"('{r}', '{c}', {a}, {b})" for r, c, a, b in REGIONS)

ORACLES = {
    "ingest_filter": f"WITH {INCLUDED} SELECT record_id, chrom_id, pos, flag, mapq, CASE WHEN seq IS NULL OR seq IN ('', '*') THEN NULL ELSE length(seq) END AS l_seq FROM inc",
    "normalised_bases": f"WITH {SCOPE} SELECT record_id, seq FROM rd",
    "contigs": "SELECT chrom_id, contig_name FROM contigs",
    "order_reads": "SELECT * FROM ordered_reads",
    "read_starts": "SELECT read_id, s_start FROM ordered_reads",
    "s_length": "SELECT build_id, CAST(sum(l_seq) + count(*) - 1 AS BIGINT) AS s_length FROM ordered_reads GROUP BY 1",
    "cigar_ops": f"WITH {SCOPE}, {_OPS} SELECT record_id, CAST(idx AS BIGINT) AS op_idx, op, len, rs AS read_start, fs AS ref_start, pa AS prev_aligned_ref, na AS next_aligned_ref, nr AS next_aligned_read FROM nb",
    "cigar_ref_span": f"WITH {SCOPE} SELECT record_id, CAST({_SPAN} AS BIGINT) AS span FROM rd",
    "reverse_complement": f"WITH {SCOPE} SELECT record_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM rd",
    "pattern_orientations": f"""WITH p(pattern) AS (VALUES {", ".join(f"('{p}')" for p in dict.fromkeys([*MOTIFS, *PALINDROMES, "ACGNT"]))})
      SELECT pattern, pattern AS word, '+' AS strand FROM p UNION ALL
      SELECT pattern, translate(reverse(pattern), 'ACGT', 'TGCA'), '-' FROM p WHERE translate(reverse(pattern), 'ACGT', 'TGCA') <> pattern""",
    "batch_motif_count": _count(MOTIFS),
    "global_count_complete": _count(["ACGTA"]),
    "global_count_single": _count(MOTIFS, Strand.SINGLE),
    "global_count_palindrome": _count(PALINDROMES),
    "global_count_nonoverlap": _greedy(["AAA", "ACAGACAG", *MOTIFS]),
    "global_count_with_n": _count(["NNNN", "ANC", "NNCAN"]),
    "global_exists": f"WITH {SCOPE} SELECT count(*) > 0 AS exists FROM rd WHERE contains(seq, 'GATTACA') OR contains(seq, 'TGTAATC')",
    "global_exists_absent": f"WITH {SCOPE} SELECT count(*) > 0 AS exists FROM rd WHERE contains(seq, 'ACGTNACGTNACGT')",
    "global_exists_threshold": f"WITH {_hits(['ACGT'])} SELECT count(*) >= 50 AS exists FROM hit",
    "locate_all": f"WITH {_located(MOTIFS)} SELECT {_ORD}, pattern, strand, chrom, p_min, p_max, read_id FROM loc",
    "locate_single_strand": f"WITH {_located(MOTIFS, Strand.SINGLE)} {_REPORT}",
    "locate_clipped": f"WITH {_located(MOTIFS, where='contains(cigar, chr(83))')} {_REPORT}",
    "locate_indel": f"WITH {_located(['ACG', 'TTG', 'CCA'], where='regexp_matches(cigar, chr(91) || chr(73) || chr(68) || chr(78) || chr(93))')} {_REPORT}",
    "locate_topk": f"WITH {_located(['ACGT'])} SELECT {_ORD}, pattern, strand, chrom, p_min, p_max, read_id FROM loc ORDER BY ord LIMIT 25",
    "locate_suffix_order": f"WITH {_located(['TTAGGG'])} SELECT CAST(row_number() OVER (ORDER BY strand <> '+', {_SA_KEY}, read_id) - 1 AS BIGINT) AS ord, pattern, strand, chrom, p_min, p_max, read_id FROM loc ORDER BY ord LIMIT 40",
    "locate_many_words": f"""WITH {SCOPE}, six AS (SELECT substr(seq, p, 6) AS k FROM (SELECT seq, unnest(range(1, l_seq - 4)) AS p FROM rd)),
      f AS (SELECT k AS pattern, '+' AS strand FROM six WHERE regexp_matches(k, '^GA[ACGT]+$')
        UNION ALL SELECT translate(reverse(k), 'ACGT', 'TGCA'), '-' FROM six WHERE regexp_matches(k, '^[ACGT]+TC$') AND translate(reverse(k), 'ACGT', 'TGCA') <> k)
      SELECT pattern, strand, count(*) AS n FROM f GROUP BY ALL""",
    "word_postings": f"""WITH {SCOPE}, six AS (SELECT DISTINCT record_id, substr(seq, p, 6) AS k FROM (SELECT record_id, seq, unnest(range(1, l_seq - 4)) AS p FROM rd)),
      c AS (SELECT translate(k, 'ACGT', '0123') AS d, count(*) AS n_reads FROM six WHERE NOT contains(k, 'N') GROUP BY k)
      SELECT {' + '.join(f'CAST(substr(d, {i + 1}, 1) AS BIGINT) * {4 ** (5 - i)}' for i in range(6))} AS word, n_reads FROM c""",
    "count_by_postings": _count(["TTGGGATTGGGA"]),
    "locate_bed": f"WITH {_located(['TTAGGG'])} SELECT chrom, p_min - 1 AS start, p_max AS \"end\", 'read_' || CAST(read_id AS VARCHAR) AS name, CAST(0 AS BIGINT) AS score, strand FROM loc",
    "locate_json_summary": f"WITH {_hits(['TTAGGG'])} SELECT '{{\"mode\":\"sorted\",\"count\":' || CAST(count(*) AS VARCHAR) || '}}' AS json FROM hit",
    "locate_json_document": f"""WITH {_located(['ACGT'])}, t AS (SELECT {_ORD}, strand, chrom, p_min, p_max, read_id FROM loc ORDER BY ord LIMIT 25)
      SELECT '{{"mode":"sorted","matches":[' || string_agg('{{"strand":"' || strand || '","chrom":"' || chrom || '","p_min":' || p_min || ',"p_max":' || p_max || ',"read_id":' || read_id || '}}', ',' ORDER BY ord) || '],"count":' || count(*) || '}}' AS json FROM t""",
    "stream_directory": f"""WITH {SCOPE}, o AS (SELECT read_id, l_seq, coalesce(octet_length(aux), 0) AS a, regexp_extract_all(CASE WHEN cigar <> '*' THEN cigar ELSE '' END, '[0-9]+[MIDNSHP=X]') AS l FROM rd),
      v AS (SELECT *, len(l) AS c, list_transform(l, lambda x: CAST(x[:-2] AS BIGINT) * 16) AS vs FROM o),
      e AS (SELECT read_id, unnest([{{'s': 'seq', 'n': l_seq}}, {{'s': 'qual', 'n': l_seq}}, {{'s': 'map', 'n': 1}}, {{'s': 'meta', 'n': 2 + {_VARINT.format(v='c')} + coalesce(list_sum(list_transform(vs, lambda x: {_VARINT.format(v='x')})), 0) + a}}]) AS x FROM v),
      b AS (SELECT x.s AS stream, read_id // 1024 AS block_id, min(read_id) AS first_read_id, count(*) AS n_reads, CAST(sum(x.n) AS BIGINT) AS block_length FROM e GROUP BY 1, 2)
      SELECT *, CAST(coalesce(sum(block_length) OVER (PARTITION BY stream ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM b""",
    "region_exists_pruned": _region("GATTACA", "chrM", 1_000, 9_000, "count(*) >= 1 AS once, count(*) >= 3 AS thrice"),
    "region_count": _region("ACGT", "chrM", 1_000, 9_000, "count(*) AS region_count"),
    "region_count_unknown_chrom": "SELECT CAST(0 AS BIGINT) AS region_count",
    "region_exists_t1": _region("GATTACA", "chrM", 0, BIG, "count(*) >= 1 AS region_exists"),
    "region_exists_t5": _region("ACGT", "chr1", 0, BIG, "count(*) >= 5 AS region_exists"),
    "region_count_pruned": _region("ACGT", "chrM", 1_000, 9_000, "count(*) AS region_count"),
    "batch_region_motif_count": f"WITH {_located(MOTIFS)}, reg(region, chrom, a, b) AS (VALUES {_regions}) SELECT region, pattern, count(*) AS n FROM loc JOIN reg USING (chrom) WHERE p_min <= b AND p_max >= a GROUP BY ALL",
    "count_by_chrom": f"WITH {_hits(['ACGT'])} SELECT c.contig_name AS chrom, count(off) AS n FROM contigs c LEFT JOIN hit ON hit.chrom = c.contig_name GROUP BY 1",
    "count_rollup": f"WITH {_hits(['TTAGGG'])} SELECT chrom_id, strand, count(*) AS n FROM hit GROUP BY ROLLUP (chrom_id, strand)",
    "reads_containing": f"WITH {_hits(['ACGT', 'TTAGGG', 'GATTACA'], Strand.SINGLE)} SELECT pattern, count(DISTINCT record_id) AS n_reads, count(*) AS n, count(*) / count(DISTINCT record_id) AS ratio FROM hit GROUP BY 1",
    "reads_without_motif": f"WITH {SCOPE} SELECT record_id FROM rd WHERE NOT contains(seq, 'ACGT')",
    "quality_postfilter": f"WITH {_located(['ACGT', 'TTAGGG'])} {_REPORT} WHERE list_sum({_FILL}) >= 20 * l_seq",
    "repeated_deliveries": "SELECT source_file_id, bam_offset, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id FROM reads_raw GROUP BY 1, 2 HAVING count(*) > 1",
    "windows_table": f"{_WINDOWS} SELECT * FROM wt",
    "window_prune_candidates": f"{_WINDOWS} SELECT * FROM wt WHERE chrom_id = 27 AND genomic_start <= 9000 AND genomic_end >= 1000",
    "read_to_window": f"WITH RECURSIVE {_GREEDY_WINDOWS} SELECT read_id, build_id, l AS window_start FROM rw",
    "text_place_to_read": f"""WITH {_hits(['TTAGGG'])} SELECT build_id, s_start + off AS s_pos, read_id, off AS "offset", false AS is_separator FROM hit
      UNION ALL SELECT build_id, s_start + l_seq, read_id, l_seq, true FROM ordered_reads
      WHERE read_id NOT IN (SELECT max(read_id) FROM ordered_reads GROUP BY build_id)""",
    "map_delta_encode": "SELECT read_id, pos - coalesce(lag(pos) OVER (PARTITION BY build_id, chrom_id ORDER BY read_id), 0) AS delta FROM ordered_reads",
    "map_delta_decode": "SELECT read_id, pos FROM ordered_reads",
    "abs_pos_dense": "SELECT read_id, pos FROM ordered_reads",
    "abs_pos_sparse": "SELECT read_id, build_id, chrom_id, pos FROM ordered_reads QUALIFY row_number() OVER (PARTITION BY build_id, chrom_id ORDER BY read_id) = 1",
    "qual_fill_missing": f"{_QUAL} SELECT * FROM ql",
    "qual_lossy_bin": f"{_QUAL} SELECT record_id, list_transform(qual, lambda q: CAST(least(93, (q // 11) * 11 + 5) AS INTEGER)) AS qual FROM ql",
    "qual_rans_delta": f"{_QUAL} SELECT record_id, list_transform(qual, lambda q, i: CASE WHEN i = 1 THEN q ELSE CAST((q - qual[i - 1] + 128 + 256) % 256 AS INTEGER) END) AS qual FROM ql",
    "qual_rans_undelta": f"{_QUAL} SELECT * FROM ql",
    "qual_cycle_transpose": f"{_QUAL}, e AS (SELECT record_id, unnest(qual) AS q, unnest(range(0, len(qual))) AS i FROM ql) SELECT record_id, list(q ORDER BY i % 10, i) AS qual FROM e GROUP BY 1 UNION ALL SELECT record_id, qual FROM ql WHERE len(qual) = 0",
    "qual_block_directory": f"""WITH {SCOPE}, b AS (SELECT read_id // 1024 AS block_id, min(read_id) AS first_read_id, count(*) AS n_reads, CAST(sum(coalesce(len(qual), 0)) AS BIGINT) AS block_length FROM rd GROUP BY 1)
      SELECT *, CAST(coalesce(sum(block_length) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM b""",
    "suffix_array": f"{_SA} SELECT text_id, row, s_pos FROM sa",
    "bwt": f"{_SA} SELECT text_id, row, bwt AS symbol FROM sa",
    "c_array": f"{_SA}, m AS (SELECT text_id, k.code, k.ord, count(sa.code) AS n FROM (SELECT DISTINCT text_id FROM sx) t CROSS JOIN {_CODES} LEFT JOIN sa USING (text_id, code) GROUP BY ALL) SELECT text_id, code, {_BEFORE.format('text_id', 'ord')} AS c FROM m",
    "lf_mapping": f"{_SA}, n AS (SELECT text_id, row, bwt, row_number() OVER (PARTITION BY text_id, bwt ORDER BY row) - 1 AS occ FROM sa), c AS (SELECT text_id, code, min(row) AS c FROM sa GROUP BY ALL) SELECT n.text_id, row, c + occ AS lf FROM n JOIN c ON c.text_id = n.text_id AND c.code = n.bwt",
    "occ_checkpoints": f"{_SA}, c AS (SELECT DISTINCT text_id, row // 64 AS checkpoint FROM sa), m AS (SELECT c.text_id, checkpoint, k.code, count(sa.bwt) AS n FROM c CROSS JOIN {_CODES} LEFT JOIN sa ON sa.text_id = c.text_id AND sa.row // 64 = checkpoint AND sa.bwt = k.code GROUP BY ALL) SELECT text_id, checkpoint, code, {_BEFORE.format('text_id, code', 'checkpoint')} AS n FROM m",
    "bwt_runs": f"{_SA}, d AS (SELECT text_id, CASE WHEN lag(bwt) OVER (PARTITION BY text_id ORDER BY row) = bwt THEN 0 ELSE 1 END AS x FROM sa) SELECT text_id, CAST(sum(x) AS BIGINT) AS runs, count(*) - 1 AS length, (count(*) - 1) / sum(x) AS ratio FROM d GROUP BY 1",
    "sa_samples": f"{_SA} SELECT text_id, row // 64 AS k, s_pos FROM sa WHERE row % 64 = 0",
    "isa_samples": f"{_SA} SELECT text_id, s_pos // 64 AS k, row FROM sa WHERE s_pos % 64 = 0",
    "sa_range_count": f"{_SA} SELECT text_id, count(*) AS n FROM sa WHERE row % 8 = 0 AND row // 8 >= 10 AND row // 8 < 60 AND s_pos BETWEEN 100 AND 900 GROUP BY 1",
    "backward_search": f"{_SA} SELECT text_id, coalesce(min(row) FILTER (WHERE substr(s, s_pos + 1, 4) = 'ACGT'), 0) AS lo, coalesce(max(row + 1) FILTER (WHERE substr(s, s_pos + 1, 4) = 'ACGT'), 0) AS hi FROM sa JOIN sx USING (text_id, s_pos) GROUP BY 1",
    "text_from_bwt": "SELECT bundle_id AS text_id, unnest(range(1, len(l) + 1)) AS read_idx, unnest(l) AS seq FROM (SELECT bundle_id, string_split(s, '#') AS l FROM seq_bundles)",
    "rle_encode": f"{_SA}, d AS (SELECT *, CASE WHEN lag(bwt) OVER (PARTITION BY text_id ORDER BY row) = bwt THEN 0 ELSE 1 END AS x FROM sa), r AS (SELECT *, sum(x) OVER (PARTITION BY text_id ORDER BY row) - 1 AS run FROM d) SELECT text_id, CAST(run AS BIGINT) AS run, bwt AS symbol, count(*) AS n FROM r GROUP BY ALL",
    "occ_rank": f"{_SA}, p AS (SELECT bundle_id AS text_id, length(s) + 1 AS rows, CAST(unnest([0, 1, 63, 64, 65, 128, 500]) AS BIGINT) AS place FROM seq_bundles) SELECT p.text_id, place, k.code AS symbol, count(sa.row) AS n FROM p CROSS JOIN {_CODES} LEFT JOIN sa ON sa.text_id = p.text_id AND sa.row < place AND sa.bwt = k.code WHERE place <= rows GROUP BY ALL",
    "fm_locate": "SELECT bundle_id AS text_id, p - 1 AS s_pos FROM (SELECT *, unnest(range(1, length(s) + 1)) AS p FROM seq_bundles) WHERE substr(s, p, 4) = 'ACGT'",
    "fm_locate_bidir": "SELECT bundle_id AS text_id, p - 1 AS s_pos FROM (SELECT *, unnest(range(1, length(s) + 1)) AS p FROM seq_bundles) WHERE substr(s, p, 7) = 'GATTACA'",
    "mtf_encode": f"""{_SA}, x AS (SELECT text_id, row, bwt, {', '.join(f"coalesce(max(row) FILTER (WHERE bwt = '{c}') OVER w, {-1 - i}) AS e{i}" for i, c in enumerate('ACGTN#'))} FROM sa
        WINDOW w AS (PARTITION BY text_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      p AS (SELECT *, CASE bwt {' '.join(f"WHEN '{c}' THEN e{i}" for i, c in enumerate('ACGTN#'))} END AS e FROM x WHERE bwt <> '$')
      SELECT text_id, row // 65536 AS block, count(*) AS n, list(CAST({' + '.join(f'CAST(e{i} > e AS BIGINT)' for i in range(6))} AS BIGINT) ORDER BY row) AS places FROM p GROUP BY ALL""",
    "seq_codec": f"{_SA} SELECT text_id, row // 65536 AS block, string_agg(bwt, '' ORDER BY row) AS symbols FROM sa GROUP BY ALL",
    "meta_codec": f"""WITH {SCOPE}, o AS (SELECT record_id, aux, regexp_extract_all(CASE WHEN cigar <> '*' THEN cigar ELSE '' END, '[0-9]+[MIDNSHP=X]') AS l FROM rd),
      v AS (SELECT record_id, coalesce(octet_length(aux), 0) AS a, len(l) AS n, list_transform(l, lambda x: CAST(x[:-2] AS BIGINT) * 16 + strpos('MIDNSHP=X', x[-1:]) - 1) AS vs FROM o)
      SELECT record_id, CAST(2 + {_VARINT.format(v='n')} + coalesce(list_sum(list_transform(vs, lambda x: {_VARINT.format(v='x')})), 0) + a AS BIGINT) AS n_bytes, CAST(12 + 5 * n + a AS BIGINT) AS n_fixed FROM v""",
    **{name: f"WITH {SCOPE} SELECT record_id, flag, CASE WHEN cigar <> '*' THEN cigar ELSE '' END AS cigar, coalesce(aux, ''::BLOB) AS aux FROM rd" for name in ("meta_decode", "meta_decode_fixed")},
    "bundle_reads": "SELECT bundle_id, unnest(range(0, len(l))) AS read_idx, unnest(l) AS seq FROM (SELECT bundle_id, string_split(s, '#') AS l FROM seq_bundles)",
    "index_info": f"{_WINDOWS}, per AS (SELECT build_id, count(*) AS n_reads, CAST(sum(l_seq) + count(*) - 1 AS BIGINT) AS s_length, count(DISTINCT chrom_id) AS n_contigs_with_reads, count(DISTINCT source_file_id) AS n_files, min(l_seq) AS shortest, max(l_seq) AS longest FROM ordered_reads GROUP BY 1) SELECT per.*, n_windows FROM per JOIN (SELECT build_id, count(*) AS n_windows FROM wt GROUP BY 1) USING (build_id)",
    "index_counts": _count(MOTIFS),
    "index_locate": f"WITH {_located(['TTAGGG'])} SELECT {_ORD}, strand, chrom, p_min, p_max, read_id FROM loc",
    "index_regions": f"WITH {_located(['ACGT'])}, reg(region, chrom, a, b) AS (VALUES {_regions}) SELECT region, count(p_min) AS n, count(p_min) >= 50 AS fifty FROM reg LEFT JOIN loc ON loc.chrom = reg.chrom AND p_min <= b AND p_max >= a GROUP BY region",
    "index_reads": "SELECT record_id, read_id, build_id, s_start, chrom_id, l_seq FROM ordered_reads",
    "index_verify": """SELECT unnest(['checksum_seq', 'checksum_qual', 'checksum_meta', 'checksum_map', 'checksum_order', 'checksum_windows', 'checksum_contigs', 'checksum_directory', 'n_reads', 'n_windows', 'n_contigs', 'ordering_digest',
      'dense_ids', 'order', 'text_places', 'contigs', 'positions', 'lengths', 'windows_cover', 'windows_filled', 'windows_adjoin', 'windows_order', 'windows_begin']) AS "check", CAST(0 AS BIGINT) AS fresh, unnest(range(23)) = 0 AS damaged""",
    "index_facts": f"{_WINDOWS} SELECT (SELECT count(*) FROM ordered_reads) AS n_reads, (SELECT CAST(sum(l_seq) + count(*) - count(DISTINCT build_id) AS BIGINT) FROM ordered_reads) AS s_length, (SELECT count(*) FROM wt) AS n_windows, (SELECT count(*) FROM contigs) AS chrom_count, (SELECT count(DISTINCT source_file_id) FROM ordered_reads) AS n_files, CAST({WINDOW} AS BIGINT) AS window_size, true AS is_lossless, 'BASE' AS mode, 'strand_complete' AS strand_mode",
    "bits_rank": "SELECT build_id, s_start + l_seq - 1 AS place, row_number() OVER (PARTITION BY build_id ORDER BY s_start) AS rank FROM ordered_reads",
    "bits_select": "WITH n AS (SELECT build_id, read_id + 1 AS k FROM ordered_reads), s AS (SELECT build_id, s_start AS place, row_number() OVER (PARTITION BY build_id ORDER BY s_start) AS k FROM ordered_reads) SELECT n.build_id, n.k, place FROM n JOIN s ON s.build_id = n.build_id AND s.k = n.k",
    "bits_access": "WITH e AS (SELECT build_id, max(s_start + l_seq) AS stop FROM ordered_reads GROUP BY 1), p AS (SELECT build_id, unnest([s_start, s_start + 1]) AS place FROM ordered_reads) SELECT p.build_id, place, EXISTS (SELECT 1 FROM ordered_reads o WHERE o.build_id = p.build_id AND o.s_start = place) AS bit FROM p JOIN e ON e.build_id = p.build_id WHERE place < stop",
    "bam_round_trip": f"WITH {SCOPE} SELECT qname, flag, chrom, pos, coalesce(mapq, 255) AS mapq, coalesce(cigar, '*') AS cigar, seq, {_FILL} AS qual, coalesce(aux, ''::BLOB) AS aux FROM rd",
    "sam_round_trip": f"WITH {SCOPE} SELECT qname, flag, chrom, pos, coalesce(mapq, 255) AS mapq, coalesce(cigar, '*') AS cigar, seq, {_FILL} AS qual FROM rd",
    "bam_header_contigs": "SELECT row_number() OVER (ORDER BY contig_name) - 1 AS chrom_id, contig_name, (SELECT count(*) FROM ordered_reads o WHERE o.chrom_id = c.chrom_id) AS n_reads FROM contigs c",
    "verify_windows": "SELECT unnest(['windows_cover', 'windows_filled', 'windows_adjoin', 'windows_order', 'windows_begin']) AS \"check\", CAST(0 AS BIGINT) AS bad",
    "verify_text_index": "SELECT unnest(['sa_permutation', 'bwt_symbols', 'lf', 'search', 'locate']) AS \"check\", CAST(0 AS BIGINT) AS bad",
    "verify_text_index_damaged": "SELECT unnest(['sa_permutation', 'bwt_symbols', 'lf', 'search', 'locate']) AS \"check\", unnest([false, true, true, true, true]) AS found",
    "verify_damaged": """WITH d AS (SELECT read_id, build_id, source_file_id, bam_offset, record_id, CASE WHEN read_id = 20 THEN 999 ELSE chrom_id END AS chrom_id, CASE WHEN read_id = 4 THEN 0 ELSE pos END AS pos,
        CASE WHEN read_id = 9 THEN 0 ELSE l_seq END AS l_seq, CASE WHEN read_id = 15 THEN s_start + 3 ELSE s_start END AS s_start FROM ordered_reads WHERE read_id <> 30),
      x AS (SELECT d.*, b.read_id AS before, b.build_id AS bb, b.read_id IS NOT NULL AND (b.build_id, b.chrom_id, b.pos, b.source_file_id, b.bam_offset, b.record_id) > (d.build_id, d.chrom_id, d.pos, d.source_file_id, d.bam_offset, d.record_id) AS back, b.s_start + b.l_seq + 1 AS due
        FROM d LEFT JOIN d b ON b.read_id = d.read_id - 1),
      s AS (SELECT count(*) FILTER (WHERE before IS NULL AND read_id <> 0) AS dense_ids, count(*) FILTER (WHERE back) AS "order", count(*) FILTER (WHERE s_start <> CASE WHEN bb = build_id THEN due ELSE 0 END) AS text_places,
        count(*) FILTER (WHERE chrom_id NOT IN (SELECT chrom_id FROM contigs)) AS contigs, count(*) FILTER (WHERE pos < 1) AS positions, count(*) FILTER (WHERE l_seq < 1) AS lengths FROM x)
      UNPIVOT s ON COLUMNS(*) INTO NAME "check" VALUE bad""",
    "verify_invariants": "SELECT unnest(['dense_ids', 'order', 'text_places', 'contigs', 'positions', 'lengths']) AS \"check\", CAST(0 AS BIGINT) AS bad",
    **{name: f"WITH {SCOPE} SELECT read_id, qname, {flag} AS flag, {chrom} AS chrom, {pos} AS pos, mapq, {cig} AS cigar, {seq} AS seq, {qual} AS qual, {aux} AS aux FROM rd" for name, (flag, chrom, pos, cig, seq, qual, aux) in {
        "reconstruct_all": ("flag", "chrom", "pos", "cigar", "seq", _FILL, "aux"),
        "reconstruct_streams": ("CAST(0 AS BIGINT)", "chrom", "pos", "CAST(l_seq AS VARCHAR) || 'M'", "repeat('N', l_seq)", "list_transform(range(0, l_seq), lambda i: CAST(255 AS INTEGER))", "CAST(NULL AS BLOB)"),
        "reconstruct_qual_meta": ("flag", "CAST(NULL AS VARCHAR)", "CAST(0 AS BIGINT)", "cigar", "repeat('N', l_seq)", _FILL, "aux"),
    }.items()},
    "reconstruct_read_ids": f"WITH {SCOPE}, w AS (SELECT unnest([5, 3, 3, 40]) AS read_id, CAST(unnest(range(0, 4)) AS BIGINT) AS request) SELECT read_id, request, qname, flag, chrom, pos, mapq, cigar, seq, {_FILL} AS qual, aux FROM rd JOIN w USING (read_id)",
}
