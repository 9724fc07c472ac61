"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from strandlake.llm import documents, oracle, reads

_READS = "p1_found p1_shared_amount p2_found p2_slices p2_percentiles p2_rank_error p2_compression p4_found p4_intervals p4_check p5_found p5_consensus p5_agreement p5_planted"
_DOCUMENTS = "p7_found p7_containers p7_fill p7_check p8_found p8_leaks p8_clean_documents p9_found p9_levels p9_boards p9_held_out p9_agreement"

QUERIES = {name: getattr(module, name) for module, names in ((reads, _READS), (documents, _DOCUMENTS)) for name in names.split()}

ORACLES = oracle.ORACLES
