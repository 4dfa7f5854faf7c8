"""The subpackage's queries and their SQL."""

from __future__ import annotations

from lattica.llm.ann import op8_nearest_vectors
from lattica.llm.archive import op2_token_archive
from lattica.llm.html import op6_html_extraction
from lattica.llm.language import op10_language_id
from lattica.llm.media import op4_transport_streams
from lattica.llm.mixing import OP9_SQL, op9_source_mixing
from lattica.llm.near_dups import OP7_SQL, op7_near_duplicates
from lattica.llm.packing import op3_packing
from lattica.llm.shards import op1_sharding
from lattica.llm.token_counts import op5_token_counts

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_token_archive": op2_token_archive,
    "op3_packing": op3_packing,
    "op4_transport_streams": op4_transport_streams,
    "op5_token_counts": op5_token_counts,
    "op6_html_extraction": op6_html_extraction,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_source_mixing": op9_source_mixing,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {"op7_near_duplicates": OP7_SQL, "op9_source_mixing": OP9_SQL}
