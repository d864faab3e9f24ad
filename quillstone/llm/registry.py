"""Queries and DuckDB SQL of the training-data operators."""

from .decontaminate import op7_decontaminate
from .licenses import OP9_SQL, op9_licenses
from .near_dedup import op4_near_dedup
from .packing import op10_packing
from .pii import OP2_SQL, op2_pii
from .search import op1_search
from .token_counts import op3_token_counts
from .token_store import op6_token_store
from .toxicity import op8_toxicity
from .url_filters import OP5_SQL, op5_url_filters

QUERIES = {
    "op1_search": op1_search,
    "op2_pii": op2_pii,
    "op3_token_counts": op3_token_counts,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_token_store": op6_token_store,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_packing": op10_packing,
}
#: The other queries are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op2_pii": OP2_SQL,
    "op5_url_filters": OP5_SQL,
    "op9_licenses": OP9_SQL,
}
