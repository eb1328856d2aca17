"""The queries of this folder and their SQL."""

from __future__ import annotations

from .conversation_trie import OP13_SQL, op13_conversation_trie
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .line_dedup import op10_line_dedup
from .order_minhash import op11_order_minhash
from .packing import op7_packing
from .quality_model import op2_quality_model
from .quality_rules import op8_quality_rules
from .sample_pieces import op9_sample_pieces
from .secrets import op6_secret_scan
from .simhash import op4_simhash
from .token_counts import op3_token_counts
from .toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_quality_model, op3_token_counts, op4_simhash, op5_exact_dedup, op6_secret_scan, op7_packing,
    op8_quality_rules, op9_sample_pieces, op10_line_dedup, op11_order_minhash, op12_filter_audit, op13_conversation_trie)}
SQL = {"op5_exact_dedup": OP5_SQL, "op12_filter_audit": OP12_SQL, "op13_conversation_trie": OP13_SQL}
