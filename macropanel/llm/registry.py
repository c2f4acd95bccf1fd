"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op1_byte_bpe
from .chat import OP10_SQL, op10_chat
from .embedding_dedup import OP7_SQL, op7_embedding_dedup
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .line_dedup import OP8_SQL, op8_line_dedup
from .mixing import op9_mixing
from .ngram_join import OP3_SQL, op3_ngram_join
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .substring_dedup import OP5_SQL, op5_suffix_array_dedup
from .token_counts import op6_token_counts
from .toxicity import op2_toxicity
from .url_filter import OP13_SQL, op13_url_filter
from .whitening import op12_embedding_whitening

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_chat": op10_chat,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_url_filter": op13_url_filter,
}
ORACLE = {
    "op3_ngram_join": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_suffix_array_dedup": OP5_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_chat": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_url_filter": OP13_SQL,
}
