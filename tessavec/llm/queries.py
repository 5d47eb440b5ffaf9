"""The queries of the training-data operators and, where SQL can express one, the equivalent for DuckDB."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .embedding_dedup import OP1_SQL, op1_embedding_dedup
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .ngram_join import op6_ngram_join
from .packing import op2_best_fit_packing
from .secrets import op10_secret_scan
from .tokenfile import op4_token_files
from .tokens import op9_token_counts
from .toxicity import op7_toxicity
from .urlfilter import op8_url_filter

QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_best_fit_packing, op3_exact_dedup, op4_token_files, op5_byte_bpe, op6_ngram_join, op7_toxicity, op8_url_filter, op9_token_counts, op10_secret_scan)}
ORACLE_SQL = {"op1_embedding_dedup": OP1_SQL, "op3_exact_dedup": OP3_SQL}
