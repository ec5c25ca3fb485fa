"""Queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from covary.llm.bpe import op2_byte_bpe
from covary.llm.divergence import OP11_SQL, op11_source_divergence
from covary.llm.forest import op13_projection_forest
from covary.llm.langid import op5_language_id
from covary.llm.lm import op10_lm_scores
from covary.llm.mixing import OP9_SQL, op9_mixing
from covary.llm.neardup import OP6_SQL, op6_minhash_dedup
from covary.llm.negatives import OP12_SQL, op12_hard_negatives
from covary.llm.tokens import op1_token_files
from covary.llm.topk import OP4_SQL, op4_topk
from covary.llm.toxicity import op7_toxicity
from covary.llm.vecdup import OP8_SQL, op8_embedding_dedup
from covary.llm.warc import OP3_SQL, op3_warc

QUERIES = {f.__name__: f for f in (op1_token_files, op2_byte_bpe, op3_warc, op4_topk, op5_language_id, op6_minhash_dedup, op7_toxicity, op8_embedding_dedup, op9_mixing, op10_lm_scores, op11_source_divergence, op12_hard_negatives, op13_projection_forest)}
ORACLES = {"op3_warc": OP3_SQL, "op4_topk": OP4_SQL, "op6_minhash_dedup": OP6_SQL, "op8_embedding_dedup": OP8_SQL, "op9_mixing": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_hard_negatives": OP12_SQL}
