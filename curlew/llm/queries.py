"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .embeddings import OP8_SQL, op8_embedding_near_dedup
from .packing import op1_best_fit_packing
from .piece_bpe import op5_merge_dropout
from .quality import op6_quality_classifier
from .simhash import op3_simhash
from .sketch import op10_scaled_sketch
from .suffix_dedup import op4_suffix_dedup
from .token_files import op7_token_files
from .toxicity import op2_toxicity
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_merge_dropout": op5_merge_dropout,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_files": op7_token_files,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_warc": op9_warc,
    "op10_scaled_sketch": op10_scaled_sketch,
}

ORACLE_SQL: dict[str, str] = {
    "op8_embedding_near_dedup": OP8_SQL,
    "op9_warc": OP9_SQL,
}
