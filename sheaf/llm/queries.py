"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from sheaf.llm.bpe import op9_byte_bpe
from sheaf.llm.cotrain import op7_cotraining_quality
from sheaf.llm.decontaminate import op8_decontaminate
from sheaf.llm.embed_dedup import OP5_SQL, op5_embedding_dedup
from sheaf.llm.line_dedup import OP3_SQL, op3_line_dedup
from sheaf.llm.order_minhash import op2_order_minhash
from sheaf.llm.secret_scan import op6_secret_scan
from sheaf.llm.sharding import OP10_SQL, op10_stratified_interleave
from sheaf.llm.toxicity import op4_toxicity
from sheaf.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_order_minhash": op2_order_minhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_cotraining_quality": op7_cotraining_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_stratified_interleave": op10_stratified_interleave,
}

ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op3_line_dedup": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "op10_stratified_interleave": OP10_SQL}
