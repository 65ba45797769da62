"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from corvane.llm import chat_format, embedding_dedup, jaccard_join, lexical_search, line_dedup, mixing, secret_scan, sharding, topk_search, turn_repair
from corvane.llm.chat_format import op9_chat_format
from corvane.llm.embedding_dedup import op3_embedding_dedup
from corvane.llm.jaccard_join import op4_jaccard_join
from corvane.llm.lexical_search import op11_ranked_search
from corvane.llm.line_dedup import op10_line_dedup
from corvane.llm.mixing import op1_mix_sources
from corvane.llm.quality import op6_quality
from corvane.llm.secret_scan import op5_secret_scan
from corvane.llm.sentencepiece_op import op2_sentencepiece
from corvane.llm.sharding import op12_shard_documents
from corvane.llm.token_files import op7_token_counts
from corvane.llm.topk_search import op8_top_k
from corvane.llm.turn_repair import op13_turn_repair

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_sentencepiece, op3_embedding_dedup, op4_jaccard_join, op5_secret_scan, op6_quality, op7_token_counts, op8_top_k, op9_chat_format, op10_line_dedup, op11_ranked_search, op12_shard_documents, op13_turn_repair)}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op3_embedding_dedup": embedding_dedup.SQL,
    "op4_jaccard_join": jaccard_join.SQL,
    "op5_secret_scan": secret_scan.SQL,
    "op8_top_k": topk_search.SQL,
    "op9_chat_format": chat_format.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_ranked_search": lexical_search.SQL,
    "op12_shard_documents": sharding.SQL,
    "op13_turn_repair": turn_repair.SQL,
}
