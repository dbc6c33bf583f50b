"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import wraps

from . import scratch
from .chat import OP7_SQL, op7_chat_tool_links
from .decontam import OP3_SQL, op3_benchmark_leaks
from .embeddings import OP4_SQL, op4_embedding_near_dedup
from .factors import OP11_SQL, op11_copied_words
from .licenses import op2_license_scan
from .minhash import OP1_SQL, op1_minhash_near_dedup
from .packing import op5_pack_sequences
from .quality import op6_quality_scores
from .ranking import OP12_SQL, op12_ranked_search
from .repeats import op9_remove_repeats
from .sharding import op10_kd_shards
from .toxicity import op8_toxicity_scores
from .turns import OP13_SQL, op13_repair_conversations



def _tidy(query):
    """The query's result as a table of its own, without its other scratch tables."""

    @wraps(query)
    def run(spark, sf_dir):
        return scratch.tidied(spark, lambda: query(spark, sf_dir))

    return run


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_pack_sequences": op5_pack_sequences,
    "op6_quality_scores": op6_quality_scores,
    "op7_chat_tool_links": op7_chat_tool_links,
    "op8_toxicity_scores": op8_toxicity_scores,
    "op9_remove_repeats": op9_remove_repeats,
    "op10_kd_shards": op10_kd_shards,
    "op11_copied_words": op11_copied_words,
    "op12_ranked_search": op12_ranked_search,
    "op13_repair_conversations": op13_repair_conversations,
}
QUERIES = {name: _tidy(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op3_benchmark_leaks": OP3_SQL,
    "op4_embedding_near_dedup": OP4_SQL,
    "op7_chat_tool_links": OP7_SQL,
    "op11_copied_words": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_repair_conversations": OP13_SQL,
}
