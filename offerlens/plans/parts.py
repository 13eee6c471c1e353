"""Parts of larger queries that are asked for by themselves: the same plan, of which Catalyst keeps what the columns need."""

from __future__ import annotations

from .registry import ORACLES, QUERIES

#: name -> (query, columns)
PARTS = {
    "price_minmax_norm": ("quote_comparison", ("l_partkey", "l_orderkey", "l_linenumber", "price")),
    "quality_multiplier": ("quote_comparison", ("l_partkey", "l_orderkey", "l_linenumber", "quality")),
    "rank_quotes": ("quote_comparison", ("l_partkey", "l_orderkey", "l_linenumber", "total", "rank_order")),
    "rank_financing": ("financing_options", ("o_orderkey", "opt", "rank_order")),
    "topk_cosine": ("vec_topk", ("qid", "vec_id", "rank_order")),
    "vec_cosine": ("vec_topk", ("qid", "vec_id", "score")),
    "topk_lexical": ("lexical_fallback", ("doc_id",)),
    "lexical_score": ("lexical_fallback", ("doc_id", "score")),
    "classify_notice_kind": ("scan_notice_attachments", ("o_orderkey", "name", "document_kind")),
    "url_hash": ("url_normalize", ("page_id", "url_hash")),
}

for _name, (_query, _columns) in PARTS.items():
    QUERIES[_name] = lambda spark, folder, q=_query, c=_columns: QUERIES[q](spark, folder).select(*c)
    ORACLES[_name] = f"select {', '.join(_columns)} from ({ORACLES[_query]}) whole"
