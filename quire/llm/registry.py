"""The queries of this subpackage and their SQL, added to the entry module by name."""

from __future__ import annotations

from .bpe_codec import op10_bpe_codec
from .conversation_repair import op12_conversation_repair
from .decontaminate import op9_decontamination
from .fill_in_middle import op13_fill_in_middle
from .fill_in_middle import oracle as op13_sql
from .jpeg import op8_jpeg_media
from .language_id import op7_language_id
from .near_duplicates import op6_near_duplicates
from .sstable import op5_sorted_tables
from .token_count import op1_token_counts
from .toxicity import op3_toxicity_neighbours
from .url_filter import op2_url_reputation
from .url_filter import oracle as op2_sql
from .vector_search import op11_vector_search
from .vector_search import oracle as op11_sql
from .warc import op4_warc_revisits


def queries():
    return {
        "op1_token_counts": op1_token_counts,
        "op2_url_reputation": op2_url_reputation,
        "op3_toxicity_neighbours": op3_toxicity_neighbours,
        "op4_warc_revisits": op4_warc_revisits,
        "op5_sorted_tables": op5_sorted_tables,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_language_id": op7_language_id,
        "op8_jpeg_media": op8_jpeg_media,
        "op9_decontamination": op9_decontamination,
        "op10_bpe_codec": op10_bpe_codec,
        "op11_vector_search": op11_vector_search,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql():
    return {"op2_url_reputation": op2_sql(), "op11_vector_search": op11_sql(), "op13_fill_in_middle": op13_sql()}
