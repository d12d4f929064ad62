"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from quantloom.llm.chat_tree import OP5_SQL, op5_chat_tree
from quantloom.llm.line_dedup import OP9_SQL, op9_line_dedup
from quantloom.llm.media import op8_media
from quantloom.llm.mixing import OP6_SQL, op6_mixing
from quantloom.llm.packing import op12_packing
from quantloom.llm.permutation_index import op7_permutation_index
from quantloom.llm.phrases import OP13_SQL, op13_phrases
from quantloom.llm.piece_codec import op2_sentencepiece
from quantloom.llm.simhash import op10_simhash
from quantloom.llm.substring_dedup import op1_substring_dedup
from quantloom.llm.token_store import op4_token_store
from quantloom.llm.toxicity import op3_toxicity
from quantloom.llm.whitening import op11_whitening


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_toxicity": op3_toxicity,
        "op4_token_store": op4_token_store,
        "op5_chat_tree": op5_chat_tree,
        "op6_mixing": op6_mixing,
        "op7_permutation_index": op7_permutation_index,
        "op8_media": op8_media,
        "op9_line_dedup": op9_line_dedup,
        "op10_simhash": op10_simhash,
        "op11_whitening": op11_whitening,
        "op12_packing": op12_packing,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_tree": OP5_SQL, "op6_mixing": OP6_SQL, "op9_line_dedup": OP9_SQL, "op13_phrases": OP13_SQL}
