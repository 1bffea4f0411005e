"""The registered queries of the training-data operators and their SQL."""

from boreal.llm.ann import op1_nearest
from boreal.llm.bpe import op9_bpe
from boreal.llm.conversation_trie import OP11_SQL, op11_conversation_trie
from boreal.llm.decontaminate import OP13_SQL, op13_decontaminate
from boreal.llm.langid import op8_language_id
from boreal.llm.merkle import OP12_SQL, op12_merkle_manifest
from boreal.llm.mixing import OP5_SQL, op5_mix
from boreal.llm.ngram_join import op2_ngram_join
from boreal.llm.quality import OP6_SQL, op6_quality_rules
from boreal.llm.substring_dedup import op7_substring_dedup
from boreal.llm.token_files import op10_token_files
from boreal.llm.toxicity import op4_toxicity
from boreal.llm.url_filter import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_ngram_join": op2_ngram_join,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_mix": op5_mix,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_bpe": op9_bpe,
    "op10_token_files": op10_token_files,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_decontaminate": op13_decontaminate,
}
ORACLE_SQL = {"op3_url_filter": OP3_SQL, "op5_mix": OP5_SQL, "op6_quality_rules": OP6_SQL, "op11_conversation_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_decontaminate": OP13_SQL}
