"""The queries of this package by name, and their SQL where there is one."""

from facetloom.llm.decontamination import OP1_SQL, op1_aho_corasick_decontamination
from facetloom.llm.langid import op3_byte_cnn_language
from facetloom.llm.lm_scoring import op7_kneser_ney
from facetloom.llm.packing import op9_best_fit_packing
from facetloom.llm.pii import op4_pii
from facetloom.llm.quality import op5_mcd_quality
from facetloom.llm.secrets import op6_trigram_secret_scan
from facetloom.llm.sharding import op10_hash_tree_shards
from facetloom.llm.simhash import op2_simhash_components
from facetloom.llm.suffix_dedup import op8_suffix_dedup

QUERIES = {
    q.__name__: q
    for q in (
        op1_aho_corasick_decontamination,
        op2_simhash_components,
        op3_byte_cnn_language,
        op4_pii,
        op5_mcd_quality,
        op6_trigram_secret_scan,
        op7_kneser_ney,
        op8_suffix_dedup,
        op9_best_fit_packing,
        op10_hash_tree_shards,
    )
}
ORACLE_SQL = {"op1_aho_corasick_decontamination": OP1_SQL}
