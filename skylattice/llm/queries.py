"""Registered queries of the training-data operators."""

from skylattice.llm import contamination, infilling, innerproduct, mixing, quality, quotes, ranking, repeats, sharding
from skylattice.llm.contamination import op8_spaced_seeds
from skylattice.llm.infilling import op12_fill_in_middle
from skylattice.llm.innerproduct import op11_inner_products
from skylattice.llm.language import op7_language_id
from skylattice.llm.mixing import op1_mix_sources
from skylattice.llm.quality import op2_quality_rules
from skylattice.llm.quotes import op3_quote_links
from skylattice.llm.ranking import op13_ranked_search
from skylattice.llm.repeats import op9_repeats
from skylattice.llm.sharding import op4_extendible_shards
from skylattice.llm.simhash import op6_simhash
from skylattice.llm.tokens import op5_wavelet_tokens
from skylattice.llm.toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_rules, op3_quote_links, op4_extendible_shards, op5_wavelet_tokens, op6_simhash, op7_language_id, op8_spaced_seeds, op9_repeats, op10_toxicity, op11_inner_products, op12_fill_in_middle, op13_ranked_search)}
ORACLE_SQL: dict[str, str] = {}
for module in (mixing, quality, quotes, sharding, contamination, repeats, infilling, innerproduct, ranking):
    ORACLE_SQL |= module.ORACLE_SQL
