"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from casegraph.llm.clustering import OP12_SQL, op12_centroid_clusters
from casegraph.llm.fingerprints import op6_fingerprints
from casegraph.llm.linededup import op10_line_dedup
from casegraph.llm.lmscore import op9_lm_scoring
from casegraph.llm.mixing import OP2_SQL, op2_mixing
from casegraph.llm.neardup import OP4_SQL, op4_near_duplicates
from casegraph.llm.packing import op7_packing
from casegraph.llm.quality import OP3_SQL, op3_quality_rules
from casegraph.llm.secrets import op8_secret_scans
from casegraph.llm.sharding import op1_sharding
from casegraph.llm.simhashdup import op11_simhash_duplicates
from casegraph.llm.tokencount import op5_token_counts
from casegraph.llm.vectorcodes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_counts": op5_token_counts,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op8_secret_scans": op8_secret_scans,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_line_dedup": op10_line_dedup,
    "op11_simhash_duplicates": op11_simhash_duplicates,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_vector_codes": op13_vector_codes,
}

SQL = {
    "op2_mixing": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op4_near_duplicates": OP4_SQL,
    "op12_centroid_clusters": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
