"""The queries of this package and their SQL."""

import corpus_pipeline

from .ann import op6_ann
from .langid import op4_langid
from .licenses import OP10_SQL, op10_licenses
from .mixing import OP5_SQL, op5_mixing
from .oracles import OP1_SQL, OP2_SQL, OP3_SQL, OP8_SQL
from .packing import op9_packing
from .phrases import OP11_SQL, op11_phrases
from .pii import op1_pii
from .resampling import OP13_SQL, op13_resampling
from .simhash import op7_simhash
from .substring import op8_substring
from .suffix import op3_suffix_array
from .vectors import op2_embedding_dedup
from .wrappers import OP12_SQL, op12_html

QUERIES = {
    "op1_pii": op1_pii,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_suffix_array": op3_suffix_array,
    "op4_langid": op4_langid,
    "op5_mixing": op5_mixing,
    "op6_ann": op6_ann,
    "op7_simhash": op7_simhash,
    "op8_substring": op8_substring,
    "op9_packing": op9_packing,
    "op10_licenses": op10_licenses,
    "op11_phrases": op11_phrases,
    "op12_html": op12_html,
    "op13_resampling": op13_resampling,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_pii": OP1_SQL,
    "op2_embedding_dedup": OP2_SQL,
    "op3_suffix_array": OP3_SQL,
    "op5_mixing": OP5_SQL,
    "op8_substring": OP8_SQL,
    "op10_licenses": OP10_SQL,
    "op11_phrases": OP11_SQL,
    "op12_html": OP12_SQL,
    "op13_resampling": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
