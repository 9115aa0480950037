"""The subpackage's queries and, where SQL can say the same, their SQL."""

from .bpe import op3_bpe
from .chat import OP6_SQL, op6_chat_format
from .cover_tree import OP1_SQL, op1_cover_tree
from .filter_audit import OP13_SQL, op13_filter_audit
from .mixing import op8_mixing
from .quality import op9_quality
from .seed_extend import op12_seed_extend
from .sharding import OP2_SQL, op2_sharding
from .simhash import op5_simhash
from .suffix import op10_suffix
from .token_alignment import op11_alignment
from .topk import OP4_SQL, op4_topk
from .toxicity import op7_toxicity

QUERIES = {
    "op1_cover_tree": op1_cover_tree,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_topk": op4_topk,
    "op5_simhash": op5_simhash,
    "op6_chat_format": op6_chat_format,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_suffix": op10_suffix,
    "op11_alignment": op11_alignment,
    "op12_seed_extend": op12_seed_extend,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {"op1_cover_tree": OP1_SQL, "op2_sharding": OP2_SQL, "op4_topk": OP4_SQL, "op6_chat_format": OP6_SQL, "op13_filter_audit": OP13_SQL}
