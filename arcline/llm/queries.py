"""The queries of this folder and their SQL twins."""

from __future__ import annotations

from .ann import op4_nearest
from .chat import OP6_SQL, op6_chat
from .decontam import OP5_SQL, op5_decontamination
from .kdshard import op2_sharding
from .langid import op7_language_id
from .licenses import OP12_SQL, op12_licenses
from .linededup import OP10_SQL, op10_line_dedup
from .lmscore import op8_lm_score
from .mixing import OP9_SQL, op9_mixing
from .repair import OP11_SQL, op11_repair
from .simhash import op1_simhash
from .toxicity import op3_toxicity
from .trie import OP13_SQL, op13_prefix_trie

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_nearest": op4_nearest,
    "op5_decontamination": op5_decontamination,
    "op6_chat": op6_chat,
    "op7_language_id": op7_language_id,
    "op8_lm_score": op8_lm_score,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_repair": op11_repair,
    "op12_licenses": op12_licenses,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op5_decontamination": OP5_SQL,
    "op6_chat": OP6_SQL,
    "op9_mixing": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_repair": OP11_SQL,
    "op12_licenses": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
