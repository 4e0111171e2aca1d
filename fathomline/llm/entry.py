"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .chat import ORACLE_SQL as CHAT_SQL
from .chat import op2_chat
from .decontaminate import ORACLE_SQL as DECONTAMINATION_SQL
from .decontaminate import op5_decontamination
from .hard_negatives import ORACLE_SQL as HARD_NEGATIVES_SQL
from .hard_negatives import op11_hard_negatives
from .language_id import op4_language
from .line_dedup import ORACLE_SQL as LINE_DEDUP_SQL
from .line_dedup import op6_line_dedup
from .merkle import ORACLE_SQL as MERKLE_SQL
from .merkle import op12_merkle
from .minhash import op13_minhash
from .packing import op7_packing
from .pii import op1_pii
from .quality import ORACLE_SQL as QUALITY_SQL
from .quality import op3_quality
from .simhash import op9_simhash
from .token_files import op10_token_files
from .toxicity import op8_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle": op12_merkle,
    "op13_minhash": op13_minhash,
}
ORACLES: dict[str, str] = {
    "op2_chat": CHAT_SQL,
    "op3_quality": QUALITY_SQL,
    "op5_decontamination": DECONTAMINATION_SQL,
    "op6_line_dedup": LINE_DEDUP_SQL,
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_merkle": MERKLE_SQL,
}
