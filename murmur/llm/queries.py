"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .audio import op2_audio
from .bpe import op6_bpe
from .fingerprint import op7_fingerprints
from .language import op5_language
from .licences import OP1_SQL, op1_licences
from .mixing import OP3_SQL, op3_mixing
from .near_dedup import OP9_SQL, op9_near_dedup
from .pii import OP10_SQL, op10_pii
from .sharding import OP8_SQL, op8_sharding
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_licences": op1_licences,
    "op2_audio": op2_audio,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_language": op5_language,
    "op6_bpe": op6_bpe,
    "op7_fingerprints": op7_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_near_dedup": op9_near_dedup,
    "op10_pii": op10_pii,
}

SQL = {
    "op1_licences": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op8_sharding": OP8_SQL,
    "op9_near_dedup": OP9_SQL,
    "op10_pii": OP10_SQL,
}
