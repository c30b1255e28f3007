"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import decontaminate_query
from .hard_negatives import HARD_NEGATIVES_SQL, hard_negatives_query
from .lzprint import lzprint_query
from .packing import packing_query
from .parity_join import parity_join_query
from .pii import pii_query
from .quality import quality_query
from .repeats import repeats_query
from .simhash import simhash_query
from .tokens import token_query
from .toxicity import toxicity_query
from .warc import WARC_SQL, warc_query
from .whitening import whitening_query

QUERIES = {
    "op1_repeats": repeats_query,
    "op2_toxicity": toxicity_query,
    "op3_packing": packing_query,
    "op4_warc": warc_query,
    "op5_pii": pii_query,
    "op6_tokens": token_query,
    "op7_simhash": simhash_query,
    "op8_lzprint": lzprint_query,
    "op9_quality": quality_query,
    "op10_decontaminate": decontaminate_query,
    "op11_whitening": whitening_query,
    "op12_hard_negatives": hard_negatives_query,
    "op13_parity_join": parity_join_query,
}
ORACLE_SQL = {"op4_warc": WARC_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
