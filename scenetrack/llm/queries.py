"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op12_alignment
from .decontaminate import op1_decontaminate
from .jaccard import op13_jaccard_join
from .media import op4_media
from .minhash import op5_minhash
from .mixing import TARGETS_SQL, mixing_targets, op9_mixing
from .passages import op6_passages
from .periodic import op11_periodic_runs
from .pii import op10_pii
from .quality import op3_quality
from .sharding import op8_sharding
from .suffixes import op2_suffixes
from .toxicity import op7_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffixes": op2_suffixes,
    "op3_quality": op3_quality,
    "op4_media": op4_media,
    "op5_minhash": op5_minhash,
    "op6_passages": op6_passages,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_alignment": op12_alignment,
    "op13_jaccard_join": op13_jaccard_join,
    "mixing_targets": mixing_targets,
}

ORACLE_SQL: dict[str, str] = {"mixing_targets": TARGETS_SQL}
