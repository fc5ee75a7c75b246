"""Queries of this subpackage and their DuckDB SQL, as the entry module registers them."""

from __future__ import annotations

from .decontamination import OP10_SQL, op10_decontamination
from .hilbert_sharding import op8_hilbert_sharding
from .license_scan import op9_license_scan
from .minhash_dedup import OP1_SQL, op1_minhash_dedup
from .pfair_mixing import op5_pfair_mixing
from .pii import op4_pii
from .quality_classifier import op6_quality_classifier
from .quality_rules import OP7_SQL, op7_quality_rules
from .toxicity import op3_toxicity
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_hilbert_sharding": op8_hilbert_sharding,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {"op1_minhash_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op7_quality_rules": OP7_SQL, "op10_decontamination": OP10_SQL}
