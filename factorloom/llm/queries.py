"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op7_bpe
from .ctw import op1_ctw
from .decontaminate import op4_decontaminate
from .langid import op9_langid
from .line_dedup import op10_line_dedup
from .merkle import op13_merkle
from .near_dedup import op3_near_dedup
from .pii import op12_pii
from .quality_gam import op8_quality_gam
from .quality_rules import op5_quality_rules
from .substring_dedup import op6_substring_dedup
from .url_rules import op2_url_rules
from .whitening import op11_whitening

QUERIES = {
    "op1_ctw": op1_ctw,
    "op2_url_rules": op2_url_rules,
    "op3_near_dedup": op3_near_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe": op7_bpe,
    "op8_quality_gam": op8_quality_gam,
    "op9_langid": op9_langid,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_pii": op12_pii,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {}
