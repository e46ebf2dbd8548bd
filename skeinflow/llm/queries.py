"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op8_bpe
from .conversations import OP11_SQL, op11_repair
from .html_text import op6_html_text
from .licenses import op1_license_scan
from .merkle import OP12_SQL, op12_merkle
from .mixing import OP7_SQL, op7_mix_sources
from .paragraph_sketch import op10_fingerprints
from .pii import op9_pii
from .pu_quality import op2_quality_classifier
from .quality_rules import OP5_SQL, op5_quality_rules
from .simhash import op3_simhash
from .substrings import OP4_SQL, op4_substrings
from .toxicity import op13_toxicity

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_simhash": op3_simhash,
    "op4_substrings": op4_substrings,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_text": op6_html_text,
    "op7_mix_sources": op7_mix_sources,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_fingerprints": op10_fingerprints,
    "op11_repair": op11_repair,
    "op12_merkle": op12_merkle,
    "op13_toxicity": op13_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op4_substrings": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_mix_sources": OP7_SQL,
    "op11_repair": OP11_SQL,
    "op12_merkle": OP12_SQL,
}
