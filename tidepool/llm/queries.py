"""Registry of the pipeline operators' queries and their oracle SQL."""

from __future__ import annotations

from tidepool.llm.op01_html import op1_html_text
from tidepool.llm.op02_secrets import op2_secret_scan
from tidepool.llm.op03_token_counts import op3_token_counts
from tidepool.llm.op04_suffix_dedup import op4_suffix_dedup
from tidepool.llm.op05_decontaminate import op5_decontaminate
from tidepool.llm.op06_minhash import op6_minhash_near_dedup
from tidepool.llm.op07_quality import op7_quality_rules
from tidepool.llm.op08_warc import op8_warc
from tidepool.llm.op09_token_files import op9_token_files
from tidepool.llm.op10_mixing import op10_entropy_mix
from tidepool.llm.op11_manifest import op11_merkle_manifest
from tidepool.llm.op12_hmm import op12_hmm_score
from tidepool.llm.op13_filter_audit import op13_filter_audit
from tidepool.llm.oracle import ORACLE

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_token_files": op9_token_files,
    "op10_entropy_mix": op10_entropy_mix,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hmm_score": op12_hmm_score,
    "op13_filter_audit": op13_filter_audit,
}

__all__ = ["ORACLE", "QUERIES"]
