"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from verdant.llm import bytebpe, centroids, decontaminate, pagetext, periodic, personal, quality, repeats, secrets, simhash, tokenfile, toolcalls, warc

from verdant.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_tool_calls": toolcalls.op2_tool_calls,
    "stated_tool_calls": toolcalls.stated_tool_calls,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_token_files": tokenfile.op4_token_files,
    "op5_byte_bpe": bytebpe.op5_byte_bpe,
    "op6_secrets": secrets.op6_secrets,
    "op7_page_text": pagetext.op7_page_text,
    "op8_repeats": repeats.op8_repeats,
    "op9_warc": warc.op9_warc,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_personal": personal.op11_personal,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_centroids": centroids.op13_centroids,
}
