"""The queries of this subpackage for the driver, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from rangeloom.llm import bpe, decontam, html, language, lines, pii, quality, repeats, simhash, toxicity


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_repeats": repeats.op2_repeats,
        "op3_html": html.op3_html,
        "op4_simhash": simhash.op4_simhash,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_bpe": bpe.op7_bpe,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_quality": quality.op9_quality,
        "op10_language": language.op10_language,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": lines.OP5_SQL}
