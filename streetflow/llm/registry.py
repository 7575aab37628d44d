"""The queries of this subpackage, and the SQL that expresses them."""

from __future__ import annotations

from streetflow.llm import decontaminate, html, langid, licenses, linededup, lm, mixing, pipeline, png, simhash, warc


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.query,
        "op2_license_scan": licenses.query,
        "op3_lm_scoring": lm.query,
        "op4_html_text": html.query,
        "op5_line_dedup": linededup.query,
        "op6_warc_salvage": warc.query,
        "op7_decontaminate": decontaminate.query,
        "op8_language_id": langid.query,
        "op9_png_media": png.query,
        "op10_mix_sources": mixing.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_salvage": warc.ORACLE, "op5_line_dedup": linededup.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op10_mix_sources": mixing.ORACLE}
