"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import chunk_dedup, collocations, context_mixing, decontamination, line_crf, mixing, near_dedup, packing, quality_cnn, source_audit, toxicity_fm, url_filter, warc_zip


def queries() -> dict:
    return {
        "op1_warc_zip": warc_zip.op1,
        "op2_chunk_dedup": chunk_dedup.op2,
        "op3_line_crf": line_crf.op3,
        "op4_source_mixing": mixing.op4,
        "op5_toxicity_fm": toxicity_fm.op5,
        "op6_near_dedup": near_dedup.op6,
        "op7_context_mixing": context_mixing.op7,
        "op8_url_filter": url_filter.op8,
        "op9_best_fit_packing": packing.op9,
        "op10_quality_cnn": quality_cnn.op10,
        "op11_source_audit": source_audit.op11,
        "op12_decontamination": decontamination.op12,
        "op13_collocations": collocations.op13,
    }


def oracle_sql() -> dict:
    return {
        "op1_warc_zip": warc_zip.OP1_SQL,
        "op2_chunk_dedup": chunk_dedup.OP2_SQL,
        "op4_source_mixing": mixing.OP4_SQL,
        "op8_url_filter": url_filter.OP8_SQL,
        "op11_source_audit": source_audit.OP11_SQL,
        "op12_decontamination": decontamination.OP12_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }
