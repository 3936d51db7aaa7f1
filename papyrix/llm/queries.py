"""The ten operators' queries, the pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations


def queries() -> dict:
    import corpus_pipeline

    from . import binary, html, jaccard, language, mixing, neighbours, packing, secrets, telephony, warc

    found = [mixing.op1_source_mixing, language.op2_language_id, neighbours.op3_nearest_neighbours, packing.op4_best_fit_packing, warc.op5_warc_archive, html.op6_main_text, secrets.op7_secret_scan, binary.op8_token_binary, telephony.op9_telephony_media, jaccard.op10_jaccard_join]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from . import warc

    return {"op5_warc_archive": warc.ORACLE}
