"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from flowloom.llm import audit, exact_dedup, language_id, lloyd, near_dedup, ogg, packing, pieces, pii, quality, sketches, token_counts, url_filter


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (
        url_filter.op1_url_filter, pieces.op2_sentencepiece, packing.op3_best_fit_packing, language_id.op4_language_id, token_counts.op5_token_counts,
        quality.op6_quality_classifier, pii.op7_pii, exact_dedup.op8_exact_dedup, near_dedup.op9_minhash_near_dedup, ogg.op10_media_columns,
        sketches.op11_document_fingerprints, audit.op12_filter_audit, lloyd.op13_centroid_clustering, pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.SQL, "op12_filter_audit": audit.SQL, "op13_centroid_clustering": lloyd.SQL}
