"""The queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from recordaudit.llm import counts, fingerprints, language, maxent, media, mixing, packing, quality, search, simhash, toxicity, warc, whitening


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": counts.op1_token_counts,
    "op2_language_id": language.op2_language_id,
    "op3_simhash": simhash.op3_simhash,
    "op4_warc": warc.op4_warc,
    "op5_flac": media.op5_flac,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_quality": quality.op7_quality,
    "op8_mix": mixing.op8_mix,
    "op9_best_fit": packing.op9_best_fit,
    "op10_maxent": maxent.op10_maxent,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_whitening": whitening.op12_whitening,
    "op13_search": search.op13_search,
    "pipeline": pipeline,
}
ORACLES = {"op4_warc": warc.OP4_SQL, "op8_mix": mixing.OP8_SQL, "op13_search": search.OP13_SQL}
