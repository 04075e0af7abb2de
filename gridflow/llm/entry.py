"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, language, minhash, packing, phrases, pii, quality, secrets, tokenfile, topk, toxicity, turns, vectors

QUERIES = {
    f.__name__: f
    for f in (
        vectors.op1_embedding_near_dedup,
        topk.op2_block_topk,
        bpe.op3_bpe_transducer,
        pii.op4_pii_surrogates,
        toxicity.op5_toxicity_ordinal,
        quality.op6_quality_bayes,
        secrets.op7_secret_scan,
        packing.op8_best_fit_packing,
        tokenfile.op9_token_files,
        minhash.op10_minhash_near_dedup,
        turns.op11_conversation_repair,
        phrases.op12_phrase_collocations,
        language.op13_language_ftrl,
    )
}

ORACLE_SQL = {"op1_embedding_near_dedup": vectors.SQL, "op2_block_topk": topk.SQL, "op10_minhash_near_dedup": minhash.SQL, "op11_conversation_repair": turns.SQL, "op12_phrase_collocations": phrases.SQL}
