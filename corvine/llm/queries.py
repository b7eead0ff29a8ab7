"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from corvine.llm import bpe, embeddings, html, jaccard, licenses, mix, partitions, ppm, quality, repeats, runs, signatures, tokenbin

QUERIES = {
    "op1_mix": mix.op1_mix,
    "op2_licenses": licenses.op2_licenses,
    "op3_embeddings": embeddings.op3_embeddings,
    "op4_ppm": ppm.op4_ppm,
    "op5_bpe": bpe.op5_bpe,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_tokenbin": tokenbin.op7_tokenbin,
    "op8_html": html.op8_html,
    "op9_repeats": repeats.op9_repeats,
    "op10_quality": quality.op10_quality,
    "op11_signatures": signatures.op11_signatures,
    "op12_runs": runs.op12_runs,
    "op13_partitions": partitions.op13_partitions,
}

ORACLES = {
    "op1_mix": mix.ORACLE,
    "op2_licenses": licenses.ORACLE,
    "op3_embeddings": embeddings.ORACLE,
    "op6_jaccard": jaccard.ORACLE,
    "op9_repeats": repeats.ORACLE,
    "op10_quality": quality.ORACLE,
    "op11_signatures": signatures.ORACLE,
}
