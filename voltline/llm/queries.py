"""The registered queries of the corpus operators and their oracles."""

from . import audio, bpe, compaction, divergence, exact, licenses, packing, quality, simhash, substring, toxicity, warc, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_exact": exact.op2_exact,
    "op3_compaction": compaction.op3_compaction,
    "op4_packing": packing.op4_packing,
    "op5_audio": audio.op5_audio,
    "op6_substring": substring.op6_substring,
    "op7_quality": quality.op7_quality,
    "op8_licenses": licenses.op8_licenses,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe": bpe.op10_bpe,
    "op11_divergence": divergence.op11_divergence,
    "op12_warc": warc.op12_warc,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {"op2_exact": exact.OP2_SQL, "op3_compaction": compaction.OP3_SQL, "op11_divergence": divergence.OP11_SQL, "op12_warc": warc.OP12_SQL}
