"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import collocations, conversations, decontamination, exact_dedup, licenses, lm_scoring, mixing, pii, quality, simhash, token_files, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality, mixing.op2_mixing, licenses.op3_licenses, simhash.op4_simhash, token_files.op5_token_files,
        lm_scoring.op6_lm_scoring, pii.op7_pii, toxicity.op8_toxicity, decontamination.op9_decontamination, exact_dedup.op10_exact_dedup,
        conversations.op11_conversations, warc.op12_warc, collocations.op13_collocations,
    )
}

SQL = {"op2_mixing": mixing.SQL, "op3_licenses": licenses.SQL, "op9_decontamination": decontamination.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_conversations": conversations.SQL, "op12_warc": warc.SQL, "op13_collocations": collocations.SQL}
