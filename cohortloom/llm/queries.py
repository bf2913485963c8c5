"""The operators of this folder as queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from cohortloom.llm import bpe, chat, collocations, decontam, hmm, html_text, jaccard, licences, periodic, pii, quality, token_counts, url_filter

QUERIES = {
    "op1_url_filter": url_filter.digest,
    "op2_quality_rules": quality.digest,
    "op3_bpe_round_trip": bpe.digest,
    "op4_licence_scan": licences.digest,
    "op5_jaccard_join": jaccard.digest,
    "op6_token_counts": token_counts.digest,
    "op7_main_text": html_text.digest,
    "op8_pii": pii.digest,
    "op9_chat_tree": chat.digest,
    "op10_decontamination": decontam.digest,
    "op11_hidden_markov": hmm.digest,
    "op12_periodic_runs": periodic.digest,
    "op13_collocations": collocations.digest,
}

SQL = {
    "op2_quality_rules": quality.SQL,
    "op13_collocations": collocations.SQL,
}
