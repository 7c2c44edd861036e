"""The queries of this folder, by name, with their SQL where SQL can express them."""

from quarryline.llm import balanced_shards, compression_toxicity, license_scan, line_dedup, minmax, pii_spans, quality_rules, sentencepieces, winnowing, zip_archives

QUERIES = {
    "op1_pii_semi_markov": pii_spans.query,
    "op2_three_line_dedup": line_dedup.query,
    "op3_license_scan": license_scan.query,
    "op4_host_quality_rules": quality_rules.query,
    "op5_balanced_label_propagation": balanced_shards.query,
    "op6_compression_toxicity": compression_toxicity.query,
    "op7_zip_warc": zip_archives.query,
    "op8_sentencepiece": sentencepieces.query,
    "op9_winnowing_decontamination": winnowing.query,
    "op10_minmax_near_dedup": minmax.query,
}

ORACLES = {
    "op2_three_line_dedup": line_dedup.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op4_host_quality_rules": quality_rules.ORACLE,
    "op7_zip_warc": zip_archives.ORACLE,
    "op9_winnowing_decontamination": winnowing.ORACLE,
}
