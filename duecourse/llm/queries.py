"""The registered queries of this subpackage, and their SQL."""

from . import exact_dedup, importance, lexical_search, license_scan, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, telephony_audio

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_telephony_audio": telephony_audio.op5_telephony_audio,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_importance": importance.op12_importance,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "op8_mixing": mixing.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE, "op13_lexical_search": lexical_search.ORACLE,
}
