"""The queries of this package and their SQL."""

from ontoloom.llm import decontaminate, exact_dedup, license_scan, near_dedup, packing, quality, secret_scan, suffix_dedup, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        secret_scan.op1_secret_scan, suffix_dedup.op2_suffix_dedup, license_scan.op3_license_scan, decontaminate.op4_benchmark_decontamination, warc.op6_warc,
        near_dedup.op5_near_dedup, quality.op7_quality_classifier, packing.op8_best_fit_packing, exact_dedup.op9_exact_dedup, url_filter.op10_url_filter,
    )
}
ORACLES = {"op3_license_scan": license_scan.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op10_url_filter": url_filter.ORACLE}
