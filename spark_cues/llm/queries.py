"""The training-data queries, their DuckDB counterparts, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprints, line_dedup, mih, negatives, packing, secret_scan, sharding, simhash, surrogates, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_multi_index_hashing": mih.op1_multi_index_hashing,
        "op2_hmm_transcripts": chat.op2_hmm_transcripts,
        "op3_simhash_pigeonring": simhash.op3_simhash_pigeonring,
        "op4_line_spread": line_dedup.op4_line_spread,
        "op5_concat_and_cut": packing.op5_concat_and_cut,
        "op6_secret_ledger": secret_scan.op6_secret_ledger,
        "ledger_history": secret_scan.ledger_history,
        "op7_keyed_surrogates": surrogates.op7_keyed_surrogates,
        "op8_template_windows": decontaminate.op8_template_windows,
        "op9_toxicity_lexicon": toxicity.op9_toxicity_lexicon,
        "op10_histogram_sort": sharding.op10_histogram_sort,
        "op11_feast_whitening": whitening.op11_feast_whitening,
        "op12_bottom_k": fingerprints.op12_bottom_k,
        "op13_str_tree": negatives.op13_str_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_spread": line_dedup.ORACLE_SQL, "op6_secret_ledger": secret_scan.ORACLE_SQL, "ledger_history": secret_scan.HISTORY_SQL, "op8_template_windows": decontaminate.ORACLE_SQL}
