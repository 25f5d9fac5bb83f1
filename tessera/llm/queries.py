"""Queries of the training-data operators, opN_<name>, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import divergence, fim, flac, langid, mixing, packing, passages, pieces, quality, simhash, toxicity, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": urlfilter.op1_url_filter,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_packing": packing.op4_packing,
        "op5_flac": flac.op5_flac,
        "op6_language_id": langid.op6_language_id,
        "op7_simhash": simhash.op7_simhash,
        "op8_warc": warc.op8_warc,
        "op9_quality": quality.op9_quality,
        "op10_passages": passages.op10_passages,
        "op11_divergence": divergence.op11_divergence,
        "op12_fim": fim.op12_fim,
        "op13_mixing": mixing.op13_mixing,
    }


def oracles() -> dict[str, str]:
    return {"op8_warc": warc.OP8_SQL, "op11_divergence": divergence.OP11_SQL, "op12_fim": fim.OP12_SQL}
