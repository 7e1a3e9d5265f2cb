"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keysift.llm import exact_dedup, fill_middle, licenses, spelling, warc
from keysift.llm.decontaminate import op10_decontamination
from keysift.llm.exact_dedup import op3_exact_dedup
from keysift.llm.fill_middle import op12_fill_middle
from keysift.llm.language import op5_language
from keysift.llm.licenses import op7_licenses
from keysift.llm.packing import op2_packing
from keysift.llm.quality import op4_quality
from keysift.llm.secrets import op9_secrets
from keysift.llm.simhash import op8_simhash
from keysift.llm.spelling import op13_spelling_variants
from keysift.llm.token_counts import op1_token_counts
from keysift.llm.toxicity import op11_toxicity
from keysift.llm.warc import op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_packing,
        op3_exact_dedup,
        op4_quality,
        op5_language,
        op6_warc,
        op7_licenses,
        op8_simhash,
        op9_secrets,
        op10_decontamination,
        op11_toxicity,
        op12_fill_middle,
        op13_spelling_variants,
    )
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_licenses": licenses.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
