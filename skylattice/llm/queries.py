"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm.fingerprints import op7_fingerprints
from skylattice.llm.jaccard import op8_jaccard
from skylattice.llm.langid import op1_language
from skylattice.llm.licenses import op3_licenses
from skylattice.llm.mixing import OP2_SQL, op2_mixing
from skylattice.llm.neighbours import op9_neighbours
from skylattice.llm.packing import op4_packing
from skylattice.llm.pieces import op11_pieces
from skylattice.llm.prefixes import OP12_SQL, op12_prefixes
from skylattice.llm.runs import op13_runs
from skylattice.llm.secrets import op10_secrets
from skylattice.llm.toxicity import op5_toxicity
from skylattice.llm.urls import op6_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_urls": op6_urls,
    "op7_fingerprints": op7_fingerprints,
    "op8_jaccard": op8_jaccard,
    "op9_neighbours": op9_neighbours,
    "op10_secrets": op10_secrets,
    "op11_pieces": op11_pieces,
    "op12_prefixes": op12_prefixes,
    "op13_runs": op13_runs,
}
ORACLES: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op12_prefixes": OP12_SQL,
}
