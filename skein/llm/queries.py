"""The queries of this folder's operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .langid import op6_langid
from .lattice import op1_lattice
from .linededup import op7_lines
from .mixing import op3_mixing
from .oracles import ORACLE_SQL
from .quality import op10_quality
from .sharding import op5_sharding
from .simhash import op9_simhash
from .topk import op12_fagin
from .toxicity import op2_toxicity
from .trie import op13_trie
from .vectors import op8_vectors
from .whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice": op1_lattice,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_bpe": op4_bpe,
    "op5_sharding": op5_sharding,
    "op6_langid": op6_langid,
    "op7_lines": op7_lines,
    "op8_vectors": op8_vectors,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_fagin": op12_fagin,
    "op13_trie": op13_trie,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
