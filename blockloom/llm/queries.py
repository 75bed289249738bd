"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

import importlib

from .bpe import op4_bpe
from .chat import OP2_SQL, op2_chat_format
from .counts import op5_token_counts
from .exact import OP3_SQL, op3_exact_dedup
from .licenses import OP6_SQL, op6_license_scan
from .mixing import op8_mix
from .pii import op9_pii
from .quality import OP7_SQL, op7_quality
from .simhash import op10_simhash
from .suffix import op1_suffix_dedup


def pipeline(spark, sf_dir):
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_chat_format, op3_exact_dedup, op4_bpe, op5_token_counts,
    op6_license_scan, op7_quality, op8_mix, op9_pii, op10_simhash, pipeline,
)}
ORACLES = {"op2_chat_format": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op6_license_scan": OP6_SQL, "op7_quality": OP7_SQL}
