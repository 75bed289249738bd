"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from blockloom.llm import bpe, common, exact, mixing, quality, simhash


def quality_rules(spark, docs, sf_dir):
    """Bad lines go; documents that fail the base counts or lose too much text go."""
    return quality.keep_good(docs)


def exact_dedup(spark, docs, sf_dir):
    """One of equal texts stays."""
    return exact.drop_copies(docs)


def near_dedup(spark, docs, sf_dir):
    """One of each group of linked fingerprints stays."""
    return simhash.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def encode(spark, docs, sf_dir):
    """Token ids of each document, with digests of them and of the decoded text."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
#: The stages are not expressible in SQL as a whole; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what is between them is written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
