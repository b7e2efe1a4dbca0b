"""The queries ``opN_<name>`` of the operators in this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, graph_index, licenses, line_frequency, merkle, minhash, mixing, prefix_trie, secrets, sharding, suffix_repeats, toxic_spans, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": graph_index.op1_nearest,
    "op2_line_quality": line_frequency.op2_line_quality,
    "op3_toxicity": toxic_spans.op3_toxicity,
    "op4_shards": sharding.op4_shards,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_near_duplicates": minhash.op6_near_duplicates,
    "op7_mix": mixing.op7_mix,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_repeats": suffix_repeats.op10_repeats,
    "op11_license_scan": licenses.op11_license_scan,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_manifest": merkle.op13_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_quality": line_frequency.OP2_SQL,
    "op7_mix": mixing.OP7_SQL,
    "op10_repeats": suffix_repeats.OP10_SQL,
    "op11_license_scan": licenses.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_manifest": merkle.OP13_SQL,
}
