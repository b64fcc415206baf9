"""The block-scan queries once more, with blocks so small that the keys of small tables span many of them.

Each must give the rows of its namesake, so each has its namesake's SQL.
"""

from functools import partial

from parlance.catalog import conversation_queries, signal_queries, transcript_queries
from parlance.catalog.registry import ORACLE, register

WIDTHS = {
    transcript_queries: {"detect_overlap": 3, "merge_transcripts": 2, "merge_transcripts_flow": 3, "concat_transcripts": 2,
                         "detokenize": 50, "detokenize_characters": 50},
    signal_queries: {"resample_linear": 64, "resample_linear_up": 64, "frame_signal": 64, "zero_crossing_rate": 64,
                     "normalize_per_feature": 2, "audit_chunk_coverage": 2},
    conversation_queries: {"reassemble_fragments": 100, "pair_turns": 2},
}

for module, widths in WIDTHS.items():
    for name, width in widths.items():
        register(f"{name}_small_blocks", ORACLE[name])(partial(getattr(module, name), per_block=width))
