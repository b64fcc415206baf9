"""The pipeline, stage by stage on what the stage before wrote, against plain versions; and the queries' columns."""

import os
import sys

import pytest
from test_jaccard import plain as plain_components
from test_lines import plain as plain_lines
from test_quality import plain_limits, plain_verdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as contract  # noqa: E402
import corpus_pipeline  # noqa: E402
from parlance.llm import mixing, queries, quality  # noqa: E402
from parlance.llm.base import table, written  # noqa: E402

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_warc_round_trip": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op2_lpt_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op4_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op5_phrase_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_prefix_targets": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op7_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_quality_divergence": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op10_soft_mixing": ["doc_id", "n_tokens", "rate", "copies"],
    "op11_host_reputation": ["page_id", "host", "path", "rule", "verdict"],
    "op12_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}


def test_every_operator_has_its_query():
    registered = [q for q in contract.queries() if q.startswith("op")]
    assert sorted(registered) == sorted(COLUMNS)
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_whole_table(spark, name):
    out = contract.queries()[name](spark, SF)
    assert set(COLUMNS[name]) <= set(out.columns)
    if name == "op12_spelling_variants":
        return
    source = {"op1": "pages", "op11": "pages", "op6": "conversations"}.get(name.split("_")[0], "documents")
    key = {"pages": "page_id", "conversations": "conv_id"}.get(source, "doc_id")
    keys = {r[0] for r in out.select(key).collect()} - {-1}
    assert keys == {r[0] for r in table(spark, SF, source).select(key).collect()}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert len(stages) == 5
    state = {r.doc_id: r for r in docs.collect()}

    kept = written(stages[0](spark, docs, SF), "t0")
    refs = quality.language_references(docs)
    assert kept.columns == docs.columns
    limits = plain_limits([(r.text, r.lang) for r in state.values()], refs)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in state.items() if plain_verdict(r.text, r.lang, refs, limits)[-1]}

    cleaned = written(stages[1](spark, kept, SF), "t1")
    before = sorted(kept.collect(), key=lambda r: r.doc_id)
    after = sorted(cleaned.collect(), key=lambda r: r.doc_id)
    assert cleaned.columns == docs.columns and [f.dataType for f in cleaned.schema] == [f.dataType for f in docs.schema]
    assert [r.text for r in after] == [x[0] for x in plain_lines([r.text for r in before], 10, 1)]
    assert all(r.n_chars == len(r.text) for r in after)

    single = written(stages[2](spark, cleaned, SF), "t2")
    groups = plain_components([(r.doc_id, r.text) for r in after])
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {i for i, _, c in groups if i == c}

    mixed = written(stages[3](spark, single, SF), "t3")
    out, mix = mixing.mix_to_targets(single, table(spark, SF, "labels"), queries.LABELS, queries.WEIGHTS, keep_whole=queries.WHOLE)
    copies = {r.doc_id: r.copies for r in out.collect() if r.copies}
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies

    packed = stages[4](spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == set(copies)
    load = {}
    for r in packed:
        load[r.sequence_id] = load.get(r.sequence_id, 0) + r.length
    assert max(load.values()) <= 1024


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
