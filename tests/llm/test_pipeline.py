"""The corpus pipeline over a small folder: every stage's promise, checked by brute force on what it kept."""

import re
import zlib

import numpy as np
import pytest
import tokenizers

import corpus_pipeline as cp
from conftest import SMALL
from roadlens.llm.common import read_table
from roadlens.llm.queries import TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage but the last returns, and the rows of the last."""
    docs, kept = read_table(spark, SMALL, "documents"), []
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialize(stage(spark, docs, SMALL), f"test-{name}")
        kept.append((name, docs))
    return dict(kept), cp.STAGES[-1][1](spark, docs, SMALL).collect()


def test_stages_keep_the_columns_and_only_take_rows_away(spark, stages):
    before = read_table(spark, SMALL, "documents")
    ids = {r.doc_id for r in before.collect()}
    for name, docs in stages[0].items():
        assert docs.columns == before.columns
        now = {r.doc_id for r in docs.collect()}
        assert now and now <= ids, name
        ids = now


def test_rejected_texts_are_gone(stages):
    for r in stages[0]["quality"].collect():
        words = WORD.findall(r.text or "")
        grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
        assert len(words) >= 20 and 100 * len(covered) <= 30 * len(words)


def test_no_near_copies_stay(stages):
    sets = []
    for r in stages[0]["near_duplicates"].collect():
        words = WORD.findall((r.text or "").translate(LOWER))
        sets.append((r.doc_id, {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}))
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            assert not (x & y) or len(x & y) < 0.8 * len(x | y), (a, b)


def test_no_benchmark_window_stays(spark, stages):
    windows = set()
    for r in read_table(spark, SMALL, "benchmark").collect():
        words = BENCH_WORD.findall((r.text or "").translate(LOWER))
        windows |= {tuple(words[i:i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(w) for w in windows}
    for r in stages[0]["decontaminate"].collect():
        words = BENCH_WORD.findall((r.text or "").translate(LOWER))
        assert not any(tuple(words[i:i + n]) in windows for n in sizes for i in range(len(words) - n + 1)), r.doc_id


def test_token_files_hold_the_mixed_texts(stages):
    tok = tokenizers.Tokenizer.from_file(TOKENIZER)
    expected = []
    for r in stages[0]["mixing"].collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        expected.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[1])
    assert sorted((d, n, c) for _, d, n, c in rows) == sorted(expected)
    at = 0
    for start, _, n, _ in rows:
        assert start == at
        at += n


def test_run_over_a_folder_without_documents(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        t = read_table(spark, SMALL, name)
        (t.limit(0) if name == "documents" else t).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
