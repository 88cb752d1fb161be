"""The stages one after the other, each against brute force on its own input."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from packetloom.llm import byte_bpe, minhash, secrets
from packetloom.llm.common import read, written

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = read(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        following = written(stage(spark, docs, SMALL), f"test-{name}")
        out.append((name, docs.collect(), following.collect(), following.columns))
        docs = following
    return {name: (before, after, columns) for name, before, after, columns in out}


def test_columns_stay(outputs):
    for name, (_, _, columns) in outputs.items():
        if name != "tokens":
            assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_keeps_clean_documents(outputs):
    before, after, _ = outputs["language"]
    assert set(after) <= set(before) and len(after) >= 0.97 * len(before)


def test_one_document_of_each_group_stays(outputs):
    before, after, _ = outputs["near_dedup"]
    sets = {r.doc_id: set(minhash.shingles(r.text, 5).tolist()) for r in before}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    assert sorted(r.doc_id for r in after) == sorted({top(i) for i in sets})


def test_secrets_go_and_documents_stay(outputs):
    before, after, _ = outputs["secrets"]
    texts = {r.doc_id: r.text for r in after}
    assert len(texts) == len(before)
    changed = 0
    for r in before:
        if secrets.base_spans(r.text):
            changed += 1
            assert not secrets.base_spans(texts[r.doc_id])
    assert sum(texts[r.doc_id] != r.text for r in before) <= changed + 0.02 * len(before)


def test_mix_takes_documents_up_to_three_times(outputs):
    before, after, _ = outputs["mix"]
    taken = Counter(r.doc_id for r in after)
    texts = {r.doc_id: r.text for r in before}
    assert max(taken.values()) <= 3 and all(texts[r.doc_id] == r.text for r in after)
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert 0.8 <= words(after) / words(before) <= 1.2


def test_tokens_are_the_library_s(outputs):
    before, after, _ = outputs["tokens"]
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r.decodes and r.ids == library.encode_ordinary(texts[r.doc_id])
