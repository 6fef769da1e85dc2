import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from ledgerwise.llm import blob_ledger, packing, queries
from ledgerwise.llm.common import materialize, table
from .test_text_ops import brute_targets
from .test_vectors_and_dedup import brute_near

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's rows, as ``run`` makes them."""
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def test_stages_in_order_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "secret_scans", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, stages):
    kept = {r.doc_id for r in stages["toxicity"].collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    toxic = [i for i, t in labels.items() if t]
    assert sum(i in kept for i in toxic) <= 0.1 * len(toxic)
    assert sum(i not in kept for i, t in labels.items() if not t) <= 0.02 * len(labels)


def test_one_of_each_group_stays(stages):
    texts = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    want = sorted(key for key, _, least in brute_near(texts, 5, 80) if key == least)
    assert sorted(r.doc_id for r in stages["minhash_near_dedup"].collect()) == want


def test_no_secret_is_left(stages):
    before = {r.doc_id: r.text for r in stages["minhash_near_dedup"].collect()}
    after = stages["secret_scans"].collect()
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        spans = blob_ledger.find_spans(before[r.doc_id])
        assert (r.text != before[r.doc_id]) == bool(spans) and r.n_chars == len(r.text)
        assert not blob_ledger.find_spans(r.text)


def test_mix_and_packing(stages):
    rows = stages["secret_scans"].collect()
    copies = Counter(r.doc_id for r in stages["mixing"].collect())
    size, most, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r.text))
        size[r.source] += n
        most[r.source] = max(most[r.source], n)
        taken[r.source] += n * copies[r.doc_id]
    target = brute_targets(size)
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in rows}
    assert all(abs(taken[s] - target[s]) <= 1.01 * most[s] + 1 for s in size)
    enc = packing.encoder(queries.tokenizer("word_bpe_49k.json"))
    length = {r.doc_id: len(np.frombuffer(enc(r.text), "<u4")) + 1 for r in rows}
    total = Counter()
    for r in stages["packing"].collect():
        total[r.doc_id] += r.length
        assert r.doc_tokens == length[r.doc_id] and 0 <= r.offset and r.offset + r.length <= 2048
    assert total == Counter({i: n * length[i] for i, n in copies.items()})
