"""The document pipeline, stage by stage, on a small table with planted cases."""

import collections
import random

import brute
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def planted():
    pick = random.Random(12)
    vocab = [f"{a}{b}{c}" for a in ("al", "be", "cor") for b in ("mi", "to", "sen") for c in ("", "da", "ver")]
    clean = [" ".join(pick.choice(vocab) for _ in range(pick.randint(60, 200))) for _ in range(260)]
    copy, near = clean[0] + " \n", clean[1].split(" ")
    near[5] = "other"
    secret = clean[2] + " token = abcdefghijklmnop1234 " + clean[3]
    bad = ["too short", "again and again and again " * 30, " ".join(w + "%%%" for w in clean[4].split())]
    texts = [*clean, copy, " ".join(near), secret, *bad, None, ""]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], len(clean)


def test_stages(spark):
    data, n = planted()
    docs = spark.createDataFrame(data, SCHEMA)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None).persist()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    copy, near, secret = n, n + 1, n + 2
    assert ids["quality_rules"] == set(range(n + 3))  # what fails goes, what is clean stays
    assert ids["exact_dedup"] == ids["quality_rules"] - {0} and copy in ids["exact_dedup"]  # the longer text stays
    assert ids["near_dedup"] == ids["exact_dedup"] - {near}
    texts = {r.doc_id: r.text for r in kept["secret_scan"]}
    assert "[SECRET]" in texts[secret] and not any(brute.secrets(t) for t in texts.values())
    assert all(r.n_chars == len(r.text) for r in kept["secret_scan"])
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: len(ref.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    got = collections.Counter()
    for r in kept["packing"]:
        got[r.doc_id] += r.length
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
    assert docs.count() == 0


