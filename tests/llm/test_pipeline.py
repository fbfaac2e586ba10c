"""The pipeline against its stages worked out by brute force."""

import re
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from keelson.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_keeps_what_each_stage_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {r["doc_id"] for r in quality.judge_quality(docs).where("kept").collect()}
    stage = docs.where(docs.doc_id.isin(*good))
    model = toxicity.fit(stage, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = sorted(r["doc_id"] for r in toxicity.score_texts(stage, model).where("score < 0.5").collect())
    first: dict[str, int] = {}
    for d in clean:
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[d]), d)
    left = sorted(first.values())
    sets = {d: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(re.findall("[^\x20\x09-\x0d]+", rows[d])) for d in left}
    root = {d: d for d in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(left):
        for b in left[:i]:
            k = len(sets[a] & sets[b])
            if 5 * k >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    stay = [d for d in left if find(d) == d]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter({d: len(tok.encode(rows[d], add_special_tokens=False).ids) + 1 for d in stay})
    got: Counter = Counter()
    pieces = corpus_pipeline.run(spark, SF).collect()
    for r in pieces:
        got[r["doc_id"]] += r["length"]
    assert got == want and 0 < len(stay) < len(clean) < len(rows)
    assert zlib.crc32(b"") == 0 and all(r["ids_crc32"] for r in pieces)


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
