"""The corpus pipeline against its stages in plain Python."""

import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from cairn.llm import op1_language, op5_decontaminate, op6_sentencepiece, op9_secrets

from .test_operators import shingles, words


def test_pipeline(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = op1_language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    best, score = model.score_block(pa.array(list(docs.values())))
    kept = [d for d, b, s in zip(docs, best, score, strict=True) if b >= 0 and s >= 0.5]
    sets, part = {d: shingles(docs[d]) for d in kept}, {}
    for d in sorted(kept):
        part[d] = d
    changed = True
    pairs = [(a, b) for i, a in enumerate(kept) for b in kept[:i] if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(part[a], part[b])
            changed |= part[a] != low or part[b] != low
            part[a] = part[b] = low
    kept = [d for d in kept if part[d] == d]
    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(13, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    sizes = {len(x) for x in grams}

    def clean(text):
        w = words(text)
        hit = {i + k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for k in range(n)}
        return not hit or 20 * len(hit) < len(w)

    kept = [d for d in kept if clean(docs[d])]
    scanner = op9_secrets.Scanner()
    final = {}
    for d in kept:
        out, at = [], 0
        for s, k, e in scanner.spans([docs[d].encode()])[0]:
            if s >= at:
                out += [docs[d][at:s], f"<{scanner.rules[k].name}>"]
            at = max(at, e)
        final[d] = "".join([*out, docs[d][at:]])
    codec = op6_sentencepiece.codec(op6_sentencepiece.model_path())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(final)
    for d, text in final.items():
        ids, sizes = codec.encode(pa.array([text]))
        assert got[d]["ids"] == ids.tolist() and got[d]["n_ids"] == int(sizes[0]) and got[d]["round_trip"] == (codec.decode(ids, np.array([len(ids)]))[0].decode() == text)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, sf).count() == docs.count() - docs.filter(~docs["text"].rlike(r"\p{L}") | docs["text"].isNull()).count()
    assert not [r for r in corpus_pipeline.secrets(spark, docs, sf).collect() if re.search("AKIA[A-Z0-9]{16}", r["text"] or "")]
    assert op5_decontaminate.normalised("A-b É1") == [b"a", b"b", "É1".encode()]
