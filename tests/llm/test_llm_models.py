"""Trained operators: held-out accuracy, exact likelihoods, and the pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from creditloom.llm import decontaminate, hmm, langid, simhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_of_held_out_documents(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(docs).where("held_out").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_language_odd(odd, nothing):
    got = {r["text"]: r for r in langid.language_id(odd).collect()}
    for text in (None, "", " \t\n ", "7 8 9 ## --"):
        assert (got[text]["lang_pred"], got[text]["score"]) == ("und", 0.0)
    assert langid.language_id(nothing).count() == 0
    assert langid.language_id(odd.where("doc_id = 3")).first()["lang_pred"] == "und"


def test_language_mixture():
    counts = np.ones((2, langid.BUCKETS))
    texts = ["the cat sat on the mat and then the other one", "der hund lief durch den wald und war sehr schnell"]
    for k, t in enumerate(texts):
        _, bucket, _ = langid.trigrams([t])
        np.add.at(counts[k], bucket, 50)
    model = langid.Mixture(["en", "de"], counts)
    labels, scores = model.predict([texts[0], texts[1], f"{texts[0]} {texts[0]} {texts[1]}", "42"])
    assert labels == ["en", "de", "en", "und"] and scores[0] == scores[1] == 1.0 and 0.5 < scores[2] < 0.8


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    model = hmm.Model(*(x / x.sum(axis=-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, 20)))))
    lengths = np.array([1, 200, 31, 32, 33, 64, 65, 5])
    classes = rng.integers(0, 20, lengths.sum())
    _, _, got = hmm.Lanes(classes, lengths).forward(model)
    want, counts = [], np.zeros(3 + 9 + 60)
    for a, n in zip(np.cumsum(lengths) - lengths, lengths):
        o = classes[a:a + n]
        alpha, beta = [model.start * model.emit[:, o[0]]], [np.ones(3)]
        for c in o[1:]:
            alpha.append(alpha[-1] @ model.step * model.emit[:, c])
        for c in o[:0:-1]:
            beta.append(model.step @ (model.emit[:, c] * beta[-1]))
        beta, total = beta[::-1], alpha[-1].sum()
        want.append(np.log(total))
        counts[:3] += alpha[0] * beta[0] / total
        for t, c in enumerate(o):
            counts[12:].reshape(3, 20)[:, c] += alpha[t] * beta[t] / total
            if t:
                counts[3:12] += (np.outer(alpha[t - 1], model.emit[:, c] * beta[t]) * model.step / total).ravel()
    assert np.allclose(got, want) and np.allclose(hmm.Lanes(classes, lengths).expected(model), counts)


def test_scores(documents, odd, nothing):
    for docs in (documents, odd):
        rows = [(r["doc_id"], [*SPACED.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")), "\n"]) for r in docs.collect()]
        held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
        c = Counter(w for (_, ws), h in zip(rows, held) if not h for w in ws)
        n, v = sum(c.values()), len(c)
        want = [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, ws), h in zip(rows, held)]
        got = hmm.score_texts(docs).collect()
        assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=repr) == sorted(want, key=repr)
        assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm.score_texts(nothing).count() == 0


def test_score_beats_base_on_held_out(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = hmm.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_classes_are_a_distribution():
    classes = hmm.Classes(np.array([5, 9], np.uint64), np.arange(256.0), np.ones(256))
    keys = np.array([9, 5, 300, 44], np.uint64)
    assert classes.of(keys).tolist() == [1, 0, 2 + 44, 2 + 44]
    # Class 44 holds one kind with 44 tokens, and one unknown token.
    p = 10 ** classes.log10_in_class(np.array([46, 46]), np.array([44, 0]))
    assert abs(p.sum() - 1) < 1e-12


def test_pipeline_stages(llm, folder, documents, tmp_path):
    docs = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(llm, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            out = llm.read.parquet(str(tmp_path / name))
            if name == "near_duplicates":
                found = simhash.simhash_dedup(docs)
                want = {r[0] for r in found.where("doc_id = component_id").select("doc_id").collect()}
                assert {r["doc_id"] for r in out.collect()} == want
            if name == "benchmark_passages":
                bad = decontaminate.decontaminate(docs, llm.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").count()
                assert out.count() == docs.count() - bad
            docs = out
    whole = corpus_pipeline.run(llm, folder)
    assert whole.agg(F.countDistinct("doc_id")).first()[0] == docs.count() > 0.5 * documents.count()


def test_pipeline_odd(llm, odd, nothing, folder):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(llm, docs, folder)
        assert set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
        corpus_pipeline.pack(llm, docs, folder).count()
