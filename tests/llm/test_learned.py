"""Language identification and toxicity: exactness of the inference, held-out accuracy, odd inputs."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from probestats.llm import language, shared, toxicity
from probestats.llm.wordgrams import char_ngrams, coded_words

SF = "/root/testdata/sf0.01"


def crf(k, seed):
    rng = np.random.default_rng(seed)
    return language.Crf([f"l{i}" for i in range(k)], np.zeros((4, k)), {}, np.eye(k), rng.normal(size=(k, k)), rng.normal(size=k))


@pytest.mark.parametrize("k", [2, 3])
def test_forward_backward_equals_enumeration(k):
    model, rng = crf(k, k), np.random.default_rng(9)
    sizes = [1, 5, 3, 4]
    scores = rng.normal(size=(sum(sizes), k)) * 2
    got = model.posteriors(scores, np.cumsum(sizes))
    pairs_got = language._expected(model, scores, np.cumsum(sizes))[1]
    pairs, start = np.zeros((k, k)), 0
    for n in sizes:
        s, p, pp, total = scores[start : start + n], np.zeros((n, k)), np.zeros((k, k)), 0.0
        for path in itertools.product(range(k), repeat=n):
            w = np.exp(model.first[path[0]] + sum(s[t, path[t]] for t in range(n)) + sum(model.change[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for t in range(n):
                p[t, path[t]] += w
            for a, b in itertools.pairwise(path):
                pp[a, b] += w
        assert np.allclose(got[start : start + n], p / total)
        pairs += pp / total
        start += n
    assert np.allclose(pairs_got, pairs)


def test_ngrams_are_those_of_the_words():
    words = ["ab", "a", "xyzab", "é"]
    hashes, owner = char_ngrams(words, 2, 4)
    of = {}
    for h, o in zip(hashes.tolist(), owner.tolist(), strict=True):
        of.setdefault(o, []).append(h)
    assert [len(of[i]) for i in range(4)] == [3 + 2 + 1, 2 + 1, 6 + 5 + 4, 2 + 1]
    assert len(set(of[0]) & set(of[2])) == 3  # "ab", and the endings "b" and "ab"
    long, _ = char_ngrams(["a"], 5, 6)
    assert len(long) == 1  # shorter than any n-gram: itself


def test_coded_words_of_a_slice():
    texts = pa.array(["drop", "Ab 12 cd, CD.", None, "é"]).slice(1)
    words, codes, ends = coded_words(texts)
    assert [words[c] for c in codes] == ["ab", "cd", "cd", "é"] and ends.tolist() == [3, 3, 4]


def test_languages_held_out(spark):
    docs = shared.table(spark, SF, "documents")
    langs = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    found = language.identify(docs).collect()
    assert len(found) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and len((langs[r["doc_id"]][1] or "").split()) > 3]
    assert sum(r["lang_pred"] == langs[r["doc_id"]][0] for r in held) > 0.99 * len(held) > 100


def test_code_switched_words(spark):
    docs = shared.table(spark, SF, "documents")
    model = language.learn(docs, "lang", 200)
    by = {}
    for r in docs.where("crc32(encode(cast(doc_id as string), 'utf-8')) % 4 = 2").collect():
        words = [w for w in (r["text"] or "").split() if any(c.isalpha() for c in w)]
        if len(words) > 100:
            by.setdefault(r["lang"], words[50:75])
    text = " ".join(w for lang in sorted(by) for w in by[lang])
    found = sorted(language.segments(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect(), key=lambda r: r["first_word"])
    label = [x for r in found for x in [r["lang"]] * r["n_words"]]
    truth = [lang for lang in sorted(by) for _ in by[lang]]
    assert len(label) == len(truth) and sum(a == b for a, b in zip(label, truth, strict=True)) > 0.9 * len(truth)


def test_language_of_odd_documents(odd_docs, no_docs):
    found = language.identify(odd_docs).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(found) == odd_docs.count() and len(by[1]) == 2
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (3, 4, 5, 8))
    assert {r["lang_pred"] for r in found} <= {"en", "de", "fr", "und"} and not any(r["held_out"] for r in by[None])
    kept = language.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {3, 4, 5, 8}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language.identify(no_docs).count() == 0
    nothing = language.identify(odd_docs.where("lang IS NULL")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_document_ngrams_with_and_without_a_vocabulary():
    texts = pa.array(["idiot idiot clown", None, "the clown", ""])
    docs, grams = toxicity.document_ngrams(texts)
    known = np.unique(grams)[::3]
    some_docs, at = toxicity.document_ngrams(texts, known)
    want = {(d, g) for d, g in zip(docs.tolist(), grams.tolist(), strict=True) if g in set(known.tolist())}
    assert {(d, int(known[a])) for d, a in zip(some_docs.tolist(), at.tolist(), strict=True)} == want
    assert len(set(zip(docs.tolist(), grams.tolist(), strict=True))) == len(docs)


def test_log_ratios_equal_counts(spark):
    rows = [("bad bad idiot", True)] * 4 + [("good idea", False)] * 6 + [("bad good", False)]
    grams, ratios = toxicity.log_ratios(spark.createDataFrame(rows, "text string, toxic boolean"), 1000, least=1, least_ratio=-99.0)
    counts = {}
    for text, toxic in rows:
        for g in set(toxicity.document_ngrams(pa.array([text]))[1].tolist()):
            counts.setdefault(g, [0, 0])[not toxic] += 1
    p_all, q_all = (sum(c[i] + 1 for c in counts.values()) for i in (0, 1))
    want = {g: np.log((p + 1) / p_all) - np.log((q + 1) / q_all) for g, (p, q) in counts.items()}
    assert dict(zip(grams.tolist(), np.round(ratios, 9).tolist(), strict=True)) == {g: round(r, 9) for g, r in want.items()}


def test_toxicity_held_out(spark):
    docs, labels = (shared.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    held = [(toxic[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in toxic]
    # about one in six labels of these tables stands for nothing in the text
    assert np.mean([p for t, p in held if t]) > 0.75 and np.mean([p for t, p in held if not t]) < 0.01


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(-9, 9)] + [(1, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in found)
    empty = {r["score"] for r in found if r["doc_id"] in (3, 4, 5)}
    assert len(empty) == 1
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {0}
