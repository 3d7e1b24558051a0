"""Language of words and documents by a linear-chain conditional random field.

A word's features are its character n-grams (those at its ends are affixes) and, from a lexicon, how much more often
it occurs in each language. Transitions between the languages of neighbouring words are learned with them.
Forward-backward gives each word's probability of each language given the whole text; a document's language is the
one with the largest mean probability over its words.

Labels of single words are not needed: the chain is trained on documents of one language each, joined into streams
in which some documents are cut, so that languages change between words as in code-switched text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from probestats.llm.shared import crc_of_id, first_ids, parts
from probestats.llm.wordgrams import char_ngrams, coded_words

TABLE_BITS = 18
LOW, HIGH = 2, 5


@dataclass
class Crf:
    langs: list[str]
    grams: np.ndarray  # hashed n-gram x language
    lexicon: dict[str, np.ndarray]  # word -> log ratios by language
    lexicon_weight: np.ndarray  # language x language
    change: np.ndarray  # transitions, from x to
    first: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Table rows of all n-grams, each word's first, the scale of each word's, and the lexicon's log ratios."""
        hashes, owner = char_ngrams(words, LOW, HIGH)
        starts = np.searchsorted(owner, np.arange(len(words)))
        scale = 1 / np.sqrt(np.diff(np.r_[starts, len(owner)]))
        none = np.zeros(len(self.langs))
        ratios = np.array([self.lexicon.get(w, none) for w in words]).reshape(len(words), -1)
        return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64), starts, scale, ratios

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each language for each distinct word."""
        out = np.zeros((len(words), len(self.langs)))
        for start in range(0, len(words), 20_000):
            some = words[start : start + 20_000]
            rows, starts, scale, ratios = self.features(some)
            out[start : start + len(some)] = np.add.reduceat(self.grams[rows], starts, axis=0) * scale[:, None] + ratios @ self.lexicon_weight
        return out

    def posteriors(self, scores: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probability of each language at each word of chains that end at ``ends``, by forward-backward.

        Chains run side by side, longest first, so that step t works on all chains that have a word t.
        """
        starts = np.r_[0, ends[:-1]]
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")  # chains with a word t
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        a = np.exp(self.change - self.change.max())
        forward, backward = np.empty_like(e), np.empty_like(e)
        now = np.exp(self.first - self.first.max())[None, :] * e[starts[: live[0]]] if len(live) else None
        for t, n in enumerate(live.tolist()):
            at = starts[:n] + t
            if t:
                now = (now[:n] @ a) * e[at]
            now = now / now.sum(axis=1, keepdims=True)
            forward[at] = now
        now = None
        for t in range(len(live) - 1, -1, -1):
            n = int(live[t])
            at = starts[:n] + t
            grown = np.ones((n, e.shape[1]))
            if now is not None and len(now):
                grown[: len(now)] = (now * e[at[: len(now)] + 1]) @ a.T
            now = grown / grown.sum(axis=1, keepdims=True)
            backward[at] = now
        both = forward * backward
        return both / both.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 0, epochs: int = 4, rate: float = 0.3, chain: int = 64, batch: int = 64, decay: float = 1e-5) -> Crf:
    """Fit on (language, text) rows: the lexicon on one half of each language's rows, the chain on the other."""
    langs = sorted({lang for lang, _ in rows})
    k, rng = len(langs), np.random.default_rng(seed)
    code = {lang: i for i, lang in enumerate(langs)}
    words, codes, ends = coded_words(pa.array([t for _, t in rows], pa.string()))
    docs = [codes[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
    seen, spans = Counter(), []
    counts = np.zeros((len(words), k))
    for (lang, _), doc in sorted(zip(rows, docs, strict=True), key=lambda x: x[0]):
        if not len(doc):
            continue
        seen[lang] += 1
        if seen[lang] % 2:
            counts[:, code[lang]] += np.bincount(doc, minlength=len(words))
        if seen[lang] % 2 == 0 or len(rows) < 4 * k:
            cut = np.cumsum(rng.geometric(1 / 12, size=len(doc))) if rng.random() < 0.5 else np.array([len(doc)])
            spans += [(x, code[lang]) for x in np.split(doc, cut[cut < len(doc)])]
    often = np.flatnonzero(counts.sum(axis=1) >= 2)
    rates = (counts[often] + 0.5) / (counts.sum(axis=0) + 0.5 * len(words))
    ratios = np.log(rates) - np.log(rates).mean(axis=1, keepdims=True)
    lexicon = {words[w]: r for w, r in zip(often.tolist(), ratios, strict=True)}
    crf = Crf(langs, np.zeros((1 << TABLE_BITS, k)), lexicon, np.eye(k) * 0.5, np.eye(k), np.zeros(k))
    if k < 2 or not spans:
        return crf
    spans = [spans[i] for i in rng.permutation(len(spans))]
    stream, labels = np.concatenate([s for s, _ in spans]), np.concatenate([np.full(len(s), c) for s, c in spans])
    squares = [np.full_like(p, 1e-2) for p in (crf.grams, crf.lexicon_weight, crf.change)]
    chains = np.arange(0, len(stream), chain)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(chains), -(-len(chains) // batch)):
            at = np.concatenate([np.arange(c, min(c + chain, len(stream))) for c in some])
            sizes = np.minimum(some + chain, len(stream)) - some
            own, local = np.unique(stream[at], return_inverse=True)
            rows_, starts, scale, lex = crf.features([words[w] for w in own.tolist()])
            scores = np.add.reduceat(crf.grams[rows_], starts, axis=0) * scale[:, None] + lex @ crf.lexicon_weight
            y = labels[at]
            p, pairs = _expected(crf, scores[local], np.cumsum(sizes))
            error = -p
            error[np.arange(len(y)), y] += 1
            by_word = np.stack([np.bincount(local, error[:, c], len(own)) for c in range(k)], axis=1)
            spread = np.repeat(by_word * scale[:, None], np.diff(np.r_[starts, len(rows_)]), axis=0)
            used, where = np.unique(rows_, return_inverse=True)
            g_grams = np.stack([np.bincount(where, spread[:, c], len(used)) for c in range(k)], axis=1)
            inside = np.ones(len(at), bool)
            inside[np.cumsum(sizes) - 1] = False
            i = np.flatnonzero(inside)
            g_change = -pairs
            np.add.at(g_change, (y[i], y[i + 1]), 1)
            n = len(at)
            g = g_grams / n - decay * crf.grams[used]
            squares[0][used] += g * g
            crf.grams[used] += rate * g / np.sqrt(squares[0][used]) * 10
            for param, square, g in ((crf.lexicon_weight, squares[1], lex.T @ by_word / n), (crf.change, squares[2], g_change / n)):
                g = g - decay * param
                square += g * g
                param += rate * g / np.sqrt(square)
    return crf


def _expected(crf: Crf, scores: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the words, and expected counts of the transitions."""
    p = crf.posteriors(scores, ends)
    # a pair's probability follows from the posterior of its second word and the filter before it
    starts = np.r_[0, ends[:-1]]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(crf.change - crf.change.max())
    pairs = np.zeros_like(a)
    now = np.ones((len(starts), len(a))) * np.exp(crf.first)
    for t in range(int((ends - starts).max())):
        live = np.flatnonzero(starts + t < ends)
        at = starts[live] + t
        if t:
            joint = now[live][:, :, None] * a[None]
            into = joint.sum(axis=1)
            pairs += (joint * (p[at] / into)[:, None, :]).sum(axis=0)
            now[live] = into
        now[live] *= e[at]
        now[live] /= now[live].sum(axis=1, keepdims=True)
    return p, pairs


def sample(docs: DataFrame, lang: str, learn, rows_per_lang: int) -> list[tuple[str, str]]:
    """(language, text) of the first ``rows_per_lang`` learnable ids of each language in hash order.

    The ids are chosen first, so that texts are neither sorted nor shuffled.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col(lang).cast("string").alias("lang"))
    chosen = first_ids(known, "lang", rows_per_lang).select(F.col("doc_id").alias("of"), "lang")
    texts = docs.where(learn).select("doc_id", F.col("text").cast("string").alias("text"))
    # at most rows_per_lang rows for each language are broadcast
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).where("text IS NOT NULL")
    once = found.groupBy("of", "lang").agg(F.min("text").alias("text"))  # however often an id is repeated
    return sorted((r["lang"], r["text"]) for r in once.collect())


def _tell(model: Crf, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    words, codes, ends = coded_words(texts)
    n = np.diff(np.r_[0, ends])
    lang, score = np.full(len(n), "und", object), np.zeros(len(n))
    has = np.flatnonzero(n)
    if len(has) and model.langs:
        p = model.posteriors(model.emissions(words)[codes], ends[has])
        mean = np.add.reduceat(p, np.r_[0, ends[has][:-1]], axis=0) / n[has][:, None]
        best = mean.argmax(axis=1)
        lang[has], score[has] = np.array(model.langs, object)[best], np.clip(mean[np.arange(len(has)), best], 0, 1)
    return lang, score


def predict(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, ``lang_pred`` and ``score`` (the language's mean probability over the words) of every document.

    ``und`` and 0 where a text has no letter, or where no language was learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "text", 2_000_000):
            lang, score = _tell(sent.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id long, lang_pred string, score double")


def segments(docs: DataFrame, crf: Crf) -> DataFrame:
    """Runs of words of one language in each document: doc_id, first_word, n_words, lang. Words without a letter do not count."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in parts(found, "text"):
            words, codes, ends = coded_words(batch.column("text"))
            if not len(codes) or not model.langs:
                continue
            n = np.diff(np.r_[0, ends])
            best = model.posteriors(model.emissions(words)[codes], ends[n > 0]).argmax(axis=1)
            doc = np.repeat(np.arange(len(n)), n)
            new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc[new])), pa.array(new - np.r_[0, ends[:-1]][doc[new]]), pa.array(np.diff(np.r_[new, len(best)])), pa.array(np.array(model.langs, object)[best[new]], pa.string())],
                ["doc_id", "first_word", "n_words", "lang"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id long, first_word long, n_words long, lang string")


def identify(docs: DataFrame, lang: str = "lang", rows_per_lang: int = 400) -> DataFrame:
    """One row per document: doc_id, ``held_out``, ``lang_pred``, ``score``. Fits first, on a job's result.

    Learns from rows whose CRC-32 of doc_id modulo 4 is not 2 and whose ``lang`` is known: at most
    ``rows_per_lang`` ids of each language, chosen by hash; repeated rows are learned from once.

    NULL text and texts without a letter: ``und``, 0. NULL doc_id: predicted, never learned from, not held out.
    Repeated rows return each. Other columns are ignored. An empty table gives no rows; if nothing can be learned
    all documents are ``und``.
    """
    held = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    return predict(docs, learn(docs, lang, rows_per_lang)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def learn(docs: DataFrame, lang: str, rows_per_lang: int) -> Crf:
    rows = sample(docs, lang, crc_of_id() % 4 != 2, rows_per_lang)
    return fit(rows) if rows else Crf([], np.zeros((0, 0)), {}, np.zeros((0, 0)), np.zeros((0, 0)))


def keep_identified(docs: DataFrame, lang: str = "lang", least: float = 0.5, rows_per_lang: int = 400) -> DataFrame:
    """The documents whose language is told with a score of ``least`` or more, row by row, with all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, lang, rows_per_lang))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "text", 2_000_000):
            told, score = _tell(sent.value, batch.column("text"))
            yield batch.filter(pa.array((told != "und") & (score >= least)))

    return docs.mapInArrow(batches, docs.schema)
