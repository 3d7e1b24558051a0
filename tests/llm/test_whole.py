"""Each case here would have failed where an operator did less than its whole job."""

import numpy as np
import pytest

from probestats.llm import html, language, maxent, toxicity
from probestats.llm.shared import crc_of_id


# --- language model -------------------------------------------------------------------------------------------


def test_both_softmaxes_see_the_whole_history():
    """A word three back, or the two words before together, changes the group and the class inside it."""
    rng = np.random.default_rng(0)
    groups, classes = (rng.normal(size=(r, maxent.WAYS)).astype(np.float32) for r in (maxent.GROUP_ROWS, maxent.CLASS_ROWS))
    model = maxent.Model(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64), np.ones(maxent.CLASSES), 0, 0, groups, classes)
    group = np.zeros(1, np.int64)

    def told(*keys: int) -> list[np.ndarray]:
        features = model.features(np.array([*keys, 11], np.uint64) * maxent._A, np.zeros(4, np.int64))[:, 3:]
        return [maxent._log_softmax(w, r)[:, 0] for w, r in zip((groups, classes), maxent._rows(features, group), strict=True)]

    for one, other in zip(told(5, 7, 9), told(6, 7, 9), strict=True):
        assert np.abs(one - other).max() > 0.1
    lines = maxent._rows(model.features(np.arange(40, dtype=np.uint64) * maxent._A, np.zeros(40, np.int64)), np.zeros(40, np.int64))
    assert [len(x) for x in lines] == [5, 5]


def test_a_step_sums_the_errors_of_every_row():
    rng = np.random.default_rng(1)
    rows, target = rng.integers(0, 60, (5, 40)).astype(np.uint16), rng.integers(0, maxent.WAYS, 40)
    weights = rng.normal(size=(64, maxent.WAYS)).astype(np.float32)
    squares, touched = np.ones_like(weights), np.zeros(64, np.float32)
    error = -np.exp(maxent._log_softmax(weights, rows)).astype(np.float64)
    error[target, np.arange(40)] += 1
    g = np.zeros((64, maxent.WAYS))
    np.add.at(g, rows.ravel(), np.tile(error.T, (5, 1)))
    want = weights + 0.4 * g / np.sqrt(1 + g * g)
    maxent._step(weights, squares, touched, rows, target, 0.4)
    assert np.allclose(weights, want, atol=1e-5) and touched.tolist() == np.bincount(rows.ravel(), minlength=64).tolist()


# --- samples --------------------------------------------------------------------------------------------------


def test_language_samples_hold_distinct_ids(spark):
    """However often ids are repeated: all ids of a language with few, and as many as wanted of one with many."""
    often = [(i, f"wort {i}", "de") for i in range(20) for _ in range(500)]
    hot = [(1000, "le mot", "fr")] * 5000 + [(1000 + i, f"le mot {i}", "fr") for i in range(1, 300)]
    blank = [(5000 + i, None if i % 10 else f"word {i}", "en") for i in range(200)]
    docs = spark.createDataFrame(often + hot + blank, "doc_id long, text string, lang string")
    found = language.sample(docs, "lang", crc_of_id() % 4 != 2, 15)
    assert len(set(found)) == len(found)
    by = {lang: sum(x == lang for x, _ in found) for lang in ("de", "en", "fr")}
    assert by["fr"] == 15 and by["de"] == docs.where(crc_of_id() % 4 != 2).where("lang = 'de'").select("doc_id").distinct().limit(15).count()
    assert by["en"] == min(15, docs.where(crc_of_id() % 4 != 2).where("lang = 'en' AND text IS NOT NULL").count())
    assert len(language.sample(docs, "lang", crc_of_id() % 4 != 2, 1)) == 3


def test_toxicity_samples_hold_distinct_ids(spark):
    rows = [(i, "bad idiot", True) for i in range(30) for _ in range(1 if i else 3000)] + [(100 + i, "good idea", False) for i in range(3) for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    for most in (5, 20, 100):
        found = toxicity.training_rows(docs, np.empty(0, np.uint64), most)
        assert [sum(t == x for t, _ in found) for x in (True, False)] == [min(most, 30), 3]


# --- main text ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page",
    [
        "<div class=post><p>%(small)s</p><blockquote>%(large)s</blockquote></div>",
        "<div class=page><p>%(small)s</p><blockquote>%(large)s</blockquote></div>",
        "<article><div class=intro>%(small)s</div><div class=body>%(large)s</div></article>",
        "<main><h1>%(small)s</h1><article><p>%(large)s</article></main>",
        "<div class=page><div class=intro>%(small)s</div><div class=body>%(large)s</div></div>",
        "<article><table><tr><td>%(small)s<td>%(large)s</table></article>",
        "<div class=story><div>%(small)s</div><figure>%(large)s</figure></div>",
        "<article class=one><p>%(small)s</article><article class=two><p>%(large)s</article>",
    ],
)
def test_no_part_of_an_article_is_left(page):
    small, large = " ".join(["few words here"] * 35), " ".join(["more words here"] * 65)
    source = f"<body><nav>menu</nav><div class=sidebar>aside</div>{page % {'small': small, 'large': large}}<footer>foot</footer></body>"
    for path in (html.vote(source)[0], "no>such"):
        assert html.extract(source, path)[0] == f"{small} {large}"


def test_boilerplate_beside_an_article_is_left():
    text = "words of the article " * 20
    for source in (f"<body><div><div>by whom and when</div><article><p>{text}</article></div></body>", f"<body><table><tr><td>menu<td class=text><p>{text}</table></body>"):
        assert html.extract(source, html.vote(source)[0])[0] == text.strip()
