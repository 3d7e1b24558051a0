"""Operators on documents against brute force, round trips and odd inputs."""

import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from probestats.llm import components, decontamination as dec, maxent, packing, quality, sharding, shared, simhash, similar

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- sharding -------------------------------------------------------------------------------------------------


@given(st.integers(1, 3000), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_permutation_and_its_inverse(n, seed):
    x = np.arange(n)
    p = sharding.permute(x.copy(), n, seed)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p.copy(), n, seed, back=True) == x).all()


def test_permutation_of_huge_ranges_is_spread():
    n = 10**12 + 7
    x = np.arange(0, n, n // 5000)
    p = sharding.permute(x.copy(), n, 1)
    assert len(set(p.tolist())) == len(x) and p.max() < n
    assert abs(p.mean() / n - 0.5) < 0.02 and abs(np.corrcoef(x, p)[0, 1]) < 0.05
    shard, slot = sharding.place(x.copy(), n, 24, 1)
    assert (sharding.row_at(shard, slot, n, 24, 1) == x).all()


def test_shards_are_even_and_reproducible(spark, sf):
    docs = shared.table(spark, sf, "documents")
    found = rows(sharding.shard(docs))
    again = rows(sharding.shard(docs.repartition(7)))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in found} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slots = {}
    for r in found:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 24
    # the order of row numbers is that of ids
    ids = sorted(texts)
    n = len(ids)
    shard, slot = sharding.place(np.arange(n), n, 24, 42)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in found} == set(zip(ids, shard.tolist(), slot.tolist(), strict=True))


def test_written_shards(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs.select("doc_id", "text"), str(tmp_path / "s"), shards=3, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"]) for r in odd_docs.collect())
    places = {(r["shard"], r["slot"]) for r in sharding.shard(odd_docs, 3).collect()}
    assert places == {(r["shard"], r["slot"]) for r in back.collect()}


# --- packing --------------------------------------------------------------------------------------------------


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids + [1]


def test_word_by_word_tokens_equal_whole_text_tokens():
    texts = ["Hello, world's 3rd  café\n\tnaïve １２ <|endoftext|> x<|startoftext|>y", "", None, " \x0b\x0c ", "a b　c é İstanbul ΣΑΣ.", "the " * 50 + "!?..."]
    array = pa.array(["dropped", *texts], pa.string()).slice(1)
    tokenize = packing.WordTokenizer(TOKENIZER, most=3)
    for _ in range(3):  # words are forgotten in between
        ids, sizes = tokenize(array)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [reference_ids(t) for t in texts]


def check_packed(found, docs, capacity):
    want = Counter()
    for r in docs.collect():
        ids = np.array(reference_ids(r["text"]), "<u4")
        start = 0
        for length in packing.cuts(len(ids), capacity):
            want[r["doc_id"], start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)] += 1
            start += length
        assert start == len(ids)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return sequences


@pytest.mark.parametrize("capacity", [1, 2, 64, 2048])
def test_tails_are_cut_at_class_limits(capacity):
    limits = {capacity // k for k in range(1, capacity + 1)}
    wasted = 0.0
    for n in range(1, 2 * capacity + 1):
        pieces = packing.cuts(n, capacity)
        full = n // capacity
        assert sum(pieces) == n and pieces[:full] == [capacity] * full and len(pieces) <= full + 3
        assert set(pieces[:-1]) <= limits
        wasted += sum(capacity / (capacity // x) - x for x in pieces)
    assert wasted <= 0.03 * sum(range(1, 2 * capacity + 1))


def test_first_fit():
    assert packing.first_fit([3, 7, 5, 2], 10) == [(0, 7), (0, 0), (1, 0), (1, 5)]
    assert packing.first_fit([], 10) == []


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, sf, capacity):
    docs = shared.table(spark, sf, "documents")
    sequences = check_packed(rows(packing.pack(docs.repartition(5), TOKENIZER, capacity)), docs, capacity)
    used = sum(x for p in sequences.values() for _, x in p)
    assert used > 0.95 * capacity * (len(sequences) - 1)
    # a bin of class k holds k pieces of that class; only the last few pieces of all classes are laid otherwise
    own = [p for s, p in sequences.items() if s % 4 < 2]
    assert all({capacity // x for _, x in p} == {len(p)} for p in own) and len(own) > 0.5 * len(sequences)


def test_packing_odd_documents(spark, odd_docs, no_docs):
    found = packing.pack(odd_docs, TOKENIZER, 256, keep_ids=True)
    check_packed(rows(found), odd_docs, 256)
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(found).collect()}
    for r in rows(found):
        assert ids[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack(no_docs, TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pack(no_docs, TOKENIZER, 1000)


# --- SimHash --------------------------------------------------------------------------------------------------


def slow_fingerprint(text, size):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_simhash_equals_brute_force(spark, sf):
    docs = shared.table(spark, sf, "documents")
    found = rows(simhash.near_duplicates(docs))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: slow_fingerprint(t, 3) for i, t in texts.items()}
    ids = sorted(fps)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    label = slow_components(ids, linked)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{fps[i]:016x}", label[i]) for i in ids}


def test_simhash_hash_is_the_built_in_one(spark):
    text = "ünï códe words"
    built_in = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert built_in % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


@given(st.integers(2, 400), st.integers(0, 2**32), st.integers(1, 3))
@settings(max_examples=25, deadline=None)
def test_bit_sliced_links_in_blocks(n, seed, words):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (max(1, n // 8), words)).astype(np.uint64)
    fps = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, fps.shape).astype(np.uint64)) * rng.integers(0, 2, fps.shape).astype(np.uint64)
    sizes = np.sort(np.diff(np.r_[0, np.sort(rng.integers(0, n + 1, 3)), n]))[::-1]
    sizes = sizes[sizes > 1]
    fps = fps[: sizes.sum()]
    got = slow_components(range(len(fps)), simhash.links_in_blocks(fps, sizes, 3).tolist()) if len(sizes) else {}
    block = np.repeat(np.arange(len(sizes)), sizes)
    linked = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if block[i] == block[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= 3]
    assert got == slow_components(range(len(fps)), linked)


def test_hot_block_is_dealt_and_complete(spark):
    """A chain of fingerprints in one block, larger than a task's part: every link crosses parts somewhere."""
    chain = [(1 << (i % 20)) ^ (i // 20 << 40) for i in range(300)]
    nodes = spark.createDataFrame([(c - 2**63,) for c in chain], "node long").withColumn("words", F.array("node"))
    keyed = nodes.withColumn("choice", F.lit(0)).withColumn("bits", F.lit(0).cast("long"))
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(keyed, 3, 32).collect()}
    want = slow_components(chain, [(a, b) for i, a in enumerate(chain) for b in chain[i + 1 :] if (a ^ b).bit_count() <= 3])
    assert slow_components(chain, [(a + 2**63, b + 2**63) for a, b in got]) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 1000 for i in range(1000, 1200)}}


@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(-30, 30))))
@settings(max_examples=60, deadline=None)
def test_forest_of_one_task(edges):
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    want = slow_components({x for e in edges for x in e}, edges)
    node, root = components.forest(a, b)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {k: v for k, v in want.items() if k != v}


@pytest.mark.parametrize("most", [7, components.LOCAL])
def test_components_whatever_a_task_joins(spark, most):
    """Chains, rings, stars and random edges over many files: most edges cross tasks and parts of tasks."""
    rng = np.random.default_rng(5)
    chain = rng.permutation(400).tolist()
    edges = list(zip(chain, chain[1:], strict=False)) + [(1000 + i, 1000 + (i + 1) % 60) for i in range(60)] + [(-3, i) for i in range(2000, 2200)] + rng.integers(3000, 3200, (90, 2)).tolist()
    spread = spark.createDataFrame([tuple(e) for e in edges], "x long, y long").repartition(40)
    got = rows(components.components(spread, "x", "y", most))
    want = slow_components({x for e in edges for x in e}, edges)
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["root"] for r in got} == {k: v for k, v in want.items() if v != k or k in {b for a, b in want.items() if a != b}}


def test_components_of_a_small_graph_take_few_jobs(spark):
    """Every plan costs the driver memory: rounds of a small graph must not each run their jobs."""
    chain = np.random.default_rng(5).permutation(3000).tolist()
    edges = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a long, b long")
    spark.sparkContext.setJobGroup("few", "components of a small graph")
    try:
        found = components.components(edges, "a", "b")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 12
    assert found.count() == 3000 and {r["root"] for r in found.collect()} == {0}


def test_near_duplicates_leave_little_in_the_driver(spark, monkeypatch):
    """Shuffles and broadcasts of plans that are done go while the chain runs; names of all documents are never broadcast."""
    small, stage, left, sides = similar.small, similar.stage, [], []
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    monkeypatch.setattr(similar, "small", lambda df, *rows: sides.append(df.columns) or small(df, *rows))
    monkeypatch.setattr(similar, "stage", lambda df, name: left.append(tracker.shuffleStatuses().size()) or stage(df, name))
    texts = [" ".join(f"word{i % 40}x{k}" for k in range(30)) + f" end {i}" for i in range(60)]
    kept = similar.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert kept.count() == 40
    assert sides and not any("_node" in columns for columns in sides)
    time.sleep(1)  # Spark's cleaner works beside
    assert tracker.shuffleStatuses().size() <= 8 and max(left) <= left[0] + 40


def test_near_duplicates_of_odd_documents(spark, odd_docs, no_docs):
    found = rows(simhash.near_duplicates(odd_docs))
    assert len(found) == odd_docs.count()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[1]] == [1, 1] and by[2][0]["component_id"] == 1
    zero = [r for r in found if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {3, 4, 5, None} and {r["component_id"] for r in zero} == {3}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_similar_groups_equal_brute_force(spark, sf):
    docs = shared.table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    base = next(t for t in texts.values() if t and 200 < len(t.split()) < 400)
    w = base.split()
    edited = {10_000 + k: " ".join(w[: 20 * k] + ["changed"] + w[20 * k + 1 :]) for k in range(8)} | {10_100: " ".join(w[: len(w) * 9 // 10]), 10_200: " ".join(w[: len(w) // 2])}
    more = docs.select("doc_id", "text").union(spark.createDataFrame(list(edited.items()), "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(more, group=6).collect()}
    sets = {i: set(similar.shingle_set((t or "").encode(), 5).tolist()) for i, t in (texts | edited).items()}
    ids = sorted(sets)
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if alike(sets[a], sets[b])]
    assert got == slow_components(ids, linked)
    kept = {r["doc_id"] for r in similar.keep_first(more).collect()}
    assert kept == set(slow_components(ids, linked).values())


def test_keep_first_of_odd_documents(odd_docs, no_docs):
    kept = similar.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 6, 7, 8, -9, None, None], key=str)
    assert similar.keep_first(no_docs).count() == 0


@pytest.mark.parametrize("number", [0, 10**9])
def test_no_link_is_missed_where_few_words_repeat(spark, monkeypatch, number):
    """Fingerprints of such texts are far apart at the threshold; the bands are those of ever more documents."""
    from random import Random

    bands = similar.bands_for
    monkeypatch.setattr(similar, "bands_for", lambda n: bands(max(n, number)))
    rng = Random(5)
    texts, pairs = {}, []
    for i in range(40):
        words = [f"w{rng.randrange(20)}" for _ in range(1000)]
        longer = words + [f"new{i}x{k}" for k in range(248)]
        texts |= {2 * i: " ".join(words), 2 * i + 1: " ".join(longer)}
        a, b = (set(similar.shingle_set(texts[2 * i + k].encode(), 5).tolist()) for k in (0, 1))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * i, 2 * i + 1))
    assert len(pairs) > 30
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs).collect()}
    assert got == slow_components(sorted(texts), pairs)


@pytest.mark.parametrize("size", [1, 2, 7, 30, 33, 100, 517, 5000])
def test_prefixes_of_similar_sets_share_enough(size):
    rng = np.random.default_rng(size)
    for threshold in (0.8, 0.9):
        for larger in {size, int(size / threshold)}:
            # as little in common as the threshold allows, and the differences first in hash order
            both = next(c for c in range(size + 1) if c >= threshold * (size + larger - c) - 1e-9)
            for first in (True, False):
                values = np.sort(rng.choice(2**62, size + larger - both, replace=False).astype(np.uint64))
                unlike = size + larger - 2 * both
                other, shared_ = (values[:unlike], values[unlike:]) if first else (values[len(values) - unlike :], values[: len(values) - unlike])
                a = np.sort(np.r_[other[: size - both], shared_])[: similar.prefix(size, threshold)]
                b = np.sort(np.r_[other[size - both :], shared_])[: similar.prefix(larger, threshold)]
                in_both = len(np.intersect1d(a, b))
                assert in_both >= similar.common(size, threshold)
                assert similar.common(similar._least(larger, threshold), threshold) <= in_both


def test_only_documents_with_rare_shingles_of_other_groups_are_candidates(spark):
    """Texts that share some of their words, which very many hold, are never compared."""
    hot = " ".join(f"line{i}" for i in range(60))
    docs = spark.createDataFrame([(i, hot + " " + " ".join(f"own{i}x{k}" for k in range(340))) for i in range(300)], "doc_id long, text string")
    rows = similar.prints(docs, 2, 5, 0.8)
    named = rows.select("key", F.col("doc_id").alias("node"), F.col("doc_id").alias("component_id"))
    assert similar.unlinked(rows, named, 0.8).count() == 0


def test_prefixes_are_shuffled_once(spark, monkeypatch):
    """Also where no side of a join is small, rows of shingles meet once, and not before that."""
    texts = [" ".join(f"word{i}x{k}" for k in range(60)) + f" the end {i % 7} of all is said" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, stage = [], similar.stage
    monkeypatch.setattr(similar, "small", lambda df, rows=0: df)
    monkeypatch.setattr(similar, "stage", lambda df, name: found.append((name, df._jdf.queryExecution().executedPlan().toString())) or stage(df, name))
    made = stage(similar.prints(docs, 2, 5, 0.8), "prints")
    similar.unlinked(made, made.select("key", F.col("doc_id").alias("node"), F.col("doc_id").alias("component_id")), 0.8)
    assert found and sum(plan.count("Exchange hashpartitioning(shingle") for name, plan in found if name not in ("hot", "met")) == 1


@pytest.mark.parametrize("least", [1, 3])
def test_frequent_shingles_make_the_same_candidates(spark, monkeypatch, least):
    """Counted before the shuffle or after it; of two copies one counts, and a group's own shingles are none."""
    common = " ".join(f"line{i}" for i in range(60))
    texts = {i: common + " " + " ".join(f"own{i // 2 if i < 40 else i}x{k}" for k in range(20 + i % 3)) for i in range(400)} | {400: common + " a", 401: common + " a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows_ = similar.stage(similar.prints(docs, 2, 5, 0.8), "prints")
    nodes = rows_.groupBy("key").agg(F.min("doc_id").alias("node"))
    named = similar.stage(nodes.withColumn("component_id", F.when(F.col("node") < 20, F.expr("node div 2 * 2")).otherwise(F.col("node"))), "named")
    monkeypatch.setattr(similar, "HOT_COUNT", 10**9)
    want = sorted(rows(similar.unlinked(rows_, named, 0.8)), key=str)
    monkeypatch.setattr(similar, "HOT_COUNT", least)
    assert want and sorted(rows(similar.unlinked(rows_, named, 0.8)), key=str) == want
    assert 401 not in {r["node"] for r in want}


def test_rows_a_document_do_not_grow_with_the_number_of_documents(spark, monkeypatch, no_docs):
    seen, banded, bands = [], similar._banded, similar.bands_for
    monkeypatch.setattr(similar, "bands_for", lambda n: bands(15_000_000))
    monkeypatch.setattr(similar, "_banded", lambda nodes, bits, n: seen.append((bits, n)) or banded(nodes, bits, n))
    similar.similar_groups(no_docs.select("doc_id", "text"))
    assert seen == [(18, similar.MOST_BANDS)] and similar.MOST_BANDS >= bands(250_000)[1]


@pytest.mark.parametrize("most", [32, 4096])
def test_blocks_with_lone_rows_are_shuffled_once(spark, most):
    chain = [(1 << (i % 20)) ^ (i // 20 << 40) for i in range(300)]
    nodes = spark.createDataFrame([(c - 2**63, 0) for c in chain] + [(c - 2**63, 1 + i) for i, c in enumerate(chain)], "node long, bits long")
    keyed = similar.stage(nodes.withColumn("words", F.array("node")).withColumn("choice", F.lit(0)), "keyed")
    found = simhash.links(keyed, 3, most, lone=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {tuple(sorted((r["a"], r["b"]))) for r in found.collect()}
    want = slow_components(chain, [(a, b) for i, a in enumerate(chain) for b in chain[i + 1 :] if (a ^ b).bit_count() <= 3])
    assert slow_components(chain, [(a + 2**63, b + 2**63) for a, b in got]) == want
    assert simhash.links(keyed.where("bits > 0"), 3, most, lone=True).count() == 0


def test_halves_in_columns_equal_those_of_single_words():
    from random import Random

    letters = ["a", "B", "z", "Z", "@", "[", "`", "{", "1", ".", ",", ";", "!", "?", ":", "é", "É", "İ", "ß", "K", "\u0307", "漢", "\U0001f600", "-", "_", "\x00", "　"]
    draw = Random(3)
    made = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(20_000)} | {"...", "aİ."}
    for words in (sorted(made), ["..."], []):
        found, at = packing.all_halves(pa.array(words, pa.large_string()))
        assert [(found[i], found[j]) for i, j in at.tolist()] == [packing._halves(w) for w in words] and len(set(found)) == len(found)


def test_words_of_letters_are_tokenized_many_in_a_text(monkeypatch):
    """The tokenizer gets fewer texts than words, and gives what it gives for the whole text."""
    from tokenizers import Tokenizer

    words = [f"{a}{b}{c}ing" for a in "bcdfgh" for b in "aeiou" for c in "lmnprst"] + ["don't", "12", "naïve", "x-ray"]
    plain, own = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER)
    seen, single = [], own._single
    monkeypatch.setattr(own, "_single", lambda texts: seen.append(len(texts)) or single(texts))
    text = " ".join(words)
    assert own(pa.array([text]))[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1] and sum(seen) < len(words) / 10
    monkeypatch.setattr(own, "_closes", np.ones_like(own._closes))  # ends that cannot be told: one by one
    other = "unbelievably " + text.replace("ing", "ings")
    assert own(pa.array([other]))[0].tolist() == [*plain.encode(other, add_special_tokens=False).ids, 1]


def test_bands_reach_the_recall():
    for n in (100, 10**6, 10**10):
        bits, bands = similar.bands_for(n)
        assert 1 - (1 - similar.AGREE**bits) ** bands >= 0.997 and n / 2**bits <= 64


# --- decontamination ------------------------------------------------------------------------------------------


def test_contaminated_equals_brute_force(spark, sf):
    docs, items = shared.table(spark, sf, "documents"), shared.table(spark, sf, "benchmark")
    some = [r["text"].split() for r in items.limit(12).collect()]
    planted = [(90_000 + i, " ".join(["before", "it"] + ["another"] * (i % 3) + w[i % 3 :] + ["after"] * 9)) for i, w in enumerate(some)]
    planted += [(91_000, " ".join(some[0] + some[1] + some[0])), (91_001, " ".join(some[2]).upper().replace(".", " !")), (91_002, " ".join(some[3][:-2]))]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in dec.contaminated(docs, items).collect()}
    plain = {r["item_id"]: dec.plain_words(r["text"]) for r in items.collect()}
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    want = {}
    for r in docs.collect():
        w = dec.plain_words(r["text"])
        has = set(shingles(w))
        for item, own in plain.items():
            own_shingles = shingles(own)
            if not has & set(own_shingles):
                continue
            for s in range(max(1, len(w) - len(own) + 1)):
                value = dec.similarity(shingles(w[s : s + len(own)]), own_shingles)
                if value >= 0.8 and value > want.get((r["doc_id"], item), (0,))[0]:
                    want[r["doc_id"], item] = (value, s)
    assert got == want and len(want) > 10 and min(v for v, _ in want.values()) < 1


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 50, 30)) for _ in range(200)]
    items = dec.Items(list(enumerate(text)), 5, 24, 0.8)
    prints = rng.integers(0, 2**63, 3000).astype(np.uint64)
    prints[:1000] = items.prints[30][rng.integers(0, 200, 1000)]
    for _ in range(24):
        prints[:1000] ^= np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64)
    w, i = items.near(30, prints)
    within = np.bitwise_count(prints[:, None] ^ items.prints[30][None, :]) <= 24
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(within)), strict=True))


def test_decontamination_of_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "jumps over the lazy dog and then runs"), (None, "nummer aber mit vielen worten darin"), (3, None), (4, ""), (5, "12 34 56"), (1, "word5 other5 word6 other6 word7 other7 word8")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in dec.contaminated(odd_docs, items).collect())
    assert got == Counter({(1, 1): 2, (2, 1): 1, (None, None): 1, (8, 5): 1, (6, 1): 1})
    kept = dec.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([3, 4, 5, None, 7, -9])
    assert dec.contaminated(no_docs, items).count() == 0
    assert dec.contaminated(odd_docs, items.limit(0)).count() == 0 and dec.clean(odd_docs, items.limit(0)).count() == odd_docs.count()
    many = dec.contaminated(odd_docs, items, part_bytes=20)  # several passes
    assert Counter((r["doc_id"], r["item_id"]) for r in many.collect()) == got


def test_equal_rows_are_numbered_in_many_ranges(spark):
    rows_ = spark.range(0, 50_000, 1, 4).select(F.lit(7).alias("doc_id"))
    numbered, n = sharding.number_rows(rows_, ["doc_id"], cells=8)
    assert n == 50_000 and numbered.agg(F.min("row"), F.max("row"), F.countDistinct("row")).first()[:] == (0, n - 1, n)
    found = sharding.shard(spark.createDataFrame([], "doc_id long, text string"))
    assert found.count() == 0 and "slot" in found.columns


def test_words_that_end_in_a_dotted_capital():
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(TOKENIZER)
    texts = ["İ, x", "aİ. b", "İ.,", "İstanbul, İ;", "ß. ǅ, ŉ! É,", "ΣΑΣ. İİ:"]
    ids, sizes = packing.WordTokenizer(TOKENIZER)(pa.array(texts))
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, np.r_[0, ends[:-1]], ends, strict=True):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids + [packing.END]


# --- quality --------------------------------------------------------------------------------------------------


def test_measures():
    five = "a b c d e"
    assert quality.measure_text(f"{five} {five} x")[:5] == (11, 11, 0, 0, 10)
    assert quality.measure_text("a a a a a a a")[4] == 7
    assert quality.measure_text("x # y\nx # y\n\n \nz|%")[1:6] == (9, 4, 1, 0, 3)
    assert quality.measure_text(None) == (0,) * 7
    assert quality.measure_text("é ü")[:2] == (1, 3)  # not a separator here


def test_host_verdicts(spark):
    """Documents of a bad host fall by the strict limits, equal ones of a good host do not."""
    clean = " ".join(f"w{i}" for i in range(40))
    mild = " ".join(f"w{i}" + ("#" if i % 8 == 0 else "") for i in range(40))  # 5 symbols in 40 words
    severe = " ".join(f"w{i}##" for i in range(40))
    rows_ = [(i, mild if i % 4 else clean, "bad") for i in range(200)] + [(1000 + i, clean if i else mild, "good") for i in range(200)] + [(5000, severe, "good"), (6000, mild, "tiny")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert not found[1]["kept"] and found[4]["kept"] and found[1000]["kept"] and not found[5000]["kept"]
    rates = {r["host"]: r["host_rate"] for r in found.values()}
    assert 0.7 < rates["bad"] < 0.75 and rates["good"] < 0.02 and 0.3 < rates["tiny"] < 1  # one document is shrunk
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {i for i, r in found.items() if r["kept"]}


def test_quality_of_odd_documents(odd_docs, no_docs):
    found = rows(quality.judge(odd_docs))
    assert len(found) == odd_docs.count()
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in found if r["kept"]) == Counter({1: 2, 2: 1, None: 1})
    assert quality.judge(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


# --- language model -------------------------------------------------------------------------------------------


def lm_words(text):
    return bytes((text or "").encode()).lower().split() + [None]


def check_base(found, docs):
    counts = Counter()
    for r in docs:
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update(lm_words(r["text"]))
    total = counts.total()
    want = Counter()
    for r in docs:
        words = lm_words(r["text"])
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words)
        want[r["doc_id"], len(words), sum(counts[w] > 0 for w in words), total, round(base, 5) + 0.0] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5) + 0.0) for r in found) == want


def test_language_model(spark):
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents")
    found = rows(maxent.score(docs))
    check_base(found, docs.collect())
    held = [r for r in found if r["held_out"]]
    assert len(held) > 100 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in found)
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in found)


def test_language_model_is_a_distribution():
    """Over all known words and one unknown word of each class, probabilities add up to one, after any history."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(500)]
    n = rng.integers(1, 50, len(words))
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)
    codes = maxent.suffix_codes(words)
    mass = np.bincount(codes, n, 1 << maxent.CODE_BITS)
    class_of = np.minimum((np.cumsum(mass) - mass / 2) * maxent.CLASSES / mass.sum(), maxent.CLASSES - 1).astype(np.int64)
    cls = class_of[codes]
    of_class = np.bincount(cls, n, maxent.CLASSES) + np.bincount(cls, minlength=maxent.CLASSES) + 1
    groups, classes = (rng.normal(size=(r, maxent.WAYS)).astype(np.float32) for r in (maxent.GROUP_ROWS, maxent.CLASS_ROWS))
    order = np.argsort(hashes)
    model = maxent.Model(hashes[order], n[order], class_of, of_class, int(n.sum()), len(words), groups, classes)
    features = np.repeat(model.features(np.array([5, 7, 9, 11], np.uint64), np.zeros(4, np.int64))[:, 3:], maxent.CLASSES, axis=1)
    y = np.arange(maxent.CLASSES)
    rows_ = maxent._rows(features, y // maxent.WAYS)
    p = np.exp(maxent._log_softmax(groups, rows_[0])[y // maxent.WAYS, y] + maxent._log_softmax(classes, rows_[1])[y % maxent.WAYS, y])
    assert p.sum() == pytest.approx(1, abs=1e-4)
    assert (p[cls] * (n + 1) / of_class[cls]).sum() + (p / of_class).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_of_odd_documents(spark, odd_docs, no_docs):
    check_base(rows(maxent.score(odd_docs)), odd_docs.collect())
    assert maxent.score(no_docs).count() == 0
    untrained = rows(maxent.score(odd_docs.where("doc_id IS NULL")))
    assert {(r["train_tokens"], r["base_score"], r["n_known"]) for r in untrained} == {(0, 0.0, 0)}


def test_tokens_of_a_slice():
    texts = pa.array(["drop", "É Ab ab\x0bAB éé x", None, ""]).slice(1)
    hashes, _, numbers, ends = maxent.tokens(texts)
    want = [xxhash.xxh64_intdigest(w) for w in ("É".encode(), b"ab", b"ab", b"ab", "éé x".encode())]
    assert hashes[numbers].view(np.uint64).tolist() == [*want, 0, 0, 0] and ends.tolist() == [6, 7, 8]


def test_tokenizer_gets_few_words_a_call():
    """What the tokenizer returns takes much memory a word, so a slice of new words must not go to it at once."""
    import public_tokenizers
    import pyarrow as pa

    from probestats.llm import packing

    tokenize = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    plain, calls = tokenize._tokenizer, []

    class Counted:
        def encode_batch_fast(self, words, **how):
            calls.append(len(words))
            return plain.encode_batch_fast(words, **how)

    tokenize._tokenizer = Counted()
    texts = [" ".join(f"w{i}x{j}." for j in range(500)) for i in range(20)] + [None, ""]
    ids, sizes = tokenize(pa.array(texts, pa.string()))
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert sum(calls) > 10_000 and max(calls) <= 5000
