"""Conversations, runs and exact search against brute force, and odd inputs."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from probestats.llm import conversations as conv, periodic, shared, topk
from probestats.llm.recompression import Grammar

SPACE = " \t\n\v\f\r"


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- conversations ----------------------------------------------------------------------------------------------

ROLE = {"u": "user", "a": "assistant"}
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """All scripts in order of cost and text, by a queue; no survivors, trees or parts."""
    fault, queue, done = faults(turns), [(0, "", "", 0, ())], set()
    while True:
        cost, audit, state, i, left = heapq.heappop(queue)
        if (state, i) in done:
            continue
        done.add((state, i))
        if i == len(turns) and state in ("", "a"):
            return cost, audit, list(left)
        ways = [(5, "I", to, i, (ROLE[to], "")) for to in NEXT[state] if to in ROLE]
        if i < len(turns):
            role, text = turns[i]
            ways.append((2, "D", state, i + 1, None))
            if fault[i] in ("", "truncated"):
                more = 5 if fault[i] else 0
                ways += [(more, "K", to, i + 1, (role, text)) for to in NEXT[state] if to == role[:1]]
                ways += [(more + 1, "R", to, i + 1, (ROLE[to], text)) for to in NEXT[state] if to in ROLE]
        for more, edit, to, at, message in ways:
            heapq.heappush(queue, (cost + more, audit + edit, to, at, left if message is None else (*left, message)))


def expected(found):
    """What ``repair`` should tell of (turn, role, text) rows in order."""
    turns = [(r, x) for _, r, x in found]
    fault, numbers = faults(turns), [t for t, _, _ in found if t is not None]
    cost, audit, left = cheapest(turns)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, "blank": fault.count("blank"), "duplicate": fault.count("duplicate"), "truncated": fault.count("truncated"),
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest(),
    }


def in_order(found):
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


ROW = st.tuples(st.sampled_from(["system", "user", "assistant", "user", "assistant", "tool", "", " "]), st.sampled_from(["a.", "b", "", "c! ", "d?", "e", " \n", "f."]))


@given(st.lists(ROW, max_size=9))
@settings(max_examples=400, deadline=None)
def test_decoder_finds_the_first_of_the_cheapest_scripts(turns):
    writer, fault = conv.Writer(), faults(turns)
    decoder = conv.Decoder(writer)
    for (role, text), f in zip(turns, fault, strict=True):
        if f in ("blank", "duplicate"):
            decoder.must_go()
        else:
            decoder.take(role[:1] if role[:1] in ("s", "u", "a") else "-", f == "truncated", (role, text))
    decoder.finish()
    assert (decoder.cost, *writer.take()) == cheapest(turns)


def test_survivors_coalesce_and_memory_is_bounded():
    emitted = []
    decoder, most = conv.Decoder(lambda edits, row: emitted.append(edits)), 0
    rng = random.Random(5)
    for i in range(20_000):
        role = rng.choice("uuaas") if i % 3 else "ua"[i % 2]
        if rng.random() < 0.1:
            decoder.must_go()
        else:
            decoder.take(role, rng.random() < 0.3, (ROLE.get(role, "system"), str(i)))
        most = max(most, len(decoder.rows))
    assert most < 200
    assert len("".join(emitted)) > 19_000  # most edits are out before the end


def conversations_frame(spark, found):
    kind = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType()), StructField("part", StringType()), StructField("digest", StringType())])
    return spark.createDataFrame([(*r, "clash", None) for r in found], kind)


@pytest.mark.parametrize("part_rows", [conv.PART_ROWS, 7])
def test_repair_equals_brute_force_whole_and_in_parts(spark, part_rows):
    rng, found = random.Random(2), []
    for c in [None, 1, 2, 3, -4, 5, 6]:
        for t in range(rng.choice([0, 3, 8, 60])):
            turn = rng.choice([t, t, None, 3, t + 5, -t])
            found.append((c, turn, rng.choice(["system", "user", "assistant", "assistant", "Bot", ""]), rng.choice(["x.", "y", "", "z!", " "]) + rng.choice(["", str(t), str(t) + "."])))
    found += [(7, 1, "user", "same.")] * 40 + [(8, i, "user", "same.") for i in range(40)] + [(9, 0, "user", "Long. " * 50_000)]
    got = {r.pop("conv_id"): r for r in rows(conv.repair(conversations_frame(spark, found), part_rows=part_rows))}
    by_id = {}
    for c, *row in found:
        by_id.setdefault(c, []).append(row)
    assert got == {c: expected(in_order(r)) for c, r in by_id.items()}
    messages = rows(conv.repair(conversations_frame(spark, found), messages=True, part_rows=part_rows))
    for c, r in by_id.items():
        left = [(m["role"], m["text"]) for m in sorted((m for m in messages if m["conv_id"] == c), key=lambda m: (m["part"], m["nth"]))]
        assert left == cheapest([(role, text) for _, role, text in in_order(r)])[2]


def test_damage_and_odd_conversations(spark):
    found = [(i // 4, i % 4, ["system", "user", "assistant", "user"][i % 4], f"text {i}. And?") for i in range(400)]
    found += [(None, 1, "user", "a."), (200, None, None, None), (200, None, "user", "b."), (201, 5, "assistant", None)]
    frame = conversations_frame(spark, found)
    by_id = {c: [] for c, *_ in found}
    for c, t, r, x in found:
        r, x = (" " if v is None else v for v in (r, x))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        x = "" if h == 1 else x.translate(str.maketrans("", "", ".!?")) if h == 2 else x
        by_id[c] += [(t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    got = {r.pop("conv_id"): r for r in rows(conv.repair(conv.damage(frame), frame))}
    assert got == {c: expected(in_order(r)) for c, r in by_id.items()}
    empty = frame.limit(0)
    assert conv.repair(conv.damage(empty), empty).count() == 0
    alone = rows(conv.repair(empty, frame.where("conv_id = 3")))
    assert alone == [{"conv_id": 3, **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0), "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}]


# --- runs -------------------------------------------------------------------------------------------------------


def all_runs(w):
    """Every period by itself, stretch by stretch."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e > s and e + q - s >= max(6, 4 * q):
                found.setdefault((s, e + q), q)  # the smallest period comes first
            s = max(e, s + 1) if e > s else s + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


WORDS = st.lists(st.integers(0, 2), max_size=80)


@st.composite
def periodic_words(draw):
    w = draw(WORDS)
    for _ in range(draw(st.integers(0, 3))):
        w = w + draw(st.lists(st.integers(0, 3), min_size=1, max_size=6)) * draw(st.integers(2, 9)) + draw(WORDS)[:5]
    return w


@given(st.lists(periodic_words(), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_runs_equal_brute_force(sequences):
    got = [[] for _ in sequences]
    for k, *row in zip(*(x.tolist() for x in periodic.runs([np.array(w, np.int64) for w in sequences])), strict=True):
        got[k].append(tuple(row))
    assert got == [all_runs(w) for w in sequences]


@given(periodic_words(), st.randoms(use_true_random=False))
@settings(max_examples=100, deadline=None)
def test_extensions_on_the_grammar(w, rng):
    if len(w) < 2:
        return
    walls = np.array([0, len(w) + 1])
    whole = np.r_[10, w, 11].astype(np.int64)
    pairs = [sorted(rng.sample(range(1, len(w) + 1), 2)) for _ in range(30)]
    i, j = np.array(pairs, np.int64).T
    grammar = Grammar(whole, walls)

    def common(a, b, step):
        n = 0
        while whole[a + n * step] == whole[b + n * step]:
            n += 1
        return n

    assert grammar.extend(i, j, 1).tolist() == [common(a, b, 1) for a, b in pairs]
    assert grammar.extend(i, j, -1).tolist() == [common(a, b, -1) for a, b in pairs]


def summary(doc_id, text):
    words = (text or "").encode().split()
    places = range(len(words))
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        places = [i if i < a else a + (i - a) % p for i in places]
    words = [words[i] for i in places]
    found = all_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def test_run_query_equals_brute_force(spark, sf):
    docs = shared.table(spark, sf, "documents")
    got = periodic.summarize(docs, repeat_tails=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts) and sum(r["n_runs"] for r in got) > 10
    for r in got:
        if len(texts[r["doc_id"]].split()) < 3000:
            assert tuple(r) == summary(r["doc_id"], texts[r["doc_id"]])


def test_runs_of_odd_documents(spark, odd_docs, no_docs):
    more = [(i, "b a " * 40 + "c", None, None, None) for i in range(50)] + [(60, "x " * 5, None, None, None), (61, "x " * 6, None, None, None), (62, "é　 " * 9, None, None, None)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, no_docs.schema), allowMissingColumns=True).where(F.length("text").isNull() | (F.length("text") < 10_000))
    want = sorted((summary(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert sorted(map(tuple, periodic.summarize(docs, repeat_tails=True).collect()), key=str) == want
    assert any(s[1:6] == (1, 0, 6, 1, 6000) for s in want)
    assert periodic.summarize(no_docs).count() == periodic.find_runs(no_docs).count() == 0
    assert {tuple(r) for r in periodic.find_runs(docs).where("doc_id = 3 or doc_id = 62").collect()} == {(3, 0, 80, 2), (62, 0, 9, 1)}
    assert periodic.summarize(odd_docs).count() == odd_docs.count()  # the very long text as well


# --- exact search -----------------------------------------------------------------------------------------------


def best(vectors, k, every, scale=64):
    """vectors: {id: list}."""
    whole = {i: [int(np.floor(scale * x)) for x in v] for i, v in vectors.items() if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, v in whole.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole.items() if i != q)[:k]
            out |= {(q, rank, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(scores, 1)}
    return out


VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("score", StringType())])


@pytest.mark.parametrize("block", [topk.BLOCK, 40])
@pytest.mark.parametrize("shape", ["spread", "clustered", "equal", "huge"])
def test_search_equals_brute_force(spark, block, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 24))
    if shape == "clustered":  # where the coarse levels leave little
        x = np.repeat(rng.normal(size=(10, 24)) * 5, 30, axis=0) + x * 0.05
    if shape == "equal":
        x = np.round(x[rng.integers(0, 4, 300)])
    if shape == "huge":
        x *= 1e7
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    got = topk.search(spark.createDataFrame([(i, v, "clash") for i, v in vectors.items()], VECTORS), k=7, block=block)
    assert {tuple(r) for r in got.collect()} == best(vectors, 7, 20)


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = {0: [1.0, 2.0], 1: [0.5], 2: [], 3: None, 4: [1.0, None], 5: [nan, 1.0], 6: [1.0, -inf], 7: [-0.01, 0.01, 9.0], 20: [], 40: [3.0] * 5, -20: [0.0, -0.0], 41: [1e300, 1e300]}
    found = [(i, v, None) for i, v in vectors.items()]
    again = [(0, [1.0, 2.0], None), (1, [0.6], "x"), (None, [1.0], None)]  # the least vector of an id counts
    got = topk.search(spark.createDataFrame(found + again, VECTORS), k=20, every=20)
    del vectors[41]
    kept = {tuple(r) for r in got.where("vec_id <> 41").select("query_id", "vec_id", "score").collect()}
    assert kept == {(q, i, s) for q, _, i, s in best(vectors, 20, 20)}
    assert got.where("vec_id = 41 and query_id = 40").first()["score"] == 2**63 - 1
    assert topk.search(spark.createDataFrame([], VECTORS)).count() == 0
    assert topk.search(spark.createDataFrame([(20, [1.0], None)], VECTORS)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (20, 64))
    x = np.repeat(centres, 100, axis=0) + rng.integers(-2, 3, (2000, 64))
    block = topk.Block(np.arange(2000), x)
    exact, left = x[::100] @ x.T, []
    for edges, level in zip(block.edges, block.levels, strict=True):
        upper = block.statistics(x[::100], edges) @ level.T
        assert (upper >= exact - 0.5).all()
        left.append((upper >= np.sort(exact, axis=1)[:, -20:-19]).mean())
    assert left == sorted(left, reverse=True) and left[-1] < 0.2
