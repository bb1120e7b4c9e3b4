import random
import re

import numpy as np
import pyarrow as pa
import xxhash

import corpus_pipeline
from pointloom.llm import simhash, similar_sets
from tests.llm.cases import edge, empty
from tests.llm.test_simhash import components


def brute_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def made(seed):
    """Texts with copies at all similarities, chains, a large group, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = ["", None, "a b", "A  b", "a b c d e"]
    passage = [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(6, 150))] + (passage if rng.random() < 0.5 else [])
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
    hub = [word() for _ in range(100)]
    for i in range(40):
        copy = list(hub)
        copy[i] = "other"
        texts.append(" ".join(copy))
    return texts


def test_groups_of_all_pairs(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (docs, list(enumerate(made(1)))):
        sets = {i: brute_set(t) for i, t in rows}
        want = components(sets, lambda a, b: similar(sets[a], sets[b]))
        got = {r["doc_id"]: r["component_id"] for r in similar_sets.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want
        assert len(set(want.values())) < len(set(sets.values()))


def test_stage_drops_a_near_copy(spark, sf_dir):
    """Four words of 200 changed: similarity 0.81, fingerprints 4 bits apart."""
    words = [f"word{i}" for i in range(200)]
    near, far = ["changed" if i in (5, 50, 95, 140) else w for i, w in enumerate(words)], [*words[:150], *(f"new{i}" for i in range(50))]
    rows = [(i, " ".join(w), "en", "src0", 1) for i, w in enumerate((words, near, far))]
    docs = spark.createDataFrame(rows, edge(spark, extra=False).schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == [0, 2]


def test_edges(spark):
    by = {}
    for r in similar_sets.near_duplicates(edge(spark)).collect():
        by.setdefault(r["doc_id"], []).append(r["component_id"])
    assert by[3] == by[4] == by[7] == [3] and by[6] == [5] and by[8] == [8, 8] and by[None] == [None]
    assert similar_sets.near_duplicates(empty(spark)).count() == 0


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(1)
    for n in (1, 5, 50, 400):
        a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        b = np.concatenate([a[: n // 2], np.unique(rng.integers(-(1 << 63), 1 << 63, n // 3 + 1))])
        x, y = similar_sets.parities(a), similar_sets.parities(b)
        assert sum(bin(int(p) & (1 << 64) - 1).count("1") for p in x ^ y) <= len(np.setxor1d(a, b))
    assert similar_sets.parities(np.zeros(0, np.int64)).tolist() == [0, 0, 0, 0]


def test_cell_counts_never_differ_more_than_the_sets():
    """Also where a cell holds more than 256; and unlike long sets, whose parities say nothing, are told apart."""
    rng = np.random.default_rng(3)
    for n in (1, 50, 2000, 100_000):
        a, other = (np.unique(rng.integers(-(1 << 63), 1 << 63, n)) for _ in range(2))
        b = np.unique(np.concatenate([a[: n // 2], other[: n // 3 + 1]]))
        apart = similar_sets.counts_apart(*(np.stack([similar_sets.cell_counts(s)] * 2) for s in (a, b)))
        assert apart[0] == apart[1] <= len(np.setxor1d(a, b))
    a, b = (np.unique(rng.integers(-(1 << 63), 1 << 63, 5000)) for _ in range(2))
    assert 9 * similar_sets.counts_apart(similar_sets.cell_counts(a)[None], similar_sets.cell_counts(b)[None])[0] > len(a) + len(b)
    assert similar_sets.counts_apart(np.zeros((0, 256), np.uint8), np.zeros((0, 256), np.uint8)).tolist() == []


def test_whole_sets_are_sent_for_close_pairs_only(spark, monkeypatch):
    """Long texts that share a passage by two meet, but only a near copy's pair has its sets built again and sent."""
    rng = random.Random(4)
    texts = [[*(f"p{i // 2}_{j}" for j in range(600)), *(f"w{rng.randrange(10**6)}" for _ in range(2000))] for i in range(12)]
    texts.append([*texts[0][:-50], *(f"new{i}" for i in range(50))])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sent, verified = [], similar_sets._verified
    monkeypatch.setattr(similar_sets, "_verified", lambda docs, distinct, pairs: sent.append(pairs.count()) or verified(docs, distinct, pairs))
    got = {r["doc_id"]: r["component_id"] for r in similar_sets.near_duplicates(docs).collect()}
    assert got == {i: i for i in range(12)} | {12: 0}
    assert sum(sent) == 1


def close_copies(seed):
    """Long texts and copies with a word or two changed, whose fingerprints are up to a few bits apart; one copy with a line twice."""
    rng = random.Random(seed)
    texts = []
    for _ in range(10):
        base = [f"w{rng.randrange(10**6)}" for _ in range(800)]
        texts += [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in rng.sample(range(800), 2)]
    return [*texts, texts[0] + " " + " ".join(texts[0].split()[-400:])]


def set_print(s):
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_stage_links_by_fingerprints_on_the_grid(spark, sf_dir, monkeypatch):
    """With the way for pairs beyond the grid shut, similar sets within 2 bits are still found, and no others."""
    rows = list(enumerate(close_copies(5) + made(2)[:60]))
    sets = {i: brute_set(t) for i, t in rows}
    prints = {i: set_print(s) for i, s in sets.items()}
    near = lambda a, b: similar(sets[a], sets[b]) and bin(prints[a] ^ prints[b]).count("1") <= 2
    want = components(sets, near)
    assert sum(i != r for i, r in want.items()) > 3 and want != components(sets, lambda a, b: similar(sets[a], sets[b]))
    for name in ("_star", "_rest"):
        monkeypatch.setattr(similar_sets, name, lambda company, *known: spark.createDataFrame([], "a long, b long"))
    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], edge(spark, extra=False).schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == sorted(set(want.values()))


def test_links_of_the_grid_are_checked(spark, monkeypatch):
    """Fingerprints that meet without similar sets make no link, and hide none."""
    rows = list(enumerate(close_copies(6) + made(3)[:60]))
    sets = {i: brute_set(t) for i, t in rows}

    def all_to_the_smallest(prints):
        lo = prints.groupBy().min("fp").first()[0]
        return prints.where(f"fp <> {lo}").selectExpr(f"{lo}L AS a", "fp AS b")

    monkeypatch.setattr(simhash, "links", all_to_the_smallest)
    got = {r["doc_id"]: r["component_id"] for r in similar_sets.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(sets, lambda a, b: similar(sets[a], sets[b]))


def test_company_in_any_batches():
    """Against counting: visits that share their shingle with another key, or are salted, each once."""
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 7, 1000):
        shingle, key = rng.integers(0, 60, 200), rng.integers(0, 40, 200)
        order = np.lexsort((key, shingle))
        shingle, key = shingle[order], key[order]
        salt = np.where(shingle % 7 == 0, key % 64, -1).astype(np.int32)
        keys = {s: {k for t, k in zip(shingle.tolist(), key.tolist(), strict=True) if t == s} for s in shingle.tolist()}
        want = sorted((s, k) for s, own in keys.items() for k in own if len(own) > 1 or s % 7 == 0)
        columns = {"shingle": shingle, "salt": salt, "key": key, "at": key + 1000}
        batches = [pa.RecordBatch.from_pydict({c: v[i : i + size] for c, v in columns.items()}) for i in range(0, 200, size)]
        got = [(r["shingle"], r["key"]) for b in similar_sets._company(iter(batches)) for r in b.to_pylist() if r["at"] == r["key"] + 1000]
        assert sorted(got) == want
    assert list(similar_sets._company(iter([]))) == []
