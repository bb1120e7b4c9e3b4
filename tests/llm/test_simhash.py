import random

import numpy as np
import pytest
import xxhash

from pointloom.llm import simhash
from pointloom.llm.graph import connected_components
from tests.llm.cases import EDGE, edge, empty


def brute_print(text):
    words = [w.encode() for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    items = sorted(items)
    for k, a in enumerate(items):
        for b in items[k + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}


def test_fingerprints(spark):
    texts = ["", None, "One", "one  TWO", "a b c", "A b\tc\nd é É", "x y z " * 500]
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == [brute_print(t) for t in texts]
    same = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"] & (1 << 64) - 1
    assert simhash.fingerprint(b"a b c") == same


@pytest.mark.parametrize("seed", [1, 2])
def test_links_keep_the_components_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1, 2, 4, 3}
    for p in list(prints):
        for _ in range(rng.randint(0, 6)):
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << i) for i in range(64)}  # a hot group: all within 2 of each other
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    want = components(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.links(df)
    rows = found.collect()
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2 for r in rows)
    got = {p: p for p in signed} | {r["node"]: r["root"] for r in connected_components(found).collect()}
    assert got == want


def test_report_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r["doc_id"]: brute_print(r["text"]) for r in docs.collect()}
    want = components(prints, lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_report(docs).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_edges(spark):
    rows = simhash.simhash_report(edge(spark)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(EDGE)
    assert by[3]["component_id"] == by[4]["component_id"] == by[7]["component_id"] == 3 and by[3]["fingerprint"] == "0" * 16
    assert by[6]["component_id"] == 5
    kept = simhash.keep_one_of_each(edge(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == edge(spark).columns and 6 not in ids and 4 not in ids and 5 in ids and ids.count(8) == 2 and None in ids
    assert simhash.simhash_report(empty(spark)).count() == 0 and simhash.keep_one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("in_a_task", [0, 1 << 20])
def test_components_of_a_long_chain(spark, in_a_task):
    order = list(range(300))
    random.Random(3).shuffle(order)
    edges = list(zip(order, order[1:], strict=False)) + [(900, 901), (901, 900), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), task_edges=in_a_task).collect()}
    assert got == dict.fromkeys(order, 0) | {900: 900, 901: 900}
    assert np.all(list(got.values()) == np.minimum(list(got.keys()), list(got.values())))
