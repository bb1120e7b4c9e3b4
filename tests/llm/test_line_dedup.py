import hashlib

import numpy as np
import pytest

from pointloom.llm import line_dedup
from tests.llm.cases import EDGE, edge, empty

NULL = (1 << 63) - 1


def brute(rows):
    key = lambda s: s.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(NULL if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = NULL if i is None else i
        stay = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"shard_keys": 3, "salts": 2}, {"salts": 1}])
def test_report_matches_brute_force(spark, sf_dir, how):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(x[2] for x in want) > 0
    assert sorted((tuple(r) for r in line_dedup.line_dedup_report(docs, **how).collect()), key=str) == want


def test_edges(spark):
    want = brute([(r[0], r[1]) for r in EDGE])
    got = line_dedup.line_dedup_report(edge(spark))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    out = line_dedup.dedup_lines(edge(spark))
    assert out.columns == edge(spark).columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[2] == "something else entirely\n\n" and texts[3] is None and texts[6] == "" and texts[None] == ""
    assert line_dedup.line_dedup_report(empty(spark)).count() == 0


def test_key_has_ten_code_points(spark):
    rows = [(1, "éééééééééé"), (2, " ÉÉÉÉÉÉÉÉÉÉ \néééééééééé"), (3, "ééééééééé"), (4, "ééééééééé")]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    table = line_dedup.PerfectHash.unpack(*line_dedup.PerfectHash.build(keys).pack())
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys))) and table.size == len(keys)
