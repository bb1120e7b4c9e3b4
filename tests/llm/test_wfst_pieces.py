import os
import random
import struct

import pytest

from pointloom.llm import wfst_pieces as w
from tests.llm.cases import EDGE, edge, empty

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(w.MODEL_PATH), reason="no vocabulary file")

PARTS = ["a", "e", "t", "th", "  ", " ", "▁", "é", "n", "s", "\n", "1", "2", ".", "ing", "the", "🤗", "ß", "\t", "!!", "Th", "　", "ﬁ", "日本", "\0", "<s>", "\r\n"]


@pytest.fixture(scope="module")
def pair():
    return w.PieceTransducer(w.model_bytes(), memory_parts=50), sentencepiece.SentencePieceProcessor(model_file=w.MODEL_PATH)


def test_same_as_the_library(pair):
    mine, theirs = pair
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16)))
        ids = mine.encode(text)
        assert ids == theirs.encode(text), repr(text)
        assert mine.decode(ids) == theirs.decode(ids)
        assert "▁" in text or mine.decode(ids) == text


def test_real_texts(spark, pair, sf_dir):
    mine, theirs = pair
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert mine.encode(r["text"]) == theirs.encode(r["text"])


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


ODD = ["ｆｕｌｌ", "　", "ﬁ", "½", "e\u0301", "é", "か\u3099", "ｶﾞ", "①", "\u00a0", "\u200b", "\u00ad", "\t", "\r\n", "  ", " ", "ß", "İ", "Å", "ﷺ", "한", "a", "the", "🤗", "▁", "\u0000", "\ufeff", "\u2028", "x"]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("user", [[], ["<a>", "the x", "ﬁ", "aa", "a"]])
def test_compiled_normaliser_and_users_pieces_equal_the_library(tmp_path, rule, squeeze, user):
    rules = dict(w._fields(dict(w._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]))[2]
    user = [u.replace(" ", w.META) for u in user if u.replace(" ", w.META) not in w.PieceTransducer(w.model_bytes()).pieces]
    model = w.model_bytes() + field(3, field(2, rules) + field(3, 1) + field(4, squeeze)) + b"".join(field(1, field(1, u.encode()) + field(2, 0.0) + field(3, 4)) for u in user)
    (tmp_path / "m.model").write_bytes(model)
    mine, theirs = w.PieceTransducer(model), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(ODD + PARTS + (["<a>", "aa"] if user else [])) for _ in range(rng.randint(0, 12)))
        assert mine.encode(text) == theirs.encode(text), repr(text)


def test_rewriting_rules_against_plain_search():
    """Every rule of the table, found by walking it, applied longest first."""
    rules = dict(w._fields(dict(w._fields(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto()))[3]))[2]
    machine = w.Rewriter(rules)
    for text in ("", "plain", "ｆﬁ½", "e\u0301" * 3, "か\u3099x", "①" * 50):
        want, k = "", 0
        while k < len(text):
            best = 0
            for n in range(1, 9):
                raw = text[k : k + n].encode()
                length, entry, _ = machine._walk(raw, 0)
                if length == len(raw):
                    best, new = n, machine._entry(entry)
            want += new if best else text[k]
            k += max(best, 1)
        assert machine(text) == want


def test_unigram_shortest_path_matches_brute_force():
    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.9, "ba": -6.6, "aba": -7.0, "▁ab": -7.0}
    pieces = [("<unk>", 0.0, 2), *((p, s, 1) for p, s in scores.items())]
    model = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    model += field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 0))
    machine = w.PieceTransducer(model)

    def best(s):
        if not s:
            return 0.0, []
        options = [(scores[p] + best(s[len(p) :])[0], [p, *best(s[len(p) :])[1]]) for p in scores if s.startswith(p)]
        return max(options, key=lambda o: o[0])

    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))
        got = [machine.pieces[i] for i in machine.encode(text)]
        assert abs(sum(scores[p] for p in got) - best("▁" + text.replace(" ", "▁"))[0]) < 1e-5 and "".join(got) == "▁" + text.replace(" ", "▁")
    assert [machine.pieces[i] for i in machine.encode("axxb")] == ["▁a", "<unk>", "b"]


def test_edges(spark):
    model = w.model_bytes()
    out = w.encode_texts(edge(spark), model)
    rows = out.collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(EDGE) and all(r["decodes"] for r in rows)
    assert by[3]["piece_ids"] == [] and by[4]["n_pieces"] == 0 and by[5]["n_pieces"] == len(by[5]["piece_ids"])
    back = {r["doc_id"]: r["text"] for r in w.decode_ids(out, model).collect()}
    assert back == {r[0]: r[1] or "" for r in EDGE}
    assert w.encode_texts(empty(spark), model).count() == 0
    long_word = "x" * 200000
    machine = w.transducer(model)
    assert machine.decode(machine.encode(long_word)) == long_word
