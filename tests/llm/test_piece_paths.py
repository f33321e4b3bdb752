"""SentencePiece paths: equal to the library, exact round trips, unigram weights by brute force."""

import itertools

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import piece_paths as pp

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pp.PIECES)
CASES = [
    "", " ", "  a  b ", "Hello  world\n\tfoo 中\U0001f600 x ", "▁a ▁", "\x00\x01\x7f", "a" * 300, "=" * 70, "日本語テスト", "\n\n\n", "def f(x):\n        return x  # 1000000",
    "é" * 50, "https://example.org/a?b=c&d=eeee", "﻿x", "​   y",
]


def test_equals_the_library():
    t = pp.compile_model()
    for text in CASES:
        ids = LIBRARY.encode(text)
        assert t.encode(text) == ids and t.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcdeinorst ▁ \n.,-_=/\t0123éñ中ß\U0001f600\x00")), max_size=60))
def test_random_texts(text):
    t = pp.transducer()
    assert t.encode(text) == LIBRARY.encode(text)
    if "▁" not in text:
        assert t.decode(t.encode(text)) == text


def test_kept_paths_are_few(monkeypatch):
    monkeypatch.setattr(pp, "KEPT_SEGMENTS", 8)
    monkeypatch.setattr(pp, "KEPT_PAIRS", 16)
    t = pp.compile_model()
    assert t.segment.findall("▁word.▁(x12)\n²é▁▁") == ["▁word", ".", "▁(", "x", "12)", "\n", "²", "é", "▁▁"]
    for n in range(200):
        text = f"word{n}, {'abcdefgh'[n % 8] * n}tion again ({n}²)."
        assert t.encode(text) == LIBRARY.encode(text)
        assert len(t.kept) <= 8 and len(t.kept.older) <= 8 and len(t.agreed) <= 16


def test_few_arcs_are_tried():
    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    t = pp.compile_model()
    words = ["▁ontiorea", "▁reingwher", "▁dieenteungte", "▁Esciónllmi", "▁viéauxiertion", "▁international", "▁understanding", "Theaenly"]
    n = sum(len(t.shortest(w)) for w in words)
    t.agreed = Counted(t.agreed)
    assert sum(len(t.shortest(w)) for w in words) == n
    assert n <= Counted.asked <= 3 * n  # every arc of every place that is reached: 93 for 27 pieces here


def test_arcs_are_the_pieces_on_the_way():
    t = pp.compile_model()
    for text in ("▁international", "Hello", "\x00a", "é1", "日本語"):
        for at in range(len(text)):
            want = [(n, t.ids[text[at : at + n]]) for n in range(len(text) - at, 0, -1) if text[at : at + n] in t.ids]
            assert list(t.arcs(text, at)) == (want if want and want[-1][0] == 1 else [*want, (1, -1)])


def test_unigram_takes_the_cheapest_path():
    pieces = [("<unk>", 0.0, pp.UNKNOWN), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("ba", -3.2, 1), ("aab", -4.5, 1), ("▁", -1.0, 1), ("▁a", -2.2, 1)]
    t = pp.PieceTransducer(pieces, pp.Normaliser(True, True, False), bpe=False)
    weights = {p: -s for p, s, k in pieces if k == 1}

    def best(text):
        cost = [0.0] + [float("inf")] * len(text)
        for i, j in itertools.combinations(range(len(text) + 1), 2):
            cost[j] = min(cost[j], cost[i] + weights.get(text[i:j], float("inf")))
        return cost[-1]

    for n in range(1, 7):
        for letters in itertools.product("ab ", repeat=n):
            text = "".join(letters)
            ids = t.encode(text)
            assert abs(sum(weights[pieces[i][0]] for i in ids) - best(t.normaliser.apply(text))) < 1e-9 and t.decode(ids) == text


def test_documents(spark):
    rows = [(i, x, "clash") for i, x in enumerate(CASES)] + [(90, None, None), (91, "word " * 100_000, ""), (91, "word " * 100_000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = pp.decode_ids(pp.encode_documents(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.ids) == LIBRARY.encode(r.text or "") and r.n_ids == len(r.ids) and r.n_byte_ids == sum(LIBRARY.is_byte(i) for i in r.ids)
        assert r.round_trip == (r.decoded == (r.text or "")) and (r.round_trip or "▁" in r.text)
    assert pp.encode_documents(docs.limit(0)).count() == 0
    some = spark.createDataFrame([(None,), ([],), ([260, 29999],)], "ids array<int>")
    assert [r.decoded for r in pp.decode_ids(some).collect()][:2] == [None, ""]
