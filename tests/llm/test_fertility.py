"""Tokeniser fertility: counts by brute force, agreement with the library, bands."""

import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from plumbline.llm import fertility as fe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in "".join(w)), len(lines) - len(set(lines)), len(inside)


TEXTS = [
    None, "", " \n\t\x0b", "a", "a b c a b c", "a b a b a b a", "x\ny\nx\n\n\nx ", "é # ** <|> \x85     b", "\U0001f600 中文 " * 30,
    "one two three four five " * 12, "the cat sat " * 40, "\n".join(f"line {i} of many words here" for i in range(30)), "w" * 300_000,
]


def test_base_counts(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "clash", 1)]
    out = fe.judge(spark.createDataFrame(rows, "doc_id bigint, text string, kept string, other int")).collect()
    assert len(out) == len(rows)
    for r in out:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base(TEXTS[r.doc_id])
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and r.kept == (not r.base_failed and r.in_band) and r.other == 1


def test_measures_agree_with_the_library():
    costs, model = fe.WordCosts(fe.PIECES), sentencepiece.SentencePieceProcessor(model_file=fe.PIECES)
    text = "Ein kleines Haus steht am Fluß, 中 \U0001f600 und noch ein Haus."
    ids = [i for w in text.split() for i in model.encode(w)]
    p = np.array(list(Counter(ids).values())) / len(ids)
    got = fe.measure(text, costs)
    assert got["n_tokens"] == len(ids) and got["script"] == "LATIN"
    assert got["byte_share"] == pytest.approx(sum(model.is_byte(i) for i in ids) / len(ids))
    assert got["token_entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert got["chars_per_token"] == pytest.approx(sum(map(len, text.split())) / len(ids))


def test_bands():
    costs = fe.WordCosts(fe.PIECES)
    prose = ("The committee met on a rainy Tuesday to discuss how the new bridge should be paid for, who would maintain it and what would happen to the old "
             "ferry. Several members argued that tolls were unfair to people living on the eastern bank, while others feared that raising taxes would drive "
             "small companies away. After four hours they agreed to ask an engineer from another city for an independent estimate before the next session.")
    assert fe.measure(prose, costs)["in_band"]
    assert not fe.measure(" ".join("qzx" * 9 for _ in range(60)), costs)["in_band"]
    assert not fe.measure(" ".join(w + "%%%" for w in prose.split()), costs, fe.BANDS | {"LATIN": fe.Band((2.0, 7.0), 0.05, ((6, 6.5),))})["in_band"]
    assert [fe.script(c) for c in "aяαא中あ한1"] == ["LATIN", "CYRILLIC", "GREEK", "HEBREW", "HAN", "KANA", "HANGUL", None]


def test_junk_is_rejected_and_prose_kept(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = fe.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = ([r.kept for r in out if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.3


def test_empty_table(spark):
    assert fe.judge(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_byte_level_vocabulary_and_pieces_of_a_batch(monkeypatch):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(fe.BYTE_LEVEL)
    texts = [(t or "").encode() if t is not None else None for t in TEXTS] + ["Fluß 中文 \U0001f600 of a long day".encode()]
    costs = fe.WordCosts(fe.PIECES, fe.BYTE_LEVEL)
    whole = fe.measure_texts(texts, costs, (fe.BANDS, fe.BYTE_LEVEL_BANDS))
    for i, t in enumerate(texts):
        ids = [x for w in (t or b"").split() for x in model.encode(" " + w.decode(), add_special_tokens=False).ids]
        p = np.array(list(Counter(ids).values())) / max(1, len(ids))
        assert whole["byte_level_tokens"][i] == len(ids) and whole["byte_level_entropy"][i] == pytest.approx(-(p * np.log2(p)).sum())
        partial = sum("\ufffd" in model.decode([x]) for x in ids)
        assert whole["byte_level_partial_share"][i] == pytest.approx(partial / max(1, len(ids)))
    monkeypatch.setattr(fe, "BLOCK_WORDS", 7)
    monkeypatch.setattr(fe, "CACHED_WORDS", 3)  # numbers start again with every text
    one_by_one = [fe.measure_texts([t], costs, (fe.BANDS, fe.BYTE_LEVEL_BANDS)) for t in texts]
    assert {k: [x[k][0] for x in one_by_one] for k in whole} == {k: pytest.approx(v) if isinstance(v[0], float) else v for k, v in whole.items()}
