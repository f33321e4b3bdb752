"""Tokeniser fertility: how public vocabularies cut a text, with bands per vocabulary and script.

Two vocabularies are asked: pieces with byte fallback (a word gets the usual leading blank) and byte-level merges, where a token
that is no whole character counts as a fallback. A worker numbers the words it meets and tokenises each new one once; all else
is sums over the numbers of a piece of a batch. Per text and vocabulary: characters per token, share of fallback tokens, and token
entropy in bits, which grows with the number of tokens. The script that most letters of the text belong to picks the bands; a text
outside one band of either vocabulary is rejected. Bands are a table, not fitted to the corpus: a source full of copies cannot move
them.

The same pass counts words, characters of words, marked signs, repeated lines and words in repeated three-word windows.
Defined cases: null and empty texts have no words, count 0 everywhere and fail the base rule; a text without letters takes the
bands of OTHER; scripts with equally many letters go by name; every row is judged on its own, so repeated rows get equal results; a
very long text is a piece of its own and is judged whole; other columns are passed on unless named like a new one. The files of the
vocabularies must lie under the same path on every executor.
"""

from __future__ import annotations

import os
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
CACHED_WORDS = 1 << 18
PIECE_BYTES = 4 << 20
BLOCK_WORDS = 1 << 18
ASCII_LETTERS = string.ascii_letters.encode()


@dataclass(frozen=True)
class Band:
    """Accepted: characters per token between two limits, byte-fallback share up to a limit, entropy from a floor.

    ``entropy`` gives the floor in bits at so many tokens (as log2); between them it is interpolated.
    """

    chars: tuple[float, float]
    most_bytes: float
    entropy: tuple[tuple[float, float], ...]

    def accepts(self, chars_per_token: float, byte_share: float, entropy: float, tokens: int) -> bool:
        floor = np.interp(np.log2(max(1, tokens)), *zip(*self.entropy, strict=True))
        return bool(self.chars[0] <= chars_per_token <= self.chars[1] and byte_share <= self.most_bytes and entropy >= floor)


PROSE = ((6, 5.05), (8, 5.77), (10, 6.22), (12, 6.4))
SPELLED = ((6, 4.2), (8, 4.7), (10, 5.0), (12, 5.1))  # scripts that are mostly cut into single letters or bytes
# Alphabets that the vocabulary covers with long pieces are cut more coarsely than scripts it mostly spells out.
BANDS = {
    "LATIN": Band((1.55, 7.0), 0.05, PROSE),
    "CYRILLIC": Band((1.3, 6.0), 0.05, PROSE),
    "GREEK": Band((0.8, 4.0), 0.1, SPELLED),
    "HAN": Band((0.25, 3.0), 0.9, SPELLED),
    "KANA": Band((0.4, 3.0), 0.7, SPELLED),
    "HANGUL": Band((0.25, 3.0), 0.95, SPELLED),
    "ARABIC": Band((0.6, 4.0), 0.3, SPELLED),
    "HEBREW": Band((0.6, 4.0), 0.3, SPELLED),
    "DEVANAGARI": Band((0.4, 3.0), 0.5, SPELLED),
    "OTHER": Band((0.15, 7.0), 1.0, SPELLED),
}
# Byte-level merges know few whole characters beyond Latin ones, so other scripts are bounded by entropy alone.
BYTE_LEVEL_BANDS = {name: Band((0.15, 7.5), 1.0, tuple((n, bits - 1) for n, bits in SPELLED)) for name in BANDS} | {
    "LATIN": Band((1.3, 7.5), 0.35, tuple((n, bits - 0.3) for n, bits in PROSE)),  # accented letters may be two tokens each
}
SCRIPTS = sorted(BANDS)
NAMES = {"CJK": "HAN", "HIRAGANA": "KANA", "KATAKANA": "KANA"}


def script(char: str) -> str | None:
    """Script of a letter by the first part of its Unicode name."""
    if not char.isalpha():
        return None
    first = unicodedata.name(char, "OTHER").split(" ")[0].split("-")[0]
    name = NAMES.get(first, first)
    return name if name in BANDS else "OTHER"


class Rows:
    """An array that grows at its end."""

    def __init__(self, width: int, kind: type):
        self.data, self.size = np.zeros((1024, width), kind), 0

    def add(self, rows: np.ndarray) -> None:
        end = self.size + len(rows)
        if end > len(self.data):
            more = np.zeros((max(end, 2 * len(self.data)) - self.size, self.data.shape[1]), self.data.dtype)
            self.data = np.concatenate((self.data[: self.size], more))
        self.data[self.size : end] = rows
        self.size = end


class Pieces:
    """A vocabulary of pieces; ``fallback`` marks the ids of single bytes."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it shows in Latin-1, else the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A vocabulary of byte-level merges; ``fallback`` marks the ids that are no whole characters."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.model.encode_special_tokens = True
        signs = byte_signs()

        def partial(i: int) -> bool:
            token = self.model.id_to_token(i) or ""
            try:
                bytes(signs.get(c, 32) for c in token).decode()
            except UnicodeDecodeError:
                return True
            return False

        self.fallback = np.array([partial(i) for i in range(self.model.get_vocab_size())])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Numbers(dict):
    """word -> number in order of arrival; ``new`` holds the words that came last."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordCosts:
    """Numbers of words with what each costs: code points, marked signs, letters by script, and its ids under every vocabulary."""

    def __init__(self, *files: str):
        self.vocabularies = [ByteLevel(f) if f.endswith(".json") else Pieces(f) for f in files]
        self.scripts: dict[str, str | None] = {}
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.facts = Rows(2 + len(SCRIPTS) + 2 * len(self.vocabularies), np.int32)  # then tokens and fallbacks by vocabulary
        self.ids = [Rows(1, np.int32) for _ in self.vocabularies]
        self.starts = [Rows(1, np.int64) for _ in self.vocabularies]

    def script_of(self, char: str) -> str | None:
        if char not in self.scripts:
            self.scripts[char] = script(char)
        return self.scripts[char]

    def number(self, found: Iterator[bytes], n: int) -> np.ndarray:
        """The numbers of ``n`` words; new ones are tokenised together. Earlier numbers may lose their meaning."""
        if len(self.numbers) > CACHED_WORDS:
            self.clear()
        out = np.fromiter(map(self.numbers.__getitem__, found), np.int64, n)
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new = []
        return out

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode(errors="replace") for w in new]
        facts = np.zeros((len(new), self.facts.data.shape[1]), np.int32)
        latin = 2 + SCRIPTS.index("LATIN")
        for row, word, text in zip(facts, new, texts, strict=True):
            row[0], row[1] = len(text), len(word) - len(word.translate(None, SYMBOLS))
            if text.isascii():
                row[latin] = len(word) - len(word.translate(None, ASCII_LETTERS))
                continue
            for name, n in Counter(map(self.script_of, text)).items():
                if name:
                    row[2 + SCRIPTS.index(name)] = n
        for v, vocabulary in enumerate(self.vocabularies):
            ids = vocabulary.encode(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            at = 2 + len(SCRIPTS) + 2 * v
            facts[:, at], facts[:, at + 1] = sizes, np.diff(np.concatenate(([0], np.cumsum(vocabulary.fallback[flat])))[ends])
            self.starts[v].add(self.ids[v].size + ends[:-1, None])
            self.ids[v].add(flat[:, None])
        self.facts.add(facts)


def repeated_words(index: np.ndarray) -> int:
    """Words inside three-word windows that the text holds at least twice; words come as numbers."""
    if len(index) < 4:
        return 0
    if index.max() >= 1 << 21:
        index = np.unique(index, return_inverse=True)[1]
    first, last = index[:-2] << 21 | index[1:-1], index[2:]
    if index.max() >= 1 << 21:  # more than two million different words: pairs are numbered first
        first = np.unique(first, return_inverse=True)[1]
    windows = first << 21 | last
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    twice = again[np.minimum(np.searchsorted(again, windows), len(again) - 1)] == windows
    inside = np.zeros(len(index), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def repeated_lines(text: bytes | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = (text or b"").split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def entropies(index: np.ndarray, owner: np.ndarray, tokens: np.ndarray, costs: WordCosts, v: int) -> np.ndarray:
    """Token entropy in bits of every text; ``tokens`` counts them."""
    sizes = costs.facts.data[index, 2 + len(SCRIPTS) + 2 * v].astype(np.int64)
    place = np.repeat(costs.starts[v].data[index, 0] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    keys = np.sort(np.repeat(owner, sizes) << 20 | costs.ids[v].data[place, 0])
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    text = keys[first] >> 20
    p = np.diff(first, append=len(keys)) / tokens[text]
    return np.bincount(text, -p * np.log2(p), len(tokens)) + 0.0


def measure_texts(texts: list[bytes | None], costs: WordCosts, bands: tuple[dict[str, Band], ...]) -> dict[str, list]:
    """The measures of texts in UTF-8, with one table of bands for each vocabulary of ``costs``."""
    found = [t.split() if t else [] for t in texts]  # bytes.split() cuts at exactly the six separators
    n_words = np.fromiter(map(len, found), np.int64, len(found))
    index = costs.number(chain.from_iterable(found), int(n_words.sum()))
    ends = np.concatenate(([0], np.cumsum(n_words)))
    owner = np.repeat(np.arange(len(texts)), n_words)
    total = np.zeros((len(texts), costs.facts.data.shape[1]), np.int64)
    for at in range(0, len(index), BLOCK_WORDS):
        part = owner[at : at + BLOCK_WORDS]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        total[part[first]] += np.add.reduceat(costs.facts.data[index[at : at + BLOCK_WORDS]], first, axis=0, dtype=np.int64)
    letters = total[:, 2 : 2 + len(SCRIPTS)]
    scripts = [SCRIPTS[k] if some else "OTHER" for k, some in zip(letters.argmax(axis=1).tolist(), letters.any(axis=1).tolist(), strict=True)]
    out = {
        "n_words": n_words.tolist(), "word_chars": total[:, 0].tolist(), "n_symbols": total[:, 1].tolist(), "n_dup_lines": [repeated_lines(t) for t in texts],
        "n_repeat_words": [repeated_words(index[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], "script": scripts, "in_band": [True] * len(texts),
    }
    for v, (names, table) in enumerate(zip(BY_VOCABULARY, bands, strict=False)):
        tokens, fallbacks = total[:, 2 + len(SCRIPTS) + 2 * v], total[:, 3 + len(SCRIPTS) + 2 * v]
        per_token, share = total[:, 0] / np.maximum(1, tokens), fallbacks / np.maximum(1, tokens)
        entropy = entropies(index, owner, tokens, costs, v)
        values = [x.tolist() for x in (tokens, per_token, share, entropy)]
        out |= dict(zip(names, values, strict=True))
        accepted = [table[s].accepts(c, f, e, n) for s, n, c, f, e in zip(scripts, *values, strict=True)]
        out["in_band"] = [a and b for a, b in zip(out["in_band"], accepted, strict=True)]
    return out


def measure(text: str | None, costs: WordCosts, bands: dict[str, Band] = BANDS) -> dict:
    """The measures of one text under the first vocabulary."""
    return {k: v[0] for k, v in measure_texts([text.encode() if text else None], costs, (bands,)).items()}


def texts_of(column) -> Iterator[list[bytes | None]]:
    """The texts of an Arrow column in UTF-8, in lists of about PIECE_BYTES."""
    import pyarrow as pa

    piece, size = [], 0
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        text = value.as_py()
        piece.append(text)
        size += len(text or b"")
        if size >= PIECE_BYTES:
            yield piece
            piece, size = [], 0
    yield piece


BY_VOCABULARY = (
    ("n_tokens", "chars_per_token", "byte_share", "token_entropy"),
    ("byte_level_tokens", "byte_level_chars_per_token", "byte_level_partial_share", "byte_level_entropy"),
)
MEASURES = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "script": "string", "n_tokens": "bigint", "chars_per_token": "double", "byte_share": "double", "token_entropy": "double", "in_band": "boolean",
    "byte_level_tokens": "bigint", "byte_level_chars_per_token": "double", "byte_level_partial_share": "double", "byte_level_entropy": "double",
}
_costs: dict[tuple[str, str], WordCosts] = {}


def judge(docs: DataFrame, model_file: str = PIECES, bands: dict[str, Band] | None = None, least_words: int = LEAST_WORDS,
          most_repeated: int = MOST_REPEATED, byte_level_file: str = BYTE_LEVEL, byte_level_bands: dict[str, Band] | None = None) -> DataFrame:
    """The documents with their measures, base_failed, in_band and kept."""
    tables = bands or BANDS, byte_level_bands or BYTE_LEVEL_BANDS
    names = [c for c in docs.columns if c not in {*MEASURES, "base_failed", "kept"}]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        files = model_file, byte_level_file
        if files not in _costs:
            _costs[files] = WordCosts(*files)
        types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        for batch in batches:
            found = [measure_texts(piece, _costs[files], tables) for piece in texts_of(batch.column("text"))]
            new = [pa.array(list(chain.from_iterable(f[k] for f in found)), types[t]) for k, t in MEASURES.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], names=[*names, *MEASURES])

    docs = docs.select(*names)
    out = docs.mapInArrow(run, docs.withColumns({k: F.lit(None).cast(t) for k, t in MEASURES.items()}).schema)
    out = out.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("in_band"))
