"""SentencePiece encoding and decoding as shortest paths through weighted transducers.

From the model file three transducers are compiled: the normaliser (dummy prefix and blanks become U+2581), the pieces (a trie
whose ends emit an id with a weight), and the byte fallback (a character outside the vocabulary becomes its UTF-8 bytes). An
input is composed with them lazily, position by position, and the cheapest path in the tropical semiring (weights add, the
minimum wins) gives the ids.

Weights. Unigram models: the negative log probability of a piece. BPE models: 0 for two neighbouring pieces that merging their
joined text gives back, infinity for others. Merging is local, so a segmentation whose neighbours all agree is the one that
merging the whole text gives; exactly one path has a finite weight. Verdicts on pairs are kept.

No piece of such vocabularies holds a blank after another character, so texts are cut before blanks that follow something
else, and between letters and other characters where no piece joins them (both checked when the model is compiled). The paths of
such segments are kept in the worker, the latest ones.

Defined cases: null and empty texts have no ids; every row is encoded on its own; NUL and other control characters fall back
to bytes; decoding replaces bytes that are not UTF-8 by U+FFFD. Other columns are passed on unless named like a new one.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pieces_of, release_memory, worker_cache

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
KEPT_SEGMENTS = 1 << 17  # twice as many with the older half
KEPT_PAIRS = 1 << 18
INFINITE = float("inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Normaliser:
    """Maps characters one by one and puts a blank in front; ``back`` is its inverse."""

    def __init__(self, dummy_prefix: bool, escape: bool, squeeze: bool):
        self.dummy_prefix, self.escape, self.squeeze = dummy_prefix, escape, squeeze

    def apply(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", BLANK) if self.escape else text

    def back(self, text: str) -> str:
        text = text.replace(BLANK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class _Segments(dict):
    """Paths of the segments seen lately, as bytes of int32. When there are too many they become the older half, which gives back what is asked for again."""

    def __init__(self, owner):
        self.owner = owner
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        got = self.older.pop(part, None)
        if got is None:
            got = array("i", self.owner.shortest(part)).tobytes()
        if len(part) <= 64:  # longer ones hardly come again
            if len(self) >= KEPT_SEGMENTS:
                self.older = dict(self)
                self.clear()
            self[part] = got
        return got


class PieceTransducer:
    """The compiled model: arcs of a trie, weights, byte ids."""

    def __init__(self, pieces: list[tuple[str, float, int]], normaliser: Normaliser, bpe: bool):
        self.pieces, self.normaliser, self.bpe = pieces, normaliser, bpe
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        if not bpe and len(self.bytes) not in (0, 256):
            raise ValueError("the byte pieces are not complete")
        self.trie: dict = {"": ((1, -1),)}  # a node leads from a character to the next node, and from the empty text to the arcs that end on the way
        for piece, i in sorted((p[0], i) for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)):
            self._add(piece, i)
        worst = min((s for _, s, k in pieces if k == NORMAL), default=0.0)
        self.unknown_weight = 10.0 - worst
        self.ids = {p[0]: i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=0)
        self.width = len(pieces) + 1
        self.agreed: dict[int, bool] = {}  # by (left + 1) * width + right
        self.grown: dict[int, list[tuple[str, str, float]]] = {}
        inside = {c for p in self.ids for c in p}
        lone = "".join(c for c in "\n\t\r" if c not in inside)  # in no piece, so paths may be cut around them
        blanks_lead = not any(BLANK in piece.lstrip(BLANK) for piece in self.ids)
        rest = f"[^{BLANK}{lone}]"
        odd = re.escape("".join(sorted(c for c in inside if c.isalnum() and not c.isalpha())))  # digits and the like are no letters
        letter, other = rf"[^\W\d_{odd}]", rf"(?:[^\w{BLANK}{lone}]|[\d_{odd}])"
        is_letter = re.compile(letter).match
        apart = not any(bool(is_letter(a)) != bool(is_letter(b)) for piece in self.ids for a, b in pairwise(piece.lstrip(BLANK)))
        run = f"{BLANK}*{letter}+|{BLANK}+(?:{other}+)?|{other}+" if apart else f"{BLANK}+{rest}*|{rest}+"  # no merge joins letters with others
        self.segment = re.compile(f"{run}|[{lone or BLANK}]") if blanks_lead else None
        self.kept = _Segments(self)
        text_of = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
        self.surface = [text_of.get(kind, str.encode)(piece) for piece, _, kind in pieces]

    def _add(self, piece: str, number: int) -> None:
        """Pieces come in order, so the arcs of a place on the way are complete."""
        node = self.trie
        for c in piece:
            before, node = node[""], node.setdefault(c, {})
            if "" not in node:
                node[""] = before
        node[""] = ((len(piece), number), *(before if len(piece) > 1 else ()))

    def growth(self, piece: int) -> list[tuple[str, str, float]]:
        """How merging builds a piece, always by the best pair, the leftmost of equals: (first symbol, last symbol, score of the next merge).

        Empty if merging never builds it.
        """
        got = self.grown.get(piece)
        if got is None:
            parts, got = list(self.pieces[piece][0]), []
            while True:
                best, where = -INFINITE, -1
                for i in range(len(parts) - 1):
                    n = self.ids.get(parts[i] + parts[i + 1])
                    if n is not None and self.pieces[n][1] > best:
                        best, where = self.pieces[n][1], i
                got.append((parts[0], parts[-1], best))
                if where < 0:
                    break
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
            self.grown[piece] = got = got if len(parts) == 1 else []
        return got

    def agree(self, left: int, right: int) -> bool:
        """Whether merging keeps two pieces apart. -1 stands for the start or a character outside the vocabulary.

        Both pieces grow side by side, the better merge first; they stay apart if no merge across their border ever is the best.
        """
        key = (left + 1) * self.width + right
        got = self.agreed.get(key)
        if got is None:
            a, b = [self.growth(p) if p >= 0 else None for p in (left, right)]
            got, i, j = a != [] and b != [], 0, 0
            while got and a and b:
                (_, last, mine), (first, _, theirs) = a[i], b[j]
                n = self.ids.get(last + first)
                if n is not None and (score := self.pieces[n][1]) > mine and score >= theirs:
                    got = False
                elif mine == theirs == -INFINITE:
                    break
                elif mine >= theirs:
                    i += 1
                else:
                    j += 1
            if len(self.agreed) >= KEPT_PAIRS:
                self.agreed.clear()
            self.agreed[key] = got
        return got

    def arcs(self, text: str, at: int) -> tuple[tuple[int, int], ...]:
        """(length, piece) of the pieces that start at a place, longest first; a character outside the vocabulary is piece -1."""
        node = self.trie
        for c in text[at : at + self.longest]:
            if c not in node:
                break
            node = node[c]
        return node[""]

    def _agreeing(self, text: str) -> list[int]:
        """Pieces of the path where arcs weigh 0 or infinity: each place has one finite arrival, so the first path found is the cheapest.

        The longest arc is tried first, a shorter one when the path stops behind it.
        """
        agreed, arcs, width, n = self.agreed, self.arcs, self.width, len(text)
        path, behind, stopped = [], [], set()
        at, left, open_ = 0, -1, iter(arcs(text, 0))
        while at < n:
            key = (left + 1) * width
            for length, piece in open_:
                if at + length not in stopped:
                    got = agreed.get(key + piece)
                    if self.agree(left, piece) if got is None else got:
                        behind.append((at, left, open_))
                        path.append(piece)
                        at, left = at + length, piece
                        open_ = iter(arcs(text, at))
                        break
            else:
                stopped.add(at)
                at, left, open_ = behind.pop()
                path.pop()
        return path

    def _weighted(self, text: str) -> list[int]:
        """Pieces of the cheapest path, from the cheapest arrivals place by place."""
        n = len(text)
        weight, back = [INFINITE] * (n + 1), [(-1, -1)] * (n + 1)
        weight[0] = 0.0
        for at in range(n):
            for length, piece in self.arcs(text, at):
                end = at + length
                step = weight[at] + (self.unknown_weight if piece < 0 else -self.pieces[piece][1])
                if step < weight[end]:
                    weight[end], back[end] = step, (at, piece)
        path, at = [], n
        while at:
            at, piece = back[at]
            path.append(piece)
        return path[::-1]

    def shortest(self, text: str) -> list[int]:
        """Ids of the cheapest path through normalised text."""
        path = self._agreeing(text) if self.bpe else self._weighted(text)
        if -1 not in path:
            return path
        out, at = [], 0
        for piece in path:
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in text[at].encode()]
            else:
                out.append(self.unknown)
            at += 1 if piece < 0 else len(self.pieces[piece][0])
        return out

    def encoded(self, text: str | None) -> np.ndarray:
        normal = self.normaliser.apply(text or "")
        if self.segment is None:
            return np.array(self.shortest(normal), np.int32)
        return np.frombuffer(b"".join(map(self.kept.__getitem__, self.segment.findall(normal))), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encoded(text).tolist()

    def decode(self, ids) -> str:
        """The inverse: pieces give their text, runs of byte pieces are joined first."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return self.normaliser.back(raw.decode("utf-8", "replace"))


def compile_model(model_file: str = PIECES) -> PieceTransducer:
    """Reads the public model format; character maps of other normalisers are not supported."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    model = format_.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap:
        raise ValueError("models with a character map are not supported")
    if model.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models have piece weights")
    normaliser = Normaliser(spec.add_dummy_prefix, spec.escape_whitespaces, spec.remove_extra_whitespaces)
    return PieceTransducer([(p.piece, p.score, p.type) for p in model.pieces], normaliser, model.trainer_spec.model_type == 2)


_compiled: dict[str, PieceTransducer] = worker_cache({})  # with the paths and verdicts that a model has gathered


def transducer(model_file: str = PIECES) -> PieceTransducer:
    """Compiled once per worker, and again after another operator's tasks emptied it."""
    if model_file not in _compiled:
        _compiled[model_file] = compile_model(model_file)
    return _compiled[model_file]


def encode_documents(docs: DataFrame, model_file: str = PIECES) -> DataFrame:
    """The documents with ids, n_ids, n_byte_ids and round_trip (decoding gives the text back)."""
    new = {"ids": "array<int>", "n_ids": "bigint", "n_byte_ids": "bigint", "round_trip": "boolean"}
    names = [c for c in docs.columns if c not in new]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory(_compiled)
        t = transducer(model_file)
        is_byte = np.array([p[2] == BYTE for p in t.pieces])
        for batch in pieces_of(batches, 1024):
            ids, counts, spelled, same = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                got = t.encoded(text)
                same.append(t.decode(got.tolist()) == (text or ""))
                ids.append(got)
                counts.append(len(got))
                spelled.append(int(is_byte[got].sum()) if len(got) else 0)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            cols = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(counts, pa.int64()), pa.array(spelled, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], names=[*names, *new])

    docs = docs.select(*names)
    return docs.mapInArrow(run, docs.withColumns({k: F.lit(None).cast(t) for k, t in new.items()}).schema)


def decode_ids(table: DataFrame, column: str = "ids", model_file: str = PIECES) -> DataFrame:
    """The table with ``decoded``; null ids give null."""
    names = [c for c in table.columns if c != "decoded"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = transducer(model_file)
        for batch in batches:
            texts = [None if v is None else t.decode(v) for v in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    table = table.select(*names)
    return table.mapInArrow(run, table.withColumn("decoded", F.lit(None).cast("string")).schema)
