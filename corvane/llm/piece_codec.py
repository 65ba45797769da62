"""Merge-type (BPE) SentencePiece encoding by backtracking over dictionary matches, and decoding.

A sequence of pieces is what merging gives exactly when every adjacent pair is
what merging gives for the pair's own text. So instead of merging a whole word,
the encoder takes the longest match at each place, checks it against the piece
before it, and backs off to shorter matches; places from which no valid rest
was found are marked in a bit field and never tried again.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa

MARK = "▁"  # stands for a space in pieces; here pieces are kept with spaces, so that most words are one byte a character
UNKNOWN, CONTROL, BYTE, NORMAL = 2, 3, 6, 1  # piece types of the model file
CACHE_WORDS = 200_000  # of each of two generations; with the pairs some 100 MB in each encoding worker
CACHE_WORD_CHARS = 64
CACHE_PAIRS = 250_000  # over all lengths of the left one
SLICE = 1 << 16  # characters of a text whose words are held at a time, where spaces allow
SHORT = 64  # symbols up to which merging scans all pairs rather than keeping a heap
NEVER = float("-inf")
SHARED = 1 << 40  # puts a match far before the word's start


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs from a model file; small and bounded by the vocabulary, so it can be broadcast."""

    key: str
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    usable: tuple[int, ...]
    dummy_prefix: bool
    unk_surface: str


def load_model(path: str) -> PieceModel:
    """Reads a model file. Only BPE models with byte fallback, no normalisation and no user symbols are taken."""
    import hashlib

    from sentencepiece import sentencepiece_model_pb2 as pb

    raw = open(path, "rb").read()
    m = pb.ModelProto()
    m.ParseFromString(raw)
    kinds = tuple(p.type for p in m.pieces)
    spec, trained = m.normalizer_spec, m.trainer_spec
    if trained.model_type != pb.TrainerSpec.BPE or not trained.byte_fallback or set(kinds) - {UNKNOWN, CONTROL, BYTE, NORMAL}:
        raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces are supported")
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError("only models without text normalisation are supported")
    pieces, scores = tuple(p.piece.replace(MARK, " ") if p.type == NORMAL else p.piece for p in m.pieces), tuple(p.score for p in m.pieces)
    rank = {p: s for p, s, k in zip(pieces, scores, kinds) if k == NORMAL}
    usable = tuple(i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL and merged(p, rank) == [p])
    return PieceModel(hashlib.sha256(raw).hexdigest(), pieces, scores, kinds, usable, spec.add_dummy_prefix, trained.unk_surface)


def merged(text: str, rank: dict[str, float]) -> list[str]:
    """The symbols left when the best-scored adjacent pair (the leftmost of equals) is joined until none can be."""
    symbols = list(text)
    n = len(symbols)
    if n <= SHORT:
        best = [rank.get(a + b, NEVER) for a, b in zip(symbols, text[1:])]
        while best and (top := max(best)) != NEVER:
            i = best.index(top)
            symbols[i] += symbols.pop(i + 1)
            del best[i]
            if i:
                best[i - 1] = rank.get(symbols[i - 1] + symbols[i], NEVER)
            if i < len(best):
                best[i] = rank.get(symbols[i] + symbols[i + 1], NEVER)
        return symbols
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (s := rank.get(x := symbols[a] + symbols[b])) is not None:
            heapq.heappush(heap, (-s, a, b, x))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, a, b, x = heapq.heappop(heap)
        if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != x:
            continue
        symbols[a], symbols[b] = x, ""
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [s for s in symbols if s]


class PieceDecoder:
    """Decoder of one model: surfaces only, no matcher."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.surface = [self._surface(i) for i in range(len(model.pieces))]
        self.surface_array = pa.array(self.surface, pa.binary())
        self.control_mask = np.array([k == CONTROL for k in model.kinds])
        self.controls = {i for i, k in enumerate(model.kinds) if k == CONTROL}
        self.opens = [k == NORMAL and p.startswith(" ") for p, k in zip(model.pieces, model.kinds)]

    def _surface(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (self.model.unk_surface if kind == UNKNOWN else piece).encode()

    def decode(self, ids: list[int]) -> str:
        """Text of any ids of the vocabulary: control ids say nothing, bytes that aren't UTF-8 become U+FFFD each."""
        runs = [ids]
        if not self.controls.isdisjoint(ids):  # bytes on two sides of a control id are read apart
            runs = [[]]
            for i in ids:
                runs.append([]) if i in self.controls else runs[-1].append(i)
        text = ""
        for run in runs:
            raw = b"".join(map(self.surface.__getitem__, run))
            try:
                text += raw.decode()
            except UnicodeDecodeError:
                text += _lenient(raw)
        if self.model.dummy_prefix:
            first = next((i for i in ids if self.model.kinds[i] != CONTROL), None)
            if first is not None and self.opens[first]:
                return text[1:]
        return text


class PieceCodec:
    """Encoder of one model."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.rank = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == NORMAL}
        self.id_of = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        seen: set[float] = set()
        twice = {s for s in self.rank.values() if s in seen or seen.add(s)}
        self.matcher = ahocorasick.Automaton()
        self.known = {model.pieces[i] for i in model.usable}
        for i in model.usable:
            p = model.pieces[i]
            # Scores that pieces share break the rule of adjacent pairs: words with such a piece are merged directly.
            self.matcher.add_word(p, len(p) + (SHARED if len(p) > 1 and self.rank[p] in twice else 0))
        self.matcher.make_automaton()
        #: No piece reaches over the start of a run of spaces, so texts fall apart there.
        self.apart = not any(" " in p.lstrip(" ") for p in self.id_of)
        self.chunks = re.compile(" +[^ ]*|[^ ]+" if self.apart else "(?s).+")
        self.run_of_spaces = re.compile("(?<! ) ")
        #: By the left piece's length: whether a text falls apart there.
        self.pairs: list[dict[str, bool]] = [{} for _ in range(max(map(len, self.id_of), default=0) + 2)]
        self.n_pairs = 0
        self.cache = _Words(self, {})

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' text gives the two pieces again."""
        if self.n_pairs >= CACHE_PAIRS:
            for known in self.pairs:
                known.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        ok = self.pairs[len(left)][left + right] = merged(left + right, self.rank) == [left, right]
        return ok

    def split(self, word: str) -> list[str]:
        """The pieces of one word, by backtracking."""
        n = len(word)
        # Matches come by ascending end, so the last of each start is its longest.
        longest = {end - size: end for end, size in self.matcher.iter(word)}
        if longest and min(longest) < -1:
            return merged(word, self.rank)
        known, pairs = self.known, self.pairs
        failed = 0  # bit p: no valid rest starts at p
        starts = [0]  # of the pieces taken and of the one looked for
        pos, before = 0, -1
        end = longest.get(-1, 0) + 1
        while True:
            if not failed or not failed >> end & 1:
                ok = True if before < 0 else pairs[pos - before].get(word[before:end])
                if ok is None:
                    ok = self.fits(word[before:pos], word[pos:end])
                if ok:
                    starts.append(end)
                    if end == n:
                        return [word[a:b] for a, b in zip(starts, starts[1:])]
                    before, pos = pos, end
                    end = longest.get(pos - 1, pos) + 1
                    continue
            # The next shorter match; a character outside the vocabulary stands alone.
            end -= 1
            while end > pos + 1 and word[pos:end] not in known:
                end -= 1
            if end == pos:
                if before < 0:
                    return merged(word, self.rank)
                failed |= 1 << pos
                end = starts.pop()
                pos = before
                before = starts[-2] if len(starts) > 1 else -1

    def word_ids(self, word: str) -> bytes:
        pieces = self.split(word)
        try:
            return array("i", map(self.id_of.__getitem__, pieces)).tobytes()
        except KeyError:
            return array("i", [i for p in pieces for i in ([self.id_of[p]] if p in self.id_of else map(self.byte_id.__getitem__, p.encode()))]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers of the machine's byte order; an empty text has none."""
        if not text:
            return b""
        return b"".join(map(self._part, self._slices(text.replace(MARK, " "))))

    def _slices(self, text: str) -> Iterator[str]:
        """A text cut at spaces that begin a run of them; that one space is left out, as each part is coded with one before it."""
        at = 0
        while self.model.dummy_prefix and self.apart and len(text) - at > SLICE:
            space = self.run_of_spaces.search(text, at + SLICE, len(text) - 1)
            if not space:
                break
            yield text[at : space.start()]
            at = space.end()
        yield text[at:]

    def _part(self, text: str) -> bytes:
        words = text.split(" ") if self.model.dummy_prefix and self.apart else [""]
        if "" not in words:  # single spaces only: each word has one before it
            out = b"".join(map(self.cache.__getitem__, words))
        else:
            out = b"".join(map(self._chunk, self.chunks.findall(" " + text if self.model.dummy_prefix else text)))
        if len(self.cache) > CACHE_WORDS:
            self.cache.older = {}
            self.cache = _Words(self, self.cache)
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Ids of spaces and the word after them. Words after one space are cached without it."""
        if chunk[0] != " " or not self.apart:
            return self.word_ids(chunk)
        return self.cache[chunk if chunk[1:2] == " " else chunk[1:]]


class _Words(dict):
    """Ids of words met since the last turn; those of the turn before are looked up, not made again. Long words aren't kept."""

    def __init__(self, codec: PieceCodec, older: dict[str, bytes]):
        self.codec, self.older = codec, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.codec.word_ids(word if word[:1] == " " else " " + word)
        if len(word) <= CACHE_WORD_CHARS:
            self[word] = ids
        return ids


def _lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + size].decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}
_DECODERS: dict[str, PieceDecoder] = {}


def codec_of(model: PieceModel) -> PieceCodec:
    """This worker's encoder of a model; made once for all its tasks."""
    if model.key not in _CODECS:
        _CODECS.clear()
        _CODECS[model.key] = PieceCodec(model)
    return _CODECS[model.key]


def decoder_of(model: PieceModel) -> PieceDecoder:
    """This worker's decoder of a model."""
    if model.key not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[model.key] = PieceDecoder(model)
    return _DECODERS[model.key]
