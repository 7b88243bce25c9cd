"""BPE encoding and decoding as a streaming transducer with bounded lookahead (operator 3).

A merge list has a *sufficient lookahead* L: whatever follows a prefix, tokens that end L or more symbols before the
end of the prefix do not change (compare Berglund and van der Merwe, "Formalizing BPE Tokenization", 2023). Symbols to
the right can reach leftwards only through a chain of merges of rising rank, where the token that a merge takes in from
the left begins the right part of the next merge; L is the longest such chain. The encoder therefore holds at most
``2 * L + STEP`` symbols of a word, emits tokens once they are stable, and goes on at the boundary of the last one.

Decoding feeds the bytes of one token after another to an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame

from .support import map_columns

STEP = 256  # symbols a word stream takes in before it looks for stable tokens
PIECE = 1 << 16  # characters of a text that are normalised and split at a time
RUN = 512  # longer runs without white space are streamed
CACHED = 250_000  # runs and words whose ids a worker remembers, in each of two generations

_SPACE = regex.compile(r"\s+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the tokenizer
_LETTERS = regex.compile(r"\p{L}+")
_SYMBOLS = regex.compile(r"[^\s\p{L}\p{N}]+")
# Places inside a run where neither composition nor the split pattern looks across.
_SAFE = regex.compile(r"(?<=\p{L}{3})(?=[A-Za-z一-鿿])|(?<=[!-/:-@\[-`{-~])(?=[!-/:-@\[-`{-~])|(?=[0-9])")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the others follow at 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for shift, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + shift)
    return table


_TO_ALPHABET = {b: c for b, c in byte_alphabet().items()}
_FROM_ALPHABET = {c: b for b, c in _TO_ALPHABET.items()}


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str = "") -> int:
    """The longest leftward chain of a merge list, in symbols, and one for a word's last symbol.

    ``ValueError`` for a list that is not proper (a part without an earlier merge, or one product of two merges), for
    which no bound is known.
    """
    reach: dict[str, int] = {}
    made: set[str] = set()
    longest = 0
    for left, right in merges:
        for part in (left, right):
            bare = part.removesuffix(suffix) if suffix else part
            if len(bare) > 1 and part not in made:
                raise ValueError(f"{part!r} is merged before it is made")
        if left + right in made:
            raise ValueError(f"{left + right!r} is made twice")
        made.add(left + right)
        bare = right.removesuffix(suffix) if suffix else right
        best = len(left) + max((reach.get(bare[:n], 0) for n in range(1, len(bare) + 1)), default=0)
        reach[left] = max(reach.get(left, 0), best)
        longest = max(longest, best)
    return longest + 1


@dataclass(frozen=True)
class Text:
    """What a tokenizer file says besides the merges."""

    lower: bool
    nfc: bool
    collapse: bool
    split: str
    special: tuple[tuple[str, int], ...]


class WordStream:
    """Ids of one word that arrives in parts; memory is bounded by the lookahead."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.held: list[str] = []

    def feed(self, symbols: str) -> Iterator[list[int]]:
        room = STEP if self.encoder.lookahead is None else 2 * self.encoder.lookahead + STEP
        for start in range(0, len(symbols), STEP):
            self.held.extend(symbols[start : start + STEP])
            if self.encoder.lookahead is not None and len(self.held) >= room:
                stable = len(self.held) - self.encoder.lookahead
                ids, end = [], 0
                for token in self.encoder.merge(self.held):
                    if end + len(token) > stable:
                        break
                    end += len(token)
                    ids.append(self.encoder.vocab[token])
                self.held = self.held[end:]
                yield ids

    def end(self) -> list[int]:
        symbols, self.held = self.held, []
        return self.encoder.finish(symbols)


class Encoder:
    """Encodes with a merge list read from a tokenizer file (byte-level alphabet, optional end-of-word suffix)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        try:
            self.lookahead: int | None = sufficient_lookahead(merges, self.suffix)
        except ValueError:
            self.lookahead = None  # words are then held whole
        self.text = _text_rules(data)
        self.pretoken = regex.compile(self.text.split)
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.text.special}
        self.byte_level = (data.get("decoder") or {}).get("type") == "ByteLevel"
        self.special = dict(self.text.special)
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.words = _Known(self._word)
        self.runs = _Known(self._run)

    # Words

    def merge(self, symbols: list[str]) -> list[str]:
        """The tokens of a sequence of symbols: always the pair of least rank, the leftmost first."""
        ranks = self.ranks
        if len(symbols) <= 32:
            parts, never = list(symbols), len(ranks)
            found = [ranks.get(pair, never) for pair in zip(parts, parts[1:])]
            while found and (rank := min(found)) < never:
                at = found.index(rank)
                made = parts[at] + parts.pop(at + 1)
                parts[at] = made
                del found[at]
                if at:
                    found[at - 1] = ranks.get((parts[at - 1], made), never)
                if at < len(found):
                    found[at] = ranks.get((made, parts[at + 1]), never)
            return parts
        parts, n = list(symbols), len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (pair := (parts[a], parts[b])) in ranks:
                    heapq.heappush(heap, (ranks[pair], a))
        return [p for p in parts if p]

    def finish(self, symbols: list[str]) -> list[int]:
        """Ids of symbols that end a word."""
        if not symbols:
            return []
        if self.suffix:
            symbols = [*symbols[:-1], symbols[-1] + self.suffix]
        vocab = self.vocab
        return [vocab[t] for t in self.merge(symbols)]

    # Texts

    def normalise(self, text: str) -> str:
        if self.text.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.text.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return text

    @staticmethod
    def symbols(word: str) -> str:
        return word.encode().decode("latin-1").translate(_TO_ALPHABET)

    def _word(self, word: str) -> bytes:
        ids = self.finish(list(self.symbols(word)))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: str) -> bytes:
        """Ids of a run without white space."""
        if len(run) > RUN:
            raise _Long
        words = self.pretoken.findall(self.normalise(run))
        return self.words[words[0]] if len(words) == 1 else b"".join(map(self.words.__getitem__, words))

    def stream_run(self, run: str) -> Iterator[list[int]]:
        """Ids of a long run, in parts: an open word is carried from piece to piece."""
        stream: WordStream | None = None
        kind = _LETTERS
        for piece in _safe_pieces(run):
            text, at = self.normalise(piece), 0
            if stream is not None:
                if more := kind.match(text):
                    at = more.end()
                    yield from stream.feed(self.symbols(more.group()))
                if at < len(text):
                    yield stream.end()
                    stream = None
            for found in self.pretoken.finditer(text, at):
                word = found.group()
                current = WordStream(self)
                yield from current.feed(self.symbols(word))
                pattern = next((p for p in (_LETTERS, _SYMBOLS) if p.fullmatch(word)), None)
                if found.end() == len(text) and pattern is not None:
                    stream, kind = current, pattern
                else:
                    yield current.end()
        if stream is not None:
            yield stream.end()

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text as little-endian unsigned 32-bit arrays, emitted piece by piece; their strings in a text give
        the special tokens."""
        at = 0
        for found in self.special_pattern.finditer(text):
            yield from self._plain(text, at, found.start())
            yield np.array([self.special[found.group()]], dtype="<u4")
            at = found.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[np.ndarray]:
        while start < end:
            stop = end
            if end - start > PIECE:
                cut = max(text.rfind(" ", start + PIECE // 2, start + PIECE), text.rfind("\n", start + PIECE // 2, start + PIECE))
                if cut < 0:
                    space = _SPACE.search(text, start + PIECE, end)
                    cut = space.start() if space else end
                stop = cut
            piece = text[start:stop]
            start = stop
            runs = _SPACE.split(piece) if _ODD_SPACE.search(piece) else piece.split()
            try:
                yield np.frombuffer(b"".join(map(self.runs.__getitem__, runs)), dtype="<u4")
                continue
            except _Long:
                pass
            for run in runs:
                if len(run) <= RUN:
                    yield np.frombuffer(self.runs[run], dtype="<u4")
                else:
                    for ids in self.stream_run(run):
                        yield np.array(ids, dtype="<u4")

    def decoder(self) -> Decoder:
        return Decoder(self)


class _Known(dict):
    """Remembers the ids of strings. Once it is full it starts anew and keeps the last generation to fall back on, so
    that frequent strings stay known and memory is bounded."""

    def __init__(self, work) -> None:
        super().__init__()
        self.work = work
        self.last: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHED:
            self.last = dict(self)
            self.clear()
        ids = self.last.get(key)
        if ids is None:
            ids = self.work(key)
        self[key] = ids
        return ids


class _Long(Exception):
    """A run that is to be streamed."""


class Decoder:
    """Ids to text, part by part. Without a decoder in the tokenizer file, tokens are joined by a space."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False
        self.pieces = _piece_bytes(encoder)

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        between = b"" if self.encoder.byte_level else b" "
        data = between.join(map(self.pieces.__getitem__, ids.tolist()))
        if self.begun:
            data = between + data
        self.begun = True
        return self.machine.decode(data)

    def end(self) -> str:
        return self.machine.decode(b"", final=True)


def _piece_bytes(encoder: Encoder) -> dict[int, bytes]:
    if not hasattr(encoder, "piece_bytes"):
        special = set(encoder.special)

        def piece(token: str) -> bytes:
            if not encoder.byte_level or token in special or any(c not in _FROM_ALPHABET for c in token):
                return token.encode()
            return bytes(_FROM_ALPHABET[c] for c in token)

        encoder.piece_bytes = {i: piece(t) for i, t in encoder.tokens.items()}
    return encoder.piece_bytes


def _safe_pieces(run: str) -> Iterator[str]:
    at = 0
    while len(run) - at > PIECE and (cut := _SAFE.search(run, at + PIECE)):
        yield run[at : cut.start()]
        at = cut.start()
    yield run[at:]


def _text_rules(data: dict) -> Text:
    def each(part: dict | None, many: str) -> list[dict]:
        return [] if part is None else part[many] if part["type"] == "Sequence" else [part]

    normalizers = {n["type"]: n for n in each(data.get("normalizer"), "normalizers")}
    splits = [p["pattern"]["Regex"] for p in each(data.get("pre_tokenizer"), "pretokenizers") if p["type"] == "Split"]
    if "Replace" not in normalizers or len(splits) != 1 or not set(normalizers) <= {"NFC", "Replace", "Lowercase"}:
        raise ValueError("only tokenizers that drop white space and split by one pattern are read")
    special = tuple((t["content"], t["id"]) for t in data.get("added_tokens", ()))
    return Text("Lowercase" in normalizers, "NFC" in normalizers, True, splits[0], special)


@functools.lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    """One encoder per file and worker."""
    return Encoder(path)


ROUND_TRIP = "n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING"


def digest(encoder: Encoder, text: str | None) -> tuple[int, str, str]:
    """Number of ids, digest of the ids in decimal, digest of the text decoded from them; nothing whole is held."""
    ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
    decoder, count = encoder.decoder(), 0
    decimals = _decimals(encoder)
    for ids in encoder.encode(text or ""):
        if len(ids):
            ids_hash.update((b" " if count else b"") + b" ".join(map(decimals.__getitem__, ids.tolist())))
            text_hash.update(decoder.feed(ids).encode())
            count += len(ids)
    text_hash.update(decoder.end().encode())
    return count, ids_hash.hexdigest(), text_hash.hexdigest()


def _decimals(encoder: Encoder) -> dict[int, bytes]:
    if not hasattr(encoder, "decimal_bytes"):
        encoder.decimal_bytes = {i: b"%d" % i for i in encoder.tokens}
    return encoder.decimal_bytes


def _digests(path: str):
    encoder = load(path)
    return lambda texts: list(zip(*(digest(encoder, t) for t in texts))) or [[], [], []]


def _encoded(path: str):
    encoder = load(path)

    def work(texts: list[str | None]) -> list[list]:
        return [[np.concatenate([*encoder.encode(t or ""), np.empty(0, "<u4")]).tolist() for t in texts]]

    return work


def _decoded(path: str):
    encoder = load(path)

    def text(ids: list[int] | None) -> str:
        decoder = encoder.decoder()
        return decoder.feed(np.asarray(ids or [], dtype="int64")) + decoder.end()

    return lambda column: [[text(ids) for ids in column]]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the ids of each text; a null text has no ids. Repeated keys give repeated rows."""
    return map_columns(docs, [text], lambda: _encoded(path), "ids ARRAY<INT>", [key])


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key, text`` of ``key, ids``; null ids give an empty text."""
    return map_columns(encoded, ["ids"], lambda: _decoded(path), "text STRING", [key])


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs``.

    A null text counts as empty: no ids, digests of nothing. A null or repeated key is carried along; other columns of
    ``docs`` play no part. One narrow stage, no shuffle; a text is encoded, decoded and digested piece by piece.
    """
    return map_columns(docs, [text], lambda: _digests(path), ROUND_TRIP, [key])
