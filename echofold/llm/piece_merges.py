"""SentencePiece encoding for merge-type vocabularies by an agenda of adjacent symbol pairs, checked against the library.

The normalised text is a chain of symbols, at first its characters. The agenda holds each adjacent pair whose concatenation is a piece, best
score first and leftmost among equals; merging a pair takes it off the chain and puts its pairs with both neighbours on the agenda. Symbols that are
no piece in the end become byte pieces. Where no piece goes on with a space after another character, texts are cut into words, and each word that a
Python worker doesn't remember is merged once for the whole Arrow batch: the agendas of many words are rows of a matrix, and the best pair is taken from each row at a time. Long words,
and texts of other vocabularies, have an agenda of their own. The library encodes the same words (or whole texts, where the vocabulary asks for that), and the ids are compared.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm.spark_util import parts_by_bytes, text_or_empty

#: Longest word that is merged with others, how many are at a time, how many words are remembered, and bytes of text that are worked on at a time.
_LONGEST, _ROWS, _MOST, _BATCH = 48, 1 << 14, 1 << 19, 1 << 21
#: Bits of a symbol's number, and the cost of two symbols that make up no piece.
_BITS, _NO_PAIR = 21, np.iinfo(np.int32).max
_SPACE = "▁"
_WORD = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
_NORMAL, _BYTE, _IGNORED = 1, 6, (2, 3)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merge_symbols(text: str, costs: dict[str, float]) -> list[str]:
    """The symbols that are left when no two neighbours make up a piece; ``costs`` has the pieces with their negative scores."""
    symbols: list[str | None] = list(text)
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    cost, push, pop = costs.get, heapq.heappush, heapq.heappop
    agenda = [(c, k, k + 1, joined) for k, joined in enumerate(map(add, text, text[1:])) if (c := cost(joined)) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, left, right, joined = pop(agenda)
        a, b = symbols[left], symbols[right]
        # Outdated when either side has been merged meanwhile: then it is gone or longer than it was.
        if a is None or b is None or len(a) + len(b) != len(joined):
            continue
        symbols[left], symbols[right] = joined, None
        right = after[left] = after[right]
        if right < n:
            before[right] = left
            wider = joined + symbols[right]
            if (c := cost(wider)) is not None:
                push(agenda, (c, left, right, wider))
        if (first := before[left]) >= 0:
            wider = symbols[first] + joined
            if (c := cost(wider)) is not None:
                push(agenda, (c, first, left, wider))
    return [s for s in symbols if s is not None]


class MergeModel:
    """A merge-type vocabulary with byte fallback, and the library's processor for the same file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = {p.type for p in spec.pieces}
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or _BYTE not in kinds or kinds - {_NORMAL, _BYTE, *_IGNORED}:
            raise ValueError("the vocabulary must be of the merge type, with byte pieces and without unused or user-defined ones")
        self.library = SentencePieceProcessor(model_file=path)
        self.costs = {p.piece: -p.score for p in spec.pieces if p.type == _NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == _BYTE}
        self.decimals = [str(i) for i in range(len(spec.pieces))]
        rules = spec.normalizer_spec
        words = not any(_SPACE in piece.lstrip(_SPACE) for piece in self.costs)
        #: Whether words are encoded one by one, and the library encodes one as it does within a text.
        self.by_word = words and rules.name == "identity" and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
        self.known: dict[str, list[int]] = {}
        self._tables()

    def _tables(self) -> None:
        """Symbols as numbers: a piece's id, or beyond the ids a character's own number; and all pairs of symbols that make up a piece."""
        self.n = len(self.decimals)
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.n
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        number = lambda s: int(self.of_char[ord(s)]) if len(s) == 1 else self.ids.get(s, -1)
        order = {c: k for k, c in enumerate(sorted(set(self.costs.values())))}
        pairs = []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = number(piece[:k]), number(piece[k:])
                if left >= 0 and right >= 0:
                    pairs.append((left << _BITS | right, order[self.costs[piece]], i))
        keys, costs, merged = np.array(sorted(pairs) or np.zeros((0, 3)), np.int64).T
        self.pairs = keys, np.append(costs, _NO_PAIR).astype(np.int32), np.append(merged, -1)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which entry of ``pairs`` two symbols are; the one behind the last for none."""
        keys = self.pairs[0]
        wanted = (left << _BITS) | right
        at = np.searchsorted(keys, wanted)
        return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, len(keys)) if len(keys) else np.zeros_like(wanted)

    def word_ids(self, symbols: np.ndarray) -> list[int]:
        return [i for s in symbols[symbols >= 0].tolist() for i in ([s] if s < self.n else [self.bytes[b] for b in chr(s - self.n).encode()])]

    def merge_words(self, words: list[str]) -> np.ndarray:
        """The symbols left of short words, -1 behind the last: each row of a matrix is a word's chain of symbols, another one's the costs of its pairs."""
        _, costs, merged = self.pairs
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        columns = np.arange(width)
        points = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
        symbols_of = np.where(columns < sizes[:, None], self.of_char[points], -1)
        pair = self._pair(symbols_of[:, :-1], symbols_of[:, 1:])
        pair[columns[1:] >= sizes[:, None]] = len(merged) - 1
        row, out = np.arange(len(words)), np.empty((len(words), width), np.int64)
        while len(row):
            cost = costs[pair] if width > 1 else np.full((len(row), 1), _NO_PAIR)
            # Of equal costs argmin takes the leftmost.
            best = cost.argmin(1)
            open_ = cost[np.arange(len(row)), best] < _NO_PAIR
            out[row[~open_]] = symbols_of[~open_]
            row, symbols_of, pair, best = row[open_], symbols_of[open_], pair[open_], best[open_, None]
            if not len(row):
                break
            each = np.arange(len(row))[:, None]
            symbols_of[each, best] = merged[pair[each, best]]
            # What stood to the right of the pair moves up.
            symbols_of = np.take_along_axis(symbols_of, np.minimum(columns + (columns > best), width - 1), 1)
            symbols_of[:, -1] = -1
            pair = np.take_along_axis(pair, np.minimum(columns[:-1] + (columns[:-1] > best), width - 2), 1)
            pair[:, -1] = len(merged) - 1
            for at in (best - 1, best):
                inner = np.clip(at, 0, width - 2)
                left, right = symbols_of[each, inner], symbols_of[each, inner + 1]
                found = np.where((left >= 0) & (right >= 0), self._pair(np.maximum(left, 0), np.maximum(right, 0)), len(merged) - 1)
                pair[each, inner] = np.where(at == inner, found, pair[each, inner])
        return out

    def _merge_alone(self, text: str) -> list[int]:
        out: list[int] = []
        for symbol in merge_symbols(text, self.costs):
            known = self.ids.get(symbol)
            out += [known] if known is not None else [self.bytes[b] for b in symbol.encode()]
        return out

    def _learn(self, words: list[str]) -> set[str]:
        """Remember words; returns those whose ids weren't the library's, which are remembered with the library's."""
        words.sort(key=len)
        theirs = self.library.encode([w[1:] for w in words], num_threads=1)
        # The library says nothing about an empty text, so of a space alone it is asked the piece's id.
        theirs = [ids if w != _SPACE else [self.library.piece_to_id(w)] for w, ids in zip(words, theirs)]
        odd, at = set(), 0
        while at < len(words):
            # Words of like sizes, so that rows are hardly wider than they need be.
            most = min(max(8, len(words[at]) * 5 // 4), _LONGEST)
            end = bisect_right(words, most, at, min(len(words), at + _ROWS), key=len)
            if end > at:
                odd.update(words[at + k] for k in self._unlike(self.merge_words(words[at:end]), theirs[at:end]))
            elif self._merge_alone(words[at]) != theirs[at]:
                odd.add(words[at])
            at = max(end, at + 1)
        self.known.update(zip(words, theirs))
        return odd

    def _unlike(self, own: np.ndarray, theirs: list[list[int]]) -> list[int]:
        """Rows that differ. Symbols are ids, but for characters that are no piece; rows of those are compared byte by byte."""
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.fromiter(chain.from_iterable(theirs), np.int64, int(sizes.sum()))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = place < own.shape[1]
        wanted = np.full_like(own, -1)
        wanted[np.repeat(np.arange(len(theirs)), sizes)[inside], place[inside]] = flat[inside]
        unlike = np.flatnonzero((own != wanted).any(1) | (sizes > own.shape[1]))
        return [k for k in unlike.tolist() if self.word_ids(own[k]) != theirs[k]]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """ids of each text, and whether the agenda's were the library's."""
        shown = [self.library.normalize(t) for t in texts]
        if not self.by_word:
            theirs = self.library.encode(texts, num_threads=1)
            return theirs, [self._merge_alone(s) == ids for s, ids in zip(shown, theirs)]
        if len(self.known) > _MOST:
            self.known = {}
        words = [_WORD.findall(s) for s in shown]
        new = set(chain.from_iterable(words)).difference(self.known)
        odd = self._learn(list(new)) if new else set()
        known = self.known
        ids = [list(chain.from_iterable([known[w] for w in ws])) for ws in words]
        # A word that differed isn't remembered, so that it tells on every text.
        for w in odd:
            del known[w]
        return ids, [not odd or odd.isdisjoint(ws) for ws in words]


@lru_cache(maxsize=2)
def merge_model(path: str) -> MergeModel:
    return MergeModel(path)


def encode_pieces(docs: DataFrame, model: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode documents (doc_id, text) without begin or end ids, and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the library's decoded text), agrees
    (whether the agenda's ids are the library's) and, if asked for, ids as array<int>. Where they weren't, the library's would be returned.

    ``model`` is a file that every executor has; one that isn't a merge-type vocabulary with byte pieces is refused on the driver. A null
    text counts as empty and has no tokens. Equal scores go to the leftmost pair. ``doc_id`` may be null, of any type and need not identify a
    row; rows that repeat stay, each with its result. Texts of any length are encoded whole. An empty table gives an empty result. Other columns are ignored. No shuffle.
    """
    path = model or default_model()
    merge_model(path)
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merge_model(path)
        for batch in batches:
            for part in parts_by_bytes(batch, 1, _BATCH):
                texts = part.column(1).to_pylist()
                all_ids, agrees = own.encode(texts)
                digests = [hashlib.sha256(",".join([own.decimals[i] for i in ids]).encode()).hexdigest() for ids in all_ids]
                decoded = [hashlib.sha256(t.encode()).hexdigest() for t in own.library.decode(all_ids)]
                arrays = [part.column(0), pa.array([len(i) for i in all_ids], pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
                if keep_ids:
                    arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = T.StructType([rows.schema["doc_id"]]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("agrees", "boolean")
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(encode, schema)


def op11_score_agenda_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
