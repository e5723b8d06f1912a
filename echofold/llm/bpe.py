"""Byte-level BPE encoding with reuse of content-defined chunks, and exact decoding.

A rolling hash over 32 bytes cuts each text into chunks, so copies and near copies of a passage yield the same chunks wherever
they begin, in any script. Chunks that occur more than once are encoded once, by themselves, with the places where their words (what the
tokenizer's pattern splits off) begin. Near its ends a chunk's own encoding needn't be the whole text's, so every join is repaired: the text is
encoded again from a word's beginning well inside the chunk before it, over the join and into the next chunk, in growing windows, until
the words of the window and those of the chunk begin at the same places. From there the chunk's ids are taken over. The same is asked at the left end, where the
window must begin with the words that the earlier chunk has there; if it doesn't, that chunk isn't used. Words are encoded one by
one, so agreement makes the whole equal to the whole text's encoding. Texts without shared chunks never leave their task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm.spark_util import cut, marked, parts_by_bytes, scratch_table, text_keys, text_or_empty

#: Chunks end where this many low bits of the hash are 0, but not before MIN_CHUNK bytes, and at MAX_CHUNK.
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 10, 512, 8192
#: Bytes of a chunk in the first window over its join, and in the last one that is tried; bytes of its end that are encoded again.
FIRST, MOST, BACK = 64, 512, 48
_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
_SEGMENT = 1 << 20
#: Bytes of text that are encoded at a time.
_BATCH = 1 << 17


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes that end at each position (fewer at the start)."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        if len(h) > shift:
            moved = h[:-shift] << np.uint32(shift)
            h[shift:] += moved
    return h


def _char_start(data: np.ndarray, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of UTF-8 bytes end, never within a character; the last end is the length."""
    marks = []
    for at in range(0, len(data), _SEGMENT):
        low = max(0, at - 31)
        h = _rolling(data[low : at + _SEGMENT])[at - low :]
        marks.append(np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + at + 1)
    ends, last = [], 0
    for mark in np.concatenate(marks).tolist() if marks else []:
        while mark - last > MAX_CHUNK:
            last = _char_start(data, last + MAX_CHUNK)
            ends.append(last)
        if mark - last >= MIN_CHUNK:
            last = _char_start(data, mark)
            ends.append(last)
    while len(data) - last > MAX_CHUNK:
        last = _char_start(data, last + MAX_CHUNK)
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks(text: bytes) -> list[tuple[int, int, int, int]]:
    """start, end and two 64-bit hashes of each chunk that is long enough to be worth its joins; of equal ones the first."""
    ends = chunk_ends(np.frombuffer(text, np.uint8))
    out = []
    for a, b in zip([0, *ends[:-1]], ends):
        if b - a >= MIN_CHUNK:
            h = xxhash.xxh3_128_intdigest(text[a:b])
            out.append((a, b, (h >> 64) - 2**63, (h & 0xFFFFFFFFFFFFFFFF) - 2**63))
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@lru_cache(maxsize=2)
def splits_locally(path: str) -> bool:
    """Whether the tokenizer is a byte-level BPE that keeps every byte and whose pattern looks nowhere back."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = spec.get("pre_tokenizer") or {}
    steps = first.get("pretokenizers", [first])
    plain = all(x.get("type") in ("ByteLevel", "Split", "Digits") and not x.get("add_prefix_space") and "(?<" not in str(x.get("pattern")) and x.get("behavior", "Isolated") == "Isolated" for x in steps)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    model = spec["model"]
    return spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and any(x.get("type") == "ByteLevel" for x in steps) and plain and added


@lru_cache(maxsize=2)
def _tables(path: str) -> tuple[list[bytes], list[bytes], np.ndarray, int]:
    """Bytes of each id's token, its decimal form with a comma, its length, and bytes of the longest added token."""
    tokenizer = _tokenizer(path)
    # Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        tokens[i] = special[i].encode() if i in special else bytes(byte[c] for c in token)
    return tokens, [b"%d," % i for i in range(len(tokens))], np.array([len(t) for t in tokens]), max([len(t.encode()) for t in special.values()], default=0)


def encode_texts(texts: list[str], path: str) -> list[list[int]]:
    """ids of each text, a bounded number of bytes at a time."""
    tokenizer, out, at = _tokenizer(path), [], 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= _BATCH):
            held += len(texts[end])
            end += 1
        out += [e.ids for e in tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
        at = end
    return out


class _Encoded:
    """A text's ids, where each one's bytes begin, and on demand where its words do."""

    def __init__(self, text: bytes, path: str):
        self._found = _tokenizer(path).encode(text.decode(), add_special_tokens=False)
        self.ids = self._found.ids
        sizes = _tables(path)[2][self.ids] if self.ids else np.zeros(0, np.int64)
        self._at = np.cumsum(sizes) - sizes

    def begins(self, low: int, high: int) -> dict[int, int]:
        """The words that begin from byte ``low`` to ``high``, in order, with each one's first token. Only tokens there are asked."""
        first, stop = np.searchsorted(self._at, low), np.searchsorted(self._at, high, side="right")
        before = self._found.token_to_word(int(first) - 1) if first else None
        out = {}
        for k, at in zip(range(int(first), int(stop)), self._at[first:stop].tolist()):
            word = self._found.token_to_word(k)
            if word != before:
                out[at] = k
            before = word
        return out


def encode_chunk(text: bytes, path: str) -> dict | None:
    """What is kept of a chunk: ids up to ``out`` (bytes, a word's beginning), words that begin up to MOST and from ``out`` on.

    At least two further words with a letter or digit follow ``out`` before the chunk's last word, so neither runs of white space nor of digits that
    go on beyond the chunk can move it. None for a chunk without such a place.
    """
    found, n = _Encoded(text, path), len(text)
    limit, reach = n - max(BACK, _tables(path)[3]), 4 * BACK
    while True:
        ends = list(found.begins(max(n - reach, 0), n).items())
        solid = 0
        for k in range(len(ends) - 2, -1, -1):
            if solid >= 2 and 0 < ends[k][0] <= limit:
                out, token = ends[k]
                starts = found.begins(0, min(MOST, out))
                # The next word is asked to come again behind ``out``.
                return {"ids": found.ids[:token], "begins": list(starts), "first": list(starts.values()), "out": out, "tail": [0, ends[k + 1][0] - out]}
            solid += any(c.isalnum() for c in text[ends[k][0] : ends[k + 1][0]].decode())
        if reach >= n:
            return None
        reach *= 4


def _join(text: bytes, at: int, start: int, chunk: dict, path: str) -> tuple[_Encoded, int, int] | None:
    """The window from ``at`` to a word in the chunk at ``start`` from which both agree, the window's tokens before it, and its index in the chunk; or None."""
    reach, most = FIRST, min(MOST, chunk["out"])
    own = {b + start: k for b, k in zip(chunk["begins"], chunk["first"])}
    while True:
        end = start + min(reach, most)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        window = _Encoded(text[at:end], path)
        here = {b + at: k for b, k in window.begins(start - at, end - at).items()}
        # The window's own end may have changed its last words.
        safe = min(list(here)[-3], end - _tables(path)[3]) if len(here) > 3 else -1
        mine, its = [b for b in here if b <= safe], [b for b in own if b <= safe]
        for i, b in enumerate(mine[:-2]):
            if b in own and mine[i:] == its[its.index(b) :]:
                return window, here[b], own[b]
        if reach >= most:
            return None
        reach *= 2


def encode_with_chunks(text: bytes, given: list[tuple[int, dict]], path: str) -> tuple[list[int], int]:
    """ids of a text some of whose chunks (start, what is kept) are encoded already, and how many ids are taken from them."""
    banned: set[int] = set()
    while True:
        out, taken, at, tail, last = [], 0, 0, None, None
        for start, chunk in given:
            if start in banned or start < at:
                continue
            met = _join(text, at, start, chunk, path)
            if met is None:
                continue
            window, n, k = met
            if tail is not None and list(window.begins(0, tail[-1])) != tail:
                break
            out += window.ids[:n] + chunk["ids"][k:]
            taken += len(chunk["ids"]) - k
            at, tail, last = start + chunk["out"], chunk["tail"], start
        else:
            if tail is None:
                return encode_texts([text.decode()], path)[0], 0
            rest = _Encoded(text[at:], path)
            if list(rest.begins(0, tail[-1])) == tail:
                return out + rest.ids, taken
        # The chunk used last doesn't end here as it does by itself.
        banned.add(last)


def _rows(docs: DataFrame) -> DataFrame:
    data = F.encode(text_or_empty(), "UTF-8")
    return docs.select("doc_id", *[c.alias(k) for k, c in text_keys(data).items()], data.alias("bytes"))


_CHUNK = ["ha", "hb", "ca", "cb", "start", "stop", "n"]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct chunks of each text, with their number."""
    for batch in batches:
        for part in parts_by_bytes(batch, 2):
            rows: list[tuple] = []
            for ha, hb, text in zip(*(c.to_pylist() for c in part.columns)):
                mine: dict[tuple[int, int], list[int]] = {}
                for start, stop, ca, cb in chunks(text):
                    mine.setdefault((ca, cb), [start, stop, 0])[2] += 1
                rows += [(ha, hb, ca, cb, *v) for (ca, cb), v in mine.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.int32()) for k in range(7)], _CHUNK)


def _wire(chunk: dict | None, squeeze) -> bytes:
    """A chunk in bytes: the size of what is said about it, this, and the ids."""
    if chunk is None:
        return b""
    head = json.dumps({k: v for k, v in chunk.items() if k != "ids"}, separators=(",", ":")).encode()
    return squeeze.compress(len(head).to_bytes(4, "little") + head + np.array(chunk["ids"], "<u4").tobytes())


def _unwire(data: bytes, expand) -> dict:
    data = expand.decompress(data)
    n = 4 + int.from_bytes(data[:4], "little")
    return json.loads(data[4:n]) | {"ids": np.frombuffer(data[n:], "<u4").tolist()}


def _shared_chunks(texts: DataFrame, found: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(ha, hb, ca, cb, start) for the chunks of distinct texts that may be shared, and (ca, cb, chunk) for those that are, encoded."""
    often = cut(found.groupBy("ca", "cb").agg(F.sum("n").alias("n"), F.min(F.struct("ha", "hb", "start", "stop")).alias("owner")).where("n > 1").select("ca", "cb", "owner.*"))
    owned = often.groupBy("ha", "hb").agg(F.collect_list(F.struct("ca", "cb", "start", "stop")).alias("owned"))
    owners = marked(texts.select("ha", "hb", "bytes"), often, ["ha", "hb"]).where("_maybe").select("ha", "hb", "bytes")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in parts_by_bytes(batch, 0, _BATCH):
                rows = []
                for text, listed in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows += [(c["ca"], c["cb"], _wire(encode_chunk(text[c["start"] : c["stop"]], path), squeeze)) for c in listed]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.binary()) for k in range(3)], ["ca", "cb", "chunk"])

    # Copies of an owner give its chunks once.
    encoded = owners.dropDuplicates(["ha", "hb"]).join(owned, ["ha", "hb"]).select("bytes", "owned").mapInArrow(encode, "ca long, cb long, chunk binary").where(F.octet_length("chunk") > 0)
    uses = marked(found.select("ha", "hb", "ca", "cb", "start"), often, ["ca", "cb"]).where("_maybe").drop("_maybe").dropDuplicates(["ha", "hb", "start"])
    return cut(uses), cut(encoded)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode documents (doc_id, text) and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text), n_reused (tokens
    taken from shared chunks, or from an equal text) and, if asked for, ids as array<int>.

    A null text counts as empty and has no tokens. ``doc_id`` may be null, of any type and need not identify a row; rows that repeat stay, each
    with its result. Texts of any length and script are encoded whole. Of a chunk that a text holds twice only the first is taken over. A
    tokenizer that isn't a byte-level BPE, or changes the text before it splits it, is used without reuse. An empty table gives an empty
    result. Other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    local = splits_locally(path)
    rows, kind = _rows(docs), "array<struct<start:int,chunk:binary>>"
    if local:
        with scratch_table(rows.select("ha", "hb", "bytes").mapInArrow(_find, "ha long, hb long, ca long, cb long, start int, stop int, n int")) as found:
            uses, encoded = _shared_chunks(rows, found, path)
        # As many entries as the text has chunks. The shuffle by text serves the grouping and the join.
        given = uses.join(encoded, ["ca", "cb"]).groupBy("ha", "hb").agg(F.array_sort(F.collect_list(F.struct("start", "chunk"))).alias("given"))
        likely = marked(rows, uses, ["ha", "hb"])
        alone = likely.where("not _maybe").withColumn("given", F.lit(None).cast(kind))
        both = likely.where("_maybe").join(given, ["ha", "hb"], "left")
    else:
        alone, both = rows.withColumn("given", F.lit(None).cast(kind)), None

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, tokens, decimals = zstandard.ZstdDecompressor(), *(_tables(path)[:2] if local else ((), ()))

        def told(text: bytes, ids: list[int], taken: int) -> tuple:
            if not local:
                back = _tokenizer(path).decode(ids, skip_special_tokens=False)
                return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), taken, ids
            back = b"".join(map(tokens.__getitem__, ids))
            # Bytes that are the text's own are valid UTF-8.
            decoded = back if back == text else back.decode("utf-8", "replace").encode()
            return len(ids), hashlib.sha256(b"".join(map(decimals.__getitem__, ids))[:-1]).hexdigest(), hashlib.sha256(decoded).hexdigest(), taken, ids

        # Copies of a text with shared chunks come one after another, as they are joined by text.
        last, result = None, None
        for batch in batches:
            for part in parts_by_bytes(batch, 1, _BATCH):
                texts, listed, keys = part.column(1).to_pylist(), part.column(2).to_pylist(), list(zip(part.column(3).to_pylist(), part.column(4).to_pylist()))
                fresh = iter(encode_texts([t.decode() for t, g in zip(texts, listed) if not g], path))
                out = []
                for text, given, key in zip(texts, listed, keys):
                    if not given:
                        out.append(told(text, next(fresh), 0))
                        continue
                    if key == last:
                        result = (*result[:3], result[0], result[4])
                    else:
                        last, result = key, told(text, *encode_with_chunks(text, [(c["start"], _unwire(c["chunk"], expand)) for c in given], path))
                    out.append(result)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()] + ([pa.list_(pa.int32())] if keep_ids else [])
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_reused", "ids"]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]], names[: len(kinds) + 1])

    # Each text is decoded as soon as it is encoded, so ids don't leave the task unless asked for.
    schema = T.StructType([rows.schema["doc_id"]]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("n_reused", "long")
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    fields = ["doc_id", "bytes", "given", "ha", "hb"]
    every = alone.select(*fields) if both is None else alone.select(*fields).unionByName(both.select(*fields))
    return every.mapInArrow(assemble, schema)


def op8_chunk_reuse_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
