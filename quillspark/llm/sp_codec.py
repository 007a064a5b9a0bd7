"""SentencePiece encoding with byte offsets into the source, and decoding.

Normalisation looks up the longest prefix of the rest of the text in the model's compiled character map (a double-array
trie) and records, for every normalised byte, the source byte it came from. The pieces of every document must spell its
normalised text byte by byte; then their running lengths, read through that record, are spans of the source. A document whose pieces
don't has its ids and decoded text all the same, and null instead of spans. Models without byte pieces, whose unknown piece spells nothing, are refused.

Defined cases: a null text counts as empty and gives the end id alone, an empty span list and an empty decoded text.
Characters without a piece become byte pieces; all of these but the last have empty spans at the character's start,
as the character can't be divided. Very long texts are encoded whole. Repeated rows give repeated results, an empty table
an empty one. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, frame, id_type, ragged, small_batches, space_words, typed

SPACE = "▁"
#: Distinct words whose pieces a Python worker remembers; beyond it the memory starts afresh.
REMEMBERED_WORDS = 400_000


class CharacterMap:
    """The compiled character map of a model: longest-prefix lookup of source bytes."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units, self.targets = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if size else [], blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts there."""
        if not self.units:
            return None
        node, found = 0, None
        jump = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node ^= jump(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.targets[start : self.targets.index(b"\0", start)]
        return found


class Normalizer:
    """Source text to normalised bytes, with the source byte of every normalised byte (and of the end)."""

    def __init__(self, spec):
        self.map, self.prefix, self.trim = CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode()
        if not self.map.units and not self.trim:
            return self.plain(data)
        out, origin, i, mark, blank = bytearray(), [], 0, SPACE.encode(), True
        if self.trim:
            while i < len(data) and (hit := self.step(data, i))[1] == b" ":
                i += hit[0]
        if self.prefix and i < len(data):
            out += mark
            origin += [i] * 3
        while i < len(data):
            width, target = self.step(data, i)
            if self.trim and blank and target.startswith(b" ") and origin:
                target = target.lstrip(b" ")
            for j in range(len(target)):
                new = mark if target[j : j + 1] == b" " else target[j : j + 1]
                out += new
                origin += [i] * len(new)
            blank = target.endswith(b" ") or (blank and not target)
            i += width
        while self.trim and out.endswith(mark):
            i = origin[-3]
            del out[-3:], origin[-3:]
        return bytes(out), np.array([*origin, i])

    def step(self, data: bytes, i: int) -> tuple[int, bytes]:
        """The longest mapped prefix, else one character as it is."""
        if hit := self.map.longest(data, i):
            return hit
        width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        return width, data[i : i + width]

    def plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """With an empty map every character is its own longest prefix; only spaces change, from one byte to three."""
        lead = 3 if self.prefix and data else 0
        raw = np.frombuffer(data, np.uint8)
        start = np.flatnonzero((raw & 0xC0) != 0x80)
        origin = np.repeat(start, np.diff(np.append(start, len(raw))))  # each byte's character
        origin = np.repeat(origin, np.where(raw == 32, 3, 1))
        return (SPACE.encode() if lead else b"") + data.replace(b" ", SPACE.encode()), np.concatenate([np.zeros(lead, np.int64), origin, [len(raw)]])


@cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Codec:
    """Encoder and decoder of one model. Merges never cross into a space mark or a line feed, so words are remembered alone."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        self.sp = processor(path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        kinds = type(model.pieces[0]) if model.pieces else None
        self.normalizer = Normalizer(model.normalizer_spec)
        content = [b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.encode() for p in model.pieces]
        self.content, self.bytes_of = content, np.array([len(c) for c in content])
        if not model.trainer_spec.byte_fallback:
            raise ValueError("a model with byte pieces is needed")
        plain = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        spec = model.normalizer_spec
        apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain) and not any(p.type == kinds.USER_DEFINED for p in model.pieces)
        self.by_word = apart and not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        self.known: dict[str, tuple[bytes, str]] = {}

    def encode(self, texts: pa.Array) -> Iterator[tuple[str, np.ndarray, str]]:
        """Each text with its ids (no end id), as an array and as decimals with a space after each."""
        decimals = lambda ids: "".join([f"{i} " for i in ids])
        at, codes, words = space_words(texts, " \n")
        if len(self.known) > REMEMBERED_WORDS:
            self.known = {}
        known = self.known
        if new := [w for w in words if w not in known]:
            for w, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
                ids = ids[w[:1] == "\n" :]  # before a line feed the mark of the start stands alone
                known[w] = np.array(ids, "<i4").tobytes(), decimals(ids)
        found = [known[w] for w in words]
        flat, ends = ragged([x[0] for x in found], codes, "<i4")
        ends, strings = np.concatenate([[0], ends])[at].tolist(), [x[1] for x in found]
        odd = {i for i, w in enumerate(words) if not w or SPACE in w}
        is_odd = np.isin(codes, np.fromiter(odd, np.int64, len(odd)))
        for i, text in enumerate(texts.to_pylist()):
            a, b = at[i], at[i + 1]
            if not text:
                yield "", np.zeros(0, "<i4"), ""
            elif not self.by_word or words[codes[a]][:1] == "\n" or is_odd[a:b].any():  # repeated or literal space marks, or a line feed first
                ids = self.sp.encode(text)
                yield text, np.array(ids, "<i4"), decimals(ids)
            else:
                yield text, flat[ends[i] : ends[i + 1]], "".join([strings[c] for c in codes[a:b].tolist()])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Start and end byte of each piece in the source, None where the pieces don't spell the normalised text byte by byte."""
        normal, origin = self.normalizer.normalize(text)
        content = self.content
        if b"".join([content[i] for i in ids.tolist()]) != normal:
            return None
        ends = np.cumsum(self.bytes_of[ids])
        return origin[np.concatenate([[0], ends[:-1]])] if len(ends) else ends, origin[ends]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    end = codec.sp.eos_id()
    for b in small_batches(batches, chars=4_000_000):
        schema = typed(DIGEST if digest else ENCODED, b)
        out: dict[str, list] = {f.name: [] for f in schema}
        for key, (text, ids, decimals) in zip(b.column(0).to_pylist(), codec.encode(b.column(1)), strict=True):
            found = codec.spans(text, ids)
            every = [*ids.tolist(), end]
            decoded = codec.sp.decode(every)
            if digest:
                spans = None if found is None else zlib.crc32(np.stack(found).astype("<i8").tobytes())
                row = (key, len(every), hashlib.sha256(f"{decimals}{end}".encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), spans)
            else:
                row = (key, every, *(x if x is None else x.tolist() for x in found or (None, None)), decoded)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        yield frame(out, schema)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row a document. ids (end id last), starts and ends (source bytes of each id but the end id) and the decoded text;
    with digest, their counts and hashes, so that only these leave the Python worker."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long" if digest else "ids array<int>, starts array<long>, ends array<long>, decoded string"
    return arrow_map(rows, lambda it: encode_batches(it, model_path, digest), f"doc_id {id_type(rows)}, {columns}")
