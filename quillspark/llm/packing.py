"""Best-fit packing by the sum-of-squares rule.

Documents become token ids followed by an end id; those longer than a sequence are cut into full pieces and a rest.
Each packing task places its pieces one after another where the sum over residual gaps of the squared number of open
sequences with that gap becomes smallest. Only (id, piece, length) rows travel; texts and ids never do.

Defined cases: a null text counts as empty and gives one piece that holds the end id alone. Very long texts are encoded
whole. Repeated rows are packed as often as they occur. Rows with a null id are packed like others. Of pieces of one
length the order is that of the checksum, then of id and piece (equal ones are alike). An empty table gives
an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, cut, frame, gathered, id_type, ragged, small_batches, space_words, typed

CAPACITY, END_ID = 2048, 0
#: Pieces a packing task holds in memory at once (about 60 bytes each). What is left open at a task's end is the cost of splitting.
PIECES_PER_TASK = 40_000
#: Distinct words whose ids a Python worker remembers; then those not met since half of it filled are forgotten.
REMEMBERED_WORDS = 400_000

PIECES = "piece int, start long, length long, ids_crc32 long"


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


tokenizer = cache(load_tokenizer)


def words_stand_alone(tok) -> bool:
    """True for a tokenizer whose steps keep words apart and that ends words with a mark: lower case after white space became
    single spaces, a split that drops what lies between letters, digits and signs, and plain byte pair merges."""
    rules = json.loads(tok.to_str())
    steps = lambda part, inner: [x["type"] for x in part.get(inner, [part])] if part else []
    pre, model = rules.get("pre_tokenizer") or {}, rules["model"]
    first = (pre.get("pretokenizers") or [{}])[0]
    return (
        steps(rules.get("normalizer"), "normalizers") == ["NFC", "Replace", "Lowercase"]
        and steps(pre, "pretokenizers") == ["Split", "ByteLevel"]
        and first.get("invert") is True
        and first.get("behavior") == "Removed"
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not any(rules.get(k) for k in ("truncation", "padding", "post_processor"))
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    )


class WordEncoder:
    """Ids of whole texts, word by word where the tokenizer's rules never let a token cross a space; other tokenizers get whole texts."""

    def __init__(self, tok, remembered: int = REMEMBERED_WORDS):
        self.tok, self.remembered, self.known, self.older = tok, remembered, {}, {}
        self.by_word = words_stand_alone(tok)
        self.ends_word = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_word:
            return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        at, codes, words = space_words(texts, " ")
        if len(self.known) > self.remembered // 2:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        self.learn(new)
        ids, ends = ragged([known[w] for w in words], codes, "<u4")
        ends = np.concatenate([[0], ends])[at]
        return [ids[a:b] for a, b in pairwise(ends.tolist())]

    def learn(self, new: list[str]) -> None:
        """Letters and the full stops or commas after them are separate pre-tokens: letters are encoded many to a call, once for all their endings."""
        known, older, odd, parts = self.known, self.older, [], []
        for w in new:
            core = w.rstrip(".,")
            if core.isalpha():
                parts.append((w, core.lower() if core.isascii() else core, w[len(core) :]))
            else:
                odd.append(w)
        cores = list({c for _, c, _ in parts if c not in known and c not in older})
        for i in range(0, len(cores), 500):
            some = cores[i : i + 500]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends_word[ids]) + 1
            if len(last) == len(some):
                raw, at = ids.tobytes(), [0, *(4 * last).tolist()]
                known.update(zip(some, [raw[a:b] for a, b in pairwise(at)], strict=True))
            else:  # a letter that lower case turns into several characters
                self.alone(some)
        tails = {t: array("I", self.tok.encode(t, add_special_tokens=False).ids).tobytes() for t in {t for _, _, t in parts}}
        for w, core, tail in parts:
            known[w] = (known.get(core) or older[core]) + tails[tail]
        self.alone(odd)

    def alone(self, words: list[str]) -> None:
        for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[w] = array("I", e.ids).tobytes()


@cache
def lasting_encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return WordEncoder(tokenizer(path))


def encode_pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool, lean: bool = False) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids])
    encoder = WordEncoder(load_tokenizer(path), REMEMBERED_WORDS // 4) if lean else lasting_encoder(path)
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
    for b in small_batches(batches if lean else gathered(batches)):
        out: dict[str, list] = {f.name: [] for f in schema}
        schema = typed(schema, b)
        for key, text_ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
            ids = text_ids.tobytes() + end
            for at in range(0, len(ids), step):
                part = ids[at : at + step]
                row = (key, at // step, at // 4, len(part) // 4, zlib.crc32(part), part)
                for name, value in zip(out, row, strict=False):
                    out[name].append(value)
        yield frame(out, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Place the lengths in the order given: bin and offset of each. Ties go to the smallest gap, an open bin before a new one."""
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap; full bins don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.int64(1) << 60
    for i, size in enumerate(lengths.tolist()):
        gaps = count[size:]
        change = np.where(gaps > 0, 2 * (count[: capacity + 1 - size] - gaps) + 2, never)  # in the sum of squares
        if gaps[0] > 0:
            change[0] = 1 - 2 * gaps[0]  # the bin is full and leaves the sum
        best = int(change.argmin())
        fresh = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        if change[best] <= fresh:
            gap = best + size
            bins[i] = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, bins[i] = capacity, opened
            opened += 1
        offsets[i] = capacity - gap
        if gap > size:
            stacks[gap - size].append(int(bins[i]))
            count[gap - size] += 1
    return bins, offsets


def pack_batches(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if not (got := [b for b in batches if b.num_rows]):
        return
    held = pa.Table.from_batches(got)
    keys = [held.column(n).to_numpy() for n in ("length", "ids_crc32", "piece")]
    ids = held.column("doc_id").combine_chunks()
    ranks = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy()
    order = np.lexsort((keys[2], ranks, keys[1], -keys[0]))  # longest first, then by content: the same result in any arrival order
    held = held.take(pa.array(order))
    bins, offsets = sum_of_squares(held.column("length").to_numpy(), capacity)
    held = held.append_column("sequence_id", pa.array(bins + (np.int64(TaskContext.get().partitionId()) << 33))).append_column("offset", pa.array(offsets))
    yield from held.to_batches(max_chunksize=10_000)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, lean: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    lean: the tokenizer and the words met are let go after each task, which costs time and saves memory where Python
    workers serve other stages too.

    The number of packing tasks follows the number of pieces, so waste (a few open sequences a task) stays in proportion.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shape = f"doc_id {id_type(rows)}, {PIECES}" + ", ids binary" * with_ids
    pieces = cut(arrow_map(rows, lambda it: encode_pieces(it, tokenizer_path, capacity, end_id, with_ids, lean), shape))
    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    # dealt in turn, whatever the ids: repeated or null ones don't meet in one task
    return arrow_map(pieces.repartition(tasks), lambda it: pack_batches(it, capacity), f"{shape}, sequence_id long, offset long")
