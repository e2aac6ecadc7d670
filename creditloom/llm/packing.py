"""Packing tokenised documents into training sequences.

Method: best-fit decreasing. Documents longer than a sequence are first cut into
full windows; the pieces that remain are taken from the longest down, and each
goes into the open sequence it fits most tightly. A segment tree over remaining
capacities finds that sequence.

Pieces are dealt by a hash into packs of about `PACK_PIECES`, each packed on its
own: a pack's last few sequences are all that is lost against one global order.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.blocks import pieces, prepare
from creditloom.session import settle

LENGTH = 4096
END_ID = 2
PACK_PIECES = 8_192
VOCABULARY = "word_bpe_49k.json"
KEPT_WORDS = 300_000
_STOPS = frozenset(".,;:!?")
_BATCH_BYTES = 4_000_000


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTokenizer:
    """Token ids of whole texts, each distinct word of a batch tokenised once.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words in turn. The words met first are kept for later
    batches, `KEPT_WORDS` of them at most.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.ends_run = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_run[i] = token.endswith("</w>")
        self.kept = pa.array([], pa.string())
        self.flat, self.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _tokenise(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids end to end, and how many each has."""
        # A run of letters, or of other signs, is tokenised by itself and closes with a token
        # that says so; words of letters, and those with one stop behind, are told apart by these.
        runs = np.fromiter(map(_runs, words), np.int64, len(words))
        simple = [w for w, n in zip(words, runs.tolist()) if n]
        parts, sizes = [np.empty(0, np.uint32)], np.zeros(len(words), np.int64)
        if simple:
            lines = [" ".join(simple[i:i + 100]) for i in range(0, len(simple), 100)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            last = np.flatnonzero(self.ends_run[ids])[np.cumsum(runs[runs > 0]) - 1]
            sizes[runs > 0] = np.diff(last, prepend=-1)
            parts.append(ids)
        others = np.flatnonzero(runs == 0).tolist()
        for i, e in zip(others, self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False)):
            parts.append(np.array(e.ids, np.uint32))
            sizes[i] = len(parts[-1])
        # The ids stand with the simple words first; bring them into the words' order.
        flat = np.concatenate(parts)
        order = np.concatenate([np.flatnonzero(runs > 0), others]).astype(np.int64)
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(sizes[order]) - sizes[order]
        return _gather(flat, start, sizes), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin and end; null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, self.kept), -1).to_numpy().astype(np.int64)
        flat, begin = self.flat, self.begin
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = coded.dictionary.take(pa.array(fresh))
            ids, sizes = self._tokenise(new.to_pylist())
            at[fresh] = len(begin) - 1 + np.arange(len(new))
            flat, begin = np.concatenate([flat, ids]), np.append(begin, begin[-1] + np.cumsum(sizes))
            if room := min(len(new), KEPT_WORDS - len(self.kept)):
                self.kept = pa.concat_arrays([self.kept, new.slice(0, room)])
                self.begin = begin[:len(self.kept) + 1]
                self.flat = flat[:self.begin[-1]].copy()
        which = at[coded.indices.to_numpy()]
        size = begin[which + 1] - begin[which]
        ends = np.append(0, np.cumsum(size))
        return _gather(flat, begin[which], size), ends[np.append(0, np.cumsum(per_text))]


def _runs(word: str) -> int:
    """How many runs a plain word has: 1 of letters alone, 2 with one stop behind; 0 for any other word."""
    if word.lower().isalpha():
        return 1
    return 2 if word[-1:] in _STOPS and word[:-1].lower().isalpha() else 0


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - ends + size, size)]


@lru_cache(maxsize=2)
def _word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece: full windows, then what remains."""
    def run(batches):
        tokenizer = _word_tokenizer(tokenizer_path(vocabulary))
        for table in pieces(batches, "text", _BATCH_BYTES):
            rows = []
            flat, bounds = tokenizer.encode(table["text"].combine_chunks().cast(pa.string()))
            for i, doc_id in enumerate(table["doc_id"].to_pylist()):
                ids = np.append(flat[bounds[i]:bounds[i + 1]], np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start:start + length]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class OpenSequences:
    """Sequences by the room left in them, under a segment tree that counts them."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out (room, sequence) with the least room of at least `need`."""
        node = need + self.size
        if not self.count[node]:
            # Up to the first subtree to the right that is not empty, then down its left side.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._count(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length; sequences are numbered from 0."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms, opened = OpenSequences(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        got = rooms.tightest(need)
        if got is None:
            got, opened = (capacity, opened), opened + 1
        room, sequence[i] = got
        offset[i] = capacity - room
        if room > need:
            rooms.add(room - need, int(sequence[i]))
    return sequence, offset


def pack(cut_pieces: DataFrame, capacity: int = LENGTH, pack_pieces: int = PACK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32, ...)."""
    settled = settle(cut_pieces)
    packs = 1 + settled.count() // pack_pieces
    names = settled.columns

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit_decreasing(table["length"].to_numpy(), capacity)
        return table.select(names).append_column("sequence_id", pa.array((table["pack"].to_numpy() << 32) + sequence)).append_column(
            "offset", pa.array(offset))

    # The place in the written table sets apart pieces that are equal in everything else.
    dealt = settled.withColumn(
        "pack", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_metadata.row_index"), F.lit(packs)).cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in settled.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("pack").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of `docs` (doc_id, text).

    Each document ends with the end id, so a null or empty text is one piece of
    one token. Rows that repeat a doc_id or have none are packed like any other.
    Whole texts are tokenised, very long ones into many pieces; an empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    return pack(cut(docs, vocabulary))
