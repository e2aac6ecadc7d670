"""Phrases of two and more words that stand together more often than their parts suggest.

Method: stripes. A prefix keys an associative counter of what follows it. Every
block of documents counts its own stripes, the buckets merge the stripes of all
blocks elementwise, and what has the asked-for count after that is a phrase. One
merged structure holds all that is needed: its entries are the extensions, a
prefix is itself an entry of the round before, which is its total, and the
greatest entry of a stripe, with that of the mirrored one, decides which phrases
a longer one subsumes.

Rounds go from words to longer phrases. A phrase is frequent only if its first
and its last words but one are, so a round counts just those places where two
frequent phrases of the round before overlap. Both get their number from the
bucket that counted them; a number stands for exactly one phrase, so the pair
(phrase without its last word, phrase without its first one) is an exact key, and
the second tells which word follows the first. The stripe of a frequent prefix is
dealt over all buckets by what follows, so no task has to hold it whole.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.blocks import aligned, by_block, n_buckets, prepare, rows, to_blocks, unpack
from creditloom.llm.words import hashes
from creditloom.session import settle

LEAST_COUNT = 30
LONGEST = 4
TOP = 2_000
SUBSUMED_PERCENT = 80
UNKNOWN = "und"
_PARTS = 64  # in which each language's phrases are ranked before the last ranking

# ASCII upper case as lower case; what ends a piece as a line feed, what separates words as a space.
_SEPARATED = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_EMPTY, _BREAK = 0, 1

_ZSTD = pa.Codec("zstd")


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: like bytes of neighbours side by side, then compressed."""
    flat = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + _ZSTD.compress(flat, asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    flat = _ZSTD.decompress(data[8:], 8 * n, asbytes=True)
    return np.frombuffer(flat, np.uint8).reshape(8, n).T.copy().view("<i8").reshape(n)


def _increasing(values: np.ndarray) -> bytes:
    return _squeeze(np.diff(values, prepend=0))


def _from_increasing(data: bytes) -> np.ndarray:
    return np.cumsum(_unsqueeze(data))


class _Tokens:
    """The words of a block: per language one row of numbers, in which 1 ends a piece."""

    def __init__(self, payload: bytes):
        table = unpack(payload)
        texts = defaultdict(list)
        for lang, text in zip(table["lang"].to_pylist(), table["text"].to_pylist()):
            if text:
                texts[lang].append(text)
        self.keys: list[bytes] = []
        codes, amounts = [], []
        for lang in sorted(texts):
            number = defaultdict(count(2).__next__)
            number[b""], number[b"\n"] = _EMPTY, _BREAK
            own = []
            for text in texts[lang]:
                words = text.encode().translate(_SEPARATED).replace(b"\n", b" \n ").split(b" ")
                words.append(b"\n")
                found = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                own.append(found[found != _EMPTY])
            own = np.concatenate(own)
            amounts.append(np.bincount(own, minlength=len(number))[2:])
            codes.append(np.where(own == _BREAK, -1, own - 2 + len(self.keys)))
            # A word has no space, so the first one ends it.
            suffix = b" " + lang.encode()
            self.keys += [word + suffix for word in list(number)[2:]]
        self.codes = np.concatenate(codes) if codes else np.empty(0, np.int64)
        self.amounts = np.concatenate(amounts) if amounts else np.empty(0, np.int64)
        self.hashed = hashes(self.keys)


def _dealt(hashed: np.ndarray, buckets: int):
    """Order by bucket, and (bucket, start, end) of each part."""
    where = (hashed % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    edges = np.flatnonzero(np.diff(where[order], prepend=-1))
    return order, [(int(where[order[a]]), a, b) for a, b in pairwise([*edges.tolist(), len(where)])]


def _pair_hash(prefix: np.ndarray, follows: np.ndarray) -> np.ndarray:
    out = prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + follows.astype(np.uint64)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _answer(ids: np.ndarray) -> bytes:
    frequent = ids >= 0
    return np.packbits(frequent).tobytes() + ids[frequent].astype("<i8").tobytes()


def _ids(out: bytes, n: int) -> np.ndarray:
    head = (n + 7) // 8
    ids = np.full(n, -1, np.int64)
    ids[np.unpackbits(np.frombuffer(out[:head], np.uint8), count=n).astype(bool)] = np.frombuffer(out[head:], "<i8")
    return ids


def _numbered(bucket: int, frequent: np.ndarray, buckets: int) -> np.ndarray:
    """A number for each frequent entry of a bucket that no other bucket gives, -1 for the rest."""
    ids = np.full(len(frequent), -1, np.int64)
    ids[frequent] = np.arange(int(frequent.sum())) * buckets + bucket
    return ids


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


ANSWER = "block long, bucket int, out binary, found binary"
WORD = "id long, lang string, word string, f long"
PAIR = "id long, prefix long, follows long, f long"


def _out(bucket: pa.Table, answers: list[bytes], found: pa.RecordBatch) -> pa.Table:
    """The answers to the blocks of a bucket, and one more row with what is frequent in it."""
    return pa.table({
        "block": pa.concat_arrays([bucket["block"].combine_chunks(), pa.array([-1], pa.int64())]),
        "bucket": pa.array([bucket["bucket"][0].as_py()] * (len(answers) + 1), pa.int32()),
        "out": pa.array([*answers, None], pa.binary()), "found": pa.array([None] * len(answers) + [_ipc(found)], pa.binary())})


def _tabled(answered: DataFrame, schema: str) -> DataFrame:
    def read(batches):
        for (data,) in rows(batches):
            yield from pa.ipc.open_stream(data).read_all().to_batches()

    return answered.where("block = -1").select("found").mapInArrow(read, schema)


def _to_blocks(answered: DataFrame) -> DataFrame:
    return by_block(answered.where("block >= 0").select("block", "bucket", "out"))


def _frequent_words(blocks: DataFrame, least: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Answers to the blocks, and the frequent words with a row of id -1 for the words of a language in a bucket."""
    def send(batches):
        for block, payload in rows(batches):
            own = _Tokens(payload)
            order, parts = _dealt(own.hashed, buckets)
            amounts = own.amounts[order]
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()),
                pa.array([[own.keys[i] for i in order[a:b]] for _, a, b in parts], pa.list_(pa.binary())),
                pa.array([_squeeze(amounts[a:b]) for _, a, b in parts], pa.binary())], ["bucket", "block", "keys", "amounts"])

    def merge(bucket: pa.Table) -> pa.Table:
        lists = bucket["keys"].combine_chunks()
        ends = lists.offsets.to_numpy()
        encoded = pc.dictionary_encode(lists.flatten())
        at, keys = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
        own = np.concatenate([_unsqueeze(x) for x in bucket["amounts"].to_pylist()])
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, own)
        by_key = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        ids = np.empty(len(keys), np.int64)
        ids[by_key] = _numbered(bucket["bucket"][0].as_py(), total[by_key] >= least, buckets)
        parts = [key.decode().split(" ", 1) for key in keys]
        every = defaultdict(int)
        for (_, lang), n in zip(parts, total.tolist()):
            every[lang] += n
        frequent = np.flatnonzero(ids >= 0).tolist()
        found = pa.RecordBatch.from_arrays([
            pa.array([int(ids[i]) for i in frequent] + [-1] * len(every), pa.int64()),
            pa.array([parts[i][1] for i in frequent] + list(every), pa.string()),
            pa.array([parts[i][0] for i in frequent] + [None] * len(every), pa.string()),
            pa.array([int(total[i]) for i in frequent] + list(every.values()), pa.int64())], ["id", "lang", "word", "f"])
        return _out(bucket, [_answer(ids[at[a:b]]) for a, b in pairwise(ends.tolist())], found)

    keyed = blocks.select("block", "payload").mapInArrow(send, "bucket int, block long, keys array<binary>, amounts binary")
    answered = settle(keyed.groupBy("bucket").applyInArrow(merge, ANSWER))

    def place(batches):
        for block, payload, found in rows(batches):
            own = _Tokens(payload)
            ids = aligned(own.hashed, found, buckets, _ids, np.int64)
            here = np.flatnonzero(own.codes >= 0)
            word = ids[own.codes[here]]
            yield _state(block, here[word >= 0], word[word >= 0])

    joined = blocks.select("block", "payload").join(_to_blocks(answered), "block")
    return settle(joined.mapInArrow(place, STATE)), settle(_tabled(answered, WORD))


STATE = "block long, places binary, ids binary"


def _state(block: int, places: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_increasing(places)], pa.binary()),
                                       pa.array([_squeeze(ids)], pa.binary())], ["block", "places", "ids"])


class _Overlaps:
    """The places of a block where two frequent phrases overlap in all but one word, and its stripes."""

    def __init__(self, places: bytes, ids: bytes, buckets: int):
        places, ids = _from_increasing(places), _unsqueeze(ids)
        next_to = np.flatnonzero(places[1:] == places[:-1] + 1)
        self.places = places[next_to]
        prefix, follows = ids[next_to], ids[next_to + 1]
        order = np.lexsort((follows, prefix))
        prefix, follows = prefix[order], follows[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (prefix[1:] != prefix[:-1]) | (follows[1:] != follows[:-1])
        first = np.flatnonzero(fresh)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(fresh) - 1
        self.prefix, self.follows = prefix[first], follows[first]
        self.amounts = np.diff(np.append(first, len(order)))
        self.hashed = _pair_hash(self.prefix, self.follows)
        self.buckets = buckets

    def stripes(self, block: int) -> pa.RecordBatch:
        order, parts = _dealt(self.hashed, self.buckets)
        columns = [[(_increasing if c is self.prefix else _squeeze)(c[order[a:b]]) for _, a, b in parts]
                   for c in (self.prefix, self.follows, self.amounts)]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()),
             *[pa.array(c, pa.binary()) for c in columns]], ["bucket", "block", "prefix", "follows", "amounts"])


def _longer(state: DataFrame, least: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """One word more: the places and numbers of frequent phrases, and these phrases (id, prefix, follows, f)."""
    def send(batches):
        for block, places, ids in rows(batches):
            yield _Overlaps(places, ids, buckets).stripes(block)

    def merge(bucket: pa.Table) -> pa.Table:
        parts = [_from_increasing(x) for x in bucket["prefix"].to_pylist()]
        prefix = np.concatenate(parts)
        follows = np.concatenate([_unsqueeze(x) for x in bucket["follows"].to_pylist()])
        own = np.concatenate([_unsqueeze(x) for x in bucket["amounts"].to_pylist()])
        order = np.lexsort((follows, prefix))
        a, b = prefix[order], follows[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        total = np.add.reduceat(own[order], first)
        ids = _numbered(bucket["bucket"][0].as_py(), total >= least, buckets)
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(ids, np.diff(np.append(first, len(order))))
        frequent = ids >= 0
        found = pa.RecordBatch.from_arrays(
            [pa.array(x[frequent], pa.int64()) for x in (ids, a[first], b[first], total)], ["id", "prefix", "follows", "f"])
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        return _out(bucket, [_answer(each[x:y]) for x, y in pairwise(ends)], found)

    keyed = state.mapInArrow(send, "bucket int, block long, prefix binary, follows binary, amounts binary")
    answered = settle(keyed.groupBy("bucket").applyInArrow(merge, ANSWER))

    def place(batches):
        for block, places, ids, found in rows(batches):
            own = _Overlaps(places, ids, buckets)
            number = aligned(own.hashed, found, buckets, _ids, np.int64)[own.which]
            yield _state(block, own.places[number >= 0], number[number >= 0])

    joined = state.join(_to_blocks(answered), "block")
    return settle(joined.mapInArrow(place, STATE)), settle(_tabled(answered, PAIR))


def _least_cut():
    """score, k, l, r of the first cut with the least score, out of f, heads and tails; products go through decimals."""
    return F.expr("""array_min(transform(sequence(1, size(heads) - 1), k -> named_struct(
        'score', cast(2000000 as decimal(7, 0)) * cast(f as decimal(20, 0)) div
                 (cast(heads[k - 1] as decimal(20, 0)) + cast(tails[size(heads) - k - 1] as decimal(20, 0))),
        'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k - 1])))""")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP,
                 subsumed_percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language of `docs` (lang, text).

    a is how often the phrase occurs, n how many words the language has. The cut
    with the least floor(2000000 a / (l + r)) counts, where l and r are how often
    the words before and behind it occur together; among equal ones, the first.
    Phrases inside a longer one with at least `subsumed_percent` of their count
    are left out. A null lang is `und`, together with texts that say so; null and
    empty texts have no words; repeated rows count as often as they stand there.
    Ties go by phrase in byte order. An empty table, or one without a phrase that
    is frequent enough, gives no rows. Other columns are ignored, whatever their
    names. A long text is a block of its own.
    """
    spark = prepare(docs.sparkSession)
    blocks = to_blocks(docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text"), "lang", "text")
    buckets = n_buckets(blocks, 14)
    state, words = _frequent_words(blocks, least, buckets)
    sizes = words.where("id = -1").groupBy("lang").agg(F.sum("f").alias("n"))
    # heads: counts of the first one, two, ... words; tails: of the last one, two, ... words.
    known = words.where("id >= 0").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"),
                                          "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    found = []
    for _ in range(2, longest + 1):
        state, pairs = _longer(state, least, buckets)
        if found:
            greatest = pairs.select(F.col("prefix").alias("id"), "f").union(pairs.select("follows", "f")).groupBy("id").agg(
                F.max("f").alias("longer"))
            found[-1] = found[-1].join(greatest, "id", "left")
        before = known.select(F.col("id").alias("prefix"), "lang", "phrase", "heads")
        behind = known.select(F.col("id").alias("follows"), "last", "tails")
        known = settle(pairs.join(before, "prefix").join(behind, "follows").select(
            "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails")))
        found.append(known)
    if not found:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found[-1] = found[-1].withColumn("longer", F.lit(None).cast("long"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    kept = every.where(F.expr(f"longer IS NULL OR 100 * longer < {int(subsumed_percent)} * f")).withColumn("cut", _least_cut()).select(
        "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language can hold most phrases: the best of its parts first, then the best of these.
    part = F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))
    kept = kept.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(
        F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
