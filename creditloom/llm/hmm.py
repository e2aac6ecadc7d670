"""Language-model scores from a hidden Markov model.

Method: Baum-Welch. The expected state, transition and emission counts of every
training document are summed in each task, aggregated by Spark across tasks, and
give the next round's model. A text's score is its exact likelihood by the
scaled forward recursion.

The vocabulary grows with the corpus, the model does not: states emit word
classes (the most frequent tokens have a class each, the others share classes by
hash), and a class emits its tokens in proportion to their counts plus one, with
one unknown token per shared class. Token counts over the whole corpus come from
an exchange between blocks of documents (blocks.py); a token is told apart by a
64-bit hash.

Both recursions run over all chunks of `CHUNK` tokens of a block at once: a
chunk's steps multiply to one small matrix, the matrices carry the state from
chunk to chunk, and then the steps inside are filled in.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.blocks import KEYED, aligned, by_block, combine, keyed_rows, n_buckets, prepare, rows, to_blocks, unpack
from creditloom.llm.words import distinct, hashes, spaced_lower
from creditloom.session import settle

STATES = 4
ROUNDS = 6
OWN_CLASSES = 60_000  # with the shared ones below 2^16, as classes are stored in two bytes
SHARED_CLASSES = 256
CHUNK = 32
SMOOTHING = 0.1
END = b"\n"  # no word contains it


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class _Tokens:
    """A block's tokens, each document's end included."""

    def __init__(self, payload: bytes):
        table = unpack(payload)
        self.ids = table["doc_id"]
        self.training = np.array([not is_held_out(i) for i in self.ids.to_pylist()], bool)
        hashed = [hashes([*spaced_lower(t), END]) for t in table["text"].to_pylist()]
        self.lengths = np.array([len(h) for h in hashed], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.hashed = np.concatenate(hashed)
        self.keys, order, first = distinct(self.hashed)
        self.which = np.empty(len(self.hashed), np.int64)
        self.which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))

    def training_counts(self) -> np.ndarray:
        return np.bincount(self.which[np.repeat(self.training, self.lengths)], minlength=len(self.keys))


class Classes:
    """The class of each token and the weight it has in its class."""

    def __init__(self, own: np.ndarray, shared_tokens: np.ndarray, shared_kinds: np.ndarray):
        self.own = np.sort(own)
        # Each shared class holds its tokens' counts plus one each, and one for an unknown token.
        self.mass = shared_tokens + shared_kinds + 1.0

    def __len__(self):
        return len(self.own) + SHARED_CLASSES

    def of(self, keys: np.ndarray) -> np.ndarray:
        shared = len(self.own) + (keys % np.uint64(SHARED_CLASSES)).astype(np.int64)
        if not len(self.own):
            return shared
        at = np.minimum(np.searchsorted(self.own, keys), len(self.own) - 1)
        return np.where(self.own[at] == keys, at, shared)

    def log10_in_class(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(classes))
        shared = classes >= len(self.own)
        out[shared] = np.log10((counts[shared] + 1.0) / self.mass[classes[shared] - len(self.own)])
        return out


class Model:
    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit
        self.top = emit.max(axis=0)
        self.scaled = np.ascontiguousarray((emit / self.top).T)  # by class, the likeliest state has 1
        self.log_top = np.log(self.top)

    @staticmethod
    def initial(class_counts: np.ndarray, states: int = STATES) -> "Model":
        """Class frequencies, tilted by fixed amounts so that the states differ."""
        n = len(class_counts)
        tilt = 0.5 + ((np.arange(states)[:, None] * 2654435761 + np.arange(n)[None, :] * 40503 + 12345) % 65536) / 65536
        emit = (class_counts + 1.0) * tilt
        step = np.full((states, states), 0.4 / max(1, states - 1))
        np.fill_diagonal(step, 0.6 if states > 1 else 1.0)
        return Model(np.full(states, 1.0 / states), step, emit / emit.sum(axis=1, keepdims=True))

    def next(self, counts: np.ndarray) -> "Model":
        """The model that expected counts give: start, transitions and emissions end to end."""
        k, n = self.emit.shape
        start, step, emit = counts[:k], counts[k:k + k * k].reshape(k, k), counts[k + k * k:].reshape(k, n)

        def share(x):
            return (x + SMOOTHING) / (x + SMOOTHING).sum(axis=-1, keepdims=True)

        return Model(share(start), share(step), share(emit))


class Lanes:
    """Sequences cut into chunks, the longest chunks first, so those still running are always a front part."""

    def __init__(self, classes: np.ndarray, lengths: np.ndarray):
        per_doc = -(-lengths // CHUNK)
        self.doc = np.repeat(np.arange(len(lengths)), per_doc)
        ordinal = np.arange(len(self.doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        begin = np.repeat(np.cumsum(lengths) - lengths, per_doc) + ordinal * CHUNK
        size = np.minimum(CHUNK, np.repeat(lengths, per_doc) - ordinal * CHUNK)
        order = np.argsort(-size, kind="stable")
        self.doc, ordinal, begin, size = self.doc[order], ordinal[order], begin[order], size[order]
        self.running = [int(np.searchsorted(-size, -t, side="left")) for t in range(CHUNK)]
        self.classes = [classes[begin[:m] + t] for t, m in enumerate(self.running)]
        self.first = np.flatnonzero(ordinal == 0)
        by_ordinal = np.argsort(ordinal, kind="stable")
        self.rounds = np.split(by_ordinal, np.cumsum(np.bincount(ordinal))[:-1]) if len(ordinal) else []
        self.n_docs = len(lengths)

    def products(self, model: Model):
        """The product of each chunk's steps, scaled, and the logarithm of the scale."""
        k = len(model.start)
        out = np.empty((len(self.doc), k, k))
        out[:] = model.step
        out[self.first] = model.start  # whatever comes before a document, its first state is drawn from start
        out *= model.scaled[self.classes[0]][:, None, :]
        logs = np.zeros(len(self.doc))
        for t in range(1, CHUNK):
            m = self.running[t]
            if not m:
                break
            out[:m] = (out[:m].reshape(-1, k) @ model.step).reshape(m, k, k) * model.scaled[self.classes[t]][:, None, :]
            if t % 8 == 7:
                scale = out[:m].sum(axis=(1, 2))
                out[:m] /= scale[:, None, None]
                logs[:m] += np.log(scale)
        return out, logs

    def forward(self, model: Model):
        """State before each chunk, the chunks' products, and each document's log likelihood."""
        products, logs = self.products(model)
        before = np.empty((len(self.doc), len(model.start)))
        now = np.zeros((self.n_docs, len(model.start)))
        now[:, 0] = 1.0
        total = np.zeros(self.n_docs)
        for lanes in self.rounds:
            docs = self.doc[lanes]
            before[lanes] = now[docs]
            after = np.matmul(now[docs][:, None, :], products[lanes])[:, 0]
            scale = after.sum(axis=1)
            now[docs] = after / scale[:, None]
            total[docs] += np.log(scale) + logs[lanes]
        np.add.at(total, self.doc, sum_by_lane(self, model))
        return before, products, total

    def expected(self, model: Model) -> np.ndarray:
        """Baum-Welch counts: start, transitions and emissions end to end."""
        k, n = model.emit.shape
        before, products, _ = self.forward(model)
        after = np.empty_like(before)
        now = np.ones((self.n_docs, k))
        for lanes in reversed(self.rounds):
            docs = self.doc[lanes]
            after[lanes] = now[docs]
            back = np.matmul(products[lanes], now[docs][:, :, None])[:, :, 0]
            now[docs] = back / back.sum(axis=1, keepdims=True)
        came, due = [], []  # the state before each step, and what the step expects
        state = before
        for t, m in enumerate(self.running):
            if not m:
                break
            state = state[:m]
            expect = state @ model.step
            if t == 0:
                expect[self.first] = model.start
            came.append(state)
            due.append(expect)
            state = expect * model.scaled[self.classes[t]]
            state /= state.sum(axis=1, keepdims=True)
        start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, n))
        inside = np.ones(len(self.doc), bool)
        inside[self.first] = False
        for t in range(len(came) - 1, -1, -1):
            m = self.running[t]
            ahead = model.scaled[self.classes[t]] * after[:m]
            gamma = due[t] * ahead
            whole = gamma.sum(axis=1, keepdims=True)
            gamma /= whole
            for s in range(k):
                emit[s] += np.bincount(self.classes[t], weights=gamma[:, s], minlength=n)
            left = came[t] / whole
            if t == 0:
                start += gamma[self.first].sum(axis=0)
                left = left * inside[:, None]
            step += model.step * (left.T @ ahead)
            back = ahead @ model.step.T
            after[:m] = back / back.sum(axis=1, keepdims=True)
        return np.concatenate([start, step.ravel(), emit.ravel()])


def sum_by_lane(lanes: Lanes, model: Model) -> np.ndarray:
    out = np.zeros(len(lanes.doc))
    for t, m in enumerate(lanes.running):
        out[:m] += model.log_top[lanes.classes[t]]
    return out


def _counted(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, out) with the training counts of a block's tokens, and per bucket, under no block,
    its most frequent tokens and the tokens and kinds in each shared class."""
    def send(batches):
        for block, payload in rows(batches):
            tokens = _Tokens(payload)
            yield keyed_rows(block, tokens.keys, tokens.training_counts(), buckets)

    pair = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64())]))

    def add(bucket: pa.Table) -> pa.Table:
        keys, _, combined, parts, each = combine(bucket, np.add)
        out = [combined[a:b].tobytes() for a, b in parts]
        keys, counts = keys[each], combined[each]
        keys, counts = keys[counts > 0], counts[counts > 0]
        largest = np.lexsort((keys, -counts))[:OWN_CLASSES]
        top = [{"key": int(k), "n": int(n), "kinds": 1} for k, n in zip(keys[largest].view(np.int64), counts[largest])]
        shared = (keys % np.uint64(SHARED_CLASSES)).astype(np.int64)
        in_class, kinds = np.bincount(shared, weights=counts, minlength=SHARED_CLASSES), np.bincount(shared, minlength=SHARED_CLASSES)
        classes = [{"key": i, "n": int(in_class[i]), "kinds": int(kinds[i])} for i in np.flatnonzero(kinds).tolist()]
        n = len(out)
        return pa.table({
            "block": pa.array([*bucket["block"].to_pylist(), None], pa.int64()), "bucket": pa.array([bucket["bucket"][0].as_py()] * (n + 1), pa.int32()),
            "out": pa.array([*out, None], pa.binary()), "top": pa.array([None] * n + [top], pair), "classes": pa.array([None] * n + [classes], pair)})

    pairs = "array<struct<key:long,n:long,kinds:long>>"
    keyed = blocks.select("block", "payload").mapInArrow(send, KEYED)
    return settle(keyed.groupBy("bucket").applyInArrow(add, f"block long, bucket int, out binary, top {pairs}, classes {pairs}"))


def _from_int64(out: bytes, n: int) -> np.ndarray:
    return np.frombuffer(out, np.int64, n)


def _classes(counted: DataFrame) -> tuple[Classes, np.ndarray, int, int]:
    """The classes, the training tokens in each, and N and V."""
    none = counted.where("block is null")
    top = none.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "key").limit(OWN_CLASSES).collect()
    own = {int(np.int64(r["key"]).view(np.uint64)): r["n"] for r in top}
    tokens, kinds = np.zeros(SHARED_CLASSES), np.zeros(SHARED_CLASSES)
    for r in none.select(F.explode("classes").alias("c")).select("c.*").groupBy("key").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        tokens[r["key"]], kinds[r["key"]] = r["n"], r["kinds"]
    n, v = int(tokens.sum()), int(kinds.sum())
    for key, count in own.items():
        tokens[key % SHARED_CLASSES] -= count
        kinds[key % SHARED_CLASSES] -= 1
    classes = Classes(np.array(sorted(own), np.uint64), tokens, kinds)
    return classes, np.concatenate([[own[k] for k in sorted(own)], tokens]), n, v


def train(sequences: DataFrame, class_counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over settled rows (classes, n, lengths, training) of all blocks."""
    model = Model.initial(class_counts, states)
    spark = sequences.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches):
            counts = None
            for packed, n, lengths, training in rows(batches):
                classes = np.frombuffer(pa.decompress(packed, 2 * n, "zstd"), np.uint16)
                lengths, learn = np.frombuffer(lengths, np.int64), np.frombuffer(training, bool)
                found = Lanes(classes[np.repeat(learn, lengths)], lengths[learn]).expected(shared.value) if learn.any() else 0
                counts = found if counts is None else counts + found
            if counts is not None and np.ndim(counts):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], ["at", "n"])

        got = sequences.select("classes", "n", "lengths", "training").mapInArrow(expect, "at long, n double") \
            .groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        if not len(got):
            break
        counts = np.zeros(states + states * states + states * len(class_counts))
        counts[got["at"]] = got["n"]
        model = model.next(counts)
    return model


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of `docs`.

    A null or empty text is its end token alone. A null doc_id is learned from.
    Repeated rows are learned from and scored as often as they stand there. With
    nothing to learn from, every token is unknown. An empty table gives no rows.
    Other columns are ignored, whatever their names. A very long text is a block of
    its own; the recursions run over its chunks.
    """
    prepare(docs.sparkSession)
    blocks = to_blocks(docs, "doc_id", "text")
    buckets = n_buckets(blocks, 30)
    counted = _counted(blocks, buckets)
    classes, class_counts, n_all, n_kinds = _classes(counted)

    def look_up(batches):
        for payload, found in rows(batches):
            tokens = _Tokens(payload)
            counts = aligned(tokens.keys, found, buckets, _from_int64, np.int64)
            kind = classes.of(tokens.keys)
            base = np.log10((counts + 1.0) / (n_all + n_kinds + 1.0))
            inside = classes.log10_in_class(kind, counts)
            # Sums by document: every document has its end token at least.
            sums = [np.add.reduceat(x[tokens.which], tokens.starts) for x in (base, inside, (counts > 0).astype(np.int64))]
            sequence = kind[tokens.which].astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                pa.array([pa.compress(sequence.tobytes(), "zstd", asbytes=True)]), pa.array([len(sequence)], pa.int64()),
                pa.array([tokens.lengths.tobytes()]), pa.array([tokens.training.tobytes()]),
                pa.array([tokens.ids.to_pylist()], pa.list_(pa.int64())), pa.array([sums[0].tolist()], pa.list_(pa.float64())),
                pa.array([sums[1].tolist()], pa.list_(pa.float64())), pa.array([sums[2].tolist()], pa.list_(pa.int64()))],
                ["classes", "n", "lengths", "training", "ids", "base", "inside", "known"])

    sequences = settle(blocks.select("block", "payload").join(by_block(counted.where("block is not null").select("block", "bucket", "out")), "block", "left")
                       .select("payload", "answers").mapInArrow(
        look_up, "classes binary, n long, lengths binary, training binary, ids array<long>, base array<double>, inside array<double>, known array<long>"))
    model = docs.sparkSession.sparkContext.broadcast(train(sequences, class_counts, states, rounds))

    def score(batches):
        for packed, n, lengths, training, ids, base, inside, known in rows(batches):
            lengths = np.frombuffer(lengths, np.int64)
            _, _, total = Lanes(np.frombuffer(pa.decompress(packed, 2 * n, "zstd"), np.uint16), lengths).forward(model.value)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(~np.frombuffer(training, bool)), pa.array(lengths), pa.array(known, pa.int64()),
                pa.array([n_all] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(total / np.log(10) + np.array(inside))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return sequences.mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
