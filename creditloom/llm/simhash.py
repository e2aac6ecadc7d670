"""Near-duplicates by SimHash, linked at 3 or fewer differing bits.

Method: segment-popcount embedding. A fingerprint is cut into 16 segments and
mapped to the vector of their bit counts. Flipping one bit moves one coordinate
by one, so fingerprints 3 bits apart have vectors at most 3 apart in Manhattan
distance. The grid range-join finds all such vectors: of a pair, let x be the
one with no more bits set. Then y is reached from x by u steps up and d steps
down, u >= d and u + d <= 3, so both meet in a cell: x offers itself and every
cell up to two steps up, y looks into its own cell and those one step up or
down. Each cell's members are then compared bit by bit.

Only distinct fingerprints enter the join. A cell answers with a forest that
links its members, never with all pairs, and components are joined up across
cells by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.blocks import pieces, prepare
from creditloom.llm.words import spaced_lower
from creditloom.session import settle

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = 16
SPREAD_ROWS, CELL_ROWS = 100_000, 50_000  # fingerprints for each task that spreads them, and that compares cells
GOES_ROWS = 1_000_000  # keys of rows that go, 24 MB, up to which the texts are filtered where they lie
_CHUNK = 1 << 16


def fingerprint(words: list[bytes]) -> int:
    """Bit k is set if it is set in over half of the shingles' hashes; 0 without words."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - SHINGLE + 1)
    begin, end = np.append(0, ends)[:n].tolist(), (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, end)), "<u8", n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = hashed[i:i + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row, and the long columns `keys` as they are."""
    def of(batches):
        for table in pieces(batches, "text"):
            values = np.array([fingerprint(spaced_lower(t)) for t in table["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[table[c].combine_chunks().cast(pa.int64()) for c in ("doc_id", *keys)],
                                              pa.array(values.view(np.int64))], ["doc_id", *keys, "fp"])

    return docs.select("doc_id", *keys, "text").mapInArrow(of, ", ".join(f"`{c}` long" for c in ("doc_id", *keys, "fp")))


def _cells(values: np.ndarray, segments: int):
    """(cell, which value, looks) for every cell a fingerprint offers itself to or looks into."""
    width = 64 // segments
    field = width.bit_length()
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.reshape(len(values), segments, width).sum(axis=2, dtype=np.int64)
    step = np.int64(1) << (field * np.arange(segments, dtype=np.int64))
    home = counts @ step
    everyone = np.arange(len(values))
    cells, owner, looks = [home, home], [everyone, everyone], [False, True]
    for i in range(segments):
        up, down = counts[:, i] < width, counts[:, i] > 0
        for inside, by, look in ((up, step[i], False), (up, step[i], True), (down, -step[i], True)):
            cells.append(home[inside] + by)
            owner.append(everyone[inside])
            looks.append(look)
    for i, j in combinations_with_replacement(range(segments), 2):
        inside = (counts[:, i] + 1 + (i == j) <= width) & (counts[:, j] < width)
        cells.append(home[inside] + step[i] + step[j])
        owner.append(everyone[inside])
        looks.append(False)
    look = np.repeat(looks, [len(c) for c in cells])
    return np.concatenate(cells), np.concatenate(owner), look


def _forest(values: np.ndarray, most: int):
    """Links that connect the values at most `most` bits apart, one fewer than a component's size."""
    left, links = values, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= most
            if near.any():
                found = left[near]
                links += [(int(at), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return links


def links(values: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """a, b: links between distinct fingerprints `fp` that connect all within `max_bits` (3 at most).

    The links span the same components as all pairs would, without listing them.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the cells cover up to 3 differing bits")

    def spread(batches):
        for batch in batches:
            values = batch.column("fp").to_numpy()
            for i in range(0, len(values), 500):
                cells, owner, look = _cells(values[i:i + 500], segments)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(values[i:i + 500][owner]), pa.array(look)],
                                                 ["cell", "fp", "looks"])

    def compare(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "looks"))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            if held[0][0] == held[0][-1]:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on in the next batch
            yield _within(tuple(x[:cut] for x in held), max_bits)
            held = tuple(x[cut:] for x in held)
        if held is not None:
            yield _within(held, max_bits)

    # A fingerprint becomes 166 rows, so both steps get their tasks by the number of fingerprints.
    n, shuffles = values.count(), int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread_out = values.select("fp").repartition(max(shuffles, n // SPREAD_ROWS)).mapInArrow(spread, "cell long, fp long, looks boolean")
    return (spread_out.repartition(max(shuffles, n // CELL_ROWS), "cell").sortWithinPartitions("cell")
            .mapInArrow(compare, "a long, b long").distinct())


def _within(rows, max_bits: int) -> pa.RecordBatch:
    cell, fp, looks = rows
    edges = np.append(np.flatnonzero(np.diff(cell, prepend=cell[0] - 1)), len(cell))
    lookers = np.add.reduceat(looks.astype(np.int64), edges[:-1])
    sizes = np.diff(edges)
    found = []
    for k in np.flatnonzero((sizes > 1) & (lookers > 0) & (lookers < sizes)).tolist():
        found += _forest(np.unique(fp[edges[k]:edges[k + 1]]), max_bits)
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                                      ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge (a, b): root is the smallest node it is connected to."""
    def hang(pairs: DataFrame, both: bool) -> DataFrame:
        # Everyone next to a node is hung below the smallest node around it.
        if both:
            pairs = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        around = pairs.join(least.select("a", F.least("a", "m").alias("m")), "a")
        if both:
            moved = around.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = around.select(F.col("b").alias("a"), F.col("m").alias("b")).union(around.select("a", F.col("m").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    mark = [F.count("*"), F.bit_xor(F.xxhash64("a", "b"))]
    pairs = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while (now := tuple(pairs.agg(*mark).first())) != before:
        before = now
        pairs = settle(hang(hang(pairs, True), False))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())


def simhash_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id for every row of `docs` (doc_id, text).

    Null and empty texts have fingerprint zero and link to it like any other.
    Equal fingerprints are one component. Rows repeating a doc_id all appear; a
    null doc_id gets its component but never names one (a component of null ids
    alone has a null component_id). An empty table gives no rows. Other columns are
    ignored, whatever their names. A very long text is hashed whole, in parts.
    """
    prepare(docs.sparkSession)
    found = settle(fingerprints(docs))
    rooted = _rooted(settle(found.groupBy("fp").agg(F.min("doc_id").alias("first_id"))), max_bits)
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return found.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _rooted(per_value: DataFrame, max_bits: int) -> DataFrame:
    """Adds `root`, the smallest fingerprint that can be reached, to rows with a distinct `fp` each."""
    joined = components(links(per_value, max_bits)).withColumnRenamed("node", "fp")
    return settle(per_value.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _row_hash(docs: DataFrame):
    """A hash of all columns; nulls count by where they stand, maps as text."""
    values = [F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*values, *[v.isNull() for v in values])


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of `docs` per component, all columns: that with the smallest doc_id, then the smallest hash of its text and of the row.

    Rows are told apart by all of their columns, so rows that share a doc_id stay
    or go each by their own text. A row without doc_id stands behind all that have
    one. Rows equal in every column are one row; null and empty texts are one
    component. Reruns keep the same rows. An empty table gives no rows. Column
    names do not matter but for doc_id and text.
    """
    prepare(docs.sparkSession)
    text_key, row_key = "_text_key", "_row_key"
    while {text_key, row_key} & set(docs.columns):
        text_key, row_key = f"_{text_key}", f"_{row_key}"
    keyed = docs.withColumns({text_key: F.xxhash64("text"), row_key: _row_hash(docs)})
    found = settle(fingerprints(keyed, text_key, row_key))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", text_key, row_key)
    rooted = _rooted(settle(found.groupBy("fp").agg(F.min(place).alias("first"))), max_bits)
    stays = settle(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a[text_key] == b[text_key]) & (a[row_key] == b[row_key])
    # Usually fewer rows go than stay, and the fewer are joined with the texts.
    goes = settle(found.join(stays, same(found, stays), "left_anti").select("doc_id", text_key, row_key).distinct())
    # Without the hint Spark shuffles the texts to find the few that go.
    small = F.broadcast(goes) if goes.count() <= GOES_ROWS else goes
    out = keyed.join(small, same(keyed, goes), "left_anti")
    if found.join(stays, same(found, stays), "left_semi").count() > stays.count():
        out = out.dropDuplicates(["doc_id", text_key, row_key])  # equal in every column
    return out.select(*docs.columns)
