"""Near-duplicates by shared word shingles, linked at a Jaccard similarity of 0.85 or more.

Method: SetSketch registers. Register i of a set is floor(1 - log_b x), where x
is the least of the exponentially distributed hashes that its elements have for
i, cut to 16 bits: the minima are kept on an exponential scale. Registers of a
union are the greater ones of its parts, and two sets agree in a register about
as often as their similarity says.

1. Texts with the same shingles are one class; only classes go on.
2. Bands of six registers give 40 keys a class. Two sets at 0.85 share none with a
   probability below 1e-8.
3. The classes of a key are linked in three steps, never as all pairs of a group,
   and what one step connects the next ones do not compare. First each class is
   held against the least class of its keys, the likeliest one only. Then, in the
   keys that still hold several components, each class names its likeliest partner
   in another one. Last, the keys that are mixed even then are swept: all that can
   be linked across components is compared on the full sets, inside cells of
   bounded size, out of which only links come.
4. What goes on is decided by likelihood: how many registers are greater, equal
   and less is a trinomial of the similarity, given both sizes. A pair is left
   out where 0.85 is e^16 times less likely than the best estimate, or where the
   sizes exclude it. Of the keys that two classes share, the sweep uses only the
   first one.
5. Every link that counts is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.blocks import pieces, prepare, release
from creditloom.llm.simhash import components
from creditloom.llm.words import hashes, rolling, spaced_lower
from creditloom.session import settle

SHINGLE = 5
PERCENT = 85
BANDS, BAND_ROWS = 40, 6
REGISTERS = BANDS * BAND_ROWS
BASE, RATE = 1.001, 20.0
GREATEST = (1 << 16) - 1
DOUBT = 16.0           # a link is given up where it is e^DOUBT times less likely than the best estimate
LIKELY = 0.7           # estimates from here on are tried in the first step
CELL = 1_000           # classes of one key that are compared with each other in a cell,
CELL_SHINGLES = 4_000_000  # or fewer, where their sets are large
_STEP = 1 << 16        # shingles whose hashes are held at once


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLIERS = _odd(REGISTERS, 13)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, ascending, end to end, and how many each has."""
    words = [spaced_lower(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(words)), lengths)
    hashed = hashes([w for ws in words for w in ws])
    whole = doc[:max(0, len(doc) - SHINGLE + 1)] == doc[SHINGLE - 1:]
    values, owner = rolling(hashed, SHINGLE)[whole], doc[:len(whole)][whole]
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        values = np.append(values, np.array([xxhash.xxh64_intdigest(b" ".join(words[i]), len(words[i])) for i in short], np.uint64))
        owner = np.append(owner, short)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.bincount(owner[fresh], minlength=len(words))


def _registers(least: np.ndarray) -> np.ndarray:
    x = -np.log1p(-(least.astype(np.float64) + 1.0) / (2.0 ** 64 + 2048.0)) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / math.log(BASE)), 0, GREATEST).astype("<u2")


def sketches(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers of each set that is not empty, a row a set."""
    sizes = sizes[sizes > 0]
    ends = np.cumsum(sizes)
    least = np.empty((len(sizes), REGISTERS), np.uint64)
    a = 0
    while a < len(sizes):
        base = ends[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(ends, base + _STEP, "right")))
        part, starts = values[base:ends[b - 1]], ends[a:b] - sizes[a:b] - base
        room = np.empty_like(part)
        for i, m in enumerate(MULTIPLIERS):
            np.multiply(part, m, out=room)
            least[a:b, i] = np.minimum.reduceat(room, starts)
        a = b
    return _registers(least)


def _mixed(values: np.ndarray, by: int) -> np.ndarray:
    out = values ^ np.uint64(by)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xCAF649A9A4C12C69)
    return out ^ (out >> np.uint64(29))


def _sketched(batches):
    for table in pieces(batches, "text"):
        values, sizes = shingle_sets(table["text"].to_pylist())
        some = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[some]
        sums = [np.zeros(len(sizes), np.uint64) for _ in range(2)]
        if len(starts):
            for out, by in zip(sums, (0x51_7C_C1_B7, 0x2545F491)):
                out[some] = np.add.reduceat(_mixed(values, by), starts)
        drawn = iter(sketches(values, sizes))
        yield pa.RecordBatch.from_arrays([
            table["doc_id"].combine_chunks().cast(pa.int64()), table["place"].combine_chunks(), pa.array(sizes.astype(np.int64)),
            *[pa.array(x.view(np.int64)) for x in sums],
            pa.array([next(drawn).tobytes() if x else None for x in some.tolist()], pa.binary())],
            ["doc_id", "place", "n", "k1", "k2", "registers"])


def _band_keys(batches):
    for batch in batches:
        registers = _matrix(batch.column("registers"))
        bands = registers.reshape(len(registers), BANDS, BAND_ROWS).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(BAND_ROWS):
            keys = _mixed(keys + bands[:, :, i], 0x27D4EB2F)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(registers))),
            pa.array(np.repeat(batch.column("class").to_numpy(), BANDS))], ["key", "band", "class"])
    release()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


# --- likelihood ---------------------------------------------------------------

def _chance(x: np.ndarray) -> np.ndarray:
    """Probability that a register is greater, by the share x of the union in that set alone."""
    return -np.log1p(-x * (BASE - 1.0) / BASE) / math.log(BASE)


def likelihood(similarity, n_a, n_b, greater, less) -> np.ndarray:
    """Log-likelihood of a similarity, given the sizes and how many registers of the first set are greater and less."""
    u = n_a / (n_a + n_b)
    more, fewer = _chance(np.maximum(u - (1 - u) * similarity, 0.0)), _chance(np.maximum(1 - u - u * similarity, 0.0))
    tiny = 1e-300
    return (greater * np.log(np.maximum(more, tiny)) + less * np.log(np.maximum(fewer, tiny))
            + (REGISTERS - greater - less) * np.log(np.maximum(1.0 - more - fewer, tiny)))


def _slope(similarity, n_a, n_b, greater, less) -> np.ndarray:
    """How the log-likelihood changes with the similarity; it falls, so its zero is the estimate."""
    u = n_a / (n_a + n_b)
    only_a, only_b = np.maximum(u - (1 - u) * similarity, 1e-12), np.maximum(1 - u - u * similarity, 1e-12)
    more, fewer = _chance(only_a), _chance(only_b)
    rise = (BASE - 1.0) / BASE / math.log(BASE)
    more_by, fewer_by = (-v * rise / (1.0 - x * (BASE - 1.0) / BASE) for v, x in ((1 - u, only_a), (u, only_b)))
    return (greater * more_by / more + less * fewer_by / fewer
            - (REGISTERS - greater - less) * (more_by + fewer_by) / np.maximum(1.0 - more - fewer, 1e-12))


def estimate(n_a, n_b, greater, less) -> np.ndarray:
    """The likeliest similarity, where the slope changes its sign."""
    u = n_a / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(24):
        middle = (low + high) / 2
        rising = _slope(middle, n_a, n_b, greater, less) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return (low + high) / 2


def least_equal(percent: int) -> int:
    """Equal registers that a pair at the bar falls short of with a probability below e^-DOUBT.

    Registers are equal with at least the probability of the similarity, so this
    many are asked for before a likelihood is worked out.
    """
    bar = percent / 100
    tail, chance = 0.0, [math.comb(REGISTERS, n) * bar ** n * (1 - bar) ** (REGISTERS - n) for n in range(REGISTERS + 1)]
    for n, p in enumerate(chance):
        tail += p
        if tail > math.exp(-DOUBT):
            return n
    return REGISTERS


def possible(n_a, n_b, greater, less, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates, and whether the pair can be linked."""
    found = estimate(n_a, n_b, greater, less)
    bar = percent / 100
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    top = np.minimum(bar, np.minimum(n_a, n_b) / np.maximum(n_a, n_b))
    doubt = likelihood(found, n_a, n_b, greater, less) - likelihood(top, n_a, n_b, greater, less)
    return found, fits & ((found >= bar) | (doubt <= DOUBT))


# --- candidates and links -----------------------------------------------------

PAIR = "a long, b long, likely double"


def _pair_batch(a, b, likely) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(likely, pa.float64())], ["a", "b", "likely"])


def _judged(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that can be linked, with the estimate."""
    def run(batches):
        for batch in batches:
            left, right = _matrix(batch.column("ra")), _matrix(batch.column("rb"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            likely, fits = possible(n_a, n_b, (left > right).sum(axis=1), (left < right).sum(axis=1), percent)
            yield _pair_batch(batch.column("a").to_numpy()[fits], batch.column("b").to_numpy()[fits], likely[fits])
        release()

    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, PAIR)


def _cells(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, out of batches sorted by them; several groups a table."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = int(np.count_nonzero(~np.all([c == x for c, x in zip(columns, last)], axis=0)))
        if cut or (held and [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys] != last):
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
    release()


def _across(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per row i of a cell: i, the rows behind it of other components with enough equal registers, and which ones are equal."""
    key, low, high, slot, root, n = (table[c].to_numpy() for c in ("key", "low", "high", "slot", "root", "n"))
    registers, enough = _matrix(table["registers"]), least_equal(percent)
    fresh = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    for start, stop in zip(fresh.tolist(), [*fresh[1:].tolist(), len(key)]):
        for i in range(start, stop - 1):
            others = np.arange(i + 1, stop)
            fits = (root[others] != root[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
            if low[i] != high[i]:
                fits &= slot[others] != slot[i]
            others = others[fits]
            if len(others):
                same = registers[others] == registers[i]
                fits = np.count_nonzero(same, axis=1) >= enough
                yield i, others[fits], same[fits]


_CELL_KEYS = ["key", "low", "high"]


def _nearest(percent: int):
    """Each class of a cell with its likeliest partner in another component."""
    def run(batches):
        for table in _cells(batches, _CELL_KEYS):
            cls, n = table["class"].to_numpy(), table["n"].to_numpy().astype(float)
            registers = _matrix(table["registers"])
            best, partner = np.zeros(len(cls), np.int64), np.full(len(cls), -1)
            for i, others, same in _across(table, percent):
                equal = np.count_nonzero(same, axis=1)
                better = others[equal > best[others]]
                best[better], partner[better] = equal[equal > best[others]], i
                if len(others) and equal.max() > best[i]:
                    best[i], partner[i] = equal.max(), others[equal.argmax()]
            a = np.flatnonzero(partner >= 0)
            b = partner[a]
            more, less = (registers[a] > registers[b]).sum(axis=1), (registers[a] < registers[b]).sum(axis=1)
            likely, fits = possible(n[a], n[b], more, less, percent)
            a, b = cls[a[fits]], cls[b[fits]]
            yield _pair_batch(np.minimum(a, b), np.maximum(a, b), likely[fits])

    return run


def _overlap(left: np.ndarray, right: np.ndarray) -> int:
    """Elements in both of two ascending sets."""
    if len(left) > len(right):
        left, right = right, left
    at = np.searchsorted(right, left)
    return int((right[np.minimum(at, len(right) - 1)] == left).sum())


def _similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = _overlap(left, right)
    return 100 * both >= percent * (len(left) + len(right) - both)


def _swept(percent: int):
    """Links between components, confirmed on the full sets; what a cell has connected it does not compare again."""
    def run(batches):
        for table in _cells(batches, _CELL_KEYS):
            cls, band, n = table["class"].to_numpy(), table["band"].to_numpy(), table["n"].to_numpy().astype(float)
            registers = _matrix(table["registers"])
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
            root = {int(r): int(r) for r in table["root"].to_numpy()}
            of = table["root"].to_numpy().tolist()
            left, right = [], []

            def top(r: int) -> int:
                while root[r] != r:
                    root[r] = r = root[root[r]]
                return r

            for i, others, same in _across(table, percent):
                before = int(band[i]) * BAND_ROWS
                others = others[~same[:, :before].reshape(len(others), int(band[i]), BAND_ROWS).all(axis=2).any(axis=1)]
                if not len(others):
                    continue
                more, less = (registers[i] > registers[others]).sum(axis=1), (registers[i] < registers[others]).sum(axis=1)
                _, fits = possible(np.full(len(others), n[i]), n[others], more, less, percent)
                for j in others[fits].tolist():
                    one, other = top(of[i]), top(of[j])
                    if one != other and _similar(sets[i], sets[j], percent):
                        root[one] = other
                        left.append(int(cls[i]))
                        right.append(int(cls[j]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            keep = [_similar(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("sa", "sb")), percent)
                    for i in range(batch.num_rows)]
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[keep]) for c in ("a", "b")], ["a", "b"])
        release()

    side = lambda c: sets.select(F.col("class").alias(c), F.col("shingles").alias(f"s{c}"))
    return settle(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def _with_roots(rows: DataFrame, links: DataFrame, *columns: str) -> DataFrame:
    """Adds root_<column>, the component of each class column."""
    rooted = settle(components(links))
    for c in columns:
        rows = rows.join(rooted.select(F.col("node").alias(c), F.col("root").alias("_root")), c, "left").withColumn(
            f"root_{c}", F.coalesce("_root", c)).drop("_root")
    return rows


def _links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    keyed = classes.select("class", "registers").mapInArrow(_band_keys, "key long, band int, class long")
    shared = keyed.groupBy("key").agg(F.min("class").alias("least"), F.count("*").alias("held")).where("held > 1")
    members = settle(keyed.join(shared, "key"))
    wanted = members.select("class").distinct()
    sets = settle(_sets(docs, classes.join(wanted, "class", "left_semi")))

    stars = members.where("class <> least").select(F.col("least").alias("a"), F.col("class").alias("b")).distinct()
    nearest = _judged(stars, classes, percent).where(F.col("likely") >= LIKELY).groupBy("b").agg(F.max_by("a", "likely").alias("a"))
    links = _confirmed(nearest.select("a", "b"), sets, percent)

    facts = classes.select("class", "n", "registers")
    pairs = _dealt_cells(members, links, facts).mapInArrow(_nearest(percent), PAIR).select("a", "b").distinct()
    links = settle(links.union(_confirmed(pairs, sets, percent)))
    swept = _dealt_cells(members, links, facts.join(sets, "class"), "shingles").mapInArrow(_swept(percent), "a long, b long")
    return settle(links.union(swept))


def _dealt_cells(members: DataFrame, links: DataFrame, facts: DataFrame, *more: str) -> DataFrame:
    """The classes of keys that hold several components, in cells of bounded size, cell by cell.

    A key with more classes is cut into slots, and any two of them meet in a cell.
    """
    rest = settle(_with_roots(members.select("key", "band", "class"), links, "class").withColumnRenamed("root_class", "root")
                  .join(facts.select("class", "n"), "class"))
    slots = F.expr(f"int(greatest((count(1) - 1) div {CELL}, sum(n) div {CELL_SHINGLES}) + 1)")
    mixed = rest.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other"), slots.alias("slots")).where("one <> other")
    slot = F.pmod(F.xxhash64("class"), F.col("slots")).cast("int")
    dealt = rest.join(mixed.select("key", "slots"), "key").withColumn("slot", slot).withColumn(
        "facing", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    cells = dealt.select("key", F.least("slot", "facing").alias("low"), F.greatest("slot", "facing").alias("high"), "band", "slot", "class", "root")
    cells = cells.join(facts, "class").select(*_CELL_KEYS, "band", "slot", "class", "root", "n", "registers", *more)
    # The work of a cell grows with the square of its rows, so small partitions are not merged.
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, *_CELL_KEYS).sortWithinPartitions(*_CELL_KEYS)


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, shingles: the full set of each of the classes, out of one text that has it."""
    def run(batches):
        for table in pieces(batches, "text"):
            values, sizes = shingle_sets(table["text"].to_pylist())
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([table["class"].combine_chunks(), pa.array(
                [values[b - n:b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist())], pa.binary())], ["class", "shingles"])

    at = classes.select("class", F.col("at.doc_id").alias("_id"), F.col("at.place").alias("place"))
    found = docs.join(at, (docs["place"] == at["place"]) & docs["doc_id"].eqNullSafe(at["_id"]))
    # Rows repeated with their id are one text.
    return found.select("class", "text").groupBy("class").agg(F.first("text").alias("text")).mapInArrow(run, "class long, shingles binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text).

    Texts whose sets of five-word shingles have 100 * intersection >= percent *
    union are linked; component_id is the smallest doc_id that can be reached. A
    text of fewer words has these as its one shingle. Null, empty and blank texts
    have none and are linked with nothing. kept is whether the row's doc_id names
    its component. A null doc_id names none: its row is never kept, and its
    component_id is null if nobody else is in the component. Rows that repeat a
    doc_id all appear, each with the component of its own text. An empty table gives
    no rows. Other columns are ignored, whatever their names. A long text is
    held whole, with 8 bytes a shingle.

    `percent` may be 85 or more: bands are made for that.
    """
    if percent < PERCENT:
        raise ValueError(f"bands of {BAND_ROWS} registers find similarities of {PERCENT} percent and more")
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("place", F.xxhash64("text"))
    rows = settle(docs.mapInArrow(_sketched, "doc_id long, place long, n long, k1 long, k2 long, registers binary"))
    some = rows.where("n > 0").groupBy("n", "k1", "k2").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "place")).alias("at"), F.first("registers").alias("registers"))
    classes = settle(some.withColumn("class", F.monotonically_increasing_id()))
    named = settle(_with_roots(classes.select("n", "k1", "k2", "class", "first_id"), _links(docs, classes, percent), "class"))
    ids = named.groupBy("root_class").agg(F.min("first_id").alias("component_id"))
    whole = named.join(ids, "root_class").select("n", "k1", "k2", "component_id")
    found = rows.select("doc_id", "n", "k1", "k2").join(whole, ["n", "k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
