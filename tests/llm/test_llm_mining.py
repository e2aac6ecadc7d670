"""Periodic runs, collocations and set sketches, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from creditloom.llm import collocations, periodic_runs, setsketch
from creditloom.llm.queries import QUERIES

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- periodic runs --------------------------------------------------------------

def brute_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i:
                run = words[i:j + q]
                if len(run) >= max(6, 4 * q) and not any(
                        all(run[k] == run[k + p] for k in range(len(run) - p)) for p in range(1, q)):
                    out.append((i, len(run), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        n = rng.randint(1, 70)
        words = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(n)]
        if rng.random() < 0.6:
            a, period = rng.randrange(n), rng.randint(1, 12)
            words = [w if i < a else words[a + (i - a) % period] if a + period <= n else w for i, w in enumerate(words)]
        assert periodic_runs.runs_of(words) == brute_runs(words)
        stretches = zip(*(x.tolist() for x in periodic_runs._stretches(np.array(words), np.zeros(n, int))))
        found = [(a + s, length, q) for a, b in stretches for s, length, q in periodic_runs.runs_of(words[a:b])]
        assert sorted(found, key=lambda r: (r[0], r[2])) == brute_runs(words)


def test_extensions_are_common_prefixes():
    rng = random.Random(5)
    text = [rng.randint(1, 2) for _ in range(80)] + [0]
    common = periodic_runs.Extensions(periodic_runs.SuffixTree(text))
    a, b = np.triu_indices(len(text), 1)
    want = [next(k for k in range(len(text)) if text[i + k] != text[j + k]) for i, j in zip(a, b)]
    assert common.of(a, b).tolist() == want


def test_trees_of_long_repeats():
    words = [1 + i % 7 for i in range(30_000)]
    assert periodic_runs.runs_of(words) == [(0, 30_000, 7)]
    assert periodic_runs.runs_of([1] * 30_000) == [(0, 30_000, 1)]


def collapsed(words, runs):
    gone = set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs_of_odd_rows(odd, nothing):
    rows = odd.collect()
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in periodic_runs.periodic_runs(odd).collect()]
    want = []
    for r in rows:
        words = SPACED.findall(r["text"] or "")
        runs = brute_runs(words) if len(words) < 1000 else [(2, 8000, 2)]
        want.append((r["doc_id"], len(words), runs, collapsed(words, runs)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(nothing).count() == 0
    best = {r["doc_id"]: r for r in periodic_runs.digest(periodic_runs.periodic_runs(odd)).collect()}
    assert (best[8]["n_runs"], best[8]["start"], best[8]["length"], best[8]["period"], best[8]["exponent_milli"]) == (1, 0, 12, 2, 6000)
    assert (best[3]["n_runs"], best[3]["start"], best[3]["exponent_milli"]) == (0, None, None)
    assert best[3]["runs_sha256"] == hashlib.sha256(b"").hexdigest()


def test_periodic_runs_query_brute_force(llm, folder):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](llm, folder).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    planted = 0
    for r in llm.read.parquet(f"{folder}/documents.parquet").collect():
        words = SPACED.findall(r["text"] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if len(words) > 1500:
            continue
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
        assert got[r["doc_id"]] == want
    assert planted > 5


# --- collocations ---------------------------------------------------------------

def brute_collocations(rows, least, longest, top, percent):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        frequent = [p for p in f if len(p) > 1 and f[p] >= least]
        scored = []
        for p in frequent:
            inside = [f[q] for q in frequent if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * x >= percent * f[p] for x in inside):
                continue
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, longest, top, percent", [(2, 4, 2000, 80), (3, 5, 7, 50)])
def test_collocations_brute_force(llm, least, longest, top, percent):
    rng = random.Random(7)
    common = ["the", "The", "a", "of", "New", "york", "ünder", "\x1cx", "city", " y"]
    rows = []
    for i in range(120):
        words = [rng.choice(common) if rng.random() < 0.8 else f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "de", None, "und", "two words", ""]), "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for w in words)))
    rows += [("en", None), ("en", ""), (None, " \t"), ("xx", "once only"), *[("en", "a b c d a b c d")] * 3]
    docs = llm.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, rank string").repartition(5)
    got = collocations.collocations(docs, least, longest, top, percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least, longest, top, percent)


def test_collocations_without_phrases(odd, nothing, llm):
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(llm.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0
    found = {(r["lang"], r["phrase"]): r["a"] for r in collocations.collocations(odd).collect()}
    assert found[("de", "abc def abc def")] == 3999


def test_numbers_survive_packing():
    for values in ([], [0], [5, -3, 1 << 60], list(range(0, 5000, 3))):
        assert collocations._unsqueeze(collocations._squeeze(np.array(values, np.int64))).tolist() == values
        assert collocations._from_increasing(collocations._increasing(np.array(sorted(values), np.int64))).tolist() == sorted(values)


def test_scores_beyond_64_bits(llm):
    f, first, last = 9_000_000_000_000_000, 9_000_000_000_000_001, 10_000_000_000_000_007
    rows = llm.createDataFrame([(f, [first, f], [last, f]), (f, [first, first, f], [first, last, f])], "f long, heads array<long>, tails array<long>")
    got = [tuple(r[0]) for r in rows.select(collocations._least_cut()).collect()]
    assert got == [(2_000_000 * f // (first + last), 1, first, last), (2_000_000 * f // (first + last), 1, first, last)]


# --- set sketches ---------------------------------------------------------------

def brute_near(rows, percent=85):
    sets = []
    for _, text in rows:
        w = SPACED.findall(lower(text))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc is not None and doc == component))
    return sorted(out, key=repr)


def near_texts(rng, groups, size):
    rows, doc = [], 0
    for _ in range(groups):
        base = [f"t{rng.randint(0, 400)}" for _ in range(rng.randint(30, 150))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"u{rng.randint(0, 10**6)}"
            rows.append((doc, " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)))
            doc += 1
    return rows


def test_near_duplicates_brute_force(llm, monkeypatch):
    monkeypatch.setattr(setsketch, "CELL", 7)  # keys are cut into several cells
    rng = random.Random(11)
    rows = near_texts(rng, 12, 25)
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(500, "one two"), (501, "One two"), (502, "one two three"), (503, None), (504, ""), (505, " \n"), (3, "unlike all the others here"),
             (None, rows[0][1]), (None, "alone in its component of no name"), rows[4], rows[4]]
    docs = llm.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, class string").repartition(3)
    got = setsketch.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_near(rows)


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = sorted(map(tuple, setsketch.near_duplicates(odd).collect()), key=repr)
    assert got == brute_near([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert setsketch.near_duplicates(nothing).count() == 0
    with pytest.raises(ValueError):
        setsketch.near_duplicates(odd, 60)


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.7, 0.9):
        a = rng.integers(0, 1 << 63, 4000, np.uint64)
        b = np.append(a[:int(4000 * share)], rng.integers(0, 1 << 63, 400, np.uint64))
        x, y = setsketch.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        true = int(4000 * share) / (4000 + 400)
        sizes = np.array([float(len(a))]), np.array([float(len(b))])
        counts = np.array([(x > y).sum()]), np.array([(x < y).sum()])
        assert abs(setsketch.estimate(*sizes, *counts)[0] - true) < 0.12
        assert setsketch.possible(*sizes, *counts, 85)[1][0] == (share == 0.9) or share == 0.7


def test_few_pairs_at_the_bar_have_fewer_equal_registers():
    rng = np.random.default_rng(1)
    assert (rng.binomial(setsketch.REGISTERS, 0.85, 200_000) >= setsketch.least_equal(85)).all()
    assert setsketch.least_equal(85) > 160


def test_registers_merge_by_the_greater():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1 << 63, 300, np.uint64), rng.integers(0, 1 << 63, 500, np.uint64)
    x, y, union = setsketch.sketches(np.concatenate([a, b, a, b]), np.array([300, 500, 800]))
    assert (np.maximum(x, y) == union).all()
