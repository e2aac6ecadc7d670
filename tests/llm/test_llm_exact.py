"""Operators with an exact answer, against brute force and SQL."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from compare import difference, oracle_connection, oracle_result, spark_result
from creditloom.llm import chat, decontaminate, licenses, packing, pii, quality, simhash, substring_dedup
from creditloom.llm.queries import ORACLES, QUERIES

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(llm, folder, name):
    assert difference(spark_result(QUERIES[name](llm, folder)), oracle_result(oracle_connection(folder), ORACLES[name])) is None


def removed_words(rows):
    first = {}
    texts = [(i, SPACED.findall(t or "")) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, np.inf), np.inf if i is None else i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < (np.inf if i is None else i):
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup_brute_force(odd, nothing):
    got = [tuple(r) for r in substring_dedup.substring_dedup(odd).collect()]
    assert sorted(got, key=repr) == removed_words([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_anchor_cover_reaches_every_alignment():
    for a in range(7):
        for b in range(7):
            assert any((a + d) % 7 in substring_dedup.COVER and (b + d) % 7 in substring_dedup.COVER for d in range(7))


def brute_fingerprint(text):
    w = SPACED.findall(lower(text))
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(values, most=3):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {v: find(v) for v in vs}


def test_simhash_brute_force(llm, documents, odd, nothing):
    for docs in (documents, odd):
        rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
        root = brute_components({f for _, f in rows})
        ids = {}
        for i, f in rows:
            if i is not None:
                ids[root[f]] = min(ids.get(root[f], i), i)
        want = sorted(((i, f"{f:016x}", ids.get(root[f])) for i, f in rows), key=repr)
        got = [tuple(r) for r in simhash.digest(simhash.simhash_dedup(docs)).collect()]
        assert sorted(got, key=repr) == want
    assert simhash.simhash_dedup(nothing).count() == 0


@pytest.mark.parametrize("segments", [8, 16])
def test_links_lose_no_pair(llm, segments):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150).tolist() + [0, (1 << 64) - 1, (1 << 64) - 8]
    values = set(base)
    for v in base[:60] + base[-3:]:
        for n in (1, 2, 3, 4):
            x = v
            for k in rng.choice(64, n, replace=False).tolist():
                x ^= 1 << k
            values.add(x)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    edges = simhash.links(llm.createDataFrame([(v,) for v in signed], "fp long"), segments=segments)
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups = {}
    for v in values:
        s = int(np.uint64(v).view(np.int64))
        groups.setdefault(got.get(s, s), set()).add(v)
    want = {}
    for v, r in brute_components(values).items():
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_one_of_each(odd):
    kept = simhash.one_of_each(odd).collect()
    ids = [r["doc_id"] for r in kept]
    assert kept[0].asDict().keys() == set(odd.columns) and ids.count(2) <= 1 and 1 in ids and 9 in ids
    assert sum(i in (3, 4, 5) for i in ids) == 1  # no words: one group


def brute_one_of_each(rows):
    """The first row of each component; rows are (doc_id, text, source) and ties among texts of one id are left open."""
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    root = brute_components(set(prints))
    least = {}
    for (doc, _, _), f in zip(rows, prints):
        key = (doc is None, doc or 0)
        least[root[f]] = min(least.get(root[f], key), key)
    return root, {f: v for f, v in least.items()}


A, B = "the same words stand in this long text about loans and banks", "entirely other words are found over here in that one"


@pytest.mark.parametrize("rows, want", [
    ([(5, A), (5, B), (3, B)], [(3, B), (5, A)]), ([(5, A), (5, B)], [(5, A), (5, B)]), ([(5, A), (5, A)], [(5, A)]),
    ([(None, A), (7, A), (None, B)], [(7, A), (None, B)]), ([(1, None), (2, ""), (None, " ")], [(1, None)])])
def test_one_row_a_component(llm, rows, want):
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, simhash.one_of_each(docs).collect()), key=repr) == sorted(want, key=repr)


def test_one_of_each_with_repeated_ids(llm):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = rng.choice(words, 60).tolist()
        texts.append(base)
        for _ in range(3):
            near = list(base)
            near[int(rng.integers(60))] = "changed"
            texts.append(near)
    rows = [(int(rng.integers(30)) if rng.random() > 0.1 else None, " ".join(texts[int(rng.integers(len(texts)))]), str(rng.integers(2)))
            for _ in range(200)]
    docs = llm.createDataFrame([(*r, {"k": "v"}, "x") for r in rows], "doc_id long, text string, source string, extra map<string,string>, _text_key string")
    first = sorted((tuple(r) for r in simhash.one_of_each(docs.repartition(5)).collect()), key=repr)
    assert first == sorted((tuple(r) for r in simhash.one_of_each(docs.repartition(2, "source")).collect()), key=repr)
    root, least = brute_one_of_each(rows)
    kept = [(r[0], root[brute_fingerprint(r[1])]) for r in first]
    assert len(kept) == len({f for _, f in kept}) == len(least)
    assert all((doc is None, doc or 0) == least[f] for doc, f in kept)


def test_decontaminate_brute_force(llm, documents, odd, folder):
    items = [(r["item_id"], r["text"]) for r in llm.read.parquet(f"{folder}/benchmark.parquet").collect()]
    items += [(901, "w3 w4"), (902, ""), (903, None), (None, "w5 w6"), (901, "w9"), (904, items[0][1])]
    wins = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            wins.setdefault(tuple(w[k:k + 13]), set()).add(str(i))
    sizes = {len(w) for w in wins}
    bench = llm.createDataFrame(items, "item_id long, text string")
    for docs in (documents, odd):
        want = []
        for r in docs.collect():
            w, hit, found = ALNUM.findall(lower(r["text"])), set(), set()
            for n in sizes:
                for k in range(len(w) - n + 1):
                    if got := wins.get(tuple(w[k:k + n])):
                        hit.update(range(k, k + n))
                        found |= got
            want.append((r["doc_id"], len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
        got = decontaminate.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "hit_items", "contaminated").collect()
        assert sorted(map(repr, (tuple(g) for g in got))) == sorted(map(repr, want))
    none = decontaminate.decontaminate(odd, bench.limit(0)).agg({"n_hit": "sum"}).first()[0]
    assert none == 0


def test_automaton_blocks_agree(llm, documents, folder, monkeypatch):
    bench = llm.read.parquet(f"{folder}/benchmark.parquet")
    whole = decontaminate.digest(decontaminate.decontaminate(documents, bench))
    monkeypatch.setattr(decontaminate, "automata", lambda b, w=13: [decontaminate.SuffixAutomaton(
        [(str(r["item_id"]), decontaminate.alphanumeric_lower(r["text"])) for r in b.collect() if r["item_id"] % 3 == k], w) for k in range(3)])
    assert spark_result(decontaminate.digest(decontaminate.decontaminate(documents, bench))) == spark_result(whole)


def test_cut_spans():
    assert decontaminate.without_spans("One, two three!  Four", [(1, 3)]) == "One, !  Four"


def test_packing(documents, odd, nothing):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for docs in (documents, odd):
        rows = packing.pack_documents(docs).collect()
        texts = {}
        for r in docs.collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            texts.setdefault(r["doc_id"], []).append(np.array(ids, "<u4"))
        for r in rows:
            assert any(len(t) == r["doc_tokens"] and zlib.crc32(t[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for t in texts[r["doc_id"]])
        assert sum(r["length"] for r in rows) == sum(len(t) for ts in texts.values() for t in ts)
        spans = {}
        for r in rows:
            spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in spans.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(spans) <= sum(r["length"] for r in rows) / 4096 * 1.02 + 1
    assert packing.pack_documents(nothing).count() == 0


def test_best_fit_takes_the_tightest():
    sequence, offset = packing.best_fit_decreasing(np.array([60, 70, 30, 40, 100, 1]), 100)
    assert sequence[0] == sequence[3] and sequence[1] == sequence[2] and offset[2] == 70 and sequence[5] not in sequence[:5]


def brute_spans(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii(llm, documents, odd, nothing):
    tricky = ["a@b@c.de.f x@y", "@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "+1 (2)3-4.5 6789 +1", "..a@b.c@d.e.f", "4111-1111-1111-1111-", "x@y.z..w"]
    for text in tricky + [r["text"] for r in documents.collect()] + [r["text"] for r in odd.collect()]:
        assert pii.base_spans(text or "") == brute_spans(text)
    for docs in (documents, odd):
        found = pii.find_pii(docs).collect()
        for r in found:
            spans = [tuple(s) for s in r["spans"]]
            assert set(brute_spans(r["text"])) <= set(spans) and set(docs.columns) <= set(r.asDict())
    more = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    secrets = {r["text"][s["start"]:s["end"]] for r in pii.find_pii(more).collect() for s in r["spans"] if s["kind"] == "secret"}
    assert secrets == {x for r in more.collect() for x in re.findall(r'token = "([0-9a-f]{40})"', r["text"])}
    assert pii.find_pii(nothing).count() == 0
    clean = pii.find_pii(odd, replace=True).where("doc_id = 9").first()["text"]
    assert clean == "mail [EMAIL] or [PHONE] at [IP] \U0001F600 card [CARD]"


def test_pii_thresholds_from_all_documents(llm, monkeypatch):
    """The only true secret of a table lies outside the sample; rows without doc_id are sampled as others are."""
    rows = [(i, f"{'mail a.b@c.org or' if i % 2 else 'sum'} 12345678 of {i} 300.1.1.1 or 10.0.0.{i % 250}") for i in range(400)]
    rows += [(None, f"none {i} 300.2.2.2 10.1.1.1") for i in range(400)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 200)
    chosen = docs.where(pii._chosen(docs))
    assert 40 <= chosen.where("doc_id is null").count() <= 180
    assert pii.learn(docs).thresholds.keys() >= {"ip", "email"}
    trees = pii.Trees([(1.0, [(pii.FEATURES.index("named"), 0.5, 1, 2), (-1, -1.0, 0, 0), (-1, 1.0, 0, 0)])], {})
    hidden = llm.createDataFrame([(t, False) for _, t in rows] + [("key = abcdef0123456789abcdef", False)], "text string, fitted boolean")
    assert pii._calibrate(hidden, trees)["secret"] == pii.step_of(1.0)
    assert pii._threshold(np.array([5, 3, 1]), np.array([1, 0, 0]), np.array([98, 2, 1])) == 3


def test_benchmark_item_without_id_hits(llm):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = llm.createDataFrame([(1, passage), (2, "other words")], "doc_id long, text string")
    bench = llm.createDataFrame([(None, passage), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["hit_items"], r["contaminated"]) for r in decontaminate.decontaminate(docs, bench, unnamed=True).collect()}
    assert got == {1: (20, [], True), 2: (0, [], False)}


def test_items_without_id_count_as_the_sql_counts_them(llm, tmp_path):
    """One item without a name, however many rows it has, next to named ones and ids that repeat."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in [(1, 20), (None, 16), (2, 3), (None, 2), (2, 14), (3, 1), (None, 30)]] + [(None, ""), (4, None)]
    docs = [(i, " ".join([*rng.choice(words, 30), *(items[int(rng.integers(7))][1].split()), *rng.choice(words, 5)])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, items[1][1]), (103, items[3][1] + " " + items[5][1])]
    llm.createDataFrame(docs, "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    llm.createDataFrame(items, "item_id long, text string").toPandas().astype({"item_id": "Int64"}).to_parquet(tmp_path / "benchmark.parquet")
    import duckdb
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    assert difference(spark_result(QUERIES["op3_decontamination"](llm, str(tmp_path))), oracle_result(con, ORACLES["op3_decontamination"])) is None


def test_licenses(documents, odd, nothing):
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
           for r in licenses.digest(licenses.scan_licenses(documents)).collect()}
    want = set()
    for r in documents.collect():
        w, at, labels = ALNUM.findall(lower(r["text"])), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want.add((r["doc_id"], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert got == want
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize("text,matches", [
    ("Released under the terms of the MIT License.", True), ("Released under the terms the MIT License.", False),
    ("Licensed under the Apache License, Version 2.0", True), ("Licensed under CC BY-NC 4.0", True), ("licensed under cc by", False),
    ("This work is licensed under the GNU General Public License, version 3", True), ("", False), (None, False)])
def test_templates(text, matches):
    assert bool(licenses.Scanner().scan(text)[2]) == matches


def test_template_markup():
    automaton = licenses.TokenAutomaton("a [[b [[c]]]] {{2}} ((d | e f)) g")
    words = lambda s: [w.encode() for w in s.split()]
    for s in ("a d g", "a b d g", "a b c x y e f g", "a x d g"):
        assert automaton.match(words(s), 0) == len(s.split())
    for s in ("a c d g x"[:5], "a x y z d g", "a e g", "b d g"):
        assert automaton.match(words(s), 0) is None


def test_chat_round_trip(llm):
    rows = [(1, 0, "system", "be\\"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "[\\INST] <</SYS>> </s>\n"), (1, 2, "assistant", "twin"),
            (2, None, None, None), (2, 0, "tool [/ROLE]", "x"), (None, 0, "assistant", ""), (None, 1, "user", " </s"), (3, 0, "user", " ")]
    got = {r["conv_id"]: r for r in chat.format_conversations(llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [(r, t) for _, _, r, t in rows[:4]]
    assert [tuple(t) for t in got[2]["turns"]] == [("", ""), ("tool [/ROLE]", "x")]
    loss = "".join(chat.unescape(got[1]["formatted"][s["start"]:s["end"]]) for s in got[1]["loss_spans"])
    assert loss == "[\\INST] <</SYS>> </s>\ntwin"
    assert [tuple(t) for t in got[None]["turns"]] == [("assistant", ""), ("user", " </s")]
    assert chat.format_conversations(llm.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_detects_rewriting():
    turns = [("user", "hello"), ("assistant", "there"), ("user", "again")]
    assert not chat.rewrites_history(turns, chat.instruct)
    assert chat.rewrites_history(turns, lambda t: "".join(x for _, x in t[-2:]))
    assert chat.rewrites_history(turns, lambda t: f"{len(t)} turns" + "".join(x for _, x in t))
    assert chat.rewrites_history([("user", " x ")], lambda t: "".join(x.strip() + ";" for _, x in t))


def brute_quality(text):
    text = text or ""
    w = SPACED.findall(text)
    wins = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if wins[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base(documents, odd, nothing):
    for docs in (documents, odd):
        got = [tuple(r)[:7] for r in quality.digest(quality.quality(docs)).collect()]
        assert sorted(got, key=repr) == sorted(((r["doc_id"], *brute_quality(r["text"])) for r in docs.collect()), key=repr)
    assert quality.quality(nothing).count() == 0


def test_quality_outliers(llm):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        n = int(rng.lognormal(5, 0.4)) + 20
        rows.append((i, " ".join(f"word{rng.integers(0, 10**6)}" for _ in range(n)), "en", "a"))
    rows += [(1000 + i, " ".join("##$$" + "x" * 40 + str(rng.integers(0, 10**6)) for _ in range(300)), "en", "a") for i in range(30)]
    rows += [(2000, "x" * 400 + " " + " ".join(map(str, range(20))), "en", "small")]
    got = {r["doc_id"]: r for r in quality.quality(llm.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i]["kept"] for i in range(30))
    assert sum(not got[i]["kept"] for i in range(400)) <= 2 and got[2000]["kept"] and got[2000]["distance"] is None


def test_quality_pools_small_groups(llm):
    """Groups, languages and tables too small for an estimate of their own are judged by the next wider pool."""
    rng = np.random.default_rng(5)

    def text(size):
        return " ".join(f"word{rng.integers(0, 10**6)}" for _ in range(size))

    rows = [(i, text(int(rng.lognormal(5, 0.4)) + 20), "en", "a") for i in range(200)]
    rows += [(300 + i, text(120), lang, source) for i, (lang, source) in enumerate([("en", "host"), ("en", None), ("fr", "a"), (None, "a"), (None, None)])]
    far = "x" * 400 + " " + " ".join(map(str, range(20)))
    rows += [(400 + i, far, lang, source) for i, (lang, source) in enumerate([("en", "host"), ("en", None), ("fr", "a"), (None, "a"), (None, None)])]
    schema = "doc_id long, text string, lang string, source string"
    got = {r["doc_id"]: r for r in quality.quality(llm.createDataFrame(rows, schema), pooled=True).collect()}
    assert len(got) == len(rows) and all(r["base_failed"] or r["distance"] is not None for r in got.values())
    assert all(got[300 + i]["kept"] and not got[400 + i]["kept"] for i in range(5))
    few = quality.quality(llm.createDataFrame(rows[:3], schema), pooled=True).collect()
    assert all(r["kept"] and r["distance"] is not None for r in few)


def test_quality_tight(llm):
    """A coordinate has its own width, the least spread holds where it does not vary, and a third of outliers stays outside."""
    rng = np.random.default_rng(6)

    def text(size, low, high):
        return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(low, high)))) for _ in range(size))

    rows = [(i, text(int(rng.lognormal(5, 0.4)) + 40, 3, 8), "en", "a") for i in range(200)]
    rows += [(300 + i, text(150, 6, 9), "en", "a") for i in range(3)]  # 7 characters a word where the others have 5
    rows += [(400, text(150, 3, 8) + " #", "en", "a")]  # the first one with a symbol
    rows += [(i, text(int(rng.lognormal(5, 0.4)) + 40, 3, 8), "en", "b") for i in range(500, 600)]
    rows += [(700 + i, text(150, 8, 14), "en", "b") for i in range(45)]
    copy = text(150, 3, 8)  # near half of a group in copies leaves the other half its room
    rows += [(800 + i, copy if i % 2 else text(150, 3, 8), "en", "c") for i in range(101)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(llm.createDataFrame(rows, "doc_id long, text string, lang string, source string"), tight=True).collect()}
    assert not any(got[300 + i] for i in range(3)) and not any(got[700 + i] for i in range(45)) and got[400]
    assert sum(not got[i] for i in [*range(200), *range(500, 600), *range(800, 901)]) <= 8


def test_quality_against_numpy(llm):
    """The same estimate by plain matrices."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'#' if rng.random() < .1 else ''}w{rng.integers(0, 10**int(rng.integers(1, 8)))}" for _ in range(int(rng.lognormal(4, .7)) + 12)), "en", "a")
            for i in range(200)]
    frame = quality.quality(llm.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    x, unit = [], quality.UNIT
    for i, t, _, _ in rows:
        n, chars, symbols, dup, rep, failed = brute_quality(t)
        if not failed:
            x.append([i, *(np.floor(unit * v + 0.5) for v in (np.log1p(n), np.log1p(chars / n), np.sqrt(symbols / chars), np.sqrt(max(rep / n, dup))))])
    x = np.array(x)
    ids, x = x[:, 0], x[:, 1:]
    least = np.diag([(unit * s) ** 2 for s in quality.LEAST_SPREAD])

    def at(v, share):
        return np.sort(v)[int(np.ceil(share * len(v))) - 1]

    def d2(m, c):
        return np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)

    q = np.array([[at(c, s) for s in (0.25, 0.5, 0.75)] for c in x.T])
    m, c = q[:, 1], np.diag(np.maximum((q[:, 2] - q[:, 0]) / 1.349, unit * np.array(quality.LEAST_SPREAD)) ** 2)
    for _ in range(quality.STEPS):
        bins = np.floor(np.log1p(d2(m, c)) * 64)
        near = x[bins <= at(bins, 0.75)]
        m, c = near.mean(0), np.cov(near.T, bias=True) + least
    bins = np.floor(np.log1p(d2(m, c)) * 64)
    scale = np.expm1((at(bins, 0.5) + 0.5) / 64) / quality.CHI2_MEDIAN
    assert np.allclose(frame.loc[ids.astype(int), "distance"], d2(m, c) / max(scale, 1), rtol=1e-6)


def test_digests_are_of_the_kept_text(documents):
    r = substring_dedup.digest(substring_dedup.substring_dedup(documents)).orderBy("doc_id").first()
    text = documents.where(f"doc_id = {r['doc_id']}").first()["text"]
    assert r["n_removed"] or r["kept_sha256"] == hashlib.sha256(" ".join(SPACED.findall(text)).encode()).hexdigest()


def test_any_role_is_as_long_as_the_sql_says(llm, tmp_path):
    rows = [(1, 0, "tool", "a [/ROLE] b"), (1, 1, "to\\ol[ROLE]<s>", "x"), (1, 2, "", "y"), (1, 3, None, None), (2, 0, "user", "hi"), (2, 1, "assistant", "</s>")]
    llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    assert difference(spark_result(QUERIES["op8_chat_format"](llm, str(tmp_path))), oracle_result(con, ORACLES["op8_chat_format"])) is None


def test_one_of_each_leaves_the_texts_where_they_lie(llm):
    """However low Spark's own bound, the few rows that go are sent to the texts and not the other way round."""
    docs = llm.createDataFrame([(i, f"one two three four five {i // 2 % 3}") for i in range(20)], "doc_id long, text string")
    before = llm.conf.get("spark.sql.autoBroadcastJoinThreshold")
    llm.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash.one_of_each(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(out.collect()) < 20
    finally:
        llm.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
