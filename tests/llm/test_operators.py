"""The ten operators against plain Python on small tables with awkward rows."""

from __future__ import annotations

import ctypes
import hashlib
import random
import re
import string
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import _text as t
from tracelake.llm import alignment, bloom, chat, decontaminate, html, jaccard, lines, lm, mixing, quality, suffixes
from tracelake.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 7))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(12)]
    passage = prose(rng, 60)
    out: list[tuple[int | None, str | None, str | None]] = []
    for i, b in enumerate(base):
        parts = b.split(" ")
        text = "\n".join(" ".join(parts[j : j + 25]) for j in range(0, len(parts), 25))
        out.append((i, text, f"s{i % 3}"))
    near = out[0][1].split(" ")
    for i in range(5):
        copy = list(near)
        copy[10 + 9 * i] = f"change{i}"
        out.append((20 + i, " ".join(copy), "s0"))
    out += [(30 + i, out[1][1], "s1") for i in range(4)]
    out += [(40 + i, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30), "s2") for i in range(6)]
    out += [(50, None, None), (51, "", "s1"), (52, "one", None), (53, "two words", "s1"), (54, "   \n\t\n ", "s2"), (55, "x " * 300, "s0"), (56, "ÄÖ é ß 漢字 " * 40, "s1")]
    out += [(57, "The The the\nThe The the\n\nthe", "s0"), (58, "A# b$ <c>\n" * 30, "s2"), (58, "A# b$ <c>\n" * 30, "s2"), (59, "Zz " + out[2][1].upper(), "s2"), (60, out[3][1] + "\n", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, x, s, "clash") for i, x, s in rows], "doc_id long, text string, source string, score string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_line_statistics(docs, rows):
    def brute(text):
        text = text or ""
        w = re.findall(WORD, text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        n = len(w)
        return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n

    got = sorted(lines.line_frequency(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert [tuple(r) for r in got] == sorted((i, *brute(x)) for i, x, _ in rows)


def test_frequent_lines_deplete_documents(spark):
    rng = random.Random(1)
    shared = prose(rng, 60)
    table = [(i, shared + f"\nown{i}", "h") for i in range(30)] + [(100 + i, shared, "h") for i in range(40)] + [(200 + i, prose(rng, 80), "h") for i in range(20)] + [(300, shared, None)]
    got = {r.doc_id: r for r in lines.line_frequency(spark.createDataFrame(table, "doc_id long, text string, source string")).collect()}
    assert all(not got[i].kept and got[i].n_words_removed == 60 for i in range(30))  # 31 distinct texts hold the line
    assert all(got[200 + i].kept for i in range(20))
    assert got[300].kept and len(got) == len(table)


def test_frequent_lines_are_cut_out_of_the_text(spark):
    rng = random.Random(8)
    menu, ad = prose(rng, 20), prose(rng, 25)
    table = [(i, f"{menu}\n\n{prose(rng, 50)}\n {ad.upper()}\t\n{prose(rng, 9)} é\n{menu}", "ab"[i % 2]) for i in range(60)]
    table += [(100, f"{menu}\n{ad}", "a"), (101, f"{menu}\n{ad}", None), (102, None, "a"), (103, "\n", "b"), (104, menu + "\n", "b")]
    table += [(200 + i, f"{menu}\n{prose(rng, 60)}", None) for i in range(30)]
    words = lambda line: tuple(re.findall(WORD, low(line)))
    hosts = {h: {x or "" for _, x, s in table if s == h} for _, _, h in table}
    held = {h: Counter(line for x in texts for line in {words(line) for line in x.split("\n")} - {()}) for h, texts in hosts.items()}
    want = {}
    for i, x, h in table:
        gone = [line for line in (x or "").split("\n") if held[h][words(line)] > 20 and held[h][words(line)] > 0.02 * len(hosts[h])]
        want[i] = "\n".join(line for line in (x or "").split("\n") if line not in gone), len({words(line) for line in gone}), sum(len(words(line)) for line in gone)
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    for options in ({}, {"most_lines": 0}):
        got = {r.doc_id: (r.text, r.n_lines_removed, r.n_words_removed) for r in lines.line_frequency(df, **options).collect()}
        assert got == want
    assert want[100] == ("", 2, 45) and want[101] == (ad, 1, 20) and want[0][1:] == (2, 65) and want[0][0].startswith("\n")


def test_jaccard_components(docs, rows):
    sets = {}
    for i, x, _ in rows:
        w = re.findall(WORD, low(x or ""))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    group[a] = group[b] = min(group[a], group[b])
    got = sorted(tuple(r) for r in jaccard.similar_components(docs).collect())
    assert got == sorted((i, len(sets[i]), group[i]) for i, *_ in rows)
    assert len({g for g in group.values()}) < len(group)


def test_jaccard_blocks_meet_in_pairs(spark):
    rng = random.Random(8)
    base = prose(rng, 200).split(" ")
    table = []
    for i in range(40):  # a chain: each differs a little from the one before
        base[(i * 5) % 200] = f"w{i}"
        table.append((i, " ".join(base)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    small = sorted(tuple(r) for r in jaccard.similar_components(df, block=3).collect())
    assert small == sorted(tuple(r) for r in jaccard.similar_components(df).collect())
    assert {c for *_, c in small} == {0}


def brute_components(table, k=4, percent=85):
    """(doc_id, set size, smallest linked doc_id) of each row, by comparing all pairs."""
    sets = []
    for _, x in table:
        w = re.findall(WORD, low(x or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(table)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = table[i][0] is not None and table[i][0] == table[j][0] and sets[i] and sets[j]
            if same or both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(table):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(table)]


@pytest.mark.parametrize("options", [{}, {"block": 3, "most_ids": 0}, {"block": 20, "sampled_shingles": 100_000_000, "most_frequent": 40}])
def test_jaccard_near_copies_of_every_degree(spark, options):
    """Copies with up to 14 changed words link with some of the others only; some ids are null or repeat with other texts."""
    rng = random.Random(12)
    table = []
    for i in range(120):
        copy = prose(random.Random(5), 140).split(" ")
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(140)] = f"w{rng.randrange(30)}"
        table.append((None if i % 40 == 7 else i, " ".join(copy)))
    table += [(200 + i, prose(rng, 140)) for i in range(20)] + [(220 + i % 3, prose(random.Random(i % 4), 30)) for i in range(12)]
    table += [(3, prose(rng, 50)), (201, table[5][1]), (None, "only null here"), (None, "only null here"), (None, None), (300, "a b"), (301, "A b"), (302, "  ")]
    got = [tuple(r) for r in jaccard.similar_components(spark.createDataFrame(table, "doc_id long, text string"), **options).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    want = brute_components(table)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 20 < len({c for *_, c in want}) < 120


def test_workers_give_memory_back_after_the_jaccard_join(spark):
    def held(batches):
        def now():
            with open("/proc/self/smaps_rollup") as f:
                return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon:"))

        before = now()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield from (pa.RecordBatch.from_arrays([pa.array([(before - now()) / 1024])], ["mb"]) for _ in batches)

    docs = spark.range(0, 12000, 1, 4).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 400), x -> hex(xxhash64(id, x))), ' ') AS text")
    found = jaccard.similar_components(docs).collect()
    assert len(found) == 12000 and all(r["n_shingles"] == 397 and r["component_id"] == r["doc_id"] for r in found)
    idle = [r["mb"] for r in spark.range(0, 4, 1, 4).mapInArrow(held, "mb double").collect()]
    assert len(idle) == 4 and max(idle) < 8, idle


def test_links_inside_a_cell_join_what_all_pairs_join():
    rng = np.random.default_rng(3)
    for _ in range(60):
        m = int(rng.integers(2, 30))
        sets = [np.unique(rng.choice(14, 12)).astype(np.uint64) for _ in range(m)]
        label = rng.integers(0, 6, m) if rng.random() < 0.5 else np.arange(m)
        joined = lambda links, label=label, m=m: jaccard._flood(m, *(np.array(c, np.int64) for c in zip(*links, *[(int(np.argmax(label == label[x])), x) for x in range(m)], strict=True)))
        pairs = [(x, y) for x in range(m) for y in range(x) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 85 * len(np.union1d(sets[x], sets[y]))]
        out = jaccard.linked(sets, label, 85)
        assert (joined(out) == joined(pairs)).all() and len(out) < m


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    group = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(60):
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == group


def test_repeated_bytes(docs, rows):
    length = 200
    texts = [(i, (x or "").encode()) for i, x, _ in rows]
    seen = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    want = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) > 0).sum())
        want.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in suffixes.remove_repeated(docs, run_entries=7, range_entries=5).collect()]
    assert sorted(got) == sorted(want)


def test_repeated_bytes_around_a_hot_passage(spark):
    """A passage in hundreds of contexts, cut at both ends, is one gram's group with more windows than a pass compares."""
    rng = random.Random(23)
    passage = prose(rng, 60)[:230]
    texts = [(i, prose(rng, 40) + passage[rng.choice([0, 0, 20, 90]) :][: rng.choice([230, 230, 215, 100])] + prose(rng, 40)) for i in range(150)]
    length = 200
    seen = Counter(x.encode()[s : s + length] for _, x in texts for s in range(len(x.encode()) - length + 1))
    want = {}
    for i, x in texts:
        b = x.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        want[i] = bytes(np.frombuffer(b, np.uint8)[~gone])
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for options in ({"most_windows": 300, "most_ids": 0}, {"most_windows": 4_000_000}):
        assert {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeated(df, **options).collect()} == want
    assert sum(len(x) - len(want[i]) for i, x in texts) > 5000


def test_repeated_bytes_beyond_the_filters(spark, docs):
    want = sorted((r.doc_id, bytes(r.kept)) for r in suffixes.remove_repeated(docs).collect())
    for options in ({"most_grams": 0}, {"most_ids": 0}, {"most_grams": 0, "most_ids": 0}):
        assert sorted((r.doc_id, bytes(r.kept)) for r in suffixes.remove_repeated(docs, **options).collect()) == want


def test_texts_that_lose_nothing_are_not_moved(spark):
    rng = random.Random(31)
    letters = string.ascii_letters + string.digits
    own = lambda n: "".join(rng.choices(letters, k=n))
    passage, copy = own(300), own(4000)
    texts = [(i, own(4000) + ("#%!$"[i // 150] + passage if i % 150 == 0 else "")) for i in range(600)] + [(1000 + i, copy) for i in range(6)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4).localCheckpoint()

    def shuffled() -> int:
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before, bound = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: bytes(r.kept).decode() for r in suffixes.remove_repeated(df, most_ids=0).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert got == {i: "" if x == copy else x.replace(passage, "") for i, x in texts}
    assert shuffled() - before < sum(len(x) for _, x in texts) / 2


def test_filter_finds_what_was_put_in(spark):
    rng = np.random.default_rng(4)
    keys, others = rng.integers(-(1 << 63), 1 << 63, 9000), rng.integers(-(1 << 63), 1 << 63, 9000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    for most_bits in (bloom.MOST_BITS, 1 << 10):
        bits = bloom.built(df, len(keys), most_bits)
        assert bloom.might(bits, keys.view(np.uint64)).all()
    assert bloom.might(bloom.built(df, len(keys)), others.view(np.uint64)).mean() < 0.02
    assert not bloom.might(bloom.built(df.limit(0), 0), others.view(np.uint64)).any()
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(len(keys)) == 7)], ["key", "sure"])
    bits = bloom.built(df.where("key > 0"), len(keys))
    found, clear = (next(bloom.rows(bits, "key", x)(iter([batch]))).column("key").to_pylist() for x in (True, False))
    assert sorted(found + clear) == sorted(keys.tolist()) and all(k <= 0 for k in clear) and len(clear) > 4000
    assert int(keys[7]) in next(bloom.rows(bits, "key", bool(keys[7] < 0), "sure")(iter([batch]))).column("key").to_pylist()


def test_loser_tree_merges_with_known_prefixes():
    rng = random.Random(5)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        packed = [suffixes._pack([(x, b"", [1], [2]) for x in r]) for r in runs]
        out = list(suffixes.merge([suffixes._unpack(p) for p in packed]))
        keys = [x[1] for x in out]
        assert keys == sorted(x for r in runs for x in r)
        assert all(n == suffixes._common(a, b, 0) for a, (n, b, _) in zip(keys, out[1:], strict=False))


def longest_rising(pairs):
    """By comparing all pairs; of several longest ones the one whose members come last, judged from the end."""
    size = []
    for i, (_, y) in enumerate(pairs):
        size.append(1 + max((size[j] for j in range(i) if pairs[j][1] < y), default=0))
    out, want, y = [], max(size, default=0), float("inf")
    for i in range(len(pairs) - 1, -1, -1):
        if size[i] == want and pairs[i][1] < y:
            out, want, y = [pairs[i], *out], want - 1, pairs[i][1]
    return out


def plain_patience(one, two, a=0, c=0):
    """Patience diff by the textbook, in slices: how many lines match, and where."""
    head = 0
    while head < min(len(one), len(two)) and one[head] == two[head]:
        head += 1
    if head:
        return [(a + i, c + i) for i in range(head)] + plain_patience(one[head:], two[head:], a + head, c + head)
    tail = 0
    while tail < min(len(one), len(two)) and one[-1 - tail] == two[-1 - tail]:
        tail += 1
    if tail:
        return plain_patience(one[:-tail], two[:-tail], a, c) + [(a + len(one) - tail + i, c + len(two) - tail + i) for i in range(tail)]
    unique = longest_rising([(i, two.index(x)) for i, x in enumerate(one) if one.count(x) == 1 == two.count(x)])
    if unique:
        out, i, j = [], 0, 0
        for x, y in unique:
            out += plain_patience(one[i:x], two[j:y], a + i, c + j) + [(a + x, c + y)]
            i, j = x + 1, y + 1
        return out + plain_patience(one[i:], two[j:], a + i, c + j)
    nth = {(x, two[:j].count(x)): j for j, x in enumerate(two)}
    return [(a + i, c + j) for i, j in longest_rising([(i, nth[x, one[:i].count(x)]) for i, x in enumerate(one) if (x, one[:i].count(x)) in nth])]


def brute_alignment(table, rare):
    """The (deleted, moved) lines of each (doc_id, text), from texts compared in plain Python."""
    docs = sorted({(i, x or "") for i, x in table}, key=lambda r: (r[0] is not None, r[0] or 0))
    words = lambda line: tuple(re.findall(WORD, low(line)))
    content = [[(p, words(line)) for p, line in enumerate(x.split("\n")) if words(line)] for _, x in docs]
    holders: dict = {}
    for d, ls in enumerate(content):
        for a in range(len(ls)):
            b, n = a, 0
            while b < len(ls) and n < 20:
                n, b = n + len(ls[b][1]), b + 1
            if n >= 20:
                holders.setdefault(tuple(w for _, w in ls[a:b]), []).append((d, a, b))
    aligned, runs = [set() for _ in docs], [set() for _ in docs]
    for held in holders.values():
        for d, a, b in held:
            if d == held[0][0]:
                continue
            runs[d] |= {p for p, _ in content[d][a:b]}
            for e in {e for e, *_ in held if e < d} if len(held) <= rare else {held[0][0]}:
                found = plain_patience([w for _, w in content[d]], [w for _, w in content[e]])
                while found:
                    n = next((k for k in range(1, len(found)) if found[k] != (found[0][0] + k, found[0][1] + k)), len(found))
                    block, found = [content[d][i] for i, _ in found[:n]], found[n:]
                    if sum(len(w) for _, w in block) >= 20:
                        aligned[d] |= {p for p, _ in block}
    return {doc: (a | r, r - a) for doc, a, r in zip(docs, aligned, runs, strict=True)}


@pytest.mark.parametrize("rare", [8, 2])
def test_alignment(spark, rows, rare):
    rng = random.Random(11)
    lines = [prose(rng, rng.choice([3, 8, 12, 25])) for _ in range(30)]
    table = [(i, x) for i, x, _ in rows]
    for i in range(40):  # blocks of the same lines in all orders, with lines of their own between them
        parts = [lines[k : k + rng.randint(1, 5)] for k in rng.sample(range(28), 4)]
        table.append((400 + i, "\n".join(x for part in parts for x in [*part, prose(rng, 5), ""])))
    passages = prose(rng, 25), prose(rng, 25)
    table += [(500, "\n".join(passages)), (501, "\n".join(passages[::-1])), (502, "\n".join(passages[::-1])), (None, "\n".join(passages)), (503, None)]
    df = spark.createDataFrame([(i, x, "c", 7) for i, x in table], "doc_id long, text string, _places string, `_HASH` long")
    out = alignment.dedup_lines(df, rare=rare)
    assert out.columns == ["doc_id", "text", "_places", "_HASH", "n_lines", "n_deleted", "n_partners", "n_moved"]
    want = []
    brute = brute_alignment(table, rare)
    for i, x in table:
        gone, moved = brute[i, x or ""]
        want.append((i, x if not gone else "\n".join(line for p, line in enumerate(x.split("\n")) if p not in gone), len(gone), len(moved), "c", 7))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    got = [(r.doc_id, r.text, r.n_deleted, r.n_moved, r._places, r._HASH) for r in out.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 100 and any(r[3] for r in want)
    few = alignment.dedup_lines(df, rare=rare, most_broadcast=0)
    assert sorted(((r.doc_id, r.text) for r in few.collect()), key=key) == sorted(((r[0], r[1]) for r in want), key=key)


def test_alignment_of_a_hot_document_and_long_texts(spark):
    rng = random.Random(2)
    lines = [prose(rng, 22) for _ in range(3000)]
    table = [(i, lines[0] + f"\nown {i}\n" + prose(rng, 20)) for i in range(60)] + [(100, "\n".join(lines)), (101, "\n".join(lines[1:]))]
    df = spark.createDataFrame(table, "doc_id long, text string")
    gone = {r.doc_id: len(r.places) for r in alignment.deleted_lines(df, rare=2, hot_pairs=7).collect()}
    assert gone == {**dict.fromkeys(range(1, 60), 1), 100: 1, 101: 2999}


def test_patience():
    assert alignment.patience(list("abcdef"), list("xbcyef")) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    assert alignment.patience([], list("a")) == []
    rng = random.Random(4)
    for _ in range(50):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcde") for _ in range(rng.randint(0, 12))]
        out = alignment.patience(a, b)
        assert all(a[i] == b[j] for i, j in out) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(out, out[1:], strict=False))
        assert out == plain_patience(a, b)


@pytest.mark.parametrize("broadcast_windows", [200_000, 0])
def test_decontaminate(spark, docs, rows, broadcast_windows):
    sep = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    source = rows[2][1].split()
    items = [(1, " ".join(source[5:40])), (2, " ".join(source[30:45]).upper()), (3, "two words"), (4, ""), (5, None), (6, "nowhere to be found in this table of texts at all"), (10, " ".join(source[5:15])), (10, " ".join(source[5:15]))]

    def windows(text):
        w = re.findall(sep, low(text or ""))
        return {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} - {()}

    def brute(text):
        w = re.findall(sep, low(text or ""))
        hit, found = set(), set()
        for item, x in items:
            for g in windows(x):
                for s in range(len(w) - len(g) + 1):
                    if tuple(w[s : s + len(g)]) == g:
                        hit |= set(range(s, s + len(g)))
                        found.add(str(item))
        return len(w), len(hit), sorted(found)

    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, bench, broadcast_windows=broadcast_windows).collect()]
    assert sorted(got) == sorted((i, *brute(x)) for i, x, _ in rows)
    assert sum(r[2] for r in got) > 60


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontaminate_ties_and_text_ends(spark, most):
    rng = random.Random(31)
    sep = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["a", "A", "b", "É", "é", "ΣΑΣ", "7"]) for _ in range(n))
    texts = [(i, say(rng.randint(0, 60))) for i in range(120)]
    items = [(0, texts[3][1]), (1, say(10)), (2, say(14)), (3, say(9)), (4, "É a 7")]
    texts += [(201, None), (202, texts[3][1].replace("a", "A")), (None, items[2][1]), (202, items[1][1])]
    for i in range(10, 20):  # texts that end inside a window of an item, where they equal a shorter item
        tail = " ".join(f"{i}{x}" for x in "abcdefghi")
        items += [(i, tail + " last"), (i + 10, tail)]
        texts += [(i + 200, "x " + tail), (i + 200, "x " + tail)]

    def brute(text):
        w, hit, found = re.findall(sep, low(text or "")), set(), set()
        for item, x in items:
            v = re.findall(sep, low(x))
            for g in [v[i : i + 10] for i in range(max(len(v) - 9, min(len(v), 1)))]:
                for s in range(len(w) - len(g) + 1):
                    if w[s : s + len(g)] == g:
                        hit |= set(range(s, s + len(g)))
                        found.add(str(item))
        return len(w), len(hit), len(found), sorted(found)

    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs, bench, broadcast_windows=most, broadcast_texts=most).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"])) for r in out), key=key) == sorted(((i, *brute(x)) for i, x in texts), key=key)


def test_fingerprints_cost_little_more_than_words(spark):
    rng = random.Random(32)
    texts = spark.createDataFrame([(i, prose(rng, 400)) for i in range(200)], "doc_id long, text string")
    texts = texts.crossJoin(spark.range(20)).select(F.concat_ws(" ", "id", "text", "id").alias("text")).repartition(4).cache()
    texts.count()

    def seconds(value):
        took = []
        for _ in range(4):
            start = time.perf_counter()
            texts.select(F.sum(F.size(value))).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    w = decontaminate.words(F.col("text"))
    cost = seconds(decontaminate.let(w, lambda x: decontaminate.fingerprints(x, 10, 5))) / seconds(w)
    texts.unpersist()
    assert cost < 4.6  # 3.2 measured; 6.0 when each gram and each run of grams was an array of its own


def test_mixing(spark, docs, rows):
    out = mixing.mix(docs).collect()
    size = {}
    for _, x, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(WORD, x or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        target = {s: 3.0 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 3 * r.size and len(r.shards) == r.copies
    for s in order:
        assert abs(sum(r.taken for r in out if r.source == s) - target[s]) <= 60
    key = lambda r: (r.doc_id, r.copies, r.shards, r.orders)
    assert sorted(map(key, out)) == sorted(map(key, mixing.mix(docs.repartition(7), broadcast_sources=0).collect()))


def xx(*parts, seed=42):
    """Spark's chained 64-bit hash."""
    for p in parts:
        if p is not None:
            raw = p.encode() if isinstance(p, str) else p.to_bytes(*((4, "little") if isinstance(p, Int) else (8, "little")), signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Int(int):
    """A number that Spark hashes as four bytes."""


@pytest.mark.parametrize("blocks", [1024, 8, 1])
def test_mixing_draws_what_plain_python_draws(spark, blocks):
    rng = random.Random(31)
    table = [(i, prose(rng, rng.choice([0, 1, 5, 60, 200])) if i % 17 else None, rng.choice(["a", "b", "b", "b", "c", None])) for i in range(300)]
    table += [(1000 + i, "one two", "tiny") for i in range(2)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in table], "doc_id long, text string, source string, base int, left int, whole int, cut int")
    mixed = mixing.mix(df, blocks=blocks)
    out = {r.doc_id: r for r in mixed.collect()}
    assert len(out) == len(table) and out[0].base == 1 and out[0]["left"] == 2
    copies = {}
    for source in {s for *_, s in table}:
        own = [(xx(Int(7), i, x), i, len(re.findall(WORD, x or ""))) for i, x, s in table if s == source]
        total, target = sum(n for *_, n in own), out[next(i for _, i, _ in own)].target
        base = int(target / total + 1e-9) if total else 0
        left = round(target - base * total)
        copies |= {i: base for _, i, _ in own}
        block = lambda key: ((key % (1 << 64)) >> 20) % blocks
        for b in sorted({block(k) for k, *_ in own}):
            docs_of = sorted(r for r in own if block(r[0]) == b)
            if left <= 0:
                break
            size = sum(n for *_, n in docs_of)
            if size <= left:
                left -= size
                for _, i, _ in docs_of:
                    copies[i] += 1
                continue
            gap, last = left, None
            for r in docs_of:
                if r[2] > gap:
                    break
                gap, last = gap - r[2], r
                copies[r[1]] += 1
            open_ = [r for r in own if block(r[0]) > b or block(r[0]) == b and (last is None or r[:2] > last[:2])]
            fill = min(((abs(n - gap), k, i) for k, i, n in open_ if n and abs(n - gap) < gap), default=None)
            if fill:
                copies[fill[2]] += 1
            break
    assert {i: r.copies for i, r in out.items()} == copies
    rows = mixing.draws(mixed).collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in copies.items() if n})
    by_shard = {k: [r for r in rows if r.shard == k] for k in range(8)}
    for own in by_shard.values():
        assert [r.order for r in own] == sorted(r.order for r in own)
        assert len(own) < 10 or [r.doc_id for r in own] != sorted(r.doc_id for r in own)


def test_shards_are_written_in_shuffled_order(spark, docs, tmp_path):
    mixed = mixing.mix(docs)
    mixing.write_shards(mixed, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == mixed.agg(F.sum("copies")).first()[0]
    assert {r.shard for r in back.select("shard").distinct().collect()} == set(range(8))


def test_splitting_tree_is_exact(spark):
    quotas = spark.createDataFrame([("a", 37), ("b", 0), (None, 100)], "source string, quota long")
    rows = mixing.split_quotas(quotas, 3, 5).collect()
    for source, quota in (("a", 37), ("b", 0), (None, 100)):
        own = sorted((r.shard, r.quota, r.first) for r in rows if r.source == source)
        assert sum(q for _, q, _ in own) == quota and [s for s, *_ in own] == list(range(8))
        assert all(a[2] + a[1] == b[2] for a, b in zip(own, own[1:], strict=False))
    per = Counter()
    for r in rows:
        per[r.shard] += r.quota
    assert max(per.values()) - min(per.values()) <= 1


TURNS = [(1, 0, "system", "be [brief]"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "back\\slash <\\ [\\ <<"), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (2, 2, "to[ol", "x"), (None, 5, "user", "é\n"), (None, 6, "assistant", "漢字 [/INST]")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, 1) for r in TURNS], "conv_id long, turn long, role string, text string, position long")
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    for conv in (1, 2, None):
        turns = sorted(((n, r or "", x or "") for c, n, r, x in TURNS if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert not got[conv].rewrites
    assert chat.digest(chat.format_turns(df.where("false"))).count() == 0


class Rewriting(chat.InstructTemplate):
    """Marks the last turn, and so rewrites the one before."""

    memory = None

    def render(self, messages):
        return "".join(self._turn(*m) for m in messages[:-1]) + ("!" + self._turn(*messages[-1]) if messages else "")


def test_rewriting_templates_are_found():
    state = chat.Incremental(Rewriting())
    for role in ("user", "assistant", "user"):
        state.feed(role, "hello")
    assert state.rewrites
    state = chat.Incremental(chat.InstructTemplate())
    chunks = [state.feed("user" if i % 2 == 0 else "assistant", f"text {i}")[0] for i in range(20)]
    assert "".join(chunks) == chat.InstructTemplate().render([("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(20)])


class Numbered(chat.InstructTemplate):
    """Numbers its turns, so each depends on how many stand before it; drops turn 5 once there are `most`."""

    memory = None

    def __init__(self, most=10**9):
        self.most = most

    def render(self, messages):
        return "".join(f"{i}:" + self._turn(*m) for i, m in enumerate(messages) if i != 5 or len(messages) < self.most)

    def read(self, chunk):
        return super().read(chunk.partition(":")[2])


def test_prefixes_are_whole_in_long_conversations(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"text <{i}>") for i in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_turns(df, Numbered()).collect(), key=lambda r: r.position)
    assert "".join(r.chunk for r in rows) == Numbered().render([(r, x) for *_, r, x in turns])
    assert [chat.InstructTemplate().unescape(r.chunk[r.text_start - r.span_start : r.text_end - r.span_start]) for r in rows] == [x for *_, x in turns]
    assert not any(r.rewrites for r in rows)
    late = chat.digest(chat.format_turns(df, Numbered(most=150)), Numbered()).first()
    assert late.rewrites and late.turns_sha256 is None and late.n_turns == 200


def test_a_threshold_is_a_bound(spark):
    counts = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    rng = random.Random(1)
    for df, most in ((counts(*[200_000] * 50), 10), (counts(*range(200_000, 200_050)), 10), (counts(*[rng.randrange(1, 10**6) for _ in range(500)]), 100), (counts(5, 5, 5), 2)):
        assert df.where(F.col("n") >= lm._threshold(df, most)).count() <= most
    assert lm._threshold(counts(3, 4), 5) <= 3 and lm._threshold(counts(1, 2, 2, 9), 3) == 2


def test_escape_round_trip():
    rng = random.Random(6)
    template = chat.InstructTemplate()
    for _ in range(300):
        text = "".join(rng.choice("<[\\]>/sINST a") for _ in range(rng.randint(0, 20)))
        assert template.unescape(template.escape(text)) == text
        assert not re.search(r"</?s>|\[/?INST\]", template.escape(text))


def test_language_model(spark, docs, rows):
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    import zlib

    train = [(x or "") for i, x, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for x in train for w in [*re.findall(WORD, low(x)), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, x, _ in rows:
        words = [*re.findall(WORD, low(x or "")), None]
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((i, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    for most_words in (300_000, 5):
        out = lm.score(docs, learn, most_words=most_words).collect()
        assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == sorted(want)
        assert all(np.isfinite(r.score) and r.score < 0 for r in out)


def test_language_model_drops_no_count(spark, docs, rows):
    """Scores by plain Python from all counts, however few entries are sent to the executors."""
    learnt = lambda i: i is None or i % 3 > 0
    symbols = lambda x: [lm._PAD] * lm.ORDER + list((x or "").encode()) + [lm._END]
    after: dict[tuple, Counter] = {}
    for i, x, _ in rows:
        s = symbols(x)
        for p in range(lm.ORDER, len(s)) if learnt(i) else ():
            for d in range(lm.ORDER + 1):
                after.setdefault(tuple(s[p - d : p]), Counter())[s[p]] += 1

    def log10(context, symbol):
        p, gone = 0.0, set()
        for d in range(lm.ORDER, -1, -1):
            counts = {c: n for c, n in after.get(context[len(context) - d :], {}).items() if c not in gone}
            if not counts:
                continue
            total = sum(counts.values()) + len(counts)
            if symbol in counts:
                return p + np.log10(counts[symbol] / total)
            p += np.log10(len(counts) / total)
            gone |= set(counts)
        return p - np.log10(256 - len(gone))

    want = []
    for i, x, _ in rows:
        s = symbols(x)
        want.append((i, round(sum(log10(tuple(s[p - lm.ORDER : p]), s[p]) for p in range(lm.ORDER, len(s))), 6)))
    for most_entries in (400_000, 20, 0):
        out = lm.score(docs, F.col("doc_id") % 3 > 0, most_entries=most_entries).collect()
        assert sorted((r.doc_id, round(r.score, 6)) for r in out) == sorted(want)


def test_probabilities_sum_to_one():
    texts = ["the cat sat on the mat", "the dog sat", "aaaa", "é漢"]
    grams = []
    for _, _, x in t.slices(pa.array(texts)):
        grams.append(np.unique(lm._keys(x)[0], return_counts=True))
    top = lm._count(grams)
    levels = [lm._count([(top[0] & np.uint64((1 << 8 * (d + 1)) - 1), top[1])]) for d in range(lm.ORDER + 1)]
    trie = lm.Trie(levels)
    for context in [*(top[0] >> np.uint64(8))[:20], np.uint64(0x4142434445)]:
        p = 10 ** trie.log10((context << np.uint64(8)) | np.arange(256, dtype=np.uint64))
        assert abs(p.sum() - 1) < 1e-9
    assert np.allclose(lm.Scorer(trie).log10(top[0]), trie.log10(top[0]))


def test_quality(spark):
    rng = random.Random(9)
    table = []
    for i in range(400):
        good = i % 3 > 0
        text = prose(rng, 60)
        table.append((i, text if good else " ".join(w + "###" for w in text.split()), int(good)))
    table += [(1000, None, 1), (1001, "", None)]
    df = spark.createDataFrame([(i, x, "en", "s", 0.5) for i, x, _ in table], "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in table if i != 1], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in quality.classify(df, labels).collect()}
    assert set(out) == {i for i, *_ in table} and all(0 <= s <= 1 for s in out.values())
    assert np.mean([(out[i] >= 0.3) == bool(q) for i, _, q in table[:400]]) > 0.97
    one = {r.score for r in quality.classify(df, labels.where("quality = 1")).collect()}
    assert len(one) == 1 and next(iter(one)) > 0.9
    few = {r.score for r in quality.classify(df, labels.where("doc_id < 12")).collect()}
    assert len(few) == 1


def test_document_vectors_are_plain_means():
    rng = random.Random(14)
    texts = [prose(rng, n) + "  12!? Ab\n" for n in (1, 7, 60_000, 300)] + ["", "x", None]
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    for _, _, x in t.slices(pa.array(texts), 1 << 30):
        b, bound = quality._pieces(x)
        got = quality.features(x, vectors)
        for i, text in enumerate(texts):
            assert bound[i + 1] - bound[i] == len(re.findall(r"[A-Za-z]+|[0-9]+|\n+|[^A-Za-z0-9\s]+", text or ""))
            v = vectors[b[bound[i] : bound[i + 1]]].astype(np.float64)
            want = np.concatenate([v.mean(0), v.std(0), (v[:-1] * v[1:]).sum(0) / len(v)]) if len(v) else np.zeros(quality.N_FEATURES)
            assert np.allclose(got[i], want, atol=1e-3)


def test_context_vectors_by_plain_python(spark):
    rng = random.Random(15)
    table = [(i, " ".join(rng.choice(["a", "bb", "Cc", "d1", "!"]) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(99, None)]
    bucket = lambda w: int(quality._pieces(next(iter(t.slices(pa.array([w]))))[2])[0][0])
    place, sign = quality._index_vectors(11)
    total, seen = np.zeros((quality.BUCKETS, quality.DIM)), Counter()
    for _, x in table:
        words = [bucket(w) for w in re.findall(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]+", x or "")]
        seen.update(words)
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                turn = 7 * (abs(i - j) - 1) + 3 * (j > i)
                for k in range(quality.ONES) if i != j else ():
                    total[w, (place[words[j], k] + turn) % quality.DIM] += sign[words[j], k]
    share = np.array([seen[b] for b in range(quality.BUCKETS)]) / sum(seen.values())
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1) * (1e-3 / (1e-3 + share))[:, None]
    got = quality.word_vectors(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    assert np.allclose(got, want, atol=1e-6)


def test_quality_holds_its_tables_about_once_on_the_driver(spark):
    def peak(work):
        tracemalloc.start()
        try:
            return work(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    random_ = np.random.default_rng(2)
    x = random_.normal(3, 2, (8000, quality.N_FEATURES)).astype(np.float32)
    y = (x[:, 0] > 3).astype(float)
    network, most = peak(lambda: quality.Network(epochs=2).fit(x, y))
    assert most < x.nbytes
    assert np.allclose(network.mean, x.astype(np.float64).mean(0)) and np.allclose(network.scale, x.astype(np.float64).std(0), atol=1e-5)
    assert np.mean((network.score(x) >= 0.5) == (y == 1)) > 0.9
    vectors, most = peak(lambda: quality.word_vectors(spark.createDataFrame([(1, "a b a")], "doc_id long, text string")))
    assert vectors.dtype == np.float32 and most < 2.5 * vectors.nbytes


PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>'</script></head><body class='nav-open'><div class='menu'><ul><li>Home<li>About</ul></div>{body}<div id='box'>Same on all pages</div><footer>foot</footer></body></html>"


def test_main_text(spark):
    article = "<header><h1>Title &amp; more</h1></header><p>First <b>bold<br>line<p>Second  &copy;\n x<div class='ad'>buy</div><section class=comments><p>nice</section><span class='promo'>p</span><p>A<span class='ad'>no</span>B"
    table = [(1, "http://a.org/x", PAGE.replace("{body}", f"<article>{article}</article>")), (2, None, None), (3, "nonsense", ""), (4, "http://b.org", "plain &lt;text&gt;<!-- c --> more<p>")]
    rng = random.Random(7)
    own = {}
    for i in range(40):
        own[100 + i] = prose(rng, 12)
        table.append((100 + i, "http://c.org/" + str(i), PAGE.replace("{body}", f"<div class='text{i}'><p>{own[100 + i]}</p></div>")))
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    assert got[1] == "Title & more\nFirst bold line\nSecond © x\nAB"
    assert (got[2], got[3], got[4]) == ("", "", "plain <text> more")
    for i, text in own.items():
        assert got[i] == text  # the box that every page repeats is of low importance


def extracted(spark, table, **options):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(table, "page_id long, url string, html string"), **options).collect()}


def test_importance_decides_inside_articles_and_on_small_hosts(spark):
    rng = random.Random(17)
    table, want, plain = [], {}, {}
    for host, n, inside in (("one.org", 3, False), ("two.org", 30, False), ("three.org", 30, True), ("four.org", 2, True)):
        for i in range(n):
            page, own = len(table), [prose(rng, 12), prose(rng, 9)]
            box = f"<div class='k4'><b>Read by {rng.randrange(10**6)} people</b><p>Join us and never miss a story</p></div>"
            menu = "<div class='q7'>" + "".join(f"<span><a href='/{prose(rng, 1)}'>{prose(rng, 2)}</a></span> " for _ in range(6)) + "</div>"
            body = f"{menu}{box}<div class='z1'><p>{own[0]}</p><p>{own[1]}</p></div>" if not inside else f"{menu}<article><h1>{own[0]}</h1>{box}<p>{own[1]}</p></article>"
            table.append((page, f"https://{host}/{i}", f"<html><body>{body}</body></html>"))
            keep_box = host == "four.org"  # two pages say too little
            said = re.search("Read by \\d+ people", box)[0]
            want[page] = "\n".join([own[0], said, "Join us and never miss a story", own[1]] if keep_box else own)
            plain[page] = said
    got = extracted(spark, table)
    assert got == want
    without = extracted(spark, table, least_importance=0.0)  # no branch is removed
    changed = [i for i in want if without[i] != want[i]]
    assert len(changed) == 63 and all(plain[i] in without[i] for i in want)


def test_names_of_content_stay(spark):
    parts = ["<section id='related-work'><h2>Related work</h2><p>Others did it</p></section>", "<h2 id='promotion'>Promotion</h2>", "<div class='search-engine-history'><p>Engines</p></div>", "<p id='comments'>On comments</p>"]
    noise = ["<div class='ad-slot'>buy</div>", "<div id='comments'><p>nice</p></div>", "<ul class='navMenu'><li>Home</ul>", "<div class='cookie-notice'>cookies</div>", "<div role='complementary'>side</div>", "<section class='user-comments'><p>me too</p></section>"]
    teaser = "<main><article>short</article><p>" + "The long body of the page. " * 5 + "</p></main>"
    got = extracted(spark, [(1, "http://a.org/1", f"<article>{''.join(parts + noise)}</article>"), (2, "http://b.org/1", teaser)])
    assert got[1] == "Related work\nOthers did it\nPromotion\nEngines\nOn comments"
    assert got[2] == "short\n" + " ".join(["The long body of the page."] * 5)


def test_copies_of_a_page_do_not_make_it_presentation(spark):
    rng = random.Random(18)
    text = prose(rng, 30)
    table = [(i, "http://a.org/x", f"<script>track({i})</script><article><p>{text}</p></article>") for i in range(50)]
    table += [(100, "http://b.org/1", "<p>" + "long text " * 60_000 + "</p>"), (101, "http://b.org/2", "<div>" * 3000 + "deep")]
    got = extracted(spark, table)
    assert {got[i] for i in range(50)} == {text} and len(got[100]) == 599_999 and got[101] == "deep"


def test_words_never_cross_documents():
    for _, _, x in t.slices(pa.array(["ab", "", "cd e", None, " ", "f\n"])):
        first, last = x.words()
        assert [bytes(x.data[a:b]) for a, b in zip(first, last, strict=True)] == [b"ab", b"cd", b"e", b"f"]
        assert x.bounds(first).tolist() == [0, 1, 1, 3, 3, 3, 4]
        start, end = x.lines()
        assert [bytes(x.data[a:b]) for a, b in zip(start, end, strict=True)] == [b"ab", b"", b"cd e", b"", b" ", b"f", b""]
        assert x.line_bounds().tolist() == [0, 1, 2, 3, 4, 5, 7]


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        lines.line_frequency(empty), jaccard.similar_components(empty), suffixes.remove_repeated(empty), alignment.dedup_lines(empty), decontaminate.contamination(empty, bench),
        mixing.mix(empty), lm.score(empty, F.lit(True)), quality.classify(empty, labels), html.main_text(pages),
    ):
        assert df.collect() == []


def test_no_letters_are_lost():
    assert set(string.ascii_lowercase) == {chr(c) for c in t.LOWER[65:91]}
