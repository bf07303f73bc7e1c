"""The corpus pipeline on a small corpus whose right result is known by construction."""

from __future__ import annotations

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    at = str(tmp_path_factory.mktemp("corpus"))
    item = prose(rng, 30)
    clean = [prose(rng, 80) for _ in range(150)]
    rows = [(i, x, "en", f"s{i % 2}", len(x)) for i, x in enumerate(clean)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "s0", 1) for i in range(80)]
    near = clean[0].split(" ")
    near[40] = "changed"
    block = "\n".join(prose(rng, 25) for _ in range(2))
    rows += junk
    rows += [(2000, clean[1], "en", "s0", 1), (2001, " ".join(near), "en", "s0", 1), (2002, item + " " + prose(rng, 50), "en", "s1", 1)]
    rows += [(2010, prose(rng, 60) + "\n" + block, "en", "s1", 1), (2011, block + "\n" + prose(rng, 60), "en", "s1", 1), (2012, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(150)] + [(1000 + i, 0, 0) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert len([i for i in kept["quality"] if 1000 <= i < 2000]) <= 2 and len([i for i in kept["quality"] if i < 150]) >= 148
    lines = kept["line_dedup"]
    assert 2000 not in lines  # an exact copy has nothing left
    assert 2011 not in lines or lines[2011].text.count("\n") == 0 and lines[2011].n_chars == len(lines[2011].text)
    assert set(kept["line_dedup"]) - set(kept["jaccard"]) <= {2001, 0} and not {0, 2001} <= set(kept["jaccard"])
    assert set(kept["jaccard"]) - set(kept["decontaminate"]) <= {2002} and 2002 not in kept["decontaminate"]
    size = {}
    for r in kept["decontaminate"].values():
        size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in kept["mix"].values():
        assert r.copies > 0 and r.taken == r.copies * r.size and r.source_size == size[r.source]
    for s in size:
        own = [r for r in kept["mix"].values() if r.source == s]
        if own:
            assert abs(sum(r.taken for r in own) - own[0].target) < 100


def test_repeated_ids_leave_one_row(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "x"), (None, None)], "doc_id long, text string").withColumns({})
    out = corpus_pipeline.jaccard_stage(spark, docs, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 1), (False, 3), (True, 0)]


def test_near_copies_from_four_fifths_go(spark, folder):
    rng = random.Random(21)
    words = [f"{prose(rng, 1)}{i}" for i in range(1000)]
    changed = list(words)
    for i in range(22):
        changed[20 + 44 * i] = f"changed{i}"
    texts = {1: words, 2: words[:820], 3: changed, 4: words[:780]}

    def similarity(a, b, k):
        one, two = ({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} for x in (texts[a], texts[b]))
        return len(one & two) / len(one | two)

    assert all(similarity(1, i, 5) >= 0.8 and similarity(1, i, 4) < 0.85 for i in (2, 3))
    assert similarity(1, 4, 5) < 0.8 and similarity(3, 4, 5) < 0.8 <= similarity(2, 4, 5)
    pair = lambda *ids: spark.createDataFrame([(i, " ".join(texts[i])) for i in ids], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.jaccard_stage(spark, pair(1, 2, 3), folder).collect()] == [1]
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_stage(spark, pair(1, 4), folder).collect()) == [1, 4]
