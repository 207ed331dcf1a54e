import random
import sys
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import test_op4
import test_op6
import test_op10
import numpy as np

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA).repartition(4)


def of(df):
    return sorted((str(r.doc_id), str(r.text), r.source) for r in df.collect())


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = [(i, t, "s") for i, t in test_op6.corpus(5, 25, 8)]
    got = C.near_duplicates(spark, frame(spark, rows), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    plain = [(i, t) for i, t, _ in rows]
    blank = [(str(i), str(t), "s") for i, t in plain if not test_op6.grams(t)]
    sets = {}
    for i, t in plain:
        sets[(i, t)] = test_op6.grams(t)
    keys = [k for k in sets if sets[k]]
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in keys:
        for b in keys:
            n = len(sets[a] & sets[b])
            if a != b and n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                up[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).append(k)
    kept = of(got)
    assert len(kept) == len(groups) + len(blank) and all(b in kept for b in blank)
    for own in groups.values():
        ids = [i for i, _ in own if i is not None]
        assert sum((str(i), str(t), "s") in kept for i, t in own) >= 1
        assert not ids or any((str(i), str(t), "s") in kept for i, t in own if i == min(ids))


def test_decontaminate_drops_exactly_the_hit_documents(spark, tmp_path):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "x " + items[0][1] + " y"), (2, "a Short, ITEM b"), (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (None, "short item")]
    want = sorted((str(i), str(t), "s") for i, t in docs if not any(r[2] for r in test_op4.brute([(i, t)], items)))
    assert of(C.decontaminate(spark, frame(spark, [(*d, "s") for d in docs]), str(tmp_path))) == want


def test_mix_repeats_documents_as_taken(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 20))), r.choice("abcd")) for i in range(200)] + [(None, "x y", "a"), (3, None, "b")]
    docs = frame(spark, rows)
    taken = {}
    for x in C.op9_mix.mix(docs).collect():
        taken[x.doc_id, x.size] = taken.get((x.doc_id, x.size), 0) + x.taken
    got = {}
    for x in C.mix(spark, docs, "").collect():
        n = len((x.text or "").split())
        got[x.doc_id, n] = got.get((x.doc_id, n), 0) + n
    assert got == {k: v for k, v in taken.items() if v}


def test_quality_drops_what_the_score_rejects(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, test_op10.junk(i, rng), "s") for i in range(300)]
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {int(r[0]) for r in of(C.quality(spark, frame(spark, rows), str(tmp_path)))}
    want = {i for i in range(300) if i % 4}
    assert len(got ^ want) <= 6


def test_run_end_to_end(spark):
    sf = "/root/testdata/sf0.001"
    got = C.run(spark, sf).orderBy("start").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    assert got
    for r in got:
        assert r.start == at and r.n_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
        at += r.n_tokens


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_further_columns_ride_along_whatever_their_names(spark, tmp_path):
    names = ["doc_id", "text", "source", "k", "k1", "k2", "many", "n", "i", "row", "score", "_score", "a.b"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names[3:])
    rng = np.random.default_rng(3)
    good = [test_op10.junk(4 * i + 1, rng) for i in range(60)]
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(i, t, "s" if i % 3 else None, *[f"{n}{i}" for n in names[3:]]) for i, t in enumerate([*good, long, None, ""])]
    rows += [(1, good[1], "s", *["other"] * 10), rows[2], (None, good[5] + " x", None, *[None] * 10)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words at all in any of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names, name
        got = [tuple(r) for r in out.collect()]
        assert all(r in rows for r in got), name
        if name == "near_duplicates":
            assert got.count(rows[2]) == 1 and len(got) == len({t for _, t, *_ in rows[:-1]})
        if name == "mix":
            assert len(got) > len(rows) and all(got.count(r) <= 2 * rows.count(r) for r in rows)
            assert sorted(map(str, got)) == sorted(map(str, [tuple(r) for r in stage(spark, docs.repartition(5), "").collect()]))
    assert C.tokens(spark, docs, "").count() == len(rows)
