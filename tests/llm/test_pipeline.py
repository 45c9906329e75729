"""The pipeline on a small corpus, each stage against a plain version of it."""

import random
from collections import Counter

import corpus_pipeline as cp

from wavejobs.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    docs, labels, toxic, near, leaks = [], [], set(), {}, set()
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(10)]
    for d in range(400):
        text = rng.choices(words, k=rng.randint(30, 200))
        if d % 8 == 0:
            toxic.add(d)
            text[5:5] = ["scum", "vile", "moron"]
        elif d % 8 == 1 and d > 10:
            leaks.add(d)
            at = rng.randrange(len(text))
            text[at:at] = rng.choice(items)[1].split()
        elif d % 8 == 2 and d > 10:
            near[d] = d - 8 if d - 8 in near or d == 18 else d - 8
            text = docs[d - 8][1].split() if d > 18 else text
        docs.append((d, " ".join(text), "en", f"s{rng.choice((0, 0, 0, 1, 2))}", 0))
        labels.append((d, 1, int(d in toxic)))
    docs += [(None, "no id here", "en", "s1", 0), (500, None, None, None, None), (501, "", "en", "s1", 0)]
    return docs, labels, items, toxic, leaks


def test_stages(spark, tmp_path):
    docs, labels, items, toxic, leaks = corpus()
    frame = spark.createDataFrame(docs, DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    names, functions = zip(*cp.STAGES)
    assert names == ("toxicity", "simhash", "decontamination", "mixing", "sharding")

    def step(i, df):
        out = functions[i](spark, df, sf)
        if i < 4:
            assert out.columns == frame.columns
        path = f"{tmp_path}/{i}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    one = step(0, frame)
    assert ids(one) == sorted((r[0] for r in docs if r[0] not in toxic), key=str)
    two = step(1, one)
    first = {}
    for d, t, *_ in docs:
        if d is not None and d not in toxic:
            first.setdefault(t or "", d)
    assert ids(two) == sorted([*first.values(), None], key=str)
    three = step(2, two)
    assert ids(three) == sorted((d for d in [*first.values(), None] if d not in leaks), key=str)


CLASH = DOCS + ", t long, row string, h int, id long, key1 long, copies int, component_id string"


def test_rows_under_one_id_and_clashing_names(spark):
    one, other = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(5, one), (5, other), (5, one), (6, one), (7, None), (8, ""), (None, one), (None, one)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 1, "x", 2, 3, 4, 5, "y") for d, t in rows], CLASH)
    stay = cp.near_copies_out(spark, docs, "")
    assert stay.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in stay.collect()), key=repr) == sorted([(5, one), (5, other), (7, None), (None, one), (None, one)], key=repr)
    taken = cp.mixed(spark, docs, "")
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in mixing.mix(docs).collect())


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_mixing_and_sharding_stages(spark):
    rows = [r for r in corpus()[0] if r[0] is not None][:120]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = cp.mixed(spark, docs, "").persist()
    copies = Counter({(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect() if r.copies})
    assert mixed.columns == docs.columns and Counter((r.doc_id, r.source) for r in mixed.collect()) == copies
    slots = {}
    for r in cp.sharded(spark, mixed, "").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40)) and sum(map(len, slots.values())) == sum(copies.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_feeds_each_stage_the_one_before(spark, tmp_path, monkeypatch):
    spark.createDataFrame(corpus()[0], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def stage(name, keep):
        def f(session, docs, sf_dir):
            seen.append((name, docs.count(), sf_dir))
            return docs.where(keep)

        return name, f

    monkeypatch.setattr(cp, "STAGES", [stage("a", "doc_id % 2 = 0"), stage("b", "doc_id % 3 = 0"), stage("c", "doc_id > 100")])
    out = cp.run(spark, str(tmp_path))
    evens = [r[0] for r in corpus()[0] if r[0] is not None and r[0] % 2 == 0]
    assert sorted(r.doc_id for r in out.collect()) == [d for d in sorted(evens) if d % 3 == 0 and d > 100]
    assert [x[:2] for x in seen] == [("a", 403), ("b", len(evens)), ("c", len([d for d in evens if d % 3 == 0]))]


def test_take_shares_repeated_rows(spark):
    rows = [(1, "a b c d", "en", "s", 0)] * 3 + [(2, "x y", "en", "t", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    taken = sum(r.copies for r in mixing.mix(df).collect())
    assert mixing.take(df).count() == taken and mixing.take(df).columns == df.columns
    assert mixing.take(df.limit(0)).collect() == []


def test_run_on_rows(spark, tmp_path):
    """The whole pipeline with its real stages: which documents are left, how often the mix takes them, and their shards."""
    docs, labels, items, toxic, leaks = corpus()
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = {}
    for d, t, *_ in docs:
        if d is not None and d not in toxic:
            first.setdefault(t or "", d)
    kept = [r for r in docs if r[0] is None or (r[0] in first.values() and r[0] not in leaks)]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(kept, DOCS)).collect()}
    out = cp.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter({d: n for d, n in copies.items() if n})
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
