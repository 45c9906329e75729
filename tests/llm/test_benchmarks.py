"""Benchmark decontamination: plain, re-parameterised and inconsistent copies."""

import random
import re

from wavejobs.llm import benchmarks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t long, item_id string"
ITEM = "A train leaves with Alice at 9 and covers 120 km in 3 hours, then Alice walks 5 km to the station of Bern. How many hours does Alice need for all of the way?"


def judged(spark, docs, items):
    rows = [(d, t, "en", "s", 0, 1, "clash") for d, t in docs]
    got = benchmarks.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    return got


def test_slots(spark):
    other = ITEM.replace("Alice", "Robert").replace("120", "450.5").replace("Bern", "Ulm").replace("km", "miles")
    numbers = ITEM.replace("120", "450").replace("3 hours", "7 hours").replace("at 9", "at 8").replace("5 km", "6 km")  # too few literal windows are left
    mixed = numbers.replace("Alice", "Robert", 1)  # one name in three places becomes two
    merged = numbers.replace("Bern", "Alice")  # two names become one
    docs = [(1, "Some words before. " + ITEM + " And after."), (2, "intro " + other), (3, mixed), (4, merged), (5, ITEM[: len(ITEM) // 2]), (6, "nothing of the kind here at all")]
    docs += [(7, numbers), (8, ITEM.lower()), (9, ITEM.upper()), (10, ITEM.replace(" ", "\n")), (11, ITEM.replace("hours, then", "hours, and so then"))]
    got = {r.doc_id: (r.contaminated, list(r["items"])) for r in judged(spark, docs, [(7, ITEM)])}
    assert got == {**{d: (True, [7]) for d in (1, 2, 7, 8, 9, 10, 11)}, **{d: (False, []) for d in (3, 4, 5, 6)}}


def test_names_at_sentence_starts(spark):
    item = "Tom has 3 apples. Tom buys 4 more from Anna. How many apples does Tom have now, after all?"
    changed = "Ben has 5 apples. Ben buys 8 more from Rosa. How many apples does Ben have now, after all?"
    swapped = "Ben has 5 apples. Rosa buys 8 more from Rosa. How many apples does Ben have now, after all?"
    got = {r.doc_id: r.contaminated for r in judged(spark, [(1, changed), (2, swapped), (3, "Well. " + changed)], [(1, item)])}
    assert got == {1: True, 2: False, 3: True}


def test_windows_that_are_not_one_occurrence(spark):
    words = ITEM.split()
    scattered = " ".join(" ".join(words[i : i + 5]) + f" filler{i} " * 40 for i in range(len(words) - 4))
    got = {r.doc_id: r.contaminated for r in judged(spark, [(1, scattered), (2, ITEM + scattered)], [(7, ITEM)])}
    assert got == {1: False, 2: True}


def test_template_windows_that_many_items_share(spark):
    stem = "How many of the items does each of them have at the end of the day in total if"
    items = [(i, f"{stem} subject{i} keeps part{i} and leaves rest{i} for later{i}") for i in range(150)]
    docs = [(d, f"{stem} " * 20 + f"own{d} text{d}") for d in range(80)] + [(1000, items[17][1].replace("later17", "After"))]
    got = {r.doc_id: list(r["items"]) for r in judged(spark, docs, items)}
    assert got == {**{d: [] for d in range(80)}, 1000: [17]}


def test_edge_cases(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfghjk" for b in ("aeb", "omu", "iru", "ela", "ust")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 40)))) for i in range(12)] + [(90, None), (91, ""), (None, "null id item of some words"), (92, "two words")]
    docs = []
    for d in range(80):
        text = rng.choices(words, k=rng.randint(0, 120))
        if d % 4 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = items[d % 12][1].upper().split() if d % 8 else items[d % 12][1].split()
        docs.append((d, " ".join(text)))
    docs += [(None, items[3][1]), (5, "again " + items[5][1]), (200, None), (201, ""), (202, "?!"), (203, "Two, words")]

    def slow(text):
        tokens = re.findall(r"[^\W_]+", (text or "").lower())
        have = {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))}
        out = []
        for i, t in items:
            w = re.findall(r"[^\W_]+", (t or "").lower())
            need = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            if i is not None and w and len(need & have) >= 0.8 * len(need):
                out.append(i)
        return out

    got = sorted(((r.doc_id, list(r["items"]), r.contaminated) for r in judged(spark, docs, items)), key=repr)
    assert got == sorted(((d, slow(t), bool(slow(t))) for d, t in docs), key=repr)
    empty = spark.createDataFrame([], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert benchmarks.decontaminate(empty, none).collect() == []
    some = spark.createDataFrame([(1, "text", "en", "s", 0, 1, "")], DOCS)
    assert [r.contaminated for r in benchmarks.decontaminate(some, none).collect()] == [False]


def test_hot_windows(spark):
    rng = random.Random(4)
    table = lambda n: " ".join(str(x) for x in rng.sample(range(10_000), n))
    items = [(i, table(60)) for i in range(10)] + [(50, "5 " * 20)]
    docs = [(d, table(800)) for d in range(30)] + [(100, " ".join(["7"] * 300)), (101, "plain words only " * 30), (102, table(50) + " " + items[3][1]), (103, "5 " * 100)]
    got = {r.doc_id: list(r["items"]) for r in judged(spark, docs, items)}
    assert got == {**{d: [] for d in range(30)}, 100: [], 101: [], 102: [3], 103: [50]}  # windows of numbers alone are no templates


def test_against_the_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(8)
    names, verbs = ["Ann", "Bob", "Cy", "Dee"], "buys sells finds keeps the old small red and one of with".split()
    def story(r, n):  # noqa: E306
        return " ".join(r.choice((r.choice(names), r.choice(verbs), r.choice(verbs), str(r.randint(1, 9)), r.choice(("km", "hours")))) + r.choice(("", "", ".", ",")) for _ in range(n))

    items = [(i, story(rng, rng.randint(2, 40))) for i in range(15)] + [(50, "3 4 5 6 7 8"), (51, None), (52, "")]
    docs = []
    for d in range(60):
        text = items[d % 15][1].split()
        for _ in range(d % 4):
            text[rng.randrange(len(text))] = story(rng, 1)
        if d % 3 == 0:
            swap = dict(zip(names, rng.sample(names, 4)))
            text = [swap.get(w, w) for w in text]
        docs.append((d, " ".join(story(rng, 10).split() + text + story(rng, 10).split())))
    docs += [(100, None), (101, ""), (102, "1 2 3 4 5 6 7 8 9")]
    frame = spark.createDataFrame([(d, t, "en", "s", 0, 1, "c") for d, t in docs], DOCS)
    frame.write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark")
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = sorted((d, c, i, round(v, 9)) for d, c, i, v in duckdb.sql(benchmarks.ORACLE).fetchall())
    got = benchmarks.decontaminate(frame, spark.read.parquet(f"{tmp_path}/benchmark")).collect()
    assert sorted((r.doc_id, r.contaminated, list(r["items"]), round(r.covered, 9)) for r in got) == want
    assert 5 < sum(w[1] for w in want) < 60


STORY = "Alice has 3 boxes of pears in the yard. Each of the boxes of Alice weighs 12 kg. Later on Bob takes 3 of the boxes from Alice away. How many kg of pears are then left in the yard for Bob and his friends?"


def filled(text, **names):
    """The text with each word, number or unit named replaced; names of digits are written n3."""
    return re.sub(r"\w+", lambda m: names.get(m[0] if not m[0].isdigit() else f"n{m[0]}", m[0]), text)


def test_slots_over_a_whole_occurrence(spark):
    """What is a copy is known from how a text is made, not from windows: consistent fillings are, those that change midway aren't, whatever stands between."""
    half = STORY.index("Later")
    one = {"Alice": "Maria", "n3": "7", "n12": "55", "Bob": "Ulrich", "kg": "pounds"}
    two = {**one, "Alice": "Ben", "n3": "8"}
    rng, docs, want = random.Random(2), [], {}

    def add(text, copy):
        docs.append((len(docs), f"Before it all. {text} And after it."))
        want[len(docs) - 1] = copy

    for gap in ("", "well ", "well as it were ", "so " * 12):
        add(filled(STORY[:half], **one) + gap + filled(STORY[half:], **one), True)
        add(filled(STORY[:half], **one) + gap + filled(STORY[half:], **two), False)
        add(filled(STORY[:half], **one) + gap + filled(STORY[half:], **{**one, "Bob": "Maria"}), False)  # two names become one
        add(filled(STORY[:half], **{**one, "n12": "7"}) + gap + filled(STORY[half:], **one), False)  # two numbers become one
    words = filled(STORY, **one).split()
    for _ in range(4):
        at = rng.randrange(8, len(words) - 8)
        add(" ".join([*words[:at], "really", *words[at:]]), True)
    got = {r.doc_id: r.contaminated for r in judged(spark, docs, [(1, STORY), (2, "Some other item with Tom and 4 km of road that is not in any text")])}
    assert got == want


def test_repeated_words_are_met_in_runs(spark):
    items = spark.createDataFrame([(1, "same " * 400), (2, "Every one of 7 days is " * 30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "same " * 5000), (2, "same " * 100), (3, "Every one of 9 days is " * 40)], "doc_id long, text string")
    marks = benchmarks.tokenized(items, "item_id")
    own = benchmarks.tokenized(docs.selectExpr("doc_id AS t", "text"), "t")
    pairs = spark.createDataFrame([(1, 1), (2, 1)], "t long, item_id long")
    assert benchmarks.meetings(pairs, benchmarks.item_windows(marks, 5), own, 5).count() < 10_000
    got = {r.doc_id: (list(r["items"]), round(r.covered, 3)) for r in benchmarks.decontaminate(docs, items).collect()}
    assert got == {1: ([1], 1.0), 2: ([], 0.0), 3: ([2], 1.0)}
