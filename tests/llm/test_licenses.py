"""License scans: alignment against brute force and planted notices."""

import random

from wavejobs.llm import licenses

DOCS = "doc_id long, text string, lang string, source string, n_chars long, license string, coverage double"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 20))]
        b = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 20))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
    unique = [f"w{i}" for i in range(50)]
    for _ in range(100):  # with all words unique it is the longest common subsequence
        a, b = rng.sample(unique, 30), rng.sample(unique, 30)
        assert len(licenses.align(a, b)) <= lcs(a, b)
        anchors = [b.index(w) for w in a if w in b]
        assert len(licenses.increasing(anchors)) == lcs(a, b)


def test_planted(spark):
    rng = random.Random(3)
    prose = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i % 97}" for i in range(5000)] + ["the", "of", "version", "license", "under"] * 40
    rows, want = [], {}
    for d in range(60):
        text = rng.choices(prose, k=rng.randint(0, 3000))
        if d % 3 == 0:
            name = rng.choice(sorted(licenses.TEMPLATES))
            notice = rng.choice(licenses.TEMPLATES[name]).split()
            if len(notice) > 12:
                notice[4] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = notice
            want[d] = name
        rows.append((d, " ".join(text), "en", "s", 0, "clash", 0.0))
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "s", 0, "", 0.0), (None, "Released under the MIT License. Licensed under CC BY 4.0.", "en", "s", 0, "", 0.0)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    assert {d: got[d].license for d in got if d is not None and got[d].license} == want
    assert got[None].licenses == ["CC-BY-4.0", "MIT"] and got[100].license is None and got[101].passages == []


def test_long_text_with_repeats_and_empty(spark):
    line = licenses.TEMPLATES["MIT"][0]
    hits = licenses.Scanner(licenses.TEMPLATES, 0.8).scan(" ".join([line] * 500))
    assert len(hits) >= 250 and {h[0] for h in hits} == {"MIT"}
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []


def test_every_copy_in_a_row():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            for n in (2, 3, 7, 500):
                hits = scanner.scan("some prose before it " + " ".join([text] * n) + " and after it")
                assert [h[0] for h in hits] == [name] * n, (text, n, len(hits))
    two = scanner.scan("Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.")
    assert [h[0] for h in two] == ["CC-BY-4.0", "CC-BY-NC-4.0"]


def test_against_every_window():
    """A notice with words left out and put in is found if and only if some window of the text aligns well enough."""
    rng = random.Random(12)
    prose = [f"prose{i}" for i in range(50)]
    both = [0, 0]
    for _ in range(60):
        name = rng.choice(["Apache-2.0", "MIT", "BSD", "GPL-3.0", "MPL-2.0"])
        template = licenses.words(licenses.TEMPLATES[name][-1])
        own = [w for w in template if rng.random() > rng.choice((0.1, 0.18, 0.25))]
        for _ in range(rng.randint(0, 3)):
            own.insert(rng.randrange(len(own)), rng.choice(prose))
        text = [*rng.choices(prose, k=6), *own, *rng.choices(prose, k=6)]
        size = len(template)
        best = max(len(licenses.align(text[p:q], template)) for p in range(0, 10) for q in range(len(text) - 10, len(text) + 1))
        found = [h for h in licenses.Scanner({name: licenses.TEMPLATES[name][-1:]}, 0.8).scan(" ".join(text))]
        assert bool(found) == (best >= 0.8 * size), (name, best / size)
        both[bool(found)] += 1
    assert min(both) > 5
