"""Spelling variants against brute force."""

import random
import re
import zlib

from wavejobs.llm import spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, id long"


def edits(word, letters):
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]
        for c in letters:
            yield word[:i] + c + word[i + 1 :]
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]


def brute_words(docs, shortest=5, least=3):
    counts = {}
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= least}


def brute(counts):
    letters = {c for w in counts for c in w}
    out = {}
    for w, n in counts.items():
        near = {e for e in edits(w, letters) if e in counts and e != w}
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (v[0], root(w), *v[1:]) for w, v in out.items()}


def rows(df):
    got = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: tuple(r)[1:] for r in got}


def test_documents(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdéÀ×") for _ in range(rng.randrange(3, 9))) for _ in range(120)]
    vocabulary = stems + [rng.choice(list(edits(w, "abcé"))) for w in stems for _ in range(4)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=120)) + rng.choice(["", " Ünïcode-Wörter, ABCDÉ abœcde x\U0001f600abcab'd", "1abcdc2abcdcd"]), "", "", 0, "x", 1, 2) for i in range(200)]
    docs += [docs[0], (None, docs[3][1], "", "", 0, None, None, None), (900, None, "", "", 0, None, None, None), (901, "", None, None, None, None, None, None), (902, "ab cd " * 5 + "abcde " * 9000, "", "", 0, "", 0, 0)]
    want = brute(brute_words([d[:2] for d in docs]))
    assert rows(spelling.group(spark.createDataFrame(docs, DOCS))) == want
    assert any(v[0] for v in want.values())


def test_words_of_all_lengths(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(150)} | {"a" * n for n in range(1, 24)} | {"é" * 30 + "a" + "é" * 20, "é" * 30 + "b" + "é" * 20, "é" * 50}
    words |= {"x" * 9 + "y", "x" * 9 + "yz", "x" * 10, "x" * 8 + "yz", "z" + "q" * 9, "q" * 9, "zq" + "q" * 9}
    counts = {w: rng.randrange(1, 40) for w in words} | {"kkkkkkk": 40, "kkkkkkl": 15, "kkkkkll": 5}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute(counts)
    assert any(v[1] != v[0] for v in want.values() if v[0])  # chains of forms
    assert rows(spelling.variants(frame, deep=10, broadcast_rows=20)) == want


def test_runs_in_slices():
    text = "Abc dÉfœgh " * 50
    parts = list(spelling.runs_of(text, 64))
    assert len(parts) > 5 and sum(sum(p.values()) for p in parts) == 150
    assert not list(spelling.runs_of(None)) and not list(spelling.runs_of(""))


def test_empty(spark):
    assert spelling.group(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.group(spark.createDataFrame([(1, None, "", "", 0, "", 0, 0)], DOCS)).count() == 0
