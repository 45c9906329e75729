"""Alignment of two tokenizers against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wavejobs.llm import alignment

DOCS = "doc_id long, text string, lang string, key long, pairs string, count long"
A_FILE, B_FILE = alignment.vocabulary_files()


@pytest.fixture(scope="module")
def both():
    return tuple(alignment.loaded(open(f, "rb").read()) for f in (A_FILE, B_FILE))


def plain(text):
    """Groups as (a ids, b ids) and links as (a id, b id), by the libraries' own encoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    va, vb = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    va.encode_special_tokens = True
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in chars} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in chars)}
    a, b = va.encode(" " + text, add_special_tokens=False).ids, vb.encode(text)
    a_bytes = [bytes(back[c] for c in va.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if vb.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [vb.id_to_piece(i)]]
    if not text or not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
        return [], []
    spans = []
    for ids, parts in ((a, a_bytes), (b, b_bytes)):
        at, out = 0, []
        for i, p in zip(ids, parts):
            out.append((at, at + len(p), i))
            at += len(p)
        spans.append(out)
    ends = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
    groups, start = [], 0
    for e in ends:
        groups.append(tuple([i for s, t, i in side if start <= s and t <= e] for side in spans))
        start = e
    links = [(i, j) for s, t, i in spans[0] for u, v, j in spans[1] if s < v and u < t]
    return groups, links


TEXTS = [
    "Plain words, and more words: they're here.", "", None, "  two  spaces \n\n tabs\t\t ", " ", "   ", "a ", "<|endoftext|> <s> <unk> <0x41>", "naïve café ÉÀ ×÷ ﬁ １２３", "漢字かな交じり文 한국어 \U0001f600\U0001f469‍\U0001f680",
    "x▁y", "nul\x00byte", "　  odd spaces", "é ‮ rtl", "1234567890 3.14159 0x7f", "supercalifragilisticexpialidocious " * 3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\n", "tail\r\n", "don't I'll we've ''s",
]


def want(rows):
    found = [(i, *plain(t or "")) for i, t in rows]
    counts = Counter(x for _, _, links in found for x in links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for i, groups, links in found:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [10**6, 0])
def test_documents(spark, most):
    rng = random.Random(3)
    words = [w for t in TEXTS if t for w in t.split(" ")]
    rows = list(enumerate(TEXTS)) + [(100 + k, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for k in range(40)] + [(None, "no id"), (3, "again"), (3, "again"), (500, "many words " * 800)]
    docs = spark.createDataFrame([(i, t, "x", 1, None, 2) for i, t in rows], DOCS).repartition(3)
    got = alignment.align(docs, broadcast_rows=most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == want(rows)


def test_groups(spark):
    rows = list(enumerate(TEXTS))
    data = [open(f, "rb").read() for f in (A_FILE, B_FILE)]
    got = {r.doc_id: r.groups for r in alignment.groups(spark.createDataFrame([(i, t, "", 0, "", 0) for i, t in rows], DOCS), *data).collect()}
    for i, t in rows:
        groups, _ = plain(t or "")
        assert [(list(g.a_ids), list(g.b_ids)) for g in got[i]] == groups
        assert not groups or got[i][-1].end == len((" " + t).encode())


def test_quick_encoders_are_the_vocabularies(both):
    a, b = both
    rng = random.Random(9)
    alphabet = "ab é\n\t 'sd1▁ ß漢\U0001f600.,<>|́\x00\x1c "
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 40))) for _ in range(3000)] + [t for t in TEXTS if t] + [" " * 3000, "x" * 3000, "\n" * 999 + "y"]
    assert a.encode(texts) == [a.whole.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert b.encode(texts) == b.model.encode(texts)


def test_shared_ends():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 80, 500, 5000):
        for density in (0.02, 0.3, 0.9):
            space = np.arange(1, n * 3 + 1)
            ends, others = (np.append(space[:-1][rng.random(len(space) - 1) < density], space[-1]) for _ in range(2))
            holder, shared = alignment.held_by(ends, others, near=4)
            assert (holder == np.searchsorted(others, ends)).all() and (shared == np.isin(ends, others)).all()


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None, "", 0, "", 0), (None, "", "", 0, "", 0)], DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
