"""Line dedup against brute force."""

import random

import pytest

from wavejobs.llm import lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long, line string, k1 string"


def brute(rows):
    seen, out = [], {}
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
    for r in order:
        doc, text = rows[r][:2]
        for i, line in enumerate(text.split("\n") if text is not None else []):
            words = set(line.split())
            place = (doc is None, doc, i)
            if words:
                hit = any(p != place and 5 * len(words & w) >= 4 * len(words | w) for p, w in seen)
                seen.append((place, words))
                if hit:
                    out.setdefault(r, []).append(i)
    return [(rows[r][0], len(rows[r][1].split("\n")) if rows[r][1] is not None else 0, out.get(r, [])) for r in range(len(rows))]


@pytest.mark.parametrize("hot", [64, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(2)
    words = [f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(2000)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(80)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(base).split(" ")
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(rng.choice((" ", "  ", "\t")).join(line))
        rows.append((d, "\n".join(text), "en", "s", 0, "clash", "clash"))
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "s", 0, "", ""), (102, "\n \n", "en", "s", 0, "", ""), (None, base[0] + "\nnew words here", "en", "s", 0, "", "")]
    got = [(r.doc_id, r.n_lines, list(r.removed)) for r in lines.dedup(spark.createDataFrame(rows, DOCS).repartition(3), cells=1 << 12).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_copies_of_a_row_and_empty(spark):
    rows = [(1, "a b c\na b c", "en", "s", 0, "", ""), (1, "a b c\na b c", "en", "s", 0, "", "")]
    assert [list(r.removed) for r in lines.dedup(spark.createDataFrame(rows, DOCS), cells=1 << 12).collect()] == [[1], [1]]
    assert lines.dedup(spark.createDataFrame([], DOCS), cells=1 << 12).collect() == []


@pytest.mark.parametrize("hot", [128, 3])
def test_long_lines_meet_on_two_words(spark, monkeypatch, hot):
    """All pairs of long lines at the limit of similarity are found, whichever words differ."""
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(7)
    common = [f"c{i}" for i in range(300)]
    rows, d = [], 0
    for k in range(30):
        n = rng.randint(36, 90)
        base = [f"rare{k}", *rng.sample(common, n - 1)]
        for gone in (0, n // 9, n // 9 + 1):  # n - gone words shared of n + gone
            other = rng.sample(base, n - gone) if k % 2 else sorted(base)[: n - gone]
            rows.append((d, " ".join(other + [f"new{k}x{gone}x{i}" for i in range(gone)]), "en", "s", 0, "", ""))
            d += 1
    got = [(r.doc_id, r.n_lines, list(r.removed)) for r in lines.dedup(spark.createDataFrame(rows, DOCS), cells=1 << 16).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert sum(len(x[2]) for x in got) >= 30


def test_long_lines_that_share_one_rare_word(spark, monkeypatch):
    """Pairs of long lines that have one rare word in common and nothing else aren't verified, as similar ones share two of their rarest."""
    rng = random.Random(8)
    rows = []
    for d in range(24):
        own = [f"own{d}x{i}" for i in range(16)]
        rows.append((d, " ".join([*own, f"only{d // 2}", *rng.sample([f"c{d % 2}x{i}" for i in range(150)], 134)]), "en", "s", 0, "", ""))
    asked, real = [], lines.texts_by_id
    monkeypatch.setattr(lines, "texts_by_id", lambda ids, *rest: asked.append(ids.distinct().count()) or real(ids, *rest))
    assert all(not r.removed for r in lines.dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert asked == [0]


def test_sketches_differ_by_no_more_than_the_sets(spark):
    rng = random.Random(9)
    rows = [(0, [], []), (1, [0, 1 << 52, (1 << 56) - 1], [])]
    for k in range(2, 300):
        a = {rng.getrandbits(56) >> rng.choice((0, 0, 5)) for _ in range(rng.randint(1, 200))}
        b = set(rng.sample(sorted(a), rng.randint(0, len(a)))) | {rng.getrandbits(56) for _ in range(rng.randint(0, 9))}
        rows.append((k, list(a), rng.sample(sorted(b), len(b))))
    sig = [{r.k: r.sig for r in lines.sketched(spark.createDataFrame([(x[0], x[i]) for x in rows], "k long, h array<long>")).collect()} for i in (1, 2)]
    apart = [(bin((sig[0][k] ^ sig[1][k]) & (1 << 64) - 1).count("1"), len(set(a) ^ set(b))) for k, a, b in rows]
    assert all(bits <= words for bits, words in apart)
    assert sum(bits for bits, words in apart if words > 60) > 15 * sum(words > 60 for _, words in apart)


@pytest.mark.parametrize("similarity", [1.0, 0.8, 0.55])
def test_similar_lengths_share_a_band(spark, similarity):
    n = spark.range(1, 3001).select("id", lines.band(lines.F.col("id"), similarity).alias("own"), lines.band(lines.F.floor(lines.F.col("id") / similarity + 1e-6), similarity).alias("last"))
    got = {r.id: (r.own, r.last) for r in n.collect()}
    assert all(last - own in (0, 1) for own, last in got.values())
    assert all(got[m][0] in got[k] for k in got for m in (k, int(k / similarity), int(k / similarity) - 1) if k <= m <= 3000 and m * similarity <= k + 1e-9)


def test_lines_dont_carry_their_text(spark, capsys):
    """A text is split into lines once, and a line's row holds no other lines."""
    lines.lines_of(spark.createDataFrame([(1, "a b\nc", "en", "s", 0, "", "")], DOCS)).select("doc_id", "n_lines", "l", "k1").explain()
    plan = capsys.readouterr().out
    generate = next(row for row in plan.splitlines() if "Generate" in row)
    assert plan.count("split(") == 1
    assert "n_lines" in generate.split("[", 1)[1]


def test_words_shared_too_late_in_a_line(spark, monkeypatch):
    """Lines that have too few words in common from the one they meet on aren't verified."""
    rows = []
    for k in range(60):
        tail = [f"c{k % 2}x{i}" for i in range(16)]
        rows.append((2 * k, " ".join([f"r{k}", f"s{k}", f"both{k}", f"d{k % 2}", *tail]), "en", "s", 0, "", ""))
        rows.append((2 * k + 1, " ".join([f"o{k}", f"p{k}", f"q{k}", f"both{k}", *tail]), "en", "s", 0, "", ""))
    asked, real = [], lines.texts_by_id
    monkeypatch.setattr(lines, "texts_by_id", lambda ids, *rest: asked.append(ids.distinct().count()) or real(ids, *rest))
    got = [(r.doc_id, r.n_lines, list(r.removed)) for r in lines.dedup(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert asked == [0]


@pytest.mark.parametrize("similarity", [1.0, 0.8, 0.55])
def test_longest_line_for_a_place(spark, similarity):
    """No longer line that is similar and shares nothing before a place (one word, if two are asked for) is left out."""
    n = spark.range(1, 121).select("id", *[lines.longest(lines.F.col("id"), lines.F.lit(i), similarity).alias(f"i{i}") for i in range(6)], lines.twice(lines.F.col("id"), similarity).cast("int").alias("e"))
    for r in n.collect():
        for i in range(6):
            fit = [m for m in range(r.id, 2 * r.id + 1) if min(r.id, r.id - i + r.e) * (1 + similarity) >= similarity * (r.id + m) - 1e-9]
            assert not fit or r[f"i{i}"] >= max(fit)
