"""Quality, near-duplicates, languages, segmentation and outliers."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stratagraph.llm import langid, neardup, outliers, pieces, quality, words

DOCS = "doc_id long, text string, lang string, source string, key string, n_words string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def raw(texts):
    b = [t.encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)])


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\ré東😀\xa0") for _ in range(rng.randrange(40))) for _ in range(200)]
    data, offsets = raw(texts)
    s, e, f = words.spans(data, offsets)
    got = [bytes(data[i:j]).decode() for i, j in zip(s, e)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert got == [w for t in want for w in t] and np.diff(f).tolist() == list(map(len, want))
    hashes = words.word_hashes(data, s, e)
    assert len(set(hashes.tolist())) == len(set(got))


def slow_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, x in enumerate(tri) if n[x] >= 2 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)]


def test_counts_match_brute_force():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab ", "cd ", "ab cd ef ", "é#| ", "\n", "x\n", " ", "\r\n", "東 "]) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "\n\n", "a", "a a a a a"]
    c = outliers.text_counts(*raw(texts))
    got = np.stack([c[k] for k in outliers.COUNTS], axis=1).tolist()
    assert got == [slow_counts(t) for t in texts]


def vectors(texts):
    return np.array([[math.log(max(wc, 1) / n), math.sqrt(s / n), math.sqrt(d / n), math.sqrt(r / n)] for n, wc, s, d, r in map(slow_counts, texts)])


def points(spark, x, key="k"):
    return spark.createDataFrame([(key, *map(float, row)) for row in x], "key string, x0 double, x1 double, x2 double, x3 double")


def test_estimates_have_the_least_determinant_of_all_subsets(spark):
    """Against all subsets of small samples with outliers, which pull the mean, lie apart or correlate otherwise."""
    rng = np.random.default_rng(4)
    for k, far in enumerate(([3, 0, 0, 0], [0, 2, -2, 1], [1, 1, 1, 1])):
        mix = rng.normal(size=(4, 4)) * 0.4
        x = np.concatenate([rng.normal(size=(12, 4)) @ mix, rng.normal(size=(3, 4)) * 0.1 + np.array(far) * 3.0])
        h = math.ceil(len(x) * outliers.SHARE)
        factor, floor = outliers.consistency(outliers.SHARE), np.diag(np.square(outliers.FLOORS))
        det = lambda rows: np.linalg.det(factor * np.cov(rows.T, bias=True) + floor)
        best = min((det(x[list(s)]), s) for s in itertools.combinations(range(len(x)), h))
        got = outliers.fit(points(spark, x)).first()
        assert math.isclose(math.exp(got.log_det), best[0], rel_tol=1e-6), k
        assert np.allclose([got[f"m{i}"] for i in range(4)], x[list(best[1])].mean(axis=0))
        assert (got.n, got.rows) == (h, len(x))


def test_the_start_with_the_least_determinant_wins(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(300, 1)) * [1, 0.9, 0.8, 1] + rng.normal(size=(300, 4)) * 0.05, rng.normal(size=(80, 4)) * 0.3 + [1.5, -1.5, 1, -1]])
    ends = outliers.cut(outliers.starts(points(spark, x)))
    assert ends.count() == outliers.STARTS
    one = outliers.fit(points(spark, x)).first()
    far = np.array([one[f"m{i}"] for i in range(4)])
    assert np.abs(far).max() < 0.3 and one.log_det < min(r.log_det for r in ends.collect())


def test_cutoff_and_consistency():
    assert math.isclose(outliers.cutoff(0.05), 9.4877, abs_tol=1e-3) and 33 < outliers.cutoff() < 34
    d = np.sort((np.random.default_rng(1).normal(size=(400_000, 4)) ** 2).sum(axis=1))
    assert math.isclose(outliers.cutoff(0.25), d[300_000], rel_tol=0.01)


def test_outliers(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80 + i % 40, 5000) + (" ### ||" * 80 if i % 20 == 0 else ""), "en", "s") for i in range(300)] + [(900, None, None, None), (901, "", "en", "s"), (902, prose(rng, 70, 5000), None, None), (902, prose(rng, 70, 5000), None, None), (903, prose(rng, 90, 5000), "de", "few")]
    got = outliers.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows[:300]:
        assert [by[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == slow_counts(t)
    assert all(by[i].kept == (i % 20 != 0) for i in range(300)) and by[900].base_failed and not by[900].kept and by[901].n_words == 0
    assert by[902].kept and by[903].kept  # groups of one or two go by their elders
    assert outliers.judge(frame(spark, [])).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60, 5000) if i % 4 else "BUY!! NOW!! " * 30, "en", f"h{i % 5}") for i in range(200)] + [(500, None, None, None), (501, "", "en", None), (501, "", "en", None)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 120)] + [(None, 1), (5, 1)], "doc_id long, quality int")
    got = quality.classify(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id % 4 != 0) for r in got if r.doc_id < 200)
    none = quality.classify(frame(spark, rows), labels.filter("false")).collect()
    assert len(none) == len(rows) and all(r.kept for r in none)
    assert quality.classify(frame(spark, []), labels).count() == 0


def test_sparse_sites_shrink(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 60, 5000), "en", "good" if i % 2 else "bad") for i in range(400)] + [(1000, prose(rng, 60, 5000), "en", "new")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1000, 0)], "doc_id long, quality int")
    p = {r.host: r.p_path for r in quality.classify(frame(spark, rows), labels).select("host", "p_path").distinct().collect()}
    assert p["bad"] < p["new"] < p["good"] and abs(p["new"] - 0.5) < 0.1


def test_own_evidence_is_left_out_of_the_site(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60, 300), "en", "many") for i in range(60)] + [(100, prose(rng, 60, 300), "en", "lone0"), (101, prose(rng, 60, 300), "en", "lone1")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 0), (101, 1), (102, None)], "doc_id long, quality int")
    by = {r.doc_id: r for r in quality.classify(frame(spark, rows), labels).collect()}
    mean = (30 + 1) / 62
    assert math.isclose(by[100].p_path, by[101].p_path) and math.isclose(by[100].p_path, mean)  # nothing else is known of their sites
    assert by[0].p_path > by[1].p_path  # one's own label is missing from the rest


def test_words_tell_quality_apart(spark):
    rng = random.Random(7)
    words = {0: [f"bad{i}" for i in range(40)], 1: [f"fine{i}" for i in range(40)]}
    rows = [(i, " ".join(rng.choices(words[i % 2], k=60)), "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert all(r.kept == bool(r.doc_id % 2) for r in quality.classify(frame(spark, rows), labels).filter("doc_id >= 200").collect())


def test_word_features_match_brute_force():
    slots, values, begins = quality.word_features(*raw(["A b a", "", "c"]))
    assert np.diff(begins).tolist() == [2, 0, 1] and np.allclose(sorted(values[:2]), sorted([(1 + math.log(2)) / math.hypot(1 + math.log(2), 1), 1 / math.hypot(1 + math.log(2), 1)])) and values[2] == 1


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(12):
        base = prose(rng, 150, 10**6)
        rows += [base, base.upper(), base] + [edited(rng, base, rng.randrange(1, 9)) for _ in range(6)]
    hot = prose(rng, 200, 10**6)
    rows += [edited(rng, hot, 1) for _ in range(150)]
    rows += [None, "", "", "one two", "one two", "one three", " \n "]
    docs = [(i * 3 + 1, t, "en", "s") for i, t in enumerate(rows)] + [(1, rows[0], "en", "s")]
    df = frame(spark, docs)
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    idf = neardup.sketch(df)
    parent = {i: i for i, *_ in docs}
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    lists = {i: neardup.shingles(*raw([t or ""]))[0] for i, t, *_ in docs}
    ids = [i for i in lists if len(lists[i])]
    for a in ids:
        for b in ids:
            if a < b and neardup.similarity(lists[a], lists[b], idf) >= neardup.THRESHOLD:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in lists}
    assert neardup.classes(frame(spark, [])).count() == 0


def test_weighted_jaccard():
    idf = np.ones(1 << neardup.SKETCH_BITS, np.float32)
    x, y = np.array([1, 2, 2, 3], np.uint32), np.array([2, 3, 4], np.uint32)
    l2 = 1 + math.log(2)
    assert math.isclose(neardup.similarity(x, y, idf), (1 + 1) / (1 + l2 + 1 + 1), rel_tol=1e-6)


def test_samples_meet_as_often_as_texts_are_alike():
    rng = np.random.default_rng(0)
    idf = np.ones(1 << neardup.SKETCH_BITS, np.float32)
    hit = total = 0
    for _ in range(40):
        a = rng.integers(0, 2**32, 300, dtype=np.uint32)
        b = np.concatenate([a[:200], rng.integers(0, 2**32, 100, dtype=np.uint32)])
        h = np.concatenate([np.sort(a), np.sort(b)])
        k = neardup.band_keys(h, np.repeat([0, 1], 300), 2, idf)
        hit += int((k[0] == k[1]).sum())
        total += neardup.BANDS
    assert 0.01 < hit / total < 0.08  # 0.5 ** 5 = 0.03


def brute_marginals(scores, trans, prior):
    n, k = scores.shape
    p = np.zeros((n, k))
    for seq in np.ndindex(*[k] * n):
        w = prior[seq[0]] + sum(scores[i, y] for i, y in enumerate(seq)) + sum(trans[a, b] for a, b in zip(seq, seq[1:]))
        for i, y in enumerate(seq):
            p[i, y] += math.exp(w)
    return p / p.sum(axis=1, keepdims=True)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    firsts, trans, prior = np.array([0, 3, 3, 8, 9]), rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(9, 3)) * 2
    for block in (1, 2, 3, 128):
        got = langid.marginals(scores, firsts, trans, prior, block)
        for a, b in zip(firsts[:-1], firsts[1:]):
            if b > a:
                assert np.allclose(got[a:b], brute_marginals(scores[a:b], trans, prior))


def test_long_texts_are_scored_in_parts(monkeypatch):
    rng = random.Random(8)
    model = langid.train([tongue(rng, 40, ["the", "ing"]), tongue(rng, 40, ["eau", "que"])], ["aa", "bb"])
    text = tongue(rng, 500, ["the", "ing", "eau"]) + " " + "x" * 700 + " " + tongue(rng, 300, ["que", "ère"])
    whole = model.shares([raw([text])])
    monkeypatch.setattr(langid, "GROUP_BYTES", 100)
    assert np.allclose(model.shares([raw([text])]), whole, atol=1e-5)


def tongue(rng, n, syllables):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(7)
    tongues = {"aa": ["the", "ing", "wh", "sh"], "bb": ["eau", "ère", "ou", "que"]}
    rows = [(i, tongue(rng, 40, tongues["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb", "s") for i in range(200)]
    odd = [(900, None, "aa", "s"), (901, "12 34 !! €", "aa", "s"), (902, "", None, "s"), (903, "東京", None, "s"), (1, rows[1][1], "aa", "s"), (904, tongue(rng, 30_000, tongues["aa"]), None, "s")]
    got = langid.identify(frame(spark, rows + odd)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.held_out and r.doc_id < 200]
    assert held and all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") and 0.5 <= r.score <= 1 for r in held)
    assert [by[i].lang_pred for i in (900, 901, 902, 904)] == ["und", "und", "und", "aa"] and by[903].lang_pred != "und" and by[900].score == 0.0
    model = langid.fit(frame(spark, rows))
    mixed = [(1, "the shing 12 whing theing eauque ouère queou eauou"), (None, None), (2, ""), (3, "12 3"), (1, "the")]
    labels = langid.label_words(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    first = [w.lang for w in next(r.words for r in labels if r.doc_id == 1 and len(r.words) > 1)]
    assert len(labels) == 5 and first[:3] == ["aa"] * 3 and first[-3:] == ["bb"] * 3 and len(first) == 8
    assert sorted(len(r.words) for r in labels) == [0, 0, 0, 1, 8]
    assert {r.lang_pred for r in langid.identify(frame(spark, [(1, "abc", None, "s")])).collect()} == {"und"}
    assert langid.identify(frame(spark, [])).count() == 0


TEXTS = ["", " ", "a", "  x  ", "▁x ▁", "héllo\n\t東京 😀", " " * 50, "\x00\r\n", "q" * 3000, "the cat sat on the mat " * 20]


def test_pieces_are_lossless_and_reproducible(spark):
    v = pieces.vocabulary(None)
    ids, b = pieces.encode(v, ["k"] * len(TEXTS), TEXTS)
    assert [pieces.decode(ids[i:j]) for i, j in zip(b[:-1], b[1:])] == TEXTS
    for i, t in enumerate(TEXTS):  # alone or in a batch, the same
        one, _ = pieces.encode(v, ["k"], [t])
        assert one.tolist() == ids[b[i] : b[i + 1]].tolist()
    rows = [(i, t, "en", "s") for i, t in enumerate([*TEXTS, None])] + [(None, "x", "en", "s"), (0, "", "en", "s")]
    back = pieces.decode_ids(pieces.encode_texts(frame(spark, rows))).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in rows)
    assert sorted(map(str, pieces.round_trip(frame(spark, rows)).collect())) == sorted(map(str, back))


def test_segmentations_are_drawn_by_their_weights():
    v, n = pieces.vocabulary(None), 40_000
    ids, b = pieces.encode(v, [str(i) for i in range(n)], [" them"] * n, alpha=0.3)
    got = Counter(tuple(ids[i:j].tolist()) for i, j in zip(b[:-1], b[1:]))
    def all_paths(rest):
        if not rest:
            yield (), 1.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in v.pieces:
                i, s = v.pieces[rest[:k]]
                for p, w in all_paths(rest[k:]):
                    yield (i, *p), w * math.exp(0.3 * s)
    want = dict(all_paths(" them"))
    total = sum(want.values())
    for p, w in want.items():
        share = w / total
        assert abs(got[p] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_runs_of_spaces_are_drawn_from_all_segmentations():
    v, n = pieces.vocabulary(None), 40_000
    ids, b = pieces.encode(v, [str(i) for i in range(n)], ["a    b" if i % 2 else "    " for i in range(n)], alpha=0.3)
    for odd, text in ((1, "a    b"), (0, "    ")):
        got = Counter(tuple(ids[b[i] : b[i + 1]].tolist()) for i in range(odd, n, 2))

        def all_paths(rest):
            if not rest:
                yield (), 1.0
            for k in range(1, len(rest) + 1):
                if rest[:k] in v.pieces:
                    i, s = v.pieces[rest[:k]]
                    for p, w in all_paths(rest[k:]):
                        yield (i, *p), w * math.exp(0.3 * s)

        want = dict(all_paths(text))
        assert len(want) >= 8 and set(got) <= set(want)
        for p, w in want.items():
            share = w / sum(want.values())
            assert abs(got[p] / (n / 2) - share) < 5 * math.sqrt(share * (1 - share) / (n / 2)) + 1e-4


@pytest.mark.parametrize("n", [0, 1, 7])
def test_components(spark, n):
    from stratagraph.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == ({i: 0 for i in range(n + 1)} if n else {}) | {100: 100, 101: 100}


