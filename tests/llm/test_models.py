"""Language model, periodic runs and source divergence against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from assayer.llm import divergence, neural, queries, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, codes string, term string, runs string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (6, "é" * 400), (6, "é" * 400), (7, "w " * 3000), (None, "no id at all here"), (9, "\U0001F600\n\n\nx İ"), (None, None)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, *more, 0, "a", "b", "c") for i, t, *more in rows], SCHEMA).repartition(3)


def _table(spark, tmp_path, rows):
    _frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def _runs(w, least=24, power=3):
    found = {}
    for q in range(1, len(w) // power + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                if i + q - start >= max(least, power * q):
                    found.setdefault((start, i + q), q)
                start = None
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _edited(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def _repetitive(rng, most=160):
    kinds = rng.choice([1, 2, 2, 3, 5, 50])
    w = [f"é{rng.randrange(kinds)}" for _ in range(rng.randrange(most))]
    for _ in range(rng.randrange(4)):
        if w:
            a, p = rng.randrange(len(w)), rng.randrange(1, 20)
            w = w[:a] + w[a : a + p] * rng.randrange(1, 9) + w[a + p * rng.randrange(2) :]
    return w + (w + w) * (rng.random() < 0.2)


def test_all_runs_of_random_texts():
    rng = random.Random(5)
    for _ in range(150):
        texts = [_repetitive(rng) for _ in range(rng.randrange(6))]
        symbols, bounds = runs.numbered([[x.encode() for x in w] for w in texts])
        got = [x.tolist() for x in runs.runs(symbols, bounds)]
        want = [(a + int(bounds[k]), a + n + int(bounds[k]), q) for k, w in enumerate(texts) for a, n, q in _runs(w)]
        assert list(zip(*got, strict=True)) == want


def test_repair_rules_spell_the_text_and_no_pair_is_left_twice():
    rng = random.Random(6)
    for _ in range(60):
        symbols, bounds = runs.numbered([[x.encode() for x in _repetitive(rng)] for _ in range(4)])
        (symbol, start, middle, end), (left, right) = runs.repair(symbols, bounds)
        assert left.tolist() == [0, *right[:-1].tolist()][: len(left)] and right[-1:].tolist() == bounds[-1:].tolist() * bool(len(right))
        spelled = {}
        for s, a, m, b in zip(symbol, start, middle, end, strict=True):
            assert a < m < b
            assert spelled.setdefault(int(s), symbols[a:b].tolist()) == symbols[a:b].tolist()
        made = {(a, b): int(s) for s, a, b in zip(symbol, start, end, strict=True)}
        rule = [made.get((a, b), int(symbols[a])) for a, b in zip(left, right, strict=True)]
        text = np.searchsorted(bounds, left, side="right")
        pairs = [(t, rule[i], rule[i + 1]) for i, t in enumerate(text[:-1]) if text[i + 1] == t and rule[i] != rule[i + 1]]
        assert max(Counter(pairs).values(), default=0) <= 1


def test_runs_of_a_long_text_of_one_word_and_of_fibonacci_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 700:
        a, b = b, b + a
    texts = [[b"w"] * 200_000, [x.encode() for x in b], [x.encode() for x in b * 3]]
    symbols, bounds = runs.numbered(texts)
    got = list(zip(*[x.tolist() for x in runs.runs(symbols, bounds)], strict=True))
    want = [(0, 200_000, 1)] + [(s + int(bounds[k]), s + n + int(bounds[k]), q) for k in (1, 2) for s, n, q in _runs([x.decode() for x in texts[k]])]
    assert got == want


def test_run_query_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = ODD + [(20 + i, rng.choice([" ", "\n ", "\t"]).join(_repetitive(rng, 400))) for i in range(120)]
    found = queries.op12_periodic_runs(spark, _table(spark, tmp_path, [(i, t, "en", "s") for i, t in rows])).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        w = _edited(i, _words(t))
        own = _runs(w)
        gone = {k for a, n, q in own for k in range(a + q, a + n)}
        best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(own), *top, sha("".join(f"{a},{n},{q}\n" for a, n, q in own)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in found))) == sorted(map(str, want))
    assert sum(n > 0 for _, n, *_ in want) > 30


@pytest.mark.parametrize("make", [runs.collapse_runs, neural.score, divergence.audit])
def test_empty_tables(spark, make):
    assert make(_frame(spark, [(1, "x", "en", "s")]).where("doc_id = 2")).count() == 0


def _tokens(text):
    fold = {i: i + 32 for i in range(65, 91)}
    return [*(w.translate(fold) for w in _words(text)), None]


def _base(rows):
    learnt = Counter(t for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for t in _tokens(x))
    n, v = sum(learnt.values()), len(learnt)
    out = []
    for i, x in rows:
        t = _tokens(x)
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        out.append((i, held, len(t), sum(learnt[w] > 0 for w in t), n, sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)))
    return out, learnt


def _prose(rng, n):
    out, word = [], "a"
    for _ in range(n):
        word = rng.choice({"a": ["big", "Small", "red"], "big": ["dog", "cat"], "Small": ["cat", "été"], "red": ["dog", f"x{rng.randrange(900)}"]}.get(word, ["a", "the"]))
        out.append(word)
    return " ".join(out)


def test_language_model_counts_and_norm(spark, tmp_path):
    rng = random.Random(2)
    rows = ODD + [(30 + i, _prose(rng, rng.randrange(60))) for i in range(300)]
    found = queries.op11_language_model(spark, _table(spark, tmp_path, [(i, t, "en", "s") for i, t in rows])).collect()
    want, _ = _base(rows)
    order = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=order)
    for mine, theirs in zip(got, sorted(want, key=order), strict=True):
        assert mine[:5] == theirs[:5] and mine[5] == pytest.approx(theirs[5], rel=1e-9)
    prose = lambda rs: [r for r in rs if r.held_out and r.doc_id >= 30]
    unseen = prose(found)
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    longer = prose(neural.score(_frame(spark, [(i, t, "en", "s") for i, t in rows]), rounds=12).collect())
    assert sum(r.score for r in longer) > 0.8 * sum(r.base_score for r in unseen)


@pytest.mark.parametrize(("shortlist", "listed"), [(0, 0), (3, 0), (5, 12), (5, 2000)])
def test_language_model_counts_at_any_size_of_its_lists(spark, shortlist, listed):
    rng = random.Random(3)
    rows = ODD + [(30 + i, _prose(rng, rng.randrange(40))) for i in range(120)]
    found = neural.score(_frame(spark, [(i, t, "en", "s") for i, t in rows]), shortlist=shortlist, listed=listed).collect()
    want, _ = _base(rows)
    order = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=order)
    for mine, theirs in zip(got, sorted(want, key=order), strict=True):
        assert mine[:5] == theirs[:5] and mine[5] == pytest.approx(theirs[5], rel=1e-9)


def test_language_model_by_its_definition(spark):
    """One text with a shortlist of two: probabilities of all words and an unseen one sum to 1."""
    learnt, held = ([i for i in range(1, 200) if (zlib.crc32(str(i).encode()) % 5 == 1) == out] for out in (False, True))
    words = ["a", "b", "c", "d", "never"]
    ids = held[: len(words)]
    rows = [(learnt[0], "a b a b a b c"), (learnt[1], "b a d"), *((i, f"a {w}") for i, w in zip(ids, words, strict=True))]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    scores = {r.doc_id: r for r in neural.score(frame, shortlist=2).collect()}
    assert all(scores[j].train_tokens == 12 for j in ids)
    # c and d share a class by their equal counts; the unseen word has a third of either
    c, d, never = (scores[ids[words.index(w)]].score for w in ("c", "d", "never"))
    assert c == pytest.approx(d) and c - never == pytest.approx(math.log10(3))


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    noise = np.array([0.4, 0.3, 0.2, 0.1])
    model = neural.start_model(noise, width=3)
    model.classes = rng.normal(0, 0.5, model.classes.shape)
    model.context, model.places, model.bias = (x.astype(np.float64) for x in (model.context, model.places, model.bias))
    codes, bounds = np.array([1, 2, 3, 1, 0, 2, 2]), np.array([0, 4, 4, 7])
    before = neural.contexts(codes, bounds, len(noise))
    assert before[:5].tolist() == [[4, 4, 4], [1, 4, 4], [2, 1, 4], [3, 2, 1], [4, 4, 4]]
    drawn = np.array([0, 1, 1, 3, 2])
    _, found = neural.gradients(model, before, codes, drawn, noise)
    for part, g in zip(model.parts(), found, strict=True):
        for at in np.ndindex(part.shape):
            own = part[at]
            part[at] = own + 1e-5
            high, _ = neural.gradients(model, before, codes, drawn, noise)
            part[at] = own - 1e-5
            low, _ = neural.gradients(model, before, codes, drawn, noise)
            part[at] = own
            assert g[at] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-4)
    total = sum(np.exp(model.log_probabilities(before, np.full(len(codes), k))) for k in range(len(noise)))
    assert total == pytest.approx(np.ones(len(codes)))


def _audited(rows, least, best):
    fold = {i: i + 32 for i in range(65, 91)}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))) for _, t, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        spread = Counter(w for x, _, t in docs if x == lang for w in set(t))
        kept = [w for w, n in spread.items() if n >= least]
        groups = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, t in docs:
            if x == lang:
                groups[s].update(w for w in t if spread[w] >= least)
        whole = sum(groups.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: B023, E731
        for s, c in groups.items():
            pairs = [(o, sum(abs(share(c, w) - share(d, w)) for w in kept)) for o, d in groups.items() if o != s]
            terms = [(w, share(c, w) - share(whole, w)) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, best)):
                ranked = sorted(found, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("least", "best", "part", "block", "tile"), [(5, 3, 1 << 18, 4096, 256), (3, 50, 7, 4, 2), (400, 50, 9, 9, 9)])
def test_divergence_against_brute_force(spark, least, best, part, block, tile):
    rng = random.Random(4)
    terms = [rng.choice(["été", "Haus", "tree", "q", "ZÜRICH", "日本", "\U0001F600b"]) + "x" * rng.randrange(4) for _ in range(40)]
    rows = [(i, rng.choice([" ", "-", "7\n"]).join(rng.choices(terms, range(1, 41), k=rng.randrange(60))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "b", "b", "cé", None, "z"])) for i in range(150)]
    rows += [(i, t, "en", "s") for i, t in ODD] + [(1, "", "xx", "alone"), (1, None, "yy", "one"), (2, "only", "yy", None)]
    found = divergence.audit(_frame(spark, rows), least, best, part, block, tile).collect()
    assert sorted((r.lang, r.source, r.kind, r.item, r.value, r["rank"]) for r in found) == _audited(rows, least, best)
