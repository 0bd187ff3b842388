"""The corpus pipeline against brute force, with copies on many sites."""

import hashlib
import random

import corpus_pipeline
from assayer.llm import pieces, quality
from tests.llm.test_operators import _groups
from tests.llm.test_whole_job import _alike

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _fixture():
    rng = random.Random(17)
    vocabulary = [f"{a}{b}" for a in ("ban", "kel", "dor", "mi", "su") for b in ("ta", "rin", "lo", "ve", "po", "x")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    junk = lambda: "".join(rng.choices("0123456789{}[]<>#$%&*@!~|", k=rng.randrange(40, 400)))
    rows, labels = [], []
    for i in range(240):  # labelled prose and junk, by which the classifier learns
        good = i % 2
        rows.append((i, prose(rng.randrange(20, 90)) if good else junk(), f"s{i % 9}"))
        labels.append((i, good, 0))
    shared = [prose(30), prose(25)]
    rows += [(300 + i, shared[0] + "\n" + shared[1], f"site{i}") for i in range(7)]  # whole copies on seven sites
    rows += [(320 + i, "Shared footer line here\n" + prose(40), f"site{i}") for i in range(6)]
    rows += [(340 + i, "Line on four sites only\n" + prose(40), f"site{i % 4}") for i in range(6)]
    near = prose(120).split()
    for i in range(4):  # near copies on few sites
        rows.append((360 + i, " ".join(near[:50] + [f"edit{i}"] + near[51:]), "one"))
    item = prose(40)
    rows += [(380, prose(30) + " " + item + " " + prose(20), "one"), (381, prose(30) + " " + item[: len(item) // 3], "one")]
    rows += [(390, None, None), (391, "", "one"), (None, prose(30), "two"), (392, "  ", "one")]
    return rows, labels, [(1, item), (2, None), (3, prose(6) + " unseen words only here now")]


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels, items = _fixture()
    docs = spark.createDataFrame([(i, t, "en", s, 7) for i, t, s in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    scored = {(r.doc_id, r.text): r.score for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    rows = [r for r in rows if scored[r[0], r[1]] >= 0.5]
    held = sum(1 for i, _, _ in rows if i is not None and i < 240)
    assert 110 <= held <= 130 and all(i % 2 for i, _, _ in rows if i is not None and i < 240 and scored[i, next(t for j, t, _ in rows if j == i)] > 0.9)

    sites, first = {}, {}
    for i, t, s in rows:
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            sites.setdefault(line, set()).add(s or "")
            if i is not None:
                first[line] = min(i, first.get(line, i))
    cut = []
    for i, t, s in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(sites.get(x.strip(" "), ())) >= 5 and first[x.strip(" ")] != i)]
        if len(kept) == len(lines):
            cut.append((i, t))
        elif "\n".join(kept).strip():
            cut.append((i, "\n".join(kept)))
    assert {i for i, _ in cut if i is not None and 300 <= i < 320} == {300}

    known = [(i, t) for i, t in cut if i is not None]
    root = _groups(known, 5, 80)
    cut = [(i, t) for i, t in cut if i is None or root[i][2]]
    assert {i for i, _ in cut if i is not None and 360 <= i < 370} == {360}

    alnum = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t or "").split()
    alike = _alike({i: alnum(t) for i, t in cut if i is not None and alnum(t)}, {j: alnum(t) for j, t in items if t})
    hit = {i for (i, _), x in alike.items() if x >= 0.8}
    assert hit == {380}
    cut = [(i, t) for i, t in cut if i not in hit]

    model = pieces.compile_model()
    want = []
    for i, t in cut:
        ids = model.encode(t or "")
        want.append((str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.round_trip) for r in got) == sorted(want)


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, None, None, None, None), (3, "w " * 3000, "en", "s", 1), (3, "w " * 3000, "en", "s", 1)]
    for name, rows in (("some", odd), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        # repeated rows of one id stay as they are, null ids are never copies
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
