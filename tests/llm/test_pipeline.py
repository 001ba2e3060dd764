"""The pipeline's stages, each against its own input."""

import random

import corpus_pipeline as cp

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    n = docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, D)
        if k < 4:
            assert out.columns == cp.COLUMNS, name
            docs = cp.materialize(out)
            after = {r.doc_id: r.text for r in docs.collect()}
            assert all(before[i] == t for i, t in after.items())
            if k == 2:
                assert not any(b in t for t in after.values() for b in bench)
                assert all(any(b in t for b in bench) for i, t in before.items() if i not in after)
        else:
            rows = sorted(out.collect(), key=lambda r: r.start)
            assert len(rows) == docs.count() and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert 0 < len(rows) and n


def test_near_copies_go(spark):
    """Copies with some words changed go: what stays equals brute force over 5-word shingles at 0.8."""
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdgkmt" for b in "aeiou" for c in ("l", "n", "rs")]
    line = "this line is in every second document of the whole table".split()
    texts = []
    for k in range(60):
        base = [r.choice(words) for _ in range(r.choice([4, 12, 60, 150, 400]))]
        texts.append(base + line * (k % 2))
        for changed in (1, 2, 4, 8):
            copy = list(base)
            for _ in range(changed):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(copy + line * (k % 2))
    hub = [r.choice(words) for _ in range(200)]
    for _ in range(80):  # a large group of near copies
        copy = list(hub)
        for _ in range(r.randrange(5)):
            copy[r.randrange(200)] = r.choice(words)
        texts.append(copy)
    rows = [(i, " ".join(t).upper() if i % 3 else "  ".join(t), None, "s", 1) for i, t in enumerate(texts)] + [(900, None, None, "s", 0), (901, " ", None, "s", 1)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t, *_ in rows}
    top = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if j in sets and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and top[i] != top[j]:
                lo, hi = sorted((top[i], top[j]))
                top = {k: lo if v == hi else v for k, v in top.items()}
    want = {i for i, v in top.items() if i == v}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in cp.drop_near_duplicates(spark, docs, D).collect()}
    assert got == want and len(want) < len(rows) * 0.6


def odd(spark):
    """Nulls in each column, empty, blank and very long texts, repeated ids and rows, clashing extra columns."""
    r = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdgkmt" for b in "aeiou" for c in ("l", "n", "rs")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    same, item = text(40), spark.read.parquet(f"{D}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, same, "en", "a", 9), (2, same, None, None, None), (2, same, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n", "en", "a", 2), (6, text(30_000), "de", "b", 1), (7, f"x {item} y", "en", "b", 1), (7, text(30), "en", "b", 1), (None, same, "en", "a", 1), (None, None, None, None, None), (8, text(25), "fr", "c", 1), (9, text(60), "en", "a", 3)]
    extra = "p_toxic int, p_low_quality int, nth int, id long, h long, row int, component_id long, part int, `__word` int, `text_` string"
    return spark.createDataFrame([(*x, 1, 2, 3, 4, 5, 6, 7, 8, 9, "t") for x in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    rows = [tuple(x)[:5] for x in docs.collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    quality, near, leaks, mixed, tokens = (f for _, f in cp.STAGES)
    out = quality(spark, docs, D)
    assert out.columns == cp.COLUMNS and sorted(map(tuple, out.collect()), key=key) == sorted(rows, key=key)
    out = near(spark, docs, D)
    got = sorted(map(tuple, out.collect()), key=key)
    # 2 is a copy of 1; 4 and 5 of 3; the least text of 7 stays
    want = [x for x in rows if x[0] in (None, 1, 3, 6, 8, 9)] + [min(x for x in rows if x[0] == 7)]
    assert out.columns == cp.COLUMNS and got == sorted(want, key=key)
    out = leaks(spark, docs, D)
    assert out.columns == cp.COLUMNS and sorted(map(tuple, out.collect()), key=key) == sorted((x for x in rows if x[0] != 7), key=key)
    out = mixed(spark, docs, D)
    copies = [tuple(x) for x in out.collect()]
    assert out.columns == cp.COLUMNS and set(copies) <= set(rows)
    assert copies.count(rows[1]) % 2 == 0  # both rows of 2 have one count
    done = tokens(spark, docs, D).collect()
    assert len(done) == len(rows) and sorted(str(x.doc_id) for x in done) == sorted(str(x[0]) for x in rows)
    assert sum(x.n_tokens == 1 for x in done) == 3  # null and empty texts
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0
