"""Tokenizer alignment, language mixtures and whitening against brute force, with the awkward cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import align, language, whiten

D = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, lang string, key long, b int, n long, component int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, 4, 0.5) for i, t, lang in rows], EXTRA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    words = ["the", "of", "Haanth", "reoush", "ón", "être", "naïve", "x=1;", "don't", "3.14", "日本語", "🙂🙂", "<s>", "<|endoftext|>", "a\tb", "l1\nl2"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [text(r.randrange(1, 60)) for _ in range(50)]
    out += [None, "", " ", "  ", " lead", "trail ", "two  spaces", "a \n b", "\n", " x  y", "x ᠎ y", "▁under", "a ▁b", "é", "▁", "\x00nul", "tab\t tab", "ﬁne", "x" * 3000, text(4000), "the " * 500]
    return [*out, out[3], out[3]]


def brute(texts):
    """Tokens by the libraries from whole texts, links by every pair's ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = align.default_tokenizers()
    a_model = Tokenizer.from_file(a_path)
    a_model.encode_special_tokens = True
    b_model, signs = sentencepiece.SentencePieceProcessor(model_file=b_path), align.byte_signs()
    a_bytes = {v: bytes(signs[c] for c in t) for t, v in a_model.get_vocab().items()}

    def b_bytes(k):
        p = b_model.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def ranges(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends, strict=True))

    docs, counts = [], collections.Counter()
    for t in texts:
        a, b = (a_model.encode(f" {t}", add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        pa, pb = [a_bytes[x] for x in a], [b_bytes(x) for x in b]
        if not t or b"".join(pa) != f" {t}".encode() or b"".join(pb) != f" {t}".encode():
            docs.append(([], [], [], []))
            continue
        ra, rb = ranges(pa), ranges(pb)
        links, j0 = [], 0
        for x, (lo, hi) in zip(a, ra, strict=True):
            while rb[j0][1] <= lo:
                j0 += 1
            j = j0
            while j < len(b) and rb[j][0] < hi:
                links.append((x, b[j]))
                j += 1
        cuts = sorted({hi for _, hi in ra} & {hi for _, hi in rb})
        groups, i, j = [], 0, 0
        for cut in cuts:
            ga, gb = [], []
            while i < len(a) and ra[i][1] <= cut:
                ga.append(str(a[i]))
                i += 1
            while j < len(b) and rb[j][1] <= cut:
                gb.append(str(b[j]))
                j += 1
            groups.append(f"{','.join(ga)}|{','.join(gb)}")
        counts.update(links)
        docs.append((a, b, groups, links))
    best = {}
    for (_, b), c in counts.items():
        best[b] = max(best.get(b, 0), c)
    rows = [(len(a), len(b), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, x in docs]
    return rows, counts


@pytest.mark.parametrize("split", [False, True])
def test_alignment(spark, texts, split, monkeypatch):
    """Every digest and count as by brute force, also with blocks of few documents and ids dealt to several tasks."""
    if split:
        monkeypatch.setattr(align, "BLOCK_BYTES", 1500)
        monkeypatch.setattr(align, "parallelism", lambda _: 40)
    ids = [*range(len(texts) - 2), None, 3]
    docs = frame(spark, [(i, t, None) for i, t in zip(ids, texts, strict=True)])
    want, counts = brute(texts)
    out, pairs = align.align(docs)
    assert out.columns == ["doc_id", *align.DOC_FIELDS, "n_best", "count_sum", "groups_sha256"]
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=key)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == counts
    if split:
        rows = align.scan(docs, *align.default_tokenizers())
        posts = rows.where("b is not null").select("block", "b", "a", "n", "docs", "times")
        assert posts.select("block").distinct().count() > 10


def test_split_ids_keep_their_counts(spark):
    """An id with most of the postings goes to several tasks, whose streams may hold several of its parts."""
    import pyarrow as pa

    docs = frame(spark, [(k, "the the of", None) for k in range(3000)])
    out, pairs = align.align(docs.repartition(64))
    counts = {(r.a, r.b): r.n for r in pairs.collect()}
    assert out.count() == 3000 and set(counts.values()) == {6000, 3000}
    assert {(r.n_best, r.count_sum) for r in out.collect()} == {(3, 15000)}
    part = lambda p, block, n, docs_: (7, p, 1, n, block, docs_, bytes([2]) if docs_ else None)
    rows = [part(0, None, 9, None), part(0, 1, 0, b"\0\0"), part(3, None, 9, None), part(3, 2, 0, b"\1\0")]
    names = ["b", "part", "a", "n", "block", "docs", "times"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    for cut in range(5):
        got = [tuple(r.values()) for b in align.contribute(iter([batch.slice(0, cut), batch.slice(cut)])) for r in b.to_pylist()]
        long = lambda x: x.to_bytes(8, "little")
        assert got == [(1, b"\0\0", long(2), long(18)), (2, b"\1\0", long(2), long(18))]


def test_alignment_of_nothing(spark):
    out, pairs = align.align(frame(spark, []))
    assert out.count() == 0 and pairs.count() == 0
    assert [tuple(r)[1:] for r in align.align(frame(spark, [(1, None, None), (None, "", None)]))[0].collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_words_are_encoded_as_in_their_text(texts):
    t = align.Tokenizers.of(*align.default_tokenizers())
    assert t.parts_words and t.ranks
    for text in texts:
        if text:
            a, b = t.encode([text])[0]
            whole = t.a.encode(f" {text}", add_special_tokens=False).ids, t.b.encode(text)
            if a:
                assert (np.frombuffer(a, "i4").tolist(), np.frombuffer(b, "i4").tolist()) == whole


# Languages


@pytest.fixture(scope="module")
def prose():
    r = random.Random(2)
    syllables = {"aa": ["ba", "lo", "mi", "ran"], "bb": ["kuz", "zik", "ot", "vuk"], "cc": ["été", "où", "ça", "lin"]}
    return lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def test_held_out_languages(spark):
    """Languages of documents that weren't learned from, and only lang, text and the fold's rule take part."""
    rows = {r.doc_id: r for r in language.query(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    assert len(rows) == len(docs) and all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert len(held) > 100 and sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_mixtures(spark, prose):
    """Each text's languages and their shares, whatever its length; marks, case and digits don't matter."""
    learned = [(k, prose(lang, 40), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 20)]
    model = language.learn(frame(spark, [*learned, (None, None, "aa"), (98, "123", "aa"), (99, prose("aa", 5), None)]))
    assert model.names == ["aa", "bb", "cc"] and np.allclose(model.shares, 1 / 3)
    cases = {"aa": {"aa": 1}, "aa bb": {"aa": 0.5, "bb": 0.5}, "aa aa aa bb": {"aa": 0.75, "bb": 0.25}, "aa bb cc": {"aa": 1 / 3, "bb": 1 / 3, "cc": 1 / 3}}
    for words in (60, 3000):
        texts = [" ".join(prose(lang, words) for lang in case.split()) for case in cases]
        got = language.identify(frame(spark, [(k, t, "zz") for k, t in enumerate(texts)]), model).orderBy("doc_id").collect()
        for r, want in zip(got, cases.values(), strict=True):
            found = {x.lang: x.share for x in r.languages}
            assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 0.1 for k in want)
            assert abs(r.score - max(want.values())) < 0.1 and r.lang_pred == max(found, key=found.get)
    upper = language.identify(frame(spark, [(1, prose("bb", 30).upper() + " 123 !!", None)]), model).first()
    assert upper.lang_pred == "bb"


def test_odd_texts_have_no_language(spark, prose):
    model = language.learn(frame(spark, [(k, prose(lang, 30), lang) for k, lang in enumerate(["aa", "bb"] * 5)]))
    odd = [(1, None, "aa"), (2, "", "aa"), (3, "12 345 !?", "aa"), (None, "́", "aa"), (3, "baLO", None), (3, "baLO", None)]
    got = language.identify(frame(spark, odd), model).collect()
    assert [(r.lang_pred, r.score) for r in got[:4]] == [("und", 0.0)] * 4 and [r.lang_pred for r in got[4:]] == ["aa", "aa"]
    empty = language.learn(frame(spark, []))
    assert empty.names == [] and language.identify(frame(spark, [(1, "abc", None)]), empty).first().lang_pred == "und"
    assert language.identify(frame(spark, []), model).count() == 0


def test_likelihoods_by_hand(spark):
    """A word's likelihood by the stated formula, with plain dictionaries; cut into pieces it is the same."""
    docs = [(1, "aba ab", "x"), (2, "bb abba", "y")]
    model = language.learn(frame(spark, docs))
    texts = {"x": ["aba", "ab"], "y": ["bb", "abba"]}
    stream, per_text = language.words(["Ab abab"])
    got = language.word_likelihoods(model, stream)
    assert per_text.tolist() == [2] and got.shape == (2, 2)
    for col, lang in enumerate(model.names):
        seen = collections.Counter()
        for w in texts[lang]:
            s = "\0" + w + "\0"
            for i in range(1, len(s)):
                for n in range(1, 5):
                    # What reaches beyond the word's start is cut off there.
                    seen[n, s[max(0, i - n + 1) : i + 1]] += 1
        total = sum(v for (n, _), v in seen.items() if n == 1)
        for row, w in enumerate(["ab", "abab"]):
            s, ll = "\0" + w + "\0", 0.0
            for i in range(1, len(s)):
                p = (seen[1, s[i]] + language.UNSEEN) / (total + language.UNSEEN * language.BUCKETS)
                for n in range(2, 5):
                    c = seen[n, s[max(0, i - n + 1) : i + 1]]
                    context = seen[1, "\0"] if i == 1 else seen[n - 1, s[max(0, i - n + 1) : i]]
                    p = (c + language.STRENGTH * p) / (max(context, c) + language.STRENGTH)
                ll += np.log(p)
            assert abs(got[row, col] - ll) < 1e-3
    whole = language.word_likelihoods(model, np.tile(stream, 50))
    before, language.PIECE = language.PIECE, 16
    try:
        assert np.allclose(language.word_likelihoods(model, np.tile(stream, 50)), whole, atol=1e-5)
    finally:
        language.PIECE = before


# Whitening


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, n long, component double")


def exact(vectors, k=8):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 1024) + 100_000
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    return x, c, e[::-1][:k], u[:, ::-1][:, :k], e.sum()


@pytest.mark.parametrize("block", [None, 2])
def test_whitening(spark, block):
    """Components, whitened rows and exact deviations as by a whole covariance, from blocks of two columns too."""
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(400, 24)) * np.linspace(1, 2, 24)).astype(np.float32)
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)] + [(7, vectors[7].tolist()), (None, vectors[9].tolist())]
    bad = [(500, None), (501, [None] * 24), (502, [float("nan")] * 24), (503, [float("inf"), *[0.0] * 23]), (504, []), (505, [1.0, 2.0])]
    got = whiten.whiten(embeddings(spark, rows + bad).repartition(5), **({"block": block} if block else {})).toPandas()
    x, c, e, u, total = exact([v for _, v in rows])
    assert len(got) == 8 * len(rows) and set(got.vec_id.dropna()) == set(range(400)) and got.vec_id.isna().sum() == 8
    assert (got.n == len(rows)).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, e / total, rtol=1e-10)
    want = c @ u / np.sqrt(e)
    one = got[got.vec_id == 3].set_index("component").whitened
    for k in range(8):
        sign = np.sign(one[k + 1] * want[3, k])
        mine = got[(got.component == k + 1) & got.vec_id.notna() & (got.vec_id != 7)].sort_values("vec_id").whitened
        assert np.allclose(mine, sign * np.delete(want[:400], 7, axis=0)[:, k], atol=1e-8)
    n, s = len(rows), x.sum(axis=0)
    exact_dev = {int(i): int(sum(int(n * a - b) ** 2 for a, b in zip(v.tolist(), s.tolist(), strict=True))) for (i, _), v in zip(rows, x, strict=True) if i is not None}
    assert all(int(d) == exact_dev[int(i)] for i, d in zip(got.vec_id, got.deviation, strict=True) if i == i)


def test_whitening_is_exact_beyond_longs(spark):
    big = [(k, [float(2**39 if k % 2 else -(2**39)), float(k)]) for k in range(6)]
    got = {r.vec_id: int(r.deviation) for r in whiten.whiten(embeddings(spark, big)).where("component = 1").collect()}
    x = np.array([[int(v * 1024) + 100_000 for v in row] for _, row in big], object)
    assert got == {k: sum((6 * a - b) ** 2 for a, b in zip(x[k], x.sum(axis=0), strict=True)) for k in range(6)}
    with pytest.raises(Exception, match="beyond"):
        whiten.whiten(embeddings(spark, [(1, [1e30]), (2, [0.0])])).collect()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    """Empty tables, single and equal vectors have no component."""
    out = whiten.whiten(embeddings(spark, rows))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "eigenvalue", "residual", "identity_error"]


def test_fewer_components_than_asked_for(spark):
    """Dimensions without variance give none; tied eigenvalues still whiten."""
    rows = [(k, [float(k % 2), float(k // 2 % 2), 5.0]) for k in range(8)]
    got = whiten.whiten(embeddings(spark, rows)).toPandas()
    assert sorted(got.component.unique()) == [1, 2] and got.identity_error[0] < 1e-12 and np.allclose(got.explained, 0.5)


def test_subspace_from_few_columns():
    """Residuals certify the components of a large flat spectrum while few columns are kept."""
    r = np.random.default_rng(5)
    q = np.linalg.qr(r.normal(size=(300, 300)))[0]
    e = np.concatenate([[9.0, 8.5], np.linspace(3, 1, 298)])
    a = q * e @ q.T
    values, vectors, residuals, passes = whiten.subspace(lambda x: a @ x, 300, 8, block=8, most_kept=48)
    assert np.allclose(values, e[:8]) and residuals.max() <= 1e-13 * 9 and np.allclose(a @ vectors, vectors * values) and passes < 200


def test_query_columns(spark):
    out = whiten.query(spark, D)
    assert {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}.items() <= dict(out.dtypes).items()
    assert out.agg(F.count(F.lit(1))).first()[0] == 8 * spark.read.parquet(f"{D}/embeddings.parquet").count()
