"""The operators on small tables, against brute force, with the awkward cases: nulls, empty and long texts, ties,
repeated rows, empty tables, clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, mixing, pii, quality, simhash, substring_bytes, substring_words, token_binary, url_filter, winnow
from marlstone.llm.common import connected_components
from marlstone.llm.induced import Queues, sorted_suffixes, suffix_order

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, h long, start long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, f"src{k % 3}", None if t is None else len(t), 1, 2, 3) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfgl" for b in ("a", "e", "io", "ung")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, run = text(70), " ".join(["la"] * 130)
    out = [(k, text(r.randrange(1, 150))) for k in range(40)]
    out += [(100, f"{text(20)} {passage} {text(9)}"), (101, f"x {passage}\n{text(30)}"), (102, passage), (103, run), (104, f"y {run} z"), (105, None), (106, ""), (107, " \n "), (108, out[3][1]), (109, out[3][1])]
    out += [(110, text(4000)), (None, "no id at all"), (111, "ein zwei"), (111, "ein zwei"), (112, "é😀" * 60), (113, "a é😀" + "é😀" * 60)]
    return out


def kept(rows):
    return sorted(((i, t or "") for i, t in rows if i is not None), key=lambda x: x[0])


def covered(rows, units, size):
    first, out = {}, []
    for i, t in rows:
        for s in range(len(u := units(t)) - size + 1):
            g = tuple(u[s : s + size])
            first[g] = min(first.get(g, i), i)
    for i, t in rows:
        u = units(t)
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - size + 1):
            if first[tuple(u[s : s + size])] < i:
                gone[s : s + size] = True
        out.append((i, u, gone))
    return out


def test_winnowing(spark, rows):
    got = {r.doc_id: r for r in winnow.fingerprint_pairs(frame(spark, rows)).collect()}
    texts = dict(kept(rows))
    ids = sorted(texts, reverse=True)
    assert set(got) == set(ids)
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[3].fingerprint == got[108].fingerprint
    assert got[110].near_edited > 0.2
    one = frame(spark, [(1, texts[110])])
    h, chosen = one.select(winnow._hashes(F.filter(F.split("text", winnow.UNIT), lambda x: x != ""), 3), winnow.chosen(F.col("text"))).first()
    h = [x >> 32 for x in h]
    want = sorted({max(range(s, s + 8), key=lambda i: (-h[i], i)) for s in range(len(h) - 7)})
    assert [2**32 - 1 - (x & (2**32 - 1)) for x in chosen] == want
    assert winnow.fingerprint_pairs(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(32768, 262144), (8, 6)])
def test_simhash(spark, rows, sizes):
    rows = rows + [(200 + k, " ".join(f"w{j}" for j in range(300) if j != k * 7)) for k in range(12)]

    def fp(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[k : k + 3] for k in range(len(w) - 2)] if len(w) > 2 else [w] if w else [])]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [(i, fp(t)) for i, t in kept(rows)]
    comp = {i: i for i, _ in f}
    changed = True
    while changed:
        changed = False
        for i, a in f:
            for j, b in f:
                if (a ^ b).bit_count() <= 2 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows), *sizes).collect())
    assert got == sorted((i, f"{a:016x}", comp[i]) for i, a in f)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)] + [(200, 200 + k) for k in range(30)], "a long, b long")
    got = dict(connected_components(edges).collect())
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100} | {200 + k: 200 for k in range(30)}


def test_mixing(spark, rows):
    df = frame(spark, rows)
    got = mixing.mix(df, {"src0": 3.0, "src1": 0.0}, other=1.0)
    again = mixing.mix(df, {"src0": 3.0, "src1": 0.0}, other=1.0)
    assert got.columns[:5] == df.columns[:5] and sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert got.where("source = 'src1'").count() == 0
    assert got.where("source = 'src0'").count() > got.where("source = 'src2'").count()
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("s").alias("source"), F.lit(2).alias("n_chars"))
    counts = {r[0]: r[1] for r in mixing.mix(many, {"s": 1.0}, 0.0, budget=100_000.0).groupBy("doc_id").count().collect()}
    n = np.array([counts.get(k, 0) for k in range(20000)])
    assert abs(n.mean() - 2.5) < 0.06 and abs(n.var() - 2.5) < 0.12
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": -1.0})
    assert mixing.mix(df.limit(0)).count() == 0


def test_substring_words(spark, rows):
    got = sorted(tuple(r) for r in substring_words.dedup(frame(spark, rows)).collect())
    want = [(i, len(u), int(g.sum()), hashlib.sha256(" ".join(x for x, y in zip(u, g, strict=True) if not y).encode()).hexdigest()) for i, u, g in covered(kept(rows), lambda t: [x for x in re.split("[\x20\x09-\x0d]+", t) if x], 50)]
    assert got == sorted(want) and sum(w[2] > 0 for w in want) > 4
    assert substring_words.dedup(frame(spark, rows).limit(0)).count() == 0


def test_substring_bytes(spark, rows):
    want = []
    for i, u, g in covered(kept(rows), lambda t: t.encode(), 50):
        runs = int(sum(g[k] and (k == 0 or not g[k - 1]) for k in range(len(g))))
        want.append((i, len(u), int(g.sum()), runs, hashlib.sha256(bytes(x for x, y in zip(u, g, strict=True) if not y)).hexdigest()))
    got = sorted(tuple(r) for r in substring_bytes.dedup(frame(spark, rows), queue_entries=100).collect())
    assert got == sorted(want)
    assert substring_bytes.dedup(frame(spark, rows).limit(0)).count() == 0


def test_induced_sorting():
    r = random.Random(1)

    def save(a, b):
        return lambda: (a.copy(), b.copy())

    for k in range(60):
        t = np.array([x for _ in range(12) for x in [r.randrange(1, 1 + r.choice([2, 4, 20]))] * r.choice([1, 1, 2, 90])] + [0], np.uint8)
        sa, lcp = (np.concatenate(x) for x in zip(*sorted_suffixes(t, lambda: Queues(save, 20)), strict=True))
        b = t.tobytes()
        assert sorted(sa.tolist()) == list(range(len(t)))
        for x, y, m in zip(sa[:-1].tolist(), sa[1:].tolist(), lcp[1:].tolist(), strict=True):
            common = next((j for j in range(56) if b[x + j : x + j + 1] != b[y + j : y + j + 1]), 56)
            assert m == common and (common == 56 or b[x:] < b[y:])


def test_packing(tmp_path):
    r = np.random.default_rng(0)
    for bits in (0, 1, 4, 9, 15, 16, 30, 60, 64):
        ids = r.integers(0, 2**bits, 5000, dtype=np.uint64, endpoint=False) if bits < 64 else r.integers(0, 2**64, 5000, dtype=np.uint64, endpoint=False)
        ids[::7] = 1
        assert (token_binary.unpack(token_binary.pack(ids)) == ids).all()
    assert len(token_binary.unpack(token_binary.pack(np.zeros(0, np.uint64)))) == 0


def test_token_binary(spark, rows):
    from tokenizers import Tokenizer

    path = token_binary.default_tokenizer()
    t = Tokenizer.from_file(path)
    odd = ["a  b", "x \n y", "don't we'll 12²½ªº\n\n a\n", "a<|endoftext|>b", "日本語 text", "tail ", "­ soft", "tab\there"]
    rows = rows + [(300 + k, x) for k, x in enumerate(odd)]
    got = [tuple(r) for r in token_binary.encode_documents(frame(spark, rows)).collect()]
    want, start = [], 0
    for i, x in sorted(((i, x or "") for i, x in rows), key=lambda p: (p[0] is not None, p[0] or 0, p[1])):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_binary.encode_documents(frame(spark, rows).limit(0)).count() == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{D.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    gold = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [i for i in gold if i % 2]
    assert np.mean([(got[i].p_low_quality <= 0.5) == bool(gold[i]) for i in held]) > 0.93
    clean = "The meeting about the river begins at noon and ends before the evening. "
    few = [(k, clean * (k + 1)) for k in range(6)] + [(6, None), (7, ""), (None, clean), (8, "%%% $$$ ### *** " * 40), (9, clean + "you stupid worthless idiot"), (9, clean)]
    keep = quality.classify(frame(spark, few)).collect()
    assert len(keep) == len(few) and all(r.keep for r in keep if r.doc_id is None or r.doc_id < 8)
    odd = frame(spark, few).select("*", F.lit(1).alias("p_toxic"), F.lit(2).alias("P_low_quality"), F.lit(3).alias("text_"), F.lit(4).alias("keep"))
    left = quality.filter_quality(odd)
    assert left.columns == odd.columns and {tuple(r)[-4:] for r in left.collect()} == {(1, 2, 3, 4)} and left.count() >= 9
    long = frame(spark, [(1, clean * 20_000), (2, "%%% $$$ ### *** " * 20_000), (3, clean)])
    assert quality.classify(long).count() == 3
    assert quality.classify(frame(spark, few).limit(0)).count() == 0


def test_decontamination(spark, rows):
    item = "A train leaves Rome at 7 hours and Anna walks 12 km to meet it, then waits 7 minutes near the old gate of Milan."
    other = item.replace("7", "9").replace("12", "15").replace("Rome", "Oslo").replace("Anna", "Petra").replace("Milan", "Turin")
    broken = item.replace("at 7 hours", "at 8 hours")
    docs = rows + [(500, f"bla {item} bla"), (501, f"bla bla {other} bla"), (502, f"bla {broken} bla"), (503, "A train leaves Rome at noon."), (504, "It is\n too  SHORT!\nfor all"), (505, "this is too short to tell")]
    bench = spark.createDataFrame([(1, item, 9), (2, "too short", 9), (None, item, 9), (3, None, 9)], "item_id long, text string, doc_id int")
    for limit in (1_000_000, 0):
        got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(frame(spark, docs), bench, broadcast_rows=limit).collect()}
        assert got == {(500, 1): "exact", (501, 1): "reparameterised", (504, 2): "whole"}
    left = decontaminate.decontaminate(frame(spark, docs), bench)
    assert left.columns == frame(spark, docs).columns and left.count() == len(docs) - 3
    assert decontaminate.leaks(frame(spark, docs).limit(0), bench).count() == 0 == decontaminate.leaks(frame(spark, docs), bench.limit(0)).count()


def test_personal_data(spark):
    pats = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def base(t):
        out = []
        for kind, p in pats:
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (16 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 8 <= len(d) <= 15):
                    continue
                out.append(f"{kind}:{m.start()}:{m.end()}")
        return out

    texts = [None, "", "a@b.c_d@e.f x@y.z.. 1.2.3.4.5.6.7.8 é a.b+c@d-e.co.uk,", "4111 1111 1111 1111 and 4111-1111-1111-11111 +1 (017) 555-7713+49 30 1234567 ( 0.0.0.256 00000000255.1.2.3", "1" * 9000 + " " + "a" * 20000 + "@ x@y.co" + " " * 9000 + "+1", "😀 mail a@b.cd 😀 1.2.3.4 😀", "12 " * 5000 + "+3 " * 500]
    texts += [f"call me, phone: (555) {k:03d}-4567, or tel 555-{k:03d}-9876." for k in range(30)] + [f"version 2024-01-{k:02d} of 123 456 789" for k in range(30)]
    got = {r.doc_id: r for r in pii.find(frame(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        want = base(t or "")
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(w.startswith(p) for w in want) for p, _ in pats], t
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[k].spans.split(",")) or not want
    assert pii.find(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_url_filter(spark):
    day = "date'2024-01-{:02d}'"
    pages = spark.sql(" union all ".join(f"select {i} page_id, {u} url, {d} fetched_on, 'x' key, 1 rank" for i, u, d in [(1, "'http://a.b.com/x'", day.format(5)), (2, "'http://a.b.com/x'", day.format(15)), (3, "'http://a.b.com/x'", day.format(25)), (4, "'https://u@B.COM:80'", day.format(15)), (5, "cast(null as string)", day.format(1)), (6, "'nonsense'", day.format(1)), (7, "'http://c.org'", "cast(null as date)"), (1, "'http://a.b.com/x'", day.format(5))]))
    entries = spark.createDataFrame([("a.b.com", "block", "2024-01-10"), ("a.b.com", "remove", "2024-01-20"), ("b.com", "allow", "2024-01-01"), ("b.com", "block", "2024-01-22"), ("b.com", "remove", "2024-01-22"), (None, "block", "2024-01-01"), ("c.org", "odd", "2024-01-01")], "key string, action string, listed_on string")
    for limit in (1000, 0):
        got = {r.page_id: (r.verdict, r.entry_key) for r in url_filter.filter_urls(pages, entries, broadcast_rows=limit).collect()}
        assert got == {1: ("allow", "b.com"), 2: ("block", "a.b.com"), 3: ("block", "b.com"), 4: ("allow", "b.com"), 5: ("invalid", None), 6: ("invalid", None), 7: ("undated", None)}
    assert url_filter.filter_urls(pages.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, entries.limit(0)).collect()} == {"keep", "invalid", "undated"}


def test_shared_folder_files(tmp_path):
    fs, at = pafs.FileSystem.from_uri(f"file://{tmp_path}")
    with fs.open_output_stream(f"{at}/s") as out:
        w = token_binary.ShardWriter(out)
        for k, n in enumerate((0, 3, 70_000, 1)):
            w.add(k, np.arange(n, dtype=np.uint64))
        w.close()
    with fs.open_input_file(f"{at}/s") as f:
        assert [(d, len(i), int(i.sum())) for d, i in token_binary.read_shard(f)] == [(0, 0, 0), (1, 3, 3), (2, 70_000, 70_000 * 69_999 // 2), (3, 1, 0)]


def test_decontamination_checks_every_place(spark):
    """A copy counts behind an instance of its template whose slots don't fit; an exact one comes before others."""
    bench = spark.createDataFrame([(1, "What is 5 plus 5 in base ten?")], "item_id long, text string")
    ask = "What is {} plus {} in base ten?".format
    docs = [(1, f"Sheet. {ask(3, 4)} So. {ask(5, 5)} End."), (2, f"{ask(3, 3)} {ask(1, 2)} {ask(5, 5)}"), (3, f"{ask(3, 4)} {ask(8, 8)}"), (4, f"{ask(3, 4)} {ask(1, 2)}")]
    got = {r.doc_id: (r.kind, r.at_word) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert got == {1: ("exact", 10), 2: ("exact", 16), 3: ("reparameterised", 8)}


def test_mixing_at_high_rates(spark):
    """Counts stay Poisson where exp(-rate) is 0."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("s").alias("source"), F.lit(2).alias("n_chars"))
    n = np.array([r[1] for r in mixing.mix(docs, {"s": 1.0}, 0.0, budget=600_000.0).groupBy("doc_id").count().collect()])
    assert len(n) == 300 and abs(n.mean() - 1000) < 8 and 650 < n.var() < 1400


def test_served_suffixes_spill(tmp_path):
    """With a small limit all but a few suffixes go to files, and memory doesn't keep nine bytes of each."""
    t = np.append(np.random.default_rng(2).integers(97, 117, 400_000, np.uint8), np.uint8(0))
    save, written = substring_bytes._saver(f"file://{tmp_path}/q"), []

    def counted(places, prefixes):
        written.append(len(places))
        return save(places, prefixes)

    pieces = list(sorted_suffixes(t, lambda: Queues(counted, 1_000)))
    want = [np.concatenate(x) for x in zip(*sorted_suffixes(t), strict=True)]
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*pieces, strict=True), want, strict=True))
    assert sum(written) > 2 * len(t) - 100_000  # each suffix in its queue, and once served; before: the queues' alone
    assert not list((tmp_path / "q").iterdir())


@pytest.mark.parametrize("sizes", [(4, 10_000), (4, 20)])
def test_links_of_larger_budgets(spark, sizes):
    """Pairs that differ in three of the top bits are linked too."""
    r = np.random.default_rng(4)
    fps = [int(x) for x in r.integers(0, 2**63, 40)]
    pairs = [(x, x ^ (0b111 << k)) for x, k in zip(fps, [60, 59, 58, 57, 40, 20, 0, 56] * 5, strict=True)]
    nodes = spark.createDataFrame([(int(np.uint64(y).view(np.int64)),) for p in pairs for y in p], "fp long")
    found = {frozenset((a & 2**64 - 1, b & 2**64 - 1)) for a, b in simhash.links(nodes, *sizes, budget=3).collect()}
    assert found == {frozenset(p) for p in pairs}


def test_substring_groups_of_near_copies(spark):
    """Anchors that many documents share are split, contexts that many share are settled: equal to brute force."""
    r = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfglmn" for b in ("a", "e", "io", "ung")]
    text = lambda n: [r.choice(words) for _ in range(n)]
    hub, run, rows = text(130), ["la"] * 60 + ["li"] * 55, []
    for k in range(60):
        t = list(hub)
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((r.randrange(1000, 2000), " ".join(text(k % 4) + t[: r.randrange(60, 130)] + text(k % 3))))
        rows.append((2000 + k, " ".join(text(2) + run[r.randrange(40) : 70 + r.randrange(45)] + text(2))))
    b = covered(kept(rows), lambda t: t.encode(), 50)
    want = sorted((i, len(u), int(g.sum()), int(g[0]) + int((g[1:] & ~g[:-1]).sum()), hashlib.sha256(bytes(x for x, y in zip(u, g, strict=True) if not y)).hexdigest()) for i, u, g in b)
    for hot in (2, 10**6):
        assert sorted(tuple(x) for x in substring_bytes.dedup(frame(spark, rows), hot=hot).collect()) == want
    w = covered(kept(rows), str.split, 50)
    want = sorted((i, len(u), int(g.sum()), hashlib.sha256(" ".join(x for x, y in zip(u, g, strict=True) if not y).encode()).hexdigest()) for i, u, g in w)
    assert sorted(tuple(x) for x in substring_words.dedup(frame(spark, rows)).collect()) == want


def test_substring_of_very_long_texts(spark):
    """A passage across the border of two scanned parts of one text is found."""
    r = np.random.default_rng(6)
    words = [f"{x:x}" for x in r.integers(0, 2**40, substring_words.SEGMENT + 9_000)]
    at = substring_words.SEGMENT - 20
    passage = words[at : at + 90]
    rows = [(1, " ".join(["x", *passage, "y"])), (2, " ".join(words)), (3, " ".join(words[-70:]))]
    got = {x.doc_id: x.n_removed for x in substring_words.dedup(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 90, 3: 70}
    size = len(rows[1][1])
    assert size > substring_bytes.SEGMENT
    text = rows[1][1]
    cut = text[substring_bytes.SEGMENT - 30 : substring_bytes.SEGMENT + 45]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in substring_bytes.dedup(frame(spark, [(1, f"#{cut}#"), (2, text), (3, text[-64:])])).collect()}
    assert got == {1: (0, 0), 2: (75, 1), 3: (64, 1)}


def test_reduced_strings_are_sorted():
    """Recursion over names: equal to a plain sort of all suffixes."""
    r = random.Random(3)
    for _ in range(80):
        top = r.choice([2, 4, 20])
        t = np.array([x for _ in range(r.randrange(1, 14)) for x in [r.randrange(1, 1 + top)] * r.choice([1, 1, 2, 9])] + [0], np.int64)
        assert suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_decontamination_kinds_and_repeated_ids(spark):
    """A changed word is no exact copy, an inserted one shifts the rest; of rows with one id any may leak."""
    bench = spark.createDataFrame([(1, "please give us the sum of 12 apples and 30 pears that Anna put into the large red basket on day 4 of the week")], "item_id long, text string")
    item = bench.first().text
    docs = [(1, f"a b {item} c"), (2, item.replace("week", "month")), (3, item.replace("the large", "the very large")), (4, item.replace("the large", "the very large").replace("12", "15")), (5, item.replace("the large", "the very large").replace("day 4", "day 12")), (6, "aaa clean text of another row"), (6, f"zzz {item}"), (7, f"x {item.replace('30', '12')}")]
    got = {r.doc_id: r.kind for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert got == {1: "exact", 2: "edited", 3: "edited", 4: "reparameterised", 6: "exact"}
    assert decontaminate.decontaminate(frame(spark, docs), bench).count() == 2


def test_decontamination_against_brute_force(spark):
    """Random templates with other values: all consistent ones are found, no inconsistent or partial one is."""
    r = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdgkmt" for b in "aeiou" for c in ("l", "n", "rs")]
    bench, docs, want = [], [], set()
    for item in range(40):
        t = [r.choice(words) for _ in range(r.randrange(12, 40))]
        at = sorted(r.sample(range(2, len(t) - 2), 3))
        values = [str(v) for v in r.sample(range(100, 500), 2)]
        fill = lambda v: [v[0] if k in at[:2] else v[1] if k == at[2] else w for k, w in enumerate(t)]  # noqa: B023, E731
        bench.append((item, " ".join(fill(values))))
        prose = lambda n: [r.choice(words) for _ in range(n)]
        for kind in range(4):
            doc = item * 10 + kind
            x = fill([str(r.randrange(1000, 5000)), str(r.randrange(6000, 9000))]) if kind != 1 else fill(values)
            if kind == 2:
                x[at[0]] = "77"
            if kind == 3:
                x = x[: len(x) // 2]
            docs.append((doc, " ".join(prose(r.randrange(30)) + x + prose(r.randrange(30)))))
            if kind < 2:
                want.add((doc, item, "exact" if kind else "reparameterised"))
    got = {(x.doc_id, x.item_id, x.kind) for x in decontaminate.leaks(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == want


def test_quality_finds_toxic_documents(spark):
    """Held-out recall of labelled toxic documents in all languages, clean ones left alone; twice the same."""
    docs, labels = (spark.read.parquet(f"{D.replace('0.001', '0.1')}/{n}.parquet") for n in ("documents", "labels"))
    gold = {r.doc_id: r.toxic for r in labels.collect()}
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = {r.doc_id: r.p_toxic for r in quality.classify(some, labels.where("doc_id % 2 = 0")).collect()}
    found, missed, wrong = (sum(bool(gold[i]) == t and (p > 0.5) == f for i, p in got.items() if i % 2) for t, f in ((True, True), (True, False), (False, True)))
    assert found >= 0.8 * (found + missed) and wrong <= 3, (found, missed, wrong)
    again = {r.doc_id: r.p_toxic for r in quality.classify(some.repartition(5), labels.where("doc_id % 2 = 0")).collect()}
    assert again == got


def test_personal_data_found_by_votes(spark):
    """Planted phones, spelled addresses, names and secrets are accepted, dates, amounts and placeholders aren't; places are right."""
    r = random.Random(2)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    good = [lambda: f"({digits(3)}) 555-{digits(4)}", lambda: f"anna{digits(2)} at mail{digits(1)} dot com", lambda: f'token = "{r.randbytes(20).hex()}"', lambda: f"AKIA{''.join(r.choice('ABCDEFGHIJKLMNOP234567') for _ in range(16))}"]
    lead = ["phone: ", "mail: ", "", "key: "]
    bad = [lambda: f"2024-0{r.randrange(1, 10)}-1{digits(1)} 10", lambda: f"123 {digits(3)} {digits(3)}", lambda: "password = your_password_here"]
    rows, want, decoys = [], {}, {}
    for k in range(300):
        kind = k % 7
        g = (good + bad)[kind]()
        before = f"é some prose {digits(1)} " + (lead + [""] * 3)[kind]
        rows.append((k, f"{before}{g} and more"))
        (want if kind < 4 else decoys)[k] = (len(before), len(before) + len(g))
    got = {x.doc_id: x for x in pii.find(frame(spark, rows)).collect()}
    hit = sum(any(tuple(map(int, s.split(":")[1:])) == at for s in got[k].spans.split(",") if s) for k, at in want.items())
    false = sum(got[k].n_added > 0 for k in decoys)
    assert hit >= 0.95 * len(want) and false <= 0.1 * len(decoys), (hit, len(want), false, len(decoys))
    assert sum(x.n_secret for x in got.values()) >= 0.95 * 2 * 300 / 7 - 2
    # candidates never meet base spans
    for x in got.values():
        s = sorted(tuple(map(int, y.split(":")[1:])) for y in x.spans.split(",") if y)
        assert all(a[1] <= b[0] for a, b in zip(s, s[1:], strict=False))


def test_tables_of_numbers_hold_no_item(spark):
    """Many hits of the same windows aren't an item: its words must be there."""
    tables = [(k, "Table " + " ".join(str(v) for v in range(k, 60 + k))) for k in range(3)]
    items = [(k, f"What comes next in the row {' '.join(str(v) for v in range(k, k + 8))} for case {k} of the set ?") for k in range(3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.leaks(frame(spark, tables), bench).count() == 0
    got = decontaminate.leaks(frame(spark, [*tables, (9, f"so {items[1][1]} and on")]), bench).collect()
    assert {r.doc_id for r in got} == {9} and next(r.coverage for r in got if r.item_id == 1) > 0.9


def test_phones_that_end_a_sentence(spark):
    """A full stop behind a phone isn't part of it, unless a digit follows."""
    texts = [f"call: (555) 123-4{k:03d}. Mail: bob{k} at mail dot com now" for k in range(150)] + [f"release 55.12 123-4{k:03d}.7 of it" for k in range(20)]
    got = {x.doc_id: x for x in pii.find(frame(spark, list(enumerate(texts)))).collect()}
    assert sum(f"phone:6:{6 + len('(555) 123-4000')}" in got[k].spans for k in range(150)) >= 0.95 * 150
    assert not any("phone" in got[k].spans for k in range(150, 170))


def test_mixing_keeps_clashing_columns(spark):
    """Whatever further columns are called, they pass through."""
    names = ["__n", "__s", "__cdf", "__m", "mix_0", "MIX_2"]
    df = spark.createDataFrame([(1, "a b", "s", 3, *range(6))], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in names))
    out = mixing.mix(df, {"s": 1.0}, 0.0, budget=9.0)
    assert set(names) < set(out.columns) and all(tuple(r[c] for c in names) == tuple(range(6)) for r in out.collect()) and out.count() > 0


def test_personal_data_in_texts_of_many_matches(spark):
    """Time grows with the matches, not with their square."""
    text = "".join(f"u{k}@mail.example.com (555) 123-4567\n" for k in range(20_000))
    x = pii.find(frame(spark, [(1, text)])).first()
    assert x.n_email == 20_000 and x.spans.startswith("email:0:")
    last = [s for s in x.spans.split(",") if s.startswith("email")][-1].split(":")
    assert text[int(last[1]) : int(last[2])] == "u19999@mail.example.com"


def test_winnowing_against_brute_force(spark):
    """Rolling hashes, forced ties, fingerprints and likenesses."""
    texts = {1: "la " * 40 + "lo la li " * 9, 2: "a b", 3: "", 4: "x" * 300, 5: "one two three four five six seven eight nine ten eleven twelve", 6: "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"}
    units = lambda t: [u for w in re.split("[\x20\x09-\x0d]+", t) for u in [w[k : k + 12] for k in range(0, len(w), 12)]]

    def marks(t):
        u = [spark.range(1).select(F.pmod(F.xxhash64(F.lit(x)), F.lit(winnow.PRIME))).first()[0] if x not in known else known[x] for x in units(t)]
        known.update(zip(units(t), u, strict=True))
        h = []
        for i in range(max(1, len(u) - 2)):
            g = u[i] if u else 0
            for j in (1, 2):
                g = (g * winnow.BASE + (u[i + j] if i + j < len(u) else 0)) % winnow.PRIME
            h.append(g)
        return sorted({max(range(s, min(s + 8, len(h))), key=lambda i: (-h[i], i)) for s in range(max(1, len(h) - 7))}), h

    known: dict = {}
    got = {x.doc_id: x for x in winnow.fingerprint_pairs(frame(spark, list(texts.items()))).collect()}
    ids = sorted(texts, reverse=True)
    near = lambda a, b: len(a & b) / len(a | b)
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        (at, h), (to, g), (nt, f) = marks(t), marks(edited), marks(n)
        assert got[i].fingerprint.lower() == "".join(f"{h[x] << 32 | (2**32 - 1 - x):016x}" for x in at)
        assert abs(got[i].near_edited - near({h[x] for x in at}, {g[x] for x in to})) < 1e-12
        assert abs(got[i].near_next - near({h[x] for x in at}, {f[x] for x in nt})) < 1e-12
