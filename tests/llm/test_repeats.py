import random

import numpy as np
import pyarrow as pa

import brute

from tidewright.llm import repeats, substrings, suffixes


def corpus(seed: int, n: int = 60):
    rnd = random.Random(seed)
    vocab = ["a", "b", "the", "of", "ha", "é", "x1", "good", "über", "日本", "z" * 30]
    passages = [" ".join(rnd.choice(vocab[: rnd.randrange(1, len(vocab) + 1)]) for _ in range(rnd.randrange(20, 140))) for _ in range(12)]
    passages += ["ha " * 70, "a b " * 40, "a b c " * 30, "a a b " * 30, "x" * 120, "xy" * 80, "ha " * 20 + "q w e r t y u i o p " + "a " * 20]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "short")]
    for d in range(4, n):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            p = rnd.choice(passages)
            if rnd.random() < 0.4:
                w = p.split(" ")
                w[rnd.randrange(len(w))] = rnd.choice(["edit", "", "é"])
                p = " ".join(w)
            if rnd.random() < 0.5:
                p = p[rnd.randrange(0, 20) : len(p) - rnd.randrange(0, 20)]
            parts.append(p)
            parts.append(" ".join(str(rnd.random()) for _ in range(rnd.randrange(0, 30))))
        rows.append((d * 3 % 97 if d < 97 else d, rnd.choice([" ", "\n", "\t\t"]).join(parts)))
    seen = set()
    return [r for r in rows if not (r[0] in seen or seen.add(r[0]))]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id bigint, text string, chunk string, id bigint")


def test_passages_equal_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_tokens, r.n_removed, r.left) for r in substrings.remove_repeated_passages(frame(spark, rows), digest=True).collect()}
        assert got == brute.op9(rows)


def test_strings_equal_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_tokens, r.n_removed, r.n_spans, r.left) for r in suffixes.remove_repeated_strings(frame(spark, rows), digest=True).collect()}
        assert got == brute.op10(rows)


def test_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_tokens, r.n_removed, r.left) for r in substrings.remove_repeated_passages(docs, digest=True).collect()} == brute.op9(rows)
    assert {r.doc_id: (r.n_tokens, r.n_removed, r.n_spans, r.left) for r in suffixes.remove_repeated_strings(docs, digest=True).collect()} == brute.op10(rows)


def test_edges(spark):
    empty = frame(spark, [])
    assert substrings.remove_repeated_passages(empty).count() == 0
    assert suffixes.remove_repeated_strings(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (5, long), (5, long), (7, long + " é"), (7, None)]
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_removed) for r in substrings.remove_repeated_passages(frame(spark, rows)).collect())
    assert got == [(-1, 60, 60), (5, 60, 0), (5, 60, 0), (7, 0, 0), (7, 61, 60)]
    text = {r.doc_id: r.left for r in suffixes.remove_repeated_strings(frame(spark, rows[1:2] + rows[3:4]), carry=["chunk"], as_text=True).collect()}
    assert text[7] == " é" and text[5] == long


def test_landmarks_of_equal_windows():
    """Any 50 words hold a landmark that does not depend on what stands around them; any 50 bytes have one representative."""
    rnd = random.Random(5)
    for _ in range(400):
        w = " ".join(rnd.choice("abcde") for _ in range(50))
        found = []
        for _ in range(2):
            before, after = (" ".join(rnd.choice("abcde") for _ in range(rnd.randrange(0, 40))) for _ in range(2))
            at = len(before.split())
            t = substrings.words([" ".join(x for x in (before, w, after) if x).encode()])
            s, k = substrings.landmarks(t)
            ok = (s >= at) & (s < at + 50)
            found.append({(int(a) - at, int(b)) for a, b in zip(s[ok], k[ok])})
        common = {b for _, b in found[0] & found[1]}
        assert common, w
        assert substrings.possible(t, lambda key: np.array([int(x) in common for x in key], bool))[at], w
    for _ in range(400):
        w = "".join(rnd.choice("abc ") for _ in range(50))
        found = set()
        for _ in range(2):
            before, after = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 40))) for _ in range(2))
            s, n, k = suffixes.runs(suffixes.positions([b"x", (before + w + after).encode()]))
            at = 1 + len(before.encode())
            found.add(int(k[(s <= at) & (at < s + n)][0]))
        assert len(found) == 1


def test_runs_of_one_representative_stay_apart():
    """Different contexts of one frequent string have different names."""
    rnd = random.Random(8)
    middle = "the one line of every page."
    texts = [("".join(rnd.choices("abcdefgh", k=40)) + middle + "".join(rnd.choices("abcdefgh", k=40))).encode() for _ in range(50)]
    chunk = suffixes.Chunk(pa.table({"id": pa.array(range(50), pa.int64()), "text": pa.array(texts, pa.binary())}), 4, 64, repeats.random_points())
    want = {(int(k), bytes(t)) for _, ts, start, size, key, _ in chunk.steps for s, n, k in zip(start, size, key) for t in [b"".join(ts)[s : s + n + 49]]}
    assert len({k for k, _ in want}) < len(want)
    chunk.narrow(chunk.representatives()[0])
    assert len(chunk.whole_runs()[0]) == len(want)


def test_names_are_polynomials_modulo_the_prime():
    rnd = random.Random(9)
    tokens = np.array([rnd.getrandbits(61) or 1 for _ in range(400)] + [2**61 - 1, 1], np.uint64)
    for point in repeats.random_points():
        for small in (False, True):
            t = tokens & np.uint64(255) if small else tokens
            start = np.sort([rnd.randrange(0, 300) for _ in range(12)])
            end = start + np.array([rnd.randrange(1, 75) for _ in range(12)])
            (got,) = repeats.names(t.astype(np.uint8) if small else t, start, end, (point,), small)
            assert got.tolist() == [sum((int(x) + small) * pow(point, i, repeats.PRIME) for i, x in enumerate(t[a:b])) % repeats.PRIME for a, b in zip(start, end)]


def test_long_texts_in_blocks(spark, monkeypatch):
    rnd = random.Random(11)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text), (2, "x" + text[500:1700] + "y" + text[100:900]), (3, text[::-1] + text[2000:2100])]
    want = brute.op10(rows)
    monkeypatch.setattr(repeats, "_BLOCK", 256)
    monkeypatch.setattr(suffixes, "_BLOCK", 100)
    repeats._points.clear()
    raw = suffixes.positions([t.encode() for _, t in rows])
    s, n, _ = suffixes.runs(raw)
    monkeypatch.undo()
    a, b, _ = suffixes.runs(raw)
    assert (s == a).all() and (n == b).all()
    points = repeats.random_points()
    whole = repeats.names(raw.values, s, s + n + 49, points, True)
    monkeypatch.setattr(repeats, "_BLOCK", 256)
    repeats._points.clear()
    for x, y in zip(whole, repeats.names(raw.values, s, s + n + 49, points, True)):
        assert (x == y).all()
    repeats._points.clear()
    assert {r.doc_id: (r.n_tokens, r.n_removed, r.n_spans, r.left) for r in suffixes.remove_repeated_strings(frame(spark, rows), digest=True).collect()} == want


def thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_unlike_long_words_have_unlike_names(spark):
    """Words that polynomial hashes modulo a power of two cannot tell apart, in a document's first word and all along a window."""
    flip = str.maketrans("ab", "ba")
    tail = " ".join(f"w{i}" for i in range(49))
    rows = []
    for n in (64, 1024, 2048):
        x = thue_morse(n)
        rows += [(len(rows), f"{x} {tail}"), (len(rows) + 1, f"{x.translate(flip)} {tail}")]
    x = " ".join(thue_morse(64))
    rows += [(10, x[:99]), (11, x.translate(flip)[:99])]
    got = {r.doc_id: (r.n_tokens, r.n_removed, r.left) for r in substrings.remove_repeated_passages(frame(spark, rows), digest=True).collect()}
    assert got == brute.op9(rows) and all(v[1] == 0 for d, v in got.items() if d < 10)
    rows = [(d, t.replace(" ", "")) for d, t in rows]
    assert {r.doc_id: (r.n_tokens, r.n_removed, r.n_spans, r.left) for r in suffixes.remove_repeated_strings(frame(spark, rows), digest=True).collect()} == brute.op10(rows)


def test_names_of_words_are_distinct():
    rnd = random.Random(10)
    ws = {bytes(rnd.randrange(33, 127) for _ in range(rnd.randrange(1, 90))) for _ in range(4000)} | {b"a" * n for n in range(1, 200)} | {bytes([c]) for c in range(128, 256)}
    ws = sorted(ws)
    one = substrings.words([b" ".join(ws)]).values
    assert len(set(one.tolist())) == len(ws)
    back = substrings.words([b"x " + b"\n".join(ws[::-1])]).values[1:]
    assert (back[::-1] == one).all()


def test_many_texts_round_one_string(spark):
    """Of 300,000 different 50-byte texts with one common end nothing goes."""
    from pyspark.sql import functions as F

    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 24), F.lit("the one line of every page")).alias("text"))
    got = suffixes.remove_repeated_strings(docs, digest=True).selectExpr("count(*) n", "sum(n_tokens) b", "sum(n_removed) r").first()
    assert tuple(got) == (300_000, 50 * 300_000, 0)


def test_null_and_repeated_ids_are_dealt_over_chunks(spark):
    from pyspark.sql import functions as F

    text = F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))) for k in range(8)])
    for doc in (F.lit(None).cast("bigint"), F.lit(7).cast("bigint")):
        docs = spark.range(2000).select(doc.alias("doc_id"), text.alias("text"))
        texts, _, _ = repeats.dealt(docs, "doc_id", "text", [])
        assert texts.select("chunk").distinct().count() > 4
        for out in (substrings.remove_repeated_passages(docs.union(docs)), suffixes.remove_repeated_strings(docs.union(docs))):
            assert tuple(out.selectExpr("count(*)", "sum(n_removed)").first()) == (4000, 0)


def test_texts_of_a_short_period_beyond_a_block(spark):
    n = repeats._BLOCK + 300
    texts = ["a" * n, "." + "a" * (n + 7), "abc" * (n // 3), "c" + "abc" * (n // 3 + 5) + "!" * 40, "q" * n]
    got = {r.doc_id: (r.n_tokens, r.n_removed, r.n_spans, r.left) for r in suffixes.remove_repeated_strings(frame(spark, list(enumerate(texts)))).collect()}
    want = [(texts[0], 0, 0), (".", n + 7, 1), (texts[2], 0, 0), ("!" * 40, len(texts[3]) - 40, 1), (texts[4], 0, 0)]
    assert {d: (len(t), k, s, left.encode()) for d, (t, (left, k, s)) in enumerate(zip(texts, want, strict=True))} == got
    s, size, _ = suffixes.runs(suffixes.positions([t.encode() for t in texts]))
    assert size.max() == 25 and size.sum() == sum(len(t) - 49 for t in texts)


def test_parts_get_equally_many_representatives():
    text = np.random.default_rng(3).integers(0, 256, 1 << 20, dtype=np.uint8).tobytes()
    chunk = suffixes.Chunk(pa.table({"id": pa.array([1], pa.int64()), "text": pa.array([text], pa.binary())}), suffixes.part_edges(50), 64, repeats.random_points())
    keys = chunk.representatives()[0]
    sizes = [s.stop - s.start for _, s in chunk.split(keys, True)]
    assert len(sizes) == 50 and max(sizes) < 1.2 * len(keys) / 50
