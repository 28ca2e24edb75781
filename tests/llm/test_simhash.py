import random

import brute
import numpy as np

from tidewright.llm import simhash
from tidewright.llm.components import components


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, 4, 4).collect()}
    assert got == brute.op8(rows)


def test_edges(spark):
    schema = "doc_id bigint, text string, fp string, id int"
    assert simhash.near_duplicates(spark.createDataFrame([], schema), 4).count() == 0
    rows = [(7, None), (3, ""), (9, " \n"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (None, "one two")]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], schema), 4).collect())
    assert got == [(-1, 4), (3, 3), (4, 4), (5, 4), (5, 4), (7, 3), (9, 3)]


def test_tree_and_pieces_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 32)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for _ in range(4)], base[0] ^ np.arange(200, dtype=np.uint64)]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    want = {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)}
    root = list(range(len(fps)))
    pairs = simhash.forest(fps, 4)
    assert len(pairs) == len(fps) - len(want) and all(near[i, j] for i, j in pairs)
    for i, j in pairs.tolist():
        p, q = root[i], root[j]
        root = [min(p, q) if x == max(p, q) else x for x in root]
    root = np.array(root)
    assert {frozenset(np.flatnonzero(root == k).tolist()) for k in set(root)} == want
    tree = simhash.Tree(fps, 20, 4)
    at, leaf = tree.route(fps)
    shards = [set(leaf[at == i]) for i in range(len(fps))]
    assert tree.leaves > 4 and all(shards[i] & shards[j] for i, j in zip(*np.nonzero(near)))


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, rnd.randrange(2, 60)) for _ in range(80)] + [(200, 150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    assert all(got[i] == 100 for i in (101, 159, 160, 200)) and all(got[b] == 1 for _, b in pairs[60:140])
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_near_copies_go_and_clean_documents_stay(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randrange(60, 300))] for _ in range(120)]
    rows, near = [], {}
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
    for i in range(0, 120, 2):
        w = list(base[i])
        for _ in range(max(1, len(w) // 80)):
            w[rnd.randrange(len(w))] = "edited"
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, base[i]))
        near[1000 + i] = len(a & b) / len(a | b)
        rows.append((1000 + i, " ".join(w)))
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, fp string, a int")
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert set(range(120)) <= left  # every document that came first stays
    wanted = [d for d, j in near.items() if j >= 0.8]
    found = [d for d in wanted if d not in left]
    print("recall", len(found) / len(wanted), "of", len(wanted))
    assert len(found) >= 0.9 * len(wanted) and all(d in left for d, j in near.items() if j < 0.8)
    assert simhash.drop_near_duplicates(docs.filter("false")).count() == 0


def _padded(rnd, own, word="same", times=400):
    """Words of one's own among repeats of one word, whose shingle decides the fingerprint."""
    return " ".join([word] * times + [f"w{rnd.getrandbits(40)}" for _ in range(own)])


def test_equal_fingerprints_are_no_link(spark):
    rnd = random.Random(5)
    texts = [_padded(rnd, 800) for _ in range(12)]
    assert len(set(simhash.fingerprints([t.encode() for t in texts], 5).tolist())) < 12
    rows = list(enumerate(texts)) + [(100, texts[7] + " more"), (101, texts[3].upper() + "  "), (None, texts[1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, d string").repartition(3)
    left = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(left, key=lambda d: -1 if d is None else d) == [None, *range(12)]


def test_wrong_candidates_hide_no_link(spark):
    """Hundreds of unrelated documents within 14 bits of one another, and every similar pair among them is found."""
    rnd = random.Random(6)
    rows, near = [], set()
    for i in range(400):
        words = _padded(rnd, 200, times=22).split()
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            for k in rnd.sample(range(30, len(words)), 3):
                words[k] = "edited"
            near.add(1000 + i)
            rows.append((1000 + i, " ".join(words)))
    fps = simhash.fingerprints([t.encode() for _, t in rows], 5)
    assert (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 14).sum(1).mean() > 100
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, d string").repartition(3)
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert left == set(range(400))


def test_near_copies_of_one_key_over_several_blocks(spark, monkeypatch):
    """A link that the chain by size misses is found among all pairs of a shingle."""
    monkeypatch.setattr(simhash, "_PAIR_ROWS", 3)
    monkeypatch.setattr(simhash, "_ROWS_AT_ONCE", 2)
    rnd = random.Random(7)
    line = " ".join(f"c{k}" for k in range(8))
    rows = [(i, " ".join([line] + [f"w{rnd.getrandbits(40)}" for _ in range(22)])) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 40, 3)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, d string").repartition(3)
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(range(40))


def test_rows_go_by_id_and_text(spark):
    """A row that repeats the id of a near copy stays if its own text is unlike; rows without an id stay."""
    rnd = random.Random(13)
    words = [[f"w{rnd.getrandbits(30)}" for _ in range(120)] for _ in range(4)]
    near = [" ".join([*w[:60], "edited", *w[61:]]) for w in words]
    rows = [(1, " ".join(words[0])), (2, near[0]), (2, " ".join(words[1])), (2, " ".join(words[2])), (3, near[2]), (None, near[1]), (None, near[1]), (4, None), (5, ""), (6, " \n"), (7, " ".join(words[3])), (7, " ".join(words[3]))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, d string, n int").repartition(3)
    left = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()), key=repr)
    want = [r for r in rows if r not in ((2, near[0]), (3, near[2]), (5, ""), (6, " \n"))]
    assert left == sorted(want, key=repr)


def test_parities_reject_nothing_similar():
    rng = np.random.default_rng(14)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, n // 8) + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common >= 0.8 * (len(a) + len(b) - common):
            assert simhash.may_be_similar(simhash.parity(a), simhash.parity(b), len(a), len(b), 0.8)
    sets = [np.unique(rng.integers(0, 2**63, int(k), dtype=np.uint64)) for k in (60, 64, 65, 70, 120, 128, 129, 150)]
    for x in sets:
        for y in sets:
            p, q = simhash.parity(x), simhash.parity(y)
            want = simhash.may_be_similar(p, q, len(x), len(y), 0.2) and min(len(x), len(y)) >= 0.2 * max(len(x), len(y))
            table = simhash._apart(*(np.frombuffer(z, np.uint64)[None] for z in (p, q)), np.array([len(x)]), np.array([len(y)]), 0.2)
            assert (table[0, 0] < simhash._FAR) == want
    a, b = (rng.integers(0, 2**63, 700, dtype=np.uint64) for _ in range(2))
    assert not simhash.may_be_similar(simhash.parity(a), simhash.parity(b), 700, 700, 0.8)
    assert simhash.parity(np.empty(0, np.uint64)) == bytes(8)


def test_closest_pairs_of_each_root(monkeypatch):
    monkeypatch.setattr(simhash, "_PAIR_ROWS", 3)
    monkeypatch.setattr(simhash, "_ROWS_AT_ONCE", 2)
    rng = np.random.default_rng(16)
    base = rng.integers(0, 2**63, 130, dtype=np.uint64)
    sets = [np.unique(np.r_[base[int(rng.integers(0, 12)) :], rng.integers(0, 2**63, int(rng.integers(0, 9)), dtype=np.uint64)]) for _ in range(20)]
    n, root, bits = np.array(list(map(len, sets))), np.arange(20) % 7, [simhash.parity(x) for x in sets]
    whole = {tuple(sorted(p)) for p in simhash._meeting(n, root, bits, 0.8, False).tolist()}
    apart = {(i, j): int(simhash._apart(*(np.frombuffer(bits[k], np.uint64)[None] for k in (i, j)), n[[i]], n[[j]], 0.8)[0, 0]) for i in range(20) for j in range(20) if root[i] != root[j]}
    assert whole == {(i, j) for (i, j), x in apart.items() if i < j and x < simhash._FAR}
    near = simhash._meeting(n, root, bits, 0.8, True).tolist()
    assert sorted(root[i] for i, _ in near) == sorted({int(root[i]) for (i, j), x in apart.items() if x < simhash._FAR})
    assert all(apart[i, j] == min(x for (p, _), x in apart.items() if root[p] == root[i]) for i, j in near)


def test_a_dense_ball_is_joined_quickly():
    """Fifty thousand points within a few bits of one another: no step grows with points times unions."""
    import time

    rng = np.random.default_rng(15)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60_000, 3)).astype(np.uint64), axis=1)
    points = np.unique(np.uint64(0x123456789ABCDEF) ^ flips)[:30_000]
    began = time.time()
    pairs = simhash.forest(points, 4)
    assert len(pairs) == len(points) - 1 and time.time() - began < 60
