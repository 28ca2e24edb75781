import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidewright.llm import packing
from tidewright.llm.queries import tokenizer_path


def check(pieces, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert len(ids) == p.length > 0 and zlib.crc32(np.array(ids, np.uint32).tobytes()) == p.ids_crc32 and p.doc_tokens == len(want[p.doc_id])
        by_doc[p.doc_id].append((p.start, p.length))
        by_seq[p.sequence_id].append((p.offset, p.length))
    for d, ids in want.items():
        at = 0
        for a, n in sorted(by_doc[d]):
            assert a == at
            at += n
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: no padding at all


def test_every_token_once_and_no_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(packing.pack_documents(docs, tokenizer_path()).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_edges(spark):
    schema = "doc_id bigint, text string, ids string, near int"
    assert packing.pack_documents(spark.createDataFrame([], schema), tokenizer_path()).count() == 0
    rows = {0: None, 1: "", 2: "word " * 9000, 3: "same text", 4: "same text", 5: "<|endoftext|>"}
    check(packing.pack_documents(spark.createDataFrame([(d, t, "x", 1) for d, t in rows.items()], schema), tokenizer_path()).collect(), rows)


def test_bm25_against_plain_formula():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint16) for _ in range(50)]
    df = np.zeros(40)
    for d in docs:
        df[np.unique(d)] += 1
    mean = np.mean([len(d) for d in docs])
    index = packing.Index(docs, df, len(docs), mean)

    def w(d, t):
        tf = (docs[d] == t).sum()
        return np.log1p((50 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))

    for seed in range(10):
        used = rng.random(50) < 0.3
        score = {d: sum(w(d, t) for t in set(docs[seed].tolist())) for d in range(50) if not used[d]}
        got = list(index.neighbours(seed, used))
        assert sorted(got) == sorted(d for d, s in score.items() if s > 0)
        ordered = [score[d] for d in got]
        assert ordered == pytest.approx(sorted(ordered, reverse=True), rel=1e-5)


def test_long_seeds_are_scored_by_all_their_terms():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 2000, rng.integers(300, 900)).astype(np.uint16) for _ in range(40)]
    sets = [np.unique(d) for d in docs]
    df = np.bincount(np.concatenate(sets), minlength=2000).astype(float)
    mean = np.mean([len(d) for d in docs])
    index = packing.Index(docs, df, len(docs), mean)
    tf = np.array([np.bincount(d, minlength=2000) for d in docs])
    length = np.array([len(d) for d in docs])[:, None]
    weight = np.log1p((40 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    for seed in range(10):
        assert len(sets[seed]) > 200
        used = np.zeros(40, bool)
        used[seed] = True
        score = weight[:, sets[seed]].sum(1)
        got = list(index.neighbours(seed, used))
        assert sorted(got) == [d for d in range(40) if d != seed]
        ordered = [score[d] for d in got]
        assert ordered == pytest.approx(sorted(ordered, reverse=True), rel=1e-5)


def plain_fill(lengths, ranked, window):
    """The greedy rule, token by token: a window takes its seed, then the seed's unused neighbours, best first; what overflows seeds the next one."""
    free, out, sequence, rest = list(range(len(lengths))), [], [], []
    while free or rest:
        seed = rest[0][0] if rest else free.pop(0)
        queue = rest or [(seed, k) for k in range(lengths[seed])]
        rest = []
        asked = None
        while len(sequence) < window and (queue or asked != []):
            if not queue:
                if asked is None:
                    asked = [d for d in ranked(seed, set(range(len(lengths))) - set(free)) if d in free]
                if not asked:
                    break
                free.remove(asked[0])
                queue = [(asked[0], k) for k in range(lengths[asked[0]])]
                del asked[0]
            sequence.append(queue.pop(0))
        rest = queue
        if len(sequence) == window:
            out.append(sequence)
            sequence = []
    return out + [sequence] * bool(sequence)


def test_fill_is_the_greedy_rule():
    rng = np.random.default_rng(3)
    for n, window in ((1, 16), (30, 16), (60, 64), (60, 37)):
        docs = [rng.integers(0, 30, rng.integers(0, 40)).astype(np.uint16) for _ in range(n)]
        df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=30).astype(float)
        mean = np.mean([len(d) for d in docs])
        lengths = [len(d) + 1 for d in docs]
        got = defaultdict(list)
        for doc, start, size, sequence, offset in packing.fill(lengths, packing.Index(docs, df, n, mean), window):
            assert offset == len(got[sequence])
            got[sequence] += [(doc, start + k) for k in range(size)]

        def ranked(seed, used):
            return packing.Index(docs, df, n, mean).neighbours(seed, np.array([d in used for d in range(n)]))

        assert [got[k] for k in sorted(got)] == plain_fill(lengths, ranked, window)
