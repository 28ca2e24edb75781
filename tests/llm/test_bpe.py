import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import bpe
from tidewright.llm.queries import tokenizer_path

PATH = tokenizer_path()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


LIB, OWN = library(), bpe.WordBPE(PATH)


def same(texts):
    ids, counts = OWN.encode_batch(texts)
    ends = np.cumsum(counts)
    for t, r, e, n in zip(texts, LIB.encode_batch(texts, add_special_tokens=False), ends, counts):
        assert ids[e - n : e].tolist() == r.ids, t
        assert OWN.decode(ids[e - n : e]).decode() == LIB.decode(r.ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    same(texts)


def test_hard_texts():
    rnd = random.Random(1)
    pool = "abc ABC'sStTdé ÉÈ ß Σς İı \x1c\x1d\x85\xa0 ́é²½٣अ好😀\n\t_-#'re'll 1234567ªºµ"
    same(["".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 40))) for _ in range(5000)])
    same(["", "a" * 4000, "ab" * 3000, "<|endoftext|>" * 3, "x<|endoftext|>Y <|startoftext|>", "<|end", "the" * 2000, "J̌ ǰ"])


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    small = bpe.WordBPE(PATH)
    texts = [" ".join(f"word{i % 170} the" for i in range(k, k + 200)) for k in range(0, 3000, 100)]
    for t in texts:
        ids, _ = small.encode_batch([t])
        assert ids.tolist() == LIB.encode(t, add_special_tokens=False).ids


def test_documents(spark):
    schema = "doc_id bigint, text string, ids string, n_tokens int"
    rows = [(1, None), (2, ""), (3, "Hello, World!"), (3, "Hello, World!"), (None, "x " * 70000)]
    got = bpe.encode_digests(spark.createDataFrame([(*r, "x", 1) for r in rows], schema), PATH).collect()
    for r, (d, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), rows):
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (d, len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode_documents(spark.createDataFrame([(3, "Hi there", "x", 1)], schema), PATH).first()
    assert np.frombuffer(full.ids, np.uint32).tolist() == LIB.encode("Hi there", add_special_tokens=False).ids
    assert bpe.encode_digests(spark.createDataFrame([], schema), PATH).count() == 0
