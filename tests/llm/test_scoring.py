import math
import re
from collections import Counter

import pytest

from tidewright.llm import scoring
from tidewright.llm.scoring import A0, A1, A2


def brute(rows, target):
    toks = [(d, re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for d, t in rows]
    models = []
    for chosen in (lambda d: True, lambda d: d in target):
        uni, bi = Counter(), Counter()
        for d, ws in toks:
            if chosen(d):
                uni.update(ws)
                bi.update(zip(ws, ws[1:]))
        models.append((uni, bi, max(1, sum(uni.values()))))
    v = max(1, len(models[0][0]))
    out = []
    for d, ws in toks:
        if not ws:
            out.append((d, 0, None, None))
            continue
        loss = []
        for uni, bi, n in models:
            s = 0
            for h, w in zip([None, *ws], ws):
                p = A2 * bi[h, w] / uni[h] + A1 * uni[w] / n if h is not None and uni[h] else (A2 + A1) * uni[w] / n
                s -= math.log(p + A0 / v)
            loss.append(s / len(ws))
        out.append((d, len(ws), loss[1], loss[0]))
    return out


def compare(spark, rows, target):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, chunk string, part int")
    ids = spark.createDataFrame([(t,) for t in target], "doc_id bigint")
    got = sorted(((r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in scoring.cross_entropy_difference(docs, ids).collect()), key=lambda r: (r[0] is None, r))
    want = sorted(brute(rows, set(target) - {None}), key=lambda r: (r[0] is None, r))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:], rel=1e-9) if w[2] is not None else g[2:] == (None, None)


def test_against_plain_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    compare(spark, [(r.doc_id, r.text) for r in docs.collect()], [r.doc_id for r in labels.filter("quality = 1").collect()])


def test_edges(spark):
    compare(spark, [(1, None), (2, ""), (3, "a b A b"), (3, "a b A b"), (None, "a c"), (5, "x " * 3000)], [3, 99, None])
    compare(spark, [(1, "a b")], [])
    compare(spark, [], [1])


def test_labels_of_held_out_documents(spark):
    """Fitted on half of the labelled documents, the score ranks the other half: AUC above chance."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality IS NOT NULL").collect()]
    target = spark.createDataFrame([(d,) for d, q in labels if q == 1 and d % 2], "doc_id bigint")
    score = {r.doc_id: r.score for r in scoring.cross_entropy_difference(docs, target).collect()}
    good = [score[d] for d, q in labels if q == 1 and d % 2 == 0 and score.get(d) is not None]
    bad = [score[d] for d, q in labels if q == 0 and d % 2 == 0 and score.get(d) is not None]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    print("AUC", auc)
    assert auc > 0.6
