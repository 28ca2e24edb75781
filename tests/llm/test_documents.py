"""Exact dedup, sharding and quality against plain versions, with their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from tidewright.llm import exact_dedup, quality, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, part int, size int, norm string"
ROWS = [(0, None), (1, ""), (2, "Abc É"), (3, "aBC É"), (4, "abc é"), (5, "x" * 200000), (6, "X" * 200000), (7, "x" * 199999), (None, "abc É"), (8, "only"), (8, "only"), (9, "same start " * 3 + "a"), (10, "same start " * 3 + "b")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else None, "s", 0, "x", 1, 2, "n") for d, t in rows], SCHEMA).repartition(3)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_duplicates(spark):
    for stays, pick in (("max", max), ("min", min)):
        got = exact_dedup.exact_duplicates(frame(spark, ROWS), stays=stays).collect()
        groups = defaultdict(list)
        for d, t in ROWS:
            groups[lower(t)].append(d)
        assert len(got) == len(ROWS)
        for t, ids in groups.items():
            sha = hashlib.sha256(t.encode()).hexdigest()
            rows = [r for r in got if r.text_sha256 == sha]
            best = pick(i for i in ids if i is not None)
            assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
            assert all(r.keep_id == best and r.group_size == len(ids) for r in rows)
            assert [r.doc_id for r in rows if r.kept] == [best]
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_one_group_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [(i, "copy" if i % 3 else f"text {i}") for i in range(2000)]
        got = exact_dedup.exact_duplicates(frame(spark, rows), stays="max").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    copies = [r for r in got if r.group_size > 1]
    assert len(copies) == 1333 and {r.keep_id for r in copies} == {1999} and sum(r.kept for r in copies) == 1
    assert sum(r.kept for r in got) == 668


def test_drop_duplicates_keeps_columns(spark):
    out = exact_dedup.drop_duplicates(frame(spark, ROWS))
    assert out.columns == frame(spark, ROWS).columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 4, 5, 7, 8, 9, 10]


def test_shards(spark):
    rows = [(i * 7 % 501, "é" * (i % 40)) for i in range(500)] + [(1000, None), (1001, "z" * 5000)]
    for shards in (1, 4, 16):
        got = sharding.prefix_shards(frame(spark, rows), shards).collect()
        assert len(got) == len(rows)
        by = defaultdict(list)
        for r in got:
            t = dict(rows)[r.doc_id] or ""
            assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
            by[r.shard].append(r)
        total = sum(r.size for r in got)
        order = []
        for s in sorted(by):
            assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
            assert abs(sum(r.size for r in by[s]) - total / shards) <= 5001
            order += [r.doc_id for r in sorted(by[s], key=lambda r: r.slot)]
        assert order == sorted(order)
    assert sharding.prefix_shards(frame(spark, []), 4).count() == 0
    twice = sharding.prefix_shards(frame(spark, [(1, "a"), (1, "a"), (None, "b")]), 2).collect()
    assert len(twice) == 3 and sorted((r.start) for r in twice) == [0, 2, 4]


def counts(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(tri)
    hit = {j for i, x in enumerate(tri) if n[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_counts_and_verdicts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate([None, "", "a b", "a b c a b c", "a\x0bb\x0c# <\n\n \nx\nx\r\nx", "日本 é " * 60, "w " * 9000, "a a a a"])]
    got = quality.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = counts(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.judge(frame(spark, [])).count() == 0


def test_an_outlier_of_its_group_goes_and_clean_ones_stay(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(80))) for i in range(40)] + [(99, " ".join(f"#$%&{k}" for k in range(80)))]
    kept = {r.doc_id for r in quality.filter_quality(spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id bigint, text string, lang string, source string")).collect()}
    assert kept == set(range(40))


def plain(i, n=80):
    return [f"w{i:02d}x{k:02d}" for k in range(n)]


def test_each_rate_has_a_fence_that_decides(spark):
    """In a group of clean documents an outlier by any one rate goes, though the base rules let it pass."""
    def lines(ws):
        return "\n".join(" ".join(ws[k : k + 8]) for k in range(0, len(ws), 8))

    base = [(i, lines(plain(i))) for i in range(60)]
    odd = {
        "symbol_rate": lines([w + "#" * (k % 5 == 0) for k, w in enumerate(plain(70))]),
        "dup_line_rate": lines(plain(71)) + "\n" + "\n".join([" ".join(plain(71)[:8])] * 8),
        "repeat_rate": " ".join(plain(72) + plain(72)[:20]),
        "word_length": lines([w * 2 for w in plain(73)]),
        "short words": lines([w[4:] for w in plain(74)]),
    }
    rows = base + [(100 + i, t) for i, t in enumerate(odd.values())]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[d].kept for d, _ in base)
    for i, name in enumerate(odd):
        r = got[100 + i]
        assert not r.base_failed and not r.kept, name
        over = {"symbol_rate": 1000 * r.n_symbols // r.n_words > r.max_symbol_rate, "dup_line_rate": 1000 * r.n_dup_lines // r.n_lines > r.max_dup_line_rate, "repeat_rate": 1000 * r.n_repeat_words // r.n_words > r.max_repeat_rate, "word_length": 1000 * r.word_chars // r.n_words > r.max_word_length, "short words": 1000 * r.word_chars // r.n_words < r.min_word_length}
        assert over[name], name
        if name not in ("dup_line_rate",):  # repeated lines are repeated words too
            assert [k for k, v in over.items() if v] == [name]


def test_the_same_document_in_two_groups(spark):
    """What is an outlier among prose is not one where all documents are like that."""
    code = [" ".join(f"{w}{{{k}}}&" if k % 2 else w + "$" for k, w in enumerate(plain(i))) for i in range(40)]
    rows = [(i, " ".join(plain(i)), "prose") for i in range(40)] + [(100 + i, t, "code") for i, t in enumerate(code)] + [(200, code[0], "prose")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame([(d, t, "en", s) for d, t, s in rows], "doc_id bigint, text string, lang string, source string")).collect()}
    assert got[100] and not got[200] and sum(got.values()) == 80


def test_many_groups_take_the_salted_way(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {(r.doc_id, r.kept) for r in quality.judge(frame(spark, rows)).collect()}
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert {(r.doc_id, r.kept) for r in quality.judge(frame(spark, rows)).collect()} == want


def test_sketches_merge(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    c = quality.word_counts(frame(spark, rows))
    parts = quality.sketch(c.filter("doc_id < 100")).unionByName(quality.sketch(c.filter("doc_id >= 100")))
    merged = parts.groupBy("lang", "source", "rate", "cell").sum("n")
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in quality.sketch(c).collect()}


def test_given_sql_agrees(spark):
    """The SQL of the queries, on the smallest tables."""
    import duckdb

    from tidewright.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, folder)
        cols = sorted(df.columns)
        want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql})").fetchall()
        assert sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in cols]).collect()))) == sorted(map(repr, want)), name
