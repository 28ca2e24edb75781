import hashlib

from tidewright.llm import warc

SCHEMA = "page_id bigint, url string, html string, file string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_files_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>é {i}</p>\r\n\r\nWARC/1.1\r\n" * (i % 5)) for i in range(40)] + [(None, None, None)]
    recs = warc.records(frame(spark, rows), file_records=16)
    warc.write_warc(recs, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r.headers["WARC-Target-URI"] if "WARC-Target-URI" in r.headers else "", r.body.decode()) for r in back) == sorted((u or "", h or "") for _, u, h in rows)
    want = {(r.offset, r.length, r.sha256) for r in warc.manifest(recs).collect()}
    data = {}
    for r in back:
        raw = data.setdefault(r.path, open(r.path.removeprefix("file:"), "rb").read())
        assert (r.offset, r.length, hashlib.sha256(raw[r.offset : r.offset + r.length]).hexdigest()) in want


def test_audit_finds_each_damage(spark):
    rows = [(i, f"u{i}", f"body {i}") for i in range(1500)]
    a = warc.records(frame(spark, rows), file_records=100)
    assert warc.audit(a, a).count() == 0
    damaged = [(i, u, "BODY" + h[4:] if i in (3, 777) else h) for i, u, h in rows if i != 1250] + [(1499, "twice", "x")]
    got = {(r.record_id, r.status) for r in warc.audit(a, warc.records(frame(spark, damaged), file_records=100)).collect()}
    assert {(3, "altered"), (777, "altered"), (1250, "missing")} <= got
    assert {x for x in got if x[1] == "moved"} == {(i, "moved") for i in range(1251, 1300)}
    assert {x[0] for x in got if x[1] in ("extra", "altered")} == {3, 777, 1499}
    empty = warc.records(frame(spark, []))
    assert {r.status for r in warc.audit(a, empty).collect()} == {"missing"} and warc.audit(empty, empty).count() == 0


def test_only_differing_branches_are_read(spark):
    rows = [(i, f"u{i}", "b") for i in range(600)]
    a = warc.manifest(warc.records(frame(spark, rows), file_records=100))
    b = warc.manifest(warc.records(frame(spark, [(i, u, "c" if i == 450 else h) for i, u, h in rows]), file_records=100))
    for x, y in zip(warc.merkle_levels(a, 1), warc.merkle_levels(b, 1)):
        assert warc._differing(x, y).count() == 1


def test_records_without_an_id_are_dealt_by_url(spark):
    rows = [(None, f"u{i}", f"body {i}") for i in range(400)] + [(i, f"v{i}", "x") for i in range(40)]
    a = warc.records(frame(spark, rows), file_records=16)
    assert a.filter("file < 0").select("file").distinct().count() > 300
    b = warc.records(frame(spark, [(d, u, h.upper() if u in ("u7", "v3") else h) for d, u, h in rows if u != "u9"]), file_records=16)
    got = sorted((r.record_id is None, r.status) for r in warc.audit(a, b).collect())
    assert got == [(False, "altered"), (True, "altered"), (True, "missing")]
