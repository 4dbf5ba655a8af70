"""The data sources against plain reading."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recallweave.operators import records
from recallweave.sources import readers


@pytest.fixture(autouse=True)
def registered(spark):
    readers.register(spark)


def test_walk(spark, tmp_path):
    kept = {"a.md": "A", "deep/b.md": "ü", "deep/er/c.txt": "", "d/e/f/g/h.md": "H"}
    gone = {".hidden/x.md": "no", "deep/.x.md": "no", "node_modules/x.md": "no", "deep/er/node_modules/x.md": "no", "1/2/3/4/5/far.md": "no"}
    for name, body in (kept | gone).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body, encoding="utf-8")
    (tmp_path / "deep" / "bad.txt").write_bytes(b"ok\xff")
    for folders, files in ((1, 1), (2, 2), (64, 1000)):
        for root in (str(tmp_path), tmp_path.as_uri()):
            df = spark.read.format("folder_walk").option("depth", 5).option("folders", folders).option("files", files).load(root)
            got = {r.path[len(str(tmp_path)) + 1 :]: (r.text, r.size, r.valid) for r in df.collect()}
            want = {k: (v, len(v.encode()), True) for k, v in kept.items()} | {"deep/bad.txt": (None, 3, False)}
            assert got == want
    assert df.rdd.getNumPartitions() == 1
    with pytest.raises(PySparkException, match="no UTF-8"):
        spark.read.format("folder_walk").option("mode", "failfast").load(str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("folder_walk").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(PySparkException):
        spark.read.format("folder_walk").load(str(tmp_path / "missing")).collect()


@pytest.mark.parametrize("split", [1, 2, 3, 5, 7, 64, 1 << 20])
@pytest.mark.parametrize("body", ["", "a", "␟", "␟␟", "a␟b", "a␟b␟", "␟a␟␟long record of words␟ü␟x" * 3])
def test_records_by_ranges(tmp_path, split, body):
    (tmp_path / "r").write_bytes(body.encode())
    reader = readers.RecordsReader({"path": str(tmp_path / "r"), "separator": "␟", "split_bytes": str(split)})
    got = [(row["position"], row["record"]) for p in reader.partitions() for b in reader.read(p) for row in b.to_pylist()]
    want, at = [], 0
    for piece in body.encode().split("␟".encode()):
        want.append((at, piece.decode()))
        at += len(piece) + 3
    if want[-1][1] == "":
        want.pop()
    assert got == want


def test_mailbox(spark, tmp_path):
    mail = lambda n, body="b": "␞".join([str(n), "s", "x@y", "0", "INBOX", "acc", body])
    (tmp_path / "m1").write_bytes("␟".join([mail(1), "too␞few", mail(2, "line\nline")]).encode())
    (tmp_path / "m2").write_bytes(mail(3).encode() + "␟".encode() + b"bad\xff\xe2\x90" + "␟".encode())
    df = spark.read.format("separated_records").option("separator", "␟").option("split_bytes", 16).load(str(tmp_path))
    assert df.where("not valid").select("record").collect() == [(None,)]
    got = records.mail_records(df.where("valid"), "record")
    assert sorted((r.message_id, r.body) for r in got.collect()) == [("1", "b"), ("2", "line\nline"), ("3", "b")]


def test_record_stream_takes_what_is_new(spark, tmp_path):
    box, out, checkpoint = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "cp")
    box.mkdir()

    def append(name, text):
        with open(box / name, "ab") as f:
            f.write(text.encode())

    def run():
        rows = spark.readStream.format("separated_records").option("separator", "␟").option("split_bytes", 4).load(str(box))
        q = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(once=True).start(out)
        assert q.awaitTermination(120)
        return sorted(r.record for r in spark.read.schema(readers.RECORDS).parquet(out).select("record").collect())

    append("a", "one␟two␟thr")
    assert run() == ["one", "two"]  # the third is being written
    append("a", "ee␟")
    append("b", "four␟")
    assert run() == ["four", "one", "three", "two"]  # a restart goes on from its offsets
    assert run() == ["four", "one", "three", "two"]
    assert spark.read.format("separated_records").option("separator", "␟").load(str(box)).where(F.col("valid")).count() == 4
