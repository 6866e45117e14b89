"""The data source: files by loader, writes that are seen whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from siftspark.sources import datasource


def test_files_by_loader(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\n\ntext\r\nmore")
    (tmp_path / "sub" / "b.docx").write_bytes(b"PK\x03\x04")
    (tmp_path / "c.exe").write_bytes(b"MZ")
    (tmp_path / "_hidden.md").write_text("no")
    for n in range(5):
        (tmp_path / f"x{n}.MARKDOWN").write_text(f"number {n}")
    df = spark.read.format("siftspark").option("files", 2).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4
    got = {(os.path.basename(r.path), r.pos): (r.type, r.content, r.heading_level) for r in df.collect()}
    assert got[("a.md", 0)] == ("markdown", "T", 1) and got[("a.md", 1)] == ("markdown", "text\nmore", None)
    assert got[("b.docx", 0)][:2] == ("error", "DOCX_UNREADABLE") and got[("c.exe", 0)][:2] == ("error", "UNSUPPORTED_MEDIA_TYPE")
    assert len(got) == 9 and got[("x3.MARKDOWN", 0)][1] == "number 3"


def rows(spark, root):
    return sorted((r.document_id, r.body) for r in spark.read.format("siftspark").option("kind", "artefacts").load(root).collect())


def test_writes_are_whole_or_not_there(spark, tmp_path):
    datasource.register(spark)
    root = str(tmp_path / "out")
    docs = spark.range(10).select(F.concat(F.lit("d"), "id").alias("document_id"), F.concat(F.lit("é\n"), "id").alias("body")).repartition(3)
    assert rows(spark, root) == []
    docs.write.format("siftspark").mode("append").save(root)
    want = sorted((f"d{k}", f"é\n{k}") for k in range(10))
    assert rows(spark, root) == want
    fails = docs.withColumn("body", F.when(F.col("document_id") == "d7", F.raise_error(F.lit("broken"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="broken"):
        fails.write.format("siftspark").mode("append").save(root)
    assert rows(spark, root) == want and not os.listdir(os.path.join(root, "_building")) and len(os.listdir(os.path.join(root, "versions"))) == 1
    spark.createDataFrame([("n", None)], "document_id string, body string").write.format("siftspark").mode("append").save(root)
    assert rows(spark, root) == sorted([*want, ("n", "")])
    docs.limit(0).write.format("siftspark").mode("overwrite").save(root)
    assert rows(spark, root) == []
    with pytest.raises(Exception, match="body"):
        docs.drop("body").write.format("siftspark").mode("append").save(root)


def test_a_damaged_file_is_put_aside(tmp_path):
    from pyspark.sql import Row

    w = datasource._Writer(str(tmp_path), False)
    good, bad = w.write(iter([Row(document_id="a", body="x")])), w.write(iter([Row(document_id="b", body="y")]))
    with open(tmp_path / "_building" / w.id / bad.name, "ab") as f:
        f.write(b"!")
    with pytest.raises(OSError, match="damaged"):
        w.commit([good, None, bad])
    assert os.listdir(tmp_path / "quarantine") == [w.id] and not os.path.exists(tmp_path / "pointer")
