import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators import recognize, resolve
from quillon.sources import docx, files, sinks
from quillon.streaming import masking

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(body, header=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {NS}>{header}</w:hdr>")
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_text_charsets(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("中文".encode())
    (tmp_path / "b.TXT").write_bytes("中文合同".encode("gbk"))
    (tmp_path / "sub" / "c.txt").write_bytes(b"")
    (tmp_path / "d.exe").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: r.text for r in files.read_text(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "中文", "b.TXT": "中文合同"}  # Spark skips files without bytes


def test_docx(spark, tmp_path):
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("one") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('d')}</w:tr></w:tbl><w:p><w:r><w:br w:type=\"page\"/></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>two</w:t></w:r></w:ins></w:p>"
    (tmp_path / "x.docx").write_bytes(package(body, p("head")))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = files.read_docx(spark, str(tmp_path)).orderBy("order_index").collect()
    assert [(r.text.strip(), r.container_type, r.table_index, r.row_index, r.col_index, r.page_no) for r in rows] == [
        ("one", "body", None, None, None, 1), ("a", "table_cell", 0, 0, 0, 1), ("b", "table_cell", 0, 0, 1, 1), ("c", "table_cell", 0, 1, 0, 1), ("d", "table_cell", 0, 1, 1, 1), ("two", "body", None, None, None, 2), ("head", "header", None, None, None, None),
    ]


def test_damaged_packages_are_told(spark, tmp_path):
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "torn.docx").write_bytes(package("<w:p>"))
    (tmp_path / "good.docx").write_bytes(package(p("x")))
    got = {r.path.rpartition("/")[2]: r.reason for r in files.damaged_docx(spark, str(tmp_path)).collect()}
    assert got == {"bad.docx": "BadZipFile", "torn.docx": "ParseError"}


def test_rewritten_package_keeps_its_other_parts():
    content = package(p("甲") + p("张三和李四"), p("head"))
    new, done, failed, text = docx.rewrite_package(content, [(2, 4, "张三", "X")])
    assert (done, failed, text) == (1, [], "甲\nX和李四\nhead")
    with zipfile.ZipFile(io.BytesIO(new)) as a, zipfile.ZipFile(io.BytesIO(content)) as b:
        assert a.namelist() == b.namelist() and a.read("word/header1.xml") == b.read("word/header1.xml")
    assert docx.shares(5, [1, 1, 2]) == [1, 1, 3] and docx.shares(1, [3, 3]) == [1, 0] and docx.shares(0, [2]) == [0]


def test_rules_file(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"patterns": [{"name": "T", "regex": "T[0-9]"}], "keywords": {"product": {"keywords": ["Alpha", " "], "score": 0.95}}}))
    patterns, words = files.read_rules(spark, str(tmp_path / "rules.json"))
    assert patterns[0]["name"] == "T" and words == {"PRODUCT": (["Alpha"], 0.95)}


def test_ocr_and_pages(spark):
    row = spark.range(1).select(files.needs_ocr(F.lit("字" * 100)).alias("a"), files.needs_ocr(F.lit("。" * 100)).alias("b"), files.estimated_pages(F.lit(2000), F.lit(0), F.lit(0)).alias("c"), files.estimated_pages(F.lit(1), F.lit(2), F.lit(3)).alias("d")).first()
    assert tuple(row) == (False, True, 2, 3)


def test_replacing_longest_first(spark):
    assert spark.range(1).select(sinks.replace_longest(F.lit("abc ab a"), [("ab", "a"), ("abc", "ab"), ("a", "Z")])).first()[0] == "ab a Z"


@pytest.mark.parametrize(("lengths", "want"), [([2, 2], ["ab", "cd"]), ([1, 3], ["a", "bcd"]), ([3, 3, 3], ["ab", "c", "d"])])
def test_split_over(spark, lengths, want):
    assert spark.range(1).select(sinks.split_over(F.lit("abcd"), F.array(*map(F.lit, lengths)))).first()[0] == want


def test_stream_masks_like_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a.b@example.com now"), (2, "none")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))

    def mask(batch):
        spans = recognize.recognize(batch, recognize.LATIN_RULES)
        return resolve.rewrite(batch, spans.select("doc_id", "start", "end", F.lit("<X>").alias("replacement")))

    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    masking.masked_stream(stream, mask, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.doc_id: r.masked for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "mail <X> now", 2: "none"}


def test_stream_sessions(spark, tmp_path):
    events = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00", 1.0), (2, 7, "2024-01-01 00:00:10", 2.0), (3, 7, "2024-01-01 00:01:00", 3.0)], "event_id long, user_id long, t string, value double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    got = sorted((r.n_events, r.value) for r in masking.sessions(events).collect())
    assert got == [(1, 3.0), (2, 3.0)]
    events.write.parquet(str(tmp_path / "in"))
    stream = masking.distinct_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 3
