"""Word files, annotations and the folder stream, on small fixtures."""

import io
import json
import zipfile

from palimpsest.plans.pipeline import redact_units
from palimpsest.sources.annotations import parse_annotations
from palimpsest.sources.docx import PIXEL, docx_units, rewrite_docx
from palimpsest.streaming.folder import expired, incoming, redact_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def paragraph(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def word_file():
    body = paragraph("Write to ", "ann.lee@corp.org") + paragraph(" ") + f"<w:tbl><w:tr><w:tc>{paragraph('Order 12')}</w:tc><w:tc>{paragraph('bob@corp.org')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}<w:sectPr><w:headerReference w:type='default' r:id='h'/></w:sectPr><w:sectPr/></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{paragraph('Head')}</w:hdr>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Type="http://x/image" Target="media/a.png"/><Relationship Id="h" Type="http://x/header" Target="header1.xml"/></Relationships>')
        z.writestr("word/media/a.png", b"picture")
        z.writestr("word/media/header.png", b"not of the main part")
    return out.getvalue()


def test_docx_units_rewrite_and_images(spark):
    files = spark.createDataFrame([(1, bytearray(word_file())), (2, bytearray(b"no archive"))], "doc_id long, content binary")
    units = docx_units(files)
    want = [(1, 0, "body", "Write to ann.lee@corp.org"), (1, 1, "body/table0[r0,c0]", "Order 12"), (1, 2, "body/table0[r0,c1]", "bob@corp.org"), (1, 3, "section0/header", "Head"), (1, 4, "section1/header", "Head")]
    assert sorted(map(tuple, units.collect())) == want
    done = redact_units(units)
    back = rewrite_docx(files, done.redacted)
    bad = back.where("doc_id = 2").first()
    assert bad.content is None and "BadZipFile" in bad.error
    back = back.where("doc_id = 1")
    row = back.first()
    assert (row.images_found, row.images_blanked) == (1, 1)
    again = {r.unit: r.text for r in docx_units(back.select("doc_id", "content")).collect()}
    assert again == {0: "Write to user1@example.com", 1: "Order 12", 2: "user2@example.com", 3: "Head", 4: "Head"}
    with zipfile.ZipFile(io.BytesIO(row.content)) as z:
        assert z.read("word/media/a.png") == PIXEL and z.read("word/media/header.png") == b"not of the main part"


def test_annotations_bare_and_scoped(spark):
    item = {"text": "a@b.org", "type": "EMAIL"}
    rows = [("bare", json.dumps([item, item])), ("scoped", json.dumps({"scope": {"unit_start": 3, "unit_end": 9}, "entities": [item]}))]
    entities, scope = parse_annotations(spark.createDataFrame(rows, "corpus string, json string"))
    assert sorted(map(tuple, entities.collect())) == [("bare", 0, "a@b.org", "EMAIL"), ("bare", 1, "a@b.org", "EMAIL"), ("scoped", 0, "a@b.org", "EMAIL")]
    assert sorted(map(tuple, scope.collect())) == [("bare", 0, 2**31 - 1), ("scoped", 3, 9)]


def test_stream_rewrites_each_document_once(spark, tmp_path):
    docs = [(1, "Mail ann@corp.org\nand ann@corp.org"), (2, "nothing here"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    query = redact_stream(incoming(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "unit", "redacted")
    assert sorted(map(tuple, got.collect())) == [(1, 0, "Mail user1@example.com"), (1, 1, "and user1@example.com"), (2, 0, "nothing here")]


def test_expired_keeps_fresh_files(spark):
    files = spark.sql("SELECT * FROM VALUES ('old', timestamp'2024-01-01 00:00:00'), ('new', timestamp'2024-01-01 01:30:00') t(path, modificationTime)")
    import datetime

    assert [r.path for r in expired(files, 3600, datetime.datetime(2024, 1, 1, 2)).collect()] == ["old"]
