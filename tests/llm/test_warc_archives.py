"""Archives that grow, are replaced, or come from others."""

import gzip

import pytest

from foretide.llm import warc
from foretide.settings import fresh_path

FOREIGN = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:aa-1>\r\nContent-Length: 11\r\n\r\nsoftware: x\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:bb-2>\r\nWARC-Target-URI: http://x/\r\nContent-Type: application/http\r\n"
    b"Content-Length: 46\r\n\r\nHTTP/1.1 200 OK\r\nX-A: b\r\n\r\n<p>hello world</p>\n\r\n\r\n"
)


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def read(spark, path):
    return sorted((r["page_id"], bytes(r["payload"]).decode()) for r in warc.read(spark, path).collect())


def test_append_keeps_and_overwrite_replaces(spark):
    path = fresh_path(spark, "warc")
    warc.write_pages(pages(spark, (1, "u", "one")), path)
    warc.write_pages(pages(spark, (2, "v", "two"), (3, "w", "three")), path)
    assert read(spark, path) == [(1, "one"), (2, "two"), (3, "three")]
    warc.with_revisits(pages(spark, (4, "x", "four"))).write.format("warc").mode("overwrite").save(path)
    assert read(spark, path) == [(4, "four")]
    warc.write_pages(pages(spark).limit(0), path)
    assert read(spark, path) == [(4, "four")]


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_archives_of_others(spark, tmp_path, name):
    data = FOREIGN
    if name.endswith(".gz"):  # a gzip member per record
        cut = FOREIGN.index(b"WARC/1.0", 5)
        data = gzip.compress(FOREIGN[:cut]) + gzip.compress(FOREIGN[cut:])
    (tmp_path / name).write_bytes(data)
    (tmp_path / "notes.txt").write_text("not an archive")
    for path in (str(tmp_path), str(tmp_path / name)):
        rows = {r["record_id"]: r for r in warc.read(spark, f"file://{path}").collect()}
        assert set(rows) == {"<urn:uuid:aa-1>", "<urn:uuid:bb-2>"}
        page = rows["<urn:uuid:bb-2>"]
        assert bytes(page["payload"]) == b"<p>hello world</p>\n"[: len(page["payload"])] and page["page_id"] is None and page["url"] == "http://x/"
        only = warc.read(spark, f"file://{path}").where("record_type = 'warcinfo'").collect()
        assert [bytes(r["payload"]) for r in only] == [b"software: x"]
        assert warc.read(spark, f"file://{path}", payload=False).where("payload is not null").count() == 0
