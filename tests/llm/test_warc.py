"""Archives: exact round trips, pushed predicates, foreign files."""

import base64
import gzip
import hashlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callmetrics.llm import warc as W
from tests.llm.helpers import write_table

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two é</p>"), (3, None, "<p>one</p>"), (4, "http://a/4", None),
    (5, "http://a/5", ""), (6, "http://a/6\r\nX: y", "WARC/1.1\r\n\r\n" * 3), (7, "", "x" * 300_000), (8, "http://a/8", "<p>one</p>"),
    (None, "http://a/9", "<p>none</p>"), (None, "http://a/9", "<p>none</p>"), (12, "u", "dup"), (12, "u", "dup"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def write_pages(folder, pages=PAGES):
    write_table(folder, "pages", dict(zip(("page_id", "url", "html"), map(list, zip(*pages)))) if pages else dict.fromkeys(("page_id", "url", "html"), []),
                [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def expected(pages):
    leader = {}
    for page_id, _, html in pages:
        if page_id is not None:
            leader[html or ""] = max(page_id, leader.get(html or "", page_id))
    rows = []
    for page_id, _, html in pages:
        first = leader.get(html or "")
        refers = first if first is not None and first != page_id else None
        rows.append((page_id, len((html or "").encode()), digest(html), "revisit" if refers is not None else "response", refers))
    return sorted(map(str, rows))


def test_query(spark, tmp_path):
    write_pages(tmp_path)
    got = W.op4_warc_round_trip(spark, str(tmp_path))
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got.collect()) == expected(PAGES)


def test_empty(spark, tmp_path):
    write_pages(tmp_path, [])
    assert W.op4_warc_round_trip(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("warc")
    W.register(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    W.with_revisits(pages).write.format("warc").mode("append").option("file_bytes", 700).option("split_bytes", 300).save(f"{folder}/a")
    return f"{folder}/a"


def test_payloads_and_urls_survive(spark, archive):
    got = spark.read.format("warc").load(archive).where("record_type = 'response'").collect()
    want = {(p, (h or "").encode()) for p, _, h in PAGES if p in (2, 5, 6, 7, 8, 12, None)}
    assert {(r.page_id, bytes(r.payload)) for r in got} == want
    urls = {r.page_id: r.target_uri for r in got}
    assert urls[6] == "http://a/6%0D%0AX: y" and urls[7] == "" and urls[2] == "http://a/2"


def test_archives_are_valid_gzip_and_warc(archive, tmp_path):
    import pathlib

    names = list(pathlib.Path(archive).glob("*.warc.gz"))
    assert len(names) > 3  # rolled by size
    for name in names:
        content = gzip.decompress(name.read_bytes())
        assert content.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


@pytest.mark.parametrize("condition", [
    "record_type = 'revisit'", "page_id in (1, 7)", "refers_to is not null", "page_id is null and record_type = 'response'",
    "page_id > 5", "page_id >= 5 and page_id < 7", f"payload_digest = '{digest('dup')}'", "refers_to = 8 and page_id <= 1", "target_uri = 'u'",
])
def test_pushed_predicates_agree_with_spark(spark, archive, condition):
    all_rows = spark.read.format("warc").load(archive).drop("payload").collect()
    want = spark.createDataFrame(all_rows, "record_type string, page_id long, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to long").where(condition)
    got = spark.read.format("warc").load(archive).drop("payload").where(condition)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_unwanted_payloads_are_never_inflated(archive, monkeypatch):
    from pyspark.sql.datasource import EqualTo
    from pyspark.sql.types import StructType

    reader = W.WarcReader({"path": archive}, StructType().add("page_id", "long").add("payload", "binary"))
    assert list(reader.pushFilters([EqualTo(("page_id",), 2)])) == []
    inflated = []
    upto = W.Inflated.upto
    monkeypatch.setattr(W.Inflated, "upto", lambda self, size: inflated.append(out := upto(self, size)) or out)
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert rows == [(2, "<p>two é</p>".encode())]
    assert max(map(len, inflated)) < 10_000  # of the page with 300,000 bytes only the header's first block


def test_damage_is_noticed(spark, tmp_path):
    folder = tmp_path / "b"
    folder.mkdir()
    entry = W.page_record(1, "u", b"payload", digest("other"), 7, None)
    (folder / "x.warc.gz").write_bytes(W.member(entry))
    W.register(spark)
    assert spark.read.format("warc").load(str(folder)).count() == 1
    with pytest.raises(Exception, match="does not have its digest"):
        spark.read.format("warc").option("verify", "true").load(str(folder)).collect()


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives(spark, tmp_path, packed):
    """Plain records, and gzip members without a length."""
    folder = tmp_path / "c"
    folder.mkdir()
    entries = [W.page_record(n, f"u{n}", b"x" * n * 1000, digest("x" * n * 1000), n * 1000, None) for n in range(5)]
    entries.append(W.record([("WARC-Type", "metadata"), ("Content-Type", "text/plain")], b"a: b"))
    out = io.BytesIO()
    for entry in entries:
        out.write(gzip.compress(entry) if packed else entry)
    (folder / ("y.warc.gz" if packed else "y.warc")).write_bytes(out.getvalue())
    W.register(spark)
    got = spark.read.format("warc").option("verify", "true").load(str(folder))
    assert sorted(str((r.record_type, r.page_id, r.payload_bytes)) for r in got.collect()) == sorted(
        [str(("response", n, n * 1000)) for n in range(5)] + [str(("metadata", None, None))]
    )
    assert [r.page_id for r in got.where(F.col("page_id") == 3).collect()] == [3]
