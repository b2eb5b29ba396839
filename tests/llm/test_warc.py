import base64
import gzip
import hashlib

from pulsegrid.llm import storage, warc


def test_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(9001, "u", "same"), (9003, None, "same"), (9002, "u\nv", "same"), (9002, "u", "same"), (9010, "e", None), (9011, "e", ""), (None, "n", "same"), (None, None, "only")], pages.schema)
    pages = pages.union(extra).repartition(3).cache()
    rows = pages.collect()
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in rows:
        body = (r.html or "").encode()
        owner = first.get(r.html or "")
        again = owner is not None and owner != r.page_id
        want.append((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", owner if again else None))
    path = storage.new_path(spark, "warc")
    got = [tuple(r) for r in warc.digest(pages, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = warc.read(spark, path)
    held = {r.page_id: bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()}
    assert all(held[r.page_id] == (r.html or "") for r in rows if r.page_id in held and r.page_id is not None)
    one = back.where("record_type = 'revisit' and refers_to = 9001").select("page_id")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert sorted(str(r.page_id) for r in one.collect()) == ["9002", "9002", "9003", "None"], plan
    assert back.where("page_id in (9010, 9011)").count() == 2
    assert warc.read(spark, path, payloads=False).where("payload is not null").count() == 0


def test_short_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.to_records(pages, 3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_gzip_members_and_skipping(spark, tmp_path):
    rows = [{"record_type": "response", "page_id": k, "target_uri": "t", "payload": b"p" * k, "payload_bytes": k, "payload_digest": warc.sha1_base32(b"p" * k), "refers_to": None} for k in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(r)) for r in rows))
    got = warc.read(spark, f"file://{tmp_path}").orderBy("page_id").collect()
    assert [bytes(r.payload) for r in got] == [b"p" * k for k in range(5)]

    class Counted:
        def __init__(self, data):
            import io

            self.inner, self.taken = io.BytesIO(data), 0

        def readline(self):
            return self.inner.readline()

        def read(self, n):
            self.taken += n
            return self.inner.read(n)

        def seek(self, *a):
            return self.inner.seek(*a)

    stream = Counted(b"".join(warc.record(r) for r in rows))
    assert [r["page_id"] for r in warc.records(stream, lambda r: r["page_id"] == 3, True)] == [3]
    assert 0 < stream.taken < 200


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.digest(pages, storage.new_path(spark, "warc")).count() == 0


def test_a_second_append_keeps_the_first(spark, tmp_path):
    where = f"file://{tmp_path}/twice"
    for k in (1, 2):
        pages = spark.createDataFrame([(k, "http://x/", f"<p>{k}</p>")], "page_id long, url string, html string")
        warc.write(pages, where)
    assert sorted(r.page_id for r in warc.read(spark, where).select("page_id").collect()) == [1, 2]
