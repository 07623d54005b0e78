import base64
import gzip
import hashlib
import random

from planloom.llm.warc import LoserTree, archive_history, parse_records


def brute(pages, least=0):
    last = {}
    for p, _, html in pages:
        if p is not None:
            last[html or ""] = max(last.get(html or "", p), p)
    out = []
    for p, _, html in pages:
        raw = (html or "").encode()
        top = last.get(html or "")
        again = len(raw) >= least and top is not None and (p is None or p < top)
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    return out


def key(row):
    return tuple("" if x is None else str(x) for x in row)


def digest(frame):
    return sorted([(r.id, r.bytes, r.digest, r.record_type, r.refers_to) for r in frame.collect()], key=key)


def pages():
    rnd = random.Random(6)
    bodies = ["", None, "é日🙂", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello", "a\r\n\r\n", "\n", "x" * 70_000]
    urls = [None, "", "http://www.B.com/x?y#z", "https://a.b.org/é/1", "http://b.com", "ftp://q\r\nX: y"]
    rows = [(k, rnd.choice(urls), rnd.choice(bodies)) for k in range(120)]
    return rows + [(200, "u", "same")] * 2 + [(199, "u", "same"), (None, "u", "same"), (None, None, "alone")]


def test_round_trip(spark):
    frame = spark.createDataFrame([(*p, 3, "k") for p in pages()], "page_id bigint, url string, html string, bytes int, key string")
    for least in (0, 5):
        assert digest(archive_history(frame, least)) == sorted(brute(pages(), least), key=key)
    assert archive_history(frame.limit(0)).count() == 0


def test_history_is_ordered_and_offsets_point_at_records(spark, tmp_path):
    frame = spark.createDataFrame(pages(), "page_id bigint, url string, html string").repartition(5)
    rows = archive_history(frame, path=str(tmp_path / "warc"), records_a_file=40).collect()
    order = [(r.key, r.date, str(r.id if r.id is not None else "")) for r in rows]
    assert order == sorted(order) and len({r.run for r in rows}) > 1
    for r in rows:
        raw = gzip.decompress(open(r.run.removeprefix("file:"), "rb").read())
        (_, _, head, _), = parse_records(raw[r.offset:r.offset + r.length])
        assert head[b"warc-record-id"].decode() == f"<urn:capture:{'' if r.id is None else r.id}>"


def test_loser_tree():
    rnd = random.Random(1)
    for n in range(0, 9):
        runs = [sorted(rnd.randint(0, 30) for _ in range(rnd.randint(0, 12))) for _ in range(n)]
        assert [runs[r][k] for r, k in LoserTree(runs)] == sorted(x for run in runs for x in run)


def test_whole_table(spark, small_folder):
    from planloom.llm.queries import QUERIES

    given = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small_folder}/pages.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op5_warc"](spark, small_folder).collect()), key=key)
    assert got == sorted(brute(given), key=key)
