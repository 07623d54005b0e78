"""WARC archives of captures, written and read with Spark, and their merged index.

A WARC record is text lines, a blank line, the block, and a blank line after it; captures here are
UTF-8, so Spark's text writer can lay the records down, with the closing blank line as its line
separator. Each file is sorted by URL key and time: it is a capture run. Reading parses whole files
by their Content-Length and yields one sorted run of index entries per file. Runs are then dealt out
by ranges of (URL key, time), and each range is merged by a loser tree over its runs: the parts in
order are one history of all captures, ordered by URL key and time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.common import scratch, text_of

END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Captures without a time of their own are so many seconds after this.
FIRST_CAPTURE = 1_700_000_000
#: Records of one archive file at most, so that a file can be read by one task.
RECORDS_A_FILE = 5_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32(hex_digest: Column) -> Column:
    """Base32 of a 160-bit hex digest: eight letters for each ten hex digits."""
    letters = []
    for part in range(4):
        bits = F.conv(F.substring(hex_digest, 10 * part + 1, 10), 16, 10).cast("bigint")
        for k in range(8):
            five = F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int")
            letters.append(F.substring(F.lit(BASE32), five + 1, F.lit(1)))
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, without scheme, www and fragment, lower case."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", ""))
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^www\.", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def with_record_types(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds bytes, sha1 (hex), record_type and refers_to to (id, ..., payload).

    Of the records with equal payloads of at least so many bytes, the one with the greatest id is the
    response and the others revisit it. Rows repeated with that id are responses too.
    """
    sized = captures.withColumn("sha1", F.sha1(F.encode("payload", "UTF-8"))).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    first = sized.groupBy("sha1", "bytes").agg(F.max("id").alias("greatest"))
    again = (F.col("bytes") >= least_bytes) & (F.col("id").isNull() & F.col("greatest").isNotNull() | (F.col("id") < F.col("greatest")))
    return sized.join(first, ["sha1", "bytes"]).select(
        *captures.columns, "bytes", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("greatest")).alias("refers_to"),
    )


def record(id_: Column) -> Column:
    """One WARC record without its closing blank line."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.col("time")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), name(id_),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", ""),
        F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers_to")),
        )).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(END), block,
    )


def write_archives(captures: DataFrame, path: str, least_bytes: int = 0, records_a_file: int = RECORDS_A_FILE) -> None:
    """Write (id, url, time, payload) rows as gzipped WARC files, each sorted by URL key and time."""
    typed = with_record_types(captures, least_bytes)
    rows = typed.withColumn("key", url_key(F.col("url"))).sortWithinPartitions("key", "time", "id")
    (
        rows.select(record(F.col("id")).alias("value")).write
        .option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)
    )


FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


def parse_records(raw: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """(offset, length, header fields in lower case, block) of every record, by Content-Length."""
    at = 0
    while at < len(raw):
        head_end = raw.index(b"\r\n\r\n", at)
        head = {k.lower(): v for k, v in FIELD.findall(raw[at:head_end])}
        start = head_end + 4
        end = start + int(head[b"content-length"])
        yield at, end + 4 - at, head, raw[start:end]
        at = end + 4


def _id_in(field: bytes | None) -> str | None:
    return (field[len(b"<urn:capture:"):-1].decode() or None) if field else None


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One index entry per record of the archives, each file's entries in its own order. Payload and
    digest of a response are taken anew from its block; a revisit states both."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def entries(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                run, unzip = name.as_py(), zlib.decompressobj(31)
                raw = unzip.decompress(content.as_py()) + unzip.flush()
                rows = []
                for no, (at, length, head, block) in enumerate(parse_records(raw)):
                    kind = head[b"warc-type"].decode()
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                    rows.append((
                        run, no, head[b"warc-target-uri"].decode(), head[b"warc-date"].decode(), _id_in(head[b"warc-record-id"]), size, digest,
                        kind, _id_in(head.get(b"warc-refers-to")), at, length,
                    ))
                frame = pd.DataFrame(rows, columns=["run", "no", "url", "date", "id", "bytes", "digest", "record_type", "refers_to", "offset", "length"])
                yield from _batches(frame)

    raw = "run string, no bigint, url string, date string, id string, bytes bigint, digest string, record_type string, refers_to string, offset bigint, length bigint"
    found = files.mapInArrow(entries, raw)
    return found.withColumn("key", url_key(F.col("url")))


def _batches(frame: pd.DataFrame):
    import pyarrow as pa

    kinds = {"no": pa.int64(), "bytes": pa.int64(), "offset": pa.int64(), "length": pa.int64()}
    if len(frame):
        yield pa.RecordBatch.from_arrays([pa.array(frame[c].tolist(), kinds.get(c, pa.string())) for c in frame.columns], names=list(frame.columns))


class LoserTree:
    """Merge of sorted runs. Each inner node holds the run that lost there, node 0 the winner; the
    next entry of the winner's run plays only against the losers on its way up."""

    def __init__(self, runs: Sequence[Sequence]):
        self.runs, self.at = runs, [0] * len(runs)
        self.n = len(runs)
        self.nodes = [-1] * max(1, self.n)
        for run in range(self.n):
            self._play(run, building=True)

    def _before(self, a: int, b: int) -> bool:
        """Does run a's entry come first? Spent runs come last; ties go to the earlier run."""
        if self.at[a] >= len(self.runs[a]) or self.at[b] >= len(self.runs[b]):
            return self.at[a] < len(self.runs[a])
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return (x, a) <= (y, b)

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.n) // 2
        while node:
            other = self.nodes[node]
            if building and other < 0:
                self.nodes[node] = winner
                return
            if self._before(other, winner):
                self.nodes[node], winner = winner, other
            node //= 2
        self.nodes[0] = winner

    def __iter__(self):
        for _ in range(sum(map(len, self.runs))):
            run = self.nodes[0]
            yield run, self.at[run]
            self.at[run] += 1
            self._play(run)


def merge_index(index: DataFrame) -> DataFrame:
    """All index entries in order of (key, date, id): each part sorted, the parts in range order, and
    `position` numbering them within a part. Ranges hold about as many entries each; one URL with
    many captures is cut by date."""
    ranged = index.repartitionByRange("key", "date", "id").sortWithinPartitions("run", "no")

    def merged(frames):
        frames = list(frames)
        rows = pd.concat(frames, ignore_index=True) if frames else []
        if not len(rows):
            return
        order = list(zip(rows["key"], rows["date"], rows["id"].fillna(""), strict=True))
        starts = [0, *(rows.index[rows["run"].ne(rows["run"].shift())][1:]), len(rows)]
        # Files are sorted as text is; a run within them may still fall back where a key ends in
        # the middle of a character's bytes, so each is brought into the order of the merge.
        places = [sorted(range(a, b), key=order.__getitem__) for a, b in zip(starts, starts[1:], strict=False)]
        tree = LoserTree([[order[p] for p in run] for run in places])
        rows = rows.loc[[places[run][k] for run, k in tree]].reset_index(drop=True)
        rows["position"] = range(len(rows))
        yield rows

    kept = index.schema.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", ")
    return ranged.mapInPandas(merged, f"{kept}, position bigint")


def archive_history(
    pages: DataFrame, least_bytes: int = 0, path: str | None = None, records_a_file: int = RECORDS_A_FILE, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Write the pages as WARC files, read them back, and return the merged capture history: id, url,
    key, date, bytes, digest, record_type, refers_to, run (file), offset and length in the
    unpacked file, position.

    Every row becomes a record, repeated rows too. A null payload is empty; a null URL is an empty
    one; a record with a null id is read back without one. Empty payloads equal each other. An
    empty table gives an empty history. Other columns are not read. The id also sets the time.
    """
    spark = pages.sparkSession
    path = path or f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema[id_col].dataType.simpleString()
    captures = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"),
        (FIRST_CAPTURE + F.coalesce(F.col(id_col).cast("bigint"), F.lit(0))).alias("time"), text_of(payload_col).alias("payload"),
    )
    write_archives(captures, path, least_bytes, records_a_file)
    history = merge_index(read_index(spark, path))
    return history.withColumn("id", F.col("id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
