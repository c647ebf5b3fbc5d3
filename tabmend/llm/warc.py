"""WARC archives: write pages as records, and read them back from their segments.

Writing: a payload that occurs again is stored once, in the record of the smallest id, and
others refer to it (revisit).  A payload travels in an HTTP response with chunked transfer
framing.  A record longer than ``segment`` bytes is cut into a first segment and
continuation records.

Reading: files are parsed record by record.  Segments are grouped by the identifier of
their origin, ordered by segment number, and checked against the total length; the whole
block is split into HTTP header and body, and the body's chunk framing is undone.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmend.llm.common import Workspace, full, named, ordered, shipped

shipped(__name__)

SEGMENT = 16_384
CHUNK = 4_096
#: Segments in a file; a file has at most so many times ``segment`` bytes.
FILE_RECORDS = 1_000
MIN_REVISIT = 100
#: Up to so many digests that occur again (some 10 MB) go to every executor.
BROADCAST_ROWS = 100_000
CRLF = "\r\n"


def with_types(pages: DataFrame, id_col: str, html_col: str, url_col: str, least: int = MIN_REVISIT) -> DataFrame:
    """(id, url, payload, digest, first): ``first`` is the id whose payload this one repeats."""
    payload = F.encode(full(named(html_col)), "UTF-8")
    df = pages.select(
        ordered(named(id_col)).alias("key"), full(named(url_col)).alias("url"), payload.alias("payload")
    ).withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    # one row per payload that occurs again; summed up before the shuffle
    first = df.filter(F.col("n") >= least).groupBy(F.col("digest").alias("d_")).agg(
        F.min("key").alias("first"), F.count(F.lit(1)).alias("times")
    )
    first = Workspace(pages.sparkSession).stored(first.filter("times > 1"), "repeated")
    if first.count() <= BROADCAST_ROWS:  # else payloads move to the digests that occur again
        first = F.broadcast(first)
    df = df.join(first, (F.col("digest") == F.col("d_")) & (F.col("n") >= least), "left")
    return df.select("key", "url", "payload", "digest", "n", F.when(F.col("first") != F.col("key"), F.col("first")).alias("first"))


def _lines(*parts) -> Column:
    return F.concat(*[F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in part], F.lit(CRLF)) for part in parts])


def _name(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key["id"].cast("string"), F.lit("none")), F.lit(">"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    html_col: str = "html",
    url_col: str = "url",
    segment: int = SEGMENT,
    chunk: int = CHUNK,
    compression: str = "gzip",
) -> None:
    """Writes one logical record per row below ``path``, in files of bounded size.

    Null pages are empty payloads.  The record of a page is named after its id, which stands in a header of
    its own too; rows without an id, and rows that share one, get a number of their row in the name, so that
    each is a record.  A revisit refers to the page by id and digest; a null id comes after all others."""
    df = with_types(pages, id_col, html_col, url_col)
    ids = df.filter("key.id IS NOT NULL").groupBy(F.col("key").alias("k_")).agg(F.count(F.lit(1)).alias("times"))
    ids = Workspace(pages.sparkSession).stored(ids.filter("times > 1").select("k_"), "shared")
    df = df.join(ids, F.col("key") == F.col("k_"), "left") if not ids.isEmpty() else df.withColumn("k_", F.lit(None))
    number = F.when(F.col("k_").isNotNull() | F.col("key.id").isNull(), F.concat(F.lit(":row"), F.monotonically_increasing_id()))
    df = df.withColumn("row", F.coalesce(number, F.lit(""))).drop("k_")
    count = F.ceil(F.col("n") / chunk).cast("int")
    framed = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.concat(
            F.encode(F.concat(F.lower(F.hex(F.least(F.lit(chunk), F.col("n") - (i - 1) * chunk).cast("long"))), F.lit(CRLF)), "UTF-8"),
            F.substring(F.col("payload"), (i - 1) * chunk + 1, F.lit(chunk)),
            F.encode(F.lit(CRLF), "UTF-8"),
        ),
    )
    body = F.when(F.col("n") > 0, F.array_join(F.transform(framed, lambda b: b.cast("string")), "")).otherwise("")
    head = _lines(("HTTP/1.1 200 OK",), ("Content-Type: text/html; charset=utf-8",), ("Transfer-Encoding: chunked",), ("",))
    # the cast keeps bytes as they are
    block = F.concat(head, body, F.lit("0\r\n\r\n")).cast("binary")
    block = F.when(F.col("first").isNull(), block).otherwise(F.encode(F.lit("HTTP/1.1 200 OK\r\n\r\n"), "UTF-8"))
    df = df.select("key", "row", "url", "digest", "n", "first", block.alias("block")).withColumn("total", F.octet_length("block"))
    pieces = F.greatest(F.ceil(F.col("total") / segment).cast("int"), F.lit(1))
    df = df.withColumn("pieces", pieces).select("*", F.explode(F.sequence(F.lit(1), F.col("pieces"))).alias("seg"))
    part = F.substring(F.col("block"), (F.col("seg") - 1) * segment + 1, F.lit(segment))
    own = F.concat(F.lit("urn:page:"), F.coalesce(F.col("key.id").cast("string"), F.lit("none")), F.col("row"))
    me = F.concat(F.lit("<"), own, F.when(F.col("seg") > 1, F.concat(F.lit("#"), "seg")).otherwise(""), F.lit(">"))
    kind = F.when(F.col("seg") > 1, "continuation").when(F.col("first").isNotNull(), "revisit").otherwise("response")
    cut = F.col("pieces") > 1
    header = F.concat(
        _lines(("WARC/1.1",), ("WARC-Type: ", kind), ("WARC-Record-ID: ", me), ("WARC-Target-URI: ", F.regexp_replace("url", r"[\r\n]", "")),
               ("WARC-Date: 1970-01-01T00:00:00Z",), ("Content-Type: application/http; msgtype=response",)),
        F.when((F.col("seg") == 1) & F.col("key.id").isNotNull(), _lines(("WARC-Page-ID: ", F.col("key.id").cast("string")))).otherwise(""),
        F.when(F.col("seg") == 1, _lines(("WARC-Payload-Digest: sha256:", F.col("digest")))).otherwise(""),
        F.when(F.col("first").isNotNull(), _lines(("WARC-Refers-To: ", _name(F.col("first"))),
               ("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",))).otherwise(""),
        F.when(cut, _lines(("WARC-Segment-Number: ", F.col("seg").cast("string")))).otherwise(""),
        F.when(cut & (F.col("seg") > 1), _lines(("WARC-Segment-Origin-ID: <", own, ">"))).otherwise(""),
        F.when(cut & (F.col("seg") == F.col("pieces")), _lines(("WARC-Segment-Total-Length: ", F.col("total").cast("string")))).otherwise(""),
        _lines(("Content-Length: ", F.octet_length(part).cast("string")), ("",)),
    )
    record = F.concat(header, part.cast("string"))
    df.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


FIELDS = "kind string, id string, page string, uri string, digest string, refers string, seg int, origin string, total long, block binary"


def _records(data: bytes) -> Iterator[tuple]:
    """The records of a file, by their headers and lengths."""
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":  # one member for the file, or one for each record
        out = []
        while data:
            member = zlib.decompressobj(31)
            out.append(member.decompress(data) + member.flush())
            data = member.unused_data.lstrip(b"\0")
        stream = io.BytesIO(b"".join(out))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:60]!r}")
        head: dict[str, str] = {}
        last = ""
        while (line := stream.readline()) and line.strip():
            if line[:1] in b" \t" and last:  # a folded header line
                head[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            head[last] = value.strip()
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {head.get('warc-record-id')} is cut off")
        seg, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
        yield (
            head.get("warc-type"), head.get("warc-record-id"), head.get("warc-page-id"), head.get("warc-target-uri"),
            head.get("warc-payload-digest"), head.get("warc-refers-to"), int(seg) if seg else None,
            head.get("warc-segment-origin-id"), int(total) if total else None, block,
        )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per record as it lies in the files; a file is read by one task."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame(list(_records(data)), columns=names).astype(
                    {"seg": "Int32", "total": "Int64"}
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, FIELDS)


def unchunked(body: bytes) -> bytes | None:
    """The body without chunk framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
        if body[at - 2 : at] != b"\r\n":
            return None


def payload_of(block: bytes) -> bytes | None:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    chunked = any(
        line.lower().startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in head.split(b"\r\n")
    )
    return unchunked(body) if chunked else body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per logical record: id, page (where a header names it), uri, kind, refers, digest, payload, ok.

    ``ok`` is true where all segments are there, the total length is right, the framing can be undone and
    the digest fits; a record that fails any of these has no payload.  Segments that occur
    twice count once.  A revisit has no payload of its own.  Archives without records give
    no rows."""
    rows = read_segments(spark, path).filter(F.col("kind").isin("response", "revisit", "resource", "continuation"))
    origin = F.coalesce("origin", "id")
    rows = rows.withColumns({"origin": origin, "seg": F.coalesce("seg", F.lit(1))})
    # a group is one record: its segments, whose number is bounded by its length
    lead = lambda name: F.max(F.when(F.col("kind") != "continuation", F.col(name))).alias(name)
    whole = rows.groupBy("origin").agg(
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("type"), lead("page"), lead("uri"), lead("digest"), lead("refers"),
        F.max("total").alias("total"), F.max("seg").alias("last"),
        F.array_sort(F.collect_set(F.struct("seg", "block"))).alias("parts"),
    )
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    whole = whole.withColumns({"n": F.size("parts"), "block": block})
    complete = (F.col("n") == F.col("last")) & ((F.col("last") == 1) | (F.col("total") == F.octet_length("block")))

    @F.pandas_udf("struct<payload:binary,digest:string>")
    def decoded(blocks: pd.Series) -> pd.DataFrame:
        bodies = [None if b is None else payload_of(b) for b in blocks]
        return pd.DataFrame(
            {"payload": bodies, "digest": [None if b is None else "sha256:" + hashlib.sha256(b).hexdigest() for b in bodies]}
        )

    own = F.col("type") != "revisit"
    whole = whole.withColumn("complete", F.coalesce(complete, F.lit(False)))
    whole = whole.withColumn("found", decoded(F.when(F.col("complete") & own, F.col("block"))))
    fits = F.col("found.payload").isNotNull() & F.coalesce(F.col("digest") == F.col("found.digest"), F.col("digest").isNull())
    ok = F.col("complete") & F.coalesce(F.when(own, fits).otherwise(F.col("refers").isNotNull()), F.lit(False))
    return whole.select(
        F.col("origin").alias("id"), "page", "uri", F.col("type").alias("kind"), "refers", "digest",
        F.when(ok, F.col("found.payload")).alias("payload"), ok.alias("ok"),
    )


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload's length ``n``, given to revisits too, from what they refer to.

    That is a record's id, or the page of several equal records, and the digest."""
    named_ = F.coalesce(F.concat(F.lit("<urn:page:"), F.col("page"), F.lit(">")), F.col("id"))
    sizes = records.filter(F.col("kind") != "revisit").groupBy(named_.alias("r_"), F.col("digest").alias("d_"))
    sizes = sizes.agg(F.max("n").alias("of_"))
    again = (F.col("refers") == F.col("r_")) & F.col("digest").eqNullSafe(F.col("d_")) & (F.col("kind") == "revisit")
    return records.join(sizes, again, "left").withColumn("n", F.coalesce("n", "of_")).drop("r_", "d_", "of_")
