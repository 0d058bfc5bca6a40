"""WARC archives as a chunked record table.

A page is one record, or, beyond a segment's size, a first segment and continuation
records, each a row of its own: record, segment number, a piece of the payload and the
digest of the payload so far. Nothing is ever assembled whole. Archives are written and
read by Spark's own text source, so they may lie in any store that Spark reaches: the
separator of rows on reading is the head that every record of the archive begins with,
which holds a random token and so occurs in no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, discard, materialise, scratch_path

#: Code points of payload in a record; longer payloads take several.
SEGMENT_CHARS = 1 << 16
#: Revisits up to which their list is broadcast.
BROADCAST_REVISITS = 1_000_000
EOL = "\r\n"


def head_for(token: str) -> str:
    return f"WARC/1.1{EOL}WARC-Archive-Token: {token}{EOL}"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def chunks(text: str, size: int):
    for at in range(0, len(text) or 1, size):
        yield text[at : at + size].encode("utf-8", "replace")


def payload_key():
    """What names a payload: a strong digest of its bytes."""
    return F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, strong and first: the rows whose payload a page with a smaller id has, too."""
    known = pages.select("page_id", payload_key().alias("strong"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n")).where(F.col("n") >= least_bytes)
    known = materialise(known.select("page_id", "strong"), "warc-digests")
    firsts = materialise(known.groupBy("strong").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("strong", "first"), "warc-firsts")
    found = materialise(known.join(firsts, "strong").where("page_id > first").select("page_id", "strong", "first").distinct(), "warc-revisits")
    discard(known, firsts)
    return found


def records(page_id, url: str, html: str, first, token: str, segment: int):
    """The texts of a page's records, without the final line end."""
    text = html or ""
    digest, size = hashlib.sha1(), 0
    for piece in chunks(text, segment):
        digest.update(piece)
        size += len(piece)
    whole = base32(digest.digest())
    name = lambda page: f"<urn:page:{'' if page is None else page}:{whole}>"
    answer = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: {size}{EOL}{EOL}"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    common = [f"WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{whole}"]

    def record(kind: str, own: list[str], block: str) -> str:
        n = len(block.encode("utf-8", "replace"))
        return head_for(token) + EOL.join([f"WARC-Type: {kind}", *own, *common, f"Content-Length: {n}", "", block]) + EOL

    if first is not None:
        yield record("revisit", [
            f"WARC-Record-ID: {name(page_id)}", f"WARC-Refers-To: {name(first)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Type: application/http;msgtype=response"], answer)
        return
    several, running, at = len(text) > segment, hashlib.sha1(), 0
    for number, start in enumerate(range(0, len(text) or 1, segment), 1):
        piece = text[start : start + segment]
        raw = piece.encode("utf-8", "replace")
        running.update(raw)
        at += len(raw)
        own = [f"WARC-Record-ID: {name(page_id)}" if number == 1 else f"WARC-Record-ID: <urn:page-part:{uuid.uuid4()}>"]
        if several:
            own += [f"WARC-Segment-Number: {number}", f"WARC-Running-Digest: sha1:{base32(running.copy().digest())}"]
            own += [f"WARC-Segment-Origin-ID: {name(page_id)}"] * (number > 1)
            own += [f"WARC-Segment-Total-Length: {len(answer) + at}"] * (number > 1 and at == size)
        own += ["Content-Type: application/http;msgtype=response"]
        yield record("response" if number == 1 else "continuation", own, answer * (number == 1) + piece)


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT_CHARS, compression: str = "none") -> str:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path``; returns the archive's token."""
    token = uuid.uuid4().hex
    written = revisits(pages, least_bytes)
    known = F.broadcast(written) if written.count() <= BROADCAST_REVISITS else written
    rows = pages.select("page_id", "html", "url", payload_key().alias("strong")).join(known, ["page_id", "strong"], "left").select("page_id", "html", "url", "first")

    def run(batches):
        for part in blocks(batches):
            out, held = [], 0
            for page_id, html, url, first in zip(*(c.to_pylist() for c in part.columns)):
                for text in records(page_id, url, html, first, token, segment):
                    out.append(text)
                    held += len(text)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", EOL).option("compression", compression).text(path)
    discard(written)
    return token


def chunk_table(spark: SparkSession, path: str, token: str) -> DataFrame:
    """One row per record: record (that of the first segment), segment (0 if there is one only), type, page,
    refers_to, digest, payload_bytes (as the answer's head says; of first segments), running, size and data.

    ``data`` is filled for payloads in several segments; others are verified on the spot.
    """

    def run(batches):
        for part in blocks(batches, 0):
            out = {k: [] for k in ("record", "segment", "type", "page", "refers_to", "digest", "payload_bytes", "running", "data")}
            for raw in part.column(0).to_pylist():
                if not raw:
                    continue  # before an archive's first record
                head, _, rest = raw.partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split(EOL))
                n = int(fields["Content-Length"])
                block, kind = rest[:n], fields["WARC-Type"]
                if len(block) != n:
                    raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
                size = None
                if kind != "continuation":
                    answer, _, block = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", answer)[1])
                segment = int(fields.get("WARC-Segment-Number", 0))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and not segment and base32(hashlib.sha1(block).digest()) != digest:
                    raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                record = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
                page = record.removeprefix("<urn:page:").rpartition(":")[0]
                refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").rpartition(":")[0]
                for k, x in zip(out, (record, segment, kind, page or None, refers or None, digest, size,
                                      fields.get("WARC-Running-Digest", "sha1:").removeprefix("sha1:"), block if segment else None)):
                    out[k].append(x)
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    lines = spark.read.option("lineSep", head_for(token)).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(run, "record string, segment int, type string, page string, refers_to string, digest string, payload_bytes long, running string, data binary")


def read_archive(spark: SparkSession, path: str, token: str) -> DataFrame:
    """One row per page record: page, payload_bytes, payload_digest, record_type, refers_to.

    Payloads in several segments are hashed segment by segment, in order, in one task a
    record; each segment's running digest is checked, and no payload is put together.
    """
    table = chunk_table(spark, path, token)

    def run(batches):
        now, digest, size, times, first = None, None, 0, 0, None

        def finished():
            if now is None:
                return []
            if base32(digest.digest()) != first["digest"] or size != first["payload_bytes"]:
                raise ValueError(f"record {now} lacks a segment")
            return [(first["page"], size, first["digest"], "response", None)] * times

        for part in blocks(batches, 8):
            out = []
            for row in part.to_pylist():
                if not row["segment"]:
                    out.append((row["page"], row["payload_bytes"], row["digest"], row["type"], row["refers_to"]))
                    continue
                if row["record"] != now:
                    out += finished()
                    now, digest, size, times, first, last = row["record"], hashlib.sha1(), 0, 0, row, 0
                times += row["segment"] == 1  # the same page twice: its segments come twice
                if row["segment"] == last:
                    continue
                last = row["segment"]
                digest.update(row["data"])
                size += len(row["data"])
                if base32(digest.copy().digest()) != row["running"]:
                    raise ValueError(f"segment {last} of record {now} is damaged")
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in out] for i, k in enumerate(schema.names)}, schema=schema)
        out = finished()
        yield pa.RecordBatch.from_pydict({k: [r[i] for r in out] for i, k in enumerate(schema.names)}, schema=schema)

    schema = pa.schema([("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
    ordered = table.repartition("record").sortWithinPartitions("record", "segment")
    return ordered.mapInArrow(run, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def warc(pages: DataFrame, least_bytes: int = 0, segment: int = SEGMENT_CHARS, path: str | None = None) -> DataFrame:
    """Write the archives, then one row per page from reading them: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of ``least_bytes`` or more the smallest page_id holds the response;
    the others revisit it. Null html is an empty payload; each row is a record of its own,
    repeated ones and those that share a page_id with another payload too; rows without a
    page_id are responses without one; a null url is about:blank; an empty table gives no
    rows; further columns are ignored.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    token = write_archive(pages, path, least_bytes, segment)
    kind = pages.schema["page_id"].dataType
    return read_archive(pages.sparkSession, path, token).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {shift}) & 31)::INT + 1, 1)"
ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), part AS (
  SELECT page_id, i, ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT AS v FROM p, range(8) AS t(i)
), code AS (
  SELECT page_id, string_agg({' || '.join(_DIGIT.format(shift=s) for s in (15, 10, 5, 0))}, '' ORDER BY i) AS payload_digest FROM part GROUP BY page_id
), f AS (SELECT page_id, strlen(body) AS payload_bytes, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f JOIN code USING (page_id)
"""
