"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both name the response in WARC-Refers-To; the metadata record keeps the response's own headers, HTTP headers and digests, and
the conversion record the text of the page. Record ids are named by what they derive from, so a retried task writes the
same ones.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import html as dom

VERSION, LINE = "WARC/1.1\r\n", "\r\n"
#: One response record: its WARC headers in order, and its block (HTTP header and payload).
RESPONSE = "warc_headers array<struct<name: string, value: string>>, block string"
RECORD = ("warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
          "content_length long, block_digest string, payload_digest string, source_digest string, block string")
_FIELDS = [x.split(" ")[0] for x in RECORD.split(", ")]


def digest(data: bytes) -> str:
    """A labelled SHA-1 digest in base 32, as WARC files carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(text: str) -> tuple[str, list[tuple[str, str]], str]:
    """First line, fields and body of an HTTP message; a message without an empty line is all header."""
    head, _, body = text.partition("\r\n\r\n")
    lines = head.split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:  # a folded field
            fields[-1] = (fields[-1][0], fields[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return lines[0], fields, body


def _record(kind: str, source: dict[str, str], content_type: str, block: str, source_digest: str, extra: str) -> dict:
    data = block.encode("utf-8", "replace")
    refers = source.get("warc-record-id", "")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} of {refers} {extra}")
    return {"warc_type": kind, "record_id": f"<urn:uuid:{name}>", "refers_to": refers, "target_uri": source.get("warc-target-uri"),
            "warc_date": source.get("warc-date"), "content_type": content_type, "content_length": len(data), "block_digest": digest(data),
            "payload_digest": digest(data) if kind == "conversion" else None, "source_digest": source_digest, "block": block}


def derivatives(headers: list[tuple[str | None, str | None]], block: str) -> list[dict]:
    """The records derived from one response. A payload that is neither HTML nor plain text has no conversion."""
    source = {(k or "").lower(): v or "" for k, v in headers}
    status, fields, payload = _header(block)
    payload_digest = digest(payload.encode("utf-8", "replace"))
    given = source.get("warc-payload-digest")
    http = {k.lower(): v for k, v in fields}
    kind = http.get("content-type", "text/html").split(";")[0].strip().lower()
    lines = [("refers-to", source.get("warc-record-id", "")), ("source-payload-digest", given or payload_digest),
             ("payload-digest-verified", str(given in (None, "", payload_digest)).lower()), ("http-status", status),
             *((f"warc-header-{k}", v or "") for k, v in headers), *((f"http-header-{k}", v) for k, v in fields),
             ("payload-length", str(len(payload.encode("utf-8", "replace"))))]
    out = [_record("metadata", source, "application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines), given or payload_digest, payload_digest)]
    if kind in ("text/html", "application/xhtml+xml", "text/plain"):
        page = dom.parse(payload) if kind != "text/plain" else None
        text = dom.blocks(page, [True] * len(page.parent)) if page else payload
        out.append(_record("conversion", source, "text/plain; charset=utf-8", text, given or payload_digest, payload_digest))
    return out


def derive(headers: Column, block: Column) -> Column:
    """Array of RECORD for a response's WARC headers and block; a null block is empty."""
    kinds = [pa.int64() if f == "content_length" else pa.string() for f in _FIELDS]
    kind = pa.list_(pa.struct(list(zip(_FIELDS, kinds, strict=True))))

    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for heads, blocks in pairs:
            yield pa.array([derivatives([(x["name"], x["value"]) for x in h.as_py() or []], b.as_py() or "")
                            for h, b in zip(heads, blocks, strict=True)], kind)
    types = ", ".join(f"{f}: {'long' if f == 'content_length' else 'string'}" for f in _FIELDS)
    return F.arrow_udf(run, f"array<struct<{types}>>")(headers, block)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """key and the columns of RESPONSE for every page: a 200 answer with the page as payload."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    h = F.md5(F.concat_ws("\x00", F.col(f"`{key}`").cast("string"), F.col(f"`{url}`").cast("string"), body))
    name = F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                     F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    fields = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", name), ("WARC-Target-URI", F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))),
              ("WARC-Date", F.lit(date)), ("Content-Type", F.lit("application/http; msgtype=response")),
              ("Content-Length", F.octet_length(block).cast("string"))]
    return pages.select(F.col(f"`{key}`").alias("key"), F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in fields]).alias("warc_headers"), block.alias("block"))


def derived(source: DataFrame) -> DataFrame:
    """key and the columns of RECORD: the derivatives of every row of ``source`` (key and RESPONSE).

    Empty payloads give an empty conversion; repeated rows give the same records again; null ids stay null; an empty table
    gives no rows. Payloads are converted whole.
    """
    return source.select("key", F.inline(derive(F.col("warc_headers"), F.col("block"))))


def serialised(records: DataFrame) -> Column:
    """One WARC record as text, but for the line break that ends it; lengths are those of its UTF-8 bytes."""
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI",
             "warc_date": "WARC-Date", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length"}
    head = [line(v, F.col(k).cast("string")) for k, v in names.items()]
    return F.concat(F.lit(VERSION), *head, F.lit(LINE), F.col("block"), F.lit(LINE))


def write(records: DataFrame, path: str) -> None:
    """Record files, one per task."""
    records.select(serialised(records).alias("value")).write.option("lineSep", LINE).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """RESPONSE-like rows (all record types) of text WARC files, split between tasks at record starts. ``complete`` tells
    whether the block has the length that its header names."""
    raw = spark.read.option("lineSep", VERSION).text(path).where("value <> ''")
    cut = raw.select(F.split("value", "\r\n\r\n", 2).alias("p")).select(F.col("p")[0].alias("head"), F.regexp_replace(F.coalesce(F.col("p")[1], F.lit("")), r"\r\n\r\n\z", "").alias("block"))
    pair = F.transform(F.filter(F.split("head", "\r\n"), lambda x: F.instr(x, ":") > 0), lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    length = F.regexp_extract("head", r"(?im)^content-length:\s*([0-9]+)", 1)
    return cut.select(pair.alias("warc_headers"), "block", (length == F.octet_length("block").cast("string")).alias("complete"))
