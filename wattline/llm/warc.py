"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response yields two records that refer to it (``WARC-Refers-To``): a
``metadata`` record whose JSON block keeps the source record's headers, digests,
title and links, and a ``conversion`` record with the page's text.  Record ids
are name-based UUIDs of the source (of a page: its id, url and payload digest), so
reruns agree and different pages differ; digests are SHA-1 in base 32 over whole
payloads and blocks.  ``read_warc``, ``derivatives_of`` and ``write_warc`` go from
files to files; ``derivatives`` starts from a table of pages.

Pages are read in linear time whatever is left unclosed in them: every search for
an end remembers where the next one is.  Everything is per record: no shuffle, and
memory follows the largest record (``read_warc``: the largest file).

Defined cases: a null payload is an empty one; a null url leaves out
WARC-Target-URI and hosts no links; null ids are told apart by url and payload;
repeated rows give equal records; comments and scripts without an end are text;
bytes that don't fit the declared charset (UTF-8 unless HTTP names a known one) are
replaced; a record that its file cuts off is kept and marked ``WARC-Truncated``;
other columns are not looked at; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import bound_batches, table

VERSION = "WARC/1.0"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
BLOCK_TAGS = "address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title".split()

_SKIPPED = re.compile(r"(?i)<(?:(!--)|(!doctype)|(script|style|noscript|template)\b)")
_BREAK = re.compile(r"(?i)</?(?:%s)\b[^>]*>" % "|".join(BLOCK_TAGS))
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_TITLE = re.compile(r"(?i)<title")
_TITLE_END = re.compile(r"(?i)</title>")
_LINK = re.compile(r"(?i)<(a|link|img|iframe)\b")
_TARGET = re.compile(r"""(?i)\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_HTML = re.compile(r"(?i)<html")
_LANG = re.compile(r"""(?i)\blang(?=\s*=\s*["']?([\w-]+))""")
_CHARSET = re.compile(r"""(?i)charset\s*=\s*["']?([\w.:-]+)""")


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


class Next:
    """Where something occurs next in a page, for places that only grow: the page is searched once."""

    def __init__(self, page: str, what: str | re.Pattern):
        self.page, self.what = page, re.compile(re.escape(what)) if isinstance(what, str) else what
        self.match = self.what.search(page)

    def after(self, place: int) -> re.Match | None:
        """The first match that begins at ``place`` or later."""
        if self.match is not None and self.match.start() < place:
            self.match = self.what.search(self.page, place)
        return self.match


def visible(page: str) -> str:
    """The page without comments, scripts, styles and doctype."""
    ends: dict[str, Next] = {}

    def end(name: str, what: str, place: int) -> int | None:
        if name not in ends:
            ends[name] = Next(page, re.compile(what))
        found = ends[name].after(place)
        return None if found is None else found.end()

    out, done = [], 0
    for m in _SKIPPED.finditer(page):
        if m.start() < done:
            continue
        if m[1]:
            to = end("comment", "-->", m.end())
        else:
            to = end("tag", ">", m.end())
            if m[3] and to is not None:
                to = end(m[3].lower(), rf"(?i)</{m[3]}\s*>", to)
        if to is not None:
            out += [page[done : m.start()], " "]
            done = to
    return "".join([*out, page[done:]])


def page_text(bare: str) -> str:
    """Text of a ``visible`` page: blocks on lines of their own, runs of white space as one space, entities resolved."""
    flat = " ".join(bare.split())
    last = flat.rfind(">") + 1  # no tag ends after it
    flat = _TAG.sub("", _BREAK.sub("\n", flat[:last])) + flat[last:]
    lines = (" ".join(x.split()) for x in html.unescape(flat).split("\n"))
    return "\n".join(x for x in lines if x)


def page_title(bare: str) -> str | None:
    begin = _TITLE.search(bare)
    head = bare.find(">", begin.end()) if begin else -1
    end = _TITLE_END.search(bare, head + 1) if head >= 0 else None
    return html.unescape(re.sub(r"\s+", " ", bare[head + 1 : end.start()]).strip()) if end else None


def page_lang(bare: str) -> str | None:
    """The last ``lang`` of the first <html> tag that has one."""
    done = 0
    for m in _HTML.finditer(bare):
        if m.start() >= done:
            done = bare.find(">", m.end())
            done = len(bare) if done < 0 else done
            found = [x[1] for x in _LANG.finditer(bare, m.end(), done)]
            if found:
                return found[-1]
    return None


def page_links(bare: str) -> Iterator[tuple[str, str]]:
    """(tag, target as written) of links, each tag's first one."""
    close, target, done = Next(bare, ">"), Next(bare, _TARGET), 0
    for m in _LINK.finditer(bare):
        if m.start() < done:
            continue
        found, end = target.after(m.end()), close.after(m.end())
        if found is not None and (end is None or found.start() < end.start()):
            yield m[1], found[1] or found[2] or found[3] or ""
            done = found.end()


def page_facts(bare: str, url: str | None) -> dict:
    """Title, language and links of a ``visible`` page as metadata records hold them."""
    links = []
    for tag, target in page_links(bare):
        target = html.unescape(target).strip()
        try:
            target = urljoin(url or "", target)
        except ValueError:
            pass
        links.append({"path": f"{tag.upper()}@/{'src' if tag.lower() in ('img', 'iframe') else 'href'}", "url": target})
    return {"title": page_title(bare), "lang": page_lang(bare), "links": links}


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = b""

    def __post_init__(self):
        self.headers = dict(self.headers)

    def serialize(self) -> bytes:
        lines = [VERSION, *(f"{k}: {v}" for k, v in self.headers.items() if k != "Content-Length"), f"Content-Length: {len(self.block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + self.block + b"\r\n\r\n"

    def compressed(self) -> bytes:
        """A gzip member of its own."""
        return gzip.compress(self.serialize(), 6, mtime=0)


def parse(raw: bytes) -> Iterator[Record]:
    """Records of a WARC file, plain or as gzip members."""
    f = io.BufferedReader(_Inflated(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record begins here")
        headers: dict[str, str] = {}
        last = None
        while (line := f.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and last:
                headers[last] += " " + text.strip()
            else:
                last, _, value = text.partition(":")
                headers[last] = value.strip()
        size = int(headers.get("Content-Length", 0))
        block = f.read(size)
        if len(block) < size:
            headers["WARC-Truncated"] = "unspecified"
        yield Record(headers, block)


class _Inflated(io.RawIOBase):
    """What gzip members hold; a member that is cut off ends the stream."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.out = raw, 0, b""
        self.member = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.out:
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                if self.raw[self.at : self.at + 2] != b"\x1f\x8b":
                    return 0
                self.member = zlib.decompressobj(31)
            part = self.member.unconsumed_tail
            if not part:
                part = self.raw[self.at : self.at + (1 << 16)]
                self.at += len(part)
                if not part:
                    return 0
            self.out = self.member.decompress(part, 1 << 16)
        n = min(len(into), len(self.out))
        into[:n] = self.out[:n]
        self.out = self.out[n:]
        return n


def response(name: str, url: str | None, payload: bytes, date: str) -> Record:
    """A response record around a payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(name), "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\r\n]", "", url)
    headers |= {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(http + payload), "Content-Type": "application/http; msgtype=response"}
    return Record(headers, http + payload)


def http_parts(block: bytes) -> tuple[list[str], bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    return (head.decode("utf-8", "replace").split("\r\n"), body) if gap else ([], block)


def _decoded(payload: bytes, head: list[str]) -> str:
    """The payload in the charset that HTTP declares, UTF-8 if none or an unknown one."""
    kind = next((x for x in head[1:] if x.lower().startswith("content-type:")), "")
    found = _CHARSET.search(kind)
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(source: Record) -> tuple[Record, Record, dict, str]:
    """(metadata record, conversion record, facts, text) of a response record."""
    head, payload = http_parts(source.block)
    page, url = _decoded(payload, head), source.headers.get("WARC-Target-URI")
    bare = visible(page)
    facts, text = page_facts(bare, url), page_text(bare)
    sid = source.headers.get("WARC-Record-ID") or record_id(digest(source.block))
    shared = {"WARC-Date": source.headers.get("WARC-Date", ""), **({"WARC-Target-URI": url} if url is not None else {}), "WARC-Refers-To": sid}
    facts |= {"payload_digest": digest(payload), "payload_length": len(payload)}
    envelope = {
        "WARC-Header": {**source.headers, "Content-Length": str(len(source.block))},
        "HTTP-Status": head[0] if head else None,
        "HTTP-Header": {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])},
        "Payload": {"Digest": facts["payload_digest"], "Length": len(payload), "Declared-Digest-Agrees": source.headers.get("WARC-Payload-Digest") in (None, facts["payload_digest"])},
        "HTML": {"Title": facts["title"], "Language": facts["lang"], "Links": facts["links"]},
    }
    block = json.dumps({"Envelope": envelope}, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
    meta = Record({"WARC-Type": "metadata", "WARC-Record-ID": record_id(sid + "#metadata"), **shared, "WARC-Block-Digest": digest(block), "Content-Type": "application/json"}, block)
    body = text.encode("utf-8", "replace")
    conv = Record({"WARC-Type": "conversion", "WARC-Record-ID": record_id(sid + "#conversion"), **shared, "WARC-Block-Digest": digest(body), "Content-Type": "text/plain", **({"WARC-Identified-Content-Language": facts["lang"]} if facts["lang"] else {})}, body)
    return meta, conv, facts, text


ROWS = "response_id string, metadata_id string, conversion_id string, refers_to string, target_uri string, payload_digest string, metadata_digest string, text_digest string, title string, lang string, n_links long, text string, metadata string"
RECORDS = "warc_response binary, warc_metadata binary, warc_conversion binary"


def _row(source: Record, url: str | None, records: bool) -> list:
    meta, conv, facts, text = derive(source)
    row = [conv.headers["WARC-Refers-To"], meta.headers["WARC-Record-ID"], conv.headers["WARC-Record-ID"], conv.headers["WARC-Refers-To"], url, facts["payload_digest"], meta.headers["WARC-Block-Digest"], conv.headers["WARC-Block-Digest"], facts["title"], facts["lang"], len(facts["links"]), text, meta.block.decode()]
    return row + ([source.serialize(), meta.serialize(), conv.serialize()] if records else [])


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def derivatives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", records: bool = False) -> DataFrame:
    """One row a page; with ``records`` also the three serialised records (response, metadata, conversion)."""
    bound_batches(pages.sparkSession, 200)
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {ROWS}" + (f", {RECORDS}" if records else "")
    out = _arrow(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for name, url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                payload = (page or "").encode("utf-8", "replace")
                rows.append(_row(response(json.dumps([name, url, digest(payload)]), url, payload, date), url, records))
            if rows:
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(out)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], schema=out)

    return pages.select(F.col(id_col).alias("c0"), F.col(id_col).cast("string").alias("c1"), F.col(url_col).alias("c2"), F.col(html_col).alias("c3")).mapInArrow(run, schema)


def derivatives_of(records_: DataFrame, *, records: bool = False) -> DataFrame:
    """One row for each response record of a frame as ``read_warc`` gives it; other records are left out."""
    bound_batches(records_.sparkSession, 200)
    schema = ROWS + (f", {RECORDS}" if records else "")
    out = _arrow(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for headers, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = Record(dict(headers), block.as_py())
                rows.append(_row(source, source.headers.get("WARC-Target-URI"), records))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return records_.where("record_type = 'response'").select("headers", "block").mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str, glob: str = "*.warc*") -> DataFrame:
    """Records of WARC files, plain or gzipped: path, record_type, record_id, target_uri, headers, block."""
    bound_batches(spark, 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for r in parse(raw.as_py()):
                    h = r.headers
                    yield pa.RecordBatch.from_pydict({"path": [name], "record_type": pa.array([h.get("WARC-Type")], pa.string()), "record_id": pa.array([h.get("WARC-Record-ID")], pa.string()), "target_uri": pa.array([h.get("WARC-Target-URI")], pa.string()), "headers": pa.array([list(h.items())], pa.map_(pa.string(), pa.string())), "block": pa.array([r.block], pa.binary())})

    return files.mapInArrow(run, "path string, record_type string, record_id string, target_uri string, headers map<string,string>, block binary")


def write_warc(serialised: DataFrame, folder: str, column: str = "record", gzip_: bool = False) -> None:
    """Write a binary column of serialised records as WARC files, one a partition; nulls are left out.

    A record ends with two line ends; the second one is the writer's own.
    """
    body = F.expr(f"substring(`{column}`, 1, octet_length(`{column}`) - 2)").cast("string")
    rows = serialised.where(F.col(column).isNotNull()).select(body.alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", "gzip" if gzip_ else "none").text(folder)


def write_derivatives(derived: DataFrame, folder: str, **how) -> None:
    """The metadata and conversion records of ``derived`` (with ``records=True``) as WARC files."""
    write_warc(derived.select(F.explode(F.array("warc_metadata", "warc_conversion")).alias("record")), folder, **how)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"))
