"""Raw messages as a DataFrame: files, mail boxes, archives, pasted headers; validation and parsing.

The Python boundary is crossed once: one Arrow pass turns (filename, content) into a struct of all that
the mail library reads. Whatever the bytes are, a message comes out; what couldn't be read shows as
issues and a lower confidence.
"""

from __future__ import annotations

import hashlib
import io
import mailbox
import tarfile
import tempfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from email.message import EmailMessage, Message
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayscope.config import MAX_UPLOAD_BYTES, OLE_MAGIC, REQUIRED_HEADERS
from relayscope.session import reach

PARSED = (
    "filename string, sha256 string, source_format string, from_display_name string, from_address string, to_addresses array<string>, subject string, "
    "date_raw string, date_parsed timestamp, message_id string, return_path string, content_type string, has_attachments boolean, "
    "attachments array<struct<filename:string,content_type:string,size_bytes:bigint,sha256:string>>, parse_confidence double, "
    "issues array<struct<field:string,detail:string>>, received array<string>, authentication_results array<string>, dkim_signature string, body string, is_html boolean"
)
_STAMP = pa.timestamp("us", tz="UTC")
T = TypeVar("T")


def files(spark: SparkSession, folder: str, pattern: str = "*.eml") -> DataFrame:
    """path, filename, content of the files in a folder (or one file)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def pasted(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Pasted header texts as messages."""
    return spark.createDataFrame([("pasted-email.eml", bytearray(t.encode("utf-8"))) for t in texts], "filename string, content binary")


def validated(df: DataFrame, most: int = MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``): empty contents and those over ``most`` bytes are rejected."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    reason = F.when(size == 0, "empty file").when(size > most, "file too large")
    tested = df.withColumn("reason", reason)
    return tested.where("reason is null").drop("reason"), tested.where("reason is not null").drop("content")


def source_format(df: DataFrame) -> DataFrame:
    """``df`` with ``source_format``: msg by name or by the first bytes, else eml."""
    magic = F.hex(F.substring("content", 1, 8)) == OLE_MAGIC
    return df.withColumn("source_format", F.when(F.coalesce(F.lower("filename").endswith(".msg"), F.lit(False)) | F.coalesce(magic, F.lit(False)), "msg").otherwise("eml"))


# fixed values: what issues say, and what an issue takes off the confidence
_SAID = {
    "parser": "parser raised {!r}, falling back",
    "fallback": "fallback parser raised {!r}",
    "msg": ".msg parser raised {!r}",
    "msg library": "extract_msg not installed",
    "missing": "required header missing",
    "date": "could not parse date: {!r}",
    "attachment": "failed hashing: {!r}",
    "parts": "failed walking MIME parts: {!r}",
}
_UNNAMED = "(unnamed attachment)"
_PER_DEFECT, _PER_MISSING, _NO_ORIGIN = 0.05, 0.12, 0.3


class _Reading:
    """One message being read. Whatever a reader raises becomes an issue, or nothing where none is named, and its ``other`` value."""

    def __init__(self) -> None:
        self.issues: list[tuple[str, str]] = []
        self.held: dict[str, str | None] = {}  # headers read so far; the library parses them anew each time

    def tried(self, read: Callable[[], T], other: T, field: str | None = None, said: str = "") -> T:
        try:
            return read()
        except Exception as e:  # noqa: BLE001 - a message is read as far as it can be
            if field is not None:
                self.issues.append((field, _SAID[said].format(e)))
            return other

    def eml(self, raw: bytes) -> Message:
        by = lambda rules: lambda: BytesParser(policy=rules).parsebytes(raw)
        found = self.tried(by(policy.default), None, "__root__", "parser")
        if found is None:
            found = self.tried(by(policy.compat32), None, "__root__", "fallback")
        if found is None:
            return EmailMessage()
        self.issues += [("__message__", str(d)) for d in getattr(found, "defects", [])]
        return found

    def msg(self, raw: bytes) -> Message:
        try:
            import extract_msg
        except ImportError:
            self.issues.append(("__root__", _SAID["msg library"]))
            return EmailMessage()

        def rebuilt() -> Message:
            held = extract_msg.openMsg(io.BytesIO(raw))
            message = EmailMessage(policy=policy.default)
            for name, value in (("From", held.sender), ("To", held.to), ("Subject", held.subject), ("Date", held.date), ("Message-ID", getattr(held, "messageId", ""))):
                message[name] = value or ""
            for line in str(getattr(held, "header", None) or "").splitlines():
                name, colon, value = line.partition(":")
                if colon and name.lower() in ("received", "authentication-results"):
                    message[name.title()] = value.strip()
            message.set_content(held.body or "")
            held.close()
            return message

        return self.tried(rebuilt, EmailMessage(), "__root__", "msg")

    def header(self, message: Message, name: str) -> str | None:
        if name not in self.held:
            value = self.tried(lambda: message.get(name), None)
            self.held[name] = None if value is None else self.tried(lambda: str(value), None)
        return self.held[name]

    def headers(self, message: Message, name: str) -> list[str]:
        return self.tried(lambda: [str(v) for v in message.get_all(name, [])], [])

    def attachments(self, message: Message) -> list[dict]:
        found: list[dict] = []

        def walk() -> None:
            for part in message.walk() if message.is_multipart() else ():
                name = part.get_filename()
                if name or "attachment" in str(part.get("Content-Disposition", "")).lower():
                    held, kind = self.tried(lambda: (part.get_payload(decode=True), part.get_content_type()), (b"", None), "attachments", "attachment")
                    held = held if isinstance(held, bytes) else b""
                    found.append({"filename": _utf8(name) or _UNNAMED, "content_type": kind, "size_bytes": len(held), "sha256": hashlib.sha256(held).hexdigest()})

        self.tried(walk, None, "body", "parts")
        return found

    def body(self, message: Message) -> tuple[str, bool]:
        """The HTML body if there is one, else the plain one."""

        def read() -> tuple[str, bool]:
            for kind in ("html", "plain") if isinstance(message, EmailMessage) else ():
                if (part := message.get_body(preferencelist=(kind,))) is not None:
                    return str(part.get_content()), kind == "html"
            return "", False

        return self.tried(read, ("", False))


def _utf8(text: str | None) -> str | None:
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


#: Fields that are a header as it stands.
_PLAIN_HEADERS = {"subject": "Subject", "date_raw": "Date", "message_id": "Message-ID", "return_path": "Return-Path", "dkim_signature": "DKIM-Signature"}


def parse_message(filename: str | None, raw: bytes | None) -> dict:
    """All fields of one message; never raises."""
    raw = raw or b""
    reading = _Reading()
    is_msg = (filename or "").lower().endswith(".msg") or raw[:8].hex().upper() == OLE_MAGIC
    message = (reading.msg if is_msg else reading.eml)(raw)
    defects = sum(f == "__message__" for f, _ in reading.issues)
    missing = [h for h in REQUIRED_HEADERS if not reading.header(message, h)]
    reading.issues += [(h, _SAID["missing"]) for h in missing]
    sender, received = reading.header(message, "From"), reading.headers(message, "Received")
    names = reading.tried(lambda: [(n or None, a or None) for n, a in getaddresses([sender])], [(None, sender)]) if sender else []
    name, address = names[0] if names else (None, None)
    fields = {f: _utf8(reading.header(message, h)) for f, h in _PLAIN_HEADERS.items()}
    raw_date = reading.header(message, "Date")
    date_parsed = reading.tried(lambda: parsedate_to_datetime(raw_date), None, "Date", "date") if raw_date else None
    content_type = reading.tried(message.get_content_type, None, "body", "parts")
    attachments = reading.attachments(message) if content_type is not None else []
    body, is_html = reading.body(message)
    penalty = _PER_DEFECT * defects + _PER_MISSING * len(missing) + (0.0 if sender or received else _NO_ORIGIN)
    return {
        **fields,
        "filename": filename,
        "sha256": hashlib.sha256(raw).hexdigest(),
        "source_format": "msg" if is_msg else "eml",
        "from_display_name": _utf8(name),
        "from_address": _utf8(address),
        "to_addresses": [_utf8(a) for _, a in reading.tried(lambda: getaddresses(reading.headers(message, "To")), []) if a],
        "date_parsed": date_parsed,
        "content_type": content_type,
        "has_attachments": bool(attachments),
        "attachments": attachments,
        "parse_confidence": max(0.0, min(1.0, 1.0 - penalty)),
        "issues": [{"field": f, "detail": _utf8(d)} for f, d in reading.issues],
        "received": [_utf8(h) for h in received],
        "authentication_results": [_utf8(h) for h in reading.headers(message, "Authentication-Results")],
        "body": _utf8(body),
        "is_html": is_html,
    }


_ARROW = pa.schema(
    [("filename", pa.string()), ("sha256", pa.string()), ("source_format", pa.string()), ("from_display_name", pa.string()), ("from_address", pa.string()), ("to_addresses", pa.list_(pa.string())), ("subject", pa.string()), ("date_raw", pa.string()), ("date_parsed", _STAMP), ("message_id", pa.string()), ("return_path", pa.string()), ("content_type", pa.string()), ("has_attachments", pa.bool_())]
    + [("attachments", pa.list_(pa.struct([("filename", pa.string()), ("content_type", pa.string()), ("size_bytes", pa.int64()), ("sha256", pa.string())]))), ("parse_confidence", pa.float64()), ("issues", pa.list_(pa.struct([("field", pa.string()), ("detail", pa.string())])))]
    + [("received", pa.list_(pa.string())), ("authentication_results", pa.list_(pa.string())), ("dkim_signature", pa.string()), ("body", pa.string()), ("is_html", pa.bool_())]
)


def parse(df: DataFrame, key: str = "filename", name: str = "filename", content: str = "content") -> DataFrame:
    """``msg_id`` (from ``key``) and the parsed fields of each message."""
    from datetime import UTC

    reach(df.sparkSession)
    narrow = df.select(F.col(key).cast("string").alias("msg_id"), F.col(name).alias("_name"), F.col(content).alias("_content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # bounds the parsed messages held at a time
                part = batch.slice(a, 256)
                rows = [parse_message(n, c) for n, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                for row in rows:
                    when = row["date_parsed"]
                    if when is not None:  # a naive date is UTC
                        row["date_parsed"] = when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)
                table = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                yield pa.RecordBatch.from_arrays([part.column(0), *table.columns], names=["msg_id", *_ARROW.names])

    return narrow.mapInArrow(run, f"msg_id string, {PARSED}")


def plain_text(message: Message) -> str:
    """Subject, blank line, plain-text parts."""
    parts = []
    for part in message.walk() if message.is_multipart() else [message]:
        if not message.is_multipart() or part.get_content_type() == "text/plain":
            try:
                payload = part.get_payload(decode=True)
                parts.append(payload.decode("utf-8", "replace") if payload else "")
            except Exception:  # noqa: BLE001
                continue
    return f"{message.get('Subject', '')}\n\n{' '.join(p for p in parts if p)}".strip()


def corpus_texts(df: DataFrame) -> DataFrame:
    """filename, text of the messages in mail boxes and bz2 tar archives (filename, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = []
                if name.lower().endswith((".tar.bz2", ".tar")):
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for member in tar:
                            held = tar.extractfile(member) if member.isfile() else None
                            if held is not None:
                                texts.append(plain_text(message_from_bytes(held.read())))
                else:
                    # the mailbox reader wants a file; it is this worker's own scratch and ends with the call
                    with tempfile.NamedTemporaryFile(suffix=".mbox") as f:
                        f.write(content)
                        f.flush()
                        texts += [plain_text(m) for m in mailbox.mbox(f.name)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array([_utf8(t) for t in texts], pa.string())], names=["filename", "text"])

    return df.select("filename", "content").mapInArrow(run, "filename string, text string")
