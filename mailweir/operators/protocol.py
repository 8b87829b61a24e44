"""The receiving session: ordered lines of clients become replies and messages.

What can be said of a line alone (verb, path, limits, relay decision) is made of native columns, in parallel. Only what depends on the
lines before it goes through a small machine, which streams a session's lines in order and holds one message at most. Lines are dealt
by session, so one shuffle is all. The same machine runs as a stateful stream (`mailweir.streaming.sessions`).

A line has session_id, seq and line (text without its line end), and optionally remote_ip, at (seconds) and shutdown (boolean).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailweir.functions import grammar
from mailweir.functions import text as fn
from mailweir.operators.allow import AllowList, allows_recipient
from mailweir.operators.replies import canned, reply_text

#: Limits of a session.
LINE_BYTES, RECIPIENTS, BAD_COMMANDS, BODY_SLACK = 1024, 100, 5, 1_024_000


@dataclass(frozen=True)
class ServerOptions:
    """What a listener is configured with."""

    hostname: str = "mail.example.com"
    allowed_hosts: tuple[str, ...] = (".",)
    max_size: int = 10 << 20
    timeout: int = 30
    proxy: bool = False
    starttls: bool = False
    always_tls: bool = False
    running: bool = True
    state: str = "running"
    help_text: str = "214 RFC 5321"

    def ehlo(self, tls: bool) -> str:
        """The capabilities that EHLO lists."""
        lines = [f"250-{self.hostname} Hello", f"250-SIZE {self.max_size}", "250-PIPELINING", *(["250-STARTTLS"] if self.starttls and not tls else []), "250-ENHANCEDSTATUSCODES", "250 HELP"]
        return "\r\n".join(lines)


def greeting(options: ServerOptions, client: Column, active: Column, at: Column, product: str = "mailweir") -> Column:
    """The first line that a client gets."""
    return F.concat(F.lit(f"220 {options.hostname} {product} #"), client.cast("string"), F.lit(" ("), active.cast("string"), F.lit(") "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"))


FIELDS = ["verb", "helo", "fault", "is_null", "user", "host", "address", "relay", "proxy_ip", "proxy_helo"]


def with_commands(lines: DataFrame, options: ServerOptions) -> DataFrame:
    """Add what a line says as a command (FIELDS); relay is whether its recipient is accepted."""
    line = F.col("line")
    verb = fn.verb(line)
    mail, rcpt = verb == "MAIL FROM:", verb == "RCPT TO:"
    said = lines.withColumn("verb", F.when((verb == "XCLIENT") & F.lit(not options.proxy), None).when((verb == "STARTTLS") & F.lit(not options.starttls), None).otherwise(verb))
    said = said.withColumn("_rest", F.when(mail, F.substring(line, 11, 4096)).when(rcpt, F.substring(line, 9, 4096)))
    said = said.withColumns({"_back": F.when(mail, grammar.parse_path(F.col("_rest"), False)), "_path": F.when(rcpt, grammar.parse_path(F.col("_rest"), True))})
    said = said.withColumn("_path", F.coalesce("_path", "_back")).drop("_back")
    path = F.col("_path")
    postmaster = rcpt & (path["host"] == "") & (path["user"] == "postmaster")
    host = F.when(postmaster, F.lit(options.hostname)).otherwise(path["host"])
    said = said.withColumn("_host", host)
    null_path = F.coalesce(path["null_path"], F.lit(False))
    return said.withColumns(
        {
            "helo": F.when(verb == "HELO", grammar.greeting_host(F.substring(line, 5, 4096), False)).when(verb == "EHLO", grammar.greeting_host(F.substring(line, 5, 4096), True)),
            "fault": F.when(mail | rcpt, grammar.address_fault(F.col("_rest"), path)),
            "is_null": null_path, "user": F.when(~null_path, path["user"]), "host": F.when(~null_path, F.col("_host")),
            "address": F.when(~null_path, fn.address_text(path["user"], F.col("_host"), path["quoted"], path["ip"].isNotNull())),
            "relay": F.when(rcpt, allows_recipient(F.col("_host"), path["ip"], list(options.allowed_hosts))),
            "proxy_ip": F.when(verb == "XCLIENT", fn.proxy_value(line, "ADDR")), "proxy_helo": F.when(verb == "XCLIENT", fn.proxy_value(line, "HELO")),
        }
    ).drop("_rest", "_path", "_host")


_OK = {"RSET": "reset_ok", "VRFY": "verify_ok", "NOOP": "noop_ok"}


@dataclass
class Session:
    """A client's state between two lines."""

    remote_ip: str = ""
    queued_id: str = ""
    state: str = "command"
    helo: str = ""
    esmtp: bool = False
    tls: bool = False
    bad: int = 0
    number: int = 0
    sender: tuple[str, str, str] | None = None
    recipients: list[str] = field(default_factory=list)
    hosts: list[str] = field(default_factory=list)
    body: list[str] = field(default_factory=list)
    size: int = 0
    raw: int = 0
    last: float | None = None

    def pack(self) -> bytes:
        return pickle.dumps(self)

    def reset(self) -> None:
        self.sender, self.recipients, self.hosts, self.body, self.size, self.raw = None, [], [], [], 0, 0

    def take(self, line: str, said: dict, options: ServerOptions, at: float | None = None, shutdown: bool = False) -> tuple[str | None, dict | None]:
        """The reply to a line (null: none), and the message that it completes (null: none)."""
        if at is not None:
            if self.last is not None and at - self.last > options.timeout:
                self.state = "closed"
            self.last = at
        if self.state == "closed":
            return None, None
        if self.state == "data":
            return self._data(line, options)
        if len(line.encode()) + 2 > LINE_BYTES:
            return self._close("line_too_long"), None
        if shutdown:
            return self._close("shutdown"), None
        return self._command(line, said, options), None

    def _close(self, name: str, *more: str) -> str:
        self.state = "closed"
        return canned(name, *more)

    def _command(self, line: str, said: dict, options: ServerOptions) -> str:
        verb = said["verb"]
        if verb in ("HELO", "EHLO"):
            if said["helo"] is None:
                return canned("syntax_error")
            self.helo, self.esmtp = said["helo"], self.esmtp or verb == "EHLO"
            self.reset()
            return options.ehlo(self.tls) if verb == "EHLO" else f"250 {options.hostname} Hello"
        if verb == "HELP":
            return "214-OK\r\n" + options.help_text
        if verb == "XCLIENT":
            self.remote_ip, self.helo = said["proxy_ip"] or self.remote_ip, said["proxy_helo"] or self.helo
            return canned("mail_ok")
        if verb == "MAIL FROM:":
            if self.sender:  # the null path leaves none
                return canned("nested_mail")
            if said["fault"]:
                return canned(said["fault"])
            self.sender = None if said["is_null"] or not said["user"] else (said["user"], said["host"] or "", said["address"])
            return canned("mail_ok")
        if verb == "RCPT TO:":
            return self._recipient(said, options)
        if verb == "DATA":
            if not self.recipients:
                return canned("no_recipients")
            self.state = "data"
            return canned("data_ok")
        if verb == "QUIT":
            return self._close("quit_ok")
        if verb == "STARTTLS":
            if not self.tls:
                self.tls = True
                self.reset()
            return canned("starttls_ok")
        if verb in _OK:
            if verb == "RSET":
                self.reset()
            return canned(_OK[verb])
        self.bad += 1
        return self._close("max_unrecognized") if self.bad >= BAD_COMMANDS else canned("unrecognized")

    def _recipient(self, said: dict, options: ServerOptions) -> str:
        if len(self.recipients) > RECIPIENTS:
            return canned("too_many_recipients")
        if said["fault"]:
            return canned(said["fault"])
        if not said["relay"]:
            return canned("relay_denied", said["host"] or "")
        if not options.running:
            return canned("rcpt_failed", "storage not available")
        self.recipients.append(said["address"])
        self.hosts.append(said["host"] or "")
        return canned("rcpt_ok")

    def _data(self, line: str, options: ServerOptions) -> tuple[str | None, dict | None]:
        self.raw += len(line.encode()) + 2
        if line == ".":
            self.state = "command"
            if self.size > options.max_size:
                reply = self._close("read_error", f"maximum DATA size exceeded ({options.max_size})")
                self.reset()
                return reply, None
            self.number += 1
            user, host, text = self.sender or ("", "", "")
            made = {
                "number": self.number, "remote_ip": self.remote_ip, "helo": self.helo, "esmtp": self.esmtp, "tls": self.tls or options.always_tls, "mail_user": user, "mail_host": host, "mail_from": text,
                "rcpt_to": self.recipients, "rcpt_hosts": self.hosts, "data": "".join(x + "\n" for x in self.body), "queued_id": self.queued_id,
            }
            self.reset()
            if not options.running:
                return canned("backend_not_running", options.state), None
            return canned("queued", self.queued_id) if self.queued_id else reply_text("2.0.0", 250, "OK"), made
        if self.raw > options.max_size + BODY_SLACK:
            reply = self._close("read_limit", "maximum line length exceeded")
            self.reset()
            return reply, None
        plain = line[1:] if line.startswith(".") else line
        self.size += len(plain.encode()) + 1
        self.body.append(plain)
        return None, None


MESSAGE = "struct<number:int,remote_ip:string,helo:string,esmtp:boolean,tls:boolean,mail_user:string,mail_host:string,mail_from:string,rcpt_to:array<string>,rcpt_hosts:array<string>,data:string,queued_id:string>"


def run_sessions(lines: DataFrame, options: ServerOptions) -> DataFrame:
    """session_id, seq, state (before the line), verb, reply, code and message of every line, in one shuffle by session.

    Lines after a session's end have no reply. A reply's code is its first three digits. Lines of a null session are one session.
    Messages are of lines that end a body; a body that is too long closes its session.
    """
    optional = {"remote_ip": F.lit("").cast("string"), "at": F.lit(None).cast("double"), "shutdown": F.lit(False)}
    have = set(lines.columns)
    rows = lines.select("session_id", "seq", F.coalesce("line", F.lit("")).alias("line"), *(F.col(c) if c in have else x.alias(c) for c, x in optional.items()))
    rows = with_commands(rows, options).withColumn("queued_id", fn.queue_id(F.col("session_id").cast("bigint")))
    id_type = rows.schema["session_id"].dataType
    seq_type = rows.schema["seq"].dataType
    schema = T.StructType([T.StructField("session_id", id_type), T.StructField("seq", seq_type), *T._parse_datatype_string(f"state string, verb string, reply string, message {MESSAGE}").fields])
    kind = pa.struct([(n, pa.int32() if n == "number" else pa.bool_() if n in ("esmtp", "tls") else pa.list_(pa.string()) if n.startswith("rcpt") else pa.string()) for n in [f.name for f in schema["message"].dataType.fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, session = object(), Session()
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in ("session_id", "line", "remote_ip", "at", "shutdown", "queued_id", *FIELDS)}
            states, replies, messages = [], [], []
            for i, key in enumerate(columns["session_id"]):
                if key != now:
                    now, session = key, Session(columns["remote_ip"][i] or "", columns["queued_id"][i] or "")
                states.append(session.state)
                reply, message = session.take(columns["line"][i], {c: columns[c][i] for c in FIELDS}, options, columns["at"][i], bool(columns["shutdown"][i]))
                replies.append(reply)
                messages.append(message)
            yield pa.RecordBatch.from_arrays([b.column("session_id"), b.column("seq"), pa.array(states, pa.string()), b.column("verb"), pa.array(replies, pa.string()), pa.array(messages, kind)], schema.names)

    done = rows.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(run, schema)
    return done.withColumn("code", F.when(F.col("reply").isNotNull(), fn.result_code(F.col("reply"))))


def messages(done: DataFrame) -> DataFrame:
    """One row for each message of `run_sessions`: session_id and its fields."""
    return done.where(F.col("message").isNotNull()).select("session_id", "message.*")


def valid_recipients(df: DataFrame, tests: list[Column], rcpt: str = "rcpt_to") -> Column:
    """The reply for the last recipient of `rcpt`: of the first test (null: fine, else the reason) that refuses it, else the acceptance.

    Without tests nothing is looked at.
    """
    refused = F.coalesce(*tests) if tests else F.lit(None).cast("string")
    return F.when(refused.isNotNull(), F.concat(F.lit(canned("rcpt_failed") + " "), refused)).otherwise(F.lit(canned("rcpt_ok")))


def user_too_long(address: Column, limit: int = 255) -> Column:
    """The test of the row store: a recipient's user that its column can't hold is unknown."""
    return F.when(F.octet_length(F.regexp_extract(address, "(?s)^(.*?)(?:@[^@]*)?$", 1)) > limit, "no such user")


__all__ = ["AllowList", "ServerOptions", "Session", "greeting", "messages", "run_sessions", "user_too_long", "valid_recipients", "with_commands"]
