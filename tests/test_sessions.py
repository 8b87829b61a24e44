"""Sessions in batch and as a stream, batches as a stream, sinks and sources."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from mailweir.operators import protocol, sessions
from mailweir.sinks import store, table
from mailweir.sources import config, lines
from mailweir.streaming import sessions as streaming

OPTIONS = protocol.ServerOptions(hostname="mx.example", allowed_hosts=("ok.example", "[192.0.2.9]"), max_size=200, proxy=True, starttls=True)
CASES = {
    1: [("HELO client.example", "250 mx.example Hello"), ("MAIL FROM:<a@b.example> SIZE=3", "250 2.1.0 OK"), ("MAIL FROM:<c@d.example>", "503 5.5.1 Error: nested MAIL command"), ("RSET", "250 2.1.0 OK"), ("MAIL FROM:<c@d.example>", "250 2.1.0 OK"), ("HELO again.example", "250 mx.example Hello"), ("mail from:<c@d.example>", "250 2.1.0 OK"), ("QUIT", "221 2.0.0 Bye"), ("NOOP", None)],
    2: [("EHLO client.example", "250-mx.example Hello\r\n250-SIZE 200\r\n250-PIPELINING\r\n250-STARTTLS\r\n250-ENHANCEDSTATUSCODES\r\n250 HELP"), ("STARTTLS", "220 2.0.0 Ready to start TLS"), ("EHLO client.example", "250-mx.example Hello\r\n250-SIZE 200\r\n250-PIPELINING\r\n250-ENHANCEDSTATUSCODES\r\n250 HELP"), ("HELO <i>x</i>", "550 5.5.2 Syntax error"), ("VRFY x", "252 2.5.0 Cannot verify user"), ("NOOP", "200 2.0.0 OK")],
    3: [("MAIL FROM:<>", "250 2.1.0 OK"), ("MAIL FROM:<>", "250 2.1.0 OK"), ("MAIL FROM:<", "501 5.5.4 Invalid address"), ("RCPT TO:<x@no.example>", "454 4.1.1 Error: Relay access denied: no.example"), ("RCPT TO:<Postmaster>", "454 4.1.1 Error: Relay access denied: mx.example"), ("RCPT TO:<x@[192.0.2.9]>", "250 2.1.5 OK"), ("DATA", "354 Enter message, ending with '.' on a line by itself"), ("a line", None), ("..dot", None), (".", "250 2.0.0 OK: queued as"), ("DATA", "503 5.5.1 Error: No recipients")],
    4: [("junk", "554 5.5.1 Unrecognized command")] * 4 + [("more", "554 5.5.1 Too many unrecognized commands"), ("NOOP", None)],
    5: [("X" * 1023, "554 5.5.1 Line too long."), ("NOOP", None)],
    6: [("XCLIENT ADDR=192.0.2.77 NAME=[UNAVAILABLE] HELO=proxied.example", "250 2.1.0 OK"), (f"MAIL FROM:<{'u' * 129}@b.example>", "550 5.5.4 Local part too long, cannot exceed 64 characters"), ("MAIL FROM:<a@b.example>", "250 2.1.0 OK"), ("RCPT TO:<x@ok.example>", "250 2.1.5 OK"), ("DATA", "354 Enter message, ending with '.' on a line by itself"), ("y" * 250, None), (".", "451 4.3.0 Error: maximum DATA size exceeded (200)"), ("NOOP", None)],
    7: [(f"RCPT TO:<r{i}@ok.example>", "250 2.1.5 OK") for i in range(101)] + [("RCPT TO:<last@ok.example>", "452 4.5.3 Too many recipients")],
}


@pytest.fixture(scope="module")
def sent(spark):
    rows = [(k, i, line, f"198.51.100.{k}") for k, case in CASES.items() for i, (line, _) in enumerate(case)]
    return spark.createDataFrame(rows, "session_id bigint, seq bigint, line string, remote_ip string")


def checked(rows):
    got = {(r["session_id"], r["seq"]): r["reply"] for r in rows}
    for k, case in CASES.items():
        for i, (line, want) in enumerate(case):
            reply = got.pop((k, i))
            assert reply == want or (want and want.endswith("queued as") and reply.startswith(want + " ")), (k, line, reply)
    assert not got


def test_replies(spark, sent):
    done = protocol.run_sessions(sent, OPTIONS)
    rows = done.collect()
    checked(rows)
    assert {r["code"] for r in rows if r["session_id"] == 1} == {250, 503, 221, None}
    (message,) = protocol.messages(done).collect()
    assert (message["session_id"], message["data"], message["rcpt_to"], message["mail_from"], message["remote_ip"]) == (3, "a line\n.dot\n", ["x@[192.0.2.9]"], "", "198.51.100.3")
    assert protocol.run_sessions(sent.limit(0), OPTIONS).count() == 0


def test_shutdown_timeout_and_a_stopped_backend(spark):
    rows = [(1, 0, "NOOP", 0.0, False), (1, 1, "NOOP", 1.0, True), (2, 0, "NOOP", 0.0, False), (2, 1, "NOOP", 31.0, False), (3, 0, "RCPT TO:<a@ok.example>", 0.0, False), (None, 0, "NOOP", 0.0, False)]
    df = spark.createDataFrame(rows, "session_id bigint, seq int, line string, at double, shutdown boolean")
    got = {(r["session_id"], r["seq"]): r["reply"] for r in protocol.run_sessions(df, protocol.ServerOptions(allowed_hosts=("ok.example",), running=False)).collect()}
    assert got == {(1, 0): "200 2.0.0 OK", (1, 1): "421 4.3.0 Server is shutting down. Please try again later. Sayonara!", (2, 0): "200 2.0.0 OK", (2, 1): None, (3, 0): "550 5.1.1 User unknown in local recipient table storage not available", (None, 0): "200 2.0.0 OK"}


def stream_of(spark, df, path, order):
    """The rows as a stream of several micro-batches, in order."""
    rows = df.orderBy(*order).collect()
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], df.schema).coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_stream(df, name, path):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}-check").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    return df.sparkSession.table(name)


def test_a_stream_of_lines_gives_the_same_replies(spark, sent, tmp_path):
    stream = stream_of(spark, sent, f"{tmp_path}/lines", ["seq", "session_id"])
    checked(run_stream(streaming.stream_sessions(stream, OPTIONS), "replies", f"{tmp_path}/lines").collect())


def test_a_stream_gives_the_same_batches(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 3 as user", "id * 10 + if(id > 50, 500, 0) as at", "id as tie")
    want = sorted(map(tuple, sessions.batches(rows, "user", "at", "tie", 4, 200).select("user", "at", "tie", "island", "batch", "place").collect()))
    stream = stream_of(spark, rows, f"{tmp_path}/rows", ["at", "tie"])
    assert sorted(map(tuple, run_stream(streaming.stream_batches(stream, "user", "at", "tie", 4, 200), "batches", f"{tmp_path}/rows").collect())) == want


def test_rows_are_inserted_once(spark, tmp_path):
    path = f"{tmp_path}/rows.db"
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE mail (id INTEGER, "to" TEXT, mail BLOB)')
    rows = spark.range(130).selectExpr("id", "concat('u', id) as `to`", "cast('x' as binary) as mail").repartition(3)
    table.probe(lambda: sqlite3.connect(path), "mail")
    failed = f"{tmp_path}/failed"

    def connect():
        import os

        if not os.path.exists(failed):  # the first statement of one task fails once
            open(failed, "w").close()
            return Flaky(sqlite3.connect(path, timeout=60))
        return sqlite3.connect(path, timeout=60)

    for _ in range(2):  # a second run replaces the rows
        table.insert_rows(rows, connect, "mail", "id", rows=50, pause=0.01)
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*), count(DISTINCT id), max(mail) FROM mail").fetchone() == (130, 130, b"x")
    with pytest.raises(sqlite3.OperationalError):
        table.probe(lambda: sqlite3.connect(path), "none")
    write = table.write_batch(f"{tmp_path}/out")
    for _ in range(2):
        write(rows, 7)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 130


class Flaky:
    def __init__(self, db):
        self.db, self.bad = db, True

    def cursor(self):
        if self.bad:
            self.bad = False
            raise sqlite3.OperationalError("once")
        return self.db.cursor()

    def __getattr__(self, name):
        return getattr(self.db, name)


def test_stores(spark):
    now = [0.0]
    held = store.MemoryStore(lambda: now[0])
    held.put("k", 10, b"v")
    assert held.get("k") == b"v"
    now[0] = 10.0
    assert held.get("k") is None

    class Refusing:
        def put(self, key, ttl, value):
            if key == "bad":
                raise OSError

    rows = spark.createDataFrame([("a", "x"), ("bad", "x"), (None, "x"), ("c", None)], "key string, value string")
    assert [r["in_store"] for r in store.with_store(rows.coalesce(1), Refusing).collect()] == [True, False, False, False]

    def broken():
        raise OSError

    assert not any(r["in_store"] for r in store.with_store(rows, broken).collect())
    mail = spark.createDataFrame([("h", "redis", b""), ("i", "", b"own")], "hash string, body string, mail binary")
    kept = spark.createDataFrame([("h", b"kept"), ("i", b"not this")], "key string, value binary")
    assert {r["hash"]: bytes(r["mail"]) for r in store.joined(mail, kept).collect()} == {"h": b"kept", "i": b"own"}


def test_transcripts_and_bodies(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/one.txt").write_bytes(b"HELO a.example\r\nNOOP\nQUIT\r\n")
    (tmp_path / "t/two.txt").write_bytes(b"QUIT")
    done = protocol.run_sessions(lines.read_transcripts(spark, f"{tmp_path}/t").withColumn("remote_ip", F.lit("192.0.2.1")), protocol.ServerOptions(hostname="h"))
    assert sorted(r["reply"] for r in done.collect()) == ["200 2.0.0 OK", "221 2.0.0 Bye", "221 2.0.0 Bye", "250 h Hello"]
    df = spark.createDataFrame([(1, "a\r\n..b\r\n.\r\nafter"), (2, "no end"), (3, ".\n"), (4, "")], "k int, raw string")
    got = {r["k"]: r["body"] for r in lines.bodies(lines.explode_lines(df, "raw", "k"), "k", "seq").collect()}
    assert got == {1: "a\n.b\n", 3: ""}
    sizes = spark.createDataFrame([("x" * n,) for n in (10, 11, 30)], "b string").select(lines.body_state(F.col("b"), 10, 15).alias("s"))
    assert [r["s"] for r in sizes.collect()] == ["ok", "over", "cut"]


def test_configuration_files(spark, tmp_path):
    path = tmp_path / "app.json"
    path.write_text('{"servers": [{"listen_interface": "127.0.0.1:25", "is_enabled": true}], "backend_config": {"save_process": "Hasher"}}')
    app = config.App.load(str(path))
    assert app.servers[0].max_clients == 100 and app.servers[0].log_file == "stderr" and app.backend_config["log_received_mails"] is False
    assert config.App.of({}).servers[0].listen_interface == "127.0.0.1:2525" and app.with_overrides("p").pid_file == "p"
    rows = config.app_rows(config.read_configs(spark, str(path)))
    assert config.server_rows(rows).first()["max_size"] == 10 << 20 and rows.first()["error"] is None
    for text, problem in (("{", "could not parse"), ('{"servers": [{}]}', "listen interface"), ('{"servers": [{"listen_interface": "x", "tls": {"start_tls_on": true}}]}', "PublicKeyFile is empty")):
        path.write_text(text)
        with pytest.raises(ValueError, match=problem):
            config.App.load(str(path))

    from dataclasses import dataclass

    @dataclass
    class Hash:
        size: int
        host: str = "h"

    assert config.read_options({"size": 3.9, "host": 5}, Hash) == Hash(3, "h")
    with pytest.raises(ValueError, match="size"):
        config.read_options({"size": "x"}, Hash)


def test_messages_are_stored_whole(spark):
    """In the store if it takes them, else compressed in their rows."""
    import zlib

    from mailweir.sinks import whole

    rows = [(1, "a@x.example", ["one@y.example", "two@z.example"], "Subject: hi\nTo: T <t@h.example>\n\nbody", "192.0.2.1", "h", True, False, "t", "a", "x.example")]
    mail = spark.createDataFrame(rows, "k int, mail_from string, rcpt_to array<string>, data string, remote_ip string, helo string, esmtp boolean, tls boolean, stamp string, mail_user string, mail_host string")
    at = F.lit(0).cast("timestamp")
    kept = whole.stored_rows(mail, store.MemoryStore, at, "mail.example").collect()
    assert [(r["recipient"], r["to"], r["body"], bytes(r["mail"])) for r in kept] == [("one@y.example", "t@h.example", "redis", b""), ("two@z.example", "t@h.example", "redis", b"")]

    def broken():
        raise OSError

    (only,) = whole.stored_rows(mail, broken, at, "mail.example", first_only=True).collect()
    text = zlib.decompress(only["mail"]).decode()
    assert only["body"] == "gzip" and text.startswith("Delivered-To: one@mail.example.com\n") and text.endswith("\n\nbody") and only["subject"] == "hi" and len(only["hash"]) == 32
