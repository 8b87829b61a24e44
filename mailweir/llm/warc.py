"""WARC archives: writing with deduplication, and reading with boundary-chain verification.

Records are written by Spark's text writer, whose separator is the blank lines that end a record, and
read by its text reader, which splits files by byte range at the magic line. Every magic is a
candidate: its header gives the offset of its successor. Within a byte range, candidates are linked to
the first offset that their chain reaches outside of it; between ranges, pointer jumping from the
start of the file keeps the offsets that are reached. Magic lines inside payloads are never reached,
and their text stays payload.

Writing: of records with equal payloads of at least `min_bytes` bytes, that with the largest id is a
response, the others are revisits without payload, which name it.

Defined results: a null payload counts as empty, a null URI leaves its line out. Null ids count as
smallest; rows that repeat the largest id are responses all. Line ends in URIs are percent-encoded.
An empty table writes no record. Columns other than id, URI and payload stay out. Bytes before the first record, or after a
record whose length is wrong, are reached by no chain and left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailweir.llm.common import fresh_path, lean, read_table, stored

MAGIC = "WARC/1.1\r\n"
#: Byte ranges up to which their entries are broadcast (about 200 bytes each); beyond, they are joined by shuffle.
BROADCAST_RANGES = 100_000
DATE = "1970-01-01T00:00:00Z"
_ALPHABET, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(column):
    """Bare upper-case base32 SHA-1, natively: 20 bits, five hex digits, make four letters."""
    hexed = F.sha1(column)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _ALPHABET)


def write_records(pages: DataFrame, out: str, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Write one record for each row under `out`.

    Payloads aren't shuffled unless the table of repeated payloads is too large to broadcast; then
    both sides meet by digest, and Spark splits digests that many rows share.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("id"), F.col(uri).cast("string").alias("uri"), body.alias("body"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("body")), "size": F.octet_length("body").cast("bigint")})
    large = rows.where(F.col("size") >= min_bytes)
    repeats = large.groupBy("digest", "size").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(stored(repeats, "repeats"), ["digest", "size"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    safe_uri = F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")), F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), safe_uri, F.lit("\r\n")), F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("original")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), http,
    )
    record = F.concat(head.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("body")))
    joined.select(record.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(out)


_SPLITS = "spark.sql.files.minPartitionNum"


def _reader(spark: SparkSession) -> SparkSession:
    """A session whose settings nobody changes, and whose byte ranges don't follow the live cores.

    A scan is cut by the settings of the session that made it, whenever it runs. So all scans of one reader have the same
    ranges, as long as the files stay.
    """
    reader = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if reader.conf.isModifiable(key):
            reader.conf.set(key, value)
    if not spark.conf.get(_SPLITS, None):
        reader.conf.set(_SPLITS, str(max(1, spark.sparkContext.defaultParallelism)))
    return reader


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines, in file order within each byte range."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


_LINKS = "file string, block bigint, at bigint, next bigint"


def _chains(spark: SparkSession, path: str) -> DataFrame:
    """A row for each byte range (at null; next: its length) and one for each candidate (offset, where its chain leaves the range).

    Offsets count from the first chunk of the range. Only chunk lengths and header figures reach Python.
    """
    head = F.substring_index("value", "\r\n\r\n", 1)
    length = F.regexp_extract(head, r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})(\r\n|$)", 1)
    headed = F.octet_length(head) < F.octet_length("value")
    need = F.when(headed & (length != ""), F.octet_length(head) + F.lit(8 + len(MAGIC)) + F.expr("try_cast(length as bigint)"))
    small = _chunks(spark, path).withColumn("length", length).select("file", "block", F.octet_length("value").cast("bigint").alias("size"), need.alias("need"))
    magic = len(MAGIC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sizes, needs = None, [], []

        def flush() -> pa.RecordBatch:
            size, need_ = np.concatenate(sizes), np.concatenate(needs)
            ends = np.cumsum(size + magic)
            at = ends - (size + magic) - magic  # where the magic before each chunk begins
            goal = np.where(need_ >= 0, at + need_, -1 << 62)
            last = int(at[-1])
            spot = np.searchsorted(at, goal)
            known = (goal >= 0) & (goal <= last) & (at[np.minimum(spot, len(at) - 1)] == goal)
            leave = np.where(goal > last, goal, -1 << 62)
            for i in range(len(at) - 1, -1, -1):
                if known[i]:
                    leave[i] = leave[spot[i]]
            n = len(at)
            nexts = pa.array(np.append(ends[-1], leave), mask=np.append(False, leave <= -1 << 62))  # null: the chain breaks
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * (n + 1), pa.string()), pa.array([now[1]] * (n + 1), pa.int64()), pa.array([None, *at.tolist()], pa.int64()), nexts],
                ["file", "block", "at", "next"],
            )

        for b in batches:
            file, block = b.column("file").to_pylist(), b.column("block").to_numpy(zero_copy_only=False)
            size, need_ = b.column("size").to_numpy(zero_copy_only=False), b.column("need").fill_null(-1).to_numpy(zero_copy_only=False)
            cut = [0, *(i for i in range(1, len(file)) if file[i] != file[i - 1] or block[i] != block[i - 1]), len(file)]
            for i, j in zip(cut, cut[1:], strict=False):
                if i == j:
                    continue
                if now != (file[i], int(block[i])):
                    if now:
                        yield flush()
                    now, sizes, needs = (file[i], int(block[i])), [], []
                sizes.append(size[i:j])
                needs.append(need_[i:j])
        if now:
            yield flush()

    return small.mapInArrow(lean(run), _LINKS)


def verified_entries(spark: SparkSession, path: str) -> DataFrame:
    """For each byte range: base (its offset in the file), entry (offset of its first record that is reached, or null) and
    goal (where the record ends that its first bytes belong to)."""
    links = stored(_chains(spark, path), "links")
    order = Window.partitionBy("file").orderBy("block")
    ranges = links.where("at IS NULL").select("file", "block", F.col("next").alias("length"))
    ranges = stored(ranges.select("file", "block", "length", (F.sum("length").over(order) - F.col("length")).alias("base"), F.row_number().over(order).alias("nth")), "ranges")
    nodes = links.where("at IS NOT NULL").join(ranges, ["file", "block"]).select("file", "block", "nth", (F.col("at") + F.col("base")).alias("at"), (F.col("next") + F.col("base")).alias("next"))
    outer = nodes.groupBy("file", "next").agg(F.min("nth").alias("from_nth")).select("file", F.col("next").alias("at"), "from_nth")
    starts = nodes.where("at = 0")  # the first record of a file
    jumps = stored(nodes.join(outer, ["file", "at"], "left_semi").unionByName(starts).distinct(), "jumps")
    reached = jumps.where("at = 0").select("file", "at")
    rounds = int(ranges.agg(F.max("nth")).first()[0] or 1)
    hop = jumps.select("file", "at", "next")
    done = 1
    while done < rounds:  # doubling: after round r, all records within 2 ** r hops are reached
        step = reached.join(hop, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = stored(reached.unionAll(step).distinct(), "reached")
        to = hop.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        hop = stored(hop.join(to, ["file", "next"]).select("file", "at", F.col("then").alias("next")), "hops")
        done *= 2
    entries = jumps.join(reached, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("file")
    return ranges.join(entries, ["file", "block"], "left").select(
        "file", "block", "base", "entry", F.coalesce(F.first("entry", ignorenulls=True).over(later), F.sum("length").over(whole) - len(MAGIC)).alias("goal"), (F.col("nth") > 1).alias("later")
    )


_FIELDS = [("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary())]
_RECORD = "file string, offset bigint, goal bigint, type string, record_id string, refers_to string, uri string, date string, digest string, http_length bigint, payload binary"


def _need(chunk: bytes) -> int | None:
    """Bytes of the record that begins with this chunk, its magic and its end included."""
    head, blank, _ = chunk.partition(b"\r\n\r\n")
    found = re.search(rb"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})(?:\r\n|$)", head) if blank else None
    return len(MAGIC) + len(head) + 8 + int(found[1]) if found else None


def parse_record(data: bytes) -> tuple:
    """type, record id, refers-to, URI, date, digest, HTTP content length, payload of a record without its magic."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip().decode("utf-8", "replace"))
    block = block[: int(fields.get(b"content-length", "0"))]
    size = None
    if fields.get(b"content-type", "").startswith("application/http"):
        http, _, block = block.partition(b"\r\n\r\n")
        found = re.search(rb"(?i)\r\nContent-Length:[ \t]*([0-9]+)", http)
        size = int(found[1]) if found else None
    digest = fields.get(b"warc-payload-digest", "")
    return (fields.get(b"warc-type"), fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"), fields.get(b"warc-target-uri"), fields.get(b"warc-date"), digest.removeprefix("sha1:") or None, size, block)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under a path: file, offset, header fields and payload.

    Payloads stay in the task that reads them. Only records with magic inside that go on in another
    byte range are put together by a shuffle of their parts; without any, that path isn't taken.
    """
    reader = _reader(spark)
    entries = stored(verified_entries(reader, path), "entries")
    known = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("later") & ~F.col("entry").eqNullSafe(F.col("base") - len(MAGIC))).alias("crossing")).first()
    chunks = _chunks(reader, path).withColumns({"value": F.col("value").cast("binary"), "row": F.monotonically_increasing_id()})
    if known["n"] <= BROADCAST_RANGES:
        met = chunks.join(F.broadcast(entries), ["file", "block"], "left")
    else:
        met = chunks.join(entries, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "row")
    magic = MAGIC.encode()
    names = ["file", "offset", "goal", *(n for n, _ in _FIELDS)]
    kinds = [pa.string(), pa.int64(), pa.int64(), *(t for _, t in _FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, and with a goal the parts of those that go on elsewhere (their offset: where the part begins)."""
        now = begin = expected = aim = None
        at = held = 0
        parts: list[bytes] = []
        out: list[tuple] = []

        def close(end: int) -> None:
            """What is open ends at `end`: a record, or the last bytes of a record of an earlier range."""
            if parts:
                data = magic.join(parts)
                if begin is not None and expected is not None and expected <= end:
                    out.append((now[0], begin, None, *parse_record(data)))
                else:
                    first = end - len(magic) * len(parts) - sum(map(len, parts))
                    out.append((now[0], first, expected if begin is not None else aim, *[None] * 7, data))
                parts.clear()

        def emit() -> pa.RecordBatch:
            rows = list(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for b in batches:
            for file, block, base, entry, goal, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "base", "entry", "goal", "value")), strict=True):
                if (file, block) != now:
                    if base is None:
                        raise ValueError(f"{file} has no byte range at {block}: its ranges or its bytes changed while it was read")
                    close(at)
                    now, at, begin, expected, aim = (file, block), base - len(magic), None, entry, goal
                if at == expected:
                    close(at)
                    need = _need(value)
                    begin, expected = at, at + need if need else None
                parts.append(value)
                at += len(value) + len(magic)
                held += len(value)
                if held > 4 << 20 and out:
                    yield emit()
                    held = 0
        close(at)
        if out:
            yield emit()

    found = met.mapInArrow(lean(run), _RECORD)
    records = found.where("goal IS NULL AND type IS NOT NULL").drop("goal")
    if not known["crossing"]:
        return records

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, out = None, [], []

        def close() -> None:
            data = magic.join(p for _, p in parts)
            need = _need(data)
            if parts and need and parts[0][0] + need == now[1] and len(data) + len(magic) >= need:
                out.append((now[0], parts[0][0], *parse_record(data)))

        for b in batches:
            for file, offset, goal, payload in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "goal", "payload")), strict=True):
                if (file, goal) != now:
                    if now:
                        close()
                    now, parts = (file, goal), []
                parts.append((offset, payload))
        if now:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds[:2] + kinds[3:])], names[:2] + names[3:])

    torn = found.where("goal IS NOT NULL").select("file", "offset", "goal", "payload").repartition("file", "goal").sortWithinPartitions("file", "goal", "offset")
    return records.unionByName(torn.mapInArrow(lean(join), _RECORD.replace("goal bigint, ", "")))


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write a record for every page, read the archives back."""
    out = fresh_path(spark, "warc")
    write_records(read_table(spark, sf_dir, "pages"), out)
    page = lambda c: F.regexp_extract(c, r"^<urn:record:(-?[0-9]+)>$", 1).try_cast("bigint")
    whole = F.col("type") == "response"
    return read_records(spark, out).select(
        page(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(~whole, page(F.col("refers_to"))).alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS keep,
         translate(array_to_string(list_transform(range(8), lambda i:
           to_base(CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT), 32, 4)), ''),
           '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d
"""
