"""The registered queries of the message operators, with their SQL.

Messages are made up from columns of the tables, so that each operator's result can be stated in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailweir.functions import addresses, grammar, ip, mime
from mailweir.functions import text as fn
from mailweir.operators import allow, configdiff, mailrows, processors, protocol, replies, sessions, tlsnames
from mailweir.sinks import logs, store
from mailweir.sources import config, load
from mailweir.sources import lines as line_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ALLOWED = ["ththre.example.com", "*.example.org", "*.net"]
_HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_ALLOWS = f"(lower({_HOST}) = 'ththre.example.com' OR regexp_matches(lower({_HOST}), '^[^/]*\\.example\\.org$') OR regexp_matches(lower({_HOST}), '^[^/]*\\.net$'))"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))


@query(f"""
SELECT page_id, {_HOST} AS host, {_ALLOWS} AS allowed,
       CASE WHEN {_ALLOWS} THEN '250 2.1.5 OK' ELSE '454 4.1.1 Error: Relay access denied: ' || {_HOST} END AS reply
FROM pages""")
def q01_relay_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relay decision and reply for the host of every page."""
    judged = _hosts(spark, sf_dir).withColumn("allowed", allow.allows_host(F.col("host"), ALLOWED))
    status = judged.withColumn("status", F.when(F.col("allowed"), "2.1.5").otherwise("4.1.1"))
    denied = F.concat(F.lit("454 4.1.1 Error: Relay access denied: "), F.col("host"))
    return replies.with_reply(status).select("page_id", "host", "allowed", F.when(F.col("allowed"), F.col("reply")).otherwise(denied).alias("reply"))


@query(f"SELECT page_id, {_HOST} AS host FROM pages WHERE lower({_HOST}) IN (SELECT DISTINCT lower({_HOST}) FROM pages WHERE page_id % 3 = 0)")
def q02_allowed_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _hosts(spark, sf_dir)
    return allow.split_by_exact_list(hosts, "host", hosts.where("page_id % 3 = 0"))


@query(f"SELECT page_id, {_HOST} AS host FROM pages WHERE lower({_HOST}) NOT IN (SELECT DISTINCT lower({_HOST}) FROM pages WHERE page_id % 3 = 0)")
def q02_denied_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _hosts(spark, sf_dir)
    return allow.split_by_exact_list(hosts, "host", hosts.where("page_id % 3 = 0"), keep=False)


@query("SELECT * FROM (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS position FROM events) WHERE position <= 60")
def q03_recipient_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return sessions.cap_rows(events, "user_id", ["ts", "event_id"], 60).drop("ts")


@query("""
SELECT doc_id, strlen(text) AS bytes,
       CASE WHEN strlen(text) > 5000 THEN '550' WHEN strlen(text) > 3000 THEN '451' ELSE '250' END AS code
FROM documents""")
def q04_body_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("bytes"), F.when(size > 5000, "550").when(size > 3000, "451").otherwise("250").alias("code"))


@query("""
SELECT doc_id, CASE WHEN strlen(split_part(text, ' ', 1)) + strlen(split_part(text, '.', 1)) + 3 > 256 THEN '550 5.5.4 Path too long'
  WHEN strlen(split_part(text, ' ', 1)) > 128 THEN '550 5.5.4 Local part too long'
  WHEN strlen(split_part(text, '.', 1)) > 255 THEN '550 5.5.4 Domain cannot exceed 255 characters' ELSE '250 2.1.0 OK' END AS reply FROM documents""")
def q05_path_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, local part and domain against their limits in bytes, in this order."""
    local, domain = F.octet_length(F.split_part("text", F.lit(" "), F.lit(1))), F.octet_length(F.split_part("text", F.lit("."), F.lit(1)))
    reply = (
        F.when(local + domain + 3 > 256, "550 5.5.4 Path too long").when(local > 128, "550 5.5.4 Local part too long")
        .when(domain > 255, "550 5.5.4 Domain cannot exceed 255 characters").otherwise("250 2.1.0 OK")
    )
    return table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))


def _recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("rcpt"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"))


_RCPT = "(SELECT o_orderkey, o_orderstatus, o_orderpriority, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS rcpt FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


@query(f"""
SELECT o_orderkey, CAST(i AS INTEGER) AS position, md5(o_orderstatus || o_orderpriority || array_to_string(rcpt[1:i], '')) AS hash
FROM (SELECT *, unnest(range(1, len(rcpt) + 1)) AS i FROM {_RCPT})""")
def q08_hasher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of sender, subject and all recipients so far, for every recipient."""
    hashes = fn.cumulative_md5(F.concat("o_orderstatus", "o_orderpriority"), F.col("rcpt"))
    rows = _recipients(spark, sf_dir).select("o_orderkey", F.posexplode(hashes).alias("p", "hash"))
    return rows.select("o_orderkey", (F.col("p") + 1).alias("position"), "hash")


@query("""
SELECT o_orderkey, 'Delivered-To: c' || o_custkey || '@mail.test' || chr(10) || 'Received: from 10.0.0.1 ([10.0.0.1])' || chr(10) || chr(9) || 'by host.test with '
  || CASE WHEN o_orderstatus = 'F' THEN 'E' ELSE '' END || 'SMTP' || CASE WHEN o_custkey % 2 = 0 THEN 'S' ELSE '' END
  || ' id ' || md5(CAST(o_orderkey AS VARCHAR)) || '@host.test;' || chr(10) || chr(9) || 'Thu, 01 Jan 1970 00:00:00 +0000' || chr(10) AS header
FROM orders""")
def q10_delivery_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    label = fn.protocol_label(F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0)
    user = F.concat(F.lit(" c"), F.col("o_custkey").cast("string"))
    header = fn.delivery_header(user, F.lit("mail.test"), F.lit("10.0.0.1"), F.lit("host.test"), label, F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.lit("Thu, 01 Jan 1970 00:00:00 +0000"))
    return orders.select("o_orderkey", header.alias("header"))


@query(f"SELECT o_orderkey, unnest(rcpt) AS recipient, md5(o_orderstatus || o_orderpriority || rcpt[1]) AS hash, 'order ' || o_orderkey AS subject FROM {_RCPT}")
def q11_mail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored row for each recipient; all carry the first hash."""
    first = fn.cumulative_md5(F.concat("o_orderstatus", "o_orderpriority"), F.col("rcpt"))[0]
    return _recipients(spark, sf_dir).select("o_orderkey", F.explode("rcpt").alias("recipient"), first.alias("hash"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("subject"))


_PADDED = "CASE doc_id % 4 WHEN 0 THEN chr(9) || left(text, 40) || chr(10) || chr(13) WHEN 1 THEN ' ' || left(text, 60) || chr(9) || ' ' WHEN 2 THEN chr(9) || text ELSE text END"


@query(f"SELECT doc_id, lower(hex(CASE WHEN strlen(t) > 255 THEN encode(t)[1:255] ELSE encode(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END)) AS prefix FROM (SELECT doc_id, {_PADDED} AS t FROM documents)")
def q12_trim_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space of every kind at the ends of short texts; long ones keep it."""
    padded = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PADDED.replace("chr(", "char(")).alias("t"))
    return padded.select("doc_id", F.lower(F.hex(fn.trim_bytes(F.col("t"), 255))).alias("prefix"))


@query("SELECT event_id, CAST(user_id % 256 AS BIGINT) * 16777216 + CAST(event_id % 256 AS BIGINT) * 65536 + 7 * 256 + 9 AS ip FROM events")
def q13_ipv4_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    quad = F.concat_ws(".", (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"), F.lit("7"), F.lit("9"))
    return table(spark, sf_dir, "events").select("event_id", fn.ipv4_number(quad).alias("ip"))


@query(f"""
SELECT event_id, s.status, CAST(coalesce(d.code, CAST(s.status[1] AS INTEGER) * 100) AS INTEGER) AS basic_code,
       coalesce(d.code, CAST(s.status[1] AS INTEGER) * 100) || ' ' || s.status || ' ' ||
       coalesce(d.txt, CASE s.status[1] WHEN '2' THEN 'OK' WHEN '4' THEN 'Temporary failure.' WHEN '5' THEN 'Permanent failure.' ELSE '' END) AS reply
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '2' WHEN 1 THEN '4' ELSE '5' END || '.' || (event_id % 8) || '.' || (event_id % 6) AS status FROM events) s
LEFT JOIN {replies.sql_dimension()} ON s.status = d.status""")
def q14_reply_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    status = F.concat(F.when(e % 3 == 0, "2").when(e % 3 == 1, "4").otherwise("5"), F.lit("."), (e % 8).cast("string"), F.lit("."), (e % 6).cast("string"))
    return replies.with_reply(table(spark, sf_dir, "events").select("event_id", status.alias("status")))


@query("""
SELECT event_id, user_id, CAST(b AS BIGINT) AS bad_so_far FROM (
  SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM events)
WHERE b < 5 OR (b = 5 AND event_type = 'error')""")
def q15_kill_after_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return sessions.kill_after(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "bad_so_far")


@query("SELECT user_id, count(*) FILTER (value < 100) AS accepted, count(*) AS lines FROM events GROUP BY user_id")
def q16_accepted_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") < 100).alias("accepted"), F.count(F.lit(1)).alias("lines"))


@query("""
SELECT event_id, user_id, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS transaction FROM events""")
def q18_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return sessions.transactions(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "transaction")


@query("""
WITH g AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 30000000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY t, event_id) - 1 AS r FROM i)
SELECT event_id, user_id, CAST(island AS INTEGER) AS island, CAST(r // 3 AS INTEGER) AS batch, CAST(r % 3 AS INTEGER) AS place FROM n""")
def q19_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert batches of each user: three rows, or thirty thousand idle seconds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", micros.alias("at"))
    return sessions.batches(events, "user_id", "at", "event_id", 3, 30_000_000_000).drop("at")


@query("""
SELECT user_id, max(epoch_us(ts)) AS at, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id
HAVING max(epoch_us(ts)) + 40000000000 > (SELECT max(epoch_us(ts)) FROM events)""")
def q20_expiring_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("user_id", micros.alias("at"), "event_id")
    now = events.agg(F.max("at").alias("now"))  # one row, in the plan
    return sessions.last_write(events, "user_id", "at", "event_id", now, 40_000_000_000)


@query("""
WITH o AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name || 'x' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 13 <> 0),
b AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_custkey IS NULL AS isnew, n.c_custkey IS NULL AS gone, o.c_name IS DISTINCT FROM n.c_name AS d1, o.c_nationkey IS DISTINCT FROM n.c_nationkey AS d2 FROM o FULL OUTER JOIN n ON o.c_custkey = n.c_custkey)
SELECT c_custkey, 'new' AS event, NULL AS field FROM b WHERE isnew UNION ALL SELECT c_custkey, 'removed', NULL FROM b WHERE gone
UNION ALL SELECT c_custkey, 'changed', 'c_name' FROM b WHERE NOT isnew AND NOT gone AND d1 UNION ALL SELECT c_custkey, 'changed', 'c_nationkey' FROM b WHERE NOT isnew AND NOT gone AND d2""")
def q21_config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    new = c.where(k % 13 != 0).withColumns({"c_name": F.when(k % 7 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")), "c_nationkey": F.when(k % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))})
    return configdiff.diff(c.where(k % 11 != 0), new, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '"' || replace(replace(c_name || '"', '\\', '\\\\'), '"', '\\"') || '"' ELSE c_name || '"' END
  || '@' || CASE WHEN c_custkey % 3 = 0 THEN '[10.0.0.1]' ELSE 'a.test' END AS address FROM customer""".replace("\\\\", "\\"))
def q24_address_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    literal = k % 3 == 0
    text = fn.address_text(F.concat("c_name", F.lit('"')), F.when(literal, "10.0.0.1").otherwise("a.test"), k % 4 == 0, literal)
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("address"))


@query("""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 250 WHEN 1 THEN 554 WHEN 2 THEN 400 + event_id % 60 WHEN 3 THEN 554 WHEN 4 THEN 554 WHEN 5 THEN 250 WHEN 6 THEN 554 ELSE 25 END AS code FROM events""")
def q25_result_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that begin with a code, or with less than three characters of one, behind white space of every kind."""
    e = F.col("event_id")
    text = (
        F.when(e % 8 == 0, " 250 OK").when(e % 8 == 1, "error").when(e % 8 == 2, F.concat((400 + e % 60).cast("string"), F.lit(" x"))).when(e % 8 == 3, "25 x")
        .when(e % 8 == 4, "2").when(e % 8 == 5, "\t\n 250 OK\r\n").when(e % 8 == 6, "").otherwise("+25 x")
    )
    return table(spark, sf_dir, "events").select("event_id", fn.result_code(text).cast("bigint").alias("code"))


@query("""
SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN starts_with(l, 'T') THEN '.' || l ELSE l END), chr(10)) || chr(10)) AS body
FROM documents WHERE doc_id % 5 <> 0""")
def q26_dot_unstuffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as sent, from transferred lines up to the dot alone: lines that begin with T are sent with a dot. Every fifth transfer has no end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sent = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.when(x.startswith("T"), F.concat(F.lit(".."), x)).otherwise(x)), "\r\n")
    ended = docs.select("doc_id", F.concat(sent, F.when(F.col("doc_id") % 5 != 0, "\r\n.\r\nQUIT\r\n.").otherwise("")).alias("raw"))
    found = line_source.bodies(line_source.explode_lines(ended, "raw", "doc_id"), "doc_id", "seq")
    return found.select("doc_id", F.md5(F.col("body").cast("binary")).alias("body"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE md5(CAST(o_orderkey AS VARCHAR)) = md5('7')")
def q30_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    return table(spark, sf_dir, "orders").where(hashed == F.md5(F.lit(b"7"))).select("o_orderkey", "o_custkey")  # a stored hash would be pushed down


@query("""
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'MAIL FROM:' WHEN 'assistant' THEN 'RCPT TO:' WHEN 'system' THEN 'HELO' END AS verb FROM conversations""")
def q31_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("role") == "user", "mail from:<").when(F.col("role") == "assistant", "Rcpt To:<").when(F.col("role") == "system", "helo ").otherwise("blah "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.verb(line).alias("verb"))


@query("""
SELECT event_id, CASE WHEN g > 30000000000 THEN '554 Error: transaction timeout' ELSE '250 2.0.0 OK' END AS reply
FROM (SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS g FROM events)""")
def q32_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.coalesce(micros - F.lag(micros).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.when(gap > 30_000_000_000, "554 Error: transaction timeout").otherwise("250 2.0.0 OK").alias("reply"))


_USER = "lower(replace(c_name, '#', '.'))"
_LINE = f"""CASE c_custkey % 7 WHEN 0 THEN '<' || {_USER} || '@shop.example.com> SIZE=' || c_custkey || ' BODY=8BITMIME' WHEN 1 THEN '<>' WHEN 2 THEN '<' || {_USER} || '>'
 WHEN 3 THEN ' <@a.example,@b:"' || c_name || ' x"@[127.0.0.1]>' WHEN 4 THEN '<' || {_USER} || '@-bad.example>' WHEN 5 THEN '<' || {_USER} || '@a.example> SI-=1' ELSE 'x@y' END"""


@query(f"""
SELECT c_custkey, c_custkey % 7 IN (0, 1, 3) AS ok, CASE c_custkey % 7 WHEN 0 THEN {_USER} WHEN 1 THEN '' WHEN 3 THEN c_name || ' x' END AS user_part,
       CASE c_custkey % 7 WHEN 0 THEN 'shop.example.com' WHEN 1 THEN '' WHEN 3 THEN '127.0.0.1' END AS host, CASE WHEN c_custkey % 7 = 3 THEN '127.0.0.1' END AS ip,
       CASE c_custkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 3 THEN 0 END AS n_params, CASE c_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 3 THEN 2 END AS n_route
FROM customer""")
def q33_reverse_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sender paths of seven kinds, right and wrong, by the protocol's grammar."""
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_LINE).alias("line"))
    parsed = lines.select("c_custkey", grammar.parse_path(F.col("line"), forward=False).alias("p"))
    return parsed.select("c_custkey", "p.ok", F.col("p.user").alias("user_part"), "p.host", "p.ip", F.when(F.col("p.ok"), F.size("p.params")).alias("n_params"), F.when(F.col("p.ok"), F.size("p.route")).alias("n_route"))


@query("""
SELECT doc_id, 'doc ' || doc_id AS subject, 2 AS n_lang, lang AS first_lang, 'a ' || coalesce(source, '') AS folded, 4 AS n_names
FROM (SELECT doc_id, coalesce(lang, '') AS lang, source FROM documents)""")
def q34_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header maps of messages made from documents: repeated names in any case, and folded lines."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    data = F.concat(F.lit("SUBJECT: doc "), F.col("doc_id").cast("string"), F.lit("\nx-lang:  "), c("lang"), F.lit("\nX-Lang: two\nX-folded: a\n\t "), c("source"), F.lit("\nDate: x\n\n"), c("text"))
    parsed = table(spark, sf_dir, "documents").select("doc_id", mime.parse_headers(data).alias("h"))
    of = lambda name: F.col("h")[name]
    return parsed.select("doc_id", of("Subject")[0].alias("subject"), F.size(of("X-Lang")).alias("n_lang"), of("X-Lang")[0].alias("first_lang"), of("X-Folded")[0].alias("folded"), F.size("h").alias("n_names"))


@query("SELECT c_custkey, 'Re: ' || c_name || c_mktsegment || ' =?nope' AS subject FROM customer")
def q35_encoded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent encoded words become one text, what isn't one stays."""
    word = lambda c: F.concat(F.lit("=?UTF-8?B?"), F.base64(F.encode(c, "UTF-8")), F.lit("?="))
    raw = F.concat(F.lit("Re: "), word(F.col("c_name")), F.lit(" \t"), word(F.col("c_mktsegment")), F.lit(" =?nope"))
    return table(spark, sf_dir, "customer").select("c_custkey", mime.decoded_words(raw).alias("subject"))


@query("""
SELECT c_custkey, c_name AS subject, md5('bob@example.net' || c_name || 't0' || 'a@x.example') AS first_hash, md5('bob@example.net' || c_name || 't0' || 'a@x.examplec@y.example') AS second_hash,
       'Delivered-To: a@mail.example.com' || chr(10) || 'Received: from 10.0.0.1 ([10.0.0.1])' || chr(10) || chr(9) || 'by x.example with ESMTP id '
       || md5('bob@example.net' || c_name || 't0' || 'a@x.example') || '@x.example;' || chr(10) || chr(9) || 't0' || chr(10) AS delivery_header
FROM customer""")
def q36_processor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured chain: headers, hashes of the recipients, delivery header."""
    message = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("10.0.0.1").alias("remote_ip"), F.lit("helo.example").alias("helo"), F.lit("bob").alias("mail_user"), F.lit("example.net").alias("mail_host"),
        F.array(F.lit("a@x.example"), F.lit("c@y.example")).alias("rcpt_to"), F.lit(True).alias("esmtp"), F.lit(False).alias("tls"), F.lit("t0").alias("stamp"),
        F.concat(F.lit("Subject: "), F.col("c_name"), F.lit("\n\nbody")).alias("data"),
    )
    out = message.transform(processors.chain("HeadersParser|Hasher|Header|Debugger"))
    return out.select("c_custkey", "subject", F.col("hashes")[0].alias("first_hash"), F.col("hashes")[1].alias("second_hash"), "delivery_header")


# -- sessions ------------------------------------------------------------------------------------


SERVER = protocol.ServerOptions(hostname="mx.example.com", allowed_hosts=("a.example", "*.shop.example"), max_size=20_000)
_EVENT_LINE = """CASE event_type WHEN 'view' THEN 'noop' WHEN 'signup' THEN 'RSET' WHEN 'click' THEN 'MAIL FROM:<u' || user_id || '@x.example>'
  WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'RCPT TO:<bad' WHEN event_id % 4 = 1 THEN 'rcpt to:<r' || event_id || '@z.example>' ELSE 'RCPT TO:<r' || event_id || '@a.example>' END ELSE 'blah' END"""


@query("""
WITH e AS (SELECT *, row_number() OVER w AS seq,
    count(*) FILTER (event_type = 'error') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bad,
    max(CASE WHEN event_type = 'signup' THEN epoch_us(ts) ELSE -1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reset_at,
    max(CASE WHEN event_type = 'click' THEN epoch_us(ts) ELSE -2 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mail_at
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS session_id, event_id,
  CASE WHEN bad > 5 OR (bad = 5 AND event_type <> 'error') THEN NULL
    WHEN event_type = 'view' THEN '200 2.0.0 OK' WHEN event_type = 'signup' THEN '250 2.1.0 OK'
    WHEN event_type = 'click' THEN CASE WHEN coalesce(mail_at, -2) > reset_at THEN '503 5.5.1 Error: nested MAIL command' ELSE '250 2.1.0 OK' END
    WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN '501 5.5.4 Invalid address' WHEN 1 THEN '454 4.1.1 Error: Relay access denied: z.example' ELSE '250 2.1.5 OK' END
    WHEN bad = 5 THEN '554 5.5.1 Too many unrecognized commands' ELSE '554 5.5.1 Unrecognized command' END AS reply
FROM e""")
def q37_session_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply to every line of a session of each user: nested senders, refused recipients, and the end after five unknown lines."""
    events = table(spark, sf_dir, "events")
    seq = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    done = protocol.run_sessions(events.select(F.col("user_id").alias("session_id"), seq.alias("seq"), F.expr(_EVENT_LINE).alias("line")), SERVER)
    return done.select("session_id", F.col("seq.id").alias("event_id"), "reply")


def _document_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is sent in a session of its own, as one message to two recipients (one refused), and then again without recipients."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id").cast("string")
    stuffed = F.regexp_replace("text", "(?m)^\\.", "..")
    raw = F.concat(
        F.lit("EHLO client.example\r\nMAIL FROM:<d"), k, F.lit("@x.example> SIZE=9\r\nRCPT TO:<one@a.example>\r\nRCPT TO:<two@b.example>\r\nRCPT TO:<\"t w\"@x.shop.example>\r\nDATA\r\nSubject: doc "), k, F.lit("\r\n\r\n"),
        F.replace(stuffed, F.lit("\n"), F.lit("\r\n")), F.lit("\r\n.\r\nMAIL FROM:<>\r\nMAIL FROM:<>\r\nDATA\r\nQUIT\r\nNOOP\r\n"),
    )
    lines = line_source.explode_lines(docs.select(F.col("doc_id").alias("session_id"), raw.alias("raw")), "raw", "session_id")
    return protocol.run_sessions(lines.withColumn("remote_ip", F.lit("192.0.2.7")), SERVER)


_SENT = "'Subject: doc ' || doc_id || chr(10) || chr(10) || text || chr(10)"


@query(f"""
WITH d AS (SELECT doc_id, strlen({_SENT}) > 20000 AS over, chr(13) || chr(10) AS e FROM documents),
r AS (SELECT doc_id, over, unnest([{{'n': 0, 'reply': '250-mx.example.com Hello' || e || '250-SIZE 20000' || e || '250-PIPELINING' || e || '250-ENHANCEDSTATUSCODES' || e || '250 HELP'}},
  {{'n': 1, 'reply': '250 2.1.0 OK'}}, {{'n': 2, 'reply': '250 2.1.5 OK'}}, {{'n': 3, 'reply': '454 4.1.1 Error: Relay access denied: b.example'}}, {{'n': 4, 'reply': '250 2.1.5 OK'}},
  {{'n': 5, 'reply': '354 Enter message, ending with ''.'' on a line by itself'}},
  {{'n': 6, 'reply': CASE WHEN over THEN '451 4.3.0 Error: maximum DATA size exceeded (20000)' ELSE '250 2.0.0 OK: queued as' END}},
  {{'n': 7, 'reply': '250 2.1.0 OK'}}, {{'n': 8, 'reply': '250 2.1.0 OK'}}, {{'n': 9, 'reply': '503 5.5.1 Error: No recipients'}}, {{'n': 10, 'reply': '221 2.0.0 Bye'}}]) AS x FROM d)
SELECT doc_id AS session_id, x.n AS place, x.reply AS reply FROM r WHERE NOT (over AND x.n > 6)""")
def q38_transfer_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies of a whole transfer, in order; a body beyond the limit ends its session."""
    done = _document_sessions(spark, sf_dir).where("reply IS NOT NULL")
    placed = done.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1)
    queued = F.when(F.col("reply").startswith("250 2.0.0 OK: queued as "), "250 2.0.0 OK: queued as").otherwise(F.col("reply"))
    return placed.select("session_id", "place", queued.alias("reply"))


@query(f"""
SELECT doc_id AS session_id, 1 AS number, '192.0.2.7' AS remote_ip, 'client.example' AS helo, true AS esmtp, false AS tls, 'd' || doc_id || '@x.example' AS mail_from,
       'one@a.example,"t w"@x.shop.example' AS rcpt, md5({_SENT}) AS data FROM documents WHERE strlen({_SENT}) <= 20000""")
def q39_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that the transfers of all documents make."""
    found = protocol.messages(_document_sessions(spark, sf_dir))
    return found.select("session_id", "number", "remote_ip", "helo", "esmtp", "tls", "mail_from", F.array_join("rcpt_to", ",").alias("rcpt"), F.md5(F.col("data").cast("binary")).alias("data"))


_CANNED = {
    "line_too_long": "554 5.5.1 Line too long.", "nested_mail": "503 5.5.1 Error: nested MAIL command", "no_sender": "503 5.5.1 Error: No sender", "no_recipients": "503 5.5.1 Error: No recipients",
    "unrecognized": "554 5.5.1 Unrecognized command", "max_unrecognized": "554 5.5.1 Too many unrecognized commands", "syntax_error": "550 5.5.2 Syntax error", "read_limit": "550 5.2.3 Error:",
    "message_size": "552 5.4.0 Error:", "read_error": "451 4.3.0 Error:", "path_too_long": "550 5.5.4 Path too long", "invalid_address": "501 5.5.4 Invalid address",
    "local_part_too_long": "550 5.5.4 Local part too long, cannot exceed 64 characters", "domain_too_long": "550 5.5.4 Domain cannot exceed 255 characters",
    "backend_not_running": "554 5.5.0 Transaction failed - backend not running", "backend_transaction": "554 5.5.0 Error:", "backend_timeout": "554 5.5.0 Error: transaction timeout",
    "rcpt_failed": "550 5.1.1 User unknown in local recipient table", "too_many_recipients": "452 4.5.3 Too many recipients", "relay_denied": "454 4.1.1 Error: Relay access denied:",
    "shutdown": "421 4.3.0 Server is shutting down. Please try again later. Sayonara!", "mail_ok": "250 2.1.0 OK", "rcpt_ok": "250 2.1.5 OK", "reset_ok": "250 2.1.0 OK", "verify_ok": "252 2.5.0 Cannot verify user",
    "noop_ok": "200 2.0.0 OK", "quit_ok": "221 2.0.0 Bye", "data_ok": "354 Enter message, ending with '.' on a line by itself", "starttls_ok": "220 2.0.0 Ready to start TLS", "queued": "250 2.0.0 OK: queued as",
}


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in _CANNED.items()) + ") AS t(name, reply)")
def q40_canned_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canned reply as it is sent, stated in full by the SQL."""
    return spark.createDataFrame([(name, replies.canned(name)) for name in replies.CANNED], "name string, reply string")


# -- allow-list, addresses, rows --------------------------------------------------------------------


@query("""
WITH h AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'Plain.Example' WHEN 1 THEN 'x.star.example' WHEN 2 THEN 'a/b.star.example' WHEN 3 THEN 'nine9.example' WHEN 4 THEN 'ninex.example' WHEN 5 THEN 'qx*y' WHEN 6 THEN 'qxzy'
  WHEN 7 THEN '192.168.0.' || event_id % 3 WHEN 8 THEN '2001:db8::' || event_id % 4 ELSE 'none.example' END AS host, event_id % 10 IN (7, 8) AS literal FROM events)
SELECT event_id, host, CASE event_id % 10 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN false
  WHEN 7 THEN event_id % 3 = 1 WHEN 8 THEN event_id % 4 = 2 ELSE false END AS allowed FROM h""")
def q41_relay_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and address literals against a list of names, patterns with classes and escapes, and literals written in other ways; a dot beside others allows nothing."""
    e = F.col("event_id")
    made = F.expr("""CASE event_id % 10 WHEN 0 THEN 'Plain.Example' WHEN 1 THEN 'x.star.example' WHEN 2 THEN 'a/b.star.example' WHEN 3 THEN 'nine9.example' WHEN 4 THEN 'ninex.example' WHEN 5 THEN 'qx*y' WHEN 6 THEN 'qxzy'
      WHEN 7 THEN '192.168.0.' || event_id % 3 WHEN 8 THEN '2001:db8::' || event_id % 4 ELSE 'none.example' END""")
    rows = table(spark, sf_dir, "events").select("event_id", made.alias("host"), F.when((e % 10).isin(7, 8), made).alias("ip"))
    listed = [".", "plain.example", "*.star.example", "nine[0-9].exampl*", "?x\\*y*", "[::FFFF:C0A8:1]", "[2001:0DB8:0:0::0002]", "[not.an.address]"]
    return rows.select("event_id", "host", allow.allows_recipient(F.col("host"), F.col("ip"), listed).alias("allowed"))


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'c' || c_custkey || '@a.example' WHEN 1 THEN 'c' || c_custkey || '@a.example' WHEN 2 THEN '"x y"@[192.0.2.1]' WHEN 3 THEN 'one@a.example' WHEN 4 THEN '' ELSE '' END AS first,
  CASE c_custkey % 6 WHEN 1 THEN c_name WHEN 3 THEN NULL WHEN 2 THEN 'Q. Name' END AS display_name,
  CASE c_custkey % 6 WHEN 3 THEN 'the group' WHEN 4 THEN 'nobody' END AS group_name, CAST(CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 0 END AS INTEGER) AS members FROM customer""")
def q42_header_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailboxes with and without names, a group, an empty group, and a malformed address."""
    k = F.col("c_custkey")
    spec = F.concat(F.lit("c"), k.cast("string"), F.lit("@a.example"))
    text = (
        F.when(k % 6 == 0, spec).when(k % 6 == 1, F.concat(F.lit('"'), F.col("c_name"), F.lit('" <'), spec, F.lit(">"))).when(k % 6 == 2, 'Q. Name <"x y"@[192.0.2.1]>, next@a.example')
        .when(k % 6 == 3, "the group: one@a.example, Two <two@b.example>,three@c.example;").when(k % 6 == 4, "nobody: ;").otherwise(F.concat(F.col("c_name"), F.lit(" <nowhere>")))
    )
    found = table(spark, sf_dir, "customer").select("c_custkey", addresses.address_list(text).alias("l"))
    one = F.get(F.col("l.list"), F.lit(0))
    return found.select("c_custkey", addresses.mailbox_text(one).alias("first"), one["display_name"].alias("display_name"), F.col("l.group").alias("group_name"), F.size("l.list").alias("members"))


@query("""
WITH m AS (SELECT c_custkey, c_name, unnest(['a' || c_custkey || '@x.example', 'b@y.example']) AS r, md5('s@x.example' || c_name || 't' || 'a' || c_custkey || '@x.example') AS h FROM customer)
SELECT c_custkey, r AS recipient, CASE WHEN c_custkey % 3 = 0 THEN 'to@h.example' ELSE r END AS "to", 's@x.example' AS "from", c_name AS subject, CASE c_custkey % 4 WHEN 1 THEN 'redis' ELSE '' END AS body,
  md5(CASE c_custkey % 4 WHEN 1 THEN '' ELSE 'H' || chr(10) || 'Subject: ' || c_name || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'To: T <to@h.example>' || chr(10) || 'Message-ID: <m' || c_custkey || '@i.example>' || chr(10) ELSE '' END || chr(10) || 'x' END) AS mail,
  h AS hash, CASE c_custkey % 2 WHEN 0 THEN 'C0000207' ELSE '20010DB8000000000000000000000009' END AS ip_addr, c_custkey % 2 = 0 AS is_tls,
  CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey || '@i.example' ELSE h || '.' || split_part(r, '@', 1) || '@mail.example' END AS message_id, '' AS reply_to, 's@x.example' AS return_path FROM m""")
def q43_stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row store's columns for every recipient of a message made of each customer."""
    k = F.col("c_custkey")
    extra = F.when(k % 3 == 0, F.concat(F.lit("To: T <to@h.example>\nMessage-ID: <m"), k.cast("string"), F.lit("@i.example>\n"))).otherwise("")
    made = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("s@x.example").alias("mail_from"), F.lit("s").alias("mail_user"), F.lit("x.example").alias("mail_host"), F.array(F.concat(F.lit("a"), k.cast("string"), F.lit("@x.example")), F.lit("b@y.example")).alias("rcpt_to"),
        F.concat(F.lit("Subject: "), F.col("c_name"), F.lit("\n"), extra, F.lit("\nx")).alias("data"), F.lit("H\n").alias("delivery_header"), F.when(k % 2 == 0, "192.0.2.7").otherwise("2001:db8::9").alias("remote_ip"),
        (k % 2 == 0).alias("tls"), F.lit("t").alias("stamp"), (k % 4 == 1).alias("in_store"),
    )
    rows = mailrows.mail_rows(made.transform(processors.chain("headersparser|hasher")), F.lit(0).cast("timestamp"), "mail.example", keep=["c_custkey"])
    return rows.select("c_custkey", "recipient", "to", "from", "subject", "body", F.md5("mail").alias("mail"), "hash", F.hex("ip_addr").alias("ip_addr"), "is_tls", "message_id", "reply_to", "return_path")


# -- configuration ------------------------------------------------------------------------------------

_SERVERS = "SELECT 'i' || s_suppkey AS listen_interface, {on} AS is_enabled, {log} AS log_file, CAST({timeout} AS INTEGER) AS timeout, CAST(100 AS INTEGER) AS max_clients, {tls} AS tls_key FROM supplier WHERE {where}"
_OLD = _SERVERS.format(on="s_suppkey % 4 <> 0", log="'a.log'", timeout="30", tls="'k1'", where="s_suppkey % 7 <> 1")
_NEW = _SERVERS.format(on="s_suppkey % 4 <> 0 OR s_suppkey % 8 = 0", log="CASE WHEN s_suppkey % 3 = 0 THEN 'b.log' ELSE 'a.log' END", timeout="CASE WHEN s_suppkey % 5 = 0 THEN 60 ELSE 30 END", tls="CASE WHEN s_suppkey % 6 = 0 THEN 'k2' ELSE 'k1' END", where="s_suppkey % 7 <> 2")


@query(f"""
WITH o AS ({_OLD}), n AS ({_NEW}),
b AS (SELECT coalesce(o.listen_interface, n.listen_interface) AS i, o.listen_interface IS NULL AS fresh, n.listen_interface IS NULL AS gone, o.is_enabled <> n.is_enabled AS sw, n.is_enabled AS on_,
  o.log_file <> n.log_file AS lf, o.timeout <> n.timeout AS tm, o.tls_key <> n.tls_key AS tl FROM o FULL OUTER JOIN n ON o.listen_interface = n.listen_interface)
SELECT i AS listen_interface, 'server_change:new_server' AS event FROM b WHERE fresh UNION ALL SELECT i, 'server_change:remove_server' FROM b WHERE gone
UNION ALL SELECT i, 'server_change:update_config' FROM b WHERE NOT fresh AND NOT gone AND (sw OR lf OR tm OR tl)
UNION ALL SELECT i, CASE WHEN on_ THEN 'server_change:start_server' ELSE 'server_change:stop_server' END FROM b WHERE NOT fresh AND NOT gone AND sw
UNION ALL SELECT i, CASE WHEN lf THEN 'server_change:new_log_file' ELSE 'server_change:reopen_log_file' END FROM b WHERE NOT fresh AND NOT gone AND NOT sw
UNION ALL SELECT i, 'server_change:timeout' FROM b WHERE NOT fresh AND NOT gone AND NOT sw AND tm UNION ALL SELECT i, 'server_change:tls_config' FROM b WHERE NOT fresh AND NOT gone AND NOT sw AND tl""")
def q44_server_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a reload that adds, removes, switches and changes servers."""
    suppliers = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    made = lambda rows, on, log, timeout, tls: rows.select(F.concat(F.lit("i"), k.cast("string")).alias("listen_interface"), on.alias("is_enabled"), log.alias("log_file"), timeout.alias("timeout"), F.lit(100).alias("max_clients"), F.struct(tls.alias("private_key_file")).alias("tls"))
    old = made(suppliers.where(k % 7 != 1), k % 4 != 0, F.lit("a.log"), F.lit(30), F.lit("k1"))
    new = made(suppliers.where(k % 7 != 2), (k % 4 != 0) | (k % 8 == 0), F.when(k % 3 == 0, "b.log").otherwise("a.log"), F.when(k % 5 == 0, 60).otherwise(30), F.when(k % 6 == 0, "k2").otherwise("k1"))
    return configdiff.server_events(old, new).select("listen_interface", "event")


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN '127.0.0.1:2525' ELSE '0.0.0.0:' || c_custkey END AS listen_interface, CASE c_custkey % 4 WHEN 0 THEN 'n' || c_custkey ELSE 'this.host' END AS host_name,
  CAST(CASE WHEN c_custkey % 4 = 0 AND c_custkey > 0 THEN c_custkey ELSE 10485760 END AS BIGINT) AS max_size, 30 AS timeout, 100 AS max_clients, c_custkey % 4 IN (0, 2) AS is_enabled, CASE c_custkey % 4 WHEN 1 THEN 'app.log' WHEN 0 THEN 's.log' ELSE 'stderr' END AS log_file,
  CASE c_custkey % 4 WHEN 0 THEN 'A|B' ELSE 'HeadersParser|Header|Debugger' END AS save_process, CASE c_custkey % 4 WHEN 3 THEN 'PublicKeyFile is empty' END AS error FROM customer""")
def q45_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations as JSON text, loaded with their defaults and checked; one server each."""
    text = F.expr("""CASE c_custkey % 4 WHEN 0 THEN '{"servers":[{"listen_interface":"0.0.0.0:' || c_custkey || '","host_name":"n' || c_custkey || '","max_size":' || c_custkey || ',"is_enabled":true,"log_file":"s.log"}],"backend_config":{"save_process":"A|B","extra":1}}'
      WHEN 1 THEN '{"log_file":"app.log","servers":[{"listen_interface":"0.0.0.0:' || c_custkey || '","timeout":0}]}' WHEN 2 THEN '{}' ELSE '{"servers":[{"listen_interface":"0.0.0.0:' || c_custkey || '","tls":{"start_tls_on":true,"private_key_file":"k"}}]}' END""")
    apps = config.app_rows(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), host="this.host").withColumn("save_process", F.col("backend_config")["save_process"])
    return config.server_rows(apps, "c_custkey", "save_process", "error").select("c_custkey", "listen_interface", "host_name", "max_size", "timeout", "max_clients", "is_enabled", "log_file", "save_process", "error")


@query("""
SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id WHEN 3 THEN 7 END AS BIGINT) AS size, CASE WHEN event_id % 4 <> 2 THEN 'h' || event_id END AS host, CASE WHEN event_id % 4 = 0 THEN true END AS log,
  CASE event_id % 4 WHEN 1 THEN 'property missing/invalid: ''size'' of expected type: int' WHEN 2 THEN 'property missing/invalid: ''size'' of expected type: int' END AS error FROM events""")
def q46_typed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required and optional options of a processor out of JSON: present, of another type, missing, and with a fraction."""
    text = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"size":' || event_id || ',"host":"h' || event_id || '","log":true}' WHEN 1 THEN '{"size":"9","host":"h' || event_id || '"}'
      WHEN 2 THEN '{"host":5}' ELSE '{"size":7.9,"host":"h' || event_id || '","log":"yes"}' END""")
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    made, error = config.typed(F.col("t"), {"size": ("int", False), "host": ("string", False), "log": ("bool", True)})
    return rows.select("event_id", *(c.alias(n) for n, c in made.items()), error.alias("error"))


# -- counters and small functions ---------------------------------------------------------------------


@query("""
WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id), c AS (SELECT user_id, a AS t, 1 AS d FROM s UNION ALL SELECT user_id, b, -1 FROM s)
SELECT user_id, d AS change, CAST(sum(d) OVER (ORDER BY t, d DESC, user_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM c""")
def q47_active_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions are open after each one's first and last event."""
    return sessions.active(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts")


@query("SELECT s_nationkey, CAST(sum(100 + s_suppkey % 9) AS BIGINT) AS clients, sum(100 + s_suppkey % 9) <= 500 AS fits FROM supplier GROUP BY s_nationkey")
def q48_client_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    servers = table(spark, sf_dir, "supplier").select("s_nationkey", (100 + F.col("s_suppkey") % 9).alias("max_clients"))
    return config.client_total(servers, "s_nationkey").select("s_nationkey", "clients", (F.col("clients") <= 500).alias("fits"))


@query("SELECT o_custkey, CASE WHEN count(*) = 1 THEN 'e' || min(o_orderkey) ELSE chr(10) || string_agg('e' || o_orderkey, chr(10) ORDER BY o_orderkey) END AS errors FROM orders GROUP BY o_custkey")
def q49_joined_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One error stands alone, several each on a line of their own."""
    text = F.concat(F.lit("e"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", text.alias("text")).transform(lambda d: sessions.joined_errors(d, "o_custkey", "o_orderkey", "text"))


@query("""
SELECT event_id, md5(chr(65533) || CASE WHEN event_id % 700 * 97 = 0 THEN chr(0) ELSE chr(CAST(event_id % 550 * 97 + 1 AS INTEGER)) END) AS queued FROM events WHERE event_id % 700 > 0""")
def q50_queue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest by which a client's messages are queued, of clients whose number is a character of one to three bytes."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where(e % 700 > 0).select("event_id", fn.queue_id(e % 550 * 97 + 1).alias("queued"))


@query("SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN 3600 + 30 * 60 WHEN 2 THEN 1.5 WHEN 3 THEN 30 WHEN 4 THEN 30 ELSE -0.25 END AS DOUBLE) AS seconds FROM events")
def q51_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 6 == 0, F.concat(e.cast("string"), F.lit("s"))).when(e % 6 == 1, "1h30m").when(e % 6 == 2, "1.5s").when(e % 6 == 3, "30").when(e % 6 == 4, "").otherwise("-250ms")
    return table(spark, sf_dir, "events").select("event_id", fn.duration_seconds(text, 30).alias("seconds"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || event_id % 200 ELSE '192.0.2.1' END AS remote_ip, CASE WHEN event_id % 2 = 0 THEN 'h' || event_id || '.example' ELSE 'first.example' END AS helo FROM events")
def q52_proxied_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a proxy says of a client replaces what the connection says, where it says it."""
    e = F.col("event_id")
    line = F.concat(F.lit("XCLIENT ADDR="), F.when(e % 3 == 0, F.concat(F.lit("10.0.0."), (e % 200).cast("string"))).otherwise("[UNAVAILABLE]"), F.lit(" NAME=a=b"), F.when(e % 2 == 0, F.concat(F.lit(" HELO=h"), e.cast("string"), F.lit(".example"))).otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(fn.proxy_value(line, "ADDR"), fn.peer_ip(F.lit("192.0.2.1:4711"))).alias("remote_ip"), F.coalesce(fn.proxy_value(line, "HELO"), F.lit("first.example")).alias("helo"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2001:db8::' || to_base(event_id % 60000 + 1, 16) WHEN 1 THEN '10.1.2.' || event_id % 250 WHEN 2 THEN NULL WHEN 3 THEN '1:0:2:3:4:5:6:' || to_base(event_id % 10, 16) ELSE '::' || to_base(event_id % 60000 + 1, 16) END AS ip_text
FROM events""".replace("to_base(", "lower(to_base(").replace("60000 + 1, 16)", "60000 + 1, 16))").replace("10, 16)", "10, 16))"))
def q53_address_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text of addresses that are written in other ways; the longest run of zeros is left out."""
    e = F.col("event_id")
    padded, plain = F.lpad(F.hex(e % 60000 + 1), 4, "0"), F.upper(F.hex(e % 60000 + 1))
    text = (
        F.when(e % 5 == 0, F.concat(F.lit("2001:0DB8:0000:0:0:0::"), padded)).when(e % 5 == 1, F.concat(F.lit("::FFFF:10.1.2."), (e % 250).cast("string"))).when(e % 5 == 2, F.concat(F.lit("1::2::"), plain))
        .when(e % 5 == 3, F.concat(F.lit("0001:0000:2:3:4:5:06:"), F.hex(e % 10))).otherwise(F.concat(F.lit("0:0:0:0:0:0:0:"), plain))
    )
    return table(spark, sf_dir, "events").select("event_id", ip.canonical_ip(text).alias("ip_text"))


@query("SELECT doc_id, CAST(strlen('H' || chr(10) || text) AS INTEGER) AS bytes, md5(text) AS unpacked FROM documents")
def q54_compressed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages compressed and taken out again; the length is that of the delivery header and the body."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("H\n").alias("delivery_header"), F.col("text").alias("data"))
    packed = docs.transform(processors.compressor).withColumn("bytes", mailrows.view_bytes(F.col("delivery_header"), F.col("data")))
    return packed.select("doc_id", "bytes", F.md5(F.substring(processors.expanded("compressed"), 3, 1 << 30)).alias("unpacked"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '550 5.1.1 User unknown in local recipient table no such user' WHEN 1 THEN '550 5.1.1 User unknown in local recipient table quota exceeded' ELSE '250 2.1.5 OK' END AS reply FROM customer")
def q55_recipient_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of checks that looks at the last recipient only."""
    k = F.col("c_custkey")
    last = F.when(k % 3 == 0, F.concat(F.repeat(F.lit("u"), 256), F.lit("@a.example"))).when(k % 3 == 1, "full@a.example").otherwise("u@a.example")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.concat(F.repeat(F.lit("v"), 300), F.lit("@a.example")), last).alias("rcpt_to"))
    address = F.element_at("rcpt_to", -1)
    reply = protocol.valid_recipients(rows, [protocol.user_too_long(address), F.when(address.startswith("full@"), "quota exceeded")])
    return rows.select("c_custkey", reply.alias("reply"))


@query("""
SELECT event_id, kind, name, CAST(number AS INTEGER) AS number FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'protocol' WHEN 1 THEN 'curve' WHEN 2 THEN 'cipher' ELSE 'client_auth' END AS kind,
  CASE event_id % 8 WHEN 0 THEN 'tls1.2' WHEN 4 THEN 'tls1.9' WHEN 1 THEN 'X25519' WHEN 5 THEN 'P384' WHEN 2 THEN 'TLS_AES_128_GCM_SHA256' WHEN 6 THEN 'TLS_NONE' WHEN 3 THEN 'RequireAnyClientCert' ELSE 'NoClientCert' END AS name,
  CASE event_id % 8 WHEN 0 THEN 771 WHEN 1 THEN 29 WHEN 5 THEN 24 WHEN 2 THEN 4865 WHEN 3 THEN 2 WHEN 7 THEN 0 END AS number FROM events) WHERE number IS NOT NULL""")
def q56_tls_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of TLS settings joined with their numbers; unknown ones are left out."""
    made = table(spark, sf_dir, "events").select("event_id", F.expr("""CASE event_id % 4 WHEN 0 THEN 'protocol' WHEN 1 THEN 'curve' WHEN 2 THEN 'cipher' ELSE 'client_auth' END""").alias("kind"), F.expr("""CASE event_id % 8
      WHEN 0 THEN 'tls1.2' WHEN 4 THEN 'tls1.9' WHEN 1 THEN 'X25519' WHEN 5 THEN 'P384' WHEN 2 THEN 'TLS_AES_128_GCM_SHA256' WHEN 6 THEN 'TLS_NONE' WHEN 3 THEN 'RequireAnyClientCert' ELSE 'NoClientCert' END""").alias("name"))
    return tlsnames.numbered(made)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'mail of ' || o_custkey ELSE 'own' END AS mail FROM orders")
def q57_stored_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail rows with their mail from the key-value store, where they say that it is there."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = F.md5(k.cast("string").cast("binary"))
    rows = orders.select("o_orderkey", key.alias("hash"), F.when(k % 2 == 0, "redis").otherwise("").alias("body"), F.when(k % 2 == 0, "").otherwise("own").alias("mail"))
    held = orders.select(key.alias("key"), F.concat(F.lit("mail of "), F.col("o_custkey").cast("string")).alias("value"))
    return store.joined(rows, held).select("o_orderkey", "mail")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'WARN' WHEN 3 THEN 'error' WHEN 4 THEN 'panic' ELSE 'odd' END AS level, event_id % 6 IN (2, 3, 4) AS shown FROM events")
def q58_log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.expr("CASE event_id % 6 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'WARN' WHEN 3 THEN 'error' WHEN 4 THEN 'panic' ELSE 'odd' END")
    return table(spark, sf_dir, "events").select("event_id", level.alias("level"), logs.shown(level, "warn").alias("shown"))


@query("SELECT s_suppkey, k, v FROM (SELECT s_suppkey, unnest(['s_name', 's_nationkey']) AS k, unnest([s_name, CAST(s_nationkey AS VARCHAR)]) AS v FROM supplier)")
def q59_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a struct as names and texts."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(configdiff.as_map("s_name", "s_nationkey")).alias("k", "v"))


@query("""
SELECT CAST(i AS BIGINT) AS session_id, 'to' || i || '@mail.example.com' AS rcpt, 'Subject: test ' || i || chr(10) || chr(10) || 'line 1 of ' || i || chr(10) || 'line 2 of ' || i || chr(10) || 'line 3 of ' || i || chr(10) AS data,
  '198.18.' || (i // 256) % 256 || '.' || i % 256 AS remote_ip FROM range(500) AS t(i)""")
def q60_generated_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of made-up clients, through the session machine."""
    done = protocol.run_sessions(load.sessions(spark, 500), protocol.ServerOptions(allowed_hosts=("mail.example.com",)))
    return protocol.messages(done).select("session_id", F.array_join("rcpt_to", ",").alias("rcpt"), "data", "remote_ip")


@query("""
WITH b AS (SELECT c_custkey, c_custkey % 2 = 0 AS backend, c_custkey % 3 = 0 AS hosts, c_custkey % 5 = 0 AS pid, c_custkey % 7 = 0 AS log, c_custkey % 11 = 0 AS level FROM customer)
SELECT c_custkey, 'config_change:backend_config' AS event FROM b WHERE backend UNION ALL SELECT c_custkey, 'config_change:new_config' FROM b WHERE backend OR hosts OR pid OR log OR level
UNION ALL SELECT c_custkey, 'config_change:allowed_hosts' FROM b WHERE hosts UNION ALL SELECT c_custkey, 'config_change:pid_file' FROM b WHERE pid
UNION ALL SELECT c_custkey, 'config_change:log_file' FROM b WHERE log UNION ALL SELECT c_custkey, 'config_change:log_level' FROM b WHERE level""")
def q61_application_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two versions of an application's configuration, for every customer."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.select("c_custkey", F.array(F.lit("process"), F.lit("A")).alias("backend_config"), F.array(F.lit("a.example")).alias("allowed_hosts"), F.lit("p").alias("pid_file"), F.lit("l").alias("log_file"), F.lit("info").alias("log_level"))
    other = lambda name, n, value: F.when(k % n == 0, value).otherwise(F.col(name))
    new = old.withColumns({
        "backend_config": other("backend_config", 2, F.array(F.lit("process"), F.lit("B"))), "allowed_hosts": other("allowed_hosts", 3, F.array(F.lit("a.example"), F.lit("b.example"))),
        "pid_file": other("pid_file", 5, F.lit("")), "log_file": other("log_file", 7, F.lit("off")), "log_level": other("log_level", 11, F.lit("debug")),
    })
    return configdiff.app_events(old, new, "c_custkey").select("c_custkey", "event")


@query("SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS date FROM orders")
def q62_mail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps as in message headers; the session's zone must be UTC."""
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.mail_date(F.col("o_orderdate").cast("timestamp")).alias("date"))


@query("SELECT c_nationkey, CAST(sum(strlen(c_name) + strlen(c_mktsegment)) AS BIGINT) AS bytes FROM customer GROUP BY c_nationkey")
def q63_byte_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.byte_totals(table(spark, sf_dir, "customer"), "c_nationkey", "c_name", "c_mktsegment")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS client_id FROM events")
def q64_client_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers without gaps in the order of arrival."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return sessions.numbered(events, ["ts", "event_id"], F.date_trunc("hour", F.col("ts").cast("timestamp"))).select("event_id", "client_id")
