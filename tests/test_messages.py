"""Grammar, headers, encoded words, addresses and the processor chain on small cases made from the RFCs' productions."""

import zlib

import pytest
from pyspark.sql import functions as F

from mailweir.functions import addresses, grammar, mime
from mailweir.functions import text as fn
from mailweir.functions.ip import canonical_ip, canonical_text, ip_bytes
from mailweir.operators import allow, mailrows, processors, replies

REVERSE = {
    "<>": ("", ""), " <>": ("", ""), "<ann@mail.example>": ("ann", "mail.example"), "<ann@mail.example> SIZE=12": ("ann", "mail.example"), "<@hop.example,@next.example:ann@end.example>": ("ann", "end.example"),
    "<@hop.example:ann@[192.0.2.9]>": ("ann", "192.0.2.9"), "<ann@[IPv6:2001:DB8:0:0::1]>": ("ann", "2001:db8::1"), "<ann@[IPv6:::::]>": None, "<ann@[IPv6:2001:db8::1::]>": None, "<ann@[192.0.2.256]>": None,
    '<"a\\[b"@mail.example>': ("a[b", "mail.example"), "<dept/unit=one@mail.example>": ("dept/unit=one", "mail.example"), "<ann@mail.example> X-KEY=1 FLAG": ("ann", "mail.example"), "<ann@mail.example> X-=1": None,
    "": None, "<": None, "ann": None, "<<>>": None, "<nohost>": None, "<@hop.example:nohost": None, " <": None, "<two..dots@mail.example>": None, "<ann@-mail.example>": None, "<ann@mail-.example>": None, None: None,
}
FORWARD = {"<Postmaster>": ("postmaster", ""), "<postMASTER@mail.example> NOTIFY=NEVER": ("postmaster", "mail.example"), '<"Postmaster">': ("postmaster", ""), "<>": None, "<nohost>": None, "<ann@[192.0.2.1]>": ("ann", "192.0.2.1")}


def values(spark, cases, column, kind="string"):
    df = spark.createDataFrame([(x,) for x in cases], f"x {kind}")
    return {r["x"]: r["y"] for r in df.select("x", column(F.col("x")).alias("y")).collect()}


@pytest.mark.parametrize(("cases", "forward"), [(REVERSE, False), (FORWARD, True)])
def test_paths(spark, cases, forward):
    got = values(spark, cases, lambda x: grammar.parse_path(x, forward))
    assert {k: (p["user"], p["host"]) if p["ok"] else None for k, p in got.items()} == cases


def test_path_limits(spark):
    fault = lambda x: grammar.address_fault(x, grammar.parse_path(x, False))
    label = "d" * 60
    cases = {"<ann@mail.example>": None, "<>": None, "nothing": "invalid_address", f"<{'u' * 128}@a.example>": None, f"<{'u' * 129}@a.example>": "local_part_too_long", f"<{'u' * 250}@a.example>": "path_too_long", f"<{'é' * 130}@a.example>": "path_too_long", f"<a@{'.'.join([label] * 4)}>": None}
    assert values(spark, cases, fault) == cases


def test_greetings(spark):
    lines = {" mail.example": ("mail.example",) * 2, " [192.0.2.3]": (None, "192.0.2.3"), " [IPv6:2001:db8::1]": (None, "2001:db8::1"), " under_score.example": (None, None), "mail.example": (None, None), " mail.example more": (None, None), "": (None, None)}
    for k in (0, 1):
        assert values(spark, lines, lambda x, k=k: grammar.greeting_host(x, bool(k))) == {x: y[k] for x, y in lines.items()}


def test_ip_texts(spark):
    cases = {
        "2001:0DB8:0000:0000:0001:0000:0000:0001": "2001:db8::1:0:0:1", "::": "::", "1::": "1::", "::1": "::1", "1:0:0:2:0:0:0:3": "1:0:0:2::3", "::FFFF:C000:0207": "192.0.2.7", "64:ff9b::192.0.2.33": "64:ff9b::c000:221",
        "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::": "1:2:3:4:5:6:7:0", "192.0.2.255": "192.0.2.255", "192.0.2.256": None, "192.0.2": None, "192.0.02.1": None, "1::2::3": None, ":::": None, "1:2": None, "12345::": None, "1:2:3:4:5:6:7:8:9": None, "": None, None: None,
    }
    assert values(spark, cases, canonical_ip) == cases
    assert {k: canonical_text(k) for k in cases if k is not None} == {k: v for k, v in cases.items() if k is not None}
    whole = {"192.0.2.7": "C0000207", "0.0.0.9": "09", "::1": "01", "1::2": "00010000000000000000000000000002"[2:], "no": "", None: ""}
    assert values(spark, whole, lambda x: F.hex(ip_bytes(x))) == whole
    legacy = {"192.0.2.7": "C0000207", "::1": "", "1::2": whole["1::2"], "1:2:3:4:5:6:7:8": "", "::ffff:192.0.2.7": "C0000207", "no": ""}
    assert values(spark, legacy, lambda x: F.hex(ip_bytes(x, legacy=True))) == legacy


def test_allow_lists(spark):
    listed = ["one.example", "*.wild.example", "pre*mid*.example", "?q.example", "[a-c]x*", "lit\\*eral*", "[::FFFF:C000:0207]", "[2001:0db8::0001]", "[bad]"]
    hosts = {"ONE.example": True, "two.example": False, "a.wild.example": True, "wild.example": False, "preAmidB.example": True, "xq.example": False, "bx.anything": True, "dx": False, "lit*erally": True, "literal": False, "a/b.wild.example": False, "a.wild.example\n": False, None: False}
    assert values(spark, hosts, lambda x: allow.allows_host(x, listed)) == hosts
    ips = {"192.0.2.7": True, "192.0.2.8": False, "2001:db8::1": True}
    assert values(spark, ips, lambda x: allow.allows_recipient(F.lit("any"), x, listed)) == ips
    for all_of, open_ in ((["."], True), (["*"], True), ([".", "*.y"], True), ([".", "a.example"], False), ([], False)):
        assert values(spark, {"b.example": 0}, lambda x, all_of=all_of: allow.allows_host(x, all_of)) == {"b.example": open_}


def test_addresses(spark):
    cases = {
        "ann@mail.example": [(None, "ann", "mail.example")], '"Ann B." <ann@mail.example>': [("Ann B.", "ann", "mail.example")], "Ann  B <ann@mail.example>": [("Ann B", "ann", "mail.example")], '"a b"@[IPv6:2001:DB8::1]': [(None, "a b", "2001:db8::1")],
        "Crew: ann@mail.example, Bob <bob@mail.example>;": [(None, "ann", "mail.example"), ("Bob", "bob", "mail.example")], "None: ;": [], "ann": None, "ann@[IPv6:IPv6::1]": None, "Ann <ann@mail.example": None, "": None, None: None,
    }
    got = values(spark, cases, addresses.address_list)
    assert {k: None if v is None else [(m["display_name"], m["user"], m["host"]) for m in v["list"]] for k, v in got.items()} == cases
    assert got["Crew: ann@mail.example, Bob <bob@mail.example>;"]["group"] == "Crew"
    texts = {'X <"a b"@mail.example>': '"a b"@mail.example', "ann@[192.0.2.1]": "ann@[192.0.2.1]", "no": ""}
    assert values(spark, texts, addresses.first_address_text) == texts


def test_long_names_without_a_mailbox(spark):
    """Each would take years if a run of atoms, spaces or words could be cut in more than one way."""
    name, many = "Customer#" + "0" * 40, '"Q" ' + "word " * 40
    cases = dict.fromkeys([f"{name} <nowhere>", f"{many}<nowhere>", f"{name}{' ' * 60}(", f"{many}: {name} <nowhere>;", f"{many}: {name} <a@b.example>, {many}<nowhere>;", name], None)
    assert values(spark, cases, addresses.address_list) == cases
    good = f"{many}: {name} <a@b.example> , {many}<c@d.example>\t;"
    found = values(spark, [good], addresses.address_list)[good]
    assert [m["display_name"] for m in found["list"]] == [name, "Q " + "word " * 39 + "word"] and found["group"] == "Q " + "word " * 39 + "word"


def test_encoded_words():
    cases = {
        "=?ISO-8859-1?Q?Caf=E9?= au lait": "Café au lait", "plain": "plain", None: None, "at the end =?ISO-8859-1?Q?Caf=E9?=": "at the end Café",
        "x =?ISO-8859-1?Q?Caf=E9?=glued": "x Caféglued", "=?UTF-8?B?YQ==?= \t=?UTF-8?B?Yg==?=": "ab", "=?UTF-8?B?Y?=": "=?UTF-8?B?Y?=", "=?nope?Q?x?=": "=?nope?Q?x?=", "=?UTF-8?Q?a_b?=": "a b",
    }
    assert {k: mime.decode_words(k) for k in cases} == cases


def test_headers(spark):
    cases = {"Subject: hi\nto: a\nTO:b\nX-y-Z: 1\n  2\n\nBody: no": {"Subject": ["hi"], "To": ["a", "b"], "X-Y-Z": ["1 2"]}, "no header": None, None: None, "A: 1\nbroken line\nB: 2\n\n": {"A": ["1"]}, "x" * 40000 + "\n\n": None, "A: " + "y" * 4093 + "\n\n": None}
    assert values(spark, cases, mime.parse_headers) == cases


def test_result_codes_and_limits(spark):
    codes = {"250 OK": 250, "2": 554, "25 x": 554, "\t 250 OK\n": 250, "": 554, "25": 554, "2500": 250, "abc": 554, None: 554}
    assert values(spark, codes, fn.result_code) == codes
    cut = {"\t b\n": b"b", "abcdef": b"abcd", " abcd": b" abc", "é" * 3: "éé".encode(), "": b""}
    assert {k: bytes(v) for k, v in values(spark, cut, lambda x: fn.trim_bytes(x, 4)).items()} == cut
    assert values(spark, {"[2001:db8::1%eth0]:25": 0, "192.0.2.1:25": 0}, fn.peer_ip) == {"[2001:db8::1%eth0]:25": "2001:db8::1", "192.0.2.1:25": "192.0.2.1"}
    assert values(spark, {0: 0}, lambda x: fn.mail_date(F.timestamp_seconds(x)), "int") == {0: "Thu, 01 Jan 1970 00:00:00 +0000"}


def test_replies():
    assert replies.canned("relay_denied", "b.example") == "454 4.1.1 Error: Relay access denied: b.example"
    assert replies.reply_text("2.5.0") == "250 2.5.0 OK" and replies.reply_text("2.9.9") == "200 2.9.9 OK" and replies.reply_text("4.9.9") == "400 4.9.9 Temporary failure."
    assert len(replies.CANNED) == 30


def test_chain(spark):
    df = spark.createDataFrame([("Hello " * 50, 1), (None, 2)], "data string, n int")
    got = {r["n"]: r["compressed"] for r in df.transform(processors.chain(" COMPRESSOR | debugger")).collect()}
    assert zlib.decompress(got[1]).decode() == "Hello " * 50 and got[2] is None
    assert df.transform(processors.chain("")).columns == df.columns
    with pytest.raises(ValueError, match="nothere"):
        processors.chain("hasher|NotHere")
    message = spark.createDataFrame([("192.0.2.1", "helo.example", ["ann@first.example", "b@c.example"], False, True, "t")], "remote_ip string, helo string, rcpt_to array<string>, esmtp boolean, tls boolean, stamp string")
    made = message.transform(processors.chain("header")).first()["delivery_header"]
    assert made == "Delivered-To: ann@mail.example.com\nReceived: from 192.0.2.1 ([192.0.2.1])\n\tby first.example with SMTPS id unknown@first.example;\n\tt\n"


def test_recipient_lists(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],)], "r array<string>")
    got = rows.select(mailrows.push(F.col("r"), F.lit("c")).alias("x"), mailrows.pop(F.col("r")).alias("y")).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c"], ["a"]), (["c"], [])]
