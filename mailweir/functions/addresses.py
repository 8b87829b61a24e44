"""Addresses in headers (RFC 5322): a mailbox with or without a display name, or a group of mailboxes; native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweir.functions import text as fn
from mailweir.functions.grammar import DOMAIN, LOCAL, QUOTED, literal_ip
from mailweir.functions.ip import let

#: A run of spaces or of atoms, and the words of a phrase, have one way to match: nothing that may follow one begins with what it is made
#: of. So they are possessive; with ways to cut a run, a name without a mailbox would be tried in all of them.
_SPACE = "[ \t]*+"
_ATOMS = r"[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~.]++"
_PHRASE = rf"(?:(?:{QUOTED}|{_ATOMS}){_SPACE})++"
_SPEC = rf"(?:{LOCAL})@(?:{DOMAIN}|\[[^\[\]\\]*\])"
_MAILBOX = rf"(?:(?:{_PHRASE})?<{_SPACE}{_SPEC}{_SPACE}>|{_SPEC})"

MAILBOX = "struct<display_name:string,display_name_quoted:boolean,user:string,quoted:boolean,host:string,ip:string>"


def _struct(**parts: Column) -> Column:
    """A struct whose names stay beside a generator, where Spark drops aliases."""
    return F.named_struct(*(x for name, value in parts.items() for x in (F.lit(name), value)))


def unquoted(local: Column) -> Column:
    """A local part or word without its quotes and escapes."""
    return F.when(local.startswith('"'), F.regexp_replace(F.substring(local, F.lit(2), F.length(local) - 2), r"\\(.)", "$1")).otherwise(local)


def _name(phrase: Column) -> Column:
    """A display name: its words without quotes and escapes, one space between two."""
    return F.array_join(F.transform(F.regexp_extract_all(phrase, F.lit(rf"({QUOTED}|{_ATOMS})"), F.lit(1)), unquoted), " ")


def _parts(box: Column) -> Column:
    """A well-formed mailbox as a struct, null if its address literal is no address."""
    phrase = F.regexp_extract(box, rf"(?s)\A({_PHRASE})?<", 1)
    spec = F.when(box.endswith(">"), F.regexp_extract(box, rf"(?s)<{_SPACE}({_SPEC}){_SPACE}>\z", 1)).otherwise(box)

    def made(phrase: Column, local: Column, host: Column, ip: Column) -> Column:
        parts = lambda user: _struct(
            display_name=F.nullif(_name(phrase), F.lit("")), display_name_quoted=phrase.contains('"'), user=user,
            quoted=local.startswith('"') & ~user.rlike(rf"\A{_ATOMS}\z"), host=F.coalesce(ip, host), ip=ip,
        )
        return F.when(~host.startswith("[") | ip.isNotNull(), let(unquoted(local), parts))

    literal = lambda host: F.when(host.startswith("["), literal_ip(host))
    placed = lambda p, s: let(F.regexp_extract(s, "(?s)^(.*)@", 1), lambda local: let(F.substring_index(s, "@", -1), lambda host: let(literal(host), lambda ip: made(p, local, host, ip))))
    return let(phrase, lambda p: let(spec, lambda s: placed(p, s)))


def address_list(text: Column) -> Column:
    """struct<group, list> of an address: one mailbox (group null), or a group's name and members (an empty group has none); null if malformed.

    What follows a mailbox after a comma isn't looked at.
    """
    group = rf"(?s)\A{_SPACE}({_PHRASE}):((?:{_SPACE}{_MAILBOX}{_SPACE}(?:,{_SPACE}{_MAILBOX}{_SPACE})*)?{_SPACE});"

    def made(t: Column) -> Column:
        one = F.regexp_extract(t, rf"(?s)\A{_SPACE}({_MAILBOX}){_SPACE}(?:,.*)?\z", 1)
        boxes = F.when(t.rlike(group), F.regexp_extract_all(F.regexp_extract(t, group, 2), F.lit(f"({_MAILBOX})"), F.lit(1))).otherwise(let(one, lambda x: F.when(x != "", F.array(x))))
        name = F.when(t.rlike(group), _name(F.regexp_extract(t, group, 1)))
        return let(F.transform(boxes, _parts), lambda found: F.when(found.isNotNull() & F.forall(found, lambda x: x.isNotNull()), _struct(group=name, list=found)))

    return let(text, made)


def first_address(text: Column) -> Column:
    """The first mailbox of an address, null if there is none."""
    return F.get(address_list(text)["list"], F.lit(0))


def mailbox_text(box: Column) -> Column:
    """A mailbox's address as text, without its display name; empty for null."""
    return let(box, lambda x: F.coalesce(fn.address_text(x["user"], x["host"], x["quoted"], x["ip"].isNotNull()), F.lit("")))


def first_address_text(text: Column) -> Column:
    """The first mailbox's address as text, without its display name; empty if there is none."""
    return mailbox_text(first_address(text))
