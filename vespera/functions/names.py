"""Names, types, citations and paths: small rules that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies, prefixes and phrases that results depend on.
ENTITY_TYPES = ("process", "file", "user", "host", "ip", "domain", "registry_key", "command", "hash", "url", "other")
ANSWER_PRIVATE = ("10.", "192.168.", "172.16.", "127.")
ECHOED = (
    "confirmed malware", "malware confirmed", "confirmed exfiltration", "exfiltration occurred", "data was stolen", "confirmed compromise",
    "definitely malicious", "definite malware",
)
CITED_PATH = r"Source: ([^)\n]+)|Evidence: (\S+)"


def known_type(label: Column) -> Column:
    """struct<type, note>: a label of the vocabulary in its spelling there; any other becomes other, with a note that keeps it."""
    tidy = F.replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lit(" "), F.lit("_"))
    there = tidy.isin(*ENTITY_TYPES)
    return F.struct(F.when(there, tidy).otherwise("other").alias("type"), F.when(~there, F.concat(F.lit("unknown type kept as other: "), F.coalesce(label, F.lit("")))).alias("note"))


def notable_ip(ip: Column) -> Column:
    """Whether answers may name an address: it has none of the short list of private prefixes."""
    return ~F.greatest(*[ip.startswith(p) for p in ANSWER_PRIVATE])


def echoes(text: Column) -> Column:
    """Whether a text would repeat an overclaim if it were quoted."""
    return F.greatest(*[F.contains(F.lower(text), F.lit(p)) for p in ECHOED])


def source_path(text: Column) -> Column:
    """The evidence file that a text cites, without closing marks; empty if it cites none."""
    both = F.concat(F.regexp_extract(text, CITED_PATH, 1), F.regexp_extract(text, CITED_PATH, 2))
    return F.regexp_replace(both, r"[).,;\s]+$", "")


def citation(kind: Column, target: Column, note: Column) -> Column:
    """How a citation reads: (Source: path) for files, [[page]] for pages, with a note if there is one."""
    base = F.when(kind == "source", F.concat(F.lit("(Source: "), target, F.lit(")"))).otherwise(F.concat(F.lit("[["), target, F.lit("]]")))
    return F.concat(base, F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" - "), note)).otherwise(""))


def safe_case(name: str) -> str:
    """A case's name, if it is one folder name that does not begin with a dot; else ValueError."""
    if not name or name.startswith(".") or re.search(r"[/\\]", name):
        raise ValueError(f"not a case name: {name!r}")
    return name


def safe_page(path: str) -> str:
    """A page's path below its case, if it is relative, stays below it and names nothing hidden; else ValueError."""
    parts = re.split(r"[/\\]", path or "")
    if not path or path[0] in "/\\" or ":" in parts[0] or any(p == ".." or p.startswith(".") or not p for p in parts):
        raise ValueError(f"not a page of a case: {path!r}")
    return "/".join(parts)
