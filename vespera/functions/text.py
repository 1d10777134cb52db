"""Column builders over text: tokenizers, kinds, hashes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
SEARCH_STOPWORDS = (
    "a an the is are was were be been being of to and or in on for with by as this that these those any from into what which who "
    "whom whose do does did has have had it its his her their our your my we you they i if when where why how"
).split()
QUESTION_STOPWORDS = "is the a an of to and or what evidence are was were be been does do this that for in on with any there from".split()
LINK_STOPWORDS = "the a an of to and or in on for with by as is are was were be been this that vs vs. from into any limited objective".split()
TOKEN = r"[a-zA-Z][a-zA-Z0-9_.\-]*"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
DOMAIN = r"\b(?!\d+\.\d+\.\d+\.\d+\b)(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
EXE = r"\b[A-Za-z0-9_.\-]+\.exe\b"
USER = r"\b[A-Z][A-Z0-9_-]{2,}\\[a-zA-Z][a-zA-Z0-9_.\-]+\b"
NOT_A_DOMAIN = r"(?i)\.(exe|reg|csv|txt|md)$"
PRIVATE_IP = r"^(10\.|192\.168\.|172\.1[6-9]\.|172\.2|172\.3[01]\.|127\.)"
DIMENSIONS = 256


def search_tokens(text: Column) -> Column:
    """Lower-cased words of the search index without its stop words, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(found, lambda t: ~t.isin(SEARCH_STOPWORDS))


def question_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda t: ~t.isin(QUESTION_STOPWORDS))


def link_tokens(text: Column) -> Column:
    """Distinct blank-separated tokens of three letters or more that link claims and contradictions."""
    parts = F.split(F.translate(F.lower(text), "/.", "  "), r"\s+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(LINK_STOPWORDS)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def is_public_ip(ip: Column) -> Column:
    return ~ip.rlike(PRIVATE_IP) & (ip != "0.0.0.0")


def source_kind(path: Column) -> Column:
    """Kind of an evidence file by its name, first rule first."""
    name = F.lower(basename(path))
    has = lambda *w: name.rlike("|".join(w))
    csv = name.endswith(".csv")
    return (
        F.when(has("powershell") & has("history", "console"), "powershell_history")
        .when(name.endswith(".reg") | has("registry"), "registry_reg")
        .when(has("sysmon") & csv, "sysmon_csv")
        .when(has("network", "netflow", "conn") & csv, "network_csv")
        .when(has("defender", "av_scan", "antivirus"), "defender_scan")
        .when((has("hash") & has("rep", "virustotal")) | has("reputation"), "hash_reputation")
        .when(has("investigator", "analyst", "notes"), "investigator_notes")
        .when(csv, "generic_csv")
        .when(name.rlike(r"\.(md|markdown)$"), "generic_markdown")
        .otherwise("generic_text")
    )


def event_type(description: Column) -> Column:
    d = F.lower(description)
    return (
        F.when(d.rlike(r"spawn|powershell command|cmd\.exe"), "process_execution")
        .when(d.rlike("connect|outbound|tcp|udp"), "network_connection")
        .when(d.contains("registry value"), "registry_change")
        .when(d.rlike("defender|scan"), "av_scan")
        .when(d.contains("investigator note"), "investigator_note")
        .otherwise("other")
    )


def route(question: Column) -> Column:
    """The answer route of a question; the first condition that holds decides."""
    q = F.lower(question)
    has = lambda *w: F.greatest(*[q.contains(x) for x in w]) if len(w) > 1 else q.contains(w[0])
    return (
        F.when(has("compromise") | (has("overall") & has("assessment")), "compromise")
        .when(has("contradict", "conflict") & has("malware", "claim", "hypothesis", "evidence", "assessment"), "contradiction")
        .when(has("confirm", "is this", "is there", "is it", "before") & has("malware", "malicious", "infected"), "malware")
        .when((has("steal", "stole") & has("data", "file", "document")) | has("exfil", "data theft", "data loss", "data leak"), "exfiltration")
        .when(has("signed", "signature", "authenticode") & has("is", "was", "any", "valid", "digital"), "signature")
        .when(has("which", "what", "list") & has("source", "file") & has("mention", "reference", "about", "touch"), "sources")
        .when(has("persist", "autostart", "run key"), "persistence")
        .when(has("network", "c2", "beacon", "outbound"), "network")
        .when((has("next", "should", "recommend") & has("investigat", "step", "do", "look")) | has("what next"), "next_steps")
        .otherwise("generic")
    )


def query_terms(question: str) -> list[str]:
    """The search tokens of a question, on the driver; a question's repeated terms count again."""
    import re

    return [t for t in (x.lower() for x in re.findall(TOKEN, question)) if t not in SEARCH_STOPWORDS]
