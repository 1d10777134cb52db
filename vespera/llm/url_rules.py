"""URL filters: pattern rules indexed by their rarest literal token.

A rule's pattern is a text that may hold `*` (any characters), `^` (one character that is not a-z or 0-9, or either end
of the url), `||` at its start (the start of the host, or of a part of it after a dot or hyphen) and `|` at its end (the
end of the url). Its literal tokens are the runs of a-z and 0-9 that every matching url holds as whole tokens: those that
end at another literal, at `^` or at an anchor, not at `*` or an open end. Each rule is filed under the one of its tokens
that the fewest rules (or, if counts are given, the fewest urls) have. A url's tokens fetch the candidate rules; only
those run their regular expression. Rules without such a token are candidates of every url.

Host rules (the list with allow and block) go before pattern rules, the longest host rule wins.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import map_rows

_TOKEN = re.compile(r"[a-z0-9]+")
_CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Host and path prefix rules as stated.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The method's own rules.
PATTERNS = (
    ("block", "^casino^"), ("block", "||adult^"), ("block", "^spam-farm^"), ("block", "||xxx^"), ("block", "^poker-online^"), ("block", "^viagra^"),
    ("block", "/wp-login.php^"), ("block", "/cgi-bin/"),
)
#: Rules that are sent to every task as an index; more of them meet the urls by a join on tokens.
INDEXED_RULES = 100_000


def regex_of(pattern: str) -> str:
    """The regular expression of a pattern, for lower-cased urls."""
    low = pattern.translate(_CAPITALS)
    head, low = (r"^[^:/?#]*://([^/?#]*[.-])?", low[2:]) if low.startswith("||") else ("", low)
    tail, low = ("$", low[:-1]) if low.endswith("|") else ("", low)
    body = "".join(".*" if c == "*" else "(^|[^a-z0-9]|$)" if c == "^" else c if re.match("[a-z0-9]", c) else "\\" + c if ord(c) < 128 else c for c in low)
    return head + body + tail


def literals(pattern: str) -> list[str]:
    """The tokens that every url matching the pattern holds whole."""
    low = pattern.translate(_CAPITALS)
    open_, low = (not low.startswith("||"), low.removeprefix("||"))
    shut, low = (low.endswith("|"), low.removesuffix("|"))
    out = []
    for m in _TOKEN.finditer(low):
        whole_start = low[m.start() - 1] != "*" if m.start() else not open_
        whole_end = low[m.end()] != "*" if m.end() < len(low) else shut
        if whole_start and whole_end:
            out.append(m[0])
    return out


def rarest(rules, uses: dict[str, int] | None = None) -> list[str]:
    """The token under which each rule (verdict, pattern) is filed; empty if it has none. uses: how many urls hold a token."""
    each = [literals(p) for _, p in rules]
    if uses is None:
        uses = Counter(t for ts in each for t in set(ts))
    return [min(ts, key=lambda t: (uses.get(t, 0), -len(t), t)) if ts else "" for ts in each]


def parts(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for null and for a url without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[cut:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:cut].translate(_CAPITALS), path[:end]


class RuleIndex:
    def __init__(self, host_rules=HOST_RULES, patterns=PATTERNS, uses: dict[str, int] | None = None):
        # keyed by host; looked up once for each suffix of a url's host, longest rule text first
        self.hosts: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for verdict, rule in host_rules:
            host, slash, path = rule.partition("/")
            self.hosts[host].append((slash + path, rule, verdict))
        self.by_token: dict[str, list[tuple[re.Pattern, str]]] = defaultdict(list)
        for (verdict, pattern), token in zip(patterns, rarest(patterns, uses)):
            self.by_token[token].append((re.compile(regex_of(pattern), re.DOTALL), verdict))

    def host_rule(self, host: str, path: str) -> tuple[str, str] | None:
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            for prefix, rule, verdict in self.hosts.get(".".join(labels[i:]), ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return best

    def found(self, url: str | None) -> tuple[str, str, str | None, str | None]:
        """Host, path, host rule, and the verdict of that rule or else of the pattern rules (null if none matches)."""
        host, path = parts(url)
        if best := self.host_rule(host, path) if host else None:
            return host, path, *best
        low = (url or "").translate(_CAPITALS)
        hits = {v for t in {"", *_TOKEN.findall(low)} for r, v in self.by_token.get(t, ()) if r.search(low)}
        return host, path, None, "allow" if "allow" in hits else "block" if hits else None

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        *where, verdict = self.found(url)
        return *where, verdict or "allow"


def token_uses(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """token, n: in how many urls each token stands."""
    low = F.translate(F.coalesce(F.col(url_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def by_join(judged: DataFrame, patterns, uses: dict[str, int] | None = None) -> DataFrame:
    """judged (url and RuleIndex.found's columns, by host rules and rules without tokens) with the verdicts of any number of other rules."""
    rows = [(t, regex_of(p), v) for (v, p), t in zip(patterns, rarest(patterns, uses)) if t]
    rules = judged.sparkSession.createDataFrame(rows, "token string, regex string, ruled string")
    low = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    url = judged.where("rule is null and url is not null").select("url", low.alias("low")).distinct()
    tokens = url.select("url", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    hit = tokens.join(rules, "token").where(F.regexp_like("low", F.concat(F.lit("(?s)"), F.col("regex"))))
    said = hit.groupBy("url").agg(F.min("ruled").alias("said"))  # allow before block
    out = judged.join(said, "url", "left")
    verdict = F.when(F.col("rule").isNotNull(), F.col("verdict")).otherwise(F.coalesce(F.least("verdict", "said"), F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS, id_col: str = "page_id", url_col: str = "url", uses: dict[str, int] | None = None, indexed: int = INDEXED_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row. Null or malformed urls: empty host and path, verdict allow.

    Among pattern rules an allow beats any block. Only the two columns are read; repeated rows are each judged. uses: how
    many urls hold a token (token_uses), where the rules' own counts are not to decide which token is the rarest. Up to
    `indexed` pattern rules are sent to every task; more are joined by token, and each distinct url is judged once.
    """
    got = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    small = len(patterns) <= indexed

    def make():
        first = patterns if small else [r for r, t in zip(patterns, rarest(patterns, uses)) if not t]
        index = RuleIndex(host_rules, first, uses)

        def f(ids, urls):
            if small:
                return ids, *([*c] for c in zip(*map(index.judge, urls)))
            return ids, urls, *([*c] for c in zip(*map(index.found, urls)))

        return f

    key = f"page_id {got.schema[0].dataType.simpleString()}, " + "url string, " * (not small)
    out = map_rows(got, make, key + "host string, path string, rule string, verdict string")
    return out if small else by_join(out, patterns, uses)
