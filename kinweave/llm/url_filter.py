"""URL filters: pattern rules indexed by their rarest literal token.

A pattern is written in a small public notation: text matches itself without regard to case,
`*` matches anything, `^` a separator or an end, and `|` at either end anchors the pattern to
the url's start or end. A token of a pattern is a run of letters and digits that every match
must show as a whole url token; of these the one that fewest urls have is the rule's key. A
url's tokens fetch candidate rules, and only those run a regular expression. Rules without
a token are tried on every url."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import fresh, lower_ascii, map_texts

TOKEN = re.compile("[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rules are sent to every task; more of them than this are refused.
MAX_RULES = 200_000


@dataclass(frozen=True)
class HostRule:
    """Fits `host`, of any case, and its subdomains if the path starts with `path`, case included; the longest host + path wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def low_host(self) -> str:
        return self.host.translate(_LOWER)

    def tokens(self) -> list[str]:
        """Host labels and whole parts of the path are url tokens; the path's last, open part is not."""
        path = self.path.translate(_LOWER)
        return TOKEN.findall(self.low_host) + TOKEN.findall(re.sub("[a-z0-9]+$", "", path))


#: The host and path rules of the contract.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: Patterns of unwanted urls.
PATTERNS = (
    "^casino^", "^poker^", "^gambling^", "^lottery^", "^pills^", "^viagra^", "^porn^", "^xxx^", "^adult^", "^escort^",
    "^spam^", "^warez^", "^torrent^", "^payday^loan", "^replica^watch", "^free^download^", "^doubleclick^", "^click^*^redirect^",
    "^utm_source=spam", "^track^*^pixel^", "://ads.", "/ads/*.js^", "^popunder^", "^malware^", "^phishing^",
)


def to_regex(pattern: str) -> str:
    """The pattern as a regular expression, in a form that Python, Java and RE2 share."""
    left, right = pattern.startswith("|"), pattern.endswith("|") and len(pattern) > 1
    body = pattern[left : len(pattern) - right].translate(_LOWER)
    out = []
    for i, c in enumerate(body):
        if c == "*":
            out.append(".*")
        elif c == "^":
            out.append("(^|[^a-z0-9])" if i == 0 and not left else "([^a-z0-9]|$)")
        else:
            out.append(c if re.match("[a-z0-9_/:=&-]", c) else "\\" + c)
    return "(?s)" + "^" * left + "".join(out) + "$" * right


def tokens_of(pattern: str) -> list[str]:
    """Runs of letters and digits bounded on both sides by text, `^` or an anchor, never by `*` or an open end."""
    left, right = pattern.startswith("|"), pattern.endswith("|") and len(pattern) > 1
    body = pattern[left : len(pattern) - right].translate(_LOWER)
    out = []
    for m in TOKEN.finditer(body):
        before = left if m.start() == 0 else body[m.start() - 1] != "*"
        after = right if m.end() == len(body) else body[m.end()] != "*"
        if before and after:
            out.append(m[0])
    return out


def token_counts(pages: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """How many urls show each of the rules' tokens, over all rows; the rows sent back are bounded by the rules."""
    spark = pages.sparkSession
    if not tokens:
        return {}
    wanted = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    split = F.array_distinct(F.split(lower_ascii(F.col(url)), "[^a-z0-9]+"))
    seen = pages.select(F.explode(split).alias("token")).join(F.broadcast(wanted), "token")
    return {r.token: r.n for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


class RuleIndex:
    """Both kinds of rules behind one token lookup."""

    def __init__(self, hosts: tuple[HostRule, ...], patterns: tuple[str, ...], counts: dict[str, int]):
        self.by_token, self.always, self.compiled = defaultdict(list), [], {}
        rarest = lambda tokens: min(tokens, key=lambda t: (counts.get(t, 0), t))
        for p in patterns:
            tokens = tokens_of(p)
            (self.by_token[rarest(tokens)] if tokens else self.always).append((None, p))
        for r in hosts:
            tokens = r.tokens()
            (self.by_token[rarest(tokens)] if tokens else self.always).append((r, r.name))

    def hits(self, pattern: str, low: str) -> bool:
        """A pattern is compiled when a url first asks for it."""
        regex = self.compiled.get(pattern) or self.compiled.setdefault(pattern, re.compile(to_regex(pattern)))
        return regex.search(low) is not None

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """host, path, rule, verdict, pattern."""
        url = url or ""
        at = url.find("://")
        host = path = ""
        if at >= 0:
            rest = url[at + 3 :]
            cut = re.search("[/?#]", rest)
            end = cut.start() if cut else len(rest)
            host = rest[:end].translate(_LOWER)
            path = re.split("[?#]", rest[end:], maxsplit=1)[0]
        low = url.translate(_LOWER)
        rules = list(self.always)
        for t in set(TOKEN.findall(low)):
            rules += self.by_token.get(t, ())
        best, pattern = None, None
        for host_rule, name in rules:
            if host_rule is None:
                if (pattern is None or name < pattern) and self.hits(name, low):
                    pattern = name
            elif f".{host}".endswith(f".{host_rule.low_host}") and path.startswith(host_rule.path):
                best = max(best or host_rule, host_rule, key=lambda r: (len(r.name), r.name))
        verdict = best.verdict if best else "block" if pattern else "allow"
        return host, path, best.name if best else None, verdict, pattern


def read_rules(spark: SparkSession, path: str) -> tuple[tuple[HostRule, ...], tuple[str, ...]]:
    """(host rules, patterns) of a text file: `allow host/path` or `block host/path` a line, any other line is a pattern.
    Empty lines and lines that begin with # are skipped; a file of more than MAX_RULES rules is refused."""
    lines = [r.value.strip() for r in spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").limit(MAX_RULES + 1).collect()]
    _bounded(len(lines))
    hosts, patterns = [], []
    for line in lines:
        verdict, _, name = line.partition(" ")
        if verdict in ("allow", "block") and name.strip():
            host, slash, rest = name.strip().partition("/")
            hosts.append(HostRule(verdict, host, slash + rest))
        else:
            patterns.append(line)
    return tuple(hosts), tuple(patterns)


def _bounded(n: int) -> None:
    if n > MAX_RULES:
        raise ValueError(f"{n} rules; at most {MAX_RULES} can be sent to every task")


def filter_urls(
    pages: DataFrame, url: str = "url", hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[str, ...] = PATTERNS, keep: list[str] | None = None
) -> DataFrame:
    """Append host, path, rule, verdict and pattern (the first pattern in code-point order that hits).

    A null url, or one without `://`, has an empty host and path and no host rule; patterns still
    apply to its text. Rows pass through one to one, repeated ones too; an empty table stays empty; long urls are
    judged whole; rules of one length are told apart by name; names that clash get a trailing _."""
    keep = pages.columns if keep is None else keep
    _bounded(len(hosts) + len(patterns))
    wanted = [t for p in patterns for t in tokens_of(p)] + [t for r in hosts for t in r.tokens()]
    shared = pages.sparkSession.sparkContext.broadcast((hosts, patterns, token_counts(pages, url, wanted)))
    names = fresh(keep, "host", "path", "rule", "verdict", "pattern")

    def kernel():
        index = RuleIndex(*shared.value)
        return lambda urls: [list(c) for c in zip(*map(index.judge, urls))] or [[]] * 5

    return map_texts(pages, url, [T.StructField(n, T.StringType()) for n in names], kernel, keep)
