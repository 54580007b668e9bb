"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression.  Its literal tokens are derived from its syntax:
runs of letters and digits that the expression itself bounds on both sides, so
that every match shows them as whole tokens of the url.  Each rule is filed under
the one of its tokens (or the alternatives that stand in one place) that is rarest
in the url table; a url's own tokens fetch candidate rules, and only those run
their expression.  Rules without a bounded token run on every url.
Host rules (host suffix plus path prefix) come first: the longest that fits
decides; without one, any matching pattern blocks.

The rule list is a parameter held by each task, bounded by ``MAX_RULES``; token
counts that pick the index come back as one row per rule token.

Defined cases: a null url or one without ``://`` has empty host and path, no rule,
and verdict ``allow`` unless a pattern matches the raw url (null never matches);
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _parser as syntax

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import bound_batches, table

MAX_RULES = 100_000

#: (host, path prefix, verdict)
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Expressions on the lower-cased url.
PATTERNS = (
    r"[?&]utm_[a-z]+=",
    r"[?&]sessionid=",
    r"/wp-login\.php",
    r"/cgi-bin/",
    r"[./-](porn|xxx)[./-]",
    r"/(login|signin)(/|\?|$)",
    r"\.(exe|zip|apk)(\?|#|$)",
    r"//ads?\.",
    r"/tag/[^/?#]+/page/[0-9]+",
    r"[?&]replytocom=[0-9]+",
)

TOKEN = re.compile(r"[a-z0-9]+")
#: Alternatives of one place that are listed at most.
MOST_ALTERNATIVES = 64


def _texts(node) -> set[str] | None:
    """The strings that a node of a parsed expression can match, a line end for ``$``; None if they are not a short list."""
    op, arg = node
    if op is syntax.LITERAL:
        return {chr(arg)}
    if op is syntax.AT and arg is syntax.AT_END:
        return {"\n"}
    if op is syntax.IN and all(k is syntax.LITERAL for k, _ in arg):
        return {chr(c) for _, c in arg}
    if op is syntax.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
        found = _joined(arg[2])
        return None if found is None else found | {""}
    if op is syntax.SUBPATTERN and not arg[1] and not arg[2]:
        return _joined(arg[3])
    if op is syntax.BRANCH:
        found = [_joined(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _texts(node)
        if found is None or len(out) * len(found) > MOST_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in found}
    return out


def _plain(c: str) -> bool:
    return TOKEN.fullmatch(c) is not None


def literal_tokens(expression: str) -> list[tuple[str, ...]]:
    """Places of bounded tokens: any match shows, for each place, one of its tokens as a whole token."""
    parts = [_texts(node) for node in syntax.parse(expression)]
    ends = [p is not None and all(x and not _plain(x[-1]) for x in p) for p in parts]
    begins = [p is not None and all(x and not _plain(x[0]) for x in p) for p in parts]
    out = []
    for i in (k + 1 for k, bounded in enumerate(ends) if bounded):
        tokens = {""}
        for j in range(i, len(parts)):
            if begins[j]:
                if "" not in tokens:
                    out.append(tuple(sorted(tokens)))
                break
            if parts[j] is None or not all(x == "" or _plain(x) for x in parts[j]) or len(tokens) * len(parts[j]) > MOST_ALTERNATIVES:
                break
            tokens = {a + b for a in tokens for b in parts[j]}
    return out


def token_counts(urls: DataFrame, url_col: str, tokens: Sequence[str]) -> dict[str, int]:
    """How many urls hold each literal token of the rules (at most ``MAX_RULES`` rules name a bounded list)."""
    split = F.array_distinct(F.split(F.lower(F.col(url_col)), "[^a-z0-9]+"))
    wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "t string")
    got = urls.select(F.explode(split).alias("t")).join(F.broadcast(wanted), "t").groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in got}


class RuleIndex:
    """Rules by the rarest of their literal tokens; a place with alternatives files the rule under each."""

    def __init__(self, patterns, counts):
        self.rules = [re.compile(p) for p in patterns]
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, p in enumerate(patterns):
            places = literal_tokens(p)
            if not places:
                self.always.append(k)
                continue
            for t in min(places, key=lambda place: (sum(counts.get(t, 0) for t in place), place)):
                self.by_token.setdefault(t, []).append(k)

    def first(self, url: str) -> int | None:
        """The lowest-numbered rule that matches."""
        low = url.lower()
        fetched = set(self.always)
        for t in TOKEN.findall(low):
            fetched.update(self.by_token.get(t, ()))
        return next((k for k in sorted(fetched) if self.rules[k].search(low)), None)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://``, A-Z lower-cased; path up to ``?`` or ``#``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([x for x in map(rest.find, "/?#") if x >= 0], default=len(rest))
    path = rest[cut:]
    end = min([x for x in map(path.find, "?#") if x >= 0], default=len(path))
    return rest[:cut].translate(_ASCII_LOWER), path[:end]


class HostRules:
    """Longest host-suffix and path-prefix rule."""

    def __init__(self, rules):
        self.by_host: dict[str, list] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def best(self, host: str, path: str) -> tuple[str, str] | None:
        found, labels = None, host.split(".")
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for p, verdict in self.by_host.get(suffix, ()):
                if path.startswith(p) and (found is None or len(suffix + p) > len(found[0])):
                    found = (suffix + p, verdict)
        return found


def judge_urls(urls: DataFrame, url_col: str = "url", id_col: str = "page_id", host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """id, host, path, rule, verdict, pattern (the expression that matched, else null)."""
    if len(patterns) + len(host_rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    bound_batches(urls.sparkSession)
    tokens = sorted({t for p in patterns for place in literal_tokens(p) for t in place})
    counts = token_counts(urls, url_col, tokens) if tokens else {}

    def run(batches):
        index, hosts = RuleIndex(patterns, counts), HostRules(host_rules)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                best = hosts.best(host, path)
                hit = None if url is None else index.first(url)
                verdict = best[1] if best else "allow" if hit is None else "block"
                rows.append((host, path, best[0] if best else None, verdict, None if hit is None else patterns[hit]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in cols]], names=[id_col, "host", "path", "rule", "verdict", "pattern"])

    kind = urls.schema[id_col].dataType.simpleString()
    return urls.select(F.col(id_col).alias("c0"), F.col(url_col).alias("c1")).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _any_pattern() -> str:
    low = "lower(url)"
    return " OR ".join(f"regexp_matches({low}, '{p}')" for p in PATTERNS)


def op10_sql() -> str:
    hosts = ", ".join(f"('{h}','{p}','{v}')" for h, p, v in HOST_RULES)
    first = " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{p}'" for p in PATTERNS)
    return f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, p, v) AS (VALUES {hosts}),
m AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, m.rule,
  CASE WHEN m.v IS NOT NULL THEN m.v WHEN {_any_pattern()} THEN 'block' ELSE 'allow' END AS verdict,
  CASE {first} END AS pattern
FROM s LEFT JOIN m USING (page_id)
"""
