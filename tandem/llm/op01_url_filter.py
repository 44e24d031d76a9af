"""URL filters by rarest-token index (operator 1).

A rule is an action and a pattern ``host/path``: it fits its host and all
subdomains where the url's path starts with the rule's; ``*`` in the path stands
for any run of characters. Every rule becomes one regular expression over
host + path and is indexed under one literal token: the one that fewest urls
contain, counted over the whole table, among the tokens that each matching url
must contain as a whole. A url's tokens fetch candidate rules and only those run
their expressions; the longest rule that fits decides, else the default verdict.

Rules are broadcast in blocks of at most ``block`` rules, a proven bound; more
rules take more passes over the (narrow) host and path columns, with the best
rule so far carried along. Rules without a whole literal token are candidates for
every url. Urls are judged row by row: no shuffle, no hot host.

Defined cases: a null url or one without ``://`` has empty host and path, and no
rule fits it; repeated rows and page_ids are judged alike; empty tables give
empty results; an empty rule list gives the default verdict. Among fitting rules
of equal length the alphabetically first decides.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    action: str   # allow or block
    pattern: str  # host/path, as in "example.com/en/"

    @property
    def regex(self) -> str:
        host, _, path = self.pattern.partition("/")
        tail = ".*".join(re.escape(x) for x in path.split("*"))
        return rf"(?s)(?:[^/]*\.)?{re.escape(host.lower())}/{tail}"

    @property
    def tokens(self) -> set[str]:
        """Tokens that every matching url contains whole: a token that ends the
        pattern or touches a wildcard may go on in the url."""
        host, _, path = self.pattern.partition("/")
        text = f"{host.lower()}/{path}"
        return {m[0] for m in re.finditer(TOKEN, text)
                if m.end() < len(text) and text[m.end()] != "*" and text[m.start() - 1:m.start()] != "*"}


#: The rules of the registered query.
RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """host: after the first :// up to / ? # or end, A-Z lower-cased; path: then up to ? or #."""
    rest = F.substring_index  # only to keep the next lines short
    url = F.coalesce("url", F.lit(""))
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    tail = rest(rest(tail, "?", 1), "#", 1)
    host = rest(tail, "/", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (pages.withColumn("_tail", tail).withColumn("host", lower)
            .withColumn("path", F.expr("substring(_tail, length(host) + 1)")).drop("_tail"))


def token_counts(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many urls contain each wanted token. The rules' tokens go as a table (bounded like the
    rules), and only tokens of urls that meet one are counted, partially in each task."""
    if not wanted:
        return {}
    table = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "token string"))
    tokens = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(f"({TOKEN})")))
    found = (urls.select(F.explode(tokens).alias("token")).join(table, "token", "left_semi")
             .groupBy("token").agg(F.count("*").alias("n")).collect())
    return {r["token"]: r["n"] for r in found}


class RuleIndex:
    """Rules under their rarest token; an expression is compiled when a url first asks for it."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        tokens_of = [rule.tokens for rule in rules]
        shared = Counter(t for tokens in tokens_of for t in tokens)
        for rule, tokens in zip(rules, tokens_of):
            if tokens:  # of tokens in equally many urls, the one that fewest rules have
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), shared[t], t))
                self.by_token.setdefault(rarest, []).append(rule)
            else:
                self.always.append(rule)
        self.token = re.compile(TOKEN)
        self.compiled: dict[Rule, re.Pattern] = {}

    def fits(self, rule: Rule, subject: str) -> bool:
        regex = self.compiled.get(rule)
        if regex is None:
            regex = self.compiled[rule] = re.compile(rule.regex)
        return regex.match(subject) is not None

    def best(self, host: str, path: str, best: tuple[str, str] | None) -> tuple[str, str] | None:
        """(pattern, action) of the longest rule that fits, the one given included."""
        subject = host + path
        candidates = list(self.always)
        for token in set(self.token.findall(subject)):
            candidates += self.by_token.get(token, ())
        for rule in candidates:
            if (best is None or (-len(rule.pattern), rule.pattern) < (-len(best[0]), best[0])) and self.fits(rule, subject):
                best = (rule.pattern, rule.action)
        return best


#: The index a worker process built last, with the name of its rules.
_last: list[tuple[str, RuleIndex]] = []


def _index_of(name: str, shared: Broadcast) -> RuleIndex:
    """The index of the broadcast rules, built once in a worker process."""
    if not _last or _last[0][0] != name:
        _last[:] = [(name, RuleIndex(*shared.value))]
    return _last[0][1]


def _judge(name: str, shared: Broadcast):
    def run(batches):
        index = _index_of(name, shared)
        for batch in batches:
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, action = batch.column("rule").to_pylist(), batch.column("action").to_pylist()
            best = [index.best(h, p, (r, a) if r is not None else None)
                    for h, p, r, a in zip(host, path, rule, action)]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["rule"] = pa.array([b and b[0] for b in best], pa.string())
            columns["action"] = pa.array([b and b[1] for b in best], pa.string())
            yield pa.RecordBatch.from_pydict(columns)
    return run


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow", block: int = 100_000) -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict of every row."""
    rules = list(dict.fromkeys(rules))
    urls = with_host_and_path(pages.select("page_id", "url")).drop("url")
    counts = token_counts(urls, {t for r in rules for t in r.tokens})
    out = urls.withColumn("rule", F.lit(None).cast("string")).withColumn("action", F.lit(None).cast("string"))
    schema = out.schema
    for lo in range(0, len(rules), block):
        some = rules[lo:lo + block]
        own = {t for r in some for t in r.tokens}
        shared = pages.sparkSession.sparkContext.broadcast((some, {t: n for t, n in counts.items() if t in own}))
        out = out.mapInArrow(_judge(uuid.uuid4().hex, shared), schema)
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
