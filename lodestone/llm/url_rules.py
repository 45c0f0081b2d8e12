"""URL filters as a sort-merge range join.

A host is written with its labels reversed, each ended by a separator, so that a rule's host is an interval of keys
that holds the host and all its subdomains, and intervals nest or are disjoint. Pages are range-partitioned and sorted
by that key (then path and id, so one busy host spreads over many tasks). Each task sweeps its sorted pages against the
sorted rules and keeps the stack of rules whose intervals are open; a task that begins inside open intervals restores
them from the rules' parents. Path prefixes are looked up by length among the open hosts' rules.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Ends a label in a key; no host of a url holds it.
END = "/"
#: Rules that one sweep holds; more are swept in shards of this size, one after the other over the same sorted pages.
RULES_PER_SWEEP = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_key(host: str) -> str:
    return "".join(label + END for label in reversed(host.split(".")))


class Sweep:
    """Rules by host key, each with the nearest rule host that encloses it."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        by_host: dict[str, dict[str, str]] = {}
        for host, path, verdict in rules:
            if any(c in host for c in "/?#"):  # no host
                continue
            paths = by_host.setdefault(host, {})
            if paths.get(path) != "block":  # of equal rules, block holds
                paths[path] = verdict
        entries = sorted((host_key(h), h, p) for h, p in by_host.items())
        self.keys = [k for k, _, _ in entries]
        self.hosts = [h for _, h, _ in entries]
        self.paths = [p for _, _, p in entries]
        self.lengths = [sorted({len(x) for x in p}, reverse=True) for p in self.paths]
        self.parent: list[int] = []
        stack: list[int] = []
        for i, key in enumerate(self.keys):
            while stack and not key.startswith(self.keys[stack[-1]]):
                stack.pop()
            self.parent.append(stack[-1] if stack else -1)
            stack.append(i)

    def opened(self, key: str) -> tuple[list[int], int]:
        """The stack just before key, and the next rule."""
        at = bisect_right(self.keys, key)
        i, chain = at - 1, []
        while i >= 0 and not key.startswith(self.keys[i]):
            i = self.parent[i]
        while i >= 0:
            chain.append(i)
            i = self.parent[i]
        return chain[::-1], at

    def run(self, rows):
        """For each (key, path) in order: (rule, verdict) of the longest rule that fits, or None."""
        stack, at, begun = [], 0, False
        for key, path in rows:
            if not begun:
                stack, at = self.opened(key)
                begun = True
            while at < len(self.keys) and self.keys[at] <= key:
                while stack and not self.keys[at].startswith(self.keys[stack[-1]]):
                    stack.pop()
                stack.append(at)
                at += 1
            while stack and not key.startswith(self.keys[stack[-1]]):
                stack.pop()
            best = None
            for i in stack:
                for n in self.lengths[i]:
                    if n <= len(path) and (verdict := self.paths[i].get(path[:n])):
                        rank = (len(self.hosts[i]) + n, len(self.hosts[i]))
                        if best is None or rank > best[0]:
                            best = (rank, self.hosts[i] + path[:n], verdict)
                        break
            yield best and best[1:]


def url_parts(url):
    """(host, path) columns of a url column."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    rules: (host, path, verdict). A rule fits its host and all subdomains if the path starts with its path. The longest
    host + path wins, of equal lengths the longer host, of equal rules block. Where none fits, rule is null and the
    verdict is default. A null url, or one without ``://``, has an empty host and path. Rules with a null host or path
    fit nothing. Repeated pages and null ids each keep their row; further columns of pages are left out; no pages or no
    rules are fine.
    """
    host, path = url_parts(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), END), F.lit(END))
    none = F.lit(None).cast("string")
    out = keyed.select("id", "host", "path", key.alias("key"), none.alias("rule"), none.alias("verdict"))
    out = out.repartitionByRange("key", "path", "id").sortWithinPartitions("key", "path", "id")
    schema = out.schema
    for shard in rule_shards(rules):
        sweep = pages.sparkSession.sparkContext.broadcast(Sweep(shard))

        def run(batches, sweep=sweep):
            held = [None]

            def rows():
                for batch in batches:
                    held[0] = batch
                    yield from zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True)

            found: list = []
            current = None
            for got in sweep.value.run(rows()):
                current = held[0]
                found.append(got)
                if len(found) == current.num_rows:
                    yield better(current, found)
                    found = []

        out = out.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rule_shards(rules):
    """Lists of at most RULES_PER_SWEEP rules; only one is on the driver at a time."""
    if isinstance(rules, list):
        for i in range(0, len(rules), RULES_PER_SWEEP):
            yield [r for r in rules[i : i + RULES_PER_SWEEP] if None not in r]
        return
    rules = rules.select("host", "path", "verdict").dropna()
    shards = -(-rules.count() // (RULES_PER_SWEEP // 2))  # hashing does not fill them evenly
    for i in range(shards):
        yield [tuple(r) for r in rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(shards)) == i).collect()]


def better(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    """The batch with what this sweep found, where it beats what earlier ones had."""
    rules, verdicts = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
    for i, got in enumerate(found):
        if got and (rules[i] is None or rank(got) > rank((rules[i], verdicts[i]))):
            rules[i], verdicts[i] = got
    kept = [batch.column(c) for c in ("id", "host", "path", "key")]
    return pa.RecordBatch.from_arrays([*kept, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=batch.schema.names)


def rank(got: tuple[str, str]) -> tuple:
    rule, verdict = got
    return len(rule), rule.index("/") if "/" in rule else len(rule), verdict == "block"


def op4_url_rules(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


OP4_SQL = r"""
WITH p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict FROM p LEFT JOIN r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b
"""
