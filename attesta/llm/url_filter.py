"""Verdicts on URLs: stated rules first, path templates learned from them for the rest.

A rule names a host with its subdomains and the beginning of a path.  URLs that
no rule fits are judged by a tree of path templates, one for each host:

* A segment that looks variable (digits, long hexadecimal words, an extension
  after either) stands as its shape.  Words and extensions that few of the
  node's paths have, below one in ``LITERALS``, stand as a wildcard, so that a
  node has a bounded number of branches.
* Branches of a node are merged where they cannot be told apart: what comes
  next in them (end, shape, word), and what is known of it (blocked, allowed,
  nothing) are counts, compared by a G-test.
* A template is rejected if the smoothed share of blocked paths among its
  labelled ones reaches ``PURITY``.  One without labels has the share one half.

The tree grows by level, all hosts at once.  Paths are counted once however
many pages have them, partial counts meet before a shuffle, and the busiest
branches, bounded in number by their share of the paths, are broadcast, so that
no host is one task's work.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import BROADCAST_BYTES, free_name, stage

#: A branch stands by itself if it has this part of its node's paths at least: one in so many.
LITERALS = 20
#: Levels of a tree; what is left of a longer path is one segment.
LEVELS = 16
#: Blocked and allowed paths that every template is given besides its own.
PRIOR = 1
#: Smoothed share of blocked paths from which a template is rejected.
PURITY = 0.9
#: Chance up to which branches that are alike are told apart.
ALIKE = 0.05
#: Branches with one in so many of all paths are joined by broadcast.
BUSY = 2000
#: Fixed letters of the contract's lower-casing.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a segment is, in this order: its shape or ``w`` for a word.
KINDS = [("end", r"\A\z"), ("<n>", r"\A[0-9]+\z"), ("<x>", r"\A[0-9a-fA-F-]{8,}\z"), ("<n>.", r"\A[0-9]+\.[A-Za-z0-9]{1,5}\z"), ("<x>.", r"\A[0-9a-fA-F-]{8,}\.[A-Za-z0-9]{1,5}\z")]
NEXT = ["none", *[k for k, _ in KINDS], "w"]
KNOWN = ["block", "allow", "nothing"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits. A rule is (verdict, host and path); rules are a stated list, so they stand in the expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    """A variable-looking segment's shape, with its extension; null for a word."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS):
        dotted = kind.endswith(".")
        out = F.when(segment.rlike(pattern), F.concat(F.lit(kind), F.regexp_extract(segment, r"\.([A-Za-z0-9]+)$", 1)) if dotted else F.lit(kind)).otherwise(out)
    return out


def kind(segment: Column) -> Column:
    """Number in NEXT of a segment; null is that there is none."""
    out = F.lit(NEXT.index("w"))
    for k, pattern in reversed(KINDS):
        out = F.when(segment.rlike(pattern), F.lit(NEXT.index(k))).otherwise(out)
    return F.when(segment.isNull(), F.lit(0)).otherwise(out)


def chi_square(df: int, chance: float) -> float:
    """The value that a chi-square variable of ``df`` degrees exceeds with that chance (Wilson and Hilferty)."""
    t = math.sqrt(-2 * math.log(chance))  # the normal quantile, Hastings' fit
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    return df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def alike(a: np.ndarray, b: np.ndarray, chance: float = ALIKE) -> bool:
    """Whether two rows of counts cannot be told apart by a G-test."""
    both = a + b
    some = both > 0
    a, b, both = a[some], b[some], both[some]
    if len(both) < 2:
        return True
    g = 0.0
    for own in (a, b):
        want = both * (own.sum() / both.sum())
        got = own > 0
        g += 2 * float((own[got] * np.log(own[got] / want[got])).sum())
    return g <= chi_square(len(both) - 1, chance)


def merged(names: list[str], counts: np.ndarray, chance: float = ALIKE) -> list[str]:
    """A label for each branch of a node: the joined names of the branches merged with it. The largest come first, and each goes to the first group that it is like."""
    order = sorted(range(len(names)), key=lambda i: (-counts[i].sum(), names[i]))
    groups: list[tuple[list[str], np.ndarray]] = []
    where = {}
    for i in order:
        for j, (own, total) in enumerate(groups):
            if alike(total, counts[i], chance):
                groups[j] = ([*own, names[i]], total + counts[i])
                where[i] = j
                break
        else:
            where[i] = len(groups)
            groups.append(([names[i]], counts[i].copy()))
    labels = ["|".join(sorted(own)) for own, _ in groups]
    return [labels[where[i]] for i in range(len(names))]


def _merge_branches(nodes: DataFrame, chance: float) -> DataFrame:
    """(host, node, branch, label, total paths) of nodes with their branches: at most LITERALS with a share, three plain shapes and three wildcards."""
    size = len(NEXT) * len(KNOWN)

    def run(frames):
        for frame in frames:
            out = []
            for host, node, branches in zip(frame["host"], frame["node"], frame["branches"], strict=True):
                counts = np.zeros((len(branches), size))
                for i, b in enumerate(branches):
                    for place, n in zip(b["at"], b["n"], strict=True):
                        counts[i, place] += n
                names = [b["branch"] for b in branches]
                out += [(host, node, b, label, int(c.sum())) for b, label, c in zip(names, merged(names, counts, chance), counts, strict=True)]
            yield pd.DataFrame(out, columns=["host", "node", "branch", "label", "total"])

    return nodes.mapInPandas(run, "host string, node string, branch string, label string, total bigint")


def _near_join(rows: DataFrame, facts: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row a key with ``total`` rows of it: busy keys, BUSY at most of all rows, by broadcast, the others by shuffle."""
    busy = F.col("total") * BUSY >= total
    often = rows.join(F.broadcast(facts.filter(busy).drop("total")), on, "left")
    got = [c for c in facts.columns if c not in [*on, "total"]]
    seldom = often.filter(F.col(got[0]).isNull()).drop(*got).join(facts.filter(~busy).drop("total"), on, "left")
    return often.filter(F.col(got[0]).isNotNull()).unionByName(seldom)


def templates(paths: DataFrame, levels: int = LEVELS, chance: float = ALIKE) -> DataFrame:
    """(host, path, known, template) of distinct (host, path, known) rows, known being one of KNOWN.

    The first segment of a path is what follows its first slash; an empty path
    is one empty segment.
    """
    cut = F.split(F.regexp_replace("path", "^/", ""), "/", levels)
    at_hand = stage(paths.select("host", "path", "known", F.lit("").alias("node"), cut.alias("rest")))
    done = None
    while total := at_hand.count():
        segment = F.element_at("rest", 1)
        after = F.when(F.size("rest") > 1, F.element_at("rest", 2))
        spot = kind(after) * len(KNOWN) + F.array_position(F.array(*map(F.lit, KNOWN)), F.col("known")).cast("int") - 1
        rows = at_hand.select("host", "path", "known", "node", "rest", F.coalesce(shape(segment), segment).alias("word"), shape(segment).isNotNull().alias("shaped"), spot.alias("at"))
        counts = rows.groupBy("host", "node", "word", "shaped", "at").count()
        words = stage(counts.groupBy("host", "node", "word", "shaped").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("at", "count"))).alias("by")))
        nodes = words.groupBy("host", "node").agg(F.sum("n").alias("paths"), F.count(F.lit(1)).alias("total"))
        told = _near_join(words, stage(nodes), ["host", "node"], words.count())
        # words come from outside: what could pass for a shape or a merged label is escaped
        seldom = F.when(F.col("shaped"), F.regexp_replace("word", r"\..*$", ".*")).otherwise(F.lit("<*>"))
        often = F.when(F.col("shaped"), F.col("word")).otherwise(F.regexp_replace("word", r"([<|\\])", r"\\$1"))
        told = stage(told.withColumn("branch", F.when(F.col("n") * LITERALS >= F.col("paths"), often).otherwise(seldom)))
        branch = told.select("host", "node", "branch", F.explode("by").alias("at", "n")).groupBy("host", "node", "branch", "at").agg(F.sum("n").alias("n"))
        branch = branch.groupBy("host", "node", "branch").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
        labels = stage(_merge_branches(branch.groupBy("host", "node").agg(F.collect_list(F.struct("branch", "at", "n")).alias("branches")), chance))
        grown = _near_join(rows, told.select("host", "node", "word", "shaped", "branch", F.col("n").alias("total")), ["host", "node", "word", "shaped"], total)
        grown = _near_join(grown, labels, ["host", "node", "branch"], total)
        grown = stage(grown.select("host", "path", "known", F.concat_ws("/", "node", "label").alias("node"), F.slice("rest", 2, levels).alias("rest")))
        ended = grown.filter(F.size("rest") == 0).select("host", "path", "known", F.col("node").alias("template"))
        done = ended if done is None else done.unionByName(ended)
        at_hand = grown.filter(F.size("rest") > 0)
    return done if done is not None else paths.withColumn("template", F.lit(""))


def rejected(found: DataFrame, prior: float = PRIOR, purity: float = PURITY) -> DataFrame:
    """(host, template, purity, total) of the templates whose smoothed share of blocked paths reaches ``purity``."""
    count = lambda what: F.sum((F.col("known") == what).cast("bigint"))
    share = (F.col("blocked") + prior) / (F.col("blocked") + F.col("allowed") + 2 * prior)
    tally = found.groupBy("host", "template").agg(count("block").alias("blocked"), count("allow").alias("allowed"), F.count(F.lit(1)).alias("total"))
    return tally.withColumn("purity", share).filter(F.col("purity") >= purity).select("host", "template", "purity", "total")


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", levels: int = LEVELS, prior: float = PRIOR, purity: float = PURITY, chance: float = ALIKE) -> DataFrame:
    """The rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    A rule's verdict holds where one fits; other rows get that of their path's
    template, learned from the paths that rules fit on the same host.  A URL
    that is null or has no ``://`` has an empty host and path.  Repeated rows
    stay and count as one path; all other columns pass through, but for those
    of the four new names, which are replaced; an empty table stays empty.
    """
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col])
    url = F.col(url_col)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    told = pages.withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("rule", rule)
    ruled = verdict
    paths = stage(told.select("host", "path").groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")))
    known = paths.select("host", "path", F.coalesce(ruled, F.lit("nothing")).alias("known"))
    found = templates(known, levels, chance)
    bad = stage(rejected(found, prior, purity).select("host", "template", F.lit(True).alias("bad"), "total"))
    if not bad.limit(1).count():
        return told.withColumn("verdict", F.coalesce(ruled, F.lit("allow")))
    mark = free_name(told.columns, "bad")
    open_paths = found.filter("known = 'nothing'").select("host", "path", "template")
    blocked = _near_join(open_paths, bad, ["host", "template"], paths.count()).filter("bad").join(paths, ["host", "path"])
    blocked = stage(blocked.select("host", "path", F.lit(True).alias(mark), F.col("pages").alias("total")))
    n_bytes = blocked.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    if n_bytes <= BROADCAST_BYTES:
        out = told.join(F.broadcast(blocked.drop("total")), ["host", "path"], "left")
    else:
        out = _near_join(told, blocked, ["host", "path"], told.count())
    return out.withColumn("verdict", F.coalesce(ruled, F.when(F.col(mark), F.lit("block")).otherwise(F.lit("allow")))).select(*told.columns, "verdict")
