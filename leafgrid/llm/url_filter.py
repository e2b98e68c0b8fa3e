"""URL filters: pattern rules are indexed by their rarest literal token, so a URL runs only the rules it may fit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

TOKENS = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """A rule on urls: ``name`` is what results carry; ``pattern`` is searched in host + path.

    ``literals`` are tokens that any url which fits must contain. ``rank`` decides among rules that fit: the highest
    wins, then the longer host.
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: tuple[int, int] = (0, 0)


def host_rule(verdict: str, where: str) -> Rule:
    """The rule for a host with all its subdomains and a path's beginning, written like ``example.com/en/``."""
    host, slash, path = where.partition("/")
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}"
    tokens = TOKENS.findall(host.lower())
    # The last token of the path may go on in the url, and a host's tokens can't, for labels end at dots.
    inner = [t for t in re.findall(r"(?<=/)([a-z0-9]+)(?=/)", slash + path)]
    return Rule(where, verdict, pattern, tuple(dict.fromkeys(tokens + inner)), (len(where), len(host)))


def split_url(url):
    """Host and path as columns: after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end.

    Both are empty for null and for a url without ://.
    """
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host.alias("host"), path.alias("path")


def judge_urls(pages: DataFrame, rules: list[Rule], fallback: list[Rule] = (), default: str = "allow") -> DataFrame:
    """Each page with the rule that its url fits: page_id, host, path, rule, verdict.

    ``rules`` are the host and path rules, of which the one with the highest rank wins. Where none fits, rule is null
    and the verdict is that of the first pattern in ``fallback`` that fits, else ``default``. All rules are indexed
    together by the literal that is rarest in the pages (then by the alphabet); a rule without literals is tried on
    every url. The rules are the caller's list, which grows with its author and not with the pages; they travel
    with the task.

    A null url has an empty host and path and gets the default. Each row gives a row, repeated rows too. Extra
    columns are left out; an empty table gives an empty table.
    """
    rows = pages.select(F.col("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    rows = rows.select("page_id", *split_url(F.col("url")))
    wanted = sorted({t for r in [*rules, *fallback] for t in r.literals})
    found = F.array_distinct(F.regexp_extract_all(lower_ascii(F.concat("host", "path")), F.lit(TOKENS.pattern), F.lit(0)))
    listed = F.split(F.lit(" ".join(wanted)), " ")
    # Only tokens of rules are counted: one row for each at most.
    counts = {r["token"]: r["n"] for r in rows.select(F.explode(F.array_intersect(found, listed)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = [(r, i >= len(rules), i) for i, r in enumerate([*rules, *fallback])]
    index: dict[str, list[int]] = {}
    for rule, _, i in every:
        index.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t), default=""), []).append(i)
    rules_of = [(r.name, r.verdict, r.pattern, late, r.rank) for r, late, _ in every]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [re.compile(p) for _, _, p, _, _ in rules_of]
        free = index.get("", [])

        def one(host: str, path: str) -> tuple[str | None, str]:
            text = host + path
            tried = {i for t in set(TOKENS.findall(text.translate(LOWER))) for i in index.get(t, ())}
            fits = [i for i in sorted(tried.union(free)) if patterns[i].search(text)]
            own = [i for i in fits if not rules_of[i][3]]
            if own:
                best = max(own, key=lambda i: (rules_of[i][4], -i))
                return rules_of[best][0], rules_of[best][1]
            return None, rules_of[fits[0]][1] if fits else default

        for pdf in batches:
            judged = [one(h, p) for h, p in zip(pdf["host"], pdf["path"], strict=True)]
            yield pdf.assign(rule=pd.Series([a for a, _ in judged], dtype=object, index=pdf.index), verdict=[b for _, b in judged])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


LOWER = {c: c + 32 for c in range(65, 91)}
#: The rules of the contract.
HOST_RULES = [host_rule("allow", "com/"), host_rule("block", "example.com/en/"), host_rule("allow", "www.example.com/en/"), host_rule("block", "net/es/"), host_rule("block", "net/fr/")]
#: What decides where no host rule fits: hosts and paths that mark advertising, tracking or log-in pages, a rule for each word.
FALLBACK_RULES = [
    *(Rule(f"{word} host", "block", rf"^(?:[^/]*\.)?{word}\.", (word,)) for word in ("ads", "adserver", "tracker")),
    *(Rule(f"{word} path", "block", rf"(?s)^[^/]*/(?:.*/)?{word}/", (word,)) for word in ("ads", "adserver", "banner")),
    *(Rule(f"{word} page", "block", rf"(?s)^[^/]*/(?:.*/)?{word}(?:/|\Z)", (word,)) for word in ("login", "signup", "cart", "checkout")),
]
