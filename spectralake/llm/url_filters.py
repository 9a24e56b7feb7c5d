"""URL filter: host rules first, then a weighted vocabulary counted by one Aho-Corasick pass.

Rules are (action, host, path): a rule fits its host and every subdomain when the path of the url starts with the
rule's path; the longest rule wins. Urls that no rule fits are judged by the vocabulary: a term counts where no ASCII
letter or digit touches it. One strict term rejects, and so do several distinct soft terms whose weights reach
``threshold``; a soft term counts once however often it stands there.

Nulls and urls without ``://`` have an empty host and path; their whole string is still searched for terms (null: no
term). Repeated rows are judged one by one, an empty table gives an empty table, other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralake.llm.common import enter

# Strict terms reject alone.
STRICT = ("casino", "malware", "phishing", "porn", "porno", "sex", "viagra", "warez", "xxx")
# Soft terms and their weights.
SOFT = {
    "ads": 1.0, "adult": 1.0, "bets": 1.0, "betting": 1.0, "bonus": 1.0, "cheap": 1.0, "clickbait": 1.0, "crack": 1.0,
    "deals": 0.5, "farm": 1.0, "free": 1.0, "gambling": 1.0, "jackpot": 1.0, "keygen": 1.0, "loan": 1.0, "lottery": 1.0,
    "offer": 0.5, "pills": 1.0, "poker": 1.0, "popup": 1.0, "promo": 0.5, "spam": 1.0, "track": 1.0, "tracker": 1.0,
    "win": 1.0,
}
THRESHOLD = 2.0

_automata: dict[tuple, object] = {}


def automaton(strict: tuple[str, ...], soft: tuple[tuple[str, float], ...]):
    import ahocorasick

    key = (strict, soft)
    if key not in _automata:
        a = ahocorasick.Automaton()
        for term, weight in [*((t, None) for t in strict), *soft]:
            a.add_word(term, (term, weight))
        a.make_automaton()
        _automata[key] = a
    return _automata[key]


def _inside(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def hits(url: str | None, strict: tuple[str, ...], soft: tuple[tuple[str, float], ...]) -> tuple[list[str], list[str]]:
    """Distinct strict and soft terms of a url, sorted."""
    found: tuple[set, set] = (set(), set())
    s = (url or "").translate(_LOWER)
    for end, (term, weight) in automaton(strict, soft).iter(s) if s else ():
        start = end - len(term) + 1
        if (start == 0 or not _inside(s[start - 1])) and (end + 1 == len(s) or not _inside(s[end + 1])):
            found[weight is not None].add(term)
    return sorted(found[0]), sorted(found[1])


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; both null without one."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, action = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    key: str = "page_id",
    strict: Iterable[str] = STRICT,
    soft: dict[str, float] = SOFT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each row of ``pages``: key, url, host, path, rule, verdict, strict_hits, soft_hits, soft_weight."""
    strict, terms = tuple(strict), tuple(sorted(soft.items()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("url_filters")
        for b in batches:
            found = [hits(u, strict, terms) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array([x[0] for x in found], pa.list_(pa.string())),
                    pa.array([x[1] for x in found], pa.list_(pa.string())),
                    pa.array([sum(soft[t] for t in x[1]) for x in found], pa.float64()),
                ],
                names=[*b.schema.names, "strict_hits", "soft_hits", "soft_weight"],
            )

    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(key), F.col("url")).select(key, "url", host.alias("host"), path.alias("path"))
    kind = base.schema[key].dataType.simpleString()
    counted = base.mapInArrow(count, f"`{key}` {kind}, url string, host string, path string, strict_hits array<string>, soft_hits array<string>, soft_weight double")
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when((F.size("strict_hits") > 0) | (F.col("soft_weight") >= threshold), "block").otherwise("allow")
    return counted.select(key, "url", "host", "path", name.alias("rule"), F.coalesce(action, method).alias("verdict"), "strict_hits", "soft_hits", "soft_weight")
