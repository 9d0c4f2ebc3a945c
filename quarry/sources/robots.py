"""Whether robots.txt lets an agent fetch a URL: the longest matching rule decides, allow before disallow."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1024)
def groups(content: str) -> tuple[tuple[frozenset[str], tuple[tuple[bool, str], ...]], ...]:
    """(agents, (allowed, pattern) rules) of each group."""
    out: list[tuple[set[str], list[tuple[bool, str]]]] = []
    open_ = False
    for line in content.splitlines():
        field, colon, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if not open_:
                out.append((set(), []))
            out[-1][0].add(value.split("/")[0].strip().lower())
            open_ = True
        elif field in ("allow", "disallow"):
            open_ = False
            if out and value:
                out[-1][1].append((field == "allow", value))
    return tuple((frozenset(a), tuple(r)) for a, r in out)


@lru_cache(maxsize=65536)
def _pattern(rule: str) -> re.Pattern:
    end = rule.endswith("$")
    body = ".*".join(map(re.escape, (rule[:-1] if end else rule).split("*")))
    return re.compile(body + ("$" if end else ""), re.DOTALL)


def allowed(content: str | None, agent: str, url: str) -> bool:
    """Groups that name the agent replace those for all."""
    parts = urlsplit(url)
    place = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    found = groups(content or "")
    own = [r for agents, rules in found if agent.lower() in agents for r in rules]
    named = any(agent.lower() in agents for agents, _ in found)
    rules = own if named else [r for agents, rs in found if "*" in agents for r in rs]
    best = max(((len(p), ok) for ok, p in rules if _pattern(p).match(place)), default=(0, True))
    return best[1]


def robots_allowed(agent: str):
    """A function of two columns, the robots.txt and the URL."""

    @F.arrow_udf(T.BooleanType())
    def run(content: pa.Array, url: pa.Array) -> pa.Array:
        return pa.array([None if u is None else allowed(c, agent, u) for c, u in zip(content.to_pylist(), url.to_pylist(), strict=True)], pa.bool_())

    return run
