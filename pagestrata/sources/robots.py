"""robots.txt: groups, longest-match rules (RFC 9309), and the AI crawlers a file blocks."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

# Product tokens of AI crawlers; a longer file is read up to the limit crawlers honour.
AI_CRAWLERS = ["GPTBot", "OAI-SearchBot", "ChatGPT-User", "Google-Extended", "ClaudeBot", "anthropic-ai", "PerplexityBot", "CCBot", "Bytespider", "Amazonbot", "meta-externalagent"]
LIMIT = 500 * 1024


def _lines(text: str):
    for raw in text.encode("utf-8", "replace")[:LIMIT].decode("utf-8", "ignore").lstrip("﻿").splitlines():
        field, colon, value = raw.split("#", 1)[0].partition(":")
        if colon:
            yield field.strip().lower(), value.strip()


def parse(text: str | None) -> tuple[list[tuple[list[str], list[tuple[bool, str]], float | None]], list[str]]:
    """(groups, sitemaps): a group is its agents in lower case, its rules (allow, path) and its crawl delay."""
    groups: list = []
    sitemaps = []
    agents_open = False
    for field, value in _lines(text or ""):
        if field == "user-agent":
            if not agents_open:
                groups.append([[], [], None])
            groups[-1][0].append(value.lower())
            agents_open = True
        elif field == "sitemap":
            sitemaps.append(value)
        elif groups and field in ("allow", "disallow", "crawl-delay"):
            agents_open = False
            if field == "crawl-delay":
                try:
                    groups[-1][2] = float(value)
                except ValueError:
                    pass
            elif value:
                groups[-1][1].append((field == "allow", value))
    return [tuple(g) for g in groups], sitemaps


def rules_for(text: str | None, agent: str) -> tuple[list[tuple[bool, str]], float | None]:
    """Rules and crawl delay of the groups for a product token, else those for *."""
    groups, _ = parse(text)
    token = agent.lower()
    own = [g for g in groups if token in g[0]] or [g for g in groups if "*" in g[0]]
    return [r for g in own for r in g[1]], next((g[2] for g in own if g[2] is not None), None)


def _matches(pattern: str, path: str) -> bool:
    anchored = pattern.endswith("$")
    parts = (pattern[:-1] if anchored else pattern).split("*")
    return re.match(".*".join(map(re.escape, parts)) + ("$" if anchored else ""), path, re.S) is not None


def is_allowed(text: str | None, agent: str, url: str) -> bool:
    """The longest matching rule decides; allow wins a tie; no rule allows."""
    parts = urlsplit(url)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    if path == "/robots.txt":
        return True
    best = max(((len(p), allow) for allow, p in rules_for(text, agent)[0] if _matches(p, path)), default=(0, True))
    return best[1]


def blocked_ai_crawlers(text: str | None) -> list[str]:
    """AI crawlers the file names in a User-agent line and keeps from the root."""
    named = {value.lower() for field, value in _lines(text or "") if field == "user-agent"}
    return [a for a in AI_CRAWLERS if a.lower() in named and not is_allowed(text, a, "https://site.example/")]
