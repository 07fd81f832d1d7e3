"""URLs: canonical form, hosts, registered domains, links of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = frozenset("_ga _gl dclid fbclid gclid gclsrc igshid jsessionid mc_cid mc_eid msclkid phpsessid ref ref_src ref_url referrer scm session_id sessionid sid spm yclid".split())
_UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_PORTS = {"http": "80", "https": "443"}
#: Public suffixes of two labels; all others count as one label.
SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au edu.au co.nz org.nz co.jp ne.jp or.jp ac.jp com.br net.br org.br co.in co.kr or.kr com.cn net.cn org.cn com.mx com.tr com.ar com.sg com.hk com.tw co.za github.io blogspot.com".split())
_LINK = re.compile(r"\[([^\]]*)\]\(\s*([^)\s]+)(?:\s+\"[^\"]*\")?\s*\)")
#: Characters of a path that stay as they are; a path with others is escaped anew.
_PATH = re.compile(r"[A-Za-z0-9\-._~!$&'()*+,;=:@\[\]/%]*")
ANCHOR_CHARS = 120
_AUTO = re.compile(r"<(https?://[^\s>]+)>")
_HREF = re.compile(r"""<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>""", re.I | re.S)


def _escapes(text: str) -> str:
    """Unreserved escapes decoded, the others in capitals."""

    def one(m: re.Match) -> str:
        byte = int(m[1], 16)
        return chr(byte) if byte in _UNRESERVED else m[0].upper()

    return re.sub("%([0-9a-fA-F]{2})", one, text)


def canonical(url: str | None) -> str | None:
    """The canonical form of a web address, null for what isn't one."""
    try:
        parts = urlsplit((url or "").strip())
        port = parts.port
    except ValueError:
        return None
    scheme, host = parts.scheme.lower(), parts.netloc.rpartition("@")[2].lower()
    if scheme not in _PORTS or not host or re.search(r"[\s<>\"]", host) or re.search("%(?![0-9a-fA-F]{2})", parts.path):
        return None
    if port is not None and str(port) == _PORTS[scheme]:
        host = host.rpartition(":")[0]
    raw = parts.path if _PATH.fullmatch(parts.path) else quote(unquote_to_bytes(parts.path), safe="$&+,/:;=@-_.~")
    path: list[str] = []
    for piece in _escapes(raw).split("/"):
        if piece == "..":
            path[-1:] = []
        elif piece not in ("", "."):
            path.append(piece)
    pairs = []
    for pair in _escapes(parts.query).split("&"):
        name, _, value = pair.partition("=")
        low = name.lower()
        if pair and low not in TRACKING and not low.startswith("utm_"):
            pairs.append((name, value, pair))
    query = "&".join(p for _, _, p in sorted(pairs, key=lambda x: x[:2]))
    return f"{scheme}://{host}/{'/'.join(path)}{'?' + query if query else ''}"


def registered_domain(host: str | None) -> str | None:
    """The last two labels of a host, three where the last two are a public suffix."""
    if not host or re.fullmatch(r"[\d.]+", host):
        return host
    labels = host.split(":")[0].split(".")
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in SUFFIXES else labels[-2:])


def _resolved(url: str | None, found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    own, out = canonical(url), []
    for target, label in found:
        try:
            to = canonical(urljoin((url or "").strip(), target.strip()))
        except ValueError:
            continue
        if to and to != own:
            out.append((to, label))
    return out


def _label(text: str) -> str:
    return " ".join(re.sub("<[^>]*>", "", text).split())[:ANCHOR_CHARS].rstrip()


def links(url: str | None, body: str | None, html: bool = False) -> list[tuple[str, str]]:
    """(canonical target, label) of a page's links in order: addresses alone first, then labelled ones; links to itself go."""
    body = body or ""
    found = _HREF.findall(body) if html else [(x, "") for x in _AUTO.findall(body)] + [(x, t) for t, x in _LINK.findall(body)]
    return _resolved(url, [(x, _label(t)) for x, t in found])


def outlinks(url: str | None, body: str | None, html: bool = False) -> list[str]:
    """Canonical targets of a page's links, each once, as first seen."""
    return list(dict.fromkeys(t for t, _ in links(url, body, html)))


def anchor_links(url: str | None, body: str | None, html: bool = False) -> list[tuple[str, str]]:
    """(canonical target, label) of the links that have a label, with repeats."""
    found = _HREF.findall(body or "") if html else [(x, t) for t, x in _LINK.findall(body or "")]
    return _resolved(url, [(x, t) for x, t in ((x, _label(t)) for x, t in found) if t])


def mapped(function, column) -> Column:
    """A column of strings through a function of strings. The UDF is made where a plan is, never when a worker imports this module."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(function)

    return run(column)


def canonical_url(column) -> Column:
    return mapped(canonical, column)


def domain_of(column) -> Column:
    return mapped(registered_domain, column)


def links_udf(html: bool):
    """Column function (url, body) -> array of (target, label)."""

    @F.pandas_udf("array<struct<target:string,label:string>>")
    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for url, body in columns:
            yield pd.Series([[{"target": t, "label": x} for t, x in links(u, b, html)] for u, b in zip(url, body, strict=True)], dtype=object)

    return run


def host(url: Column) -> Column:
    """Lower-case host without its port, by built-in expressions."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")


def doc_identity(canonical_column: Column) -> Column:
    """Identity of a document: the digest of its canonical address."""
    return F.sha2(canonical_column, 256)


def authority(url: Column) -> Column:
    """The host with its port as an address says it; what isn't an address stands for itself. Compaction sorts by it."""
    at = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/?#]+)", 1)
    return F.when(at == "", url).otherwise(at)
