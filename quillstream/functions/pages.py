"""Fetched pages and addresses: titles, links, and which hosts may not be fetched."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions import text as X


def page_title(html: Column) -> Column:
    """The title element's text, collapsed; null when there is none."""
    found = X.collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(found != "", found)


def page_links(html: Column) -> Column:
    """Targets of href attributes, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*["']([^"'#][^"']*)["']"""), 1)


@F.pandas_udf(T.StringType())
def blocked(addresses: pd.Series) -> pd.Series:
    """Why an IP address may not be fetched (private, loopback, link_local, multicast, reserved, invalid); null if it may."""

    def of(a: str | None) -> str | None:
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return "invalid"
        ip = getattr(ip, "ipv4_mapped", None) or ip
        for name in ("loopback", "link_local", "multicast", "unspecified", "reserved", "private"):
            if getattr(ip, f"is_{name}"):
                return name
        return None

    return addresses.map(of)


def local_link(target: Column) -> Column:
    """The path of a link to a sibling file, null for other schemes, absolute, escaped, hidden or non-markdown targets."""
    plain = F.regexp_replace(F.regexp_replace(X.trim(target), r"^<(.*)>$", "$1"), r"#.*$", "")
    bad = plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^[/~]|%|\\|(^|/)\.[^./]|(^|/)\.\.(/|$)") | ~plain.endswith(".md")
    return F.when(~bad, F.regexp_replace(plain, r"^(\./)+", ""))
