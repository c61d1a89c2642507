"""URL functions: host, registrable domain, scheme, resolution."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hosts import host  # noqa: F401  one of these functions

_SPACE = " \t\n\r\f\x0b"


def registrable(name: Column) -> Column:
    """The last two non-empty labels of a host; all of them where there are fewer."""
    labels = F.filter(F.split(F.lower(name), "[.]"), lambda x: x != "")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def is_web(url: Column) -> Column:
    return url.rlike("(?i)^https?://")


def is_third_party(url_host: Column, page_host: Column) -> Column:
    """Neither the page's host nor its registrable domain; without a page host every host is one."""
    return page_host.isNull() | ((url_host != page_host) & (registrable(url_host) != registrable(page_host)))


def _normal(url: str) -> str | None:
    """An absolute URL with lower-case scheme and host, without a default port, and with a path; None if it has no host though it needs one."""
    parts = urlsplit(url)
    scheme = parts.scheme.lower()
    if not scheme:
        return None
    if scheme not in ("http", "https"):
        return url
    name = parts.hostname
    if not name or any(c in name for c in " <>^|%"):
        return None
    port = parts.port
    place = (parts.netloc.rpartition("@")[0] + "@" if "@" in parts.netloc else "") + (f"[{name}]" if ":" in name else name)
    if port is not None and port != {"http": 80, "https": 443}[scheme]:
        place += f":{port}"
    return urlunsplit((scheme, place, (parts.path or "/").replace(" ", "%20"), parts.query.replace(" ", "%20"), parts.fragment))


def resolve(reference: str | None, base: str | None) -> str | None:
    """reference seen from base, as an absolute URL; None where that is none."""
    if reference is None or base is None:
        return None
    try:
        return _normal(urljoin(base.strip(_SPACE), reference.strip(_SPACE)))
    except ValueError:
        return None


def resolve_policy(reference: str | None, base: str | None) -> str | None:
    """Like resolve, for http and https targets only."""
    found = resolve(reference, base)
    return found if found and found.startswith(("http://", "https://")) else None


def resolve_action(action: str | None, base: str | None) -> tuple[str, bool]:
    """A form's target and whether it is encrypted. Without one the page itself is; what can't be resolved stays as it is."""
    action = (action or "").strip(_SPACE)
    if not action:
        page = resolve("", base)
        return "", bool(page and page.startswith("https:"))
    found = resolve(action, base)
    return (action, False) if found is None else (found, found.startswith("https:"))


@F.pandas_udf(T.StringType())
def resolve_policy_url(reference: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve_policy(r, b) for r, b in zip(reference, base)], dtype=object)


def url_key(url: Column) -> Column:
    """What two URLs of the same document have in common: all but the fragment."""
    return F.regexp_replace(url, "#.*$", "")
