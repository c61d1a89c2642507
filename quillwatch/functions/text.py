"""Text of HTML pages by pattern replacement: exact on well-formed markup, and inside the JVM.

`operators.html` has a parser for arbitrary markup.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no policy text.
DROPPED = ("script", "style", "noscript", "nav", "footer", "header")
TEXT_CAP = 20_000

#: White space as browsers' regular expressions see it.
SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def visible_text(html: Column, cap: int = TEXT_CAP) -> Column:
    """A page's body without dropped elements, comments and tags, entities decoded, white space collapsed, at most cap code points."""
    body = F.coalesce(html, F.lit(""))
    body = F.regexp_replace(body, "(?s)<!--.*?-->", "")
    body = F.regexp_replace(body, f"(?is)<({'|'.join(DROPPED)})\\b[^>]*>.*?</\\1\\s*>", "")
    body = F.regexp_replace(body, "(?is)^.*?<body[^>]*>", "")
    body = F.regexp_replace(body, "(?is)</body\\s*>.*$", "")
    body = F.regexp_replace(body, "(?s)<[^>]*>", "")
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(character))
    return F.substring(collapse(body), 1, cap)


def shorten(text: Column, limit: int) -> Column:
    """At most limit code points, and an ellipsis where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
