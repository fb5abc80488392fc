"""Links out of HTML by pattern, as the index defines them: no parser, so anchors in comments and scripts count too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define an anchor and a base element.
ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
BASE = r"""(?is)<base\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# The entities that are decoded, in this order.
ENTITIES = [("&amp;", "&"), ("&#38;", "&"), ("&#x26;", "&"), ("&quot;", '"'), ("&#39;", "'")]


def unquoted(value: Column) -> Column:
    """An attribute value without its pair of quotes."""
    return F.when(value.rlike("(?s)^(\"|')"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def raw_hrefs(html: Column) -> Column:
    """The values of all anchors' href attributes, in order, still quoted."""
    return F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))


def base_href(html: Column) -> Column:
    """The first base element's href, or null."""
    found = F.regexp_extract(html, BASE, 1)
    return F.when(found != "", unquoted(found))


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
