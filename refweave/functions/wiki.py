"""Which URLs of an encyclopedia are articles, and their titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _part, decoded

# The namespaces whose pages are no articles.
NO_ARTICLES = ["book", "category", "draft", "file", "gadget", "help", "image", "media", "mediawiki", "module", "portal", "project", "special", "talk", "template", "timedtext", "user", "wikipedia"]


def is_article(url: Column) -> Column:
    """A legal URL without query whose path is /wiki/ and a title outside the namespaces above. The host isn't looked at."""
    path = decoded(_part(url, "PATH"))
    title = F.substring(path, F.lit(7), F.length(path))
    space = F.lower(F.trim(F.replace(F.substring_index(title, ":", 1), F.lit("_"), F.lit(" "))))
    named = (F.instr(title, ":") > 1) & space.isin(NO_ARTICLES)
    return F.coalesce(_part(url, "QUERY").isNull() & path.startswith("/wiki/") & (title != "") & ~named, F.lit(False))


def title_of(url: Column) -> Column:
    """What follows /wiki/, decoded (a plus is a blank too), with blanks for underscores; the URL itself without /wiki/."""
    at = F.instr(url, "/wiki/")
    return F.when(at == 0, url).otherwise(F.replace(F.try_url_decode(F.substring(url, at + 6, F.length(url))), F.lit("_"), F.lit(" ")))
