"""URL normalization with the semantics of java.net.URI, as Column expressions.

Spark's parse_url is java.net.URI, so it also says which strings are legal; what RFC 3986 does otherwise (relative queries,
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Schemes that are never links, the longest key, the ports that go without saying.
NO_LINKS = ["javascript", "mailto", "tel", "data", "about", "ftp"]
LONGEST = 2000
DEFAULT_PORTS = {"http": "80", "https": "443"}
# Characters that java.net.URI leaves alone in a path and in a query.
PATH_LEGAL = r"A-Za-z0-9_\-!.~'()*:@&=+$,;/"
QUERY_LEGAL = r"A-Za-z0-9_\-!.~'()*;/?:@&=+$,\[\]"
# The blanks that NFC replaces, en quad and em quad, as a pattern has them.
KEPT_BLANKS = r"\u2000\u2001"


def _part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def trimmed(text: Column) -> Column:
    """Without characters up to the blank at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_usable_href(href: Column) -> Column:
    """Whether a trimmed href may be a link at all: not empty, no mere fragment, none of the NO_LINKS schemes."""
    return (href != "") & ~href.startswith("#") & ~href.rlike(f"(?i)^({'|'.join(NO_LINKS)}):")


def parse_base(url: Column) -> Column:
    """The trimmed URL if it is legal and absolute, else null."""
    clean = trimmed(url)
    return F.when(_part(clean, "PROTOCOL").isNotNull(), clean)


def path_segments(path: Column) -> Column:
    """The segments of a path without "" and ".", each ".." taken back with what it follows; one that follows nothing stays."""
    none = F.array().cast("array<string>")
    up = lambda kept, p: (p == "..") & (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
    add = lambda kept, p: F.when(up(kept, p), F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.concat(kept, F.array(p)))
    return F.aggregate(F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != ".")), none, add)


def joined_path(path: Column, kept: Column) -> Column:
    """A path without "." and "x/.." segments and repeated slashes, from its path_segments; paths without any stay as they are."""
    last = F.when(F.size(kept) > 0, F.element_at(kept, -1)).otherwise("")
    open_end = (path.rlike(r"(^|/)\.?$") | (path.rlike(r"(^|/)\.\.$") & (last != ".."))) & (F.size(kept) > 0)
    text = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"), F.when(open_end, "/").otherwise(""))
    return F.when(path.rlike(r"//|(^|/)\.\.?(/|$)"), text).otherwise(path)


def decoded(raw: Column) -> Column:
    """Percent escapes decoded as UTF-8, bad bytes as U+FFFD; a plus stays."""
    return F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)


def _encoded(text: Column, legal: str) -> Column:
    one = lambda c: F.when(c.rlike(f"^[{legal}]$"), c).otherwise(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))
    return F.when(text.rlike(f"^[{legal}]*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def composed(text: Column) -> Column:
    """NFC, which the JDK applies before it escapes, by the ICU that Spark itself has. Blanks are escaped before composing, so the two
    that NFC would replace stay."""
    one = lambda x: F.when(x.rlike(f"^[{KEPT_BLANKS}]"), x).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False)))
    runs = F.regexp_extract_all(text, F.lit(f"[{KEPT_BLANKS}]+|[^{KEPT_BLANKS}]+"), F.lit(0))
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(runs, one), "")).otherwise(text)


def with_resolved(rows: DataFrame, out: str, href: Column, base: Column | None = None, unicode: bool = True) -> DataFrame:
    """rows and a column out: the canonical absolute form of href against base (absolute, legal or null), or null if it is
    no usable web link.

    Each step refers to the ones before by name, so that no expression is computed twice; all of them run in one stage.
    unicode=False leaves NFC out, and differs only for decomposed characters.
    """
    c = lambda name: F.col(f"__url_{name}")
    empty = F.lit("")
    names = {"scheme": "PROTOCOL", "authority": "AUTHORITY", "host": "HOST", "path": "PATH"}
    steps = {"h": trimmed(href), "b": F.lit(None).cast("string") if base is None else base, "asks": _part(c("h"), "QUERY"), "mark": _part(c("h"), "REF")}
    steps |= {f"own_{k}": _part(c("h"), v) for k, v in names.items()} | {f"base_{k}": _part(c("b"), v) for k, v in names.items()}
    steps["own"] = c("own_scheme").isNotNull() | c("own_authority").isNotNull()
    steps["lone"] = ~c("own") & (c("own_path") == "") & c("asks").isNull() & c("mark").isNotNull()  # a fragment means the base itself
    steps["query"] = F.when(c("lone"), _part(c("b"), "QUERY")).otherwise(c("asks"))
    steps["scheme"] = F.lower(F.coalesce(c("own_scheme"), c("base_scheme")))
    steps["host"] = F.lower(F.when(c("own"), c("own_host")).otherwise(c("base_host")))
    steps["port"] = F.regexp_replace(F.regexp_extract(F.when(c("own"), c("own_authority")).otherwise(c("base_authority")), r":(\d+)$", 1), r"^0+(?=\d)", "")
    steps["folder"] = F.regexp_extract(c("base_path"), r"^(.*/)?", 0)
    steps["merged"] = F.when(c("own_path") == "", c("folder")).otherwise(F.concat(F.when(c("folder") == "", "/").otherwise(c("folder")), c("own_path")))
    steps["kept"] = path_segments(c("merged"))
    steps["raw"] = F.when(c("lone"), c("base_path")).when(c("own") | c("own_path").startswith("/"), c("own_path")).otherwise(joined_path(c("merged"), c("kept")))
    steps["clean"], steps["asked"] = decoded(c("raw")), decoded(c("query"))
    path, query = "clean", "asked"
    if unicode:
        path, query = "clean_nfc", "asked_nfc"
        steps[path], steps[query] = composed(c("clean")), composed(c("asked"))
    steps["shown"] = F.when(c(path) == "", "/").otherwise(c(path))
    default = F.lit(False)
    for name, number in DEFAULT_PORTS.items():
        default = default | ((c("scheme") == name) & (c("port") == number))
    port = F.when((c("port") == "") | default, empty).otherwise(F.concat(F.lit(":"), c("port")))
    tail = F.when(F.coalesce(c(query), empty) == "", empty).otherwise(F.concat(F.lit("?"), _encoded(c(query), QUERY_LEGAL)))
    steps["url"] = F.concat(c("scheme"), F.lit("://"), c("host"), port, _encoded(c("shown"), PATH_LEGAL), tail)
    df = rows.select("*", *(v.alias(f"__url_{k}") for k, v in steps.items()))
    legal = c("own_path").isNotNull() & (c("own_scheme").isNotNull() | c("base_path").isNotNull()) & c("scheme").isin(*DEFAULT_PORTS) & (c("host") != "") & c("shown").startswith("/")
    found = F.when(is_usable_href(c("h")) & legal & (F.length(c("url")) <= LONGEST), c("url"))
    # a generator keeps filters on the result from being pushed into the steps, which would copy them over and over
    return df.select(*(F.col(f"`{x}`") for x in rows.columns if x != out), F.explode_outer(F.array(found)).alias(out))


def host_of(url: Column) -> Column:
    """The lower-cased host, or an empty string."""
    return F.coalesce(F.lower(_part(url, "HOST")), F.lit(""))


def same_site(host_a: Column, host_b: Column) -> Column:
    """Whether two hosts agree but for one leading www."""
    strip = lambda h: F.regexp_replace(h, r"^www\.", "")
    return strip(host_a) == strip(host_b)
