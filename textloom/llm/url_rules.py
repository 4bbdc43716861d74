"""URL filters with redirect equivalence. DataFrame functions only.

Longest-match rules give explicit verdicts. Redirects and canonical links make urls aliases; each
connected component takes an explicit allow of any member first, else an explicit block, else the
default, and passes it to members that no rule fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import components, join_hot, materialise, small

# A page is cut from left to right into comments, elements whose content is no markup, and other tags. Every
# alternative goes on to the end of the page where its own end is missing, as browsers do; so none is tried in
# vain, and the cutting takes time in proportion to the page. Quotes count after an equals sign only.
_REST = r"""(?:[^>=]++|=\s*+(?:"(?:[^"]*+"|.*+)|'(?:[^']*+'|.*+))?+)*+(?:>|\z)"""
_RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
MARKUP = rf"(?is)<!--(?:-?>|.*?-->|.*+)|<({_RAW})(?=[\s/>]){_REST}(?:.*?</\1(?=[\s/>])|.*+)|<[a-z/!?]{_REST}"
#: Names and values, quotes included, of a tag's attributes.
_ATTRIBUTES = r"""(?s)([^\s=>/]++)\s*+(?:=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]*+))?+"""
_REFRESH = r"""(?is)^\s*+[\d.]*+\s*+(?:[;,]\s*+)?+(?:url\s*+=\s*+)?+(?:"([^"]*+)|'([^']*+)|([^"'].*+))?+"""
# The characters that HTML has to write by name.
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a url among aliases: scheme and host in lower case, no fragment."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The fitting rule ``host + path`` that is longest, or null; rules: (verdict, host, path)."""
    found = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.lit(h + p)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: list[tuple[str, str, str]]) -> Column:
    allowed = [h + p for v, h, p in rules if v == "allow"]
    return F.when(rule.isin(*allowed), F.lit("allow")).when(rule.isNotNull(), F.lit("block"))


def _once(value: Column, then) -> Column:
    """then(value), where the value is worked out once however often it is used; written out at each place,
    nested expressions would grow beyond any plan."""
    return F.transform(F.array(value), then)[0]


def decoded(value: Column) -> Column:
    """An attribute's value with named and numbered characters in their place; numbers that are no
    character stay as they are written."""

    def one(piece: Column) -> Column:  # what follows an ampersand
        number = F.regexp_extract(piece, r"^#(\d{1,7});", 1)
        coded = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        point = F.when(number != "", number.cast("int")).when(coded != "", F.conv(coded, 16, 10).cast("int"))
        return _once(point, lambda p: written(piece, p))

    def written(piece: Column, point: Column) -> Column:
        fits = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point < 0x110000))
        rest = F.regexp_replace(piece, r"^#[0-9a-zA-Z]+;", "")
        out = F.when(F.coalesce(fits, F.lit(False)), F.concat(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"), rest))
        for name, char in _NAMED.items():
            out = out.when(piece.startswith(f"{name};"), F.concat(F.lit(char), F.substring(piece, F.lit(len(name) + 2), F.length(piece))))
        return out.otherwise(F.concat(F.lit("&"), piece))

    tail = lambda parts: F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return _once(F.split(value, "&", -1), lambda parts: F.concat(parts[0], F.array_join(tail(parts), "")))


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of a tag's first attribute of that name, in any case; null if it has none."""
    body = F.regexp_replace(tag, r"(?is)^<[a-z]+", "")
    names = lambda b: F.transform(F.regexp_extract_all(b, F.lit(_ATTRIBUTES), F.lit(1)), F.lower)
    at = lambda b: F.nullif(F.array_position(names(b), F.lit(name)).cast("int"), F.lit(0))
    raw = _once(body, lambda b: F.try_element_at(F.regexp_extract_all(b, F.lit(_ATTRIBUTES), F.lit(2)), at(b)))
    return decoded(F.regexp_replace(raw, r"""(?s)^(["'])(.*?)\1?$""", "$2"))


def _address(text: Column) -> Column:
    """An address without white space at its ends, tabs and line ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")


_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def plain_path(path: Column) -> Column:
    """A path without the segments ``.`` and ``..``, by RFC 3986. Only a path that has some is folded."""
    return _once(path, _plain_path)


def _plain_path(path: Column) -> Column:
    segments = F.split(F.regexp_replace(path, r"(?<=/)\.{1,2}$", "$0/"), "/", -1)
    drop = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", drop(acc)).otherwise(F.concat(acc, F.array(s))))
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)") & path.startswith("/"), F.array_join(kept, "/")).otherwise(path)


def resolved(base: Column, ref: Column) -> Column:
    """The address that ref means on a page at base, by RFC 3986, without fragment; null where it is none with
    an authority."""
    parts = lambda url: F.struct(*(F.regexp_extract(url, _PARTS, n).alias(f"p{n}") for n in (1, 2, 3, 4)), url.contains("?").alias("asks"))
    return _once(parts(base), lambda b: _once(parts(ref), lambda r: _resolved(b, r)))


def _resolved(base: Column, ref: Column) -> Column:
    part = lambda url, n: url[f"p{n}"]
    scheme, authority, path, query = (part(ref, n) for n in (1, 2, 3, 4))
    own = (scheme != "") | (authority != "")
    folder = F.regexp_extract(part(base, 3), r"(?s)^(.*/)", 1)
    merged = F.when(own | path.startswith("/"), path).when(path == "", part(base, 3)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    asked = F.when((path == "") & (query == "") & ~own & ~ref["asks"], part(base, 4)).otherwise(query)
    place = F.when(own, authority).otherwise(part(base, 2))
    head = F.concat(F.when(scheme != "", scheme).otherwise(part(base, 1)), F.lit(":"), place)
    return F.when(F.length(place) > 2, F.concat(head, plain_path(merged), asked))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``(src, dst)`` of all canonical links and refreshes to another address in a page, resolved
    against its first base address, if it has one. What stands in comments, scripts and the like is no
    link; nor is a refresh without an address, or a link to no host. Null html has none, nor has a
    page whose url is null or without ``://``. A page of any length is cut in time in proportion to it;
    repeated rows give repeated edges, and an empty table none.
    """
    html, url = F.col(html_col), F.col(url_col)
    found = pages.where(html.rlike("(?i)canonical|refresh") & url.contains("://"))
    tags = F.filter(F.regexp_extract_all(html, F.lit(MARKUP), F.lit(0)), lambda t: t.rlike(r"(?i)^<(?:link|meta|base)[\s/>]"))
    found = found.select(url.alias("url"), tags.alias("tags"))
    base = F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: attribute(t, "href")), lambda h: h.isNotNull())
    found = found.select("url", F.try_element_at(base, F.lit(1)).alias("base"), F.explode("tags").alias("tag"))
    rel = F.split(F.lower(F.coalesce(attribute(F.col("tag"), "rel"), F.lit(""))), r"[\t\n\f\r ]+")
    canonical = F.col("tag").rlike("(?i)^<link") & F.array_contains(rel, "canonical")
    fresh = F.col("tag").rlike("(?i)^<meta") & (F.lower(F.trim(F.coalesce(attribute(F.col("tag"), "http-equiv"), F.lit("")))) == "refresh")
    content = attribute(F.col("tag"), "content")
    target = F.concat(*(F.regexp_extract(content, _REFRESH, n) for n in (1, 2, 3)))
    to = _address(F.when(canonical, attribute(F.col("tag"), "href")).when(fresh, target))
    found = materialise(found.select("url", "base", to.alias("to"))).where("to <> ''")
    found = found.withColumn("base", F.coalesce(resolved(F.col("url"), _address(F.col("base"))), F.col("url")))
    found = found.select(node_of(F.col("url")).alias("src"), _once(resolved(F.col("base"), F.col("to")), node_of).alias("dst"))
    return found.where("dst is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: ``(id_col, host, path, rule, verdict)``.

    redirects: further edges ``(src, dst)`` of urls. A null url, or one without ``://``, has empty
    host and path, fits no rule and has no aliases. Repeated rows are judged alike; an empty table
    gives an empty result. Only urls with an edge enter the components; a component's verdict goes
    back by its member's name, by broadcast where the names are small. Beyond that it is a join with
    one row a name on one side, of which adaptive execution splits the pages of one url.
    """
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    found = components(edges.where("src is not null and dst is not null"))
    rule = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    said = found.withColumn("said", verdict_of(rule, rules))
    verdicts = said.groupBy("component").agg(F.max((F.col("said") == "allow").cast("int")).alias("a"), F.max((F.col("said") == "block").cast("int")).alias("b"), F.count(F.lit(1)).alias("n"))
    passed = F.when(F.col("a") == 1, F.lit("allow")).when(F.col("b") == 1, F.lit("block"))
    verdicts = materialise(verdicts)
    total = verdicts.agg(F.sum("n")).first()[0] or 0
    aliases = join_hot(found, verdicts, "component", "n", total).select("node", passed.alias("passed")).where("passed is not null")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.join(small(materialise(aliases)), "node", "left")
    return rows.select(id_col, "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), "passed", F.lit(default)).alias("verdict"))
