"""Url rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import text as T
from gleaner.functions.text import strip, text_or_empty

# scheme, authority, path, query, fragment
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?:(//)([^/?#]*))?([^?#]*)(?:(\?)([^#]*))?(?:#(?s:.*))?\z"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def host(url: Column) -> Column:
    """Authority part (host with port) of a url, empty if it has none."""
    return _part(text_or_empty(url), 3)


def path(url: Column) -> Column:
    return _part(text_or_empty(url), 4)


def query_param(url: Column, name: str) -> Column:
    """First non-empty value of a query parameter, decoded; empty if absent."""
    raw = F.regexp_extract(_part(text_or_empty(url), 6), rf"(?:^|&){name}=([^&]+)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def menu_id(url: Column) -> Column:
    return query_param(url, "mId")


def _remove_dots(p: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    pieces = F.split(p, "/")
    segments = F.slice(pieces, F.lit(2), F.size(pieces))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    # a trailing dot segment stands for a folder
    tail = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(folded, tail), "/"))


def _tidy(p: Column) -> Column:
    return F.when(p.rlike(r"/\.\.?(?:/|\z)"), _remove_dots(p)).otherwise(p)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link as seen from ``base``, without its fragment."""
    parts = T.let(text_or_empty(href), lambda h: F.struct(
        h.alias("all"), *[_part(h, i).alias(n) for i, n in enumerate(
            ["scheme", "slashes", "host", "path", "mark", "query"], 1)]))
    origin = T.let(base, lambda b: F.struct(*[_part(b, i).alias(n) for i, n in (
        (1, "scheme"), (3, "host"), (4, "path"), (5, "mark"), (6, "query"))]))
    return T.let(parts, lambda h: T.let(origin, lambda b: _joined(b, h)))


def _joined(base: Column, ref: Column) -> Column:
    query = F.concat(ref["mark"], ref["query"])
    root = F.concat(base["scheme"], F.lit("://"), base["host"])
    folder = F.when(base["path"] == "", F.lit("/")).otherwise(F.regexp_replace(base["path"], r"[^/]*\z", ""))
    scheme = F.when(ref["scheme"] != "", F.lower(ref["scheme"])).otherwise(base["scheme"])
    return (
        F.when((ref["scheme"] != "") & (F.lower(ref["scheme"]) != F.lower(base["scheme"])),
               F.regexp_replace(ref["all"], r"(?s)#.*\z", ""))
        .when((ref["slashes"] != "") & (ref["host"] != ""), F.concat(scheme, F.lit("://"), ref["host"], ref["path"], query))
        .when((ref["path"] == "") & (ref["mark"] != ""), F.concat(root, base["path"], query))
        .when(ref["path"] == "", F.concat(root, base["path"], base["mark"], base["query"]))
        .when(ref["path"].startswith("/"), F.concat(root, _tidy(ref["path"]), query))
        .otherwise(F.concat(root, _tidy(F.concat(folder, ref["path"])), query))
    )


def normalize_url(base: Column, href: Column, hosts) -> Column:
    """Absolute http(s) url on one of the hosts, else null."""
    unusable = "^(?:" + "|".join(lx.NON_PAGE_SCHEMES) + ")"

    def absolute(link):
        return F.when((link != "") & ~link.rlike(unusable), resolve(base, link))

    def on_host(full):
        return F.when(full.rlike("^https?://") & host(full).isin(*hosts), full)

    return T.let(T.let(strip(text_or_empty(href)), absolute), on_host)


def page_type(url: Column) -> Column:
    lower = F.lower(url)
    out = F.lit("other")
    for word, kind in reversed(lx.PAGE_TYPES):
        out = F.when(lower.contains(word), F.lit(kind)).otherwise(out)
    return out


def top_menu(url: Column, menus: dict[str, str]) -> Column:
    """Name of the top menu a url's menu id belongs to, "기타" if unknown."""
    table = F.create_map(*[F.lit(x) for pair in menus.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring(menu_id(url), 1, 2)), F.lit("기타"))


def listing_url(base: Column, page_no: Column) -> Column:
    joint = F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.when(page_no == 1, base).otherwise(F.concat(base, joint, F.lit("page="), page_no.cast("string")))


def listing_urls(base: Column, pages: int) -> Column:
    """array of the first ``pages`` urls of a listing."""
    return F.transform(F.sequence(F.lit(1), F.lit(pages)), lambda n: listing_url(base, n))


def notice_file_url(href: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    """Only real download paths become urls; script calls and anything else stay empty."""
    h = strip(text_or_empty(href))
    return (
        F.when(h.startswith("http"), h)
        .when(h.startswith("/emwp/"), resolve(F.lit(profile.notice_base_url), h))
        .when(h.startswith("../") | h.startswith("./"), resolve(F.lit(profile.notice_action_url), h))
        .otherwise("")
    )
