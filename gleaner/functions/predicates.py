"""Boolean and scoring rules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import text as T
from gleaner.functions import urls as U

_PHONE = r"[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}"
_WEB = r"https?://|www\."
_COLON = "[:：]"


def _any_of(words) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


# -- urls -------------------------------------------------------------------------------------


def has_allowed_menu(url: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    prefixes = profile.excluded_menu_prefixes

    def allowed(mid):
        excluded = mid.rlike("^" + _any_of(prefixes)) if prefixes else F.lit(False)
        return mid.isin(*profile.forced_menu_ids) | (F.substring(mid, 1, 2).isin(*profile.top_menus) & ~excluded)

    return T.let(U.menu_id(url), allowed)


def is_portal_url(url: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    return U.host(url).isin(*profile.hosts) & U.path(url).startswith("/portal/")


def is_allowed_url(url: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    return T.let(url, lambda u: (
        ~T.any_contains(F.lower(u), lx.DENY_URL_WORDS)
        & is_portal_url(u, profile)
        & T.any_contains(F.lower(u), lx.ALLOWED_PATHS)
        & has_allowed_menu(u, profile)
    ))


def is_recent_year_label(label: Column, year: int = lx.CURRENT_YEAR, span: int = lx.YEAR_MENU_SPAN) -> Column:
    found = T.first_year(label)
    return found.isNull() | found.between(year - span + 1, year)


def should_save(url: Column, label: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE,
                year: int = lx.CURRENT_YEAR) -> Column:
    return (
        is_recent_year_label(label, year)
        & U.page_type(url).isin(*lx.SAVED_PAGE_TYPES)
        & has_allowed_menu(url, profile)
    )


def is_html(content_type: Column) -> Column:
    kind = T.text_or_empty(content_type)
    return (kind == "") | F.lower(kind).contains("text/html")


# -- dates ------------------------------------------------------------------------------------


def is_recent_date(date_text: Column, as_of: str = lx.RECENT_AS_OF, days: int = lx.RECENT_DAYS) -> Column:
    """On or after the cutoff, or not a valid date at all."""
    day = T.parse_date(date_text)
    return day.isNull() | (day >= F.date_sub(F.lit(as_of).cast("date"), days))


def mentions_recent_year(text: Column, min_year: int = lx.FORM_MIN_YEAR) -> Column:
    years = F.regexp_extract_all(T.text_or_empty(text), F.lit(r"(20[0-9]{2})[-.][0-9]{2}[-.][0-9]{2}"), F.lit(1))
    return (F.size(years) == 0) | F.exists(years, lambda y: y.cast("int") >= min_year)


# -- headings and lines -----------------------------------------------------------------------


def looks_like_heading(text: Column) -> Column:
    return T.let(T.clean_inline(text), lambda t: (
        F.length(t).between(2, 30)
        & ~t.rlike(f"{_COLON}|{_PHONE}|{_WEB}")
        & ~T.ends_with_any(t, lx.SENTENCE_ENDINGS)
        & ~T.any_contains(t, lx.HEADING_STOP_WORDS)
    ))


def looks_like_waste_heading(text: Column) -> Column:
    return T.let(T.clean_inline(text), _waste_heading)


def _waste_heading(t: Column) -> Column:
    has_colon = t.rlike(_COLON)
    left = T.strip(F.regexp_extract(t, "^([^:：]*)[:：]", 1))
    right = T.strip(F.regexp_extract(t, "^[^:：]*[:：](.*)", 1))
    colon_title = (
        (F.length(left) > 3)
        & ~T.any_contains(right, lx.WASTE_HEADING_VALUES)
        & ~right.rlike("[0-9]")
        & ((F.length(t) <= 30) | (t.contains("수수료") & t.contains("폐기물")))
    )
    short = (F.size(F.split(t, " ")) <= 5) & (F.length(t) <= 30)
    return (
        F.when(~F.length(t).between(2, 50), False)
        .when(t.rlike(f"{_WEB}|{_PHONE}|^{_any_of(lx.WASTE_HEADING_STARTS)}"), False)
        .when(T.ends_with_any(t, lx.SENTENCE_ENDINGS), False)
        .when(t.isin(*lx.WASTE_HEADING_EXACT), True)
        .when(has_colon, colon_title)
        .when(T.ends_with_any(t, lx.WASTE_HEADING_ENDINGS) | t.endswith("?"), True)
        .otherwise(short)
    )


def is_list_heading(text: Column) -> Column:
    return T.let(T.clean_inline(text), lambda t: (
        F.when(~F.length(t).between(1, 50), False)
        .when(t.rlike(f"{_WEB}|{_PHONE}|^{_any_of(lx.WASTE_HEADING_STARTS)}"), False)
        .when(T.any_contains(t, lx.LIST_HEADING_WORDS) & (F.length(t) > 25), False)
        .when(T.ends_with_any(t, lx.LIST_HEADING_ENDINGS), True)
        .otherwise(F.length(t) <= 20)
    ))


def is_data_line(text: Column) -> Column:
    units = "|".join(lx.COUNTED_UNITS)
    return T.clean_inline(text).rlike(rf"{_COLON}|{_PHONE}|{_WEB}|[0-9]+\s*(?:{units})")


def is_noise_heading(text: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    t = T.clean_inline(text)
    return (t == "") | t.isin(*profile.noise_headings) | t.rlike("<a |</a>|<span|</span>")


def is_real_heading(text: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    t = T.clean_inline(text)
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    return (
        ~is_noise_heading(t, profile)
        & ~is_data_line(t)
        & F.length(t).between(2, 35)
        & ~T.ends_with_any(t, lx.SENTENCE_ENDINGS)
        & ~T.any_contains(padded, lx.REAL_HEADING_BAD_WORDS)
    )


def is_bad_title(title: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    return T.let(T.strip(T.text_or_empty(title)), lambda t: (
        (t == "") | t.isin(*lx.BAD_TITLES) | t.contains(profile.english_name)))


def is_bad_heading(text: Column, page_title: Column) -> Column:
    return T.let(T.clean_inline(text), lambda t: (
        (t == "") | t.isin(*lx.BAD_HEADINGS) | (T.normalize_heading(t) == T.normalize_heading(page_title))))


def is_bad_table_title(text: Column) -> Column:
    t = T.clean_inline(text)
    return (t == "") | t.contains("다운로드") | t.rlike(r"\.(?:hwp|pdf|xlsx|xls)\z") | t.isin("다운로드", "보기", "첨부파일")


# -- links ------------------------------------------------------------------------------------


def has_page_scheme(href: Column) -> Column:
    return ~T.text_or_empty(href).rlike("^(?:javascript:|mailto:|tel:|#)")


def is_valid_shortcut(label: Column, href: Column, url: Column,
                      profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:

    def valid(t, full):
        foreign = (U.host(full) != "") & ~U.host(full).isin(*profile.hosts)
        return (
            (t != "")
            & ~T.any_contains(t, lx.SHORTCUT_DENY)
            & has_page_scheme(href)
            & full.rlike("^https?://")
            & ~t.isin(*lx.SHORTCUT_GENERIC)
            & (T.any_contains(t, lx.SHORTCUT_ALLOW) | foreign)
        )

    return T.let(T.clean_inline(label), lambda t: T.let(T.text_or_empty(url), lambda full: valid(t, full)))


def is_menu_link(href: Column) -> Column:
    h = T.text_or_empty(href)
    return h.contains("/portal/contents.do") & h.contains("mId=")


def is_shortcut_only(label: Column, href: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    full = U.resolve(F.lit(profile.base_url), T.text_or_empty(href))
    return ~is_menu_link(href) & is_valid_shortcut(label, href, full, profile)


def is_shortcut_label(label: Column) -> Column:
    return T.any_contains(T.clean_inline(label), lx.SHORTCUT_LABELS)


# -- documents --------------------------------------------------------------------------------


def is_target_form(title: Column, category: Column, required: Column, notes: Column, text: Column) -> Column:
    joined = F.concat_ws(" ", *[T.text_or_empty(c) for c in (title, category, required, notes, text)])
    return T.any_contains(joined, lx.FORM_TARGET_WORDS)


def is_menu_like(text: Column, signals=None) -> Column:
    """Three or more menu signals, more than 70 % short lines, or no lines at all."""
    hits = T.count_contained(text, signals or lx.DEFAULT_PROFILE.menu_signals)

    def short_lines(found):
        return (F.size(found) == 0) | (F.size(F.filter(found, lambda x: F.length(x) <= 12)) > F.size(found) * 0.70)

    return (hits >= 3) | T.let(T.lines(text), short_lines)


def passes_section_gate(text: Column, block_type: Column, min_length: int = 15, max_bars: int = 2) -> Column:
    t = T.strip(T.text_or_empty(text))
    bars = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    return (
        (F.coalesce(block_type, F.lit("")) != "full_text_backup")
        & (F.length(t) >= min_length)
        & ~t.contains("research_box")
        & (bars <= max_bars)
    )


def long_enough(text: Column, min_length: int) -> Column:
    return F.length(T.text_or_empty(text)) >= min_length


def matches_query(title: Column, body: Column, q: str | None) -> Column:
    if not q:
        return F.lit(True)
    return F.coalesce(title.contains(q), F.lit(False)) | F.coalesce(body.contains(q), F.lit(False))


def offers_attachments(page_type: Column, words=lx.ATTACHMENT_PAGE_WORDS) -> Column:
    return T.any_contains(T.text_or_empty(page_type), words)


def is_own_file_link(url: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    return T.any_contains(url, [profile.source, "/download/"])


# -- scores -----------------------------------------------------------------------------------


def node_score(text: Column, signals=None) -> Column:
    return (
        T.count_contained(text, lx.SECTION_HINTS) * 2
        + F.least(F.floor(F.length(text) / 250), F.lit(8))
        - T.count_contained(text, signals or lx.DEFAULT_PROFILE.menu_signals) * 2
    ).cast("int")


def document_score(url: Column, title: Column, text: Column, n_sections: Column, signals=None) -> Column:
    kind = U.page_type(url)
    size = F.length(text)
    return (
        F.when(kind.isin("bbs_view", "civil_view"), 4).when(kind == "contents", 2).otherwise(0)
        + F.when(F.length(title).between(2, 120), 1).otherwise(0)
        + F.when(size >= 200, 2).otherwise(0)
        + F.when(size >= 500, 2).otherwise(0)
        + F.least(n_sections, F.lit(5))
        + F.when(T.any_contains(text, lx.SECTION_HINTS), 3).otherwise(0)
        - F.when(is_menu_like(text, signals), 5).otherwise(0)
    )
