"""Text rules as column expressions (string columns in, string or array columns out).

Patterns spell white space out (``_WS``) because Java's ``\\s`` and ``trim`` are ASCII-only while the
rules are defined on Unicode white space.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import lexicon as lx

# \p{Z} is every separator; with the ASCII and control blanks this is exactly lexicon.WS_CHARS
_WS_SET = r"\s\p{Z}\x1c-\x1f\x85"
_WS = f"[{_WS_SET}]"
# every blank but the plain one and the line end; the first set passes over most characters with two comparisons
_ODD_BLANK = r"[[^ -~가-힣]&&[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_DATE = r"(20[0-9]{2})[./-]" + _WS + r"*([0-9]{1,2})[./-]" + _WS + r"*([0-9]{1,2})"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row and stated once in the plan.

    Rules that mention a derived text many times would otherwise multiply it, and do so again each time a
    filter on them is pushed through a projection.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _swap(c: Column, old: str, new: str) -> Column:
    """Plain replacement; much faster than ``translate``, which looks up every character."""
    return F.replace(c, F.lit(old), F.lit(new))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(lx.WS_CHARS))


def any_contains(c: Column, words) -> Column:
    """True if the text holds at least one of the words."""
    pattern = "|".join(re.escape(w) for w in words)
    return c.rlike(pattern) if pattern else F.lit(False)


def count_contained(c: Column, words) -> Column:
    """How many of the words occur in the text (each counted once)."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(c.contains(w), 1).otherwise(0)
    return total


def ends_with_any(c: Column, endings) -> Column:
    return c.rlike("(?:" + "|".join(re.escape(e) for e in endings) + ")\\z")


# -- cleaning ---------------------------------------------------------------------------------


def clean_text(c: Column, *, trailing_blanks: bool = True, carriage_returns: bool = True) -> Column:
    """Collapse blanks and blank-line runs, keep paragraphs apart by exactly one empty line."""
    t = F.regexp_replace(F.replace(text_or_empty(c), F.lit("\xa0"), F.lit(" ")), r"[ \t]+", " ")
    if carriage_returns:
        t = _swap(t, "\r", "\n")
    t = F.regexp_replace(t, r"\n[ \t]*\n+", "\n\n")
    if trailing_blanks:
        t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    return strip(t)


def clean_inline(c: Column) -> Column:
    """Every white-space run becomes one blank; ends stripped."""
    return F.btrim(F.regexp_replace(text_or_empty(c), _WS + "+", " "))


def clean_block(c: Column) -> Column:
    """Clean every line, drop the empty ones."""
    t = F.regexp_replace(_swap(text_or_empty(c), "\r", "\n"), _ODD_BLANK + "+", " ")
    # blanks are single from here on, so one next to a line end is found without a pattern
    t = F.regexp_replace(t, "  +", " ")
    t = _swap(_swap(t, " \n", "\n"), "\n ", "\n")
    return F.btrim(F.regexp_replace(t, "\n\n+", "\n"), F.lit(" \n"))


def clean_block_waste(c: Column) -> Column:
    return remove_noise_lines_waste(clean_block(c))


def lines(c: Column) -> Column:
    """Cleaned, non-empty lines."""
    return F.filter(F.split(clean_block(c), "\n"), lambda x: x != "")


def remove_noise_lines(c: Column, exact=lx.NOISE_EXACT, prefixes=lx.NOISE_PREFIXES, min_length: int = 2) -> Column:
    drop = "^(?:" + "|".join(map(re.escape, prefixes)) + ")|^(?:" + "|".join(map(re.escape, exact)) + ")$"
    # the start of a line tells, with one character more than the longest word has
    start = 1 + max(map(len, [*prefixes, *exact, ""]))
    # a carriage return is white space inside a line here, not a line end
    source = _swap(text_or_empty(c), "\r", " ")
    kept = F.filter(lines(source), lambda x: (F.length(x) >= min_length) & ~F.left(x, F.lit(start)).rlike(drop))
    # joined lines have neither blank ends nor empty lines, unless a bundle is cut out
    return let(F.array_join(kept, "\n"), lambda t: F.when(t.contains(lx.NOISE_BUNDLE_CORE), F.regexp_replace(
        strip(F.regexp_replace(t, lx.NOISE_BUNDLE, "")), r"\n{3,}", "\n\n")).otherwise(t))


def remove_noise_lines_waste(c: Column, exact=lx.WASTE_NOISE_EXACT) -> Column:
    kept = F.filter(lines(c), lambda x: ~x.isin(*exact))
    return F.array_join(kept, "\n")


def drop_junk_lines(c: Column, junk) -> Column:
    """Strip lines, drop empty ones and those holding any junk word anywhere."""
    split = F.transform(F.split(text_or_empty(c), "\n"), strip)
    return F.array_join(F.filter(split, lambda x: (x != "") & ~any_contains(x, junk)), "\n")


def squeeze(c: Column) -> Column:
    """Dedup key: the text without any white space."""
    return F.regexp_replace(text_or_empty(c), _WS + "+", "")


# -- ids --------------------------------------------------------------------------------------


def text_id(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def notice_id(start_url: Column, number: Column) -> Column:
    return text_id(F.concat(start_url, F.lit("#notice-"), number))


def file_doc_id(source: str, file_name: Column) -> Column:
    return text_id(F.concat(F.lit(source + "::"), file_name))


def shortcut_id(source_url: Column, label: Column, url: Column) -> Column:
    return text_id(F.concat(source_url, F.lit("|shortcut|"), label, F.lit("|"), url))


def text_hash(c: Column) -> Column:
    """Hash for change detection; null for empty text."""
    body = strip(text_or_empty(c))
    return F.when(body != "", text_id(body))


# -- dates and numbers ------------------------------------------------------------------------


def _iso(date_source: Column, pattern: str) -> Column:
    part = [F.regexp_extract(date_source, pattern, i) for i in (1, 2, 3)]
    return F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0"))


def normalize_date(c: Column) -> Column:
    """First ``20yy.m.d`` (also / and -) as ``yyyy-mm-dd``; text without a date is returned cleaned."""
    return let(clean_inline(c), lambda t: F.when(t.rlike(_DATE), _iso(t, _DATE)).otherwise(t))


def parse_date(c: Column) -> Column:
    shape = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"
    return let(normalize_date(c), lambda t: F.when(t.rlike(shape), F.try_to_date(t, "y-M-d")))


def normalize_views(c: Column) -> Column:
    digits = F.regexp_extract(text_or_empty(c), r"([0-9][0-9,]*)", 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("bigint")


def first_year(c: Column) -> Column:
    return F.regexp_extract(text_or_empty(c), r"(20[0-9]{2})", 1).try_cast("int")


def filename_to_title(c: Column) -> Column:
    """Drop the extension (a leading dot is part of the name), separators become blanks."""
    stem = F.regexp_replace(c, r"^(.*[^.].*)\.[^.]*\z", "$1")
    return clean_inline(F.translate(stem, "_-", "  "))


# -- labelled fields, spans, titles -----------------------------------------------------------


def _after_label(text: Column, label_pattern: str, value: str) -> tuple[Column, Column]:
    pattern = label_pattern + _WS + "*[:：]?" + _WS + "*" + value
    return text.rlike(pattern), F.regexp_extract(text, pattern, 1)


def labelled_field(text: Column, label_patterns, value: str = r"([^\n]+)", clean=clean_inline) -> Column:
    """Value after the first label (in list order) that matches anywhere; empty if none does.

    White space after the label may cross a line end, so a value on the next line is taken.
    """
    out = F.lit("")
    for label in reversed(list(label_patterns)):
        hit, found = _after_label(text, label, value)
        out = F.when(hit, clean(found)).otherwise(out)
    return out


def notice_field(text: Column, labels) -> Column:
    return labelled_field(text, [re.escape(x) for x in labels])


def page_metadata(text: Column) -> Column:
    """struct(department, date, views) of a page's full text."""
    day = "((?:20[0-9]{2})[./-]" + _WS + "*[0-9]{1,2}[./-]" + _WS + "*[0-9]{1,2})"
    views = labelled_field(text, lx.VIEW_LABELS, "([0-9,]+)", clean=lambda c: c)
    return F.struct(
        labelled_field(text, lx.DEPARTMENT_LABELS, r"([^\n|]+)").alias("department"),
        labelled_field(text, lx.DATE_LABELS, day, clean=normalize_date).alias("date"),
        normalize_views(views).alias("views"),
    )


def waste_metadata(text: Column) -> Column:
    """struct(department, phone, date, views) by the waste pages' looser rules."""
    day = "((?:20[0-9]{2})[./-]" + _WS + "*[0-9]{1,2}[./-]" + _WS + "*[0-9]{1,2})"
    date = labelled_field(text, ["(?:최근업데이트|최종수정일|수정일)"], day, clean=lambda c: c)
    views = labelled_field(text, ["조회수"], "([0-9,]+)", clean=lambda c: c)
    return F.struct(
        labelled_field(text, ["(?:담당부서|부서)"]).alias("department"),
        F.regexp_extract(text, r"(0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4})", 1).alias("phone"),
        F.translate(date, "./", "--").alias("date"),
        F.replace(views, F.lit(","), F.lit("")).alias("views"),
    )


def find(text: Column, word) -> Column:
    """1-based position of a word, 0 if absent."""
    return F.instr(text, word)


def form_fields(body: Column, labels=lx.FORM_LABELS) -> Column:
    """map(label -> text up to the next label). "Next" follows list order, not nearness."""
    t = clean_inline(body)
    values = []
    for i, label in enumerate(labels):
        start = F.instr(t, label)
        rest = F.substr(t, start + F.lit(len(label)))
        end = F.length(rest)
        for later in reversed(labels[i + 1 :]):
            at = F.instr(rest, later)
            end = F.when(at > 0, at - 1).otherwise(end)
        values.append(F.when(start > 0, F.btrim(F.substr(rest, F.lit(1), end))).otherwise(""))
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*values))


def cut_at(text: Column, stops) -> Column:
    """Cut at the first hit of each stop word in turn."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text


def from_first(text: Column, starts) -> Column:
    """Drop what precedes the first start marker (in list order) that occurs."""
    out = text
    for marker in reversed(list(starts)):
        at = F.instr(text, marker)
        out = F.when(at > 0, F.substr(text, at)).otherwise(out)
    return out


def form_body(text: Column, start: str = lx.FORM_LABELS[0], stops=lx.FORM_STOPS) -> Column:
    return clean_inline(cut_at(from_first(text, [start]), stops))


def notice_body(text: Column, starts=lx.BID_STARTS, stops=lx.BID_STOPS) -> Column:
    return clean_text(cut_at(from_first(text, starts), stops), trailing_blanks=False)


def notice_core(body: Column, markers=lx.BID_BODY_MARKERS) -> Column:
    """Keep the first marker (in list order) that occurs plus what follows its last occurrence."""
    t = strip(text_or_empty(body))
    out = t
    for marker in reversed(list(markers)):
        out = F.when(t.contains(marker), F.concat(F.lit(marker), F.substring_index(t, marker, -1))).otherwise(out)
    return out


def form_title(text: Column, noise=lx.FORM_TITLE_NOISE, label: str = lx.FORM_LABELS[0]) -> Column:
    """Last dash-separated part in front of the first label, after removing menu words."""
    t = clean_inline(text)
    for word in noise:
        t = F.replace(t, F.lit(word), F.lit(" "))
    t = clean_inline(t)

    dash = "[-–]"
    lead = F.regexp_extract(t, "민원사무서식" + _WS + "*" + dash + _WS + "*(.+?)" + _WS + "+" + label, 1)
    before = F.substring_index(t, label, 1)
    def last_part(c):
        parts = F.filter(F.transform(F.split(c, dash), strip), lambda p: p != "")
        return F.try_element_at(parts, F.lit(-1))

    lead_last = F.when(lead != "", last_part(lead))
    before_last = last_part(before)
    return F.coalesce(lead_last, before_last, F.lit("제목없음"))


# -- paragraphs and lines ---------------------------------------------------------------------


def paragraphs(c: Column, min_length: int = 20) -> Column:
    """Cleaned paragraphs of at least ``min_length`` characters."""
    parts = F.transform(F.split(text_or_empty(c), r"\n{2,}"), lambda p: clean_text(p))
    return F.filter(parts, lambda p: F.length(p) >= min_length)


def paragraphs_nonblank(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), r"\n{2,}"), lambda p: strip(p) != "")


def nonblank_lines(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), "\n"), lambda p: strip(p) != "")


def key_lines(c: Column, words=lx.KEY_LINE_WORDS) -> Column:
    return F.filter(lines(c), lambda x: any_contains(x, words))


# -- links, headings, display -----------------------------------------------------------------


def distinct_links(links: Column) -> Column:
    """Map semantics on array<struct<text,url>>: a label keeps its first place and its last url."""
    usable = F.filter(
        F.transform(links, lambda x: F.struct(strip(x["text"]).alias("text"), strip(x["url"]).alias("url"))),
        lambda x: (x["text"] != "") & (x["url"] != ""),
    )
    labels = F.array_distinct(F.transform(usable, lambda x: x["text"]))
    return F.transform(labels, lambda label: F.struct(
        label.alias("text"),
        F.element_at(F.filter(usable, lambda x: x["text"] == label), -1)["url"].alias("url"),
    ))


def inject_links(text: Column, links: Column) -> Column:
    """Replace labels by markdown links, in link order, unless that url is linked already."""
    def step(acc, link):
        absent = ~acc.contains(F.concat(F.lit("("), link["url"], F.lit(")")))
        linked = F.concat(F.lit("["), link["text"], F.lit("]("), link["url"], F.lit(")"))
        return F.when(acc.contains(link["text"]) & absent, F.replace(acc, link["text"], linked)).otherwise(acc)

    none = F.coalesce(F.size(links), F.lit(0)) < 1
    return F.when(none, text).otherwise(F.aggregate(distinct_links(links), text, step))


def heading_text(path: Column, title: Column) -> Column:
    """``a > b``, or the title if the path is empty."""
    joined = F.array_join(path, " > ")
    return F.when(F.coalesce(F.size(path), F.lit(0)) > 0, joined).otherwise(title)


def with_heading(heading: Column, text: Column, gap: str = "\n\n") -> Column:
    return F.concat(F.lit("# "), heading, F.lit(gap), text)


def normalize_heading(c: Column) -> Column:
    return squeeze(F.replace(clean_inline(c), F.lit("페가전"), F.lit("폐가전")))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(text_or_empty(c), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_FILE_NAME = r"([^\s/\\]+?\.(?:" + lx.FILE_EXTENSIONS + "))"


def attachment_name(download: Column, title: Column, label: Column, around: Column) -> Column:
    """File name inside the surrounding text, else the first non-empty candidate; buttons and size removed."""
    in_text = F.regexp_extract(around, "(?i)" + _FILE_NAME, 1)
    name = F.coalesce(*[F.nullif(c, F.lit("")) for c in (in_text, download, title, label, around)], F.lit(""))
    name = F.replace(F.replace(clean_inline(name), F.lit("다운로드"), F.lit("")), F.lit("첨부파일"), F.lit(""))
    return clean_inline(drop_size_suffix(strip(name)))


def drop_size_suffix(c: Column, units: str = "KByte|MByte|KB|MB", ignore_case: bool = True) -> Column:
    flag = "(?i)" if ignore_case else ""
    return F.regexp_replace(c, flag + r"\s*\[[0-9.]+\s*(?:" + units + r")\]\s*\z", "")


def file_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?i)\.(" + lx.FILE_EXTENSIONS + ")", 1))


def download_ids(onclick: Column, *, public_variant: bool = True) -> tuple[Column, Column]:
    """The two ids of a download script call (empty if there is none)."""
    name = "fn_egov_downFile(?:_pubc)?" if public_variant else "fn_egov_downFile"
    pattern = name + r"\('([^']+)'\s*,\s*'([^']+)'\)"
    return F.regexp_extract(text_or_empty(onclick), pattern, 1), F.regexp_extract(text_or_empty(onclick), pattern, 2)


def download_url(file_id: Column, file_sn: Column, base: str = lx.DEFAULT_PROFILE.file_down_url) -> Column:
    return F.when(file_id != "", F.concat(F.lit(base + "?atchFileId="), file_id, F.lit("&fileSn="), file_sn)) \
        .otherwise("")


def markdown_links(c: Column) -> Column:
    """array<struct<label,url>> in text order."""
    pattern = F.lit(lx.MARKDOWN_LINK)
    labels = F.regexp_extract_all(text_or_empty(c), pattern, F.lit(1))
    urls = F.regexp_extract_all(text_or_empty(c), pattern, F.lit(2))
    return F.arrays_zip(labels.alias("label"), urls.alias("url"))


def spoken_rules() -> list[tuple[str, str]]:
    """Ordered (pattern, replacement) pairs that turn an answer into text to be read aloud."""
    ws = _WS
    rules = [(r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1")]
    rules += [
        (f"([0-9]+){ws}*[~-]{ws}*([0-9]+){ws}*{unit}", f"$1{unit}에서 $2{unit}") for unit in lx.RANGE_UNITS
    ]
    rules += [
        ("[☎📞📱]", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"`([^`]+)`", "$1"),
        (f"(?m)^#{{1,6}}{ws}+", ""),
        (f"(?m)^{ws}*[-*+]{ws}+", ""),
        (rf"https?://[^{_WS_SET}]+", ""),
        ("[*_~>#]", ""),
    ]
    return rules


def spoken_text(c: Column) -> Column:
    out = text_or_empty(c)
    for pattern, replacement in spoken_rules():
        out = F.regexp_replace(out, pattern, replacement)
    return strip(out)


def resolve_download(url: Column, backend: str = lx.DEFAULT_PROFILE.backend_url) -> Column:
    return F.when(url.contains("FileDown.do"), url).otherwise(F.concat(F.lit(backend), url))
