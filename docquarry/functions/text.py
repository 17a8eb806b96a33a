"""Scalar text functions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode as U

# The white space that the search recognises (a closed list, since the \s of engines differ).
SPACE = r"\t\n\x0B\f\r    -     　﻿"
# The white space of the rules for page text, and what ends a line there.
PAGE_SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LINE_END = r"[\n\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
# What separates query tokens besides white space.
TOKEN_SEPARATORS = ",，、;；"
# Punctuation that the scoped lookups ignore.
LOOKUP_PUNCTUATION = r"，。；：！？、（）「」『』【】《》〈〉／/%％﹪﹖?.,:;()\[\]{}"
# Han characters for layout rules.
HAN = r"㐀-鿿"
# Punctuation beside which layout blanks are dropped.
CJK_PUNCTUATION = "，。；：！？】【、（）「」『』《》〈〉／/%％﹪○"
# Digits before a per cent sign, superscripts, subscripts and circled ones included.
ANY_DIGIT = r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨"
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
# How an item of a list begins.
ITEM_START = (
    r"^(?:[壹貳參肆伍陸柒捌玖拾][、．.]|[一二三四五六七八九十][、．.]|[（(][一二三四五六七八九十0-9０-９]+[）)]"
    r"|[０-９0-9]+[、.．]|※|備註：|附註：|第[一二三四五六七八九十0-9０-９]+[篇章節])"
)
# Chinese numerals of list labels.
NUMERALS = {
    "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12,
    "十三": 13, "十四": 14, "十五": 15, "十六": 16, "十七": 17, "十八": 18, "十九": 19, "二十": 20, "二十一": 21,
    "二十二": 22, "二十三": 23, "二十四": 24,
}


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def bound(values: dict[str, Column], use) -> Column:
    """``use(x)`` where x has each of ``values`` as a field, computed once however often it is used."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use), F.lit(0))


def squeeze(value: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.regexp_replace(F.regexp_replace(value, f"[{SPACE}]+", " "), "^ | $", "")


def normalize(value: Column, nfkc=None) -> Column:
    """Search form: compatibility form (by ``nfkc``, see ``unicode``), small letters, squeezed blanks; null is ''."""
    value = _or_empty(value)
    return squeeze(F.lower(nfkc(value) if nfkc else value))


def canonical_number(value: Column, nfkc=None) -> Column:
    """Document number for search: search form without blanks, in capitals."""
    return F.upper(F.regexp_replace(normalize(value, nfkc), f"[{SPACE}]", ""))


def canonical_source_number(value: Column, nfkc=U.nfkc) -> Column:
    """Document number of an extracted record: compatibility form without blanks and closing kind of letter, letters as they are."""
    value = nfkc(value) if nfkc else value
    return F.regexp_replace(F.regexp_replace(value, f"[{PAGE_SPACE}]+", ""), "(?:函|公告)$", "")


def tokens(normalized: Column) -> Column:
    """Distinct query tokens in their order."""
    return F.array_distinct(F.filter(F.split(normalized, f"[{SPACE}{TOKEN_SEPARATORS}]+"), lambda x: x != ""))


def lookup_form(value: Column) -> Column:
    """Form of the scoped lookups: small letters without blanks and punctuation, no compatibility form."""
    return F.regexp_replace(F.lower(_or_empty(value)), f"[{SPACE}{LOOKUP_PUNCTUATION}]", "")


def digits(value: Column) -> Column:
    return F.regexp_replace(_or_empty(value), "[^0-9]", "")


def official_number(value: Column) -> Column:
    return F.replace(F.replace(lookup_form(value), F.lit("字第"), F.lit("")), F.lit("號"), F.lit(""))


def number_query(value: Column) -> Column:
    """The official number of a query that has six digits in a row, else ''."""
    n = official_number(value)
    return F.when(n.rlike("[0-9]{6,}"), n).otherwise(F.lit(""))


def search_text(value: Column, nfkc=U.nfkc) -> Column:
    """Page text for the index, in compatibility form: no blanks between Han characters, but one where a date meets an
    agency's number across any; others squeezed. A section sign counts as a blank."""
    value = _or_empty(value)
    value = nfkc(value) if nfkc else value
    han, blank = f"[{HAN}]", f"[{PAGE_SPACE}]+"
    value = F.regexp_replace(value, f"(?<!日)(?<={han}){blank}(?={han})|(?<=日){blank}(?!農授金字)(?={han})", "")
    value = F.replace(F.regexp_replace(value, blank, " "), F.lit("§"), F.lit(" "))
    return F.regexp_replace(value, "^ +| +$", "")


def audit_form(value: Column) -> Column:
    """Letters and digits alone, without difference of case (by capitals, so that final and long s count as s; ß is ss)."""
    bare = F.regexp_replace(_or_empty(value), r"(?U)[\W_]+", "")
    return F.lower(F.upper(F.regexp_replace(bare, "[ßẞ]", "ss")))


def ascii_digits(value: Column) -> Column:
    return F.translate(value, FULL_DIGITS, DIGITS)


def compact(value: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(_or_empty(value), f"[{SPACE}]+", "")


def layout_spaces(line: Column) -> Column:
    """Drop the blanks that layout put between Han characters, their punctuation and wide digits, or before per cent."""
    mark = f"{HAN}{CJK_PUNCTUATION}０-９"
    line = F.regexp_replace(line, "日[ \\t\\u3000]+(?=農授金字)", "日")
    line = F.regexp_replace(line, f"(?<=[{mark}])[ \\t\\u3000]+(?=[{mark}])", "")
    line = F.regexp_replace(line, f"(?<=[{ANY_DIGIT}])[ \\t\\u3000]+(?=[％﹪%])", "")
    line = F.regexp_replace(line, "[ \\t\\u3000]+", " ")
    return F.trim(F.replace(line, F.lit(""), F.lit(" ")))


def paragraphs(text: Column) -> Column:
    """Lines joined into paragraphs: a new one after an empty line, after a sentence's end and at an item's start.

    Whether a line begins a paragraph shows from it and the line before, so all breaks are marked in one pass and the
    lines between two breaks are joined: the work grows with the text, not with its square.
    """
    lines = F.transform(F.split(F.regexp_replace(_or_empty(text), "\r\n?", "\n"), "\n", -1), layout_spaces)

    def marked(before: Column, line: Column) -> Column:
        fresh = (before == "") | line.rlike(ITEM_START) | before.rlike("[。！？]$")
        glue = F.when(~fresh & before.rlike("[A-Za-z0-9]$") & line.rlike("^[A-Za-z0-9]"), F.lit(" ")).otherwise(F.lit(""))
        return F.struct(fresh.alias("fresh"), F.concat(glue, line).alias("piece"), (line == "").alias("empty"))

    pairs = bound({"l": lines}, lambda x: F.zip_with(F.concat(F.array(F.lit("")), F.slice(x["l"], F.lit(1), F.size(x["l"]) - 1)), x["l"], marked))
    kept = F.filter(pairs, lambda x: ~x["empty"])

    def joined(x: Column) -> Column:
        n = F.size(x["k"])
        begins = F.filter(F.transform(x["k"], lambda y, i: F.when(y["fresh"], i + 1)), lambda i: i.isNotNull())
        return bound({"k": x["k"], "b": begins, "n": n}, lambda y: F.transform(y["b"], lambda i, j: F.array_join(F.transform(F.slice(y["k"], i, F.coalesce(F.get(y["b"], j + 1), y["n"] + 1) - i), lambda z: z["piece"]), "")))

    return bound({"k": kept}, joined)


def display_text(raw: Column, printed: Column, nfkc_each=U.nfkc_each) -> Column:
    """Page text for readers: the printed page number among the last six lines is dropped (its last occurrence; wide forms
    and blanks inside don't hide it), blank lines at the ends too, and a date keeps its distance from an agency's number."""
    lines = F.split(F.replace(_or_empty(raw), F.lit("\r"), F.lit("\n")), LINE_END, -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    tail = F.slice(lines, F.greatest(F.size(lines) - 5, F.lit(1)), F.lit(6))
    own = printed.cast("string")
    bare = F.transform(nfkc_each(tail), lambda t: F.regexp_replace(t, f"[{PAGE_SPACE}]+", ""))

    def dropped(x: Column) -> Column:
        n = F.size(x["l"])
        hits = F.filter(F.transform(x["t"], lambda t, i: F.when(t == own, i + 1)), lambda i: i.isNotNull())
        at = F.greatest(n - 6, F.lit(0)) + F.array_max(hits)  # null without a hit
        whole = F.transform(x["l"], lambda t: F.regexp_replace(t, f"[{PAGE_SPACE}]+$", ""))
        kept = F.when(at.isNull(), whole).otherwise(F.concat(F.slice(whole, F.lit(1), at - 1), F.slice(whole, at + 1, n)))
        return F.array_join(kept, "\n")

    text = F.regexp_replace(bound({"l": lines, "t": bare}, dropped), "^\n+|\n+$", "")
    return F.replace(text, F.lit("日農授金字"), F.lit("日 農授金字"))


def roc_date(iso: Column) -> Column:
    """A date as year-1911/MM/DD; null if it isn't one."""
    d = F.try_to_date(iso)
    return F.when(d.isNotNull(), F.concat((F.year(d) - 1911).cast("string"), F.lit("/"), F.date_format(d, "MM/dd")))


def roc_year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(date, "([0-9]+)年", 1), F.lit(""))


def period(start: Column, end: Column) -> Column:
    """Application period in words, dates counted as in ``roc_date``; '' if open on both sides."""
    # How a period is told.
    told = "官方資料所載受理期"
    a, b = roc_date(start), roc_date(end)
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit(f"{told}間："), a, F.lit("－"), b))
        .when(b.isNotNull(), F.concat(F.lit(f"{told}限：至 "), b))
        .when(a.isNotNull(), F.concat(F.lit(f"{told}間：自 "), a, F.lit(" 起")))
        .otherwise(F.lit(""))
    )


def event_date(published: Column, effective: Column, version: Column) -> Column:
    return F.coalesce(F.nullif(published, F.lit("")), F.nullif(effective, F.lit("")), version)


def numeral(label: Column) -> Column:
    """Chinese numeral 1 to 24 as an int, null otherwise."""
    return F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])[label]


def heading_trimmed(answer: Column) -> Column:
    """An answer without one short bracketed heading at its end."""
    return F.regexp_replace(answer, "\\s*[（(][^）)]{1,48}[）)]\\s*$", "")


def title_variants(title: Column) -> Column:
    """Spellings under which a form's title may be found: as it is, without attachment number and edition, and both with
    the other name of the form where the title has it."""
    # How attachments are numbered, how editions are told, and the two names of the form.
    blank, number = f"[{PAGE_SPACE}]*", r"\p{Nd}+"
    bare = F.regexp_replace(title, f"^附件(?:{blank}{number})?{blank}[-、,，]?{blank}", "")
    core = F.regexp_replace(bare, f"-{{1,2}}{blank}{number}{blank}版$", "")
    old, new = F.lit("申請書及審核表"), F.lit("申請書及檢核表")
    renamed = F.when(F.contains(title, old), F.array(F.replace(title, old, new), F.replace(core, old, new))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(title, core), renamed))


def numbered(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}-%03d", number)


def sample_of(terms: Column) -> Column:
    """The first three, with a sign that there are more."""
    return F.concat(F.array_join(F.slice(terms, 1, 3), "、"), F.when(F.size(terms) > 3, F.lit("等")).otherwise(F.lit("")))


def printed_page(pdf_page: Column, front: int = 2) -> Column:
    return F.when(pdf_page > front, pdf_page - front)


def page_role(raw: Column) -> Column:
    """interpretation, form or rule by what the page begins with."""
    # Leading labels of letters and forms.
    letters = ("函令摘要", "調整農業天然災害低利貸款利率", "有關")
    forms = ("申請書", "審查表", "政策性農業專案貸款查驗報告表", "受災證明書", "附件")
    c = compact(raw)
    begins = lambda names: F.lit(False) if not names else F.array_contains(F.transform(F.array(*map(F.lit, names)), lambda x: c.startswith(x)), True)
    return F.when(begins(letters), "interpretation").when(begins(forms), "form").otherwise("rule")
