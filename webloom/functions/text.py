"""Text expressions: tokens, chunkers, entity patterns, small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = "the a an and or but of in on at to for with by from is are was were be been it its this that as not de la le les des un une et der die das und el los las en".split()

#: Entity patterns, matched without regard to case and line by line.
_HEX, _D = "[0-9a-f]", "[0-9]"
ENTITIES = {
    "ipv4": rf"(?:{_D}{{1,3}}\.){{3}}{_D}{{1,3}}",
    "ipv6": rf"{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{7}}",
    "mac_addr": rf"(?:{_HEX}{{2}}:){{5}}{_HEX}{{2}}",
    "uuid": rf"{_HEX}{{8}}-{_HEX}{{4}}-[1-5]{_HEX}{{3}}-[89ab]{_HEX}{{3}}-{_HEX}{{12}}",
    "html_color_hex": rf"#{_HEX}{{6}}\b",
    "hashtag": r"#[-\w]+",
    "twitter_handle": r"@\w{1,15}",
    "email": r"[-+.\w]+@[-\w]+\.[-.\w]+",
    "url": r"https?://[^<>\s'\"]+",
    "percentage": rf"{_D}+(?:\.{_D}+)?%",
    "number": rf"\b{_D}{{1,3}}(?:[\s.,]{_D}{{3}})*(?:\.{_D}+)?\b",
    "currency": rf"(?:\$|€|£|EUR|USD|RM)\s?{_D}+(?:[,.]{_D}{{2}})?",
    "date_iso": rf"{_D}{{4}}-{_D}{{2}}-{_D}{{2}}",
    "date_us": rf"{_D}{{1,2}}/{_D}{{1,2}}/{_D}{{2,4}}",
    "time_24h": rf"\b(?:2[0-3]|[01]?{_D}):[0-5]{_D}(?:[.:][0-5]{_D})?\b",
    "phone_us": rf"\(?{_D}{{3}}\)?[-. ]?{_D}{{3}}[-. ]?{_D}{{4}}",
    "phone_intl": rf"\+?{_D}[-0-9 .()]{{7,}}{_D}",
    "postal_us": rf"\b{_D}{{5}}(?:-{_D}{{4}})?\b",
    "postal_uk": rf"\b[A-Z]{{1,2}}{_D}[0-9A-Z]? ?{_D}[A-Z]{{2}}\b",
    "iban": rf"[A-Z]{{2}}{_D}{{2}}[0-9A-Z]{{11,30}}",
    "credit_card": rf"\b(?:3[47]{_D}{{13}}|5[1-5]{_D}{{14}}|4{_D}{{12}}(?:{_D}{{3}})?|6(?:5{_D}{{2}}|011){_D}{{12}})\b",
}


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body asks for it: higher-order functions evaluate what stands in them anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column, longer_than: int = 2) -> Column:
    """Lower-cased words between white space, those of few characters left out."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > longer_than)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def without_stop_words(ws: Column, stop: list[str] | None = None) -> Column:
    known = F.array(*map(F.lit, stop or STOP_WORDS))
    return F.filter(ws, lambda w: ~F.array_contains(known, w))


def entities(text: Column, kinds: list[str] | None = None) -> Column:
    """array<struct<label,value>> of the chosen kinds' matches."""
    each = [F.transform(F.regexp_extract_all(text, F.lit("(?im)" + ENTITIES[k]), F.lit(0)), _labelled(k)) for k in kinds or ENTITIES]
    return F.flatten(F.array(*each))


def _labelled(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("label"), v.alias("value"))


# Chunkers give an array of strings; posexplode() it.


def chunk_regex(text: Column, patterns: list[str] | None = None) -> Column:
    """Split by each pattern in turn; empty pieces stay."""
    out = F.array(text)
    for p in patterns or [r"\n\n"]:
        out = F.flatten(F.transform(out, _splitter(p)))
    return out


def _splitter(p: str):
    return lambda x: F.split(x, p, -1)


def chunk_sentences(text: Column) -> Column:
    """Between a full stop, exclamation or question mark and white space; each sentence once, in order."""
    return F.array_distinct(F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != ""))


def chunk_fixed(text: Column, size: int = 100) -> Column:
    none = F.array().cast("array<string>")
    return let(words(text), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(size)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))).otherwise(none))


def chunk_sliding(text: Column, size: int = 100, step: int = 50) -> Column:
    """Windows of size words each step words, and one at the end of the text; a text of size words or fewer is one chunk as it stands."""
    def windows(w: Column) -> Column:
        last = F.greatest(F.size(w) - size, F.lit(0))
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
        return F.when(F.size(w) <= size, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " ")))

    return let(words(text), windows)


def chunk_overlapping(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Windows that share overlap words; the last ends with the text."""
    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - overlap - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(F.size(w) <= size, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " ")))

    return let(words(text), windows)


def chunk_markdown(text: Column) -> Column:
    """Before each heading line."""
    return F.filter(F.split(text, r"(?m)(?=^#{1,6}\s)"), lambda x: F.trim(x) != "")


def merge_chunks(ws: Column, target: int) -> Column:
    """Words dealt to ceil(n / target) chunks of target words; the last takes what is left."""
    def dealt(w: Column) -> Column:
        n = F.greatest(F.ceil(F.size(w) / target).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * target + 1, target), " "))

    return let(ws, dealt)


def trigrams(s: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def text_key(text: Column) -> Column:
    """Lower-cased without white space and anything but ASCII word characters: equal keys are equal chunks."""
    return F.regexp_replace(F.lower(text), r"[\s\W]", "")


def escape_quotes(text: Column) -> Column:
    """With a backslash before each quotation mark and apostrophe."""
    return F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("'"), F.lit("\\'"))


def escape_json(text: Column) -> Column:
    """As the inside of a JSON string: backslashes, quotation marks and control characters escaped."""
    for raw, name in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    rest = F.filter(F.array_distinct(F.split(text, "")), lambda c: c.rlike("^[\\x00-\\x1f]$"))
    return F.aggregate(rest, text, lambda a, c: F.replace(a, c, F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))))


def context_terms(*texts: Column) -> Column:
    """Sorted distinct words of some texts, lower-cased, of more than two characters once punctuation around them is gone."""
    whole = F.lower(F.concat_ws(" ", *texts))
    bare = F.transform(F.split(whole, r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,!?;:"()\[\]{}]+|[.,!?;:"()\[\]{}]+$""", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w: F.length(w) > 2)))


def padded_table(rows: Column) -> Column:
    """The lines of an array of rows of cells as a table of even columns: cells padded to the column's width, a rule after the first row."""

    def lines(r: Column) -> Column:
        widths = F.transform(F.sequence(F.lit(0), F.array_max(F.transform(r, lambda x: F.size(x))) - 1), lambda i: F.array_max(F.transform(r, lambda x: F.length(F.coalesce(F.get(x, i), F.lit(""))))))

        def with_widths(w: Column) -> Column:
            line = lambda x: F.concat(F.lit("| "), F.array_join(F.transform(w, lambda n, i: F.rpad(F.coalesce(F.get(x, i), F.lit("")), n, " ")), " | "), F.lit(" |"))
            rule = F.concat(F.lit("|-"), F.array_join(F.transform(w, lambda n: F.repeat(F.lit("-"), n)), "-|-"), F.lit("-|"))
            own = F.transform(r, line)
            return F.concat(F.slice(own, 1, 1), F.array(rule), F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))))

        return let(widths, with_widths)

    return let(rows, lines)


def xml_tag(text: Column, tag: str) -> Column:
    """The longest content of a tag, trimmed; null without one."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)" + f"</{tag}>"), F.lit(1))
    return F.trim(F.aggregate(found, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a)))


def token_estimate(text: Column) -> Column:
    return F.size(words(text)) * 1.3


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+!])", r"\\$1")


def srcset(value: Column) -> Column:
    """array<struct<url,width>> of a srcset attribute."""
    parts = F.filter(F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\S+)", 1).alias("url"), F.nullif(F.regexp_extract(p, r"\s(\d+)w$", 1), F.lit("")).cast("int").alias("width")))


def duration(seconds: Column) -> Column:
    """H:MM:SS."""
    s = F.floor(seconds).cast("long")
    return F.concat((s / 3600).cast("long").cast("string"), F.lit(":"), F.lpad(((s % 3600) / 60).cast("long").cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def proxy(value: Column) -> Column:
    """`ip:port[:user:password]` as a struct."""
    p = F.split(value, ":")
    return F.struct(F.concat(F.lit("http://"), F.get(p, 0), F.lit(":"), F.get(p, 1)).alias("server"), F.get(p, 2).alias("user"), F.get(p, 3).alias("password"))


def pdf_date(value: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(value, r"D:(\d{14})", 1), F.lit("yyyyMMddHHmmss"))
