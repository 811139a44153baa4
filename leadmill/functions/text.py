"""Text columns: trimming, addresses, titles, names and other scalars. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill import vocab

_SPACE = r"(?U)^\s+|\s+$"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, _SPACE, "")


def grams(text: Column, n: int) -> Column:
    """The distinct strings of n characters in a text, found in one pass of a pattern."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def literals(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_in(text: Column, tokens: Column) -> Column:
    """Whether a token that isn't empty occurs in the text."""
    return F.coalesce(F.exists(tokens, lambda t: (t != "") & F.contains(text, t)), F.lit(False))


def first_in(text: Column, tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: (t != "") & F.contains(text, t)), F.lit(0))


# Addresses


def extract_domain(url: Column) -> Column:
    """Lower-case network location without ``www.``; empty without a dot. Port and user stay."""
    place = F.regexp_replace(F.lower(strip(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))), r"^www\.", "")
    return F.when(F.contains(place, F.lit(".")), place).otherwise("")


def extract_host(text: Column) -> Column:
    """Host of an address or of bare text, without user and port."""
    rest = F.regexp_replace(strip(text), r"(?s)^.*?//", "")
    head = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.lower(strip(F.substring_index(F.substring_index(head, "@", -1), ":", 1)))


def _labels(domain: Column) -> Column:
    return F.filter(F.split(F.lower(domain), r"\."), lambda p: p != "")


def _last(parts: Column, n: int) -> Column:
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")


def registrable_domain(domain: Column, second: Sequence[str] = vocab.SECOND_LEVEL, countries: Sequence[str] = vocab.COUNTRIES) -> Column:
    """The last two labels, or three under a second-level suffix of a country."""
    parts = _labels(domain)
    deep = F.get(parts, F.size(parts) - 1).isin(*countries) & F.get(parts, F.size(parts) - 2).isin(*second)
    return F.when((F.size(parts) > 2) & F.coalesce(deep, F.lit(False)), _last(parts, 3)).otherwise(_last(parts, 2))


def registrable_domain_listed(host: Column, suffixes: Sequence[str] = vocab.LISTED_SUFFIXES) -> Column:
    """The same by an explicit list of suffixes; scheme, port and ``www.`` are dropped."""
    clean = F.when(F.contains(host, F.lit("//")), extract_host(host)).otherwise(F.lower(strip(host)))
    parts = _labels(F.regexp_replace(F.substring_index(clean, ":", 1), r"^www\.", ""))
    return F.when((F.size(parts) > 2) & _last(parts, 2).isin(*suffixes), _last(parts, 3)).otherwise(_last(parts, 2))


def classify_site(domain: Column, non_company: Sequence[str] = vocab.NON_COMPANY_SITES, directories: Sequence[str] = vocab.DIRECTORY_SITES, registrable=registrable_domain) -> Column:
    """``directory`` by host suffix, tested first, then ``non_company`` by registrable domain, else ``company``."""
    in_directory = reduce(lambda a, b: a | b, [(domain == d) | domain.endswith(f".{d}") for d in directories], F.lit(False))
    return F.when((domain != "") & in_directory, "directory").when((domain != "") & registrable(domain).isin(*non_company), "non_company").otherwise("company")


def is_skippable(host: Column, extra: Sequence[str] = (), skip: Sequence[str] = vocab.SKIP_SITES, suffixes: Sequence[str] = vocab.LISTED_SUFFIXES) -> Column:
    """Whether a host can't be a company's home page; blank ones can't."""
    domain = registrable_domain_listed(host, suffixes)
    return (domain == "") | domain.isin(*skip, *(x.strip().lower() for x in extra if x.strip()))


# Titles and names


def _first_segment(title: Column) -> Column:
    cut = title
    for sep in reversed(vocab.TITLE_SEPARATORS):  # the first separator of the list that occurs wins
        cut = F.when(F.contains(title, F.lit(sep)), F.substring_index(title, sep, 1)).otherwise(cut)
    return strip(cut)


def registrable_label(domain: Column, registrable=registrable_domain) -> Column:
    return F.substring_index(registrable(domain), ".", 1)


def _lead(title: Column) -> Column:
    """What stands before the separator that comes first in the title."""
    separators = "|".join(f"\\Q{s}\\E" for s in vocab.TITLE_SEPARATORS)
    return strip(F.regexp_replace(title, f"(?s)(?:{separators}).*", ""))


def _segment(title: Column) -> Column:
    """The first segment, or the lead where that ends with a company suffix: what is joined behind a whole name says nothing about it."""
    return let(_lead(title), lambda lead: F.when((lead != "") & (_suffix_end(lead) == F.length(lead)), lead).otherwise(_first_segment(title)))


def name_from_title(title: Column, domain: Column, registrable=registrable_domain) -> Column:
    """A company name from a page title, or ``''``: see the three ways in."""
    return let(
        F.struct(_segment(title).alias("segment"), registrable_label(domain, registrable).alias("label")),
        lambda x: let(F.struct(x["segment"].alias("segment"), x["label"].alias("label"), _suffix_end(x["segment"]).alias("end")), lambda y: _title_name(y["segment"], y["label"], y["end"])),
    )


def _suffix_end(segment: Column) -> Column:
    """End of the last company suffix, 0 without one."""
    n = F.length(segment)
    own = [F.when(F.contains(segment, F.lit(s)), n - F.length(F.substring_index(segment, s, -1))).otherwise(0) for s in vocab.ORG_SUFFIXES]
    return F.array_max(F.array(F.lit(0), *own, _last_match_end(segment)))


def _title_name(segment: Column, label: Column, end: Column) -> Column:
    n = F.length(segment)
    fits = (n > 0) & (n <= 40) & (F.size(F.filter(F.split(segment, r"(?U)\s+"), lambda w: w != "")) <= 3) & ~segment.rlike(f"[{vocab.SENTENCE_MARKS}]")
    by_suffix = strip(F.substring(segment, F.lit(1), end))
    flat = F.regexp_replace(F.lower(segment), r"[^0-9a-z\x{4e00}-\x{9fa5}]", "")
    agrees = (F.length(label) >= 4) & (flat != "") & (F.contains(flat, label) | F.contains(label, flat))
    brand = (n <= 12) & any_in(segment, literals(vocab.INDUSTRY_WORDS))
    return F.when(~fits, "").when((end > 0) & (F.length(by_suffix) >= 2), by_suffix).when(brand | agrees, segment).otherwise("")


def _last_match_end(segment: Column) -> Column:
    """End of the last Latin company suffix, 0 without one."""
    head = F.regexp_extract(segment, f"{vocab.LATIN_ORG_TAIL[:5]}^(.*{vocab.LATIN_ORG_TAIL[5:]})", 1)
    return F.length(head)


def name_from_domain(domain: Column, registrable=registrable_domain) -> Column:
    """The registrable label with spaces for hyphens, capitalised; the domain itself if that is blank."""
    name = strip(F.replace(F.substring(registrable_label(domain, registrable), 1, 40), F.lit("-"), F.lit(" ")))
    return F.when(name != "", F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, F.lit(2), F.length(name))))).otherwise(domain)


_NAME_NOISE = r"(?U)[\s\-_.·・]+"


def normalize_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, _NAME_NOISE, ""))


def latin_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def name_forms(names: Column) -> Column:
    """struct(full, tokens) of all forms of the names in an array."""
    given = F.filter(names, lambda n: strip(n) != "")
    cjk = F.transform(F.filter(given, lambda n: n.rlike(CJK)), normalize_name)

    def latin(n: Column) -> Column:
        words = latin_words(n)
        sizes = F.when(F.size(words) >= 2, F.sequence(F.lit(2), F.size(words))).otherwise(F.array().cast("array<int>"))
        starts = F.transform(sizes, lambda k: F.array_join(F.slice(words, F.lit(1), k), ""))
        ends = F.transform(sizes, lambda k: F.array_join(F.slice(words, F.size(words) - k + 1, k), ""))
        whole = F.when(F.size(words) > 0, F.array(F.array_join(F.reverse(words), ""))).otherwise(F.array().cast("array<string>"))
        return F.concat(starts, ends, whole)

    full = F.array_sort(F.array_distinct(F.concat(cjk, F.flatten(F.transform(given, latin)))))
    return F.struct(full.alias("full"), F.array_sort(F.array_distinct(F.flatten(F.transform(given, latin_words)))).alias("tokens"))


def match_name(forms: Column, hints: Column) -> Column:
    """struct(level, hint): the best of full, partial, none over the hints; the first full one wins."""
    full, tokens = forms["full"], forms["tokens"]
    usable = F.filter(hints, lambda h: F.length(normalize_name(h)) >= 2)
    exact = F.get(F.filter(usable, lambda h: F.array_contains(full, normalize_name(h))), F.lit(0))
    part = F.get(
        F.filter(
            usable,
            lambda h: F.when(normalize_name(h).rlike(CJK), F.exists(full, lambda f: F.contains(f, normalize_name(h)))).otherwise(F.array_contains(tokens, normalize_name(h))),
        ),
        F.lit(0),
    )
    return F.struct(
        F.when(exact.isNotNull(), "full").when(part.isNotNull(), "partial").otherwise("none").alias("level"),
        F.coalesce(exact, part, F.lit("")).alias("hint"),
    )


# Fields of records


def registry_fields(content: Column) -> Column:
    """Registered capital, legal representative and founding date from explicit phrases; absent ones left out."""
    found = {
        "registered_capital": strip(F.regexp_extract(content, r"注册资本[为:：]?\s*([0-9][0-9,.]*\s*万?[元人民币]*)", 1)),
        "legal_rep": strip(F.regexp_extract(content, r"法定代表人[为:：]?\s*([\x{4e00}-\x{9fa5}·]{2,5})", 1)),
        "founded": strip(F.regexp_extract(content, r"成立[于日期:：]*\s*(\d{4}[年-]\d{1,2}[月-]\d{1,2}日?)", 1)),
    }
    return F.map_filter(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)]), lambda _, v: v != "")


def employee_range(text: Column) -> Column:
    """struct(low, high) of a size text, null if there is no number; an open end is 10^6."""
    pattern = r"(?U)(\d+)\s*(?:[-–~至]\s*(\d+))?"
    low = F.regexp_extract(text, pattern, 1).try_cast("long")
    high = F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("long"), low)
    return F.when(low.isNotNull(), F.when(F.contains(text, F.lit("上")), F.struct(low.alias("low"), F.lit(vocab.OPEN_END).cast("long").alias("high"))).otherwise(F.struct(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))))


def range_covers(have: Column, low: Column, high: Column, least: float = 0.5) -> Column:
    """Whether half of the range lies inside; ranges that only touch, as single numbers do, never match."""
    overlap = F.least(have["high"], high) - F.greatest(have["low"], low)
    return F.coalesce((overlap > 0) & (overlap >= least * (have["high"] - have["low"])), F.lit(False))


def normalize_funding(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(" "), F.lit("")))


def contact_items(text: Column) -> Column:
    """array<struct<label, email>> of the parts of an official-contact text."""
    parts = F.filter(F.transform(F.split(text, "[;；]"), strip), lambda p: p != "")
    mail = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"

    def item(p: Column) -> Column:
        email = F.regexp_extract(p, mail, 0)
        label = F.when(email != "", F.regexp_replace(strip(F.substring(p, F.lit(1), F.position(email, p) - 1)), "[:：]$", "")).otherwise(p)
        return F.struct(label.alias("label"), email.alias("email"))

    return F.transform(parts, item)


#: What a question starts with, and what it asks for.
_ASKING = ("帮我查一下", "帮我查", "帮我对", "帮我调研", "帮我", "把我查一下", "把我查", "把我", "查询", "分析", "调研", "了解一下", "查一下", "关于", "对")
_TASKS = ("这家公司以及最近的状况", "以及最近的状况", "这家公司", "的背景与业务概览", "公开背景概览", "进行贸易背调", "进行企业背调", "进行背调", "进行调研")


def report_title(query: Column) -> Column:
    """The subject of a question: one leading phrase, all task phrases and one company suffix off, 20 characters."""
    text = strip(query)
    cut = F.regexp_replace(text, f"^(?:{'|'.join(_ASKING)})", "")
    for phrase in _TASKS:
        cut = F.replace(cut, F.lit(phrase), F.lit(""))
    cut = F.regexp_replace(cut, "^[，。？！?! ]+|[，。？！?! ]+$", "")
    cut = F.substring(F.regexp_replace(cut, "(?:股份)?有限公司$", ""), 1, 20)
    return F.when(cut != "", cut).otherwise(F.substring(query, 1, 20))


def report_sections(markdown: Column) -> Column:
    return F.size(F.filter(F.split(markdown, r"\r\n|[\n\r]"), lambda line: line.startswith("## ")))


def as_bool(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin("true", "yes", "1"), F.lit(False))


def stable_seed(text: Column) -> Column:
    return F.crc32(F.encode(text, "utf-8")) % 100000


def dedupe_key(domain: Column, name: Column) -> Column:
    """Lower-cased domain, else lower-cased name."""
    return F.coalesce(blank_to_null(F.lower(strip(domain))), F.lower(strip(name)))


def row_key(primary: Column, name: Column) -> Column:
    """Domain or profile address, else name, as written."""
    return F.coalesce(blank_to_null(strip(primary)), strip(name))


def person_key(source_url: Column, name: Column, company: Column) -> Column:
    return F.coalesce(blank_to_null(F.lower(strip(source_url))), F.lower(F.concat(strip(name), F.lit("@"), strip(company))))


def all_names(name: Column, local: Column, aliases: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(F.array(name, local), aliases), lambda n: strip(n) != ""))


def clean_tags(industry: Column, tags: Column, most: int = 3) -> Column:
    """The main industry, then the first tags, distinct and without blanks."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(industry), F.slice(tags, 1, most)), strip), lambda t: t != ""))


def joined_location(*parts: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(F.array(*parts), strip), lambda p: p != "")), "，")
