"""Text expressions: all run inside Spark's own engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for Java's regular expressions.
SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def normal_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def bigrams(c: Column) -> Column:
    """The set of character pairs of a normalised title; empty below two characters. The title is normalised once, not for each pair."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    sets = F.transform(F.array(normal_title(F.coalesce(c, F.lit("")))), lambda t: F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs(t))))
    return F.element_at(sets, 1)


def hash_id(c: Column, n: int = 12) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, n)


def clean_url(c: Column) -> Column:
    """Up to the first blank, quote or angle bracket."""
    return F.regexp_extract(c, r"""^([^\s"<>]*)""", 1)


def first_category(url: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The category of the first pattern that the decoded URL holds."""
    decoded = F.coalesce(F.try_url_decode(url), url)
    out = F.lit(default)
    for pattern, category in reversed(rules):
        out = F.when(decoded.contains(pattern), F.lit(category)).otherwise(out)
    return out


def bullets(c: Column, mark: str = "・") -> Column:
    """Summary text as a bullet per line: text with two marks or more is split at them, other text stays."""
    parts = F.filter(F.transform(F.split(c, mark), strip), lambda x: x != "")
    many = (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))) >= 2
    return F.when(c.isNull(), "").when(many & strip(c).startswith(mark), F.array_join(F.transform(parts, lambda x: F.concat(F.lit(mark), x)), "\n")).otherwise(strip(c))


def summary_points(c: Column) -> Column:
    """The points of a summary, split at marks and line ends."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[・\n]"), strip), lambda x: x != "")


def string_list(c: Column, limit: int, width: int = 24) -> Column:
    """Distinct items between commas of any kind and line ends: no hash mark in front, blanks squeezed, cut at width."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), "[,，、\n]"), lambda x: F.substring(squeeze(F.regexp_replace(strip(x), "^#+", "")), 1, width))
    return F.slice(F.array_distinct(F.filter(items, lambda x: x != "")), 1, limit)


def unquoted(c: Column) -> Column:
    """Blanks squeezed, without quotes around."""
    return strip(F.regexp_replace(squeeze(c), "^[\"'“”「」『』]+|[\"'“”「」『』]+$", ""))


def key_sentences(items: Column, limit: int = 2, least: int = 8, most: int = 120, clean: Callable[[Column], Column] = unquoted) -> Column:
    """Distinct sentences of fitting length, each as `clean` leaves it."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, clean), lambda x: (F.length(x) >= least) & (F.length(x) <= most))), 1, limit)


def sentences(c: Column) -> Column:
    """Bullets if there are two marks or more, else sentences after their closing marks."""
    many = (F.length(c) - F.length(F.replace(c, F.lit("・"), F.lit("")))) >= 2
    return F.filter(F.transform(F.when(many, F.split(c, "・")).otherwise(F.split(c, r"(?<=[。！？；])\s*")), strip), lambda x: x != "")


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def has_cjk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[㐀-鿿豈-﫿]")


def without_fence(c: Column) -> Column:
    """A model's answer without a code fence around it."""
    return F.regexp_replace(strip(c), r"(?s)^```\w*\s*|\s*```$", "")


def json_object(c: Column) -> Column:
    """The widest brace-delimited part of an answer."""
    return F.regexp_extract(without_fence(c), r"(?s)(\{.*\})", 1)


def json_array(c: Column) -> Column:
    return F.regexp_extract(without_fence(c), r"(?s)(\[.*\])", 1)


def signature(key: Column, ids: Column, n: int) -> Column:
    """Short digest of a group's key and members, whatever their order."""
    return F.substring(F.md5(F.concat_ws("|", key, F.array_join(F.sort_array(ids), "|")).cast("binary")), 1, n)


def quality_bucket(chars: Column) -> Column:
    return F.when(chars >= 1200, 3).when(chars >= 500, 2).when(chars >= 150, 1).otherwise(0)


def read_minutes(chars: Column) -> Column:
    return F.when(chars > 0, F.greatest(F.lit(1), F.floor(chars / 500 + 0.5))).otherwise(0).cast("int")


def score_class(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 5, "mid").otherwise("low")


def is_site(url: Column, part: str, source: Column | None = None, prefix: str | None = None) -> Column:
    """Whether a lower-cased URL holds a part or a source's name begins with a prefix."""
    by_url = F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit(part))
    return by_url if source is None or prefix is None else by_url | F.startswith(F.coalesce(source, F.lit("")), F.lit(prefix))


def split_paragraphs(c: Column, short: int = 140) -> Column:
    """Paragraphs of a text without any: one if it is short and has fewer than two closing marks, else cut at blanks after such marks."""
    t = squeeze(F.coalesce(c, F.lit("")))
    parts = F.filter(F.transform(F.split(t, r"(?<=[。！？；])\s+"), strip), lambda x: x != "")
    one = (F.length(t) < short) & (F.regexp_count(t, F.lit("[。！？；]")) < 2)
    return F.when(t == "", F.array().cast("array<string>")).when(one, F.array(t)).otherwise(parts)


def joined_url(base: Column, href: Column) -> Column:
    """An address relative to a page's: absolute ones stay, `//host` takes the scheme, `/path` the host, others the folder."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1)
    host = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(host, href)).otherwise(F.concat(folder, href))


def swapped_host(url: Column, to: str) -> Column:
    """The same address under another scheme and host, such as `https://h`."""
    return F.regexp_replace(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*", to)
