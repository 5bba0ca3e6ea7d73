"""Scalar functions over text and paths, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, one to one.
ACCENTED = "ÀÁÂÃÄÅÆàáâãäåæÇçÈÉÊËèéêëÌÍÎÏìíîïÐðÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿÞþß"
PLAIN = "AAAAAAAaaaaaaaCcEEEEeeeeIIIIiiiiDdNnOOOOOOooooooUUUUuuuuYyyTts"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(c) -> Column:
    return F.element_at(F.split(_c(c), "/"), -1)


def dirname(c) -> Column:
    """The directory part with its trailing slash, '' without one."""
    return F.regexp_extract(_c(c), r"^(.*/)?", 0)


def dir_hash(c) -> Column:
    """Five-digit polynomial hash of the directory part, modulo 2^16 at every step so that nothing overflows."""
    letters = F.filter(F.split(dirname(c), ""), lambda x: x != "")
    h = F.aggregate(letters, F.lit(0), lambda acc, x: ((acc * 31 + F.ascii(x)) % 65536).cast("int"))
    return F.lpad(h.cast("string"), 5, "0")


def stem(c) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(basename(c), ".", 1)


def safe_name(c) -> Column:
    return F.regexp_replace(_c(c), "[\\n\\r\"'`]", "")


def symbol_id(path, name) -> Column:
    return F.concat_ws("_", dir_hash(path), stem(path), safe_name(name))


def stub_id(path) -> Column:
    return F.concat_ws("_", dir_hash(path), stem(path))


def file_base_name(c) -> Column:
    """Base name without an extension of up to five characters, then what follows the last remaining dot; else the base name."""
    name = basename(c)
    kept = F.regexp_extract(name, r"([^.]*)\.[^.]{1,5}$", 1)
    return F.when(kept != "", kept).otherwise(name)


def strip_diacritics(c) -> Column:
    return F.translate(_c(c), ACCENTED, PLAIN)


def normalize_for_search(c) -> Column:
    return F.lower(strip_diacritics(c))


def words(c) -> Column:
    """Pieces between white space, empty ones aside."""
    return F.filter(F.split(_c(c), r"\s+"), lambda x: x != "")


def token_estimate(c) -> Column:
    """ceil(1.33 * words)."""
    return F.ceil(F.size(words(c)) * F.lit(1.33)).cast("bigint")


def token_savings(tokens, n_words) -> Column:
    """Per cent saved against 4 tokens for each thousand words, at least 0; 0 where there are no words."""
    full = _c(n_words) * F.lit(4.0) / F.lit(1000.0)
    return F.when(full > 0, F.greatest(F.lit(0.0), F.lit(100.0) * (1 - _c(tokens) / full))).otherwise(F.lit(0.0))


def url_type(c) -> Column:
    """twitter, arxiv, pdf, image, youtube or webpage, by the first substring that fits."""
    u = _c(c)
    return (
        F.when(u.contains("twitter.com") | u.contains("x.com"), "twitter").when(u.contains("arxiv.org"), "arxiv").when(u.endswith(".pdf"), "pdf")
        .when(u.endswith(".png") | u.endswith(".jpg") | u.endswith(".webp"), "image").when(u.contains("youtube.com") | u.contains("youtu.be"), "youtube").otherwise("webpage")
    )


def url_filename(c, ext: str = ".md") -> Column:
    """The address's last 40 characters with separators replaced, and an extension."""
    u = _c(c)
    return F.concat(F.translate(F.substring(u, F.greatest(F.length(u) - 39, F.lit(1)), F.lit(40)), "/\\:*?.", "______"), F.lit(ext))


def valid_url(c) -> Column:
    return F.coalesce(_c(c).startswith("http://") | _c(c).startswith("https://"), F.lit(False))


def valid_graph_path(c) -> Column:
    """No component '..'."""
    return F.coalesce(~F.array_contains(F.split(_c(c), "/"), ".."), F.lit(False))


def html_escape(c) -> Column:
    x = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def sanitize_label(c) -> Column:
    """Without control characters, HTML-escaped, 256 characters at most."""
    return F.substring(html_escape(F.regexp_replace(_c(c), r"[\x00-\x1f\x7f]", "")), 1, 256)


def cypher_escape(c) -> Column:
    return F.replace(F.replace(_c(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))


def file_name(c) -> Column:
    """A label as a file name: separators and reserved characters become '_'."""
    return F.regexp_replace(_c(c), r'[/\\:*?"<>|]', "_")


def capitalize(c) -> Column:
    """First letter a-z in upper case, the rest as it is."""
    x = _c(c)
    return F.concat(F.translate(F.substring(x, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(x, F.lit(2), F.length(x)))


def short_path(c) -> Column:
    """The last two segments."""
    parts = F.split(_c(c), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def code_category(c) -> Column:
    """code, paper or document by the lower-case suffix."""
    p = F.lower(_c(c))
    # Suffixes of code.
    exts = "py|ts|js|go|rs|java|c|cpp|rb|cs|kt|scala|php|swift|lua|zig|hs|ex|m|jl"
    return F.when(p.rlike(rf"\.({exts})$"), "code").when(p.endswith(".pdf"), "paper").otherwise("document")


def match_score(label, terms: list[str]) -> Column:
    """How many of the terms are substrings of the lower-case label."""
    low = F.lower(_c(label))
    out = F.lit(0)
    for t in terms:
        out = out + F.coalesce(low.contains(t).cast("int"), F.lit(0))
    return out


def query_terms(question: str, min_length: int = 3) -> list[str]:
    return [w for w in question.lower().split() if len(w) >= min_length]


# What the signs of a paper look like.
PAPER_SIGNS = (
    ("arxiv.org", "arxiv:", "arxiv."),
    ("abstract", "summary", "résumé"),
    ("et al.", "et al.,", "ibid.", "op. cit.", "cf.", "proceedings of", "journal of", "ieee", "acm "),
    ("references", "bibliography", "works cited", "références"),
)


def paper_score(c) -> Column:
    """How many of five signs of a paper (a repository number, a DOI, abstract, citations, references) a text shows; two make one."""
    t = F.lower(F.coalesce(_c(c), F.lit("")))
    # a DOI: '10.' somewhere, and a slash three or more characters after the first '1'
    after = F.substring(t, F.locate("1", t) + 3, F.lit(1 << 30))
    out = (t.contains("10.") & F.coalesce(after.contains("/"), F.lit(False))).cast("int")
    for group in PAPER_SIGNS:
        hit = F.lit(False)
        for sign in group:
            hit = hit | t.contains(sign)
        out = out + hit.cast("int")
    return out


def headers(c) -> Column:
    """array<struct<level, title, line>> of a text's headings of levels 1-4; deeper ones count as level 4 with '#' in the title."""
    lines = F.transform(F.split(_c(c), "\n"), lambda x, i: F.struct(F.regexp_extract(x, "^ *(#{1,4})(.*)$", 1).alias("h"), F.trim(F.regexp_extract(x, "^ *(#{1,4})(.*)$", 2)).alias("title"), (i + 1).alias("line")))
    return F.transform(F.filter(lines, lambda x: (x["h"] != "") & (x["title"] != "")), lambda x: F.struct(F.length(x["h"]).alias("level"), x["title"].alias("title"), x["line"].alias("line")))


def tags(c) -> Column:
    """Distinct #tags of two or more characters that do not start a line (those are headings)."""
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(r"(?<!\n)#([\p{L}\p{N}_/-]{2,})"), 1))


def wiki_links(c) -> Column:
    """Targets of [[target]] and [[target|alias]]."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit(r"\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]"), 1), lambda x: F.trim(x))
