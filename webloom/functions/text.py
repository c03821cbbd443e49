"""Text of HTML pages as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest token in characters, the words of a snippet, and the patterns that say what of a page is text.
MAX_TOKEN = 100
SNIPPET_WORDS = 50
_SCRIPT, _STYLE = r"(?s)<script.*?</script>", r"(?s)<style.*?</style>"
_TAG, _PUNCTUATION = r"<[^>]*>", r"[^a-zA-Z0-9\s]"


def strip_script_style(page: Column) -> Column:
    """The page without ``<script ...</script>`` and ``<style ...</style>``, in lower-case spelling only; null stays null."""
    return F.regexp_replace(F.regexp_replace(page, _SCRIPT, ""), _STYLE, "")


def _bodies(page: Column, tag: str) -> Column:
    return F.regexp_extract_all(page, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def visible_text(page: Column) -> Column:
    """The bodies of ``<title>``, then of ``<p>`` (exact tags), each followed by a space."""
    bare = strip_script_style(page)
    return F.array_join(F.transform(F.concat(_bodies(bare, "title"), _bodies(bare, "p")), lambda b: F.concat(b, F.lit(" "))), "")


def title_text(page: Column) -> Column:
    """The bodies of ``<title>``, each followed by a space."""
    return F.array_join(F.transform(_bodies(strip_script_style(page), "title"), lambda b: F.concat(b, F.lit(" "))), "")


def clean_text(text: Column) -> Column:
    """Tags, then all but ASCII letters, digits and white space, as spaces; in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, _TAG, " "), _PUNCTUATION, " "))


def tokenize(text: Column) -> Column:
    """The words of a text between white space; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def short_tokens(tokens: Column, most: int = MAX_TOKEN) -> Column:
    """Tokens of at most ``most`` characters."""
    return F.filter(tokens, lambda t: F.length(t) <= most)


def page_tokens(page: Column) -> Column:
    """Cleaned tokens of a page's visible text."""
    return short_tokens(tokenize(clean_text(visible_text(page))))


def page_title(page: Column) -> Column:
    """The first title, trimmed; ``No title`` where there is none, while an empty title stays empty."""
    found = _bodies(page, "title")
    return F.when(F.size(found) > 0, F.regexp_replace(F.get(found, F.lit(0)), r"^\s+|\s+$", "")).otherwise(F.lit("No title"))


def page_snippet(page: Column, words: int = SNIPPET_WORDS) -> Column:
    """The first words of the paragraphs, without tags. Empty paragraphs give no word."""
    pieces = F.transform(_bodies(page, "p"), lambda b: tokenize(F.regexp_replace(b, r"(?s)<.*?>", "")))
    return F.array_join(F.slice(F.flatten(pieces), 1, words), " ")


def page_line_filter(page: Column) -> Column:
    """The lines that hold ``<title>`` or ``<p>``."""
    return F.array_join(F.filter(F.split(page, "\n"), lambda line: line.contains("<title>") | line.contains("<p>")), "\n")


def render_result(url: Column, title: Column, snippet: Column) -> Column:
    """One search result as HTML, with its parts escaped."""

    def safe(c: Column) -> Column:
        for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(raw), F.lit(ref))
        return c

    return F.concat(F.lit('<div class="result"><a href="'), safe(url), F.lit('">'), safe(title), F.lit("</a><p>"), safe(snippet), F.lit("</p></div>"))
