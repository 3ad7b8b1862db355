"""String functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.urls import none_if_empty, trimmed


def slug(text: Column, longest: int = 80) -> Column:
    """Lower case, runs of other signs than letters, digits, ``._-`` as one dash; ``paper`` if nothing is left."""
    words = F.filter(F.split(F.lower(trimmed(text)), "[^a-z0-9._]+"), lambda w: w != "")
    clean = F.coalesce(none_if_empty(F.array_join(words, "-")), F.lit("paper"))
    cut = F.when(F.length(clean) > longest, F.regexp_replace(F.substring(clean, 1, longest), r"[-.]+$", "")).otherwise(clean)
    return F.coalesce(none_if_empty(cut), F.lit("paper"))


def normal_label(label: Column) -> Column:
    """Without a colon at its end, in lower case."""
    return F.lower(F.regexp_replace(trimmed(label), r"\s*:\s*$", ""))


def natural_key(text: Column) -> Column:
    """Sorts digit runs by value and the rest in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    # The number of digits goes before them, padded, so runs of any length sort by value.
    number = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    padded = lambda r: F.concat(F.lpad(F.length(number(r)).cast("string"), 10, "0"), number(r))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), padded(r)).otherwise(F.lower(r))), "")


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")


def year_between(year: Column, spec: str) -> Column:
    """Filter of ``2023``, ``2020-2025``, ``2020-`` or ``-2025``."""
    low, dash, high = spec.partition("-")
    if not dash:
        high = low
    keep = F.lit(True)
    if low.strip():
        keep = keep & (year >= int(low))
    if high.strip():
        keep = keep & (year <= int(high))
    return keep


def yaml_string(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def yaml_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, yaml_string), ", "), F.lit("]"))


def front_matter(title: Column, key: Column, source: Column, extractor: Column, authors: Column, more: dict[str, Column]) -> Column:
    """YAML lines between dashes: title, key, source and extractor always, the others in the given order if they hold anything."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    full = lambda c: none_if_empty(c.cast("string"))
    optional = [F.when(F.size(authors) > 0, line("authors", yaml_list(authors)))]
    optional += [F.when(full(c).isNotNull(), line(name, yaml_string(full(c)))) for name, c in more.items()]
    fixed = [line("title", yaml_string(F.coalesce(title, F.lit("")))), line("key", F.coalesce(key, F.lit(""))), line("source", F.coalesce(source, F.lit(""))), line("extractor", F.coalesce(extractor, F.lit("")))]
    return F.array_join(F.array_compact(F.array(F.lit("---"), *fixed, *optional, F.lit("---"))), "\n")


def utc_stamp(time: Column) -> Column:
    """ISO 8601 with the zone and without fractions; the session's zone is UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssXXX")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def code_fence(text: Column, least: int = 3) -> Column:
    """A fence longer than any run of backticks in the text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(least), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


#: What Markdown puts around text, and what stays of it.
_FENCED = r"```[^\n]*\n?([^`]*(?:`{1,2}[^`]+)*)```"
_LABELLED = r"!?\[([^\]]*)\]\([^)]*\)"
_LINE_MARK = r"(?<=^|\n)#{1,6}[ \t\x0B\f\r\n]*"


def strip_markdown(text: Column) -> Column:
    """Plain text of Markdown: of fences, links and images what they hold; marks of headings, emphasis, code and quotes dropped."""
    unfenced = F.regexp_replace(text, _FENCED, "$1")
    unlinked = F.regexp_replace(unfenced, _LABELLED, "$1")
    unmarked = F.translate(F.regexp_replace(unlinked, _LINE_MARK, ""), "*_`>", "")
    return F.concat(trimmed(unmarked), F.lit("\n"))


def caption_label(text: Column) -> Column:
    return none_if_empty(F.regexp_extract(text, r"(?i)^\s*((?:figure|fig\.?|table)\s*[0-9IVXivx]+)", 1))


def page_index(node_id: Column) -> Column:
    return F.regexp_extract(node_id, r"/page/(\d+)/", 1).try_cast("int")


def looks_like_pdf(path: Column) -> Column:
    return F.lower(path).rlike(r"(\.pdf|/pdf)$")


def balance_braces(text: Column) -> Column:
    """Closing braces without an opening one dropped, missing closing ones appended."""
    step = lambda acc, c: F.struct(
        F.when(c == "{", acc["d"] + 1).when((c == "}") & (acc["d"] > 0), acc["d"] - 1).otherwise(acc["d"]).alias("d"),
        F.when((c == "}") & (acc["d"] == 0), acc["t"]).otherwise(F.concat(acc["t"], c)).alias("t"),
    )
    walked = F.aggregate(
        F.split(text, ""),
        F.struct(F.lit(0).alias("d"), F.lit("").alias("t")),
        step,
        lambda acc: F.concat(acc["t"], F.repeat(F.lit("}"), acc["d"])),
    )
    return F.when(text.contains("{") | text.contains("}"), walked).otherwise(text)


def _foldable() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def search_tokens(text: Column) -> Column:
    """Tokens of full-text search: runs of letters, digits and private-use signs, case and Latin diacritics folded."""
    source, target = _foldable()
    folded = F.lower(F.translate(text, source, target))
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")
