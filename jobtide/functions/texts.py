"""Text functions (STR-1 to STR-19) and formatting (DT-5, DT-6, DT-9)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values. Calls to action that are no titles, in labels.
LABEL_CALLS = ("learn more", "help", "sign in", "bookmark", "share", "apply", "view job", "apply now", "connect")
# Fixed values. The same in texts of anchors.
ANCHOR_CALLS = ("learn more", "help", "sign in", "bookmark", "share", "apply")
# Fixed values. The same in headings.
HEADING_CALLS = ("view job", "learn more", "read more", "apply now", "connect")
# Fixed value. What stands before the title in a label.
LABEL_PREFIX = r"(?i)^(?:learn more about|view details for)\s+(.+)"
# Fixed values. Names of classes that say only layout.
GENERIC_CLASSES = ("row", "rows", "col", "cols", "container", "grid", "section", "wrapper", "content")
# Fixed values. Titles of list pages, which no posting has.
BOILERPLATE_TITLES = ("find your role", "job openings at meta | meta careers")
# Fixed value. The text that tells which of all results a page shows.
RESULTS_WINDOW = r"(?i)(\d+)\s*[‐‑‒–\-]\s*(\d+)\s*of\s*(\d+)"


@F.pandas_udf(T.StringType())
def _compatible(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


def decomposed(x) -> Column:
    """NFKD; text in ASCII is as it is."""
    return F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(_compatible(x))


def slugify(x) -> Column:
    """STR-1."""
    ascii_only = F.regexp_replace(decomposed(x), r"[^\x00-\x7F]", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(ascii_only, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("page"))


def strip_accents(x) -> Column:
    """STR-2: NFKD without combining marks."""
    return F.regexp_replace(decomposed(x), r"\p{Mn}", "")


def norm(x) -> Column:
    """STR-3: accents stripped, case folded, other than a-z and 0-9 to single spaces."""
    folded = F.replace(F.lower(strip_accents(x)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def split_locations(x) -> Column:
    """STR-4."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"[;,/|•·]+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def _edits(a: str, b: str, most: int) -> int:
    """The fewest insertions, deletions, replacements and swaps of neighbours from a to b, or more than `most`.

    Equal beginnings cost nothing and are skipped; where the texts part, each kind of edit is tried with one edit less
    to spend, so the search is as deep as `most`, however long the texts are.
    """
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        return len(a) + len(b)
    if most == 0:
        return 1
    rests = [(a[1:], b[1:]), (a[1:], b), (a, b[1:])]
    if a[1:2] == b[0] and b[1:2] == a[0]:
        rests.append((a[2:], b[2:]))
    return 1 + min(_edits(x, y, most - 1) for x, y in rests)


def _compatible_edits(a: str, b: str, most: int) -> int:
    """What a table of edits gives whose first row is all 0: the start of the longer text is free (quirk Q8).

    Cells further than `most` from the diagonal count as most + 1.
    """
    a, b = sorted((a, b), key=len)
    table = {(0, j): 0 for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        table[i, 0] = i
        for j in range(1, len(b) + 1):
            if abs(i - j) > most:
                table[i, j] = most + 1
                continue
            ways = [table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1])]
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 1] + b[j - 2]:
                ways.append(table[i - 2, j - 2] + 1)
            table[i, j] = min(ways)
    return table[len(a), len(b)]


def osa_distance(a: str, b: str, most: int, compat: bool = False) -> int:
    """Edit distance with swaps of neighbours, most + 1 if it is greater. compat: the start of the longer text is free."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    return min((_compatible_edits if compat else _edits)(a, b, most), most + 1)


def within_distance(a, b, most: int = 2, compat: bool = False) -> Column:
    """STR-5 as a predicate; Python sees only pairs that lengths and the JVM's own distance do not rule out."""

    @F.pandas_udf(T.BooleanType())
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p is not None and q is not None and osa_distance(p, q, most, compat) <= most for p, q in zip(x, y, strict=True)])

    near = F.abs(F.length(a) - F.length(b)) <= most
    if not compat:
        near = near & (F.levenshtein(a, b, 2 * most) >= 0)  # a swap is two of its edits
    return F.when(near, close(F.when(near, a), F.when(near, b))).otherwise(False)


def collapsed(x) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def label_title(label) -> Column:
    """STR-8: a title from an aria-label, empty for calls to action."""
    label = F.trim(F.coalesce(label, F.lit("")))
    after = F.trim(F.regexp_extract(label, LABEL_PREFIX, 1))
    return F.when(after != "", after).when(~F.lower(label).isin(*LABEL_CALLS), label).otherwise("")


def anchor_title(text, title) -> Column:
    """STR-9: an anchor's text or title attribute, empty for calls to action."""
    found = collapsed(F.coalesce(F.nullif(text, F.lit("")), title, F.lit("")))
    return F.when(F.lower(found).isin(*ANCHOR_CALLS), "").otherwise(found)


def attribute_title(link, label, title) -> Column:
    """STR-10: the first attribute that is not blank, without a call's prefix."""
    found = F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in (link, label, title)), F.lit(""))
    after = F.trim(F.regexp_extract(found, LABEL_PREFIX, 1))
    return F.when(after != "", after).otherwise(found)


def is_heading(text) -> Column:
    """STR-11: long enough, no call to action, at least three letters or digits."""
    text = F.trim(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.coalesce((F.length(text) >= 4) & ~F.lower(text).isin(*HEADING_CALLS) & (letters >= 3), F.lit(False))


def cleaned_title(title) -> Column:
    """STR-12."""
    title = F.trim(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r" - Meta$", ""))
    return F.when(F.lower(title).isin(*BOILERPLATE_TITLES), "").otherwise(title)


def is_generic_class(names) -> Column:
    """STR-13: empty, or any of the class names says only layout."""
    return (F.coalesce(names, F.lit("")) == "") | F.arrays_overlap(F.split(names, " "), F.array(*map(F.lit, GENERIC_CLASSES)))


def class_key(names) -> Column:
    """ARR-4: class names sorted and joined."""
    return F.array_join(F.array_sort(F.filter(F.split(F.coalesce(names, F.lit("")), r"\s+"), lambda c: c != "")), " ")


def results_window(text) -> Column:
    """STR-15: struct of page size (null if it would not be positive) and total, from `a-b of n`."""
    a, b, n = (F.regexp_extract(collapsed(text), RESULTS_WINDOW, k).try_cast("int") for k in (1, 2, 3))
    return F.when(n.isNotNull(), F.struct(F.when(b >= a, b - a + 1).alias("size"), n.alias("total")))


def whole_number(text) -> Column:
    """STR-16."""
    digits = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(digits.rlike(r"^\d+$"), digits.try_cast("int"))


def page_of(text) -> Column:
    """STR-17: struct of page and pages, from `Page x of y`."""
    page, pages = (F.regexp_extract(text, r"(?i)page\s+(\d+)\s+of\s+(\d+)", k).try_cast("int") for k in (1, 2))
    return F.when(page.isNotNull(), F.struct(page.alias("page"), pages.alias("pages")))


def tsv_title(title) -> Column:
    """STR-19."""
    return F.translate(title, "\t", " ")


def age_text(seconds) -> Column:
    """DT-5."""
    hours = seconds / 3600.0
    return F.when(hours < 48, F.format_string("%.1fh", hours)).otherwise(F.format_string("%.1fd", hours / 24))


def age_class(active, seconds) -> Column:
    """DT-6."""
    return (
        F.when(~active, "inactive").when(seconds <= 48 * 3600, "new").when(seconds >= 7 * 86400, "old").otherwise("plain")
    )


def floor_median(numbers) -> Column:
    """DT-9: of an array, the mean of an even count's middles rounded down; null if it is empty."""
    ordered, n = F.array_sort(numbers), F.size(numbers)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, F.floor((low + high) / 2).cast("int"))


def svg_view_box(text) -> Column:
    """STR-20: the four numbers of a viewBox, or width and height without units."""
    box = F.transform(F.split(F.trim(F.regexp_extract(text, r"""(?i)viewBox\s*=\s*["']([^"']+)["']""", 1)), r"[\s,]+"), lambda x: x.try_cast("double"))
    w, h = (F.regexp_extract(text, rf"""(?i)<svg\b[^>]*\b{k}\s*=\s*["']\s*([0-9.]+)(?:px)?\s*["']""", 1).try_cast("double") for k in ("width", "height"))
    sized = F.when(w.isNotNull() & h.isNotNull(), F.array(F.lit(0.0), F.lit(0.0), w, h))
    return F.when((F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull()), box).otherwise(sized)


def svg_pixels(text, name: str) -> Column:
    """STR-20: an attribute's number, plain or in px; null for other units."""
    return F.regexp_extract(text, rf"""(?i)\b{name}\s*=\s*"\s*(\d+(?:\.\d+)?)(?:px)?\s*\"""", 1).try_cast("double")


def _number(x) -> Column:
    """Up to six decimals, none that are zero."""
    return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")


def svg_with_view_box(text) -> Column:
    """STR-20: text with a viewBox, made of its width and height if it has none; as it is if it lacks them."""
    w, h = svg_pixels(text, "width"), svg_pixels(text, "height")
    has = text.rlike(r"""(?i)viewBox\s*=\s*["']""")
    made = F.concat(F.lit('<svg viewBox="0 0 '), _number(w), F.lit(" "), _number(h), F.lit('"'))
    first = F.regexp_extract(text, r"(?is)^(.*?)<svg\b", 1)
    rest = F.regexp_extract(text, r"(?is)^.*?<svg\b(.*)$", 1)
    return F.when(~has & (w > 0) & (h > 0) & text.rlike(r"(?i)<svg\b"), F.concat(first, made, rest)).otherwise(text)


def svg_expanded(text, percent: float) -> Column:
    """STR-20: the viewBox grown on each side by a share of its longer side."""
    whole = svg_with_view_box(text)
    box = svg_view_box(whole)
    pad = F.greatest(box[2], box[3]) * (percent / 100)
    numbers = (box[0] - pad, box[1] - pad, box[2] + 2 * pad, box[3] + 2 * pad)
    made = F.concat(F.lit('viewBox="'), F.concat_ws(" ", *map(_number, numbers)), F.lit('"'))
    at = r"""(?i)viewBox\s*=\s*(?:"[^"]+"|'[^']+')"""
    return F.when(box.isNotNull() & (F.lit(percent) > 0), F.regexp_replace(whole, F.lit(at), made)).otherwise(whole)


def svg_outlined(text, units: float, name: str = "outline") -> Column:
    """STR-20: the drawing in a group with a white outline of so many units."""
    steps = (
        f'<feMorphology in="SourceAlpha" operator="dilate" radius="{units:g}" result="wide"/><feFlood flood-color="white"/>'
        '<feComposite in2="wide" operator="in" result="edge"/><feMerge><feMergeNode in="edge"/><feMergeNode in="SourceGraphic"/></feMerge>'
    )
    head = f'$1<defs><filter id="{name}" x="-20%" y="-20%" width="140%" height="140%">{steps}</filter></defs><g filter="url(#{name})">'
    opened = F.regexp_replace(text, r"(?is)^(.*?<svg\b[^>]*>)", head)
    return F.when(text.rlike(r"(?is)<svg\b[^>]*>.*</svg>"), F.regexp_replace(opened, r"(?is)</svg>", "</g></svg>")).otherwise(text)


def ensure_utc(x) -> Column:
    """DT-2: an ISO time as text; without a zone it is in UTC. Null if it is no time."""
    zoned = x.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})\s*$")
    return F.try_to_timestamp(F.when(zoned, x).otherwise(F.concat(x, F.lit("Z"))))
