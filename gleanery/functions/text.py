"""Text functions: words, word-gram hashes, winnowing, cleaning, style scores. All are column expressions; none shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, total

#: Letters, digits and the underscore, in any script.
WORD = r"[\p{L}\p{N}_]+"
GRAM_WORDS, WINNOW_WINDOW = 6, 5

#: Names that say nothing about what they hold.
GENERIC_NAMES = (
    "data", "result", "results", "value", "values", "temp", "tmp", "output", "input", "item", "items", "obj", "object",
    "processed", "response", "handler", "manager", "helper", "util", "utils",
)
#: Stock phrases of generated prose.
STOCK_PHRASES = (
    "in conclusion", "it is important to note", "furthermore", "overall, it can be seen", "in today's world", "delve into",
    "it is worth noting", "in summary", "moreover", "as an ai language model", "plays a crucial role", "in the realm of",
    "on the other hand", "it is essential to", "this comprehensive", "let's dive in",
)
#: Words that don't tell one criterion from another.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "of", "and", "or", "to", "in", "on", "for", "with", "that", "this", "it", "as", "be", "by", "at",
    "from", "was", "were", "will", "should", "must", "your", "their", "does", "do", "have", "has", "how", "what", "into",
)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def gram_hashes(tokens: Column, k: int = GRAM_WORDS) -> Column:
    """A 64-bit hash, as hex, of each run of k tokens; empty below k tokens."""

    def run(t: Column) -> Column:  # elements one by one: a slice would copy the whole array for each gram
        grams = F.transform(
            F.sequence(F.lit(0), F.size(t) - k), lambda i: F.substring(F.md5(F.concat_ws("\x1f", *(F.get(t, i + j) for j in range(k)))), 1, 16)
        )
        return F.when(F.size(t) < k, F.array().cast("array<string>")).otherwise(grams)

    return let(tokens, run)


def winnow(hashes: Column, window: int = WINNOW_WINDOW, short: bool = True) -> Column:
    """The distinct least hashes of each window. With fewer hashes than a window: the least one if short, else none."""

    def run(h: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(h) - window)
        minima = F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*(F.get(h, i + j) for j in range(window)))))
        too_few = F.size(h) < (1 if short else window)
        return F.when(too_few, F.array().cast("array<string>")).otherwise(minima)

    return let(hashes, run)


def normal_name(name: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def html_text(html: Column) -> Column:
    """Markup to plain text: scripts, styles and tags go, the five basic entities are resolved, white space collapses."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " "), r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def clip(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit(mark))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


#: Parts of names that tell nothing.
COMMON_PARTS = (
    "main", "test", "tests", "run", "init", "self", "data", "value", "item", "list", "temp", "helper", "util", "utils", "get", "set",
    "print", "return", "input", "output", "args", "kwargs", "index",
)


def identifier_parts(name: Column, least: int = 4) -> Column:
    """The parts of snake or camel case names of at least ``least`` letters, lower case, without common ones."""
    cut = F.split(F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")), r"[_\-0-9]+")
    return F.array_distinct(F.filter(cut, lambda x: (F.length(x) >= least) & ~x.isin(*COMMON_PARTS)))


#: Endings that a stem loses, the first that fits, if four letters stay.
ENDINGS = ("ing", "ed", "es", "s")


def stem(word: Column) -> Column:
    """A word without a common ending, then without a closing e if it has over four letters: test, tests, tested and testing are one."""
    cut = F.when(F.lit(False), word)
    for end in ENDINGS:
        cut = cut.when(word.endswith(end) & (F.length(word) >= 4 + len(end)), F.substring(word, F.lit(1), F.length(word) - len(end)))
    cut = cut.otherwise(word)
    return F.when(cut.endswith("e") & (F.length(cut) > 4), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


#: Markdown to plain text: what goes and what stays of it, in this order.
MARKDOWN = (
    (r"(?m)^[ \t]*(?:```|~~~)[^\n]*$", ""),  # fences; the code stays
    (r"!\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]{0,3}>[ \t]?", ""),
    (r"(?m)^[ \t]*(?:[-*+]|[0-9]{1,3}[.)])[ \t]+", ""),
    (r"(?m)^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$", ""),
    (r"[*_`~]{1,3}", ""),
    (r"[ \t]*\|[ \t]*", " "),
    (r"\s+", " "),
)


def markdown_text(text: Column) -> Column:
    for pattern, kept in MARKDOWN:
        text = F.regexp_replace(text, pattern, kept)
    return F.trim(text)


def markdown_sql(text: str) -> str:
    for pattern, kept in MARKDOWN:
        text = f"regexp_replace({text}, '{pattern}', '{kept.replace('$', chr(92))}', 'g')"
    return f"trim({text})"


def keywords(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2)))


def uneven_below(lengths: Column, hundredths: int) -> Column:
    """Whether the deviation over the mean of an array of numbers is under hundredths / 100, in whole numbers."""

    def run(x: Column) -> Column:
        s1, s2 = total(x), total(F.transform(x, lambda v: v * v))
        return (s1 > 0) & (10_000 * (F.size(x) * s2 - s1 * s1) < hundredths * hundredths * s1 * s1)

    return let(lengths, run)


def signal(points: Column) -> Column:
    return F.when(points < 34, "low").when(points < 67, "medium").otherwise("high")


def prose_points(text: Column) -> Column:
    """Style points of prose: even sentences 30, few different words 25, stock phrases 10 each up to 30, long words 15."""
    sentences = F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\x01"), "\x01"), lambda s: F.length(F.trim(s)) > 0)
    lengths = F.transform(sentences, lambda s: F.regexp_count(s, F.lit("[A-Za-z']+")))
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    low = F.lower(text)
    even = let(lengths, lambda x: F.when((F.size(x) >= 5) & uneven_below(x, 35), 30).otherwise(0))
    few = let(found, lambda w: F.when((F.size(w) >= 50) & (10 * F.size(F.array_distinct(w)) < 4 * F.size(w)), 25).otherwise(0))
    stock = F.least(F.lit(30), 10 * sum((F.contains(low, F.lit(p)).cast("int") for p in STOCK_PHRASES), F.lit(0)))
    long = let(found, lambda w: F.when((F.size(w) > 0) & (10 * F.length(F.array_join(w, "")) > 52 * F.size(w)), 15).otherwise(0))
    return F.least(F.lit(100), even + few + stock + long)


def code_points(source: Column) -> Column:
    """Style points of code: comments over a quarter of lines, even line lengths, generic names over 8 %, documented functions."""
    lines = F.split(source, "\n")
    commented = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(#|//)")))
    filled = F.transform(F.filter(lines, lambda x: x.rlike(r"\S")), F.length)
    names = F.transform(F.regexp_extract_all(source, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), F.lower)
    generic = F.size(F.filter(names, lambda w: w.isin(*GENERIC_NAMES)))
    documented = F.regexp_count(source, F.lit("(def |function )[^\\n]*\\n\\s*(\"\"\"|'''|/\\*\\*)"))
    defined = F.regexp_count(source, F.lit(r"\b(def|function)\s+\w+"))
    dense = F.when(4 * commented > F.size(lines), 25).otherwise(0)
    even = F.when((F.size(lines) > 15) & (F.size(filled) > 1) & uneven_below(filled, 25), 25).otherwise(0)
    plain = F.when(100 * generic > 8 * F.size(names), 25).otherwise(0)
    told = F.when((defined > 0) & (10 * documented > 7 * defined), 25).otherwise(0)
    return dense + even + plain + told


def figure_mentions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)\b(figure|fig\.?|screenshot|see below|shown below)\b"))
