"""The tokenizer and its relatives as Column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One word pattern, the two CJK blocks that are split into characters and pairs, the narrower block that decides a
# question's language, and Unicode white space as str.strip() has it.
WORD = r"[a-z0-9]+(?:[._'-][a-z0-9]+)*"
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
HAN = r"[\x{4e00}-\x{9fff}]"
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNIT = "\x1f"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def tokenize(text: Column | str) -> Column:
    """Array of tokens: the ASCII words in order, then for each run of CJK characters its single characters and its pairs."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))

    def grams(run: Column) -> Column:
        n = F.length(run)
        ones = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(run, i, F.lit(1)))
        twos = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(n > 1, F.concat(ones, twos)).otherwise(ones)

    words = _matches(low, WORD)
    # only texts with CJK characters pay for the lambda over their runs
    return F.when(low.rlike(f"[{CJK}]"), F.concat(words, F.flatten(F.transform(_matches(low, f"[{CJK}]+"), grams)))).otherwise(words)


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7f]*$")


def content_tokens(tokens: Column) -> Column:
    """The sorted distinct tokens that carry content: ASCII ones of four characters or more, and CJK pairs."""
    heavy = F.filter(tokens, lambda t: F.when(is_ascii(t), F.length(t) >= 4).otherwise(F.length(t) == 2))
    return F.array_sort(F.array_distinct(heavy))


def strip(text: Column | str) -> Column:
    """White space off both ends, all of Unicode's."""
    return F.regexp_replace(_col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(text: Column | str) -> Column:
    """All white space deleted."""
    return F.regexp_replace(_col(text), f"[{SPACE}]+", "")


def language(text: Column | str) -> Column:
    """zh where any Han character occurs, else en."""
    return F.when(_col(text).rlike(HAN), "zh").otherwise("en")


def split_lines(text: Column | str) -> Column:
    """Lines at every Unicode line boundary; an empty last one doesn't count."""
    lines = F.split(_col(text), r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def digest(*parts: Column | str, length: int = 16) -> Column:
    """The first characters of the SHA-1 of the parts, each closed by a unit separator."""
    joined = F.concat(*[x for p in parts for x in (_col(p).cast("string"), F.lit(UNIT))])
    return F.substring(F.sha1(joined), 1, length)


def snippet(text: Column | str, n: int) -> Column:
    """The first n characters on one line."""
    return F.translate(F.substring(_col(text), 1, n), "\n", " ")


def leak_bucket(df: Column | str) -> Column:
    d = _col(df)
    return F.when(d <= 2, "<=2").when(d <= 10, "3-10").when(d <= 50, "11-50").otherwise(">50")


def lenient_int(c: Column | str) -> Column:
    """An integer, or 0 where there is none."""
    return F.coalesce(_col(c).try_cast("int"), F.lit(0))
