"""Text: normal form, density of links, sentence limits, secrets, risk markers, table likeness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
#: White space of the contract: more than Java's own \s, which is ASCII alone.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: White space that is more or other than one plain space. Printable ASCII, most of a text, is told by one look.
LOOSE_SPACE = rf"(?![!-~])(?: (?={SPACE})|(?! ){SPACE}){SPACE}*"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"
URL_TOKEN = r"(?i)^(https?://|www\.)"
SEPARATOR_TOKEN = r"^[|›»·•\-—/>\\]+\z"
#: What every text with such a token holds somewhere.
LINK_SIGN = r"(?i)https?://|www\.|[|›»·•\-—/>\\]"
BULLET = rf"^{SPACE}*([-*•]|[0-9]+[.)]){SPACE}"
SENTENCE_END = r"""[.!?:;)"'\]]"""
SECRETS = {
    "openai_key": r"sk-[a-zA-Z0-9]{20,}",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN[A-Z ]*PRIVATE KEY-----",
    "slack_token": r"xox[bp]-[a-zA-Z0-9-]+",
}
#: What every text with such a secret holds, by pattern.
SECRET_SIGNS = {"openai_key": "sk-", "aws_access_key": "AKIA", "private_key": "-----BEGIN", "slack_token": "xox"}
#: Begun where a run of its characters begins or the match before ended: no other place in the run is the first that fits.
EMAIL = r"(?:\G|(?<![\w.+-]))[\w.+-]+@[\w-]+\.[\w.-]+"
#: ASCII word limits: Java's \b takes other letters for parts of words.
MARKERS = ("TODO", "DRAFT", "DEPRECATED", "INTERNAL ONLY", "DO NOT SHARE")
MARKER = rf"(?<![A-Za-z0-9_])({'|'.join(MARKERS)})(?![A-Za-z0-9_])"
TABLE_RULE = rf"^{SPACE}*\|?{SPACE}*:?-{{3,}}:?{SPACE}*(\|{SPACE}*:?-{{3,}}:?{SPACE}*)+\|?{SPACE}*\z"
TABLE_LINES, TABLE_LINE_CHARS = 24, 220
SAMPLE_CHARS = 500


def stripped(text: Column) -> Column:
    """Without white space at its ends; a text whose first and last characters are none is not searched."""
    at = lambda k: F.substring(text, k, 1).rlike(SPACE)
    return F.when(at(1) | at(-1), F.regexp_replace(text, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")).otherwise(text)


def normalized(text: Column) -> Column:
    """Zero-width characters gone, lower case, white space collapsed and trimmed; null counts as empty."""
    given = F.coalesce(text, F.lit(""))
    bare = F.when(F.octet_length(given) > F.char_length(given), F.regexp_replace(given, ZERO_WIDTH, "")).otherwise(given)
    return F.trim(F.regexp_replace(F.lower(bare), LOOSE_SPACE, " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, signs: tuple[str, ...], pattern: str) -> Column:
    """All matches of a pattern's one group; a text without any of the signs, which every match begins with or holds, is not searched."""
    seen = text.isNull()
    for sign in signs:
        seen = seen | F.contains(text, F.lit(sign))
    return F.when(seen, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))


def sample(text: Column, chars: int | None = SAMPLE_CHARS) -> Column:
    """The first characters as they are, or (null) all: what patterns and structure are judged on."""
    given = F.coalesce(text, F.lit(""))
    return given if chars is None else F.substring(given, 1, chars)


def link_density(text: Column) -> Column:
    """Share of tokens that are links or menu separators; 0 of no tokens."""
    links = lambda tokens: F.filter(tokens, lambda t: t.rlike(URL_TOKEN) | t.rlike(SEPARATOR_TOKEN))
    share = once(F.filter(F.split(text, rf"{SPACE}+"), lambda t: t != ""), lambda tokens: F.coalesce(F.try_divide(F.size(links(tokens)).cast("double"), F.size(tokens)), F.lit(0.0)))
    # Most texts hold neither: they are not split.
    return F.when(text.rlike(LINK_SIGN), share).otherwise(0.0)


def mid_sentence(text: Column) -> Column:
    """Neither begins like a sentence or bullet nor ends like a sentence."""
    first, last = (lambda t: F.substring(t, 1, 1)), (lambda t: F.substring(t, -1, 1))
    return once(stripped(text), lambda t: (t != "") & (first(t) != F.upper(first(t))) & ~last(t).rlike(SENTENCE_END) & ~t.rlike(BULLET))


def thin_reason(text: Column, length: Column, min_chars: int, max_density: float) -> Column:
    """short, linkDensity, midSentence (in this order of precedence) or null."""
    return F.when(length < min_chars, "short").when(link_density(text) > max_density, "linkDensity").when(mid_sentence(text), "midSentence")


def redacted(found: Column) -> Column:
    return F.concat(F.substring(found, 1, 4), F.lit("…"))


def secrets(text: Column) -> Column:
    """All matches, pattern by pattern: array<struct<pattern, redacted>>."""

    def found(name: str, pattern: str) -> Column:
        return F.transform(matches(text, (SECRET_SIGNS[name],), f"({pattern})"), lambda m: F.struct(F.lit(name).alias("pattern"), redacted(m).alias("redacted")))

    return F.concat(*(found(name, pattern) for name, pattern in SECRETS.items()))


def email_count(text: Column) -> Column:
    return F.size(matches(text, ("@",), f"({EMAIL})"))


def markers(text: Column) -> Column:
    return F.array_distinct(matches(text, MARKERS, MARKER))


def cells(line: Column, delimiter: str) -> Column:
    """Cells that hold something; of a line without the delimiter none are counted, as one is no row of a table."""
    return F.when(F.contains(line, F.lit(delimiter)), F.size(F.filter(F.split(line, rf"\Q{delimiter}\E"), lambda c: stripped(c) != ""))).otherwise(0)


def repeated_rows(lines: Column, delimiter: str) -> Column:
    """Three or more rows of three or more cells, of at most two different widths."""
    widths = F.filter(F.transform(F.filter(lines, lambda x: F.length(x) <= TABLE_LINE_CHARS), lambda x: cells(x, delimiter)), lambda n: n >= 3)
    return (F.size(widths) >= 3) & (F.size(F.array_distinct(widths)) <= 2)


def may_hold_rows(text: Column) -> Column:
    """Whether lines hold delimiters enough for a table: what no table can do without, seen without splitting."""
    lines = lambda d, n: F.contains(text, F.lit(d)) & (F.regexp_count(text, F.lit(rf"(?md)^[^\n{d}]*+[{d}][^\n{d}]*+[{d}]")) >= n)
    return lines("|", 2) | lines("\t", 3) | lines(",", 3)


def table_like(text: Column, first: int | None = TABLE_LINES) -> Column:
    """Whether the first lines that are not blank, or (null) all of them, hold a table."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), stripped), lambda x: x != "")

    def judged(lines: Column) -> Column:
        piped = F.size(F.filter(lines, lambda x: cells(x, "|") >= 3))
        ruled = F.exists(lines, lambda x: x.rlike(TABLE_RULE))
        return (F.size(lines) >= 3) & ((piped >= 3) | ((piped >= 2) & ruled) | repeated_rows(lines, "\t") | repeated_rows(lines, ","))

    found = once(lines if first is None else F.slice(lines, 1, first), judged)
    return F.when(may_hold_rows(text), found).otherwise(F.when(text.isNotNull(), F.lit(False)))
