"""Column builders for text and code: normalising, tokenising, extracting, counting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token pattern and number pattern that results depend on.
TOKEN_PATTERN = r"\\[A-Za-z@]+|NUM|[A-Za-z_][A-Za-z0-9_]*|--|->|<-|<->|\S"
NUMBER_PATTERN = r"(?<![A-Za-z])[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?"


#: Lines of a TeX log that tell an error, or a bad box.
LOG_ERROR, LOG_BOX = r"^\s*!|\.tex:\d+:", r"^\s*(?:Over|Under)full \\"


def strip_space(c: Column) -> Column:
    """Both ends, all ASCII white space (``trim`` takes off blanks only)."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


#: White space that ends are stripped of, line ends but for the line feed, and code fences.
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\n\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
FENCE_START, FENCE_END = r"(?i)\A```(?:latex|tex|tikz)?\s*", r"\s*```\z"


def strip_all(c: Column) -> Column:
    """Both ends, all Unicode white space."""
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def normalize_code(c: Column) -> Column:
    """Line feeds only, no enclosing code fence, no white space at line ends; null becomes ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(strip_all(c), FENCE_START, "")
    c = F.regexp_replace(c, FENCE_END, "")
    # Other line ends are line ends too, and white space before any of them goes with them, but not the line feeds.
    c = F.regexp_replace(c, r"[\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", "\n")
    return strip_all(F.regexp_replace(c, r"[\t\x1f \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+(?=\n|\z)", ""))


def code_hash(code: Column) -> Column:
    return F.when(code == "", F.lit("")).otherwise(F.sha2(code, 256))


def strip_comments(c: Column, parity: bool = False) -> Column:
    """From % to the line's end, unless escaped; with ``parity``, two backslashes escape each other."""
    if parity:
        return F.regexp_replace(c, r"(?m)(?<!\\)((?:\\\\)*)%.*$", "$1")
    return F.regexp_replace(c, r"(?m)(?<!\\)%.*$", "")


def normalize_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER_PATTERN, "NUM")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0))


def code_tokens(code: Column) -> Column:
    return tokens(normalize_numbers(strip_comments(code)))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def normal_line(line: Column) -> Column:
    return F.regexp_replace(strip_space(line), r"[-+]?(?:\d+\.\d*|\.\d+|\d+)", "<NUM>")


#: All of Unicode's space separators (category Zs), which DuckDB's trim takes off.
SPACES = "".join(map(chr, [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))


def has_text(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c, F.lit(SPACES)) != "")


def lowered(c: Column) -> Column:
    """Lower case letter by letter, as DuckDB has it: a capital sigma at a word's end and a dotted I are no exceptions."""
    return F.lower(F.translate(c, "\u0130\u03a3", "i\u03c3"))


def occurrences(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("long")


def fenced_block(c: Column) -> Column:
    """The first fenced block, else a whole document, else a picture environment, else ''."""
    fence = F.regexp_extract(c, r"(?is)```(?:latex|tex|tikz)?\s*(.*?)```", 1)
    document = F.regexp_extract(c, r"(?is)\\documentclass.*?\\end\{document\}", 0)
    picture = F.regexp_extract(c, r"(?is)\\begin\{tikzpicture\}.*?\\end\{tikzpicture\}", 0)
    return F.when(fence != "", strip_space(fence)).when(document != "", document).otherwise(picture)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "class").otherwise(s)


def canonical_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[-_]+", " "), " +", " ")


def archive_id(c: Column) -> Column:
    """``archive/number`` of an old-style id, a plain number as it is, null for anything else."""
    name, number = F.regexp_extract(c, r"^([a-zA-Z-]*)([\d.]+)$", 1), F.regexp_extract(c, r"^([a-zA-Z-]*)([\d.]+)$", 2)
    return F.when(number == "", None).when(name == "", number).otherwise(F.concat(name, F.lit("/"), number))


def suppress_page_numbers(c: Column) -> Column:
    """An empty page style after the first ``\\begin{document}``."""
    mark = r"\begin{document}"
    head = F.substring_index(c, mark, 1)
    return F.when(F.contains(c, F.lit(mark)), F.concat(head, F.lit(mark + "\n\\thispagestyle{empty}"), F.substring(c, F.length(head) + len(mark) + 1, F.length(c)))).otherwise(c)


def log_counts(log: Column) -> dict[str, Column]:
    """Errors, warnings and bad boxes of a TeX log, by line; the notes of one package on reruns are no warnings."""
    count = lambda test: F.size(F.filter(lines(F.coalesce(log, F.lit(""))), test)).cast("long")
    return {
        "errors": count(lambda x: x.rlike(LOG_ERROR)),
        "warnings": count(lambda x: F.contains(x, F.lit("Warning:")) & ~x.rlike(r"^\s*Package rerunfilecheck Warning:")),
        "badboxes": count(lambda x: x.rlike(LOG_BOX)),
    }


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only."""
    return F.conv(F.substring(shuffle_key(seed, *keys), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def shuffle_key(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def random_substring(c: Column, key: Column, k: int, size: int = 50) -> Column:
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(k)))), 1, 8), 16, 10).cast("long")
    start = 1 + F.pmod(draw, (F.greatest(F.length(c) - size, F.lit(0)) + 1).cast("long"))
    return F.substring(c, start.cast("int"), F.lit(size))
