"""TeX sources: comments, node texts, figures, preambles, macros. Balanced brackets need a scan, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that make a comment old code; what a preamble keeps and leaves to the macro expander.
CODE_CHARACTERS = r"[\\{}$&#^_\[\]]"
KEPT_WORDS, KEPT_PACKAGES = ("documentclass", "tikz", "tkz", "pgf"), ("inputenc", "fontenc", "fontspec", "amsmath", "amssymb", "color")
MACRO_STARTS = ("\\new", "\\renew")
HIDDEN_TEXT = "\\tikzset{every node/.append style={text opacity=0}}\n"
PICTURE_START, PICTURE_END = "\\begin{tikzpicture}", "\\end{tikzpicture}"
MOST_DEPTH = 20


def _text_function(f: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run


# --- comments


def strip_old_code(c: Column) -> Column:
    """Leading comment lines go, and comments that hold characters of code; others, such as remarks, stay."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n|\r", "\n"), r"\A\s+|\s+\z", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\A(?:%.*\n)+", ""), r"\A\s+", "")
    c = F.regexp_replace(c, rf"(?m)^[ \t]*%.*{CODE_CHARACTERS}.*(?:\n|\z)", "")
    c = F.regexp_replace(c, rf"(?m)(?<!\\)((?:\\\\)*)[ \t]*(?<=\s)%.*{CODE_CHARACTERS}.*$", "$1")
    c = F.regexp_replace(c, rf"(?m)(?<!\\)((?:\\\\)*)%.*{CODE_CHARACTERS}.*$", "$1%")
    return F.regexp_replace(c, r"\s+\z", "")


def clean_example(c: Column, full: bool = False) -> Column:
    """Line feeds only, stripped, without leading comment lines; with ``full`` also without commented-out code."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\r\n|\r", "\n"), r"\A\s+|\s+\z", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\A(?:%.*\n)*", ""), r"\A\s+|\s+\z", "")
    return strip_old_code(plain) if full else plain


# --- brackets and node texts

_NODE = re.compile(r"\\node|(?<![^\W])node(?![^\W])")


def _escaped(text: str, at: int) -> bool:
    return (at - len(text[:at].rstrip("\\"))) % 2 == 1 if at else False


def _after_blank(text: str, at: int) -> int:
    """The next place that is neither white space nor in a comment."""
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text[at] == "%" and not _escaped(text, at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        else:
            break
    return at


def closing(text: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes; -1 if it never does. Comments and escaped brackets don't count."""
    pairs = {"{": "}", "[": "]", "(": ")"}
    if at >= len(text) or text[at] not in pairs:
        return -1
    left, right, depth = text[at], pairs[text[at]], 0
    while (at := _after_blank(text, at)) < len(text):
        if text[at] in (left, right) and not _escaped(text, at):
            depth += 1 if text[at] == left else -1
            if not depth:
                return at
        at += 1
    return -1


def placeholder(i: int) -> str:
    """aaaa, aaab, ... zzzz."""
    if not 0 <= i < 26**4:
        raise ValueError("too many nodes")
    return "".join(chr(97 + i // 26**k % 26) for k in (3, 2, 1, 0))


def replace_node_texts(text: str, replacement: str | None = None) -> str:
    """Bodies of nodes become ``replacement``, or else placeholders in turn; options stay, and empty bodies."""
    out, done, number = [], 0, 0
    for match in _NODE.finditer(text):
        if match.start() < done:
            continue
        at = _after_blank(text, match.end())
        if match[0] == "node" and (at >= len(text) or text[at] not in "([{"):
            continue
        while at < len(text) and text[at] != "{":
            end = closing(text, at) if text[at] in "[(" else at
            if end < 0:
                at = len(text)
            else:
                at = _after_blank(text, end + 1) if text[at] in "[(" else at + 1
        end = closing(text, at)
        if end < 0:
            break
        body = text[at + 1 : end]
        if _after_blank(text, at + 1) != end:
            body = placeholder(number) if replacement is None else replacement
            number += 1
        else:
            body = ""
        out += [text[done : at + 1], body, "}"]
        done = end + 1
    return "".join(out) + text[done:]


def process(c: Column, mode: str, replacement: str = "Text") -> Column:
    """``clean_all_text`` hides the texts of nodes, ``replace_all`` and ``replace_sequential`` change them."""
    if mode == "clean_all_text":
        return F.replace(c, F.lit(PICTURE_START), F.lit(HIDDEN_TEXT + PICTURE_START))
    if mode == "replace_all":
        return _text_function(partial(replace_node_texts, replacement=replacement))(c)
    if mode == "replace_sequential":
        return _text_function(replace_node_texts)(c)
    raise ValueError(f"unknown mode: {mode}")


# --- figures


def substitute_images(c: Column) -> Column:
    return F.regexp_replace(c, r"(\\includegraphics\*?(?:\[.*?\]){0,2})\{.+?\}", r"$1{example-image}")


def preamble(c: Column) -> tuple[Column, Column]:
    """(statements that a picture's document keeps, all others), line by line, of what stands before the document."""
    statements = F.split(F.substring_index(c, "\\begin{document}", 1), "\n")
    bare = lambda s: F.ltrim(s)
    any_of = lambda s, words: F.lit(False) if not words else F.expr("false") | sum_or([F.contains(s, F.lit(w)) for w in words])
    package = lambda s: F.startswith(bare(s), F.lit("\\usepackage")) & any_of(s, KEPT_PACKAGES)
    macro = lambda s: sum_or([F.startswith(bare(s), F.lit(m)) for m in MACRO_STARTS])
    keeps = lambda s: ~macro(s) & (any_of(s, KEPT_WORDS) | package(s))
    told = F.filter(statements, lambda s: ~F.startswith(bare(s), F.lit("%")))
    join = lambda a: F.regexp_replace(F.array_join(a, "\n"), r"\A\s+|\s+\z", "")
    return join(F.filter(told, keeps)), join(F.filter(told, lambda s: ~keeps(s)))


def sum_or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def used_colours(macros: Column, picture: Column) -> Column:
    """Colour definitions in ``macros`` whose names stand in the picture as words, one a line."""
    found = F.regexp_extract_all(macros, F.lit(r"(?m)^[ \t]*(\\definecolor(?:\[\w+?\])?\{\w+?\}\{\w+?\}\{.+?\})"), F.lit(1))
    name = lambda d: F.regexp_extract(d, r"\\definecolor(?:\[\w+?\])?\{(\w+?)\}", 1)
    return F.array_join(F.filter(found, lambda d: F.regexp_like(picture, F.concat(F.lit(r"\b"), name(d), F.lit(r"\b")))), "\n")


def _caption(figure: str) -> str:
    at = figure.rfind("\\caption{")
    if at < 0:
        return ""
    at, depth = at + len("\\caption"), 0
    for i in range(at, len(figure)):
        depth += (figure[i] == "{") - (figure[i] == "}")
        if not depth:
            return figure[at + 1 : i]
    return figure[at + 1 :]


def _dedent(code: str, prefix: str) -> str:
    rows = code.split("\n")
    if prefix and not prefix.strip():
        cut = min(len(r) - len(r.lstrip()) for r in rows if r.strip())
        return "\n".join(r[cut:] if r.strip() else "" for r in rows)
    if all(r.lstrip().startswith("%") for r in rows):
        return "\n".join(r.lstrip()[1:] for r in rows)
    return code.removeprefix(prefix)


def find_pictures(text: str) -> list[tuple[str, str]]:
    """(code, caption) of all pictures: first those that are alone in a figure with a caption, then all others."""
    whole = re.compile(r"([^\n]*?)(\\begin\{tikzpicture\}.*?\\end\{tikzpicture\})", re.DOTALL)
    out: dict[str, str] = {}
    for figure in re.findall(r"\\begin\{figure\}(.*?)\\end\{figure\}", text, re.DOTALL):
        if figure.count(PICTURE_START) == 1 and (m := whole.search(figure)) and (caption := _caption(figure)):
            caption = " ".join(re.sub(r"\\label\{[^{}]*\}", "", caption).split())
            out.setdefault(_dedent(m[0], m[1]), caption)
    for m in whole.finditer(text):
        out.setdefault(_dedent(m[0], m[1]), "")
    return list(out.items())


def pictures(c: Column) -> Column:
    """array<struct<code, caption>> of ``find_pictures``."""

    @F.pandas_udf("array<struct<code:string,caption:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"code": a, "caption": b} for a, b in find_pictures(t or "")])

    return run(c)


def minimal_document(imports: Column, colours: Column, macros: Column, picture: Column) -> Column:
    part = lambda x: F.when(F.trim(x) != "", F.concat(F.lit("\n\n"), x)).otherwise("")
    return F.concat(imports, part(colours), part(macros), F.lit("\n\n\\begin{document}\n\n"), substitute_images(picture), F.lit("\n\n\\end{document}"))


# --- macros

#: The four kinds of tokens: control word, control symbol, comment, any other character.
TEX_TOKEN = r"\\[A-Za-z@]+|\\(?s:.)|%[^\n]*\n?|(?s:.)"
_DEFINITION = re.compile(r"\\(?:re)?newcommand\*?\s*\{?\s*(\\[A-Za-z@]+|\\.)\s*\}?\s*(?:\[(\d)\])?\s*(?:\[([^\]]*)\])?\s*")


def tex_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TEX_TOKEN), F.lit(0))


def joined_tokens(tokens: Column, comments: bool = True) -> Column:
    """Text of tokens; without comments a blank keeps a control word apart from a letter that comes to stand after it."""
    if comments:
        return F.array_join(tokens, "")
    plain = F.filter(tokens, lambda t: ~F.startswith(t, F.lit("%")))
    glue = lambda text, t: F.concat(text, F.when(text.rlike(r"\\[A-Za-z@]+\z") & t.rlike(r"\A[A-Za-z]"), F.lit(" ")).otherwise(""), t)
    return F.aggregate(plain, F.lit(""), glue)


def definitions(macros: str) -> dict[str, tuple[int, str | None, str, str]]:
    """name -> (number of arguments, default of the first, body, whole definition); the last one counts."""
    out, at = {}, 0
    while m := _DEFINITION.search(macros, at):
        end = closing(macros, m.end())
        if end < 0:
            at = m.end()
            continue
        out[m[1]] = (int(m[2] or 0), m[3], macros[m.end() + 1 : end], macros[m.start() : end + 1])
        at = end + 1
    return out


def _uses(name: str) -> re.Pattern:
    return re.compile(re.escape(name) + (r"(?![A-Za-z@])" if name[1:].isalpha() or "@" in name else ""))


def expand(text: str, known: dict[str, tuple[int, str | None, str, str]], depth: int = 0) -> str:
    """``text`` with macros replaced by their bodies, and theirs; deeper than MOST_DEPTH it stays as it is."""
    if depth >= MOST_DEPTH or not known:
        return text
    either = re.compile("|".join(f"(?:{_uses(n).pattern})" for n in sorted(known, key=len, reverse=True)))
    out, done = [], 0
    for m in either.finditer(text):
        if m.start() < done:
            continue
        n, default, body, _ = known[m[0]]
        at, given = m.end(), []
        if default is not None:
            here = _after_blank(text, at)
            end = closing(text, here) if here < len(text) and text[here] == "[" else -1
            given.append(text[here + 1 : end] if end > 0 else default)
            at = end + 1 if end > 0 else at
        while len(given) < n:
            here = _after_blank(text, at)
            if here >= len(text):
                break
            end = closing(text, here) if text[here] == "{" else here
            if end < 0:
                break
            given.append(text[here + 1 : end] if text[here] == "{" else text[here])
            at = end + 1
        if len(given) < n:
            continue
        new = re.sub(r"#([1-9])", lambda x: given[int(x[1]) - 1] if int(x[1]) <= len(given) else x[0], body)
        out += [text[done : m.start()], expand(new, known, depth + 1)]
        done = at
    return "".join(out) + text[done:]


def used_definitions(macros: str, text: str) -> list[str]:
    """The definitions that ``text`` uses, and those that these use, in their order."""
    known, used, todo = definitions(macros), set(), [text]
    while todo:
        part = todo.pop()
        for name in known:
            if name not in used and _uses(name).search(part):
                used.add(name)
                todo.append(known[name][2])
    return [known[n][3] for n in known if n in used]


def expanded(macros: Column, text: Column) -> Column:
    @F.pandas_udf("string")
    def run(macros: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else expand(t, definitions(m or "")) for m, t in zip(macros, texts, strict=True)], dtype=object)

    return run(macros, text)


def used_macros(macros: Column, text: Column) -> Column:
    @F.pandas_udf("string")
    def run(macros: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(["\n\n".join(used_definitions(m or "", t or "")) for m, t in zip(macros, texts, strict=True)], dtype=object)

    return run(macros, text)


# --- other


def all_start(c: Column, prefix: str) -> Column:
    return F.forall(F.split(c, "\n"), lambda x: F.startswith(x, F.lit(prefix)))


def without_prefix(c: Column, prefix: str) -> Column:
    cut = lambda x: F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x)
    return F.array_join(F.transform(F.split(c, "\n"), cut), "\n")


def code_examples(c: Column) -> Column:
    """Bodies of a manual's visible ``codeexample`` environments with the options pre, post and preamble around them."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(_examples(t or "")))

    return run(c)


def _examples(text: str):
    for m in re.finditer(r"\\begin\{codeexample\}", text):
        at, options = m.end(), ""
        if text[at : at + 1] == "[":
            end = closing(text, at)
            if end < 0:
                continue
            options, at = text[at + 1 : end], end + 1
        stop = text.find("\\end{codeexample}", at)
        if stop < 0 or re.search(r"(?:^|,)\s*(?:hidden|code only)\s*(?:,|$|=\s*true)", options):
            continue
        named = {}
        for o in re.finditer(r"(?:^|,)\s*(pre|post|preamble)\s*=\s*", options):
            end = closing(options, o.end())
            named[o[1]] = options[o.end() + 1 : end] if end > 0 else options[o.end() :].split(",")[0]
        yield "\n".join(x for x in (named.get("preamble"), named.get("pre"), text[at:stop].strip(), named.get("post")) if x)


def html_code(c: Column) -> Column:
    """Codes of ``<pre><code>`` blocks of a page that hold a whole picture, made a document where they are none."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?is)<pre[^>]*>\s*<code[^>]*>(.*?)</code>\s*</pre>"), F.lit(1))
    plain = lambda b: F.replace(F.replace(F.replace(F.replace(F.replace(b, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    whole = lambda b: b.rlike(r"(?s)\\begin\{(tikzpicture|forest)\}.*\\end\{\1\}")
    body = lambda b: F.when(F.contains(b, F.lit("\\begin{document}")), b).otherwise(F.concat(F.lit("\\begin{document}\n"), b, F.lit("\n\\end{document}")))
    head = lambda b: F.when(F.contains(b, F.lit("\\documentclass")), b).otherwise(F.concat(F.lit("\\documentclass[tikz]{standalone}\n"), b))
    return F.transform(F.filter(F.transform(blocks, plain), whole), lambda b: head(body(b)))


def caption_sentence(caption: Column, description: Column) -> Column:
    """Both as sentences: a capital first, a full stop at the end where no sentence mark stands."""
    def sentence(c: Column) -> Column:
        c = F.trim(F.coalesce(c, F.lit("")))
        told = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))
        return F.when(c == "", F.lit(None).cast("string")).when(c.rlike(r"[.!?]$"), told).otherwise(F.concat(told, F.lit(".")))

    return F.concat_ws(" ", sentence(caption), sentence(description))
