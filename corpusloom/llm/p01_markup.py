"""Problem 1: markup residue in text documents.

Method: tag-path ratios.  The leaves of a page (stretches of text, list items,
headings, tables, code) are grouped by their path of block tags from the root to
the leaf; for each path the text length and the punctuation are taken per leaf,
both are smoothed along the page and fused, and a path whose (lower) median is below the
threshold (a share of the standard deviation) is dropped as furniture, with the
structures in it.  What stays is read again for Markdown, wiki and LaTeX
notation, whichever the page mixes, and comes out as clean text in which
headings (``#``), lists (``-``, ``1.``), tables (``|``), code blocks (fences)
and formulas (``$$`` or ``$``) are still marked.

Defined cases: a null page has null text and no structures; an empty page has
empty text; markup shown as escaped text is markup, that in scripts, styles and
comments is not; unclosed tags end with their parent or the page; a page of a
single path is content as a whole; repeated rows give repeated results; an
empty input gives an empty result; other columns pass through, those with the
names of the results are replaced.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.common import add_columns

HEADING, LIST, TABLE, CODE, FORMULA = "baslik", "liste", "tablo", "kod", "formul"
#: Tags that start a block, tags whose content is no text, and all tags that are known when shown as text.
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form header hr html li main nav ol p section table tbody td tfoot th thead tr ul center".split())
SILENT = ("script", "style", "noscript", "template", "title", "iframe")
KNOWN = sorted({*BLOCK, *SILENT, *"h1 h2 h3 h4 h5 h6 pre code math mi mo mn msup msub mfrac mrow msqrt br b i u a em strong font span syntaxhighlight source ref sub sup meta head".split()}, key=len, reverse=True)
FURNITURE_SHARE = 0.15

_SHOWN = re.compile(r"&lt;(/?\s*(?:" + "|".join(KNOWN) + r")\b(?:(?!&gt;|&lt;)[^<>])*)&gt;", re.I)
_SHOWN_COMMENT = re.compile(r"&lt;!--.*?--&gt;", re.S)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(SILENT) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<\s*(/?)\s*([A-Za-z][A-Za-z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_ENTITY = re.compile(r"&(?:lt|gt|amp|quot|nbsp|#\d+|#x[0-9a-f]+);", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?’'\"()“”-]")

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*[\w+#.-]*\s*$")
_ATX = re.compile(r"^ {0,3}(#{1,6})\s+(\S.*?)\s*#*\s*$")
_SETEXT = re.compile(r"^ {0,3}(?:={3,}|-{3,})\s*$")
_WIKI_HEAD = re.compile(r"^\s*(={1,6})\s*([^=\s](?:.*[^=\s])?)\s*\1\s*$")
_TEX_HEAD = re.compile(r"\\((?:sub){0,2}section|chapter|part|(?:sub)?paragraph)\*?\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
_BULLET = re.compile(r"^\s*(?:([-+•])\s+(?=\S)|(\*{1,4}|#{1,4})(?=[^\s*#-])|(\*{1,4})\s+(?=[^\s*]))")
_NUMBERED = re.compile(r"^\s*(\d{1,3})([.)])\s+(?=\S)")
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
_TEX_BLOCK = re.compile(r"\\begin\{(verbatim|lstlisting|minted|itemize|enumerate|description|tabular|tabularx|longtable|array|equation|align|gather|displaymath|eqnarray|multline|math)(\*?)\}((?:\[[^\]]*\])?(?:\{[^{}]*\})*)(.*?)\\end\{\1\2\}", re.S)
_TEX_KINDS = {**dict.fromkeys(("verbatim", "lstlisting", "minted"), CODE), **dict.fromkeys(("itemize", "enumerate", "description"), LIST), **dict.fromkeys(("tabular", "tabularx", "longtable", "array"), TABLE)}
_WIKI_TABLE = re.compile(r"^\s*\{\|(.*?)^\s*\|\}", re.S | re.M)
_DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]{1,200}?)(?<=[^\s\\])\$(?![\d$])")
_TEX_SIGN = re.compile(r"[\\^_=+<>{}]|^[A-Za-z]$")
_TEX_STYLE = re.compile(r"\\(?:textbf|textit|emph|underline|texttt|textsc|mbox|text)\{([^{}]*)\}")
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_MD_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_STRONG = re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1|'{2,5}([^'\n]+?)'{2,5}")
_LIGHT = re.compile(r"(?<![\w*_\\])([*_])(?=[^\s*_])([^*_\n]{1,200}?)(?<=[^\s*_])\1(?![\w*_])")
_BLANKS = re.compile(r"[ \t\f\v\u00a0]+")
_MARK = "\ue000{}\ue001"
_MARKED = re.compile("\ue000(\\d+)\ue001")
_LEAF = re.compile("(\ue000\\d+\ue001|\ue004[^\n]*|\n[ \\t\\r]*\n\\s*)")
_ITEM_MARK = re.compile("^\ue004 *(?:-|\\d+\\.) ")
_LEAF_TAGS = {HEADING: "h", TABLE: "table", CODE: "pre"}  # a formula belongs to the path it stands in


class _Page:
    """Leaves of a page in their order, each with its tag path, and the blocks that were taken out of the text."""

    def __init__(self):
        self.nodes: list[tuple[tuple, str]] = []  # path from the root, text
        self.blocks: list[str] = []
        self.block_kinds: list[str] = []
        self.kinds: set[str] = set()  # of structures in kept leaves

    def _mark(self, kind: str, text: str) -> str:
        self.blocks.append(text)
        self.block_kinds.append(kind)
        return _MARK.format(len(self.blocks) - 1)

    def block(self, kind: str, text: str) -> str:
        return "\n\n" + self._mark(kind, text) + "\n\n"

    def inline(self, kind: str, text: str) -> str:
        return self._mark(kind, text)

    def add(self, path: tuple, text: str) -> None:
        """The leaves of a stretch of text: list items and blocks end the path of the text around them."""
        for piece in _LEAF.split(text):
            if not piece:
                continue
            leaf = path
            if piece[0] == "\ue004":
                depth = (len(piece) - len(piece[1:].lstrip()) - 1) // 2
                leaf = (*path, *("ul",) * (depth + 1), "li")
            elif m := _MARKED.fullmatch(piece):
                leaf = (*path, _LEAF_TAGS.get(self.block_kinds[int(m.group(1))], ())) if self.block_kinds[int(m.group(1))] in _LEAF_TAGS else path
            self.nodes.append((leaf, piece))

    def shown(self, piece: str) -> str:
        """What a leaf holds, its blocks included; the mark of a list item is none of it."""
        piece = _ITEM_MARK.sub("", piece)
        while "\ue000" in piece:
            piece = _MARKED.sub(lambda m: self.blocks[int(m.group(1))], piece)
        return piece.strip()


def _plain(text: str) -> str:
    """A text with its entities decoded, also those of a text that was escaped twice."""
    text = html.unescape(text)
    return html.unescape(text) if _ENTITY.search(text) else text


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _parse(source: str) -> _Page:
    page = _Page()
    source = _SHOWN_COMMENT.sub("", source)
    source = _SHOWN.sub(r"<\1>", source)
    path: list[str] = []
    buffer: list[str] = []
    hold: list[tuple[str, int]] = []  # open structures: tag, where their text starts in the buffer
    lists: list[list] = []

    def flush() -> None:
        text = "".join(buffer)
        if text.strip():
            page.add(tuple(path), ("\n\n" if page.nodes else "") + text.strip("\n"))
        buffer.clear()

    def close(tag: str) -> None:
        while hold:
            name, start = hold.pop()
            inner = "".join(buffer[start:])
            del buffer[start:]
            if name == "table":
                rows = [[c for c in r.split("\ue003") if c.strip()] for r in inner.split("\ue002")]
                rows = ["| " + " | ".join(_squeeze(c) for c in r) + " |" for r in rows if r]
                buffer.append(page.block(TABLE, "\n".join(rows)) if rows else inner)
            elif name in ("pre", "syntaxhighlight", "source"):
                buffer.append(page.block(CODE, "```\n" + inner.strip("\n") + "\n```"))
            elif name == "math":
                buffer.append(page.inline(FORMULA, "$" + _squeeze(inner) + "$") if inner.strip() else "")
            elif inner.strip():
                buffer.append(page.block(HEADING, "#" * int(name[1]) + " " + _squeeze(inner)))
            if name == tag:
                break

    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            buffer.append(_plain(source[at : m.start()]))
        at = m.end()
        if not m.group(3):
            continue
        closing, tag = bool(m.group(2)), m.group(3).lower()
        held = [h[0] for h in hold]
        if tag in ("pre", "syntaxhighlight", "source", "math", "table") or (tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6")):
            if closing:
                if tag in held:
                    close(tag)
            elif tag not in held and not (tag == "source" and m.group(4).rstrip().endswith("/")):
                if tag != "math" and not held:
                    buffer.append("\n")
                hold.append((tag, len(buffer)))
        elif "pre" in held or "math" in held:
            if tag == "br":
                buffer.append("\n")
        elif "table" in held:
            if tag in ("tr", "td", "th") and not closing:
                buffer.append("\ue002" if tag == "tr" else "\ue003")
            elif tag in BLOCK or tag == "br":
                buffer.append(" ")
        elif held:
            buffer.append(" " if tag in BLOCK or tag == "br" else "")
        elif tag in ("ul", "ol"):
            buffer.append("\n")
            if closing:
                if lists:
                    lists.pop()
                if not lists:
                    buffer.append("\n")
            else:
                lists.append([tag, 0])
        elif tag == "li":
            if not closing:
                if lists:
                    lists[-1][1] += 1
                mark = f"{lists[-1][1]}." if lists and lists[-1][0] == "ol" else "-"
                buffer.append("\n\ue004" + "  " * max(0, len(lists) - 1) + mark + " ")
        elif tag == "ref":
            buffer.append(" [" if not closing else "]")
        elif tag == "br":
            buffer.append("\n")
        elif tag in BLOCK:
            if lists and tag in ("p", "div"):
                buffer.append(" ")
                continue
            flush()
            if closing:
                if tag in path:
                    del path[len(path) - 1 - path[::-1].index(tag) :]
                    lists.clear()
            elif tag != "hr":
                path.append(tag)
    if at < len(source):
        buffer.append(_plain(source[at:]))
    if hold:
        close("")
    flush()
    return page


def _smooth(x: np.ndarray) -> np.ndarray:
    if len(x) < 3:
        return x
    kernel = np.array([0.25, 0.5, 0.25])
    padded = np.concatenate([x[:1], x, x[-1:]])
    return np.convolve(padded, kernel, mode="valid")


def content_nodes(nodes: list[tuple[tuple, str]]) -> list[bool]:
    """Which leaves belong to content, by the ratios of their tag paths; blank ones go with any."""
    at = [i for i, (_, t) in enumerate(nodes) if t.strip()]
    paths: dict[tuple, list[int]] = {}
    for k, i in enumerate(at):
        paths.setdefault(nodes[i][0], []).append(k)
    keep = [True] * len(nodes)
    if len(paths) < 2:
        return keep
    size = np.array([len(nodes[i][1].strip()) for i in at], dtype=float)
    points = np.array([len(_PUNCTUATION.findall(nodes[i][1])) for i in at], dtype=float)
    length, marks = np.zeros(len(at)), np.zeros(len(at))
    for ks in paths.values():
        length[ks], marks[ks] = size[ks].mean(), points[ks].mean()
    fused = np.sqrt(_smooth(length) * (1 + _smooth(marks)))
    least = FURNITURE_SHARE * fused.std()
    for ks in paths.values():
        if np.sort(fused[ks])[(len(ks) - 1) // 2] < least:
            for k in ks:
                keep[at[k]] = False
    return keep


def _read_notation(page: _Page, text: str) -> str:
    """Markdown, wiki and LaTeX structures of a text, as clean text."""

    def environment(m: re.Match) -> str:
        kind = _TEX_KINDS.get(m.group(1), FORMULA)
        body = m.group(4)
        if kind == CODE:
            return page.block(CODE, "```\n" + body.strip("\n") + "\n```")
        if kind == FORMULA:
            return page.block(FORMULA, "$$" + _squeeze(body) + "$$")
        if kind == TABLE:
            rows = [r for r in re.split(r"\\\\|\\hline|\\toprule|\\midrule|\\bottomrule", body) if r.strip()]
            return page.block(TABLE, "\n".join("| " + " | ".join(_squeeze(_styles(c)) for c in re.split(r"(?<!\\)&", r)) + " |" for r in rows))
        items = [x for x in re.split(r"\\item(?:\[[^\]]*\])?", body) if x.strip()]
        number = m.group(1) == "enumerate"
        return page.block(LIST, "\n".join((f"{i}. " if number else "- ") + _squeeze(_styles(x)) for i, x in enumerate(items, 1)))

    def wiki_table(m: re.Match) -> str:
        rows = []
        for part in re.split(r"^\s*\|-.*$", m.group(1).partition("\n")[2], flags=re.M):
            cells = [c for line in part.splitlines() for c in re.split(r"\|\||!!", line.strip().lstrip("|!")) if line.strip().startswith(("|", "!")) and not line.strip().startswith("|+")]
            if cells:
                rows.append("| " + " | ".join(_squeeze(_styles(c)) for c in cells) + " |")
        return page.block(TABLE, "\n".join(rows))

    lines, out, i = text.split("\n"), [], 0
    if "```" in text or "~~~" in text:  # fences first: nothing in them is markup
        while i < len(lines):
            m = _FENCE.match(lines[i])
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(m.group(1)) and not lines[j].strip().strip(m.group(1)[0])), None) if m else None
            if end is not None:
                out.append(page.block(CODE, "```\n" + "\n".join(lines[i + 1 : end]) + "\n```"))
                i = end + 1
            else:
                out.append(lines[i])
                i += 1
        text = "\n".join(out)
    if "\\" in text:
        text = re.sub(r"(?<=\S)~(?=\s|$|\S)", " ", text) if "~~" not in text else text  # a tie
        text = _TEX_BLOCK.sub(environment, text)
        text = _TEX_HEAD.sub(lambda m: page.block(HEADING, "#" * (1 + m.group(1).count("sub") + ("paragraph" in m.group(1))) + " " + _squeeze(_styles(m.group(2)))), text)
    if "{|" in text:
        text = _WIKI_TABLE.sub(wiki_table, text)
    if "$" in text or "\\" in text:
        text = _DISPLAY.sub(lambda m: page.inline(FORMULA, "$$" + _squeeze(m.group(1) or m.group(2) or m.group(3)) + "$$"), text)
        text = _INLINE.sub(lambda m: page.inline(FORMULA, "$" + m.group(1) + "$") if _TEX_SIGN.search(m.group(1)) else m.group(), text)
    return _read_lines(page, text)


def _styles(text: str) -> str:
    """A text without marks of emphasis and links."""
    text = _TEX_STYLE.sub(r"\1", text) if "\\" in text else text
    text = _WIKI_LINK.sub(r"\1", text) if "[[" in text else text
    text = _MD_LINK.sub(r"\1", text) if "](" in text else text
    text = _STRONG.sub(lambda m: m.group(2) or m.group(3), text) if "**" in text or "__" in text or "''" in text else text
    return _LIGHT.sub(r"\2", text) if "*" in text or "_" in text else text


def _item(line: str) -> tuple[str, str] | None:
    """(kind of mark, text) of a line that could be a list item."""
    m = _BULLET.match(line)
    if m:
        mark = m.group(1) or m.group(2) or m.group(3)
        if mark[0] == "*" and line.strip().startswith("**") and line.strip().endswith("**"):
            return None
        if m.group(2) and mark[0] == "*" and re.match(r"\*{1,2}[^*\n]+\*{1,2}(?!\w)", line.strip()):
            return None  # emphasis
        return mark[0], line[m.end() :]
    m = _NUMBERED.match(line)
    return ("1", line[m.end() :]) if m else None


def _read_lines(page: _Page, text: str) -> str:
    lines = text.split("\n")
    out, i, n = [], 0, len(lines)
    while i < n:
        line = lines[i]
        bare = line.strip()
        if not bare or "\ue000" in bare and _MARKED.fullmatch(bare) or bare[0] == "\ue004":
            out.append(line)
            i += 1
            continue
        follow = lines[i + 1] if i + 1 < n else ""
        m = _WIKI_HEAD.match(line)
        if m:
            out.append(page.block(HEADING, "#" * len(m.group(1)) + " " + _styles(m.group(2))))
            i += 1
            continue
        if "|" in bare and "|" in follow and _TABLE_RULE.match(follow):
            end = i + 2
            while end < n and "|" in lines[end] and lines[end].strip():
                end += 1
            rows = [lines[i], *lines[i + 2 : end]]
            out.append(page.block(TABLE, "\n".join("| " + " | ".join(_squeeze(_styles(c)) for c in r.strip().strip("|").split("|")) + " |" for r in rows)))
            i = end
            continue
        m = _ATX.match(line)
        if m and not (len(m.group(1)) == 1 and (_ATX.match(follow) or (i and _ATX.match(lines[i - 1]) and lines[i - 1].strip()))):
            out.append(page.block(HEADING, m.group(1) + " " + _styles(m.group(2))))
            i += 1
            continue
        if _SETEXT.match(follow) and (i == 0 or not lines[i - 1].strip()) and len(bare) <= 120 and (follow.strip()[0] == "=" or "|" not in bare) and not _SETEXT.match(line):
            out.append(page.block(HEADING, ("#" if follow.strip()[0] == "=" else "##") + " " + _styles(bare)))
            i += 2
            continue
        item = _item(line) or (("#", m.group(2)) if m else None)
        if item:
            end, items = i, []
            while end < n and (x := _item(lines[end]) or (("#", _ATX.match(lines[end]).group(2)) if _ATX.match(lines[end]) else None)):
                items.append(x)
                end += 1
            first = _NUMBERED.match(line)
            if len(items) > 1 or item[0] in "-+*•" and not first:
                number = item[0] in "1#"
                out.append(page.block(LIST, "\n".join((f"{k}. " if number else "- ") + _styles(x[1].strip()) for k, x in enumerate(items, 1))))
                i = end
                continue
        out.append(_styles(line))
        i += 1
    return "\n".join(out)


def convert(source: str) -> tuple[str, list[str]]:
    """(clean text, kinds of structure) of a page."""
    page = _parse(source)
    if not page.nodes:
        return "", []
    kept = [t for (_, t), ok in zip(page.nodes, content_nodes([(p, page.shown(t)) for p, t in page.nodes])) if ok]
    text = _read_notation(page, "".join(kept).strip("\n"))
    if any(t[0] == "\ue004" for t in kept):
        page.kinds.add(LIST)
    lines = [_BLANKS.sub(" ", x).rstrip() if "\ue004" in x else _BLANKS.sub(" ", x).strip() for x in text.replace("\r", "").split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).replace("\ue004", "")
    for _ in range(4):  # blocks may stand in blocks
        if "\ue000" not in text:
            break
        for m in _MARKED.finditer(text):
            page.kinds.add(page.block_kinds[int(m.group(1))])
        text = _MARKED.sub(lambda m: page.blocks[int(m.group(1))].strip("\n"), text)
    return text.strip(), sorted(page.kinds)


def clean_text(df: DataFrame, source_col: str, out_col: str = "clean_text", kinds_col: str = "structures") -> DataFrame:
    """``df`` with clean text and the kinds of structure that the markup of a column expresses."""

    def compute(pages: list) -> list[pa.Array]:
        out = [(None, []) if s is None else convert(s) for s in pages]
        return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))]

    return add_columns(df, source_col, [T.StructField(out_col, T.StringType()), T.StructField(kinds_col, T.ArrayType(T.StringType()))], compute)
