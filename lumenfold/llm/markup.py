"""Markup residue in text documents: clean text by tree scoring.

A text is read as a tree. HTML tags make its containers (well-formed or not: missing end tags are closed by what follows,
stray ones are dropped); Markdown, wiki and LaTeX lines make headings, lists, quotes, tables, code and formulas. Each
paragraph passes points for its length and commas to its parent and half of them to the grandparent, discounted by its
share of linked text. The container with most points is kept with those of its siblings that reach a fifth of its points,
hold structure (heading, list, code, table, formula), or are running text with few links; what is left out are
navigation-like parts, scripts and styles. A text without containers is one container and is kept whole.

In the result a heading is a line `# ...` (as many # as its level), a list item a line `- ...` or `1. ...`, code stands
between lines of ```, a formula between $ signs, a table row has cells joined by ` | `. Inline marks, links, templates,
references, comments and character entities give way to their text.

What the reading consumes as markup is counted by its language there and then, so `constructs` > 0 names the texts that
carried markup; nothing else decides. In program source (a row whose `source` flag is set) only the comments are read, and in
them only what no program writes by itself; the code stays. Comparison signs, prices, paths, issue numbers, rows of asterisks
and addresses in angle brackets are no constructs.

No text is lost to damage: a start tag of a script or the like without its end tag, an open comment, brace or template only
loses its own marks; fenced and inline code stays as it is; nesting is followed by stacks to any depth.

Defined results: rows without id are left out; null text gives null clean text and 0 constructs; empty text stays; no length is cut.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import spread

# Element names of the HTML standard, split by what they do here.
BLOCK = "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
INLINE = "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label link mark math meta meter noscript nowiki output picture q ref s samp select small source span strike strong sub sup textarea time title tt u var video wbr".split()
DROPPED = "script style head iframe noscript object svg template".split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
# LaTeX commands that may stand without a brace.
LATEX_BARE = "alpha beta gamma delta epsilon theta lambda mu pi sigma omega sum int prod infty partial nabla cdot cdots ldots dots le ge leq geq ne neq approx times div pm in subset cup cap log ln sin cos tan exp lim max min quad qquad item maketitle tableofcontents LaTeX TeX newline noindent bfseries itshape large Large small hline centering left right to rightarrow Rightarrow".split()

_NAMES = "|".join(sorted({*BLOCK, *INLINE, *DROPPED, *VOID}, key=len, reverse=True))
_ATTR = r"""(?:\s+[A-Za-z_:@-][\w:.-]*(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))?)*"""
TAG = re.compile(rf"<(/?)({_NAMES})({_ATTR})\s*(/?)>", re.I)
#: A tag cut off by the end of the passage or by the next tag.
TORN = re.compile(rf"""<(?:{_NAMES})\s+[A-Za-z-]+\s*=\s*(?:"[^"<>]*"?|'[^'<>]*'?|[^\s"'<>=]*)\s*(?=$|<)|</(?:{_NAMES})\s*(?=$|<)""", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!--|<!DOCTYPE[^>]*>|<!\[CDATA\[|\]\]>|<\?xml[^>]*>", re.S | re.I)
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));|&(nbsp|lt|gt|amp|quot|mdash|ndash|hellip|eacute|uuml|ouml|auml|szlig)(?![\w=;])")

MD = {
    "heading": re.compile(r"(?m)^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$"),
    "setext": re.compile(r"(?m)^(\S[^\n]*)\n(={3,}|-{3,})[ \t]*$"),
    "fence": re.compile(r"(?m)^ {0,3}(?:```|~~~)[^\n`]*$"),
    "image": re.compile(r"!\[([^\]\n]*)\]\(([^)\s]*)[^)\n]*\)"),
    "link": re.compile(r"(?<!!)\[([^\[\]\n]+)\](?:\(([^)\s]*)[^)\n]*\)|\[([^\]\n]*)\])"),
    "linkdef": re.compile(r"(?m)^ {0,3}\[[^\]\n]+\]:[ \t]+\S+.*$\n?"),
    "footnote": re.compile(r"\[\^[^\]\n]+\]:?"),
    "bold": re.compile(r"(?<![\w*])\*\*\*?(?=[^\s*])([^*\n]*?[^\s*])\*\*\*?(?![\w*])|(?<!\w)__(?=[^\s_])([^_\n]*?[^\s_])__(?!\w)"),
    "em": re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])|(?<![\w_/\\.-])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w/])"),
    "strike": re.compile(r"~~(?=\S)([^~\n]*?\S)~~"),
    "code": re.compile(r"(?<!`)`(?!`)([^`\n]+)`(?!`)"),
    "quote": re.compile(r"(?m)^ {0,3}>[ \t]+(?=\S)"),
    "task": re.compile(r"(?m)^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]+"),
    "table": re.compile(r"(?m)^[ \t]*\|.*\|[ \t]*$|^[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+$"),
    "bullet": re.compile(r"(?m)^[ \t]*[-*+][ \t]+(?=\S)"),
    "number": re.compile(r"(?m)^[ \t]*\d{1,3}[.)][ \t]+(?=\S)"),
}
WIKI = {
    "heading": re.compile(r"(?m)^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$"),
    "link": re.compile(r"\[\[([^\[\]\n]+)\]\]"),
    "extlink": re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\]\n]*))?\]"),
    "template": re.compile(r"\{\{([^{}]*)\}\}"),
    "table": re.compile(r"(?m)^[ \t]*(?:\{\||\|\}|\|-|\|\+).*$\n?"),
    "bold": re.compile(r"'''(?=\S)([^\n]*?\S)'''"),
    "em": re.compile(r"''(?=[^\s'])([^'\n]*?[^\s'])''"),
    "magic": re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|(?m:^#REDIRECT\b)"),
    "torn": re.compile(r"(?m)\[\[[^\[\]\n]*$|\{\{[^{}\n]*$|^[^\[\]\n]*\]\](?!\()|^[^{}\n]*\}\}$"),
}
LATEX = {
    "command": re.compile(r"(?<![\w:\\])\\(?:[A-Za-z]+\*?(?=[{\[])|begin\b|end\b)|~\\(?:cite|ref)\b|(?<=\{)\\(?:it|bf|em|tt|rm|sc|sl|large|Large|small|huge)\b"),
    "bare": re.compile(rf"(?<![\w:\\])\\(?:{'|'.join(LATEX_BARE)})(?![A-Za-z\\])"),
    "math": re.compile(r"\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s$\d])[^$\n]*[\\^_{=+][^$\n]*\$(?!\d)|\\\([^\n]*?\\\)|\\\[.*?\\\]", re.S),
    "escape": re.compile(r"(?<![\w:\\])\\[%&#_$](?=\W|\w)"),
    "quotes": re.compile(r"``[^`'\n]+''"),
}
#: A text without any of this has no construct; it needs no reading.
QUICK = r"[<&`\[{$\\*~|]|__|''|==|(?m:^\s*(?:#{1,6}|[-+>;:]|\d{1,3}[.)])\s)|(?m:^-{3,}\s*$)|(?<!\w)_\S"
_QUICK = re.compile(QUICK)
_LISTS = ("bullet", "number")


def _entity(m: re.Match) -> bool:
    return m.group(1) is None or m.group(1) + ";" in html.entities.html5


class Node:
    __slots__ = ("kind", "parts", "kids", "linked", "score", "parent", "size")

    def __init__(self, kind: str, parent: Node | None = None):
        self.kind, self.parent, self.size = kind, parent, 0
        self.parts: list[str] = []
        self.kids: list[Node] = []
        self.linked, self.score = 0, 0.0
        if parent is not None:
            parent.kids.append(self)

    def text(self) -> str:
        return re.sub(r"[ \t]+", " ", "".join(self.parts)).strip(" \t")


def _tags(text: str) -> list[re.Match]:
    """The tags of a text. `Vec<b>` is program source: where nothing but bare names after words stands, without end signs,
    attributes or end tags, they are no tags."""
    found = list(TAG.finditer(text))
    ended = {m.group(2).lower() for m in found if m.group(1)}
    sure = lambda m: not m.start() or not text[m.start() - 1].isalnum() or m.group(1) or m.group(3).strip() or m.group(2).lower() in VOID or m.group(2).lower() in ended
    return found if any(map(sure, found)) else []


def _tree(text: str, tags: list[re.Match]) -> Node:
    """HTML to a tree of containers and text leaves. A block tag closes the open paragraph; ends close the nearest match; what
    is left out as a whole (scripts and the like) needs its end tag."""
    root = Node("root")
    at, leaf, drop, link = root, None, None, 0
    pos = 0
    open_ends = Counter(m.group(2).lower() for m in tags if m.group(1))
    depth: Counter = Counter()  # open containers by kind, so an end tag without a start is known at once

    def write(s: str) -> None:
        nonlocal leaf
        if drop or not s or (leaf is None and not s.strip()):
            return
        if leaf is None:
            leaf = Node("text", at)
        leaf.parts.append(s)
        if link:
            leaf.linked += len(s)

    for m in tags:
        write(text[pos : m.start()])
        pos = m.end()
        end, name = m.group(1), m.group(2).lower()
        if end:
            open_ends[name] -= 1
        if drop:
            if end and name == drop:
                drop = None
            continue
        if name in DROPPED:
            drop = None if end or m.group(4) or open_ends[name] <= 0 else name
        elif name == "a":
            link = 0 if end else 1
        elif name == "br":
            write("\n")
        elif name in ("code", "tt", "kbd", "samp") and at.kind != "pre":
            write("`")
        elif name == "math":
            write("$")
        elif name == "ref":
            write(" ")
        elif name in BLOCK:
            leaf = None
            if end:
                if depth[name] > 0:
                    while at.kind != name:
                        depth[at.kind] -= 1
                        at = at.parent
                    depth[name] -= 1
                    at = at.parent
            else:
                while at.kind in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd") or (at.kind == name == "li"):
                    depth[at.kind] -= 1
                    at = at.parent
                if name != "hr":
                    at = Node(name, at)
                    depth[name] += 1
    write(text[pos:])
    return root


def _upwards(root: Node) -> list[Node]:
    """All nodes, children before their parents."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(n.kids)
    return out[::-1]


def _score(root: Node) -> None:
    """Sets sizes (length of the text below), linked lengths and scores."""
    for node in _upwards(root):
        if node.kind == "text":
            node.size = len(node.text())
            continue
        node.size, node.linked = sum(k.size for k in node.kids), sum(k.linked for k in node.kids)
        for k in node.kids:
            if k.kind in ("text", "p", "pre", "td", "blockquote") and k.size >= 25:
                points = (1 + "".join(_flat(k)).count(",") + min(3, k.size // 100)) * (1 - k.linked / k.size)
                node.score += points
                if node.parent is not None:
                    node.parent.score += points / 2


def _flat(node: Node) -> Iterator[str]:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.kind == "text":
            yield n.text()
        stack.extend(reversed(n.kids))


_KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "pre", "table", "dl", "figure", "p"}


def _keep(root: Node) -> list[Node]:
    """The best container and the siblings on its way up that belong to it."""
    _score(root)
    best = root
    stack = list(root.kids)
    while stack:
        n = stack.pop()
        if n.kind not in ("text",) and n.score > best.score:
            best = n
        stack.extend(n.kids)
    left, right = [], []  # what is kept before and after the best one, the nearest first
    top = best
    while best.parent is not None:
        kids = best.parent.kids
        at = next(k for k, s in enumerate(kids) if s is best)
        left += [s for s in reversed(kids[:at]) if _belongs(s, top)]
        right += [s for s in kids[at + 1 :] if _belongs(s, top)]
        best = best.parent
    return [*reversed(left), top, *right]


def _belongs(s: Node, best: Node) -> bool:
    density = s.linked / s.size if s.size else 0
    if s.kind in ("nav", "footer", "aside", "menu") and density > 0.3:
        return False
    return s.score >= max(1.0, best.score * 0.2) or s.kind in _KEPT or density < 0.5


def _render(nodes: list[Node], code: Callable[[str], str]) -> list[str]:
    """The blocks of the nodes. code: keeps a piece of code from further reading."""
    below: dict[int, list[str]] = {}
    for top in nodes:
        for n in _upwards(top):
            kids = [below.pop(id(k), []) for k in n.kids]
            if n.kind == "text":
                t = n.text().strip()
                got = [t] if t else []
            elif n.kind in ("h1", "h2", "h3", "h4", "h5", "h6"):
                t = " ".join(x.strip() for x in _flat(n) if x.strip())
                got = ["#" * int(n.kind[1]) + " " + t] if t else []
            elif n.kind == "pre":
                got = [code("```\n" + html.unescape("\n".join("".join(k.parts) or "".join(_flat(k)) for k in n.kids)).strip("\n") + "\n```")]
            elif n.kind == "tr":
                cells = [" ".join(x for x in _flat(k) if x) for k in n.kids]
                got = [" | ".join(cells)] if any(cells) else []
            elif n.kind in ("ul", "ol", "menu"):
                items = [(k, b) for k, b in zip(n.kids, kids) if b]
                got = [(f"{no}. " if n.kind == "ol" else "- ") + "\n".join(b).removeprefix("- " if k.kind == "li" else "") for no, (k, b) in enumerate(items, 1)]
            elif n.kind == "li":
                parts = [x for b in kids for x in b]
                got = ["- " + "\n".join(parts)] if parts else []
            else:
                # the longest child's list is taken over, so a deep nest isn't copied at each level
                got = max(kids, key=len, default=[])
                at = next((k for k, b in enumerate(kids) if b is got), 0)
                before = [x for b in kids[:at] for x in b]
                if before:
                    got[:0] = before
                for b in kids[at + 1 :]:
                    got += b
            below[id(n)] = got
    return [x for top in nodes for x in below.get(id(top), [])]


def _wiki_link(m: re.Match) -> str:
    inner = m.group(1)
    if re.match(r"(?i)(?:category|file|image|kategorie|datei)\s*:", inner):
        return ""
    return inner.rpartition("|")[2] if "|" in inner else inner


def _template(inner: str) -> str:
    name, *args = inner.split("|")
    if "\n" in inner or name.strip().lower().startswith("infobox"):
        return "\n".join(f"- {a.strip()}" for a in args if "=" in a)
    return args[-1] if args else ""


#: Commands whose argument isn't text, layout commands without one, and heading levels.
_NO_TEXT = frozenset("label cite citep citet ref eqref pageref begin end vspace hspace input include usepackage documentclass bibliography bibliographystyle newcommand setlength includegraphics".split())
_LAYOUT = frozenset("maketitle tableofcontents hline noindent centering newline bfseries itshape large Large small quad qquad left right LaTeX TeX".split())
_LEVEL = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_LATEX_TOKEN = re.compile(
    r"(?P<cmd>~?(?:(?<![\w:\\])|(?=\\(?:begin|end|item|textbf|textit|emph|cite|ref|label)\b))\\(?P<name>[A-Za-z]+)\*?(?=[{\[])(?:\[[^\]\n]*\])?)|(?P<env>(?<![\w:\\])\\(?:begin|end)\b)|(?P<tie>~\\(?:cite|ref)\b)|(?P<switch>(?<=\{)(?:\\(?:it|bf|em|tt|rm|sc|sl|large|Large|small|huge)\b[ \t]*)+)"
    rf"|(?P<bare>(?<![\w:\\])\\(?:{'|'.join(LATEX_BARE)})(?![A-Za-z\\]))|(?P<escape>(?<![\w:\\])\\[%&#_$](?=\W|\w))|(?P<quotes>``[^`'\n]+'')|(?P<brk>\\\\)|(?P<open>\{{)|(?P<close>\}})"
)
_DOCUMENT = re.compile(r"\\(?:begin|section|chapter|subsection|item)\b")
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\}(?:\[[^\]]*\])?(.*?)\\end\{\1\}", re.S)
_EQUATION = re.compile(r"\\begin\{(equation|align|displaymath|math)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
#: In comments of program source: what no program writes by itself.
_COMMENTS_LINE = re.compile(r"(?m)(?:^|(?<=[\s;{}()]))(?://+!?|#+|--+|;;+)[ \t]+(\S[^\n]*)$")


class Reader:
    """One text's reading: what stands so far, pieces kept from further reading, constructs consumed by language."""

    def __init__(self, text: str):
        self.t = text
        self.kept: list[str] = []
        self.counts = {"html": 0, "markdown": 0, "wiki": 0, "latex": 0}

    def keep(self, piece: str) -> str:
        self.kept.append(piece)
        return f"\x00{len(self.kept) - 1}\x00"

    def take(self, language: str, pattern: re.Pattern, to) -> None:
        """Consume all matches. `to` may give None: then the match stays and doesn't count."""
        n = 0

        def put(m: re.Match) -> str:
            nonlocal n
            new = to(m) if callable(to) else m.expand(to)
            if new is None:
                return m.group(0)
            n += 1
            return new

        self.t = pattern.sub(put, self.t)
        self.counts[language] += n

    def found(self) -> int:
        return sum(self.counts.values())

    def code(self) -> None:
        """Fenced code (an open fence reaches to the end) and inline code are kept as they are."""
        if "\x00" in self.t:
            self.t = self.t.replace("\x00", self.keep("\x00"))
        if "```" in self.t or "~~~" in self.t:
            out, code = [], None
            for part in re.split(r"(?m)(^ {0,3}(?:```|~~~)[^\n`]*$)", self.t):
                if MD["fence"].fullmatch(part):
                    self.counts["markdown"] += 1
                    if code is None:
                        code = ""
                    else:
                        out.append(self.keep("```" + code + "```"))
                        code = None
                elif code is not None:
                    code += part
                else:
                    out.append(part)
            if code is not None:
                out.append(self.keep("```" + code.rstrip("\n") + "\n```"))
            self.t = "".join(out)
        if "`" in self.t:
            self.take("markdown", MD["code"], lambda m: self.keep(m.group(0)))

    def html(self) -> None:
        if "&" in self.t:
            self.counts["html"] += sum(map(_entity, ENTITY.finditer(self.t)))
            if "&lt;" in self.t and not TAG.search(self.t):  # tags that were escaped
                self.t = html.unescape(self.t)
        if "<" in self.t or "]]>" in self.t:
            self.take("html", COMMENT, "")
            tags = _tags(self.t)
            if tags:
                self.counts["html"] += len(tags)
                self.t = "\n\n".join(_render(_keep(_tree(self.t, tags)), self.keep))
            self.take("html", TORN, "")
        if self.counts["html"]:
            self.t = html.unescape(self.t).replace("\xa0", " ")

    def latex(self) -> None:
        if not ("\\" in self.t or "$" in self.t or "``" in self.t):
            return
        formula = lambda x: self.keep("$" + x.strip("$").removeprefix("\\(").removesuffix("\\)").removeprefix("\\[").removesuffix("\\]").strip() + "$")
        if _DOCUMENT.search(self.t):
            self.t = re.sub(r"(?m)(?<!\\)%(?=\s).*$", "", self.t)
        self.take("latex", _VERBATIM, lambda m: self.keep("```\n" + m.group(2).strip("\n") + "\n```"))
        self.take("latex", _EQUATION, lambda m: formula(m.group(3).strip()))
        self.take("latex", LATEX["math"], lambda m: formula(m.group(0)))
        stack: list[tuple[str | None, list[str]]] = [(None, [])]
        n, pos, t = 0, 0, self.t

        def close() -> None:
            name, parts = stack.pop()
            body = "".join(parts)
            if name == "":
                body = "{" + body + "}"
            elif name in _LEVEL:
                body = "\n" + "#" * _LEVEL[name] + " " + body + "\n"
            elif name == "item":
                body = "- " + body
            elif name in _NO_TEXT:
                body = ""
            stack[-1][1].append(body)

        for m in _LATEX_TOKEN.finditer(t):
            if m.start() < pos:
                continue
            stack[-1][1].append(t[pos : m.start()])
            pos, kind, put = m.end(), m.lastgroup, stack[-1][1].append
            if kind == "name":
                kind = "cmd"
            if kind == "cmd":
                n += 1
                name = m.group("name")
                if t[pos : pos + 1] == "{":
                    stack.append((name, []))
                    pos += 1
                elif name == "item":
                    label = re.search(r"\[([^\]\n]*)\]$", m.group(0))
                    put("- " + (label.group(1) + " " if label and label.group(1) else ""))
            elif kind in ("env", "tie"):
                n += 1
            elif kind == "switch":
                n += 1
                if stack[-1][0] == "" and not "".join(stack[-1][1]):
                    stack[-1] = ("switch", stack[-1][1])
            elif kind == "bare":
                n += 1
                name = m.group(0)[1:]
                put("- " if name == "item" else {"LaTeX": "LaTeX", "TeX": "TeX", "newline": "\n"}.get(name, "") if name in _LAYOUT else "$" + m.group(0) + "$")
                if name == "item":
                    pos += len(t[pos:]) - len(t[pos:].lstrip(" \t")) if t[pos : pos + 1] in " \t" else 0
            elif kind == "escape":
                n += 1
                put(m.group(0)[1:])
            elif kind == "quotes":
                n += 1
                put("“" + m.group(0)[2:-2] + "”")
            elif kind == "brk":
                put("\n" if n else m.group(0))
            elif kind == "open":
                stack.append(("", []))
            elif len(stack) == 1:
                put("}")
            else:
                name = stack[-1][0]
                close()
                if name and name != "switch" and t[pos : pos + 1] == "{":  # a further argument
                    stack[-1][1].append(" ")
                    stack.append((name, []))
                    pos += 1
        stack[-1][1].append(t[pos:])
        while len(stack) > 1:  # open to the end: the text stays
            name, parts = stack.pop()
            stack[-1][1].append(("{" if name == "" else "") + "".join(parts))
        if n:
            self.t = "".join(stack[0][1])
            self.counts["latex"] += n

    def templates(self) -> None:
        """Templates from the inside out, by a stack; braces without their match stay."""
        stack: list[list[str]] = [[]]
        pos, n = 0, 0
        for m in re.finditer(r"\{\{|\}\}", self.t):
            stack[-1].append(self.t[pos : m.start()])
            pos = m.end()
            if m.group(0) == "{{":
                stack.append([])
            elif len(stack) == 1:
                stack[-1].append("}}")
            else:
                inner = "".join(stack.pop())
                if "{" in inner or "}" in inner:
                    stack[-1].append("{{" + inner + "}}")
                else:
                    n += 1
                    stack[-1].append(_template(inner))
        stack[-1].append(self.t[pos:])
        self.t = "{{".join("".join(x) for x in stack)
        self.counts["wiki"] += n

    def lines(self) -> None:
        """Wiki and Markdown syntax to the plain form."""
        if any(x in self.t for x in ("[", "{", "''", "==", "__", "|", "#R", "#r")):
            marks = "[[" in self.t or "{{" in self.t
            self.templates()
            self.take("wiki", WIKI["table"], lambda m: m.group(0).lstrip()[2:].lstrip() if m.group(0).lstrip().startswith("|+") else "")
            if "||" in self.t or "!!" in self.t:
                self.t = re.sub(r"(?m)^[ \t]*[!|](?!\|)[ \t]*(.*)$", lambda m: re.sub(r"\s*(?:\|\||!!)\s*", " | ", m.group(1)).rstrip("| "), self.t)
            self.take("wiki", WIKI["heading"], lambda m: "#" * len(m.group(1)) + " " + m.group(2))
            self.take("wiki", WIKI["link"], _wiki_link)
            self.take("wiki", WIKI["extlink"], lambda m: m.group(1) or "")
            self.take("wiki", WIKI["bold"], r"\1")
            self.take("wiki", WIKI["em"], r"\1")
            self.take("wiki", WIKI["magic"], "")
            if marks or self.counts["wiki"]:
                self.take("wiki", WIKI["torn"], lambda m: re.sub(r"\[\[|\]\]|\{\{|\}\}", "", m.group(0)))
        self.take("markdown", MD["setext"], lambda m: ("# " if m.group(2)[0] == "=" else "## ") + m.group(1))
        self.take("markdown", MD["heading"], r"\1 \2")
        self.take("markdown", MD["image"], r"\1")
        self.take("markdown", MD["link"], r"\1")
        self.take("markdown", MD["linkdef"], "")
        self.take("markdown", MD["footnote"], "")
        self.take("markdown", MD["task"], "- ")
        self.take("markdown", MD["quote"], "")
        self.take("markdown", MD["table"], lambda m: " | ".join(c.strip() for c in m.group(0).strip().strip("|").split("|")) if re.search(r"[^\s|:-]", m.group(0)) else "")
        for k in ("bold", "em"):
            self.take("markdown", MD[k], lambda m: m.group(1) or m.group(2))
        self.take("markdown", MD["strike"], r"\1")
        # a list mark alone is plain text too: it counts beside other markup or as a list of at least two lines
        bullets, numbers = (len(MD[k].findall(self.t)) for k in _LISTS)
        if bullets + numbers >= 2 or self.found():
            self.counts["markdown"] += bullets + numbers
            self.t = MD["bullet"].sub("- ", self.t)

    def result(self) -> str:
        """The text with the kept pieces put back, from the outside in."""
        out: list[str] = []
        stack: list[str | None] = [self.t]
        while stack:
            x = stack.pop()
            if x is None:
                out.append("\x00")
                continue
            parts = re.split(r"\x00(\d+)\x00", x)
            if len(parts) == 1:
                out.append(x)
                continue
            for k in range(len(parts) - 1, -1, -1):
                if k % 2 == 0:
                    if parts[k]:
                        stack.append(parts[k])
                else:
                    piece = self.kept[int(parts[k])]
                    stack.append(None if piece == "\x00" else piece)
        return "".join(out)


def _comment(text: str) -> tuple[str, dict[str, int]]:
    """A comment of program source without what can only be markup."""
    r = Reader(text)
    if _QUICK.search(text) is None:
        return text, r.counts
    tags = [m for m in _tags(text) if m.group(1) or m.group(3).strip() or f"</{m.group(2).lower()}" in text.lower()]
    if tags:
        out, pos = [], 0
        for m in tags:
            out.append(text[pos : m.start()])
            pos = m.end()
        r.t = "".join(out) + text[pos:]
        r.counts["html"] += len(tags)
    r.take("html", ENTITY, lambda m: html.unescape(m.group(0)) if m.group(0).endswith(";") and _entity(m) else None)
    r.take("markdown", MD["image"], r"\1")
    r.take("markdown", MD["link"], lambda m: m.group(1) if m.group(2) and re.match(r"https?:|[./#]|mailto:", m.group(2)) else None)
    r.take("wiki", WIKI["link"], lambda m: _wiki_link(m) if re.search(r"[a-z]{3}", m.group(1)) else None)
    r.take("markdown", MD["strike"], r"\1")
    return r.t, r.counts


def _source(text: str) -> tuple[str, dict[str, int]]:
    counts = {"html": 0, "markdown": 0, "wiki": 0, "latex": 0}

    def one(m: re.Match) -> str:
        new, n = _comment(m.group(1))
        for k in counts:
            counts[k] += n[k]
        return m.group(0)[: m.start(1) - m.start()] + new

    return _COMMENTS_LINE.sub(one, text), counts


def clean(text: str, source: bool = False) -> tuple[str, dict[str, int]]:
    """Clean text and the constructs met, by language."""
    if source:
        return _source(text)
    r = Reader(text)
    if not _QUICK.search(text):
        return text, r.counts
    r.code()
    r.html()
    r.latex()
    r.lines()
    if not r.found():
        return text, r.counts
    t = re.sub(r"[ \t]+(?=\n)|[ \t]+\Z", "", r.t)
    r.t = re.sub(r"\n{3,}", "\n\n", t).strip()
    return r.result(), r.counts


RESULT = "clean_text string, constructs int, html int, markdown int, wiki int, latex int"


def clean_table(df: DataFrame, id_col: str, text_col: str, source: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """id, the extra columns, clean_text, constructs and its parts. Ids with several rows (redeliveries) come once."""
    extra = extra or {}
    flag = F.coalesce(source, F.lit(False)) if source is not None else F.lit(False)
    rows = df.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in extra.items()], F.col(text_col).alias("_text"), flag.alias("_source"))
    rows = rows.where(F.col("id").isNotNull())
    kept = ["id", *extra]
    # what has no sign of markup stays in the JVM
    read = F.coalesce(F.col("_text").rlike(QUICK), F.lit(False))
    zero = F.lit(0)
    plain = rows.where(~read).select(*kept, F.col("_text").alias("clean_text"), *[zero.alias(c) for c in ("constructs", "html", "markdown", "wiki", "latex")])

    def run(batches):
        for pdf in batches:
            got = [clean(t, bool(f)) for t, f in zip(pdf["_text"], pdf["_source"])]
            out = pdf[kept].copy()
            out["clean_text"] = [t for t, _ in got]
            out["constructs"] = [sum(c.values()) for _, c in got]
            for k in ("html", "markdown", "wiki", "latex"):
                out[k] = [c[k] for _, c in got]
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return spread(rows.where(read)).mapInPandas(run, f"{fields}, {RESULT}").unionByName(plain)


def marked_ids(df: DataFrame, id_col: str, text_col: str, source: Column | None = None) -> DataFrame:
    """Distinct ids of texts in which the cleaning met a construct."""
    return clean_table(df, id_col, text_col, source).where(F.col("constructs") > 0).select("id").distinct()


