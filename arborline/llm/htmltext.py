"""Layout-aware text of HTML pages.

A tree builder closes elements that HTML closes by implication (p before a block, li before li,
cells and rows of a table, dt/dd, option), drops what is not shown, and a renderer walks the tree:
blocks start new lines, paragraphs and headings are set off by a blank line, list items carry
bullets or numbers with indentation, and the cells of a table are aligned in columns.
"""

from __future__ import annotations

import hashlib
import html
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

# Element names by their role in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
SHOWN_RAW = frozenset(["textarea", "xmp"])
HIDDEN = frozenset("head datalist object audio video canvas annotation annotation-xml".split())
#: Closed from any depth; of svg, only what stands in SVG_SHOWN outside SVG_UNSEEN is drawn.
EMBEDDED = frozenset(["svg", "math", "select", "map"])
SVG_SHOWN, SVG_UNSEEN = frozenset(["text", "foreignobject"]), frozenset(["defs", "desc", "metadata", "symbol"])
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote table figure".split())
BLOCKS = SPACED | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup hr legend li main nav section summary tr caption option".split())
ENDS_P = BLOCKS - {"html", "body", "tr", "caption", "option", "legend"}
LISTS = frozenset(["ul", "ol", "menu", "dir"])
CELLS, ROW_GROUPS = frozenset(["td", "th"]), frozenset(["thead", "tbody", "tfoot"])
#: What an opening tag closes by implication, and where the search for it stops.
IMPLIED = (
    {"li": (frozenset(["li"]), LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "option": (frozenset(["option"]), frozenset(["select"]))}
    | {t: (CELLS, frozenset(["tr", "table"])) for t in CELLS}
    | {"tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table", *ROW_GROUPS]))}
    | {t: (frozenset([*ROW_GROUPS, "tr", "td", "th", "caption"]), frozenset(["table"])) for t in ROW_GROUPS}
)
SCOPE_ENDS = frozenset(["table", "td", "th", "button", "caption"])
#: Elements nested deeper are kept beside, not inside, one another, as browsers do.
MAX_DEPTH = 512
#: Elements that a selector may name; longer ones are not known.
MAX_STEPS = 16
# The most columns and rows that a cell may span by the standard.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
#: Cells are padded to their columns' widest line, unless that makes a table so many times longer than
#: its text (one very long line in many rows); then lines beyond WIDE run over their column.
MAX_PADDING, WIDE = 16, 60

TOKEN = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)")
#: Signs that are never drawn: soft hyphens, break opportunities, joins of words, byte order marks.
UNDRAWN = dict.fromkeys(map(ord, "\u00ad\u200b\u2060\ufeff"))
#: What ends a tag, or opens a quoted value in it.
IN_TAG = re.compile(r"=\s*([\"'])|>")
SPACE = re.compile(r"[ \t\n\r\f]+")
GONE = re.compile(r"(?:^|[\s\"'/])hidden(?=$|[\s=/>])(?!\s*=\s*[\"']?until-found)|display\s*:\s*none", re.I)
QUOTED = re.compile(r"(?<![\w-])(?!style\b)[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Style sheets: comments, blocks with their selectors, simple selectors, and what hides.
CSS_COMMENT, CSS_RULE = re.compile(r"/\*(?s:.*?)(?:\*/|\Z)"), re.compile(r"([^{}]*)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*)")
MARK = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")
COMBINATOR = re.compile(r"\s*(>)\s*|\s+")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-zA-Z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)


class Node:
    __slots__ = ("attrs", "kids", "marks", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.marks = tag, attrs, [], None


def text_of(s: str) -> str:
    return html.unescape(s) if "&" in s else s


def attributes(attrs: str) -> dict[str, str]:
    """The attributes of a tag by lower-cased name; the first of equal names counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        out.setdefault(m[1].lower(), text_of(m[2] or m[3] or m[4] or ""))
    return out


def number(attrs: str, name: str) -> int | None:
    """An attribute that is a whole number, or None."""
    if name not in attrs.lower():
        return None
    m = re.match(r"\s*([+-]?\d{1,9})", attributes(attrs).get(name, ""))
    return int(m[1]) if m else None


def tag_end(page: str, at: int) -> int:
    """The place of the `>` that ends a tag; those in quoted values do not, and a quote that never
    closes is none.  -1 where there is none."""
    while m := IN_TAG.search(page, at):
        if not m[1]:
            return m.start()
        shut = page.find(m[1], m.end())
        if shut < 0:
            return page.find(">", m.end())
        at = shut + 1
    return -1


def top_level(css: str) -> str:
    """A style sheet without comments and without the blocks of at-rules, save those for screens."""
    css, out, at = CSS_COMMENT.sub(" ", css), [], 0
    while (rule := css.find("@", at)) >= 0:
        out.append(css[at:rule])
        opened, ended = css.find("{", rule), css.find(";", rule)
        if opened < 0 or 0 <= ended < opened:  # a rule without a block
            at = ended + 1 if ended >= 0 else len(css)
            continue
        depth, i = 1, opened + 1
        for m in re.compile(r"[{}]").finditer(css, i):
            depth += 1 if m[0] == "{" else -1
            i = m.end()
            if not depth:
                break
        else:
            i = len(css) + 1
        if re.fullmatch(r"@media\s+(?:only\s+)?(?:screen|all)\s*", css[rule:opened], re.I):
            out.append(css[opened + 1 : i - 1])
        at = i
    return "".join([*out, css[at:]])


def selector(text: str) -> tuple[tuple, list] | None:
    """(weight, steps) of a selector; steps from the last element outwards: (how the one before it is related,
    tag, ids, classes, attributes with their values).  Descendants and children are known, and elements by
    name, id, class and attribute; None for others."""
    ends = [m for m in COMBINATOR.finditer(text) if "[" not in text[: m.start()] or text[: m.start()].count("[") == text[: m.start()].count("]")]
    cuts = [0, *(x for m in ends for x in m.span()), len(text)]
    parts, ties = [text[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)], [m[1] or " " for m in ends]
    if len(parts) > MAX_STEPS:
        return None
    steps, weight = [], [0, 0, 0]
    for part, tie in zip(parts, [None, *ties], strict=True):
        m = SELECTOR.fullmatch(part)
        if not m or not part:
            return None
        marks = MARK.findall(m[2] or "")
        ids, classes = frozenset(n for k, n, *_ in marks if k == "#"), frozenset(n for k, n, *_ in marks if k == ".")
        has = [(name.lower(), next((v for v in values if v), None) if any(values) else None) for k, _, name, *values in marks if not k]
        tag = (m[1] or "*").lower()
        weight = [w + x for w, x in zip(weight, (len(ids), len(classes) + len(has), tag != "*"), strict=True)]
        steps.append((tie, tag, ids, classes, has))
    return tuple(weight), steps[::-1]


def shown_rules(sheets: list[str]) -> list[tuple]:
    """(important, weight, order, steps, property, value) of the rules for display or visibility."""
    out = []
    for order, (selectors, body) in enumerate(m.groups() for css in sheets for m in CSS_RULE.finditer(top_level(css))):
        for prop, value, important in DECLARED.findall(body):
            for one in selectors.split(","):
                if found := selector(one.strip()):
                    out.append((bool(important), found[0], order, found[1], prop.lower(), value.lower()))
    return out


def fits(steps: list, chain: tuple) -> bool:
    """Whether an element, the last of a chain (node, chain of its parent), is what a selector names."""

    def one(node: Node, step: tuple) -> bool:
        _, tag, ids, classes, has = step
        if tag not in ("*", node.tag):
            return False
        if not (ids or classes or has):
            return True
        if node.marks is None:
            own = attributes(node.attrs) if node.attrs else {}
            node.marks = own, frozenset(own.get("class", "").split())
        own, named = node.marks
        return classes <= named and ids <= {own.get("id")} and all(n in own and v in (None, own[n]) for n, v in has)

    if not one(chain[0], steps[0]):
        return False
    # Where the next step may stand: of a descendant any ancestor, so each place is tried from the nearest.
    open_, known = [(1, chain[1], steps[0][0])], set()
    while open_:
        k, above, tie = open_.pop()
        if k == len(steps):
            return True
        if (k, id(above)) in known:
            continue
        known.add((k, id(above)))
        while above is not None:
            if one(above[0], steps[k]):
                if tie == " ":
                    open_.append((k, above[1], tie))
                open_.append((k + 1, above[1], steps[k][0]))
                break
            if tie == ">":
                break
            above = above[1]
    return False


def styled(rules: list[tuple], chain: tuple) -> tuple[str, str]:
    """(display, visibility) that an element's own style and the sheets give it, empty where neither does."""
    node = chain[0]
    inline = {p.lower(): v.lower() for p, v, _ in DECLARED.findall(attributes(node.attrs).get("style", ""))} if "style" in node.attrs.lower() else {}
    best = {p: ((False, (9, 9, 9), -1), v) for p, v in inline.items()}
    for important, weight, order, steps, prop, value in rules:
        if (important or prop not in inline) and (prop not in best or best[prop][0] < (important, weight, order)) and fits(steps, chain):
            best[prop] = ((important, weight, order), value)
    return best.get("display", ("", ""))[1], best.get("visibility", ("", ""))[1]


def settle(root: Node, rules: list[tuple]) -> None:
    """Take out of the tree what is not displayed, and texts that are not visible.  Visibility is inherited, and
    may be given back below; an invisible element stays where something in it is seen, and as a cell."""
    order: list[tuple[tuple, bool]] = [((root, None), True)]
    for chain, visible in order:
        kids = []
        for k in chain[0].kids:
            if isinstance(k, str):
                if visible:
                    kids.append(k)
                continue
            below = (k, chain)
            display, how = styled(rules, below)
            if display == "none" or (how == "collapse" and (k.tag == "tr" or k.tag in ROW_GROUPS)):
                continue
            kids.append(k)
            order.append((below, how in ("visible", "initial") if how and how != "inherit" else visible))
        chain[0].kids = kids
    seen = set()
    for (node, _), visible in reversed(order):
        node.kids = [k for k in node.kids if isinstance(k, str) or id(k) in seen]
        if visible or node.kids or node.tag in CELLS:
            seen.add(id(node))


def parse(page: str) -> Node:
    """The tree of what is shown; texts are strings among the children."""
    root, sheets, veiled = Node("html"), [], False
    stack, at, end = [root], 0, len(page)
    broken = False
    hidden = 0  # depth of the stack at which a hidden element was opened, 0 if none

    def close(names, stops, outermost: bool = False) -> None:
        nonlocal hidden
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                found = i
                if not outermost:
                    break
            elif stack[i].tag in stops:
                break
        if found:
            del stack[found:]
            if hidden >= len(stack):
                hidden = 0

    last = page.rfind(">")  # beyond it no tag ends; all is text up to an open comment
    while at < end:
        m = TOKEN.search(page, at) if at <= last else None
        if m and m[2]:
            ended = -1 if broken else tag_end(page, m.end())
            if ended < 0:  # quotes hide every end from here on: tags end at the next one
                broken, ended = True, page.find(">", m.end())
        if at > last and (comment := page.find("<!--", at)) >= 0:
            end = comment
        upto = m.start() if m else end
        if upto > at and not hidden:
            stack[-1].kids.append(text_of(page[at:upto]))
        if not m:
            break
        if not m[2]:
            at = m.end()
            continue
        tag, attrs, at = m[2].lower(), page[m.end() : ended], ended + 1
        if m[1]:
            if tag in VOID or tag in ("html", "body"):
                if tag == "br" and not hidden:
                    stack[-1].kids.append(Node("br"))
                continue
            close((tag,), () if tag in BLOCKS or tag in HIDDEN or tag in EMBEDDED or tag in CELLS or tag in ROW_GROUPS else SCOPE_ENDS)
            continue
        if tag in RAW:
            shut = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            if tag == "style" and not hidden_media(attrs):
                sheets.append(page[at : shut.start() if shut else end])
            if tag in SHOWN_RAW and not hidden and not gone(attrs):
                node = Node("pre", attrs)
                veiled = veiled or "visibility" in attrs.lower()
                node.kids.append(text_of(page[at : shut.start() if shut else end]) if tag == "textarea" else page[at : shut.start() if shut else end])
                stack[-1].kids.append(node)
            at = shut.end() if shut else end
            continue
        if tag in ("html", "body"):
            if hidden and stack[-1].tag == "head":
                close(("head",), ())
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag], outermost=True)
        if tag in ENDS_P:
            close(("p",), SCOPE_ENDS)
            if stack[-1].tag == "head":  # body content ends an open head
                close(("head",), ())
        if tag in CELLS and stack[-1].tag in ("table", *ROW_GROUPS):
            row = Node("tr")
            if not hidden:
                stack[-1].kids.append(row)
            stack.append(row)
        node = Node(tag, attrs)
        if not hidden:
            if tag in HIDDEN or (attrs and gone(attrs)) or (tag == "dialog" and "open" not in attributes(attrs)):
                if tag not in VOID and len(stack) < 4 * MAX_DEPTH:
                    stack.append(node)
                    hidden = len(stack) - 1
                continue
            stack[-1].kids.append(node)
            veiled = veiled or "visibility" in attrs.lower()
        if tag not in VOID and not attrs.endswith("/") and len(stack) < MAX_DEPTH * (4 if hidden else 1):
            stack.append(node)
    rules = shown_rules(sheets)
    if veiled or any(r[-1] in ("none", "hidden", "collapse") for r in rules):
        settle(root, rules)
    return root


def hidden_media(attrs: str) -> bool:
    """Whether a style sheet is for other media than screens."""
    return "media" in attrs.lower() and not re.search(r"screen|all", attributes(attrs).get("media", "all"), re.I)


def gone(attrs: str) -> bool:
    """Whether a tag's own attributes take the element out of the page."""
    low = attrs.lower()
    if "hidden" not in low and "display" not in low:
        return False
    return bool(GONE.search(QUOTED.sub(" ", attrs)))


class Lines:
    """Collects lines; knows the pending blank line, indentation and bullet."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.indent, self.bullet = False, "", None

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if self.now:
            if s[:1] == " " and self.now[-1][-1:] == " ":
                s = s[1:]
        else:
            s = s.lstrip(" ")
        if s:
            self.now.append(s)

    def line(self, raw: str | None = None) -> None:
        s = "".join(self.now).rstrip(" ").replace("\xa0", " ") if raw is None else raw
        self.now = []
        if s or raw is not None:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines.append((self.indent if self.bullet is None else self.bullet) + s)
            self.gap, self.bullet = False, None

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap = self.gap or spaced


def counted(n: int, style: str) -> str:
    """The number of a list item by its list's type: 1, a, A, i or I."""
    if style in ("a", "A") and n > 0:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
        return out if style == "a" else out.upper()
    if style in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            k, n = divmod(n, value)
            out += sign * k
        return out if style == "i" else out.upper()
    return str(n)


def drawn(node: Node):
    """The elements of an svg whose text is drawn."""
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag not in SVG_UNSEEN:
            if kid.tag in SVG_SHOWN:
                yield kid
            else:
                yield from drawn(kid)


def render(node: Node, out: Lines, depth: int = 0) -> None:
    tag = node.tag
    if tag == "table":
        return table(node, out, depth)
    count, step, style = 1, 1, "1"
    if tag == "ol":
        own = attributes(node.attrs) if node.attrs else {}
        step, style = -1 if "reversed" in own else 1, own.get("type", "1")
        start = number(node.attrs, "start")
        count = start if start is not None else 1 if step == 1 else sum(isinstance(k, Node) and k.tag == "li" for k in node.kids)
    for kid in node.kids:
        if isinstance(kid, str):
            if tag == "pre":
                first, *rest = kid.replace("\r\n", "\n").split("\n")
                out.now.append(first)
                for s in rest:
                    out.line("".join(out.now)) if out.now != [""] or out.lines else out.now.clear()
                    out.now.append(s)
            elif kid:
                out.text(kid)
            continue
        name = kid.tag
        if name == "br":
            out.line("".join(out.now).rstrip(" "))
        elif name == "hr":
            out.block(False)
        elif name == "svg":
            for label in drawn(kid):  # each label a line of its own
                out.block(False)
                render(label, out, depth + 1)
                out.block(False)
        elif name not in BLOCKS:
            if name in CELLS and out.now:
                out.text(" ")
            render(kid, out, depth + 1)
        else:
            # A list inside an item follows it without a blank line.
            spaced = name in SPACED and not (name in LISTS and out.indent)
            out.block(spaced)
            indent = out.indent
            if name == "li":
                if tag == "ol":
                    value = number(kid.attrs, "value")
                    count = count if value is None else value
                mark = f"{counted(count, style)}. " if tag == "ol" else "- "
                count += step
                out.bullet, out.indent = indent + mark, indent + " " * len(mark)
            elif name == "dd" or name == "blockquote":
                out.indent = indent + "  "
            render(kid, out, depth + 1)
            out.block(spaced)
            out.indent, out.bullet = indent, None


def table(node: Node, out: Lines, depth: int) -> None:
    """Rows of cells, each cell's lines set in the columns it spans; a cell that spans rows keeps its
    columns in them."""
    rows: list[list[tuple[int, int, list[str]]]] = []  # cells of a row: first column, columns, lines
    taken: dict[int, int] = {}  # column: rows still spanned from above

    def gather(n: Node) -> None:
        for kid in n.kids:
            if isinstance(kid, str):
                if kid.strip():
                    out.text(kid)
            elif kid.tag in ROW_GROUPS:
                taken.clear()  # no cell spans beyond its group
                gather(kid)
                taken.clear()
            elif kid.tag == "tr":
                cells, at, below = [], 0, {}
                for c in kid.kids:
                    if isinstance(c, Node) or c.strip():
                        inner, cell = Lines(), isinstance(c, Node) and c.tag in CELLS
                        if cell:
                            render(c, inner, depth + 1)
                        else:  # stray content makes a cell of its own
                            box = Node("td")
                            box.kids.append(c)
                            render(box, inner, depth + 1)
                        inner.line()
                        wide, tall = ((number(c.attrs, "colspan"), number(c.attrs, "rowspan")) if cell and c.attrs else (1, 1))
                        wide, tall = max(1, min(wide or 1, MAX_COLSPAN)), MAX_ROWSPAN if tall == 0 else max(1, min(tall or 1, MAX_ROWSPAN))
                        while taken.get(at, 0):
                            at += 1
                        cells.append((at, wide, inner.lines or [""]))
                        if tall > 1:
                            below |= {k: tall for k in range(at, at + wide)}
                        at += wide
                rows.append(cells)
                for k in [k for k, left in taken.items() if left <= 1]:
                    del taken[k]
                for k in taken:
                    taken[k] -= 1
                for k, tall in below.items():
                    taken[k] = max(taken.get(k, 0), tall - 1)
            else:  # captions and stray content stand before the rows
                box = Node("div")
                box.kids.append(kid)
                render(box, out, depth + 1)
                out.line()

    gather(node)
    out.line()

    def widths(most: int | None) -> dict[int, int]:
        width: dict[int, int] = {}
        for cells in rows:
            for at, span, lines in cells:
                if span == 1:
                    width[at] = max(width.get(at, 0), *(len(s) if most is None else min(len(s), most) for s in lines))
        return width

    width = widths(None)
    starts = np.cumsum([0, *(width.get(k, 0) + 2 for k in range(max(width, default=-1) + 1))])
    place = lambda k: int(starts[min(k, len(starts) - 1)]) + 2 * max(0, k - len(starts) + 1)
    text = sum(len(s) + 2 for cells in rows for _, _, lines in cells for s in lines)
    if sum(place(cells[-1][0]) * max(len(lines) for _, _, lines in cells) for cells in rows if cells) > MAX_PADDING * text + (1 << 16):
        width = widths(WIDE)
        starts = np.cumsum([0, *(width.get(k, 0) + 2 for k in range(max(width, default=-1) + 1))])
    for cells in rows:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            made = ""
            for at, _, lines in cells:
                if i < len(lines) and lines[i]:
                    # What runs over its column moves the rest of the line.
                    made = (made + "  " if made and len(made) + 2 > place(at) else made.ljust(place(at))) + lines[i]
            if made.strip():
                out.line(made.rstrip())


def page_text(page: str | None) -> str:
    out = Lines()
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * MAX_DEPTH))  # a few calls for each level
    render(parse(page or ""), out)
    out.line()
    text = "\n".join(out.lines)
    return (text if text.isascii() else text.translate(UNDRAWN)).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines, text_sha256), one row for each input row.

    Null or empty html gives an empty text of no lines.  Ids pass through, null or repeated; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            texts = [page_text(h.as_py()) for h in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string())],
                names=["page_id", "text", "n_chars", "n_lines", "text_sha256"],
            )

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(tidied(run), "page_id long, text string, n_chars long, n_lines long, text_sha256 string")
