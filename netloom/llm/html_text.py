"""Visible text of HTML pages, laid out.

Pages are spread over the tasks as they are read; each is one row, and rendering
it is one pass over its tags with a stack of open elements: implied end tags are
added, hidden subtrees skipped, and text goes to the frame of the block it is
in. A table cell has a frame of its own, so a table is laid out once its cells
are known.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not shown.
UNSEEN = frozenset("head title script style template noscript object iframe canvas audio video datalist desc defs metadata annotation annotation-xml".split())
RAW = frozenset("script style title textarea iframe noscript".split())
#: Blocks, with the blank lines around them.
BLOCKS = dict.fromkeys("address article aside body center dd details dialog div dt fieldset figcaption figure footer form header hgroup html legend li main nav option section summary tr caption tbody thead tfoot td th".split(), 0)
BLOCKS |= dict.fromkeys("blockquote dl h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split(), 1)
#: start tag -> (open elements that it ends, elements that shield those further out).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
ENDS |= {k: ({"td", "th", "tr", "caption"}, {"table"}) for k in ("tr",)} | {k: ({"td", "th", "caption"}, {"table", "tr"}) for k in ("td", "th")}
ENDS |= {k: ({"td", "th", "tr", "caption", "tbody", "thead", "tfoot"}, {"table"}) for k in ("tbody", "thead", "tfoot")}
CELL = ({"p"}, {"td", "th", "table", "caption", "button"})
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: Name and value (quoted, in a quote that never ends, or bare) of an attribute.
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
MAY_HIDE = re.compile("hidden|style", re.I)
#: Comments and strings of a style.
QUOTED = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*"|'[^']*'""", re.S)
SHEET = re.compile(r"<style(?=[\s>])[^>]*>(.*?)(?:</style|\Z)", re.I | re.S)
#: Rules for print, fonts and the like; rules; selectors of one element by its name, id and classes.
AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|\Z)")
SELECTOR = re.compile(r"(\*|[a-z][\w-]*)?((?:[#.][\w-]+)*)", re.I)
INLINE = (1, 0, 0, 0)
BLANK = re.compile(r"[ \t\n\r\f]+")
#: Lines of cells are broken at spaces to this many characters where a table has several columns.
WRAP = 120
#: Spans beyond this count as this, as browsers bound them too.
MOST_SPAN = 1000


class Frame:
    """Lines of a block; the open line is a list of pieces."""

    def __init__(self):
        self.lines, self.line, self.gap, self.marks = [], [], 0, []

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(s.split("\n")):
                if i:
                    self.close(keep=True)
                self.line.append(part)
            return
        s = BLANK.sub(" ", s)
        if s[:1] == " " and (not self.line or self.line[-1][-1:] == " "):
            s = s[1:]
        if s:
            self.line.append(s)

    def close(self, gap: int = 0, keep: bool = False) -> None:
        s = "".join(self.line).rstrip()
        self.line = []
        if s or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            lead = "".join(m if m is not None and k == len(self.marks) - 1 else " " * n for k, (m, n) in enumerate((x[0], x[1]) for x in self.marks))
            if self.marks:
                self.marks[-1][0] = None
            self.lines.append((lead + s).rstrip())
        self.gap = max(self.gap, gap)

    def add(self, lines: list[str]) -> None:
        for s in lines:
            self.line = [s]
            self.close(keep=True)


def attributes(attrs: str) -> dict[str, str]:
    """Names and values; the first of attributes of one name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def declarations(style: str) -> list[tuple[str, bool, str]]:
    """(property, important, value) of what a style says about display and visibility."""
    out = []
    for d in QUOTED.sub(" ", style).lower().split(";"):
        name, _, value = (x.strip() for x in d.partition(":"))
        plain = value.removesuffix("important").rstrip().removesuffix("!").rstrip() if value.endswith("important") else value
        if name in ("display", "visibility") and plain:
            out.append((name, plain != value, plain))
    return out


def style_sheet(page: str) -> dict[str, list[tuple]]:
    """The rules about visibility in a page's style sheets: number, element, ids, classes, specificity, declarations, by what an element must have (#id, .class, name or *). Selectors that look at more than one element, and rules for some media only, are left out."""
    rules: dict[str, list[tuple]] = {}
    n = 0
    for m in SHEET.finditer(page):
        for block in AT_RULE.sub(" ", QUOTED.sub(" ", m[1])).split("}")[:-1]:
            before, brace, body = block.rpartition("{")
            said = declarations(body) if brace else []
            for one in before.rpartition("{")[2].split(",") if said else ():
                k = SELECTOR.fullmatch(one.strip())
                if k and one.strip():
                    ids, classes = ({x[1:] for x in re.findall(rf"[{c}][\w-]+", k[2])} for c in "#.")
                    name = (k[1] or "*").lower()
                    key = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else name
                    rules.setdefault(key, []).append((n, name, ids, classes, (0, len(ids), len(classes), int(name != "*")), said))
                    n += 1
    return rules


def visibility(name: str, attrs: str, sheet: dict[str, list[tuple]]) -> tuple[bool, str | None]:
    """Whether an element is not there at all, and the visibility that it states for itself and its content."""
    if not sheet and not MAY_HIDE.search(attrs):
        return False, None
    own = attributes(attrs)
    said = [(INLINE, declarations(html.unescape(own.get("style", ""))))]
    if sheet:
        classes, ids = set(own.get("class", "").split()), {own.get("id", "")}
        may = sorted((r for key in (*(f"#{x}" for x in ids), *(f".{x}" for x in classes), name, "*") for r in sheet.get(key, ())), key=lambda r: r[0])
        said = [(k, d) for _, n, i, c, k, d in may if n in ("*", name) and i <= ids and c <= classes] + said
    won: dict[str, tuple] = {}
    for rank, decls in said:  # of equal rank the last counts
        for prop, important, value in decls:
            if prop not in won or (important, rank) >= won[prop][:2]:
                won[prop] = (important, rank, value)
    display = won["display"][2] if "display" in won else "none" if "hidden" in own else ""
    return display == "none", won["visibility"][2] if "visibility" in won else None


def _wrapped(lines: list[str], wide: int) -> list[str]:
    """Lines broken at spaces; words that are longer stay whole."""
    out = []
    for s in lines:
        while len(s) > wide:
            cut = s.rfind(" ", 1, wide + 1)
            cut = cut if cut > 0 else s.find(" ", wide)
            if cut < 0:
                break
            out.append(s[:cut])
            s = s[cut + 1 :]
        out.append(s)
    return out


def lay_out(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table, from rows of (lines of a cell, columns, rows that it spans). A row has as many lines as its tallest cell; a cell over several rows stands in its first."""
    grid, taken = [], {}  # taken: column -> rows that a cell above still reaches into
    for r in rows:
        at, line = 0, []
        for cell, wide, high in r:
            while taken.get(at):
                at += 1
            line.append((at, cell, wide))
            for k in range(at, at + wide):
                taken[k] = max(taken.get(k, 0), high)
            at += wide
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        grid.append(line)
    grid = [r for r in grid if any(c for _, c, _ in r)]
    if max((at + wide for r in grid for at, _, wide in r), default=0) > 1:
        grid = [[(at, _wrapped(c, WRAP), wide) for at, c, wide in r] for r in grid]
    width: dict[int, int] = {}
    for one in (True, False):
        for at, cell, wide in (x for r in grid for x in r if (x[2] == 1) == one):
            need, last = max(map(len, cell), default=0), at + wide - 1
            room = sum(width.get(k, 0) for k in range(at, last)) + 3 * (wide - 1)
            width[last] = max(width.get(last, 0), need - room)
    out = []
    for r in grid:
        for n in range(max(len(c) for _, c, _ in r)):
            parts, reached = [], 0
            for at, cell, wide in r:
                parts += [" " * width.get(k, 0) for k in range(reached, at)]
                room = sum(width.get(k, 0) for k in range(at, at + wide)) + 3 * (wide - 1)
                parts.append((cell[n] if n < len(cell) else "").ljust(room))
                reached = at + wide
            out.append(" | ".join(parts).rstrip())
    return out


def _number(value: str, otherwise: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value)
    return int(m[1]) if m else otherwise


def render(page: str | None) -> tuple[str, int, int]:
    """The visible text of a page, and how many list items and tables it holds; empty for null."""
    page = page or ""
    end = page.rfind(">") + 1
    sheet = style_sheet(page[:end]) if "<style" in page.lower() else {}
    frames, tables, lists = [Frame()], [], []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, not there, pre, visible, closed details
    opened: Counter[str] = Counter()  # names in the stack, so that it is not walked for one that is not there
    n_items = n_tables = 0

    def there() -> bool:
        return not (stack and stack[-1][1])

    def shown() -> bool:
        return not stack or (not stack[-1][1] and stack[-1][3] and not stack[-1][4])

    def push(name: str, gone: bool, pre: bool, visible: bool, closed: bool = False) -> None:
        stack.append((name, gone, pre, visible, closed))
        opened[name] += 1

    def pop() -> None:
        name, gone, *_ = stack.pop()
        opened[name] -= 1
        if gone:
            return
        f = frames[-1]
        if name in ("td", "th") and tables:
            f.close()
            frames.pop()
            tables[-1][-1][-1][0].extend(f.lines)
        elif name == "table" and tables:
            f.close()
            f.add(lay_out(tables.pop()))
            f.close(1)
        elif name in BLOCKS:
            f.close(BLOCKS[name] if not (name in ("ul", "ol", "menu") and len(lists) > 1) else 0)
            if name == "li" and f.marks:
                f.marks.pop()
            elif name in ("ul", "ol", "menu") and lists:
                lists.pop()

    def end_of(names: set, shields: set) -> None:
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                while len(stack) > k:
                    pop()
                if names & {"td", "th", "tr"}:  # a row may stand open around the cell
                    end_of(names, shields)
                return
            if stack[k][0] in shields:
                return

    at = 0
    while at < end:
        m = TOKEN.search(page, at, end)
        if m is None:
            break
        if m.start() > at and shown():
            frames[-1].text(html.unescape(page[at : m.start()]), bool(stack and stack[-1][2]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        attrs = m[3] or m[6] or ""
        if m[1] or m[4]:
            if name == "br":
                if there():
                    frames[-1].close()
                continue
            if not opened[name]:
                continue
            shields = set() if name in ("html", "body", "table") else {"table"} if name in ("td", "th", "tr", "tbody", "thead", "tfoot") else {"td", "th", "table"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in shields:
                    break
            continue
        if name in BLOCKS and name not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"):
            end_of(*CELL)
        if name in ENDS:
            end_of(*ENDS[name])
        if name in ("td", "th") and tables and there() and not (stack and stack[-1][0] == "tr"):
            push("tr", False, False, shown())
            tables[-1].append([])
        gone, stated = visibility(name, attrs, sheet) if attrs or sheet else (False, None)
        own = attributes(attrs) if name in ("dialog", "details") else {}
        gone = gone or not there() or name in UNSEEN or (name == "dialog" and "open" not in own) or bool(stack and stack[-1][4] and name != "summary")
        visible = (not stack or stack[-1][3]) if stated in (None, "inherit") else stated not in ("hidden", "collapse")
        f = frames[-1]
        if not gone:
            if name == "br":
                f.close()
            elif name in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                own = attributes(attrs) if "span" in attrs.lower() else {}
                wide, high = (min(MOST_SPAN, max(1, _number(own.get(k, ""), 1))) for k in ("colspan", "rowspan"))
                tables[-1][-1].append(([], wide, high))
                frames.append(Frame())
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name == "table":
                f.close(1)
                tables.append([])
                n_tables += 1
            elif name in BLOCKS:
                f.close(BLOCKS[name] if not (name in ("ul", "ol", "menu") and lists) else 0)
                if name in ("ul", "ol", "menu"):
                    lists.append([_number(attributes(attrs).get("start", ""), 1), name == "ol"])
                elif name == "li":
                    n_items += visible
                    mark = "- "
                    if lists and lists[-1][1]:
                        mark = f"{lists[-1][0]}. "
                        lists[-1][0] += 1
                    f.marks.append([mark, len(mark)])
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        push(name, gone, name == "pre" or bool(stack and stack[-1][2]), visible, name == "details" and "open" not in own)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at, end)
            stop = close.start() if close else end
            if not gone and visible:
                frames[-1].text(html.unescape(page[at:stop]), True)
            at = stop
    if at < len(page) and shown():
        frames[-1].text(html.unescape(page[max(at, 0) :]), bool(stack and stack[-1][2]))
    while stack:
        pop()
    frames[0].close()
    return "\n".join(frames[0].lines).strip("\n"), n_items, n_tables


def extract_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, html string, ...) -> page_id, text, n_chars, n_items, n_tables; one row per input row.

    All visible text is kept, in order: blocks on lines of their own with a
    blank line around paragraphs, headings, lists and tables, list items with
    their marks and indents, preformatted text as it is, cells of a table in
    aligned columns, also over several columns and rows; a row with a cell of
    several lines has several lines. Scripts, the head and elements hidden by
    attribute, by their style or by a style sheet of the page are left out, and so
    are dialogs that are not open and all of closed details but their summary;
    content that is made visible again inside hidden content is kept. Of style
    sheets, selectors of one element count (``p``, ``.a.b``, ``#x``), by
    specificity and order; nested ones and those for some media do not. Broken
    markup is rendered as browsers would guess; a tag that never ends is text.

    Null and empty pages give the empty string; very long ones are read whole.
    Repeated rows and null ids are passed through. Extra columns are ignored; an empty table gives an empty
    result.
    """
    pages = pages.select(F.col("page_id"), F.col("html").cast("string").alias("html"))

    def run(batches):
        for b in batches:
            got = [render(x) for x in b.column(1).to_pylist()]
            cols = [pa.array([x[0] for x in got], pa.string()), *[pa.array(v, pa.int64()) for v in ([len(x[0]) for x in got], [x[1] for x in got], [x[2] for x in got])]]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["page_id", "text", "n_chars", "n_items", "n_tables"])

    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_chars long, n_items long, n_tables long")
