"""HTML extraction with wrappers inferred from pages of one host.

A page is a stream of tokens: tags (with the classes that tell a part's role)
and text slots.  Consecutive equal groups of tokens fold into a repeated group,
level by level, which leaves the page's shape.  The shapes of a host are aligned
one after another with the wrapper so far: what only some have becomes optional,
what repeats in any shape becomes a repeated group in all, and texts become
slots, so the wrapper is a regular expression without unions.

Every slot of the wrapper knows its path of open tags.  Slots in menus, headers,
footers, sidebars, notices, adverts, forms and comments are dropped; of the rest
those inside an article (or main part) are kept.  A host without such a part
keeps the slots of the container that holds most of the text in its pages,
without texts that are the same on every page.  Inside an article too, a slot
that most pages of the host have with one and the same text is left out.

The wrapper's expression describes the host; pages are not matched against it,
and what is optional or repeated decides nothing.

Two passes read the pages: the first counts shapes and texts by host, where
equal shapes are summed before the shuffle, so a host of any size costs as much
as it has shapes; the second applies the rules.  The rules are broadcast where
their measured size is under ``most_bytes``, else joined.

Nulls: a null or empty html gives an empty text; a null url belongs to the
host ``''``.  Repeated rows each get their own row.  An empty table gives an
empty result.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, cut, quoted

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][\w:-]*)[^>]*>|<([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
FOLD = re.compile(r"(.{1,24}?)\1+", re.S)
SPACE = re.compile(r"\s+")

#: Tag names of HTML by use.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "label", "option", "object", "canvas"}
MAIN = {"article", "main"}
#: Words of class, id or role names.
DROPPED_ROLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|widget|comments?|replies|respond|notices?|cookies?|consent|alert|popup|modal|"
    r"nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommend\w*|subscribe|newsletter|signup|login|pagination|pager|toolbar)(?:$|[\s_-])",
    re.I,
)
MAIN_ROLE = re.compile(r"(?:^|[\s_-])(?:article|main|content|entry|post|story|body)(?:$|[\s_-])", re.I)

KEEP, DROP = "+", "-"


def tokens(page: str):
    """('open', tag, role) / ('close', tag, '') / ('text', raw, '') in order;
    raw elements are left out whole."""
    at, size, lower = 0, len(page), None
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[1]:
            yield "close", m[1].lower(), ""
        elif m[2]:
            tag = m[2].lower()
            if tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    lower = page.lower() if lower is None else lower
                    end = lower.find(f"</{tag}", at)
                    if end < 0:
                        return
                    close = page.find(">", end)
                    at = size if close < 0 else close + 1
                continue
            role = " ".join(x for g in ROLE.findall(m[3]) for x in g if x) if "=" in m[3] else ""
            yield "open", tag, re.sub(r"\d+", "0", role)


def stream(page: str) -> tuple[list[str], list[tuple[int, str, str]]]:
    """The page's symbols, and (symbol's place, kind, text or tag) of its tokens."""
    symbols: list[str] = []
    out: list[tuple[int, str, str]] = []
    for kind, name, role in tokens(page):
        if kind == "text":
            if not name.isspace():
                out.append((len(symbols), kind, name))
                symbols.append("#")
            elif out and out[-1][1] == "text":
                out.append((len(symbols) - 1, "space", " "))
            else:
                out.append((len(symbols), "space", " "))
        elif kind == "open":
            out.append((len(symbols), kind, name))
            symbols.append(f"<{name} {role}>" if role else f"<{name}>")
        else:
            out.append((len(symbols), kind, name))
            symbols.append(f"</{name}>")
    return symbols, out


class Shape:
    """Nested groups: an item is a symbol or a list (a repeated group);
    ``path`` gives, for each symbol of the page, the item's number in reading
    order."""

    def __init__(self, symbols: list[str]):
        numbers: dict[str, int] = {}
        text = "".join(chr(0x4E00 + numbers.setdefault(s, len(numbers))) for s in symbols)
        names: list = list(numbers)
        spans = [[i] for i in range(len(symbols))]  # the symbols under each item
        for _ in range(4):
            made, ends, at = [], [], 0
            for m in FOLD.finditer(text):
                unit = m[1]
                for i in range(at, m.start()):
                    made.append(text[i])
                    ends.append(spans[i])
                key = "(" + unit
                if key not in numbers:
                    numbers[key] = len(names)
                    names.append(unit)
                made.append(chr(0x4E00 + numbers[key]))
                ends.append([x for i in range(m.start(), m.end()) for x in spans[i]])
                at = m.end()
            if not at:
                break
            made += text[at:]
            ends += spans[at:]
            text, spans = "".join(made), ends
        self.text, self.names = text, names

    def items(self, text: str | None = None) -> list:
        out = []
        for c in self.text if text is None else text:
            name = self.names[ord(c) - 0x4E00]
            out.append(self.items(name) if ord(name[0]) >= 0x4E00 else name)
        return out


def key_of(items: list) -> str:
    return json.dumps(items, separators=(",", ":"), ensure_ascii=False)


def shape_of(symbols: list[str]) -> list:
    return Shape(symbols).items()


def flat(items: list) -> list[str]:
    out: list[str] = []
    for x in items:
        out += ["(", *flat(x), ")+"] if isinstance(x, list) else [x]
    return out


def groups(items: list) -> list[list]:
    return [g for x in items if isinstance(x, list) for g in [x, *groups(x)]]


def regrouped(items: list, units: list[list]) -> list:
    """``items`` with single stretches of the units turned into groups."""
    out = [regrouped(x, units) if isinstance(x, list) else x for x in items]
    for unit in units:
        n, at, made = len(unit), 0, []
        if out == unit:
            continue
        while at < len(out):
            if out[at : at + n] == unit:
                made.append(unit)
                at += n
            else:
                made.append(out[at])
                at += 1
        out = [x for i, x in enumerate(made) if not (i and isinstance(x, list) and x == made[i - 1])]
    return out


class Wrapper:
    """A host's union-free expression: items and which of them are optional."""

    def __init__(self, shapes: list[list]):
        units: list[list] = []
        for s in shapes:
            units += [g for g in groups(s) if g not in units and len(g) > 1]
        units.sort(key=lambda g: len(flat(g)))
        self.items: list = []
        self.optional: list[bool] = []
        for k, shape in enumerate(regrouped(s, units) for s in shapes):
            if not k:
                self.items, self.optional = list(shape), [False] * len(shape)
            else:
                self.align(shape)

    def align(self, shape: list) -> None:
        mine, theirs = [key_of([x]) for x in self.items], [key_of([x]) for x in shape]
        items, optional = [], []
        for tag, a, b, c, d in difflib.SequenceMatcher(None, mine, theirs, autojunk=False).get_opcodes():
            same = tag == "equal"
            items += self.items[a:b]
            optional += self.optional[a:b] if same else [True] * (b - a)
            if not same:
                items += shape[c:d]
                optional += [True] * (d - c)
        self.items, self.optional = items, optional

    def expression(self) -> str:
        return " ".join(
            ("(" + " ".join(flat([x])) + ")?" if opt else " ".join(flat([x])))
            for x, opt in zip(self.items, self.optional, strict=True)
        )

    def slots(self) -> dict[str, float]:
        """Paths of the text slots of the wrapper."""
        found: dict[str, float] = {}
        path = Path()
        for s in flat(self.items):
            if s == "#":
                found.setdefault(path.key(), 0.0)
            elif s[0] == "<":
                path.take(s)
        return found


class Path:
    """The open tags; a closing tag closes what stands above its opener."""

    def __init__(self):
        self.open: list[tuple[str, str]] = []

    def take(self, symbol: str) -> None:
        if symbol[1] == "/":
            self.close(symbol[2:-1])
        else:
            name, _, role = symbol[1:-1].partition(" ")
            self.push(name, role)

    def push(self, name: str, role: str) -> None:
        if name == "p" or name not in INLINE:
            while self.open and (self.open[-1][0] in INLINE or self.open[-1][0] == "p"):
                self.open.pop()
        if name == "li" and self.open and self.open[-1][0] == "li":
            self.open.pop()
        if name not in VOID:
            self.open.append((name, role))

    def close(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                return

    def key(self) -> str:
        """The path without inline tags, as text."""
        return "/".join(f"{n} {r}".strip() for n, r in self.open if n not in INLINE or r)


def dropped(path: str) -> bool:
    """Names that drop a slot; those of the page and of what holds its main
    part say nothing."""
    parts = [part.partition(" ") for part in path.split("/")]
    inner = next((k for k, p in enumerate(parts) if p[0] in MAIN), 0)
    for k, (name, _, role) in enumerate(parts):
        if k < inner and name not in DROPPED or name in ("html", "body"):
            continue
        if name in DROPPED or role and DROPPED_ROLE.search(role) and not (name in MAIN and MAIN_ROLE.search(role)):
            return True
    return False


def main_part(path: str) -> bool:
    return any(part.partition(" ")[0] in MAIN for part in path.split("/"))


def rules(host_rows: pd.DataFrame) -> tuple[str, dict[str, str]]:
    """The host's expression, and for each slot path KEEP or DROP.

    ``host_rows`` has shape, path, chars, fixed (the text is the same on every
    page), common (and on most pages of the host), one row a shape and path.
    """
    shapes = [json.loads(s) for s in sorted(set(host_rows["shape"]), key=lambda s: (len(s), s))]
    wrapper = Wrapper(shapes)
    slots = wrapper.slots()
    by_path = host_rows.groupby("path").agg({"chars": "sum", "fixed": "min", "common": "min"})
    for path in by_path.index:
        slots.setdefault(path, 0.0)
    left = [p for p in slots if not dropped(p)]
    inside = [p for p in left if main_part(p)]
    if not inside:
        moving = [p for p in left if not (p in by_path.index and by_path.loc[p, "fixed"])] or left
        weight = {p: float(by_path.loc[p, "chars"]) if p in by_path.index else 0.0 for p in moving}
        total, root = sum(weight.values()), ""
        while total:  # down to the lowest container with most of the text
            below: dict[str, float] = {}
            for p, w in weight.items():
                if p.startswith(root) and len(p) > len(root):
                    step = p[len(root) :].lstrip("/").split("/")[0]
                    below[step] = below.get(step, 0.0) + w
            best = max(below, key=lambda s: (below[s], s), default=None)
            if best is None or below[best] < 0.6 * total or best.split(" ")[0] in ("p", "h1", "h2", "h3", "li"):
                break
            root = f"{root}/{best}".lstrip("/")
        inside = [p for p in moving if p == root or p.startswith(f"{root}/") or not root]
    else:
        inside = [p for p in inside if not (p in by_path.index and by_path.loc[p, "common"])] or inside
    keep = set(inside)
    return wrapper.expression(), {p: KEEP if p in keep else DROP for p in slots}


def described(page: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The page's shape, and (path, characters, hash of the text) of its slots,
    one a path."""
    symbols, toks = stream(page)
    path, found = Path(), {}
    for at, kind, name in toks:
        if kind == "text":
            texts = found.setdefault(path.key(), [0, blake2b(digest_size=7)])
            texts[0] += len(name)
            texts[1].update(name.encode())
        elif kind != "space":
            path.take(symbols[at])
    slots = [(p, n, int.from_bytes(h.digest(), "big")) for p, (n, h) in found.items()]
    return key_of(shape_of(symbols)), slots


def extract(page: str, keep: dict[str, str]) -> str:
    """The texts of kept slots: one line a block."""
    symbols, toks = stream(page)
    path, blocks, now = Path(), [], []
    state: bool | None = None

    def flush():
        line = SPACE.sub(" ", entities.unescape("".join(now))).strip()
        if line:
            blocks.append(line)
        now.clear()

    for at, kind, name in toks:
        if kind in ("text", "space"):
            if state is None:
                key = path.key()
                state = keep.get(key, DROP if dropped(key) or not main_part(key) else KEEP) == KEEP
            if state:
                now.append(name)
        else:
            if name not in INLINE:
                flush()
            path.take(symbols[at])
            state = None
    flush()
    return "\n".join(blocks)


def inferred(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host, expression and rules (a JSON text) of every host."""

    def kernel():
        def run(texts):
            shapes, slots = [], []
            for t in texts.to_pylist():
                shape, found = described(t or "")
                shapes.append(shape)
                slots.append([{"path": p, "chars": n, "h": h} for p, n, h in found])
            return shapes, slots

        return run

    src = pages.select(host_of(url_col).alias("host"), quoted(html_col).alias("html"))
    seen = append(src, ["html"], "shape string, slots array<struct<path:string,chars:long,h:long>>", kernel, ["host"])
    by_slot = (
        seen.select("host", "shape", F.inline("slots"))
        .groupBy("host", "shape", "path")
        .agg(F.sum("chars").alias("chars"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n"))
    )

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        across = rows.groupby("path").agg({"lo": "min", "hi": "max", "n": "sum"})
        fixed = (across["lo"] == across["hi"]) & (across["n"] >= 3)
        common = fixed & (2 * across["n"] > across["n"].max())
        rows = rows.assign(fixed=rows["path"].map(fixed), common=rows["path"].map(common))
        expression, keep = rules(rows)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "expression": [expression], "rules": [json.dumps(keep)]})

    return cut(by_slot.groupBy("host").applyInPandas(one, "host string, expression string, rules string"))


def host_of(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(quoted(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def main_text(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    most_bytes: int = 32 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """``pages`` with text and n_chars (its code points)."""
    found = inferred(pages, url_col, html_col).select(F.col("host").alias("_host"), F.col("rules").alias("_rules"))
    size = found.agg(F.sum(F.length("_rules") + F.length("_host"))).first()[0] or 0
    keep = pages.columns if keep is None else keep
    right = F.broadcast(found) if size <= most_bytes else found
    joined = pages.withColumn("_html", quoted(html_col)).withColumn("_at", host_of(url_col))
    joined = joined.join(right, F.col("_at") == F.col("_host"), "left")

    def kernel():
        memo: dict[str, dict[str, str]] = {}

        def run(rule_texts, texts):
            out = []
            for r, t in zip(rule_texts.to_pylist(), texts.to_pylist(), strict=True):
                if r not in memo:
                    if len(memo) > 2000:
                        memo.clear()
                    memo[r] = json.loads(r) if r else {}
                out.append(extract(t or "", memo[r]))
            return out, [len(t) for t in out]

        return run

    return append(joined, ["_rules", "_html"], "text string, n_chars long", kernel, keep)
