"""Text engine data: a tree over the bytes it was written in.

Nodes keep the span of bytes they came from, so that reading and writing back is exact by construction; an edit is a
list of spans with new bytes, and new runs are copies of old ones with spans replaced inside.
"""

from __future__ import annotations

import re

DEPTH = 200
_SPACE = re.compile(rb"[ \t\r\n\0]*")
_TOKEN = re.compile(rb"[^\s\0<>\[\]()/]+")
_KEY = re.compile(rb"[ \t\r\n\0]*/([^\s\0<>\[\]()/]+)")
_STRING = re.compile(rb"\(([^\\)]*(?:\\.[^\\)]*)*)\)", re.DOTALL)
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


class Node:
    __slots__ = ("kind", "start", "end", "value", "items")

    def __init__(self, kind: str, start: int, end: int, value: object = None):
        self.kind = kind  # dict, array, string, number, bool, name
        self.start, self.end, self.value = start, end, value
        self.items: list = []  # of nodes, or of (key, node)

    def get(self, *keys: str) -> Node | None:
        n: Node | None = self
        for k in keys:
            n = next((v for key, v in n.items if key == k), None) if n is not None and n.kind == "dict" else None
        return n


class _Parser:
    def __init__(self, data: bytes):
        self.data, self.pos = data, 0

    def space(self) -> None:
        self.pos = _SPACE.match(self.data, self.pos).end()

    def node(self, depth: int = 0) -> Node | None:
        self.space()
        if self.pos >= len(self.data) or depth > DEPTH:
            return None
        d, start = self.data, self.pos
        if m := _TOKEN.match(d, start):
            self.pos = m.end()
            t = m[0]
            if t in (b"true", b"false"):
                return Node("bool", start, self.pos, t == b"true")
            try:
                return Node("number", start, self.pos, float(t))
            except ValueError:
                return Node("name", start, self.pos, t.decode("latin-1"))
        if d.startswith(b"<<", start):
            self.pos += 2
            return self.members(start, depth, b">>")
        c = d[start : start + 1]
        if c == b"[":
            self.pos += 1
            out = Node("array", start, start)
            while True:
                self.space()
                if self.pos >= len(d) or d[self.pos : self.pos + 1] == b"]":
                    break
                n = self.node(depth + 1)
                if n is None:
                    break
                out.items.append(n)
            self.pos = min(self.pos + 1, len(d))
            out.end = self.pos
            return out
        if c == b"(":
            return self.string(start)
        if c == b"/":
            m = _TOKEN.match(d, start + 1)
            self.pos = m.end() if m else start + 1
            return Node("name", start, self.pos, d[start + 1 : self.pos].decode("latin-1"))
        self.pos += 1
        return None

    def members(self, start: int, depth: int, close: bytes) -> Node:
        out = Node("dict", start, start)
        while True:
            if depth < DEPTH and (m := _KEY.match(self.data, self.pos)):
                self.pos = m.end()
                value = self.node(depth + 1)
                if value is None:
                    break
                out.items.append((m[1].decode("latin-1"), value))
                continue
            self.space()
            if self.pos >= len(self.data) or (close and self.data.startswith(close, self.pos)):
                break
            if self.data[self.pos : self.pos + 1] != b"/":
                self.pos += 1
                continue
            key = self.node(depth + 1)
            value = self.node(depth + 1)
            if value is None:
                break
            out.items.append((key.value, value))
        self.pos = min(self.pos + len(close), len(self.data))
        out.end = self.pos
        return out

    def string(self, start: int) -> Node:
        d, k, raw = self.data, start + 1, bytearray()
        if m := _STRING.match(d, start):
            raw, k = m[1], m.end() - 1
            if b"\\" in raw:
                raw = _ESCAPED.sub(rb"\1", raw)
        while k < len(d) and d[k] != 0x29:
            if d[k] == 0x5C and k + 1 < len(d):
                k += 1
            raw.append(d[k])
            k += 1
        self.pos = min(k + 1, len(d))
        body = bytes(raw)
        text = body[2:].decode("utf-16-be", "replace") if body.startswith(b"\xfe\xff") else body.decode("latin-1")
        return Node("string", start, self.pos, text)


def parse(data: bytes) -> Node | None:
    return _Parser(data).node()


def parse_bare(data: bytes) -> Node:
    """Members without the dict around them, as document-level text data is written."""
    p = _Parser(data)
    p.space()
    return p.node() if data.startswith(b"<<", p.pos) else p.members(0, 0, b"")


def string_bytes(text: str) -> bytes:
    raw = b"\xfe\xff" + text.encode("utf-16-be", "surrogatepass")
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", raw) + b")"


def number_bytes(v: float) -> bytes:
    """A number in at most eight decimals, without a leading zero or trailing ones."""
    if float(v).is_integer() and not isinstance(v, float):
        return str(int(v)).encode()
    t = f"{v:.8f}".rstrip("0")
    t = t + "0" if t.endswith(".") else t
    return re.sub(r"^(-?)0\.(?=\d*[1-9])", r"\1.", t).encode()


def splice(data: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
    out, at = [], 0
    for start, end, new in sorted(changes, key=lambda c: (c[0], c[1])):
        out += [data[at:start], new]
        at = end
    return b"".join([*out, data[at:]])


def units(text: str) -> int:
    return len(text.encode("utf-16-be", "surrogatepass")) // 2


def fitted(lengths: list[int], total: int) -> list[tuple[int, int]]:
    """(which, length) of the lengths that cover ``total``: those of 0 or less are passed over, what is beyond the end is
    cut, the last takes what is left; without any, one of -1 takes all."""
    out, at = [], 0
    for k, n in enumerate(lengths):
        if n > 0 and at < total:
            out.append((k, min(n, total - at)))
            at += out[-1][1]
    if not out:
        return [(-1, total)]
    out[-1] = (out[-1][0], out[-1][1] + total - at)
    return out


def fit(lengths: list[int], total: int) -> list[int]:
    return [n for _, n in fitted(lengths, total)]


def _numbers(n: Node | None) -> list[float]:
    return [x.value for x in n.items if x.kind == "number"] if n is not None and n.kind == "array" else []


#: Style key, its place in the style data, kind.
STYLE = {
    "size": ("FontSize", "number"), "tracking": ("Tracking", "int"), "kerning": ("Kerning", "int"), "auto_kerning": ("AutoKerning", "bool"),
    "bold": ("FauxBold", "bool"), "italic": ("FauxItalic", "bool"), "underline": ("Underline", "bool"),
}


def text_of(root: Node) -> str:
    n = root.get("EngineDict", "Editor", "Text")
    return (n.value if n is not None else "") or ""


def read_text(root: Node) -> dict:
    """Text, fonts, style runs and paragraphs of a text layer's engine data, defaults filled in."""
    engine, res = root.get("EngineDict"), root.get("ResourceDict")
    text = text_of(root)
    fonts = [f.get("Name").value if f.get("Name") is not None else None for f in (res.get("FontSet").items if res is not None and res.get("FontSet") is not None else [])]
    base = None
    if res is not None and (sheets := res.get("StyleSheetSet")) is not None and sheets.items:
        normal = res.get("TheNormalStyleSheet")
        k = int(normal.value) if normal is not None and normal.kind == "number" else 0
        base = sheets.items[k if k < len(sheets.items) else 0].get("StyleSheetData")
    runs = []
    if engine is not None and (sr := engine.get("StyleRun")) is not None:
        arr = sr.get("RunArray")
        for node, n in zip(arr.items if arr is not None else [], _numbers(sr.get("RunLengthArray"))):
            own = node.get("StyleSheet", "StyleSheetData")

            def pick(key: str, own: Node | None = own) -> Node | None:
                v = own.get(key) if own is not None else None
                return v if v is not None else (base.get(key) if base is not None else None)

            font, color = pick("Font"), pick("FillColor")
            no = int(font.value) if font is not None and font.kind == "number" else None
            run = {"length": int(n), "font_no": no, "font": fonts[no] if no is not None and 0 <= no < len(fonts) else None, "inherited": own is None or own.get("FontSize") is None}
            kind = color.get("Type") if color is not None else None
            argb = _numbers(color.get("Values")) if color is not None and (kind is None or kind.value == 1) else []
            run |= dict(zip("argb", argb)) if len(argb) == 4 else dict.fromkeys("argb")
            for k, (key, form) in STYLE.items():
                v = pick(key)
                run[k] = None if v is None else bool(v.value) if form == "bool" else int(v.value) if form == "int" else float(v.value)
            runs.append(run)
    paras = []
    if engine is not None and (pr := engine.get("ParagraphRun")) is not None:
        arr = pr.get("RunArray")
        for node, n in zip(arr.items if arr is not None else [], _numbers(pr.get("RunLengthArray"))):
            j = node.get("ParagraphSheet", "Properties", "Justification")
            paras.append({"length": int(n), "justification": int(j.value) if j is not None and j.kind == "number" else 0})
    return {"text": text, "fonts": fonts, "runs": runs, "paragraphs": paras}


def _ended(text: str) -> str:
    return text if text.endswith("\r") else text + "\r"


def _array(values: list[int]) -> bytes:
    return b"[ " + b" ".join(str(v).encode() for v in values) + b" ]"


def _runs(data: bytes, holder: Node, keep: list[bytes], lengths: list[int]) -> list[tuple[int, int, bytes]]:
    arr, sizes = holder.get("RunArray"), holder.get("RunLengthArray")
    first, last = arr.items[0], arr.items[-1]
    gap = data[arr.items[0].end : arr.items[1].start] if len(arr.items) > 1 else b" "
    return [(first.start, last.end, gap.join(keep)), (sizes.start, sizes.end, _array(lengths))]


def set_text(data: bytes, text: str) -> bytes:
    """New text in the style of the first run and the first paragraph."""
    return set_rich_text(data, text, [{"length": units(_ended(text))}], [{"length": units(_ended(text))}])


def _style_changes(source: bytes, node: Node, style: dict, fonts: int = 0) -> list[tuple[int, int, bytes]]:
    sheet = node.get("StyleSheet", "StyleSheetData")
    if sheet is None:
        return []
    changes, more = [], []

    def put(key: str, new: bytes) -> None:
        old = sheet.get(key)
        if old is not None:
            changes.append((old.start, old.end, new))
        else:
            more.append(b"/" + key.encode() + b" " + new + b" ")

    for k, v in style.items():
        if v is None:
            continue
        if k == "font_no":
            put("Font", str(int(v)).encode())
        elif k == "color":
            r, g, b, *a = v
            put("FillColor", b"<< /Type 1 /Values [ " + b" ".join(number_bytes(float(x)) for x in ((a[0] if a else 1.0), r, g, b)) + b" ] >>")
        elif k in STYLE:
            key, form = STYLE[k]
            put(key, (b"true" if v else b"false") if form == "bool" else str(int(v)).encode() if form == "int" else number_bytes(float(v)))
    if more:
        changes.append((sheet.end - 2, sheet.end - 2, b"".join(more)))
    return changes


def _copy(data: bytes, node: Node, changes: list[tuple[int, int, bytes]]) -> bytes:
    return splice(data[node.start : node.end], [(a - node.start, b - node.start, n) for a, b, n in changes])


def _with_fonts(data: bytes, styles: list[dict]) -> tuple[bytes, list[dict]]:
    """Styles whose fonts are named, with the numbers of these, and the data with the fonts that it lacked; a list without
    any font to start from leaves the fonts as they are."""
    out = []
    for s in styles:
        if s.get("font"):
            try:
                data, n = add_font(data, s["font"])
                s = s | {"font_no": n}
            except ValueError:
                pass
        out.append(s)
    return data, out


def set_rich_text(data: bytes, text: str, runs: list[dict], paragraphs: list[dict] | None = None) -> bytes:
    """New text with style runs and paragraphs; run i starts from the old run i, further ones from the first."""
    data, runs = _with_fonts(data, runs)
    root = parse(data)
    engine = root.get("EngineDict")
    text = _ended(text)
    total = units(text)
    body = engine.get("Editor", "Text")
    changes = [(body.start, body.end, string_bytes(text))]
    for holder, specs, styled in ((engine.get("StyleRun"), runs, True), (engine.get("ParagraphRun"), paragraphs or [{"length": total}], False)):
        old = holder.get("RunArray").items
        chosen = fitted([int(s["length"]) for s in specs], total)
        kept = []
        for k, (which, _) in enumerate(chosen):
            node, spec = old[k] if k < len(old) else old[0], specs[which] if which >= 0 else {}
            if styled:
                kept.append(_copy(data, node, _style_changes(data, node, spec)))
            else:
                kept.append(_copy(data, node, _justify(node, spec.get("justification"))))
        changes += _runs(data, holder, kept, [n for _, n in chosen])
    return splice(data, changes)


def _justify(node: Node, value: int | None) -> list[tuple[int, int, bytes]]:
    if value is None:
        return []
    props = node.get("ParagraphSheet", "Properties")
    if props is None:
        return []
    old = props.get("Justification")
    return [(old.start, old.end, str(value).encode())] if old is not None else [(props.end - 2, props.end - 2, b"/Justification " + str(value).encode() + b" ")]


def set_run_style(data: bytes, run: int, **style) -> bytes:
    """New values of one run: font (by name) or font_no, size, color (r, g, b and a), tracking, kerning and so on."""
    root, added = parse(data), []
    if style.get("font"):
        try:
            added, style["font_no"] = _font_added(data, root, style["font"])
        except ValueError:
            pass
    arr = root.get("EngineDict", "StyleRun", "RunArray")
    if not 0 <= run < len(arr.items):
        raise IndexError("run index out of range")
    return splice(data, added + _style_changes(data, arr.items[run], style))


def set_justification(data: bytes, value: int, paragraph: int = -1) -> bytes:
    arr = parse(data).get("EngineDict", "ParagraphRun", "RunArray")
    if paragraph >= len(arr.items):
        raise IndexError("paragraph index out of range")
    nodes = arr.items if paragraph < 0 else arr.items[paragraph : paragraph + 1]
    return splice(data, [c for n in nodes for c in _justify(n, value)])


def add_font(data: bytes, name: str) -> tuple[bytes, int]:
    """The data with the font in its list, and the font's number."""
    added, n = _font_added(data, parse(data), name)
    return splice(data, added), n


def _font_added(data: bytes, root: Node, name: str) -> tuple[list[tuple[int, int, bytes]], int]:
    fonts = root.get("ResourceDict", "FontSet")
    if fonts is None:
        raise ValueError("no font to start from")
    for k, f in enumerate(fonts.items):
        if f.get("Name") is not None and f.get("Name").value == name:
            return [], k
    if not fonts.items:
        raise ValueError("no font to start from")
    last = fonts.items[-1]
    gap = data[fonts.items[-2].end : last.start] if len(fonts.items) > 1 else b" "
    n = last.get("Name")
    return [(last.end, last.end, gap + _copy(data, last, [(n.start, n.end, string_bytes(name))]))], len(fonts.items)


# ---------------------------------------------------------------------------------------------------------- re-emission


def _scalar(data: bytes, n: Node) -> bytes:
    """A scalar in the form it was written in; strings anew, which gives the same for what was well written."""
    return data[n.start : n.end]


def emit(data: bytes, root: Node | None = None) -> bytes:
    """The tree written out in the indented form: one member per line, a tab per level, arrays of dicts over lines."""
    out: list[bytes] = []

    def value(n: Node, level: int | None) -> None:
        tabs, end = (b" ", b"") if level is None else (b"\t" * level, b"\n")
        if n.kind == "dict":
            out.extend((end * (2 if level == 0 else 1), tabs, b"<<", end))
            for key, v in n.items:
                deeper = None if level is None else level + 1
                out.extend((b" " if deeper is None else b"\t" * deeper, b"/", key.encode("latin-1")))
                if v.kind != "dict":
                    out.append(b" ")
                value(v, deeper if v.kind == "dict" or (v.kind == "array" and v.items and v.items[0].kind == "dict") else None)
                out.append(end)
            out.extend((tabs, b">>"))
        elif n.kind == "array":
            out.append(b"[")
            for v in n.items:
                if level is None and v.kind != "dict":
                    out.append(b" ")
                value(v, level)
            out.extend((b" ",) if level is None else (end, tabs))
            out.append(b"]")
        else:
            out.append(_scalar(data, n))

    root = parse(data) if root is None else root
    if root is None or root.kind != "dict":
        raise ValueError("no engine data")
    value(root, 0)
    return b"".join(out)


def emit_compact(data: bytes) -> bytes:
    """The members of document-level text data on one line, a blank in front of each token."""
    tokens: list[bytes] = []

    def members(n: Node) -> None:
        for key, v in n.items:
            tokens.append(b"/" + key.encode("latin-1"))
            value(v)

    def value(n: Node) -> None:
        if n.kind == "dict":
            tokens.append(b"<<")
            members(n)
            tokens.append(b">>")
        elif n.kind == "array":
            tokens.append(b"[")
            for v in n.items:
                value(v)
            tokens.append(b"]")
        else:
            tokens.append(_scalar(data, n))

    root = parse_bare(data)
    if not root.items:
        raise ValueError("no text data")
    members(root)
    return b"".join(b" " + t for t in tokens)


# ----------------------------------------------------------------------------------------------------------------------
# document-level text data: bodies are dicts whose /0 is the text; /5 and /6 hold the runs


def _holds_runs(n: Node | None) -> bool:
    return n is not None and n.kind == "dict" and (a := n.get("0")) is not None and a.kind == "array"


def bodies(root: Node) -> list[Node]:
    out: list[Node] = []

    def walk(n: Node) -> None:
        if n.kind == "dict":
            if (t := n.get("0")) is not None and t.kind == "string" and _holds_runs(n.get("5")) and _holds_runs(n.get("6")):
                out.append(n)
            for _, v in n.items:
                walk(v)
        elif n.kind == "array":
            for v in n.items:
                walk(v)

    walk(root)
    return out


def body_texts(data: bytes) -> list[str]:
    return [b.get("0").value for b in bodies(parse_bare(data))]


def _cut_to(lengths: list[int], total: int) -> list[int]:
    """Lengths above 0 that cover ``total``: the last gives way or takes what is left; without any, one takes all."""
    out, left = [], total
    for n in lengths:
        if n > 0 and left > 0:
            out.append(min(n, left))
            left -= out[-1]
    return [*out[:-1], out[-1] + left] if out else [total]


def set_body_text(data: bytes, index: int, text: str, paragraphs: list[int] = (), styles: list[int] = ()) -> bytes:
    """New text of one body, its runs of the given lengths: old runs in their order, then copies of the last one."""
    return splice(data, _body_changes(data, bodies(parse_bare(data)), index, text, paragraphs, styles))


def set_body_texts(data: bytes, texts: dict[int, str]) -> bytes:
    """New texts of several bodies by index, each in one style."""
    found = bodies(parse_bare(data))
    return splice(data, [c for index, text in texts.items() for c in _body_changes(data, found, index, text)])


def _body_changes(data: bytes, found: list[Node], index: int, text: str, paragraphs: list[int] = (), styles: list[int] = ()) -> list[tuple[int, int, bytes]]:
    if not 0 <= index < len(found):
        raise IndexError("text index out of range")
    body, text = found[index], _ended(text)
    n = body.get("0")
    changes = [(n.start, n.end, string_bytes(text))]
    for key, wanted in (("5", paragraphs), ("6", styles)):
        runs = [r for r in body.get(key, "0").items if r.kind == "dict" and r.get("1") is not None]
        if not runs:
            continue
        made = [(runs[min(k, len(runs) - 1)], v) for k, v in enumerate(_cut_to([int(x) for x in wanted], units(text)))]
        new = [_copy(data, r, [(r.get("1").start, r.get("1").end, str(v).encode())]) for r, v in made]
        changes.append((runs[0].start, runs[-1].end, b" ".join(new)))
    return changes
