"""Descriptor trees of info blocks: parsed in order, written back byte for byte, shown as JSON and as leaves.

A node is ``(type, value)``; an object is ``(name, class_id, [(key, node), ...])``. Keys and class ids keep the form
they were written in: short ones of four characters and long ones. An unknown type ends the parse; what was read so far
is kept and ``whole`` is false.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from strata.functions.binio import Reader, Short, Writer

Id = tuple[str, bool]  # text, and whether it was written with its length


class Unknown(ValueError):
    pass


def _id(r: Reader) -> Id:
    n = r.u32()
    return (r.take(n or 4).decode("latin-1"), n != 0)


def _put_id(w: Writer, i: Id) -> None:
    text, long = i
    w.put("I", len(text) if long else 0).raw(text)


def parse_object(r: Reader) -> dict:
    out = {"name": r.take(2 * r.u32()).decode("utf-16-be", "surrogatepass"), "class": _id(r), "items": [], "whole": True}
    for _ in range(r.u32()):
        key = _id(r)
        try:
            out["items"].append((key, parse_node(r)))
        except (Unknown, Short):
            out["whole"] = False
            break
    return out


_REFERENCE = ("prop", "Clss", "Enmr", "rele", "Idnt", "indx", "name")


def _reference(r: Reader) -> tuple:
    kind = r.key()
    if kind not in _REFERENCE:
        raise Unknown(kind)
    if kind in ("Idnt", "indx"):
        return (kind, r.u32())
    head = (r.take(2 * r.u32()), _id(r))
    if kind == "prop":
        return (kind, *head, _id(r))
    if kind == "Enmr":
        return (kind, *head, _id(r), _id(r))
    if kind == "rele":
        return (kind, *head, r.u32())
    if kind == "name":
        return (kind, *head, r.take(2 * r.u32()))
    return (kind, *head)


def parse_node(r: Reader) -> tuple:
    kind = r.key()
    if kind in ("Objc", "GlbO"):
        return (kind, parse_object(r))
    if kind == "VlLs":
        return (kind, [parse_node(r) for _ in range(r.u32())])
    if kind == "doub":
        return (kind, r.f64())
    if kind == "UntF":
        return (kind, (r.key(), r.f64()))
    if kind == "TEXT":
        return (kind, r.take(2 * r.u32()).decode("utf-16-be", "surrogatepass"))
    if kind == "enum":
        return (kind, (_id(r), _id(r)))
    if kind == "long":
        return (kind, r.i32())
    if kind == "comp":
        return (kind, r.i64())
    if kind == "bool":
        return (kind, r.u8() != 0)
    if kind in ("type", "GlbC"):
        return (kind, (r.take(2 * r.u32()), _id(r)))
    if kind in ("alis", "tdta"):
        return (kind, r.take(r.u32()))
    if kind == "obj ":
        return (kind, [_reference(r) for _ in range(r.u32())])
    raise Unknown(kind)


def write_object(w: Writer, o: dict) -> None:
    raw = o["name"].encode("utf-16-be", "surrogatepass")
    w.put("I", len(raw) // 2).raw(raw)
    _put_id(w, o["class"])
    w.put("I", len(o["items"]))
    for key, node in o["items"]:
        _put_id(w, key)
        write_node(w, node)


def _write_reference(w: Writer, ref: tuple) -> None:
    kind, *rest = ref
    w.raw(kind)
    if kind in ("Idnt", "indx"):
        w.put("I", rest[0])
        return
    w.put("I", len(rest[0]) // 2).raw(rest[0])
    _put_id(w, rest[1])
    for v in rest[2:]:
        if isinstance(v, tuple):
            _put_id(w, v)
        elif isinstance(v, bytes):
            w.put("I", len(v) // 2).raw(v)
        else:
            w.put("I", v)


def write_node(w: Writer, node: tuple) -> None:
    kind, v = node
    w.raw(kind)
    if kind in ("Objc", "GlbO"):
        write_object(w, v)
    elif kind == "VlLs":
        w.put("I", len(v))
        for x in v:
            write_node(w, x)
    elif kind == "doub":
        w.put("d", v)
    elif kind == "UntF":
        w.raw(v[0]).put("d", v[1])
    elif kind == "TEXT":
        raw = v.encode("utf-16-be", "surrogatepass")
        w.put("I", len(raw) // 2).raw(raw)
    elif kind == "enum":
        _put_id(w, v[0])
        _put_id(w, v[1])
    elif kind == "long":
        w.put("i", v)
    elif kind == "comp":
        w.put("q", v)
    elif kind == "bool":
        w.put("B", int(v))
    elif kind in ("type", "GlbC"):
        w.put("I", len(v[0]) // 2).raw(v[0])
        _put_id(w, v[1])
    elif kind in ("alis", "tdta"):
        w.put("I", len(v)).raw(v)
    elif kind == "obj ":
        w.put("I", len(v))
        for ref in v:
            _write_reference(w, ref)


def parse(data: bytes, skip: int = 0) -> dict:
    r = Reader(data)
    r.skip(skip)
    return parse_object(r)


def serialize(o: dict) -> bytes:
    w = Writer()
    write_object(w, o)
    return w.bytes()


def item(o: dict, key: str) -> tuple | None:
    return next((n for (k, _), n in o["items"] if k == key), None)


def plain(node: tuple):
    """A node as plain values: objects as dicts, units as {value, unit}, enums as {type, value}, references as null."""
    kind, v = node
    if kind in ("Objc", "GlbO"):
        return plain_object(v)
    if kind == "VlLs":
        return [plain(x) for x in v]
    if kind == "UntF":
        return {"value": v[1], "unit": v[0]}
    if kind == "TEXT":
        return v.removesuffix("\0")
    if kind == "enum":
        return {"type": v[0][0], "value": v[1][0]}
    if kind in ("type", "GlbC"):
        return v[1][0]
    if kind in ("alis", "tdta"):
        return v.hex()
    if kind == "obj ":
        return None
    return v if not (isinstance(v, float) and not math.isfinite(v)) else None


def plain_object(o: dict) -> dict:
    return {k: plain(n) for (k, _), n in o["items"]}


def to_json(o: dict) -> str:
    return json.dumps(plain_object(o), ensure_ascii=False)


def leaves(o: dict, at: str = "") -> Iterator[dict]:
    """One row per scalar: jpath, type and the value in the column of its kind."""
    for (k, _), n in o["items"]:
        yield from _leaf(f"{at}.{k.strip()}" if at else k.strip(), n)


def _leaf(at: str, node: tuple) -> Iterator[dict]:
    kind, v = node
    if kind in ("Objc", "GlbO"):
        yield from leaves(v, at)
    elif kind == "VlLs":
        for k, x in enumerate(v):
            yield from _leaf(f"{at}[{k}]", x)
    else:
        row = {"jpath": at, "type": kind, "v_long": None, "v_double": None, "v_bool": None, "v_string": None, "unit": None, "enum_type": None, "v_bytes": None}
        p = plain(node)
        if kind == "UntF":
            row |= {"v_double": v[1], "unit": v[0]}
        elif kind == "doub":
            row["v_double"] = v
        elif kind in ("long", "comp"):
            row["v_long"] = v
        elif kind == "bool":
            row["v_bool"] = v
        elif kind == "enum":
            row |= {"v_string": p["value"], "enum_type": p["type"]}
        elif kind in ("alis", "tdta"):
            row["v_bytes"] = v
        elif isinstance(p, str):
            row["v_string"] = p
        yield row


def merge(o: dict, values: dict) -> dict:
    """The object with new values for keys that it has; types stay, keys that it lacks are passed over."""
    items = dict(enumerate(o["items"]))
    at = {k: n for n, ((k, _), _) in items.items()}
    for key, new in values.items():
        if key not in at:
            continue
        (k, (kind, old)) = items[at[key]]
        items[at[key]] = (k, (kind, _merged(kind, old, new)))
    return o | {"items": [items[n] for n in sorted(items)]}


def _merged(kind: str, old, new):
    if kind in ("Objc", "GlbO"):
        return merge(old, new)
    if kind == "UntF":
        return (new.get("unit", old[0]), float(new.get("value", old[1]))) if isinstance(new, dict) else (old[0], float(new))
    if kind == "doub":
        return float(new)
    if kind in ("long", "comp"):
        return int(new)
    if kind == "bool":
        return bool(new)
    if kind == "TEXT":
        return str(new) + "\0" * old.endswith("\0")
    if kind == "enum":
        return (old[0], (new["value"] if isinstance(new, dict) else new, len(new["value"] if isinstance(new, dict) else new) != 4))
    raise ValueError(f"values of type {kind!r} can't be set")


#: Bytes before the descriptor of an info block.
PREFIX = {"lfx2": 8, "SoCo": 4, "GdFl": 4, "PtFl": 4, "SoLd": 12, "SoLE": 12, "vstk": 4, "CgEd": 4, "vscg": 8, "vogk": 8}
