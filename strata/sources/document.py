"""One layered document: bytes to rows of tables, and rows back to the same bytes.

``read`` parses the structure and leaves pixels as they are; only what the wanted tables need is fetched and parsed. Every
section keeps what is needed to write it back byte for byte; a layer whose fields were edited (``dirty``) is written from
its fields and info blocks: name, id, fill opacity, label and folder kind replace what the blocks hold of them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Collection
from functools import lru_cache

from strata.functions import codec, descriptor, engine_data
from strata.functions.binio import Ranged, Reader, Short, Writer
from strata.operators.layers import ADJUST_KEYS, BLEND, FILL_KEYS

#: Table -> columns with their Spark types.
SCHEMAS = {
    "documents": "path string, error string, version int, channels int, height int, width int, depth int, mode int, reserved binary, color_data binary, hres double, vres double, merged_alpha boolean, n_layers int, last_applied_comp int, global_mask binary, global_layer_mask struct<overlay_color_space:int,color1:int,color2:int,color3:int,color4:int,opacity:int,kind:int>, layer_pad binary, no_layers boolean, composite binary",
    "layers": "path string, idx int, rect_top int, rect_left int, rect_bottom int, rect_right int, sig string, blend_key string, blend_mode string, opacity int, clipping int, flag int, filler int, mask_raw binary, ranges_raw binary, name_raw binary, extra binary, dirty boolean, layer_type string, layer_id int, name_unicode string, fill_opacity int, sheet_color int, mask struct<rect_top:int,rect_left:int,rect_bottom:int,rect_right:int,default_color:int,flags:int,user_density:int,user_feather:double,vector_density:int,vector_feather:double,real_flags:int,real_background:int,real_top:int,real_left:int,real_bottom:int,real_right:int>, blend_ranges array<struct<source:int,dest:int>>, info_keys array<string>",
    "channels": "path string, idx int, ch_pos int, ch_id int, length int, compression int, data binary",
    "info_blocks": "path string, idx int, pos int, sig string, key string, size int, data binary",
    "descriptor_leaves": "path string, idx int, block string, jpath string, type string, v_long bigint, v_double double, v_bool boolean, v_string string, unit string, enum_type string, v_bytes binary",
    "descriptors": "path string, idx int, block string, json string",
    "text_layers": "path string, idx int, text string, orientation string, justification int, xx double, xy double, yx double, yy double, tx double, ty double, bound_left double, bound_top double, bound_right double, bound_bottom double, text_index int",
    "text_runs": "path string, idx int, run int, length int, font string, size_px double, r double, g double, b double, a double, tracking int, kerning int, auto_kerning boolean, bold boolean, italic boolean, underline boolean",
    "text_paragraphs": "path string, idx int, para int, length int, justification int",
    "text_fonts": "path string, idx int, font_no int, name string",
    "resources": "path string, pos int, sig string, id int, name binary, size int, data binary",
    "guides": "path string, n int, location double, direction string",
    "grid": "path string, horizontal int, vertical int",
    "slices": "path string, n int, id int, group_id int, origin int, associated_layer_id int, type int, name string, url string, target string, message string, alt_tag string, cell_text string, is_cell_text_html boolean, left int, top int, right int, bottom int, horizontal_align int, vertical_align int, a int, r int, g int, b int",
    "comps": "path string, id int, name string, comment string, record_visibility boolean, record_position boolean, record_appearance boolean",
    "layer_comp_states": "path string, idx int, pos int, comp_id int, enabled boolean, offset_x int, offset_y int",
    "palette": "path string, n int, r int, g int, b int, a int",
    "document_blocks": "path string, pos int, sig string, key string, size int, data binary, padding binary",
    "txt2_texts": "path string, text_index int, text string",
    "thumbnails": "path string, format int, width int, height int, data binary",
}

_MASK = ("rect_top", "rect_left", "rect_bottom", "rect_right", "default_color", "flags", "user_density", "user_feather", "vector_density", "vector_feather", "real_flags", "real_background", "real_top", "real_left", "real_bottom", "real_right")


#: Tables that the info blocks of layers give, beside what they say of the layer itself.
_FROM_BLOCKS = {"descriptor_leaves", "descriptors", "text_layers", "text_runs", "text_paragraphs", "text_fonts", "layer_comp_states"}
#: Info blocks that give these tables, and the tables that a resource gives.
_GIVES = {"TySh", "shmd", *descriptor.PREFIX}
_OF_RESOURCE = {1032: {"grid", "guides"}, 1033: {"thumbnails"}, 1036: {"thumbnails"}, 1050: {"slices"}, 1065: {"documents", "comps"}}
_RECT, _CHANNEL, _BLEND, _BLOCK = struct.Struct(">4iH"), struct.Struct(">hI"), struct.Struct(">4s4s4BI"), struct.Struct(">4s4sI")


def read(path: str, data: bytes | Ranged, want: Collection[str] | None = None, pixels: bool = True) -> dict[str, list[dict]]:
    """Rows by table, of the ``want``-ed tables at least; a document that can't be parsed gives one row in documents with
    the error. Without ``pixels`` the data of channels and the composite are null and are not fetched."""
    want = set(SCHEMAS if want is None else want)
    out: dict[str, list[dict]] = {t: [] for t in SCHEMAS}
    doc = {"path": path, "error": None}
    out["documents"].append(doc)
    try:
        r = Reader(data)
        _header(r, doc)
        _resources(r.sub(r.u32()), path, doc, out, want)
        if want - {"resources", "guides", "grid", "slices", "comps", "palette", "thumbnails"}:
            _layer_section(r.sub(r.u32()), path, doc, out, want, pixels)
            if pixels and "documents" in want:
                doc["composite"] = r.rest()
        _palette(path, doc, out)
    except (ValueError, IndexError, KeyError) as e:
        doc["error"] = f"{type(e).__name__}: {e}"
    return out


def _header(r: Reader, doc: dict) -> None:
    if r.take(4) != b"8BPS":
        raise ValueError("no layered document")
    doc["version"] = r.u16()
    if doc["version"] != 1:
        raise ValueError("version unsupported")
    doc["reserved"] = r.take(6)
    doc["channels"], doc["height"], doc["width"], doc["depth"], doc["mode"] = r.u16(), r.u32(), r.u32(), r.u16(), r.u16()
    doc["color_data"] = r.take(r.u32())
    doc |= {"hres": 72.0, "vres": 72.0, "merged_alpha": False, "n_layers": 0, "last_applied_comp": None}


def _resources(r: Reader, path: str, doc: dict, out: dict, want: set[str]) -> None:
    pos = 0
    while r.left() >= 11:
        sig, number, name, size = r.key(), r.u16(), r.pascal(2), None
        size = r.u32()
        data = r.take(min(size, r.left()))
        if size % 2 and r.left():
            r.skip(1)
        out["resources"].append({"path": path, "pos": pos, "sig": sig, "id": number, "name": name, "size": size, "data": data})
        pos += 1
        if number in _OF_RESOURCE and not want & _OF_RESOURCE[number]:
            continue
        try:
            _resource(number, data, path, doc, out)
        except (ValueError, IndexError):
            pass


def _resource(number: int, data: bytes, path: str, doc: dict, out: dict) -> None:
    r = Reader(data)
    if number == 1005:
        h = r.i32()
        r.skip(4)
        v = r.i32()
        doc["hres"], doc["vres"] = (h / 65536 if h > 0 else 72.0), (v / 65536 if v > 0 else 72.0)
    elif number == 1032:
        r.skip(4)
        out["grid"].append({"path": path, "horizontal": r.i32(), "vertical": r.i32()})
        for n in range(r.u32()):
            location, direction = r.i32(), r.u8()
            out["guides"].append({"path": path, "n": n, "location": location / 32, "direction": "horizontal" if direction else "vertical"})
    elif number == 1050:
        _slices(r, path, out)
    elif number == 1065:
        o = descriptor.parse(data, 4)
        listed, last = descriptor.item(o, "list"), descriptor.item(o, "lastAppliedComp")
        doc["last_applied_comp"] = last[1] if last else None
        for _, c in listed[1] if listed else []:
            p = descriptor.plain_object(c)
            info = p.get("capturedInfo") or 0
            out["comps"].append({"path": path, "id": p.get("compID"), "name": p.get("Nm  "), "comment": p.get("comment"), "record_visibility": bool(info & 1), "record_position": bool(info & 2), "record_appearance": bool(info & 4)})
    elif number == 1046:
        doc["_colors"] = r.i16()
    elif number == 1047:
        doc["_transparent"] = r.i16()
    elif number in (1033, 1036) and (number == 1036 or not out["thumbnails"]):
        form, w, h = r.u32(), r.u32(), r.u32()
        out["thumbnails"][:] = [{"path": path, "format": form, "width": w, "height": h, "data": data[28:]}]


def _slices(r: Reader, path: str, out: dict) -> None:
    if r.u32() != 6:
        return
    r.skip(16)
    r.unicode()
    for n in range(r.u32()):
        s = {"path": path, "n": n, "id": r.i32(), "group_id": r.i32(), "origin": r.i32()}
        s["associated_layer_id"] = r.i32() if s["origin"] == 1 else None
        s["name"], s["type"] = r.unicode(), r.i32()
        s["left"], s["top"], s["right"], s["bottom"] = (r.i32() for _ in range(4))
        s["url"], s["target"], s["message"], s["alt_tag"] = (r.unicode() for _ in range(4))
        s["is_cell_text_html"], s["cell_text"] = r.u8() != 0, r.unicode()
        s["horizontal_align"], s["vertical_align"] = r.i32(), r.i32()
        s["a"], s["r"], s["g"], s["b"] = (r.u8() for _ in range(4))
        out["slices"].append(s)


def _palette(path: str, doc: dict, out: dict) -> None:
    raw = doc["color_data"]
    if doc["mode"] == 2 and len(raw) >= 768:
        n, clear = doc.pop("_colors", None), doc.pop("_transparent", None)
        for k in range(min(256, n) if n and n > 0 else 256):
            out["palette"].append({"path": path, "n": k, "r": raw[k], "g": raw[256 + k], "b": raw[512 + k], "a": 0 if k == clear else 255})
    doc.pop("_colors", None)
    doc.pop("_transparent", None)


def _layer_section(r: Reader, path: str, doc: dict, out: dict, want: set[str], pixels: bool) -> None:
    doc["no_layers"] = not r.left()
    if doc["no_layers"]:
        return
    info = r.sub(r.u32())
    if info.left() >= 2:
        count = info.i16()
        doc["merged_alpha"], doc["n_layers"] = count < 0, abs(count)
        records = [_record(info, path, k, out, want) for k in range(abs(count))]
        for layer, chans, _ in records:
            for pos, (ch, size) in enumerate(chans):
                if "channels" not in want:
                    info.skip(size)
                    continue
                body = info.sub(size)
                out["channels"].append({"path": path, "idx": layer["idx"], "ch_pos": pos, "ch_id": ch, "length": size, "compression": body.u16() if size >= 2 else None, "data": body.rest() if pixels else None})
        doc["layer_pad"] = info.rest()
        for layer, _, blocks in records:
            out["layers"].append(layer)
            _derive(layer, blocks, doc, out, want)
    else:
        doc["layer_pad"] = info.rest()
    if r.left() >= 4:
        doc["global_mask"] = r.take(r.u32())
        doc["global_layer_mask"] = _global_mask(doc["global_mask"])
    pos = 0
    while r.left() >= 12:
        sig, key, size = r.key(), r.key(), r.u32()
        if sig not in ("8BIM", "8B64") or size > r.left():
            raise Short("trailing block")
        data = r.take(size)
        padding = r.take(min(-size % 4, r.left()))
        out["document_blocks"].append({"path": path, "pos": pos, "sig": sig, "key": key, "size": size, "data": data, "padding": padding})
        pos += 1
        if key == "Txt2" and "txt2_texts" in want:
            for k, t in enumerate(engine_data.body_texts(data)):
                out["txt2_texts"].append({"path": path, "text_index": k, "text": t})
    if r.left():
        out["document_blocks"].append({"path": path, "pos": pos, "sig": None, "key": None, "size": r.left(), "data": r.rest(), "padding": b""})


def _global_mask(raw: bytes) -> dict | None:
    if len(raw) < 13:
        return None
    r = Reader(raw)
    return {k: r.i16() for k in ("overlay_color_space", "color1", "color2", "color3", "color4", "opacity")} | {"kind": r.u8()}


def _ranges(raw: bytes) -> list[dict]:
    """Pairs of source and destination, that of the composite gray first."""
    r = Reader(raw)
    return [{"source": r.i32(), "dest": r.i32()} for _ in range(len(raw) // 8)]


def _record(r: Reader, path: str, idx: int, out: dict, want: set[str]) -> tuple[dict, list[tuple[int, int]], list[dict]]:
    layer = {"path": path, "idx": idx, "dirty": False}
    layer["rect_top"], layer["rect_left"], layer["rect_bottom"], layer["rect_right"], n = r.fields(_RECT)
    chans = [r.fields(_CHANNEL) for _ in range(n)]
    sig, blend, layer["opacity"], layer["clipping"], layer["flag"], layer["filler"], size = r.fields(_BLEND)
    layer["sig"], layer["blend_key"] = sig.decode("latin-1"), blend.decode("latin-1")
    x = r.sub(size)
    start = x.pos
    layer["mask_raw"] = x.take(x.u32())
    layer["ranges_raw"] = x.take(x.u32())
    layer["name_raw"] = x.pascal(4)
    layer["mask"] = _mask(layer["mask_raw"])
    blocks: list[dict] = []
    while x.end - x.pos >= 12:
        sig, key, size = x.fields(_BLOCK)
        if sig not in (b"8BIM", b"8B64"):
            break
        data = x.take(min(size, x.end - x.pos))
        blocks.append({"path": path, "idx": idx, "pos": len(blocks), "sig": sig.decode("latin-1"), "key": key.decode("latin-1"), "size": size, "data": data})
    if "info_blocks" in want:
        out["info_blocks"] += blocks
    if "layers" in want:
        layer["blend_ranges"] = _ranges(layer["ranges_raw"])
        layer["info_keys"] = [b["key"] for b in blocks]
        layer["extra"] = bytes(x.data[start : x.end])
    return layer, chans, blocks


def _mask(raw: bytes) -> dict | None:
    if len(raw) < 18:
        return None
    r, m = Reader(raw), dict.fromkeys(_MASK)
    for k in _MASK[:4]:
        m[k] = r.i32()
    m["default_color"], m["flags"] = r.u8(), r.u8()
    if len(raw) >= 36:
        m["real_flags"], m["real_background"] = r.u8(), r.u8()
        for k in _MASK[12:]:
            m[k] = r.i32()
    if m["flags"] & 16 and r.left():
        has = r.u8()
        for k, (bit, form) in {"user_density": (1, "b"), "user_feather": (2, "d"), "vector_density": (4, "b"), "vector_feather": (8, "d")}.items():
            if has & bit:
                m[k] = r.u8() if form == "b" else r.f64()
    return m


def mask_bytes(m: dict) -> bytes:
    params = [k for k in ("user_density", "user_feather", "vector_density", "vector_feather") if m.get(k) is not None]
    w = Writer().put("4i", *[m[k] for k in _MASK[:4]])
    w.put("BB", m["default_color"], (m["flags"] & ~16) | (16 if params else 0))
    if m.get("real_flags") is not None:
        w.put("BB4i", m["real_flags"], m["real_background"], *[m[k] for k in _MASK[12:]])
    if params:
        w.put("B", sum(1 << k for k, p in enumerate(("user_density", "user_feather", "vector_density", "vector_feather")) if p in params))
        for p in params:
            w.put("B" if p.endswith("density") else "d", m[p])
    if m.get("real_flags") is None and not params:
        w.put("H", 0)
    return w.bytes()


def _derive(layer: dict, blocks: list[dict], doc: dict, out: dict, want: set[str]) -> None:
    path, idx = layer["path"], layer["idx"]
    layer |= {"layer_type": "NORMAL", "layer_id": None, "name_unicode": None, "fill_opacity": 255, "sheet_color": 0, "blend_mode": BLEND.get(layer["blend_key"], "INVALID")}
    for b in blocks:
        if b["sig"] == "8B64" or "layers" not in want and b["key"] not in _GIVES:
            continue
        try:
            _block(b["key"], b["data"], layer, doc, out, want)
        except (ValueError, IndexError, KeyError, AttributeError):
            pass
    layer["path"], layer["idx"] = path, idx


def _block(key: str, data: bytes, layer: dict, doc: dict, out: dict, want: set[str]) -> None:
    at = {"path": layer["path"], "idx": layer["idx"]}
    r = Reader(data)
    if key in ADJUST_KEYS:
        layer["layer_type"] = "ADJUST"
    elif key in FILL_KEYS:
        layer["layer_type"] = "FILL"
    elif key in ("lsct", "lsdk"):
        kind = r.u32()
        if kind in (1, 2, 3):
            layer["layer_type"] = "HIDDEN" if kind == 3 else "FOLDER"
        if len(data) >= 12:
            r.skip(4)
            layer["blend_mode"] = BLEND.get(r.key(), "INVALID")
    elif key == "luni":
        layer["name_unicode"] = r.unicode()
    elif key == "lyid":
        layer["layer_id"] = r.i32()
    elif key == "iOpa":
        layer["fill_opacity"] = r.u8()
    elif key == "lclr":
        layer["sheet_color"] = r.u16()
    elif key == "TySh":
        layer["layer_type"] = "TEXT"
        if want & _FROM_BLOCKS:
            _text(r, at, doc, out)
    elif key == "shmd" and "layer_comp_states" in want:
        _metadata(r, at, layer, out)
    if key in descriptor.PREFIX and want & {"descriptors", "descriptor_leaves"}:
        o = descriptor.parse(data, descriptor.PREFIX[key])
        if "descriptors" in want:
            out["descriptors"].append(at | {"block": key, "json": descriptor.to_json(o)})
        out["descriptor_leaves"] += [at | {"block": key} | leaf for leaf in descriptor.leaves(o)]


def _metadata(r: Reader, at: dict, layer: dict, out: dict) -> None:
    for _ in range(r.u32()):
        r.skip(4)
        key = r.key()
        r.skip(4)
        body = r.take(r.u32())
        if key != "cmls":
            continue
        o = descriptor.parse(body, 4)
        for _, c in (descriptor.item(o, "layerSettings") or (None, []))[1]:
            p = descriptor.plain_object(c)
            for comp in p.get("compList") or []:
                off = p.get("Ofst") or {}
                out["layer_comp_states"].append(at | {"pos": len(out["layer_comp_states"]), "comp_id": comp, "enabled": p.get("enab", not layer["flag"] & 2), "offset_x": off.get("Hrzn", 0), "offset_y": off.get("Vrtc", 0)})


def _text(r: Reader, at: dict, doc: dict, out: dict) -> None:
    r.skip(2)
    row = at | dict(zip(("xx", "xy", "yx", "yy", "tx", "ty"), (r.f64() for _ in range(6))))
    r.skip(6)
    o = descriptor.parse_object(r)
    items = {k: n for (k, _), n in o["items"]}
    ornt = items.get("Ornt")
    row |= {"text": items["Txt "][1].removesuffix("\0") if "Txt " in items else None, "orientation": ornt[1][1][0] if ornt else None, "text_index": items["TextIndex"][1] if "TextIndex" in items else None}
    if "bounds" in items:
        for k, n in descriptor.plain(items["bounds"]).items():
            side = {"Left": "left", "Top ": "top", "Rght": "right", "Btom": "bottom"}.get(k)
            if side:
                row[f"bound_{side}"] = n["value"] if isinstance(n, dict) else n
    if "EngineData" in items and (root := engine_data.parse(items["EngineData"][1])) is not None:
        t = engine_data.read_text(root)
        row["text"] = t["text"] or row["text"]
        row["justification"] = t["paragraphs"][0]["justification"] if t["paragraphs"] else None
        for k, name in enumerate(t["fonts"]):
            out["text_fonts"].append(at | {"font_no": k, "name": name})
        for k, run in enumerate(t["runs"]):
            size = run["size"]
            out["text_runs"].append(at | {"run": k, "size_px": size * doc["hres"] / 72 if size is not None and run["inherited"] else size} | {c: run[c] for c in ("length", "font", "r", "g", "b", "a", "tracking", "kerning", "auto_kerning", "bold", "italic", "underline")})
        for k, p in enumerate(t["paragraphs"]):
            out["text_paragraphs"].append(at | {"para": k} | p)
    out["text_layers"].append(row)


# ---------------------------------------------------------------------------------------------------------------- write


def _as_written(key: str, data: bytes, layer: dict) -> bytes:
    """An info block with the layer's own value in it where that differs; a value of None leaves it as it is."""
    if key not in ("luni", "lyid", "iOpa", "lclr"):
        return data
    r = Reader(data)
    try:
        if key == "luni" and layer.get("name_unicode") not in (None, r.unicode()):
            return Writer().unicode(layer["name_unicode"], nul=False).bytes()
        if key == "lyid" and layer.get("layer_id") not in (None, r.i32()):
            return Writer().put("i", layer["layer_id"]).bytes()
        if key == "iOpa" and layer.get("fill_opacity") not in (None, r.u8()):
            return Writer().put("B3x", layer["fill_opacity"]).bytes()
        if key == "lclr" and layer.get("sheet_color") not in (None, r.u16()):
            return Writer().put("H", layer["sheet_color"]).raw(data[2:]).bytes()
    except Short:
        pass
    return data


def _lacking(keys: set[str], layer: dict) -> list[tuple[str, bytes]]:
    """Info blocks for what the layer holds and none of its blocks says."""
    kind = {"FOLDER": 1, "HIDDEN": 3}.get(layer.get("layer_type"))
    if not kind and {"luni", "lyid", "iOpa", "lclr"} <= keys:
        return []
    w = {
        "luni": (layer.get("name_unicode"), lambda v: Writer().unicode(v, nul=False)),
        "lyid": (layer.get("layer_id"), lambda v: Writer().put("i", v)),
        "iOpa": (layer.get("fill_opacity") if layer.get("fill_opacity") != 255 else None, lambda v: Writer().put("B3x", v)),
        "lclr": (layer.get("sheet_color") or None, lambda v: Writer().put("H6x", v)),
        "lsct": (kind if "lsdk" not in keys else None, lambda v: Writer().put("I", v) if v == 3 else Writer().put("I", v).raw("8BIM").raw(layer["blend_key"])),
    }
    return [(k, make(v).bytes()) for k, (v, make) in w.items() if k not in keys and v is not None]


def extra_bytes(layer: dict, blocks: list[dict]) -> bytes:
    """The extra data of an edited layer from its mask, ranges, name and info blocks."""
    mask, raw = layer.get("mask"), layer.get("mask_raw")
    w = Writer().block(raw if raw is not None and _mask(raw) == mask else mask_bytes(mask) if mask else b"").block(layer.get("ranges_raw") or b"").pascal(layer.get("name_raw") or b"", 4)
    for b in blocks:
        w.raw(b["sig"] or "8BIM").raw(b["key"]).block(_as_written(b["key"], b["data"], layer) if b["sig"] != "8B64" else b["data"])
    for key, data in _lacking({b["key"] for b in blocks}, layer):
        w.raw("8BIM").raw(key).block(data)
    return w.bytes()


def write(doc: dict, layers: list[dict], channels: list[dict], resources: list[dict], document_blocks: list[dict], info_blocks: list[dict] = ()) -> bytes:
    """A document from its rows; lists may come in any order."""
    w = Writer().raw("8BPS").put("H", doc["version"] or 1).raw(doc.get("reserved") or b"\0" * 6).put("HIIHH", doc["channels"], doc["height"], doc["width"], doc["depth"], doc["mode"]).block(doc.get("color_data") or b"")
    res = Writer()
    for x in sorted(resources, key=lambda x: x["pos"]):
        res.raw(x.get("sig") or "8BIM").put("H", x["id"]).pascal(x.get("name") or b"", 2).block(x["data"])
        if len(x["data"]) % 2:
            res.raw(b"\0")
    w.block(res.bytes())
    if doc.get("no_layers") and not layers and not document_blocks:
        return w.put("I", 0).raw(doc.get("composite") or b"").bytes()
    own: dict[int, list[dict]] = {}
    for c in sorted(channels, key=lambda c: c["ch_pos"]):
        own.setdefault(c["idx"], []).append(c)
    blocks: dict[int, list[dict]] = {}
    for b in sorted(info_blocks, key=lambda b: b["pos"]):
        blocks.setdefault(b["idx"], []).append(b)
    info, ordered = Writer(), sorted(layers, key=lambda x: x["idx"])
    if ordered or doc.get("n_layers"):
        info.put("h", -len(ordered) if doc.get("merged_alpha") else len(ordered))
        for x in ordered:
            chans = own.get(x["idx"], [])
            info.put("4i", x["rect_top"], x["rect_left"], x["rect_bottom"], x["rect_right"]).put("H", len(chans))
            for c in chans:
                info.put("hI", c["ch_id"], len(c["data"]) + (0 if c["compression"] is None else 2))
            info.raw(x.get("sig") or "8BIM").raw(x["blend_key"]).put("4B", x["opacity"], x["clipping"], x["flag"], x.get("filler") or 0)
            info.block(x["extra"] if not x.get("dirty") and x.get("extra") is not None else extra_bytes(x, blocks.get(x["idx"], [])))
        for x in ordered:
            for c in own.get(x["idx"], []):
                if c["compression"] is not None:
                    info.put("H", c["compression"])
                info.raw(c["data"])
    pad = doc.get("layer_pad")
    clean = not any(x.get("dirty") for x in ordered) and len(ordered) == (doc.get("n_layers") or 0)
    info.raw(pad) if pad is not None and clean and (len(info.out) + len(pad)) % 2 == 0 else info.pad(2)
    section = Writer().block(info.bytes())
    if doc.get("global_mask") is not None or document_blocks:
        section.block(doc.get("global_mask") or b"")
    for b in sorted(document_blocks, key=lambda b: b["pos"]):
        if b["key"] is None:
            section.raw(b["data"])
        else:
            section.raw(b["sig"]).raw(b["key"]).block(b["data"]).raw(b["padding"] if b.get("padding") is not None and len(b["data"]) == b.get("size") else b"\0" * (-len(b["data"]) % 4))
    return w.block(section.bytes()).raw(doc.get("composite") or b"").bytes()


# ------------------------------------------------------------------------------------------------------------- building


def _luni(name: str) -> dict:
    return {"sig": "8BIM", "key": "luni", "data": Writer().unicode(name, nul=False).bytes()}


def pascal_name(name: str) -> bytes:
    """The short name: bytes of UTF-8, 255 at most."""
    return name.encode("utf-8", "replace")[:255]


def _base(idx: int, name: str, layer_id: int) -> tuple[dict, list[dict]]:
    layer = {"idx": idx, "rect_top": 0, "rect_left": 0, "rect_bottom": 0, "rect_right": 0, "sig": "8BIM", "blend_key": "norm", "opacity": 255, "clipping": 0, "flag": 8, "filler": 0, "mask": None, "ranges_raw": b"", "name_raw": pascal_name(name), "dirty": True}
    return layer, [_luni(name), {"sig": "8BIM", "key": "lyid", "data": Writer().put("i", layer_id).bytes()}]


def _numbered(idx: int, blocks: list[dict]) -> list[dict]:
    return [b | {"idx": idx, "pos": k} for k, b in enumerate(blocks)]


def blank(width: int, height: int, mode: int = 3) -> dict:
    """A white 8-bit RGB document without layers."""
    if mode != 3:
        raise ValueError("only RGB documents can be created")
    return {"version": 1, "channels": 3, "height": height, "width": width, "depth": 8, "mode": 3, "color_data": b"", "merged_alpha": False, "n_layers": 0, "no_layers": False, "global_mask": b"", "composite": _white(width, height)}


@lru_cache(maxsize=4)
def _white(width: int, height: int) -> bytes:
    return codec.solid_composite([255] * 3, width, height)


_packed_small = lru_cache(maxsize=4096)(codec.pack_plane)


def _packed(plane: bytes, width: int, height: int) -> bytes:
    """Small planes are often of one colour and come many times."""
    return (_packed_small if len(plane) <= 256 else codec.pack_plane)(plane, width, height)


def image_layer(idx: int, name: str, layer_id: int, bgra: bytes, width: int, height: int, top: int = 0, left: int = 0) -> tuple[dict, list[dict], list[dict]]:
    """(layer, channels, info blocks) of a new image layer; wrong buffer sizes raise."""
    if len(bgra) != 4 * width * height:
        raise ValueError("buffer size does not fit the image")
    layer, blocks = _base(idx, name, layer_id)
    layer |= {"rect_top": top, "rect_left": left, "rect_bottom": top + height, "rect_right": left + width}
    order = ((-1, 3), (0, 2), (1, 1), (2, 0))
    chans = [{"idx": idx, "ch_pos": k, "ch_id": ch, "compression": codec.RLE, "data": _packed(bgra[at::4], width, height)} for k, (ch, at) in enumerate(order)]
    return layer, chans, _numbered(idx, blocks)


def mask_channel(idx: int, pos: int, plane: bytes, width: int, height: int) -> dict:
    if len(plane) != width * height:
        raise ValueError("buffer size does not fit the mask")
    return {"idx": idx, "ch_pos": pos, "ch_id": -2, "compression": codec.RLE, "data": _packed(plane, width, height)}


def divider(idx: int, name: str, layer_id: int, kind: int) -> tuple[dict, list[dict], list[dict]]:
    """(layer, channels, info blocks) of a folder (1 open, 2 closed) or of the divider at its foot (3)."""
    layer, blocks = _base(idx, name, layer_id)
    w = Writer().put("I", kind)
    if kind != 3:
        w.raw("8BIM").raw("pass")
        layer["blend_key"] = "pass"
    chans = [{"idx": idx, "ch_pos": k, "ch_id": ch, "compression": codec.RLE, "data": b""} for k, ch in enumerate((-1, 0, 1, 2))]
    return layer, chans, _numbered(idx, [*blocks, {"sig": "8BIM", "key": "lsct", "data": w.bytes()}])


def rewrite(data: bytes, change: Callable[[int, str, bytes], bytes | None], follow: Callable[[str, bytes], bytes | None] = lambda key, data: data) -> bytes:
    """A document with the info blocks that ``change`` (idx, key, data) gives new bytes for; None leaves a block as it is.
    ``follow`` (key, data), called after that, gives the document blocks, None drops one. The bytes are those of
    :func:`write` with the same edits: everything else stays as it is, beside the padding of the changed sections."""
    head = Reader(data)
    head.skip(26)
    head.skip(head.u32())
    head.skip(head.u32())
    at = head.pos
    r = head.sub(head.u32())
    if not r.left():
        return bytes(data)
    info, out = r.sub(r.u32()), bytearray()
    edited = False
    if info.left() >= 2:
        kept, pixels = info.pos, 0
        for k in range(abs(info.i16())):
            for _ in range(info.fields(_RECT)[4]):
                pixels += info.fields(_CHANNEL)[1]
            *_, size = info.fields(_BLEND)
            x, head_end, pieces = info.sub(size), info.pos - size, []
            x.skip(x.u32())
            x.skip(x.u32())
            x.pascal(4)
            done = head_end
            while x.end - x.pos >= 12:
                sig, key, n = x.fields(_BLOCK)
                if sig not in (b"8BIM", b"8B64"):
                    break
                old = x.take(min(n, x.end - x.pos))
                made = change(k, key.decode("latin-1"), old) if sig == b"8BIM" else None
                if made is not None:
                    pieces += [data[done : x.pos - len(old) - 4], struct.pack(">I", len(made)), made]
                    done = x.pos
            if pieces:
                body = b"".join([*pieces, data[done : x.end]])
                out += data[kept : head_end - 4] + struct.pack(">I", len(body)) + body
                kept, edited = x.end, True
        out += data[kept : info.pos]
        kept = info.pos
        info.skip(pixels)
        out += data[kept : info.pos]
        out += b"\0" * (len(out) % 2) if edited else info.rest()
    else:
        out += info.rest()
    section = Writer().block(out)
    if r.left() >= 4:
        section.block(r.take(r.u32()))
    while r.left() >= 12:
        sig, key, size = r.fields(_BLOCK)
        if sig not in (b"8BIM", b"8B64") or size > r.left():
            raise Short("trailing block")
        old, pad = r.take(size), r.take(min(-size % 4, r.left()))
        made = follow(key.decode("latin-1"), old)
        if made is not None:
            section.raw(sig).raw(key).block(made).raw(pad if len(made) == size else b"\0" * (-len(made) % 4))
    section.raw(r.rest())
    return b"".join((data[:at], struct.pack(">I", len(section.out)), section.out, data[r.end :]))


#: Bytes in front of the descriptor of a text block, and the numbers of the transform in them.
TEXT_PREFIX, TRANSFORM = 56, ("xx", "xy", "yx", "yy", "tx", "ty")


def change_text_block(data: bytes, change: Callable[[bytes, dict[str, tuple]], bytes]) -> bytes:
    """A text block taken apart into the bytes in front, the items of its descriptor by key, which ``change`` may replace,
    and what follows; ``change`` returns the bytes in front."""
    r = Reader(data)
    head = r.take(TEXT_PREFIX)
    o = descriptor.parse_object(r)
    tail = r.rest()
    items = {key[0]: node for key, node in o["items"]}
    head = change(head, items)
    return head + descriptor.serialize(o | {"items": [(key, items[key[0]]) for key, _ in o["items"]]}) + tail


def edit_text_block(data: bytes, change: Callable[[bytes], bytes]) -> bytes:
    """A text block with its engine data replaced by ``change(engine_data)``; the text in the descriptor follows."""

    return change_text_block(data, lambda head, items: _engine_changed(head, items, change))


def _engine_changed(head: bytes, items: dict[str, tuple], change: Callable[[bytes], bytes]) -> bytes:
    if "EngineData" not in items:
        raise ValueError("text layer has no engine data")
    new = change(items["EngineData"][1])
    items["EngineData"] = (items["EngineData"][0], new)
    if "Txt " in items:
        kind, old = items["Txt "]
        items["Txt "] = (kind, engine_data.text_of(engine_data.parse(new)) + "\0" * old.endswith("\0"))
    return head


def _is_text(block: bytes) -> bool:
    """Whether a text block gives a row of text_layers."""
    try:
        _text(Reader(block), {}, {"hres": 72.0}, {t: [] for t in SCHEMAS})
    except (ValueError, IndexError, KeyError, AttributeError):
        return False
    return True


def edit_texts(data: bytes, change: Callable[[int, bytes], bytes], texts: Callable[[int], str] | None = None) -> bytes:
    """A document whose text layers have the engine data ``change(idx, engine_data)``. With ``texts`` (idx), which gives
    their new text, the document-level text follows, and is dropped where it can't: no index, or one that is out of range."""
    new: list[tuple[int | None, str]] = []

    def block(idx: int, key: str, old: bytes) -> bytes | None:
        if key != "TySh":
            return None
        index: list[int | None] = []

        def run(head: bytes, items: dict[str, tuple]) -> bytes:
            index.append(items["TextIndex"][1] if "TextIndex" in items else None)
            return _engine_changed(head, items, lambda x: change(idx, x))

        try:
            made = change_text_block(old, run)
        except (ValueError, IndexError, KeyError, AttributeError):
            if _is_text(old):
                raise
            return None
        if texts is not None:
            new.append((index[0], texts(idx)))
        return made

    def follow(key: str, old: bytes) -> bytes | None:
        if key != "Txt2" or not new:
            return old
        if any(k is None for k, _ in new):
            return None
        try:
            return engine_data.set_body_texts(old, dict(sorted(new)))
        except IndexError:
            return None

    return rewrite(data, block, follow)


def edit_descriptors(data: bytes, key: str, change: Callable[[int, dict], dict | None]) -> bytes:
    """A document with the descriptors of ``key`` that ``change(idx, descriptor)`` gives anew; None leaves one as it is."""
    skip = descriptor.PREFIX[key]

    def block(idx: int, k: str, old: bytes) -> bytes | None:
        if k != key:
            return None
        try:
            o = descriptor.parse(old, skip)
        except (ValueError, IndexError, KeyError):
            return None
        new = change(idx, o)
        return None if new is None else old[:skip] + descriptor.serialize(new)

    return rewrite(data, block)


def set_text_transform(data: bytes, matrix: dict[str, float | None]) -> bytes:
    """A text block with new values of its transform; those that are None stay."""

    def run(head: bytes, items: dict[str, tuple]) -> bytes:
        old = struct.unpack(">6d", head[2:50])
        return head[:2] + struct.pack(">6d", *[o if matrix.get(k) is None else matrix[k] for k, o in zip(TRANSFORM, old)]) + head[50:]

    return change_text_block(data, run)


def move_text_block(data: bytes, dx: float, dy: float) -> bytes:
    xx, xy, yx, yy, tx, ty = struct.unpack(">6d", data[2:50])
    return set_text_transform(data, {"tx": tx + dx, "ty": ty + dy})


def set_text_bounds(data: bytes, left: float, top: float, right: float, bottom: float) -> bytes:
    """A text block with a new frame; the box of its letters is clamped into it."""
    sides = {"Left": left, "Top ": top, "Rght": right, "Btom": bottom}

    def side(node: tuple, v: float) -> tuple:
        return (node[0], (node[1][0], float(v))) if node[0] == "UntF" else (node[0], float(v))

    def number(node: tuple) -> float:
        return node[1][1] if node[0] == "UntF" else node[1]

    def box(node: tuple, clamp: bool) -> tuple:
        kind, o = node
        low = {"Left": max, "Top ": max, "Rght": min, "Btom": min}
        return (kind, o | {"items": [(k, side(n, low[k[0]](number(n), sides[k[0]]) if clamp else sides[k[0]]) if k[0] in sides else n) for k, n in o["items"]]})

    def run(head: bytes, items: dict[str, tuple]) -> bytes:
        if "bounds" not in items:
            raise ValueError("text layer has no bounds")
        items["bounds"] = box(items["bounds"], False)
        if "boundingBox" in items:
            items["boundingBox"] = box(items["boundingBox"], True)
        return head

    return change_text_block(data, run)


def known_blend(key: str) -> str:
    if len(key) != 4 or key not in BLEND:
        raise ValueError("unknown blend key")
    return key
