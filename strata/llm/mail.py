"""Readable text of raw mail messages.

A message is split into its parts along the boundaries that its headers name, nested ones too; transfer encodings and
charsets are undone, mark-up is taken out, and every text part, attached or not, comes out as a reader sees it.

Results for odd input: null gives no part; a text without headers is one plain part; an unclosed part ends with the
message; a wrong or unknown charset falls back to UTF-8, then to Windows-1252; broken base64 is decoded as far as it is
whole; other attachments give no part.
"""

from __future__ import annotations

import binascii
import html
import re

_HEADER = re.compile(r"(?im)^(content-type|content-transfer-encoding|content-disposition)[ \t]*:[ \t]*(.*(?:\n[ \t].*)*)")
_HEADERS_START = re.compile(r"(?:From [^\n]*\n)?(?:[!-9;-~]+[ \t]*:[^\n]*\n)")
_PARAM = re.compile(r"""([\w*-]+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^\s;"]+))""")
_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(style|script|head|title|template)\b.*?(?:</\1\s*>|\Z)")
_BLOCK = re.compile(r"(?i)</?(?:p|br|div|tr|td|th|table|li|ul|ol|dl|dt|dd|h[1-6]|blockquote|pre|hr|body|html|section|article|header|footer|form|option|img)\b[^>]*>")
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_QUOTE = re.compile(r"(?m)^(?:[ \t]?[>|])+[ \t]?")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
WORD = re.compile(r"[^\W_]+")

DEPTH = 12


def _params(value: str) -> dict[str, str]:
    return {k.lower().rstrip("*"): (q or w) for k, q, w in _PARAM.findall(value)}


def _bytes_as(raw: bytes, charset: str | None) -> str:
    for c in (charset, "utf-8"):
        if c:
            try:
                return raw.decode(c)
            except (UnicodeDecodeError, LookupError, ValueError):
                pass
    return raw.decode("cp1252", "replace")


def _decoded(body: str, encoding: str, charset: str | None) -> str:
    if encoding == "base64":
        clean = _NOT_BASE64.sub("", body)
        clean = clean[: len(clean) - (len(clean) % 4 == 1)]
        return _bytes_as(binascii.a2b_base64(clean + "=" * (-len(clean) % 4)), charset)
    if encoding == "quoted-printable":
        return _bytes_as(binascii.a2b_qp(body.encode("utf-8", "replace")), charset if body.isascii() else "utf-8")
    return body


def reader_text(markup: str) -> str:
    """What a reader sees of an HTML text: inline marks vanish, blocks become line breaks."""
    t = _HIDDEN.sub(" ", markup)
    t = _TAG.sub("", _BLOCK.sub("\n", t))
    return html.unescape(t) if "&" in t else t


def parts(message: str | None, depth: int = 0, markup: bool = False) -> list[tuple[str, bool, str]]:
    """(type, attached, text) of each readable text part; quoted text is included, headers are not; ``markup`` keeps tags."""
    if not message:
        return []
    if "\r" in message:
        message = message.replace("\r\n", "\n").replace("\r", "\n")
    if depth == 0 and not _HEADERS_START.match(message):
        return [("plain", False, message)]
    head, _, body = ("", "", message[1:]) if message.startswith("\n") else message.partition("\n\n")
    fields: dict[str, str] = {}
    for k, v in _HEADER.findall(head):
        fields.setdefault(k.lower(), v.strip())
    kind = fields.get("content-type", "text/plain")
    main = kind.partition(";")[0].strip().lower()
    if main.startswith("multipart/") and depth < DEPTH:
        boundary = _params(kind).get("boundary")
        if boundary:
            out: list[tuple[str, bool, str]] = []
            chunks = re.split(rf"(?m)^--{re.escape(boundary)}(--)?[ \t]*$\n?", "\n" + body)
            # split gives text, closing mark, text, ...: what stands behind a closing mark is no part
            for closed, chunk in zip(chunks[1::2], chunks[2::2]):
                if not closed:
                    out += parts(chunk.removesuffix("\n") or "\n", depth + 1, markup)
            return out
        main = "text/plain"
    encoding = fields.get("content-transfer-encoding", "8bit").strip().lower()
    if main == "message/rfc822" and depth < DEPTH:
        return parts(_decoded(body, encoding, None) if encoding in ("base64", "quoted-printable") else body, depth + 1, markup)
    if not main.startswith("text/") and main != "":
        return []
    text = _decoded(body, encoding, _params(kind).get("charset"))
    attached = fields.get("content-disposition", "").lower().startswith("attachment")
    return [("html", attached, text if markup else reader_text(text))] if main == "text/html" else [("plain", attached, text)]


def words(text: str) -> list[str]:
    """The longest runs of letters or digits, in lower case, without quote marks at the start of lines."""
    return WORD.findall(_QUOTE.sub("", text).lower())


# ---------------------------------------------------------------------------------------------------------------------
# what the sender wrote

_STARTS = "(?:on|am|le|el|em|il)"
#: The line above a quote that names its writer; it may be wrapped once.
_ATTRIBUTION = re.compile(rf"(?im)^{_STARTS}\b[^\n]{{4,200}}?(?:\n(?!{_STARTS}\b)[^\n]{{0,80}}?)?(?:wrote|schrieb|écrit|escribió|escreveu|ha scritto)[^\n]{{0,40}}:[^\S\n]*$")
#: What follows such a mark is somebody else's message, without quote marks.
_FORWARDED = re.compile(r"(?i)^-{2,}\s*(?:original message|forwarded message)")
_RULE = re.compile(r"^\s*(?:[-*_=~#]{3,}|-- ?)\s*$")
_BLOCKQUOTE = re.compile(r"(?i)<(/?)blockquote\b[^>]*>")


def _unquoted(markup: str) -> str:
    """Mark-up without its quotes, which may hold others; an unclosed one reaches to the end."""
    out, depth, at = [], 0, 0
    for m in _BLOCKQUOTE.finditer(markup):
        if depth == 0:
            out.append(markup[at : m.start()])
        depth = max(0, depth - 1) if m[1] else depth + 1
        at = m.end()
    if depth == 0:
        out.append(markup[at:])
    return "\n".join(out)


def own_prose(message: str | None) -> str:
    """The text that the sender wrote, above, between and below quotes: the first body text without quoted lines and the
    lines that name their writers, up to a signature, a notice or a message passed on."""
    found = [p for p in parts(message, markup=True) if not p[1]]
    if not found:
        return ""
    text = next((p[2] for p in found if p[0] == "plain" and p[2].strip()), None)
    if text is None:
        text = reader_text(_unquoted(found[0][2])) if found[0][0] == "html" else found[0][2]
    lines = []
    for line in text.split("\n"):
        if _RULE.match(line) or _FORWARDED.match(line):
            break
        if line.lstrip().startswith((">", "|", "&gt;")):
            continue
        lines.append(line)
    return _ATTRIBUTION.sub("", "\n".join(lines))
