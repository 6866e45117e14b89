"""The text layer of PDF files, by the standard library.

Reads objects, object streams, plain and deflated content, simple fonts (Windows Latin) and
fonts with a Unicode map; text that runs left to right without turning. Files that are
encrypted, damaged or compressed in other ways are PDF_UNSUPPORTED: for them another
extractor's blocks are the input tables of sources.layout.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(<<|>>|\[|\]|<[0-9A-Fa-f\s]*>|\(|/[^\s<>\[\]()/%{}]*|[^\s<>\[\]()/%{}]+|[{}])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Unsupported(ValueError):
    """A file whose text can't be read here."""

    code = "PDF_UNSUPPORTED"


@dataclass(frozen=True)
class Ref:
    number: int


class Operator(bytes):
    """A word of a content stream that isn't a value."""


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose opening bracket stands before at."""
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at : at + 1]
        at += 1
        if c == b"\\":
            c = raw[at : at + 1]
            at += 1
            if octal := re.match(rb"[0-7]{1,3}", raw[at - 1 : at + 2]):
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0]) - 1
            elif c not in b"\r\n":
                out += _ESCAPES.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def values(raw: bytes, at: int = 0) -> Iterator[object]:
    """The values and operators of a piece of a file; references are Ref."""
    stack: list[list] = [[]]
    while m := _TOKEN.match(raw, at):
        word, at = m[1], m.end()
        if word in (b"<<", b"["):
            stack.append([])
            continue
        if word in (b">>", b"]"):
            if len(stack) == 1:
                continue
            inner = stack.pop()
            value: object = dict(zip(inner[::2], inner[1::2], strict=False)) if word == b">>" else inner
        elif word == b"(":
            value, at = _string(raw, at)
        elif word[:1] == b"<":
            digits = re.sub(rb"\s", b"", word[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif word[:1] == b"/":
            value = re.sub(r"#([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), word.decode("latin-1"))
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", word):
            value = float(word) if b"." in word else int(word)
        elif word == b"R" and len(stack[-1]) > 1 and isinstance(stack[-1][-2], int):
            value = Ref(stack[-1][-2])
            del stack[-1][-2:]
        else:
            value = Operator(word)
        stack[-1].append(value)
        if len(stack) == 1 and isinstance(value, Operator):
            yield from stack[0]
            stack[0] = []
    yield from stack[0]


class File:
    def __init__(self, raw: bytes):
        if not raw.startswith(b"%PDF-") or re.search(rb"/Encrypt\b", raw):
            raise Unsupported("encrypted, or no PDF")
        self.objects: dict[int, tuple[object, bytes]] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", raw):
            end = raw.find(b"endobj", m.end())
            body = raw[m.end() : end if end >= 0 else len(raw)]
            head, sep, data = body.partition(b"stream")
            self.objects[int(m[1])] = (next(values(head), None), re.sub(rb"^\r?\n", b"", data.rpartition(b"endstream")[0]) if sep else b"")
        for number in [n for n, (head, _) in self.objects.items() if isinstance(head, dict) and head.get("/Type") == "/ObjStm"]:
            head, data = self.objects[number][0], self.data(number)
            places = [x for x in values(data[: head["/First"]]) if isinstance(x, int)]
            for n, start in zip(places[::2], places[1::2], strict=False):
                self.objects.setdefault(n, (next(values(data, head["/First"] + start), None), b""))

    def get(self, x: object) -> object:
        return self.objects.get(x.number, (None, b""))[0] if isinstance(x, Ref) else x

    def data(self, number: int) -> bytes:
        head, data = self.objects[number]
        filters = self.get(head.get("/Filter")) or []
        parms = self.get(head.get("/DecodeParms"))
        if [f for f in ([filters] if isinstance(filters, str) else filters) if f != "/FlateDecode"] or parms:
            raise Unsupported("a filter that isn't Flate")
        try:
            return zlib.decompressobj().decompress(data) if filters else data
        except zlib.error as e:
            raise Unsupported("damaged") from e

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they take over from above."""
        roots = [h for h, _ in self.objects.values() if isinstance(h, dict) and h.get("/Type") == "/Catalog"]
        if not roots:
            raise Unsupported("no catalog")
        out: list[dict] = []
        seen: set[object] = set()

        def walk(node: object, over: dict) -> None:
            head = self.get(node)
            if not isinstance(head, dict) or node in seen:
                return
            if isinstance(node, Ref):
                seen.add(node)
            own = over | {k: head[k] for k in ("/Resources", "/MediaBox") if k in head}
            if "/Kids" in head:
                for kid in self.get(head["/Kids"]) or []:
                    walk(kid, own)
            else:
                out.append(own | head)

        walk(roots[-1].get("/Pages"), {})
        return out

    def content(self, page: dict) -> bytes:
        found = page.get("/Contents")
        parts = self.get(found) if isinstance(self.get(found), list) else [found]
        return b"\n".join(self.data(x.number) for x in parts if isinstance(x, Ref) and x.number in self.objects)

    def letters(self, font: object) -> tuple[int, dict[int, str] | None]:
        """How many bytes a code has, and what codes stand for; None: Windows Latin."""
        head = self.get(font)
        if not isinstance(head, dict):
            return 1, None
        wide = 2 if head.get("/Subtype") == "/Type0" else 1
        if not isinstance(head.get("/ToUnicode"), Ref):
            return wide, ({} if wide == 2 else None)
        out: dict[int, str] = {}
        number = lambda b: int.from_bytes(b, "big")
        text = lambda b: b.decode("utf-16-be", "replace")
        held: list = []
        for x in values(self.data(head["/ToUnicode"].number)):
            if not isinstance(x, Operator):
                held.append(x)
                continue
            if x == b"endbfchar":
                out |= {number(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False)}
            elif x == b"endbfrange":
                for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                    each = [text(y) for y in to] if isinstance(to, list) else [text(to[:-2]) + chr(number(to[-2:]) + k) for k in range(number(b) - number(a) + 1)]
                    out |= {number(a) + k: y for k, y in enumerate(each)}
            held = []
        return wide, out


def lines(file: File, page: dict) -> list[tuple[float, float, float, str]]:
    """(x, y from the top, size, text) of each run of text on one line, as the page draws them."""
    box = file.get(page.get("/MediaBox")) or [0, 0, 612, 792]
    resources = file.get(page.get("/Resources")) or {}
    fonts = file.get(resources.get("/Font")) or {}
    known: dict[str, tuple[int, dict[int, str] | None]] = {}
    out: list[list] = []
    x = y = left = lead = size = scale = 0.0
    font: tuple[int, dict[int, str] | None] = (1, None)

    def show(raw: bytes) -> None:
        wide, table = font
        text = raw.decode("cp1252", "replace") if table is None else "".join(table.get(int.from_bytes(raw[k : k + wide], "big"), "�") for k in range(0, len(raw), wide))
        if out and out[-1][1] == y and out[-1][4] == left:
            out[-1][3] += text
        else:
            out.append([x, y, size * (scale or 1), text, left])

    args: list = []
    for v in values(file.content(page)):
        if not isinstance(v, Operator):
            args.append(v)
            continue
        if v == b"BT":
            x = y = left = 0.0
            scale = 1.0
        elif v == b"Tf" and len(args) > 1:
            name, size = args[-2], float(args[-1])
            if name not in known:
                known[name] = file.letters(fonts.get(name))
            font = known[name]
        elif v == b"TL" and args:
            lead = float(args[-1])
        elif v in (b"Td", b"TD") and len(args) > 1:
            left, y = left + args[-2], y + args[-1]
            x, lead = left, -float(args[-1]) if v == b"TD" else lead
        elif v == b"Tm" and len(args) > 5:
            scale, left, y = abs(args[-3]) or 1.0, float(args[-2]), float(args[-1])
            x = left
        elif v == b"T*":
            y -= lead
        elif v in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
            y -= lead if v != b"Tj" else 0
            show(args[-1])
        elif v == b"TJ" and args and isinstance(args[-1], list):
            show(b"".join(a if isinstance(a, bytes) else b" " * (font[0] == 1 and a < -200) for a in args[-1] if not isinstance(a, (str, dict))))
        args = []
    top = float(box[3])
    return [(a, top - b, c, t) for a, b, c, t, _ in out if t.strip()]


def blocks(raw: bytes) -> list[list[tuple[float, float, str]]]:
    """For each page its blocks (x, y from the top, text): lines that follow one another closely from the same left edge."""
    file = File(raw)
    out = []
    for page in file.pages():
        found: list[list] = []
        for x, y, size, text in lines(file, page):
            if found and found[-1][0] == x and 0 < y - found[-1][3] <= 1.5 * max(size, 1.0):
                found[-1][2] += "\n" + text
                found[-1][3] = y
            else:
                found.append([x, y, text, y])
        out.append(sorted(((x, y, text) for x, y, text, _ in found), key=lambda b: (round(b[1] / 12), b[0])))
    return out


def made(pages: list[list[str]], size: int = 10) -> bytes:
    """A PDF file with a block of lines on each page, deflated; characters outside Windows Latin become question marks."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for texts in pages:
        shown = [re.sub(rb"([\\()])", rb"\\\1", t.encode("cp1252", "replace")) for t in texts]
        body = zlib.compress(b"BT /F1 %d Tf %d TL 50 740 Td " % (size, size + 2) + b" T* ".join(b"(" + t + b") Tj" for t in shown) + b" ET")
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, x) for k, x in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF\n"
