"""Text of PDF files, with nothing but the standard library: objects, streams, content operators, character maps, tables by their rules.

Read: files with a classic or a compressed cross reference (objects are found by scanning, so damaged tables don't matter), streams that are
plain or Flate-coded (with PNG predictors), object streams, simple fonts in Latin-1 with Differences of single letters, and fonts with a
ToUnicode map.  Not read: encrypted files and other filters, whose files fail or count as scanned.
"""

from __future__ import annotations

import re
import zlib

_TOKEN = re.compile(rb"%[^\r\n]*|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_LETTERS = {"space": " ", "comma": ",", "period": ".", "hyphen": "-", "colon": ":", "at": "@", **{n: str(k) for k, n in enumerate("zero one two three four five six seven eight nine".split())}}
#: Fewer letters than this in the whole file, and it is a scan.
LEAST = 10
ROW_GAP = 3.0


class Name(str):
    pass


class Ref(int):
    pass


def _string(raw: bytes) -> bytes:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r", b"\r\n") else m[1]), raw[1:-1], flags=re.S)


def parse(data: bytes):
    """All values of a piece of PDF, operators as bytes."""
    stack: list[list] = [[]]
    for token in _TOKEN.findall(data):
        if token[:1] == b"%":
            continue
        top = stack[-1]
        if token in (b"[", b"<<"):
            stack.append([])
        elif token in (b"]", b">>") and len(stack) > 1:
            inner = stack.pop()
            stack[-1].append(dict(zip(inner[::2], inner[1::2])) if token == b">>" else inner)
        elif token[:1] == b"/":
            top.append(Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), token[1:]).decode("latin-1")))
        elif token[:1] in b"(<":
            top.append(_string(token))
        elif token == b"R" and len(top) > 1 and isinstance(top[-1], int) and isinstance(top[-2], int):
            top[-2:] = [Ref(top[-2])]
        else:
            try:
                top.append(float(token) if b"." in token else int(token))
            except ValueError:
                top.append({b"true": True, b"false": False, b"null": None}.get(token, token))
    while len(stack) > 1:
        stack[-2].append(stack.pop())
    return stack[0]


def _unpredict(data: bytes, columns: int) -> bytes:
    """PNG rows: each begins with its filter."""
    out, before = bytearray(), bytearray(columns)
    for at in range(0, len(data) - columns, columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for k in range(columns):
            left, up, corner = (row[k - 1] if k else 0), before[k], (before[k - 1] if k else 0)
            p = left + up - corner
            nearest = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            row[k] = (row[k] + (0, left, up, (left + up) // 2, nearest)[kind]) & 255
        out += row
        before = row
    return bytes(out)


class File:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s", data):
            raise ValueError("the PDF file is encrypted")
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            head, mark, rest = m[2].partition(b"stream")
            values = parse(head)
            body = None
            if mark:
                start = 2 if rest[:2] == b"\r\n" else 1
                body = rest[start : rest.rfind(b"endstream")]
            self.objects[int(m[1])] = (values[0] if values else None, body)
        for value, body in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                inside = self._decode(value, body)
                numbers = parse(inside[: value["First"]])
                ends = [*numbers[3::2], len(inside) - value["First"]]
                for number, at, stop in zip(numbers[::2], numbers[1::2], ends):
                    found = parse(inside[value["First"] + at : value["First"] + stop])
                    self.objects.setdefault(number, (found[0] if found else None, None))

    def get(self, x):
        return self.objects.get(int(x), (None, None))[0] if isinstance(x, Ref) else x

    def _decode(self, head: dict, body: bytes) -> bytes:
        length = self.get(head.get("Length"))
        body = body[:length] if isinstance(length, int) else body
        kinds = self.get(head.get("Filter")) or []
        for kind in kinds if isinstance(kinds, list) else [kinds]:
            if kind != "FlateDecode":
                return b""
            body = zlib.decompressobj().decompress(body)
        how = self.get(head.get("DecodeParms"))
        if isinstance(how, dict) and how.get("Predictor", 1) >= 10:
            body = _unpredict(body, how.get("Columns", 1))
        return body

    def stream(self, ref) -> bytes:
        head, body = self.objects.get(int(ref), (None, None)) if isinstance(ref, Ref) else (None, None)
        return self._decode(head, body) if isinstance(head, dict) and body is not None else b""

    def pages(self):
        root = next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        seen: set[int] = set()

        def walk(ref, inherited):
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                return
            if isinstance(ref, Ref):
                seen.add(int(ref))
            own = {**inherited, **({"Resources": node["Resources"]} if "Resources" in node else {})}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    yield from walk(kid, own)
            else:
                yield {**node, **own}

        yield from walk(root.get("Pages"), {}) if root else ()


def _font(pdf: File, font: dict):
    """bytes -> text."""
    if "ToUnicode" in font:
        table, size = {}, 1
        text = pdf.stream(font["ToUnicode"])
        wide = lambda x: x.decode("utf-16-be", "ignore")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
            values = parse(block)
            table.update({int.from_bytes(a, "big"): wide(b) for a, b in zip(values[::2], values[1::2])})
            size = max(size, *(len(a) for a in values[::2]), 1)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
            values = parse(block)
            for a, b, to in zip(values[::3], values[1::3], values[2::3]):
                size = max(size, len(a))
                first = int.from_bytes(a, "big")
                for k in range(int.from_bytes(b, "big") - first + 1):
                    table[first + k] = wide(to[k]) if isinstance(to, list) else wide(to[:-2] + (int.from_bytes(to[-2:], "big") + k).to_bytes(2, "big"))
        if font.get("Subtype") == "Type0":
            size = 2
        return lambda raw: "".join(table.get(int.from_bytes(raw[i : i + size], "big"), "") for i in range(0, len(raw), size))
    names: dict[int, str] = {}
    encoding = pdf.get(font.get("Encoding"))
    if isinstance(encoding, dict):
        at = 0
        for x in pdf.get(encoding.get("Differences")) or []:
            if isinstance(x, int):
                at = x
            else:
                names[at] = _LETTERS.get(x, x if len(x) == 1 else "")
                at += 1
    return lambda raw: "".join(names[c] if c in names else bytes([c]).decode("cp1252", "ignore") for c in raw)


def _times(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def page_items(pdf: File, page: dict):
    """(pieces (x, y, text, width), boxes (x0, y0, x1, y1)) of a page."""
    resources = pdf.get(page.get("Resources")) or {}
    fonts = {name: pdf.get(ref) for name, ref in (pdf.get(resources.get("Font")) or {}).items()}
    read = {name: _font(pdf, f) for name, f in fonts.items() if isinstance(f, dict)}
    contents = page.get("Contents")
    parts = contents if isinstance(contents, list) else pdf.get(contents) if isinstance(pdf.get(contents), list) else [contents]
    data = b"\n".join(pdf.stream(c) for c in parts if c is not None)
    pieces, boxes, stack = [], [], []
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, matrix, line, decode, size, leading, args = unit, unit, unit, (lambda raw: raw.decode("cp1252", "ignore")), 1.0, 0.0, []

    def show(raw):
        nonlocal matrix
        text = decode(raw)
        at = _times(matrix, ctm)
        width = 0.5 * size * len(text)  # half an em a letter
        pieces.append((at[4], at[5], text, width * abs(at[0])))
        matrix = _times((1, 0, 0, 1, width, 0), matrix)

    for x in parse(data):
        if not isinstance(x, bytes) or isinstance(x, Name) or x not in _OPERATORS:
            args.append(x)
            continue
        try:
            if x == b"q":
                stack.append(ctm)
            elif x == b"Q":
                ctm = stack.pop() if stack else unit
            elif x == b"cm":
                ctm = _times(tuple(args[-6:]), ctm)
            elif x == b"BT":
                matrix = line = unit
            elif x == b"Tf":
                decode, size = read.get(args[-2], decode), float(args[-1])
            elif x == b"TL":
                leading = args[-1]
            elif x in (b"Td", b"TD"):
                leading = -args[-1] if x == b"TD" else leading
                matrix = line = _times((1, 0, 0, 1, args[-2], args[-1]), line)
            elif x == b"Tm":
                matrix = line = tuple(args[-6:])
            elif x in (b"T*", b"'", b'"'):
                matrix = line = _times((1, 0, 0, 1, 0, -leading), line)
                if x != b"T*":
                    show(args[-1])
            elif x == b"Tj":
                show(args[-1])
            elif x == b"TJ":
                for part in args[-1]:
                    if isinstance(part, bytes):
                        show(part)
                    else:
                        matrix = _times((1, 0, 0, 1, -part / 1000 * size, 0), matrix)
                        if part < -200 and pieces:
                            pieces[-1] = (*pieces[-1][:2], pieces[-1][2] + " ", pieces[-1][3])
            elif x == b"re":
                a, b, w, h = args[-4:]
                (x0, y0), (x1, y1) = ((ctm[0] * u + ctm[2] * v + ctm[4], ctm[1] * u + ctm[3] * v + ctm[5]) for u, v in ((a, b), (a + w, b + h)))
                boxes.append((min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)))
        except (IndexError, TypeError, ValueError):
            pass  # a broken operator changes nothing
        args = []
    return pieces, boxes


_OPERATORS = set(b"q Q cm BT ET Tf TL Td TD Tm T* ' \" Tj TJ re f F f* S s n W W* g G rg RG k K cs CS sc SC scn SCN w J j M d i gs ri m l c v y h B B* b b* sh Do Tc Tw Tz Tr Ts BMC BDC EMC MP DP BX EX d0 d1".split())


def inside(piece, box) -> bool:
    """Whether a piece of text lies in a table's box."""
    return piece[0] >= box[0] and piece[1] >= box[1] and piece[0] <= box[2] and piece[1] <= box[3]


def _rows(pieces) -> list[list]:
    rows: list[list] = []
    for piece in sorted(pieces, key=lambda p: (-round(p[1] / ROW_GAP), p[0])):
        if rows and abs(rows[-1][-1][1] - piece[1]) <= ROW_GAP:
            rows[-1].append(piece)
        else:
            rows.append([piece])
    return rows


def _line(row) -> str:
    out, stop = "", None
    for x, _, text, width in sorted(row):
        out += (" " if stop is not None and x - stop > 1 and not out.endswith(" ") else "") + text
        stop = x + width
    return out.strip()


def page_text(pieces, boxes) -> str:
    """The text outside of tables by rows, then the tables' rows with bars.  Four cells or more that share edges make a table."""
    cells = [b for b in boxes if b[2] - b[0] > 5 and b[3] - b[1] > 5]
    cells = [b for b in cells if not any(b != o and b[0] <= o[0] and b[1] <= o[1] and b[2] >= o[2] and b[3] >= o[3] for o in cells)]
    if len(set(cells)) < 4:
        cells = []
    parts = [x for row in _rows([p for p in pieces if not any(inside(p, c) for c in cells)]) if (x := _line(row))]
    out = ["\n".join(parts)] if parts else []
    for y in sorted({round(c[3]) for c in cells}, reverse=True):
        texts = [t for c in sorted(set(c for c in cells if round(c[3]) == y)) if (t := "\n".join(_line(r) for r in _rows([p for p in pieces if inside(p, c)])).strip())]
        out += [" | ".join(texts)] if texts else []
    return "\n".join(out).strip()


def pdf_text(data: bytes) -> str | None:
    """The pages' text with rules between; None for a scan."""
    pdf = File(data)
    pages = [page_text(*page_items(pdf, p)) for p in pdf.pages()]
    return None if sum(len(p) for p in pages) < LEAST else "\n\n---\n\n".join(p for p in pages if p)
