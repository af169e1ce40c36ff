"""A spreadsheet sink: one table as an OOXML workbook, written as zipped XML with the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

#: Colours of the header, of high and low confidence (background, text) and of data bars.
HEADER, HIGH, LOW, BAR = "FF2C3E50", ("FFC6EFCE", "FF006100"), ("FFFFC7CE", "FF9C0006"), "FF3498DB"
#: The widest column, and what is added to the longest value.
WIDEST, ROOM = 50, 2

MAIN, OFFICE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE, KINDS = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
PLAIN, TITLE, HEAD, BODY, GOOD, BAD = range(6)


def letters(column: int) -> str:
    """0 is A, 26 is AA."""
    out = ""
    column += 1
    while column:
        column, k = divmod(column - 1, 26)
        out = chr(65 + k) + out
    return out


def styles() -> str:
    font = lambda colour="", more="": f"<font>{more}{f'<color rgb={quoteattr(colour)}/>' if colour else ''}</font>"
    fill = lambda colour: f'<fill><patternFill patternType="solid"><fgColor rgb="{colour}"/></patternFill></fill>'
    edge = "".join(f'<{side} style="thin"/>' for side in ("left", "right", "top", "bottom"))
    fonts = [font(), font(more='<b/><sz val="14"/>'), font("FFFFFFFF", "<b/>"), font(HIGH[1]), font(LOW[1])]
    fills = ['<fill><patternFill patternType="none"/></fill>', '<fill><patternFill patternType="gray125"/></fill>', fill(HEADER), fill(HIGH[0]), fill(LOW[0])]
    wrap, centre = '<alignment vertical="top" wrapText="1"/>', '<alignment horizontal="center" vertical="center"/>'
    made = [(0, 0, 0, ""), (1, 0, 0, ""), (2, 2, 1, centre), (0, 0, 1, wrap), (3, 3, 1, wrap), (4, 4, 1, wrap)]
    cells = "".join(f'<xf fontId="{f}" fillId="{g}" borderId="{b}" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1">{a}</xf>' for f, g, b, a in made)
    return f'<styleSheet xmlns="{MAIN}"><fonts count="5">{"".join(fonts)}</fonts><fills count="5">{"".join(fills)}</fills><borders count="2"><border/><border>{edge}</border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="6">{cells}</cellXfs></styleSheet>'


def cell(at: str, value, style: int, number: bool = True) -> str:
    if number and isinstance(value, int | float) and not isinstance(value, bool):
        return f'<c r="{at}" s="{style}"><v>{value}</v></c>'
    return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape("" if value is None else str(value))}</t></is></c>'


def xlsx(rows: Iterable[dict], columns: list[str], title: str, source: str = "", comparison: bool = False, kinds: dict[str, str] | None = None) -> bytes:
    """A workbook with the sheet "Data": title, source line if there is one, header, rows.

    ``kinds`` names columns of numbers and urls, without it numbers are told by their values. In a comparison a
    column named confidence shows high and low in colour, and number columns get data bars.
    Null is an empty cell that counts as four characters for the width. ``rows`` is bounded by its caller and passed once.
    """
    top = 4 if source else 3  # the header's row, from 1
    wide, lines, links, row = [len(c) for c in columns], [], [], top
    for row, values in enumerate(rows, top + 1):
        line = []
        for k, name in enumerate(columns):
            value, at = values.get(name, ""), f"{letters(k)}{row}"
            wide[k] = max(wide[k], len(str(value)))
            style = BODY
            if comparison and name.lower() == "confidence":
                style = {"high": GOOD, "low": BAD}.get(str(value).lower(), BODY)
            line.append(cell(at, value, style, not kinds or kinds.get(name) == "number"))
            if kinds and kinds.get(name) == "url" and value:
                links.append((at, str(value)))
        lines.append(f'<row r="{row}">{"".join(line)}</row>')
    first = [f'<row r="1">{cell("A1", title, TITLE)}</row>']
    if source:
        first.append(f'<row r="2">{cell("A2", f"Source: {source}", PLAIN)}</row>')
    first.append(f'<row r="{top}">{"".join(cell(f"{letters(k)}{top}", c, HEAD) for k, c in enumerate(columns))}</row>')
    widths = "".join(f'<col min="{k}" max="{k}" width="{min(w + ROOM, WIDEST)}" customWidth="1"/>' for k, w in enumerate(wide, 1))
    bars = ""
    if comparison and kinds and row > top:
        numbers = [letters(k) for k, c in enumerate(columns) if kinds.get(c) == "number"]
        bars = "".join(
            f'<conditionalFormatting sqref="{c}{top + 1}:{c}{row}"><cfRule type="dataBar" priority="{p}"><dataBar><cfvo type="min"/><cfvo type="max"/><color rgb="{BAR}"/></dataBar></cfRule></conditionalFormatting>' for p, c in enumerate(numbers, 1)
        )
    refs = "".join(f'<hyperlink ref="{at}" r:id="h{k}"/>' for k, (at, _) in enumerate(links))
    sheet = f'<worksheet xmlns="{MAIN}" xmlns:r="{OFFICE}">{f"<cols>{widths}</cols>" if widths else ""}<sheetData>{"".join(first + lines)}</sheetData>{bars}{f"<hyperlinks>{refs}</hyperlinks>" if refs else ""}</worksheet>'
    relation = lambda key, kind, to, more="": f'<Relationship Id="{key}" Type="{OFFICE}/{kind}" Target={quoteattr(to)}{more}/>'
    related = lambda *found: f'<Relationships xmlns="{PACKAGE}/relationships">{"".join(found)}</Relationships>'
    part = lambda name, kind: f'<Override PartName="/xl/{name}.xml" ContentType="{KINDS}.{kind}+xml"/>'
    files = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{part("workbook", "sheet.main")}{part("worksheets/sheet1", "worksheet")}{part("styles", "styles")}</Types>',
        "_rels/.rels": related(relation("r1", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": related(relation("r1", "worksheet", "worksheets/sheet1.xml"), relation("r2", "styles", "styles.xml")),
        "xl/styles.xml": styles(),
        "xl/worksheets/sheet1.xml": sheet,
    }
    if links:
        files["xl/worksheets/_rels/sheet1.xml.rels"] = related(*(relation(f"h{k}", "hyperlink", to, ' TargetMode="External"') for k, (_, to) in enumerate(links)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()
