"""Small inputs written out, for cases that the given tables do not hold."""

GRID = {
    "smi 26": [["Convenio", None, None, None, None], ["Grupo", "Categoría", "SB", "TOTAL", "1742"], ["2.1'", "Monitor  de\ntiempo libre", "1.000,50", 1652.135, "9,75"], ["", "Solo etiqueta", None, "n/d", None], ["3.1", None, 900, None, 8.5], [None, None, 1, 2, 3]],
    "Tablas 2025": [["nota", None], ["Nivel", "Bruto anual", "Bruto Año", "Plus nocturno.", "Hora nocturna", "x"], ["3.1", "14.000,00", "15000", "1.652", "abc", "7"], ["Jefe", None, 12.5, None, 3.25, None]],
    "junk": [["texto", "más texto"], ["uno", "dos"]],
    "one": [["total"], ["hora"]],
}
CELLS = [(1, n, name, r, c, None if v is None else str(v), None if v is None else type(v).__name__.replace("str", "string")) for n, (name, rows) in enumerate(GRID.items()) for r, row in enumerate(rows) for c, v in enumerate(row)]
CELL_SCHEMA = "wb_id int, sheet_no int, sheet string, row_no int, col_no int, v string, v_type string"

UNITS = [
    (1, "es", 0, 1, "CONVENIO COLECTIVO del sector"),
    (1, "es", 1, 1, "Artículo 1. Ámbito"),
    (1, "es", 2, 1, "según el artículo 22 del Estatuto"),
    (1, "es", 3, 2, "Art. 9.1 es un subapartado"),
    (1, "es", 4, 2, "Artículo 9.º Vacaciones"),
    (1, "es", 5, 2, "artículo 8 del texto"),
    (1, "es", 6, 3, "artículo 10 minúscula en orden"),
    (1, "es", 7, 3, "ART 13.a letra"),
    (1, "es", 8, 3, "ARTÍCULO 16.- Uno"),
    (1, "es", 9, 3, "Artículo 16 Dos"),
    (1, "es", 10, 4, "Artículo 8.ºbis Horas"),
    (1, "es", 11, 4, "ARTÍCULO NOVENO Otro"),
    (1, "es", 12, 5, "Disposición adicional primera"),
    (1, "es", 13, 5, "disposición final en minúscula"),
    (1, "eu", 0, 1, "1. artikulua Eremua"),
    (1, "eu", 1, 2, "12 ARTIKULUA"),
    (1, "eu", 2, 2, "testua 3. artikulua"),
    (2, "es", 0, 1, "anexo sin artículos"),
]
UNIT_SCHEMA = "doc_id int, lang string, unit_no int, page int, text string"
ANCHORED = {("es", n) for n in (1, 4, 6, 8, 9, 10, 11, 12)} | {("eu", 0), ("eu", 1)}

GLYPHS = [(1, 1, 0, 0, i, c, x, x + w) for i, (c, x, w) in enumerate([("h", 0.0, 5.0), ("i", 5.2, 3.0), (" ", 8.0, 1.0), ("t", 8.4, 5.0), ("z", 15.0, 5.0), ("a", 20.1, 5.0), ("-", 25.0, 3.0)])]
GLYPHS += [(1, 1, 0, 1, i, c, 4.0 * i + (6.0 if i > 3 else 0.0), 4.0 * i + (6.0 if i > 3 else 0.0) + 4.0) for i, c in enumerate("menapuz")]
GLYPHS += [(1, 1, 1, 0, 0, "X", 0.0, 9.0), (1, 1, 2, 0, 0, "a", 1.0, 1.0), (1, 1, 2, 0, 1, "b", 1.2, 1.2), (1, 1, 2, 0, 2, "c", 1.6, 1.6)]
GLYPHS += [(2, 1, 0, 0, i, "x", 2.0 * i, 2.0 * i + 2.0) for i in range(30)] + [(2, 1, 1, 0, 0, " ", 0.0, 2.0)]
GLYPH_SCHEMA = "doc_id int, page int, block_no int, line_no int, glyph_no int, c string, x0 double, x1 double"

SOURCE_SCHEMA = "chunks array<struct<chunk_id:long,document_id:long,page_from:int,page_to:int,content:string,score:double,authority_level:string,is_tabular:boolean>>"
SOURCES = [(11, 1, 3, 4, "uno", 0.91, "official_convenio", False), (12, 1, None, None, "dos", 0.95, "national_law", True), (11, 1, 3, 3, "uno otra vez", 0.5, "official_convenio", False), (14, 2, 5, 5, "cuatro", 0.4, None, False)]
ANSWERS = [
    (1, "¿q?", '```json\n{"answer": "A [Fuente 2], B [Fuente 1] .", "cited_sources": [2, 1], "confidence": 0.9}\n```', SOURCES),
    (2, "¿q?", 'Sea: {"answer": "C [Fuente 3] y [Fuente 1] y [Fuente 9] ; D [Fuente 4]", "cited_sources": [3, "1", 9, 0, "x", 3], "confidence": "0.5"} fin', SOURCES),
    (3, "¿q?", "nada", SOURCES),
    (4, "¿q?", '{"answer": "  ", "cited_sources": [], "confidence": null}', []),
    (5, "¿q?", '{"answer": "E [Fuente 1]", "cited_sources": null}', SOURCES),
]
NUMBERS = {"1.652,13": 1652.13, "1652,13": 1652.13, "1.652": 1.652, "12": 12.0, " 7,5 ": 7.5, "-3": -3.0, "€ 5": None, "": None, "abc": None, "1,2,3": None, "14d": None, "7f": None, "1,5D": None, "1e3": 1000.0, "0x10": None, "+4": 4.0, ".5": 0.5, "5.": 5.0}
YEARS = {"smi 26": 2026, "Tablas 2025": 2025, "tabla 1999-2001": 1999, "x12": None, "2.026": None, "año 25 y 26": 2025, "sin": None}
