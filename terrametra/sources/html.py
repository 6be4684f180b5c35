"""Listings and price samples out of raw HTML pages.

Price samples cut blocks with regular expressions in the JVM, walk their JSON in Python and pick on columns. Listings are
read in one Python step for each page, which cuts its blocks and cards, picks each field once and chooses the best strategy.
Patterns there are ASCII and texts of JSON values are written as Spark writes them, so both ways read a page alike.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrametra.operators.cleaning import PRICE_WINDOWS
from terrametra.session import durable

# Page patterns.
LD_JSON = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
STATE_JSON = r"(?is)<script[^>]*(?:id\s*=\s*[\"']__NEXT_DATA__[\"']|type\s*=\s*[\"']application/json[\"'])[^>]*>(.*?)</script>"
NEXT_JSON = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'
STATE_ASSIGN = r"(?is)(?:window\.__NUXT__|__INITIAL_STATE__|__APOLLO_STATE__)\s*=\s*(\{.*?\})\s*</script>"
RESULTS = r"(?s)REP_LOG_APP_PROPS\s*=\s*\{.*?\"results\".*?(\[.*)"
PRICE_MARK = r"\$\s?[\d.,]+\s*(?:MXN|USD)"
# The published pair: the size within 300 characters. Without that limit the size comes before the next price.
PRICE_PAIR = r"(?s)\$\s?([\d,]{6,12})(?:\s?MXN)?.{0,300}?(\d{2,4})\s?m"
PRICE_TO_SIZE = r"(?s)\$\s?([\d,]{6,12})(?:\s?MXN)?(?:(?!\$\s?[\d,]{6}).)*?(\d{2,4})\s?m"

# Key names of listing fields in embedded objects, compared without case.
KEYS = {
    "price": "precio|price|amount|valor|monto|list_?price|price_?value|sale_?price",
    "currency": "moneda|currency|price_?currency",
    "m2_built": "construccion|construcción|m2_?construccion|construction|constructed|built|built_?area|building_?area|construction_?(?:size|area)|covered_?area|superficie_?construida|sup_?construccion|surface_?built",
    "m2_land": "terreno|land|land_?area|lot_?size|lot_?area|superficie_?terreno|sup_?terreno|land_?size",
    "rooms": "recamaras|recámaras|habitaciones|bedrooms|rooms|dormitorios|beds",
    "baths": "banos|baños|banios|bathrooms|baths",
    "parking": "estacionamientos|parking|garages|cocheras|parking_?spaces",
    "image": "imagen|image|foto|photo|thumbnail|main_?image|cover|images|fotos|photos",
    "kind": "tipo|type|property_?type|tipo_?propiedad|category|categoria",
    "operation": "operacion|operación|operation|tipo_?operacion|transaction|listing_?type",
    "title": "titulo|título|title|name|nombre|headline",
    "location": "ubicacion|ubicación|direccion|dirección|address|location|colonia|municipio|ciudad|estado|neighborhood|full_?address",
    "url": "url|slug|link|permalink|detail_?url|canonical",
    "lat": "lat|latitude|latitud",
    "lng": "lng|lon|long|longitude|longitud",
}
LD_TYPES = "(?i)Residence|House|Apartment|RealEstate|Product|Offer|Place|Accommodation"
MIN_PRICE = 1000
# A whole run of digits, points and commas: entered once and never re-read, so long runs cost linear time.
NUMBER = r"(?i)(?<![\d.,])([\d.,]++)"
# Published limits a caller may pass; without them nothing is cut.
MAX_DEPTH = 12
CARD_GAP = 120
CARD_WINDOW = 4000

CARD_BEFORE = 1500

# Columns of every strategy, with what a strategy lacks as null.
FIELDS = {
    "id": "string", "url": "string", "title": "string", "price": "double", "currency": "string", "location": "string",
    "neighborhood": "string", "town": "string", "state": "string", "country": "string",
    "m2_built": "double", "m2_land": "double", "rooms": "double", "baths": "double", "parking": "double", "maintenance": "double",
    "kind": "string", "operation": "string", "image": "string", "affiliate": "string", "lat": "double", "lng": "double",
}
TAG = r"</?[A-Za-z][^<>]*>"
# Elements without an end tag, which open nothing.
VOID = r"(?is)^<(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b|/>$"
NO_DETAIL = r"(?i)resultados|pagina|javascript|#|facebook|twitter|whats"
DETAIL = r"(?i)/[a-z0-9-]{6,}"
IMAGE = r"""(?i)(https://[^"'\s]+\.(?:jpg|jpeg|png|webp))"""


# Block patterns by source; ``next`` is the first framework state block, the others take every match.
BLOCKS = {"ld": [LD_JSON], "state": [STATE_JSON, STATE_ASSIGN], "results": [RESULTS], "next": [NEXT_JSON]}


def _tagged(tag: Column):
    return lambda b: F.struct(tag, b.alias("block"))


def json_blocks(pages: DataFrame, page: str, html: str, sources: tuple[str, ...] = ("ld", "state", "results")) -> DataFrame:
    """``(page, source, block)``: linked data, embedded state and the results array of each page."""
    h = F.col(html)
    parts = []
    for source in sources:
        for rx in BLOCKS[source]:
            found = F.regexp_extract_all(h, F.lit(rx), F.lit(1)) if source in ("ld", "state") else F.array(F.regexp_extract(h, rx, 1))
            tag = F.lit(source).alias("source")
            parts.append(F.transform(found, _tagged(tag)))
    every = F.concat(*parts)
    return pages.select(F.col(page), F.posexplode(every).alias("block_no", "b")).select(page, "block_no", "b.source", "b.block").filter("block <> ''")


def _flat(d: dict) -> dict:
    """Scalars of an object and of its direct child objects, and the texts of lists in both."""
    flat = {}
    for k, v in d.items():
        if isinstance(v, dict):
            flat[k] = {a: _strings(b) if isinstance(b, list) else b for a, b in v.items() if not isinstance(b, dict)}
        else:
            flat[k] = _strings(v) if isinstance(v, list) else v
    return flat


def _shallow(d: dict) -> str:
    return json.dumps(_flat(d), ensure_ascii=False)


def _strings(values: list) -> list[str]:
    """Texts of a list, and the addresses of the objects in it."""
    plain = [v.get("url") or v.get("src") if isinstance(v, dict) else v for v in values]
    return [v for v in plain if isinstance(v, str)]


def _walk(node, linked: bool, max_depth: int | None = None) -> Iterator[dict]:
    """Every object in document order, on a stack, so that deep nesting is no recursion."""
    stack = [(node, 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, list):
            stack += [(x, depth + 1) for x in reversed(node)]
        elif isinstance(node, dict) and (linked or max_depth is None or depth <= max_depth):
            yield node
            if linked:
                listed = [e.get("item") or e if isinstance(e, dict) else None for e in node.get("itemListElement") or []]
                inner = [node.get("@graph"), *listed]
            else:
                inner = list(node.values())
            stack += [(x, depth + 1) for x in reversed(inner)]


# Characters and rows of objects that Python holds before they go back to Spark.
HELD_CHARS, HELD_ROWS = 1 << 20, 2_000


def json_objects(blocks: DataFrame, page: str, max_depth: int | None = None) -> DataFrame:
    """``(page, source, block_no, seq, node)`` for every JSON object of a block; malformed blocks give none.

    With ``max_depth`` (published: ``MAX_DEPTH``), objects of embedded state that lie deeper are left out.
    """
    kind = dict(blocks.dtypes)[page]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        names = [page, "source", "block_no", "seq", "node"]
        for batch in batches:
            rows, held = [], 0
            for pid, no, source, block in zip(batch[page], batch["block_no"], batch["source"], batch["block"]):
                try:
                    doc = decoder.raw_decode(block.strip())[0]
                except ValueError:
                    continue
                for i, d in enumerate(_walk(doc, source == "ld", max_depth)):
                    rows.append((pid, source, no, i, _shallow(d)))
                    held += len(rows[-1][-1])
                    if held > HELD_CHARS or len(rows) >= HELD_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return blocks.select(page, "block_no", "source", "block").mapInPandas(read, f"{page} {kind}, source string, block_no int, seq int, node string")


def pick(m: Column, names: str) -> Column:
    """First entry whose key matches, as text."""
    return F.get(F.map_values(F.map_filter(m, lambda k, v: k.rlike(f"(?i)^(?:{names})$") & v.isNotNull())), F.lit(0))


def plain(c: Column) -> Column:
    """Text without tags and repeated blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), "\\s+", " "))


def _re(pattern: str) -> re.Pattern:
    """A pattern whose classes and cases are those of ASCII, as the JVM reads it."""
    return re.compile(pattern, re.ASCII)


_END = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z"  # the JVM's $
_KEYS = {k: _re(f"(?i)(?:{v}){_END}") for k, v in KEYS.items()}
# Patterns of blocks, and signs of which a page with such a block has one in lower case.
_BLOCKS = [
    ("ld", _re(LD_JSON), ("application/ld+json",)),
    ("state", _re(STATE_JSON), ("__next_data__", "application/json")),
    ("state", _re(STATE_ASSIGN), ("window.__nuxt__", "__initial_state__", "__apollo_state__")),
]
_RESULTS, _MARK, _TAG = _re(RESULTS), _re(PRICE_MARK), _re(TAG)
_VOID = _re(r"(?i)<(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)")
_TAGS, _BLANKS, _RUN, _FIRST = _re("<[^>]+>"), _re(r"\s+"), _re("-?[0-9.]+"), _re(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
_RENT, _SALE, _LD_TYPE, _NO_DETAIL, _DETAIL = (_re(x) for x in ("(?i)renta|rent|lease", "(?i)venta|sale|sell", LD_TYPES, NO_DETAIL, DETAIL))
_KIND = _re(r"(Casa|Departamento|Terreno|Local(?:es)?|Oficinas?|Bodega|Edificio|Rancho|Inmueble)([^<>\"]{0,30}?)\s+en\s+(venta|renta)")
_HREF, _IMAGE, _HEADING = _re(r"""(?i)href\s*=\s*["']([^"']+)["']"""), _re(IMAGE), _re(r"(?i)>([^<>]{15,120})</(?:h\d|a|strong)")
_EN, _MARK_NUMBER = _re(r"en\s+(venta|renta)"), _re(r"([\d.,]+)")
_BUILT, _LAND, _ROOMS, _BATHS, _PARKING = (_re(NUMBER + x) for x in (r"\s*m²\s*(?:de\s*)?Construcci", r"\s*m²\s*(?:de\s*)?Terreno", r"\s*Rec", r"\s*Baño", r"\s*Estac"))
_UPKEEP = _re(r"(?i)\+\s*([\d.,]++)\s*mantenimiento")


def _plain(t: str | None) -> str:
    """Text without tags and repeated blanks."""
    if not t:
        return ""
    return _BLANKS.sub(" ", _TAGS.sub(" ", t) if "<" in t else t).strip(" ")


def _float_text(v: float) -> str:
    """A number as the JVM writes it, in quotes where JSON has none such."""
    if v != v or v in (float("inf"), float("-inf")):
        return f'"{json.dumps(v)}"'
    if v == 0 or 1e-3 <= abs(v) < 1e7:
        return repr(v)
    sign, digits, exponent = Decimal(repr(v)).normalize().as_tuple()
    rest = "".join(map(str, digits[1:])) or "0"
    return f"{'-' * sign}{digits[0]}.{rest}E{exponent + len(digits) - 1}"


def _text(v) -> str | None:
    """A JSON value as text: a string itself, anything else as JSON without blanks."""
    if v is None or isinstance(v, str):
        return v
    if type(v) is int:
        return str(v)
    if isinstance(v, float):
        return _float_text(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(a, ensure_ascii=False)}:{_inner(b)}" for a, b in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_inner, v)) + "]"
    return json.dumps(v)


def _inner(v) -> str:
    return json.dumps(v, ensure_ascii=False) if v is None or isinstance(v, str) else _text(v)


def _number(v) -> float | None:
    """First signed decimal of a value's text after dropping thousands commas; ``1.2.3`` reads as 1.2."""
    if v is None:
        return None
    if type(v) is int or type(v) is str and v.isascii() and v.isdigit():
        return float(v)
    run = _RUN.search((v if type(v) is str else _text(v)).replace(",", ""))
    first = run and _FIRST.match(run[0])
    return float(first[0]) if first else None


def _operation(t: str | None) -> str | None:
    if t is None:
        return None
    return "renta" if _RENT.search(t) else "venta" if _SALE.search(t) else None


def _parsed(t: str):
    """The JSON in a text, or None."""
    try:
        return json.loads(t)
    except ValueError:
        return None


def _texts(v) -> str:
    """A text value, or the text values of a child object joined by commas."""
    t = _text(v)
    if t is None or not t.startswith("{"):
        return t
    child = v if isinstance(v, dict) else _parsed(t)
    found = map(_text, child.values()) if isinstance(child, dict) else []
    return ", ".join(x for x in found if x is not None and not x.startswith("["))


def _first(v) -> str | None:
    """A text, or the first text of a list; an object is none."""
    t = _text(v)
    if t is None or t.startswith("{"):
        return None
    if not t.startswith("["):
        return t
    values = v if isinstance(v, list) else _parsed(t)
    return _text(values[0]) if isinstance(values, list) and values else None


# Fields by key, remembered: the keys of one site repeat in all its pages.
_FIELDS_OF: dict[str, list[str]] = {}
REMEMBERED_KEYS = 10_000


def _fields_of(key: str) -> list[str]:
    names = _FIELDS_OF.get(key)
    if names is None:
        names = [k for k, rx in _KEYS.items() if rx.match(key)]
        if len(_FIELDS_OF) < REMEMBERED_KEYS:
            _FIELDS_OF[key] = names
    return names


def _state(d: dict) -> dict | None:
    """An embedded object that looks like a listing: a price of at least 1000 and a place or a title."""
    got = {}
    for k, v in d.items():
        if v is not None:
            for name in _fields_of(k):
                got.setdefault(name, v)
    price = _number(_flat({"p": got["price"]})["p"]) if "price" in got else None
    if price is None or price < MIN_PRICE or not ("location" in got or "title" in got):
        return None
    got = _flat(got)
    g = got.get
    kind = _plain(_text(g("kind")))
    return {
        "url": _text(g("url")),
        "title": _plain(_text(g("title"))),
        "price": price,
        "currency": _plain(_text(g("currency"))) or "MXN",
        "location": _plain(_texts(g("location"))),
        **{k: _number(g(k)) for k in ("m2_built", "m2_land", "rooms", "baths", "parking", "lat", "lng")},
        "kind": kind or None,
        "operation": _operation(_plain(_text(g("operation"))) or kind),
        "image": _first(g("image")),
    }


def _listing_key(f: dict) -> str:
    """What two embedded objects of one listing share: the address, else title, price and place."""
    return f["url"] if f["url"] is not None else "|".join((f["title"], _float_text(f["price"]), f["location"]))


def _reader(d: dict):
    """``j(a)`` and ``j(a, b)``: the text of an object's value, and of its child object's, as ``_flat`` has them."""

    def j(a: str, b: str | None = None) -> str | None:
        v = d.get(a)
        if b is not None:
            v = v.get(b) if type(v) is dict else None
            if type(v) is dict:
                return None
        if v is None or type(v) is str:
            return v
        if type(v) is list:
            v = _strings(v)
        elif type(v) is dict:
            v = _flat({a: v})[a]
        return _text(v)

    return j


def _either(*values):
    return next((v for v in values if v is not None), None)


def _linked(d: dict) -> dict | None:
    """A schema.org object of a property or offer type with a price."""
    j = _reader(d)
    price = _number(_either(j("offers", "price"), j("price")))
    if not price or not _LD_TYPE.search(j("@type") or ""):
        return None
    object_or_none = lambda a: (t := j(a)) is None or t.startswith("{")
    address = ", ".join(x for x in (j("address", k) for k in ("streetAddress", "addressLocality", "addressRegion")) if x is not None)
    size = _either(j("floorSize", "value"), None if object_or_none("floorSize") else j("floorSize"))
    return {
        "url": _either(j("url"), j("@id")),
        "title": _plain(j("name")),
        "price": price,
        "currency": _either(j("offers", "priceCurrency"), "MXN"),
        "location": _plain(address if object_or_none("address") else j("address")),
        "town": j("address", "addressLocality"),
        "state": j("address", "addressRegion"),
        "country": j("address", "addressCountry"),
        "m2_built": _number(size),
        "rooms": _number(_either(j("numberOfRooms"), j("numberOfBedrooms"))),
        "baths": _number(j("numberOfBathroomsTotal")),
        "kind": _plain(_either(j("additionalType"), j("@type"))),
        "image": _first(_flat({"image": d.get("image")})["image"]),
        "lat": _number(j("geo", "latitude")),
        "lng": _number(j("geo", "longitude")),
    }


def _result(d: dict) -> dict | None:
    """A row of the embedded results array."""
    j = _reader(d)
    price = _number(j("precio"))
    if price is None or price < MIN_PRICE:
        return None
    trimmed = lambda a: (j(a) or "").strip(" ") or None
    n = lambda *names: _number(_either(*map(j, names)))
    thumbs = d["fotos"].get("propiedadThumbnail") if isinstance(d.get("fotos"), dict) else None
    thumbs = _strings(thumbs) if isinstance(thumbs, list) else None
    photo = _either(thumbs[0] if thumbs else None, j("foto"))
    return {
        "id": _either(j("idPropiedadesDB"), j("id")),
        "url": j("urlCorrectaPropiedad"),
        "title": _plain(j("encabezado")),
        "price": price,
        "currency": _either(j("moneda"), "MXN"),
        "location": ", ".join(filter(None, map(trimmed, ("calle", "colonia", "municipio", "estado", "pais")))) or None,
        **{k: trimmed(v) for k, v in {"neighborhood": "colonia", "town": "municipio", "state": "estado", "country": "pais"}.items()},
        "m2_built": n("m2C"),
        "m2_land": n("m2T"),
        "rooms": n("recamaras"),
        "baths": n("banos"),
        "parking": n("estacionamientos"),
        "kind": _plain(_either(j("tipoPropiedadTrans"), j("tipoPropiedad"))) or None,
        "operation": _operation(_either(j("tipoOperacion"), j("tipoOperacionTrans"))),
        "image": None if photo is None or photo.startswith(("{", "[")) else photo,
        "affiliate": _plain(j("nombreAfiliado")) or None,
        "lat": n("lat"),
        "lng": n("lon", "lng"),
    }


def _blocks(html: str) -> Iterator[tuple[str, int, str]]:
    """``(source, block_no, block)`` of a page, numbered as ``json_blocks`` has them."""
    no, low = 0, html.lower()
    for source, rx, signs in _BLOCKS:
        if any(x in low for x in signs):
            for block in rx.findall(html):
                yield source, no, block
                no += 1
    found = _RESULTS.search(html) if "REP_LOG_APP_PROPS" in html else None
    if found:
        yield "results", no, found[1]


def _json_listings(html: str, max_depth: int | None) -> Iterator[tuple[str, int, int, dict]]:
    """``(strategy, block_no, seq, fields)`` of the listings in a page's JSON, in order; malformed blocks give none."""
    odd = []  # NaN and the infinities, which are no JSON
    decoder = json.JSONDecoder(parse_constant=lambda c: odd.append(c) or float(c))
    read = {"ld": _linked, "state": _state, "results": _result}
    for source, no, block in _blocks(html):
        odd.clear()
        try:
            doc = decoder.raw_decode(block.strip())[0]
        except ValueError:
            continue
        for i, d in enumerate(_walk(doc, source == "ld", max_depth)):
            if odd and source != "state" and not _strict(_flat(d)):
                continue
            fields = read[source](d)
            if fields is not None:
                yield source, no, i, fields


def _strict(flat: dict) -> bool:
    """Whether an object has only numbers that JSON has."""
    try:
        json.dumps(flat, allow_nan=False)
    except ValueError:
        return False
    return True


def _wordy(t: str, i: int) -> bool:
    """Whether the sign at ``i`` belongs to a word, in the JVM's sense."""
    return 0 <= i < len(t) and (t[i] == "_" or t[i].isalpha() or t[i].isdecimal() or unicodedata.category(t[i]) == "Mn")


def _move(tag: str) -> int:
    """By how much a tag changes the depth."""
    if tag.startswith("</"):
        return -1
    void = _VOID.match(tag)
    return 0 if tag.endswith("/>") or (void and not _wordy(tag, void.end())) else 1


def _border(between: str, last: int | None = None) -> tuple[int, int]:
    """Where the text between two price marks leaves the first one's card: ``at`` (characters) and ``low``.

    One pass over the tags counts how deep the text is below the first mark; ``low`` is the least depth. The next card
    begins at the last element that opens at that depth, so what a card's own elements hold stays in it. Text whose depth
    ends at the least one belongs to the first card as a whole. With ``last`` the text ends where the depth falls below
    it, which is the end of the element around all cards.
    """
    depth = low = at = 0
    over = None
    for m in _TAG.finditer(between):
        move = _move(m[0])
        if move == 1 and depth == low:
            at = m.start()
        depth += move
        if depth < low:
            at, low = m.end(), depth
        if last is not None and over is None and depth < last:
            over = m.start()
    if last is not None:
        return len(between) if over is None else over, low
    return len(between) if depth == low else at, low


def _cards(html: str, card_gap: int | None, card_window: int | None, card_before: int | None) -> list[tuple[str, str, str]]:
    """``(mark, w, before)`` of a page's cards, see ``cards``."""
    marks = list(_MARK.finditer(html)) if "$" in html else []
    if not marks:
        return []
    ends = [m.start() for m in marks[1:]] + [len(html)]
    head, pieces, last = html[: marks[0].start()], [], None
    for m, end in zip(marks, ends):
        if card_gap is not None and last is not None and m.start() - last < card_gap:
            pieces[-1][1].append(html[m.start() : end])
        else:
            pieces.append((m[0], [html[m.end() : end]]))
            last = m.start()
    pieces = [(mark, "".join(parts)) for mark, parts in pieces]
    # borders of all cards but the last, which ends below the least depth of the border before it
    borders = [_border(g) for _, g in pieces[:-1]]
    tail = pieces[-1][1]
    borders.append(_border(tail, borders[-1][1]) if borders else (len(tail), 0))
    out, before = [], head
    for (mark, g), (at, _) in zip(pieces, borders):
        w = mark + g[:at]
        front = before if card_before is None else before[max(0, len(before) - card_before) :]
        out.append((mark, w if card_window is None else w[: max(0, card_window)], front))
        before = g[at:]
    return out


def _card(mark: str, w: str, before: str) -> dict:
    """Listing fields of one card."""

    def g(rx: re.Pattern) -> str | None:
        found = rx.search(w)
        return (found[1] or None) if found else None

    def word(rx: re.Pattern, front: bool = False) -> str | None:
        """As ``g``, for a pattern that ends (and with ``front`` begins) at the border of a word."""
        for m in rx.finditer(w):
            if not _wordy(w, m.end()) and not (front and _wordy(w, m.start() - 1)):
                return m[1]
        return None

    def place(part: str) -> str | None:
        for piece in _TAGS.split(part):
            t = _BLANKS.sub(" ", piece).strip(" ")
            if 9 <= len(t) <= 169 and t.count(",") >= 2 and "$" not in t:
                return t
        return None

    def detail(part: str) -> str | None:
        found = [a for a in _HREF.findall(part) if not _NO_DETAIL.search(a) and _DETAIL.search(a)]
        return found[-1] if found else None

    low = w.lower()
    said = _KIND.search(w) or _KIND.search(before)  # a card's heading may stand before its price
    kind = said[1] + said[2] if said else ""
    operation = said[3] if said else word(_EN, front=True)
    return {
        "url": _either(detail(before), detail(w)),
        "title": _plain(_either(g(_HEADING), kind)),
        "price": _number(_MARK_NUMBER.search(mark)[1]),
        "currency": mark[-3:],
        "location": _either(place(w), place(before)),
        "m2_built": _number(g(_BUILT)) if "construcci" in low else None,
        "m2_land": _number(g(_LAND)) if "terreno" in low else None,
        "rooms": _number(word(_ROOMS)) if "rec" in low else None,
        "baths": _number(g(_BATHS)) if "ba" in low else None,
        "parking": _number(g(_PARKING)) if "estac" in low else None,
        "maintenance": _number(g(_UPKEEP)) if "mantenimiento" in low else None,
        "kind": _plain(kind) or None,
        "operation": operation,
        "image": g(_IMAGE) if "https://" in low else None,
    }


def cards(pages: DataFrame, page: str, html: str, card_gap: int | None = None, card_window: int | None = None, card_before: int | None = None) -> DataFrame:
    """``(page, seq, mark, w, before)`` per card: its price mark, its text from the mark on, and its text before the mark.

    A card ends where the next one begins (``_border``), the last one with the element around the cards, so no text is in
    two cards and the work grows with the page's length. With ``card_gap``, marks closer than so many characters to the
    last used one belong to the same card; ``card_window`` and ``card_before`` cut a card's texts.
    """

    def read(text: str):
        for i, card in enumerate(_cards(text, card_gap, card_window, card_before)):
            yield (i, *card)

    return _rows(pages, page, html, read, {"seq": "int", "mark": "string", "w": "string", "before": "string"})


def window_listings(pages: DataFrame, page: str, html: str, card_gap: int | None = None, card_window: int | None = None, card_before: int | None = None) -> DataFrame:
    """One listing per card (see ``cards``), with the attributes found in the card's own texts."""

    def read(text: str):
        for i, card in enumerate(_cards(text, card_gap, card_window, card_before)):
            f = _card(*card)
            yield (0, i, *map(f.get, FIELDS), "window")

    return _rows(pages, page, html, read, {"block_no": "int", "seq": "int", **FIELDS, "strategy": "string"})


def _rows(pages: DataFrame, page: str, html: str, read, kinds: dict[str, str]) -> DataFrame:
    """The rows that ``read`` gives for each page's text, with the page; they go back to Spark in small pieces."""
    arrow = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    types = [arrow[t] for t in kinds.values()]
    names = [page, *kinds]

    def run(batches):
        for batch in batches:
            ids, at, rows, held = batch[page], [], [], 0

            def piece():
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *columns], names=names)

            for i, text in enumerate(batch[html]):
                for row in read(text.as_py()) if text.is_valid else ():
                    at.append(i)
                    rows.append(row)
                    held += sum(len(v) for v in row if isinstance(v, str))
                    if held > HELD_CHARS or len(rows) >= HELD_ROWS:
                        yield piece()
                        at, rows, held = [], [], 0
            if rows:
                yield piece()

    schema = ", ".join([f"`{page}` {dict(pages.dtypes)[page]}", *[f"{k} {t}" for k, t in kinds.items()]])
    return pages.select(page, html).mapInArrow(run, schema)


# Order of preference when strategies find equally many rows.
PREFERENCE = {"results": 0, "state": 1, "ld": 2, "window": 3}


def extract_listings(
    pages: DataFrame,
    page: str = "page_id",
    html: str = "html",
    max_depth: int | None = None,
    card_gap: int | None = None,
    card_window: int | None = None,
    card_before: int | None = None,
    base: str = "",
) -> DataFrame:
    """Listings of each page by its best strategy: the results array when present, else the one with most rows.

    By default nothing is cut; ``MAX_DEPTH``, ``CARD_GAP``, ``CARD_WINDOW`` and ``CARD_BEFORE`` are the published limits.
    With ``base``, the site's address, relative addresses of listings become whole ones. A page of one row is read and
    decided in one step; the rows of a page that has several are counted together.
    """

    def found(text: str) -> dict[str, list]:
        by, seen = {}, set()
        for strategy, no, i, f in _json_listings(text, max_depth):
            if strategy == "state":
                key = _listing_key(f)
                if key in seen:
                    continue
                seen.add(key)
            by.setdefault(strategy, []).append((no, i, *map(f.get, FIELDS), strategy))
        for i, card in enumerate(_cards(text, card_gap, card_window, card_before)):
            f = _card(*card)
            by.setdefault("window", []).append((0, i, *map(f.get, FIELDS), "window"))
        return by

    def every(text: str):
        return (row for rows in found(text).values() for row in rows)

    def best(text: str):
        by = found(text)
        return min(by.values(), key=lambda rows: _rank(rows[0][-1], len(rows))) if by else []

    kinds = {"block_no": "int", "seq": "int", **FIELDS, "strategy": "string"}
    pages = pages.select(page, html).filter(F.col(page).isNotNull())
    several = durable(pages.groupBy(page).count().filter("count > 1").select(page))
    if several.isEmpty():
        out = _rows(pages, page, html, best, kinds)
    else:
        once = _rows(pages.join(several, page, "left_anti"), page, html, best, kinds)
        out = once.unionByName(_counted(_rows(pages.join(several, page, "left_semi"), page, html, every, kinds), page))
    if base:
        path = F.concat(F.lit(f"{base.rstrip('/')}/"), F.regexp_replace("url", "^/+", ""))
        out = out.withColumn("url", F.when(F.col("url").rlike("(?i)^https?:"), F.col("url")).otherwise(path))
    return out.filter(F.col("price") >= MIN_PRICE).select(page, "strategy", "block_no", "seq", *FIELDS)


def _rank(strategy: str, n: int) -> tuple:
    return (strategy != "results", -n, PREFERENCE[strategy])


def _counted(every: DataFrame, page: str) -> DataFrame:
    """Of the rows of all strategies those of each page's best one; embedded objects of one listing are one row."""
    key = F.coalesce("url", F.concat_ws("|", "title", F.col("price").cast("string"), "location"))
    every = durable(every)
    state = every.filter("strategy = 'state'")
    one = state.groupBy(page, key.alias("_k")).agg(F.min_by(F.struct(*[c for c in every.columns if c != page]), F.struct("block_no", "seq")).alias("r"))
    every = durable(every.filter("strategy <> 'state'").unionByName(one.select(page, "r.*")))
    order = F.create_map(*[F.lit(x) for kv in PREFERENCE.items() for x in kv])[F.col("strategy")]
    counts = every.groupBy(page, "strategy").agg(F.count("*").alias("n"))
    best = counts.groupBy(page).agg(
        F.min_by("strategy", F.struct(F.when(F.col("strategy") == "results", 0).otherwise(1), -F.col("n"), order)).alias("strategy")
    )
    return every.join(best, [page, "strategy"], "left_semi").select(every.columns)


def price_samples(
    pages: DataFrame, page: str = "page_id", html: str = "html", max_depth: int | None = None, pair: str = PRICE_TO_SIZE
) -> DataFrame:
    """Prices per m2 of each page ``(page, strategy, price, m2, pm2)``: embedded state, else linked data, else text pairs.

    ``MAX_DEPTH`` and ``PRICE_PAIR`` give the published limits.
    """
    lo, hi = PRICE_WINDOWS["sample"]
    objects = json_objects(json_blocks(pages, page, html, ("ld", "next")), page, max_depth)
    j = lambda p: F.get_json_object("node", p)
    state = (
        objects.filter("source = 'next'")
        .select(page, j("$.price").try_cast("double").alias("price"), j("$.surface").try_cast("double").alias("m2"), F.lit("state").alias("strategy"))
        .filter(F.col("m2") >= 15)
        .distinct()
    )
    ld = objects.filter("source = 'ld'").select(
        page,
        F.regexp_replace(j("$.offers.price"), ",", "").try_cast("double").alias("price"),
        F.regexp_replace(j("$.floorSize.value"), "[^0-9.]", "").try_cast("double").alias("m2"),
        F.lit("ld").alias("strategy"),
    ).filter(F.col("m2") > 15)
    every = state.unionByName(ld).unionByName(price_pairs(pages, page, html, pair).filter(F.col("m2") > 15).withColumn("strategy", F.lit("text")))
    ok = durable(every.withColumn("pm2", F.try_divide("price", "m2")).filter((F.col("pm2") > lo) & (F.col("pm2") < hi)))
    rank = F.create_map(F.lit("state"), F.lit(0), F.lit("ld"), F.lit(1), F.lit("text"), F.lit(2))[F.col("strategy")]
    best = ok.groupBy(page).agg(F.min(rank).alias("_b"))
    return ok.withColumn("_b", rank).join(best, [page, "_b"], "left_semi").drop("_b")


def price_pairs(pages: DataFrame, page: str = "page_id", html: str = "html", pair: str = PRICE_TO_SIZE) -> DataFrame:
    """``$price ... size m`` pairs in document order over the whole page; ``PRICE_PAIR`` is the published pattern."""
    h = F.col(html)
    pairs = F.arrays_zip(
        F.regexp_extract_all(h, F.lit(pair), F.lit(1)).alias("p"), F.regexp_extract_all(h, F.lit(pair), F.lit(2)).alias("m")
    )
    rows = pages.select(F.col(page), F.explode(pairs).alias("x"))
    return rows.select(page, F.regexp_replace(F.col("x")["p"], ",", "").try_cast("double").alias("price"), F.col("x")["m"].try_cast("double").alias("m2"))


def sample_medians(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Median price per m2 and sample count, the rows of the price history."""
    from terrametra.operators.ranking import exact_median

    med = exact_median(samples, keys, "pm2", "median_pm2")
    return samples.groupBy(*keys).agg(F.count("*").alias("samples")).join(med, keys)
