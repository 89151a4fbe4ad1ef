"""Schematic and board files as entity rows (SRC-1, SRC-2, SRC-4) and the tables made of them (SCH-1 to SCH-15).

A file becomes rows (schematic_id, entity, ordinal, payload), payload being JSON of the item's fields. A file
whose root is not the expected one, or that is not well-formed, is one row of entity ``reject``. The
tables are projections of those rows with explicit schemas.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ohmlake.functions.columns import keep_first, ordered, top_n_per
from ohmlake.sources.scan import COLUMNS, KINDS, Scan, plain

SCHEMATIC_ROOT, BOARD_ROOT = "kicad_sch", "kicad_pcb"
EXTENSIONS = {".kicad_sch": "schematic", ".kicad_pcb": "board", ".kicad_pro": "project"}
PARSER_VERSION = "1.0.0"
#: Fixed value: characters of JSON that a task hands on at once.
PIECE = 1 << 22
#: Fixed value: bytes of files that are scanned at once; whole files, so one at least.
SCANNED = 1 << 21

_TOKEN = re.compile(r'[()]|"(?:\\.|[^"\\])*"|[^\s()"]+')


def _nested(text: str) -> list:
    """The nested list of a file; quoted strings keep their escapes."""
    out: list = []
    stack, own = [], out
    for t in _TOKEN.findall(text):
        if t == "(":
            stack.append(own)
            own.append(own := [])
        elif t == ")":
            if not stack:
                raise ValueError("a closing bracket too many")
            own = stack.pop()
        else:
            own.append(t[1:-1] if t[0] == '"' else t)
    if stack or not out or not isinstance(out[0], list):
        raise ValueError("brackets left open, or no list")
    return out[0]


def _lists(item: list, name: str | None = None, start: int = 1) -> list[list]:
    return [x for x in item[start:] if isinstance(x, list) and x and (name is None or x[0] == name)]


def _at(item: list, start: int = 1) -> dict:
    """Place and turn of the last (at x y [r]) of an item; zeros without one."""
    x = y = r = 0.0
    for a in _lists(item, "at", start):
        x, y = float(a[1]), float(a[2])
        r = float(a[3]) if len(a) > 3 else r
    return {"x": x, "y": y, "rotation": r}


def _text(item: list, i: int) -> str:
    return item[i] if len(item) > i and isinstance(item[i], str) else ""


def _effects(item: list) -> str:
    return json.dumps({e[0]: (e[1:] if len(e) > 2 else e[1] if len(e) > 1 else None) for f in _lists(item, "effects") for e in _lists(f)})


def _property(item: list) -> dict:
    return {"name": _text(item, 1), "value": _text(item, 2), "effects": _effects(item)} | _at(item, 3)


def _last(item: list, name: str, start: int) -> str:
    found = _lists(item, name, start)
    return _text(found[-1], 1) if found else ""


def _number(text: str) -> float:
    return float(text) if text else 0.0


def _library_pin(item: list) -> dict:
    a = _at(item, 3)
    return {"type": _text(item, 1), "shape": _text(item, 2), "number": _last(item, "number", 3), "name": _last(item, "name", 3), "length": _number(_last(item, "length", 3)), "x": a["x"], "y": a["y"], "orientation": a["rotation"]}


def _instance_pin(item: list) -> dict | None:
    """Fields stand from the fourth place on; instances mostly have none, so their pins are blank at the origin."""
    if len(item) < 3:
        return None
    a = _at(item, 3)
    return {"type": _text(item, 1), "number": _last(item, "number", 3), "name": _last(item, "name", 3), "length": _number(_last(item, "length", 3)), "x": a["x"], "y": a["y"]}


def _symbol(item: list) -> dict:
    lib = item[1] if len(item) > 1 else ""
    return {"library_id": lib if isinstance(lib, str) else _text(lib, 1), "properties": [_property(p) for p in _lists(item, "property", 2) if len(p) >= 3], "pins": [p for p in map(_instance_pin, _lists(item, "pin", 2)) if p], "unit": _last(item, "unit", 1), "uuid": _last(item, "uuid", 1)} | _at(item, 2)


def _library_symbol(item: list) -> dict:
    return {"id": _text(item, 1), "pins": [_library_pin(p) for p in _lists(item, "pin", 2) if len(p) >= 4], "properties": [_property(p) for p in _lists(item, "property", 2) if len(p) >= 3], "graphics": [x[0] for x in _lists(item, None, 2) if x[0] in ("symbol", "polyline", "rectangle", "circle", "arc")]}


def _points(item: list) -> list[tuple[float, float]]:
    return [(float(p[1]), float(p[2])) for pts in _lists(item, "pts") for p in _lists(pts, "xy")]


def _wire(item: list) -> dict:
    pts = _points(item)
    (x1, y1), (x2, y2) = pts[:2] if len(pts) >= 2 else ((0.0, 0.0), (0.0, 0.0))
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2}


def schematic_items(text: str) -> list[tuple[str, dict]]:
    """(entity, fields) of the items of a schematic file in order."""
    data = _nested(text)
    if not data or data[0] != SCHEMATIC_ROOT:
        raise ValueError("not a schematic")
    return [row for item in _lists(data) for row in _schematic_rows(item)]


def _schematic_rows(item: list) -> list[tuple[str, dict]]:
    """The rows of one item of a schematic file."""
    kind = item[0]
    if kind in ("version", "generator", "generator_version", "uuid", "paper"):
        return [("meta", {"key": kind, "value": _text(item, 1)})]
    if kind == "title_block":
        return [("title", {"key": x[0], "value": _text(x, 1)}) for x in _lists(item) if len(x) >= 2]
    if kind == "lib_symbols":
        return [("library_symbol", _library_symbol(x)) for x in _lists(item, "symbol") if len(x) >= 2]
    if kind in ("wire", "bus"):
        return [(kind, _wire(item))]
    if kind in ("junction", "no_connect", "bus_entry"):
        return [(kind, _at(item))]
    if kind in ("label", "hierarchical_label", "global_label"):
        return [("label" if kind != "global_label" else kind, {"text": _text(item, 1), "type": kind} | _at(item, 2))]
    if kind == "symbol" and len(item) >= 3:
        return [("symbol", _symbol(item))]
    if kind == "text":
        return [("text", {"text": _text(item, 1), "effects": _effects(item)} | _at(item, 2))]
    if kind == "sheet":
        props = {p["name"]: p["value"] for p in (_property(x) for x in _lists(item, "property") if len(x) >= 3)}
        return [("sheet", {"uuid": _last(item, "uuid", 1), "sheetfile": props.get("Sheetfile", props.get("Sheet file", "")), "sheetname": props.get("Sheetname", props.get("Sheet name", ""))})]
    return []


def board_items(text: str) -> list[tuple[str, dict]]:
    """(entity, fields) of the items of a board file in order: nets, segments, vias, zones, footprints, pads, drawings."""
    data = _nested(text)
    if not data or data[0] != BOARD_ROOT:
        raise ValueError("not a board")
    out: list[tuple[str, dict]] = []
    xy = lambda item, name: next(((float(p[1]), float(p[2])) for p in _lists(item, name)), (0.0, 0.0))
    net = lambda item: int(_last(item, "net", 1) or -1)
    for item in _lists(data):
        kind = item[0]
        if kind in ("version", "generator", "paper"):
            out.append(("meta", {"key": kind, "value": _text(item, 1)}))
        elif kind == "layers":
            out += [("layer", {"number": x[0], "name": _text(x, 1)}) for x in _lists(item)]
        elif kind == "net":
            out.append(("net", {"net": int(_text(item, 1) or 0), "name": _text(item, 2)}))
        elif kind in ("segment", "arc"):
            (x1, y1), (x2, y2) = xy(item, "start"), xy(item, "end")
            out.append((kind, {"net": net(item), "layer": _last(item, "layer", 1), "x1": x1, "y1": y1, "x2": x2, "y2": y2}))
        elif kind == "via":
            a = _at(item)
            out.append(("via", {"net": net(item), "x1": a["x"], "y1": a["y"], "x2": a["x"], "y2": a["y"]}))
        elif kind == "zone":
            out.append(("zone", {"net": net(item), "layer": _last(item, "layer", 1)}))
        elif kind in ("footprint", "module"):
            a = _at(item)
            named = {p["name"]: p["value"] for p in (_property(x) for x in _lists(item, "property") if len(x) >= 3)} | {_text(t, 1): _text(t, 2) for t in _lists(item, "fp_text")}
            ref, value = named.get("Reference", named.get("reference", "")), named.get("Value", named.get("value", ""))
            own = {"library": _text(item, 1), "layer": _last(item, "layer", 1), "uuid": _last(item, "uuid", 1) or _last(item, "tstamp", 1), "reference": ref, "value": value, "tags": _last(item, "attr", 1)} | a
            out.append(("footprint", own))
            for p in _lists(item, "pad"):
                b = _at(p)
                out.append(("pad", {"net": net(p), "number": _text(p, 1), "kind": _text(p, 2), "reference": ref, "x1": a["x"] + b["x"], "y1": a["y"] + b["y"], "x2": a["x"] + b["x"], "y2": a["y"] + b["y"]}))
            for d in _lists(item):
                if d[0] in ("fp_line", "fp_rect", "fp_circle", "fp_arc"):
                    (x1, y1), (x2, y2) = xy(d, "start"), xy(d, "end")
                    out.append(("footprint_drawing", {"reference": ref, "layer": _last(d, "layer", 1), "x1": x1, "y1": y1, "x2": x2, "y2": y2}))
        elif kind.startswith("gr_"):
            (x1, y1), (x2, y2) = xy(item, "start"), xy(item, "end")
            out.append(("drawing", {"kind": kind, "layer": _last(item, "layer", 1), "x1": x1, "y1": y1, "x2": x2, "y2": y2}))
    return out


_ROWS = pa.schema([("entity", pa.string()), ("ordinal", pa.int64()), ("payload", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch], reader: Callable[[str], list[tuple[str, dict]]]) -> Iterator[pa.RecordBatch]:
    """Rows of the files of batches (schematic_id, content), in batches of about PIECE characters."""
    for batch in batches:
        ids, texts = batch.columns
        at, rows, size = [], [], 0
        for n, text in enumerate(texts):
            try:
                found = reader(text.as_py() or "")
            except (ValueError, IndexError) as e:
                found = [("reject", {"error": str(e)})]
            for i, (entity, fields) in enumerate(found):
                rows.append((entity, i, json.dumps(fields)))
                at.append(n)
                size += len(rows[-1][2])
                if size >= PIECE:
                    yield _batch(ids, at, rows)
                    at, rows, size = [], [], 0
        if rows:
            yield _batch(ids, at, rows)


def _batch(ids: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ROWS)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *columns], ["schematic_id", *_ROWS.names])


def items(files: DataFrame, kind: str = "schematic") -> DataFrame:
    """SRC-1, SRC-2: (schematic_id, entity, ordinal, payload) of files (schematic_id, content string).

    A task holds one file's items and hands on its rows in pieces of about PIECE characters, however many files come at once.
    """
    reader = {"schematic": schematic_items, "board": board_items}[kind]
    return files.select("schematic_id", "content").mapInArrow(lambda batches: _pieces(batches, reader), f"schematic_id {_id_kind(files)}, entity string, ordinal long, payload string")


def _id_kind(files: DataFrame) -> str:
    return files.schema["schematic_id"].dataType.simpleString()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of about SCANNED bytes of whole files; a missing text is an empty one."""
    for batch in batches:
        ids, texts = batch.columns
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SCANNED, "right")))
            yield ids.slice(at, to - at), pc.fill_null(texts.slice(at, to - at), "")
            at = to


def _read(text: str) -> list[tuple[str, dict]]:
    """Items of a schematic file that is read token by token."""
    try:
        return schematic_items(text)
    except (ValueError, IndexError) as e:
        return [("reject", {"error": str(e)})]


def _json_effects(text: str) -> str:
    return _effects(["", _nested(text)])


def _rows_of(batches: Iterator[pa.RecordBatch], entities: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of some entities of the files of batches; other items of plain files are found, not read."""

    def made(scan: Scan, own: np.ndarray) -> Iterator[tuple[int, str, int, dict]]:
        for e in entities:
            found = scan.rows(e) if e != "reject" else []
            for file, ordinal, text in zip(own[scan.file[found]], scan.ordinal[found], scan.slices(found)) if len(found) else ():
                yield from ((file, e, int(ordinal) + i, fields) for i, (_, fields) in enumerate(_schematic_rows(_nested(text))))

    for ids, texts in _chunks(batches):
        found, odd = plain(texts, _json_effects, made)
        slow = ((n, e, i, fields) for n in odd for i, (e, fields) in enumerate(_read(texts[n].as_py())) if e in entities)
        at, rows, size = [], [], 0
        for n, e, i, fields in chain(found or (), slow):
            at.append(n)
            rows.append((e, i, json.dumps(fields)))
            size += len(rows[-1][2])
            if size >= PIECE:
                yield _batch(ids, at, rows)
                at, rows, size = [], [], 0
        if rows:
            yield _batch(ids, at, rows)


def some_items(files: DataFrame, entities: list[str]) -> DataFrame:
    """SRC-1 for some entities (``reject`` among them): their rows as ``items`` gives them, without making those of the others."""
    return files.select("schematic_id", "content").mapInArrow(lambda batches: _rows_of(batches, entities), f"schematic_id {_id_kind(files)}, entity string, ordinal long, payload string")


def _names_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = list(KINDS.values())

    def made(scan: Scan, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        some = np.flatnonzero(scan.count)
        count = scan.count[some]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        entity = pa.DictionaryArray.from_arrays(pa.array(np.repeat(scan.kinds[some], count), pa.int32()), kinds)
        return np.repeat(own[scan.file[some]], count), np.repeat(scan.ordinal[some], count) + step, entity.cast(pa.string())

    for ids, texts in _chunks(batches):
        found, odd = plain(texts, _json_effects, made)
        slow = [(n, i, e) for n in odd for i, (e, _) in enumerate(_read(texts[n].as_py()))]
        for file, ordinal, entity in [found] * (found is not None) + [tuple(zip(*slow))] * bool(slow):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(file)), pa.array(entity, pa.string()), pa.array(ordinal, pa.int64())], ["schematic_id", "entity", "ordinal"])


def item_names(files: DataFrame) -> DataFrame:
    """SRC-1 without fields: (schematic_id, entity, ordinal)."""
    return files.select("schematic_id", "content").mapInArrow(_names_of, f"schematic_id {_id_kind(files)}, entity string, ordinal long")


def _columns_of(batches: Iterator[pa.RecordBatch], name: str, kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows of one entity as columns."""
    fields = list(kinds)

    def made(scan: Scan, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        found = scan.rows(name)
        return own[scan.file[found]], scan.ordinal[found], COLUMNS[name](scan, found, fields)

    for ids, texts in _chunks(batches):
        found, odd = plain(texts, _json_effects, made)
        slow = [(n, i, _with_values(f) if name == "symbol" else f) for n in odd for i, (e, f) in enumerate(_read(texts[n].as_py())) if e == name]
        read = ([n for n, _, _ in slow], [i for _, i, _ in slow], {c: [f.get(c) for _, _, f in slow] for c in fields})
        for file, ordinal, columns in [found] * (found is not None) + [read] * bool(slow):
            made_of = [pa.array(columns[c], k) if isinstance(columns[c], (list, np.ndarray)) else columns[c].cast(k) for c, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(file, pa.int64())), pa.array(ordinal, pa.int64()), *made_of], ["schematic_id", "ordinal", *fields])


def _with_values(fields: dict) -> dict:
    """Fields of a symbol with the last Reference, Value and Footprint among its properties."""
    values = {p["name"]: p["value"] for p in fields["properties"]}
    return fields | {c: values.get(c.title(), "") for c in NAMED}


#: Columns of symbols that are properties of theirs.
NAMED = ["reference", "value", "footprint"]


def table(files: DataFrame, name: str, *fields: str) -> DataFrame:
    """SCH-5, SCH-6, SCH-7, SCH-8: rows of one entity as a table, made straight from files (schematic_id, content string) without JSON.

    (schematic_id, ordinal, fields), as ``entity`` gives them of ``items``; all fields if none are named. Symbols have reference, value and
    footprint too. Plain files are scanned by many at once, the others are read token by token.
    """
    kinds = StructType.fromDDL(_FIELDS[name] + (", " + ", ".join(f"{c} string" for c in NAMED) if name == "symbol" else ""))
    some = [kinds[c] for c in fields] or list(kinds)
    arrow = {f.name: to_arrow_type(f.dataType) for f in some}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some)
    return files.select("schematic_id", "content").mapInArrow(lambda batches: _columns_of(batches, name, arrow), f"schematic_id {_id_kind(files)}, ordinal long, {schema}")


def design_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: (schematic_id, kind, content) of the files under a path; kind is null for other extensions."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lit(None).cast("string")
    for ext, k in EXTENSIONS.items():
        kind = F.when(F.col("path").endswith(ext), k).otherwise(kind)
    return raw.select(F.col("path").alias("schematic_id"), kind.alias("kind"), F.decode("content", "UTF-8").alias("content"))


# ---------------------------------------------------------------- tables of schematics

_PROPERTY = "array<struct<name:string,value:string,x:double,y:double,rotation:double,effects:string>>"
_FIELDS = {
    "wire": "x1 double, y1 double, x2 double, y2 double",
    "bus": "x1 double, y1 double, x2 double, y2 double",
    "junction": "x double, y double",
    "label": "text string, type string, x double, y double, rotation double",
    "text": "text string, x double, y double, rotation double, effects string",
    "sheet": "uuid string, sheetfile string, sheetname string",
    "symbol": f"library_id string, x double, y double, rotation double, unit string, uuid string, properties {_PROPERTY}, pins array<struct<number:string,name:string,type:string,length:double,x:double,y:double>>",
    "library_symbol": f"id string, pins array<struct<type:string,shape:string,number:string,name:string,length:double,x:double,y:double,orientation:double>>, properties {_PROPERTY}, graphics array<string>",
    "net": "net int, name string",
    "segment": "net int, layer string, x1 double, y1 double, x2 double, y2 double",
    "arc": "net int, layer string, x1 double, y1 double, x2 double, y2 double",
    "via": "net int, x1 double, y1 double, x2 double, y2 double",
    "zone": "net int, layer string",
    "footprint": "library string, layer string, uuid string, reference string, value string, tags string, x double, y double, rotation double",
    "pad": "net int, number string, kind string, reference string, x1 double, y1 double, x2 double, y2 double",
    "footprint_drawing": "reference string, layer string, x1 double, y1 double, x2 double, y2 double",
    "drawing": "kind string, layer string, x1 double, y1 double, x2 double, y2 double",
}


def entity(rows: DataFrame, name: str) -> DataFrame:
    """SCH-5, SCH-6, SCH-7 and the like: the rows of one entity as a table."""
    own = rows.where(F.col("entity") == name)
    return own.select("schematic_id", "ordinal", F.from_json("payload", _FIELDS[name]).alias("p")).select("schematic_id", "ordinal", "p.*")


def _key_values(rows: DataFrame, name: str) -> DataFrame:
    own = rows.where(F.col("entity") == name).select("schematic_id", "ordinal", F.from_json("payload", "key string, value string").alias("p"))
    last = own.groupBy("schematic_id", "p.key").agg(F.max_by("p.value", "ordinal").alias("value"))
    return last.groupBy("schematic_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("m"))


def metadata(rows: DataFrame) -> DataFrame:
    """SCH-1: (schematic_id, version, generator, generator_version, uuid, paper), the last of each."""
    return _key_values(rows, "meta").select("schematic_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("version", "generator", "generator_version", "uuid", "paper")])


def title_blocks(rows: DataFrame) -> DataFrame:
    """SCH-2: (schematic_id, title_block map); a key that repeats has its last value."""
    return _key_values(rows, "title").withColumnRenamed("m", "title_block")


def library_symbols(rows: DataFrame) -> DataFrame:
    """SCH-3: the last library symbol of each id."""
    own = entity(rows, "library_symbol")
    return keep_first(own, ["schematic_id", "id"], [F.desc("ordinal")])


def library_pins(rows: DataFrame) -> DataFrame:
    """SCH-4: (schematic_id, symbol_id, pin fields), the last pin of each number."""
    own = library_symbols(rows).select("schematic_id", F.col("id").alias("symbol_id"), F.posexplode("pins").alias("pos", "p")).select("schematic_id", "symbol_id", "pos", "p.*")
    return keep_first(own, ["schematic_id", "symbol_id", "number"], [F.desc("pos")])


def last_values(properties: Column) -> Column:
    """SCH-10: a map of property values, the last of each name."""
    names = F.array_distinct(F.transform(properties, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(properties, lambda p: p["name"] == n), -1)["value"]))


def named_symbols(rows: DataFrame) -> DataFrame:
    """Symbols with the reference, value and footprint that their properties say, as ``table`` gives them."""
    own = entity(rows, "symbol").withColumn("values", last_values(F.col("properties")))
    one = lambda k: F.coalesce(F.try_element_at("values", F.lit(k)), F.lit(""))
    return own.withColumns({c: one(c.title()) for c in NAMED})


def last_of_references(symbols: DataFrame, compat: bool = True) -> DataFrame:
    """SCH-8: symbols with a reference; of one reference the last stays (compat), else of one reference and unit."""
    return keep_first(symbols.where("reference <> ''"), ["schematic_id", "reference", *([] if compat else ["unit"])], [F.desc("ordinal")])


def components(rows: DataFrame, compat: bool = True) -> DataFrame:
    """SCH-8: symbols with a Reference; of one reference the last stays (compat), else of one reference and unit."""
    return last_of_references(named_symbols(rows), compat)


def _parts_of(components: DataFrame, parts: str, key: str, also: tuple[str, ...]) -> DataFrame:
    own = components.select("schematic_id", "reference", *also, F.posexplode(parts).alias("pos", "p")).select("schematic_id", "reference", *also, "pos", "p.*")
    return keep_first(own, ["schematic_id", "reference", key], [F.desc("pos")])


def pins_of(components: DataFrame, *also: str) -> DataFrame:
    """SCH-9: (schematic_id, reference, number, ...) of the pin instances of components, the last of each number; with ``also`` columns of theirs."""
    return _parts_of(components, "pins", "number", also)


def component_pins(rows: DataFrame, compat: bool = True) -> DataFrame:
    """SCH-9: (schematic_id, reference, number, ...) of pin instances, the last of each number."""
    return pins_of(components(rows, compat))


def properties_of(components: DataFrame) -> DataFrame:
    """SCH-10: (schematic_id, reference, property fields) of components, the last of each name."""
    return _parts_of(components, "properties", "name", ())


def component_properties(rows: DataFrame, compat: bool = True) -> DataFrame:
    """SCH-10: (schematic_id, reference, property fields), the last of each name."""
    return properties_of(components(rows, compat))


def annotations(rows: DataFrame) -> DataFrame:
    """SCH-11: (schematic_id, annotations): texts in document order."""
    return entity(rows, "text").groupBy("schematic_id").agg(ordered(F.struct("ordinal", F.struct("text", "x", "y", "rotation").alias("a")), "a").alias("annotations"))


def stamped(documents: DataFrame, filename: Column, now: Column) -> DataFrame:
    """SCH-12: documents with parser version, file name, and the time of parsing in seconds and as text (UTC)."""
    return documents.withColumns({"parser_version": F.lit(PARSER_VERSION), "original_filename": filename, "parsed_date_unix": F.unix_timestamp(now), "parsed_date_readable": F.date_format(now, "yyyy-MM-dd HH:mm:ss 'UTC'")})


COUNTED = ["library_symbol", "wire", "bus", "bus_entry", "junction", "label", "global_label", "no_connect", "symbol", "sheet"]


def statistics(rows: DataFrame) -> DataFrame:
    """SCH-13, PRJ-13: (schematic_id, a count for each entity)."""
    return rows.groupBy("schematic_id").agg(*[F.count_if(F.col("entity") == e).alias(f"n_{e}") for e in COUNTED])


def listed(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """SCH-14: the first n rows of each group, with the number of those left out."""
    own = rows.withColumn("more", F.greatest(F.lit(0).cast("long"), F.count("*").over(Window.partitionBy(*by)) - n))
    return top_n_per(own, by, order, n)


# Keys that cleaning drops, and values of a Datasheet that mean none.
DROPPED_KEYS = ["effects", "font", "justify", "graphics"]
NO_DATASHEET = ["", "~"]


def _in_pieces(texts: pa.Array, made: Callable[[str], str]) -> pa.Array:
    """What is made of each text, null where it fails; Python holds about PIECE characters of it at a time."""
    pieces, own, size = [], [], 0
    for t in texts:
        try:
            own.append(made(t.as_py()))
            size += len(own[-1])
        except (TypeError, ValueError):
            own.append(None)
        if size >= PIECE:
            pieces.append(pa.array(own, pa.string()))
            own, size = [], 0
    return pa.concat_arrays([*pieces, pa.array(own, pa.string())])


def cleaned_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """SCH-15: JSON texts without dropped keys and empty datasheets at any depth; null where the text is no JSON."""

    def clean(x):
        if isinstance(x, dict):
            empty = lambda k, v: k == "Datasheet" and isinstance(v, dict) and v.get("name") == "Datasheet" and v.get("value") in NO_DATASHEET
            return {k: clean(v) for k, v in x.items() if k not in DROPPED_KEYS and not empty(k, v)}
        return [clean(v) for v in x] if isinstance(x, list) else x

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return _in_pieces(texts, lambda t: json.dumps(clean(json.loads(t)), ensure_ascii=False))

    return documents.withColumn(column, run(column))
