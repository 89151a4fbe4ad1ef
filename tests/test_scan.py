"""Schematic files that are scanned by many at once, against the reader that goes token by token."""

import json
import random

import pyarrow as pa
import pytest

from ohmlake.queries import QUERIES
from ohmlake.queries.texts import schematic_texts
from ohmlake.sources import designs as S, scan

AT = "/root/testdata/sf0.001"
SYMBOL = '(symbol (lib_id "Device:R") (at 1 2 90) (unit 2) (property "Reference" "R1" (at 1 2 0) (effects (font (size 1.27 1.27)) hide)) (property "Value" "old") (property "Value" "1 k" (at .5 4.)) (pin "1" (uuid 0)) (pin "2" line) (uuid u1))'
#: Items that plain files may have, and some that make a file odd or rejected.
ITEMS = [
    SYMBOL,
    SYMBOL.replace('"R1"', '"R2"').replace("(unit 2)", '(unit "3") (unit)'),
    '(symbol "Lib:C" (property "Reference" R3) (property "Reference") (pin) (pin "1"))',
    '(symbol "short")',
    "(symbol (lib_id x) (uuid))",
    '(wire (pts (xy 1 2) (xy 3.5 -4) (xy 5 6)) (xy 9 9))\n(wire)(bus (pts (xy 0.005 1e2)))',
    "(wire (pts (xy 1 2)) (pts (xy 3 4)))",
    '(junction (at 1 2 3) (at 4 5))(no_connect (at 1 2))("junction" x (diameter 0))',
    '(label "A (b" (at 1 2 90) (at 3 4) (effects (font)))(label)(hierarchical_label H (shape input) (at 5 6 7))(global_label "é" (at 0 0))(hierarchical_labeX "no" (at 1 2))',
    '(version 20211123) (generator eng)(generator_version "9")(generator_versiom 1)(uuid)(paper "A4")(title_block (title "t") (rev) (comment 1 "q")) atom "string"',
    '(lib_symbols (symbol "Device:R" (property "Value" "R" (at 0 0)) (pin passive line (at 0 3.81 270) (length 1.27) (name "~") (number "1")) (rectangle)) (symbol) (other 1))',
    '(text "note" (at 1 2 0) (effects (font (size 1 1))))(sheet (at 1 2) (property "Sheetname" "s" (at 0 0 0)) (uuid u))',
]
ODD = ['(label "a\\"b" (at 1 2))', "(junction (at 1))", "(junction (at 1 x))", "(junction (at 1 nan 1_0))", "(wire (pts (xy 1 2) (xy +3 4)))", "(label é (at 1 2))", "(label a\xa0b (at 1 2))", '(symbol (lib_id "a") (pin "1" x (number "7") (at 1 2)))', "(text", ")", '"', "()", "((wire))", '(symbol (at 1 2) 3)', "(label (at 1 2) (at 3 4))", "(a " * 70 + ")" * 70, "(junction (at 1 2 3\x00))", '(symbol a (property (b) "c" (at 1 2)))']
WHOLE = ["", "(other)", None, "(kicad_sch)", "(kicad_sch", "kicad_sch", " (kicad_sch (wire))", '("kicad_sch" (wire))', "(kicad_sci (wire))", "(kicad_schx (wire))", "(kicad_sch (wire)) (kicad_sch)", "(kicad_sch (wire)) x", "()", "(kicad_sch(wire))\n"]


def files() -> list:
    rng, out = random.Random(42), list(WHOLE)
    for i in range(300):
        some = rng.sample(ITEMS, rng.randrange(7)) + ([rng.choice(ODD)] if i % 3 == 0 else [])
        rng.shuffle(some)
        out.append(f"(kicad_sch {rng.choice([' ', chr(10), '']).join(some)})")
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def batch():
    texts = files()
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["schematic_id", "content"])


def rows(batch) -> list:
    """(id, ordinal, entity, fields), token by token."""
    return [(n, i, e, f) for n, t in enumerate(batch.columns[1]) for i, (e, f) in enumerate(S._read(t.as_py() or ""))]


def test_most_files_are_plain(batch):
    texts = pa.array([t or "" for t in batch.columns[1].to_pylist()])
    _, odd = scan.plain(texts, S._json_effects, lambda own, n: None)
    assert 0 < len(odd) < len(texts) / 2


@pytest.mark.parametrize("size", [1, 1 << 12, 1 << 21])
def test_some_items_are_as_all_items(batch, monkeypatch, size):
    monkeypatch.setattr(S, "SCANNED", size)
    want = rows(batch)
    every = sorted({e for _, _, e, _ in want})
    got = [(r["schematic_id"], r["ordinal"], r["entity"], r["payload"]) for b in S._rows_of(iter([batch]), every) for r in b.to_pylist()]
    assert sorted(got) == [(n, i, e, json.dumps(f)) for n, i, e, f in want]
    names = [(r["schematic_id"], r["ordinal"], r["entity"]) for b in S._names_of(iter([batch])) for r in b.to_pylist()]
    assert sorted(names) == [w[:3] for w in want]


def test_tables_are_as_those_of_items(spark):
    df = spark.createDataFrame(list(enumerate(files())), "schematic_id long, content string").repartition(3)
    items = S.items(df).cache()
    named = S.named_symbols(items)
    for name in scan.COLUMNS:
        got = S.table(df, name)
        want = (named if name == "symbol" else S.entity(items, name)).select(got.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), name
    assert S.table(df, "label", "text").columns == ["schematic_id", "ordinal", "text"]
    assert S.table(df.limit(0), "wire").count() == 0


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pins_of_components_read_each_file_once(spark):
    """F1"""
    made = plan(QUERIES["sch9_all_pins"](spark, AT))
    assert made.count("MapInArrow") == 1 and "Join" not in made.split("MapInArrow")[0] and "from_json" not in made


def test_pins_keep_columns_of_their_components(spark):
    text = "(kicad_sch " + SYMBOL.replace("Device:R", "a") + SYMBOL.replace('"2" line', '"2" line (number "7"))(pin "x" line (number "7")').replace("Device:R", "b") + ")"
    df = spark.createDataFrame([("f", text)], "schematic_id string, content string")
    got = S.pins_of(S.last_of_references(S.table(df, "symbol", "reference", "library_id", "pins")), "library_id").collect()
    assert {(r.library_id, r.number, r.type) for r in got} == {("b", "", "1"), ("b", "7", "x")}
    assert {(r.number, r.type) for r in S.component_pins(S.items(df)).collect()} == {("", "1"), ("7", "x")}


@pytest.mark.parametrize("name", ["sch9_component_pins", "sch8_all_components", "sch8_components", "sch10_component_properties", "sch5_wires", "sch6_junctions", "sch7_labels"])
def test_tables_are_made_without_json(spark, name):
    """F2, F3, F4"""
    made = plan(QUERIES[name](spark, AT))
    assert made.count("MapInArrow") == 1 and "from_json" not in made, name


def test_texts_of_the_queries_are_plain(spark):
    texts = pa.array([r.content for r in schematic_texts(spark, AT).collect() if r.content != "(other)"])
    _, odd = scan.plain(texts, S._json_effects, lambda own, n: None)
    assert len(texts) and not len(odd)
