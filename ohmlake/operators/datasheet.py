"""Specifications from datasheet texts (DTX-1 to DTX-15).

texts: (source_file, text). Patterns behave as in a Unicode-aware engine that matches without regard to case.
Where ``compat`` is true, units are forced to the fixed ones; else they are kept as matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ohmlake.functions.columns import PY, all_matches, collapse, first_match, has_any, keep_first, lines, matches, ordered, strip

# Patterns of pins.
NUMBERED_PIN = r"(?:Pin|GPIO|P)\s*(\d+)\s*[:=]\s*([A-Z_]+)\s*[-–]\s*(.+?)(?:\n|\z)"
DESCRIBED_PIN = r"(?s)([A-Z0-9_/]+)\s*\(([A-Z0-9_/]+)\)\s*:\s*(.+?)(?=\s+[A-Z0-9_/]+\s*\(|\z)"
PARENTHETICAL_PIN = r"([A-Z0-9_/]+)\s*\(([A-Z0-9_/,\s]+)\)\s*:\s*([^.]+\.)"

# Pin types in the order they are tried.
PIN_TYPES = [
    ("POWER", r"power|VCC\b|VDD\b|V\+|supply"),
    ("GROUND", r"ground|GND\b|VSS\b|V-"),
    ("CLOCK", r"clock\s*signal|CLK\b|SCL\b|SCLK\b"),
    ("CHIP_SELECT", r"chip\s*select|slave\s*select|CS\b"),
    ("DATA", r"data\s*signal|SDA\b|MOSI\b|MISO\b|DIN\b|DOUT\b"),
    ("CONTROL", r"control\s*pin|command\s*control|D/C\b|DC\b"),
    ("RESET", r"reset\s*pin|RST\b|RESET\b"),
    ("INTERRUPT", r"interrupt|IRQ\b|INT\b"),
    ("ENABLE", r"enable|EN\b|CE\b"),
]

# Patterns of levels, timing, requirements, conditions and characteristics.
VOLTAGE_LEVEL = r"(?:high|low)\s*level[:\s]*(\d+\.?\d*)\s*V"
SPI_TIMING = r"(?:Timing|SPI)\s*:\s*CPHL?\s*=\s*(\d+)\s*,\s*CPOL\s*=\s*(\d+)\s*\(([^)]+)\)"
I2C_ADDRESS = r"(?:I2C|slave)\s*address\s*:\s*0x([0-9A-F]+)"
PULL_UP = r"pull-?up\s*(?:resistor)?\s*(\d+\.?\d*)\s*(kΩ|kohm|ohm)"
DECOUPLING = r"decoupling\s*(?:capacitor)?\s*(\d+\.?\d*)\s*(µF|uF|nF|pF)"
TEMPERATURE_RANGE = r"(?:operating|work|temperature)\s*(?:range)?\s*[:\-]?\s*(-?\d+\.?\d*)\s*°?C?\s*(?:to|[-–])\s*(-?\d+\.?\d*)\s*°?C"
VOLTAGE_RANGE = r"(\d+\.?\d*)\s*V?\s*(?:to|[-–])\s*(\d+\.?\d*)\s*V"
MAX_CURRENT = r"(\d+\.?\d*)\s*(mA|µA|A)\s*(?:max|maximum)"
MAX_FREQUENCY = r"(\d+\.?\d*)\s*(MHz|KHz|Hz)\s*(?:max|maximum)"
COMPONENT_NAME = r"(?:^|\n)([A-Z0-9]+(?:-[A-Z0-9]+)*)\s*(?:Series|Family|Module)"

UNKNOWN = "Unknown Component"
REPORTED = 5


def component_name(text: Column) -> Column:
    """DTX-1: the first of ten lines that looks like a part name, else what stands before Series, Family or Module."""
    top = F.transform(F.slice(lines(text), 1, 10), strip)
    named = F.get(F.filter(top, lambda x: (F.length(x) > 5) & (F.length(x) < 50) & x.rlike(r"(?U)^[A-Z0-9][A-Z0-9\-_\s]+\z")), F.lit(0))
    return F.coalesce(named, first_match(text, COMPONENT_NAME, flags=PY + "(?m)"), F.lit(UNKNOWN))


def pin_type(name: Column, description: Column) -> Column:
    """DTX-5."""
    both, low, out = F.upper(F.concat_ws(" ", name, description)), F.lower(description), None
    for kind, pattern in PIN_TYPES:
        out = F.when(matches(both, pattern), kind) if out is None else out.when(matches(both, pattern), kind)
    return out.when(low.contains("input"), "INPUT").when(low.contains("output"), "OUTPUT").when(low.contains("bidirectional") | low.contains("i/o"), "BIDIRECTIONAL").otherwise("GENERAL")


def _found(texts: DataFrame, pattern: str, groups: int) -> DataFrame:
    """texts with pos and g1.. for every match of a pattern, in order."""
    zipped = F.arrays_zip(*[all_matches("text", pattern, i + 1).alias(f"g{i + 1}") for i in range(groups)])
    return texts.select("source_file", F.posexplode(zipped).alias("pos", "m")).select("source_file", "pos", *[F.col("m")[f"g{i + 1}"].alias(f"g{i + 1}") for i in range(groups)])


PIN = ["source_file", "src_rank", "pos", "pin_number", "pin_name", "description", "pin_type", "voltage_min", "voltage_max", "timing", "pull_up_down"]


def _pins(df: DataFrame, rank: int, number: Column, name: Column, description: Column, kind: Column, about: Column | None) -> DataFrame:
    """PIN rows; about: the text that specifications are read from (DTX-6), none if None."""
    none = F.lit(None)
    if about is None:
        low = high = none.cast("double")
        timing, pull = F.array().cast("array<string>"), none.cast("string")
    else:
        level = first_match(about, VOLTAGE_LEVEL).cast("double")
        words = F.lower(about)
        low = F.when(words.contains("low level"), level)
        high = F.when(words.contains("high level"), level)
        zipped = F.arrays_zip(*[all_matches(about, SPI_TIMING, i + 1).alias(n) for i, n in enumerate("abc")])
        said = F.transform(zipped, lambda x: F.concat(F.lit("SPI Mode: CPHL="), x["a"], F.lit(", CPOL="), x["b"], F.lit(" ("), x["c"], F.lit(")")))
        timing = F.when(words.contains("timing"), said).otherwise(F.array().cast("array<string>"))
        pull = F.when(words.contains("pull-up"), "PULL_UP").when(words.contains("pull-down"), "PULL_DOWN")
    return df.select("source_file", F.lit(rank).alias("src_rank"), "pos", number.alias("pin_number"), name.alias("pin_name"), description.alias("description"), kind.alias("pin_type"), low.alias("voltage_min"), high.alias("voltage_max"), timing.alias("timing"), pull.alias("pull_up_down"))


def numbered_pins(texts: DataFrame) -> DataFrame:
    """DTX-2: pins like "Pin 3: VCC - supply"."""
    f = _found(texts, NUMBERED_PIN, 3)
    return _pins(f, 0, F.col("g1"), strip(F.col("g2")), strip(F.col("g3")), pin_type(F.col("g2"), F.col("g3")), None)


def described_pins(texts: DataFrame) -> DataFrame:
    """DTX-3: pins like "CSB (CS): chip select", up to the next such name."""
    f = _found(texts, DESCRIBED_PIN, 3).withColumn("about", collapse(F.col("g3")))
    shown = F.when(strip(F.col("g2")) != strip(F.col("g1")), F.concat(F.lit("("), strip(F.col("g2")), F.lit(") "), "about")).otherwise(F.col("about"))
    return _pins(f, 1, F.lit(None).cast("string"), strip(F.col("g1")), shown, pin_type(F.concat_ws(" ", "g1", "g2"), F.col("about")), F.col("about"))


def parenthetical_pins(texts: DataFrame) -> DataFrame:
    """DTX-4: pins like "SCL (SCK/SCLK): clock signal.", up to the first period."""
    f = _found(texts, PARENTHETICAL_PIN, 3).withColumn("about", strip(F.col("g3")))
    shown = F.when(strip(F.col("g2")) != "", F.concat(F.lit("("), strip(F.col("g2")), F.lit(") "), "about")).otherwise(F.col("about"))
    return _pins(f, 2, F.lit(None).cast("string"), strip(F.col("g1")), shown, pin_type(F.concat_ws(" ", "g1", "g2"), F.col("about")), F.col("about"))


def table_pins(cells: DataFrame) -> DataFrame:
    """DTX-7: pins of table rows (source_file, table_no, row_no, col_no, header, cell).

    A header picks the role of its column, the last such column of a table counts; a table without pin and
    name columns gives none.
    """
    low = F.lower("header")
    role = F.when(has_any(low, ["pin", "number", "no."]), "pin").when(has_any(low, ["name", "signal", "function"]), "name").when(has_any(low, ["description", "desc"]), "desc")
    own = cells.withColumn("role", role).where("role is not null")
    last = F.max("col_no").over(Window.partitionBy("source_file", "table_no", "role"))
    own = own.withColumn("_last", last).where("col_no = _last")
    wide = own.groupBy("source_file", "table_no", "row_no").pivot("role", ["pin", "name", "desc"]).agg(F.first("cell"))
    has = lambda c: F.count(c).over(Window.partitionBy("source_file", "table_no")) > 0
    wide = wide.withColumn("_ok", has("pin") & has("name")).where(F.col("_ok") & ~F.coalesce(F.trim("name"), F.lit("")).isin("", "nan", "None"))
    pos = F.shiftleft(F.col("table_no").cast("long"), 31) + F.col("row_no")
    return _pins(wide.withColumn("pos", pos), 3, F.col("pin"), F.trim("name"), F.trim(F.coalesce("desc", F.lit(""))), F.lit(""), None)


def unique_pins(*pins: DataFrame) -> DataFrame:
    """DTX-8: the first pin of each name: numbered, described, parenthetical, then tables."""
    every = pins[0]
    for p in pins[1:]:
        every = every.unionByName(p)
    return keep_first(every, ["source_file", "pin_name"], ["src_rank", "pos"])


def requirements(texts: DataFrame, compat: bool = True) -> DataFrame:
    """DTX-9, DTX-10, DTX-11: (source_file, rank, pos, pin_name, requirement_type, value, description)."""
    text = F.col("text")
    s = lambda **c: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(k) for k, v in c.items()])
    r = lambda pin, kind, value, about: s(pin_name=pin, requirement_type=kind, value=value, description=about)
    two = lambda p, fixed, pin, kind, about: F.transform(F.arrays_zip(all_matches(text, p, 1).alias("v"), all_matches(text, p, 2).alias("u")), lambda x: r(pin, kind, F.concat(x["v"], F.lit(fixed) if compat else x["u"]), about))
    spi = F.transform(F.arrays_zip(*[all_matches(text, SPI_TIMING, i + 1).alias(n) for i, n in enumerate("abc")]), lambda x: r("SPI_INTERFACE", "SPI_TIMING", F.concat(F.lit("CPHL="), x["a"], F.lit(", CPOL="), x["b"]), F.concat(F.lit("SPI timing configuration for "), x["c"])))
    i2c = F.transform(all_matches(text, I2C_ADDRESS), lambda x: r("I2C_INTERFACE", "I2C_ADDRESS", F.concat(F.lit("0x"), x), "I2C slave address"))
    said = lambda p, one: F.when(matches(text, p), F.array(one)).otherwise(F.array().cast("array<struct<pin_name:string,requirement_type:string,value:string,description:string>>"))
    every = F.concat(
        two(PULL_UP, "kΩ", "", "PULL_UP_RESISTOR", "Pull-up resistor requirement"),
        two(DECOUPLING, "µF", "VCC", "DECOUPLING_CAPACITOR", "Decoupling capacitor requirement"),
        spi,
        said(r"SPI\s+(?:interface|communication|timing)", r("SPI_INTERFACE", "INTERFACE_REQUIREMENT", "SPI", "Requires SPI interface connection (CS, CLK, MOSI, MISO)")),
        i2c,
        said(r"I2C\s+(?:interface|communication)", r("I2C_INTERFACE", "INTERFACE_REQUIREMENT", "I2C", "Requires I2C interface connection (SDA, SCL)")),
    )
    return texts.select("source_file", F.posexplode(every).alias("pos", "r")).select("source_file", "pos", "r.*")


def _pair(text: Column, pattern: str, unit: str) -> Column:
    a, b = first_match(text, pattern, 1), first_match(text, pattern, 2)
    return F.when(a.isNotNull(), F.concat(a, F.lit(f"{unit} to "), b, F.lit(unit)))


def operating_conditions(text: Column) -> Column:
    """DTX-12: a map of the first temperature and voltage ranges."""
    return F.map_filter(F.create_map(F.lit("temperature_range"), _pair(text, TEMPERATURE_RANGE, "°C"), F.lit("voltage_range"), _pair(text, VOLTAGE_RANGE, "V")), lambda _, v: v.isNotNull())


def electrical_characteristics(text: Column, compat: bool = True) -> Column:
    """DTX-13: a map of the first greatest current and frequency."""
    one = lambda p, unit: F.concat(first_match(text, p), F.lit(unit) if compat else first_match(text, p, 2))
    return F.map_filter(F.create_map(F.lit("max_current"), one(MAX_CURRENT, "mA"), F.lit("max_frequency"), one(MAX_FREQUENCY, "MHz")), lambda _, v: v.isNotNull())


def all_pins(texts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    parts = [numbered_pins(texts), described_pins(texts), parenthetical_pins(texts)]
    return unique_pins(*parts, *([table_pins(cells)] if cells is not None else []))


def specifications(texts: DataFrame, cells: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """DTX-14: one row for each text with name, pins, requirements, conditions and characteristics."""
    pin = F.struct(*PIN[1:])
    pins = all_pins(texts, cells).groupBy("source_file").agg(F.array_sort(F.collect_list(pin)).alias("pins"))
    needs = requirements(texts, compat).groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("pos", "pin_name", "requirement_type", "value", "description"))).alias("requirements"))
    text = F.col("text")
    own = texts.select("source_file", component_name(text).alias("component_name"), operating_conditions(text).alias("operating_conditions"), electrical_characteristics(text, compat).alias("electrical_characteristics"))
    return own.join(pins, "source_file", "left").join(needs, "source_file", "left")


def pin_report(pins: DataFrame) -> DataFrame:
    """DTX-15: (source_file, report): pins grouped by type in order of appearance, REPORTED of each, and how many more."""
    own = pins.withColumn("pin_type", F.when(F.coalesce("pin_type", F.lit("")) == "", "GENERAL").otherwise(F.col("pin_type")))
    w = Window.partitionBy("source_file", "pin_type")
    own = own.withColumns({"i": F.row_number().over(w.orderBy("src_rank", "pos")), "n": F.count("*").over(w), "first": F.min(F.struct("src_rank", "pos")).over(w)})
    line = F.concat(F.lit("    - "), "pin_name", F.when(F.coalesce("pin_number", F.lit("")) != "", F.concat(F.lit(" (Pin "), "pin_number", F.lit(")"))).otherwise(""), F.lit(": "), F.coalesce("description", F.lit(""))).alias("line")
    shown = own.where(F.col("i") <= REPORTED).groupBy("source_file", "pin_type", "n", "first").agg(ordered(F.struct("i", line), "line").alias("rows"))
    more = F.when(F.col("n") > REPORTED, F.array(F.concat(F.lit("    ... and "), (F.col("n") - REPORTED).cast("string"), F.lit(" more "), F.lower("pin_type"), F.lit(" pins")))).otherwise(F.array().cast("array<string>"))
    block = F.array_join(F.concat(F.array(F.concat(F.lit("  "), "pin_type", F.lit(" Pins:"))), "rows", more), "\n")
    return shown.withColumn("block", block).groupBy("source_file").agg(F.concat(F.lit("Pins ("), F.sum("n").cast("string"), F.lit(" total):\n"), F.array_join(ordered(F.struct("first", "block"), "block"), "\n")).alias("report"))
