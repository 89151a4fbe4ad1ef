"""Structured records from analysts' response texts (RSP-1 to RSP-23).

responses: (source_file, text). The tables of patterns below say what is looked for; each operator
folds its table into one expression, so a text is read within one row and nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ohmlake.functions.columns import PY, all_matches, first_match, has_any, let, lines, matches, ordered, strip

# Keys with the patterns that give them.
ELECTRICAL = {
    "operating_voltage": r"operating\s*voltage[:\s]*([^,\n]+)",
    "rated_input_voltage": r"rated\s*input\s*voltage[:\s]*([^,\n]+)",
    "minimum_voltage": r"minimum\s*voltage[:\s]*([^,\n]+)",
    "working_voltage": r"working\s*voltage[:\s]*([^,\n]+)",
    "standby_current": r"standby\s*current[:\s]*([^,\n]+)",
    "refresh_power": r"refresh\s*power[:\s]*([^,\n]+)",
    "power_consumption": r"power\s*consumption[:\s]*([^,\n]+)",
}
PERFORMANCE = {
    "refresh_time": (r"refresh\s*time[:\s]*(\d+\.?\d*)\s*s", " seconds"),
    "viewing_angle": (r"viewing\s*angle[:\s]*(\d+)\s*degrees?", " degrees"),
    "display_colors": (r"display\s*colors?[:\s]*([^,\n]+)", ""),
    "grayscale_levels": (r"grayscale?\s*levels?[:\s]*(\d+)", ""),
    "lifetime_cycles": (r"lifetime[:\s]*([^,\n]+)", ""),
}
ENVIRONMENT = {
    "working_temperature": r"working\s*temperature[:\s]*([^,\n]+)",
    "storage_temperature": r"storage\s*temperature[:\s]*([^,\n]+)",
    "transportation_temperature": r"transportation\s*temperature[:\s]*([^,\n]+)",
    "operating_temperature": r"operating.*temperature[:\s]*([^,\n]+)",
    "working_humidity": r"working\s*humidity[:\s]*([^,\n]+)",
    "storage_humidity": r"storage\s*humidity[:\s]*([^,\n]+)",
    "storage_time": r"storage\s*time[:\s]*([^,\n]+)",
    "transportation_time": r"transportation.*time[:\s]*([^,\n]+)",
}
RESOLUTION = [r"(\d+)\s*[×x]\s*(\d+)\s*pixels?", r"resolution[:\s]*(\d+)\s*[×x]\s*(\d+)", r"(\d+)\s*[×x]\s*(\d+)\s*resolution"]
DIMENSIONS = {
    "dot_pitch": r"dot\s*pitch[:\s]*(\d+\.?\d*)\s*mm\s*[×x]\s*(\d+\.?\d*)\s*mm",
    "display_dimensions": r"display\s*dimensions[:\s]*(\d+\.?\d*)\s*mm\s*[×x]\s*(\d+\.?\d*)\s*mm",
    "driver_board_dimensions": r"driver\s*board\s*dimensions[:\s]*(\d+\.?\d*)\s*mm\s*[×x]\s*(\d+\.?\d*)\s*mm",
    "outline_dimensions": r"outline\s*dimensions[:\s]*(\d+\.?\d*)\s*mm\s*[×x]\s*(\d+\.?\d*)\s*mm\s*[×x]\s*(\d+\.?\d*)\s*mm",
}

# Pattern, name, description and type of pins.
PINS = [
    (r"CSB?\s*\(CS\)", "CS", "Chip Select", "CHIP_SELECT"),
    (r"SCL\s*\(SCK/SCLK\)", "SCL", "SPI Clock", "CLOCK"),
    (r"D/C\s*\(DC\)", "DC", "Data/Command Control", "CONTROL"),
    (r"SDA\s*\(DIN\)", "SDA", "Serial Data", "DATA"),
    (r"VCC", "VCC", "Power Supply", "POWER"),
    (r"GND", "GND", "Ground", "GROUND"),
    (r"RST", "RST", "Reset", "RESET"),
    (r"BUSY", "BUSY", "Status Indicator", "STATUS"),
]

# Platforms with their words.
PLATFORMS = {
    "raspberry_pi": ["raspberry pi", "rpi", "bcm"],
    "arduino": ["arduino", "uno", "mega"],
    "stm32": ["stm32"],
    "jetson_nano": ["jetson", "nano"],
    "esp32": ["esp32"],
    "esp8266": ["esp8266"],
}
PLATFORM_NAMES = ["raspberry pi", "arduino", "stm32", "jetson nano", "esp32", "esp8266"]
C_LIBRARIES = ["bcm2835", "wiringpi", "gpiod", "lg"]
PYTHON_LIBRARIES = ["rpi.gpio", "spidev", "pil", "numpy", "gpiozero"]
CONNECTION_PATTERNS = [r"(\w+)\s*(?:->|→|:)\s*(\w+(?:\d+)?)", r"(\w+)\s+(\w+(?:\d+)?)\s+(\d+)", r"(\w+)\s*\|\s*(\w+(?:\d+)?)\s*\|\s*(\d+)"]
CONNECTION_PINS = ["VCC", "GND", "DIN", "CLK", "CS", "DC", "RST", "BUSY"]

# Patterns and the warnings they stand for.
PRECAUTIONS = {
    "power_management_warnings": [
        (r"never.*power.*on.*long", "Never power on for extended periods"),
        (r"do not.*power.*long", "Do not power on for long periods without refreshing"),
        (r"high voltage.*damage", "High voltage state for long periods causes damage"),
        (r"sleep mode.*after.*refresh", "Set to sleep mode after refresh operations"),
        (r"voltage.*below.*2\.5V", "Never go below 2.5V supply voltage"),
    ],
    "refresh_constraints": [
        (r"partial.*refresh.*cannot.*continuous", "Cannot use partial refresh continuously"),
        (r"full.*refresh.*after.*partial", "Must perform full refresh after several partial refreshes"),
        (r"abnormal.*display.*effect", "Improper refresh causes abnormal display effects"),
        (r"flickering.*global.*refresh", "Flickering during global refresh is normal"),
    ],
    "physical_handling": [
        (r"fpc.*cable.*fragile", "FPC cable is fragile - handle carefully"),
        (r"do not.*bend.*vertical", "Do not bend cable vertically to screen"),
        (r"avoid.*repeated.*bending", "Avoid repeated excessive bending"),
        (r"screen.*fragile", "Screen is fragile - avoid impacts"),
        (r"fixed.*wiring.*development", "Use fixed wiring during development"),
    ],
    "environmental_limitations": [
        (r"uv.*exposure.*permanent", "UV exposure causes permanent damage"),
        (r"direct.*sunlight.*avoid", "Avoid direct sunlight"),
        (r"indoor.*use.*recommended", "Indoor use recommended"),
        (r"temperature.*range", "Operating temperature limits must be observed"),
    ],
    "damage_risks": [
        (r"irreversible.*damage", "Certain conditions cause irreversible damage"),
        (r"permanent.*damage", "Risk of permanent damage exists"),
        (r"cannot.*repair", "Some damage cannot be repaired"),
        (r"burn.*out", "Screen can burn out if misused"),
    ],
}
LIMITATIONS = {
    "successfully_extracted": ["successfully extracted", "can read", "extracted"],
    "cannot_extract": ["cannot extract", "cannot read", "visual elements", "diagrams"],
    "missing_documents": ["external document", "datasheet", "schematic", "missing"],
}
GRAYSCALE = [("Black", "00b"), ("Dark Grey", "01b"), ("Light Gray", "10b"), ("White", "11b")]

# Patterns of the second kind of record.
SECTION_TITLES = [r"section\s+\d+[:.]?\s*([^:\n]+)", r"#{1,3}\s*([^:\n]+)", r"^([A-Z][A-Z\s&]{10,50})[:.]?\s*$"]
PART_NUMBERS = [r"(ESP32[-_][A-Z0-9]+[-_]?[A-Z0-9]*)", r"([A-Z]{2,}\d{2,}[A-Z]*[-_]?[A-Z0-9]*)"]
PACKAGES = r"(QFN\s*\d+[×x]\d+|BGA\s*\d+|TQFP\s*\d+)"
PIN_COUNT = r"(\d+)\s*(?:pin|gpio|i/?o)"
LEVELS = {"input_high_voltage": r"VIH[:\s]*([0-9.]+)\s*V", "input_low_voltage": r"VIL[:\s]*([0-9.]+)\s*V", "output_high_voltage": r"VOH[:\s]*([0-9.]+)\s*V", "output_low_voltage": r"VOL[:\s]*([0-9.]+)\s*V"}
POWER_MODES = [r"(active|sleep|deep[_\s]*sleep|hibernation|modem[_\s]*sleep)\s*mode", r"(light[_\s]*sleep|power[_\s]*down|standby)\s*mode"]
CURRENTS = r"(\d+\.?\d*)\s*(µA|uA|mA|A)"
FREQUENCIES = r"(\d+\.?\d*)\s*(MHz|GHz|KHz|Hz)"
TEMPERATURES = r"(-?\d+\.?\d*)\s*°C?\s*[~to-]\s*(\+?\d+\.?\d*)\s*°C"
TEMPERATURES_FIXED = r"(-?\d+\.?\d*)\s*°C?\s*(?:~|to|-)\s*(\+?\d+\.?\d*)\s*°C"
FOLLOW_UP_TITLES = ["PIN ANALYSIS AND ELECTRICAL SPECIFICATIONS", "POWER MANAGEMENT AND TIMING SPECIFICATIONS", "PERIPHERAL INTERFACES AND CONFIGURATION", "VISUAL CONTENT AND MISSING INFORMATION"]

STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(STRINGS)


def _some(*choices: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, t) for c, t in choices]))


def _map(values: dict[str, Column]) -> Column:
    """A map without the keys whose value is null."""
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def _words(low: Column, words: list[str]) -> Column:
    return let(low, lambda own: _some(*[(own.contains(w), w) for w in words]))


def combined(responses: DataFrame, targeted: bool = False) -> DataFrame:
    """RSP-1: (source_file, text) from (source_file, seq, text, error): the first response, then the follow-ups in order.

    A failed follow-up stands with its error.
    """
    body = F.when(F.col("error").isNotNull(), F.concat(F.lit("Follow-up failed: "), "error")).otherwise(F.coalesce("text", F.lit("")))
    if targeted:
        titles = F.array(*[F.lit(t) for t in FOLLOW_UP_TITLES])
        body_ = F.concat(F.lit("\n" + "=" * 20 + " "), F.coalesce(F.get(titles, F.col("seq").cast("int") - 1), F.lit("")), F.lit(" " + "=" * 20 + "\n\n"), body, F.lit("\n"))
        banner = "\n\n" + "=" * 80 + "\nTARGETED FOLLOW-UP ANALYSIS - DETAILED TECHNICAL SPECIFICATIONS\n" + "=" * 80 + "\n\n"
    else:
        body_ = F.concat(F.lit("\n--- Follow-up Analysis "), F.col("seq").cast("string"), F.lit(" ---\n"), body, F.lit("\n"))
        banner = "\n\n" + "=" * 60 + "\nFOLLOW-UP ANALYSIS - ADDITIONAL DETAILS\n" + "=" * 60 + "\n\n"
    part = F.when(F.col("seq") == 0, F.concat(body, F.lit(banner))).otherwise(body_).alias("part")
    return responses.groupBy("source_file").agg(F.array_join(ordered(F.struct("seq", part), "part"), "").alias("text"))


def identification(text: Column) -> Column:
    """RSP-2."""
    named = F.filter(lines(text), lambda x: x.contains(":") & let(F.lower(x), lambda low: has_any(low, ["component name", "part number", "component:"])))
    facts = lambda low: F.struct(
        F.coalesce(strip(F.regexp_replace(F.get(named, F.lit(0)), r"^[^:]*:", "")), F.lit("")).alias("component_name"),
        F.when(low.contains("uc8176"), "UC8176").otherwise("").alias("controller_ic"),
        F.when(low.contains("electrophoretic"), "Electrophoretic Display (EPD)").otherwise("").alias("technology"),
        F.when(low.contains("v2") | low.contains("version"), F.array(F.lit("V1"), F.lit("V2"))).otherwise(_none()).alias("version_variants"),
    )
    return let(F.lower(text), facts)


def _sized(text: Column, pattern: str, n: int) -> Column:
    parts = [F.concat(first_match(text, pattern, i + 1), F.lit("mm")) for i in range(n)]
    return F.when(parts[0].isNotNull(), F.concat_ws(" × ", *parts))


def technical(text: Column) -> Column:
    """RSP-3: resolution, display size and a map of dimensions."""
    res = [F.when(first_match(text, p, 1).isNotNull(), F.concat(first_match(text, p, 1), F.lit(" × "), first_match(text, p, 2), F.lit(" pixels"))) for p in RESOLUTION]
    size = F.concat(first_match(text, r"(\d+\.?\d*)\s*inch"), F.lit(" inches"))
    return F.struct(F.coalesce(*res, F.lit("")).alias("resolution"), F.coalesce(size, F.lit("")).alias("display_size"), _map({k: _sized(text, p, 3 if k == "outline_dimensions" else 2) for k, p in DIMENSIONS.items()}).alias("dimensions"))


def electrical(text: Column) -> Column:
    """RSP-4."""
    return _map({k: strip(first_match(text, p)) for k, p in ELECTRICAL.items()})


def performance(text: Column) -> Column:
    """RSP-5."""
    return _map({k: F.concat(strip(first_match(text, p)), F.lit(unit)) for k, (p, unit) in PERFORMANCE.items()})


def environment(text: Column) -> Column:
    """RSP-6."""
    return _map({k: strip(first_match(text, p)) for k, p in ENVIRONMENT.items()})


def interfaces(text: Column) -> Column:
    """RSP-7."""
    low = F.lower(text)
    mode0 = low.contains("cphl=0") & low.contains("cpol=0")
    return F.struct(
        _some((low.contains("spi"), "SPI"), (low.contains("i2c"), "I2C"), (low.contains("uart"), "UART")).alias("primary_interfaces"),
        F.when(low.contains("spi"), "SPI").otherwise("").alias("communication_protocol"),
        F.when(mode0, "Mode 0").alias("spi_mode"),
        F.when(text.contains("20cm"), "20cm maximum").alias("max_cable_length"),
        F.when(text.contains("2.54mm") | text.contains("0.1 inch"), "0.1 inch (2.54mm) pitch").alias("connector_pitch"),
    )


def pins(text: Column) -> Column:
    """RSP-8: name, type, description and other names of the pins that the text mentions."""

    def about(name: str) -> Column:
        said = F.filter(lines(text), lambda x: x.contains(":") & F.lower(x).contains(name.lower()))
        return F.get(F.filter(F.transform(said, lambda x: strip(F.regexp_replace(x, r"^[^:]*:", ""))), lambda x: x != ""), F.lit(0))

    def other(name: str) -> Column:
        return F.filter(F.split(first_match(text, name + r"\s*\(([^)]+)\)"), r"(?U)[/,\s]+"), lambda x: x != "")

    return F.array_compact(F.array(*[
        F.when(matches(text, p), F.struct(F.lit(name).alias("pin_name"), F.lit(kind).alias("pin_type"), F.coalesce(about(name), F.lit(default)).alias("description"), F.coalesce(other(name), _none()).alias("alternate_names")))
        for p, name, default, kind in PINS
    ]))


def sections(responses: DataFrame) -> DataFrame:
    """RSP-9: (source_file, section_no, section): a header-like line starts a section."""
    line = F.col("line")
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    head = (strip(line) != "") & (((letters != "") & (F.upper(line) == line)) | line.startswith("#") | line.contains("Connection") | line.contains("Working With"))
    rows = responses.select("source_file", F.posexplode(lines("text")).alias("pos", "line"))
    w = Window.partitionBy("source_file").orderBy("pos")
    rows = rows.withColumn("section_no", F.sum(F.when(head, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    made = rows.groupBy("source_file", "section_no").agg(F.concat(F.array_join(ordered(F.struct("pos", "line"), "line"), "\n"), F.lit("\n")).alias("section"))
    return made


def connections(responses: DataFrame, most: int = 15) -> DataFrame:
    """RSP-10: (source_file, platform, rank, e_paper_pin, platform_pin, pin_number): from the first section that
    names a platform: table rows, then patterns, then pin lines; ``most`` of each platform.
    """
    own = sections(responses)
    low = F.lower("section")
    named = F.array_compact(F.array(*[F.when(has_any(low, ws), F.lit(p)) for p, ws in PLATFORMS.items()]))
    own = own.select("source_file", "section_no", "section", F.explode(named).alias("platform"))
    first = F.row_number().over(Window.partitionBy("source_file", "platform").orderBy("section_no"))
    own = own.withColumn("_i", first).where("_i = 1").select("source_file", "platform", "section")

    cells = F.transform(F.filter(lines("section"), lambda x: F.size(F.split(x, r"\|", -1)) >= 3), lambda x: F.filter(F.transform(F.split(x, r"\|", -1), strip), lambda c: c != ""))
    head = F.transform(cells, lambda c: has_any(F.lower(F.array_join(c, " ")), ["pin", "connection", "gpio"]))
    at = F.array_position(head, True)
    body = F.when(at > 0, F.slice(cells, at.cast("int") + 1, F.greatest(F.size(cells), F.lit(1)))).otherwise(F.array().cast("array<array<string>>"))
    body = F.filter(body, lambda c: (F.size(c) >= 2) & ~F.forall(c, lambda x: x.rlike(r"^[-| ]*$")))
    row = lambda a, b, c: F.struct(a.alias("e_paper_pin"), b.alias("platform_pin"), c.alias("pin_number"))
    table = F.transform(body, lambda c: row(F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.get(c, F.lit(2))))
    null = F.lit(None).cast("string")
    said = []
    for i, p in enumerate(CONNECTION_PATTERNS):
        zipped = F.arrays_zip(*[all_matches("section", p, g + 1, PY).alias("abc"[g]) for g in range(2 if i == 0 else 3)])
        said.append(F.transform(zipped, (lambda x: row(x["a"], x["b"], null)) if i == 0 else (lambda x: row(x["a"], x["b"], x["c"]))))
    listed = F.filter(lines("section"), lambda x: x.contains(":") & has_any(F.upper(x), CONNECTION_PINS))
    listed = F.transform(listed, lambda x: row(strip(F.regexp_extract(x, r"^([^:]*):", 1)), strip(F.regexp_replace(x, r"^[^:]*:", "")), null))
    every = F.slice(F.concat(table, *said, listed), 1, most)
    return own.select("source_file", "platform", F.posexplode(every).alias("rank", "c")).select("source_file", "platform", "rank", "c.*")


def precautions(text: Column) -> Column:
    """RSP-11: lists of timing constraints, warnings, constraints, handling, limits and risks."""
    low = F.lower(text)
    least = first_match(text, r"minimum\s*refresh\s*interval[:\s]*(\d+)\s*seconds?")
    daily = low.contains("24 hour") | low.contains("once every 24")
    must = matches(text, r"refresh.*least.*once.*every.*24.*hours?")
    timing = F.array_compact(F.array(
        F.when(least.isNotNull(), F.concat(F.lit("Minimum refresh interval: "), least, F.lit(" seconds"))),
        F.when(daily & must, "Must refresh at least once every 24 hours").when(daily, "Requires refresh at least once every 24 hours"),
        F.when(text.contains("180") & text.contains("second"), "Minimum 180 seconds between refreshes"),
    ))
    loud = F.transform(F.filter(lines(text), lambda x: let(F.lower(x), lambda low: has_any(low, ["power", "voltage", "vcc", "supply"]) & has_any(low, ["never", "do not", "avoid", "critical", "damage"])) & (F.length(strip(x)) > 15)), strip)
    own = {k: _some(*[(matches(text, p), t) for p, t in rules]) for k, rules in PRECAUTIONS.items()}
    own["power_management_warnings"] = F.slice(F.concat(own["power_management_warnings"], loud), 1, 10)
    return F.struct(timing.alias("timing_constraints"), *[v.alias(k) for k, v in own.items()])


def development(text: Column) -> Column:
    """RSP-12."""
    low = F.lower(text)
    return F.struct(F.transform(_words(low, PLATFORM_NAMES), F.initcap).alias("supported_platforms"), _words(low, C_LIBRARIES).alias("c_libraries"), _words(low, PYTHON_LIBRARIES).alias("python_libraries"), first_match(text, r"(https://github\.com/[^\s]+)", flags=PY).alias("repository_url"))


def registers(text: Column) -> Column:
    """RSP-13."""
    gray = F.array(*[F.struct(F.lit(c).alias("color"), F.lit(v).alias("value")) for c, v in GRAYSCALE])
    said = F.lower(text).contains("black:") & text.contains("00b")
    return F.struct(F.transform(all_matches(text, r"0x([0-9A-Fa-f]+)", flags=PY), lambda x: F.concat(F.lit("0x"), x)).alias("register_addresses"), F.when(said, gray).alias("grayscale_mappings"))


def limitations(text: Column, most: int = 15) -> Column:
    """RSP-14."""
    line = lambda ws: F.slice(F.transform(F.filter(lines(text), lambda x: has_any(F.lower(x), ws) & (F.length(strip(x)) > 10)), strip), 1, most)
    return F.struct(*[line(ws).alias(k) for k, ws in LIMITATIONS.items()])


def section_titles(text: Column, most: int = 20) -> Column:
    """RSP-15."""
    return F.slice(F.concat(*[all_matches(text, p, flags="(?dmiuU)") for p in SECTION_TITLES]), 1, most)


def part_numbers(text: Column, most: int = 10) -> Column:
    """RSP-16: distinct part numbers and packages, in order of first appearance by pattern."""
    return F.struct(F.slice(F.array_distinct(F.concat(*[all_matches(text, p) for p in PART_NUMBERS])), 1, most).alias("part_numbers"), F.array_distinct(all_matches(text, PACKAGES)).alias("package_types"))


def pin_facts(text: Column) -> Column:
    """RSP-17."""
    return F.struct(F.coalesce(first_match(text, PIN_COUNT).try_cast("int"), F.lit(0)).alias("total_pin_count"), _map({k: F.concat(first_match(text, p), F.lit("V")) for k, p in LEVELS.items()}).alias("electrical_characteristics"))


def _numbered(text: Column, pattern: str, name: str, flags: str, most: int = 10) -> Column:
    own = F.slice(F.arrays_zip(all_matches(text, pattern, 1, flags).alias("v"), all_matches(text, pattern, 2, flags).alias("u")), 1, most)
    return F.map_from_entries(F.transform(own, lambda x, i: F.struct(F.concat(F.lit(name), i.cast("string")), F.concat(x["v"], x["u"]))))


def power_facts(text: Column) -> Column:
    """RSP-18."""
    modes = F.concat(*[all_matches(text, p) for p in POWER_MODES])
    return F.struct(F.array_distinct(F.transform(modes, lambda x: F.initcap(F.replace(x, F.lit("_"), F.lit(" "))))).alias("power_modes"), _numbered(text, CURRENTS, "consumption_", PY).alias("power_consumption"))


def ranges(text: Column, compat: bool = True) -> Column:
    """RSP-19: the first temperature range and ten frequencies. compat: "to" is no separator, only its letters are."""
    p = TEMPERATURES if compat else TEMPERATURES_FIXED
    a, b = first_match(text, p, 1, PY), first_match(text, p, 2, PY)
    return F.struct(F.when(a.isNotNull(), F.concat(a, F.lit("°C to "), b, F.lit("°C"))).alias("temperature_range"), _numbered(text, FREQUENCIES, "frequency_", "(?diuU)").alias("frequencies"))


def references(text: Column, most: int = 20) -> Column:
    """RSP-20."""
    one = lambda word: F.slice(F.transform(F.arrays_zip(all_matches(text, word + r"\s*(\d+[-.]?\d*)[:\s]*([^.\n]+)", 1, PY).alias("n"), all_matches(text, word + r"\s*(\d+[-.]?\d*)[:\s]*([^.\n]+)", 2, PY).alias("d")), lambda x: F.struct(x["n"].alias("number"), strip(x["d"]).alias("description"))), 1, most)
    return F.struct(one("[Ff]igure").alias("figures"), one("[Tt]able").alias("tables"))


def record_v2(responses: DataFrame) -> DataFrame:
    """RSP-21: one nested record for each text, first kind."""
    t = F.coalesce("text", F.lit(""))
    parts = {"component_identification": identification(t), "technical_specifications": technical(t), "electrical_specs": electrical(t), "performance_specs": performance(t), "environmental_conditions": environment(t), "interfaces": interfaces(t), "pin_definitions": pins(t), "critical_precautions": precautions(t), "development_guidance": development(t), "register_control": registers(t), "extraction_analysis": limitations(t)}
    return responses.select("source_file", F.lit("2.0.0").alias("analyzer_version"), *[c.alias(k) for k, c in parts.items()])


def record_v3(responses: DataFrame, compat: bool = True) -> DataFrame:
    """RSP-21: one nested record for each text, second kind."""
    t = F.coalesce("text", F.lit(""))
    parts = {"component_identification": part_numbers(t), "pin_specifications": pin_facts(t), "power_management": power_facts(t), "electrical_characteristics": ranges(t, compat), "visual_content_analysis": references(t), "analysis_sections": section_titles(t)}
    return responses.select("source_file", F.lit("3.0.0").alias("analyzer_version"), F.length(t).alias("response_length"), *[c.alias(k) for k, c in parts.items()])


def summary_v3(records: DataFrame) -> DataFrame:
    """RSP-22: (source_file, report) of record_v3 rows; lines without content are left out."""
    c = F.col
    some = lambda label, array, n: F.when(F.size(array) > 0, F.concat(F.lit(label), F.array_join(F.slice(array, 1, n), ", ")))
    count = lambda label, size, what: F.when(size > 0, F.concat(F.lit(label), size.cast("string"), F.lit(what)))
    rows = [
        F.lit("ENHANCED DATASHEET ANALYSIS SUMMARY"),
        some("COMPONENT: ", c("component_identification.part_numbers"), 3),
        some("PACKAGES: ", c("component_identification.package_types"), 100),
        count("PINS: ", c("pin_specifications.total_pin_count"), " total pins"),
        count("ELECTRICAL: ", F.size("pin_specifications.electrical_characteristics"), " specifications extracted"),
        some("POWER MODES: ", c("power_management.power_modes"), 4),
        count("CONSUMPTION: ", F.size("power_management.power_consumption"), " measurements"),
        count("FIGURES ANALYZED: ", F.size("visual_content_analysis.figures"), " diagrams/drawings"),
    ]
    return records.select("source_file", F.array_join(F.array_compact(F.array(*rows)), "\n").alias("report"))


def summary_v2(records: DataFrame) -> DataFrame:
    """RSP-22: (source_file, report) of record_v2 rows: counts and the first five of each list."""
    c = F.col
    top = lambda label, array: F.when(F.size(array) > 0, F.concat(F.lit(label), F.array_join(F.slice(array, 1, 5), "; ")))
    rows = [
        F.concat(F.lit("Component: "), F.when(c("component_identification.component_name") == "", "Not specified").otherwise(c("component_identification.component_name"))),
        F.concat(F.lit("Resolution: "), F.when(c("technical_specifications.resolution") == "", "Not specified").otherwise(c("technical_specifications.resolution"))),
        top("Interfaces: ", c("interfaces.primary_interfaces")),
        F.concat(F.lit("Pins: "), F.size("pin_definitions").cast("string")),
        top("Warnings: ", c("critical_precautions.power_management_warnings")),
        top("Timing: ", c("critical_precautions.timing_constraints")),
        top("Platforms: ", c("development_guidance.supported_platforms")),
    ]
    return records.select("source_file", F.array_join(F.array_compact(F.array(*rows)), "\n").alias("report"))


def batch_outcome(results: DataFrame) -> DataFrame:
    """RSP-23: (successful, total, failed)."""
    ok = F.count_if(F.coalesce("ok", F.lit(False)))
    return results.agg(ok.alias("successful"), F.count("*").alias("total"), (F.count("*") - ok).alias("failed"))
