"""Circuit enrichment and datasheet links (CIR-1 to CIR-12, LNK-1 to LNK-6).

Documents are rows: title_block map<string,string>, properties map<string,string> and so on; missing
values read as empty strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ohmlake.functions.columns import has_any, keep_first, netloc, ordered, strip, valid_url

# What a library symbol is called.
DESCRIPTIONS = {
    "power:+5V": "5V power supply rail",
    "power:+3V3": "3.3V power supply rail",
    "power:GND": "Ground reference",
    "Device:R_US": "Resistor (US symbol)",
    "Device:C_Small": "Small capacitor",
    "Device:LED_Filled": "Light Emitting Diode",
    "Device:D_TVS_Filled": "Transient Voltage Suppressor diode",
    "Device:D_Schottky_Filled": "Schottky diode",
    "winterbloom:74HC2G34": "Dual buffer gate IC with Schmitt trigger inputs",
    "winterbloom:USBLC6-2SC6": "USB ESD protection IC",
    "winterbloom:USB_B_Receptacle": "USB Type B connector",
    "Connector_Generic:Conn_01x03": "3-pin connector",
    "Connector_Generic:Conn_01x04": "4-pin connector",
}

# Net types with words in labels and words in names, in the order they are tried.
NET_TYPES = [
    ("power", ["power", "vcc", "vdd", "+5v", "+3v3"], ["power", "vcc", "vdd", "+5v", "+3v3"]),
    ("ground", ["gnd", "ground", "vss"], ["gnd", "ground"]),
    ("interface", ["usb", "sda", "scl", "data"], ["usb", "sda", "scl", "uart", "spi"]),
]

# Name, function, description of functional groups.
GROUPS = {
    "Power Management": ("power_regulation", "Voltage regulation and power distribution"),
    "USB Interface": ("usb_interface", "USB communication interface"),
    "I2C Interface": ("i2c_interface", "I2C/Qwiic communication interface"),
    "Protection Circuits": ("esd_protection", "ESD and overvoltage protection"),
    "Buffer/Driver Circuits": ("signal_buffering", "Signal buffering and level conversion"),
    "LED Driver Circuits": ("led_driving", "LED current limiting and control"),
}

# Library words of connectors and of protection parts, in lower case.
CONNECTORS = ["conn_", "usb_", "jst"]
PROTECTION = ["tvs", "esd", "usblc", "d_schottky"]


def _at(column: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(column), F.lit(key)), F.lit(""))


def metadata_record(documents: DataFrame) -> DataFrame:
    """CIR-1: from title_block, generator, original_filename and parsed_date; annotations pass through."""
    return documents.select(
        "schematic_id", _at("title_block", "title").alias("title"), _at("title_block", "company").alias("company"), _at("title_block", "rev").alias("revision"), _at("title_block", "date").alias("date"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("generator", "original_filename", "parsed_date")],
        *(["annotations"] if "annotations" in documents.columns else []),
    )


def describe(library_id: Column, value: Column) -> Column:
    """CIR-3: what a component is, by library symbol, else by value. The table is a constant, so a literal map."""
    table = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, library_id), F.concat(F.lit("Electronic component: "), F.coalesce(value, F.lit(""))))


def component_records(components: DataFrame) -> DataFrame:
    """CIR-2: datasheet, mpn, rating and description from properties. library_id: a name, or a pair of which the second counts."""
    library = F.get("library_id", F.lit(1)) if components.schema["library_id"].dataType.typeName() == "array" else F.coalesce("library_id", F.lit(""))
    out = components.withColumns({
        "library_id": F.coalesce(library, F.lit("")),
        "datasheet": _at("properties", "Datasheet"),
        "mpn": F.when(_at("properties", "mpn") != "", _at("properties", "mpn")).otherwise(_at("properties", "MPN")),
        "rating": _at("properties", "Rating"),
    })
    return out.withColumn("description", describe(F.col("library_id"), F.col("value")))


def net_components(pins: Column) -> Column:
    """CIR-4: references in pin order, repeats kept."""
    return F.transform(pins, lambda p: p["ref"])


def connection_points(wires: Column) -> Column:
    """CIR-5: start and end of each wire."""
    return F.transform(wires, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end")))


def net_type(name: Column, labels: Column) -> Column:
    """CIR-6: by the first hierarchical label (type, text) that says, else by name, else signal."""
    kind = lambda text, i: reduce(lambda c, t: c.when(has_any(text, t[i]), t[0]), NET_TYPES[1:], F.when(has_any(text, NET_TYPES[0][i]), NET_TYPES[0][0]))
    said = F.transform(F.filter(labels, lambda x: x["type"] == "hierarchical_label"), lambda x: kind(F.lower(F.coalesce(x["text"], F.lit(""))), 1))
    return F.coalesce(F.get(F.filter(said, lambda x: x.isNotNull()), F.lit(0)), kind(F.lower(name), 2), F.lit("signal"))


def functional_groups(components: DataFrame) -> DataFrame:
    """CIR-7: (schematic_id, name, function, description, components) by six rules, components in ordinal order.

    One pass: a component gives a row for each rule that it meets; LED groups need LEDs and resistors and
    list the LEDs first.
    """
    lib, value = F.coalesce("library_id", F.lit("")), F.coalesce("value", F.lit(""))
    led, resistor = lib.contains("LED") | value.contains("LED"), lib.startswith("Device:R")
    rules = [
        ("Power Management", has_any(F.lower(lib), ["regulator", "converter"]), 0),
        ("USB Interface", lib.contains("USB") | value.contains("USB"), 0),
        ("I2C Interface", has_any(value, ["Qwiic", "I2C"]), 0),
        ("Protection Circuits", has_any(lib, ["TVS", "ESD", "USBLC"]), 0),
        ("Buffer/Driver Circuits", lib.contains("74HC"), 0),
        ("LED Driver Circuits", led, 0),
        ("LED Driver Circuits", resistor, 1),
    ]
    met = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(name).alias("name"), F.lit(part).alias("part"))) for name, rule, part in rules]))
    rows = components.select("schematic_id", "ordinal", "reference", F.explode(met).alias("g")).select("*", "g.name", "g.part")
    both = (F.col("name") != "LED Driver Circuits") | (F.array_size("parts") == 2)
    out = rows.groupBy("schematic_id", "name").agg(ordered(F.struct("part", "ordinal", "reference"), "reference").alias("components"), F.collect_set("part").alias("parts")).where(both).drop("parts")
    facts = F.create_map(*[x for n, (f, d) in GROUPS.items() for x in (F.lit(n), F.struct(F.lit(f).alias("f"), F.lit(d).alias("d")))])
    return out.select("schematic_id", "name", facts[F.col("name")]["f"].alias("function"), facts[F.col("name")]["d"].alias("description"), "components")


def power_rails(nets: DataFrame) -> DataFrame:
    """CIR-8: (schematic_id, power_rails): names of power and ground nets in ordinal order."""
    return nets.where(F.col("net_type").isin("power", "ground")).groupBy("schematic_id").agg(ordered(F.struct("ordinal", "name"), "name").alias("power_rails"))


def named_parts(components: DataFrame, words: list[str], out: str) -> DataFrame:
    """CIR-9, CIR-10: (schematic_id, out): "reference: value" of parts whose library id has one of the words."""
    found = components.where(has_any(F.lower(F.coalesce("library_id", F.lit(""))), words)).withColumn("_text", F.concat("reference", F.lit(": "), F.coalesce("value", F.lit(""))))
    return found.groupBy("schematic_id").agg(ordered(F.struct("ordinal", "_text"), "_text").alias(out))


def interface_connectors(components: DataFrame) -> DataFrame:
    return named_parts(components, CONNECTORS, "interface_connectors")


def protection_circuits(components: DataFrame) -> DataFrame:
    return named_parts(components, PROTECTION, "protection_circuits")


def analysis(documents: DataFrame, components: DataFrame, nets: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """CIR-11: one wide row for each document with counts, groups, rails, connectors and protection parts. groups: those of ``functional_groups``, if they are made."""
    none = F.array().cast("array<string>")
    groups = (functional_groups(components) if groups is None else groups).groupBy("schematic_id").agg(F.sort_array(F.collect_list("name")).alias("functional_groups"))
    out = documents
    for table in (components.groupBy("schematic_id").agg(F.count("*").alias("n_components")), nets.groupBy("schematic_id").agg(F.count("*").alias("n_nets")), groups, power_rails(nets), interface_connectors(components), protection_circuits(components)):
        out = out.join(table.hint("merge"), "schematic_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_components", "n_nets")} | {c: F.coalesce(c, none) for c in ("functional_groups", "power_rails", "interface_connectors", "protection_circuits")})


def retrieval_documents(overview: DataFrame, components: DataFrame, groups: DataFrame, nets: DataFrame) -> DataFrame:
    """CIR-12: (schematic_id, type, key, content) for circuits, components, groups, and nets of more than one component."""
    text = lambda *parts: F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    comma = lambda c: F.array_join(c, ", ")
    row = lambda df, kind, key, content: df.select("schematic_id", F.lit(kind).alias("type"), F.col(key).cast("string").alias("key"), content.alias("content"))
    c = F.col
    return (
        row(overview, "circuit_overview", "schematic_id", text("Circuit: ", c("title"), " by ", c("company"), "\nComponents: ", c("n_components"), " total components\nNetworks: ", c("n_nets"), " connections\nFunctional Groups: ", comma("functional_groups"), "\nPower Rails: ", comma("power_rails"), "\nInterfaces: ", comma("interface_connectors")))
        .unionByName(row(components, "component", "reference", text("Component ", c("reference"), ": ", c("value"), "\nType: ", c("description"), "\nFootprint: ", c("footprint"), "\nRating: ", c("rating"), "\nPart Number: ", c("mpn"), "\nPosition: x=", c("x"), ", y=", c("y"))))
        .unionByName(row(groups, "functional_group", "name", text("Functional Group: ", c("name"), "\nFunction: ", c("function"), "\nDescription: ", c("description"), "\nComponents: ", comma("components"))))
        .unionByName(row(nets.where(F.size("connected_components") > 1), "network", "name", text("Network: ", c("name"), "\nType: ", c("net_type"), "\nConnected Components: ", comma("connected_components"))))
    )


# ---------------------------------------------------------------- datasheet links


def library_links(symbols: DataFrame) -> DataFrame:
    """LNK-1: links of library symbols (schematic_id, ordinal, symbol_id, properties)."""
    return _links(symbols, F.col("symbol_id"), F.col("symbol_id"), _at("properties", "Value"), _at("properties", "MPN"), 0)


def component_links(components: DataFrame) -> DataFrame:
    """LNK-2: links of components (schematic_id, ordinal, reference, value, properties)."""
    mpn = F.when(_at("properties", "mpn") != "", _at("properties", "mpn")).otherwise(_at("properties", "MPN"))
    return _links(components, F.coalesce("value", "reference"), F.col("reference"), F.coalesce("value", F.lit("")), mpn, 1)


def _links(df: DataFrame, name: Column, reference: Column, value: Column, mpn: Column, rank: int) -> DataFrame:
    url = strip(_at("properties", "Datasheet"))
    return df.where(valid_url(url)).select("schematic_id", F.lit(rank).alias("src_rank"), "ordinal", name.alias("component_name"), reference.alias("component_reference"), value.alias("component_value"), url.alias("datasheet_url"), mpn.alias("mpn"))


def unique_links(symbols: DataFrame, components: DataFrame) -> DataFrame:
    """LNK-4: all links of a circuit, the first of each URL, library symbols before components."""
    every = library_links(symbols).unionByName(component_links(components))
    return keep_first(every, ["schematic_id", "datasheet_url"], ["src_rank", "ordinal", "component_reference"])


def link_messages(documents: DataFrame, links: DataFrame) -> DataFrame:
    """LNK-5, LNK-6: for each document a count, its links with domains in order, circuit info and a result record.

    documents: (schematic_id, title_block map, error string or null). A document with an error has failed.
    """
    entry = F.struct("src_rank", "ordinal", F.struct("component_name", "component_reference", "component_value", "datasheet_url", "mpn", netloc(F.col("datasheet_url")).alias("domain")).alias("entry"))
    found = links.groupBy("schematic_id").agg(F.count("*").alias("n"), ordered(entry, "entry").alias("datasheets"))
    unknown = lambda k: F.coalesce(F.try_element_at("title_block", F.lit(k)), F.lit("Unknown"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    failed = F.col("error").isNotNull()
    return documents.join(found, "schematic_id", "left").select(
        "schematic_id",
        F.struct(unknown("title").alias("title"), unknown("company").alias("company"), unknown("rev").alias("revision"), unknown("date").alias("date")).alias("circuit_info"),
        n.alias("datasheet_count"),
        "datasheets",
        F.when(failed, 500).otherwise(200).alias("status_code"),
        (~failed).alias("success"),
        F.when(failed, F.concat(F.lit("Processing error: "), "error")).when(n == 0, "No datasheets found").otherwise(F.concat(F.lit("Processed "), n.cast("string"), F.lit(" datasheets"))).alias("message"),
    )


def running(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
