"""Tables that Spark derives from the given ones for the queries, in SQL that DuckDB reads as well.

``{name}`` stands for a given table, a plain name for a derived one. Schematics are customers, nets their
orders, components parts; datasheets and responses are texts put together from a part's columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DERIVED = {
    # pins of components on nets
    "net_pins": """
SELECT o_custkey AS schematic_id, o_orderkey AS net_no, 'Net_' || CAST(o_orderkey AS STRING) AS net, CAST(l_linenumber AS BIGINT) AS pos, l_partkey AS partkey,
  CASE l_partkey % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'C' WHEN 2 THEN 'U' WHEN 3 THEN 'J' ELSE 'D' END || CAST(l_partkey % 37 + 1 AS STRING) AS reference
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "comps": """
SELECT c.schematic_id, c.partkey AS ordinal, c.reference,
  CASE c.partkey % 11 WHEN 0 THEN '+3V3' WHEN 1 THEN '+5V' WHEN 2 THEN 'GND' WHEN 3 THEN 'USB_C' WHEN 4 THEN 'Qwiic' WHEN 5 THEN 'LED_red' ELSE p_name END AS value,
  CASE c.partkey % 9 WHEN 0 THEN 'Device:R_US' WHEN 1 THEN 'Device:C_Small' WHEN 2 THEN 'Device:LED_Filled' WHEN 3 THEN 'Regulator_Linear:LDO' WHEN 4 THEN 'parts:USBLC6-2SC6'
    WHEN 5 THEN 'Connector_Generic:Conn_01x03' WHEN 6 THEN 'logic:74HC2G34' WHEN 7 THEN 'Device:D_TVS_Filled' ELSE 'power:+5V' END AS library_id,
  p_type AS footprint, CASE WHEN c.partkey % 3 = 0 THEN '' ELSE p_brand END AS mpn, CASE WHEN c.partkey % 4 = 0 THEN p_brand ELSE '' END AS mpn2, CAST(p_size AS STRING) || 'V' AS rating,
  CASE c.partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '~' WHEN 2 THEN 'no url' ELSE 'https://d' || CAST(c.partkey % 7 AS STRING) || '.example.com/ds/' || CAST(c.partkey % 40 AS STRING) || '.pdf' END AS datasheet,
  CAST(c.partkey % 100 AS DOUBLE) AS x, CAST(c.partkey % 50 AS DOUBLE) AS y
FROM (SELECT schematic_id, reference, min(partkey) AS partkey FROM net_pins GROUP BY schematic_id, reference) c JOIN {part} ON p_partkey = c.partkey""",
    # nets with a label each, and the type that it and the name give
    "net_labels": """
SELECT DISTINCT schematic_id, net_no, CASE net_no % 9 WHEN 0 THEN 'VCC_main' WHEN 1 THEN 'GND' WHEN 2 THEN 'USB_DP' WHEN 3 THEN 'clk' ELSE '' END AS label,
  CASE WHEN net_no % 2 = 0 THEN 'hierarchical_label' ELSE 'label' END AS kind,
  CASE net_no % 7 WHEN 0 THEN '+5V_' WHEN 1 THEN 'AGND_' WHEN 2 THEN 'SPI_' ELSE 'n_' END || CAST(net_no AS STRING) AS name
FROM net_pins""",
    "net_types": """
SELECT schematic_id, net_no, name,
  CASE WHEN kind = 'hierarchical_label' AND label = 'VCC_main' THEN 'power' WHEN kind = 'hierarchical_label' AND label = 'GND' THEN 'ground' WHEN kind = 'hierarchical_label' AND label = 'USB_DP' THEN 'interface'
    WHEN net_no % 7 = 0 THEN 'power' WHEN net_no % 7 = 1 THEN 'ground' WHEN net_no % 7 = 2 THEN 'interface' ELSE 'signal' END AS net_type
FROM net_labels""",
    "group_members": """
SELECT schematic_id, name, part, ordinal, reference FROM (
  SELECT schematic_id, 'Power Management' AS name, 0 AS part, ordinal, reference FROM comps WHERE library_id LIKE 'Regulator%'
  UNION ALL SELECT schematic_id, 'USB Interface', 0, ordinal, reference FROM comps WHERE library_id LIKE '%USB%' OR value LIKE '%USB%'
  UNION ALL SELECT schematic_id, 'I2C Interface', 0, ordinal, reference FROM comps WHERE value = 'Qwiic'
  UNION ALL SELECT schematic_id, 'Protection Circuits', 0, ordinal, reference FROM comps WHERE library_id LIKE '%TVS%' OR library_id LIKE '%USBLC%'
  UNION ALL SELECT schematic_id, 'Buffer/Driver Circuits', 0, ordinal, reference FROM comps WHERE library_id LIKE '%74HC%'
  UNION ALL SELECT schematic_id, 'LED Driver Circuits', 0, ordinal, reference FROM comps WHERE library_id LIKE '%LED%' OR value LIKE '%LED%'
  UNION ALL SELECT schematic_id, 'LED Driver Circuits', 1, ordinal, reference FROM comps WHERE library_id LIKE 'Device:R%') g
WHERE name <> 'LED Driver Circuits' OR (
  schematic_id IN (SELECT schematic_id FROM comps WHERE library_id LIKE '%LED%' OR value LIKE '%LED%') AND schematic_id IN (SELECT schematic_id FROM comps WHERE library_id LIKE 'Device:R%'))""",
    "wires": """
SELECT o_custkey AS schematic_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal,
  CAST(o_orderkey % 23 AS DOUBLE) AS x1, CAST(o_orderkey % 7 AS DOUBLE) AS y1, CAST(o_orderkey * 3 % 23 AS DOUBLE) + 0.005 AS x2, CAST(o_orderkey * 5 % 7 AS DOUBLE) AS y2
FROM {orders}""",
    # devices, configurations, permissions
    "devices": """
SELECT c_custkey AS device_id, n_name AS region, c_mktsegment AS customer, 'fw' || CAST(c_custkey % 4 AS STRING) AS firmware_version, c_custkey % 10 AS current_config_id,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS last_updated_at, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal ELSE NULL END AS deleted_at, CASE WHEN c_custkey % 5 = 0 THEN 'someone' ELSE NULL END AS deleted_by
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "role_permissions": """
SELECT role, permission FROM (VALUES ('click', 'read'), ('view', 'read'), ('view', 'list'), ('signup', 'write'), ('purchase', 'pay'), ('purchase', 'read'), ('admin', 'all')) AS t(role, permission)""",
    # a log of fetches
    "fetches": """
SELECT event_id, ts, user_id, 'https://h' || CAST(event_id % 11 AS STRING) || '.example.com/f/' || CAST(event_id % 900 AS STRING) || CASE WHEN event_id % 3 = 0 THEN '.pdf' ELSE '' END AS url,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' WHEN 'view' THEN 'success' ELSE 'skipped' END AS status
FROM {events}""",
    # datasheet texts and the numbers in them
    "sheets": """
SELECT 'p' || CAST(p_partkey AS STRING) AS source_file, p_partkey AS k, CAST(p_size AS BIGINT) AS s,
  CASE WHEN p_partkey % 3 = 0 THEN 'LM-' || CAST(p_partkey + 1000 AS STRING) || ' REG' ELSE 'a fine ' || p_name END || chr(10) ||
  CASE WHEN p_partkey % 3 = 1 THEN 'XR' || CAST(p_partkey AS STRING) || ' Series' ELSE 'no such thing' END || chr(10) ||
  'Pin ' || CAST(p_partkey % 40 AS STRING) || ': VCC - main feed' || chr(10) ||
  'Pin 7: SHD - ' || CASE WHEN p_partkey % 2 = 0 THEN 'an input here' ELSE 'an output there' END || chr(10) ||
  'SCL (SCK): clock signal with high level ' || CAST(p_partkey % 4 + 1 AS STRING) || '.5V and pull-up.' || chr(10) ||
  'pull-up resistor ' || CAST(p_size AS STRING) || '.7 ohm; decoupling capacitor ' || CAST(p_partkey % 90 + 10 AS STRING) || ' nF' || chr(10) ||
  CASE WHEN p_partkey % 2 = 0 THEN 'SPI: CPHL=0, CPOL=' || CAST(p_partkey % 3 AS STRING) || ' (mode ' || CAST(p_partkey % 3 AS STRING) || ')' ELSE 'I2C interface; slave address: 0x3' || CAST(p_partkey % 10 AS STRING) END || chr(10) ||
  'operating range: -' || CAST(p_partkey % 50 AS STRING) || '°C to ' || CAST(p_partkey % 90 + 10 AS STRING) || '°C' || chr(10) ||
  'supply 1.' || CAST(p_partkey % 9 AS STRING) || ' V to 3.' || CAST(p_size % 7 AS STRING) || ' V' || chr(10) ||
  CAST(p_partkey % 300 AS STRING) || ' mA max, ' || CAST(p_size AS STRING) || ' MHz maximum' AS text
FROM {part}""",
    # response texts
    "answers_": """
SELECT 'r' || CAST(p_partkey AS STRING) AS source_file, p_partkey AS k, CAST(p_size AS BIGINT) AS s,
  '# Overview' || chr(10) || 'Component Name: ' || p_name || ' v2' || chr(10) || 'Resolution: ' || CAST(p_partkey % 800 + 100 AS STRING) || ' x ' || CAST(p_size + 100 AS STRING) || ' pixels, 4.' || CAST(p_size % 10 AS STRING) || ' inch' || chr(10) ||
  'Dot pitch: 0.' || CAST(p_size AS STRING) || ' mm x 0.' || CAST(p_size AS STRING) || ' mm' || chr(10) ||
  'Operating voltage: 3.' || CAST(p_size % 4 AS STRING) || 'V' || chr(10) || 'Standby current: ' || CAST(p_size AS STRING) || ' uA' || chr(10) ||
  'Refresh time: ' || CAST(p_size AS STRING) || ' s' || chr(10) || 'Viewing angle: ' || CAST(p_partkey % 180 AS STRING) || ' degrees' || chr(10) ||
  'Working temperature: ' || CAST(p_partkey % 60 AS STRING) || ' C' || chr(10) || 'Storage humidity: ' || CAST(p_size AS STRING) || ' percent' || chr(10) ||
  CASE WHEN p_partkey % 2 = 0 THEN 'Uses SPI with CPHL=0 and CPOL=0, cable of 20cm' ELSE 'Uses I2C at 2.54mm pitch' END || chr(10) ||
  '# Working With Raspberry Pi' || chr(10) || '| pin | platform |' || chr(10) || '|---|---|' || chr(10) || '| Vcc | 3v' || CAST(p_size AS STRING) || ' |' || chr(10) ||
  'BUSY: line ' || CAST(p_partkey AS STRING) || chr(10) || '# Warnings' || chr(10) || 'Minimum refresh interval: ' || CAST(p_size + 100 AS STRING) || ' seconds' || chr(10) ||
  CASE WHEN p_partkey % 3 = 0 THEN 'Never leave the power on for ' || CAST(p_partkey AS STRING) || ' hours' ELSE 'The screen is fragile' END || chr(10) ||
  'Library: wiringpi and spidev at https://github.com/x/r' || CAST(p_partkey AS STRING) || chr(10) || 'Register 0x' || CAST(p_partkey % 90 + 10 AS STRING) || ' then 0x' || CAST(p_size AS STRING) || 'F' || chr(10) ||
  'Cannot read the block diagrams on page ' || CAST(p_size AS STRING) || chr(10) ||
  'Section 1: Intro' || chr(10) || 'Part AB' || CAST(p_partkey % 90 + 10 AS STRING) || 'X in QFN ' || CAST(p_size AS STRING) || 'x5, ' || CAST(p_size AS STRING) || ' pins, VIH: 2.' || CAST(p_size % 9 AS STRING) || ' V' || chr(10) ||
  'Deep_sleep mode at ' || CAST(p_size AS STRING) || ' mA and 1' || CAST(p_size AS STRING) || ' MHz' || chr(10) || '-' || CAST(p_size AS STRING) || ' °C - 8' || CAST(p_size % 10 AS STRING) || ' °C' || chr(10) ||
  'Figure 2: The layout of ' || p_name || '. Table 3: Limits of ' || p_name || '.' AS text
FROM {part}""",
}


#: Derived tables whose texts are far longer than the rows that they are made of, with the table and key of these. A file of such rows is
#: one split or two, however long the texts, so the rows are dealt over the tasks first.
SPREAD = {"sheets": ("part", "p_partkey"), "answers_": ("part", "p_partkey")}


def needed(names: list[str]) -> list[str]:
    """The derived tables with those that they read, in an order that defines each before its use."""
    out: list[str] = []

    def add(name: str) -> None:
        for other in DERIVED:
            if other != name and re.search(rf"\b{other}\b", DERIVED[name]):
                add(other)
        if name not in out:
            out.append(name)

    for n in names:
        add(n)
    return out


def with_derived(sql: str, recursive: bool = False) -> str:
    """DuckDB SQL with the derived tables that it names as common table expressions, on given tables by their names."""
    names = needed([n for n in DERIVED if re.search(rf"\b{n}\b", sql)])
    ctes = ",\n".join(f"{n} AS ({DERIVED[n]})" for n in names)
    more = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    body = sql[more.end() :] if more else sql
    head = "WITH RECURSIVE " if recursive or more and more[1] else "WITH "
    out = f"{head}{ctes}{',' if more and ctes else ''}\n{body}" if ctes else sql
    return re.sub(r"\{(" + "|".join(GIVEN) + r")\}", r"\1", out)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df dealt over all tasks by keys: as many as a shuffle has, and one for each core at least; few bytes do not make them fewer."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    names = needed([name])
    sql = "WITH " + ",\n".join(f"{n} AS ({DERIVED[n]})" for n in names) + f"\nSELECT * FROM {name}"
    used = {t: given(spark, sf_dir, t) for t in GIVEN if f"{{{t}}}" in sql}
    if name in SPREAD:
        table, key = SPREAD[name]
        used[table] = spread(used[table], key)
    return spark.sql(sql, **used)
