"""Queries of the graph, circuit, link, net, vector and registry operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ohmlake.functions.columns import ordered, unit_suffix, uuid_bytes, uuid_text
from ohmlake.operators import board as B, circuit as C, graph as G, nets as N, project as P, registry as R, vectors as V
from ohmlake.plans import buckets
from ohmlake.plans.components import connected_components
from ohmlake.plans.grid import near
from ohmlake.plans.storage import fresh_folder, stored

from .base import derived, given

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def nets(spark, d) -> DataFrame:
    """(schematic_id, name, connected_components): the references on a net in pin order."""
    return derived(spark, d, "net_pins").groupBy("schematic_id", F.col("net").alias("name")).agg(ordered(F.struct("pos", "partkey", "reference"), "reference").alias("connected_components"))


def comps(spark, d) -> DataFrame:
    return derived(spark, d, "comps")


def properties(df: DataFrame) -> DataFrame:
    """Components with a properties map, as documents have them."""
    pairs = {"Datasheet": "datasheet", "mpn": "mpn", "MPN": "mpn2", "Rating": "rating", "Value": "value"}
    return df.withColumn("properties", F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), F.col(c))])).drop("datasheet", "mpn", "mpn2", "rating")


# ---------------------------------------------------------------- graph

JS = "(SELECT DISTINCT schematic_id, reference FROM net_pins WHERE reference LIKE 'J%')"


def connectors(spark, d) -> DataFrame:
    return comps(spark, d).where("reference like 'J%'").select("schematic_id", "reference")


@query("gq1_nets_for_component", "SELECT DISTINCT schematic_id, reference, net FROM net_pins WHERE reference LIKE 'J%'")
def _(spark, d):
    return G.nets_for_component(nets(spark, d), connectors(spark, d))


@query("gq2_components_on_net", "SELECT DISTINCT p.schematic_id, p.net, p.reference, c.value FROM net_pins p JOIN comps c ON p.schematic_id = c.schematic_id AND p.reference = c.reference")
def _(spark, d):
    return G.components_on_net(nets(spark, d), comps(spark, d)).select("schematic_id", "net", "reference", "value")


@query("gq3_groups_touching_net", "SELECT DISTINCT p.schematic_id, p.net, g.name FROM net_pins p JOIN group_members g ON p.schematic_id = g.schematic_id AND p.reference = g.reference")
def _(spark, d):
    return G.groups_touching_net(nets(spark, d), C.functional_groups(comps(spark, d)))


@query("gq4_nets_for_resistor", "SELECT DISTINCT schematic_id, reference, net FROM net_pins WHERE reference LIKE 'R%'")
def _(spark, d):
    return G.nets_for_component(nets(spark, d), comps(spark, d).where("reference like 'R%'"))


@query("gq5_rails_on_net", "SELECT DISTINCT p.schematic_id, p.net, p.reference, c.value FROM net_pins p JOIN comps c ON p.schematic_id = c.schematic_id AND p.reference = c.reference WHERE c.value IN ('+3V3', '+5V', 'GND')")
def _(spark, d):
    return G.rails_on_net(nets(spark, d), comps(spark, d))


FACTS = """facts AS (
  SELECT p.schematic_id, p.net, bool_or(p.reference LIKE 'R%') AS r, bool_or(p.reference LIKE 'C%') AS c, bool_or(c.value = 'GND') AS g
  FROM net_pins p JOIN comps c ON p.schematic_id = c.schematic_id AND p.reference = c.reference GROUP BY ALL)"""


@query("gq6_filters_near_component", f"WITH {FACTS} SELECT DISTINCT p.schematic_id, p.reference, p.net FROM net_pins p JOIN facts f ON p.schematic_id = f.schematic_id AND p.net = f.net WHERE p.reference LIKE 'J%' AND f.c AND (f.r OR f.g)")
def _(spark, d):
    return G.filters_near_component(nets(spark, d), comps(spark, d), connectors(spark, d))


VOLTS = """on_r AS (SELECT DISTINCT schematic_id, net, reference FROM net_pins WHERE reference LIKE 'R%'),
volt AS (SELECT DISTINCT p.schematic_id, p.net, c.value FROM net_pins p JOIN comps c ON p.schematic_id = c.schematic_id AND p.reference = c.reference WHERE c.value IN ('+3V3', '+5V')),
hit AS (
  SELECT DISTINCT k.schematic_id, k.reference, v.value FROM net_pins k JOIN on_r a ON k.schematic_id = a.schematic_id AND k.net = a.net
  JOIN on_r b ON a.schematic_id = b.schematic_id AND a.reference = b.reference JOIN volt v ON b.schematic_id = v.schematic_id AND b.net = v.net WHERE k.reference LIKE 'J%')"""


@query("gq7_pull_up_voltages", f"WITH {VOLTS} SELECT k.schematic_id, k.reference, coalesce(string_agg(h.value, ',' ORDER BY h.value), '') AS voltages FROM {JS} k LEFT JOIN hit h ON k.schematic_id = h.schematic_id AND k.reference = h.reference GROUP BY ALL")
def _(spark, d):
    found = G.pull_up_voltages(nets(spark, d), comps(spark, d), connectors(spark, d))
    return found.withColumn("voltages", F.array_join("voltages", ","))


QUESTION = "CASE ordinal % 4 WHEN 0 THEN 'Is there a filter near ' || reference || '?' WHEN 1 THEN 'Which pull-up voltage at pin 12 of ' || reference WHEN 2 THEN 'voltage and FILTER of ' || reference ELSE 'what does ' || reference || ' do' END"


def questions(spark, d) -> DataFrame:
    return comps(spark, d).where("reference like 'J%'").select("schematic_id", F.concat(F.col("schematic_id").cast("string"), F.lit("/"), "reference").alias("question_id"), F.expr(QUESTION).alias("question"))


@query("gq8_question_routing", f"""
SELECT schematic_id || '/' || reference AS question_id, reference AS refs, CASE WHEN ordinal % 4 = 1 THEN '12' END AS pin,
  CASE ordinal % 4 WHEN 0 THEN 'filter' WHEN 1 THEN 'voltage' WHEN 2 THEN 'both' ELSE 'semantic' END AS route FROM comps WHERE reference LIKE 'J%'""")
def _(spark, d):
    return G.routed(questions(spark, d)).select("question_id", F.array_join("refs", ",").alias("refs"), "pin", "route")


@query("gq8_question_answers", f"""
WITH {FACTS}, {VOLTS},
q AS (SELECT schematic_id, reference, schematic_id || '/' || reference AS question_id, ordinal % 4 AS r FROM comps WHERE reference LIKE 'J%')
SELECT q.question_id, q.schematic_id, q.reference, 'filter' AS kind, coalesce(string_agg(DISTINCT f.net, ',' ORDER BY f.net), '') AS answer
FROM q LEFT JOIN (SELECT p.schematic_id, p.reference, p.net FROM net_pins p JOIN facts f ON p.schematic_id = f.schematic_id AND p.net = f.net WHERE f.c AND (f.r OR f.g)) f
  ON q.schematic_id = f.schematic_id AND q.reference = f.reference WHERE q.r IN (0, 2) GROUP BY ALL
UNION ALL SELECT q.question_id, q.schematic_id, q.reference, 'voltage', coalesce(string_agg(h.value, ',' ORDER BY h.value), '') FROM q LEFT JOIN hit h ON q.schematic_id = h.schematic_id AND q.reference = h.reference WHERE q.r IN (1, 2) GROUP BY ALL""")
def _(spark, d):
    return G.answers(questions(spark, d), nets(spark, d), comps(spark, d))


# ---------------------------------------------------------------- circuits


def typed_nets(spark, d) -> DataFrame:
    """Nets with labels, types by CIR-6, and connected components."""
    own = derived(spark, d, "net_labels").withColumn("labels", F.array(F.struct(F.col("kind").alias("type"), F.col("label").alias("text"))))
    own = own.withColumn("net_type", C.net_type(F.col("name"), F.col("labels")))
    refs = derived(spark, d, "net_pins").groupBy("schematic_id", "net_no").agg(ordered(F.struct("pos", "partkey", "reference"), "reference").alias("connected_components"))
    return own.join(refs, ["schematic_id", "net_no"]).withColumnRenamed("net_no", "ordinal")


@query("cir1_metadata", "SELECT c_custkey AS schematic_id, c_name AS title, '' AS company, c_mktsegment AS revision, '' AS date, 'gen' AS generator, c_name || '.sch' AS original_filename, '' AS parsed_date FROM customer")
def _(spark, d):
    docs = given(spark, d, "customer").select(F.col("c_custkey").alias("schematic_id"), F.create_map(F.lit("title"), "c_name", F.lit("rev"), "c_mktsegment").alias("title_block"), F.lit("gen").alias("generator"), F.concat("c_name", F.lit(".sch")).alias("original_filename"), F.lit(None).cast("string").alias("parsed_date"))
    return C.metadata_record(docs)


DESCRIBED = "CASE library_id WHEN 'Device:R_US' THEN 'Resistor (US symbol)' WHEN 'Device:C_Small' THEN 'Small capacitor' WHEN 'Device:LED_Filled' THEN 'Light Emitting Diode' WHEN 'Device:D_TVS_Filled' THEN 'Transient Voltage Suppressor diode' WHEN 'power:+5V' THEN '5V power supply rail' WHEN 'Connector_Generic:Conn_01x03' THEN '3-pin connector' ELSE 'Electronic component: ' || value END"


@query("cir2_component_records", "SELECT schematic_id, reference, value, library_id, datasheet, CASE WHEN mpn <> '' THEN mpn ELSE mpn2 END AS mpn, rating FROM comps")
def _(spark, d):
    return C.component_records(properties(comps(spark, d))).select("schematic_id", "reference", "value", "library_id", "datasheet", "mpn", "rating")


@query("cir3_descriptions", f"SELECT schematic_id, reference, {DESCRIBED} AS description FROM comps")
def _(spark, d):
    return comps(spark, d).select("schematic_id", "reference", C.describe(F.col("library_id"), F.col("value")).alias("description"))


@query("cir4_connected_components", "SELECT schematic_id, net_no, string_agg(reference, ',' ORDER BY pos, partkey, reference) AS components FROM net_pins GROUP BY ALL")
def _(spark, d):
    pins = derived(spark, d, "net_pins").groupBy("schematic_id", "net_no").agg(F.array_sort(F.collect_list(F.struct("pos", "partkey", F.col("reference").alias("ref")))).alias("pins"))
    return pins.select("schematic_id", "net_no", F.array_join(C.net_components(F.col("pins")), ",").alias("components"))


@query("cir5_connection_points", "SELECT schematic_id, count(*) AS n_points, sum(x1) AS start_x, sum(y2) AS end_y FROM wires GROUP BY ALL")
def _(spark, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    own = derived(spark, d, "wires").groupBy("schematic_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", p("x1", "y1").alias("start"), p("x2", "y2").alias("end")))).alias("w"))
    own = own.withColumn("p", C.connection_points(F.col("w")))
    total = lambda end, c: F.aggregate("p", F.lit(0.0), lambda s, x: s + x[end][c])
    return own.select("schematic_id", F.size("p").cast("long").alias("n_points"), total("start", "x").alias("start_x"), total("end", "y").alias("end_y"))


@query("cir6_net_types", "SELECT schematic_id, net_no, net_type FROM net_types")
def _(spark, d):
    return typed_nets(spark, d).select("schematic_id", F.col("ordinal").alias("net_no"), "net_type")


@query("cir7_functional_groups", "SELECT schematic_id, name, string_agg(reference, ',' ORDER BY part, ordinal, reference) AS components FROM group_members GROUP BY ALL")
def _(spark, d):
    return C.functional_groups(comps(spark, d)).select("schematic_id", "name", F.array_join("components", ",").alias("components"))


@query("cir8_power_rails", "SELECT schematic_id, string_agg(name, ',' ORDER BY net_no) AS power_rails FROM net_types WHERE net_type IN ('power', 'ground') GROUP BY ALL")
def _(spark, d):
    return C.power_rails(typed_nets(spark, d)).withColumn("power_rails", F.array_join("power_rails", ","))


@query("cir9_interface_connectors", "SELECT schematic_id, string_agg(reference || ': ' || value, ',' ORDER BY ordinal) AS interface_connectors FROM comps WHERE lower(library_id) LIKE '%conn\\_%' ESCAPE '\\' GROUP BY ALL")
def _(spark, d):
    return C.interface_connectors(comps(spark, d)).withColumn("interface_connectors", F.array_join("interface_connectors", ","))


@query("cir10_protection_circuits", "SELECT schematic_id, string_agg(reference || ': ' || value, ',' ORDER BY ordinal) AS protection_circuits FROM comps WHERE lower(library_id) LIKE '%tvs%' OR lower(library_id) LIKE '%usblc%' GROUP BY ALL")
def _(spark, d):
    return C.protection_circuits(comps(spark, d)).withColumn("protection_circuits", F.array_join("protection_circuits", ","))


def titled(spark, d) -> DataFrame:
    return given(spark, d, "customer").select(F.col("c_custkey").alias("schematic_id"), F.col("c_name").alias("title"), F.lit("us").alias("company"))


@query("cir11_analysis", """
SELECT c_custkey AS schematic_id, coalesce(nc, 0)::BIGINT AS n_components, coalesce(nn, 0)::BIGINT AS n_nets, coalesce(g.names, '') AS functional_groups, coalesce(r.names, '') AS power_rails
FROM customer LEFT JOIN (SELECT schematic_id, count(*) AS nc FROM comps GROUP BY ALL) a ON a.schematic_id = c_custkey
LEFT JOIN (SELECT schematic_id, count(*) AS nn FROM net_types GROUP BY ALL) b ON b.schematic_id = c_custkey
LEFT JOIN (SELECT schematic_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM group_members GROUP BY ALL) g ON g.schematic_id = c_custkey
LEFT JOIN (SELECT schematic_id, string_agg(name, ',' ORDER BY net_no) AS names FROM net_types WHERE net_type IN ('power', 'ground') GROUP BY ALL) r ON r.schematic_id = c_custkey""")
def _(spark, d):
    found = C.analysis(titled(spark, d), comps(spark, d), typed_nets(spark, d))
    return found.select("schematic_id", "n_components", "n_nets", F.array_join("functional_groups", ",").alias("functional_groups"), F.array_join("power_rails", ",").alias("power_rails"))


def retrieved(spark, d) -> DataFrame:
    """Components, groups and nets are read for several kinds of documents, so each is made once and stored."""
    c = stored(C.component_records(properties(comps(spark, d))).drop("properties"), "components")
    n = stored(typed_nets(spark, d).drop("labels"), "nets")
    g = stored(C.functional_groups(c), "groups")
    return C.retrieval_documents(C.analysis(titled(spark, d), c, n, g), c, g, n)


GROUP_AND_NET_DOCUMENTS = """
SELECT schematic_id, 'functional_group' AS type, name AS key, 'Functional Group: ' || name || chr(10) || 'Function: ' || CASE name WHEN 'Power Management' THEN 'power_regulation' WHEN 'USB Interface' THEN 'usb_interface' WHEN 'I2C Interface' THEN 'i2c_interface' WHEN 'Protection Circuits' THEN 'esd_protection' WHEN 'Buffer/Driver Circuits' THEN 'signal_buffering' ELSE 'led_driving' END
  || chr(10) || 'Description: ' || CASE name WHEN 'Power Management' THEN 'Voltage regulation and power distribution' WHEN 'USB Interface' THEN 'USB communication interface' WHEN 'I2C Interface' THEN 'I2C/Qwiic communication interface' WHEN 'Protection Circuits' THEN 'ESD and overvoltage protection' WHEN 'Buffer/Driver Circuits' THEN 'Signal buffering and level conversion' ELSE 'LED current limiting and control' END
  || chr(10) || 'Components: ' || string_agg(reference, ', ' ORDER BY part, ordinal, reference) AS content FROM group_members GROUP BY schematic_id, name
UNION ALL SELECT t.schematic_id, 'network', t.name, 'Network: ' || t.name || chr(10) || 'Type: ' || t.net_type || chr(10) || 'Connected Components: ' || string_agg(p.reference, ', ' ORDER BY p.pos, p.partkey, p.reference)
  FROM net_types t JOIN net_pins p ON t.schematic_id = p.schematic_id AND t.net_no = p.net_no GROUP BY t.schematic_id, t.name, t.net_type, t.net_no HAVING count(*) > 1"""


@query("cir12_retrieval_documents", GROUP_AND_NET_DOCUMENTS)
def _(spark, d):
    return retrieved(spark, d).where("type in ('functional_group', 'network')")


@query("cir12_all_documents", f"""
SELECT c_custkey AS schematic_id, 'circuit_overview' AS type, c_custkey::VARCHAR AS key, 'Circuit: ' || c_name || ' by us' || chr(10) || 'Components: ' || coalesce(nc, 0) || ' total components' || chr(10) || 'Networks: ' || coalesce(nn, 0) || ' connections'
  || chr(10) || 'Functional Groups: ' || coalesce(g.names, '') || chr(10) || 'Power Rails: ' || coalesce(r.names, '') || chr(10) || 'Interfaces: ' || coalesce(i.names, '') AS content
FROM customer LEFT JOIN (SELECT schematic_id, count(*) AS nc FROM comps GROUP BY ALL) a ON a.schematic_id = c_custkey
LEFT JOIN (SELECT schematic_id, count(*) AS nn FROM net_types GROUP BY ALL) b ON b.schematic_id = c_custkey
LEFT JOIN (SELECT schematic_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM group_members GROUP BY ALL) g ON g.schematic_id = c_custkey
LEFT JOIN (SELECT schematic_id, string_agg(name, ', ' ORDER BY net_no) AS names FROM net_types WHERE net_type IN ('power', 'ground') GROUP BY ALL) r ON r.schematic_id = c_custkey
LEFT JOIN (SELECT schematic_id, string_agg(reference || ': ' || value, ', ' ORDER BY ordinal) AS names FROM comps WHERE lower(library_id) LIKE '%conn\\_%' ESCAPE '\\' GROUP BY ALL) i ON i.schematic_id = c_custkey
UNION ALL SELECT schematic_id, 'component', reference, 'Component ' || reference || ': ' || value || chr(10) || 'Type: ' || {DESCRIBED} || chr(10) || 'Footprint: ' || footprint || chr(10) || 'Rating: ' || rating || chr(10)
  || 'Part Number: ' || CASE WHEN mpn <> '' THEN mpn ELSE mpn2 END || chr(10) || 'Position: x=' || x || ', y=' || y FROM comps
UNION ALL {GROUP_AND_NET_DOCUMENTS}""")
def _(spark, d):
    return retrieved(spark, d)


# ---------------------------------------------------------------- links

URLS = """l AS (
  SELECT schematic_id, 0 AS src, ordinal, 'sym' || ordinal AS name, 'sym' || ordinal AS ref, value, datasheet AS url, mpn2 AS mpn FROM comps WHERE datasheet LIKE 'https://%' AND ordinal % 2 = 0
  UNION ALL SELECT schematic_id, 1, ordinal, value, reference, value, datasheet, CASE WHEN mpn <> '' THEN mpn ELSE mpn2 END FROM comps WHERE datasheet LIKE 'https://%'),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY schematic_id, url ORDER BY src, ordinal, ref) AS i FROM l) WHERE i = 1)"""


def symbols(spark, d) -> DataFrame:
    return properties(comps(spark, d).where("ordinal % 2 = 0")).withColumn("symbol_id", F.concat(F.lit("sym"), F.col("ordinal").cast("string")))


@query("lnk1_library_links", f"WITH {URLS} SELECT schematic_id, name AS component_name, value AS component_value, url AS datasheet_url, mpn FROM l WHERE src = 0")
def _(spark, d):
    return C.library_links(symbols(spark, d)).select("schematic_id", "component_name", "component_value", "datasheet_url", "mpn")


@query("lnk2_component_links", f"WITH {URLS} SELECT schematic_id, name AS component_name, ref AS component_reference, url AS datasheet_url, mpn FROM l WHERE src = 1")
def _(spark, d):
    return C.component_links(properties(comps(spark, d))).select("schematic_id", "component_name", "component_reference", "datasheet_url", "mpn")


@query("lnk3_valid_urls", "SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS valid, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages")
def _(spark, d):
    return given(spark, d, "pages").select("page_id", C.valid_url(F.col("url")).alias("valid"), C.netloc(F.col("url")).alias("host"))


@query("lnk4_unique_links", f"WITH {URLS} SELECT schematic_id, src AS src_rank, ordinal, name AS component_name, url AS datasheet_url FROM u")
def _(spark, d):
    return C.unique_links(symbols(spark, d), properties(comps(spark, d))).select("schematic_id", "src_rank", "ordinal", "component_name", "datasheet_url")


def messages(spark, d) -> DataFrame:
    docs = given(spark, d, "customer").select(F.col("c_custkey").alias("schematic_id"), F.create_map(F.lit("title"), "c_name").alias("title_block"), F.when(F.col("c_custkey") % 50 == 0, "broken").alias("error"))
    return C.link_messages(docs, C.unique_links(symbols(spark, d), properties(comps(spark, d))))


@query("lnk5_messages", f"""
WITH {URLS} SELECT c_custkey AS schematic_id, c_name AS title, 'Unknown' AS company, count(url)::BIGINT AS datasheet_count, coalesce(string_agg(regexp_extract(url, '://([^/]*)', 1) || '=' || ref, ',' ORDER BY src, ordinal), '') AS entries
FROM customer LEFT JOIN u ON schematic_id = c_custkey GROUP BY c_custkey, c_name""")
def _(spark, d):
    entries = F.array_join(F.transform("datasheets", lambda e: F.concat(e["domain"], F.lit("="), e["component_reference"])), ",")
    return messages(spark, d).select("schematic_id", "circuit_info.title", "circuit_info.company", "datasheet_count", F.coalesce(entries, F.lit("")).alias("entries"))


@query("lnk6_results", f"""
WITH {URLS} SELECT c_custkey AS schematic_id, CASE WHEN c_custkey % 50 = 0 THEN 500 ELSE 200 END AS status_code, c_custkey % 50 <> 0 AS success,
  CASE WHEN c_custkey % 50 = 0 THEN 'Processing error: broken' WHEN count(url) = 0 THEN 'No datasheets found' ELSE 'Processed ' || count(url) || ' datasheets' END AS message
FROM customer LEFT JOIN u ON schematic_id = c_custkey GROUP BY c_custkey""")
def _(spark, d):
    return messages(spark, d).select("schematic_id", "status_code", "success", "message")


# ---------------------------------------------------------------- nets and boxes


@query("net1_touching_points", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND sqrt((a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal) + ((a.s_suppkey % 10) - (b.s_suppkey % 10)) * ((a.s_suppkey % 10) - (b.s_suppkey % 10))) <= 500")
def _(spark, d):
    s = given(spark, d, "supplier")
    a = s.select("s_nationkey", F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("ax"), (F.col("s_suppkey") % 10).cast("double").alias("ay"))
    b = a.toDF("s_nationkey", "b", "bx", "by")
    return near(a, b, 500.0, ["s_nationkey"], "ax", "ay", "bx", "by").where("a < b").select("a", "b")


@query("net2_wire_groups", """
WITH RECURSIVE e AS (
  SELECT a.schematic_id AS sid, a.ordinal AS x, b.ordinal AS y FROM wires a JOIN wires b ON a.schematic_id = b.schematic_id AND a.ordinal <> b.ordinal
  WHERE (a.x1 = b.x1 AND a.y1 = b.y1) OR (abs(a.x1 - b.x2) <= 0.01 AND a.y1 = b.y2) OR (abs(a.x2 - b.x1) <= 0.01 AND a.y2 = b.y1) OR (a.x2 = b.x2 AND a.y2 = b.y2)),
r(sid, x, y) AS (SELECT sid, x, y FROM e UNION SELECT r.sid, r.x, e.y FROM r JOIN e ON e.sid = r.sid AND e.x = r.y)
SELECT w.schematic_id, w.ordinal::BIGINT AS ordinal, least(w.ordinal, coalesce(min(r.y), w.ordinal))::BIGINT AS first_wire FROM wires w LEFT JOIN r ON r.sid = w.schematic_id AND r.x = w.ordinal GROUP BY w.schematic_id, w.ordinal""")
def _(spark, d):
    groups = N.wire_groups(derived(spark, d, "wires"))
    return groups.select("schematic_id", F.col("ordinal").cast("long").alias("ordinal"), F.split_part("wire_group", F.lit(":"), F.lit(2)).cast("long").alias("first_wire"))


@query("net1_touching_wires", """
WITH t AS (
  SELECT a.schematic_id, a.ordinal AS a, b.ordinal AS b FROM wires a JOIN wires b ON a.schematic_id = b.schematic_id AND a.ordinal < b.ordinal
  WHERE least((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2, (a.x1 - b.x2) ** 2 + (a.y1 - b.y2) ** 2, (a.x2 - b.x1) ** 2 + (a.y2 - b.y1) ** 2, (a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) <= 0.01 ** 2)
SELECT schematic_id, b::BIGINT AS wire FROM t GROUP BY ALL""")
def _(spark, d):
    """Wires that touch an earlier one: of wires at one point each is paired with the one before it only."""
    return N.touching(derived(spark, d, "wires")).select("schematic_id", F.col("b").cast("long").alias("wire")).distinct()


# wires one after the other, each with the earlier ones that it touches, and the list of groups after it
SEQUENTIAL = """touch AS (
  SELECT b.schematic_id, b.ordinal AS i, list(a.ordinal) AS t FROM wires a JOIN wires b ON a.schematic_id = b.schematic_id AND a.ordinal < b.ordinal
  WHERE least((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2, (a.x1 - b.x2) ** 2 + (a.y1 - b.y2) ** 2, (a.x2 - b.x1) ** 2 + (a.y2 - b.y1) ** 2, (a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) <= 0.01 ** 2 GROUP BY ALL),
w AS (SELECT v.schematic_id, v.ordinal AS i, coalesce(t, []) AS t FROM wires v LEFT JOIN touch ON touch.schematic_id = v.schematic_id AND touch.i = v.ordinal),
r AS (
  SELECT schematic_id, i, [[i]] AS g FROM w WHERE i = 0
  UNION ALL
  SELECT r.schematic_id, w.i, CASE len(list_filter(g, lambda x: len(list_intersect(x, t)) > 0))
    WHEN 0 THEN list_append(g, [w.i]) WHEN 1 THEN list_transform(g, lambda x: CASE WHEN len(list_intersect(x, t)) > 0 THEN list_append(x, w.i) ELSE x END)
    ELSE list_append(list_filter(g, lambda x: len(list_intersect(x, t)) = 0), list_append(flatten(list_filter(g, lambda x: len(list_intersect(x, t)) > 0)), w.i)) END
  FROM r JOIN w ON w.schematic_id = r.schematic_id AND w.i = r.i + 1),
net AS (SELECT schematic_id, unnest(g) AS wires, unnest(range(len(g))) AS net_id FROM (SELECT schematic_id, arg_max(g, i) AS g FROM r GROUP BY ALL))"""


@query("net3_net_numbers", f"WITH RECURSIVE {SEQUENTIAL} SELECT schematic_id, schematic_id || ':' || lpad(list_min(wires)::VARCHAR, 12, '0') AS wire_group, net_id, 'Net_' || net_id AS name FROM net")
def _(spark, d):
    w = derived(spark, d, "wires")
    return N.net_numbers(w, N.wire_groups(w))


def points_at_wires(spark, d, which: str) -> DataFrame:
    """Points near wire ends: one in three stands a little off, one in three far off."""
    w = derived(spark, d, "wires")
    off = F.when(F.col("ordinal") % 3 == 0, 0.0).when(F.col("ordinal") % 3 == 1, 0.004).otherwise(0.5)
    return w.select("schematic_id", "ordinal", (F.col("x1") + off).alias("x"), F.col("y1").alias("y"), F.lit(which).alias("text"), F.lit("label").alias("type"), F.lit(0.0).alias("rotation"))


ON = """WITH p AS (SELECT schematic_id, ordinal, x1 + CASE ordinal % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.004 ELSE 0.5 END AS x, y1 AS y FROM wires)
SELECT DISTINCT p.schematic_id, p.ordinal::BIGINT AS point FROM p JOIN wires w ON p.schematic_id = w.schematic_id
WHERE sqrt((p.x - w.x1) * (p.x - w.x1) + (p.y - w.y1) * (p.y - w.y1)) <= 0.01 OR sqrt((p.x - w.x2) * (p.x - w.x2) + (p.y - w.y2) * (p.y - w.y2)) <= 0.01"""


def on_nets(spark, d, which):
    w = derived(spark, d, "wires")
    return N.on_nets(points_at_wires(spark, d, which), ["ordinal"], w, N.wire_groups(w)).select("schematic_id", F.col("ordinal").cast("long").alias("point")).distinct()


for _i, _which in ((4, "labels"), (5, "junctions"), (6, "pins")):
    QUERIES[f"net{_i}_{_which}_on_nets"] = lambda spark, d, w=_which: on_nets(spark, d, w)
    SQL[f"net{_i}_{_which}_on_nets"] = ON


@query("net7_assembled_nets", f"""WITH RECURSIVE {SEQUENTIAL},
p AS (SELECT schematic_id, ordinal, x1 + CASE ordinal % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.004 ELSE 0.5 END AS x, y1 AS y FROM wires),
member AS (SELECT schematic_id, net_id, unnest(wires) AS ordinal FROM net),
hit AS (SELECT m.schematic_id, m.net_id, count(DISTINCT p.ordinal) AS n FROM member m JOIN wires w ON w.schematic_id = m.schematic_id AND w.ordinal = m.ordinal JOIN p ON p.schematic_id = w.schematic_id
  AND least((p.x - w.x1) ** 2 + (p.y - w.y1) ** 2, (p.x - w.x2) ** 2 + (p.y - w.y2) ** 2) <= 0.01 ** 2 GROUP BY ALL)
SELECT net.schematic_id, net.net_id, 'Net_' || net.net_id AS name, len(wires)::INTEGER AS n_wires, hit.n::INTEGER AS n_pins, hit.n::INTEGER AS n_labels
FROM net LEFT JOIN hit ON hit.schematic_id = net.schematic_id AND hit.net_id = net.net_id""")
def _(spark, d):
    w, p = derived(spark, d, "wires"), points_at_wires(spark, d, "L")
    pins = p.select("schematic_id", F.concat(F.lit("R"), F.col("ordinal").cast("string")).alias("reference"), F.lit("").alias("number"), "x", "y")
    found = N.nets(w, p, p, pins)
    return found.select("schematic_id", "net_id", "name", F.size("wires").alias("n_wires"), F.size("pins").alias("n_pins"), F.size("labels").alias("n_labels"))


@query("prj2_reachable_parts", """
WITH RECURSIVE l AS (SELECT DISTINCT schematic_id, reference AS x, 'R' || (partkey * 3 % 37 + 1) AS y FROM net_pins),
r(schematic_id, node) AS (SELECT DISTINCT schematic_id, reference FROM net_pins WHERE reference IN ('J1', 'R5', 'U9') UNION SELECT r.schematic_id, l.y FROM r JOIN l ON l.schematic_id = r.schematic_id AND l.x = r.node)
SELECT schematic_id, node FROM r""")
def _(spark, d):
    p = derived(spark, d, "net_pins")
    links = p.select("schematic_id", F.col("reference").alias("node"), F.concat(F.lit("R"), (F.col("partkey") * 3 % 37 + 1).cast("string")).alias("to"))
    return P.reachable(p.where("reference in ('J1', 'R5', 'U9')").select("schematic_id", F.col("reference").alias("node")), links, ["schematic_id"])


BOXES = "SELECT c_nationkey AS board_id, c_custkey AS item_id, CASE WHEN c_custkey % 9 = 0 THEN 5.0 ELSE c_acctbal END AS x1, c_acctbal - 10 AS y1, CASE WHEN c_custkey % 9 = 0 THEN 4.0 ELSE c_acctbal + c_custkey % 50 END AS x2, c_acctbal + 30 AS y2 FROM {customer}"


def boxes(spark, d) -> DataFrame:
    return spark.sql(BOXES, customer=given(spark, d, "customer"))


BOX_SQL = BOXES.replace("{customer}", "customer")


@query("brd3_combined_box", f"SELECT board_id, coalesce(min(x1), 0) AS x1, coalesce(min(y1), 0) AS y1, coalesce(max(x2), 0) AS x2, coalesce(max(y2), 0) AS y2 FROM ({BOX_SQL}) WHERE x1 <= x2 GROUP BY ALL")
def _(spark, d):
    return B.combined_box(boxes(spark, d), ["board_id"])


@query("brd4_outline", f"SELECT board_id, max(x2) - min(x1) AS width, max(y2) - min(y1) AS height FROM ({BOX_SQL}) WHERE x1 <= x2 AND item_id % 2 = 0 GROUP BY ALL")
def _(spark, d):
    return B.outline(boxes(spark, d).where("x1 <= x2").withColumn("layer", F.when(F.col("item_id") % 2 == 0, B.OUTLINE).otherwise("F.Cu")), ["board_id"])


@query("brd6_hit_test", f"""
WITH b AS ({BOX_SQL}), p AS (SELECT s_nationkey AS board_id, s_suppkey AS point_id, s_acctbal AS px, s_acctbal + 5 AS py FROM supplier)
SELECT p.board_id, p.point_id, b.item_id, (b.item_id % 5)::BIGINT AS layer_order, row_number() OVER (PARTITION BY p.board_id, p.point_id ORDER BY b.item_id % 5, b.item_id) AS rank
FROM p JOIN b ON p.board_id = b.board_id AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2""")
def _(spark, d):
    points = given(spark, d, "supplier").select(F.col("s_nationkey").alias("board_id"), F.col("s_suppkey").alias("point_id"), F.col("s_acctbal").alias("px"), (F.col("s_acctbal") + 5).alias("py"))
    found = B.hits(points, boxes(spark, d).withColumn("layer_order", F.col("item_id") % 5), ["board_id"], 50.0)
    return found.withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- vectors

ASKED = "vec_id % 100 = 0"


def probes(spark, d) -> DataFrame:
    """Every row whose id is divisible by 100."""
    return given(spark, d, "embeddings").where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def near_sql(where: str = "", distance: str = "list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])") -> str:
    return f"SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM (SELECT b.vec_id AS query_id, a.vec_id, {distance} AS distance, row_number() OVER (PARTITION BY b.vec_id ORDER BY {distance}, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 {where}) WHERE rank <= 5"


def rounded(df):
    return df.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query("vec3_nearest", near_sql())
def nearest(spark, d):
    return rounded(V.nearest(given(spark, d, "embeddings"), probes(spark, d), 5))


@query("vec4_nearest_where", near_sql("AND a.label = 3", "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def _(spark, d):
    return rounded(V.nearest_where(given(spark, d, "embeddings"), probes(spark, d), {"label": 3}, 5))


@query("vec5_by_id", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id * 2 FROM labels)")
def _(spark, d):
    ids = given(spark, d, "labels").select((F.col("doc_id") * 2).alias("vec_id"))
    return V.by_id(given(spark, d, "embeddings"), ids, "vec_id").select("vec_id", "label")


@query("vec6_normalized", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(embedding[64]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS last FROM embeddings")
def _(spark, d):
    v = V.normalized(F.col("embedding"))
    return given(spark, d, "embeddings").select("vec_id", F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(F.get(v, F.lit(63)), 6).alias("last"))


@query("vec7_upserted", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, 'NEW' FROM customer WHERE c_custkey % 7 = 1")
def _(spark, d):
    old = given(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 7 = 0").unionByName(old.where("c_custkey % 7 = 1").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)).withColumn("c_mktsegment", F.lit("NEW"))
    return V.upserted(old, new, ["c_custkey"])


@query("vec7_bucket_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, 'NEW' FROM customer WHERE c_custkey % 7 = 1")
def _(spark, d):
    """The same in a stored table; the upsert runs twice, as a job that was repeated does."""
    folder = f"{fresh_folder(spark, 'upsert')}/table"
    old = given(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 7 = 0").unionByName(old.where("c_custkey % 7 = 1").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)).withColumn("c_mktsegment", F.lit("NEW"))
    buckets.create(old, folder, ["c_custkey"], 8)
    for _ in range(2):
        buckets.upsert(new, folder)
    return buckets.read(spark, folder)


@query("vec1_texts", "SELECT schematic_id, reference, 'Component ' || reference || ': ' || value || '. ' || " + DESCRIBED + " || '. Rating: ' || rating || '. MPN: ' || CASE WHEN mpn <> '' THEN mpn ELSE mpn2 END || '. Footprint: ' || footprint || '. Library: ' || library_id || '. Datasheet: ' || datasheet || '. Position: x=' || x || ', y=' || y || '.' AS text FROM comps")
def _(spark, d):
    return C.component_records(properties(comps(spark, d))).select("schematic_id", "reference", V.component_text().alias("text"))


@query("vec1_net_texts", "SELECT schematic_id, net, 'Net ' || net || '. Type: . Connected components: ' || string_agg(reference, ', ' ORDER BY pos, partkey, reference) || '. Connection points: 0.' AS text FROM net_pins GROUP BY schematic_id, net")
def _(spark, d):
    none = F.array().cast("array<string>")
    return nets(spark, d).withColumns({"net_type": F.lit(None).cast("string"), "connection_points": none}).select("schematic_id", F.col("name").alias("net"), V.net_text().alias("text"))


GROUP_FACTS = ", ".join(f"('{n}', '{f}', '{d}')" for n, (f, d) in C.GROUPS.items())


@query("vec1_group_texts", f"""
SELECT schematic_id, name, 'Functional group ' || name || '. Function: ' || f || '. Description: ' || d || '. Components: ' || string_agg(reference, ', ' ORDER BY part, ordinal, reference) || '.' AS text
FROM group_members JOIN (VALUES {GROUP_FACTS}) facts(name, f, d) USING (name) GROUP BY schematic_id, name, f, d""")
def _(spark, d):
    return C.functional_groups(comps(spark, d)).select("schematic_id", "name", V.group_text().alias("text"))


@query("vec2_embedded", "SELECT DISTINCT schematic_id, name, 64::INTEGER AS dim, 1.0::DOUBLE AS norm FROM group_members")
def _(spark, d):
    own = C.functional_groups(comps(spark, d)).select("schematic_id", "name", V.group_text().alias("text"))
    return V.embedded(own, "text", dim=64).select("schematic_id", "name", F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("vec8_residual", """SELECT p_partkey, p_name, '{"p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS metadata FROM part""")
def _(spark, d):
    return V.residual(given(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), ["p_partkey", "p_name"])


@query("vec9_chunk_rows", "SELECT 'd' || doc_id AS id, 'intro' AS chunk_type, source AS source_file, lang, length(text)::BIGINT AS n FROM documents")
def _(spark, d):
    none = F.lit(None).cast("string")
    own = given(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", F.array(F.lit(0.5)).alias("embedding"), F.lit("x").alias("chunk_type"), F.col("source").alias("source_file"), none.alias("section"), none.alias("component_name"), none.alias("manufacturer"), F.lit(0).alias("chunk_index"), F.create_map(F.lit("chunk_type"), F.lit("intro"), F.lit("lang"), F.col("lang")).alias("metadata"))
    m = F.col("metadata")
    return V.chunk_rows(own).select("id", m["chunk_type"].alias("chunk_type"), m["source_file"].alias("source_file"), m["lang"].alias("lang"), F.length("document").cast("long").alias("n"))


@query("vec11_nearly_nearest")
def _(spark, d):
    return rounded(V.nearly_nearest(given(spark, d, "embeddings"), probes(spark, d), 5))


@query("vec11_stored_lists", "SELECT count(*) AS queries, count(*) * 5 AS asked, TRUE AS found_enough FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, d):
    """Recall of the search over stored lists against the exact one: nine of ten nearest rows or more are found."""
    table, folder = given(spark, d, "embeddings"), fresh_folder(spark, "lists")
    V.store_lists(table, folder)
    some = V.nearest_in_lists(table.schema, folder, probes(spark, d), 5).select("query_id", "vec_id", F.lit(True).alias("found"))
    every = V.nearest(table, probes(spark, d), 5).select("query_id", "vec_id").join(some, ["query_id", "vec_id"], "left")
    n = every.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("asked"), (F.count("found") >= 0.9 * F.count("*")).alias("found_enough"))
    return n


@query("vec12_checked", "SELECT vec_id, 'dimension' AS reason FROM embeddings WHERE vec_id % 10 = 1 UNION ALL SELECT vec_id, 'empty' FROM embeddings WHERE vec_id % 10 = 2")
def _(spark, d):
    e = given(spark, d, "embeddings")
    odd = F.when(F.col("vec_id") % 10 == 1, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 10 != 2, F.col("embedding"))
    return V.checked(e.withColumn("embedding", odd), 64)[1].select("vec_id", "reason")


# ---------------------------------------------------------------- registry


def devices(spark, d) -> DataFrame:
    return derived(spark, d, "devices")


@query("reg1_device_page", "SELECT device_id, region, customer, last_updated_at FROM devices WHERE deleted_at IS NULL AND customer = 'BUILDING' ORDER BY last_updated_at DESC NULLS LAST, region NULLS FIRST, customer NULLS FIRST, device_id LIMIT 20 OFFSET 20")
def _(spark, d):
    return R.device_page(devices(spark, d), page=2, customer="BUILDING", region="").select("device_id", "region", "customer", "last_updated_at")


@query("reg2_page_facts", "SELECT count(*) AS total, 1 AS page, 20 AS \"limit\", ceil(count(*) / 20.0)::BIGINT AS pages FROM devices WHERE deleted_at IS NULL")
def _(spark, d):
    return R.page_facts(devices(spark, d), page=0, limit=None)


@query("reg3_by_ids", "SELECT device_id, region FROM devices WHERE deleted_at IS NULL AND device_id IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    return R.by_ids(devices(spark, d), given(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("device_id"))).select("device_id", "region")


@query("reg4_inserted", "SELECT device_id, region, customer FROM devices UNION ALL SELECT s_suppkey + 1000000000, 'sup', s_name FROM supplier WHERE s_suppkey % 3 <> 0")
def _(spark, d):
    new = given(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("device_id"), F.when(F.col("s_suppkey") % 3 != 0, "sup").otherwise("").alias("region"), F.col("s_name").alias("customer"))
    return R.inserted(devices(spark, d), new)[0].select("device_id", "region", "customer")


@query("reg5_updated", "SELECT device_id, CASE WHEN deleted_at IS NULL AND device_id % 3 = 0 THEN 'fw9' ELSE firmware_version END AS firmware_version, CASE WHEN deleted_at IS NULL AND device_id % 6 = 0 THEN NULL ELSE current_config_id END AS current_config_id, CASE WHEN deleted_at IS NULL AND device_id % 3 = 0 THEN 1.0 ELSE last_updated_at END AS last_updated_at FROM devices")
def _(spark, d):
    upd = devices(spark, d).where("device_id % 3 = 0").select("device_id", F.when(F.col("device_id") % 6 == 0, F.array(F.lit("firmware_version"), F.lit("current_config_id"))).otherwise(F.array(F.lit("firmware_version"))).alias("given"), F.lit("fw9").alias("firmware_version"), F.lit(None).cast("long").alias("current_config_id"))
    return R.updated(devices(spark, d), upd, F.lit(1.0)).select("device_id", "firmware_version", "current_config_id", "last_updated_at")


@query("reg6_soft_deleted", "SELECT device_id, deleted_at IS NULL AND device_id % 4 = 0 AS affected, CASE WHEN deleted_at IS NULL AND device_id % 4 = 0 THEN 7.0 ELSE deleted_at END AS deleted_at, CASE WHEN deleted_at IS NULL AND device_id % 4 = 0 THEN 'me' ELSE deleted_by END AS deleted_by FROM devices")
def _(spark, d):
    return R.soft_deleted(devices(spark, d), devices(spark, d).where("device_id % 4 = 0"), F.lit(7.0), F.lit("me")).select("device_id", "affected", "deleted_at", "deleted_by")


@query("reg7_restored", "SELECT device_id, deleted_at IS NOT NULL AND device_id % 2 = 0 AS affected, CASE WHEN device_id % 2 = 0 THEN NULL ELSE deleted_at END AS deleted_at FROM devices")
def _(spark, d):
    return R.restored(devices(spark, d), devices(spark, d).where("device_id % 2 = 0")).select("device_id", "affected", "deleted_at")


@query("reg8_uuid_round_trip", "SELECT c_custkey, substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) AS uuid, 16::BIGINT AS n FROM customer")
def _(spark, d):
    h = F.md5("c_name")
    text = F.upper(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))
    return given(spark, d, "customer").select("c_custkey", uuid_text(uuid_bytes(text)).alias("uuid"), F.length(uuid_bytes(text)).cast("long").alias("n"))


def config_tables(spark, d):
    items = given(spark, d, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").cast("long").alias("position"), F.col("l_partkey").alias("configuration_id"))
    sets = given(spark, d, "orders").select(F.col("o_orderkey").alias("set_id"), F.col("o_orderpriority").alias("set_name"))
    return sets, items, given(spark, d, "part").select(F.col("p_partkey").alias("configuration_id"), F.col("p_name").alias("name"))


@query("reg9_configurations_in_sets", "SELECT o_orderkey AS set_id, l_linenumber::BIGINT AS position, p_partkey AS configuration_id, p_name AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def _(spark, d):
    return R.configurations_in_sets(*config_tables(spark, d))


@query("reg10_sets_with_configuration", "SELECT DISTINCT l_partkey AS configuration_id, o_orderkey AS set_id, o_orderpriority AS set_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 40")
def _(spark, d):
    sets, items, _ = config_tables(spark, d)
    return R.sets_with_configuration(sets, items, given(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("configuration_id")))


@query("reg11_orders_with_users", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    users = given(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return R.orders_with_users(given(spark, d, "orders").withColumnRenamed("o_custkey", "user_id"), users).select("o_orderkey", "c_name", "o_totalprice")


def roles(spark, d) -> DataFrame:
    return given(spark, d, "events").select("user_id", F.col("event_type").alias("role"))


@query("acl1_effective_permissions", "SELECT DISTINCT user_id, permission FROM events JOIN role_permissions ON role = event_type")
def _(spark, d):
    return R.effective_permissions(roles(spark, d), derived(spark, d, "role_permissions"))


@query("acl2_any_role", "SELECT DISTINCT user_id FROM events WHERE event_type IN ('error', 'signup')")
def _(spark, d):
    return R.users_with_any_role(roles(spark, d), ["error", "signup"])


@query("dsh1_firmware_facts", "SELECT o_custkey AS project, count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS stable, coalesce(arg_max(o_orderkey::VARCHAR, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) FILTER (o_orderstatus = 'F'), 'N/A') AS latest_stable, count(DISTINCT o_orderkey % 4)::BIGINT AS hardware FROM orders GROUP BY ALL")
def _(spark, d):
    fw = given(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.when(F.col("o_orderstatus") == "F", "stable").otherwise("beta").alias("status"), F.col("o_orderkey").cast("string").alias("version"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("released_at"), F.array(F.col("o_orderkey") % 4).alias("hardware"))
    return R.firmware_facts(fw, ["project"])


@query("dsh2_open_issues", "SELECT o_custkey AS project, o_orderpriority AS severity, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey)::BIGINT AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey, o_orderpriority")
def _(spark, d):
    return R.open_issues(given(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("severity"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status")), ["project"])


@query("dsh3_review_lists", "SELECT o_custkey AS project, o_orderkey AS review FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("new")
    own = given(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("review"), status.alias("status"))
    return R.review_lists(own, ["project"], ["review"]).select("project", "review")


@query("dsh4_numbered_pages", "SELECT o_custkey, o_orderkey, ((i - 1) // 4 + 1)::BIGINT AS page, ((i - 1) // 4 * 4 + 1) || '-' || least(((i - 1) // 4 + 1) * 4, n) || ' of ' || n AS shown FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def _(spark, d):
    return R.numbered_pages(given(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], 4, ["o_custkey"]).select("o_custkey", "o_orderkey", "page", "shown")


# ---------------------------------------------------------------- project lists


@query("prj6_natural_order", "SELECT s_suppkey, ('S' || (s_suppkey * 7 % 113)) AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 7 % 113, s_suppkey) AS place FROM supplier")
def _(spark, d):
    own = given(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.concat(F.lit("S"), (F.col("s_suppkey") * 7 % 113).cast("string")).alias("name"))
    own = P.sorted_naturally(own, "name")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("sort_key", "s_suppkey"))
    return own.select("s_suppkey", "name", place.cast("long").alias("place"))


@query("prj7_text_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), lower('BOLT brand#1'))")
def _(spark, d):
    return P.text_filter(given(spark, d, "part"), ["p_name", "p_brand", "p_type"], "BOLT brand#1").select("p_partkey")


@query("prj8_found", "SELECT schematic_id, reference AS key, reference FROM comps WHERE ordinal % 2 = 1 UNION ALL SELECT schematic_id, 'u' || ordinal, reference FROM comps WHERE ordinal % 2 = 0")
def _(spark, d):
    items = comps(spark, d).select("schematic_id", "reference", F.concat(F.lit("u"), F.col("ordinal").cast("string")).alias("uuid"))
    keys = comps(spark, d).select("schematic_id", F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("u"), F.col("ordinal").cast("string"))).otherwise(F.col("reference")).alias("key"))
    return P.found(items, keys, ["schematic_id"]).select("schematic_id", "key", "reference")


@query("prj9_symbol_list", "SELECT schematic_id, reference, library_id = 'power:+5V' AS is_power, row_number() OVER (PARTITION BY schematic_id ORDER BY library_id = 'power:+5V', substr(reference, 1, 1), substr(reference, 2)::INT) AS place FROM comps")
def _(spark, d):
    libs = comps(spark, d).select("library_id").distinct().withColumn("is_power", F.col("library_id").startswith("power:"))
    own = P.symbol_list(comps(spark, d), libs)
    return own.select("schematic_id", "reference", "is_power", F.row_number().over(Window.partitionBy("schematic_id").orderBy("sort_key")).cast("long").alias("place"))


@query("prj10_expanded", "SELECT c_custkey AS text_id, 'Rev ' || c_mktsegment || ' of ' || c_name || ' ${NOPE} $5' AS expanded FROM customer")
def _(spark, d):
    c = given(spark, d, "customer").select(F.col("c_custkey").alias("schematic_id"), "c_name", "c_mktsegment")
    texts = c.select("schematic_id", F.col("schematic_id").alias("text_id"), F.lit("Rev ${REV} of ${TITLE} ${NOPE} $5").alias("text"))
    one = lambda scope, name, value: c.select("schematic_id", F.lit(scope).alias("scope"), F.lit(name).alias("name"), F.col(value).alias("value"))
    variables = one(4, "REV", "c_mktsegment").unionByName(one(4, "TITLE", "c_mktsegment")).unionByName(one(3, "TITLE", "c_name"))
    return P.expanded(texts, variables, ["schematic_id"]).select("text_id", "expanded")


@query("prj11_unit_suffix", "SELECT s_suppkey, CASE WHEN s_suppkey % 90 < 26 THEN chr((65 + s_suppkey % 90)::INT) ELSE chr((64 + (s_suppkey % 90) // 26)::INT) || chr((65 + s_suppkey % 90 % 26)::INT) END AS suffix FROM supplier")
def _(spark, d):
    return given(spark, d, "supplier").select("s_suppkey", unit_suffix(F.col("s_suppkey") % 90 + 1).alias("suffix"))


@query("prj12_unit_pins", "SELECT c.schematic_id, c.reference, p.n AS pin FROM comps c JOIN (SELECT unnest(range(0, 6)) AS n) p ON p.n % 3 = 0 OR c.ordinal % 3 = 0 OR p.n % 3 = c.ordinal % 3")
def _(spark, d):
    own = comps(spark, d).withColumn("unit", F.col("ordinal") % 3).select("schematic_id", "reference", "library_id", "unit")
    pins = comps(spark, d).select("library_id").distinct().select("library_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")).select("library_id", F.col("n").cast("long").alias("pin"), (F.col("n") % 3).alias("unit"))
    return P.unit_pins(own, pins).select("schematic_id", "reference", "pin")


@query("prj13_summary", "SELECT c.schematic_id, count(*) AS symbols, count(DISTINCT library_id) AS unique_symbols, coalesce(max(w.n), 0)::BIGINT AS wires FROM comps c LEFT JOIN (SELECT schematic_id, count(*) AS n FROM wires GROUP BY ALL) w ON w.schematic_id = c.schematic_id GROUP BY c.schematic_id")
def _(spark, d):
    return P.summary(comps(spark, d), {"wires": derived(spark, d, "wires")}, ["schematic_id"])


@query("prj5_instance_overrides", "SELECT schematic_id, reference, CASE WHEN ordinal % 5 = 0 THEN 'root' WHEN ordinal % 3 = 0 THEN value WHEN ordinal % 2 = 0 THEN 'own' ELSE value END AS value FROM comps")
def _(spark, d):
    own = comps(spark, d).select("schematic_id", "reference", "ordinal", "value")
    one = lambda cond, v: own.where(cond).select("schematic_id", "reference", F.lit(v).cast("string").alias("value"))
    return P.with_instance_overrides(own, one("ordinal % 5 = 0", "root"), one("ordinal % 3 = 0", None), one("ordinal % 2 = 0", "own"), ["schematic_id", "reference"], ["value"]).select("schematic_id", "reference", "value")


def project_tables(spark, d):
    """Projects are nations; files are their customers, sheets link each customer's file to the next one's."""
    c = given(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("k"))
    i = F.row_number().over(Window.partitionBy("project_id").orderBy("k"))
    c = c.withColumn("i", i)
    name = lambda k: F.concat(F.lit("f"), k.cast("string"), F.lit(".sch"))
    files = c.select("project_id", name(F.col("i")).alias("filename"), F.concat(F.lit("u"), F.col("i").cast("string")).alias("uuid"))
    # the first file holds a sheet for each file up to the ninth, and one for a file that is not there
    sheets = c.where("i between 2 and 10").select("project_id", F.lit("f1.sch").alias("owner"), F.concat(F.lit("s"), F.col("i").cast("string")).alias("sheet_uuid"), F.when(F.col("i") == 10, "gone.sch").otherwise(name(F.col("i"))).alias("sheetfile"), F.concat(F.lit("Sheet "), F.col("i").cast("string")).alias("sheetname"))
    instances = sheets.select("project_id", "sheet_uuid", F.lit("/u1").alias("path"), F.substring("sheet_uuid", 2, 9).alias("page"))
    return files, sheets, instances


@query("prj1_sheet_paths", "SELECT project_id, '/u1/s' || i AS path, 'f' || i || '.sch' AS filename, i::VARCHAR AS page FROM (SELECT c_nationkey AS project_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) WHERE i BETWEEN 2 AND 9")
def _(spark, d):
    return P.sheet_paths(*project_tables(spark, d)).select("project_id", "path", "filename", "page")


@query("prj3_roots", "SELECT c_nationkey AS project_id, 'f1.sch' AS filename, '/u1' AS path FROM customer GROUP BY c_nationkey HAVING count(*) >= 2")
def _(spark, d):
    files, sheets, instances = project_tables(spark, d)
    return P.roots(files, P.sheet_paths(files, sheets, instances))


@query("prj4_pages", """
SELECT project_id, CASE WHEN i < 10 THEN i ELSE 9 + row_number() OVER (PARTITION BY project_id, i < 10 ORDER BY '/u' || i) END AS place, CASE WHEN i = 1 THEN '/u1' WHEN i < 10 THEN '/u1/s' || i ELSE '/u' || i END AS path, CASE WHEN i = 1 THEN '1' WHEN i < 10 THEN i::VARCHAR ELSE '' END AS page
FROM (SELECT c_nationkey AS project_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE n >= 2""")
def _(spark, d):
    files, sheets, instances = project_tables(spark, d)
    return P.pages(files, P.sheet_paths(files, sheets, instances)).select("project_id", F.col("place").cast("long").alias("place"), "path", "page")


@query("plans_components_of_parts", """
WITH RECURSIVE e AS (SELECT DISTINCT schematic_id || '/' || reference AS x, schematic_id || '/' || 'R' || (partkey * 3 % 37 + 1) AS y FROM net_pins),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r(x, y) AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y)
SELECT x AS node, least(x, min(y)) AS component FROM r WHERE x IN (SELECT x FROM b WHERE x <> y) GROUP BY x""")
def _(spark, d):
    key = lambda c: F.concat(F.col("schematic_id").cast("string"), F.lit("/"), c)
    edges = derived(spark, d, "net_pins").select(key(F.col("reference")).alias("a"), key(F.concat(F.lit("R"), (F.col("partkey") * 3 % 37 + 1).cast("string"))).alias("b"))
    return connected_components(edges)
