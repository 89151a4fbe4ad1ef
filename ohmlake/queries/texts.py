"""Queries of the chunk, datasheet, response, crawl, source and streaming operators, each with its SQL where it can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from ohmlake.functions.columns import ordered
from ohmlake.operators import board as B, chunks as K, crawl as W, datasheet as D, responses as A
from ohmlake.plans.storage import shared_folder
from ohmlake.sources import designs as S, files as S2
from ohmlake.streaming import jobs as J

from .base import derived, given, spread
from .circuits import BOX_SQL, boxes, comps

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# ---------------------------------------------------------------- chunks


def texts(spark, d) -> DataFrame:
    """Documents as texts, dealt over all tasks: a file of them is as many splits as it has row groups, however long the texts."""
    return spread(given(spark, d, "documents"), "doc_id").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_file"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))


def sectioned(spark, d) -> DataFrame:
    """Documents with headers and parameters put between copies of their text."""
    body = F.col("text")
    made = F.concat(F.lit("About this part.\n"), body, F.lit("\nElectrical Characteristics:\n"), body, F.lit("\nPin Configuration\nshort\nTypical Applications:\nVoltage: 3.3V, clock = 16 MHz\n"), body)
    return texts(spark, d).withColumn("text", made)


TOKENS = r"regexp_extract_all(text, '[\pL\pM\pN_]+(?:[.,''\-/][\pL\pM\pN_]+)*|[^\pL\pM\pN_\s]')"
WINDOWS = f"""t AS (SELECT doc_id, source, lang, {TOKENS} AS w FROM documents),
c AS (SELECT doc_id, source, lang, i AS off, array_to_string(w[i + 1:i + 512], ' ') AS piece FROM (SELECT *, unnest(range(0, len(w), 462)) AS i FROM t))"""


@query("chk2_sliding_windows", f"WITH {WINDOWS} SELECT 'd' || doc_id || '_slide_' || off AS id, (off // 462)::INTEGER AS chunk_index, md5(piece) AS digest FROM c WHERE length(piece) > 50")
def _(spark, d):
    return K.sliding_window(texts(spark, d)).select("id", "chunk_index", F.md5("text").alias("digest"))


@query("chk6_split_long_texts", f"WITH {WINDOWS} SELECT doc_id, off::INTEGER AS \"offset\", length(piece)::BIGINT AS n FROM c")
def _(spark, d):
    own = given(spark, d, "documents").select("doc_id", K.tokens(F.col("text")).alias("t"))
    return K.windows(own, "t").select("doc_id", "offset", F.length("piece").cast("long").alias("n"))


# `sectioned` in SQL, the headers and parameters in it by place, and the chunks that follow
MADE = """made AS (SELECT 'd' || doc_id AS source_file, 'About this part.' || chr(10) || text || chr(10) || 'Electrical Characteristics:' || chr(10) || text || chr(10) || 'Pin Configuration' || chr(10) || 'short' || chr(10) ||
  'Typical Applications:' || chr(10) || 'Voltage: 3.3V, clock = 16 MHz' || chr(10) || text AS text FROM documents)"""


def _found(pattern: str, family: int) -> str:
    """Matches of one pattern with their places: the pieces between them and they themselves, laid end to end."""
    p = "(?i)" + pattern.replace("'", "''")
    return f"""SELECT source_file, text, {family} AS family, k, m[k] AS match, list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT source_file, text, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS b FROM made))"""


_HEADS = " UNION ALL ".join(_found(f"(?:{t}){K.AFTER_TITLE}", i) for i, t in enumerate(K.SECTION_TITLES))
_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"lower(title) LIKE '%{w}%'" for w in words) + f" THEN '{kind}'" for kind, words in K.SECTION_TYPES) + " ELSE 'general' END"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SEMANTIC = f"""{MADE}, heads AS ({_HEADS}),
bodies AS (
  SELECT source_file, regexp_extract(match, '(?i)^({"|".join(K.SECTION_TITLES)})', 1) AS title, FALSE AS intro,
    {_STRIP.format("substring(text, (start + length(match) + 1)::BIGINT, (coalesce(lead(start) OVER (PARTITION BY source_file ORDER BY start), length(text)) - start - length(match))::BIGINT)")} AS body FROM heads
  UNION ALL SELECT source_file, 'Introduction', TRUE, {_STRIP.format("substring(any_value(text), 1, min(start)::BIGINT)")} FROM heads GROUP BY source_file),
kept AS (SELECT *, CASE WHEN intro THEN 'description' ELSE {_KIND} END AS kind FROM bodies WHERE length(body) > CASE WHEN intro THEN 100 ELSE 50 END),
cut AS (SELECT *, {TOKENS.replace("text", "body")} AS w FROM kept WHERE NOT intro AND length(body) > 1024),
semantic AS (
  SELECT source_file, title, kind, source_file || '_' || CASE WHEN intro THEN 'intro' ELSE kind END AS id, 0 AS chunk_index, body AS piece FROM kept WHERE intro OR length(body) <= 1024
  UNION ALL SELECT source_file, title, kind, source_file || '_' || kind || '_' || (i // 462), (i // 462)::INTEGER, array_to_string(w[i + 1:i + 512], ' ') FROM (SELECT *, unnest(range(0, len(w), 462)) AS i FROM cut))"""
_PARAMETERS = " UNION ALL ".join(_found(x, i) for i, x in enumerate(K.PARAMETERS))


def sentences_sql(name: str, source: str) -> str:
    """Runs of sentences, each from the one before it: the sentence at which the tokens no longer fit, found by sums from the start."""
    # RE2 has no look-behind: a mark is put behind each full stop that white space follows
    return f"""{name}_s AS (
  SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY i) AS i, s, len({TOKENS.replace("text", "s")}) AS n
  FROM (SELECT source_file, unnest(x) AS s, unnest(range(len(x))) AS i FROM (
    SELECT source_file, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, ' ')), lambda y: y <> '') AS x FROM {source}))),
{name}_l AS (SELECT source_file, list(s ORDER BY i) AS s, list(n ORDER BY i) AS n FROM {name}_s GROUP BY source_file),
{name}_r AS (
  SELECT source_file, s, n, 1::BIGINT AS a, NULL::BIGINT AS b, 0::BIGINT AS k FROM {name}_l
  UNION ALL
  SELECT source_file, s, n, CASE WHEN e - a > 1 THEN e - 2 ELSE e END, e, k + 1 FROM (
    SELECT *, coalesce(list_min([j FOR j IN range(greatest(a + 1, coalesce(b, 0) + 1), len(n) + 1) IF list_sum(n[a:j]) > 512]), len(n) + 1) AS e FROM {name}_r WHERE coalesce(b, 0) <= len(n))),
{name} AS (SELECT source_file, (k - 1)::INTEGER AS chunk_index, array_to_string(s[pa:b - 1], ' ') AS piece FROM (SELECT *, lag(a) OVER (PARTITION BY source_file ORDER BY k) AS pa FROM {name}_r) WHERE k > 0)"""


@query("chk5_section_types", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'specifications' WHEN p_partkey % 4 = 1 THEN 'mechanical' WHEN p_partkey % 4 = 2 THEN 'application' ELSE 'general' END AS kind FROM part")
def _(spark, d):
    title = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Electrical data of ' WHEN 1 THEN 'Package of ' WHEN 2 THEN 'EXAMPLE for ' ELSE 'About ' END || p_brand")
    return given(spark, d, "part").select("p_partkey", K.section_type(title).alias("kind"))


@query("chk1_semantic_chunks", f"WITH {SEMANTIC} SELECT id || '#' || row_number() OVER (PARTITION BY id ORDER BY title, chunk_index, md5(piece)) AS chunk_uid, kind AS chunk_type, title AS section, length(piece)::INTEGER AS n, md5(piece) AS digest FROM semantic")
def _(spark, d):
    return K.with_uid(K.semantic(sectioned(spark, d))).select("chunk_uid", "chunk_type", "section", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("chk3_sentence_chunks", f"WITH RECURSIVE t AS (SELECT 'd' || doc_id AS source_file, text FROM documents), {sentences_sql('packed', 't')} SELECT source_file || '_sent_' || chunk_index AS id, chunk_index, length(piece)::INTEGER AS n, md5(piece) AS digest FROM packed")
def _(spark, d):
    return K.sentence_boundary(texts(spark, d)).select("id", "chunk_index", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("chk4_parameters", "SELECT 'd' || doc_id AS source_file, 'voltage' AS parameter_type, '3.3V' AS parameter_value, 0 AS chunk_index FROM documents UNION ALL SELECT 'd' || doc_id, 'clock', '16 MHz', 1 FROM documents")
def _(spark, d):
    return K.parameters(sectioned(spark, d)).select("source_file", F.col("metadata")["parameter_type"].alias("parameter_type"), F.col("metadata")["parameter_value"].alias("parameter_value"), "chunk_index")


CHUNKS = f"""WITH RECURSIVE {SEMANTIC}, params AS ({_PARAMETERS}), {sentences_sql("packed", "made")},
slid AS (SELECT source_file, i, array_to_string(w[i + 1:i + 512], ' ') AS piece FROM (SELECT *, unnest(range(0, len(w), 462)) AS i FROM (SELECT source_file, {TOKENS} AS w FROM made))),
every AS (
  SELECT 'semantic' AS strategy, kind AS chunk_type, source_file FROM semantic
  UNION ALL SELECT 'sliding_window', 'sliding_window', source_file FROM slid WHERE length(piece) > 50
  UNION ALL SELECT 'sentence_boundary', 'sentence_boundary', source_file FROM packed
  UNION ALL SELECT 'parameter_extraction', 'parameter', source_file FROM params)
SELECT strategy, chunk_type, count(*) AS n, count(DISTINCT source_file) AS files FROM every GROUP BY ALL"""


@query("chk7_strategies", CHUNKS)
def _(spark, d):
    found = [K.chunked(sectioned(spark, d), s).groupBy("chunk_type").agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("files")).withColumn("strategy", F.lit(s)) for s in K.STRATEGIES]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def plain_chunks(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = F.when(F.col("doc_id") % 3 == 0, "specifications").when(F.col("doc_id") % 3 == 1, "application").otherwise("general")
    own = given(spark, d, "documents").withColumns({"id": F.concat(F.lit("c"), F.col("doc_id").cast("string")), "source_file": F.col("source"), "chunk_type": kind, "section": none, "component_name": F.when(F.col("doc_id") % 2 == 0, "U1"), "manufacturer": none, "metadata": F.create_map(F.lit("lang"), F.col("lang"))})
    return own


@query("chk8_jsonl_records", """SELECT doc_id, '{"source":"' || source || '","chunk_type":"' || CASE doc_id % 3 WHEN 0 THEN 'specifications' WHEN 1 THEN 'application' ELSE 'general' END || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"component":"U1"' ELSE '' END || '}' AS metadata FROM documents""")
def _(spark, d):
    own = plain_chunks(spark, d)
    return K.jsonl_records(own.withColumn("text", F.col("doc_id").cast("string"))).select(F.col("text").cast("long").alias("doc_id"), F.to_json("metadata").alias("metadata"))


@query("chk9_csv_rows", """SELECT 'c' || doc_id AS id, source AS source_file, CASE WHEN doc_id % 2 = 0 THEN 'U1' ELSE '' END AS component_name, '{"lang":"' || lang || '"}' AS metadata_json FROM documents""")
def _(spark, d):
    return K.csv_rows(plain_chunks(spark, d)).select("id", "source_file", "component_name", "metadata_json")


@query("chk10_question_pairs", "SELECT CASE doc_id % 3 WHEN 0 THEN 'What are the specifications for ' ELSE 'What are the typical applications for ' END || CASE WHEN doc_id % 2 = 0 THEN 'U1' ELSE 'this component' END || '?' AS question, md5(text) AS answer FROM documents WHERE doc_id % 3 < 2")
def _(spark, d):
    return K.question_pairs(plain_chunks(spark, d)).select("question", F.md5("answer").alias("answer"))


@query("chk11_corpus_summary", f"WITH {WINDOWS} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS datasheets FROM c WHERE length(piece) > 50")
def _(spark, d):
    return K.corpus_summary(K.sliding_window(texts(spark, d)))


@query("vec10_embedded_chunks", f"WITH {WINDOWS} SELECT 'd' || doc_id || '_slide_' || off AS id, 64::INTEGER AS dim, lang FROM c WHERE length(piece) > 50")
def _(spark, d):
    from ohmlake.operators.vectors import embedded_chunks

    return embedded_chunks(texts(spark, d), K.sliding_window).select("id", F.size("embedding").alias("dim"), F.col("metadata")["lang"].alias("lang"))


# ---------------------------------------------------------------- datasheets


def sheets(spark, d) -> DataFrame:
    return derived(spark, d, "sheets")


@query("dtx1_component_names", "SELECT source_file, CASE WHEN k % 3 = 0 THEN 'LM-' || (k + 1000) || ' REG' WHEN k % 3 = 1 THEN 'XR' || k ELSE 'Unknown Component' END AS component_name FROM sheets")
def _(spark, d):
    return sheets(spark, d).select("source_file", D.component_name(F.col("text")).alias("component_name"))


@query("dtx2_numbered_pins", "SELECT source_file, (k % 40)::VARCHAR AS pin_number, 'VCC' AS pin_name, 'main feed' AS description, 'POWER' AS pin_type FROM sheets UNION ALL SELECT source_file, '7', 'SHD', CASE WHEN k % 2 = 0 THEN 'an input here' ELSE 'an output there' END, CASE WHEN k % 2 = 0 THEN 'INPUT' ELSE 'OUTPUT' END FROM sheets")
def _(spark, d):
    return D.numbered_pins(sheets(spark, d)).select("source_file", "pin_number", "pin_name", "description", "pin_type")


@query("dtx3_described_pins", "SELECT source_file, 'SCL' AS pin_name, '(SCK) ' || trim(replace(split_part(text, 'SCL (SCK):', 2), chr(10), ' ')) AS description, 'POWER' AS pin_type FROM sheets")
def _(spark, d):
    return D.described_pins(sheets(spark, d)).select("source_file", "pin_name", "description", "pin_type")


@query("dtx4_parenthetical_pins", "SELECT source_file, 'SCL' AS pin_name, '(SCK) clock signal with high level ' || (k % 4 + 1) || '.' AS description, 'CLOCK' AS pin_type FROM sheets")
def _(spark, d):
    return D.parenthetical_pins(sheets(spark, d)).select("source_file", "pin_name", "description", "pin_type")


@query("dtx5_pin_types", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'POWER' WHEN 1 THEN 'GROUND' WHEN 2 THEN 'DATA' WHEN 3 THEN 'RESET' WHEN 4 THEN 'BIDIRECTIONAL' ELSE 'GENERAL' END AS kind FROM part")
def _(spark, d):
    name = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'power ground' WHEN 1 THEN 'GND' WHEN 2 THEN 'MOSI' WHEN 3 THEN 'RST' ELSE 'QQ' END")
    about = F.expr("CASE p_partkey % 6 WHEN 4 THEN 'a line of I/O ' ELSE 'a line of ' END || p_brand")
    return given(spark, d, "part").select("p_partkey", D.pin_type(name, about).alias("kind"))


@query("dtx6_pin_specifications", "SELECT source_file, ((k % 4 + 1) + 0.5)::DOUBLE AS voltage_max, 'PULL_UP' AS pull_up_down FROM sheets")
def _(spark, d):
    one = sheets(spark, d).withColumn("text", F.concat(F.lit("SCL (SCK): at high level "), (F.col("k") % 4 + 1).cast("string"), F.lit(".5V with a pull-up")))
    return D.described_pins(one).select("source_file", "voltage_max", "pull_up_down")


def cells(spark, d) -> DataFrame:
    """Tables of three columns; every fourth has no name column."""
    s = sheets(spark, d).select("source_file", "k")
    cell = lambda c, h, v: F.struct(F.lit(c).alias("col_no"), F.lit(h).alias("header") if isinstance(h, str) else h.alias("header"), v.cast("string").alias("cell"))
    row = F.explode(F.array(F.lit(0), F.lit(1)))
    s = s.withColumn("row_no", row)
    name = F.when(F.col("row_no") == 1, F.when(F.col("k") % 5 == 0, "nan").otherwise("TX")).otherwise("RX")
    c = F.explode(F.array(cell(0, "Pin No.", F.col("k") % 30 + F.col("row_no")), cell(1, F.when(F.col("k") % 4 == 0, "Other").otherwise("Signal"), name), cell(2, "Description", F.concat(F.lit(" does "), F.col("k").cast("string")))))
    return s.withColumn("c", c).select("source_file", F.lit(0).alias("table_no"), "row_no", "c.*")


@query("dtx7_table_pins", "SELECT source_file, (k % 30 + r)::VARCHAR AS pin_number, CASE r WHEN 1 THEN 'TX' ELSE 'RX' END AS pin_name, 'does ' || k AS description FROM sheets, (SELECT unnest([0, 1]) AS r) WHERE k % 4 <> 0 AND NOT (r = 1 AND k % 5 = 0)")
def _(spark, d):
    return D.table_pins(cells(spark, d)).select("source_file", "pin_number", "pin_name", "description")


@query("dtx8_unique_pins", "SELECT source_file, pin_name, min(src)::INTEGER AS src_rank FROM (SELECT source_file, unnest(['VCC', 'SHD']) AS pin_name, 0 AS src FROM sheets UNION ALL SELECT source_file, 'SCL', 1 FROM sheets UNION ALL SELECT source_file, CASE r WHEN 1 THEN 'TX' ELSE 'RX' END, 3 FROM sheets, (SELECT unnest([0, 1]) AS r) WHERE k % 4 <> 0 AND NOT (r = 1 AND k % 5 = 0)) GROUP BY ALL")
def _(spark, d):
    return D.all_pins(sheets(spark, d), cells(spark, d)).select("source_file", "pin_name", "src_rank")


REQ = """SELECT source_file, 'PULL_UP_RESISTOR' AS requirement_type, s || '.7kΩ' AS value FROM sheets UNION ALL SELECT source_file, 'DECOUPLING_CAPACITOR', (k % 90 + 10) || 'µF' FROM sheets"""


@query("dtx9_pull_ups_and_capacitors", REQ)
def _(spark, d):
    return D.requirements(sheets(spark, d)).where("requirement_type in ('PULL_UP_RESISTOR', 'DECOUPLING_CAPACITOR')").select("source_file", "requirement_type", "value")


@query("dtx10_spi_requirements", "SELECT source_file, 'CPHL=0, CPOL=' || (k % 3) AS value, 'SPI timing configuration for mode ' || (k % 3) AS description FROM sheets WHERE k % 2 = 0")
def _(spark, d):
    return D.requirements(sheets(spark, d)).where("pin_name = 'SPI_INTERFACE'").select("source_file", "value", "description")


@query("dtx11_i2c_requirements", "SELECT source_file, 'I2C_ADDRESS' AS requirement_type, '0x3' || (k % 10) AS value FROM sheets WHERE k % 2 = 1 UNION ALL SELECT source_file, 'INTERFACE_REQUIREMENT', 'I2C' FROM sheets WHERE k % 2 = 1")
def _(spark, d):
    return D.requirements(sheets(spark, d)).where("pin_name = 'I2C_INTERFACE'").select("source_file", "requirement_type", "value")


@query("dtx12_operating_conditions", "SELECT source_file, '-' || (k % 50) || '°C to ' || (k % 90 + 10) || '°C' AS temperature_range, '1.' || (k % 9) || 'V to 3.' || (s % 7) || 'V' AS voltage_range FROM sheets")
def _(spark, d):
    m = D.operating_conditions(F.col("text"))
    return sheets(spark, d).select("source_file", m["temperature_range"].alias("temperature_range"), m["voltage_range"].alias("voltage_range"))


@query("dtx13_electrical_characteristics", "SELECT source_file, (k % 300) || 'mA' AS max_current, s || 'MHz' AS max_frequency FROM sheets")
def _(spark, d):
    m = D.electrical_characteristics(F.col("text"))
    return sheets(spark, d).select("source_file", m["max_current"].alias("max_current"), m["max_frequency"].alias("max_frequency"))


@query("dtx14_specifications", "SELECT source_file, CASE WHEN k % 3 = 0 THEN 'LM-' || (k + 1000) || ' REG' WHEN k % 3 = 1 THEN 'XR' || k ELSE 'Unknown Component' END AS component_name, CASE WHEN k % 2 = 0 THEN 3 ELSE 4 END::BIGINT AS n_requirements, (k % 300) || 'mA' AS max_current FROM sheets")
def _(spark, d):
    return D.specifications(sheets(spark, d), cells(spark, d)).select("source_file", "component_name", F.size("requirements").cast("long").alias("n_requirements"), F.col("electrical_characteristics")["max_current"].alias("max_current"))


@query("dtx15_pin_reports", "SELECT source_file, 'Pins (2 total):' || chr(10) || CASE WHEN k % 40 = 7 AND FALSE THEN '' ELSE '' END || '  POWER Pins:' || chr(10) || '    - VCC (Pin ' || (k % 40) || '): main feed' || chr(10) || '  ' || CASE WHEN k % 2 = 0 THEN 'INPUT' ELSE 'OUTPUT' END || ' Pins:' || chr(10) || '    - SHD (Pin 7): ' || CASE WHEN k % 2 = 0 THEN 'an input here' ELSE 'an output there' END AS report FROM sheets")
def _(spark, d):
    return D.pin_report(D.numbered_pins(sheets(spark, d)))


# ---------------------------------------------------------------- responses


def answers(spark, d) -> DataFrame:
    return derived(spark, d, "answers_").withColumnRenamed("k", "k")


def parsed(spark, d, out: dict) -> DataFrame:
    return answers(spark, d).select("source_file", *[c.alias(n) for n, c in out.items()])


T = F.col


@query("rsp1_combined", "SELECT o_custkey AS source_file, string_agg(CASE WHEN seq = 0 THEN 'r' || o_orderkey || chr(10) || chr(10) || repeat('=', 60) || chr(10) || 'FOLLOW-UP ANALYSIS - ADDITIONAL DETAILS' || chr(10) || repeat('=', 60) || chr(10) || chr(10) ELSE chr(10) || '--- Follow-up Analysis ' || seq || ' ---' || chr(10) || CASE WHEN o_orderkey % 5 = 0 THEN 'Follow-up failed: late' ELSE 'r' || o_orderkey END || chr(10) END, '' ORDER BY seq) AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM orders) GROUP BY ALL")
def _(spark, d):
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    own = given(spark, d, "orders").withColumn("seq", seq).select(F.col("o_custkey").alias("source_file"), "seq", F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("text"), F.when((F.col("o_orderkey") % 5 == 0) & (F.col("seq") > 0), "late").alias("error"))
    return A.combined(own)


@query("rsp2_identification", "SELECT 'r' || p_partkey AS source_file, p_name || ' v2' AS component_name, '' AS controller_ic, 'V1,V2' AS variants FROM part")
def _(spark, d):
    i = A.identification(T("text"))
    return parsed(spark, d, {"component_name": i["component_name"], "controller_ic": i["controller_ic"], "variants": F.array_join(i["version_variants"], ",")})


@query("rsp3_technical", "SELECT source_file, (k % 800 + 100) || ' × ' || (s + 100) || ' pixels' AS resolution, '4.' || (s % 10) || ' inches' AS display_size, '0.' || s || 'mm × 0.' || s || 'mm' AS dot_pitch FROM answers_")
def _(spark, d):
    t = A.technical(T("text"))
    return parsed(spark, d, {"resolution": t["resolution"], "display_size": t["display_size"], "dot_pitch": t["dimensions"]["dot_pitch"]})


@query("rsp4_electrical", "SELECT source_file, '3.' || (s % 4) || 'V' AS operating_voltage, s || ' uA' AS standby_current, 2 AS n FROM answers_")
def _(spark, d):
    m = A.electrical(T("text"))
    return parsed(spark, d, {"operating_voltage": m["operating_voltage"], "standby_current": m["standby_current"], "n": F.size(m)})


@query("rsp5_performance", "SELECT source_file, s || ' seconds' AS refresh_time, (k % 180) || ' degrees' AS viewing_angle FROM answers_")
def _(spark, d):
    m = A.performance(T("text"))
    return parsed(spark, d, {"refresh_time": m["refresh_time"], "viewing_angle": m["viewing_angle"]})


@query("rsp6_environment", "SELECT source_file, (k % 60) || ' C' AS working_temperature, s || ' percent' AS storage_humidity FROM answers_")
def _(spark, d):
    m = A.environment(T("text"))
    return parsed(spark, d, {"working_temperature": m["working_temperature"], "storage_humidity": m["storage_humidity"]})


@query("rsp7_interfaces", "SELECT source_file, CASE WHEN k % 2 = 0 THEN 'SPI' ELSE 'SPI,I2C' END AS interfaces, CASE WHEN k % 2 = 0 THEN 'Mode 0' END AS spi_mode, CASE WHEN k % 2 = 0 THEN '20cm maximum' END AS cable, CASE WHEN k % 2 = 1 THEN '0.1 inch (2.54mm) pitch' END AS pitch FROM answers_")
def _(spark, d):
    i = A.interfaces(T("text"))
    return parsed(spark, d, {"interfaces": F.array_join(i["primary_interfaces"], ","), "spi_mode": i["spi_mode"], "cable": i["max_cable_length"], "pitch": i["connector_pitch"]})


@query("rsp8_pins", "SELECT source_file, 'VCC=Power Supply;BUSY=line ' || k AS pins FROM answers_")
def _(spark, d):
    return parsed(spark, d, {"pins": F.array_join(F.transform(A.pins(T("text")), lambda p: F.concat(p["pin_name"], F.lit("="), p["description"])), ";")})


@query("rsp9_sections", "SELECT source_file, unnest([1, 2, 3, 4]) AS section_no FROM answers_")
def _(spark, d):
    return A.sections(answers(spark, d)).select("source_file", F.col("section_no").cast("int").alias("section_no"))


@query("rsp10_connections", "SELECT source_file, 'raspberry_pi' AS platform, 'Vcc' AS e_paper_pin, '3v' || s AS platform_pin FROM answers_")
def _(spark, d):
    return A.connections(answers(spark, d)).where("rank = 0").select("source_file", "platform", "e_paper_pin", "platform_pin")


@query("rsp10_all_connections", "SELECT source_file, 'raspberry_pi' AS platform, r AS rank, CASE r WHEN 0 THEN 'Vcc' ELSE 'BUSY' END AS e_paper_pin, CASE r WHEN 0 THEN '3v' || s WHEN 1 THEN 'line' ELSE 'line ' || k END AS platform_pin FROM answers_, (SELECT unnest([0, 1, 2])::INTEGER AS r)")
def _(spark, d):
    return A.connections(answers(spark, d)).select("source_file", "platform", "rank", "e_paper_pin", "platform_pin")


@query("rsp11_precautions", "SELECT source_file, 'Minimum refresh interval: ' || (s + 100) || ' seconds' AS timing, CASE WHEN k % 3 = 0 THEN 'Never leave the power on for ' || k || ' hours' ELSE '' END AS warnings, CASE WHEN k % 3 = 0 THEN '' ELSE 'Screen is fragile - avoid impacts' END AS handling FROM answers_")
def _(spark, d):
    p = A.precautions(T("text"))
    return parsed(spark, d, {"timing": F.get(p["timing_constraints"], F.lit(0)), "warnings": F.array_join(p["power_management_warnings"], ";"), "handling": F.array_join(p["physical_handling"], ";")})


@query("rsp12_development", "SELECT source_file, 'Raspberry Pi' AS platforms, 'wiringpi' AS c_libraries, 'spidev' AS python_libraries, 'https://github.com/x/r' || k AS repository_url FROM answers_")
def _(spark, d):
    v = A.development(T("text"))
    return parsed(spark, d, {"platforms": F.array_join(v["supported_platforms"], ","), "c_libraries": F.array_join(v["c_libraries"], ","), "python_libraries": F.array_join(v["python_libraries"], ","), "repository_url": v["repository_url"]})


@query("rsp13_registers", "SELECT source_file, '0x' || (k % 90 + 10) || ',0x' || s || 'F' || CASE WHEN s % 10 = 0 THEN ',0x5' ELSE '' END AS registers FROM answers_")
def _(spark, d):
    return parsed(spark, d, {"registers": F.array_join(A.registers(T("text"))["register_addresses"], ",")})


@query("rsp14_limitations", "SELECT source_file, 'Cannot read the block diagrams on page ' || s AS cannot, '' AS extracted FROM answers_")
def _(spark, d):
    m = A.limitations(T("text"))
    return parsed(spark, d, {"cannot": F.array_join(m["cannot_extract"], ";"), "extracted": F.array_join(m["missing_documents"], ";")})


@query("rsp15_section_titles", "SELECT source_file, 'Intro' AS first, 'Overview' AS second FROM answers_")
def _(spark, d):
    t = A.section_titles(T("text"))
    return parsed(spark, d, {"first": F.get(t, F.lit(0)), "second": F.get(t, F.lit(1))})


@query("rsp16_part_numbers", "SELECT source_file, 'AB' || (k % 90 + 10) || 'X' AS part, 'QFN ' || s || 'x5' AS package FROM answers_")
def _(spark, d):
    p = A.part_numbers(T("text"))
    return parsed(spark, d, {"part": F.get(F.filter(p["part_numbers"], lambda x: x.startswith("AB")), F.lit(0)), "package": F.get(p["package_types"], F.lit(0))})


@query("rsp17_pin_facts", "SELECT source_file, s::INTEGER AS pins, '2.' || (s % 9) || 'V' AS vih FROM answers_")
def _(spark, d):
    p = A.pin_facts(T("text"))
    return parsed(spark, d, {"pins": p["total_pin_count"], "vih": p["electrical_characteristics"]["input_high_voltage"]})


@query("rsp18_power_facts", "SELECT source_file, 'Deep Sleep' AS modes, s || 'uA' AS first FROM answers_")
def _(spark, d):
    p = A.power_facts(T("text"))
    return parsed(spark, d, {"modes": F.array_join(p["power_modes"], ","), "first": p["power_consumption"]["consumption_0"]})


@query("rsp19_ranges", "SELECT source_file, '-' || s || '°C to 8' || (s % 10) || '°C' AS temperature_range, '1' || s || 'MHz' AS frequency FROM answers_")
def _(spark, d):
    r = A.ranges(T("text"))
    return parsed(spark, d, {"temperature_range": r["temperature_range"], "frequency": r["frequencies"]["frequency_0"]})


@query("rsp20_references", "SELECT 'r' || p_partkey AS source_file, '2=The layout of ' || p_name AS figures, '3=Limits of ' || p_name AS tables FROM part")
def _(spark, d):
    r = A.references(T("text"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat(x["number"], F.lit("="), x["description"])), ";")
    return parsed(spark, d, {"figures": text(r["figures"]), "tables": text(r["tables"])})


@query("rsp21_records", "SELECT source_file, '2.0.0' AS v2, '3.0.0' AS v3, s::INTEGER AS pins, '3.' || (s % 4) || 'V' AS voltage FROM answers_")
def _(spark, d):
    a = A.record_v2(answers(spark, d)).select("source_file", F.col("analyzer_version").alias("v2"), F.col("electrical_specs")["operating_voltage"].alias("voltage"))
    b = A.record_v3(answers(spark, d)).select("source_file", F.col("analyzer_version").alias("v3"), F.col("pin_specifications.total_pin_count").alias("pins"))
    return a.join(b, "source_file")


@query("rsp22_summaries", "SELECT source_file, 'Resolution: ' || (k % 800 + 100) || ' × ' || (s + 100) || ' pixels' AS line FROM answers_")
def _(spark, d):
    return A.summary_v2(A.record_v2(answers(spark, d))).select("source_file", F.get(F.split("report", "\n"), F.lit(1)).alias("line"))


@query("rsp23_batch_outcome", "SELECT count_if(event_type <> 'error')::BIGINT AS successful, count(*) AS total, count_if(event_type = 'error')::BIGINT AS failed FROM events")
def _(spark, d):
    return A.batch_outcome(given(spark, d, "events").select((F.col("event_type") != "error").alias("ok")))


# ---------------------------------------------------------------- crawls


def links(spark, d) -> DataFrame:
    """Anchors of the given pages."""
    return W.hrefs(given(spark, d, "pages").select("page_id", "url", "html"))


A_SQL = """a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)))) AS pos FROM pages)"""


@query("crl1_hrefs", f"WITH {A_SQL} SELECT page_id, pos::INTEGER AS pos, href FROM a")
def _(spark, d):
    return links(spark, d).select("page_id", "pos", "href")


@query("crl1_anchors_with_text", f"WITH {A_SQL} SELECT page_id, pos::INTEGER AS pos, href FROM a")
def _(spark, d):
    return W.anchors(given(spark, d, "pages")).select("page_id", "pos", "href")


@query("crl2_resolved", f"WITH {A_SQL} SELECT page_id, pos::INTEGER AS pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link FROM a WHERE regexp_matches(href, '^/[A-Za-z]+$')")
def _(spark, d):
    return links(spark, d).where("href rlike '^/[A-Za-z]+$'").select("page_id", "pos", W.resolved("url", "href").alias("link"))


@query("crl2_all_resolved", f"""WITH {A_SQL}, u AS (SELECT page_id, pos, href, regexp_extract(url, '^([a-z]+:)', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, pos::INTEGER AS pos, CASE WHEN href = '' THEN site || path WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN site || href
  ELSE site || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || href END AS link FROM u""")
def _(spark, d):
    """Every link of every page; the pages have no links with dot segments, empty queries or parameters, so that SQL needs none of it."""
    return links(spark, d).select("page_id", "pos", W.resolved("url", "href").alias("link"))


@query("crl2_dot_segments", "SELECT event_id, 'https://h' || (event_id % 11) || '.example.com/f/' || CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN '' WHEN 2 THEN 'y/z?k=1' WHEN 3 THEN '' ELSE (event_id % 900) || CASE WHEN event_id % 3 = 0 THEN '.pdf' ELSE '' END || '#top' END AS link FROM events")
def _(spark, d):
    link = F.expr("CASE event_id % 5 WHEN 0 THEN './x' WHEN 1 THEN '.' WHEN 2 THEN '../f/./y/z?k=1' WHEN 3 THEN '../../g/../f/' ELSE '#top' END")
    return derived(spark, d, "fetches").select("event_id", W.resolved(F.col("url"), link).alias("link"))


@query("crl3_pdf_links", "SELECT event_id, contains(lower(url), '.pdf') AS contains, ends_with(url, '.pdf') AS ends FROM fetches")
def _(spark, d):
    return derived(spark, d, "fetches").select("event_id", W.is_pdf_link(F.col("url")).alias("contains"), W.is_pdf_link(F.col("url"), variant="ends").alias("ends"))


@query("crl4_capped", f"WITH {A_SQL} SELECT site, page_id, pos::INTEGER AS pos FROM (SELECT regexp_extract(url, '://([^/]*)', 1) AS site, page_id, pos, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]*)', 1) ORDER BY page_id, pos) AS i FROM a) WHERE i <= 20")
def _(spark, d):
    own = links(spark, d).withColumn("site", F.regexp_extract("url", "://([^/]*)", 1)).withColumnsRenamed({"pos": "p"})
    return W.capped(own.withColumn("pos", F.struct("page_id", "p")), "site").select("site", "page_id", F.col("p").alias("pos"))


@query("crl5_manufacturers", f"WITH {A_SQL} SELECT page_id, pos::INTEGER AS pos, substr(href, 2) AS name FROM a WHERE starts_with(href, '/') AND length(href) - length(replace(href, '/', '')) = 1 AND starts_with(upper(substr(href, 2)), 'E')")
def _(spark, d):
    return W.manufacturers(links(spark, d), "E").select("page_id", "pos", "name")


def catalogue(spark, d) -> DataFrame:
    """Links of catalogue pages: orders' lines as links of customers' pages."""
    own = given(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("m")).join(given(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("n"), "l_partkey"), "o_orderkey")
    part = F.col("l_partkey").cast("string")
    kind = F.col("l_partkey") % 7
    href = F.when(kind == 0, F.concat(F.lit("/manufacturers/m-"), (F.col("l_partkey") % 50).cast("string"))).when(kind == 1, F.concat(F.lit("/products/"), (F.col("l_partkey") % 20).cast("string"))).when(kind == 2, F.concat(F.lit("/parts/"), part)).when(kind == 3, F.concat(F.lit("/x/"), part, F.lit(".pdf"))).otherwise(F.concat(F.lit("/y/z"), part))
    text = F.when(kind == 1, F.lit("Widgets")).when(kind == 2, F.concat(F.lit("PN-"), part)).when(kind == 3, F.lit("Datasheet")).otherwise(F.lit("more"))
    return own.select("m", (F.col("o_orderkey") * 100000 + F.col("n") * 10000 + F.col("l_partkey") % 10000).alias("pos"), href.alias("href"), text.alias("text"), F.col("l_partkey").alias("k"))


CAT = """cat AS (SELECT o_custkey AS m, o_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS pos, l_partkey AS k,
  CASE l_partkey % 7 WHEN 0 THEN '/manufacturers/m-' || (l_partkey % 50) WHEN 1 THEN '/products/' || (l_partkey % 20) WHEN 2 THEN '/parts/' || l_partkey WHEN 3 THEN '/x/' || l_partkey || '.pdf' ELSE '/y/z' || l_partkey END AS href
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


@query("crl6_manufacturers_by_letter", f"WITH {CAT} SELECT m, 'm-' || (k % 50) AS slug, 'm ' || (k % 50) AS name, min(pos) AS pos FROM cat WHERE k % 7 = 0 GROUP BY m, k % 50")
def _(spark, d):
    return W.manufacturers_by_letter(catalogue(spark, d).withColumn("letter", F.col("m").cast("string"))).select("m", "slug", "name", "pos")


@query("crl7_component_links", f"WITH {CAT} SELECT DISTINCT m, href FROM cat")
def _(spark, d):
    return W.component_links(catalogue(spark, d), ["m"])


@query("crl8_categories", f"WITH {CAT} SELECT m, href, min(pos) AS pos FROM cat WHERE k % 7 = 1 OR (k % 7 = 2 AND m NOT IN (SELECT m FROM cat WHERE k % 7 = 1)) GROUP BY ALL")
def _(spark, d):
    return W.categories(catalogue(spark, d), ["m"]).select("m", "href", "pos")


def paged(spark, d) -> DataFrame:
    """Listing pages: two parts' links a page, and a Next link on all but every fifth."""
    own = catalogue(spark, d)
    i = F.row_number().over(Window.partitionBy("m").orderBy("pos", "k"))
    own = own.withColumn("page", F.ceil(i / 2).cast("int"))
    nxt = own.select("m", "page").distinct().where("(m + page) % 5 <> 0").select("m", "page", F.lit(9_000_000_000).alias("pos"), F.lit("?next").alias("href"), F.lit("Next").alias("text"), F.lit(0).cast("long").alias("k"))
    return own.select("m", "page", "pos", "href", "text", "k").unionByName(nxt)


PAGED = """pg AS (SELECT *, (row_number() OVER (PARTITION BY m ORDER BY pos, k) + 1) // 2 AS page FROM cat),
st AS (SELECT m, page, count_if(k % 7 = 2) AS n, (m + page) % 5 <> 0 AS nx FROM pg GROUP BY ALL),
cut AS (SELECT m, coalesce(min(page) FILTER (n = 0 OR NOT nx), 1000) AS last FROM st GROUP BY m)"""


@query("crl9_products", f"WITH {CAT}, {PAGED} SELECT m, href, 'PN-' || k AS part_number, page::INTEGER AS page FROM (SELECT pg.*, row_number() OVER (PARTITION BY pg.m, href ORDER BY page, pos) AS i FROM pg JOIN cut ON cut.m = pg.m WHERE page <= last AND page <= 50 AND k % 7 = 2) WHERE i = 1")
def _(spark, d):
    return W.products(paged(spark, d), ["m"]).where("part_number like 'PN-%'").select("m", "href", "part_number", "page")


@query("crl10_has_next", f"WITH {CAT}, {PAGED} SELECT m, page::INTEGER AS page, nx AS has_next FROM st")
def _(spark, d):
    return W.has_next(paged(spark, d), ["m", "page"])


@query("crl11_datasheet_links", f"WITH {CAT} SELECT m, href, k || '.pdf' AS filename, 0 AS pass FROM cat WHERE k % 7 = 3 UNION ALL SELECT DISTINCT m, '/y/z' || k || '.pdf', 'z' || k || '.pdf', 1 FROM cat WHERE k % 7 = 4")
def _(spark, d):
    own = catalogue(spark, d).withColumn("part_number", F.col("k").cast("string"))
    sections = own.where("k % 7 in (3, 4)").withColumn("href", F.when(F.col("k") % 7 == 4, F.concat("href", F.lit(".pdf"))).otherwise(F.col("href")))
    return W.datasheet_links(own, sections, ["m"]).select("m", "href", "filename", "pass")


@query("crl12_button_links", "SELECT page_id, '/get/' || page_id AS href FROM pages")
def _(spark, d):
    page = F.concat(F.col("html"), F.lit('<div data-testid="datasheet-button"><b><a href="/get/'), F.col("page_id").cast("string"), F.lit('">x</a><a href="/other">y</a></b></div><a href="/end">e</a>'))
    return W.button_links(W.anchors(given(spark, d, "pages").withColumn("html", page)), ["page_id"])


@query("crl13_discovered", "SELECT 'p' || page_id AS name FROM pages WHERE page_id % 4 = 0 UNION SELECT 'Datasheets_' || (page_id % 9) FROM pages WHERE page_id % 4 = 0")
def _(spark, d):
    own = given(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), F.concat(F.lit("/wiki/Datasheets_"), (F.col("page_id") % 9).cast("string")).alias("href"), "page_id")
    return W.discovered(own.where("page_id % 4 = 0"), own)


@query("crl14_wiki_pdfs", "SELECT category, url, min(hop)::INTEGER AS hop FROM (SELECT l_suppkey AS category, CASE WHEN l_partkey % 3 = 0 THEN '/wiki/File:' || l_partkey || '.pdf' ELSE '/d/' || l_partkey || '.pdf' END AS url, 0 AS hop FROM lineitem UNION ALL SELECT l_suppkey, '/real/' || l_partkey || '.pdf', 1 FROM lineitem WHERE l_partkey % 3 = 0) GROUP BY ALL")
def _(spark, d):
    li = given(spark, d, "lineitem")
    part = F.col("l_partkey").cast("string")
    own = li.select(F.col("l_suppkey").alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("/wiki/File:"), part, F.lit(".pdf"))).otherwise(F.concat(F.lit("/d/"), part, F.lit(".pdf"))).alias("href"))
    files = given(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("/wiki/File:"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("file_href"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("/no").alias("href")), F.struct(F.lit(1).alias("pos"), F.concat(F.lit("/real/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("href")))).alias("l")).select("file_href", "l.pos", "l.href")
    return W.wiki_pdfs(own, files).select("category", "url", "hop")


@query("crl15_first_per_url", "SELECT url, min(event_id) AS event_id FROM fetches GROUP BY url")
def _(spark, d):
    return W.first_per(derived(spark, d, "fetches"), ["url"], ["event_id"]).select("url", "event_id")


@query("crl16_not_downloaded", "SELECT DISTINCT url FROM fetches WHERE url NOT IN (SELECT url FROM fetches WHERE status = 'success')")
def _(spark, d):
    f = derived(spark, d, "fetches")
    return W.not_downloaded(f.select("url").distinct(), f)


@query("crl17_batches", "SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50)::BIGINT AS batch, ceil(count(*) OVER (PARTITION BY user_id) / 50.0)::BIGINT AS n_batches FROM events")
def _(spark, d):
    return W.batched(given(spark, d, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], 50).select("event_id", "batch", "n_batches")


@query("crl18_resumed", "SELECT event_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE CASE user_id % 3 WHEN 0 THEN i >= 4 WHEN 1 THEN i >= 3 ELSE TRUE END")
def _(spark, d):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    items = given(spark, d, "events").select("user_id", "event_id").withColumn("name", F.concat(F.lit("n"), i.cast("string")))
    progress = items.select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 3 == 0, "n3").alias("last_completed"), F.when(F.col("user_id") % 3 == 1, "n3").when(F.col("user_id") % 3 == 2, "gone").alias("current"))
    return W.resumed(items, progress, ["user_id"], ["event_id"]).select("event_id")


@query("crl19_not_completed", "SELECT event_id FROM events WHERE NOT (user_id % 2 = 0 AND event_type = 'view')")
def _(spark, d):
    e = given(spark, d, "events")
    return W.not_completed(e, e.where("user_id % 2 = 0 and event_type = 'view'"), ["user_id", "event_type"]).select("event_id")


@query("crl20_outcome_totals", "SELECT user_id, day, success, error, skipped, (sum(success) OVER w)::BIGINT AS success_so_far FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count_if(status = 'success')::BIGINT AS success, count_if(status = 'error')::BIGINT AS error, count_if(status = 'skipped')::BIGINT AS skipped FROM fetches GROUP BY ALL) WINDOW w AS (PARTITION BY user_id ORDER BY day)")
def _(spark, d):
    own = derived(spark, d, "fetches").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return W.outcome_totals(own, ["user_id", "day"]).select("user_id", "day", "success", "error", "skipped", "success_so_far")


@query("crl20_totals_by_url", "SELECT url, success, error, skipped, (sum(success) OVER w)::BIGINT AS success_so_far, (sum(error) OVER w)::BIGINT AS error_so_far, (sum(skipped) OVER w)::BIGINT AS skipped_so_far FROM (SELECT url, count_if(status = 'success')::BIGINT AS success, count_if(status = 'error')::BIGINT AS error, count_if(status = 'skipped')::BIGINT AS skipped FROM fetches GROUP BY ALL) WINDOW w AS (ORDER BY url)")
def _(spark, d):
    return W.outcome_totals(derived(spark, d, "fetches"), ["url"])


@query("crl21_sanitized", "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_brand || '_v.pdf' AS name FROM part")
def _(spark, d):
    return given(spark, d, "part").select("p_partkey", W.sanitized(F.concat(F.lit("._"), "p_name", F.lit(" \t"), "p_brand", F.lit("?v.pdf_"))).alias("name"))


@query("crl22_filenames", "SELECT event_id, CASE WHEN ends_with(url, '.pdf') THEN regexp_extract(url, '([^/]*)$', 1) ELSE 'u' || user_id || '.pdf' END AS name FROM fetches")
def _(spark, d):
    return derived(spark, d, "fetches").select("event_id", W.filename_from_url(F.col("url"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("name"))


@query("crl23_header_filenames", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a_b_' || event_id || '.pdf' WHEN 1 THEN 'q_' || event_id || '.pdf' WHEN 2 THEN 'bare' || event_id ELSE 'file_' || substr(sha256('https://x.example.com/' || event_id || '/'), 1, 8) END AS name FROM events")
def _(spark, d):
    k = F.col("event_id").cast("string")
    cd = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("attachment; filename*=UTF-8''a%20b%20"), k, F.lit(".pdf"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('attachment; filename="q '), k, F.lit('.pdf"'))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("filename=bare"), k, F.lit("; x=1")))
    return given(spark, d, "events").select("event_id", W.filename_from_headers(F.concat(F.lit("https://x.example.com/"), k, F.lit("/")), cd).alias("name"))


@query("crl24_unique_names", "SELECT l_suppkey, n_rows, n_names FROM (SELECT l_suppkey, count(*) AS n_rows, count(*) AS n_names FROM lineitem GROUP BY ALL)")
def _(spark, d):
    own = given(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("f"), (F.col("l_partkey") % 9).cast("string"), F.when(F.col("l_partkey") % 5 == 0, "-1").otherwise(""), F.lit(".pdf")).alias("filename"))
    named = W.unique_names(own, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return named.groupBy("l_suppkey").agg(F.count("*").alias("n_rows"), F.countDistinct("unique_name").alias("n_names"))


@query("crl24_numbered_names", """
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_partkey % 9 AS f, l_partkey % 5 = 0 AS b FROM lineitem),
o AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, f, b ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS n,
    row_number() OVER (PARTITION BY l_suppkey, f ORDER BY l_orderkey, l_linenumber, l_partkey) AS t FROM r),
w AS (SELECT l_suppkey, f, coalesce(min(t) FILTER (b), 1e18) < coalesce(min(t) FILTER (NOT b AND n = 1), 1e18) AS asked_first FROM o GROUP BY ALL)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, 'f' || f || CASE WHEN b AND asked_first AND n = 0 THEN '-1' WHEN b AND asked_first THEN '-1-' || n WHEN b THEN '-1-' || (n + 1)
  WHEN n = 0 THEN '' WHEN asked_first THEN '-' || (n + 1) ELSE '-' || n END || '.pdf' AS unique_name
FROM o JOIN w USING (l_suppkey, f)""")
def _(spark, d):
    """Names f.pdf and f-1.pdf in one folder: whoever comes first to f-1.pdf has it."""
    columns = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
    own = given(spark, d, "lineitem").select(*columns, F.concat(F.lit("f"), (F.col("l_partkey") % 9).cast("string"), F.when(F.col("l_partkey") % 5 == 0, "-1").otherwise(""), F.lit(".pdf")).alias("filename"))
    return W.unique_names(own, ["l_suppkey"], columns[1:]).select(*columns, "unique_name")


@query("crl25_content_types", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN NULL ELSE 'text/' || event_type END AS kind FROM events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, "Application/PDF ; charset=utf-8").when(F.col("event_id") % 3 == 1, " ;x").otherwise(F.concat(F.lit(" text/"), F.upper("event_type")))
    return given(spark, d, "events").select("event_id", W.content_type(raw).alias("kind"))


@query("crl26_fetch_outcomes", "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'Unsupported URL scheme' WHEN 2 THEN 'File too large (60000000 bytes > 52428800)' WHEN 3 THEN 'HTTP error 404' WHEN 4 THEN 'File exceeded max size while downloading (> 52428800 bytes)' END AS error, event_id % 6 IN (0) AS ok FROM events WHERE event_id % 6 <> 5")
def _(spark, d):
    m = F.col("event_id") % 6
    log = given(spark, d, "events").select("event_id", F.when(m == 5, "  ").when(m == 1, "ftp://a").otherwise("https://a").alias("url"), F.when(m == 3, 404).otherwise(200).alias("http_status"), F.when(m == 2, 60_000_000).alias("content_length"), F.when(m == 4, 60_000_000).otherwise(5).alias("bytes"))
    return W.fetch_outcome(log).select("event_id", "error", "ok")


@query("crl27_invalid_payloads", "SELECT page_id, strlen(html) < 1000 OR contains(lower(substr(html, 1, 100)), '<html') AS invalid, FALSE AS invalid_wiki FROM pages")
def _(spark, d):
    body = F.encode("html", "utf-8")
    return given(spark, d, "pages").select("page_id", W.invalid_payload(body).alias("invalid"), W.invalid_payload(body, F.lit("application/pdf")).alias("invalid_wiki"))


# ---------------------------------------------------------------- sources and schematics


def schematic_texts(spark, d) -> DataFrame:
    """A schematic file's text for each customer, put together from its wires and components.

    Texts are joined by sort and merge: the planner knows their keys' files, not their lengths, and would broadcast them.
    Components are dealt over all tasks before their texts are made: their columns are shorter, and few bytes do not make tasks fewer.
    """
    s = lambda c: F.col(c).cast("string")
    wires = derived(spark, d, "wires")
    wire = F.concat(F.lit("(wire (pts (xy "), s("x1"), F.lit(" "), s("y1"), F.lit(") (xy "), s("x2"), F.lit(" "), s("y2"), F.lit(")))\n(label \"L"), s("ordinal"), F.lit("\" (at "), s("x1"), F.lit(" "), s("y1"), F.lit(" 90))\n(junction (at "), s("x2"), F.lit(" "), s("y2"), F.lit("))"))
    wires = wires.groupBy("schematic_id").agg(F.array_join(ordered(F.struct("ordinal", wire.alias("w")), "w"), "\n").alias("wires"))
    prop = lambda n, c: F.concat(F.lit(f' (property "{n}" "'), c, F.lit('" (at 1 2 0) (effects (font (size 1.27 1.27))))'))
    sym = F.concat(F.lit('(symbol (lib_id "'), F.col("library_id"), F.lit('") (at '), s("x"), F.lit(" "), s("y"), F.lit(" 0)"), prop("Reference", F.col("reference")), prop("Value", F.lit("old")), prop("Value", F.col("value")), prop("Datasheet", F.col("datasheet")), F.lit(' (pin "1" (uuid 0)))'))
    symbols = spread(comps(spark, d), "schematic_id").groupBy("schematic_id").agg(F.array_join(ordered(F.struct("ordinal", sym.alias("w")), "w"), "\n").alias("symbols"))
    lib = '(lib_symbols (symbol "Device:R" (property "Value" "R") (pin passive line (at 0 3.81 270) (length 1.27) (name "~") (number "1")) (rectangle)))'
    head = F.concat(F.lit('(kicad_sch (version 20211123) (generator eng) (uuid u'), s("schematic_id"), F.lit(') (paper "A4") (title_block (title "'), F.col("c_name"), F.lit('") (comment 1 "x") (rev "'), F.col("c_mktsegment"), F.lit('") (comment 2 "y"))\n' + lib + "\n"))
    own = given(spark, d, "customer").withColumnRenamed("c_custkey", "schematic_id").join(wires.hint("merge"), "schematic_id").join(symbols.hint("merge"), "schematic_id")
    text = F.concat(head, "wires", F.lit("\n"), "symbols", F.lit('\n(text "Note '), s("schematic_id"), F.lit('" (at 1 1 0)))'))
    return own.select("schematic_id", F.when(F.col("schematic_id") % 40 == 0, F.lit("(other)")).otherwise(text).alias("content"))


def rows(spark, d, *entities: str) -> DataFrame:
    return S.some_items(schematic_texts(spark, d), list(entities))


def last_symbols(spark, d, *fields: str) -> DataFrame:
    return S.last_of_references(S.table(schematic_texts(spark, d), "symbol", "reference", *fields))


FILES = "(SELECT DISTINCT schematic_id FROM comps WHERE schematic_id IN (SELECT schematic_id FROM wires) AND schematic_id % 40 <> 0)"


@query("src1_schematic_items", f"SELECT w.schematic_id, 'wire' AS entity, count(*) AS n FROM wires w WHERE schematic_id IN {FILES} GROUP BY ALL UNION ALL SELECT schematic_id, 'symbol', count(*) FROM comps WHERE schematic_id IN {FILES} GROUP BY ALL")
def _(spark, d):
    return S.item_names(schematic_texts(spark, d)).where("entity in ('wire', 'symbol')").groupBy("schematic_id", "entity").agg(F.count("*").alias("n"))


@query("src4_rejects", "SELECT DISTINCT schematic_id, 'not a schematic' AS error FROM comps WHERE schematic_id % 40 = 0 AND schematic_id IN (SELECT schematic_id FROM wires)")
def _(spark, d):
    return rows(spark, d, "reject").select("schematic_id", F.get_json_object("payload", "$.error").alias("error"))


@query("sch1_metadata", f"SELECT schematic_id, '20211123' AS version, 'eng' AS generator, 'u' || schematic_id AS uuid, 'A4' AS paper FROM {FILES}")
def _(spark, d):
    return S.metadata(rows(spark, d, "meta")).select("schematic_id", "version", "generator", "uuid", "paper")


@query("sch2_title_blocks", f"SELECT c_custkey AS schematic_id, c_name AS title, c_mktsegment AS rev, '2' AS comment FROM customer WHERE c_custkey IN {FILES}")
def _(spark, d):
    t = F.col("title_block")
    return S.title_blocks(rows(spark, d, "title")).select("schematic_id", t["title"].alias("title"), t["rev"].alias("rev"), t["comment"].alias("comment"))


@query("sch3_library_symbols", f"SELECT schematic_id, 'Device:R' AS id, 1 AS n_pins, 'rectangle' AS graphics FROM {FILES}")
def _(spark, d):
    return S.library_symbols(rows(spark, d, "library_symbol")).select("schematic_id", "id", F.size("pins").alias("n_pins"), F.array_join("graphics", ",").alias("graphics"))


@query("sch4_library_pins", f"SELECT schematic_id, '1' AS number, 'passive' AS type, 3.81::DOUBLE AS y, 270.0::DOUBLE AS orientation FROM {FILES}")
def _(spark, d):
    return S.library_pins(rows(spark, d, "library_symbol")).select("schematic_id", "number", "type", "y", "orientation")


@query("sch5_wires", f"SELECT schematic_id, x1, y1, x2, y2 FROM wires WHERE schematic_id IN {FILES}")
def _(spark, d):
    return S.table(schematic_texts(spark, d), "wire").select("schematic_id", "x1", "y1", "x2", "y2")


@query("sch6_junctions", f"SELECT schematic_id, x2 AS x, y2 AS y FROM wires WHERE schematic_id IN {FILES}")
def _(spark, d):
    return S.table(schematic_texts(spark, d), "junction").select("schematic_id", "x", "y")


@query("sch7_labels", f"SELECT schematic_id, 'L' || ordinal AS text, 'label' AS type, x1 AS x, 90.0::DOUBLE AS rotation FROM wires WHERE schematic_id IN {FILES}")
def _(spark, d):
    return S.table(schematic_texts(spark, d), "label", "text", "type", "x", "rotation").select("schematic_id", "text", "type", "x", "rotation")


@query("sch8_components", f"SELECT schematic_id, reference, value, library_id, x, y FROM comps WHERE schematic_id IN {FILES}")
def _(spark, d):
    return last_symbols(spark, d, "value", "library_id", "x", "y").select("schematic_id", "reference", "value", "library_id", "x", "y")


@query("sch9_component_pins", f"SELECT schematic_id, reference, '' AS number, 0.0::DOUBLE AS x FROM comps WHERE schematic_id IN {FILES}")
def _(spark, d):
    return S.pins_of(last_symbols(spark, d, "pins")).select("schematic_id", "reference", "number", "x")


IN_FILES = """WITH c AS MATERIALIZED (SELECT * FROM comps), w AS MATERIALIZED (SELECT DISTINCT schematic_id FROM wires),
f AS MATERIALIZED (SELECT c.* FROM c JOIN w ON w.schematic_id = c.schematic_id WHERE c.schematic_id % 40 <> 0)"""


@query("sch8_all_components", f"{IN_FILES} SELECT schematic_id, reference, value, library_id, x, y, 0.0::DOUBLE AS rotation FROM f")
def _(spark, d):
    return last_symbols(spark, d, "value", "library_id", "x", "y", "rotation").select("schematic_id", "reference", "value", "library_id", "x", "y", "rotation")


@query("sch9_all_pins", f"{IN_FILES} SELECT schematic_id, reference, library_id, count(*)::BIGINT AS pins FROM f GROUP BY ALL")
def _(spark, d):
    pins = S.pins_of(last_symbols(spark, d, "library_id", "pins"), "library_id")
    return pins.groupBy("schematic_id", "reference", "library_id").agg(F.count("*").alias("pins"))


@query("sch10_component_properties", f"SELECT schematic_id, reference, 'Reference' AS name, reference AS value FROM comps WHERE schematic_id IN {FILES} UNION ALL SELECT schematic_id, reference, 'Value', value FROM comps WHERE schematic_id IN {FILES} UNION ALL SELECT schematic_id, reference, 'Datasheet', datasheet FROM comps WHERE schematic_id IN {FILES}")
def _(spark, d):
    return S.properties_of(last_symbols(spark, d, "properties")).select("schematic_id", "reference", "name", "value")


@query("sch11_annotations", f"SELECT schematic_id, 'Note ' || schematic_id AS text FROM {FILES}")
def _(spark, d):
    return S.annotations(rows(spark, d, "text")).select("schematic_id", F.array_join(F.col("annotations.text"), ";").alias("text"))


@query("sch12_stamps", "SELECT o_orderkey, 'f' || o_orderkey AS original_filename, epoch(o_orderdate)::BIGINT AS parsed_date_unix, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S UTC') AS parsed_date_readable FROM orders")
def _(spark, d):
    o = given(spark, d, "orders")
    return S.stamped(o, F.concat(F.lit("f"), F.col("o_orderkey").cast("string")), F.col("o_orderdate").cast("timestamp")).select("o_orderkey", "original_filename", "parsed_date_unix", "parsed_date_readable")


@query("sch13_statistics", f"SELECT f.schematic_id, (SELECT count(*) FROM wires w WHERE w.schematic_id = f.schematic_id) AS n_wire, (SELECT count(*) FROM comps c WHERE c.schematic_id = f.schematic_id) AS n_symbol, 1::BIGINT AS n_library_symbol FROM {FILES} f")
def _(spark, d):
    return S.statistics(S.item_names(schematic_texts(spark, d)).where("entity <> 'reject'")).select("schematic_id", "n_wire", "n_symbol", "n_library_symbol")


@query("sch14_listed", "SELECT schematic_id, reference, greatest(0, n - 10)::BIGINT AS more FROM (SELECT *, row_number() OVER (PARTITION BY schematic_id ORDER BY ordinal) AS i, count(*) OVER (PARTITION BY schematic_id) AS n FROM comps) WHERE i <= 10")
def _(spark, d):
    return S.listed(comps(spark, d), ["schematic_id"], ["ordinal"], 10).select("schematic_id", "reference", "more")


def document_json(spark, d) -> DataFrame:
    """A document of JSON for each schematic: components by reference with properties."""
    prop = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("value"), F.struct(F.lit(1).alias("font")).alias("effects"))
    one = F.struct("reference", "value", "library_id", F.struct("x", "y").alias("position"), F.struct(prop("Datasheet", "datasheet").alias("Datasheet"), prop("mpn", "mpn").alias("mpn")).alias("properties"))
    own = comps(spark, d).groupBy("schematic_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "reference", one.alias("c")))), lambda x: F.struct(x["reference"], x["c"]))).alias("components"))
    return own.select("schematic_id", F.to_json(F.struct("components")).alias("json"))


@query("sch15_cleaned_json", "SELECT schematic_id, count_if(datasheet NOT IN ('', '~'))::BIGINT AS datasheets, 0::BIGINT AS effects, count(*) AS parts FROM comps GROUP BY ALL")
def _(spark, d):
    j = S.cleaned_json(document_json(spark, d))
    n = lambda w: F.size(F.regexp_extract_all("json", F.lit(w), F.lit(0))).cast("long")
    return j.select("schematic_id", n('"Datasheet": \\{').alias("datasheets"), n('"effects"').alias("effects"), n('"library_id"').alias("parts"))


@query("src5_documents", "SELECT schematic_id, reference, value, x, datasheet FROM comps")
def _(spark, d):
    docs = S2.documents(document_json(spark, d))
    return S2.document_components(docs).select("schematic_id", "reference", "value", "x", F.col("properties")["Datasheet"].alias("datasheet"))


@query("src6_analysis_parts", "SELECT event_id AS schematic_id, 'n' || event_id AS name, (props->>'k')::VARCHAR AS net_type FROM events WHERE event_id % 2 = 0")
def _(spark, d):
    k = F.col("event_id").cast("string")
    own = given(spark, d, "events").select(F.col("event_id").alias("schematic_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"analysis":{"nets":[{"name":"n'), k, F.lit('","net_type":"'), F.get_json_object("props", "$.k"), F.lit('"}]}}'))).otherwise('{"analysis":{}}').alias("json"))
    return S2.analysis_part(own, "nets").select("schematic_id", "name", "net_type")


@query("src3_settings", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props->>'k' ELSE 'none' END AS k, 'round' AS shape FROM events")
def _(spark, d):
    own = given(spark, d, "events").withColumn("s", F.from_json(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{}"), "k string, shape string"))
    return own.select("event_id", S2.over_defaults(F.col("s"), {"k": F.lit("none"), "shape": F.lit("round")}).alias("s")).select("event_id", "s.*")


@query("src8_pages_for", "SELECT page_id FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def _(spark, d):
    p = given(spark, d, "pages")
    return S2.pages_for(p, p.where("page_id % 3 = 0")).select("page_id")


@query("src15_headed_texts", "SELECT conv_id, turn, length(text)::BIGINT + 1 AS n FROM conversations")
def _(spark, d):
    own = given(spark, d, "conversations").select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("source_file"), "text")
    headed = S2.with_header(own.where("text is not null"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    v = F.split("value", "\n", 10)
    key = F.split(F.regexp_extract(F.get(v, F.lit(3)), "Source: (.*)", 1), "/")
    return headed.select(F.get(key, F.lit(0)).cast("long").alias("conv_id"), F.get(key, F.lit(1)).cast("long").alias("turn"), (F.regexp_extract(F.get(v, F.lit(5)), r"Length: (\d+)", 1).cast("long") + 1).alias("n"))


@query("src16_messages", """SELECT event_id::VARCHAR AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value, event_type AS header FROM events""")
def _(spark, d):
    own = given(spark, d, "events").select("event_id", "event_type")
    return S2.as_messages(own, {"MessageType": F.col("event_type")}, "event_id").select("key", "value", F.decode(F.get("headers", F.lit(0))["value"], "UTF-8").alias("header"))


def written(spark, write, *frames) -> str:
    """A new folder in the shared one, with frames written to it."""
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    for f in frames:
        write(f, path)
    return path


@query("src7_text_files", "SELECT count(*) AS n_lines, count(DISTINCT role) AS n_roles FROM conversations")
def _(spark, d):
    own = given(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("value"), "role")
    path = written(spark, lambda df, p: df.write.partitionBy("role").text(p), own)
    found = S2.text_files(spark, path)
    role = F.regexp_extract("file_path", "role=([^/]*)/", 1)
    return found.agg(F.sum(F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"), F.countDistinct(role).alias("n_roles"))


@query("src9_download_log", "SELECT event_id::VARCHAR AS filename, url, status FROM fetches")
def _(spark, d):
    f = derived(spark, d, "fetches")
    none = F.lit("").alias
    log = f.select(F.col("ts").cast("string").alias("timestamp"), F.col("event_id").cast("string").alias("filename"), "url", none("manufacturer"), none("category"), none("part_number"), "status", F.lit("1").alias("script_version"), F.lit('a "quoted", error').alias("error_message"))
    path = written(spark, lambda df, p: S2.append_download_log(df, p), log.where("filename % 2 = 0"))
    for _ in range(2):  # the batch that is repeated under its name is appended once
        S2.append_download_log(log.where("filename % 2 = 1"), path, "odd")
    return S2.read_download_log(spark, path).select("filename", "url", "status")


@query("src10_targets", "SELECT s_name AS name, 'https://s' || s_suppkey || '.example.com' AS website, n_name AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    own = given(spark, d, "supplier").join(given(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    target = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("website"), F.col("n_name").alias("category"))
    lists = own.groupBy("n_nationkey").agg(F.to_json(F.collect_list(target)).alias("value"))
    path = written(spark, lambda df, p: df.write.partitionBy("n_nationkey").text(p), lists)
    return S2.read_targets(spark, path).select("name", "website", "category")


@query("src12_jsonl_sink", "SELECT md5(text) AS text, source, 'U1' AS component FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT md5(text), source, NULL FROM documents WHERE doc_id % 2 = 1")
def _(spark, d):
    path = written(spark, S2.write_jsonl, K.jsonl_records(plain_chunks(spark, d)))
    back = spark.read.schema("text string, metadata struct<source:string,component:string>").json(path)
    return back.select(F.md5("text").alias("text"), "metadata.source", "metadata.component")


@query("src13_csv_sink", "SELECT 'c' || doc_id AS id, md5(text) AS text, CASE WHEN doc_id % 2 = 0 THEN 'U1' END AS component_name FROM documents")
def _(spark, d):
    path = written(spark, S2.write_csv, K.csv_rows(plain_chunks(spark, d)).withColumn("text", F.md5("text")))
    back = spark.read.option("header", "true").option("escape", '"').schema("id string, text string, chunk_type string, source_file string, component_name string, manufacturer string, section string, metadata_json string").csv(path)
    return back.select("id", "text", "component_name")


@query("src14_sink_per_source", "SELECT source AS source_file, doc_id, length(text)::BIGINT AS n FROM documents")
def _(spark, d):
    own = given(spark, d, "documents").select(F.col("source").alias("source_file"), "doc_id", F.length("text").cast("long").alias("n"))
    path = written(spark, S2.write_per_source, own)
    return spark.read.schema("doc_id long, n long, source_file string").json(path).select("source_file", "doc_id", "n")


# ---------------------------------------------------------------- boards


@query("src2_board_items", "SELECT n_nationkey AS schematic_id, 2::BIGINT AS segments, 1::BIGINT AS nets FROM nation")
def _(spark, d):
    k = F.col("n_nationkey").cast("string")
    seg = F.concat(F.lit("(segment (start 0 0) (end "), k, F.lit(' 2) (width 0.2) (layer "F.Cu") (net 1))'))
    own = given(spark, d, "nation").select(F.col("n_nationkey").alias("schematic_id"), F.concat(F.lit('(kicad_pcb (version 1) (net 1 "N'), k, F.lit('")'), seg, seg, F.lit(")")).alias("content"))
    r = S.items(own, "board")
    return r.groupBy("schematic_id").agg(F.count_if(F.col("entity") == "segment").alias("segments"), F.count_if(F.col("entity") == "net").alias("nets"))


def board_tables(spark, d) -> dict[str, DataFrame]:
    li = given(spark, d, "lineitem").select(F.col("l_suppkey").alias("board_id"), (F.col("l_partkey") % 20).cast("int").alias("net"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_returnflag").alias("f"))
    return {"segment": li.where("f = 'N'"), "via": li.where("f = 'A'"), "pad": li.where("f = 'R'")}


@query("brd1_net_members", "SELECT l_suppkey AS board_id, (l_partkey % 20)::INTEGER AS net, CASE l_returnflag WHEN 'N' THEN 'segment' WHEN 'A' THEN 'via' ELSE 'pad' END AS entity, count(*) AS n FROM lineitem WHERE l_partkey % 20 > 0 GROUP BY ALL")
def _(spark, d):
    return B.net_members(board_tables(spark, d)).groupBy("board_id", "net", "entity").agg(F.count("*").alias("n"))


@query("brd2_footprints_by_side", "SELECT schematic_id, reference, CASE WHEN ordinal % 2 = 0 THEN 'Front' ELSE 'Back' END AS side, CASE WHEN ordinal % 5 = 0 THEN 'VAL' ELSE value END AS value FROM comps")
def _(spark, d):
    own = comps(spark, d).withColumns({"layer": F.when(F.col("ordinal") % 2 == 0, "F.Cu").otherwise("B.Cu"), "value": F.when(F.col("ordinal") % 5 != 0, F.col("value"))})
    return B.footprints_by_side(own).select("schematic_id", "reference", "side", "value")


@query("brd5_footprint_boxes", "SELECT schematic_id, reference, CASE WHEN ordinal % 2 = 0 THEN x - 0.5 ELSE x - 2 END AS x1, CASE WHEN ordinal % 2 = 0 THEN x + 0.5 ELSE x + 3 END AS x2 FROM comps")
def _(spark, d):
    f = comps(spark, d).withColumn("rotation", F.lit(0.0))
    drawings = f.where("ordinal % 2 = 1").select("schematic_id", "reference", F.lit(3.0).alias("x1"), F.lit(-0.1).alias("y1"), F.lit(-2.0).alias("x2"), F.lit(0.1).alias("y2"))
    return B.footprint_boxes(f.select("schematic_id", "reference", "x", "y", "rotation"), drawings, ["schematic_id"]).select("schematic_id", "reference", "x1", "x2")


@query("brd7_board_summary", f"SELECT l.board_id, segments, vias, coalesce(width, 0) AS width FROM (SELECT l_suppkey AS board_id, count_if(l_returnflag = 'N')::BIGINT AS segments, count_if(l_returnflag = 'A')::BIGINT AS vias FROM lineitem WHERE l_returnflag IN ('N', 'A') GROUP BY ALL) l LEFT JOIN (SELECT board_id, max(x2) - min(x1) AS width FROM ({BOX_SQL}) WHERE x1 <= x2 GROUP BY ALL) b ON b.board_id = l.board_id")
def _(spark, d):
    t = board_tables(spark, d)
    drawings = boxes(spark, d).where("x1 <= x2").withColumn("layer", F.lit(B.OUTLINE)).withColumn("board_id", F.col("board_id").cast("long"))
    return B.board_summary({"segments": t["segment"], "vias": t["via"]}, drawings, ["board_id"]).select("board_id", "segments", "vias", "width")


@query("brd8_footprint_facts", "SELECT c.schematic_id, c.reference, CASE c.ordinal % 3 WHEN 0 THEN 'smd' WHEN 1 THEN 'through hole' ELSE 'unspecified' END AS kind, coalesce(n, 0)::BIGINT AS pads FROM comps c LEFT JOIN (SELECT schematic_id, reference, count(*) AS n FROM net_pins WHERE pos > 2 GROUP BY ALL) p ON p.schematic_id = c.schematic_id AND p.reference = c.reference")
def _(spark, d):
    f = comps(spark, d).withColumn("tags", F.expr("CASE ordinal % 3 WHEN 0 THEN 'smd x' WHEN 1 THEN 'through_hole' END"))
    return B.footprint_facts(f, derived(spark, d, "net_pins").where("pos > 2"), ["schematic_id"]).select("schematic_id", "reference", "kind", "pads")


# ---------------------------------------------------------------- streams, as batches; as streams they are in streams.py


def status_events(spark, d) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'click' THEN 'uploaded' WHEN 'view' THEN 'stage1_processing' WHEN 'signup' THEN 'stage1_complete' WHEN 'purchase' THEN 'completed' ELSE 'failed' END")
    return given(spark, d, "events").select(F.col("user_id").cast("string").alias("processing_id"), F.col("ts").cast("timestamp").alias("event_ts"), status.alias("status"), F.when(F.col("event_type") == "signup", F.get_json_object("props", "$.k").cast("long")).alias("component_count"), F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"), F.lit(None).cast("long").alias("net_count"))


@query("str1_link_results", "SELECT schematic_id, count(DISTINCT datasheet)::BIGINT AS datasheet_count FROM (SELECT schematic_id, CASE WHEN datasheet LIKE 'https://%' THEN datasheet END AS datasheet FROM comps) GROUP BY ALL")
def _(spark, d):
    return J.link_results(document_json(spark, d)).select("schematic_id", "datasheet_count")


@query("str2_unwrapped", "SELECT event_id::VARCHAR AS processing_id, event_type AS stage FROM events")
def _(spark, d):
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("processing_id"), F.col("event_type").alias("stage")))
    own = given(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.lit("Notification").alias("Type"), body.alias("Message")))).otherwise(body).alias("value"))
    return J.unwrapped(own).select("m.processing_id", "m.stage")


@query("str3_of_stage", "SELECT event_id::VARCHAR AS processing_id FROM events WHERE event_type = 'view'")
def _(spark, d):
    own = given(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("processing_id"), F.col("event_type").alias("stage"))).alias("value"))
    return J.of_stage(J.unwrapped(own), "view").select("m.processing_id")


@query("str4_intake", "SELECT event_id::VARCHAR AS processing_id, 'raw/' || event_id || '/f.' || CASE WHEN event_id % 2 = 0 THEN 'kicad_sch' ELSE 'txt' END AS s3_key, CASE WHEN event_id % 2 = 0 THEN 'kicad-schematic' ELSE 'unknown' END AS content_type, CASE WHEN user_id % 10 > 8 THEN 'File too large' END AS error FROM events")
def _(spark, d):
    own = given(spark, d, "events").select(F.col("event_id").cast("string").alias("processing_id"), F.when(F.col("event_id") % 2 == 0, "f.kicad_sch").otherwise("f.txt").alias("filename"), ((F.col("user_id") % 10) * 1_200_000).alias("file_size"), "ts")
    return J.intake(own).select("processing_id", "s3_key", "content_type", "error")


@query("str5_job_states", """
WITH e AS (SELECT user_id::VARCHAR AS processing_id, ts, CASE event_type WHEN 'click' THEN 'uploaded' WHEN 'view' THEN 'stage1_processing' WHEN 'signup' THEN 'stage1_complete' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN event_type = 'signup' THEN (props->>'k')::BIGINT END AS cc FROM events)
SELECT processing_id, arg_max(status, ts) AS status, arg_max(cc, ts) FILTER (cc IS NOT NULL) AS component_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created FROM e GROUP BY ALL""")
def _(spark, d):
    return J.job_states(status_events(spark, d), ["component_count", "error_message"]).select("processing_id", "status", "component_count", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


def results(spark, d) -> DataFrame:
    own = given(spark, d, "events").select(F.col("event_id").cast("string").alias("processing_id"), F.col("ts").alias("event_ts"), F.col("user_id").alias("component_count"), F.lit(3).cast("long").alias("net_count"), F.when(F.col("event_type") == "error", "bad file").alias("error"))
    return J.stage_results(own)


@query("str6_stage_results", "SELECT event_id::VARCHAR AS processing_id, CASE WHEN event_type = 'error' THEN 'stage1_failed' ELSE 'stage1_complete' END AS status, CASE WHEN event_type <> 'error' THEN user_id END AS component_count, CASE WHEN event_type = 'error' THEN 'bad file' END AS error_message FROM events")
def _(spark, d):
    return results(spark, d).select("processing_id", "status", "component_count", "error_message")


@query("str7_next_stage", """SELECT event_id::VARCHAR AS key, '{"processing_id":"' || event_id || '","stage":"stage2","s3_key":"stage1/' || event_id || '.json","component_count":' || user_id || ',"net_count":3}' AS value FROM events WHERE event_type <> 'error'""")
def _(spark, d):
    return J.next_stage(results(spark, d))


@query("str8_dead_letters", "SELECT user_id::VARCHAR AS key, count_if(event_type = 'error')::BIGINT AS receives FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id HAVING count_if(event_type = 'purchase') = 0 AND count_if(event_type = 'error') >= 3")
def _(spark, d):
    own = given(spark, d, "events").where("event_type in ('error', 'purchase')").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("event_ts"), (F.col("event_type") == "purchase").alias("ok"), F.lit("e").alias("error"))
    return J.dead_letters(own).select("key", "receives")


@query("str8_all_dead_letters", "SELECT user_id::VARCHAR AS key, count_if(value <= 200)::BIGINT AS receives FROM events GROUP BY user_id HAVING count_if(value > 200) = 0 AND count_if(value <= 200) >= 3")
def _(spark, d):
    """Every event is a receive, and worked if its value is over 200: by types of events no key would be left."""
    own = given(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("event_ts"), (F.col("value") > 200).alias("ok"), F.lit("e").alias("error"))
    return J.dead_letters(own).select("key", "receives")


@query("str9_job_status", "SELECT c_custkey::VARCHAR AS processing_id, c_custkey IN (SELECT user_id FROM events) AS found FROM customer")
def _(spark, d):
    asked = given(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("processing_id"))
    return J.job_status(asked, J.job_states(status_events(spark, d), ["error_message"])).select("processing_id", "found")


@query("str10_deduplicated", "SELECT user_id::VARCHAR AS processing_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM events GROUP BY ALL")
def _(spark, d):
    return J.deduplicated(status_events(spark, d)).select("processing_id", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("first"))
