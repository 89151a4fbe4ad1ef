"""Graph questions about circuits, set at a time (GQ-1 to GQ-8).

nets: (schematic_id, name, connected_components array<string>). components: (schematic_id, reference,
value, ...). Keys come as tables. ``by`` names the columns that tell circuits apart; with none, nets of
all circuits mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ohmlake.plans.storage import stored

CIRCUIT = ["schematic_id"]
# Rails, and those that count as pull-up voltages.
RAILS = ["+3V3", "+5V", "GND"]
PULL_UP_RAILS = ["+3V3", "+5V"]


def incidence(nets: DataFrame, by: list[str] = CIRCUIT) -> DataFrame:
    """(by, net, reference), once however often a reference stands on a net."""
    return nets.select(*by, F.col("name").alias("net"), F.explode(F.array_distinct("connected_components")).alias("reference"))


def nets_for_component(nets: DataFrame, keys: DataFrame, by: list[str] = CIRCUIT) -> DataFrame:
    """GQ-1, GQ-4: (by, reference, net) for each key (by, reference)."""
    return incidence(nets, by).join(keys.select(*by, "reference").distinct().hint("merge"), [*by, "reference"]).select(*by, "reference", "net")


def components_on_net(nets: DataFrame, components: DataFrame, keys: DataFrame | None = None, by: list[str] = CIRCUIT) -> DataFrame:
    """GQ-2: the components of each net, all their columns; keys: (by, net), all nets if None."""
    on = incidence(nets, by)
    if keys is not None:
        on = on.join(keys.select(*by, "net").distinct(), [*by, "net"], "left_semi")
    return on.join(components.hint("merge"), [*by, "reference"])


def groups_touching_net(nets: DataFrame, groups: DataFrame, keys: DataFrame | None = None, by: list[str] = CIRCUIT) -> DataFrame:
    """GQ-3: (by, net, name) of functional groups that share a component with a net."""
    on = incidence(nets, by)
    if keys is not None:
        on = on.join(keys.select(*by, "net").distinct(), [*by, "net"], "left_semi")
    members = groups.select(*by, "name", F.explode(F.array_distinct("components")).alias("reference"))
    return on.join(members, [*by, "reference"]).select(*by, "net", "name").distinct()


def rails_on_net(nets: DataFrame, components: DataFrame, keys: DataFrame | None = None, by: list[str] = CIRCUIT, rails: list[str] = RAILS) -> DataFrame:
    """GQ-5: (by, net, reference, value) of components whose value is a rail."""
    rail = components.where(F.col("value").isin(rails)).select(*by, "reference", "value")
    return components_on_net(nets, rail, keys, by).select(*by, "net", "reference", "value")


def filters_near_component(nets: DataFrame, components: DataFrame, keys: DataFrame, by: list[str] = CIRCUIT) -> DataFrame:
    """GQ-6: (by, reference, net) where the net also has R* and C*, or C* and a ground rail."""
    facts = components_on_net(nets, components.select(*by, "reference", "value"), by=by).groupBy(*by, "net").agg(
        F.bool_or(F.col("reference").startswith("R")).alias("has_r"),
        F.bool_or(F.col("reference").startswith("C")).alias("has_c"),
        F.bool_or(F.col("value") == "GND").alias("has_gnd"),
    )
    hit = facts.where(F.col("has_c") & (F.col("has_r") | F.col("has_gnd"))).select(*by, "net")
    return nets_for_component(nets, keys, by).join(hit.hint("merge"), [*by, "net"])


def pull_up_voltages(nets: DataFrame, components: DataFrame, keys: DataFrame, by: list[str] = CIRCUIT) -> DataFrame:
    """GQ-7: (by, reference, voltages) for each key: rails on all nets of the resistors on its nets.

    A net hands on the few rails that it has, so no join has more rows than parts have nets, times the rails.
    """
    on = incidence(nets, by)
    resistors = on.where(F.col("reference").startswith("R")).join(components.select(*by, "reference").hint("merge"), [*by, "reference"], "left_semi")
    rails = rails_on_net(nets, components, None, by, PULL_UP_RAILS).select(*by, "net", "value").distinct()
    of_resistor = resistors.join(rails.hint("merge"), [*by, "net"]).select(*by, "reference", "value").distinct()
    of_net = resistors.join(of_resistor.hint("merge"), [*by, "reference"]).select(*by, "net", "value").distinct()
    found = nets_for_component(nets, keys, by).join(of_net.hint("merge"), [*by, "net"]).groupBy(*by, "reference").agg(F.array_sort(F.collect_set("value")).alias("voltages"))
    asked = keys.select(*by, "reference").distinct()
    return asked.join(found.hint("merge"), [*by, "reference"], "left").select(*by, "reference", F.coalesce("voltages", F.array().cast("array<string>")).alias("voltages"))


def routed(questions: DataFrame, text: str = "question") -> DataFrame:
    """GQ-8: questions with refs, pin and route: filter, voltage, both, or semantic when none of these can answer."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    refs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\b([A-Z]{1,3}\d{1,4})\b"), F.lit(1))
    pin = F.nullif(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?i)\bpin\s+(\d{1,3})\b", 1), F.lit(""))
    some = F.size(refs) > 0
    wants_filter, wants_voltage = low.contains("filter") & some, (low.contains("voltage") | low.contains("pull up") | low.contains("pull-up")) & some
    route = F.when(wants_filter & wants_voltage, "both").when(wants_filter, "filter").when(wants_voltage, "voltage").otherwise("semantic")
    return questions.withColumns({"refs": refs, "pin": pin, "route": route})


def answers(questions: DataFrame, nets: DataFrame, components: DataFrame, question_id: str = "question_id", text: str = "question", by: list[str] = CIRCUIT) -> DataFrame:
    """GQ-8: (question id, by, reference, kind, answer) for questions that a heuristic answers; the rest is for vector search.

    Nets, components and questions are read several times, so each is made once and stored.
    """
    nets = stored(nets.select(*by, "name", "connected_components"), "nets")
    components = stored(components.select(*by, "reference", "value"), "components")
    asked = stored(routed(questions, text).where("route <> 'semantic'").select(question_id, *by, "route", F.explode("refs").alias("reference")), "asked")
    keys = asked.select(*by, "reference").distinct()
    hits = filters_near_component(nets, components, keys, by).groupBy(*by, "reference").agg(F.array_join(F.array_sort(F.collect_set("net")), ",").alias("answer"))
    volts = pull_up_voltages(nets, components, keys, by).select(*by, "reference", F.array_join("voltages", ",").alias("answer"))
    one = lambda kind, table: asked.where(F.col("route").isin(kind, "both")).join(table.hint("merge"), [*by, "reference"], "left").select(question_id, *by, "reference", F.lit(kind).alias("kind"), F.coalesce("answer", F.lit("")).alias("answer"))
    return one("filter", hits).unionByName(one("voltage", volts))
