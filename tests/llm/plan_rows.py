"""Rows that the joins of finished queries have made, from Spark's own metrics."""

import re


def newest(spark) -> int:
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((found.apply(i).executionId() for i in range(found.size())), default=-1)


def join_rows(spark, since: int) -> list[int]:
    """Of every join of queries after execution ``since``, the number of output rows."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    found = store.executionsList()
    for i in range(found.size()):
        at = found.apply(i).executionId()
        if at <= since:
            continue
        values = store.executionMetrics(at)
        nodes = store.planGraph(at).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if not re.search("Join|Cartesian|Generate|MapInArrow", node.name()):
                continue
            for m in range(node.metrics().size()):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    out.append(int(re.sub(r"\D", "", values.apply(metric.accumulatorId()).split("\n")[-1].split("(")[0]) or 0))
    return out
