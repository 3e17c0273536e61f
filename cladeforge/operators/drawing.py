"""Colours of tree nodes from counts: each sample's colour at an opacity that its score sets, mixed in sample order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.functions import colours
from cladeforge.operators import phylo, results


def colour_table(counts: DataFrame, sample_colours: dict[str, str], log: bool = False, cpm: float = 0.0) -> DataFrame:
    """(node, colour) of nodes with any count above a sample's cutoff. counts: sample, node, cnt. Samples are mixed in the order given."""
    rows = [(s, i, c.lstrip("#").upper()) for i, (s, c) in enumerate(sample_colours.items())]
    known = F.broadcast(counts.sparkSession.createDataFrame(rows, "sample string, place int, colour string"))  # the caller's list
    kept = results.cpm_cutoff(counts, cpm) if cpm else counts
    scored = kept.where("cnt > 0").join(known, "sample")
    ends = scored.groupBy("sample").agg(F.max("cnt").cast("double").alias("most"), F.min("cnt").cast("double").alias("least"))
    q = colours.opacity(F.col("cnt").cast("double"), F.col("least"), F.col("most"), log)
    parts = scored.join(phylo.sized(ends), "sample").select("node", F.struct("place", "colour", q.alias("q")).alias("p"))  # a row a sample
    return parts.groupBy("node").agg(colours.blend(F.sort_array(F.collect_list("p"))).alias("colour"))
