"""Queries on implausible measurements."""

from corpusloom.operators import spikes
from corpusloom.plans.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.add("p1_found")
def p1_found(spark, folder):
    return spikes.found_spikes(table(spark, folder, "manifest"))


@REGISTRY.add("p1_scores")
def p1_scores(spark, folder):
    return spikes.score_durations(table(spark, folder, "manifest"))
