"""All registered queries with their SQL checks."""

import importlib

AREAS = ("feed", "normalizing", "maintaining", "cleaning", "landing", "extracting", "tagging", "ingesting",
         "retrieving", "scoring", "analysing", "streaming")


def load():
    for area in AREAS:
        importlib.import_module(f"tenderspark.catalog.{area}")
    from tenderspark.catalog.registry import CHECKS, QUERIES
    return QUERIES, CHECKS
